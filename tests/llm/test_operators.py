"""Each operator against brute force, with nulls, empty texts, ties, repeated rows and clashing columns."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from xxhash import xxh64_intdigest

import public_tokenizers
from evalspark.llm import bpe, langid, packing, ppm, queries, sharding, simhash, sketch, suffix, topk, urlfilter
from evalspark.llm.common import join_keys, join_spread, repeats

EXTRA = "doc_id long, text string, lang string, source string, n_chars long, rank int, g string, key string, _bucket long"


def frame(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, None, None, None, 1, "x", None, 7) for i, t in zip(ids, texts, strict=True)], EXTRA)


WORDS = "the of and la de el und der ist que tion ment ing 's x1 22 ß é 日本".split()


@pytest.fixture(scope="module")
def texts():
    r = random.Random(3)
    some = [" ".join(r.choice(WORDS) + (r.choice(WORDS) if r.random() < 0.5 else "") for _ in range(r.randint(0, 60))) for _ in range(60)]
    return [*some, None, "", " \n ", some[3], some[3], "a" * 9000, "One Two\tthree", "one two THREE", "word " * 3000, "<|endoftext|> x"]


@pytest.fixture(scope="module")
def ids(texts):
    out = list(range(len(texts)))
    out[5] = None
    out[-3] = out[-4]
    return out


def test_bpe_agrees_with_the_library():
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own, r = bpe.Codec(bpe.vocabulary_path(), bpe.split_pattern(), limit=16), random.Random(1)
    parts = ["a", "b", " ", "\n", "'s", "'l", "l", "the", "é", "<|endoftext|>", "1", "22", "!!", "  ", "\t", "\x1c", "日本"]
    for i in range(1500):
        text = "".join(r.choice("abthe") for _ in range(300)) if i % 4 == 0 else "".join(r.choice(parts) for _ in range(r.randint(0, 80)))
        found = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == found, text
        assert own.decode(found) == library.decode(found, skip_special_tokens=False)


def test_bpe_operator(spark, texts, ids):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = bpe.encode_decode(frame(spark, texts, ids), limit=64).collect()
    want = Counter((i, t or "", tuple(library.encode(t or "", add_special_tokens=False).ids)) for i, t in zip(ids, texts, strict=True))
    assert Counter((r.doc_id, r.decoded, tuple(r.ids)) for r in rows) == want
    assert bpe.encode_decode(frame(spark, [])).count() == 0


def test_bpe_of_long_texts_by_many_tasks(spark):
    """Texts above the bound for one task, with an unsplit stretch of many parts; and one of 10 MB."""
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    r = random.Random(21)
    run = lambda n, letters="abthé": "".join(r.choices(letters, k=n))
    some = [run(900) + " ".join(run(5) for _ in range(80)) + "<|endoftext|>" + run(700) + "  \n " + run(300, "日本a!") + "<|endoftext|><|endoftext|>", "x" * 1500 + " y", "short", None, " " * 900 + "a's", run(400)]
    ids = [3, None, 5, 6, 3, 3]
    got = bpe.encode_decode(frame(spark, some, ids), limit=50, whole=350, part=64).collect()
    want = Counter((i, t or "", tuple(library.encode(t or "", add_special_tokens=False).ids)) for i, t in zip(ids, some, strict=True))
    assert Counter((x.doc_id, x.decoded, tuple(x.ids)) for x in got) == want
    large = "".join(r.choices(["the", "ing", "a", "Qu", "x"], k=5_000_000))
    assert len(large) > 9_000_000
    row = bpe.encode_decode(spark.createDataFrame([(1, large)], "doc_id long, text string"), digests=True).first()
    assert row.decoded_sha256 == hashlib.sha256(large.encode()).hexdigest()
    own = bpe.Codec(bpe.vocabulary_path(), bpe.split_pattern())
    assert row.ids_sha256 == hashlib.sha256(",".join(map(str, own.encode(large))).encode()).hexdigest()


def test_pack_histogram_holds_every_piece():
    r = random.Random(2)
    for size in (1, 8, 64):
        counts = {n: r.randint(1, 50) for n in range(1, size + 1) if r.random() < 0.7}
        held = Counter()
        for n, pattern in packing.pack_histogram(counts, size):
            assert n > 0 and sum(k * v for k, v in pattern.items()) <= size
            for k, v in pattern.items():
                held[k] += n * v
        assert held == Counter(counts)


def test_packing(spark, texts, ids):
    rows = packing.pack_documents(frame(spark, texts, ids), 64, keep_ids=True).collect()
    own = bpe.Codec(bpe.vocabulary_path(), bpe.split_pattern())
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append(r)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and len(r.ids) == r.length
    for some in by.values():
        at = 0
        for r in sorted(some, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64
    want = Counter((i, s, tuple(x[s : s + 64])) for i, t in zip(ids, texts, strict=True) for x in [[*own.encode(t or ""), 0]] for s in range(0, len(x), 64))
    assert Counter((r.doc_id, r.start, tuple(r.ids)) for r in rows) == want
    assert packing.pack_documents(frame(spark, []), 64).count() == 0


@pytest.mark.parametrize("shards", [1, 5, 24])
def test_sharding(spark, texts, ids, shards):
    rows = sharding.shard_documents(frame(spark, texts, ids), shards, nodes=8).collect()
    data = [(t or "").encode() for t in texts]
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == Counter((i, len(b) + 8, zlib.crc32(b)) for i, b in zip(ids, data, strict=True))
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    counts = [len(slots[s]) for s in range(shards)]
    assert max(counts) - min(counts) <= 1
    assert sharding.shard_documents(frame(spark, []), shards, nodes=8).count() == 0


def test_sharding_places_keys_on_the_ring(spark):
    """Each row's shard, from the ring walked key by key: home first, then clockwise to the next shard with room."""
    n, shards, nodes = 400, 6, 8
    rows = sharding.shard_documents(spark.range(n).selectExpr("id AS doc_id", "concat('t', id) AS text"), shards, nodes=nodes).collect()
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    points = sorted((signed(int.from_bytes(hashlib.blake2b(b"%d/%d" % (s, v), digest_size=8).digest(), "big")), s) for s in range(shards) for v in range(nodes))
    arcs = defaultdict(int)
    where = {}
    for i in range(n):
        h = signed(xxh64_intdigest(i.to_bytes(8, "little", signed=True), 42))
        arc = next((k for k, (p, _) in enumerate(points) if p >= h), 0)
        arcs[arc] += 1
        where[i] = arc
    room = [n // shards + (s < n % shards) for s in range(shards)]
    want = defaultdict(Counter)
    left = {}
    for arc in sorted(arcs):
        home = points[arc][1]
        take = min(arcs[arc], room[home])
        room[home] -= take
        want[arc][home] += take
        left[arc] = arcs[arc] - take
    for arc in sorted(left):
        at = arc
        while left[arc]:
            at = (at + 1) % len(points)
            take = min(left[arc], room[points[at][1]])
            room[points[at][1]] -= take
            want[arc][points[at][1]] += take
            left[arc] -= take
    got = defaultdict(Counter)
    for x in rows:
        got[where[x.doc_id]][x.shard] += 1
    assert {a: +c for a, c in want.items()} == dict(got)


def test_bounded_loads_keep_keys_at_home():
    points, owners = sharding.ring(6, 16)
    counts = {a: 10 + a % 7 for a in range(len(points))}
    room = sharding.capacities(sum(counts.values()), 6, 0.25)
    rows = sharding.allot(counts, owners, room)
    held, home = Counter(), 0
    rows.sort()
    for (a, first, shard, _), after in zip(rows, [*rows[1:], (None, 0, 0, 0)], strict=True):
        n = (after[1] if after[0] == a else counts[a]) - first
        held[shard] += n
        home += n * (shard == owners[a])
    assert sum(held.values()) == sum(counts.values()) and all(held[s] <= room[s] for s in range(6))
    due = Counter()
    for a, n in counts.items():
        due[owners[a]] += n
    assert home == sum(min(due[s], room[s]) for s in range(6))


def test_language_id(spark):
    r = random.Random(4)
    kinds = {"aa": ["bo", "ka", "lu"], "bb": ["stre", "fi", "gow"], "cc": ["ño", "él", "ção"]}
    rows = [(i, " ".join("".join(r.choices(kinds[k], k=3)) for _ in range(30)), k) for i, k in enumerate(r.choices(list(kinds), k=120))]
    rows += [(200, None, "aa"), (201, " 12 %%", None), (None, "Boka! LUKA", None), (7, "éLÑO", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS score", "'q' AS lang_pred")
    got = langid.predict(docs, langid.fit(docs.where(langid.fold("doc_id", 3) != 1)), keep=("lang",)).collect()
    for x in got:
        assert 0 <= x.score <= 1 and (x.lang is None or x.lang_pred == x.lang or x.doc_id == 200)
    assert {(x.doc_id, x.lang_pred) for x in got if x.doc_id in (200, 201, None)} == {(200, "und"), (201, "und"), (None, "aa")}
    none = langid.fit(docs.where("false"))
    assert {x.lang_pred for x in langid.predict(docs, none).collect()} == {"und"}
    assert langid.predict(docs.where("false"), none).count() == 0


def test_filters_hold_what_was_put_in():
    grams = {x: np.random.default_rng(i).integers(0, 1 << 63, 5000, dtype=np.uint64) for i, x in enumerate("ab")}
    filters = langid.Filters(["a", "b"], grams)
    assert (filters.languages(grams["a"])[0] & 1 == 1).all() and (filters.languages(grams["b"])[0] & 2 == 2).all()
    assert filters.wrong.max() < 0.01


def test_more_languages_than_a_word_has_bits(spark):
    r = random.Random(15)
    kinds = {f"l{i:02}": ["".join(r.choices("abcdefghijklmnop", k=4)) for _ in range(6)] for i in range(70)}
    rows = [(i, " ".join("".join(r.choices(kinds[k], k=2)) for _ in range(60)), k) for i, k in enumerate(list(kinds) * 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    filters = langid.fit(docs)
    assert len(filters.langs) == 70 and len(filters.tables) == 2
    assert all(x.lang_pred == x.lang for x in langid.predict(docs, filters, keep=("lang",)).collect())


def brute_grams(text):
    out = []
    for word in "".join(c if c.isalpha() else " " for c in text.lower()).split():
        w = f" {word} "
        out += [w[i : i + n] for n in langid.SIZES for i in range(len(w) - n + 1) if w[i : i + n].strip() and " " not in w[i + 1 : i + n - 1]]
    return out


def brute_languages(rows):
    """For each (text, language or none) the parts of its n-grams that each language's exact set holds."""
    counts = defaultdict(Counter)
    for text, k in rows:
        if k is not None and text is not None:
            counts[k].update(brute_grams(text))
    share = {k: {g: n / sum(c.values()) for g, n in c.items()} for k, c in counts.items()}
    most = {g: max(s.get(g, 0) for s in share.values()) for s in share.values() for g in s}
    held = {k: {g for g, x in s.items() if x >= langid.MIN_SHARE and x >= langid.MIN_PART * most[g]} for k, s in share.items()}
    found = [brute_grams(text or "") for text, _ in rows]
    return [{k: sum(g in held[k] for g in f) / len(f) for k in counts} if f else {} for f in found]


def test_language_id_by_exact_sets(spark):
    """The prediction is that of the n-gram sets which the filters stand for, learned and counted here in plain Python."""
    r = random.Random(16)
    kinds = {"aa": ["bo", "ka", "lu", "mi"], "bb": ["bo", "fi", "gow", "mi"], "cc": ["ño", "él", "ka"]}
    rows = [(i, " ".join("".join(r.choices(kinds[k], k=2)) for _ in range(r.randint(1, 8))), k) for i, k in enumerate(r.choices(list(kinds), k=150))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    want = brute_languages([(t, k) for _, t, k in rows])
    for x in langid.predict(docs, langid.fit(docs)).collect():
        parts = want[x.doc_id]
        assert x.score == pytest.approx(max(parts.values()), abs=0.01) and parts[x.lang_pred] == max(parts.values())


def brute_fingerprint(text, words=3):
    w = (text or "").encode().lower().split()
    runs = [b" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] or ([b" ".join(w)] if w else [])
    h = [xxh64_intdigest(x, 42) for x in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_anchors_meet():
    r = np.random.default_rng(0)
    x = r.integers(0, 1 << 31, 2000, dtype=np.uint64)
    home, _ = simhash.anchors(x)
    assert np.bitwise_count(home ^ x).max() <= 1
    for y in (x, x ^ (np.uint64(1) << r.integers(0, 31, 2000, dtype=np.uint64))):
        own, far = simhash.anchors(y)
        assert ((home == own) | (far == home[:, None]).any(axis=1)).all()


def test_simhash(spark, texts, ids):
    more = [*texts, *[f"{texts[0]} {w}" for w in WORDS], *[(texts[1] or "") + " " + texts[2] + f" {w}" for w in WORDS]]
    own = [*ids, *range(100, 100 + len(more) - len(ids))]
    prints = [brute_fingerprint(t) for t in more]
    parent = list(range(len(more)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(prints):
        for j, b in enumerate(prints[:i]):
            if (a ^ b).bit_count() <= 2:
                parent[root(i)] = root(j)
    least = defaultdict(list)
    for i in range(len(more)):
        least[root(i)].append(own[i])
    want = Counter((own[i], f"{prints[i]:016x}", min((x for x in least[root(i)] if x is not None), default=None)) for i in range(len(more)))
    assert Counter(map(tuple, simhash.simhash_groups(frame(spark, more, own)).collect())) == want
    assert simhash.simhash_groups(frame(spark, [])).count() == 0


def test_large_groups_by_flipping_bits(monkeypatch):
    r = np.random.default_rng(1)
    fp = np.unique(np.bitwise_xor(r.integers(0, 4, 300), np.int64(1) << r.integers(0, 62, 300)))
    key, home = np.zeros(len(fp), np.int64), np.ones(len(fp), bool)
    few = simhash._links(key, home, fp, 2)
    monkeypatch.setattr(simhash, "LARGE", 10)
    assert set(zip(*few, strict=True)) == set(zip(*simhash._links(key, home, fp, 2), strict=True))


def test_crowded_anchors(spark):
    """Anchors with more fingerprints than the bound are split, and no link is lost."""
    r = np.random.default_rng(4)
    fp = np.unique(np.concatenate([np.bitwise_xor(r.integers(0, 8, 200), np.int64(1) << r.integers(40, 62, 200)), r.integers(-(1 << 62), 1 << 62, 50)]))
    df = spark.createDataFrame([(int(x),) for x in fp], "fp long")
    for threshold in (0, 1, 2, 3):
        roots = []
        for hot in (3, 1 << 20):
            found = {x.node: x.root for x in simhash.components(simhash.links(df, threshold, hot=hot)).collect()}
            roots.append({int(x): found.get(int(x), int(x)) for x in fp})
        assert roots[0] == roots[1]
    near = sum(int(a ^ b).bit_count() <= 2 if (a ^ b) >= 0 else False for i, a in enumerate(fp.tolist()) for b in fp.tolist()[:i])
    assert near > 100


def test_near_copies(spark):
    r = random.Random(5)
    base = [" ".join(f"w{r.randint(0, 10**6)}" for _ in range(200)) for _ in range(20)]
    edited = [" ".join(x if i != 50 else "other" for i, x in enumerate(t.split())) for t in base[:10]]
    kept = simhash.drop_near_copies(frame(spark, [*base, *edited, base[0], base[0], None, ""], [*range(30), 30, 30, 40, 41])).collect()
    assert sorted(x.doc_id for x in kept) == [*range(20), 40]
    assert kept[0].__fields__ == [x.split()[0] for x in EXTRA.split(", ")]


def brute_groups(texts, words, similarity):
    sets = []
    for t in texts:
        w = t.lower().split()
        sets.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))})
    group = list(range(len(texts)))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if len(x & y) / len(x | y) >= similarity:
                group = [group[j] if g == group[i] else g for g in group]
    return {frozenset(i for i, g in enumerate(group) if g == k) for k in group}


@pytest.mark.parametrize("bound", [simhash.BOUND, 1000])
def test_near_groups_by_exact_similarity(spark, bound):
    """Pairs of similarity 0.7 to 0.95: words replaced, text appended, a line of few words, short texts."""
    r = random.Random(12)
    word = lambda n=10**6: f"w{r.randint(0, n)}"
    some = []
    for kind in range(200):
        n = (200, 200, 60, 15, 9)[kind % 5]
        t = [word(10**6 if kind % 2 else 40) for _ in range(n)]
        if kind % 5 == 0:
            other = list(t)
            for i in r.sample(range(n), r.randint(1, 8)):
                other[i] = word()
        else:
            other = t + [word() for _ in range(r.randint(1, n // 4))]
        some += [" ".join(t), " ".join(other)]
    want = brute_groups(some, 5, 0.8)
    assert 60 < sum(len(x) == 2 for x in want) < 180
    rows = simhash.near_groups(frame(spark, some), bound=bound).collect()
    got = defaultdict(set)
    for x in rows:
        got[x.group].add(x.doc_id)
    got = {frozenset(x) for x in got.values()}
    # No pair below 0.8 is taken; one of exactly 0.8 is met with probability 0.9993.
    assert all(len(x) == 1 or x in want for x in got)
    assert sum(len(x) == 2 for x in want - got) <= 1


def test_fingerprints_find_near_copies(spark, monkeypatch):
    """Without the bands the copies whose fingerprints differ in 3 bits or fewer are still found, and no others."""
    monkeypatch.setattr(simhash, "band_edges", lambda nodes, similarity: spark.createDataFrame([], "u long, v long"), raising=False)
    r = random.Random(31)
    word = lambda: f"w{r.randint(0, 10**6)}"
    some = []
    for i in range(24):
        t = [word() for _ in range(1000)]
        some += [" ".join(t), " ".join(x if 3 * j < i or j % 40 else word() for j, x in enumerate(t)), " ".join([*t[: 40 * i], word(), *t[40 * i :]])]
    fp = [simhash.fingerprint(simhash.hashed(t, 5)) for t in some]
    near = lambda a, b: ((fp[a] ^ fp[b]) & (1 << 64) - 1).bit_count() <= 3
    exact = {frozenset(g): i for i, g in enumerate(brute_groups(some, 5, 0.8))}
    same = {(a, b) for g in exact for a in g for b in g if a < b and near(a, b)}
    assert len(same) > 12 and sum(len(g) for g in exact if len(g) > 1) > 40
    got = defaultdict(set)
    for x in simhash.near_groups(frame(spark, some)).collect():
        got[x.group].add(x.doc_id)
    group = list(range(len(some)))
    for a, b in sorted(same):
        group = [group[a] if g == group[b] else g for g in group]
    assert {frozenset(x) for x in got.values()} == {frozenset(i for i, g in enumerate(group) if g == k) for k in group}


def test_large_near_groups_lose_no_link(spark):
    """Groups above the bound for one task: variants of few texts, linked in chains and through the hubs or not at all."""
    r = random.Random(22)
    word = lambda: f"w{r.randint(0, 10**6)}"
    some = []
    for _ in range(3):
        t = [word() for _ in range(120)]
        for step in range(60):
            if step % 3 == 0:  # the chain goes on from the variant, so its ends aren't similar
                t = [x if r.random() > 0.01 else word() for x in t]
            some.append(" ".join(x if r.random() > 0.012 else word() for x in t))
    want = brute_groups(some, 5, 0.8)
    for bound in (1 << 20, 20_000, 3_000):
        got = defaultdict(set)
        for x in simhash.near_groups(frame(spark, some), bound=bound).collect():
            got[x.group].add(x.doc_id)
        got = {frozenset(x) for x in got.values()}
        assert all(any(g <= w for w in want) for g in got)
        # A link is missed only where its two texts share no band and nothing links them otherwise.
        assert len(got) <= len(want) + 2


def test_similar_groups():
    r = random.Random(13)
    base = [[r.randint(0, 10**6) for _ in range(r.randint(1, 40))] for _ in range(25)]
    some = [sorted({x if r.random() > p else r.randint(0, 30) for x in b}) for b in base for p in (0, 0.05, 0.1, 0.2)]
    group = list(range(len(some)))
    for i, x in enumerate(some):
        for j, y in enumerate(some[:i]):
            if len(set(x) & set(y)) / len(set(x) | set(y)) >= 0.8:
                group = [min(group[i], group[j]) if g in (group[i], group[j]) else g for g in group]
    assert simhash.similar_groups([np.array(x, dtype=np.uint64) for x in some], 0.8).tolist() == group


def brute_repeats(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + length] for t in data for i in range(len(t) - length + 1))
    out = []
    for t in data:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        left = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((len(t), len(t) - len(left), runs, hashlib.sha256(left).hexdigest()))
    return out


@pytest.mark.parametrize(("hot", "widths"), [(1 << 16, (32, 4, 1)), (200, (16, 4, 1)), (0, (8, 1))])
def test_suffix_dedup(spark, hot, widths):
    r = random.Random(6)
    base = ["".join(r.choice("abcdé ") for _ in range(300)) for _ in range(5)]
    some = ["".join(r.choice(base)[r.randint(0, 60) : r.randint(150, 300)] if r.random() < 0.5 else "".join(r.choice("abcdefgh") for _ in range(r.randint(0, 90))) for _ in range(r.randint(0, 5))) for _ in range(60)]
    some += [None, "", "a" * 500, "ab" * 200, some[3], some[3]]
    own = [*range(len(some) - 2), 3, 3]
    own[9] = None
    rows = suffix.remove_repeats(frame(spark, some, own), 70, keep=("lang", "key"), hot=hot, widths=widths).collect()
    want = Counter((i, *x) for i, x in zip(own, brute_repeats(some, 70), strict=True))
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows) == want
    assert suffix.remove_repeats(frame(spark, []), 70).count() == 0


@pytest.mark.parametrize(("hot", "widths"), [(1 << 16, (32, 4, 1)), (200, (16, 4, 1)), (0, (8, 1))])
def test_suffix_dedup_of_two_lengths(spark, hot, widths):
    """Each length as by brute force alone, at the ends of texts too, where a longer passage no longer fits."""
    r = random.Random(16)
    base = ["".join(r.choice("abcdefg ") for _ in range(400)) for _ in range(5)]
    some = ["".join(r.choice(base)[r.randint(0, 60) : r.randint(120, 400)] if r.random() < 0.6 else "".join(r.choice("abcdefgh") for _ in range(r.randint(0, 90))) for _ in range(r.randint(0, 4))) for _ in range(60)]
    some += [None, "", "a" * 500, "ab" * 60, base[0][:130], base[0][:131], base[0][60:190], base[1][:70] + base[2][:70], base[1][:70], some[3], some[3]]
    rows = {x.doc_id: x for x in suffix.remove_repeats(frame(spark, some), 131, shorter=70, hot=hot, widths=widths).collect()}
    for i, (long, short) in enumerate(zip(brute_repeats(some, 131), brute_repeats(some, 70), strict=True)):
        x = rows[i]
        assert (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) == long
        assert hashlib.sha256(x.kept.encode()).hexdigest() == long[3] and hashlib.sha256(x.kept_shorter.encode()).hexdigest() == short[3]
    assert any(x.kept != x.kept_shorter for x in rows.values())


def test_passages_of_over_fifty_words(spark, tmp_path):
    """A passage of 60 words and under 400 bytes in two texts: the law of op5 leaves it, its further text doesn't have it."""
    r = random.Random(18)
    words = lambda n: " ".join("".join(r.choices("abcdefgh", k=r.randint(3, 6))) for _ in range(n))
    passage = words(60)
    some = [words(80) + " " + passage + " " + words(50), passage + " " + words(90), words(120)]
    assert 200 < len(passage) < 400
    frame(spark, some).write.parquet(f"{tmp_path}/documents.parquet")
    rows = {x.doc_id: x for x in queries.op5_suffix_dedup(spark, str(tmp_path)).collect()}
    assert [(rows[i].n_removed, rows[i].text) for i in range(3)] == [(0, t) for t in some]
    assert [passage in rows[i].text_without_passages for i in range(2)] == [False, False] and rows[2].text_without_passages == some[2]


def test_suffix_dedup_with_production_values(spark):
    """Texts of megabytes, passages over the borders of blocks, and one text whole in another's midst."""
    r = random.Random(17)
    text = lambda n: "".join(r.choices("abcdefgh ", k=n))
    passage, copy = text(700), text(3000)
    a = text(suffix.BLOCK - 300) + passage + text(2 * suffix.BLOCK - 500) + copy + text(900)
    b = text(5000) + passage + text(399) + copy[1000:1500] + text(100)
    some = [a, b, copy, copy, text(1 << 21) + passage[100:520], None, passage[:400], passage[1:400]]
    rows = {x.doc_id: x for x in suffix.remove_repeats(frame(spark, some)).collect()}
    for i, want in enumerate(brute_repeats(some, 400)):
        assert (rows[i].n_bytes, rows[i].n_removed, rows[i].n_spans, rows[i].kept_sha256) == want
    assert rows[6].n_removed == 400 and rows[7].n_removed == 0 and rows[0].n_removed >= 3700


def test_suffix_order():
    r = random.Random(7)
    for letters in ("ab", "a", "abcdefgh"):
        text = bytes(r.choice(letters.encode()) for _ in range(400)) + bytes(64)
        starts = np.array(sorted(r.sample(range(380), 200)))
        order = suffix.suffix_order(np.frombuffer(text, np.uint8), starts, 40)
        assert sorted(order) == sorted(starts)
        cut = [text[p : p + 40] for p in order]
        assert cut == sorted(cut)


def test_shared_starts():
    r = random.Random(8)
    base = bytes(r.choices(b"abc", k=300))
    text = b"".join(base[i : i + r.randint(20, 200)] for i in (r.randint(0, 99) for _ in range(12)))
    starts = np.array(sorted(r.sample(range(len(text)), len(text) * 4 // 5)))
    data = np.frombuffer(text + bytes(80), np.uint8)
    for some in (starts, np.arange(len(text)), starts[:1], starts[:0]):
        order = suffix.suffix_order(data, some, 60) if len(some) else some
        for length in (33, 60):
            want = [i > 0 and data[p : p + length].tobytes() == data[order[i - 1] : order[i - 1] + length].tobytes() for i, p in enumerate(order)]
            assert suffix.shared_starts(data, order, length).tolist() == want


def test_ppm_is_a_distribution(spark):
    texts = [b"abracadabra", b"abc", b"", "ñandú".encode(), b"abra abra"]
    keys, counts = ppm._merge([np.unique(k, return_counts=True) for _, _, k, _ in ppm.grams(texts)])
    trie = ppm.Trie(spark.createDataFrame([(int(k), int(n)) for k, n in zip(keys, counts, strict=True)], "gram long, n long"))
    seen = {r.gram: r.log10 for r in trie.seen().collect()}
    contexts = (b"\xfe\xfe\xfe\xfe\xfe", b" abra", b"zzzzz", b"zzabr", b"\xfe\xfe\xfeab")
    symbols = [s for s in range(256) if s != ppm.START]
    packed = lambda context, s: int.from_bytes(context, "big") << 8 | s
    rest = [(packed(c, s),) for c in contexts for s in symbols if packed(c, s) not in seen]
    both = seen | {r.gram: r.log10 for r in trie.unseen(spark.createDataFrame(rest, "gram long")).collect()}
    for context in contexts:
        assert sum(10 ** both[packed(context, s)] for s in symbols) == pytest.approx(1)
    empty = ppm.Trie(spark.createDataFrame([], "gram long, n long"))
    assert empty.unseen(spark.createDataFrame([(5,)], "gram long")).first().log10 == pytest.approx(-math.log10(255))


def brute_ppm(train, text):
    counts = defaultdict(Counter)
    pad = [ppm.START] * ppm.ORDER
    for t in train:
        s = [*pad, *t, ppm.END]
        for i in range(ppm.ORDER, len(s)):
            for d in range(ppm.ORDER + 1):
                counts[tuple(s[i - d : i])][s[i]] += 1
    total, s = 0.0, [*pad, *text, ppm.END]
    for i in range(ppm.ORDER, len(s)):
        left = set()
        for d in range(ppm.ORDER, -1, -1):
            own = {k: v for k, v in counts.get(tuple(s[i - d : i]), {}).items() if k not in left}
            if not own:
                continue
            n, q = sum(own.values()), len(own)
            if s[i] in own:
                total += math.log10(own[s[i]] / (n + q))
                break
            total += math.log10(q / (n + q))
            left |= set(own)
        else:
            total -= math.log10(ppm.SYMBOLS - len(left))
    return total


@pytest.mark.parametrize("head", [0, 30, 10_000])
def test_lm_scores(spark, texts, ids, head):
    docs = frame(spark, texts, ids)
    learn = langid.fold("doc_id", 7) != 2
    rows = ppm.score_documents(docs, docs.where(learn), head_words=head, head_grams=head).collect()
    held = [zlib.crc32((str(i) if i is not None else "").encode()) % 7 == 2 for i in ids]
    tokens = [[*(t or "").encode().lower().split(), b" "] for t in texts]
    c = Counter(w for h, ws in zip(held, tokens, strict=True) if not h for w in ws)
    n, v = sum(c.values()), len(c)
    train = [(t or "").encode() for t, h in zip(texts, held, strict=True) if not h]
    want = sorted(
        (-1 if i is None else i, len(ws), sum(w in c for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 6), round(brute_ppm(train, (t or "").encode()), 6))
        for i, t, ws in zip(ids, texts, tokens, strict=True)
    )
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in rows)
    for a, b in zip(got, want, strict=True):
        assert a == pytest.approx(b)
    assert ppm.score_documents(docs.where("false"), docs.where("false")).count() == 0
    assert {r.n_known for r in ppm.score_documents(docs, docs.where("false")).collect()} == {0}


def test_urls(spark):
    urls = ["http://a.EXAMPLE.com/en/x?q#f", "https://www.example.com/en/", "http://example.com", "x.net/es/", None, "", "http://b.net/es/1", "ftp://net/fr/", "http://notnet/fr/", "http://example.com/en", "http://example.com/en/#a", "http://c.org/", "a://b://net/fr/", "http://b.net/es/1"]
    pages = spark.createDataFrame([(i, u, None, "h") for i, u in enumerate(urls)], "page_id long, url string, html string, host string")
    rules = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
    want = {}
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else None
        cut = lambda s, stops: s[: min([s.find(x) for x in stops if x in s], default=len(s))]
        host = cut(rest, "/?#").lower() if rest is not None else ""
        path = cut(rest[len(host) :], "?#") if rest is not None else ""
        fit = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        want[i] = (host, path, max(fit)[1] if fit else None, max(fit)[2] if fit else "allow")
    rows = urlfilter.judge_urls(pages, urlfilter.rule_table(spark, rules)).collect()
    assert len(rows) == len(urls) and {r.page_id: tuple(r)[1:] for r in rows} == want
    assert urlfilter.judge_urls(pages.where("false"), urlfilter.rule_table(spark, rules)).count() == 0


def test_cover_tree():
    """Nesting, covering, separation and levels; every vector stands below one leaf."""
    r = np.random.default_rng(6)
    for x in (r.normal(size=(400, 5)).round(2) * 100, np.repeat(r.integers(0, 9, (40, 3)), 9, axis=0).astype(float), np.ones((100, 4)), r.normal(size=(1, 3))):
        tree = topk.CoverTree(x)
        assert sorted(tree.order) == list(range(len(x)))
        for n, kids in enumerate(tree.children):
            below = x[tree.order[slice(*tree.span[n])]]
            away = np.sqrt(((below - x[tree.centers[n]]) ** 2).sum(axis=1))
            assert away.max() <= tree.radius[n] + 1e-6
            if not len(kids):
                assert len(below) <= topk.LEAF or away.max() == 0
                continue
            cover = topk.BASE ** (tree.level[n] - 1)
            centers = x[[tree.centers[c] for c in kids]]
            assert tree.centers[n] == tree.centers[kids[0]] and tree.radius[n] <= topk.BASE ** tree.level[n] + 1e-6
            assert all(tree.radius[c] <= cover + 1e-6 and (tree.level[c] is None or tree.level[c] < tree.level[n]) for c in kids)
            gaps = np.sqrt(((centers[:, None] - centers[None, :]) ** 2).sum(axis=2))[~np.eye(len(kids), dtype=bool)]
            assert (gaps > cover * (1 - 1e-6)).all()


def test_top_k_of_clusters(spark):
    """Clusters far apart, in many small groups and blocks."""
    r = np.random.default_rng(8)
    middle = r.normal(size=(12, 8)) * 40
    x = np.concatenate([m + r.normal(size=(150, 8)) for m in middle]).astype(np.float32)
    vectors = spark.createDataFrame([(i, [float(y) for y in v]) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {(q.query_id, q["rank"]): (q.vec_id, q.score) for q in topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), 4, rows=100, per_block=10).collect()}
    whole = np.floor(1024 * x.astype(float)).astype(int)
    for q in range(0, len(x), 50):
        score = whole @ whole[q]
        best = sorted((-int(s), i) for i, s in enumerate(score) if i != q)[:4]
        assert [got[q, n] for n in range(1, 5)] == [(i, -s) for s, i in best]


@pytest.mark.parametrize("blocks", [(8192, 2048), (40, 3)])
def test_top_k(spark, blocks):
    r = np.random.default_rng(3)
    data = [(i, [float(x) for x in r.normal(size=6) + 3 * (i % 4)], i) for i in range(300)] + [(300, None, 0), (301, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0), (302, [float("nan")] * 6, 0), (303, [float("inf")] * 6, 0), (None, [1.0] * 6, 0), (304, [], 0), (305, [1.0, 2.0], 0), (12, data_ := [9.0] * 6, 0), (306, data_, 1), (307, data_, 2)]
    vectors = spark.createDataFrame(data, "vec_id long, embedding array<float>, rank int")
    rows = topk.top_k(vectors, vectors.where("vec_id % 10 = 0"), 5, rows=blocks[0], per_block=blocks[1]).collect()
    ok = [(i, np.floor(1024 * np.array(v, np.float32).astype(float)).astype(int)) for i, v, _ in data if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    want = set()
    for q, x in ok:
        if q % 10 == 0:
            best = sorted((-int(x @ y), i) for i, y in ok if i != q and len(x) == len(y))[:5]
            want |= {(q, n, i, -s) for n, (s, i) in enumerate(best, 1)}
    assert {tuple(r) for r in rows} == want and len(rows) == len(want)
    assert topk.top_k(vectors.where("false"), vectors.where("false"), 5).count() == 0


def test_queries_leave_settings_and_folders_as_they_were(spark, tmp_path):
    from evalspark.llm import common, queries

    docs = frame(spark, ["one two three four five six seven " * 40, "some words " * 300, None, "x"]).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, [float(i), 1.0], 0) for i in range(300)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(1, "http://a.com/x", ""), (2, None, "")], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    common.clear()
    shown = lambda: {r.key: r.value for r in spark.sql("SET").collect()}
    for name, query in queries.queries().items():
        before = shown()
        assert query(spark, str(tmp_path)).count() > 0, name
        assert shown() == before, name
    left = common.written()
    common.clear()
    fs = spark._jvm.org.apache.hadoop.fs
    assert left and not common.written()
    assert not any(fs.Path(t).getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs.Path(t)) for t in left)


def test_top_k_refuses_inexact_products(spark):
    vectors = spark.createDataFrame([(0, [1e9, 1.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="too large for exact products"):
        topk.top_k(vectors, vectors, 1).collect()


def test_top_k_of_a_query_with_two_vectors(spark):
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (0, [0.0, 1.0]), (0, [0.0, 1.0]), (1, [3.0, 0.0]), (2, [0.0, 2.0]), (3, [1.0, 0.5])], "vec_id long, embedding array<float>")
    rows = topk.top_k(vectors, vectors.where("vec_id = 0"), 3, factor=2).collect()
    assert sorted(map(tuple, rows)) == [(0, 1, 1, 12), (0, 2, 2, 8), (0, 3, 3, 4)]


def test_sketches(spark, texts, ids):
    rows = sketch.edited_fingerprints(frame(spark, texts, ids)).collect()
    assert len(rows) == len(texts)
    by = defaultdict(set)
    for r in rows:
        by[r.doc_id].add((r.n_chars, r.edited_sha256))
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    order = [(i, t or "") for i, t in sorted(zip(ids, texts, strict=True), key=lambda x: (x[0] is not None, x[0] or 0))]
    for n, (i, t) in enumerate(order):
        after = order[(n + 1) % len(order)][1]
        k = len(t) // 4
        near = {x for x, y in enumerate(order) if y[0] == i}
        if len(near) == 1 and len({y[0] for y in order[n : n + 2]}) == 2 and Counter(y[0] for y in order)[order[(n + 1) % len(order)][0]] == 1:
            assert by[i] == {(len(t), hashlib.sha256((t[: len(t) - k] + after[:k]).encode()).hexdigest())}
    same = [r.fingerprint for r in rows if r.doc_id in (3, 63, 64)]
    assert len(set(same)) == 1
    assert sketch.edited_fingerprints(frame(spark, [])).count() == 0
    assert sketch.edited_fingerprints(frame(spark, ["a b c d e f g h"])).first().near_next == 1


def graded(runs, scale=sketch.SCALE):
    """The sketch of a set of hashes: those below the least cut that leaves LEAST of them, or all."""
    while scale > 1:
        low = {h for h in runs if h < -(1 << 63) + (1 << 64) // scale}
        if len(low) >= sketch.LEAST:
            return low
        scale //= 2
    return set(runs)


def runs_of(text):
    """The hashes of all runs of five words, as Spark chains them."""
    words = text.lower().split()
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    if 0 < len(words) < 5:
        return {signed(xxh64_intdigest(" ".join(words).encode(), 42))}
    out = set()
    for i in range(len(words) - 4):
        h = 42
        for w in words[i : i + 5]:
            h = xxh64_intdigest(w.encode(), h)
        out.add(signed(h))
    return out


def test_fingerprints_by_brute_force(spark):
    r = random.Random(18)
    some = [" ".join(f"w{r.randint(0, 300)}" for _ in range(r.choice([0, 1, 3, 4, 5, 6, 40, 300, 1500]))) for _ in range(60)]
    some += [some[0], some[0] + " extra words at the end of it", "", "One two THREE four five six"]
    rows = {x.doc_id: x for x in sketch.edited_fingerprints(frame(spark, some)).collect()}
    text = lambda hashes: "".join(f"{h % (1 << 64):016x}" for h in sorted(hashes))
    part = lambda own, other: len(own & other) / len(own) if own else float(not other)
    for i, t in enumerate(some):
        after = some[(i + 1) % len(some)]
        k = len(t) // 4
        edited = t[: len(t) - k] + after[:k]
        own = graded(runs_of(t))
        got = rows[i]
        assert (got.n_chars, got.fingerprint, got.edited_fingerprint) == (len(t), text(own), text(graded(runs_of(edited))))
        assert got.near_edited == pytest.approx(part(own, runs_of(edited))) and got.near_next == pytest.approx(part(own, runs_of(after)))


def test_sketches_merge(spark):
    """Below the smaller cut the sketch of a union is the union of sketches, however unequal the texts."""
    r = random.Random(19)
    words = lambda n: [f"w{r.randint(0, 10**6)}" for _ in range(n)]
    cut_of = lambda runs: next((-(1 << 63) + (1 << 64) // s for s in (8, 4, 2) if sum(h < -(1 << 63) + (1 << 64) // s for h in runs) >= sketch.LEAST), 1 << 63)
    for n in (6, 40, 200, 3000):
        texts = [" ".join(words(n)), " ".join(words(2000))]
        rows = sketch.with_sketch(spark.createDataFrame([(t,) for t in texts], "text string"), "text", "s").collect()
        a, b = (set(x.s) for x in rows)
        whole = runs_of(texts[0]) | runs_of(texts[1])
        cut = min(cut_of(runs_of(t)) for t in texts)
        below = lambda hashes, cut=cut: {h for h in hashes if h < cut}
        assert below(a) | below(b) == below(whole) and below(graded(whole)) >= below(graded(whole) & whole)
        assert {h for h in graded(whole)} <= whole and below(a | b) == {h for h in whole if h < cut}


def test_sketches_estimate_containment(spark):
    r = random.Random(8)
    a = [f"w{r.randint(0, 10**6)}" for _ in range(4000)]
    df = spark.createDataFrame([(" ".join(a), " ".join(a[1000:]))], "x string, y string")
    both = sketch.with_sketch(sketch.with_sketch(df, "x", "sx"), "y", "sy")
    part, whole = both.select(sketch.containment(both["sx"], both["sy"]), sketch.containment(both["sy"], both["sx"])).first()
    assert abs(part - 0.75) < 0.06 and whole > 0.98


def test_short_texts_in_long_ones(spark):
    """Texts of 5 to 40 words that the next text holds whole, and likeness to the edited text."""
    r = random.Random(14)
    some = []
    for n in (5, 8, 12, 20, 40) * 12:
        short = [f"w{r.randint(0, 10**6)}" for _ in range(n)]
        long = [f"w{r.randint(0, 10**6)}" for _ in range(900)]
        some += [" ".join(short), " ".join(long[:400] + short + long[400:])]
    runs = lambda t: {tuple(w[i : i + 5]) for w in [t.split()] for i in range(max(1, len(w) - 4))}
    rows = {x.doc_id: x for x in sketch.edited_fingerprints(frame(spark, some)).collect()}
    for i, t in enumerate(some):
        after = some[(i + 1) % len(some)]
        edited = t[: len(t) - len(t) // 4] + after[: len(t) // 4]
        own, near = runs(t), (rows[i].near_edited, rows[i].near_next)
        want = (len(own & runs(edited)) / len(own), len(own & runs(after)) / len(own))
        if i % 2 == 0:
            assert want[1] == 1 and near == pytest.approx(want)
            assert len(rows[i].fingerprint) == 16 * len(own)
        else:
            assert abs(near[0] - want[0]) < 0.2 and near[1] <= want[1] + 0.2


def test_join_spread(spark):
    rows = spark.createDataFrame([(7, i) for i in range(500)] + [(i % 90, -i) for i in range(100)] + [(100 + i, i) for i in range(50)], "k long, v long")
    table = rows.groupBy("k").agg(F.count("*").alias("n")).withColumn("name", F.col("k") * 2)
    got = join_spread(rows, table, "k", "n")
    assert Counter(tuple(r) for r in got.select("k", "v", "name").collect()) == Counter((r.k, r.v, r.k * 2) for r in rows.collect())
    assert join_spread(rows.where("false"), table.where("false"), "k", "n").count() == 0


@pytest.mark.parametrize("how", ["inner", "left"])
def test_join_keys(spark, how):
    rows = spark.createDataFrame([(i % 9 if i % 3 else 7, i % 2 if i % 3 else 0, i) for i in range(300)], "a long, b long, x int")
    table = spark.createDataFrame([(i, 0, f"t{i}") for i in range(8)] + [(7, 0, "more")], "a long, b long, t string")
    again = repeats(rows)
    assert again.agg(F.sum("n")).first()[0] == 300 and repeats(rows, "x") is None
    want = Counter(map(tuple, rows.join(table, ["a", "b"], how).collect()))
    assert Counter(map(tuple, join_keys(rows, table, again, ["a", "b"], how).collect())) == want
    assert Counter(map(tuple, join_keys(rows, table, None, ["a", "b"], how).collect())) == want


def test_a_third_of_all_rows_alike(spark):
    """Rows alike in id and text, that many, are spread by what joins them, and each gives its row."""
    r = random.Random(23)
    text = lambda: " ".join(r.choice(WORDS) + r.choice(WORDS) for _ in range(r.randint(20, 60)))
    hot, passage = text(), "passage " * 30
    some = [hot] * 60 + [text() + (passage if i % 2 else "") for i in range(100)] + [None] * 20
    own = [7] * 60 + list(range(100, 200)) + [8] * 20
    docs = frame(spark, some, own)
    rows = suffix.remove_repeats(docs, 70).collect()
    assert Counter((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in rows) == Counter((i, *x) for i, x in zip(own, brute_repeats(some, 70), strict=True))
    kept = simhash.drop_near_copies(docs).collect()
    assert sorted(x.doc_id for x in kept) == [7, 8, *range(100, 200)]
    rows = sketch.edited_fingerprints(docs).collect()
    assert Counter(x.doc_id for x in rows) == Counter(own) and len({tuple(x) for x in rows}) == 102
    place = {i: t or "" for i, t in zip(own, some, strict=True)}
    order = sorted(place)
    for x in rows:
        t, after = place[x.doc_id], place[order[(order.index(x.doc_id) + 1) % len(order)]]
        k = len(t) // 4
        assert x.n_chars == len(t) and x.edited_sha256 == hashlib.sha256((t[: len(t) - k] + after[:k]).encode()).hexdigest()
