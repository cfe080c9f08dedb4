"""The pipeline's stages, each on what the one before kept."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from test_operators import brute_languages

import corpus_pipeline
from evalspark.llm import bpe, common, simhash
from evalspark.llm.common import save

DATA = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    r = random.Random(9)
    word = lambda: "".join(r.choices(["bo", "ka", "lu", "mi", "ta"], k=4))
    base = [" ".join(word() for _ in range(150)) for _ in range(30)]
    passage = " ".join(word() for _ in range(60))
    shared = [f"{base[i]} {passage} {base[i][::-1]}" for i in range(20, 24)]
    texts = [*base[:20], base[0], base[0].upper(), base[1] + " end", *shared, "12 %% 34", None, ""]
    rows = [(i, t, "aa", "s", len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    docs = save(stages["language_id"](spark, docs, str(tmp_path)))
    assert docs.columns == columns and sorted(x.doc_id for x in docs.collect()) == list(range(27))
    docs = save(stages["simhash_near_dedup"](spark, docs, str(tmp_path)))
    assert docs.columns == columns and sorted(x.doc_id for x in docs.collect()) == [*range(20), *range(23, 27)]
    docs = save(stages["suffix_array_dedup"](spark, docs, str(tmp_path)))
    kept = {x.doc_id: x for x in docs.collect()}
    assert docs.columns == columns and all(kept[i].text == texts[i] for i in range(20))
    assert all(passage not in kept[i].text and base[i - 3][:200] in kept[i].text and kept[i].n_chars == len(kept[i].text) for i in range(23, 27))
    packed = stages["packing"](spark, docs, str(tmp_path)).collect()
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    piece = lambda x: (x.doc_id, x.start, x.length, x.ids_crc32)
    assert Counter(map(piece, packed)) == Counter(map(piece, whole)) and {x.doc_id for x in packed} == set(kept)


def brute_pipeline(rows):
    """The pieces that the four stages leave of (doc_id, text, lang), in plain Python."""
    scores = [max(p.values(), default=0.0) for p in brute_languages([(t, k) for _, t, k in rows])]
    assert all(abs(x - corpus_pipeline.LEAST_LANGUAGE_SCORE) > 0.01 for x in scores)
    kept = [(i, t) for (i, t, _), x in zip(rows, scores, strict=True) if x >= corpus_pipeline.LEAST_LANGUAGE_SCORE]
    sets = [set(simhash.shingles(t, 5)) for _, t in kept]
    group = list(range(len(kept)))
    for a, x in enumerate(sets):
        for b, y in enumerate(sets[:a]):
            if group[a] != group[b] and len(x & y) >= 0.8 * len(x | y):
                group = [group[b] if g == group[a] else g for g in group]
    first = {}
    for (i, t), g in zip(kept, group, strict=True):
        first[g] = min(first.get(g, (i, t)), (i, t))
    data = {i: t.encode() for i, t in first.values()}
    n = corpus_pipeline.PASSAGE
    seen = Counter(t[p : p + n] for t in data.values() for p in range(len(t) - n + 1))
    own, out = bpe.Codec(bpe.vocabulary_path(), bpe.split_pattern()), []
    for i, t in data.items():
        gone = np.zeros(len(t), dtype=bool)
        for p in range(len(t) - n + 1):
            if seen[t[p : p + n]] > 1:
                gone[p : p + n] = True
        left = bytes(np.frombuffer(t, np.uint8)[~gone]).decode("utf-8", "ignore")
        ids = np.array([*own.encode(left), 0], dtype="<u4")
        out += [(i, s, len(ids[s : s + 1024]), zlib.crc32(ids[s : s + 1024].tobytes()), len(ids)) for s in range(0, len(ids), 1024)]
    return out


def test_pipeline_against_brute_force(spark):
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    got = corpus_pipeline.run(spark, DATA).collect()
    want = brute_pipeline(rows)
    assert 0 < len({w[0] for w in want}) < len(rows)
    assert Counter((x.doc_id, x.start, x.length, x.ids_crc32, x.doc_tokens) for x in got) == Counter(want)
    by = defaultdict(list)
    for x in got:
        by[x.sequence_id].append((x.offset, x.length))
    for some in by.values():
        assert [o for o, _ in sorted(some)] == [0, *np.cumsum([n for _, n in sorted(some)])[:-1]] and sum(n for _, n in some) <= 1024
    common.clear()
    assert not common.written()
