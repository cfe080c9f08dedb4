"""SimHash near-duplicates, found at the anchors of a covering code."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evalspark.llm.common import documents, drop_since, join_keys, join_spread, keyed, lean, once, partitions, repeats, save, slices, written
from evalspark.llm.graph import components

SEED = 42
#: A block of 31 bits is covered with radius 1 by the Hamming code of length 31.
BLOCK = 31
_MASKS = [np.uint64(sum(1 << (p - 1) for p in range(1, BLOCK + 1) if p >> j & 1)) for j in range(5)]
#: For each syndrome, the pairs of positions whose flips lead to a code word two bits away.
_PAIRS = np.array(
    [[0] * 15] + [[(1 << (i - 1)) | (1 << ((i ^ s) - 1)) for i in range(1, BLOCK + 1) if i < i ^ s] for s in range(1, BLOCK + 1)], dtype=np.uint64
)
#: Groups of this many fingerprints and more are searched by flipping bits.
LARGE = 4096
#: Anchors with more fingerprints than this are split by a further part of the fingerprints.
HOT = 8192


def shingles(text: str, words: int) -> list[bytes]:
    """Runs of words, repeats included; of fewer words the whole sequence, of none nothing."""
    found = text.encode().lower().split()
    if len(found) <= words:
        return [b" ".join(found)] if found else []
    return list(map(b" ".join, zip(*(found[i:] for i in range(words)), strict=False)))


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes; of none, zero."""
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 15):
        counts += np.unpackbits(hashes[at : at + (1 << 15)].view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, words: int, *, seeds: tuple[int, ...] = (SEED,), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and one signed 64-bit fingerprint for each seed: fp0, fp1, ..."""
    names = ["doc_id", *(f"fp{i}" for i in range(len(seeds)))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            found: list[list[int]] = [[] for _ in seeds]
            for text in batch.column(1):
                runs = shingles(text.as_py(), words)
                for own, seed in zip(found, seeds, strict=True):
                    own.append(fingerprint(np.array([xxhash.xxh64_intdigest(x, seed) for x in runs], dtype="<u8")))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in found)], names=names)

    return documents(docs, id_col, text_col).mapInArrow(lean(run), ", ".join(f"{n} long" for n in names))


def anchors(blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each block's home anchor, and the 15 anchors two bits away (its home again, where the block is a code word).

    These are all anchors within the covering radius 1 plus a threshold of 1:
    two blocks that differ in one bit at most meet at the home of either.
    """
    syndrome = np.zeros(len(blocks), dtype=np.int64)
    for j, mask in enumerate(_MASKS):
        syndrome |= (np.bitwise_count(blocks & mask) & 1).astype(np.int64) << j
    home = np.where(syndrome > 0, blocks ^ (np.uint64(1) << np.maximum(syndrome - 1, 0).astype(np.uint64)), blocks)
    far = blocks[:, None] ^ _PAIRS[syndrome]
    return home, np.where(syndrome[:, None] > 0, far, home[:, None])


def _forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect the same nodes, fewer than there are nodes."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, label = at[: len(u)], at[len(u) :], np.arange(len(nodes))
    while True:
        least = np.minimum(label[a], label[b])
        after = label.copy()
        np.minimum.at(after, a, least)
        np.minimum.at(after, b, least)
        after = after[after]
        if (after == label).all():
            break
        label = after
    linked = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[linked], nodes[label[linked]]


def _links(key: np.ndarray, home: np.ndarray, fp: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between a fingerprint at home at an anchor and any other one there; rows come by key, those at home first."""
    n = len(key)
    ends = np.searchsorted(key, key, side="right")
    starts = np.searchsorted(key, key, side="left")
    large = ends - starts >= LARGE
    us, vs = [], []
    left, lag = np.flatnonzero(home & ~large & (ends - np.arange(n) > 1)), 1
    while len(left):
        other = left + lag
        near = np.bitwise_count((fp[left] ^ fp[other]).view(np.uint64)) <= threshold
        us.append(fp[left[near]])
        vs.append(fp[other[near]])
        lag += 1
        left = left[ends[left] - left > lag]
    for k in np.unique(key[large]):
        at = slice(np.searchsorted(key, k, "left"), np.searchsorted(key, k, "right"))
        all_, own = np.sort(fp[at]), fp[at][home[at]]
        for mask in _masks(threshold):
            there = np.minimum(np.searchsorted(all_, own ^ mask), len(all_) - 1)
            hit = all_[there] == own ^ mask
            us.append(own[hit])
            vs.append(all_[there[hit]])
    u, v = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (us, vs))
    return _forest(u, v)


def _masks(threshold: int) -> Iterator[np.int64]:
    bits = [np.uint64(1 << i) for i in range(64)]
    found = {np.uint64(0)}
    for _ in range(threshold):
        found |= {x | b for x in found for b in bits}
    return (x.view(np.int64) for x in found - {np.uint64(0)})


def parts_of(fp: Column, threshold: int) -> list[Column]:
    """threshold + 1 parts of the fingerprint's bits: of two fingerprints within threshold bits one part at least is equal."""
    edges = [64 * i // (threshold + 1) for i in range(threshold + 2)]
    return [F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1 if b - a < 64 else -1)) for a, b in zip(edges, edges[1:], strict=False)]


def links(fps: DataFrame, threshold: int = 2, *, hot: int = HOT) -> DataFrame:
    """(u, v) edges that connect all distinct fingerprints fp which differ in threshold bits or fewer.

    With a threshold of 3 or less, one of two blocks of 31 bits differs in one
    bit at most, and the two fingerprints meet at an anchor of that block.
    A fingerprint goes to 32 anchors at most.  Those of an anchor with more than
    hot go on to threshold + 1 groups each, by an equal part of all 64 bits, so
    its pairs are found by many tasks.
    """
    if not 0 <= threshold <= 3:
        raise ValueError("the two blocks of 31 bits find all pairs up to 3 differing bits")

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), 20_000):
                fp = frame["fp"].to_numpy()[at : at + 20_000]
                for block in (0, 1):
                    part = (fp.view(np.uint64) >> np.uint64(BLOCK * block)) & np.uint64((1 << BLOCK) - 1)
                    home, far = anchors(part)
                    away = far != home[:, None]
                    key = np.concatenate([home, far[away]]).astype(np.int64) | (block << BLOCK)
                    yield pd.DataFrame({"key": key, "away": np.repeat([False, True], [len(home), away.sum()]), "fp": np.concatenate([fp, np.repeat(fp, away.sum(axis=1))])})

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []  # rows of the last group, which may go on
        for frame in frames:
            key = frame["key"].to_numpy()
            if not len(key):
                continue
            if held and key[0] != held[-1]["key"].iloc[-1]:
                yield of(held)
                held = []
            cut = int(np.searchsorted(key, key[-1]))
            if cut:
                yield of([*held, frame.iloc[:cut]])
                held = []
            held.append(frame.iloc[cut:])
        if held:
            yield of(held)

    def of(some: list[pd.DataFrame]) -> pd.DataFrame:
        rows = pd.concat(some, ignore_index=True)
        u, v = _links(rows["key"].to_numpy(), ~rows["away"].to_numpy(dtype=bool), rows["fp"].to_numpy(), threshold)
        return pd.DataFrame({"u": u, "v": v})

    dealt = save(fps.select("fp").mapInPandas(lean(deal), "key long, away boolean, fp long"), "anchors")
    crowded = save(dealt.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("key"), "crowded")
    rows = dealt
    if not crowded.isEmpty():
        further = F.array(*[F.xxhash64("key", F.lit(i), part) for i, part in enumerate(parts_of(F.col("fp"), threshold))])
        split = dealt.join(crowded, "key").select(F.explode(further).alias("key"), "away", "fp")
        rows = dealt.join(crowded, "key", "left_anti").unionByName(split)
    parts = partitions(fps.sparkSession)
    return rows.repartition(parts, "key").sortWithinPartitions("key", "away").mapInPandas(lean(compare), "u long, v long")


def simhash_groups(docs: DataFrame, *, words: int = 3, threshold: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id that links lead to.

    Rows with the same fingerprint are one node, so a group of copies costs one
    node however large it is; nodes are compared at their anchors, and links
    join into components in rounds of the star steps.

    A null text, or one without words, has the fingerprint zero and links like
    any other; null ids are passed over in the smallest id, which is null only
    where a component has no id at all; repeated rows each give a row.
    """
    before = written()
    rows = save(fingerprints(docs, words, id_col=id_col, text_col=text_col).withColumnRenamed("fp0", "fp"), "fingerprints")
    nodes = save(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "nodes")
    linked = components(links(nodes, threshold))
    groups = nodes.join(linked, nodes["fp"] == linked["node"]).groupBy("root").agg(F.min("first").alias("component_id"))
    named = linked.join(groups, "root").select(F.col("node").alias("fp"), "component_id")
    ids = save(nodes.join(named, "fp", "left").select("fp", "n", F.coalesce("component_id", "first").alias("component_id")), "ids")
    drop_since(before, rows, ids)
    return join_spread(rows, ids, "fp", "n").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: Near copies are candidates where the fingerprints of their sets of runs differ in up to this many bits.
NEAR_BITS = 3
#: Those of a similarity near the least differ in more, so a document also goes to BANDS keys of ROWS
#: least hashes each.  A pair of Jaccard similarity J shares a key with probability 1 - (1 - J**ROWS)**BANDS: 0.9993 at 0.8, 0.99999 at 0.85.
BANDS, ROWS = 24, 6
_FACTORS, _OFFSETS, _WEIGHTS = (x | np.uint64(1) for x in np.random.default_rng(SEED).integers(0, 1 << 64, (3, BANDS * ROWS), dtype=np.uint64))


#: Bytes of linked candidates' sets that meet in one task; more are compared by chunks.
BOUND = 1 << 20
#: Sets of such a group that all others are held against first.
HUBS = 8


def hashed(text: str, words: int) -> np.ndarray:
    """The sorted distinct hashes of the text's runs of words."""
    runs = set(shingles(text, words))
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in runs), dtype="<u8", count=len(runs)))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One key for each band: equal where the band's least hashes are equal."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), 2048):
        np.minimum(least, (_FACTORS[:, None] * hashes[at : at + 2048] + _OFFSETS[:, None]).min(axis=1), out=least)
    least = (least ^ (least >> np.uint64(31))) * _WEIGHTS
    return (least ^ (least >> np.uint64(29))).reshape(BANDS, ROWS).sum(axis=1, dtype=np.uint64).view(np.int64)


def similar_groups(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """For each set of sorted distinct hashes the first index of its group; pairs of this exact Jaccard similarity or more link.

    A pair that is similar enough shares one at least of any len - ceil(similarity * len) + 1
    hashes of one side, so the rarest of them find all its partners.
    """
    n = len(sets)
    group = np.full(n, -1)
    size = np.array([len(x) for x in sets])
    ends = np.cumsum(size)
    owner = np.repeat(np.arange(n), size)
    _, token, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    by_token, first = owner[np.argsort(token, kind="stable")], np.cumsum(often) - often
    there = np.zeros(len(often), dtype=bool)
    left = size.sum()
    for i in range(n):
        if group[i] >= 0:
            continue
        group[i], left, queue = i, left - size[i], [i]
        while queue and left:
            at = queue.pop()
            own = token[ends[at] - size[at] : ends[at]]
            rare = own[np.argsort(often[own], kind="stable")][: size[at] - int(np.ceil(similarity * size[at] - 1e-9)) + 1]
            if often[rare].sum() < left:
                other = np.unique(np.concatenate([by_token[first[t] : first[t] + often[t]] for t in rare]))
                other = other[group[other] < 0]
            else:
                other = np.flatnonzero(group < 0)
            other = other[(size[other] >= similarity * size[at] - 1e-9) & (similarity * size[other] <= size[at] + 1e-9)]
            if not len(other):
                continue
            there[own] = True
            shared = np.array([np.count_nonzero(there[token[ends[o] - size[o] : ends[o]]]) for o in other])
            there[own] = False
            near = other[shared / (size[at] + size[other] - shared) >= similarity]
            group[near] = i
            left -= size[near].sum()
            queue.extend(near.tolist())
    return group


def fingerprint_edges(sets: DataFrame, threshold: int = NEAR_BITS) -> DataFrame:
    """(u, v) edges that connect all nodes whose fingerprints are equal or differ in threshold bits or fewer; sets: distinct (node, fp)."""
    fps = save(sets.groupBy("fp").agg(F.min("node").alias("first"), F.count("*").alias("n")), "nodes")
    alike = join_spread(sets, fps, "fp", "n").where("node <> first").select(F.col("node").alias("u"), F.col("first").alias("v"))
    end = lambda c: fps.select(F.col("fp").alias(c), F.col("first").alias(f"_{c}"))
    return alike.union(links(fps, threshold).join(end("u"), "u").join(end("v"), "v").select("_u", "_v"))


def band_edges(nodes: DataFrame, similarity: float) -> DataFrame:
    """(u, v) edges that connect the nodes which share the key of a band; nodes: node, n and keys, one row each."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype=np.int64)
            node, n = (np.repeat(batch.column(i).to_numpy(), BANDS) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(key + np.tile(np.arange(BANDS), batch.num_rows)), pa.array(n), pa.array(node)], names=["key", "n", "node"])

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = [np.empty(0, np.int64)] * 3
        for batch in batches:
            key, n, node = (np.concatenate([x, y.to_numpy()]) for x, y in zip(last, batch.columns, strict=True))
            # Sorted by size, so no pair across a gap between neighbours can be similar enough.
            linked = (key[1:] == key[:-1]) & (n[:-1] >= similarity * n[1:] - 1e-9)
            yield pa.RecordBatch.from_arrays([pa.array(node[:-1][linked]), pa.array(node[1:][linked])], names=["u", "v"])
            last = [key[-1:], n[-1:], node[-1:]]

    dealt = nodes.select("node", "n", "keys").mapInArrow(lean(deal), "key long, n long, node long")
    return dealt.repartition(partitions(nodes.sparkSession), "key").sortWithinPartitions("key", "n").mapInArrow(lean(chain), "u long, v long")


def near_groups(docs: DataFrame, *, words: int = 5, similarity: float = 0.8, bound: int = BOUND, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(a, b, doc_id, group): groups of documents linked by pairs whose sets of runs of words have this Jaccard similarity.

    a and b are the key of keyed().  Documents whose fingerprints the covering
    code links, or that share a band's key of least hashes, or are linked by
    such, are candidates.  The sets of candidates that are linked meet in one task where they hold up to bound bytes, and in many, by chunks of
    about that size, where they hold more; each pair is decided by its exact
    similarity, and no group is capped.  Documents with the same set are one node.
    """
    names = ["a", "b", "doc_id", "node", "n", "fp", "keys"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 3):
            sets = [hashed(data.as_py().decode(), words) for data in batch.column(3)]
            node = pa.array([xxhash.xxh64_intdigest(x.tobytes(), SEED) - (1 << 63) for x in sets], pa.int64())
            fp = pa.array([fingerprint(x) for x in sets], pa.int64())
            keys = pa.array([band_keys(x).tobytes() if len(x) else b"" for x in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], node, pa.array([len(x) for x in sets], pa.int64()), fp, keys], names=names)

    rows = keyed(docs, id_col, text_col).mapInArrow(lean(run), "a long, b long, doc_id long, node long, n long, fp long, keys binary")
    before = written()
    rows = save(rows, "sets")
    nodes = rows.where("n > 0").groupBy("node").agg(F.first("n").alias("n"), F.first("keys").alias("keys"))
    parts = partitions(docs.sparkSession)
    own = save(rows.where("n > 0").select("node", "fp").distinct(), "fingerprints")
    linked = components(fingerprint_edges(own).union(band_edges(nodes, similarity)))
    linked = save(linked, "candidates")
    # One document of each candidate node; its set is built again from the text.
    one = rows.groupBy("node").agg(F.min(F.struct("a", "b")).alias("k")).join(linked, "node").select("k.a", "k.b", "node", "root")
    texts = once(keyed(docs, id_col, text_col), repeats(rows)).join(one.hint("shuffle_hash"), ["a", "b"]).select("root", "node", "bytes")

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            sets = pa.array([hashed(x.as_py().decode(), words).tobytes() for x in batch.column(2)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), sets], names=["root", "node", "hashes"])

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes]] = []
        root = None
        for batch in batches:
            done: list[tuple[int, int]] = []
            for r, node, hashes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if r != root:
                    done += of(held)
                    root, held = r, []
                held.append((node, hashes))
            yield pairs(done)
        yield pairs(of(held))

    def of(held: list[tuple[int, bytes]]) -> list[tuple[int, int]]:
        if not held:
            return []
        found = similar_groups([np.frombuffer(x, dtype="<u8") for _, x in held], similarity)
        return [(node, held[g][0]) for (node, _), g in zip(held, found.tolist(), strict=True)]

    def pairs(done: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], pa.int64()) for i in (0, 1)], names=["node", "group"])

    sets = save(texts.mapInArrow(lean(tokens), "root long, node long, hashes binary"), "hashes")
    loads = save(sets.groupBy("root").agg(F.sum(F.octet_length("hashes")).alias("size")).withColumn("chunks", F.ceil(F.col("size") / bound)), "loads")
    small = sets.join(loads.where("chunks = 1").select("root"), "root")
    decided = small.repartition(parts, "root").sortWithinPartitions("root", "node").mapInArrow(lean(decide), "node long, group long")
    large = loads.where("chunks > 1").select("root", "chunks")
    if not large.isEmpty():
        members = save(sets.join(large, "root").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks"))), "members")
        linked = components(_large_links(members, similarity, bound))
        decided = decided.union(linked.select("node", F.col("root").alias("group")))
    decided = save(decided, "decided")
    drop_since(before, rows, decided)
    return join_keys(rows, decided, repeats(rows, "node"), ["node"], "left").select("a", "b", "doc_id", F.coalesce("group", "node").alias("group"))


def similar_pairs(left: list[np.ndarray], right: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Indices of all pairs of sets, of sorted distinct hashes, with this exact Jaccard similarity or more."""
    size = np.array([len(x) for x in right])
    token = np.concatenate(right)
    by = np.argsort(token, kind="stable")
    token, owner = token[by], np.repeat(np.arange(len(right)), size)[by]
    us, vs = [], []
    for i, own in enumerate(left):
        lo, hi = np.searchsorted(token, own, "left"), np.searchsorted(token, own, "right")
        n = hi - lo
        at = np.arange(n.sum()) - np.repeat(n.cumsum() - n, n) + np.repeat(lo, n)
        shared = np.bincount(owner[at], minlength=len(right))
        near = np.flatnonzero(shared >= similarity * (len(own) + size - shared) - 1e-9)
        us.append(np.full(len(near), i))
        vs.append(near)
    return np.concatenate(us), np.concatenate(vs)


def _large_links(members: DataFrame, similarity: float, bound: int) -> DataFrame:
    """(u, v) edges that connect the same sets as all pairs of this similarity within a root; members: root, node, hashes, chunks, chunk.

    No task holds more than two chunks of about bound bytes.  Each set is held
    against a few hubs of its root, twice; in a group of near copies that leaves
    few.  What no hub is similar to is then held, in blocks, against all sets of
    the root, so no link is lost whatever the hubs are.
    """

    def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"u": [], "v": []}).astype("int64")
        one, other = ([np.frombuffer(x, dtype="<u8") for x in df["hashes"]] for df in (a, b))
        i, j = similar_pairs(one, other, similarity)
        u, v = a["node"].to_numpy()[i], b["node"].to_numpy()[j]
        u, v = _forest(u[u != v], v[u != v])
        return pd.DataFrame({"u": u, "v": v})

    def against(right: DataFrame) -> DataFrame:
        """Edges of the members with right (root, block, node, hashes, chunks), each chunk with each block of its root."""
        blocks = right.select("root", (F.col("block") + 0).alias("block")).distinct()  # columns of its own, as right is met again
        left = members.join(blocks, "root").groupBy("root", "chunk", "block")
        spread = right.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
        return save(left.cogroup(spread.groupBy("root", "chunk", "block")).applyInPandas(compare, "u long, v long"), "links")

    rest, edges = members, None
    for turn in range(2):
        place = F.row_number().over(Window.partitionBy("root").orderBy(F.xxhash64("node", F.lit(turn))))
        hubs = save(rest.withColumn("_place", place).where(F.col("_place") <= HUBS).select("root", F.lit(0).cast("long").alias("block"), "node", "hashes", "chunks"), "hubs")
        found = against(hubs)
        edges = found if edges is None else edges.union(found)
        met = found.select(F.col("u").alias("node")).union(found.select("v")).distinct()
        rest = save(rest.join(met, "node", "left_anti").join(hubs.select("node"), "node", "left_anti"), "rest")
    loads = rest.groupBy("root").agg(F.ceil(F.sum(F.octet_length("hashes")) / bound).alias("blocks"))
    last = rest.join(loads, "root").withColumn("block", F.pmod(F.xxhash64("node", F.lit(2)), F.col("blocks")))
    return edges.union(against(save(last.select("root", "block", "node", "hashes", "chunks"), "last")))


def drop_near_copies(docs: DataFrame, *, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each group of near copies: the one with the smallest id, then key.

    Null ids come last.  Of rows alike in id and text one stays; a null text is
    the empty text, and all texts without words are one group.
    """
    before = written()
    groups = save(near_groups(docs, words=words, similarity=similarity, id_col=id_col, text_col=text_col), "groups")
    kept = groups.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "a", "b")).alias("k")).select("k.a", "k.b")
    drop_since(before, groups)
    columns = docs.columns
    own = docs.select(*(F.col(c).alias(f"_c{i}") for i, c in enumerate(columns)))
    named = {c: f"_c{i}" for i, c in enumerate(columns)}
    rows = keyed(own, named[id_col], named[text_col], tuple(named.values())).drop("doc_id", "bytes")
    rows = once(rows, repeats(groups)).join(kept, ["a", "b"], "left_semi")
    return rows.select(*(F.col(n).alias(c) for c, n in named.items()))
