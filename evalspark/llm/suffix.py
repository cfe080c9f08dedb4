"""Exact removal of repeated passages, by suffix sorting in two stages.

A passage of LENGTH bytes is repeated if it starts at two places of the corpus.
Each window of that length picks the least hash among its runs of GRAM bytes as
its anchor, so equal windows pick the same anchor at the same place.  Windows
next to each other with one anchor make up a context.  Contexts whose anchor
occurs once can't repeat; of all others the suffixes at their windows are
sorted, and what a suffix shares with the one before it decides.  Contexts alike
are sorted as two, so copies too are found by the sort and not by counting.

Passages of several lengths are found in one sort: what repeats over a longer
one does so over the shortest, so that one's windows are sorted, by as many bytes
as the longest has.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import drop, drop_since, join_keys, keyed, lean, once, partitions, repeats, save, slices, written

LENGTH, GRAM = 400, 32
BLOCK = 1 << 18
_INDEX = np.uint64((1 << 24) - 1)
#: Windows of the contexts of one anchor that are sorted in one task; groups of more are split into narrower ones.
HOT = 1 << 16
#: Windows of a context after each splitting.
WIDTHS = (32, 4, 1)
#: Windows next to each other whose bytes are compared at once, at least.
RUN = 16
#: Windows that are sorted at once, besides those of one group.
LIVE = 1 << 16


def _hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each place on."""
    h = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    step = 1
    while step < GRAM:
        h = h[:-step] * np.uint64(0xD6E8FEB86659FD93 + 2 * step) + h[step:]
        h ^= h >> np.uint64(31)
        step *= 2
    return h


def _runs(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, anchor, the anchor's hash) of the contexts of one stretch of bytes."""
    h = _hashes(data)
    mixed = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    least = (mixed & ~_INDEX) | np.arange(len(h), dtype=np.uint64)
    width, covered = length - GRAM + 1, 1
    while covered < width:
        step = min(covered, width - covered)
        least = np.minimum(least[:-step], least[step:])
        covered += step
    anchor = (least & _INDEX).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    last = np.concatenate([first[1:] - 1, [len(anchor) - 1]])
    return first, last, anchor[first], h[anchor[first]].view(np.int64)


def contexts(texts: list[bytes], length: int = LENGTH, reach: int = 0) -> Iterator[tuple[int, int, int, int, int, bytes]]:
    """(text, first window, windows, windows up to the anchor's, anchor hash, bytes) of every context.

    The bytes are reach from each window on, if that is more than length and the
    text has them.  Short texts are taken together; windows that go over into the
    next are left out.  Long texts go in blocks that overlap, which may cut a
    context in two.
    """
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= BLOCK):
            size += len(texts[end])
            end += 1
        data = b"".join(texts[at:end])
        bounds = np.cumsum([0] + [len(t) for t in texts[at:end]])
        for block in range(0, max(1, len(data) - length + 1), BLOCK):
            part = data[block : block + BLOCK + length - 1]
            if len(part) < length:
                continue
            first, last, anchor, key = _runs(np.frombuffer(part, dtype=np.uint8), length)
            owner = np.searchsorted(bounds, first + block, side="right") - 1
            # A context may reach over a border between texts: it is cut there.
            for i in range(len(first)):
                p, q, doc = int(first[i]) + block, int(last[i]) + block, int(owner[i])
                while p <= q:
                    stop = int(bounds[doc + 1])
                    to = min(q, stop - length)
                    if to >= p:
                        a = int(anchor[i]) + block
                        yield at + doc, p - int(bounds[doc]), to - p + 1, a - p, int(key[i]), data[p : min(stop, to + max(length, reach))]
                    p, doc = max(p, stop), doc + 1
        at = end


def suffix_order(text: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """starts in the order of their suffixes, of which depth bytes count.

    Only suffixes that begin with a byte not above the next one are sorted
    directly.  The others are placed by a scan over buckets of the first byte:
    a bucket holds those placed from smaller buckets, then those sorted
    directly, and each suffix in it places the one that starts a byte before.
    """
    buffer = text.tobytes()
    wanted = np.zeros(len(text) + 1, dtype=bool)
    wanted[starts] = True
    falls = np.concatenate([text[:-1] > text[1:], [False, False]])
    new = starts
    while len(new):  # a suffix that is to be placed needs its successor
        new = new[falls[new]] + 1
        new = new[~wanted[new]]
        wanted[new] = True
    chosen = np.flatnonzero(wanted)
    direct = np.array(sorted(chosen[~falls[chosen]].tolist(), key=lambda p: buffer[p : p + depth]), dtype=np.int64)
    placed: dict[int, list[np.ndarray]] = {}
    heads = text[direct]
    sorted_by = {int(c): direct[heads == c] for c in np.unique(heads)}
    out = []
    for c in range(256):
        if not (c in placed or c in sorted_by):
            continue
        bucket = np.concatenate([*placed.pop(c, []), sorted_by.get(c, np.empty(0, np.int64))])
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[wanted[before] & falls[before]]
        lead = text[before]
        for b in np.unique(lead):
            placed.setdefault(int(b), []).append(before[lead == b])
    order = np.concatenate(out) if out else np.empty(0, np.int64)
    asked = np.zeros(len(text) + 1, dtype=bool)
    asked[starts] = True
    return order[asked[order]]


def shared_starts(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For each suffix, whether it and the one before it in this order have length bytes in common.

    Neighbouring places whose suffixes before them are neighbours as well overlap,
    so their bytes are compared once; others are compared by words.
    """
    before = np.full(len(text), -1, dtype=np.int64)
    before[order[1:]] = order[:-1]
    places = np.flatnonzero(before >= 0)
    apart = places - before[places]
    first = np.flatnonzero(np.concatenate([[True], (np.diff(places) != 1) | (np.diff(apart) != 0)])[: len(places)])
    runs = np.diff(np.append(first, len(places)))
    same = np.zeros(len(text), dtype=bool)
    long = runs >= RUN
    if long.any():
        head, n = first[long], runs[long]
        size = n + length - 1
        begin = np.cumsum(size) - size
        at = np.repeat(places[head] - begin, size) + np.arange(size.sum())
        differs = np.concatenate([[0], np.cumsum(text[at] != text[at - np.repeat(apart[head], size)])])
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at = np.repeat(begin, n) + k
        same[np.repeat(places[head], n) + k] = differs[at + length] == differs[at]
    left = places[np.repeat(~long, runs)]
    words = np.zeros(len(text), dtype=np.uint64)
    for j in range(8):
        end = j + (len(text) - j) // 8 * 8
        words[j:end:8] = text[j:end].view(np.uint64)
    for at in range(0, length, 8):
        at = min(at, length - 8)
        left = left[words[left + at] == words[before[left] + at]]
    same[left] = True
    return same[order]


def repeated_windows(parts: list[bytes], windows: list[int], lengths: tuple[int, ...] = (LENGTH,)) -> list[list[np.ndarray]]:
    """For each length, shortest first, and each context, which of its windows also start elsewhere in these contexts.

    A window whose part has fewer bytes than a length is none of that length.
    """
    reach = lengths[-1]
    text = np.frombuffer(b"".join(parts) + bytes(reach + 16), dtype=np.uint8)
    begin = np.cumsum([0] + [len(p) for p in parts])
    starts = np.concatenate([np.arange(n) + b for n, b in zip(windows, begin, strict=False)])
    ends = np.repeat(begin[1:], windows)
    order = suffix_order(text, starts, reach)
    out = []
    for length in lengths:
        fits = np.zeros(len(text), dtype=bool)
        fits[starts[starts + length <= ends]] = True
        own = order[fits[order]]
        again = shared_starts(text, own, length)
        again[:-1] |= again[1:].copy()
        hit = np.zeros(len(text), dtype=bool)
        hit[own[again]] = True
        out.append([hit[b : b + n] for n, b in zip(windows, begin, strict=False)])
    return out


def _intervals(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return edge[::2], edge[1::2] - 1


def _sort(classes: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
    """(c, first, last, length): the windows of each context c that repeat over length bytes; all contexts of a group g are together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        live, last = 0, None

        def out() -> Iterator[pa.RecordBatch]:
            rows: list[tuple[bytes, int, int, int]] = []
            twins = [x for x in held if x[4]]
            found = repeated_windows([x[3] for x in held + twins], [x[2] for x in held + twins], lengths)
            for length, hits in zip(lengths, found, strict=True):
                for (_, c, *_), hit in zip(held, hits, strict=False):
                    rows += [(c, a, b, length) for a, b in zip(*_intervals(hit), strict=True)]
            for at in range(0, len(rows), 1 << 14):
                columns = zip(zip(*rows[at : at + (1 << 14)], strict=True), (pa.binary(), pa.int32(), pa.int32(), pa.int32()), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in columns], names=["c", "first", "last", "length"])

        for batch in slices(batches, 3):
            for row in zip(*(col.to_pylist() for col in batch.columns), strict=True):
                if row[0] != last and live >= LIVE:
                    yield from out()
                    held, live = [], 0
                held.append(row)
                live, last = live + row[2], row[0]
        if held:
            yield from out()

    parts = partitions(classes.sparkSession)
    rows = classes.select("g", "c", "n", "ctx", "dup").repartition(parts, "g").sortWithinPartitions("g", "c")
    return rows.mapInArrow(lean(run), "c binary, first int, last int, length int")


def _solve(classes: DataFrame, sizes: DataFrame, lengths: tuple[int, ...], widths: tuple[int, ...], hot: int) -> DataFrame:
    """Repeated windows of contexts (g, c, n, off, ctx, dup); dup ones occur twice or more, whether or not they stand here twice.

    sizes has the windows of each group g.  Groups of over hot windows are split:
    each context into slices of width windows, at fixed distances from the
    anchor, grouped by the bytes that all windows of the slice have in common.
    Slices alike are one, and those alone in their group can't repeat.
    """
    large = save(sizes.where(F.col("size") > hot).select("g"), "large") if widths else None
    if large is None or large.isEmpty():
        return _sort(classes, lengths)
    small = _sort(classes.join(large, "g", "left_anti"), lengths)
    width = widths[0]
    slice_ = lambda x: F.floor(x / width)
    cut = (
        classes.join(large, "g")
        .withColumn("j", F.explode(F.sequence(slice_(F.col("off") - F.col("n") + 1), slice_(F.col("off")))))
        # Windows whose distance to the anchor is from j * width to j * width + width - 1.
        .withColumn("from", F.greatest(F.lit(0), F.col("off") - F.col("j") * width - (width - 1)).cast("int"))
        .withColumn("to", F.least(F.col("n") - 1, F.col("off") - F.col("j") * width).cast("int"))
        .withColumn("core", F.expr(f"substring(ctx, CAST(off - j * {width} AS INT) + 1, {lengths[0] - width + 1})"))
        .withColumn("part", F.expr(f"substring(ctx, `from` + 1, `to` - `from` + {lengths[-1]})"))
        .withColumn("near", (F.col("off") - F.col("from")).cast("int"))
        .select(F.col("c").alias("whole"), "dup", F.xxhash64("g", "j", "core").alias("g"), F.col("from"), (F.col("to") - F.col("from") + 1).cast("int").alias("n"), F.col("near").alias("off"), F.col("part").alias("ctx"))
        .withColumn("c", F.unhex(F.md5(F.concat(F.col("ctx"), F.concat_ws(",", "g", "n", "off").cast("binary")))))
    )
    cut = save(cut, "slices")
    narrow = save(cut.groupBy("g", "c").agg(F.first("n").alias("n"), F.first("off").alias("off"), F.first("ctx").alias("ctx"), (F.max("dup") | (F.count("*") > 1)).alias("dup")), "narrow")
    met = narrow.groupBy("g").agg(F.sum(F.col("n") * (1 + F.col("dup").cast("int"))).alias("size"), (F.max("dup") | (F.count("*") > 1)).alias("met"))
    met = save(met.where("met").select("g", "size"), "met")
    found = _solve(narrow.join(met.select("g"), "g"), met, lengths, widths[1:], hot)
    back = found.join(cut.select("whole", "c", "from"), "c")
    return small.union(back.select(F.col("whole").alias("c"), (F.col("first") + F.col("from")).alias("first"), (F.col("last") + F.col("from")).alias("last"), "length"))


def repeated_ranges(rows: DataFrame, again: DataFrame | None, lengths: tuple[int, ...] = (LENGTH,), *, hot: int = HOT, widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """(a, b, ranges): for each key, the windows that are repeated over each length, as (first, last, length).  rows: a, b, bytes; again: repeats() of them."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in slices(batches, 2, size=BLOCK):
            found = []
            for doc, p, n, off, key, ctx in contexts(some.column(2).to_pylist(), lengths[0], lengths[-1]):
                found.append((doc, p, n, off, key, xxhash.xxh3_128_digest(ctx + b"%d,%d" % (n, off), key & 0xFFFFFFFF)))
                if len(found) >= 1 << 14:
                    yield table(some, found)
                    found = []
            if found:
                yield table(some, found)

    def table(some: pa.RecordBatch, found: list[tuple]) -> pa.RecordBatch:
        doc, p, n, off, key, c = zip(*found, strict=True)
        doc = pa.array(doc)
        return pa.RecordBatch.from_arrays([some.column(0).take(doc), some.column(1).take(doc), pa.array(p, pa.int64()), pa.array(n, pa.int32()), pa.array(off, pa.int32()), pa.array(key, pa.int64()), pa.array(c, pa.binary())], names=["a", "b", "p", "n", "off", "g", "c"])

    before = written()
    places = save(rows.select("a", "b", "bytes").mapInArrow(lean(find), "a long, b long, p long, n int, off int, g long, c binary"), "contexts")
    # c settles n and off; a, b and p are those of whichever row comes first.
    classes = places.groupBy("g", "c").agg(F.count("*").alias("rows"), F.first("a").alias("a"), F.first("b").alias("b"), F.first("p").alias("p"), F.first("n").alias("n"), F.first("off").alias("off"))
    # Twins of copies count, as they are sorted too.
    sizes = classes.groupBy("g").agg(F.sum("rows").alias("rows"), F.sum(F.col("n") * F.when(F.col("rows") > 1, 2).otherwise(1)).alias("size"))
    sizes = save(sizes.where("rows > 1").select("g", "size"), "sizes")
    classes = save(classes.join(sizes.select("g"), "g"), "classes")
    wanted = classes.groupBy("a", "b").agg(F.collect_list(F.struct("g", "c", "n", "off", (F.col("rows") > 1).alias("dup"), "p")).alias("wanted"))
    mixed = (
        once(rows.select("a", "b", "bytes"), again)
        .join(wanted.hint("shuffle_hash"), ["a", "b"])
        .select("bytes", F.explode("wanted").alias("w"))
        .select("w.g", "w.c", "w.n", "w.off", "w.dup", F.expr(f"substring(bytes, CAST(w.p AS INT) + 1, w.n + {lengths[-1] - 1})").alias("ctx"))
    )
    mixed = save(mixed, "mixed")
    often = save(classes.where("rows > 1").select("c", F.col("rows").alias("n")), "often")
    drop(classes)
    found = save(_solve(mixed, sizes, lengths, widths, hot), "found")
    drop_since(before, places, found, often)
    # A context has fewer windows than a passage has bytes, and so has the table for each c.
    return (
        join_keys(places, found, often, ["c"])
        .groupBy("a", "b")
        .agg(F.collect_set(F.struct((F.col("p") + F.col("first")).alias("first"), (F.col("p") + F.col("last")).alias("last"), "length")).alias("ranges"))
    )


def _merged(ranges: pa.ListArray, length: int) -> list[list[tuple[int, int]]]:
    """For each row the maximal runs of bytes, as (first, end), of its windows of this length."""
    first, last, own = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in ranges.flatten().flatten())
    row = np.repeat(np.arange(len(ranges)), ranges.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    base, some = row << 40, own == length
    a, b = (base + first)[some], (base + last + length)[some]
    order = np.argsort(a)
    a, b = a[order], np.maximum.accumulate(b[order])
    start = np.flatnonzero(np.concatenate([[True], a[1:] > b[:-1]])[: len(a)])
    end = b[np.append(start[1:], len(b)) - 1] if len(b) else b
    out: list[list[tuple[int, int]]] = [[] for _ in range(len(ranges))]
    for x, y in zip(a[start].tolist(), end.tolist(), strict=True):
        out[x >> 40].append((x & (1 << 40) - 1, y & (1 << 40) - 1))
    return out


def _without(data: bytes, runs: list[tuple[int, int]]) -> bytes:
    ends = [0, *(b for _, b in runs)]
    return b"".join(data[x:y] for x, y in zip(ends, [*(a for a, _ in runs), len(data)], strict=True))


def remove_repeats(docs: DataFrame, length: int = LENGTH, *, shorter: int | None = None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), hot: int = HOT, widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """Removes every byte of a passage of length bytes that starts at two places of the texts, overlaps included.

    Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs),
    kept_sha256, kept (the remaining bytes as text; what is left of a character
    that was cut is dropped), and the columns named in keep.  With shorter, a length
    below the other, kept_shorter is what passages of that length would leave;
    all other columns are as without it.

    A null text is empty; texts shorter than length lose nothing; repeated rows
    repeat each other's whole text; null ids stay null; an empty table gives no rows.
    """
    lengths = (length,) if shorter is None else (shorter, length)
    if lengths[0] < GRAM + max(widths, default=1):
        raise ValueError("passages must be longer than the anchor and a slice together")
    if lengths[0] >= length and shorter is not None:
        raise ValueError("shorter passages must be shorter")
    names = [f"_keep{i}" for i in range(len(keep))]
    own = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", *(["kept_shorter"] if shorter is not None else [])]
    kinds = dict(docs.dtypes)
    rows = keyed(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), *(F.col(c).alias(n) for c, n in zip(keep, names, strict=True))), "_id", "_text", tuple(names))
    before = written()
    again = repeats(rows)
    ranges = repeated_ranges(rows, again, lengths, hot=hot, widths=widths)
    if again is not None:  # they are read twice
        ranges = save(ranges, "ranges")
        drop_since(before, ranges, again)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            out = []
            runs = {n: _merged(batch.column(2), n) for n in lengths}
            for i, data in enumerate(batch.column(1).to_pylist()):
                left, *rest = (_without(data, runs[n][i]) for n in reversed(lengths))
                texts = (t.decode("utf-8", "ignore") for t in (left, *rest))
                out.append((len(data), len(data) - len(left), len(runs[length][i]), hashlib.sha256(left).hexdigest(), *texts))
            columns = zip(zip(*out, strict=True), [pa.int64()] * 3 + [pa.string()] * (len(own) - 3), strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in columns), *batch.columns[3:]], names=["doc_id", *own, *names])

    schema = ", ".join(["doc_id long", *(f"{n} {'long' if n[:2] == 'n_' else 'string'}" for n in own), *(f"{n} {kinds[c]}" for n, c in zip(names, keep, strict=True))])
    done = join_keys(rows, ranges.hint("shuffle_hash"), again, ["a", "b"], "left").select("doc_id", "bytes", "ranges", *names).mapInArrow(lean(cut), schema)
    return done.select("doc_id", *own, *(F.col(n).alias(c) for n, c in zip(names, keep, strict=True)))
