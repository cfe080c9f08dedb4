"""Packing by shortest-pack-first over the histogram of lengths."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from evalspark.llm.bpe import codec, split_pattern, vocabulary_path
from evalspark.llm.common import Intervals, documents, lean, ranked, save, slices


def pack_histogram(counts: dict[int, int], size: int) -> list[tuple[int, dict[int, int]]]:
    """Patterns (how many sequences, copies of each length) that hold all pieces.

    Lengths are placed longest first.  A piece goes to the shortest open pack,
    the one with most room; where it has no room, new packs are opened.  Packs
    alike are one entry with a count, so the work depends on the number of
    distinct lengths and not on that of pieces.
    """
    open_: dict[int, list[tuple[int, dict[int, int]]]] = defaultdict(list)  # by room
    for length in sorted(counts, reverse=True):
        left = counts[length]
        placed: list[tuple[int, int, dict[int, int]]] = []
        while left:
            room = max(open_, default=0)
            if room < length:
                each = size // length
                full, rest = divmod(left, each)
                for n, k in ((full, each), (1, rest)):
                    if n and k:
                        placed.append((size - k * length, n, {length: k}))
                break
            n, pattern = open_[room].pop()
            if not open_[room]:
                del open_[room]
            each = max(1, min(room // length, left // n))
            take = min(n, left // each)
            if take < n:
                open_[room].append((n - take, pattern))
            placed.append((room - each * length, take, pattern | {length: each}))
            left -= take * each
        for room, n, pattern in placed:
            open_[room].append((n, pattern))
    return [x for packs in open_.values() for x in packs]


def pieces(docs: DataFrame, size: int, *, vocabulary: str | None, id_col: str, text_col: str, keep_ids: bool) -> DataFrame:
    """Each document's ids with a closing 0, cut after every size ids."""
    path, pattern = vocabulary or vocabulary_path(), split_pattern()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if keep_ids else [])]
    ids_kind = pa.list_(pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for some in slices(batches, 1):
            rows: list[tuple] = []
            for doc, text in zip(some.column(0).to_pylist(), some.column(1), strict=True):
                ids = np.array([*own.encode(text.as_py()), 0], dtype="<u4")
                for start in range(0, len(ids), size):
                    cut = ids[start : start + size]
                    rows.append((doc, start, len(cut), zlib.crc32(cut.tobytes()), len(ids), *([cut.astype(np.int32)] if keep_ids else [])))
            for at in range(0, len(rows), 4096):
                columns = zip(zip(*rows[at : at + 4096], strict=True), [pa.int64()] * 5 + [ids_kind] * keep_ids, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in columns], names=names)

    schema = ", ".join(f"{n} long" for n in names[:5]) + (", ids array<int>" if keep_ids else "")
    return documents(docs, id_col, text_col).mapInArrow(lean(run), schema)


def pack_documents(docs: DataFrame, size: int = 1024, *, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Packs all documents into sequences of at most size ids.

    Returns a row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, and with keep_ids the ids themselves.  Only the
    histogram of lengths, of at most size entries, reaches the driver.  Each
    pattern takes the next ranks of each of its lengths, and pieces find their
    sequence by their rank among those of the same length.

    A null or empty text is one piece holding only the closing id 0; null ids
    stay null; repeated rows are packed each by itself; an empty table gives no rows.
    """
    cut = save(pieces(docs, size, vocabulary=vocabulary, id_col=id_col, text_col=text_col, keep_ids=keep_ids))
    cut = cut.withColumn("group", cut["length"].cast("int"))
    counts = {r["group"]: r["count"] for r in cut.groupBy("group").count().collect()}  # at most size rows
    rows, used, sequence = [], defaultdict(int), 0
    for n, pattern in pack_histogram(counts, size):
        offset = 0
        for length, each in sorted(pattern.items(), reverse=True):
            rows.append((length, used[length], sequence, each, offset))
            used[length] += n * each
            offset += length * each
        sequence += n
    table = Intervals(rows, ["sequence", "each", "offset"])

    def place(t: Intervals, at: np.ndarray, within: np.ndarray) -> dict[str, np.ndarray]:
        nth, slot = np.divmod(within, t.payload["each"][at])
        length = t.starts[at] >> Intervals.SHIFT
        return {"sequence_id": t.payload["sequence"][at] + nth, "offset": t.payload["offset"][at] + slot * length}

    ties = ["doc_id", "start", "ids_crc32", "doc_tokens"]
    return (
        ranked(cut, "group", ties, counts)
        .withColumn("at", table.column("group", "rank", "sequence_id long, offset long", place))
        .select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "at.sequence_id", "at.offset", *(["ids"] if keep_ids else []))
    )
