"""Byte-level BPE: whole texts to ids and back, with tree concatenation of long unsplit text."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import documents, drop, lean, partitions, save, slices

#: Text without a sure boundary for longer than this is cut in halves.
LIMIT = 8192
#: Texts with more characters than this are encoded by many tasks; what stands here bounds a task's text.
WHOLE = 1 << 20
#: Characters of such a text that one task takes at a time.
PART = 1 << 18
#: Kinds of parts.
TEXT, BEGINS, GOES_ON = range(3)
SPECIAL = (("<|endoftext|>", 50256),)


def vocabulary_path() -> str:
    """The default vocabulary file, which every machine has with the package of public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class Codec:
    """Encodes and decodes with a vocabulary of ranks, as the tokenizers library does with the same one."""

    def __init__(self, path: str, pattern: str, special: tuple[tuple[str, int], ...] = SPECIAL, limit: int = LIMIT):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.limit, self.special = limit, dict(special)
        self.bpe = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.single = self.bpe._core_bpe.encode_single_piece
        self.bytes_of = {i: b for b, i in ranks.items()} | {i: s.encode() for s, i in special}
        # What tiktoken calls white space; regex would add U+001C to U+001F.
        self.pieces = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.specials = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if special else None

    def encode(self, text: str) -> list[int]:
        if self.specials is None or not any(s in text for s in self.special):
            return self._ordinary(text)
        ids: list[int] = []
        for part in self.specials.split(text):
            ids += [self.special[part]] if part in self.special else self._ordinary(part)
        return ids

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")

    def _ordinary(self, text: str) -> list[int]:
        if len(text) <= self.limit:
            return self.bpe.encode_ordinary(text)
        ids: list[int] = []
        for start, end, unsplit in self._stretches(text):
            ids += self._unsplit(text[start:end]) if unsplit else self.bpe.encode_ordinary(text[start:end])
        return ids

    def _stretches(self, text: str) -> Iterator[tuple[int, int, bool]]:
        """Cuts before a space between two characters that aren't white space.

        There every split of the text has a boundary, whatever stands around it.
        A stretch longer than the limit holds no such place.
        """
        start, n = 0, len(text)
        sure = lambda i: not text[i - 1].isspace() and not text[i + 1].isspace()
        while n - start > self.limit:
            at = text.rfind(" ", start + 1, start + self.limit)
            while at > start and not (at + 1 < n and sure(at)):
                at = text.rfind(" ", start + 1, at)
            if at <= start:
                at = text.find(" ", start + self.limit)
                while at >= 0 and not (at + 1 < n and sure(at)):
                    at = text.find(" ", at + 1)
                at = at if at >= 0 else n
            yield start, at, at - start > self.limit
            start = at
        if start < n:
            yield start, n, False

    def _unsplit(self, text: str) -> list[int]:
        ids: list[int] = []
        for piece in self.pieces.findall(text):
            ids += self.tree(piece.encode())
        return ids

    def tree(self, piece: bytes) -> list[int]:
        """Encodes halves, down to the limit, and joins them pair by pair."""
        if len(piece) <= self.limit:
            return self.single(piece)
        # The leaves don't depend on each other; joins go up the tree level by level.
        return self.joined([self.single(piece[i : i + self.limit]) for i in range(0, len(piece), self.limit)])

    def joined(self, level: list[list[int]]) -> list[int]:
        """The ids of a piece from those of its parts, which are joined pair by pair, level by level."""
        while len(level) > 1:
            level = [self._join(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0]

    def parts(self, text: str, size: int) -> Iterator[tuple[int, bytes]]:
        """(kind, bytes) that make up a text: TEXT is encoded by itself, as the text is cut at both ends anyway.

        A piece BEGINS and, if it has more than size bytes, GOES_ON; its parts
        are encoded by themselves and joined afterwards.
        """
        held: list[str] = []
        length = 0
        for stretch in self.specials.split(text) if self.specials else [text]:
            special = stretch in self.special
            for start, end, unsplit in [(0, len(stretch), False)] if special else self._stretches(stretch):
                if held and (unsplit or special or length + end - start > size):
                    yield TEXT, "".join(held).encode()
                    held, length = [], 0
                if unsplit:
                    for piece in self.pieces.findall(stretch[start:end]):
                        data = piece.encode()
                        for at in range(0, len(data), size):
                            yield GOES_ON if at else BEGINS, data[at : at + size]
                elif special:
                    yield TEXT, stretch.encode()
                else:
                    held.append(stretch[start:end])
                    length += end - start
        if held:
            yield TEXT, "".join(held).encode()

    def _join(self, left: list[int], right: list[int]) -> list[int]:
        """Re-encodes a growing window around the join until both sides agree.

        The window's encoding must begin with the id the left side has there and
        end with the id the right side has there, unless the window reaches that
        side's end.  Then every pair of neighbours in the result stands in the
        encoding of some text, and such a sequence is the encoding of the whole.
        """
        width = 4
        while True:
            a, b = min(width, len(left)), min(width, len(right))
            window = self.single(b"".join(map(self.bytes_of.__getitem__, left[len(left) - a :] + right[:b])))
            agree_left = a == len(left) or window[0] == left[-a]
            agree_right = b == len(right) or window[-1] == right[b - 1]
            if agree_left and agree_right and (len(window) > 1 or (a == len(left) and b == len(right))):
                return left[: len(left) - a] + window + right[b:]
            width *= 2


@lru_cache(maxsize=4)
def codec(path: str, pattern: str, limit: int = LIMIT) -> Codec:
    """One for each worker process."""
    return Codec(path, pattern, limit=limit)


def _sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def encode_decode(docs: DataFrame, *, vocabulary: str | None = None, limit: int = LIMIT, whole: int = WHOLE, part: int = PART, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """Encodes every whole text and decodes its ids: doc_id, n_tokens, ids, decoded.

    With digests, the SHA-256 of the ids in decimal, joined by commas, and of the
    decoded text stand in the place of ids and decoded, so that no long list leaves the task.

    Texts of up to whole characters take one narrow pass, in which nothing is
    shuffled.  Longer ones are cut into parts that are encoded side by side by
    any number of tasks; then the parts of a text come together and those of
    one unsplit piece are joined up the tree.

    A null or empty text has no ids and decodes to the empty text; null ids stay
    null; each row is encoded by itself, so repeated rows, ties and an empty
    table need no rule.
    """
    path, pattern = vocabulary or vocabulary_path(), split_pattern()
    names = ["doc_id", "n_tokens", *(["ids_sha256", "decoded_sha256"] if digests else ["ids", "decoded"])]
    kinds = ["long", "long", *(["string", "string"] if digests else ["array<int>", "string"])]
    schema = ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True))

    def table(own: Codec, doc: list, ids: list[list[int]]) -> pa.RecordBatch:
        back = [own.decode(x) for x in ids]
        columns = [pa.array(doc, pa.int64()), pa.array(map(len, ids), pa.int64())]
        if digests:
            columns += [pa.array([_sha(",".join(map(str, x)).encode()) for x in ids]), pa.array([_sha(x.encode()) for x in back])]
        else:
            columns += [pa.array(ids, pa.list_(pa.int32())), pa.array(back, pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern, limit)
        for some in slices(batches, 1):
            yield table(own, some.column(0).to_pylist(), [own.encode(t.as_py()) for t in some.column(1)])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern, limit)
        for batch in batches:
            for row, doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held: list[tuple] = []
                for at, (kind, data) in enumerate(own.parts(text, part)):
                    held.append((row, doc, at, kind, data))
                    if len(held) == 1024 or len(data) > 1 << 16:
                        yield batch_of(held)
                        held = []
                if held:
                    yield batch_of(held)

    def batch_of(held: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=["row", "doc_id", "at", "kind", "data"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern, limit)
        for some in slices(batches, 4):
            ids = [own.encode(data.decode()) if kind == TEXT else own.tree(data) for kind, data in zip(some.column(3).to_pylist(), some.column(4).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*some.columns[:4], pa.array(ids, pa.list_(pa.int32()))], names=["row", "doc_id", "at", "kind", "ids"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern, limit)
        last, ids, level = None, [], []
        for batch in batches:
            for row, doc, _, kind, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if level and kind != GOES_ON:
                    ids += own.joined(level)
                    level = []
                if last is not None and row != last[0]:
                    yield table(own, [last[1]], [ids])
                    ids = []
                last = row, doc
                level.append(found)
        if last is not None:
            yield table(own, [last[1]], [ids + own.joined(level)])

    rows = documents(docs, id_col, text_col)
    short = rows.where(F.length("text") <= whole).mapInArrow(lean(run), schema)
    long = rows.where(F.length("text") > whole).withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", "text")
    parts = save(long.mapInArrow(lean(cut), "row long, doc_id long, at long, kind int, data binary"), "parts")
    if parts.isEmpty():
        drop(parts)
        return short
    n = partitions(docs.sparkSession)
    encoded = parts.repartition(n, "row", "at").mapInArrow(lean(encode), "row long, doc_id long, at long, kind int, ids array<int>")
    gathered = encoded.repartition(n, "row").sortWithinPartitions("row", "at").mapInArrow(lean(gather), schema)
    return short.unionByName(gathered)
