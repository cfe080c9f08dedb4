"""Language identification by bit-sliced Bloom filters of n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import lean, save, slices

UNKNOWN = "und"
SIZES = (3, 4)
SLOTS, HASHES = 1 << 20, 3
#: Labelled rows that the filters are fitted on, at most (in expectation; chosen by a hash of the id).
TRAIN_DOCS = 40_000
#: An n-gram is in a language if it makes up this share of the language's n-grams; so a language has 1 / MIN_SHARE at most.
MIN_SHARE = 5e-6
#: ... and this part of its share in the language where it is most frequent.
MIN_PART = 0.25
CHARS = 1 << 16


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def ngrams(texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For stretches of texts: the first text's number, letters of each text, n-gram hashes and the text of each.

    Letters are lower-cased, all else is a word boundary; an n-gram may have a
    boundary at either end only.  A text is never cut.
    """
    at = 0
    while at < len(texts):
        end, chars = at, 0
        while end < len(texts) and (end == at or chars + len(texts[end]) <= CHARS):
            chars += len(texts[end])
            end += 1
        some = [t.lower() for t in texts[at:end]]
        points = np.frombuffer(("\n" + "\n".join(some) + "\n").encode("utf-32-le", "replace"), dtype="<u4")
        number = np.repeat(np.arange(end - at), [len(t) + 1 for t in some])
        number = np.concatenate([[0], number])
        letter = _letters()[points]
        code = np.where(letter, points, 0).astype(np.uint64)
        hashes, owners = [], []
        for n in SIZES:
            last = len(code) - n + 1
            inner = np.ones(max(0, last), dtype=bool)
            for j in range(1, n - 1):
                inner &= letter[j : j + last]
            where = np.flatnonzero(inner)
            h = np.full(len(where), n, dtype=np.uint64)
            for j in range(n):
                h = (h ^ code[where + j]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            hashes.append(h)
            owners.append(number[where + 1])
        yield at, np.bincount(number, weights=letter, minlength=end - at), np.concatenate(hashes), np.concatenate(owners)
        at = end


def _slots(h: np.ndarray) -> list[np.ndarray]:
    """Positions of the filter's hash functions, by double hashing."""
    a, b = h & np.uint64(SLOTS - 1), (h >> np.uint64(32)) | np.uint64(1)
    return [((a + np.uint64(j) * b) & np.uint64(SLOTS - 1)).astype(np.int64) for j in range(HASHES)]


class Filters:
    """One Bloom filter a language, sliced by bits: a slot holds a bit for each language, 64 of them in a word."""

    def __init__(self, langs: list[str], grams: dict[str, np.ndarray]):
        self.langs, self.tables = langs, [np.zeros(SLOTS, dtype=np.uint64) for _ in range(-(-len(langs) // 64))]
        for i, lang in enumerate(langs):
            for slot in _slots(grams[lang]):
                self.tables[i // 64][slot] |= np.uint64(1 << i % 64)
        # How often a language claims an n-gram that it doesn't hold.
        self.wrong = np.array([self._bit(self.tables, i).mean() ** HASHES for i in range(len(langs))])

    @staticmethod
    def _bit(words: list[np.ndarray], i: int) -> np.ndarray:
        return (words[i // 64] >> np.uint64(i % 64)) & np.uint64(1)

    def languages(self, h: np.ndarray) -> list[np.ndarray]:
        """Bitmask of all languages that hold each n-gram, in words of 64 languages."""
        first, *rest = _slots(h)
        masks = []
        for table in self.tables:
            mask = table[first]
            for slot in rest:
                mask = mask & table[slot]
            masks.append(mask)
        return masks

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        langs, scores = [], []
        for _, letters, hashes, owner in ngrams(texts):
            n = len(letters)
            total = np.bincount(owner, minlength=n)
            masks = self.languages(hashes)
            hits = np.stack([np.bincount(owner[self._bit(masks, i) == 1], minlength=n) for i in range(len(self.langs))] or [np.zeros(n)])
            wrong = self.wrong[:, None] if self.langs else 0.0
            share = np.clip((hits - total * wrong) / np.maximum(total, 1) / (1 - np.minimum(wrong, 0.999)), 0.0, 1.0)
            best = share.argmax(axis=0)
            for k in range(n):
                known = bool(letters[k]) and bool(self.langs)
                langs.append(self.langs[best[k]] if known else UNKNOWN)
                scores.append(float(share[best[k], k]) if known else 0.0)
        return langs, scores


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; of a null id, that of the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def fit(labelled: DataFrame, *, max_docs: int = TRAIN_DOCS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Filters:
    """Learns the filters from labelled rows, of which max_docs are read, chosen by a hash of the id.

    Null texts and null languages teach nothing.  What comes to the driver is
    1 / MIN_SHARE n-grams a language at most.
    """
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    n = rows.count()
    if n > max_docs:
        rows = rows.where(F.pmod(F.xxhash64(F.col(id_col), F.lit(3)), F.lit(1 << 20)) < int(max_docs / n * (1 << 20)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in slices(batches, 1):
            langs, texts = (c.to_pylist() for c in some.columns)
            for lang in sorted(set(langs)):
                for _, _, h, _ in ngrams([t for t, own in zip(texts, langs, strict=True) if own == lang]):
                    grams, counts = np.unique(h, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams)), pa.array(grams.view(np.int64)), pa.array(counts)], names=["lang", "gram", "n"])

    counts = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).mapInArrow(lean(count), "lang string, gram long, n long")
    counts = save(counts.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "ngrams")
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    least = F.create_map(*[x for lang, t in totals.items() for x in (F.lit(lang), F.lit(t * MIN_SHARE))]) if totals else None
    kept = counts.where(F.col("n") >= least[F.col("lang")]).toPandas() if totals else None
    langs = sorted(totals, key=lambda x: (-totals[x], x))
    if not langs:
        return Filters([], {})
    kept["share"] = kept["n"] / kept["lang"].map(totals)
    kept = kept[kept["share"] >= MIN_PART * kept.groupby("gram")["share"].transform("max")]
    return Filters(langs, {lang: kept.loc[kept["lang"] == lang, "gram"].to_numpy(dtype=np.int64).view(np.uint64) for lang in langs})


def predict(docs: DataFrame, filters: Filters, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang_pred and score of every whole text, with the columns named in keep after them.

    The score is the part of the text's n-grams that the language holds,
    corrected for those the filter claims wrongly.  A null text, or one without
    a letter, is und with score 0; among languages that are level the one with
    more text learned wins; repeated rows are alike; null ids stay null.  Any
    number of languages may be learned.
    """
    kinds = dict(docs.dtypes)
    names = ["doc_id", "lang_pred", "score", *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            langs, scores = filters.predict(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), *batch.columns[2:]], names=names)

    schema = ", ".join(["doc_id long", "lang_pred string", "score double", *(f"`{c}` {kinds[c]}" for c in keep)])
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col), *(F.col(c) for c in keep)).mapInArrow(lean(run), schema)
