"""Language-model scores: prediction by partial matching over bytes, and a word-frequency base."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import drop_since, lean, save, slices, written

ORDER = 5
#: Bytes that UTF-8 never has: before a text's start, and at its end.
START, END = 0xFE, 0xFF
SYMBOLS = 255
#: Longest contexts with a symbol whose probabilities every task gets, the most frequent ones; all others' are joined.
HEAD_GRAMS = 1_000_000
#: Words whose counts every task gets, and the bytes such a word may have; other words' counts are joined.
HEAD_WORDS, HEAD_BYTES = 100_000, 32
BLOCK = 1 << 20
_NO = np.uint64(0xFFFFFFFFFFFFFFFF)


def grams(texts: list[bytes], order: int = ORDER) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For stretches of texts: first and last text, packed context and symbol at each byte, and the text of each."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= BLOCK):
            size += len(texts[end])
            end += 1
        pad = bytes([START]) * order
        data = np.frombuffer(b"".join(x for t in texts[at:end] for x in (pad, t, bytes([END]))), dtype=np.uint8)
        owner = np.repeat(np.arange(end - at), [len(t) + order + 1 for t in texts[at:end]])
        key = np.zeros(len(data) - order, dtype=np.uint64)
        for j in range(order + 1):
            key = (key << np.uint64(8)) | data[j : j + len(key)]
        real = data[order:] != START
        yield at, end, key[real], owner[order:][real]
        at = end


class Table:
    """A hash table of 64-bit keys, filled and searched an array at a time."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(2 * len(keys) + 1).bit_length())
        self.mask = (1 << self.bits) - 1
        self.keys = np.full(1 << self.bits, _NO)
        self.rows = np.full(1 << self.bits, -1, dtype=np.int32)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.keys[slot] == _NO
            self.keys[slot[free]] = keys[left[free]]
            placed = self.keys[slot] == keys[left]
            self.rows[slot[placed]] = left[placed]
            left, slot = left[~placed], (slot[~placed] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Each key's number, -1 if it isn't there."""
        slot = self._slot(keys)
        out, there = self.rows[slot], self.keys[slot]
        left = np.flatnonzero((there != keys) & (there != _NO))
        out[there != keys] = -1
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & self.mask
            there = self.keys[slot]
            hit = there == keys[left]
            out[left[hit]] = self.rows[slot[hit]]
            go = ~hit & (there != _NO)
            left, slot = left[go], slot[go]
        return out


def _low(column: Column, size: int) -> Column:
    """The last bytes of packed ones."""
    return column.bitwiseAND(F.lit((1 << 8 * size) - 1))


def _small(table: DataFrame, size: int) -> DataFrame:
    """Keys of two bytes are 65,536 at most, a proven bound; such a table goes to every task."""
    return F.broadcast(table) if size <= 2 else table


class Trie:
    """Contexts of 0 to order bytes with the counts of their symbols: two tables a level, all distributed.

    symbols[d] has (gram, n), d bytes of context and the symbol after them;
    contexts[d] has (context, n, q, left): occurrences, distinct symbols, and
    what these symbols count in the next shorter context.  A level's symbols are
    those of the next longer contexts added up, so what follows a context also
    follows its shorter one, and leaving out the symbols of the longer context
    leaves the known sums n - left and q - q of the longer one.
    """

    def __init__(self, grams: DataFrame, order: int = ORDER):
        self.order, self.symbols, self.contexts = order, {order: grams}, {}
        for d in range(order - 1, -1, -1):
            shorter = self.symbols[d + 1].groupBy(_low(F.col("gram"), d + 1).alias("gram")).agg(F.sum("n").alias("n"))
            self.symbols[d] = save(shorter, f"symbols{d}")
        for d in range(order + 1):
            rows = self.symbols[d].select(F.shiftright("gram", 8).alias("context"), "n", _low(F.col("gram"), d).alias("short"))
            if d:
                lower = self.symbols[d - 1].select(F.col("gram").alias("short"), F.col("n").alias("lower"))
                rows = rows.join(_small(lower, d), "short")
            sums = (F.sum("n").alias("n"), F.count("*").alias("q"), F.sum("lower" if d else F.lit(0)).alias("left"))
            self.contexts[d] = save(rows.groupBy("context").agg(*sums), f"contexts{d}")

    def seen(self) -> DataFrame:
        """(gram, n, log10) of all grams of the longest contexts that were learned."""
        own = self.contexts[self.order].select("context", F.col("n").alias("all"), "q")
        rows = self.symbols[self.order].withColumn("context", F.shiftright("gram", 8)).join(own, "context")
        return rows.select("gram", "n", F.log10(F.col("n") / (F.col("all") + F.col("q"))).alias("log10"))

    def unseen(self, grams: DataFrame) -> DataFrame:
        """(gram, log10) of distinct grams that were not learned: coded in the longest context that has their symbol."""
        rows = grams.select("gram", F.lit(0.0).alias("log10"), F.lit(True).alias("open"), F.lit(0).cast("long").alias("left_n"), F.lit(0).cast("long").alias("left_q"))
        for d in range(self.order, -1, -1):
            own = self.contexts[d].select("context", F.col("n").alias("all"), "q", "left")
            rows = rows.withColumn("context", F.shiftright(_low(F.col("gram"), d + 1), 8)).join(_small(own, d), "context", "left")
            if d < self.order:
                symbols = self.symbols[d].select(F.col("gram").alias("symbol"), F.col("n").alias("times"))
                rows = rows.join(_small(symbols, d + 1), _low(F.col("gram"), d + 1) == F.col("symbol"), "left")
            else:
                rows = rows.withColumn("times", F.lit(None).cast("long"))
            n, q, known = F.col("all") - F.col("left_n"), F.col("q") - F.col("left_q"), F.col("q").isNotNull()
            hit = F.col("open") & known & F.col("times").isNotNull()
            leave = F.col("open") & known & F.col("times").isNull() & (q > 0)
            cost = F.when(hit, F.log10(F.col("times") / (n + q))).when(leave, F.log10(q / (n + q))).otherwise(0.0)
            rows = rows.select(
                "gram",
                (F.col("log10") + cost).alias("log10"),
                (F.col("open") & ~hit).alias("open"),
                F.when(known, F.col("left")).otherwise(F.col("left_n")).alias("left_n"),
                F.when(known, F.col("q")).otherwise(F.col("left_q")).alias("left_q"),
            )
        even = F.log10(F.greatest(SYMBOLS - F.col("left_q"), F.lit(1)))
        return rows.select("gram", (F.col("log10") - F.when(F.col("open"), even).otherwise(0.0)).alias("log10"))


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(at, weights=np.concatenate([c for _, c in parts]), minlength=len(keys)).astype(np.int64)


def frequent(counts: DataFrame, most: int) -> DataFrame:
    """The rows with the largest n, down to a count that keeps most of them at most."""
    n = F.col("n")
    # Up to 999 each count is a step, beyond each tenth more: a bounded number of steps.
    step = F.when(n < 1000, n).otherwise(1000 + F.floor(F.log(n / 1000) / F.log(F.lit(1.1))))
    held, least = 0, None
    for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("rows"), F.min("n").alias("least")).orderBy(F.desc("step")).collect():
        held += r["rows"]
        if held > most:
            break
        least = r["least"]
    return counts.limit(0) if least is None else counts.where(n >= least)


def gram_counts(texts: DataFrame) -> DataFrame:
    """(gram, n): packed longest contexts with their symbols over the column text of all rows, for a Trie."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(parts: list) -> pa.RecordBatch:
            keys, counts = _merge(parts)
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], names=["gram", "n"])

        parts: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in slices(batches, 0):
            for _, _, key, _ in grams(_bytes(batch.column(0))):
                parts.append(np.unique(key, return_counts=True))
                if sum(len(k) for k, _ in parts) > BLOCK:
                    parts = [_merge(parts)]
                    if len(parts[0][0]) > BLOCK // 2:
                        yield out(parts)
                        parts = []
        if parts:
            yield out(parts)

    return texts.select("text").mapInArrow(lean(count), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _bytes(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def _word_counts(texts: DataFrame) -> DataFrame:
    """word (bytes) and n over all rows; a space stands for the end."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(found: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

        found: Counter = Counter()
        for batch in slices(batches, 0):
            for text in _bytes(batch.column(0)):
                found.update(text.lower().split())
                found[b" "] += 1
                if len(found) > 200_000:
                    yield out(found)
                    found = Counter()
        if found:
            yield out(found)

    return texts.select("text").mapInArrow(lean(count), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Head:
    """What every task needs of the frequent words and grams, sent as plain arrays of bounded size."""

    def __init__(self, words: list[bytes], times: np.ndarray, keys: np.ndarray, log10: np.ndarray):
        self.words, self.times, self.keys, self.log10 = words, times, keys, log10
        self.made: tuple[dict[bytes, float], Table] | None = None

    def ready(self) -> tuple[dict[bytes, float], Table]:
        if self.made is None:
            self.made = dict(zip(self.words, np.log10(self.times + 1.0).tolist(), strict=True)), Table(self.keys)
        return self.made


def score_documents(docs: DataFrame, train_on: DataFrame, *, head_grams: int = HEAD_GRAMS, head_words: int = HEAD_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores every whole text of docs with what the texts of train_on teach.

    Returns doc_id, n_tokens, n_known, train_tokens, base_score and score.  score
    is the log10 probability of the text's bytes and its end by a byte trie of
    contexts up to 5 bytes: a symbol is coded in the longest context that has
    it; leaving a context with q symbols in n occurrences costs q / (n + q); and
    symbols of a context that was left no longer count in shorter ones.
    base_score adds log10((c + 1) / (N + V + 1)) over the words and the end.

    The trie holds all grams of the training texts, in distributed tables.  The
    frequent words and grams go to every task, in bounded number and length;
    those of all others are joined, so none is left out and the bounds change no
    result.

    A null text is empty: it has the end only.  Without a row to learn from all
    counts are zero and all symbols alike.  Null ids stay null; repeated rows
    are scored each.
    """
    learned = train_on.select(F.col(text_col).alias("text"))
    before = written()
    counts = save(_word_counts(learned), "words")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    low = float(np.log10(total["n"] + total["v"] + 1))
    top = frequent(counts.where(F.length("word") <= HEAD_BYTES), head_words).select("word", "n").toArrow()
    words, times = top["word"].to_pylist(), top["n"].to_numpy()
    trie = Trie(save(gram_counts(learned), "grams"))
    seen = save(trie.seen(), "seen")
    often = frequent(seen, head_grams).select("gram", "log10").toArrow()
    keys, logs10 = often["gram"].to_numpy().view(np.uint64), often["log10"].to_numpy()
    # Bounded by head_words times HEAD_BYTES and by head_grams; each worker makes its table and map once.
    shared = docs.sparkSession.sparkContext.broadcast(Head(words, times, keys, logs10))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs, table = shared.value.ready()
        log10 = np.append(shared.value.log10, 0.0)  # the last is for grams that are not in the head
        for batch in slices(batches, 2, 256):
            texts = _bytes(batch.column(2))
            scores, others, ends = np.zeros(len(texts)), [], []
            for at, end, key, owner in grams(texts):
                found_at = table.find(key)
                scores[at:end] = np.bincount(owner, weights=log10[found_at], minlength=end - at)
                other = key[found_at < 0].view(np.int64)
                ends.append(np.bincount(owner[found_at < 0], minlength=end - at))
                others.append(other)
            grams_of = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], *ends]).cumsum(), pa.int32()), pa.array(np.concatenate([np.empty(0, np.int64), *others])))
            tokens, known, base, offsets = [], [], [], [0]
            rare_words: list[bytes] = []
            rare_times: list[int] = []
            for text in texts:
                words = text.lower().split()
                words.append(b" ")
                found = [logs[w] for w in words if w in logs]
                rare = Counter(w for w in words if w not in logs) if len(found) < len(words) else {}
                tokens.append(len(words))
                known.append(len(found))
                base.append(sum(found))
                rare_words += rare.keys()
                rare_times += rare.values()
                offsets.append(len(rare_words))
            each = pa.StructArray.from_arrays([pa.array(rare_words, pa.binary()), pa.array(rare_times, pa.int64())], names=["word", "times"])
            columns = [pa.array(tokens, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(scores), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), each), grams_of]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["row", "doc_id", "n_tokens", "n_known", "base", "score", "rest", "grams"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    scored = save(rows.mapInArrow(lean(run), "row long, doc_id long, n_tokens long, n_known long, base double, score double, rest array<struct<word: binary, times: long>>, grams array<long>"), "scored")
    rare_words = scored.select("row", F.explode("rest").alias("r")).select("row", "r.word", "r.times").join(counts, "word")
    others = scored.select("row", F.explode("grams").alias("gram")).groupBy("row", "gram").agg(F.count("*").alias("times"))
    others = save(others, "others")
    unseen = trie.unseen(others.select("gram").distinct().join(seen, "gram", "left_anti"))
    other_grams = others.join(seen.select("gram", "log10").unionAll(unseen), "gram")
    nothing = F.lit(0.0)
    more = (
        rare_words.select("row", "times", (F.col("times") * F.log10(F.col("n") + 1)).alias("gain"), nothing.alias("log10"))
        .unionAll(other_grams.select("row", F.lit(0).cast("long"), nothing, F.col("times") * F.col("log10")))
        .groupBy("row")
        .agg(F.sum("times").alias("more"), F.sum("gain").alias("gain"), F.sum("log10").alias("log10"))
    )
    more = save(more, "more")
    drop_since(before, scored, more)
    return scored.drop("rest", "grams").join(more, "row", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(total["n"]).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("gain", nothing) - F.col("n_tokens") * F.lit(low)).alias("base_score"),
        (F.col("score") + F.coalesce("log10", nothing)).alias("score"),
    )
