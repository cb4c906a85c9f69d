"""Language ID by prediction by partial matching: byte context trees, a language each, with frozen statistics."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hemiciclo.llm.common import crc_fold, hold, stash

ORDER = 4
#: Bytes of training text of a language, about: those of the documents of the least hashes.
TRAIN_BYTES = 2_000_000
#: Byte strings that the trees of all languages are made from, at most: the most frequent ones.
STRINGS = 2_000_000
#: Languages, at most; more are refused.
LANGS = 1_000
UNKNOWN = "und"
#: Bits of a byte that no context of a language has seen.
FLAT_BITS = 8.0
#: Code lengths (bytes times languages) that are worked out at a time, but so many bytes at least.
CELLS, LEAST_BYTES = 1_000_000, 4096
_HASH = np.uint64(0x9E3779B97F4A7C15)


def string_keys(octets: np.ndarray, size: int) -> np.ndarray:
    """For each byte the string of `size` bytes that ends there, as a number: the size, then the bytes; those at the start hold zeros for what is missing."""
    key = np.full(len(octets), size << 8 * (ORDER + 1), np.int64)
    for back in range(min(size, len(octets))):
        key[back:] |= octets[: len(octets) - back].astype(np.int64) << 8 * back
    return key


def longest_strings(octets: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different strings that end at the bytes, each with up to ORDER bytes before it in its text, and their counts; place: of a byte in its text."""
    key = string_keys(octets, ORDER + 1)
    for size in range(1, ORDER + 1):
        short = place == size - 1
        key[short] = string_keys(octets, size)[short]
    return np.unique(key, return_counts=True)


class ContextTrees:
    """The context trees of all languages, as one table of byte strings of 1 to ORDER + 1 bytes.

    cost: bits of a string's last byte after the bytes before it, in each language: by the longest context that has
    seen it there, after the escapes (method C) from longer ones. escape: bits of the escape from the string as a
    context, 0 where the language has not seen it. A string that no language has seen is coded after an escape from
    its context like the string without its first byte.
    """

    def __init__(self, rows: Iterable[tuple[str, int, int]] | tuple[list[str], np.ndarray, np.ndarray, np.ndarray]):
        """rows: language, longest string, count; or the languages, and arrays of language number, string, count."""
        if not isinstance(rows, tuple):
            rows = list(rows)
            langs = sorted({r[0] for r in rows})
            rows = langs, np.array([langs.index(r[0]) for r in rows]), np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
        self.langs, lang, longest, n = rows
        wide = 8 * (ORDER + 1)
        size = longest >> wide
        keys, counts = [np.zeros(1, np.int64)], [np.zeros((1, len(self.langs)))]  # the empty string comes first
        for k in range(1, ORDER + 2):
            some = size >= k
            found, at = np.unique((longest[some] & ((1 << 8 * k) - 1)) | (k << wide), return_inverse=True)
            seen = np.zeros((len(found), len(self.langs)))
            np.add.at(seen, (at, lang[some]), n[some])
            keys.append(found)
            counts.append(seen)
        self.key, count = np.concatenate(keys), np.concatenate(counts)
        size, body = self.key >> wide, self.key & ((1 << wide) - 1)
        context = np.searchsorted(self.key, np.where(size > 1, ((size - 1) << wide) | (body >> 8), 0))
        suffix = np.searchsorted(self.key, np.where(size > 1, ((size - 1) << wide) | (body & ((1 << 8 * np.maximum(size - 1, 0)) - 1)), 0))
        total, kinds = np.zeros_like(count), np.zeros_like(count)
        known = np.flatnonzero((size > 0) & (self.key[np.minimum(context, len(self.key) - 1)] == np.where(size > 1, ((size - 1) << wide) | (body >> 8), 0)))
        np.add.at(total, context[known], count[known])
        np.add.at(kinds, context[known], count[known] > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            self.escape = np.where(kinds > 0, -np.log2(kinds / (total + kinds)), 0.0)
            cost = -np.log2(count / (total + kinds)[context])
        cost[0] = FLAT_BITS
        edge = np.searchsorted(size, np.arange(ORDER + 3))
        for k in range(1, ORDER + 2):
            here = slice(edge[k], edge[k + 1])
            after = self.escape[context[here]] + cost[suffix[here]]
            cost[here] = np.where(count[here] > 0, cost[here], after)
        self.cost, self.escape = cost.astype(np.float32), self.escape.astype(np.float32)
        self.table: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"table": None}

    def forget(self) -> None:
        self.table = None

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * _HASH >> np.uint64(64 - self.bits)).astype(np.int64)

    def _build(self) -> None:
        self.bits = max(4, (4 * len(self.key)).bit_length())
        self.table = np.full(1 << self.bits, -1, np.int32)
        slot, open_ = self._slots(self.key), np.arange(len(self.key), dtype=np.int32)
        while len(open_):
            at = slot[open_]
            free = self.table[at] < 0
            self.table[at[free]] = open_[free]
            open_ = open_[self.table[at] != open_]
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each string, -1 where no language has seen it."""
        slot = self._slots(keys)
        row = self.table[slot]
        open_ = np.flatnonzero((row >= 0) & (self.key[row] != keys))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            row[open_] = self.table[slot[open_]]
            open_ = open_[(row[open_] >= 0) & (self.key[row[open_]] != keys[open_])]
        return row

    def byte_costs(self, octets: np.ndarray, place: np.ndarray, skip: int = 0) -> np.ndarray:
        """Bits of each byte but the first `skip` in each language."""
        if self.table is None:
            self._build()
        bits = np.zeros((len(octets) - skip, len(self.langs)), np.float32)
        open_ = np.arange(skip, len(octets))
        for size in range(ORDER + 1, 0, -1):
            key = string_keys(octets, size)
            try_ = place[open_] >= size - 1
            now, later = open_[try_], open_[~try_]
            row = self.find(key[now])
            hit = row >= 0
            bits[now[hit] - skip] += self.cost[row[hit]]
            now = now[~hit]
            if size > 1:
                context = self.find(string_keys(octets, size - 1)[now - 1])
                bits[now[context >= 0] - skip] += self.escape[context[context >= 0]]
                open_ = np.concatenate([now, later])
            else:
                bits[now - skip] += self.escape[0] + np.float32(FLAT_BITS)
        return bits

    def of_texts(self, octets: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Bits of whole texts (one after the other in `octets`; ends: len + 1 places) in each language."""
        out = np.zeros((len(ends) - 1, len(self.langs)))
        step = max(LEAST_BYTES, CELLS // max(1, len(self.langs)))
        for lo in range(0, len(octets), step):
            hi, back = min(lo + step, len(octets)), max(0, lo - ORDER)
            text = np.searchsorted(ends, np.arange(back, hi), "right") - 1
            costs = self.byte_costs(octets[back:hi], np.arange(back, hi) - ends[text], lo - back)
            first = np.flatnonzero(np.diff(text[lo - back :], prepend=-1))
            out[text[lo - back :][first]] += np.add.reduceat(costs, first, axis=0, dtype=np.float64)
        return out


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts (NULL: none), one after the other, and where each ends (len + 1 places)."""
    texts = texts.fill_null("").cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    return np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def train_trees(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_bytes: int = TRAIN_BYTES, strings: int = STRINGS) -> ContextTrees | None:
    """Trees from about `train_bytes` bytes of whole texts of each language outside the held-out fold; None without any.

    The sample is those documents whose hash is below the language's share. Their strings of ORDER + 1 bytes are counted
    on the executors; of more than `strings` different ones, those that are more frequent make the trees.
    """
    known = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(F.col("lang").isNotNull() & (crc_fold(F.col("doc_id"), 4) != 2))
    sizes = known.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("n")).limit(LANGS + 1).collect()
    if len(sizes) > LANGS:
        raise ValueError(f"more than {LANGS} languages")
    if not (sizes := {r["lang"]: r["n"] for r in sizes if r["n"]}):
        return None
    share = F.create_map(*(x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(min(1.0, train_bytes / n)))))
    place = F.shiftrightunsigned(F.xxhash64(F.lit("lang"), "doc_id", "text"), 33) / (1 << 31)
    kind = pa.schema([("lang", pa.string()), ("string", pa.int64()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                octets, _ = text_bytes(batch.column(1).slice(i, 1))
                found, n = longest_strings(octets, np.arange(len(octets)))
                yield pa.RecordBatch.from_arrays([pa.array(batch.column(0).slice(i, 1).to_pylist() * len(found), pa.string()), pa.array(found), pa.array(n, pa.int64())], schema=kind)

    sample = known.where(place < F.element_at(share, F.col("lang"))).select("lang", "text")
    counted = sample.mapInArrow(count, "lang string, string long, n long").groupBy("lang", "string").agg(F.sum("n").alias("n"))
    counted = stash(counted, "strings")
    least, total = 1, 0
    for r in counted.groupBy("n").agg(F.count("*").alias("strings")).orderBy(F.col("n").desc()).toLocalIterator():
        total += r["strings"]
        if total > strings:
            least = r["n"] + 1
            break
    got = counted.where(F.col("n") >= least).toArrow()
    if not got.num_rows:
        return None
    lang, string, n = (got.column(c).to_numpy() for c in ("lang", "string", "n"))
    langs, lang = np.unique(lang.astype(str), return_inverse=True)
    return ContextTrees((langs.tolist(), lang, string, n))


def has_letter(text: str | None) -> bool:
    """Whether a character of Unicode's letters (general category L) stands in the text."""
    return any(map(str.isalpha, text or ""))


def identify(docs: DataFrame, trees: ContextTrees | None, *, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """doc_id, held_out, lang_pred and score for every row; with `carry` also `row`, the input row.

    The prediction is the language whose trees code the whole text, byte by byte, in the fewest bits (ties: the first by
    name), the score its probability under equal priors. NULL and letterless texts, and all texts where nothing could
    be learned, are `und` with score 0. Repeated rows are judged each; a NULL id is not held out; other columns,
    whatever their names, are not read; an empty table gives no rows. One narrow pass, a text of any length in chunks.
    """
    sent = docs.sparkSession.sparkContext.broadcast(trees)  # its size is bounded by the numbers of strings and languages
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(crc_fold(F.col(id_col), 4) == 2, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"), *([F.struct("*").alias("row")] if carry else []))

    def predict(texts: pa.Array) -> tuple[list[str], list[float]]:
        model = sent.value
        if model is None:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        bits = model.of_texts(*text_bytes(texts))
        best = bits.argmin(axis=1)
        score = 1 / np.exp2(-np.minimum(bits - bits.min(axis=1, keepdims=True), 1000)).sum(axis=1)
        some = [has_letter(t) for t in texts.to_pylist()]
        return [model.langs[b] if s else UNKNOWN for s, b in zip(some, best, strict=True)], np.where(some, score, 0).tolist()

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def judged(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hold("language", sent.value.forget if sent.value else list)
        for batch in texts:
            found = [predict(batch.slice(at, 512)) for at in range(0, len(batch), 512)]
            yield pa.StructArray.from_arrays([pa.array([x for a, _ in found for x in a], pa.string()), pa.array([x for _, b in found for x in b], pa.float64())], names=["lang_pred", "score"])

    return rows.withColumn("_j", judged("text")).select("doc_id", "held_out", "_j.lang_pred", "_j.score", *(["row"] if carry else []))


def in_known_language(docs: DataFrame, *, least: float = 0.5, **kwargs) -> DataFrame:
    """The documents, all columns, whose language is one of the learned ones with a score of `least` or more."""
    judged = identify(docs, train_trees(docs, **kwargs), carry=True)
    return judged.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select("row.*")
