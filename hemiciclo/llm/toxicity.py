"""Toxicity from the nearest labelled examples by TF-IDF cosine, found exactly in a block-max inverted index."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hemiciclo.llm.common import crc_fold, give_back, hash_sample, hold
from hemiciclo.llm.quality import fit_platt

#: Labelled documents in the index, at most, and of these the ones whose leave-one-out votes fit the calibration.
EXAMPLES, CALIBRATION = 4_000, 2_000
#: Terms are hashed to 2**BITS slots: all words, and all beginnings of so many letters of longer words.
BITS = 18
BEGINNINGS = (4, 5, 6)
NEIGHBOURS = 20
#: Votes that the toxic share of all examples has.
PRIOR_VOTES = 0.3
#: Weight of a term that is no more clustered in documents than chance would have it.
EVEN = 0.1
REJECT = 0.7
#: Examples of a block; terms that more than one in DENSE examples has stand in a matrix, others in posting lists.
BLOCK, DENSE = 64, 16
#: Characters whose terms are made at a time, documents that are searched at a time.
CHUNK, BATCH = 1 << 18, 128
_MIX, _BASE, _PART = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0x5851F42D4C957F2D)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter(map(str.isalpha, map(chr, range(0x110000))), np.int8, 0x110000)


@lru_cache(maxsize=2)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(1 << bits, _BASE), np.full(1 << bits, _INVERSE)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def _pieces(text: str) -> Iterator[str]:
    """The text in parts of about CHUNK characters, cut between a letter and something else."""
    at = 0
    while len(text) - at > CHUNK:
        to = at + CHUNK
        while to < len(text) and text[to].isalpha() and text[to - 1].isalpha():
            to += 1
        yield text[at:to]
        at = to
    yield text[at:]


def _chunk_terms(parts: list[tuple[int, str]]) -> np.ndarray:
    """document << BITS | slot of every term of the parts (document, lower-case text), repeats included.

    Hashes are polynomials of code points, so those of all beginnings of all words are differences of one running sum.
    """
    points = np.frombuffer("\n".join(p for _, p in parts).encode("utf-32-le"), np.uint32)
    letter = np.zeros(len(points) + 2, np.int8)
    letter[1:-1] = _letters()[points]
    edge = np.diff(letter)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _powers((len(points) + 1).bit_length())
    sums = np.zeros(len(points) + 1, np.uint64)
    np.cumsum((points.astype(np.uint64) + np.uint64(1)) * up[: len(points)], out=sums[1:])
    first = np.cumsum([0] + [len(p) + 1 for _, p in parts])
    document = np.array([d for d, _ in parts], np.uint64)[np.searchsorted(first, start, "right") - 1]
    back, base = down[start], sums[start]
    hashes, of = [(sums[end] - base) * back], [document]
    for k in BEGINNINGS:
        long = np.flatnonzero(end - start > k)
        hashes.append(((sums[start[long] + k] - base[long]) * back[long]) ^ _PART)
        of.append(document[long])
    h = np.concatenate(hashes)
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return np.concatenate(of) << np.uint64(BITS) | h >> np.uint64(64 - BITS)


def term_counts(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, slot and count of the terms of whole texts (NULL: none), in order of document and slot.

    A word is a run of letters, in lower case. Slots are shared where hashes collide; nothing else is left out.
    """
    found: list[np.ndarray] = []
    parts, size = [], 0
    for d, text in enumerate(texts):
        for piece in _pieces(text.lower()) if text else ():
            parts.append((d, piece))
            size += len(piece)
            if size >= CHUNK:
                found.append(_chunk_terms(parts))
                parts, size = [], 0
    if parts:
        found.append(_chunk_terms(parts))
    counted = [np.unique(f, return_counts=True) for f in found]
    keys = np.concatenate([k for k, _ in counted]) if counted else np.zeros(0, np.uint64)
    n = np.concatenate([c for _, c in counted]) if counted else np.zeros(0, np.int64)
    if len(counted) > 1:  # a text may lie in several chunks
        keys, place = np.unique(keys, return_inverse=True)
        n = np.bincount(place, n, len(keys)).astype(np.int64)
    return (keys >> np.uint64(BITS)).astype(np.int64), (keys & np.uint64((1 << BITS) - 1)).astype(np.int64), n


def _spans(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """first[0] .. last[0] - 1, first[1] .. last[1] - 1 and so on, in one array."""
    n = last - first
    return np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)


class BlockMaxIndex:
    """Unit TF-IDF vectors of the examples, as postings by term and block of examples, with each block's largest weight.

    Examples stand in order of their heaviest term, so that blocks are alike inside. Terms have the numbers of their rank,
    the most frequent first, so that what is read again and again lies together; terms of no example have none. A search bounds each block by its
    largest weights, scores the blocks with the highest bounds, then all others whose bound reaches the k-th best cosine
    of these. Bounds and scores are single precision, with the rounding of so many products allowed for; what can be
    among the k nearest gets its cosine in double precision, equal examples one for all, from the products that the lists
    gave and those of frequent terms. Only vectors, labels and ids
    travel; the rest is built where it is searched.
    """

    def __init__(self, vectors: Sequence[Mapping[int, float] | tuple[np.ndarray, np.ndarray]], labels: Sequence[int], ids: Sequence[int], terms: int):
        pairs = [(np.fromiter(v, np.int64), np.fromiter(v.values(), np.float64)) if isinstance(v, Mapping) else v for v in vectors]
        order = sorted(range(len(ids)), key=lambda i: (int(pairs[i][0][pairs[i][1].argmax()]) if len(pairs[i][0]) else -1, ids[i]))
        self.terms = terms
        self.labels = np.array([labels[i] for i in order], np.float64)
        self.ids = np.array([ids[i] for i in order], np.int64)
        self.first = np.cumsum([0] + [len(pairs[i][0]) for i in order])
        slot = np.concatenate([pairs[i][0].astype(np.int32) for i in order] or [np.zeros(0, np.int32)])
        df = np.bincount(slot, minlength=terms)
        self.slot_of = np.argsort(-df, kind="stable")[: np.count_nonzero(df)].astype(np.int32)
        self.rank = np.full(terms, -1, np.int32)
        self.rank[self.slot_of] = np.arange(len(self.slot_of))
        self.term = self.rank[slot]
        self.weight = np.concatenate([pairs[i][1] for i in order] or [np.zeros(0)])
        for a, b in zip(self.first[:-1].tolist(), self.first[1:].tolist(), strict=True):
            up = a + np.argsort(self.term[a:b])
            self.term[a:b], self.weight[a:b] = self.term[up], self.weight[up]
        self.built = False

    def __getstate__(self) -> dict:
        return {k: self.__dict__[k] for k in ("terms", "labels", "ids", "first", "slot_of", "rank", "term", "weight")} | {"built": False}

    def vector(self, at: int) -> tuple[np.ndarray, np.ndarray]:
        """Slots and weights of the example at that place."""
        return self.slot_of[self.term[self.first[at] : self.first[at + 1]]], self.weight[self.first[at] : self.first[at + 1]]

    def forget(self) -> None:
        self.__dict__ = self.__getstate__()

    def _build(self) -> None:
        n = len(self.ids)
        self.blocks = -(-n // BLOCK)
        example = np.repeat(np.arange(n, dtype=np.int32), np.diff(self.first))
        df = np.bincount(self.term, minlength=len(self.slot_of))
        self.common = common = np.count_nonzero(df * DENSE > n)  # these have the lowest numbers
        dense = self.term < common
        self.rows = np.zeros((self.blocks * BLOCK, common), np.float32)
        self.rows[example[dense], self.term[dense]] = self.weight[dense]
        self.row_most = self.rows.reshape(self.blocks, BLOCK, common).max(axis=1)
        rare = np.flatnonzero(~dense)
        rare = rare[np.argsort(self.term[rare], kind="stable")]  # by term, then by example
        self.posted, self.posted_weight = example[rare], self.weight[rare]
        place = self.term[rare].astype(np.int64) * max(1, self.blocks) + self.posted // BLOCK
        start = np.flatnonzero(np.diff(place, prepend=-1))
        self.entry_first = np.append(start, len(rare)).astype(np.int32)
        self.entry_block = self.posted[start] // BLOCK
        self.entry_most = np.maximum.reduceat(self.posted_weight, start).astype(np.float32) if len(start) else np.zeros(0, np.float32)
        self.dense_last = self.first[:-1] + np.bincount(example[dense], minlength=n)  # an example's terms stand in order of rank
        self.lists = np.searchsorted(self.term[rare][start], np.arange(len(self.slot_of) + 1))
        kinds: dict[bytes, int] = {}  # equal vectors: the first example that has it
        ends = self.first.tolist()
        print_ = lambda i, j: xxhash.xxh3_128_digest(self.term[i:j].tobytes() + self.weight[i:j].tobytes())
        self.like = np.array([kinds.setdefault(print_(i, j), k) for k, (i, j) in enumerate(zip(ends[:-1], ends[1:], strict=True))], np.int64)
        del example, dense, place, rare
        give_back()
        self.built = True

    def search(self, vector: Mapping[int, float], k: int, but: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the `k` nearest with a cosine above 0 (ties: the least id), without the example at `but`."""
        return self.search_many([(np.fromiter(vector, np.int64), np.fromiter(vector.values(), np.float64))], k, [but])[0]

    def search_many(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int, but: Sequence[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        if not self.built:
            self._build()
        m, n = len(queries), len(self.ids)
        if not n:
            return [(np.zeros(0, np.int64), np.zeros(0))] * m
        dense = np.zeros((m, self.common), np.float32)
        known, lists, weights, blocks = [], [], [], []
        for i, (slot, w) in enumerate(queries):
            term = self.rank[slot]
            up = np.argsort(term)[np.count_nonzero(term < 0) :]
            at, w = term[up], w[up]
            low = np.searchsorted(at, self.common)
            dense[i, at[:low]] = w[:low]
            known.append((at[:low], w[:low]))
            at, w = at[low:], w[low:]
            first, last = self.lists[at], self.lists[at + 1]
            lists.append(_spans(first, last))
            weights.append(np.repeat(w, last - first))
            blocks.append(self.entry_block[lists[i]])
        bound = dense @ self.row_most.T
        for i in range(m):
            bound[i] += np.bincount(blocks[i], weights[i] * self.entry_most[lists[i]], self.blocks)
        spare = 1 + 4 * (max(len(s) for s, _ in queries) + 8) * 2.0**-24  # rounding of sums of that many positive products
        rank = np.argsort(-bound, axis=1, kind="stable")
        scores = np.zeros((m, self.blocks * BLOCK), np.float32)
        kth = np.zeros(m, np.float32)
        top = min(self.blocks, -(-(k + 1) // BLOCK) + self.blocks // 8)
        seen: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(m)]
        for ranks in (slice(0, top), slice(top, None)):
            wanted = np.zeros((m, self.blocks), bool)
            np.put_along_axis(wanted, rank[:, ranks], True, axis=1)
            wanted &= (bound > 0) & (bound * spare >= kth[:, None])
            for b in np.flatnonzero(wanted.any(axis=0)):
                need = np.flatnonzero(wanted[:, b])
                scores[need, b * BLOCK : (b + 1) * BLOCK] = dense[need] @ self.rows[b * BLOCK : (b + 1) * BLOCK].T
            for i in range(m):
                use = np.flatnonzero(wanted[i][blocks[i]])
                entry = lists[i][use]
                first, last = self.entry_first[entry], self.entry_first[entry + 1]
                p = _spans(first, last)
                example, product = self.posted[p], np.repeat(weights[i][use], last - first) * self.posted_weight[p]
                scores[i] += np.bincount(example, product, scores.shape[1])
                if scores.shape[1] > k + 1:  # one spare, as `but` may be among them
                    kth[i] = np.partition(scores[i], -k - 1)[-k - 1] / np.float32(spare)
                hit = np.flatnonzero((scores[i] * spare >= kth[i])[example])
                seen[i].append((example[hit], product[hit]))
        full, place, out = np.zeros(self.common), np.full(len(scores[0]), -1, np.int32), []
        for i, (at, w) in enumerate(known):
            near = np.flatnonzero((scores[i] > 0) & (scores[i] * spare >= kth[i]))
            if but is not None:
                near = near[near != but[i]]
            _, one, kind = np.unique(self.like[near], return_index=True, return_inverse=True)
            one = near[one]  # its products with the query: those of frequent terms, and those that the lists gave
            full[at] = w
            ends = zip(self.first[one].tolist(), self.dense_last[one].tolist(), strict=True)
            cosine = np.array([self.weight[a:b] @ full.take(self.term[a:b]) for a, b in ends], np.float64)
            full[at] = 0
            place[one] = np.arange(len(one))
            for example, product in seen[i]:
                of = place[example]
                hit = np.flatnonzero(of >= 0)
                cosine += np.bincount(of[hit], product[hit], len(one))
            place[one] = -1
            cosine = cosine[kind]
            best = np.lexsort((self.ids[near], -np.round(cosine, 12)))[:k]
            out.append((near[best], cosine[best]))
        return out


class ToxicityModel:
    """Weights of the slots, the index of examples, and the votes' calibration."""

    def __init__(self, weight: np.ndarray, examples: list[tuple[int, np.ndarray, np.ndarray, int]], k: int = NEIGHBOURS):
        """examples: id, slots, counts, label."""
        self.weight, self.k = weight, k
        labels, ids = [e[3] for e in examples], [e[0] for e in examples]
        self.base = (sum(labels) + 0.5) / (len(labels) + 1)
        self.index = BlockMaxIndex([self.vector(slots, counts) for _, slots, counts, _ in examples], labels, ids, len(weight))
        self.slope, self.intercept = 1.0, 0.0

    def calibrate(self, spark: SparkSession, ids: Sequence[int]) -> None:
        """Fits Platt's curve to the votes of the examples `ids`, each without itself; executors search."""
        sent = spark.sparkContext.broadcast(self)

        def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            learned = sent.value
            hold("toxicity", learned.index.forget)
            index = learned.index
            for batch in batches:
                places = batch.column(0).to_pylist()
                for lo in range(0, len(places), BATCH):
                    some = places[lo : lo + BATCH]
                    found = index.search_many([index.vector(at) for at in some], learned.k, some)
                    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([learned.vote(*near) for near in found], pa.float64())], names=["at", "vote"])

        place = {x: i for i, x in enumerate(self.index.ids.tolist())}
        wanted = spark.createDataFrame([(place[i],) for i in ids], "at long").repartition(max(1, -(-len(ids) // BATCH)))
        got = sorted((r["at"], r["vote"]) for r in wanted.mapInArrow(votes, "at long, vote double").collect())
        sent.unpersist()
        self.slope, self.intercept = fit_platt(self._logit(np.array([v for _, v in got])), self.index.labels[[at for at, _ in got]])

    def vector(self, slots: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = counts * self.weight[slots]
        some = raw > 0
        raw = raw[some]
        return slots[some], raw / np.sqrt((raw * raw).sum()) if len(raw) else raw

    def vote(self, at: np.ndarray, cosines: np.ndarray) -> float:
        """Toxic share of the neighbours, each weighted by its cosine, with PRIOR_VOTES for the share of all examples."""
        return float(((cosines * self.index.labels[at]).sum() + PRIOR_VOTES * self.base) / (cosines.sum() + PRIOR_VOTES))

    @staticmethod
    def _logit(p):
        return np.log(p / (1 - p))

    def score(self, texts: Sequence[str | None]) -> list[tuple[float, list[tuple[int, int, float]]]]:
        """For each text the probability, and (id, label, cosine) of the neighbours that voted."""
        document, slots, counts = term_counts(texts)
        cut = np.searchsorted(document, np.arange(len(texts) + 1))
        vectors = [self.vector(slots[i:j], counts[i:j]) for i, j in zip(cut[:-1], cut[1:], strict=True)]
        out = []
        for at, cosines in self.index.search_many(vectors, self.k) if vectors else ():
            z = self.slope * self._logit(self.vote(at, cosines)) + self.intercept
            out.append((float(1 / (1 + np.exp(-z))), list(zip(self.index.ids[at].tolist(), self.index.labels[at].astype(int).tolist(), cosines.tolist(), strict=True))))
        return out


def term_weights(docs: DataFrame, *, text_col: str = "text") -> np.ndarray:
    """What a term's count is multiplied by: idf times (EVEN + residual idf), over all documents.

    The residual idf (Church and Gale) is what the idf exceeds that of a word that falls as often, but by chance: it is
    high for words that those who use them repeat. A task counts in two arrays of 2**BITS and sends what is not 0.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("toxicity", list)
        df, cf, rows = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64), 0
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                texts = batch.column(0).slice(at, BATCH).to_pylist()
                rows += len(texts)
                _, slots, counts = term_counts(texts)
                df += np.bincount(slots, minlength=1 << BITS)
                cf += np.bincount(slots, counts, 1 << BITS).astype(np.int64)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1), pa.int32()), pa.array(np.append(df[some], rows)), pa.array(np.append(cf[some], 0))], names=["slot", "df", "cf"])

    sums = docs.select(text_col).mapInArrow(count, "slot int, df long, cf long").groupBy("slot").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")).toArrow()
    slot, df_of, cf_of = (sums.column(c).to_numpy() for c in ("slot", "df", "cf"))
    n = int(df_of[slot < 0].sum())
    df, cf = np.zeros(1 << BITS), np.zeros(1 << BITS)
    df[slot[slot >= 0]], cf[slot[slot >= 0]] = df_of[slot >= 0], cf_of[slot >= 0]
    idf = np.log((n + 1) / (df + 1))
    expected = -np.log(-np.expm1(-np.maximum(cf, 0.5) / max(n, 1)))
    return idf * (EVEN + np.maximum(0, idf - expected))


def train_toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", examples: int = EXAMPLES) -> ToxicityModel | None:
    """From at most `examples` labelled documents outside the held-out fold (least hashes first, so the broadcast side is bounded); None unless both labels occur.

    An id that several label rows share counts once, as toxic if one of them says so; of several texts of an id the
    least is the example. Terms are all words of the texts; their weights come from all documents.
    """
    usable = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (crc_fold(F.col(id_col), 3) != 1))
    chosen = hash_sample(usable.groupBy(F.col(id_col).alias("_id")).agg(F.max((F.col(label_col) > 0).cast("int")).alias("_y")), "_id", examples)
    found = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_id")
    texts = found.groupBy("_id").agg(F.min("_text").alias("text"), F.max("_y").alias("y")).select(F.col("_id").cast("long"), "text", "y")

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [term_counts([t])[1:] for t in batch.column(1).to_pylist()]
            made = [pa.array([x[k].astype("<i4").tobytes() for x in out], pa.binary()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *made], names=["id", "y", "slots", "counts"])

    got = texts.select("_id", "text", "y").mapInArrow(indexed, "id long, y int, slots binary, counts binary").withColumn("place", F.xxhash64("id")).collect()
    if len({r["y"] for r in got}) < 2:
        return None
    rows = [(r["id"], np.frombuffer(r["slots"], "<i4"), np.frombuffer(r["counts"], "<i4"), r["y"]) for r in sorted(got, key=lambda r: (r["place"], r["id"]))]
    model = ToxicityModel(term_weights(docs, text_col=text_col), rows)
    model.calibrate(docs.sparkSession, [r[0] for r in rows[:CALIBRATION]])
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel | None, *, id_col: str = "doc_id", text_col: str = "text", reject: float = REJECT, carry: bool = False) -> DataFrame:
    """doc_id, held_out, score, predicted and evidence (nearest examples) for every row; with `carry` also `row`, the input row.

    Texts that share no term with an example (NULL and empty ones too) have no neighbours; their score is that of the
    toxic share of all examples. Without a model (no labels of both kinds) all score 0. Equal cosines go to the least
    example id; repeated rows are scored each; a NULL id is not held out; other columns, whatever their names, are not
    looked at; an empty table gives no rows. One narrow pass over whole texts.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the numbers of examples and slots
    near = pa.struct([("doc_id", pa.int64()), ("toxic", pa.int32()), ("cosine", pa.float64())])

    @F.arrow_udf("struct<score: double, evidence: array<struct<doc_id: bigint, toxic: int, cosine: double>>>")
    def judged(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        learned = sent.value
        hold("toxicity", learned.index.forget if learned else list)
        for batch in texts:
            got = [x for at in range(0, len(batch), BATCH) for x in ([(0.0, [])] * len(batch.slice(at, BATCH)) if learned is None else learned.score(batch.slice(at, BATCH).to_pylist()))]
            flat = list(zip(*(e for _, found in got for e in found), strict=True)) or [(), (), ()]
            ends = pa.array(np.cumsum([0, *(len(found) for _, found in got)]), pa.int32())
            lists = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(flat, near, strict=True)], fields=list(near)))
            yield pa.StructArray.from_arrays([pa.array([s for s, _ in got], pa.float64()), lists], names=["score", "evidence"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(crc_fold(F.col(id_col), 3) == 1, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"), *([F.struct("*").alias("row")] if carry else []))
    return rows.withColumn("_j", judged("text")).select("doc_id", "held_out", "_j.score", (F.col("_j.score") >= reject).cast("int").alias("predicted"), "_j.evidence", *(["row"] if carry else []))


def without_toxic(docs: DataFrame, labels: DataFrame, *, reject: float = REJECT, **kwargs) -> DataFrame:
    """The documents, all columns, whose score is below `reject`."""
    return score_toxicity(docs, train_toxicity(docs, labels, **kwargs), reject=reject, carry=True).where("predicted = 0").select("row.*")
