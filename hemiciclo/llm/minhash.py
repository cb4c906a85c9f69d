"""MinHash near-dedup: one-permutation hashing with optimal densification, banded buckets, star-shaped candidate edges."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hemiciclo.llm.common import LOWER, UPPER, give_back, hold, stash
from hemiciclo.llm.components import connected_components

SHINGLE_WORDS = 5
#: Links: PERCENT * union <= 100 * intersection.
PERCENT = 80
BINS, BAND_ROWS = 256, 6
#: A pair at the threshold shares none of the BINS // BAND_ROWS bands with a probability of 3 in a million.
BANDS = BINS // BAND_ROWS
MEMORY = 100_000
#: Rows of a key that one task joins, about, and the keys that are so large, at most one in so many rows.
SPREAD_ROWS, SPREAD_KEYS = 1_000, 5_000
#: Sets of a block, and shingles in all of them, about; a tile compares two blocks.
BLOCK_SETS, BLOCK_SHINGLES = 1024, 500_000
_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())


class _Hashes(dict):
    """Word: its 64-bit hash, made when first asked for."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMORY:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


_hashes = _Hashes()
_hash_of = _hashes.__getitem__


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: a bijection whose output bits all depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str, size: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of the text's different `size`-word shingles; of the whole sequence if it is shorter; empty without words."""
    words = text.encode().translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_hash_of, words), np.uint64, len(words))
    size = min(size, len(h))
    out = np.full(len(h) - size + 1, size, np.uint64)
    for k in range(size):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - size + 1 + k])
    return np.unique(out)


@lru_cache(maxsize=4)
def _donors(bins: int) -> np.ndarray:
    """For each attempt, the bin that each bin looks at when it is empty: a hash of bin and attempt."""
    attempt, at = np.meshgrid(np.arange(1, 4097, dtype=np.uint64), np.arange(bins, dtype=np.uint64), indexing="ij")
    return (_mix(attempt * np.uint64(0xD6E8FEB86659FD93) + at) % np.uint64(bins)).astype(np.int64)


def signature(hashes: np.ndarray, bins: int = BINS) -> np.ndarray:
    """The least hash in each of `bins` equal ranges; an empty range takes that of the first filled one in its own order of attempts."""
    at = (hashes >> np.uint64(64 - bins.bit_length() + 1)).astype(np.int64)
    first = np.flatnonzero(np.diff(at, prepend=-1))
    filled = np.zeros(bins, bool)
    filled[at[first]] = True
    out = np.zeros(bins, np.uint64)
    out[at[first]] = hashes[first]
    empty = np.flatnonzero(~filled)
    for row in _donors(bins):
        if not len(empty):
            break
        donor = row[empty]
        ok = filled[donor]
        out[empty[ok]] = out[donor[ok]]
        empty = empty[~ok]
    else:
        out[empty] = out[at[first[0]]]
    return out


def band_keys(sig: np.ndarray, rows: int = BAND_ROWS) -> np.ndarray:
    """A 64-bit key for each band of `rows` bins, different for different bands."""
    bands = sig[: len(sig) // rows * rows].reshape(-1, rows)
    keys = np.arange(1, len(bands) + 1, dtype=np.uint64)
    for k in range(rows):
        keys = _mix(keys * np.uint64(0x9E3779B97F4A7C15) + bands[:, k])
    return keys.view(np.int64)


def _signed(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, print (128 bits of the whole set), bands."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("print", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("minhash", _hashes.clear)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                n, prints, bands = [], [], []
                for text in part.column(1).to_pylist():
                    s = shingle_set(text or "", size)
                    n.append(len(s))
                    prints.append(xxhash.xxh3_128_digest(s.tobytes()))
                    bands.append(band_keys(signature(s)) if len(s) else np.zeros(0, np.int64))
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, bands)]), pa.int32()), pa.array(np.concatenate(bands)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(prints, pa.binary()), lists], schema=schema)
        batch = part = lists = bands = None
        give_back()

    return docs.mapInArrow(run, "doc_id long, n_shingles long, print binary, bands array<long>")


def _confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Those of `pairs` (a, b) of which full sets link; texts: doc_id, text, a row for each text of an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[tuple, np.ndarray] = ((), np.zeros(0, np.uint64))
        for batch in batches:
            linked = []
            for a, b, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if last[0] != (a, x):
                    last = (a, x), shingle_set(x, size)
                mine, other = last[1], shingle_set(y, size)
                if 100 * min(len(mine), len(other)) >= percent * max(len(mine), len(other)):
                    both = len(np.intersect1d(mine, other, assume_unique=True))
                    if both and 100 * both >= percent * (len(mine) + len(other) - both):
                        linked.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in linked], pa.int64()), pa.array([p[1] for p in linked], pa.int64())], names=["a", "b"])

    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("x"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("y"))
    both = pairs.join(right, "b").join(left, "a").select("a", "b", "x", "y")
    return both.mapInArrow(run, "a long, b long")


def linked_in_tile(sets: list[np.ndarray], component: np.ndarray, split: int | None, percent: int, width: int = 4096) -> list[tuple[int, int]]:
    """Places (i, j) of links between different components that span what is connected: of the first `split` sets with the others (None: of all with all).

    Intersections are products of 0/1 rows over the shingles that two sets or more have, `width` columns at a time;
    float32 holds the counts exactly.
    """
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    _, column, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    row, column = row[seen[column] > 1], column[seen[column] > 1]
    column = np.unique(column, return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    left, right = (slice(0, split), slice(split, None)) if split is not None else (slice(None), slice(None))
    both = np.zeros((len(sizes[left]), len(sizes[right])), np.float32)
    for low in range(0, int(column.max(initial=-1)) + 1, width):
        i, j = np.searchsorted(column, [low, low + width])
        dense = np.zeros((len(sets), width), np.float32)
        dense[row[i:j], column[i:j] - low] = 1
        both += dense[left] @ dense[right].T
    total = (sizes[left][:, None] + sizes[right][None, :]).astype(np.float32)
    linked = ((100 + percent) * both >= percent * total) & (component[left][:, None] != component[right][None, :]) & (both > 0)
    label = {c: c for c in component.tolist()}

    def root(c: int) -> int:
        while label[c] != c:
            c = label[c] = label[label[c]]
        return c

    found = []
    for i, j in zip(*(x.tolist() for x in np.nonzero(linked)), strict=True):
        j += split or 0
        a, b = root(int(component[i])), root(int(component[j]))
        if a != b:
            label[a] = b
            found.append((i, j))
    return found


def _links_between(residual: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Links a, b that span the components of residual rows (rep, component, family), from the full sets of every pair of a family's rows.

    A family is cut into blocks of bounded size by a hash; each pair of its blocks is a tile, a task's work of
    bounded size. A row goes to as many tiles as its family has blocks; only spanning links come back.
    """
    kind = pa.schema([("rep", pa.int64()), ("component", pa.int64()), ("family", pa.int64()), ("n", pa.int64()), ("set", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, size).tobytes() for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([len(x) // 8 for x in sets], pa.int64()), pa.array(sets, pa.binary())], schema=kind)

    rows = residual.join(texts, F.col("rep") == F.col("doc_id")).select("rep", "component", "family", "text").mapInArrow(run, "rep long, component long, family long, n long, set binary")
    rows = stash(rows, "residual")
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int")
    families = rows.groupBy("family").agg(blocks.alias("blocks"))
    placed = rows.join(families, "family").withColumn("b", F.pmod(F.xxhash64("rep", F.lit("block")), F.col("blocks")).cast("int"))
    tiles = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least("b", j).alias("i"), F.greatest("b", j).alias("j"))))
    sent = placed.select("rep", "component", "family", "set", "b", tiles.alias("tile")).select("rep", "component", "family", "set", "b", "tile.i", "tile.j")

    def tile(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        rep, component, b = (group.column(c).to_numpy() for c in ("rep", "component", "b"))
        order = np.lexsort((rep, b))
        raw = group.column("set").to_pylist()
        sets = [np.frombuffer(raw[k], np.uint64) for k in order]
        one = group.column("i")[0].as_py() == group.column("j")[0].as_py()
        split = None if one else int((b == group.column("i")[0].as_py()).sum())
        found = linked_in_tile(sets, component[order], split, percent)
        ends = [[int(rep[order[p[k]]]) for p in found] for k in (0, 1)]
        return pa.table([pa.array(e, pa.int64()) for e in ends], names=["a", "b"])

    return sent.groupBy("family", "i", "j").applyInArrow(tile, "a long, b long")


def _joined(component: DataFrame, links: DataFrame) -> DataFrame:
    """Components after more links: those that the links join are merged, over one node a component."""
    label = lambda end: F.coalesce(F.col(f"{end}.component"), F.col(f"l.{end}"))
    a, b = component.alias("a"), component.alias("b")
    met = links.alias("l").join(a, F.col("l.a") == F.col("a.node"), "left").join(b, F.col("l.b") == F.col("b.node"), "left").select(label("a").alias("a"), label("b").alias("b"))
    merged = stash(connected_components(met), "merged")
    moved = component.join(merged.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return stash(moved.unionByName(merged.join(component, "node", "left_anti")), "component")


def with_sums(rows: DataFrame, sums: DataFrame, key: str, member: str) -> DataFrame:
    """rows and sums (a row a key, with the number `n` of its rows) joined on `key`, a large key by several tasks.

    Keys of more rows than SPREAD_ROWS and than one in SPREAD_KEYS of all are few, so they can be sent to every task;
    their rows are dealt by a hash of `member`, and their sums are copied for each part.
    """
    total = sums.agg(F.sum("n").alias("n")).first()["n"] or 0
    parts = F.ceil(F.col("n") / SPREAD_ROWS).cast("int")
    large = sums.where(F.col("n") > max(SPREAD_ROWS, total // SPREAD_KEYS)).select(F.col(key).alias("_key"), F.least(parts, F.lit(1_000)).alias("_parts"))
    dealt = rows.join(F.broadcast(large), F.col(key) == F.col("_key"), "left").withColumn("_part", F.pmod(F.xxhash64(member), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_key", "_parts")
    copied = sums.join(F.broadcast(large), F.col(key) == F.col("_key"), "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_key", "_parts")
    return dealt.join(copied, [key, "_part"]).drop("_part")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row.

    1. One pass hashes each text's shingle set, its 128-bit print and its band keys. Rows with one print have one set;
       the least id of each stands for them from here on, so groups of copies cost a row each.
    2. In each bucket (band key) the least member is the centre of a star; a pair that several buckets propose counts
       once. The full sets of each star edge are compared, and links make components.
    3. A bucket whose members are still in several components may hide a link between members that its centre does
       not link to. Each such bucket gets one more star, around a centre of its own, to members of other components.
       Members of buckets that are still mixed form families (buckets that share a member are one), and all sets of
       a family are compared in tiles of bounded size. So every link between bucket members counts, while a bucket
       that is one component costs no more, and no pair leaves a tile but spanning links.

    Sets without a word (NULL and empty texts) link with nothing. Rows that share an id count as one document, which
    links by any of its texts. Rows with a NULL id link with nothing, have a NULL component and are kept. A pair exactly
    at the threshold links. Other columns, whatever their names, are not read. An empty table gives no rows.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = stash(_signed(source, shingle_words), "signed", texts=True)
    able = signed.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    classes = able.groupBy("print").agg(F.min("doc_id").alias("rep"))
    members = able.join(classes, "print").where("doc_id = rep").select("rep", F.explode("bands").alias("key"))
    sums = stash(members.groupBy("key").agg(F.count("*").alias("n"), F.min("rep").alias("centre")).where("n > 1"), "sums")
    buckets = stash(with_sums(members, sums, "key", "rep").distinct(), "buckets")
    pairs = stash(buckets.where("rep != centre").select(F.col("centre").alias("a"), F.col("rep").alias("b")).distinct(), "pairs")
    wanted = buckets.select(F.col("rep").alias("doc_id")).distinct()
    texts = stash(source.join(wanted, "doc_id", "left_semi").join(classes.withColumnRenamed("rep", "doc_id"), "doc_id", "left_semi").distinct(), "texts")
    component = stash(connected_components(_confirmed(pairs, texts, shingle_words, percent)), "component")

    def mixed_members(component: DataFrame) -> DataFrame:
        """key, rep, component of the buckets of three or more members and several components, and a centre for each."""
        placed = buckets.where("n > 2").join(component.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("component"))
        order = F.struct(F.xxhash64("rep", "key").alias("hash"), "rep", "component")
        several = placed.groupBy("key").agg(F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high"), F.min(order).alias("centre"))
        several = stash(several.where("low < high").select("key", "n", "centre"), "several")
        return stash(with_sums(placed, several, "key", "rep").drop("n"), "mixed")

    mixed = mixed_members(component)
    if not mixed.isEmpty():
        star = mixed.where(F.col("component") != F.col("centre.component")).select(F.least("rep", "centre.rep").alias("a"), F.greatest("rep", "centre.rep").alias("b")).distinct()
        star = stash(star.join(pairs, ["a", "b"], "left_anti"), "pairs")
        component = _joined(component, _confirmed(star, texts, shingle_words, percent))
        left = mixed_members(component)
        family = connected_components(left.select(F.col("centre.rep").alias("a"), F.col("rep").alias("b")))
        residual = left.select("rep", "component").distinct().join(family.select(F.col("node").alias("rep"), F.col("component").alias("family")), "rep")
        component = _joined(component, _links_between(residual, texts, shingle_words, percent))
    grouped = classes.join(component.withColumnRenamed("node", "rep"), "rep", "left").select("print", F.coalesce("component", "rep").alias("component"))
    out = signed.join(grouped, "print", "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("c"))
    component_id = F.when(F.col("doc_id").isNotNull(), F.coalesce("c", "doc_id"))
    return out.select("doc_id", "n_shingles", component_id.alias("component_id"), F.coalesce(component_id == F.col("doc_id"), F.lit(True)).alias("kept"))


def without_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **kwargs) -> DataFrame:
    """One document, the one with the least id, of each group of near-duplicates; all columns. Of its rows one stays for each text."""
    kept = near_duplicates(docs, id_col=id_col, text_col=text_col, **kwargs).where("kept").select(F.col("doc_id").alias("_id")).distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("_id"), F.md5(F.col(text_col).cast("binary")).alias("_text"))
    named = rows.where("_id is not null").join(kept, "_id", "left_semi").groupBy("_id", "_text").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return named.select("row.*").unionByName(rows.where("_id is null").select("row.*"))
