"""Embedding near-dedup: int8 tile products with a rigorous error bound for each vector, exact cosines only where the bound leaves it open."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hemiciclo.llm.common import stash
from hemiciclo.llm.components import connected_components

THRESHOLD = 0.95
#: Vectors of a block, at most about, and blocks that are made of fewer vectors, so that tasks share them; a tile is a pair of blocks.
BLOCK, LEAST_BLOCKS, LEAST_BLOCK = 8192, 12, 256
#: Rows of a tile that are multiplied at a time.
STRIP = 512
#: More than the rounding of the few double-precision steps that follow the products of whole numbers.
SLACK = 1e-12


class Quantised:
    """Unit vectors u as scale * q + error, q in -127..127; size and error are the norms of the two parts, rounded up."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.norm = np.sqrt((x * x).sum(axis=1))
        unit = x / self.norm[:, None]
        self.scale = np.maximum(np.abs(unit).max(axis=1), 1e-300) / 127
        self.q = np.rint(unit / self.scale[:, None]).astype(np.int8)
        coded = self.q * self.scale[:, None]
        self.size = np.sqrt((coded * coded).sum(axis=1)) * (1 + 1e-12)
        self.error = np.sqrt(((unit - coded) ** 2).sum(axis=1)) * (1 + 1e-12) + 1e-15

    @classmethod
    def of_codes(cls, q: np.ndarray, scale: np.ndarray, size: np.ndarray, error: np.ndarray, x: np.ndarray | None = None) -> Quantised:
        self = cls.__new__(cls)
        self.q, self.scale, self.size, self.error = q, scale, size, error
        if x is not None:
            self.x, self.norm = x, np.sqrt((x * x).sum(axis=1))
        return self

    def __len__(self) -> int:
        return len(self.q)


def code_pairs(left: Quantised, right: Quantised, threshold: float, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places (i, j), i in lo..hi of `left`, of all pairs that may reach the threshold by their codes, and whether they surely do.

    |u.v - product of the codes| <= size_u error_v + error_u size_v + error_u error_v. Products of codes are sums of
    integers below 2**24, so float32 holds them exactly up to 1,040 dimensions (beyond, float64 does); they are scaled
    in double precision. The first comparison takes the largest bounds of a row; its rounding is allowed for.
    """
    kind = np.float32 if left.q.shape[1] <= 1040 else np.float64
    product = left.q[lo:hi].astype(kind) @ right.q.astype(kind).T
    most = left.size[lo:hi] * right.error.max() + left.error[lo:hi] * (right.size.max() + right.error.max())
    least = (threshold - most - SLACK) / left.scale[lo:hi]
    bar = (least - np.abs(least) * 1e-6).astype(kind)[:, None] * ((1 / right.scale).astype(kind))[None, :]
    i, j = np.nonzero(product >= bar)
    value = product[i, j].astype(np.float64) * left.scale[lo:hi][i] * right.scale[j]
    i = i + lo
    bound = left.size[i] * right.error[j] + left.error[i] * (right.size[j] + right.error[j]) + SLACK
    may = value + bound >= threshold
    return i[may], j[may], (value - bound >= threshold)[may]


def exact(left: Quantised, right: Quantised, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Whether the cosines of pairs reach the threshold, in double precision."""
    out = np.zeros(len(i), bool)
    for at in range(0, len(i), 1 << 16):
        a, b = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
        out[at : at + (1 << 16)] = np.einsum("kd,kd->k", left.x[a], right.x[b]) / (left.norm[a] * right.norm[b]) >= threshold
    return out


def linked_pairs(left: Quantised, right: Quantised, threshold: float, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j), i in lo..hi of `left`, of all pairs with a cosine of `threshold` or more: double precision decides where the codes do not."""
    i, j, linked = code_pairs(left, right, threshold, lo, hi)
    open_ = np.flatnonzero(~linked)
    linked[open_] = exact(left, right, i[open_], j[open_], threshold)
    return i[linked], j[linked]


def _join_up(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Labels after more links: the least label of what is connected, by hooking and pointer jumping."""
    while True:
        a, b = label[i], label[j]
        if not (apart := a != b).any():
            return
        np.minimum.at(label, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (label[label] != label).any():
            label[:] = label[label]


def tile_links(ids: np.ndarray, weight: np.ndarray, left: Quantised, right: Quantised | None, threshold: float, reopened: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids and weights: of the rows of `left`, then of `right` (None: `left` against itself).

    Returns, for the rows that link or may link: id, weight of all it surely links to, the id of its component's root in
    the tile, and whether pairs of it are left open. `reopened`: only open pairs count, and double precision decides.
    So a tile gives a row for each of its vectors at most, however many pairs link.
    """
    n = len(left)
    label, count, linked, left_open = np.arange(len(ids)), np.zeros(len(ids)), np.zeros(len(ids), bool), np.zeros(len(ids), bool)
    other = left if right is None else right
    for lo in range(0, n, STRIP):
        i, j, sure = code_pairs(left, other, threshold, lo, min(n, lo + STRIP))
        if right is None:
            apart = i != j
            i, j, sure = i[apart], j[apart], sure[apart]
        shift = 0 if right is None else n
        if reopened:
            i, j = i[~sure], j[~sure]
            yes = exact(left, other, i, j, threshold)
        else:
            left_open[i[~sure]] = left_open[j[~sure] + shift] = True
            yes = sure
        i, j = i[yes], j[yes] + shift
        if right is not None:
            count += np.bincount(j, weights=weight[i], minlength=len(ids))
        count += np.bincount(i, weights=weight[j], minlength=len(ids))
        linked[i] = linked[j] = True
        _join_up(label, i, j)
    rows = np.flatnonzero(linked | left_open)
    return ids[rows], count[rows].astype(np.int64), ids[label[rows]], left_open[rows]


def near_vectors(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row.

    Equal vectors are one class: its least id stands for it and its ids weigh its links. Classes are dealt into blocks by
    a hash, so near copies spread; each pair of blocks is a tile, a task's work of bounded size. A class is sent as int8
    codes, scale and two norms to as many tiles as there are blocks. Vectors of pairs that the codes leave open go, for
    those tiles alone, a second time with their doubles. What comes back is a row for each such class and tile.

    Vectors that are NULL, empty, zero or hold NULL or non-finite components link with nothing, nor do rows with a
    NULL id (their component is NULL, they are kept); vectors of different lengths do not link; a cosine that equals the
    threshold links. Rows that share an id are nodes of one name: equal ones count once, different ones add up. Other
    columns, whatever their names, are not read; an empty table gives no rows.
    """
    made = pa.schema([("vec_id", pa.int64()), ("print", pa.binary()), ("dims", pa.int32()), ("x", pa.binary())])

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            ends, valid = column.offsets.to_numpy(), column.is_valid().to_numpy(zero_copy_only=False)
            values = column.values.to_numpy(zero_copy_only=False).astype(np.float64, copy=False) + 0.0  # -0.0 is 0.0; NULL is NaN
            raw = []
            for i, j, v in zip(ends[:-1].tolist(), ends[1:].tolist(), valid.tolist(), strict=True):
                x = values[i:j]
                square = float(x @ x) if v and j > i else 0.0
                raw.append(x.tobytes() if 0 < square < np.inf else None)
            prints = [x and xxhash.xxh3_128_digest(x) for x in raw]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.binary()), pa.array([x and len(x) // 8 for x in raw], pa.int32()), pa.array(raw, pa.binary())], schema=made)

    coded_kind = pa.schema([("rep", pa.int64()), ("n", pa.int64()), ("print", pa.binary()), ("dims", pa.int32()), ("x", pa.binary()), ("q", pa.binary()), ("scale", pa.float64()), ("size", pa.float64()), ("error", pa.float64())])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(3).to_numpy()
            for d in np.unique(dims):
                rows = batch.take(pa.array(np.flatnonzero(dims == d)))
                c = Quantised(np.frombuffer(b"".join(rows.column(4).to_pylist()), np.float64).reshape(-1, d))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array([q.tobytes() for q in c.q], pa.binary()), pa.array(c.scale), pa.array(c.size), pa.array(c.error)], schema=coded_kind)

    source = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = stash(source.mapInArrow(plain, "vec_id long, print binary, dims int, x binary"), "vectors")
    able = rows.where("vec_id is not null and print is not null")
    once = able.groupBy("print", "dims").agg(F.min("vec_id").alias("rep"), F.count_distinct("vec_id").alias("n"), F.first("x").alias("x"))
    coded = once.select("rep", "n", "print", "dims", "x").mapInArrow(code, "rep long, n long, print binary, dims int, x binary, q binary, scale double, size double, error double")
    classes = stash(coded, "classes")
    total = classes.count()
    blocks = max(1, -(-total // block), min(LEAST_BLOCKS, -(-total // LEAST_BLOCK)))
    placed = classes.withColumn("b", F.pmod(F.xxhash64("print"), F.lit(blocks)).cast("int"))
    every = F.explode(F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda j: F.struct(F.least(F.col("b"), j.cast("int")).alias("i"), F.greatest(F.col("b"), j.cast("int")).alias("j"))))
    columns = ["rep", "n", "dims", "q", "scale", "size", "error", "b"]
    flat = placed.select(*columns, every.alias("tile")).select(*columns, F.col("tile.i").alias("i"), F.col("tile.j").alias("j"))

    def tile(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        ids, weight, b, scale, size, error = (group.column(c).to_numpy() for c in ("rep", "n", "b", "scale", "size", "error"))
        at = [group.column(c)[0].as_py() for c in ("i", "j", "dims")]
        order = np.lexsort((ids, b))
        ids, weight, b, scale, size, error = ids[order], weight[order].astype(np.float64), b[order], scale[order], size[order], error[order]
        cut = int((b == b[0]).sum())
        found = ids[:0], ids[:0], ids[:0], np.zeros(0, bool)
        if cut < len(ids) or at[0] == at[1]:  # else the other block has no vector of this length
            q = np.frombuffer(b"".join(group.column("q").to_pylist()), np.int8).reshape(len(ids), -1)[order]
            again = "x" in group.column_names
            x = np.frombuffer(b"".join(group.column("x").to_pylist()), np.float64).reshape(len(ids), -1)[order] if again else None
            part = [Quantised.of_codes(q[s], scale[s], size[s], error[s], x[s] if again else None) for s in (slice(0, cut), slice(cut, None))]
            found = tile_links(ids, weight, part[0], part[1] if cut < len(ids) else None, threshold, again)
        k = len(found[0])
        return pa.table([*(pa.array(c, pa.int64()) for c in found[:3]), pa.array(found[3]), *(pa.array([x] * k, pa.int32()) for x in at)], names=["rep", "links", "root", "open", "i", "j", "dims"])

    answer = "rep long, links long, root long, open boolean, i int, j int, dims int"
    first = stash(flat.groupBy("i", "j", "dims").applyInArrow(tile, answer), "tiles")
    open_ = first.where("open").select(F.col("rep").alias("of"), F.col("dims").alias("of_dims"), "i", "j").distinct()
    doubles = placed.select(*columns, "x").join(open_, (F.col("rep") == F.col("of")) & (F.col("dims") == F.col("of_dims")) & ((F.col("b") == F.col("i")) | (F.col("b") == F.col("j"))))
    second = stash(doubles.select(*columns, "x", "i", "j").groupBy("i", "j", "dims").applyInArrow(tile, answer), "reopened")
    links = first.where("links > 0").unionByName(second.where("links > 0"))
    component = connected_components(links.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    counted = links.groupBy("rep").agg(F.sum("links").alias("links"))
    known = (
        classes.select("print", "dims", "rep", "n").join(counted, "rep", "left").join(component.withColumnRenamed("node", "rep"), "rep", "left")
        .select("print", "dims", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    )
    named = F.col("vec_id").isNotNull()
    component_id = F.when(named, F.coalesce("component", "vec_id"))
    out = rows.select("vec_id", "print", "dims").join(known, ["print", "dims"], "left")
    return out.select("vec_id", F.when(named, F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"), component_id.alias("component_id"), F.coalesce(component_id == F.col("vec_id"), F.lit(True)).alias("kept"))
