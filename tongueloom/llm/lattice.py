"""Near-duplicate vectors by lattice hashing.

In every table two random projections onto eight dimensions are decoded to the nearest points of the E8 lattice;
the pair of points is the cell of a vector. Vectors of one cell are compared, and every vector also probes the cells across the nearest
lattice neighbours. All found pairs are verified by their cosine in double precision.

Equal vectors are one row with a weight. Cells are compared in blocks of bounded size by matrix products; links within a
cell are counted and reduced to a spanning forest there, so a large group is never written out as pairs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tongueloom.llm.common import attach, components, prepare, smallest_member
from tongueloom.llm.wordhash import grouped, keys, mix, spanning
from tongueloom.session import stage


@dataclass(frozen=True)
class Lattice:
    """``scale`` stretches unit vectors before decoding; ``probes`` cells are looked up besides the own one in each table."""

    cosine: float = 0.95
    tables: int = 10
    scale: float = 0.6
    probes: int = 9
    block: int = 256
    seed: int = 5


def _d8(y: np.ndarray) -> np.ndarray:
    """Nearest point with integer coordinates of even sum."""
    x = np.rint(y)
    odd = np.flatnonzero(x.sum(axis=-1) % 2)
    if len(odd):
        off = y[odd] - x[odd]
        worst = np.abs(off).argmax(axis=-1)
        rows = np.arange(len(odd))
        x[odd, worst] += np.where(off[rows, worst] >= 0, 1.0, -1.0)
    return x


def nearest_e8(y: np.ndarray) -> np.ndarray:
    """Nearest E8 point of each row: the better of the even-sum integers and the same shifted by one half."""
    a, b = _d8(y), _d8(y - 0.5) + 0.5
    return np.where((((y - a) ** 2).sum(-1) <= ((y - b) ** 2).sum(-1))[..., None], a, b)


def _shortest() -> np.ndarray:
    """The 240 lattice points next to the origin."""
    out = []
    for i in range(8):
        for j in range(i):
            for s in (1, -1):
                for t in (1, -1):
                    v = np.zeros(8)
                    v[i], v[j] = s, t
                    out.append(v)
    for bits in range(256):
        v = np.array([0.5 if bits >> k & 1 else -0.5 for k in range(8)])
        if v.sum() % 2 == 0:
            out.append(v)
    return np.array(out)


_SHORT = _shortest()


def _cell_key(table: int, dim: int, x1: np.ndarray, x2: np.ndarray) -> np.ndarray:
    salt = keys(17, 1000 * table + dim)
    point = np.concatenate((x1, x2), axis=-1)
    with np.errstate(over="ignore"):
        return mix((np.rint(2 * point).astype(np.int64).view(np.uint64) * (salt[:16] | np.uint64(1))).sum(-1, dtype=np.uint64) + salt[16])


def cells(unit: np.ndarray, p: Lattice) -> tuple[np.ndarray, np.ndarray]:
    """Own cells ``(n, tables)`` and probed cells ``(n, tables, probes)`` of unit vectors of one dimension."""
    n, dim = unit.shape
    own, probed = np.empty((n, p.tables), dtype=np.uint64), np.empty((n, p.tables, p.probes), dtype=np.uint64)
    for t in range(p.tables):
        matrix = np.random.Generator(np.random.PCG64([p.seed, t, dim])).standard_normal((dim, 16)) * p.scale
        y = unit @ matrix
        y1, y2 = y[:, :8], y[:, 8:]
        x1, x2 = nearest_e8(y1), nearest_e8(y2)
        own[:, t] = _cell_key(t, dim, x1, x2)
        near, gain = [], []
        for yy, xx in ((y1, x1), (y2, x2)):
            g = (yy - xx) @ _SHORT.T
            best = np.argsort(-g, axis=1, kind="stable")[:, : p.probes]
            near.append(best)
            gain.append(np.take_along_axis(g, best, 1))
        both = gain[0][:, :1] + gain[1][:, :1] - 1  # moving in both blocks costs the distance of either
        choice = np.argsort(-np.concatenate((gain[0], gain[1], both), axis=1), axis=1, kind="stable")[:, : p.probes]
        for k in range(p.probes):
            c = choice[:, k]
            first, second = c < p.probes, (c >= p.probes) & (c < 2 * p.probes)
            joint = c == 2 * p.probes
            m1 = np.where(first, np.take_along_axis(near[0], np.minimum(c, p.probes - 1)[:, None], 1)[:, 0], near[0][:, 0])
            m2 = np.where(second, np.take_along_axis(near[1], np.clip(c - p.probes, 0, p.probes - 1)[:, None], 1)[:, 0], near[1][:, 0])
            z1 = np.where((first | joint)[:, None], x1 + _SHORT[m1], x1)
            z2 = np.where((second | joint)[:, None], x2 + _SHORT[m2], x2)
            probed[:, t, k] = _cell_key(t, dim, z1, z2)
    return own, probed


def _unit(v) -> np.ndarray | None:
    """The vector at length one; None if it has no direction."""
    if v is None or not len(v) or any(x is None for x in v):
        return None
    a = np.asarray(v, dtype=np.float64)
    top = np.abs(a).max()
    if not np.isfinite(a).all() or top == 0:
        return None
    a = a / top
    return a / np.sqrt(a @ a)


def hashed(vectors: DataFrame, p: Lattice) -> DataFrame:
    """``(vec_id, unit, own, probed)``; all but the id are null where a vector can link with nothing."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = [_unit(v) for v in batch.column("embedding").to_pylist()]
            own: list = [None] * len(units)
            probed: list = [None] * len(units)
            for dim in {len(u) for u in units if u is not None}:
                at = [i for i, u in enumerate(units) if u is not None and len(u) == dim]
                o, q = cells(np.array([units[i] for i in at]), p)
                for k, i in enumerate(at):
                    own[i], probed[i] = o[k].view(np.int64), q[k].reshape(-1).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").cast(pa.int64()), pa.array(units, type=pa.list_(pa.float64())), pa.array(own, type=pa.list_(pa.int64())),
                 pa.array(probed, type=pa.list_(pa.int64()))], names=["vec_id", "unit", "own", "probed"])

    return vectors.select("vec_id", "embedding").mapInArrow(run, "vec_id long, unit array<double>, own array<long>, probed array<long>")


def _blocks(members: DataFrame, p: Lattice) -> DataFrame:
    """``(task, cell, role, id, ...)``: members dealt to pairs of blocks of about ``block`` rows; every pair of a cell meets in one task."""
    size = members.groupBy("cell").agg(F.count("*").alias("n"), F.sum(1 - F.col("probe")).alias("owners")).where("n > 1 and owners > 0")
    size = stage(size.select("cell", F.ceil(F.col("n") / p.block).cast("int").alias("nb")), "cells")
    rows = attach(members, size, ["cell"]).withColumn("salt", F.pmod(F.xxhash64("id"), F.col("nb")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    return rows.withColumn("x", F.least("salt", "other")).withColumn("y", F.greatest("salt", "other")).drop("nb", "other")


_FOUND = "kind int, a long, b long, n long"


def _compare(p: Lattice):
    """Within a task: counts of links of own members (kind 0), edges of their forest (kind 1), links that only probing found (kind 2)."""

    def group(rows: list[pa.Table | pa.RecordBatch]) -> list[tuple[int, int, int, int]]:
        t = pa.Table.from_batches(rows)
        ids, probe, salt, weight = (t.column(c).to_numpy() for c in ("id", "probe", "salt", "weight"))
        x, y, table = t.column("x")[0].as_py(), t.column("y")[0].as_py(), t.column("tab")[0].as_py()
        if len(ids) < 2:
            return []
        own = np.array(t.column("own").combine_chunks().flatten().to_numpy()).reshape(len(ids), p.tables)
        units = t.column("unit").combine_chunks()
        dims = np.diff(units.offsets.to_numpy())
        if (dims != dims[0]).any():  # two dimensions in one cell: a hash collision
            return []
        unit = np.array(units.flatten().to_numpy()).reshape(len(ids), -1)
        link = unit @ unit.T >= p.cosine
        np.fill_diagonal(link, False)
        if x != y:  # pairs inside a block are compared in that block's own task
            link &= salt[:, None] != salt[None, :]
        i, j = np.nonzero(np.triu(link))
        keep = ids[i] != ids[j]
        i, j = i[keep], j[keep]
        same = own[i] == own[j]
        first = np.where(same.any(axis=1), same.argmax(axis=1), -1)
        here = (probe[i] == 0) & (probe[j] == 0) & (first == table)
        out: list[tuple[int, int, int, int]] = []
        if here.any():
            matrix = np.zeros_like(link)
            matrix[i[here], j[here]] = matrix[j[here], i[here]] = True
            n = matrix @ weight
            out += [(0, a, a, c) for a, c in zip(ids.tolist(), n.tolist()) if c]
            out += [(1, a, b, 0) for a, b in zip(*(e.tolist() for e in spanning(ids, matrix)))]
        far = (first < 0) & (probe[i] + probe[j] == 1)
        out += [(2, min(a, b), max(a, b), 0) for a, b in zip(ids[i[far]].tolist(), ids[j[far]].tolist())]
        return out

    def batch_of(rows: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], type=kind) for k, kind in enumerate(kinds)], names=["kind", "a", "b", "n"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in grouped(batches, ("cell", "x", "y")):
            out = group(rows)
            if out:
                yield batch_of(out)

    return run


def near_duplicates(vectors: DataFrame, p: Lattice = Lattice()) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` of every row of ``vectors(vec_id, embedding)``; other columns are ignored.

    ``n_links`` counts the other rows found with a cosine of at least ``cosine``, ``component_id`` is the smallest id reachable by links. Null,
    empty and zero vectors and those with null or non-finite components link with nothing, and vectors link only with those of
    their dimension. Rows that repeat a ``vec_id`` must hold one vector and count once. A null ``vec_id`` links with nothing and is returned
    with a null component. An empty table gives an empty result.
    """
    prepare(vectors.sparkSession)
    all_rows = stage(hashed(vectors, p), "hashed")
    named = all_rows.where("unit is not null and vec_id is not null").dropDuplicates(["vec_id"])
    classes = stage(
        named.groupBy(F.md5(F.concat_ws(",", F.col("unit").cast("array<string>"))).alias("class"))
        .agg(F.min("vec_id").alias("id"), F.count("*").alias("weight"), F.first("unit").alias("unit"), F.first("own").alias("own"),
             F.first("probed").alias("probed")), "vector-classes")
    own = classes.select("id", F.posexplode("own").alias("tab", "cell")).withColumn("probe", F.lit(0))
    probe = classes.select("id", F.posexplode("probed").alias("k", "cell")).select(
        "id", F.floor(F.col("k") / p.probes).cast("int").alias("tab"), "cell", F.lit(1).alias("probe"))
    places = stage(_blocks(stage(own.unionByName(probe), "places"), p), "block-places")
    members = places.join(classes.select("id", "weight", "unit", "own"), "id")
    found = stage(
        members.select("cell", "x", "y", "id", "tab", "probe", "salt", "weight", "unit", "own").repartition("cell", "x", "y")
        .sortWithinPartitions("cell", "x", "y", "id", "probe").mapInArrow(_compare(p), _FOUND), "found")
    weight = classes.select("id", "weight")
    far = stage(found.where("kind = 2").select("a", "b").distinct(), "far-links")
    far_n = (far.select("a", F.col("b").alias("id")).unionByName(far.select(F.col("b").alias("a"), F.col("a").alias("id")))
             .join(weight, "id").groupBy("a").agg(F.sum("weight").alias("n")))
    counts = found.where("kind = 0").select("a", "n").unionByName(far_n).groupBy("a").agg(F.sum("n").alias("links"))
    parts = smallest_member(components(found.where("kind = 1").select("a", "b").unionByName(far)))
    of_class = stage(
        classes.select("class", "id", "weight").join(counts.withColumnRenamed("a", "id"), "id", "left")
        .join(parts.withColumnRenamed("node", "id"), "id", "left")
        .select("class", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id")),
        "class-results")
    usable = F.col("unit").isNotNull() & F.col("vec_id").isNotNull()
    key = F.when(usable, F.md5(F.concat_ws(",", F.col("unit").cast("array<string>"))))
    out = all_rows.select("vec_id", key.alias("class")).join(of_class, "class", "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      (F.col("vec_id") == component).alias("kept"))
