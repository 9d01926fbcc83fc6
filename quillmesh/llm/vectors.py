"""Problem 1: the k most similar vectors of every vector, and all pairs of close vectors.

Method: cross-polytope hashing. Unit vectors are padded to a power of two and go through three rounds of random
signs and a fast Hadamard transform; the nearest signed axis is the hash. The last hash may use fewer axes, so that a
table has about one cell for each ``OCCUPANCY`` vectors. Each table is an independent set of rotations. A vector lives in its nearest
cell of each table and looks into the ``probes`` cells whose axes lie nearest (multiprobe). Candidates are ranked inside the cell, the
best of each region leave it, and the winners over all tables are reranked by their exact cosine.

The index is planned for each number of dimensions and order of magnitude of a space (``planned``): hashes from the number of
vectors; tables and probes by simulating pairs at the cosine aimed at, until the recall wanted is reached at the least
cost. For close pairs that cosine is the threshold; for k neighbours those of the k nearest among as many directions
spread evenly, which is the hardest case. Only these orders of magnitude are counted before the search is planned.

Rows are shuffled by (space, table, region). A region is decided by the leading hashes, as many as are needed for
regions of about ``REGION`` vectors, so that it doesn't grow with the space; one row serves all cells that a vector looks into within a region. What is shuffled is
the direction in half precision. A region that still has more than ``block`` vectors (a third of the table in one place) is divided
into blocks, which lose no pair. Exact copies of a direction are one representative in the search.

Usable records: an id, a vector whose length is its dimensions, all values finite and not all zero. Repeated ids
count once. Versions (and different dimensions of one version) are never compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.session import ship, spread
from quillmesh.sources.tables import once

SEED = 20_24
OCCUPANCY = 64
REGION = 1024
#: Half precision moves a cosine by less than this.
HALF = 2e-3
#: Most spaces whose orders of magnitude, two numbers each, are broadcast; more are joined by shuffle.
MOST_SENT = 100_000
TABLES = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32)
ROTATIONS = 8
#: A row sent costs about as much as so many candidates compared.
ROW_COST = 500


@dataclass(frozen=True)
class Index:
    """``hashes`` of which ``lead`` decide the region; the last one uses ``last`` axes."""

    dims: int
    tables: int
    hashes: int
    last: int
    probes: int
    lead: int
    regions: int


@dataclass(frozen=True)
class Goal:
    """What a search is planned for: the recall at the k nearest or, with ``least``, at that cosine."""

    recall: float
    k: int = 10
    least: float | None = None
    block: int = 1 << 15


NEIGHBOURS = Goal(recall=0.96)
CLOSE = Goal(recall=0.9999, least=0.95)


def width(dims: int) -> int:
    return 1 << max(1, (dims - 1).bit_length())


def hadamard(x: np.ndarray) -> np.ndarray:
    """The normalised fast Hadamard transform of each row; the width is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack((x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]), axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def rotate(x: np.ndarray, seed: int, table: int, k: int) -> np.ndarray:
    """A pseudo-random rotation of unit vectors, padded to a power of two."""
    d = width(x.shape[1])
    y = np.zeros((len(x), d), np.float32)
    y[:, : x.shape[1]] = x
    signs = np.random.default_rng([seed, table, k, d]).integers(0, 2, (3, d)).astype(np.float32) * 2 - 1
    for s in signs:
        y = hadamard(y * s)
    return y


def nearest_axes(y: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """The m nearest signed axes of each row (axis, or width + axis if negative) and the products with them, nearest first."""
    both = np.concatenate([y, -y], axis=1)
    m = min(m, both.shape[1])
    top = np.argpartition(-both, m - 1, axis=1)[:, :m] if m < both.shape[1] else np.tile(np.arange(m), (len(y), 1))
    near = np.take_along_axis(both, top, 1)
    order = np.argsort(-near, axis=1, kind="stable")
    return np.take_along_axis(top, order, 1), np.take_along_axis(near, order, 1)


def probed_cells(x: np.ndarray, index: Index, table: int) -> tuple[np.ndarray, np.ndarray]:
    """(region, cell) of the ``probes`` nearest cells of each row, its home first. A cell is a combination of axes, as near
    as the sum of their products; its region follows from the leading ones."""
    d, n = width(index.dims), len(x)
    each = max(2, min(2 * d, int(np.ceil((4 * index.probes) ** (1 / max(1, min(2, index.hashes)))))))
    lead = cell = np.zeros((n, 1), np.int64)
    near = np.zeros((n, 1), np.float32)
    for h in range(index.hashes):
        last = h == index.hashes - 1
        y = rotate(x, SEED, table, h)
        axis, product = nearest_axes(y[:, : index.last] if last else y, each)
        m = axis.shape[1]
        total = (near[:, :, None] + product[:, None, :]).reshape(n, -1)
        cells = (cell[:, :, None] * (2 * d) + axis[:, None, :]).reshape(n, -1)
        keep = min(total.shape[1], index.probes if last else 4 * index.probes)
        order = np.argpartition(-total, keep - 1, axis=1)[:, :keep] if keep < total.shape[1] else np.tile(np.arange(keep), (n, 1))
        order = np.take_along_axis(order, np.argsort(-np.take_along_axis(total, order, 1), axis=1, kind="stable"), 1)
        lead = np.take_along_axis(cells if h < index.lead else np.repeat(lead, m, axis=1), order, 1)
        cell, near = np.take_along_axis(cells, order, 1), np.take_along_axis(total, order, 1)
    return lead % index.regions, cell


def kth_cosines(n: float, dims: int, k: int) -> list[float]:
    """The cosines expected of the 1st..kth nearest of n directions spread evenly over the sphere."""
    c = np.linspace(-1, 1, 20_001)
    density = np.maximum(1 - c * c, 0) ** ((max(dims, 2) - 3) / 2) if dims != 2 else 1 / np.sqrt(np.maximum(1 - c * c, 1e-9))
    tail = np.cumsum(density[::-1])[::-1]
    tail = tail / tail[0]
    return [float(c[min(len(c) - 1, int(np.searchsorted(-tail, -min(1.0, (j + 0.5) / max(n, 1)))))]) for j in range(k)]


@cache
def planned(dims: int, magnitude: int, goal: Goal) -> Index:
    """The index for a space of 2 ** ``magnitude`` vectors: the cheapest tables and probes that find pairs at the cosines aimed
    at, by simulated pairs."""
    n, d = 2.0**magnitude, width(dims)
    cells = max(2.0, n / OCCUPANCY)
    hashes, last = 1, d
    while (2.0 * d) ** hashes < cells:
        hashes += 1
    while last > 1 and (2.0 * d) ** (hashes - 1) * last >= cells:
        last //= 2
    regions, lead = max(1, round(n / REGION)), 0
    while lead < hashes and (2 * d) ** lead < regions:
        lead += 1
    aims = np.array([goal.least] if goal.least is not None else kth_cosines(n, dims, goal.k))
    rng = np.random.default_rng(SEED)
    x = rng.normal(size=(800 // len(aims) * len(aims), dims))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.normal(size=x.shape)
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)
    c = np.resize(aims, len(x))[:, None]
    x, y = x.astype(np.float32), (c * x + np.sqrt(1 - c * c) * z).astype(np.float32)
    most = min(64, int(2 * last * (2.0 * d) ** (hashes - 1)))
    found = np.zeros((len(aims), most))  # of each cosine: how often one table finds a pair, by number of probes
    for t in range(ROTATIONS):
        r, q = probed_cells(x, Index(dims, 1, hashes, last, most, lead, regions), t)
        home_r, home_q = probed_cells(y, Index(dims, 1, hashes, last, 1, lead, regions), t)
        hit = np.logical_or.accumulate((r == home_r) & (q == home_q), axis=1)
        found += hit.reshape(-1, len(aims), most).mean(axis=0) / ROTATIONS
    rows = np.array([np.mean([len(set(row[: p + 1])) for row in r[:100].tolist()]) for p in range(most)])
    top: tuple[float, Index] | None = None
    for tables in TABLES:
        enough = np.flatnonzero(1 - ((1 - found) ** tables).mean(axis=0) >= goal.recall)
        if len(enough):
            p = int(enough[0])
            cost = tables * (rows[p] * ROW_COST + (p + 1) * n / ((2.0 * d) ** (hashes - 1) * 2 * last))
            if top is None or cost < top[0]:
                top = cost, Index(dims, tables, hashes, last, p + 1, lead, regions)
    return top[1] if top else Index(dims, TABLES[-1], hashes, last, most, lead, regions)


def usable(records: DataFrame) -> DataFrame:
    """(vec_id, space, values) of the records that can be compared, each once. ``space`` tells apart what can't be."""
    v = F.col("vector.values")
    good = v.isNotNull() & (F.size(v) == F.col("vector.dimensions")) & (F.size(v) > 0)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    some = F.exists(v, lambda x: x != 0)
    rows = once(records.where(F.col("vec_id").isNotNull() & good).where(finite & some).select("vec_id", "embedding_version", "vector", "ingested_at"), "vec_id")
    space = F.concat_ws("\0", F.coalesce("embedding_version", F.lit("")), F.col("vector.dimensions").cast("string"))
    return rows.select("vec_id", F.xxhash64(space).alias("space"), v.alias("values"))


def unit_vectors(rows: DataFrame) -> DataFrame:
    """(vec_id, space, dims, unit): the direction as single-precision bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, dims = [], []
            for v in b.column(2):
                x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                x = x / np.abs(x).max()
                out.append((x / np.sqrt((x * x).sum())).astype(np.float32).tobytes())
                dims.append(len(x))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(dims, pa.int32()), pa.array(out, pa.binary())], names=["vec_id", "space", "dims", "unit"])

    return rows.mapInArrow(run, "vec_id bigint, space bigint, dims int, unit binary")


def with_classes(rows: DataFrame) -> DataFrame:
    """``rows`` with ``rep``, the least id of the exact copies of their direction, and ``copies``, their number. Copies are
    counted before they are shuffled; only directions that occur more than once are joined back."""
    key = ["space", "unit"]
    several = rows.groupBy(*key).agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")).where("copies > 1")
    return rows.join(several, key, "left").withColumns({"rep": F.coalesce("rep", "vec_id"), "copies": F.coalesce("copies", F.lit(1))})


_TABLE = pa.schema(
    [("space", pa.int64()), ("tab", pa.int32()), ("region", pa.int64()), ("rep", pa.int64()), ("home", pa.int64()), ("cells", pa.list_(pa.int64())), ("half", pa.binary())]
)


def hashed(reps: DataFrame, plans: dict[tuple[int, int], Index]) -> DataFrame:
    """For each vector (rep, space, dims, magnitude, unit), table and region it looks into a row (space, tab, region, rep, home, cells, half):
    ``home`` is the vector's own cell, or -1 outside its own region; ``cells`` are those it looks into."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part.slice(i, 4096) for part in batches for i in range(0, part.num_rows, 4096)):
            rep, space = b.column(0).to_numpy(), b.column(1).to_numpy()
            dims, magnitude, unit = b.column(2).to_numpy(), b.column(3).to_numpy(), b.column(4).to_pylist()
            for d, m in sorted(set(zip(dims.tolist(), magnitude.tolist(), strict=True))):
                mine = np.flatnonzero((dims == d) & (magnitude == m))
                x = np.frombuffer(b"".join(unit[i] for i in mine), np.float32).reshape(len(mine), d)
                half = [h.tobytes() for h in x.astype(np.float16)]
                index = plans[d, m]
                for t in range(index.tables):
                    region, cell = probed_cells(x, index, t)
                    who = np.repeat(np.arange(len(mine)), region.shape[1])
                    first = np.tile(np.arange(region.shape[1]), len(mine)) == 0
                    r, c = region.ravel(), cell.ravel()
                    order = np.lexsort((~first, r, who))
                    who, r, c, first = who[order], r[order], c[order], first[order]
                    starts = np.flatnonzero(np.concatenate([[True], (who[1:] != who[:-1]) | (r[1:] != r[:-1])]))
                    home = np.where(first[starts], c[starts], -1)
                    at = who[starts]
                    cells = pa.ListArray.from_arrays(pa.array(np.append(starts, len(who)), pa.int32()), pa.array(c, pa.int64()))
                    columns = [pa.array(space[mine][at]), pa.array(np.full(len(at), t), pa.int32()), pa.array(r[starts]), pa.array(rep[mine][at]), pa.array(home), cells, pa.array([half[i] for i in at], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, schema=_TABLE)

    return reps.select("rep", "space", "dims", "magnitude", "unit").mapInArrow(run, "space bigint, tab int, region bigint, rep bigint, home bigint, cells array<bigint>, half binary")


_PAIRS = pa.schema([("vec_a", pa.int64()), ("vec_b", pa.int64()), ("cosine", pa.float32())])
#: Cosines computed at once.
MATRIX = 1 << 22


def search_region(t: pa.Table, k: int | None, least: float) -> pa.Table:
    """Pairs of the vectors at home in a region with those that look into their cells: each asker's k best, or with ``k`` None all."""
    t = t.combine_chunks()
    role, home, rep = (t[c].to_numpy() for c in ("role", "home", "rep"))
    own, ask = np.flatnonzero((home >= 0) & (role != 2)), np.flatnonzero(role != 1)
    if not len(own) or not len(ask):
        return _PAIRS.empty_table()
    x = np.frombuffer(b"".join(t["half"].to_pylist()), np.float16).reshape(t.num_rows, -1).astype(np.float32)
    lists = t["cells"].combine_chunks()
    who = np.repeat(np.arange(t.num_rows), np.diff(lists.offsets.to_numpy()))
    asked = lists.flatten().to_numpy()
    asked, who = asked[role[who] != 1], who[role[who] != 1]
    own = own[np.argsort(home[own], kind="stable")]
    cells, at = np.unique(home[own], return_index=True)
    order = np.argsort(asked, kind="stable")
    asked, who = asked[order], who[order]
    low, high = np.searchsorted(asked, cells, "left"), np.searchsorted(asked, cells, "right")
    a, b, c = [], [], []
    for p, i, j in zip(np.split(own, at[1:]), low, high, strict=True):
        step = max(1, MATRIX // len(p))
        for lo in range(i, j, step):
            q = who[lo : min(j, lo + step)]
            s = x[q] @ x[p].T
            s[rep[q][:, None] == rep[p][None, :]] = -2
            if k is not None and s.shape[1] > k:
                top = np.argpartition(-s, k - 1, axis=1)[:, :k]
                s = np.take_along_axis(s, top, 1)
                r, t_ = np.nonzero(s >= max(least, -1.5))
                mate = p[top[r, t_]]
            else:
                r, t_ = np.nonzero(s >= max(least, -1.5))
                mate = p[t_]
            a.append(rep[q[r]])
            b.append(rep[mate])
            c.append(s[r, t_])
    if not a:
        return _PAIRS.empty_table()
    va, vb, vc = np.concatenate(a), np.concatenate(b), np.concatenate(c)
    if k is None:
        va, vb = np.minimum(va, vb), np.maximum(va, vb)
    order = np.lexsort((vb, -vc, va))
    va, vb, vc = va[order], vb[order], vc[order]
    if k is not None and len(va):  # the k best of each asker
        begin = np.flatnonzero(np.concatenate([[True], va[1:] != va[:-1]]))
        keep = np.arange(len(va)) - np.repeat(begin, np.diff(np.append(begin, len(va)))) < k
        va, vb, vc = va[keep], vb[keep], vc[keep]
    return pa.Table.from_arrays([pa.array(va), pa.array(vb), pa.array(vc, pa.float32())], schema=_PAIRS)


def candidates(reps: DataFrame, goal: Goal, k: int | None, least: float) -> DataFrame:
    """(vec_a, vec_b, cosine in half precision) among representatives (rep, space, dims, unit)."""
    spark = reps.sparkSession
    magnitude = reps.groupBy("space", "dims").agg(F.ceil(F.log2(F.count("*"))).cast("int").alias("magnitude"))
    orders = magnitude.groupBy("dims", "magnitude").agg(F.count("*").alias("spaces")).collect()  # at most some 40 orders of magnitude for each number of dimensions
    plans = {(r.dims, r.magnitude): planned(r.dims, r.magnitude, goal) for r in orders}
    few = sum(r.spaces for r in orders) <= MOST_SENT
    sized = reps.join(F.broadcast(magnitude) if few else magnitude, ["space", "dims"])  # few spaces are few keys, so no shuffle by them
    table = hashed(spread(sized), plans).persist(StorageLevel.MEMORY_AND_DISK)
    key = ["space", "tab", "region"]
    hot = table.groupBy(*key).agg(F.ceil(F.count("*") / goal.block).cast("int").alias("blocks")).where("blocks > 1")
    at = table.join(hot, key, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    mine = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    others = F.sequence(F.lit(0), F.col("blocks") - 1)
    one = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("role")))
    # owners of block i meet askers of block j; role 1 owns only, 2 asks only, 0 does both
    tiles = F.when(F.col("blocks") == 1, one).otherwise(
        F.concat(F.transform(others, lambda j: F.struct(mine.alias("i"), j.alias("j"), F.lit(1).alias("role"))), F.transform(others, lambda i: F.struct(i.alias("i"), mine.alias("j"), F.lit(2).alias("role"))))
    )
    placed = at.withColumn("t", F.explode(tiles)).select(*key, "t.i", "t.j", "t.role", "rep", "home", "cells", "half")
    ship(spark)

    def search(t: pa.Table) -> pa.Table:
        return search_region(t, k, least)

    found = placed.groupBy(*key, "i", "j").applyInArrow(search, "vec_a bigint, vec_b bigint, cosine float")
    return found.groupBy("vec_a", "vec_b").agg(F.max("cosine").alias("cosine"))


def exact(pairs: DataFrame, units: DataFrame) -> DataFrame:
    """Pairs (vec_a, vec_b, ...) with the cosine of their single-precision directions, a batch at a time."""
    a = units.select(F.col("rep").alias("vec_a"), F.col("unit").alias("__x"))
    b = units.select(F.col("rep").alias("vec_b"), F.col("unit").alias("__y"))

    @F.pandas_udf("double")
    def cosine(x: pd.Series, y: pd.Series) -> pd.Series:
        out = np.zeros(len(x))
        sizes = x.map(len).to_numpy()
        for n in np.unique(sizes):
            at = np.flatnonzero(sizes == n)
            u, v = (np.frombuffer(b"".join(s.iloc[at]), np.float32).reshape(len(at), -1).astype(np.float64) for s in (x, y))
            out[at] = (u * v).sum(axis=1)
        return pd.Series(out)

    return pairs.drop("cosine").join(a, "vec_a").join(b, "vec_b").withColumn("cosine", cosine("__x", "__y")).drop("__x", "__y")


def best(pairs: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("vec_a").orderBy(F.desc("cosine"), "vec_b")
    return pairs.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= k).drop("__n")


def classed(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Usable records (vec_id, space, dims, unit, rep, copies), and the representatives among them."""
    ship(records.sparkSession)
    rows = with_classes(unit_vectors(spread(usable(records)))).persist(StorageLevel.MEMORY_AND_DISK)
    return rows, rows.where("vec_id = rep").select("rep", "space", "dims", "unit")


def similar(records: DataFrame, k: int = 10, least: float = -1.0, goal: Goal = NEIGHBOURS) -> DataFrame:
    """(vec_a, vec_b, cosine): for each usable vector its k most similar others with a cosine of at least ``least``,
    higher cosine first, ties by id. Exact copies are nearest to each other; of a class of copies its first k + 1 ids stand for all, which
    gives each vector k partners of the same cosine."""
    rows, reps = classed(records)
    near = best(candidates(reps, goal, k, least - HALF), k + 4)
    pairs = best(exact(near, reps), k).where(F.col("cosine") >= least)
    first = Window.partitionBy("rep").orderBy("vec_id")
    heads = rows.select("rep", "vec_id", F.row_number().over(first).alias("__n")).where(F.col("__n") <= k + 1)  # cut before the shuffle, too
    same = rows.where("copies > 1 and vec_id = rep").select(F.col("rep").alias("vec_a"), F.col("rep").alias("vec_b"), F.lit(1.0).alias("cosine"))
    links = pairs.select("vec_a", "vec_b", "cosine").unionByName(same)
    a = rows.select(F.col("vec_id").alias("a"), F.col("rep").alias("vec_a"))
    b = heads.select(F.col("vec_id").alias("b"), F.col("rep").alias("vec_b"))
    whole = a.join(links, "vec_a").join(b, "vec_b").where("a != b")
    return best(whole.select(F.col("a").alias("vec_a"), F.col("b").alias("vec_b"), "cosine"), k)


def close_links(records: DataFrame, least: float = 0.95, goal: Goal | None = None) -> tuple[DataFrame, DataFrame]:
    """All pairs of directions (vec_a, vec_b, cosine; representatives, smaller id first) with a cosine of at least ``least``, however many
    a vector has, and the membership (vec_id, rep, copies) of all usable vectors. Copies are not expanded into pairs."""
    goal = goal or Goal(CLOSE.recall, least=least, block=CLOSE.block)
    rows, reps = classed(records)
    found = exact(candidates(reps, goal, None, least - HALF), reps).where(F.col("cosine") >= least)
    return found, rows.select("vec_id", "rep", "copies")


def close_pairs(records: DataFrame, least: float = 0.95, goal: Goal | None = None) -> DataFrame:
    """(vec_a, vec_b), smaller id first: all pairs with a cosine of at least ``least``, copies expanded."""
    links, members = close_links(records, least, goal)
    a = members.select(F.col("vec_id").alias("a"), F.col("rep").alias("vec_a"))
    b = members.select(F.col("vec_id").alias("b"), F.col("rep").alias("vec_b"))
    across = links.select("vec_a", "vec_b").join(a, "vec_a").join(b, "vec_b").select("a", "b")
    copies = members.where("copies > 1")
    within = copies.select(F.col("vec_id").alias("a"), "rep").join(copies.select(F.col("vec_id").alias("b"), "rep"), "rep").where("a < b").select("a", "b")
    return across.unionByName(within).select(F.least("a", "b").alias("vec_a"), F.greatest("a", "b").alias("vec_b"))


def linked(records: DataFrame, least: float = 0.95, goal: Goal | None = None) -> DataFrame:
    """(vec_id, rep, copies, links) of every usable vector: its class of exact copies and how many vectors outside the class are close to it.
    Copies are counted, not expanded."""
    links, members = close_links(records, least, goal)
    sizes = members.where("vec_id = rep").select("rep", "copies")
    both = links.select(F.col("vec_a").alias("rep"), F.col("vec_b").alias("other")).unionByName(links.select(F.col("vec_b").alias("rep"), F.col("vec_a").alias("other")))
    n = both.join(sizes.withColumnsRenamed({"rep": "other", "copies": "n"}), "other").groupBy("rep").agg(F.sum("n").alias("links"))
    return members.join(n, "rep", "left").select("vec_id", "rep", "copies", F.coalesce("links", F.lit(0)).alias("links"))


def nearest_exactly(records: DataFrame, wanted: str, k: int = 10, block: int = 4096) -> DataFrame:
    """(vec_a, vec_b, cosine): the k nearest of the vectors that the condition ``wanted`` (on vec_id) names, by comparing them with all vectors, in
    blocks; the measure for ``similar``."""
    ship(records.sparkSession)
    rows = unit_vectors(spread(usable(records))).persist(StorageLevel.MEMORY_AND_DISK)
    asks = rows.where(wanted)
    sizes = rows.groupBy("space").agg(F.ceil(F.count("*") / block).cast("int").alias("own")).join(asks.groupBy("space").agg(F.ceil(F.count("*") / block).cast("int").alias("ask")), "space")

    def placed(df: DataFrame, mine: str, other: str, role: int) -> DataFrame:
        at = df.join(sizes, "space").withColumn("x", F.pmod(F.xxhash64("vec_id"), F.col(mine)).cast("int")).withColumn("y", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        i, j = ("x", "y") if role == 1 else ("y", "x")
        return at.select("space", F.col(i).alias("i"), F.col(j).alias("j"), F.lit(role).alias("role"), "vec_id", "unit")

    def run(f: pd.DataFrame) -> pd.DataFrame:
        x = np.frombuffer(b"".join(f["unit"]), np.float32).reshape(len(f), -1).astype(np.float64)
        ids, role = f["vec_id"].to_numpy(), f["role"].to_numpy()
        own, ask = np.flatnonzero(role == 1), np.flatnonzero(role == 2)
        parts = [pd.DataFrame({"vec_a": pd.Series(dtype="int64"), "vec_b": pd.Series(dtype="int64"), "cosine": pd.Series(dtype="float64")})]
        y, names = x[own], ids[own]
        for i in ask.tolist() if len(own) else ():
            s = y @ x[i]
            s[names == ids[i]] = -2
            top = own[np.lexsort((names, -s))[: k + 1]]
            at = pd.DataFrame({"vec_a": ids[i], "vec_b": ids[top], "cosine": x[top] @ x[i]})
            parts.append(at[at.vec_b != at.vec_a].head(k))
        return pd.concat(parts)

    both = placed(rows, "own", "ask", 1).unionByName(placed(asks, "ask", "own", 2))
    return best(both.groupBy("space", "i", "j").applyInPandas(run, "vec_a bigint, vec_b bigint, cosine double"), k)


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """(wanted, found, recall): how many of the true neighbours are among those found, over all vectors of ``truth``."""
    hit = truth.join(found.select("vec_a", "vec_b", F.lit(1).alias("hit")), ["vec_a", "vec_b"], "left")
    return hit.agg(F.count("*").alias("wanted"), F.count("hit").alias("found")).withColumn("recall", F.col("found") / F.col("wanted"))
