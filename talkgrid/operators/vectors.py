"""Comparing call vectors with each other.

Vectors go to *cells*, each around one of about sqrt(n) pivots, and a cell knows the range of its members' distances to every pivot. The triangle
inequality then tells, without looking at members, how far two cells, or a vector and a cell, are apart at least. A search for
neighbours within a radius visits only the pairs of cells that may hold some; a search for the nearest one takes the best of the vector's own cell as
the radius. Nothing is missed. What is visited runs as many equal tasks: whole cells are packed into tiles, and cells larger than one are cut, so that a tile's size is bounded; each pair of
tiles that hold cells to visit is one task, which compares those cells only, in slices, and returns best matches, counts or a spanning set, never its pairs. A row travels once per
partner tile, so tiles grow with the table: there are about ``SIDES`` of them until they hold ``TILE`` rows. Equal vectors collapse first, with their number.

Pivots and ranges are at most ``PIVOTS`` vectors and ``PIVOTS`` squared numbers, whatever the number of vectors. Only where all pairs are
counted (``pair_similarity_counts``) is every tile compared with every tile.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.ordered import first_k, hash_rank, quantiles
from ..session import checkpoint_dir

BLOCK = 2048
#: Tiles of a table that is large enough, and the rows at which tiles stop growing (more tiles then).
SIDES, TILE = 24, 16_384
#: Pairs whose products are held at once.
PAIRS = 1 << 21


def _kind(calls: DataFrame) -> str:
    """The SQL type of the caller's ids."""
    return calls.schema["call_id"].dataType.simpleString()


def _nearest(key: str) -> Column:
    """Aggregate: the smallest ``key`` among the rows of the largest similarity."""
    return F.min_by(key, F.struct(-F.col("similarity"), F.col(key)))


def _stack(v: pd.Series) -> np.ndarray:
    return np.stack(v.to_numpy()).astype(np.float64, copy=False)


def tile_rows(n: int, rows: int) -> int:
    """Rows of a tile of a table of ``n``: ``rows`` at least."""
    return max(1, rows, min(TILE, -(-n // SIDES)))


def _slices(rows: np.ndarray, wide: int):
    """``rows`` in runs whose products with ``wide`` others are at most ``PAIRS``."""
    step = max(1, PAIRS // max(1, wide))
    for i in range(0, len(rows), step):
        yield rows[i:i + step]


def in_blocks(df: DataFrame, id_col: str, keys: Sequence[str] = (), rows: int = BLOCK) -> DataFrame:
    """Adds ``blk``: exact, balanced blocks of at most ``rows`` per key."""
    d = df.withColumn("__all", F.lit(1)) if not keys else df
    k = list(keys) or ["__all"]
    r = hash_rank(d, k, id_col, 0, rank="__r", total="__n")
    return r.withColumn("blk", F.floor((F.col("__r") - 1) / rows)).drop("__r", "__n", "__all")


def block_pairs(left: DataFrame, right: DataFrame, keys: Sequence[str], near: DataFrame | None, kernel: Callable, schema: str) -> DataFrame:
    """``kernel(left_rows, right_rows) -> frame`` on every pair of blocks that share ``keys``.

    ``near(lb, rb)`` narrows which blocks meet. Both sides hold ``blk``; a row travels once per
    partner block.
    """
    keys = list(keys)
    lb = left.select(*keys, F.col("blk").alias("lb")).distinct()
    rb = right.select(*keys, F.col("blk").alias("rb")).distinct()
    if near is None:
        near = lb.join(rb, keys)
    fresh = lambda d: d.select(*[F.col(c).alias(c) for c in d.columns])  # noqa: E731 - own column ids on each side
    l = fresh(left.withColumnRenamed("blk", "lb").join(near, keys + ["lb"]))
    r = fresh(right.withColumnRenamed("blk", "rb").join(near, keys + ["rb"]))
    by = [*keys, "lb", "rb"]

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return kernel(a, b)

    return l.groupBy(*by).cogroup(r.groupBy(*by)).applyInPandas(run, schema)


# ------------------------------------------------------------------------------ cells

#: At most so many cells; a pivot is one vector.
PIVOTS = 512
#: What rounding may add to a distance.
SLACK = 1e-9


def pivots_of(vectors: DataFrame, most: int = PIVOTS) -> np.ndarray:
    """About sqrt(n) of the vectors, the first by a hash, so that reruns agree."""
    v = vectors.select("vec").distinct()
    m = max(1, min(most, math.isqrt(v.count())))
    return np.array([r.vec for r in v.orderBy(F.xxhash64("vec"), "vec").limit(m).collect()], np.float64)


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :] - 2 * (x @ pivots.T), 0))


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def in_cells(df: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Adds ``cell``, the number of the nearest pivot."""
    names = df.columns

    def run(batches):
        for b in batches:
            if b.num_rows:
                d = _distances(_vectors(b.column(names.index("vec"))), pivots)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(d.argmin(1).astype(np.int32))], names=[*names, "cell"])

    return df.mapInArrow(run, df.withColumn("cell", F.lit(0)).schema)


def cell_ranges(celled: DataFrame, pivots: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Per cell in use the smallest and largest distance of its members to every pivot; at most ``PIVOTS`` rows come to the driver."""
    m = len(pivots)

    def run(batches):
        low, high = np.full((m, m), np.inf), np.full((m, m), -np.inf)
        for b in batches:
            if b.num_rows:
                cell, d = b.column(0).to_numpy(), _distances(_vectors(b.column(1)), pivots)
                np.minimum.at(low, cell, d)
                np.maximum.at(high, cell, d)
        for c in np.flatnonzero(np.isfinite(low[:, 0])):
            yield pa.RecordBatch.from_pydict({"cell": pa.array([c], pa.int32()), "low": [low[c].tolist()], "high": [high[c].tolist()]})

    parts = celled.select("cell", F.col("vec").cast("array<double>").alias("vec")).mapInArrow(run, "cell int, low array<double>, high array<double>")
    each = parts.select("cell", F.posexplode(F.arrays_zip("low", "high")).alias("p", "d")).groupBy("cell", "p").agg(F.min("d.low").alias("low"), F.max("d.high").alias("high"))
    rows = each.groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("p", "low", "high"))).alias("r")).collect()
    return {r.cell: (np.array([x.low for x in r.r]), np.array([x.high for x in r.r])) for r in rows}


def cells_within(a: dict, b: dict, radius: float) -> list[tuple[int, int]]:
    """Pairs of cells that may hold vectors at most ``radius`` apart."""
    if not a or not b:
        return []
    ids = np.array(sorted(b))
    low, high = np.stack([b[c][0] for c in ids]), np.stack([b[c][1] for c in ids])
    out = []
    for c, (lo, hi) in sorted(a.items()):
        gap = np.maximum(lo[None, :] - high, low - hi[None, :]).max(1)
        out += [(c, int(o)) for o in ids[gap <= radius + SLACK]]
    return out


class Tiles:
    """Cells packed into tiles of about ``rows`` rows in order of their numbers; a larger cell has tiles of its own. At most ``PIVOTS`` numbers come to the driver."""

    def __init__(self, celled: DataFrame, rows: int):
        counts = sorted((r.cell, r.n) for r in celled.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect())
        size = tile_rows(sum(n for _, n in counts), rows)
        self.of, at, held = {}, 0, 0  # cell -> its first tile, their number
        for cell, n in counts:
            if held and held + n > size:
                at, held = at + 1, 0
            parts = -(-n // size)
            self.of[cell] = (at, parts)
            at, held = (at, held + n) if parts == 1 else (at + parts, 0)
        self.number = 1 + max((t + p - 1 for t, p in self.of.values()), default=0)

    def added(self, celled: DataFrame) -> DataFrame:
        """``celled`` with ``blk``, the tile of each row."""
        names = celled.sparkSession.createDataFrame([(c, t, p) for c, (t, p) in self.of.items()], "cell int, __t int, __p int")
        part = F.pmod(F.xxhash64(*celled.columns), F.col("__p"))
        return celled.join(F.broadcast(names), "cell").withColumn("blk", F.col("__t") + part.cast("int")).drop("__t", "__p").select(*celled.columns, "blk")

    def holding(self, cells) -> list[int]:
        return sorted({t + i for c in cells for t, p in [self.of[c]] for i in range(p)})


def _tiles_within(left: Tiles, right: Tiles, pairs: list[tuple[int, int]], spark, once: bool = False) -> DataFrame:
    """Pairs of tiles ``(lb, rb)`` that hold a pair of cells of ``pairs``; ``once`` where both sides are the same."""
    partners: dict[int, set[int]] = {}
    for a, b in pairs:
        partners.setdefault(a, set()).add(b)
    near = {(lb, rb) for a, some in partners.items() for rb in right.holding(some) for lb in left.holding([a])}
    return spark.createDataFrame(sorted({(min(p), max(p)) for p in near} if once else near), "lb int, rb int")


def _allowed(pairs: list[tuple[int, int]], m: int) -> np.ndarray:
    """``[a, b]``: whether cells ``a`` and ``b`` are to be compared."""
    out = np.zeros((m, m), bool)
    if pairs:
        out[tuple(np.array(pairs).T)] = True
    return out


def _products(x: np.ndarray, cells: np.ndarray, z: np.ndarray, others: np.ndarray, allowed: np.ndarray):
    """``(rows, columns, products)`` of the cells that are to be compared, in slices."""
    for c in np.unique(cells):
        columns = np.flatnonzero(allowed[c, others])
        if len(columns):
            part = z[columns].T
            for rows in _slices(np.flatnonzero(cells == c), len(columns)):
                yield rows, columns, x[rows] @ part


def _blocks_within(left: DataFrame, right: DataFrame, pairs: list[tuple[int, int]]) -> DataFrame:
    """Pairs of blocks ``(lb, rb)`` of cells that may match; blocks are named ``cell/number``."""
    near = left.sparkSession.createDataFrame(pairs, "a int, b int")
    lb, rb = left.select(F.col("cell").alias("a"), F.col("blk").alias("lb")).distinct(), right.select(F.col("cell").alias("b"), F.col("blk").alias("rb")).distinct()
    return lb.join(near, "a").join(rb, "b").select("lb", "rb").distinct()


def _named_blocks(celled: DataFrame, rows: int) -> DataFrame:
    return in_blocks(celled, "call_id", ["cell"], rows).withColumn("blk", F.concat_ws("/", "cell", "blk"))


def compared_share(left: DataFrame, right: DataFrame, near: DataFrame) -> float:
    """Which share of all pairs of ``left`` and ``right`` (with ``blk``) a plan ``near(lb, rb)`` compares."""
    l, r = left.groupBy(F.col("blk").alias("lb")).agg(F.count(F.lit(1)).alias("l")), right.groupBy(F.col("blk").alias("rb")).agg(F.count(F.lit(1)).alias("r"))
    met = near.join(l, "lb").join(r, "rb").agg(F.sum(F.col("l") * F.col("r"))).first()[0] or 0
    return met / max(1, left.count() * right.count())


# ------------------------------------------------------------------------------ nearest neighbour

def _best_match(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
    """The best of the points ``b`` for each of ``a``, among the cells that the bits of ``visits`` name. A point stands for ``call_id`` and ``other``, its two smallest ids."""
    if a.empty or b.empty:
        return pd.DataFrame({c: [] for c in ("call_id", "y", "neighbour", "similarity")})
    b = b.sort_values("call_id")
    x, z, mine, ids, others, cell = _stack(a["vec"]), _stack(b["vec"]), a["call_id"].to_numpy(), b["call_id"].to_numpy(), b["other"].to_numpy(), b["cell"].to_numpy()
    visits = np.unpackbits(np.frombuffer(b"".join(a["visits"]), np.uint8).reshape(len(a), -1), axis=1).astype(bool)
    alone = np.isin(ids, mine) & (ids == others)  # of these a query must not meet itself
    best, at = np.full(len(a), -np.inf), np.zeros(len(a), np.int64)
    for c in np.unique(cell):
        columns, asking = np.flatnonzero(cell == c), np.flatnonzero(visits[:, c])
        own, part = np.flatnonzero(alone[columns]), z[columns].T
        for rows in _slices(asking, len(columns)):
            s = x[rows] @ part
            if len(own):
                s[:, own] = np.where(mine[rows][:, None] == ids[columns[own]][None, :], -np.inf, s[:, own])
            k = s.argmax(axis=1)
            top = s[np.arange(len(rows)), k]
            k = columns[k]
            better = (top > best[rows]) | ((top == best[rows]) & (k < at[rows]))
            best[rows[better]], at[rows[better]] = top[better], k[better]
    found = np.isfinite(best)
    mine, at = mine[found], at[found]
    return pd.DataFrame({"call_id": mine, "y": a["y"].to_numpy()[found], "neighbour": np.where(ids[at] == mine, others[at], ids[at]), "similarity": best[found]})


def _visits(queries: DataFrame, pivots: np.ndarray, ranges: dict) -> DataFrame:
    """``queries(.., cell, similarity)`` with ``visits``: a bit for each further cell that may hold a vector at least as near."""
    ids = np.array(sorted(ranges))
    low, high = (np.stack([ranges[c][i] for c in ids]) for i in (0, 1))
    names = queries.columns

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            d = _distances(_vectors(b.column(names.index("vec"))), pivots)
            best = b.column(names.index("similarity")).to_numpy(zero_copy_only=False)
            reach = np.where(np.isnan(best), np.inf, np.sqrt(np.maximum(2 - 2 * best, 0))) + SLACK
            own = b.column(names.index("cell")).to_numpy()
            wanted = np.zeros((b.num_rows, len(pivots)), bool)
            for i in range(b.num_rows):
                gap = np.maximum(low - d[i], d[i] - high).max(1)
                wanted[i, ids[(gap <= reach[i]) & (ids != own[i])]] = True
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([r.tobytes() for r in np.packbits(wanted, axis=1)], pa.binary())], names=[*names, "visits"])

    return queries.mapInArrow(run, queries.withColumn("visits", F.lit(b"")).schema)


def _tiles_visited(queries: DataFrame, right: Tiles) -> DataFrame:
    """Pairs of tiles ``(lb, rb)`` where a query of ``queries(blk, visits)`` visits a cell of tile ``rb``."""
    of = right.of

    def run(batches):
        seen: dict[int, np.ndarray] = {}
        for b in batches:
            if b.num_rows:
                tile = b.column(0).to_numpy()
                bits = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(b.num_rows, -1)
                for t in np.unique(tile).tolist():
                    any_ = np.bitwise_or.reduce(bits[tile == t], axis=0)
                    seen[t] = any_ if t not in seen else seen[t] | any_
        for t, any_ in seen.items():
            met = sorted({k + i for c in np.flatnonzero(np.unpackbits(any_)).tolist() if c in of for k, p in [of[c]] for i in range(p)})
            yield pa.RecordBatch.from_arrays([pa.array([t] * len(met), pa.int32()), pa.array(met, pa.int32())], names=["lb", "rb"])

    return queries.select("blk", "visits").mapInArrow(run, "lb int, rb int").distinct()


def _best_of_tiles(queries: DataFrame, points: DataFrame, right: Tiles, schema: str) -> DataFrame:
    """The best of ``points`` of the same class in the cells that each of ``queries`` visits."""
    near = _tiles_visited(queries, right).join(points.select("y", F.col("blk").alias("rb")).distinct(), "rb").select("y", "lb", "rb")
    return block_pairs(queries, points, ["y"], near, _best_match, schema)


def nearest_of_class(queries: DataFrame, points: DataFrame, rows: int = BLOCK) -> DataFrame:
    """The nearest of ``points`` of the same class but itself, by cosine, for each of ``queries``; both ``(call_id, y, vec)`` with unit vectors.

    The best of the query's own cell bounds the distance; further cells are visited only where the triangle inequality allows them. Of equal points of a class
    the two smallest ids are kept, which is all that a search for others can return. ``rows`` is the least size of a tile.
    """
    schema = f"call_id {_kind(queries)}, y int, neighbour {_kind(points)}, similarity double"
    double = lambda d: d.select("call_id", F.col("y").cast("int").alias("y"), F.col("vec").cast("array<double>").alias("vec"))
    p = first_k(double(points), ["y", "vec"], [F.col("call_id")], 2).groupBy("y", "vec").agg(F.min("call_id").alias("call_id"), F.max("call_id").alias("other"))
    pivots = pivots_of(p)
    checkpoint_dir(points.sparkSession)
    p = in_cells(p, pivots).checkpoint()
    q = in_cells(double(queries), pivots).checkpoint()
    ranges = cell_ranges(p, pivots)
    if not ranges:
        return queries.sparkSession.createDataFrame([], schema)
    right, width = Tiles(p, rows), -(-len(pivots) // 8)
    p, q = right.added(p), Tiles(q, rows).added(q)

    def own_cell(batches):
        for b in batches:
            if b.num_rows:
                bits = np.zeros((b.num_rows, 8 * width), bool)
                bits[np.arange(b.num_rows), b.column(b.schema.names.index("cell")).to_numpy()] = True
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([r.tobytes() for r in np.packbits(bits, axis=1)], pa.binary())], names=[*b.schema.names, "visits"])

    first = q.mapInArrow(own_cell, q.withColumn("visits", F.lit(b"")).schema)
    own = _best_of_tiles(first, p, right, schema)
    own = own.groupBy("call_id", "y").agg(_nearest("neighbour").alias("neighbour"), F.max("similarity").alias("similarity")).checkpoint()
    asked = q.join(own.select("call_id", "y", "similarity"), ["call_id", "y"], "left")
    far = _best_of_tiles(_visits(asked, pivots, ranges).drop("similarity").checkpoint(), p, right, schema)
    return own.unionByName(far).groupBy("call_id", "y").agg(_nearest("neighbour").alias("neighbour"), F.max("similarity").alias("similarity"))


def nearest_train_neighbour(calls: DataFrame, rows: int = BLOCK) -> DataFrame:
    """Nearest training call of the same class for every validation call, by cosine: ``calls(call_id, y, split, vec)``."""
    return nearest_of_class(calls.where("split = 'val'"), calls.where("split = 'train'"), rows)


def neighbour_summary(calls: DataFrame, rows: int = BLOCK) -> DataFrame:
    """Per class: median, least and largest similarity of validation calls to their nearest training call, and the median of training calls to each other."""
    val = nearest_train_neighbour(calls, rows).select("y", F.lit("val").alias("side"), "similarity")
    train = calls.where("split = 'train'")
    both = val.unionByName(nearest_of_class(train, train, rows).select("y", F.lit("train").alias("side"), "similarity"))
    ends = both.groupBy("y").agg(F.count_if(F.col("side") == "val").alias("n"), *[f(F.when(F.col("side") == "val", F.col("similarity"))).alias(n) for n, f in (("least", F.min), ("largest", F.max))])
    mid = quantiles(both, ["y", "side"], "similarity", {"m": .5})
    pick = lambda s: F.max(F.when(F.col("side") == s, F.col("m")))
    return ends.join(mid.groupBy("y").agg(pick("val").alias("median_similarity"), pick("train").alias("train_median")), "y")


# ------------------------------------------------------------------------------ pair similarities

def pair_similarity_counts(calls: DataFrame, label: str = "y", digits: int = 4, rows: int = BLOCK) -> DataFrame:
    """How many call pairs of each pair of labels have each cosine, to ``digits``: ``calls(call_id, label, vec)``."""
    d = calls.groupBy(F.col(label).cast("string").alias("label"), "vec").agg(F.count(F.lit(1)).alias("n"), F.min("call_id").alias("call_id"))
    checkpoint_dir(calls.sparkSession)
    d = d.checkpoint()
    b = in_blocks(d, "call_id", (), tile_rows(d.count(), rows))
    # blocks are numbered without gaps, so each names its partners
    last = F.max("blk").over(W.partitionBy(F.lit(1)))
    near = b.select("blk").distinct().select("blk", last.alias("last")).select(F.col("blk").alias("lb"), F.explode(F.sequence("blk", "last")).alias("rb"))
    scale = 10 ** digits

    def counted(sims: np.ndarray, w: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Values and how often they occur."""
        lo = int(sims.min())
        if int(sims.max()) - lo < PAIRS:
            n = np.bincount(sims - lo, weights=w)
            u = np.flatnonzero(n)
            return u + lo, n[u]
        u, inv = np.unique(sims, return_inverse=True)
        return u, np.bincount(inv, weights=w)

    def kernel(x, z):
        if x.empty or z.empty:
            return pd.DataFrame({"pair": pd.Series(dtype=str), "sim": pd.Series(dtype=float), "n": pd.Series(dtype="int64")})
        same = x["lb"].iloc[0] == z["rb"].iloc[0]
        x = x.sort_values(["label", "call_id"])
        z = x if same else z.sort_values(["label", "call_id"])
        of = lambda d: [(y, np.flatnonzero((d["label"] == y).to_numpy())) for y in d["label"].dropna().unique()]
        left, right, ln, rn = _stack(x["vec"]), _stack(z["vec"]), x["n"].to_numpy(np.int64), z["n"].to_numpy(np.int64)
        single = (ln == 1).all() and (rn == 1).all()
        found: dict[str, list] = {}
        for ya, all_rows in of(x):
            for yb, columns in of(z):
                part = right[columns].T
                for rows_ in _slices(all_rows, len(columns)):
                    s = np.rint(left[rows_] @ part * scale).astype(np.int64)
                    w = None if single else np.outer(ln[rows_], rn[columns])
                    if same:  # each pair appears twice within a block; n equal vectors make n(n-1)/2 pairs
                        keep = rows_[:, None] < columns[None, :]
                        if not single:
                            own = rows_[:, None] == columns[None, :]
                            w[own] = (w[own] - ln[rows_[own.any(1)]]) // 2
                            keep |= own & (w > 0)
                        s, w = s[keep], None if single else w[keep]
                    if s.size:
                        found.setdefault("|".join(sorted((ya, yb))), []).append(counted(s.ravel(), None if w is None else w.ravel()))
        out = [pd.DataFrame({"pair": pd.Series(dtype=str), "sim": pd.Series(dtype=float), "n": pd.Series(dtype="int64")})]
        for pair, parts in found.items():
            u, n = counted(*(np.concatenate(c) for c in zip(*parts)))
            out.append(pd.DataFrame({"pair": pair, "sim": u / scale, "n": n.astype(np.int64)}))
        return pd.concat(out[1:] or out)

    p = block_pairs(b, b, (), near, kernel, "pair string, sim double, n bigint")
    return p.groupBy("pair", "sim").agg(F.sum("n").alias("n"))


def pair_similarity_medians(counts: DataFrame) -> DataFrame:
    from ..functions.ordered import cumulative, interpolated
    c = cumulative(counts, ["pair"], "sim", {"n": F.sum("n")})
    return c.groupBy("pair").agg(interpolated(.5, "sim").alias("median"), F.sum("n").alias("pairs"))


def pair_similarity_histogram(counts: DataFrame, bins: int = 50, lo: float = -0.2, hi: float = 1.0) -> DataFrame:
    b = F.floor((F.col("sim") - lo) / (hi - lo) * bins)
    return counts.where(F.col("sim").between(lo, hi)).groupBy("pair", F.least(b, F.lit(bins - 1)).cast("int").alias("bin")).agg(F.sum("n").alias("n"))


# ------------------------------------------------------------------------------ near duplicates

def near_duplicates(calls: DataFrame, threshold: float = 0.995, rows: int = BLOCK) -> DataFrame:
    """Validation calls (equal vectors once, with their number) that have training calls above ``threshold``:
    the nearest one and how many call pairs that makes.

    Two unit vectors that close are at most ``sqrt(2 - 2 threshold)`` apart: pairs of cells that are further apart are never compared, and nothing is missed.
    """
    radius = math.sqrt(max(0.0, 2 - 2 * threshold))
    d = calls.groupBy("split", F.col("vec").cast("array<double>").alias("vec")).agg(F.count(F.lit(1)).alias("n"), F.min("call_id").alias("call_id"))
    pivots = pivots_of(d)
    checkpoint_dir(calls.sparkSession)
    sides = [in_cells(d.where(F.col("split") == s).drop("split"), pivots).checkpoint() for s in ("val", "train")]
    pairs = cells_within(*[cell_ranges(x, pivots) for x in sides], radius)
    tiles, allowed = [Tiles(x, rows) for x in sides], _allowed(pairs, len(pivots))
    l, r = (t.added(x) for t, x in zip(tiles, sides))
    near = _tiles_within(*tiles, pairs, calls.sparkSession)

    def kernel(a, b):
        if a.empty or b.empty:
            return pd.DataFrame({"val_id": [], "train_id": [], "similarity": [], "n_pairs": []})
        b = b.sort_values("call_id")
        n, best, at, hits = b["n"].to_numpy(np.int64), np.full(len(a), -np.inf), np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
        for i, j, s in _products(_stack(a["vec"]), a["cell"].to_numpy(), _stack(b["vec"]), b["cell"].to_numpy(), allowed):
            k = s.argmax(axis=1)
            best[i], at[i], hits[i] = s[np.arange(len(i)), k], j[k], (s > threshold) @ n[j]
        out = pd.DataFrame({"val_id": a["call_id"], "train_id": b["call_id"].to_numpy()[at], "similarity": best, "n_pairs": hits * a["n"].to_numpy(np.int64)})
        return out[out["n_pairs"] > 0]

    m = block_pairs(l, r, (), near, kernel, f"val_id {_kind(calls)}, train_id {_kind(calls)}, similarity double, n_pairs bigint")
    return m.groupBy("val_id").agg(_nearest("train_id").alias("train_id"),
                                   F.max("similarity").alias("similarity"), F.sum("n_pairs").alias("n_pairs"))


# ------------------------------------------------------------------------------ clusters by threshold

def similarity_edges(calls: DataFrame, threshold: float, rows: int = BLOCK) -> DataFrame:
    """Enough edges to connect whatever cosine ``threshold`` connects: each pair of tiles returns its components as stars."""
    d = calls.groupBy(F.col("vec").cast("array<double>").alias("vec")).agg(F.min("call_id").alias("call_id"))
    pivots = pivots_of(d)
    checkpoint_dir(calls.sparkSession)
    celled = in_cells(d, pivots).checkpoint()
    ranges = cell_ranges(celled, pivots)
    pairs = cells_within(ranges, ranges, math.sqrt(max(0.0, 2 - 2 * threshold)))
    tiles, allowed = Tiles(celled, rows), _allowed(pairs, len(pivots))
    b = tiles.added(celled)
    near = _tiles_within(tiles, tiles, pairs, calls.sparkSession, once=True)

    def kernel(x, z):
        if x.empty or z.empty:
            return pd.DataFrame({"a": [], "b": []})
        ids, place = np.unique(np.concatenate((x["call_id"].to_numpy(), z["call_id"].to_numpy())), return_inverse=True)
        left, right, label = place[:len(x)], place[len(x):], np.arange(len(ids))
        for i, j, s in _products(_stack(x["vec"]), x["cell"].to_numpy(), _stack(z["vec"]), z["cell"].to_numpy(), allowed):
            r, c = np.nonzero(s >= threshold)
            label = _united(label, left[i[r]], right[j[c]])
        hung = np.flatnonzero(label != np.arange(len(ids)))
        return pd.DataFrame({"a": ids[hung], "b": ids[label[hung]]})

    e = block_pairs(b, b, (), near, kernel, f"a {_kind(calls)}, b {_kind(calls)}")
    # equal vectors collapsed above: tie each call to the one that stands for it
    same = calls.withColumn("vec", F.col("vec").cast("array<double>")).join(d.withColumnRenamed("call_id", "a"), "vec").select("a", F.col("call_id").alias("b")).where("a <> b")
    return e.unionByName(same)


def _united(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``label`` (the least place that each place is connected with) after the pairs ``(a, b)`` of places are connected too."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            nxt = label[label]
            if (nxt == label).all():
                break
            label = nxt


def connected_components(nodes: DataFrame, edges: DataFrame, id_col: str = "call_id") -> DataFrame:
    """``(id, cluster)`` with the least member as the cluster's name, by alternating star contraction.

    Every round is written to the checkpoint folder, so a lost executor costs one round.
    """
    spark = nodes.sparkSession
    checkpoint_dir(spark)
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct().checkpoint()
    while True:
        # large star: every neighbour above a node hangs on the least of its neighbourhood
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(m, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: the smaller neighbours of a node and the node itself hang on their least
        m2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(m2, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(m2.select("u", F.col("m").alias("v")))
        nxt = small.where("u <> v").distinct().checkpoint()
        changed = nxt.exceptAll(e).unionByName(e.exceptAll(nxt)).limit(1).count()
        e = nxt
        if not changed:
            break
    return nodes.select(F.col(id_col)).join(e.select(F.col("u").alias(id_col), F.col("v").alias("cluster")), id_col, "left").select(
        id_col, F.coalesce("cluster", F.col(id_col)).alias("cluster"))


def describe_clusters(clusters: DataFrame, calls: DataFrame) -> DataFrame:
    """Sizes, singletons, clusters in both splits and the validation calls they expose."""
    per = clusters.join(calls.select("call_id", "split"), "call_id").groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("split") == "train").alias("train"), F.count_if(F.col("split") == "val").alias("val"))
    shared = (F.col("train") > 0) & (F.col("val") > 0)
    return per.agg(F.count(F.lit(1)).alias("n_clusters"), F.count_if(F.col("n") == 1).alias("n_singletons"), F.max("n").alias("largest"),
                   F.count_if(shared).alias("shared_clusters"), F.coalesce(F.sum(F.when(shared, F.col("val"))), F.lit(0)).alias("exposed_val"),
                   F.sum("val").alias("val_total"))
