"""Ordered aggregates that survive a hot key.

A plain window over a key sorts the whole key in one task. The helpers here cut
each key into blocks along its order, aggregate every block (with map-side
combine), run the window over the small block table only, and add what each block
carries in to a window local to the block. A key holding a third of all rows is
then spread over as many tasks as it has blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

BLK = "__blk"


def value_block(value: Column, bits: int = 14) -> Column:
    """Monotone block number of a double: ``2**bits`` blocks per power of two, nothing to sample; infinities have blocks of their own."""
    a = F.abs(value.cast("double"))
    finite = F.when(a < float("inf"), a)
    e = F.floor(F.log2(finite))
    steps = 1 << bits
    b = (e + F.lit(1100)) * F.lit(steps) + F.floor((finite / F.pow(F.lit(2.0), e.cast("double")) - 1) * steps)
    ends = F.lit(2200 * steps).cast("bigint")  # beyond the block of any finite value
    return (F.when(a == 0, F.lit(0).cast("bigint")).when(value == float("inf"), ends).when(value == float("-inf"), -ends)
            .when(value > 0, b).otherwise(-b))


_FOLD = {"sum": F.sum, "sum<": F.sum, "max": F.max, "min": F.min, "total": F.sum, "total_max": F.max,
         "last": lambda c: F.last(c, ignorenulls=True)}


def scan(df: DataFrame, keys: Sequence[str], block: Column, order: Sequence[str],
         specs: dict[str, tuple[str, str]], inclusive: bool = True) -> DataFrame:
    """Add running aggregates per ``keys`` in ``order``.

    ``block`` must grow with ``order``. ``specs`` maps an output name to ``(op, column)``:
    ``sum``, ``max``, ``min``, ``last`` (last non-null) run up to the row (or to the one
    before it when not ``inclusive``), ``sum<`` always up to the one before it;
    ``total`` and ``total_max`` cover the whole key.
    """
    keys = list(keys)
    bk = keys + [BLK]
    d = df.withColumn(BLK, block)
    stamp = F.struct(*[F.col(c) for c in order])

    def block_total(op, c):
        if op == "last":
            return F.max_by(F.col(c), F.when(F.col(c).isNotNull(), stamp))
        return _FOLD[op](F.col(c))

    before = W.partitionBy(*keys).orderBy(BLK).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*keys)
    totals = d.groupBy(*bk).agg(*[block_total(op, c).alias(f"__t_{o}") for o, (op, c) in specs.items()])
    carry = totals.select(*bk, *[
        _FOLD[op](F.col(f"__t_{o}")).over(whole if op.startswith("total") else before).alias(f"__c_{o}")
        for o, (op, _) in specs.items()])
    w = W.partitionBy(*bk).orderBy(*order)
    local = lambda op: w.rowsBetween(W.unboundedPreceding, 0 if inclusive and op != "sum<" else -1)
    running = {o: s for o, s in specs.items() if not s[0].startswith("total")}
    out = d.withColumns({f"__l_{o}": _FOLD[op](F.col(c)).over(local(op)) for o, (op, c) in running.items()})
    out = out.join(carry, bk)
    cols = {}
    for o, (op, _) in specs.items():
        l, c = F.col(f"__l_{o}"), F.col(f"__c_{o}")
        if op.startswith("total"):
            cols[o] = c
        elif op.startswith("sum"):
            cols[o] = F.coalesce(l, F.lit(0)) + F.coalesce(c, F.lit(0))
        elif op == "max":
            cols[o] = F.greatest(l, c)
        elif op == "min":
            cols[o] = F.least(l, c)
        else:
            cols[o] = F.coalesce(l, c)
    return out.select(*[F.col(x) for x in df.columns], *[v.alias(o) for o, v in cols.items()])


def numbered(df: DataFrame, keys: Sequence[str], block: Column, order: Sequence[str], out: str, hot: int = 1 << 16) -> DataFrame:
    """Add the row number per ``keys`` in ``order``, the :func:`scan` of ones: a row without key is left out, one without block counts before the others and is left out.

    Ordinary keys are numbered by one window. Only keys of more than ``hot`` rows, of which a table holds at most one in ``hot`` rows, take the blocks of :func:`scan`.
    """
    keys = list(keys)
    d = df.where(" and ".join(f"`{k}` is not null" for k in keys)).withColumn(BLK, block)
    many = F.broadcast(d.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows")).where(F.col("__rows") > hot).select(*keys))
    plain = d.join(many, keys, "left_anti").withColumn(out, F.row_number().over(W.partitionBy(*keys).orderBy(BLK, *order)).cast("bigint"))
    plain = plain.where(F.col(BLK).isNotNull()).select(*df.columns, out)
    long = d.join(many, keys, "left_semi").select(*df.columns, F.lit(1).alias("__one"))
    return plain.unionByName(scan(long, keys, block, order, {out: ("sum", "__one")}).drop("__one"))


def cumulative(df: DataFrame, keys: Sequence[str], value: str, measures: dict[str, Column],
               bits: int = 14) -> DataFrame:
    """One row per distinct ``value`` with its measures, what lies below it (``cum_*``) and the key total (``tot_*``).

    Ties collapse before anything is ordered, so a score shared by a third of the rows costs one row. NULL and NaN are missing.
    """
    known = F.col(value).isNotNull() & ~F.coalesce(F.isnan(F.col(value).cast("double")), F.lit(False))
    d = (df.where(known).groupBy(*keys, value)
         .agg(*[m.alias(n) for n, m in measures.items()]))
    specs = {f"cum_{n}": ("sum", n) for n in measures} | {f"tot_{n}": ("total", n) for n in measures}
    return scan(d, keys, value_block(F.col(value), bits), [value], specs, inclusive=False)


def per_key(df: DataFrame, keys: Sequence[str], value: str, measures: dict[str, Column], aggregates: dict[str, Column], hot: int = 1 << 16) -> DataFrame:
    """``aggregates`` per ``keys`` over the :func:`cumulative` table. Ordinary keys are dealt once and ordered by one window; only keys of more than ``hot`` rows take blocks."""
    keys = list(keys)
    d = df.where(" and ".join(f"`{k}` is not null" for k in keys))
    many = F.broadcast(d.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows")).where(F.col("__rows") > hot).select(*keys))
    known = F.col(value).isNotNull() & ~F.coalesce(F.isnan(F.col(value).cast("double")), F.lit(False))
    plain = d.join(many, keys, "left_anti").where(known).repartition(*keys).groupBy(*keys, value).agg(*[m.alias(n) for n, m in measures.items()])
    w = W.partitionBy(*keys)
    before = w.orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    plain = plain.withColumns({f"cum_{n}": F.coalesce(F.sum(n).over(before), F.lit(0)) for n in measures} | {f"tot_{n}": F.sum(n).over(w.orderBy(value).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)) for n in measures})
    long = cumulative(d.join(many, keys, "left_semi"), keys, value, measures)
    named = [a.alias(n) for n, a in aggregates.items()]
    return plain.groupBy(*keys).agg(*named).unionByName(long.groupBy(*keys).agg(*named))


def at_position(pos: Column, value: str, n: str = "n", cum: str = "cum_n") -> Column:
    """Aggregate: the value holding 0-based sorted position ``pos`` of a :func:`cumulative` table."""
    return F.max(F.when((F.col(cum) <= pos) & (pos < F.col(cum) + F.col(n)), F.col(value)))


def interpolated(p: float | Column, value: str, n: str = "n", cum: str = "cum_n", tot: str = "tot_n") -> Column:
    """Aggregate: the linearly interpolated quantile of a :func:`cumulative` table."""
    last = F.col(tot) - 1
    pos = last * (F.lit(p) if not isinstance(p, Column) else p)
    lo = F.floor(pos)
    v_lo = at_position(lo, value, n, cum)
    v_hi = at_position(F.least(lo + 1, last), value, n, cum)
    part = F.max(pos - lo)
    return F.when((part == 0) | (v_lo == v_hi), v_lo).otherwise(v_lo + (v_hi - v_lo) * part)  # infinities too


def quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Exact interpolated quantiles per ``keys``; no group is ever held in one task."""
    c = cumulative(df, keys, value, {"n": F.count(F.lit(1))})
    return c.groupBy(*keys).agg(*[interpolated(p, value).alias(o) for o, p in probs.items()])


def first_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int,
            salts: int = 64, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per key in a total order: ``k`` per salted slice, then ``k`` of those."""
    slice_ = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(salts))
    pre = (df.withColumn("__salt", slice_)
           .withColumn("__r", F.row_number().over(W.partitionBy(*keys, "__salt").orderBy(*order)))
           .where(F.col("__r") <= k).drop("__salt", "__r"))
    return (pre.withColumn(rank, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
            .where(F.col(rank) <= k))


def hash_rank(df: DataFrame, keys: Sequence[str], id_col: str, seed: int, rank: str = "rank",
              total: str = "group_n") -> DataFrame:
    """Position of each row of its key in a seeded hash order, and the key's row count."""
    h = df.withColumn("__h", F.xxhash64(F.col(id_col), F.lit(seed))).withColumn("__one", F.lit(1))
    out = scan(h, keys, F.shiftright(F.col("__h"), 48), ["__h", id_col],
               {rank: ("sum", "__one"), total: ("total", "__one")})
    return out.drop("__h", "__one")


RADIX_BITS = 4


def running_positions(df: DataFrame, keys: Sequence[str], block: Column, order: str, value: str, positions: dict[str, str]) -> DataFrame:
    """For every row, what the known values up to it hold at a sorted position: ``(keys, order, target, at, below)``.

    ``positions`` maps a target to a column with a 0-based position (null: not asked). ``at`` is the value there and ``below`` the sum of the values before
    it. A distributed descent: values become ranks, and each round fixes the next four bits of every answer's rank by one block-wise scan that counts, and sums, per
    value of these bits, what has come up to the row. Rounds grow with the logarithm of the distinct values of a key, and no key is held by one task.
    """
    from ..session import checkpoint_dir
    keys = list(keys)
    v = F.col(value).cast("double")
    known = df.where(v.isNotNull() & ~F.isnan(v)).select(*keys, order, v.alias("__v"))
    distinct = known.groupBy(*keys, "__v").agg(F.lit(1).alias("__one"))
    ranks = scan(distinct, keys, value_block(F.col("__v")), ["__v"], {"__rank": ("sum<", "__one")}).select(*keys, "__v", F.col("__rank").cast("bigint").alias("__rank"))
    most = distinct.groupBy(*keys).count().agg(F.max("count")).first()[0] or 1
    rounds = max(1, -(-(most - 1).bit_length() // RADIX_BITS))
    checkpoint_dir(df.sparkSession)
    settle = (lambda d: d.checkpoint()) if rounds > 1 else (lambda d: d)
    elements = settle(known.join(ranks, [*keys, "__v"]))
    asked = F.explode(F.array(*[F.struct(F.lit(t).alias("target"), F.col(c).cast("bigint").alias("k")) for t, c in positions.items()]))
    asks = df.select(*keys, order, asked.alias("a")).select(*keys, order, "a.target", "a.k").where("k is not null")
    asks = asks.withColumns({"__node": F.lit(0).cast("bigint"), "below": F.lit(0.0)})
    digits = range(1 << RADIX_BITS)
    for level in reversed(range(rounds)):
        shift = RADIX_BITS * level
        digit = F.shiftright("__rank", shift).bitwiseAND(F.lit((1 << RADIX_BITS) - 1))
        none = {"target": F.lit(None).cast("string"), "k": F.lit(None).cast("bigint"), "below": F.lit(None).cast("double")}
        counted = elements.select(*keys, order, F.shiftright("__rank", shift + RADIX_BITS).alias("__node"), digit.cast("int").alias("__digit"), "__v", F.lit(0).alias("__kind"), *[c.alias(n) for n, c in none.items()])
        both = counted.unionByName(asks.select(*keys, order, "__node", F.lit(None).cast("int").alias("__digit"), F.lit(None).cast("double").alias("__v"), F.lit(1).alias("__kind"), "target", "k", "below"))
        # dealt before the counters of every digit are added, so that a shuffle carries one digit and one value
        both = both.withColumn("__at", block).repartition(*keys, "__node", "__at")
        mine = lambda d: F.col("__digit") == d
        both = both.withColumns({f"__n{d}": F.when(mine(d), 1).otherwise(0) for d in digits} | {f"__s{d}": F.when(mine(d), F.col("__v")).otherwise(0.0) for d in digits})
        specs = {f"__cn{d}": ("sum", f"__n{d}") for d in digits} | {f"__cs{d}": ("sum", f"__s{d}") for d in digits}
        got = scan(both, [*keys, "__node"], F.col("__at"), [order, "__kind"], specs).where("__kind = 1")
        got = got.withColumns({"__counts": F.array(*[f"__cn{d}" for d in digits]), "__sums": F.array(*[f"__cs{d}" for d in digits])})
        # the first digit whose counts, added up, pass the position
        start = F.struct(F.lit(0).alias("d"), F.col("k").alias("k"), F.col("below").alias("below"), F.lit(False).alias("found"))
        step = lambda a, x: F.when(a["found"] | (a["k"] < x["n"]), F.struct(a["d"].alias("d"), a["k"].alias("k"), a["below"].alias("below"), F.lit(True).alias("found"))).otherwise(
            F.struct((a["d"] + 1).alias("d"), (a["k"] - x["n"]).alias("k"), (a["below"] + x["s"]).alias("below"), F.lit(False).alias("found")))
        pairs = F.zip_with("__counts", "__sums", lambda n, x: F.struct(n.cast("bigint").alias("n"), x.cast("double").alias("s")))
        got = got.withColumn("__to", F.aggregate(pairs, start, step))
        asks = settle(got.select(*keys, order, "target", F.col("__to.k").alias("k"), (F.col("__node") * (1 << RADIX_BITS) + F.col("__to.d")).alias("__node"), F.col("__to.below").alias("below")))
    named = ranks.withColumnsRenamed({"__rank": "__node", "__v": "at"})
    return asks.join(named, [*keys, "__node"]).select(*keys, order, "target", "at", (F.col("below") + F.when(F.col("k") > 0, F.col("k") * F.col("at")).otherwise(0.0)).alias("below"))
