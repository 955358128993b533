"""Analytics over the verdict log: windows of time, buckets, percentiles by the panel's three index rules.

``now`` is a timestamp literal or column, so a report can be rerun for any moment. Failed
requests (``ok`` false) count in uptime only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.ordered import at_position, cumulative


def _now(now: str | Column) -> Column:
    return F.expr(f"timestamp_ntz'{now}'") if isinstance(now, str) else now


def since(log: DataFrame, now, hours: float) -> DataFrame:
    """Rows of the last ``hours``; the filter reaches the scan."""
    return log.where(F.col("at") >= _now(now) - F.make_dt_interval(secs=F.lit(hours * 3600.0)))


def recent(log: DataFrame, now, hours: float = 24, limit: int = 500) -> DataFrame:
    return since(log, now, hours).where("ok").orderBy(F.desc("at"), "id").limit(limit)


def latest(log: DataFrame, by: str, n: int) -> DataFrame:
    """Newest ``n`` rows of every source."""
    from ..functions.ordered import first_k
    return first_k(log, [by], [F.desc("at"), F.col("id")], n)


def age_s(now) -> Column:
    return F.expr("timestampdiff(MICROSECOND, at, __now)") / 1e6


def latency_series(log: DataFrame, now, hours: float = 24, buckets: int = 48) -> DataFrame:
    """Upper-median latency per bucket, oldest first; empty buckets repeat the last value, 0 before the first."""
    width = hours * 3600 / buckets
    d = since(log, now, hours).where("ok").withColumn("__now", _now(now))
    i = (buckets - 1 - F.floor(age_s(now) / width)).cast("int")
    d = d.withColumn("bucket", i).where(F.col("bucket").between(0, buckets - 1))
    c = cumulative(d, ["bucket"], "latency_ms", {"n": F.count(F.lit(1))})
    m = c.groupBy("bucket").agg(F.bround(at_position(F.floor(F.col("tot_n") / 2), "latency_ms"), 0).alias("p"))
    spine = log.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    from pyspark.sql import Window as W
    carry = W.orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)  # over the fixed buckets only
    return spine.join(m, "bucket", "left").select("bucket", F.coalesce(F.last("p", True).over(carry), F.lit(0.0)).alias("latency_ms"))


def health_stats(log: DataFrame, now, hours: float = 24) -> DataFrame:
    n, ok = F.count(F.lit(1)), F.count_if("ok")
    return since(log, now, hours).agg(n.alias("n"), ok.alias("ok"), F.when(n == 0, 100.0).otherwise(
        F.bround(ok * 100.0 / F.greatest(n, F.lit(1)), 2)).alias("uptime"))


def prune(log: DataFrame, now, days: float = 30) -> DataFrame:
    """What stays in the log."""
    return since(log, now, days * 24)


def prune_partitions(spark, path: str, now, days: int = 30) -> list[str]:
    """Drops the old days of a log partitioned by ``date``, in place; returns the days removed.

    Whole days go one by one, a removal each, so a retry goes on where it stopped; of the boundary day only what stays is written back, over that day alone. Days
    that stay whole are not touched.
    """
    from ..session import checkpoint_dir
    edge = spark.range(1).select((_now(now) - F.make_dt_interval(days=F.lit(days))).alias("t")).select(F.to_date("t").cast("string")).first()[0]
    log = spark.read.parquet(path)
    dates = sorted(r[0] for r in log.select(F.col("date").cast("string")).distinct().collect() if r[0] is not None)
    emptied = False
    if edge in dates:
        checkpoint_dir(spark)
        kept = prune(log.where(F.col("date").cast("string") == edge), now, days).checkpoint()  # settled before its files are replaced
        emptied = kept.isEmpty()
        if not emptied:
            kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    store = root.getFileSystem(spark._jsc.hadoopConfiguration())
    gone = [d for d in dates if d < edge or (d == edge and emptied)]
    for d in gone:
        store.delete(jvm.org.apache.hadoop.fs.Path(root, f"date={d}"), True)
    return gone


def detection_stats(log: DataFrame) -> DataFrame:
    return log.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("verdict") == "synthetic").alias("synthetic"),
                   F.count_if(F.col("verdict") != "synthetic").alias("human"), F.avg("confidence").alias("average_confidence"),
                   F.avg("latency_ms").alias("average_latency_ms"))


def hourly_verdicts(log: DataFrame, now, hours: int = 24) -> DataFrame:
    """Calls per hour bucket and verdict, zero filled; the last bucket is the current hour."""
    log = since(log, now, hours + 1)  # a plain comparison that reaches the scan; buckets decide the rest
    top = F.date_trunc("hour", _now(now))
    d = log.withColumn("__now", top.cast("timestamp_ntz"))
    i = (hours - 1 - F.floor(age_s(now) / 3600)).cast("int")
    d = d.where("ok").withColumn("bucket", i).where(F.col("bucket").between(0, hours - 1))
    p = d.groupBy("bucket").pivot("verdict", ["human", "synthetic", "abstained"]).count()
    spine = log.sparkSession.range(hours).select(F.col("id").cast("int").alias("bucket"))
    return spine.join(p, "bucket", "left").na.fill(0)


def confidence_histogram(log: DataFrame) -> DataFrame:
    b = F.least(F.lit(9), F.floor(F.col("confidence") * 10)).cast("int")
    counts = log.where("ok").groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    spine = log.sparkSession.range(10).select(F.col("id").cast("int").alias("bin"))
    return spine.join(counts, "bin", "left").na.fill(0)


def floor_index(p: float) -> Column:
    """0-based position ``floor(p n)``, at most the last."""
    return F.least(F.floor(F.col("tot_n") * p), F.col("tot_n") - 1)


def summary(log: DataFrame) -> DataFrame:
    """The panel's header: counts, p50 and p95 latency, p50 of the moment of decision, by the floor index."""
    ok = log.where("ok")
    long = ok.unpivot([], ["latency_ms", "decided_at_s"], "metric", "value")
    c = cumulative(long, ["metric"], "value", {"n": F.count(F.lit(1))})
    q = c.groupBy("metric").agg(at_position(floor_index(.5), "value").alias("p50"), at_position(floor_index(.95), "value").alias("p95"))
    pick = lambda m, v: F.coalesce(F.max(F.when(F.col("metric") == m, F.col(v))), F.lit(0.0))
    wide = q.agg(pick("latency_ms", "p50").alias("latency_p50_ms"), pick("latency_ms", "p95").alias("latency_p95_ms"),
                 pick("decided_at_s", "p50").alias("decided_p50_s"))
    n = ok.agg(F.count(F.lit(1)).alias("calls"), F.count_if(F.col("verdict") == "synthetic").alias("synthetic"),
               F.count_if(F.col("verdict") == "abstained").alias("abstained"))
    return n.join(F.broadcast(wide))  # one row each


def request_latency(log: DataFrame, by=("queue",)) -> DataFrame:
    """Mean, median, ceil-rank p95 and maximum of successful requests, and how many failed."""
    by = list(by)
    ok = log.where("ok")
    c = cumulative(ok, by, "latency_ms", {"n": F.count(F.lit(1))})
    n = F.col("tot_n")
    rank = F.least(n - 1, F.greatest(F.lit(0), F.ceil(n * 0.95) - 1))
    lo, hi = at_position(F.floor((n - 1) / 2), "latency_ms"), at_position(F.floor(n / 2), "latency_ms")
    q = c.groupBy(*by).agg(((lo + hi) / 2).alias("median_ms"), at_position(rank, "latency_ms").alias("p95_ms"))
    g = log.groupBy(*by).agg(F.count_if("ok").alias("succeeded"), F.count_if(~F.col("ok")).alias("failed"),
                             F.avg(F.when(F.col("ok"), F.col("latency_ms"))).alias("mean_ms"),
                             F.max(F.when(F.col("ok"), F.col("latency_ms"))).alias("max_ms"))
    return g.join(q, by, "left")


def path_counts(log: DataFrame, path: str, reason: str) -> DataFrame:
    return log.groupBy(path, reason).agg(F.count(F.lit(1)).alias("n"))


def call_search(log: DataFrame, verdict: str | None, text: str) -> DataFrame:
    """Rows of a verdict whose id or queue holds the text."""
    d = log.where(F.col("verdict") == verdict) if verdict else log
    t = text.strip().lower()
    return d.where(F.lower(F.col("id").cast("string")).contains(t) | F.lower(F.col("queue").cast("string")).contains(t))
