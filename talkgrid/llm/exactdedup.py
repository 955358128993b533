"""Exact duplicates by an extendible-hash index on shared files.

The key of a text is a 64-bit hash of its normalised form. The directory of depth ``g`` has ``2^g`` slots, one per
value of a key's leading ``g`` bits. A bucket that holds more than ``capacity`` keys is split by looking at one more
bit, which doubles the directory; a bucket keeps its own (local) depth, so a crowded range deepens alone. Keys, not
rows, fill a bucket: copies of one text are one entry, counted before they are shuffled.

Owner tasks process key ranges (whole buckets). Entries with the same key form a chain; the owner compares their bytes,
so two texts that share a key stay apart. Entries whose key occurs once need no comparison and their text is
not moved. The index (directory, entries) is written to the shared folder, and rows find their entry by key.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import WHITE, split_by_filter, table, text_or_empty, written

ENTRIES = "bucket string, depth int, key bigint, link int, sha string, keep_id bigint, rows bigint"


def normalised(text: str = "text") -> Column:
    return F.regexp_replace(text_or_empty(text), WHITE, " ")


def leading_bits(key: Column | str, depth: Column | int) -> Column:
    """The first ``depth`` bits of a 64-bit key, as a string of 0 and 1."""
    return F.substring(F.lpad(F.bin(F.col(key) if isinstance(key, str) else key), 64, "0"), F.lit(1), depth if isinstance(depth, Column) else F.lit(depth))


def build_directory(keys: DataFrame, capacity: int, most: int = 64) -> DataFrame:
    """``(bucket, depth, entries)``: leading bits, local depth and number of distinct keys of every bucket in use.

    Starts at the depth where even keys would fit, then splits overfull buckets one bit at a time; a round
    counts only the keys of overfull buckets. A single key is never split further.
    """
    n = keys.count()
    depth = max(0, (max(n - 1, 0) // max(capacity, 1)).bit_length())
    done, rest = None, keys
    while True:
        counted = written(rest.groupBy(leading_bits("key", depth).alias("bucket")).agg(F.count(F.lit(1)).alias("entries")), "directory")
        level = counted.withColumn("depth", F.lit(depth))
        full = F.col("entries") > capacity
        last = depth >= most
        fine = level if last else level.where(~full)
        done = fine if done is None else done.unionByName(fine)
        over = counted.where(full)
        if last or over.isEmpty():
            return done.select("bucket", "depth", "entries")
        rest = rest.join(over.select("bucket"), leading_bits("key", depth) == F.col("bucket"), "left_semi")
        depth += 1


def _chains(rows):
    """Owner task: rows of ``(bucket, depth, key, text, doc, rows)`` sorted by bucket and key become entries of chains.

    A chain lists the different texts of one key; equal bytes add up. It holds one key's texts at a time.
    """
    def flush(at, chain):
        return [(at[0], at[1], at[2], i, hashlib.sha256(c[0].encode()).hexdigest(), c[1], c[2]) for i, c in enumerate(chain)]

    at, chain = None, []
    for b in rows:
        out = []
        for bucket, depth, key, text, doc, n in zip(*[c.to_pylist() for c in b.columns]):
            if (bucket, depth, key) != at:
                if at is not None:
                    out.extend(flush(at, chain))
                at, chain = (bucket, depth, key), []
            for c in chain:
                if c[0] == text:
                    c[1] = doc if c[1] is None else c[1] if doc is None else min(c[1], doc)
                    c[2] += n
                    break
            else:
                chain.append([text, doc, n])
        if out:
            yield _entries(out)
    if at is not None:
        yield _entries(flush(at, chain))


def _entries(rows) -> pa.RecordBatch:
    kinds = [("bucket", pa.string()), ("depth", pa.int32()), ("key", pa.int64()), ("link", pa.int32()), ("sha", pa.string()), ("keep_id", pa.int64()), ("rows", pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows), kinds)], names=[n for n, _ in kinds])


def exact_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", capacity: int = 4096, key_bits: int = 64) -> DataFrame:
    """One row per input row: ``(doc_id, keep_id, group_size, kept, text_sha256)``.

    Null and empty texts are equal to each other. Of equal texts the row with the smallest ``doc_id`` stays; rows without
    an id stay only if the whole group has none (then ``keep_id`` is null and every row is marked kept). Of rows repeated with the
    smallest id each is marked kept: they are the same document. ``key_bits`` below 64 makes keys collide (tests do that).
    """
    mask = -1 if key_bits >= 64 else -1 << (64 - key_bits)
    norm = docs.select(F.col(key).cast("bigint").alias("doc_id"), normalised(text).alias("norm"))
    norm = norm.withColumn("key", F.xxhash64("norm").bitwiseAND(F.lit(mask).cast("bigint")))
    rows = written(norm.select("doc_id", "key", F.sha2(F.col("norm").cast("binary"), 256).alias("sha")), "rows")

    per_key = written(rows.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.min("doc_id").alias("keep_id"), F.min("sha").alias("sha")), "keys")
    directory = build_directory(per_key.select("key"), capacity)
    depths = [r.depth for r in directory.select("depth").distinct().orderBy("depth").limit(65).collect()] or [0]  # 0 to 64

    def in_bucket(d: DataFrame) -> DataFrame:
        # a key lies in the bucket of whichever depth is in use for its range
        for i, g in enumerate(depths):
            d = d.withColumn(f"__b{i}", leading_bits("key", g))
        if len(depths) == 1:
            return d.withColumn("bucket", F.col("__b0")).withColumn("depth", F.lit(depths[0])).drop("__b0")
        d = d.withColumn("__at", F.explode(F.array(*[F.struct(F.col(f"__b{i}").alias("bucket"), F.lit(g).alias("depth")) for i, g in enumerate(depths)])))
        d = d.select("*", "__at.bucket", "__at.depth").drop("__at", *[f"__b{i}" for i in range(len(depths))])
        return d.join(directory.select("bucket", "depth"), ["bucket", "depth"], "left_semi")

    once = in_bucket(per_key.where("rows = 1")).select("bucket", "depth", "key", F.lit(0).alias("link"), "sha", "keep_id", "rows")
    many = per_key.where("rows > 1").select("key")
    # copies within a task become one row before they travel
    likely = split_by_filter(norm, many, [F.col("key")], [F.col("key")])[0]
    texts = likely.join(many, "key", "left_semi").groupBy("key", "norm").agg(F.min("doc_id").alias("doc"), F.count(F.lit(1)).alias("n"))
    owned = in_bucket(texts).select("bucket", "depth", "key", "norm", "doc", "n")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    owned = owned.repartition(parts, "bucket", "depth").sortWithinPartitions("bucket", "depth", "key")
    chained = owned.mapInArrow(_chains, ENTRIES)
    index = written(once.unionByName(chained), "index")

    found = rows.join(index.select("key", "sha", "keep_id", F.col("rows").alias("group_size")), ["key", "sha"])
    return found.select("doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"),
                        F.col("sha").alias("text_sha256"))


def op10_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP10_SQL = r"""
select doc_id, min(doc_id) over (partition by norm) as keep_id, count(*) over (partition by norm) as group_size,
       doc_id = min(doc_id) over (partition by norm) as kept, sha256(norm) as text_sha256
from (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as norm from documents)
"""
