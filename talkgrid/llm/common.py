"""Shared pieces of the training-data operators: the shared folder, written tables, words as bytes."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import checkpoint_dir, ship_package

#: Space, tab, line feed, vertical tab, form feed, carriage return: the white space of every operator here.
WHITE = r"[\x20\x09-\x0D]+"
NOT_WHITE = r"[^\x20\x09-\x0D]+"


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder name of its own under the folder that driver and executors share."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Rows of an Arrow batch while a table is written: texts and sets are kilobytes each, and both sides of the pipe hold a batch.
BATCH_ROWS = 512


@contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS):
    """Arrow batches of at most ``rows`` rows for what is planned inside; the session's own setting returns afterwards."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if 0 < int(before) <= rows:
        yield
        return
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts the lineage, and survives the loss of any executor."""
    path = new_folder(df.sparkSession, name)
    with small_batches(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or ``name`` with underscores where the caller's table has it already."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def pieces_of_batch(b: pa.RecordBatch, rows: int, size: int = 1 << 20):
    """Slices of at most ``rows`` rows whose columns of varying length hold about ``size`` bytes; a longer row comes alone."""
    total = np.zeros(b.num_rows, np.int64)
    for c in b.columns:
        if pa.types.is_string(c.type) or pa.types.is_binary(c.type) or pa.types.is_large_string(c.type):
            total += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
        elif pa.types.is_list(c.type):
            total += 8 * pc.fill_null(pc.list_value_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(total)
    i = 0
    while i < b.num_rows:
        before = int(ends[i - 1]) if i else 0
        j = max(i + 1, min(i + rows, int(np.searchsorted(ends, before + size, "right"))))
        yield b.slice(i, j - i)
        i = j


def per_batch(fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], rows: int = 1024):
    """A ``mapInArrow`` function that hands ``fn`` small pieces of a batch, so that memory does not follow its longest texts."""

    def run(batches):
        for b in batches:
            for part in pieces_of_batch(b, rows):
                out = fn(part)
                if out is not None:
                    yield out

    return run


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a column without nulls, one after the other, and the n + 1 offsets into them."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset:column.offset + n + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def word_bounds(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of every word; no word spans two texts. Words come in order, so texts follow by ``searchsorted``."""
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], inside[:-1]))
    after = np.concatenate((inside[1:], [False]))
    starts = np.flatnonzero(inside & (~before | edge[:n]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends


def mix64(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit numbers evenly over all bits; a bijection."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniform(*parts: Column) -> Column:
    """A draw from (0, 1) that depends on the values alone, so reruns and retried tasks agree."""
    bits = F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double")
    return (bits + F.lit(0.5)) / F.lit(float(1 << 53))


def join_hot(rows: DataFrame, facts: DataFrame, key: str | list[str], copies: str, share: int = 1000) -> DataFrame:
    """``rows`` joined with ``facts``, one row per ``key`` that knows its number of ``rows`` (``copies``); both are written tables.

    Keys with at least one in ``share`` of all rows, so at most ``share`` keys, are broadcast and their rows stay where they are; the others are shuffled.
    """
    total = facts.agg(F.sum(copies)).first()[0] or 0
    hot = F.col(copies) * share >= F.lit(total)
    often = facts.where(hot)
    names = F.broadcast(often.select(key))
    return rows.join(F.broadcast(often), key).unionByName(rows.join(names, key, "left_anti").join(facts.where(~hot), key))


#: Bits of the filters that spare rows a shuffle: 2 MB at most, whatever the number of keys.
FILTER_BITS = 1 << 24


def split_by_filter(df: DataFrame, keys: DataFrame, mine: list[Column], theirs: list[Column]) -> tuple[DataFrame, DataFrame]:
    """``df`` in two parts: rows whose key may be among ``keys``, and rows whose key is not, which need no join with them.

    A bitmap of hashed keys, at most 512 rows of 4 KB, is built in Spark and broadcast. With more keys than bits the first part grows; it still wants an exact join. Nulls are keys like
    any other.
    """
    def bit(columns: list[Column]) -> Column:
        # from 1, as Spark numbers bitmap buckets from 1 for positive numbers only
        return F.pmod(F.xxhash64(*columns, *[c.isNull() for c in columns]), F.lit(FILTER_BITS)) + 1

    b = bit(theirs)
    maps = keys.groupBy(F.bitmap_bucket_number(b).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(b)).alias("m"))
    at, bucket, bits = (free_name(df, c) for c in ("filter_bit", "filter_bucket", "filter_bits"))
    maps = maps.select(F.col("b").alias(bucket), F.col("m").alias(bits))
    d = df.withColumn(at, bit(mine)).withColumn(bucket, F.bitmap_bucket_number(at)).withColumn(at, F.bitmap_bit_position(at))
    byte = F.conv(F.hex(F.substring(bits, (F.col(at) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    set_ = F.coalesce(F.get(F.array(*[byte.bitwiseAND(F.lit(1 << i)) > 0 for i in range(8)]), F.pmod(F.col(at), F.lit(8)).cast("int")), F.lit(False))
    d = d.join(F.broadcast(maps), bucket, "left").withColumn(at, set_)
    return d.where(F.col(at)).select(*df.columns), d.where(~F.col(at)).select(*df.columns)


def comparable(df: DataFrame, names: list[str] | None = None) -> list[Column]:
    """Columns as values that hash and sort; maps as text."""
    return [F.to_json(F.struct(F.col(f"`{c}`"))) if "map<" in df.schema[c].dataType.simpleString() else F.col(f"`{c}`") for c in (names if names is not None else df.columns)]
