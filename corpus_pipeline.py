"""The corpus pipeline: toxicity, exact duplicates, near duplicates, mixing, encoding.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet and read again as the ``docs`` of the
next one. All but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from talkgrid.llm.common import comparable, free_name, split_by_filter, table, text_or_empty, written
from talkgrid.llm.exactdedup import exact_duplicates, normalised
from talkgrid.llm.mixing import mix
from talkgrid.llm.neardedup import near_duplicates
from talkgrid.llm.pieces import encode_pieces, piece_model
from talkgrid.llm.toxicity import fit_toxicity, score_toxicity
from talkgrid.session import ship_package


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below 0.7; the model is fitted on the labelled ones among them."""
    ship_package(spark)
    model = fit_toxicity(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    score = free_name(docs, "toxicity_score")
    return score_toxicity(docs, model, output=score).where(F.col(score) < 0.7).select(*docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal normalised texts: the smallest ``doc_id``; of rows that repeat it, the first by a hash of the row.

    Rows that are neither dropped nor repeated, nearly all, stay where they are: a filter over the others' keys tells them apart.
    """
    ship_package(spark)
    sha, place = free_name(docs, "normal_sha256"), free_name(docs, "place_of_row")
    found = exact_duplicates(docs.select("doc_id", "text"))
    found = written(found.groupBy("doc_id", "text_sha256").agg(F.bool_and("kept").alias("stays"), F.count(F.lit(1)).alias("n")), "exact-decisions")
    open_ = found.where("not stays or n > 1")
    mine = docs.withColumn(sha, F.sha2(normalised().cast("binary"), 256))
    names = [F.col(f"`{c}`") for c in docs.columns]
    doubtful, plain = split_by_filter(mine, open_, [F.col("doc_id").cast("bigint"), F.col(sha)], [F.col("doc_id"), F.col("text_sha256")])
    gone = found.where("not stays").select(F.col("doc_id").alias("gone_id"), F.col("text_sha256").alias("gone_sha"))
    rest = doubtful.join(gone, (doubtful[sha] == gone["gone_sha"]) & F.col("doc_id").cast("bigint").eqNullSafe(F.col("gone_id")), "left_anti")
    every = comparable(docs)
    first = F.row_number().over(W.partitionBy(sha, "doc_id").orderBy(F.xxhash64(*every), F.xxhash64(F.lit(1), *every, *[c.isNull() for c in every])))
    return plain.select(*names).unionByName(rest.withColumn(place, first).where(F.col(place) == 1).select(*names))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest ``doc_id``, of each group linked by five-word shingles and a similarity of 0.8 or more.

    Where an id stands for several texts each is judged by itself.
    """
    ship_package(spark)
    of = free_name(docs, "hash_of_text")
    named = docs.withColumn(of, F.xxhash64(text_or_empty()))
    found = near_duplicates(named.select("doc_id", "text", of), words=5, percent=80, carry=[of])
    gone = written(found.where("not kept").select(F.col("doc_id").alias("gone_id"), F.col(of).alias("gone_hash")).distinct(), "near-decisions")
    doubtful, plain = split_by_filter(named, gone, [F.col("doc_id").cast("bigint"), F.col(of)], [F.col("gone_id"), F.col("gone_hash")])
    rest = doubtful.join(gone, (F.col("doc_id").cast("bigint") == F.col("gone_id")) & (doubtful[of] == gone["gone_hash"]), "left_anti")
    names = [F.col(f"`{c}`") for c in docs.columns]
    return plain.select(*names).unionByName(rest.select(*names))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the target of its source asks for."""
    ship_package(spark)
    return mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, source, n_tokens, ids, decoded_chars)``: the ids of every whole text, and the length of what they decode to."""
    ship_package(spark)
    path = piece_model()
    both = encode_pieces(docs.select("doc_id", "source", "text"), path, decoded="decoded")
    return both.select("doc_id", "source", F.size("ids").cast("bigint").alias("n_tokens"), "ids", F.length("decoded").cast("bigint").alias("decoded_chars"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("minhash_near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

#: SQL cannot express the compression distance, the cube method or the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
