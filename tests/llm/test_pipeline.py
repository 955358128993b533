"""The pipeline against a brute-force version, and the registration of all queries."""

import re

from pyspark.sql import functions as F

import corpus_pipeline


def test_all_queries_are_registered():
    import __spark_entry__ as entry
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14) )


def test_exact_query_equals_sql(spark, sf_dir):
    from oracle import compare, database
    from talkgrid.llm.queries import ORACLES, QUERIES
    for name, sql in ORACLES.items():
        assert compare(database(sf_dir), QUERIES[name](spark, sf_dir), sql) == ""


def test_stages_on_given_tables(spark, sf_dir):
    from talkgrid.llm.common import written
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = written(stage(spark, docs, sf_dir), name)
        seen[name] = docs
        if name != "sentencepiece":
            assert docs.columns == before.columns and docs.exceptAll(before).count() in (0,) or name == "mixing"
    norm = lambda t: re.sub("[\x20\x09-\x0d]+", " ", t or "")
    tox, exact, near, mixed = (seen[k].collect() for k in ("toxicity", "exact_dedup", "minhash_near_dedup", "mixing"))
    first = {}
    for r in tox:
        first[norm(r.text)] = min(first.get(norm(r.text), r.doc_id), r.doc_id)
    assert sorted(r.doc_id for r in exact) == sorted(first.values())
    from test_operators import near_brute
    want = near_brute([(r.doc_id, r.text) for r in exact], 5, 80)
    assert sorted(r.doc_id for r in near) == sorted(i for i, (_, c) in want.items() if i == c)
    assert {r.doc_id for r in mixed} <= {r.doc_id for r in near}
    assert sorted(r.doc_id for r in docs.collect()) == sorted(r.doc_id for r in mixed)
    text = {r.doc_id: r.text for r in mixed}
    assert all(r.decoded_chars == len(text[r.doc_id]) and r.n_tokens == len(r.ids) for r in docs.collect())


def test_stages_on_awkward_rows(spark, sf_dir):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    rows = [(1, "a b", "en", "s", 3), (1, "a b", "en", "s", 3), (1, "a b", "fr", None, 3), (2, None, None, "s", None), (3, "", "en", "t", 0), (None, "a  b", "en", "t", 4), (4, "c " * 9000, "en", "t", 1)]
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0, name
    assert corpus_pipeline.drop_exact_copies(spark, docs, sf_dir).groupBy("doc_id").count().orderBy(F.col("doc_id")).collect() == [(1, 1), (2, 1), (4, 1)]
    assert corpus_pipeline.drop_near_copies(spark, docs, sf_dir).count() == len(rows)


def test_stages_on_clashing_columns(spark, sf_dir):
    """Extra columns with the names the stages work with, in any case, and a map."""
    rows = [(i, f"text number {i // 2} of a few words", "en", "s", 9, i, "x", i, "o", [1], {"a": i}, i) for i in range(8)] + [(2, "quite another text under an id that is taken already", "en", "t", 9, 1, "x", 1, "o", [1], {"a": 1}, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, U1 int, times string, __id int, __of string, IDS array<int>, m map<string,int>, toxicity_score int")
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, sf_dir)
        if name != "sentencepiece":
            assert got.columns == docs.columns, name
        seen = sorted((r.doc_id, r.text) for r in got.collect()) if name != "sentencepiece" else got.count()
        if name == "exact_dedup":
            assert seen == sorted([(0, rows[0][1]), (2, rows[2][1]), (2, rows[8][1]), (4, rows[4][1]), (6, rows[6][1])])
        if name == "minhash_near_dedup":
            assert len(seen) == 5 and {r[0] for r in seen} == {0, 2, 4, 6}


def test_near_copies_under_one_id(spark, sf_dir):
    """An id that stands for two texts: each text is kept or dropped for its own group, none is lost."""
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    docs = spark.createDataFrame([(2, a), (5, a + " more"), (5, b), (9, b + " more"), (1, "alone"), (1, "other")], "doc_id bigint, text string")
    assert sorted((r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, docs, sf_dir).collect()) == sorted([(2, a), (5, b), (1, "alone"), (1, "other")])
