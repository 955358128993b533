"""Hard negatives against brute force."""

import math

import duckdb
import numpy as np
import pytest

from talkgrid.llm.hardneg import OP11_SQL, CoordinateIndex, hard_negatives, integer_vectors, op11_query

COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def by_hand(rows, every=100):
    """Rows ``(id, label, vector)`` that take part, with plain integers."""
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for a, la, va in rows:
        if a % every:
            continue
        score = sorted((-dot(va, v), i, l) for i, l, v in rows if i != a and len(v) == len(va))
        for ps, p, _ in [s for s in score if s[2] == la][:5]:
            fit = [(i, s) for s, i, l in score if l != la and 30 * -ps <= 100 * -s <= 90 * -ps][:10]
            out += [(a, p, r, i, -ps, -s) for r, (i, s) in enumerate(fit, 1)]
    return sorted(out)


def whole(rows):
    return [(i, l, [math.floor(256 * x) for x in v]) for i, l, v in rows]


def got(df):
    return sorted(tuple(r) for r in df.select(*COLUMNS).collect())


def run(spark, rows, every=100, **kw):
    points = integer_vectors(spark.createDataFrame([(i, [float(x) for x in v], l) for i, l, v in rows], "vec_id bigint, embedding array<double>, label int"))
    return got(hard_negatives(points, points.where(f"pmod(id, {every}) = 0"), **kw))


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    cur = con.execute(OP11_SQL)
    names = [d[0] for d in cur.description]
    want = sorted(tuple(r[names.index(c)] for c in COLUMNS) for r in cur.fetchall())
    assert want and got(op11_query(spark, sf)) == want


@pytest.mark.parametrize("kind", ["gauss", "lengths", "copies", "large"])
def test_kinds_of_vectors(spark, kind):
    draw = np.random.default_rng(3)
    x = draw.normal(size=(1200, 8)) + (draw.integers(0, 4, 1200) * 0.7)[:, None]
    if kind == "lengths":
        x *= np.exp(draw.normal(size=(1200, 1)) * 2)
    if kind == "copies":
        x[100:600] = x[100]
        x[700:720] = 0
    if kind == "large":
        x *= 3e5
    rows = [(i, int(draw.integers(0, 3)), v.tolist()) for i, v in enumerate(x)]
    assert run(spark, rows, 25, shard_rows=500, block_rows=20) == by_hand(whole(rows), 25)


def test_index_prunes_and_stays_exact():
    draw = np.random.default_rng(5)
    centres = draw.normal(size=(40, 16))
    x = np.floor(256 * (centres[draw.integers(0, 40, 4000)] + 0.05 * draw.normal(size=(4000, 16)))).astype(np.int64)
    index = CoordinateIndex(np.arange(4000), np.zeros(4000, np.int64), x)
    seen = []
    for b in index.buckets:
        q = x[7] / np.sqrt((x[7] ** 2).sum())
        found = b.candidates(q, np.argsort(-np.abs(q))[:5], 0.95, 1.0, 0.9)
        seen.append(len(found) if found is not None else len(b.rows))
        near = np.flatnonzero(b.unit @ q >= 0.95)
        assert found is None or set(near) <= set(found.tolist())
        # a range below as well
        found = b.candidates(q, np.argsort(-np.abs(q))[:5], -0.2, 0.1, 1.0)
        near = np.flatnonzero((b.unit @ q >= -0.2) & (b.unit @ q <= 0.1))
        assert found is None or set(near) <= set(found.tolist())
    assert sum(seen) < 2000


def test_awkward_rows(spark):
    rows = [(0, 1, [1.0, 2.0]), (7, 1, [1.0, 1.9]), (100, 2, [0.0, 0.0]), (3, 2, [0.9, 0.5]), (4, 2, [0.9, 0.5]), (5, 2, [-1.0, -1.0]), (-100, 2, [1.0, 1.0]), (6, 1, [1.0, 2.0]),
            (8, 2, [1.0, 2.0, 3.0]), (9, 1, [1.0, 2.0, 3.0]), (11, 3, [1e-3, 2.0 ** 20])]
    bad = [(20, None, [1.0, 1.0]), (21, 1, None), (22, 1, [1.0, None]), (23, 1, [float("nan"), 1.0]), (24, 1, [float("inf"), 1.0]), (None, 1, [1.0, 1.0]), (25, 1, [1e300, 1.0]), (26, 1, [1e308, 1e308])]
    copies = [(3, 2, [0.9, 0.5]), (3, 2, [0.9, 0.6])]
    df = spark.createDataFrame([(i, v, l, 1, {"a": 1}) for i, l, v in rows + bad + copies], "vec_id bigint, embedding array<double>, label int, ID int, v map<string,int>")
    points = integer_vectors(df)
    assert points.count() == len(rows)
    assert got(hard_negatives(points, points.where("pmod(id, 100) = 0"))) == by_hand(whole(rows))


def test_empty_tables(spark):
    none = integer_vectors(spark.createDataFrame([], "vec_id bigint, embedding array<double>, label int"))
    assert hard_negatives(none, none).count() == 0
    one = integer_vectors(spark.createDataFrame([(0, [], 1), (1, [], 1), (2, [], 2)], "vec_id bigint, embedding array<double>, label int"))
    assert got(hard_negatives(one, one.where("id = 0"))) == [(0, 1, 1, 2, 0, 0)]
