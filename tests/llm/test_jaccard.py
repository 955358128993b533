"""The Jaccard join against plain sets."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from talkgrid.llm.jaccard import CountTree, cells_of, count_points, jaccard_links, op12_query, shared_at_least
from talkgrid.llm.linking import TILE, forest, tiled, united


def shingles(text, words):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(w)} if 0 < len(w) < words else {tuple(w[i:i + words]) for i in range(len(w) - words + 1)}


def by_hand(rows, words, percent):
    """Components over distinct sets, by all pairs that share a shingle."""
    sets = {}
    for d, t in rows:
        s = frozenset(shingles(t, words))
        if s and d is not None:
            sets[s] = min(d, sets.get(s, d))
    keys = list(sets)
    where = {}
    for i, s in enumerate(keys):
        for x in s:
            where.setdefault(x, []).append(i)
    parent = list(range(len(keys)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    seen = set()
    for ids in where.values():
        for a in range(len(ids)):
            for b in range(a):
                p = (ids[b], ids[a])
                if p not in seen:
                    seen.add(p)
                    x, y = keys[p[0]], keys[p[1]]
                    if 100 * len(x & y) >= percent * len(x | y):
                        parent[find(p[0])] = find(p[1])
    least = {}
    for i, s in enumerate(keys):
        least[find(i)] = min(sets[s], least.get(find(i), sets[s]))
    at = {s: least[find(i)] for i, s in enumerate(keys)}
    return sorted(((d, len(shingles(t, words)), at.get(frozenset(shingles(t, words)), d) if d is not None else None) for d, t in rows), key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id").collect()), key=repr)


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def test_given_documents(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert got(op12_query(spark, sf)) == by_hand(rows, 4, 85)


def edited(draw, words, edits):
    out = list(words)
    for _ in range(edits):
        out[draw.randrange(len(out))] = f"e{draw.randrange(10 ** 6)}"
    return " ".join(out)


def test_group_around_the_threshold(spark):
    """1,500 copies of one text with 0 to 4 changed words: most pairs do not reach the threshold, some do."""
    draw = random.Random(1)
    base = [f"w{draw.randrange(5000)}" for _ in range(120)]
    rows = [(i, edited(draw, base, draw.choice([0, 1, 2, 2, 3, 4]))) for i in range(1500)]
    rows += [(10_000 + i, " ".join(f"u{draw.randrange(5000)}" for _ in range(60)) + " " + " ".join(base[:12])) for i in range(300)]
    assert got(jaccard_links(table(spark, rows), 4, 85)) == by_hand(rows, 4, 85)


def test_cells_beyond_a_tile(spark):
    """One very common token in the first place of 2,600 unrelated texts of mixed sizes, and near copies among them."""
    draw = random.Random(2)
    rows = []
    for i in range(2600):
        words = [f"x{draw.randrange(10 ** 6)}" for _ in range(draw.randrange(3, 14))]
        rows.append((i, "a b c d " + " ".join(words)))
        if i % 50 == 0:
            rows.append((5000 + i, "a b c d " + " ".join(words) + " y"))
    assert got(jaccard_links(table(spark, rows), 4, 80, firsts=20)) == by_hand(rows, 4, 80)


def test_awkward_rows(spark):
    long = " ".join(f"n{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "ONE  two"), (6, "one two three"), (7, long), (8, long + " end"), (9, "a a a a a a a a"), (10, "a a a a"), (None, "one two"), (None, None),
            # repeated rows, and ids that stand for different texts
            (4, "one two"), (11, "p q r s t u v w"), (12, "p q r s t u v w"), (12, "other words that stand alone here"), (13, "other words that stand alone here too"), (20, "other words that stand alone here"),
            (0, "Été 　wide space"), (-5, "Été 　wide space")]
    df = spark.createDataFrame([(*r, 1, {"a": 1}) for r in rows], "doc_id bigint, text string, NODE int, cell map<string,int>")
    assert got(jaccard_links(df, 4, 85)) == by_hand(rows, 4, 85)
    assert jaccard_links(table(spark, []), 4, 85).count() == 0
    assert got(jaccard_links(table(spark, [(1, "only one text here")]), 4, 85)) == [(1, 1, 1)]


@pytest.mark.parametrize("m", [1, 17, 200, 900])
def test_tree_finds_every_pair(m):
    draw = np.random.default_rng(m)
    base = draw.poisson(2, size=(max(1, m // 10), 32))
    points = (base[draw.integers(0, len(base), m)] + draw.poisson(0.05, size=(m, 32))).astype(np.int32)
    n = points.sum(1)
    found = {(min(a, b), max(a, b)) for x, y, _ in CountTree(points, n).pairs(85) for a, b in zip(x.tolist(), y.tolist())}
    i, j = np.triu_indices(m, 1)
    over = np.minimum(points[i], points[j]).sum(1)
    ok = (185 * over >= 85 * (n[i] + n[j])) & (100 * np.minimum(n[i], n[j]) >= 85 * np.maximum(n[i], n[j]))
    assert found == set(zip(i[ok].tolist(), j[ok].tolist()))


def test_forest_spans_what_sets_connect():
    draw = random.Random(4)
    sets = [sorted(draw.sample(range(60), 30)) for _ in range(20)]
    sets += [sorted(set(s[:-2]) | {60 + i}) for i, s in enumerate(sets)]
    start = np.cumsum([0] + [len(s) for s in sets])
    codes = np.array([x for s in sets for x in s])
    edges = forest(np.arange(40), np.arange(40), codes, start, 80)
    pairs = [(a, b) for a in range(40) for b in range(a) if 100 * len(set(sets[a]) & set(sets[b])) >= 80 * len(set(sets[a]) | set(sets[b]))]
    label = lambda p: united(40, *(np.array(c) for c in zip(*p))).tolist()
    assert label(edges) == label(pairs) and len(edges) == 40 - len(set(label(pairs)))


def with_phrases(draw, count):
    """Unrelated texts of 60 to 240 words with one or two of 4 common phrases each, and near copies of every 20th."""
    phrases = [" ".join(f"p{p}_{i}" for i in range(12)) for p in range(4)]
    rows = []
    for i in range(count):
        words = [f"x{draw.randrange(10 ** 6)}" for _ in range(draw.randrange(60, 240))]
        rows.append((i, " ".join([*draw.sample(phrases, draw.randrange(1, 3)), *words])))
        if i % 20 == 0:
            rows.append((10_000 + i, edited(draw, rows[-1][1].split(" "), draw.randrange(1, 5))))
    return rows


def test_common_phrases_bring_no_texts_together(spark):
    """Texts that share phrases alone are in few cells, so comparisons do not grow with the square of a phrase's texts; every near copy is found."""
    rows = with_phrases(random.Random(5), 800)
    docs = table(spark, rows)
    nodes = count_points(docs, 4, 85, 128, 12, "text", "doc_id").withColumn("node", F.monotonically_increasing_id())
    work = lambda d: sum(r.m ** 2 for r in d.groupBy("cell").agg(F.count("*").alias("m")).where("m > 1").collect())
    assert 5 * work(cells_of(nodes)) < work(nodes.select(F.explode(F.slice("firsts", 1, 12)).alias("cell")))
    assert got(jaccard_links(docs, 4, 85)) == by_hand(rows, 4, 85)


@pytest.mark.parametrize("n", [1, 5, 12, 16, 20, 40, 300])
def test_samples_share_what_similar_sets_share(n):
    """Over many draws, pairs at the threshold share fewer tokens of their samples than promised about as rarely as promised."""
    draw, least = np.random.default_rng(n), shared_at_least(80, 16, 0.02)
    missed = 0
    for _ in range(1000):
        both = draw.integers(-(-80 * n // 100), n + 1)
        more = draw.integers(0, max(0, 100 * both // 80 - n) + 1)
        hashes = draw.permutation(10 ** 4)[:n + more]
        a, b = set(np.sort(hashes[:n])[:16].tolist()), set(np.sort(np.concatenate((hashes[:both], hashes[n:])))[:16].tolist())
        assert 100 * both >= 80 * (n + more)
        missed += len(a & b) < max(least[n], least[both + more])
    assert missed <= (0 if n + max(0, n // 4) <= 16 else 40)


def test_a_component_is_not_compared_with_itself(spark):
    """Tiles of a cell with 20,000 members of one component and 100 others grow with the members, and hold every pair of components."""
    rows = [(7, i, 100 + i % 3, 0 if i < 20_000 else i) for i in range(20_100)]
    posted = spark.createDataFrame(rows, "cell bigint, node bigint, n bigint, comp bigint").repartition(4).cache()
    tiles = [tuple(r) for r in tiled(posted, 85, True).select("t1", "t2", "side", "node").collect()]
    assert len(tiles) < 4 * len(rows)
    where = {}
    for t1, t2, side, node in tiles:
        where.setdefault((t1, t2), {}).setdefault(node >= 20_000, set()).add((side, node))
    met = {(a, b) for (t1, t2), k in where.items() for s, a in k.get(True, ()) for z, b in k.get(False, ()) if t1 == t2 or s != z}
    assert len(met) == 100 * 20_000
    first = [tuple(r) for r in tiled(posted.withColumn("comp", F.col("node")), 85, False).select("t1", "node").collect()]
    assert len(first) < 2 * len(rows) and {n for _, n in first} == set(range(20_100)) and len(set(first)) == len(first)
    held = {}
    for t, _ in first:
        held[t] = held.get(t, 0) + 1
    assert max(held.values()) <= TILE
    posted.unpersist()
