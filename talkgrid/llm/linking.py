"""Links between sets, confirmed on full sets without writing down pairs.

A candidate search hands over *groups*: nodes that candidates connect, at most one tile of them. A group is named by two sums over its nodes, so the same group
found at several places is one group. Its sets travel once, one task confirms it by a search along links (each node is compared only with those
not reached yet) and returns a spanning forest. Nodes whose components are known to be one count as linked.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window, functions as F

from .common import FILTER_BITS, join_hot, mix64, per_batch, text_or_empty, written
from .shingles import fingerprints, shingle_sets

GROUP_SQL = "g1 bigint, g2 bigint, node bigint"
#: Members of a cell (or of both sides of a pair of tiles) that are compared in one go.
TILE = 1024
#: Members of a cell and size that are in every tile where tiles are not paired.
ANCHORS = 64


def united(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest number reachable from each of ``0 .. n - 1`` over the pairs."""
    label = np.arange(n)
    while len(a):
        x, y = label[a], label[b]
        open_ = x != y
        if not open_.any():
            break
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            nxt = label[label]
            if (nxt == label).all():
                break
            label = nxt
    return label


def candidate_groups(node: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch | None:
    """Rows ``(g1, g2, node)`` of the groups that candidates ``(a, b)``, places in ``node``, connect."""
    if not len(a):
        return None
    used, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    label = united(len(used), at[:len(a)], at[len(a):])
    by = np.lexsort((node[used], label))
    label, nodes = label[by], node[used][by]
    cut = np.flatnonzero(np.concatenate(([True], label[1:] != label[:-1])))
    size = np.diff(np.append(cut, len(label)))
    with np.errstate(over="ignore"):
        names = [np.repeat(np.add.reduceat(mix64(nodes.view(np.uint64) ^ np.uint64(c)), cut), size).view(np.int64) for c in (0x51ED27, 0xA0761D)]
    return pa.RecordBatch.from_arrays([pa.array(names[0]), pa.array(names[1]), pa.array(nodes)], names=["g1", "g2", "node"])


def _tiles(batches):
    """Rows sorted by tile ``(cell, t1, t2)``, cut into runs of whole tiles."""
    rest = None
    for b in batches:
        t = pa.Table.from_batches([b])
        rest = t if rest is None else pa.concat_tables([rest, t])
        if rest.num_rows < 4 * TILE:
            continue
        key = [rest.column(c).to_numpy() for c in ("cell", "t1", "t2")]
        new = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in key]))
        if len(new):
            last = int(new[-1]) + 1
            yield rest.slice(0, last)
            rest = rest.slice(last)
    if rest is not None and rest.num_rows:
        yield rest


def tiled(posted: DataFrame, percent: int, whole: bool) -> DataFrame:
    """``(cell, t1, t2, side, node, n, comp)`` of a written table ``posted(cell, node, n, comp)``: members of each cell, in one tile or, where there are more than ``TILE``, in pairs of tiles whose sizes fit.

    A component that fills half a tile has tiles of its own in a cell, which are not paired with one another. Without ``whole`` tiles are not paired at all; instead some members,
    about ``ANCHORS`` of a size, are in all tiles that fit them, so that components do not end with tiles.
    """
    zero = F.lit(0).cast("bigint")
    cells = posted.groupBy("cell").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    small = posted.join(cells.where(f"members <= {TILE}").select("cell"), "cell", "left_semi")
    small = small.select("cell", zero.alias("t1"), zero.alias("t2"), zero.alias("side"), "node", "n", "comp")
    often = written(cells.where(f"members > {TILE}").select("cell"), "cells")
    if often.isEmpty():
        return small
    large = posted.join(often, "cell", "left_semi").withColumn("band", F.floor(F.log("n") / F.log(F.lit(100 / percent)) + 1e-9).cast("bigint"))
    own = F.lit(-1).cast("bigint")
    if whole:
        heavy = large.groupBy("cell", "band", "comp").agg(F.count(F.lit(1)).alias("m")).where(f"m >= {TILE // 2}")
        large = large.join(heavy.select("cell", "band", "comp", F.col("comp").alias("own")), ["cell", "band", "comp"], "left")
        own = F.coalesce("own", own)
    large = large.withColumn("own", own)
    split = large.groupBy("cell", "band", "own").agg(F.count(F.lit(1)).alias("m")).withColumn("parts", F.ceil(F.col("m") * 2 / TILE))
    split = split.withColumn("first", F.sum("parts").over(Window.partitionBy("cell").orderBy("band", "own")) - F.col("parts"))
    other = split.select("cell", F.col("band").alias("other"), F.col("own").alias("other_own"), F.col("first").alias("from"), (F.col("first") + F.col("parts") - 1).alias("to"))
    # sets that fit lie in one band or in neighbouring ones
    near = split.join(other, "cell").where(F.abs(F.col("band") - F.col("other")) <= 1).where("own < 0 or own <> other_own")
    large = large.join(near, ["cell", "band", "own"]).withColumn("side", F.col("first") + F.pmod(F.xxhash64("node"), F.col("parts")))
    with_ = F.sequence("from", "to")
    if not whole:
        anchor = F.pmod(F.xxhash64("node", F.lit(1)), F.ceil(F.col("m") / ANCHORS)) == 0
        with_ = F.when(anchor, with_).when(F.col("band") == F.col("other"), F.array("side"))
    large = large.withColumn("with", F.explode(with_))
    t1, t2, side = (F.least("side", "with"), F.greatest("side", "with"), F.col("side")) if whole else (F.col("with"),) * 3
    return small.unionByName(large.select("cell", t1.alias("t1"), t2.alias("t2"), side.alias("side"), "node", "n", "comp"))


def tile_join(pairs_of: Callable, percent: int, partners: int | None):
    """A ``mapInArrow`` function over rows ``(cell, t1, t2, side, node, n, comp, ..)`` sorted by tile: groups of nodes that candidates connect.

    ``pairs_of(table, heads, sizes)`` yields candidates ``(a, b, likeness)``, rows of the table, within its tiles. Only pairs of different components
    count, of the two sides where there are two, with sizes that fit; ``partners`` keeps the best few of every two components.
    """
    def run(batches):
        for t in _tiles(batches):
            key = [t.column(c).to_numpy() for c in ("cell", "t1", "t2")]
            side, node, n, comp = (t.column(c).to_numpy() for c in ("side", "node", "n", "comp"))
            cut = np.concatenate(([0], 1 + np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in key]))))
            size = np.diff(np.append(cut, len(node)))
            within = key[1] == key[2]
            found = []
            for a, b, likeness in pairs_of(t, cut, size):
                ok = (comp[a] != comp[b]) & (within[a] | (side[a] != side[b])) & (100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b]))
                found.append((a[ok], b[ok], likeness[ok]))
            if not found:
                continue
            a, b, likeness = (np.concatenate(c) for c in zip(*found))
            if partners and len(a):
                tile = np.repeat(np.arange(len(cut)), size)[a]
                x, y = np.minimum(comp[a], comp[b]), np.maximum(comp[a], comp[b])
                by = np.lexsort((-likeness, y, x, tile))
                k = np.stack([tile[by], x[by], y[by]])
                new = np.concatenate(([True], (k[:, 1:] != k[:, :-1]).any(0)))
                by = by[np.arange(len(by)) - np.maximum.accumulate(np.where(new, np.arange(len(by)), 0)) < partners]
                a, b = a[by], b[by]
            out = candidate_groups(node, a, b)
            if out is not None:
                yield out

    return run


def _hashed(column: str):
    """1 to ``FILTER_BITS``: Spark numbers bitmap buckets from 1 for positive numbers only, 0 has a bucket of its own."""
    return F.pmod(F.xxhash64(column), F.lit(FILTER_BITS)) + 1


def _bits(ids: DataFrame, column: str) -> np.ndarray:
    """A bitmap of hashed ids, at most 512 pieces of 4 KB, built in Spark."""
    bit = _hashed(column)
    parts = ids.groupBy(F.bitmap_bucket_number(bit).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")).collect()
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in parts:
        out[(r.b - 1) * 4096:r.b * 4096] = np.frombuffer(r.bits, np.uint8)
    return out


def sets_of(docs: DataFrame, wanted: DataFrame, words: int, text: str, key: str) -> tuple[DataFrame, Broadcast]:
    """``(node, shingles)`` for ``wanted(node, first, n, s1, s2)``: the set of a text of id ``first`` that has these fingerprints; and the broadcast filter it reads.

    Texts are not shuffled: a bitmap of fixed size (2 MB) drops most unwanted ones where they are read, a join on id and fingerprints the rest. A row that is repeated in
    ``docs`` gives its set as often.
    """
    sent = docs.sparkSession.sparkContext.broadcast(_bits(wanted, "first"))

    def run(b: pa.RecordBatch) -> pa.RecordBatch | None:
        bit = b.column(2).to_numpy()
        b = b.filter(pa.array((sent.value[bit >> 3] >> (bit & 7)) & 1 == 1))
        if not b.num_rows:
            return None
        h, offsets = shingle_sets(b.column(1), words)
        s1, s2 = fingerprints(h, offsets)
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(offsets)), pa.array(s1), pa.array(s2), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(h.view(np.int64)))],
                                          names=["first", "n", "s1", "s2", "shingles"])

    d = docs.select(F.col(key).cast("bigint").alias("first"), text_or_empty(text).alias("x")).where(F.col("first").isNotNull())
    # bitmap_bit_position counts from 0 within a bucket, as the bits of this number do
    d = d.withColumn("bit", _hashed("first")).withColumn("bit", (F.bitmap_bucket_number("bit") - 1) * 32768 + F.bitmap_bit_position("bit"))
    found = d.mapInArrow(per_batch(run, 256), "first bigint, n bigint, s1 bigint, s2 bigint, shingles array<bigint>")
    return found.join(wanted, ["first", "n", "s1", "s2"]).select("node", "shingles"), sent


def forest(node: np.ndarray, comp: np.ndarray, codes: np.ndarray, start: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that connect whatever the full sets of a group connect; ``codes[start[i]:start[i + 1]]`` is the set of ``node[i]``."""
    n = np.diff(start)
    mark = np.zeros(int(codes.max()) + 1 if len(codes) else 1, bool)
    known = comp.copy()
    same: dict[int, list[int]] = {}
    for i, c in enumerate(known.tolist()):
        same.setdefault(c, []).append(i)
    left = np.ones(len(node), bool)
    edges = []

    def reach(c: int) -> list[int]:
        mine = same.pop(c, [])
        left[mine] = False
        return mine

    for root in range(len(node)):
        if not left[root]:
            continue
        todo = reach(int(known[root]))
        while todo and same:
            i = todo.pop()
            rest = np.flatnonzero(left)
            rest = rest[100 * np.minimum(n[rest], n[i]) >= percent * np.maximum(n[rest], n[i])]
            if not len(rest):
                continue
            mark[codes[start[i]:start[i + 1]]] = True
            if len(rest) * 4 < len(node):
                flat = np.concatenate([codes[start[j]:start[j + 1]] for j in rest.tolist()])
                heads = np.cumsum(n[rest]) - n[rest]
                both = np.add.reduceat(mark[flat].astype(np.int64), heads)
            else:
                both = np.add.reduceat(mark[codes].astype(np.int64), start[:-1])[rest]
            mark[codes[start[i]:start[i + 1]]] = False
            for j in rest[100 * both >= percent * (n[i] + n[rest] - both)].tolist():
                if left[j]:
                    edges.append((int(node[i]), int(node[j])))
                    todo.extend(reach(int(known[j])))
    return edges


def _confirm(percent: int):
    """A ``mapInArrow`` function over rows ``(g1, g2, node, comp, shingles)`` sorted by group: the links of each group, as a forest."""
    def links(rows: list[pa.RecordBatch]) -> list[tuple[int, int]]:
        t = pa.Table.from_batches(rows).combine_chunks()
        node, first = np.unique(t.column("node").to_numpy(), return_index=True)  # a repeated document counts once
        if len(node) < 2:
            return []
        lists = t.column("shingles").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        lists = lists.take(pa.array(first))
        start = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy()))).astype(np.int64)
        codes = np.unique(lists.flatten().to_numpy(), return_inverse=True)[1]
        return forest(node, t.column("comp").to_numpy()[first], codes, start, percent)

    def run(batches):
        held, at = [], None
        for b in batches:
            key = np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()], 1)
            cut = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]).any(1)))).tolist()
            edges = []
            for i, j in zip(cut, [*cut[1:], b.num_rows]):
                name = tuple(key[i].tolist())
                if name != at:
                    if held:
                        edges += links(held)
                    held, at = [], name
                held.append(b.slice(i, j - i))
            if edges:
                yield _edges(edges)
        if held:
            edges = links(held)
            if edges:
                yield _edges(edges)

    return run


def _edges(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = np.array(edges, np.int64).T
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def confirmed(groups: DataFrame, nodes: DataFrame, comps: DataFrame, docs: DataFrame, words: int, percent: int, text: str, key: str) -> DataFrame:
    """Links ``(a, b)`` that connect what the full sets of ``groups(g1, g2, node)`` connect, written."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wanted = written(nodes.join(groups.select("node").distinct(), "node", "left_semi").select("node", "first", "n", "s1", "s2"), "wanted")
    sets, sent = sets_of(docs, wanted, words, text, key)
    rows = groups.join(comps, "node").join(sets, "node").select("g1", "g2", "node", "comp", "shingles")
    rows = rows.repartition(parts, "g1", "g2").sortWithinPartitions("g1", "g2")
    links = written(rows.mapInArrow(_confirm(percent), "a bigint, b bigint"), "links")
    sent.destroy()  # the links are a table now; nothing reads the filter again
    return links


def components(edges: DataFrame) -> DataFrame:
    """``(node, comp)`` of every node of ``edges(a, b)``: the smallest node it is connected with.

    Alternating star contraction: neighbours above a node hang on the least of its neighbourhood, then those below it. Every round is a
    written table; rounds end when count and checksum of the edges stay the same. Their number grows with the logarithm of the nodes.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    before = None
    while True:
        e = written(e, "stars")
        now = e.agg(F.count(F.lit(1)), F.sum(F.shiftright(F.xxhash64("u", "v"), 24))).first()
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("comp"))
        before = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        e = large.join(least, "u").select("v", "m").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))).distinct()


def labelled(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(node, comp)`` of every node, written."""
    return written(nodes.select("node").join(components(edges), "node", "left").select("node", F.coalesce("comp", "node").alias("comp")), "components")


def linked_rows(rows: DataFrame, nodes: DataFrame, posted: DataFrame, pairs_of: Callable, docs: DataFrame, words: int, percent: int, partners: int, text: str, key: str) -> DataFrame:
    """``rows(doc_id, n, s1, s2, ..)`` with ``component_id``; a row without an id or with an empty set is linked with nothing.

    ``nodes(node, first, copies, n, s1, s2, ..)`` are the classes of equal sets, ``posted(node, n, place, cell)`` the cells where a node is posted. Three rounds confirm links: cells
    of the first place, tile by tile, which unite most of a large group of near copies; all cells that still hold more than one component, with the ``partners`` best candidates of every two
    components; and these cells once more, without a limit. Nothing is left out in the last round, the others make it small.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    comps, edges = nodes.select("node", F.col("node").alias("comp")), None
    details = [c for c in nodes.columns if c not in ("first", "copies", "n", "s1", "s2")]
    for first, limit in ((True, None), (False, partners), (False, None)):
        here = (posted.where("place = 0") if first else posted).select("cell", "node", "n")
        if edges is None:
            here = here.withColumn("comp", F.col("node"))
        else:
            here = here.join(comps, "node")
            mixed = here.groupBy("cell").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1")
            here = written(here.join(mixed.select("cell"), "cell", "left_semi"), "mixed")
        tiles = tiled(here, percent, not first).join(nodes.select(*details), "node")
        tiles = tiles.repartition(parts, "cell", "t1", "t2").sortWithinPartitions("cell", "t1", "t2")
        found = written(tiles.mapInArrow(tile_join(pairs_of, percent, limit), GROUP_SQL).distinct(), "groups")
        if found.isEmpty():
            if first:
                continue
            break
        more = confirmed(found, nodes, comps, docs, words, percent, text, key)
        if not more.isEmpty():
            edges = more if edges is None else edges.unionByName(more)
            comps = labelled(nodes, edges)
    named = nodes.select("node", "first", "copies", "n", "s1", "s2").join(comps, "node")
    least = named.groupBy("comp").agg(F.min("first").alias("component_id"))
    facts = written(named.join(least, "comp").select("s1", "s2", "n", "copies", "component_id"), "named")
    real = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    linked = join_hot(rows.where(real), facts, ["s1", "s2", "n"], "copies").select(*rows.columns, "component_id")
    return linked.unionByName(rows.where(~real).withColumn("component_id", F.col("doc_id")))
