"""Near duplicates: an inverted join over the coordinates of MinHash signatures.

Every text becomes the set of its word shingles and a signature of ``coordinates`` minima. Texts with equal sets
are one class. A class is posted under its coordinate-value pairs; a pair of classes is a candidate when it
collides in at least ``least`` coordinates. ``least`` is so low that a pair at the threshold has fewer collisions with a
probability below one in a million; *prefix* filtering then needs only ``coordinates - least + 1`` of the posting lists, because
a pair that collides in none of them cannot collide often enough.

Lists are merged in tiles of bounded size, signature against signature. *Skip merging* leaves out lists whose members are all in one component, pairs within a component, and
all but the first prefix coordinate that a pair shares. A candidate must also collide in enough bytes of a finer sketch (``FINE`` one-byte minima),
which rules out most pairs below the threshold before any set is read; again a pair at the threshold fails with a probability below one in a million.

A candidate is a link when its full sets confirm it. No pair is ever written down: candidates leave a tile as groups of nodes, and
``linking`` confirms a group where its sets meet, along links, in three rounds.

Lists of unrelated texts (a very common shingle that happens to be the minimum of many) stay quadratic in comparisons of signatures, not in rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import mix64, per_batch, table, text_or_empty, written
from .linking import linked_rows
from .shingles import constants, fingerprints, shingle_sets

#: Coordinates of the finer sketch; one byte each, so unrelated ones collide once in 256.
FINE = 128


def least_collisions(coordinates: int, threshold: float, miss: float = 1e-6) -> int:
    """The largest count that a pair at ``threshold`` reaches but for a probability of ``miss``."""
    below, t = 0.0, 0
    while t < coordinates:
        below += comb(coordinates, t) * threshold ** t * (1 - threshold) ** (coordinates - t)
        if below > miss:
            break
        t += 1
    return max(1, t)


def signatures(docs: DataFrame, words: int, coordinates: int, text: str = "text", key: str = "doc_id", carry: Sequence[str] = ()) -> DataFrame:
    """``(doc_id, n, s1, s2, sig, fine, c0, ..)``: set size, two fingerprints of the set, the minima (none for an empty set), the finer sketch; then the ``carry`` columns."""
    factor, salt = constants(coordinates, 37), constants(coordinates, 41)
    factor2, salt2 = constants(FINE, 53), constants(FINE, 59)
    d = docs.select(F.col(key).cast("bigint").alias("doc_id"), text_or_empty(text).alias("x"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)])
    more = d.columns[2:]

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        h, offsets = shingle_sets(b.column(1), words)
        n = np.diff(offsets)
        some = np.flatnonzero(n > 0)
        flat = np.zeros((len(some), coordinates), np.int32)
        fine = np.zeros((len(n), FINE), np.uint8)
        if len(some):
            cuts = offsets[some]
            with np.errstate(over="ignore"):
                for j in range(coordinates):
                    flat[:, j] = np.minimum.reduceat(((h ^ salt[j]) * factor[j]) >> np.uint64(32), cuts).astype(np.uint32).view(np.int32)
                for j in range(FINE):
                    fine[some, j] = np.minimum.reduceat(((h ^ salt2[j]) * factor2[j]) >> np.uint64(24), cuts) & np.uint64(255)
        ends = np.concatenate(([0], np.cumsum(np.where(n > 0, coordinates, 0)))).astype(np.int32)
        s1, s2 = fingerprints(h, offsets)
        arrays = [b.column(0), pa.array(n.astype(np.int64)), pa.array(s1), pa.array(s2), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.ravel())), pa.array([r.tobytes() for r in fine], pa.binary())]
        return pa.RecordBatch.from_arrays([*arrays, *b.columns[2:]], names=["doc_id", "n", "s1", "s2", "sig", "fine", *more])

    kinds = "".join(f", {c} {d.schema[c].dataType.simpleString()}" for c in more)
    return d.mapInArrow(per_batch(run, 256), "doc_id bigint, n bigint, s1 bigint, s2 bigint, sig array<int>, fine binary" + kinds)


def _merge(coordinates: int, prefix: int, least: int, least_fine: int):
    """Candidates within tiles of posting lists: pairs with enough collisions, each at the first prefix coordinate that it shares."""
    def pairs(cut: np.ndarray, size: np.ndarray):
        small = np.flatnonzero((size > 1) & (size <= 64))
        for m in np.unique(size[small]):
            i, j = np.triu_indices(int(m), 1)
            heads = cut[small[size[small] == m]]
            for k in range(0, len(heads), max(1, 50_000 // len(i))):
                h = heads[k:k + max(1, 50_000 // len(i)), None]
                yield (h + i).ravel(), (h + j).ravel()
        for g in np.flatnonzero(size > 64):
            rows = np.arange(cut[g], cut[g] + size[g])
            for r in range(0, len(rows) - 1):
                yield np.full(len(rows) - r - 1, rows[r]), rows[r + 1:]

    def pairs_of(t: pa.Table, heads: np.ndarray, sizes: np.ndarray):
        t = t.combine_chunks()
        comp, j = t.column("comp").to_numpy(), t.column("cell").to_numpy() >> 32
        sig = t.column("sig").combine_chunks()
        sig = (sig.chunk(0) if isinstance(sig, pa.ChunkedArray) else sig).flatten().to_numpy().reshape(-1, coordinates)
        fine = np.frombuffer(b"".join(t.column("fine").to_pylist()), np.uint8).reshape(-1, FINE)

        def near(held):
            a, b = (np.concatenate(c) for c in zip(*held))
            ok = comp[a] != comp[b]
            a, b = a[ok], b[ok]
            same = sig[a] == sig[b]
            count = same.sum(1)
            ok = (count >= least) & (same[:, :prefix].argmax(1) == j[a])
            a, b, count = a[ok], b[ok], count[ok]
            close = (fine[a] == fine[b]).sum(1)
            ok = close >= least_fine
            return a[ok], b[ok], count[ok] / coordinates + close[ok] / FINE

        held, rows = [], 0
        for p in pairs(heads, sizes):
            held.append(p)
            rows += len(p[0])
            if rows >= 50_000:
                yield near(held)
                held, rows = [], 0
        if held:
            yield near(held)

    return pairs_of


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, coordinates: int = 32, least: int | None = None, partners: int = 4,
                    text: str = "text", key: str = "doc_id", carry: Sequence[str] = ()) -> DataFrame:
    """One row per input row: ``(doc_id, n_shingles, component_id, kept)``, and the columns named by ``carry``.

    Texts are linked where ``100 * intersection >= percent * union`` of their shingle sets; ``component_id`` is the smallest id reachable
    over links and equal sets. Texts without words are linked with nothing. A row without an id keeps a null component and is kept. Rows that repeat an id are judged by their own
    texts: an id that stands for two texts may be in two components.
    """
    least = least or least_collisions(coordinates, percent / 100)
    prefix, least_fine = coordinates - least + 1, least_collisions(FINE, percent / 100)
    sigs = written(signatures(docs, words, coordinates, text, key, carry), "signatures")
    real = sigs.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    classes = real.groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies"), F.any_value("sig").alias("sig"), F.any_value("fine").alias("fine"))
    nodes = written(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    cell = F.col("place").cast("bigint") * (1 << 32) + F.col("v").cast("bigint").bitwiseAND(F.lit((1 << 32) - 1))
    posted = nodes.select("node", "n", F.posexplode(F.slice("sig", 1, prefix)).alias("place", "v")).select("node", "n", "place", cell.alias("cell"))
    lists = posted.groupBy("cell").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("cell")
    posted = written(posted.join(lists, "cell", "left_semi"), "posted")
    rows = sigs.drop("sig", "fine")
    linked = linked_rows(rows, nodes, posted, _merge(coordinates, prefix, least, least_fine), docs, words, percent, partners, text, key)
    component = F.col("component_id")
    return linked.select("doc_id", F.col("n").alias("n_shingles"), component, F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"),
                         *[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)])


def op5_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), words=4, percent=80)
