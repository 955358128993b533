"""Token alignment between a byte-level tokenizer (A) and a sentencepiece tokenizer (B), each distinct text once.

Documents are shuffled by their full text, copies counted where they are read, so a text is encoded and aligned once however many
documents hold it. Byte offsets where tokens of both sides end cut a text into groups; every A token of a group is linked with every B token of
it. Pair counts are numbers of documents: what a distinct text holds counts as often as documents have that text.

A task aligns its texts in *chunks* of bounded size. A chunk has a dictionary of the pairs that occur in it, with the number of
documents that hold each, and its texts refer to pairs by their place in the dictionary. So what is shuffled to count pairs, and what comes
back as corpus-wide counts, is one row per chunk and distinct pair, not one per text and pair; no pair has more rows than there are chunks. A second pass reads every chunk
behind its dictionary, adds up the measures of each text, and joins them to the documents by a sha256 of the text.

Null and empty texts, and texts that one tokenizer does not give back byte by byte, have no tokens: zeros and an empty digest. Rows are kept
one by one: repeated rows and equal ids count as that many documents. Very long texts are aligned whole; groups of many tokens are counted by
distinct ids before they are paired. More columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .binary import byte_model
from .bytelevel import ByteLevel
from .common import join_hot, pieces_of_batch, table, text_or_empty, written
from .pieces import SPACE, model_bytes, piece_model

#: Links of a group are written out one by one up to here; beyond, its ids are counted first.
WIDE_GROUP = 4096
#: A chunk ends with the first slice of texts (1 MB) that reaches either bound.
CHUNK_BYTES, CHUNK_PAIRS = 16 << 20, 400_000
LINKED = pa.schema([("chunk", pa.int64()), ("kind", pa.int32()), ("sha", pa.string()), ("copies", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
                    ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("pairs", pa.binary()), ("links", pa.binary()), ("codes", pa.list_(pa.int64())), ("docs", pa.list_(pa.int64()))])
LINKED_SQL = ("chunk bigint, kind int, sha string, copies bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs binary, links binary, "
              "codes array<bigint>, docs array<bigint>")
#: The result beside doc_id.
MEASURES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


class PieceSide:
    """The sentencepiece tokenizer, which puts a space before a text."""

    def __init__(self, model: bytes):
        import sentencepiece
        self.library = lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.bytes = [bytes([int(lib.id_to_piece(i)[3:-1], 16)]) if lib.is_byte(i) else lib.id_to_piece(i).replace(SPACE, " ").encode() for i in range(lib.get_piece_size())]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.library.encode(texts, num_threads=1)


@lru_cache(maxsize=2)
def _aligner(byte_level: bytes, pieces: bytes):
    return Aligner(ByteLevel(byte_level, special=False), PieceSide(pieces))


def _counted(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(ids, return_counts=True)


class Aligner:
    """Aligns slices of texts with flat arrays; both sides are tables of token bytes with an encoder."""

    def __init__(self, a, b):
        self.a, self.b = a, b
        self.size = [np.array([len(x) for x in s.bytes], np.int64) for s in (a, b)]
        # what a token adds to the written form of the groups: its id behind the sign that separates it from what stands before
        self.sign = []
        for s, first in ((a, b";"), (b, b"|")):
            t = np.empty(2 * len(s.bytes), object)
            t[:] = [x + str(i).encode() for x in (b",", first) for i in range(len(s.bytes))]
            self.sign.append(t)

    def encoded(self, texts: list[str]) -> tuple[np.ndarray, list[list[int]], list[list[int]]]:
        """Which texts both sides give back byte by byte, and their ids."""
        spaced = [" " + t for t in texts]
        got = self.a.encode(spaced), self.b.encode(texts)
        ok = np.zeros(len(texts), bool)
        for i, t in enumerate(spaced):
            if len(t) > 1:
                raw = t.encode()
                ok[i] = all(b"".join(map(s.bytes.__getitem__, ids[i])) == raw for s, ids in zip((self.a, self.b), got))
        keep = np.flatnonzero(ok)
        return ok, *([ids[i] for i in keep] for ids in got)

    def align(self, texts: list[str]) -> dict:
        """Per text ``n_a, n_b, n_groups, n_links, digest``; and the links as ``(text, code, links)``, sorted by text and code."""
        n = len(texts)
        ok, *got = self.encoded(texts)
        out = {k: np.zeros(n, np.int64) for k in ("n_a", "n_b", "n_groups", "n_links")}
        out["digest"] = [""] * n
        doc = np.flatnonzero(ok)
        none = np.zeros(0, np.int64)
        if not len(doc):
            return out | {"text": none, "code": none, "links": none}
        count = [np.array([len(x) for x in ids], np.int64) for ids in got]
        ids = [np.concatenate([np.array(x, np.int64) for x in side]) for side in got]
        end = [np.cumsum(size[i]) for size, i in zip(self.size, ids)]
        shared = [end[1][np.minimum(np.searchsorted(end[1], end[0]), len(end[1]) - 1)] == end[0], end[0][np.minimum(np.searchsorted(end[0], end[1]), len(end[0]) - 1)] == end[1]]
        group = [np.concatenate(([0], np.cumsum(s)[:-1])) for s in shared]
        groups = int(shared[0].sum())
        many = [np.bincount(g, minlength=groups) for g in group]
        start = [np.cumsum(m) - m for m in many]
        last = np.cumsum(count[0]) - 1                      # last A token of every text
        owner = np.searchsorted(last, start[0], "left")      # text of every group
        products = many[0] * many[1]
        first_group = np.searchsorted(owner, np.arange(len(doc)))
        out["n_a"][doc], out["n_b"][doc] = count
        out["n_groups"][doc] = np.bincount(owner, minlength=len(doc))
        out["n_links"][doc] = np.add.reduceat(products, first_group)
        self._digests(out["digest"], doc, ids, group, start, many, count)
        out["text"], out["code"], out["links"] = self._pairs(doc, ids, group, start, many, owner, products)
        return out

    def _digests(self, digest, doc, ids, group, start, many, count) -> None:
        total = len(ids[0]) + len(ids[1])
        written_form = np.empty(total, object)
        begins = [np.arange(len(i)) == s[g] for i, s, g in zip(ids, start, group)]
        written_form[np.arange(len(ids[0])) + start[1][group[0]]] = self.sign[0][ids[0] + begins[0] * len(self.a.bytes)]
        written_form[np.arange(len(ids[1])) + (start[0] + many[0])[group[1]]] = self.sign[1][ids[1] + begins[1] * len(self.b.bytes)]
        ends = np.cumsum(count[0] + count[1])
        for d, i, j in zip(doc.tolist(), (ends - count[0] - count[1]).tolist(), ends.tolist()):
            digest[d] = hashlib.sha256(b"".join(written_form[i:j].tolist())[1:]).hexdigest()

    def _pairs(self, doc, ids, group, start, many, owner, products):
        narrow = products <= WIDE_GROUP
        tokens = np.flatnonzero(narrow[group[0]])
        g = group[0][tokens]
        times = many[1][g]
        rows = np.repeat(np.arange(len(tokens)), times)
        nth = np.arange(len(rows)) - np.repeat(np.cumsum(times) - times, times)
        a, b = ids[0][tokens[rows]], ids[1][start[1][g[rows]] + nth]
        text, code, links = [owner[g[rows]]], [a << 32 | b], [np.ones(len(rows), np.int64)]
        for w in np.flatnonzero(~narrow).tolist():
            (x, m), (y, k) = (_counted(i[s[w]:s[w] + c[w]]) for i, s, c in zip(ids, start, many))
            code.append((x[:, None] << 32 | y[None, :]).ravel())
            links.append((m[:, None] * k[None, :]).ravel())
            text.append(np.full(len(code[-1]), owner[w]))
        text, code, links = (np.concatenate(c) for c in (text, code, links))
        distinct, at = np.unique(code, return_inverse=True)
        key = text * len(distinct) + at
        by = np.argsort(key, kind="stable")
        key = key[by]
        cut = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        key = key[cut]
        return doc[key // len(distinct)], distinct[key % len(distinct)], np.add.reduceat(links[by], cut)


def _packed(x: np.ndarray) -> bytes:
    """One byte that tells the width, then numbers of 1, 2, 4 or 8 bytes, whichever is enough."""
    most = int(x.max()) if len(x) else 0
    width = next(w for w in (1, 2, 4, 8) if most < 1 << 8 * w)
    return bytes([width]) + x.astype(f"<u{width}").tobytes()


def _numbers(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.int64)


def _cuts(x: np.ndarray, text: np.ndarray, n: int) -> list[bytes]:
    at = np.searchsorted(text, np.arange(n + 1)).tolist()
    return [_packed(x[i:j]) for i, j in zip(at[:-1], at[1:])]


class Chunk:
    """A dictionary of pairs under construction."""

    def __init__(self, number: int):
        self.number, self.bytes = number, 0
        self.place: dict[int, int] = {}
        self.docs = np.zeros(1024, np.int64)

    def add(self, texts: list[str], copies: np.ndarray, sha: pa.Array, got: dict) -> pa.RecordBatch:
        distinct, at = np.unique(got["code"], return_inverse=True)
        place = self.place
        index = np.fromiter((place.setdefault(c, len(place)) for c in distinct.tolist()), np.int64, len(distinct))
        if len(place) > len(self.docs):
            self.docs = np.concatenate((self.docs, np.zeros(max(len(self.docs), len(place) - len(self.docs)), np.int64)))
        np.add.at(self.docs, index[at], copies[got["text"]])
        self.bytes += sum(map(len, texts))
        n = len(texts)
        none = pa.nulls(n, pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, self.number)), pa.array(np.ones(n, np.int32)), sha, pa.array(copies), *(pa.array(got[c]) for c in ("n_a", "n_b", "n_groups", "n_links")),
                                           pa.array(got["digest"], pa.string()), pa.array(_cuts(index[at], got["text"], n), pa.binary()), pa.array(_cuts(got["links"], got["text"], n), pa.binary()), none, none], schema=LINKED)

    def dictionary(self) -> pa.RecordBatch:
        n = len(self.place)
        lists = [pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), pa.array(x)) for x in (np.fromiter(self.place, np.int64, n), self.docs[:n])]
        blank = [pa.nulls(1, f.type) for f in list(LINKED)[2:-2]]
        return pa.RecordBatch.from_arrays([pa.array([self.number]), pa.array([0], pa.int32()), *blank, *lists], schema=LINKED)


def linked_texts(texts: DataFrame, byte_path: str, piece_path: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Texts of ``texts(x, sha, copies)`` with their links (kind 1), and a dictionary of each chunk (kind 0)."""
    sent = texts.sparkSession.sparkContext.broadcast((model_bytes(byte_path), model_bytes(piece_path)))

    def run(batches):
        aligner = _aligner(*sent.value)
        # unique in the table that is written: of a repeated task only one attempt stays
        number = TaskContext.get().partitionId() << 32
        chunk = Chunk(number)
        for whole in batches:
            for b in pieces_of_batch(whole, 256):
                x = b.column(0).to_pylist()
                yield chunk.add(x, b.column(2).to_numpy(), b.column(1), aligner.align(x))
                if chunk.bytes >= chunk_bytes or len(chunk.place) >= CHUNK_PAIRS:
                    yield chunk.dictionary()
                    number += 1
                    chunk = Chunk(number)
        if chunk.bytes:
            yield chunk.dictionary()

    return texts.select("x", "sha", "copies").mapInArrow(run, LINKED_SQL)


def pair_counts(linked: DataFrame) -> DataFrame:
    """``(chunk, place, code, count)``: of every pair of every chunk, how many documents of the corpus hold it."""
    rows = linked.where("kind = 0").select("chunk", F.posexplode(F.arrays_zip("codes", "docs")).alias("place", "p")).select("chunk", "place", "p.codes", "p.docs")
    total = F.expr("sum(docs) over (partition by codes)")
    return rows.select("chunk", "place", F.col("codes").alias("code"), total.alias("count"))


#: What the second pass reads: rows of a chunk's dictionary have the first five columns, texts the others.
TEXT_COLUMNS = ["sha", "copies", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "links"]


def _measured(batches):
    """Rows ``(chunk, kind, place, count, best, *TEXT_COLUMNS)`` by chunk, its dictionary first; yields the measures of texts."""
    at, counts, best = None, None, None
    held: list[tuple] = []
    for b in batches:
        chunk, kind = b.column(0).to_numpy(), b.column(1).to_numpy()
        cut = np.flatnonzero(np.concatenate(([True], (chunk[1:] != chunk[:-1]) | (kind[1:] != kind[:-1]))))
        for i, j in zip(cut, [*cut[1:], b.num_rows]):
            part = b.slice(i, j - i)
            if chunk[i] != at:
                at, counts, held = chunk[i], None, []
            if kind[i] == 0:
                held.append(tuple(part.column(c).to_numpy() for c in (2, 3, 4)))
                continue
            if counts is None:
                place, count, top = (np.concatenate(c) for c in zip(*held)) if held else (np.zeros(0, np.int64),) * 3
                counts, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
                counts[place], best[place] = count, top
                held = []
            n_best, count_sum = [], []
            for p, n in zip(part.column("pairs").to_pylist(), part.column("links").to_pylist()):
                p, n = _numbers(p), _numbers(n)
                n_best.append(int((best[p] * n).sum()))
                count_sum.append(int((counts[p] * n).sum()))
            names = TEXT_COLUMNS[:-2]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64())], names=[*names, "n_best", "count_sum"])


def align_tokenizers(docs: DataFrame, byte_path: str, piece_path: str, text: str = "text", key: str = "doc_id", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per input row: ``(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)``; see the module's head."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = docs.select(F.col(key).cast("bigint").alias("doc_id"), text_or_empty(text).alias("x"))
    sha = F.sha2(F.col("x").cast("binary"), 256).alias("sha")
    rows = written(d.select("doc_id", sha), "texts-of-rows")
    texts = d.groupBy("x").agg(F.count(F.lit(1)).alias("copies")).select("x", sha, "copies")
    linked = written(linked_texts(texts, byte_path, piece_path, chunk_bytes), "linked")
    counts = written(pair_counts(linked), "pair-counts")
    # one row per A id: never more than the vocabulary has
    best = counts.groupBy(F.shiftright("code", 32).alias("a")).agg(F.max("count").alias("top"))
    mine = counts.withColumn("a", F.shiftright("code", 32)).join(F.broadcast(best), "a")
    kinds = {f.name: f.dataType.simpleString() for f in linked.schema}
    dictionary = mine.select("chunk", F.lit(0).alias("kind"), F.col("place").cast("bigint").alias("place"), "count", (F.col("count") == F.col("top")).cast("bigint").alias("best"),
                             *[F.lit(None).cast(kinds[c]).alias(c) for c in TEXT_COLUMNS])
    blank = [F.lit(None).cast("bigint").alias(c) for c in ("place", "count", "best")]
    both = dictionary.unionByName(linked.where("kind = 1").select("chunk", "kind", *blank, *TEXT_COLUMNS))
    kept = ", ".join(f"{c} {kinds[c]}" for c in TEXT_COLUMNS[:-2])
    measures = both.repartition(parts, "chunk").sortWithinPartitions("chunk", "kind").mapInArrow(_measured, f"{kept}, n_best bigint, count_sum bigint")
    found = join_hot(rows, written(measures, "measures"), "sha", "copies")
    return found.select("doc_id", *MEASURES)


def op13_query(spark: SparkSession, sf_dir: str, byte_path: str | None = None, piece_path: str | None = None) -> DataFrame:
    return align_tokenizers(table(spark, sf_dir, "documents").select("doc_id", "text"), byte_path or byte_model(), piece_path or piece_model())
