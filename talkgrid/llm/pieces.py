"""SentencePiece encoding (merge type) by a prefix table, and decoding.

In a merge-type vocabulary the encoding of every prefix of a text ends in one token that is unique to the
prefix. The table stores it: of the tokens that end at a position (found by an Aho-Corasick automaton) it is the one
that is *compatible* with the last token of the prefix before it, that is, merging the two strings together gives
just these two tokens again. The ids are then recovered backwards from the end, token by token. That costs time in
proportion to the text, without a queue of merges.

The results equal the sentencepiece library's ``encode`` without begin and end ids and without sampling, for
models with byte fallback, identity normalisation and no pieces that cross a word's start.
"""

from __future__ import annotations

import os
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import free_name, per_batch, table, text_or_empty
from .unitcache import UnitCache

SPACE = "▁"
#: The largest model file that is sent to executors with the function that uses it.
MAX_MODEL_BYTES = 64 << 20


class PrefixTable:
    """Encoder and decoder for one model."""

    def __init__(self, model: bytes, pairs: int = 200_000):
        import ahocorasick
        import sentencepiece
        self.library = lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.bytes = {}
        self.piece: dict[str, int] = {}
        self.score: dict[str, float] = {}
        for i in range(lib.get_piece_size()):
            p = lib.id_to_piece(i)
            if lib.is_byte(i):
                self.bytes[int(p[3:-1], 16)] = i
            elif lib.is_unused(i):
                raise ValueError("models with unused pieces are not supported")
            elif not (lib.is_control(i) or lib.is_unknown(i)):
                self.piece[p], self.score[p] = i, lib.get_score(i)
        if len(self.bytes) != 256:
            raise ValueError("the model has no byte fallback")
        self.text: dict[int, str] = {i: p for p, i in self.piece.items()}
        letters = {p for p in self.piece if len(p) == 1}
        self.touch: set[str] = set()
        for p in self.piece:
            if len(p) > 1:
                if not letters.issuperset(p):
                    raise ValueError(f"piece {p!r} holds a character that is no piece")
                if any(b == SPACE != a for a, b in zip(p, p[1:])):
                    raise ValueError(f"piece {p!r} crosses a word's start")
                self.touch.update(p[j:j + 2] for j in range(len(p) - 1))
        self.automaton = ahocorasick.Automaton()
        for p, i in self.piece.items():
            if len(p) == 1 or self.merged(p) == [p]:
                self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.most_pairs = pairs
        self.cache = UnitCache(self.units)

    def merged(self, s: str) -> list[str]:
        """Plain merging of a short string: the best-scored pair first, of equal ones the leftmost."""
        parts, score = list(s), self.score
        while len(parts) > 1:
            best, at = None, -1
            for j in range(len(parts) - 1):
                v = score.get(parts[j] + parts[j + 1])
                if v is not None and (best is None or v > best):
                    best, at = v, j
            if best is None:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, a: int, b: int) -> bool:
        """Whether ``a`` followed by ``b`` merges to just these two tokens."""
        x, y = self.text[a], self.text[b]
        if x[-1] + y[0] not in self.touch:
            ok = True
        elif x + y in self.piece:
            ok = False
        else:
            ok = self.merged(x + y) == [x, y]
        if len(self.pairs) > self.most_pairs:
            self.pairs.clear()
        self.pairs[a, b] = ok
        return ok

    def ids(self, s: str) -> list[int]:
        """Ids of a string in which spaces are already the space piece."""
        n = len(s)
        last, size, pairs = [-1] * (n + 1), [1] * (n + 1), self.pairs
        done = 0
        for end, (t, length) in self.automaton.iter(s):
            i = end + 1
            if last[i] >= 0:
                continue
            start = i - length
            if start:
                before = last[start]
                if before >= 0:
                    ok = pairs.get((before, t))
                    if ok is None:
                        ok = self.compatible(before, t)
                    if not ok:
                        continue
            last[i], size[i] = t, length
            done = i
        out, i = [], n
        while i > 0:
            t = last[i]
            if t >= 0:
                out.append(t)
            else:
                out.extend(self.bytes[b] for b in reversed(s[i - 1].encode()))
            i -= size[i]
        out.reverse()
        return out

    def units(self, units: list[str]) -> list[bytes]:
        return [np.array(self.ids(u.replace(" ", SPACE)), np.int32).tobytes() if u else b"" for u in units]

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        """Ids of whole texts, as 32-bit integers. A space is put before a text that is not empty."""
        return self.cache.texts([" " + t.replace(SPACE, " ") if t else "" for t in texts])


_TABLES: dict[int, PrefixTable] = {}


@lru_cache(maxsize=2)
def library_of(model: bytes):
    """The library's processor alone, all that decoding needs; one per Python worker and model."""
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_proto=model)


def prefix_table(model: bytes) -> PrefixTable:
    """One per Python worker and model."""
    key = hash(model)
    if key not in _TABLES:
        _TABLES[key] = PrefixTable(model)
    return _TABLES[key]


def model_bytes(path: str) -> bytes:
    if os.path.getsize(path) > MAX_MODEL_BYTES:
        raise ValueError(f"{path} is larger than {MAX_MODEL_BYTES} bytes")
    with open(path, "rb") as f:
        return f.read()


def encode_pieces(docs: DataFrame, model_path: str, text: str = "text", output: str = "ids", decoded: str | None = None) -> DataFrame:
    """``docs`` with ``output`` (array<int>): the ids of the whole text; null and empty texts have none.

    ``decoded`` names a second column, what the library makes of these ids again, by the same pass and worker. Columns of the same names (without regard to case) are replaced. One
    narrow pass: no shuffle, memory for a few hundred texts and the caches. The model is read on the driver and sent along.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model_bytes(model_path))
    new = [output] if decoded is None else [output, decoded]
    held = docs.drop(*[c for c in docs.columns if c.lower() in {n.lower() for n in new} and c != text])
    work = free_name(held, "encoded_text")
    schema = held.withColumns({output: F.array(F.lit(0))} | ({} if decoded is None else {decoded: F.lit("")})).schema

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        got = prefix_table(sent.value).encode(b.column(b.num_columns - 1).to_pylist())
        ends = np.concatenate(([0], np.cumsum([len(g) >> 2 for g in got]))).astype(np.int32)
        ids = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(got))])
        made = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ids)]
        if decoded is not None:
            decode = prefix_table(sent.value).library.decode
            made.append(pa.array([decode(np.frombuffer(g, np.int32).tolist()) if g else "" for g in got], pa.string()))
        return pa.RecordBatch.from_arrays([*b.columns[:-1], *made], names=[*b.schema.names[:-1], *new])

    return held.withColumn(work, text_or_empty(text)).mapInArrow(per_batch(run, 256), schema)


def decode_pieces(docs: DataFrame, model_path: str, ids: str = "ids", output: str = "decoded") -> DataFrame:
    """``docs`` with ``output`` (string), the library's decoding of ``ids``; null or empty ids decode to the empty text."""
    sent = docs.sparkSession.sparkContext.broadcast(model_bytes(model_path))
    held = docs.drop(*[c for c in docs.columns if c.lower() == output.lower() and c != ids])
    work = free_name(held, "decoded_ids")
    schema = held.withColumn(output, F.lit("")).schema

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        decode = library_of(sent.value).decode
        lists = b.column(b.num_columns - 1)
        flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))).astype(int)
        texts = pa.array([decode(flat[i:j].tolist()) if j > i else "" for i, j in zip(ends[:-1], ends[1:])], pa.string())
        return pa.RecordBatch.from_arrays([*b.columns[:-1], texts], names=[*b.schema.names[:-1], output])

    whole = F.coalesce(F.col(ids).cast("array<int>"), F.array().cast("array<int>"))
    return held.withColumn(work, whole).mapInArrow(per_batch(run, 256), schema)


def piece_model() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


def op3_query(spark: SparkSession, sf_dir: str, model_path: str | None = None) -> DataFrame:
    path = model_path or piece_model()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = encode_pieces(docs, path, decoded="decoded").drop("text")
    return both.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
                       F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
                       F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
