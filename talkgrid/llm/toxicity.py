"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on ordinary text, one on toxic text. A text is cut into
windows of a few words; a window that the toxic dictionary makes shorter than the ordinary one holds
something that only toxic texts say. How often and by how much that happens over the whole text
gives the score, through a calibrated logistic curve.

Toxic texts consist mostly of ordinary words, which tell nothing. So the toxic dictionary is trained on the
passages of toxic texts that are told apart: byte sequences that occur in many *different* surroundings
in toxic texts (a copied text has the same surroundings in every copy) and hardly in ordinary ones. Both
dictionaries hold the ordinary dictionary, so ordinary windows come out even.

The model is fitted on a bounded sample of labelled rows (``max_docs`` of each class by a hash of the id, and
``max_bytes`` of each class, of a text longer than ``max_text`` windows spread over the whole of it); scoring reads every whole text.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import free_name, per_batch, table, text_bytes, text_or_empty, word_bounds, written

GRAM = 5
SIDE = 6
#: Log likelihood ratio from which a sequence or passage counts as told apart.
SURPRISE = 9
#: Bytes or characters of a sample, and of a window of a long text.
SAMPLE, PIECE = 600, 1024


@dataclass
class Toxicity:
    """A fitted model; small, so it travels to the executors with the function that uses it."""

    ordinary: bytes
    toxic: bytes
    window: int = 8
    step: int = 7
    longest: int = 512
    weights: list[float] = field(default_factory=lambda: [-6.0, 1.0, 0.0, 0.0, 0.0, 0.0])

    def _compressors(self):
        import zstandard as z
        if getattr(self, "_made", None) is None:
            made = []
            for content in (self.toxic + self.ordinary, self.ordinary):
                how = z.ZstdCompressionParameters(
                    window_log=17, hash_log=16, chain_log=16, search_log=4, min_match=5, target_length=32, strategy=z.STRATEGY_GREEDY,
                    format=z.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0)
                d = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(compression_params=how)
                made.append(z.ZstdCompressor(dict_data=d, compression_params=how))
            self._made = made
        return self._made

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_made"}

    def windows(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(start, length)`` of every window and the number of its text. Long words are cut, so nothing is left out."""
        starts, ends = word_bounds(raw, offsets)
        if not len(starts):
            return np.zeros((0, 2), np.uint64), np.zeros(0, np.int64)
        doc = np.searchsorted(offsets, starts, "right") - 1
        first = np.searchsorted(doc, np.arange(len(offsets) - 1))
        i = np.flatnonzero((np.arange(len(starts)) - first[doc]) % self.step == 0)
        last = np.minimum(i + self.window, np.append(first[1:], len(starts))[doc[i]]) - 1
        a, b, d = np.maximum(starts[i] - 1, offsets[doc[i]]), ends[last], doc[i]
        b = np.minimum(b + 1, offsets[d + 1])
        parts = np.maximum(1, -(-(b - a) // self.longest))
        if (parts > 1).any():
            k = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            a2 = np.repeat(a, parts) + k * self.longest
            b = np.minimum(np.repeat(b, parts), a2 + self.longest + 16)
            a, d = a2, np.repeat(d, parts)
        return np.stack([a, b - a], 1).astype(np.uint64), d

    def features(self, texts: pa.Array) -> np.ndarray:
        """Per text: sum of the eight largest gains, largest, second, windows gaining two bytes, log of the windows."""
        import zstandard as z
        raw, offsets = text_bytes(texts)
        upper = (raw >= 65) & (raw <= 90)
        raw = np.where(upper, raw + 32, raw).astype(np.uint8)
        n = len(offsets) - 1
        seg, doc = self.windows(raw, offsets)
        out = np.zeros((n, 5))
        if not len(seg):
            return out
        sizes = []
        for c in self._compressors():
            size = np.empty(len(seg), np.int64)
            for i in range(0, len(seg), 1 << 16):
                part = seg[i:i + (1 << 16)]
                lo, hi = int(part[:, 0].min()), int((part[:, 0] + part[:, 1]).max())
                part = part - np.array([[lo, 0]], np.uint64)
                size[i:i + len(part)] = [len(x) for x in c.multi_compress_to_buffer(z.BufferWithSegments(raw[lo:hi].tobytes(), np.ascontiguousarray(part).tobytes()))]
            sizes.append(size)
        gain = np.maximum(sizes[1] - sizes[0], 0)
        order = np.lexsort((-gain, doc))
        gain, doc = gain[order], doc[order]
        first = np.searchsorted(doc, np.arange(n))
        rank = np.arange(len(doc)) - first[doc]
        for col, pick in ((0, rank < 8), (1, rank == 0), (2, rank == 1)):
            out[:, col] = np.bincount(doc[pick], gain[pick], n)
        out[:, 3] = np.log1p(np.bincount(doc[gain >= 2], minlength=n))
        out[:, 4] = np.log1p(np.bincount(doc, minlength=n))
        return out

    def score(self, texts: pa.Array) -> np.ndarray:
        w = np.asarray(self.weights)
        return 1 / (1 + np.exp(-np.clip(w[0] + self.features(texts) @ w[1:], -50, 50)))


def _surroundings(texts: list[bytes], chunk: int = 1 << 19) -> tuple[np.ndarray, np.ndarray]:
    """Every byte sequence of ``GRAM`` bytes, as a number, with the count of different surroundings it occurs in."""
    both, part, size = [], [], 0
    for last, t in zip([False] * len(texts) + [True], [*texts, b""]):
        part.append(t)
        size += len(t)
        if size < chunk and not last:
            continue
        a = np.frombuffer((b"\0" * (SIDE + GRAM)).join([b"", *part, b""]), np.uint8)
        a = np.where((a >= 9) & (a <= 13), 32, a).astype(np.uint64)
        n = len(a) - GRAM + 1
        gram, ok = np.zeros(n, np.uint64), np.ones(n, bool)
        for j in range(GRAM):
            gram = (gram << np.uint64(8)) | a[j:n + j]
            ok &= a[j:n + j] != 0
        at = np.flatnonzero(ok)
        around = np.zeros(len(at), np.uint64)
        for j in (*range(-SIDE, 0), *range(GRAM, GRAM + SIDE)):
            around = around * np.uint64(1099511628211) + a[at + j]
        around = (around ^ (around >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        both.append(np.unique((gram[at] << np.uint64(24)) | (around >> np.uint64(40))))
        part, size = [], 0
    pairs = np.concatenate(both)
    del both
    pairs.sort()
    fresh = np.concatenate((np.ones(min(len(pairs), 1), bool), pairs[1:] != pairs[:-1]))
    return np.unique(pairs[fresh] >> np.uint64(24), return_counts=True)


def _passages(toxic: list[bytes], ordinary: list[bytes], least: int, odds: float) -> list[bytes]:
    """The passages that tell toxic texts apart, rarest first.

    The log odds asked for grow with the number of toxic texts, up to ``odds``, but never beyond what a sequence absent from ordinary texts can
    show; its surprise decides then. In how many texts a passage must be is bounded by evidence likewise, not by its share alone.
    """
    odds = min(odds, 3.5 + 0.5 * np.log2(max(len(toxic), 32) / 32))
    gt, ct = _surroundings(toxic)
    go, co = _surroundings(ordinary)
    if not len(gt):
        return []
    i = np.minimum(np.searchsorted(go, gt), max(len(go) - 1, 0))
    here = np.where(go[i] == gt, co[i], 0) if len(go) else np.zeros(len(gt))
    share, both = ct.sum() / (ct.sum() + co.sum()), ct + here
    with np.errstate(divide="ignore", invalid="ignore"):
        surprise = ct * np.log(ct / (both * share)) + np.where(here > 0, here * np.log(here / (both * max(1 - share, 1e-9))), 0)
        more = np.log((ct + 0.5) / ct.sum()) - np.log((here + 0.5) / max(co.sum(), 1))
        most = np.log((ct + 0.5) / ct.sum()) - np.log(0.5 / max(co.sum(), 1))
    keep = (ct >= least) & ((more > odds) | (more >= most)) & (surprise > SURPRISE)
    count = {int(g).to_bytes(GRAM, "big"): int(c) for g, c in zip(gt[keep], ct[keep])}
    found: Counter[bytes] = Counter()
    for b in toxic:
        v = [count.get(b[i:i + GRAM], 0) for i in range(len(b) - GRAM + 1)]
        i, seen = 0, set()
        while i < len(v):
            if not v[i]:
                i += 1
                continue
            j = i
            while j < len(v) and v[j]:
                j += 1
            top = max(v[i:j])
            core = [k for k in range(i, j) if v[k] >= 0.8 * top]
            seen.add(b[core[0]:core[-1] + GRAM])
            i = j
        found.update(seen)
    there = b"\0".join(ordinary)
    rate = len(ordinary) / max(len(toxic), 1)
    enough = max(2, min(0.01 * len(toxic), SURPRISE / max(np.log1p(rate), 1e-9)))
    often = [(p, k) for p, k in found.most_common() if k >= enough]
    return [p for p, k in reversed(often) if there.count(p) <= 0.1 * k * rate]


def _newton(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -50, 50)))
        h = (a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w)) * 0.01
        step = np.linalg.solve(h, a.T @ (p - y) + 0.01 * ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def spread(text, longest: int):
    """``text``, or of one with more than ``longest`` characters windows of ``PIECE`` characters spread evenly from its head to its end."""
    n = max(2, longest // PIECE)
    room = F.length(text) - PIECE
    windows = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.substring(text, (F.floor(k * room / (n - 1)) + 1).cast("int"), F.lit(PIECE)))
    return F.when(F.length(text) > max(longest, n * PIECE), F.array_join(windows, " ")).otherwise(text)


def samples_of(text: bytes, most: int) -> list[bytes]:
    """At most ``most`` samples from the whole of ``text``, end to end where they cover it."""
    n = -(-len(text) // SAMPLE)
    if n <= most:
        return [text[i:i + SAMPLE] for i in range(0, len(text), SAMPLE)]
    return [text[i:i + SAMPLE] for i in (k * (len(text) - SAMPLE) // max(most - 1, 1) for k in range(most))]


def fit_toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic", key: str = "doc_id", max_docs: int = 4000, max_bytes: int = 3 << 20,
                 dictionary: int = 16384, least: int = 4, odds: float = 6.0, max_text: int = 16 << 10, text_samples: int = 5, max_samples: int = 8000) -> Toxicity:
    """Fits on at most ``max_docs`` labelled texts and ``max_bytes`` of each class (ordinary: twice as many), picked by a hash of ``key``.

    A text of more than ``max_text`` characters gives windows spread over the whole of it, so none uses up ``max_bytes``. The ordinary dictionary
    is trained on ``text_samples`` samples of each text, at most ``max_samples``; of more than ``dictionary`` bytes of toxic passages the rarest go.

    Three quarters train the dictionaries, one quarter calibrates. A document labelled more than once takes the larger
    label; labels other than 0 and 1, labels without a document and empty texts are left out. Without a text of either class the model
    scores every text alike, at a low score. The picked ids are a broadcast of at most three times ``max_docs`` rows; the texts are read in one scan.
    """
    import zstandard as z
    once = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.max(F.col(label).cast("int")).alias("y"))
    once = once.withColumn("h", F.xxhash64(F.lit(7), F.col("k").cast("string")))
    picked = [once.where(F.col("y") == y).orderBy("h", "k").limit(n) for y, n in ((1, max_docs), (0, 2 * max_docs))]
    texts = docs.select(F.col(key).alias("k"), text_or_empty(text).alias("x")).where(F.col("x") != "").join(F.broadcast(picked[0].unionByName(picked[1])), "k")
    texts = written(texts.select("y", "h", spread(F.col("x"), max_text).alias("x")), "labelled")
    parts = {}
    for y, times in ((1, 1), (0, 2)):
        # repeated ids come again, so the limit holds here too
        rows = texts.where(F.col("y") == y).orderBy("h", "x").limit(max_docs * times)
        got, used = [], 0
        for r in rows.select("x").toLocalIterator():
            got.append(r.x.encode().lower())
            used += len(got[-1])
            if used >= max_bytes * times:
                break
        parts[y] = got
    cut = {y: -(-3 * len(g) // 4) for y, g in parts.items()}
    toxic, ordinary = parts[1][:cut[1]], parts[0][:cut[0]]
    samples = [x for b in ordinary for x in samples_of(b, text_samples)][:max_samples]
    content = b"".join(samples)[:dictionary]
    if sum(map(len, samples)) > 20 * dictionary:
        content = z.train_dictionary(dictionary, samples, level=3).as_bytes()[-(dictionary - 3000):]
    passages, chosen = _passages(toxic, ordinary, least, odds), b""
    for p in passages:  # the most frequent ones last, so that a cut leaves them
        if p not in chosen:
            chosen += p
    model = Toxicity(content, chosen[-dictionary:])
    if not toxic or not ordinary:
        return model
    held = parts[1][cut[1]:] + parts[0][cut[0]:]
    y = np.array([1.0] * (len(parts[1]) - cut[1]) + [0.0] * (len(parts[0]) - cut[0]))
    if not (0 < y.sum() < len(y)):
        held, y = toxic + ordinary, np.array([1.0] * len(toxic) + [0.0] * len(ordinary))
    x = np.vstack([model.features(pa.array([h.decode() for h in held[i:i + 500]], pa.string())) for i in range(0, len(held), 500)])
    model.weights = _newton(x, y).tolist()
    return model


def score_toxicity(docs: DataFrame, model: Toxicity, text: str = "text", output: str = "score") -> DataFrame:
    """``docs`` with ``output`` (double, 0 to 1). One narrow pass; null and empty texts get the score of a text without windows.

    A column of the same name (without regard to case) is replaced; all others stay, in order.
    """
    held = docs.drop(*[c for c in docs.columns if c.lower() == output.lower() and c != text])
    work = free_name(held, "scored_text")
    schema = held.withColumn(output, F.lit(0.0)).schema

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        score = pa.array(model.score(b.column(b.num_columns - 1)), pa.float64())
        return pa.RecordBatch.from_arrays([*b.columns[:-1], score], names=[*b.schema.names[:-1], output])

    return held.withColumn(work, text_or_empty(text)).mapInArrow(per_batch(run, 512), schema)


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def op6_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~held_out())
    model = fit_toxicity(docs, labels)
    scored = score_toxicity(docs, model).drop("text")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
