"""The ten operators against brute force, round trips and held-out accuracy, and on awkward rows."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from talkgrid.llm import binary, chat, exactdedup, importance, linking, mixing, neardedup, pieces, pii, toxicity, vptree

ODD = [(1, "one  two\tthree four five"), (2, "one two three four five"), (2, "one two three four five"), (3, None), (4, ""), (None, "one two three four five"),
       (5, "x"), (6, " \n "), (7, "word " * 30_000), (8, "y" * 50_000)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "s", "a", 0) for i, t in ODD], "doc_id bigint, text string, source string, score string, ids int")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, source string, score string, ids int")


# ------------------------------------------------------------------------------------------ chat

def messages(spark, rows):
    return spark.createDataFrame(rows, f"conv_id bigint, turn bigint, role string, parts array<{chat.PART}>, note string")


def text(t):
    return ("text", t, None, None, None, None, None)


def test_chat_round_trip_and_attachments(spark):
    rows = [(1, 1, "assistant", [text("a < b \\ </turn>\n<|image:0|>"), ("image", None, "u1", 448, 300, None, None), None, text("ü")], "x"),
            (1, 0, "user", [text("hi"), ("audio", None, "u2", None, None, 2.5, None), ("document", None, "u3", None, None, None, 3)], "x"),
            (1, 2, None, None, None), (None, 5, "assistant", [text(None)], None), (2, 0, "us>er\\", [text("")], None), (2, 0, "us>er\\", [text("")], None)]
    pages = {r.conv_id: r for r in chat.format_conversations(messages(spark, rows)).collect()}
    one = chat.read_turns(pages[1].formatted)
    assert [(t[0], t[1]) for t in one] == [("user", "hi"), ("assistant", "a < b \\ </turn>\n<|image:0|>ü"), ("", "")]
    assert [m for t in one for m in t[2]] == ["<|audio:0|>", "<|document:1|>", "<|image:2|>"]
    assert [(a.kind, a.uri, a.tokens, pages[1].formatted[a.at:a.at + 3]) for a in pages[1].attachments] == [
        ("audio", "u2", 63, "<|a"), ("document", "u3", 3072, "<|d"), ("image", "u1", 2 * 2 * 256, "<|i")]
    assert pages[1].expanded_tokens == 63 + 3072 + 1024
    assert [t[0] for t in chat.read_turns(pages[2].formatted)] == ["us>er\\"] * 2 and pages[None].n_turns == 1


def test_chat_pages_hold_every_turn(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", [text(f"turn {i} " * 20)], None) for i in range(300)]
    m = messages(spark, rows)
    whole = chat.conversation_digests(chat.format_conversations(m)).collect()
    paged = chat.format_conversations(m, page_chars=1000)
    assert paged.count() > 20 and chat.conversation_digests(paged).collect() == whole
    said = "".join(f"turn {i} " * 20 for i in range(1, 300, 2))
    assert whole[0].loss_sha256 == hashlib.sha256(said.encode()).hexdigest() and whole[0].loss_chars == len(said)
    assert chat.conversation_digests(chat.format_conversations(m.limit(0))).collect() == []


# ------------------------------------------------------------------------------- personal data

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(v - 9 if v > 9 else v for v in (int(c) * (2 if i % 2 else 1) for i, c in enumerate(reversed(d)))) % 10 == 0


def base_spans(t):
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, t):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and 13 <= len(d) <= 19 and luhn(d) or kind == "phone" and 9 <= len(d) <= 15:
                yield f"{kind}:{m.start()}:{m.end()}"


def test_pii_base_spans_equal_brute_force(spark, monkeypatch):
    random.seed(3)
    bits = [*"0123456789" * 2, "+", ".", "-", " ", "(", ")", "@", "a", "b", "é", "😀", "\n", "4111111111111111", "1.2.3.4", "+1 (222) 555-1234", "x@y.z", "_", "256", "0000", "(at)", "[dot]"]
    rows = [(i, "".join(random.choices(bits, k=random.randint(0, 50)))) for i in range(600)]
    rows += [(900, None), (901, ""), (901, ""), (902, "1 " * 40_000), (903, "1." * 40_000), (904, "a" * 60_000), (905, "+1" + "(" * 60_000), (906, "a@b" * 20_000), (None, "x@y.zz")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    monkeypatch.setattr(pii, "table", lambda *a: df)
    got = pii.op2_query(spark, "").collect()
    assert len(got) == len(rows)
    want = defaultdict(list)
    for i, t in rows:
        want[i].append(hashlib.sha256(",".join(base_spans(t or "")).encode()).hexdigest())
    for r in got:
        assert r.base_sha256 in want[r.doc_id], r
        mine = [s for s in r.spans.split(",") if s]
        assert {s for s in base_spans(next(t or "" for i, t in rows if i == r.doc_id))} <= set(mine)
    redacted = df.where("doc_id is null").select(pii.redact(F.col("text"), F.array(F.struct(F.lit("email").alias("kind"), F.lit(0).alias("start"), F.lit(6).alias("stop"))))).first()[0]
    assert redacted == "[EMAIL]"
    assert pii.find_spans(df.limit(0)).count() == 0


def with_luhn(d):
    return next(d + str(k) for k in range(10) if luhn(d + str(k)))


@pytest.mark.parametrize("percent", [1, 30])
def test_pii_adds_obfuscated_spans_however_many_there_are(spark, percent):
    random.seed(percent)
    number = lambda n: "".join(random.choices("123456789", k=n))
    rows, planted, wrong = [], {}, {}
    for i in range(1200):
        name, host, octets = f"user{number(3)}", f"host{number(2)}", [str(random.randint(10, 255)) for _ in range(4)]
        card = with_luhn(number(15))
        fours, bad = [card[k:k + 4] for k in range(0, 16, 4)], card[:15] + str((int(card[15]) + 1) % 10)
        if i % 100 < percent:
            said = [f"{name} [at] {host} [dot] org", ".".join(fours), f"2{number(2)}-{number(3)}-{number(4)}", "-".join(octets)][i // 100 % 4]
            planted[i] = said
        elif i % 5 == 4:
            said = wrong[i] = bad
        else:
            said = [f"{name}@{host}.org", " ".join(fours), f"+1 2{number(2)} {number(3)} {number(4)}", ".".join(octets)][i % 4]
        rows.append((i, f"some words before {said} and some words after"))
    got = defaultdict(list)
    for r in pii.find_spans(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).where("kind is not null").collect():
        got[r.doc_id].append((r.start, r.stop))
    assert sum((18, 18 + len(s)) in got[i] for i, s in planted.items()) >= 0.9 * len(planted)
    assert sum(bool(got[i]) for i in wrong) <= 0.02 * len(wrong)


def test_pii_learns_from_every_candidate(spark, monkeypatch):
    """30,000 right and 12,000 wrong proposals: as many rows are learnt from, and the right ones spoiled."""
    p = spark.range(42_000).select(F.col("id").alias("row"), F.lit("ip").alias("kind"), F.lit(False).alias("base"), F.lit(0).cast("bigint").alias("start"), F.lit("10.0.0.1").alias("said"),
                                   F.col("id").cast("string").alias("left"), F.lit("").alias("right"), (F.col("id") < 30_000).alias("same"), (F.col("id") >= 30_000).alias("failed"), F.lit(False).alias("near"))
    seen, whole = [], pii.features
    monkeypatch.setattr(pii, "features", lambda c: seen.append({r.label: r.n for r in c.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}) or whole(c))
    model = pii.fit_booster(p, trees=2)
    assert seen == [{1.0: 30_000, 0.0: 42_000}] and model.trees.getNumTrees == 2


def test_pii_overlaps_count_against_kept_spans_only(spark):
    spans = spark.createDataFrame([(1, 7, "phone", False, 0, 10), (1, 7, "card", False, 5, 15), (1, 7, "ip", False, 12, 20), (1, 7, "ip", False, 30, 40)],
                                  "row bigint, doc_id bigint, kind string, base boolean, start bigint, stop bigint")
    assert sorted((r.start, r.stop) for r in pii.disjoint(spans).collect()) == [(0, 10), (12, 20), (30, 40)]


# --------------------------------------------------------------------------------- tokenizers

UNITS = ["a", " ", "  ", "\n", "\t", " t", "the", "ing", "▁", "é", "ñ", "你", "　", "0", ".", ",", "'s", "\0", "ＡＢ", "\x1f", "\x85", " \n", "print", "(self", "    ", "😀", "​", " ", "<|endoftext|>"]


def test_prefix_table_equals_the_library():
    t = pieces.prefix_table(pieces.model_bytes(pieces.piece_model()))
    random.seed(1)
    texts = ["".join(random.choices(UNITS, k=random.randint(0, 40))) for _ in range(3000)] + ["", " ", "x" * 20_000, "word " * 5_000]
    got = [np.frombuffer(g, np.int32).tolist() for g in t.encode(texts)]
    assert got == t.library.encode(texts, num_threads=1)
    for s in ("strawberries", "aaaaaaaa", "hello"):
        ids = t.library.encode(s)
        assert all(t.compatible(a, b) for a, b in zip(ids, ids[1:]))


def test_encode_and_decode_keep_rows_and_columns(spark, odd, none):
    path = pieces.piece_model()
    both = pieces.decode_pieces(pieces.encode_pieces(odd, path), path)
    assert pieces.encode_pieces(odd, path, decoded="decoded").collect() == both.collect()
    assert both.columns == ["doc_id", "text", "source", "score", "ids", "decoded"]
    for r in both.collect():
        assert r.decoded == (r.text or "") and (r.ids == []) == (not r.text)
    assert pieces.encode_pieces(none, path).collect() == []


def test_byte_encoder_equals_the_library():
    from tokenizers import Tokenizer
    model = pieces.model_bytes(binary.byte_model())
    random.seed(2)
    texts = ["".join(random.choices(UNITS, k=random.randint(0, 30))) for _ in range(3000)] + ["", " ", "word " * 3_000]
    encoder = binary.byte_encoder(model)
    assert encoder.fast is not None
    got = encoder.encode(texts)
    assert got == [e.ids for e in Tokenizer.from_buffer(model).encode_batch(texts, add_special_tokens=False)]


def test_sequences_read_back(spark, odd, none, tmp_path):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(binary.byte_model())
    folder = str(tmp_path / "s")
    files = binary.write_sequences(odd, folder, binary.byte_model(), length=16, rows=4, files=3)
    got = binary.read_sequences(spark, folder, files).orderBy("start").collect()
    rows = sorted(ODD, key=lambda r: (r[0] is None, r[0] or 0))
    start = 0
    for r, (i, x) in zip(got, rows, strict=True):
        ids = t.encode(x or "", add_special_tokens=False).ids + [2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    system, root = binary._open(folder)
    listed = files.orderBy("file").collect()
    reader = binary.SequenceReader(system, f"{root}/{listed[0].file}.arrow")
    ids, mask = reader.sequence(0)
    assert len(ids) == 16 and mask.all() and (ids == np.concatenate(list(reader.ids(0, 16)))).all() and ids.dtype == np.uint16
    last_ids, last_mask = reader.sequence((listed[0].ids - 1) // 16)
    assert mask.sum() == 16 and last_mask.sum() == (listed[0].ids - 1) % 16 + 1
    folder = str(tmp_path / "n")
    assert binary.read_sequences(spark, folder, binary.write_sequences(none, folder, binary.byte_model())).collect() == []


# ------------------------------------------------------------------------------ nearest neighbours

def test_vantage_trees(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 8)) * rng.uniform(0.5, 2, size=(3000, 1))
    x[100:1100] = x[5]  # a third of the rows is one vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5001, [0.0] * 8), (5002, [float("nan")] + [1.0] * 7), (5003, [None] + [1.0] * 7), (5004, [1.0, 2.0]), (7, x[7].tolist())]
    v = vptree.usable(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(4))
    assert v.count() == 3001
    q = v.where("id % 20 = 0")
    got = defaultdict(list)
    for r in vptree.nearest(v, q, factor=1.0, leaf=64).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    wanted = lambda i: sorted(((-float((x[i] * x[j]).sum()), j) for j in range(3000) if j != i))[:20]
    hits = 0
    loose = defaultdict(set)
    for r in vptree.nearest(v, q, factor=1.5, leaf=64).collect():
        loose[r.query_id].add(r.vec_id)
    for i in range(0, 3000, 20):
        want = wanted(i)
        assert [j for j, _ in got[i]] == [j for _, j in want], i
        assert np.allclose([s for _, s in got[i]], [-s for s, _ in want], atol=1e-12)
        hits += len(loose[i] & {j for _, j in want})
    assert hits / (150 * 20) > 0.9 and 5004 not in got
    assert vptree.nearest(v.where("id < 3"), v.where("id = 0")).count() == 2 and vptree.nearest(v.limit(0), v.limit(0)).count() == 0


# -------------------------------------------------------------------------------- duplicates

def shingles(t, k):
    w = (t or "").encode().lower().split()
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def near_brute(rows, k, percent):
    sets = [(i, shingles(t, k)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets}


def test_near_duplicates_equal_brute_force(spark):
    random.seed(5)
    words = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    for size in (30, 60, 200):
        for _ in range(12):
            base = random.choices(words, k=size)
            for edits in range(0, 8):
                t = list(base)
                for _ in range(edits):
                    t[random.randrange(size)] = random.choice(words)
                rows.append((n, " ".join(t)))
                n += 1
    hot = random.choices(words, k=120)
    for _ in range(150):  # one large group
        t = list(hot)
        t[random.randrange(120)] = random.choice(words)
        rows.append((n, " ".join(t).upper() if n % 3 else " ".join(t)))
        n += 1
    passage = " ".join(random.choices(words, k=15))
    for _ in range(150):  # a passage that unrelated texts share
        rows.append((n, passage + " " + " ".join(random.choices(words, k=30))))
        n += 1
    rows += [(n, "a b"), (n + 1, "A  b"), (n + 2, ""), (n + 3, " "), (n + 4, None)]
    random.shuffle(rows)
    want = near_brute(rows, 4, 80)
    got = neardedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5), words=4).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_on_awkward_rows(odd, none):
    got = neardedup.near_duplicates(odd, words=4).collect()
    assert len(got) == len(ODD) and {r.component_id for r in got if r.doc_id in (1, 2)} == {1}
    assert [r.component_id for r in got if r.doc_id is None] == [None] and all(r.kept for r in got if r.doc_id in (None, 3, 4, 5, 6, 7, 8))
    assert neardedup.near_duplicates(none).count() == 0
    assert neardedup.least_collisions(32, 0.8) == 13


def test_near_duplicates_whose_id_hashes_to_the_first_bit(spark):
    first = 25317696  # the first of consecutive ids whose hash is 0 in the bitmap of wanted documents
    assert spark.range(first, first + 1).select(F.pmod(F.xxhash64("id"), F.lit(linking.FILTER_BITS))).first()[0] == 0
    words = [f"w{i}" for i in range(100)]
    rows = [(first, " ".join(words)), (first + 1, " ".join([*words, "more"])), (first + 2, "quite another text of a few words")]
    got = neardedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), words=4).collect()
    assert {r.doc_id: r.component_id for r in got} == {first: first, first + 1: first, first + 2: first + 2}


def test_exact_duplicates(spark, odd, none):
    for bits in (64, 2):  # two bits: almost every key collides, chains tell texts apart
        got = exactdedup.exact_duplicates(odd, capacity=1, key_bits=bits).collect()
        assert len(got) == len(ODD)
        by = defaultdict(list)
        for r in got:
            by[r.text_sha256].append(r)
        want = defaultdict(list)
        for i, t in ODD:
            want[hashlib.sha256(re.sub("[\x20\x09-\x0d]+", " ", t or "").encode()).hexdigest()].append(i)
        assert set(by) == set(want)
        for sha, ids in want.items():
            known = [i for i in ids if i is not None]
            assert all(r.keep_id == min(known, default=None) and r.group_size == len(ids) and r.kept == (r.doc_id == r.keep_id) for r in by[sha])
    assert exactdedup.exact_duplicates(none).count() == 0


def test_directory_splits_until_buckets_fit(spark):
    keys = spark.range(5000).select(F.shiftright(F.xxhash64("id"), 20).alias("key"))  # crowded: the top bits are the sign
    d = exactdedup.build_directory(keys.distinct(), capacity=64).collect()
    assert sum(r.entries for r in d) == keys.distinct().count() and all(r.entries <= 64 for r in d) and len({r.depth for r in d}) > 1
    assert all(len(r.bucket) == r.depth for r in d)


# ------------------------------------------------------------------------------------- toxicity

def test_toxicity_on_held_out_rows(spark):
    random.seed(7)
    syll = ["an", "the", "ing", "er", "ti", "on", "re", "ou", "st", "ha"]
    word = lambda: "".join(random.choices(syll, k=random.randint(1, 4)))
    insults = ["moron", "idiot", "scum", "worthless"]
    rows, labels = [], []
    for i in range(1600):
        w = [word() for _ in range(random.randint(20, 200))]
        y = int(i % 5 == 0)
        for _ in range(4 * y):
            w[random.randrange(len(w))] = random.choice(insults)
        rows.append((i, " ".join(w)))
        labels.append((i, y))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    known = spark.createDataFrame([*labels[:800], (3, None), (None, 1), (99_999, 1)], "doc_id bigint, toxic int")
    model = toxicity.fit_toxicity(docs, known)
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, model).collect()}
    bad, fine = [[got[i] for i, y in labels[800:] if y == k] for k in (1, 0)]
    assert np.mean([[b > f for f in fine] for b in bad]) > 0.95


def test_toxicity_on_awkward_rows(spark, odd, none):
    labels = spark.createDataFrame([], "doc_id bigint, toxic int")
    model = toxicity.fit_toxicity(odd, labels)
    got = toxicity.score_toxicity(odd, model)
    assert got.columns == ["doc_id", "text", "source", "ids", "score"] and got.count() == len(ODD)
    assert all(0 <= r.score <= 1 for r in got.collect())
    assert toxicity.score_toxicity(none, model).count() == 0
    seg, doc = model.windows(*pieces_of(["a" * 3000 + " b", "", "c d"]))
    assert seg[:, 1].max() <= model.longest + 16 and set(doc) == {0, 2}


def test_toxicity_learns_beside_one_very_long_text(spark):
    random.seed(5)
    words = [a + b + c for a in ("ri", "sto", "ta", "win") for b in ("ver", "ne", "ble", "dow") for c in ("s", "ly", "ed", "er")]
    some = lambda n: " ".join(random.choices(words, k=n))
    rows = [(i, f"{some(15)} {'zqxvkj' if i % 2 else ''} {some(15)}", i % 2) for i in range(400)] + [(1000 + i, some(500_000), 1) for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    model = toxicity.fit_toxicity(df, df.select("doc_id", "toxic"))
    assert b"zqxvkj" in model.toxic
    long = " ".join(map(str, range(100_000)))
    cut = spark.createDataFrame([(long,)], "x string").select(toxicity.spread(F.col("x"), 16384)).first()[0]
    assert cut.startswith(long[:1024]) and cut.endswith(long[-1024:]) and len(cut) < 17_000
    assert toxicity.samples_of(b"a" * 9000 + b"end", 5)[-1].endswith(b"end")


def test_toxicity_keeps_rare_wording_among_many_toxic_texts():
    random.seed(6)
    words = [a + b + c for a in ("ri", "sto", "ta", "win") for b in ("ver", "ne", "ble", "dow") for c in ("s", "ly", "ed", "er")]
    some = lambda n: " ".join(random.choices(words, k=n)).encode()
    toxic = [some(6) + (b" zqxvkj " if i < 29 else b" moronic " if i % 2 else b" ") + some(6) for i in range(3000)]
    got = toxicity._passages(toxic, [some(12) for _ in range(6000)], 4, 6.0)
    assert any(b"zqxvkj" in p for p in got) and any(b"moronic" in p for p in got)


def pieces_of(texts):
    from talkgrid.llm.common import text_bytes
    return text_bytes(pa.array(texts))


# ---------------------------------------------------------------------------------------- mixing

def test_targets_fill_up_and_stop_at_three_times(spark):
    sizes = [("a", 10), ("b", 1000), ("c", 50), ("d", 0), ("e", 300), (None, 200)]
    got = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(sizes, "source string, source_size bigint")).collect()}
    weight = {s: 1 + i % 3 for i, s in enumerate(["a", "b", "c", "d", "e", None])}
    total, size = 1560.0, dict(sizes)
    target = {s: 0.0 for s in size}
    free = set(size)
    while True:  # share, cut at three times, share the rest again
        left = total - sum(target[s] for s in size if s not in free)
        share = {s: left * weight[s] / sum(weight[t] for t in free) for s in free}
        over = {s for s in free if share[s] > 3 * size[s]}
        if not over:
            target.update(share)
            break
        for s in over:
            target[s] = 3.0 * size[s]
        free -= over
    assert {s: round(v, 6) for s, v in got.items()} == {s: round(v, 6) for s, v in target.items()}


def test_cube_sample_keeps_both_totals(spark):
    rng = np.random.default_rng(1)
    size, p = rng.integers(1, 500, 4000), rng.uniform(0, 1, 4000)
    units = spark.createDataFrame([("g" if i % 3 else "h", i, 0, float(size[i]), float(p[i])) for i in range(4000)], "g string, u1 bigint, u2 bigint, size double, p double")
    got = mixing.cube_sample(units, "g", block=256).collect()
    assert len(got) == 4000
    for g in ("g", "h"):
        at = np.array([r.u1 for r in got if r.g == g])
        taken = np.array([r.taken for r in got if r.g == g])
        assert abs((size[at] * (taken - p[at])).sum()) < 500 and abs((taken - p[at]).sum()) < 8
    flown = mixing.fly(p, size, rng.uniform(size=4000))
    assert ((flown > 1e-9) & (flown < 1 - 1e-9)).sum() <= 2 and abs(flown.sum() - p.sum()) < 1e-6 and abs((flown * size).sum() - (p * size).sum()) < 1e-3


def test_mix_of_awkward_rows(spark, odd, none):
    rows = odd.unionByName(spark.createDataFrame([(9, "a b c", None, "a", 0)] * 40, odd.schema))
    units = mixing.each_row(mixing.mix_units(rows)).collect()
    assert len(units) == len(ODD) + 40 and all(0 <= u.times <= 3 for u in units)
    assert abs(sum(u.times for u in units if u.doc_id == 9) * 3 - next(u.target for u in units if u.doc_id == 9)) <= 3
    mixed = mixing.mix(rows)
    assert mixed.columns == rows.columns and mixed.count() == sum(u.times for u in units)
    assert mixing.mix(rows).exceptAll(mixed).count() == 0 and mixing.mix(none).count() == 0


# ---------------------------------------------------------------------------- importance resampling

def test_importance_prefers_what_the_target_holds(spark, odd, none):
    random.seed(9)
    rows = [(i, " ".join(random.choices(["red", "green", "blue"] if i % 2 else ["cat", "dog", "cow"], k=30))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = importance.resample(docs, docs.where("doc_id % 2 = 1 and doc_id < 100"), share=0.5).collect()
    kept = [r.doc_id for r in got if r.kept]
    assert len(kept) == 200 and np.mean([i % 2 for i in kept]) > 0.95
    r = importance.resample(odd, odd.limit(0), share=0.5)
    assert r.count() == len(ODD) and all(x.log_weight == 0 for x in r.collect())
    assert importance.resample(none, none).count() == 0
    v = spark.createDataFrame([(float(x),) for x in [3, 1, 2, 2, 2, 9]], "v double")
    assert [importance.kth_largest(v, "v", k) for k in (1, 2, 3, 5, 6, 7)] == [9.0, 3.0, 2.0, 2.0, 1.0, None]
