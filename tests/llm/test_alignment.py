"""Token alignment against a plain loop over documents."""

import hashlib
from bisect import bisect
from collections import Counter
from itertools import product

import public_tokenizers
import pytest

from talkgrid.llm import alignment, bytelevel
from talkgrid.llm.alignment import align_tokenizers, op13_query

BYTE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def by_hand(rows):
    """``doc_id -> measures`` for ``[(doc_id, text)]``, with the libraries and dictionaries alone."""
    import json

    import sentencepiece
    from tokenizers import Tokenizer
    a = Tokenizer.from_file(BYTE)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    shown = [x for x in range(256) if 33 <= x <= 126 or 161 <= x <= 172 or x >= 174]
    letters = {chr(x): x for x in shown} | {chr(256 + i): x for i, x in enumerate(sorted(set(range(256)) - set(shown)))}
    names = {i: p for p, i in json.load(open(BYTE))["model"]["vocab"].items()}
    token_a = lambda i: bytes(letters[c] for c in names[i])
    token_b = lambda i: bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    links, groups, counts = {}, {}, Counter()
    for k, (_, text) in enumerate(rows):
        text = text or ""
        ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        pieces = [token_a(i) for i in ids[0]], [token_b(i) for i in ids[1]]
        if not text or any(b"".join(p) != (" " + text).encode() for p in pieces):
            links[k], groups[k] = Counter(), []
            continue
        ends = []
        for p in pieces:
            at, out = 0, []
            for x in p:
                at += len(x)
                out.append(at)
            ends.append(out)
        cuts = sorted(set(ends[0]) & set(ends[1]))
        at = [[bisect(e, c) for c in (0, *cuts)] for e in ends]
        groups[k] = [tuple(i[lo:hi] for i, lo, hi in zip(ids, (at[0][g], at[1][g]), (at[0][g + 1], at[1][g + 1]))) for g in range(len(cuts))]
        links[k] = Counter(p for g in groups[k] for p in product(*g))
        counts.update(links[k].keys())
    top = {}
    for (x, _), n in counts.items():
        top[x] = max(top.get(x, 0), n)
    out = []
    for k, (doc, _) in enumerate(rows):
        g, c = groups[k], links[k]
        form = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        out.append((doc, sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), sum(c.values()), sum(n for p, n in c.items() if counts[p] == top[p[0]]),
                    sum(n * counts[p] for p, n in c.items()), hashlib.sha256(form.encode()).hexdigest() if g else ""))
    return sorted(out, key=repr)


def got(df):
    return sorted([tuple(r) for r in df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()], key=repr)


def test_given_documents(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert got(op13_query(spark, sf)) == by_hand(rows)


AWKWARD = ["", None, " ", "a", "  two  spaces  ", "tab\tand\n\nlines", "\x00nul", "under▁score", "<|endoftext|> and <s> </s> <0x41>", "naïve Ωmega 日本語テキスト", "🙂🙂👩‍👩‍👧 end",
           "x" * 5000, " " * 5000, "ab " * 3000, "日" * 3000, "same text", "same text", "same text", "é combining   nbsp 　 wide", "\r\n crlf \x85 nel"]


def test_awkward_texts(spark):
    rows = list(enumerate(AWKWARD)) + [(3, "a"), (3, "other text"), (None, "no id"), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert got(align_tokenizers(df, BYTE, PIECE)) == by_hand(rows)
    # small chunks: counts meet again over chunks
    assert got(align_tokenizers(df, BYTE, PIECE, chunk_bytes=1)) == by_hand(rows)


def test_wide_groups_and_no_fast_path(spark, monkeypatch):
    rows = list(enumerate(AWKWARD))
    aligner = alignment.Aligner(bytelevel.ByteLevel(open(BYTE, "rb").read(), special=False), alignment.PieceSide(open(PIECE, "rb").read()))
    texts = [t or "" for t in AWKWARD]
    plain = aligner.align(texts)
    monkeypatch.setattr(alignment, "WIDE_GROUP", 0)
    aligner.a.fast = None
    wide = aligner.align(texts)
    for k in plain:
        assert list(plain[k]) == list(wide[k]), k
    assert len(rows) == len(plain["n_a"])


def test_empty_table_and_clashing_columns(spark):
    assert align_tokenizers(spark.createDataFrame([], "doc_id bigint, text string"), BYTE, PIECE).count() == 0
    df = spark.createDataFrame([(1, "one two", "s", 5, {"a": 1})], "doc_id bigint, text string, sha string, COPIES int, x map<string,int>")
    assert got(align_tokenizers(df, BYTE, PIECE)) == by_hand([(1, "one two")])


@pytest.mark.parametrize("text", ["a" * 4096, "a" * 4097, " " * 4097, "a b" * 3000])
def test_endless_words_go_to_the_library(text):
    assert bytelevel.endless(text) == (max((len(w) for w in text.split()), default=0) > 4096 or text.isspace())
