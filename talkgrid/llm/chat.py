"""Chat formatting with typed content parts.

A message is a list of parts: text, image, audio or document. A visitor flattens them in order: text is escaped, any
other part becomes a placeholder ``<|image:0|>`` whose number counts the attachments of the conversation, and its reference,
place and expanded token count are recorded. A turn reads

    <turn ROLE>
    BODY</turn>

A backslash before ``\\``, ``<`` and ``>`` escapes them in roles and texts, so no text can end a turn, open one or fake
a placeholder, and reading back gives exactly what was written.

Conversations are formatted in order of turn, one task streaming over whole sorted conversations with memory for one page. A
conversation longer than ``page_chars`` comes in several pages, cut between turns.
"""

from __future__ import annotations

import hashlib
import math
import re
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import table

PART = "struct<kind:string,text:string,uri:string,width:int,height:int,seconds:double,pages:int>"
PAGE = ("conv_id bigint, page int, n_turns bigint, formatted string, loss_spans array<struct<start:bigint,stop:bigint>>, "
        "attachments array<struct<number:int,kind:string,uri:string,at:bigint,tokens:bigint>>, expanded_tokens bigint")
PAGE_ARROW = pa.schema([
    ("conv_id", pa.int64()), ("page", pa.int32()), ("n_turns", pa.int64()), ("formatted", pa.string()),
    ("loss_spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
    ("attachments", pa.list_(pa.struct([("number", pa.int32()), ("kind", pa.string()), ("uri", pa.string()), ("at", pa.int64()), ("tokens", pa.int64())]))),
    ("expanded_tokens", pa.int64())])
SPECIAL = re.compile(r"[\\<>]")
ESCAPED = re.compile(r"\\(.)", re.S)
TURN = re.compile(r"<turn ((?:[^\\>]++|\\.)*+)>\n((?:[^\\<]++|\\.|<\|[a-z]+:[0-9]+\|>)*+)</turn>\n", re.S)
PLACEHOLDER = re.compile(r"\\.|<\|([a-z]+):([0-9]+)\|>", re.S)


def escape(text: str) -> str:
    return SPECIAL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


@dataclass(frozen=True)
class TokenRates:
    """How many tokens an attachment stands for: an image by tiles, audio by seconds, a document by pages; each at least one."""

    tile: int = 14 * 16
    per_tile: int = 256
    per_second: float = 25.0
    per_page: int = 1024


@dataclass
class PartVisitor:
    """Flattens the parts of one conversation; one method per kind of part."""

    rates: TokenRates = TokenRates()
    attachments: list[dict] = field(default_factory=list)
    number: int = 0

    def visit(self, part: dict, at: int) -> str:
        """What the part adds to a body that begins at ``at``; unknown kinds count as documents of one page."""
        kind = (part.get("kind") or "text").lower()
        return getattr(self, f"visit_{kind}", self.visit_document)(part, at)

    def visit_text(self, part: dict, at: int) -> str:
        return escape(part.get("text") or "")

    def visit_image(self, part: dict, at: int) -> str:
        r = self.rates
        tiles = max(1, math.ceil((part.get("width") or 1) / r.tile)) * max(1, math.ceil((part.get("height") or 1) / r.tile))
        return self._attach("image", part, at, tiles * r.per_tile)

    def visit_audio(self, part: dict, at: int) -> str:
        seconds = part.get("seconds") or 0.0
        return self._attach("audio", part, at, math.ceil((seconds if math.isfinite(seconds) else 0.0) * self.rates.per_second))

    def visit_document(self, part: dict, at: int) -> str:
        return self._attach("document", part, at, max(1, part.get("pages") or 1) * self.rates.per_page)

    def _attach(self, kind: str, part: dict, at: int, tokens: int) -> str:
        n, self.number = self.number, self.number + 1
        self.attachments.append({"number": n, "kind": kind, "uri": part.get("uri"), "at": at, "tokens": max(1, tokens)})
        return f"<|{kind}:{n}|>"


class _Page:
    def __init__(self, conv, page):
        self.conv, self.page, self.turns, self.at, self.out, self.loss, self.attachments = conv, page, 0, 0, [], [], []

    def add(self, role: str, parts, visitor: PartVisitor, learn: frozenset[str]) -> None:
        head = f"<turn {escape(role)}>\n"
        at = self.at + len(head)
        body = []
        for part in parts if parts is not None else ():
            if part is not None:
                body.append(visitor.visit(part, at + sum(map(len, body))))
        text = "".join(body)
        if role in learn:
            self.loss.append({"start": at, "stop": at + len(text)})
        self.out += [head, text, "</turn>\n"]
        self.at = at + len(text) + 8
        self.turns += 1
        self.attachments += visitor.attachments
        visitor.attachments.clear()

    def row(self) -> dict:
        return {"conv_id": self.conv, "page": self.page, "n_turns": self.turns, "formatted": "".join(self.out), "loss_spans": self.loss,
                "attachments": self.attachments, "expanded_tokens": sum(a["tokens"] for a in self.attachments)}


def format_conversations(messages: DataFrame, learn: tuple[str, ...] = ("assistant",), rates: TokenRates = TokenRates(), page_chars: int = 4 << 20) -> DataFrame:
    """Pages of formatted conversations from ``messages(conv_id, turn, role, parts)``; more columns are ignored.

    Turns come in order of ``turn`` (null last), equal ones by role, then parts. A null role is the empty role, null parts are none, a null part
    or null text adds nothing; rows without a conversation id form one conversation. Repeated rows are repeated turns.
    """
    d = messages.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit("")).alias("role"),
                        F.col("parts").cast(f"array<{PART}>").alias("parts"))
    n = int(d.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = d.repartition(n, "conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_last(), "role", "parts")
    who = frozenset(learn)

    def run(batches):
        page, visitor, rows, held = None, None, [], 0
        for b in batches:
            for conv, role, parts in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                if page is None or page.conv != conv:
                    if page is not None:
                        rows.append(page.row())
                        held += page.at
                    page, visitor = _Page(conv, 0), PartVisitor(rates)
                elif page.at >= page_chars:
                    rows.append(page.row())
                    held += page.at
                    page = _Page(conv, page.page + 1)
                if held >= page_chars or len(rows) >= 1024:
                    yield pa.RecordBatch.from_pylist(rows, PAGE_ARROW)
                    rows, held = [], 0
                page.add(role, parts, visitor, who)
        if page is not None:
            rows.append(page.row())
            yield pa.RecordBatch.from_pylist(rows, PAGE_ARROW)

    return d.mapInArrow(run, PAGE)


def read_turns(formatted: str) -> list[tuple[str, str, list[str], int, int]]:
    """``(role, text, placeholders, start, stop)`` of every turn of a page; ``start`` to ``stop`` is the body as it stands there."""
    out, at = [], 0
    while at < len(formatted):
        m = TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        body = m[2]
        marks = [p[0] for p in PLACEHOLDER.finditer(body) if p[1]]
        text = unescape(PLACEHOLDER.sub(lambda p: "" if p[1] else p[0], body)) if marks else unescape(body)
        out.append((unescape(m[1]), text, marks, m.start(2), m.end(2)))
        at = m.end()
    return out


def conversation_digests(pages: DataFrame) -> DataFrame:
    """Per conversation, read back from its pages: number of turns, hashes of all turns and of the text under the loss mask, lengths."""
    n = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = pages.select("conv_id", "page", "formatted", "loss_spans").repartition(n, "conv_id").sortWithinPartitions("conv_id", "page")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches):
        now, rows = None, []
        close = lambda s: (s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5])
        for b in batches:
            for conv, text, spans in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                if now is None or now[0] != conv:
                    if now is not None:
                        rows.append(close(now))
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said, _, _, _ in read_turns(text):
                    now[1] += 1
                    now[2].update(f"{role}\n{said}\n".encode())
                for s in spans:
                    part = text[s["start"]:s["stop"]]
                    part = unescape(PLACEHOLDER.sub(lambda p: "" if p[1] else p[0], part))
                    now[3] += len(part)
                    now[4].update(part.encode())
                now[5] += len(text)
            if rows:
                yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=names), preserve_index=False)
                rows = []
        if now is not None:
            yield pa.RecordBatch.from_pandas(pd.DataFrame([close(now)], columns=names), preserve_index=False)

    return d.mapInArrow(run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def text_part(text: Column) -> Column:
    """A list with one text part."""
    null = F.lit(None)
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), null.cast("string").alias("uri"), null.cast("int").alias("width"),
                            null.cast("int").alias("height"), null.cast("double").alias("seconds"), null.cast("int").alias("pages")))


def op1_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return conversation_digests(format_conversations(rows.select("conv_id", "turn", "role", text_part(F.coalesce("text", F.lit(""))).alias("parts"))))
