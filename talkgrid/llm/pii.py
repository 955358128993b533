"""Personal data: candidate spans, boosted trees, calibrated thresholds. DataFrame functions and MLlib only.

*Base spans* of four kinds (email, ip, card, phone) follow fixed patterns and checks; they are always redacted. *Generators* with
looser patterns (obfuscated addresses, other separators, missing plus signs) propose further, overlapping spans. Gradient
boosted trees score every proposal by its format and surroundings. They learn from base spans, as they are and rewritten into
the loose forms, against what is known to be wrong: matches of a base pattern that fail its check, spans with a spoiled check digit, octet, host or bound, dates, and
addresses whose host cannot be one. What no check decides is in neither class. A threshold per kind, chosen on a held-out part for precision,
selects what is redacted besides; of overlapping selected spans the earlier stays, and nothing may touch a base span.

A text is read twice per region pattern (what matches, what lies between). All number-like kinds lie within runs of digits and their
separators, so only those runs are searched further. Repetitions in patterns are possessive or bounded: long runs
cost linear time and no stack. Positions are sums over the pieces of a text, as windows by row after one shuffle of the candidates; texts
themselves are not shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .common import table, text_or_empty, written

KINDS = ("email", "ip", "card", "phone")
LOCAL = r"[A-Za-z0-9._%+-]"
#: A match starts where the last one ended or at the head of a run, for no other start can match more.
BASE = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": rf"{LOCAL}{{1,64}}\x20?(?:@|[\[({{]\x20?(?:at|AT)\x20?[\])}}])\x20?[A-Za-z0-9-]{{1,63}}(?:\x20?(?:\.|[\[({{]\x20?(?:dot|DOT)\x20?[\])}}])\x20?[A-Za-z0-9-]{{1,63}}){{1,4}}",
    "ip": r"[0-9]{1,3}(?:\x20?[.-]\x20?[0-9]{1,3}){3}(?![0-9])",
    "card": r"[0-9](?:[\x20.-]{0,2}[0-9]){12,18}(?![0-9])",
    "phone": r"[+(]?[0-9](?:[\x20().-]{0,3}[0-9]){8,14}(?![0-9])",
}
REGIONS = {"n": r"[0-9+][\x20().0-9+-]*[0-9]", "b": BASE["email"], "l": LOOSE["email"]}
FEATURES = ("length", "digits", "digit_share", "separators", "groups", "longest_group", "plus", "brackets", "spaces", "dots", "octets", "luhn", "glued_left", "glued_right",
            "said_mail", "said_phone", "said_card", "said_host", "said_secret", "named_host", "dated", "kind")
SIDE = 40
AT, DOT = r"\x20?(?:@|[\[({]\x20?(?:at|AT)\x20?[\])}])\x20?", r"\x20?(?:\.|[\[({]\x20?(?:dot|DOT)\x20?[\])}])\x20?"
DATE = r"^(?:19|20)[0-9]{2}[-.\x20]?(?:0[1-9]|1[0-2])[-.\x20]?(?:0[1-9]|[12][0-9]|3[01])(?![0-9])"


def _matches(text: Column, pattern: str) -> Column:
    """``array<struct<i, gap, found, left, right>>``: matches with the length of what lies before each since the last one."""
    pieces, found = F.split(text, F.lit(pattern), -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    z = F.arrays_zip(F.slice(pieces, 1, F.size(found)).alias("p"), found.alias("f"), F.slice(pieces, 2, F.greatest(F.size(pieces), F.lit(1))).alias("q"))
    return F.transform(z, lambda m, i: F.struct(i.alias("i"), F.length(m["p"]).alias("gap"), m["f"].alias("found"),
                                                F.right(m["p"], F.lit(SIDE)).alias("left"), F.left(m["q"], F.lit(SIDE)).alias("right")))


NOTHING = "array<struct<i:int,gap:int,found:string,left:string,right:string>>"


def _none() -> Column:
    return F.array().cast(NOTHING)


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        two = d * 2
        return total + F.when(i % 2 == 1, F.when(two > 9, two - 9).otherwise(two)).otherwise(d)
    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def candidates(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Every proposed span of every row: ``(row, doc_id, kind, base, start, stop, said, left, right, wrong)``, and one row without kind per input row.

    A match of a base pattern that fails its check has no kind either; ``wrong`` names its kind. ``start`` and ``stop`` count code points. Null texts are empty. ``row`` numbers input rows, so repeated ids stay apart.
    """
    d = docs.select(F.col(key).cast("bigint").alias("doc_id"), text_or_empty(text).alias("x"), F.monotonically_increasing_id().alias("row"))
    tag = lambda t, c: F.transform(c, lambda m: F.struct(F.lit(t).alias("t"), m["i"].alias("i"), m["gap"].alias("gap"), m["found"].alias("found"), m["left"].alias("left"), m["right"].alias("right")))
    at = F.instr("x", "@") > 0
    guarded = {"n": _matches(F.col("x"), REGIONS["n"]), "b": F.when(at, _matches(F.col("x"), REGIONS["b"])).otherwise(_none()),
               "l": F.when(at | (F.instr(F.lower("x"), "at") > 0) & F.col("x").rlike(r"[\[({]\x20?(?:at|AT)\x20?[\])}]"), _matches(F.col("x"), REGIONS["l"])).otherwise(_none())}
    d = d.select("row", "doc_id", F.explode_outer(F.concat(*[tag(t, c) for t, c in guarded.items()])).alias("m")).select("row", "doc_id", "m.*")
    n = int(d.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = F.length("found")
    d = d.repartition(n, "row").withColumn("at", F.sum(F.col("gap") + size).over(W.partitionBy("row", "t").orderBy("i")) - size)
    # number regions hold the matches of three kinds, of the base pattern and of the generator
    kinds = [(k, b) for k in KINDS[1:] for b in (True, False)]
    def named(k: str, b: bool):
        return lambda m: F.struct(F.lit(k).alias("kind"), F.lit(b).alias("base"), m["i"].alias("j"), m["gap"].alias("gap2"), m["found"].alias("said"), m["left"].alias("l2"), m["right"].alias("r2"))

    inner = F.concat(*[F.transform(_matches(F.col("found"), (BASE if b else LOOSE)[k]), named(k, b)) for k, b in kinds])
    whole = F.array(F.struct(F.lit("email").alias("kind"), (F.col("t") == "b").alias("base"), F.lit(0).alias("j"), F.lit(0).alias("gap2"), F.col("found").alias("said"), F.lit("").alias("l2"), F.lit("").alias("r2")))
    d = d.withColumn("c", F.explode_outer(F.when(F.col("t") == "n", inner).when(F.col("t").isNotNull(), whole)))
    d = d.select("row", "doc_id", "t", "i", "at", "left", "right", "c.*")
    size = F.length("said")
    place = F.sum(F.col("gap2") + size).over(W.partitionBy("row", "t", "i", "kind", "base").orderBy("j")) - size
    d = d.withColumn("start", (F.col("at") + place).cast("bigint"))
    d = d.withColumn("stop", F.col("start") + size).withColumn("left", F.right(F.concat("left", "l2"), F.lit(SIDE))).withColumn("right", F.left(F.concat("r2", "right"), F.lit(SIDE)))
    digits = F.regexp_replace("said", "[^0-9]", "")
    count = F.length(digits)
    part = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9][0-9]|[0-9]|)"
    passes = (F.when(F.col("kind") == "ip", F.col("said").rlike(rf"^{part}(?:\.{part}){{3}}$"))
              .when(F.col("kind") == "card", count.between(13, 19) & F.when(count.between(13, 19), luhn(digits)).otherwise(False))
              .when(F.col("kind") == "phone", count.between(9, 15)).otherwise(True))
    # a base match that fails its check is no span, but its row stays; a generator's span needs no check
    ok = F.col("kind").isNotNull() & (~F.col("base") | passes)
    return d.select("row", "doc_id", F.when(ok, F.col("kind")).alias("kind"), (ok & F.col("base")).alias("base"), "start", "stop", "said", "left", "right",
                    F.when(~ok & F.col("base"), F.col("kind")).alias("wrong"))


def features(c: DataFrame) -> DataFrame:
    """Format and surroundings of proposals as double columns."""
    s, left = F.col("said"), F.lower("left")
    digits = F.regexp_replace(s, "[^0-9]", "")
    n, length = F.length(digits), F.length(s)
    numbers = F.filter(F.split(s, "[^0-9]+"), lambda g: g != "")
    longest = F.coalesce(F.array_max(F.transform(numbers, lambda g: F.length(g))), F.lit(0))
    told = lambda *words: F.lit(False) if not words else F.concat(left, F.lit(" "), F.lower("right")).rlike("|".join(words))
    values = {
        "length": length, "digits": n, "digit_share": n / F.greatest(length, F.lit(1)), "separators": F.length(F.regexp_replace(s, r"[^\x20().@-]", "")), "groups": F.size(numbers), "longest_group": longest,
        "plus": s.startswith("+"), "brackets": s.rlike(r"[\[({]"), "spaces": F.length(F.regexp_replace(s, r"[^\x20]", "")), "dots": F.length(F.regexp_replace(s, r"[^.]", "")),
        "octets": (F.size(numbers) == 4) & (longest <= 3) & F.forall(numbers, lambda g: (F.length(g) <= 3) & (F.substring(g, 1, 3).cast("int") <= 255)),
        "luhn": F.when(n.between(13, 19), luhn(digits)).otherwise(False), "glued_left": F.col("left").rlike(r"[A-Za-z0-9_.=/+-]$"), "glued_right": F.col("right").rlike(r"^[A-Za-z0-9_=/@-]"),
        "said_mail": told("mail", "contact", "write"), "said_phone": told("phone", "tel", "call", "fax", "mobile"), "said_card": told("card", "visa", "pay", "credit"),
        "said_host": told("host", "server", "addr", r"\bip\b"), "said_secret": told("pass", "token", "key", "secret", "sha", "hash", "uuid", "version"),
        "named_host": (F.col("kind") == "email") & s.rlike(r"[A-Za-z]{2}$"), "dated": s.rlike(DATE),
        "kind": F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")),
    }
    return c.withColumns({f"f_{k}": F.coalesce(values[k].cast("double"), F.lit(0.0)) for k in FEATURES})


def _touching(c: DataFrame) -> DataFrame:
    """Proposals with ``same`` (a base span of the kind has the same bounds), ``near`` (touches a base span of any kind) and ``failed`` (known to be wrong).

    Matches of one pattern are disjoint, so the last that starts before a proposal is the only one it can lie in.
    """
    base = F.col("base")
    same = F.max(base.cast("int")).over(W.partitionBy("row", "kind", "start", "stop")) == 1
    ended = F.max(F.when(base, F.col("stop"))).over(W.partitionBy("row").orderBy("start").rangeBetween(W.unboundedPreceding, 0))
    coming = F.min(F.when(base, F.col("start"))).over(W.partitionBy("row").orderBy(F.col("start").desc()).rangeBetween(W.unboundedPreceding, 0))
    missed = F.max(F.when(F.col("wrong").isNotNull(), F.col("stop"))).over(W.partitionBy("row", F.coalesce("kind", "wrong")).orderBy("start").rangeBetween(W.unboundedPreceding, 0))
    failed = F.coalesce(missed >= F.col("stop"), F.lit(False)) | (F.col("kind") == "phone") & (F.col("said").rlike(DATE) | F.col("left").rlike("[0-9]$")) | (F.col("kind") == "email") & ~F.col("said").rlike(r"[A-Za-z]{2}$")
    return c.withColumn("same", same).withColumn("failed", failed & F.col("kind").isNotNull()).withColumn("near", F.coalesce(ended > F.col("start"), F.lit(False)) | F.coalesce(coming < F.col("stop"), F.lit(False)))


def loose_form(said: Column, kind: Column, form: Column) -> Column:
    """``said`` rewritten into one of the forms that only the generators find; form 0 leaves it."""
    pick = lambda a, b, c: F.when(form == 1, a).when(form == 2, b).otherwise(c)
    glue = lambda groups, *seps: pick(*[F.array_join(groups, x) for x in seps])
    parts = F.split(said, AT, 2)
    email = F.concat(parts[0], pick(*map(F.lit, (" [at] ", "(at)", " @ "))), glue(F.split(parts[1], DOT), " [dot] ", "(dot)", "."))
    ip = glue(F.split(said, r"\x20?[.-]\x20?"), "-", " . ", " - ")
    card = glue(F.regexp_extract_all(F.regexp_replace(said, "[^0-9]", ""), F.lit("[0-9]{1,4}"), F.lit(0)), ".", "-", ". ")
    bare = F.regexp_replace(said, r"^[+\x20().-]+", "")
    groups = F.split(bare, r"[\x20().-]+")
    phone = pick(bare, F.array_join(groups, "."), F.array_join(groups, "-"))
    return F.when(form == 0, said).when(kind == "email", email).when(kind == "ip", ip).when(kind == "card", card).otherwise(phone)


def training_rows(proposals: DataFrame) -> DataFrame:
    """``(h, kind, said, left, right, label)``, ``h`` a hash of what is said and where.

    Every base span in some form (label 1), the same ones spoiled (0), and every proposal known to be wrong (0), in some form too.
    """
    p = proposals.where(F.col("kind").isNotNull() & ~F.col("base")).withColumn("h", F.xxhash64("said", "left", "right", "kind"))
    p = p.select("h", "kind", "said", "left", "right", "same", (F.col("failed") & ~F.col("near")).alias("wrong"))
    good = p.where("same").drop("same", "wrong")
    good = good.withColumn("said", loose_form(F.col("said"), F.col("kind"), F.pmod(F.xxhash64("h"), F.lit(4)).cast("int")))
    said, kind = F.col("said"), F.col("kind")
    last = F.regexp_extract(said, "([0-9])$", 1)
    spoiled = (F.when(kind == "card", F.concat(F.regexp_replace(said, "[0-9]$", ""), F.translate(last, "0123456789", "1234567890")))
               .when(kind == "ip", F.regexp_replace(said, "[0-9]+$", "999"))
               .when(kind == "email", F.regexp_replace(said, "[A-Za-z0-9-]+$", "1")).otherwise(said))
    # a telephone number that goes on to the left is none
    bad = good.withColumn("left", F.when(kind == "phone", F.concat("left", F.lit("7"))).otherwise(F.col("left"))).withColumn("said", spoiled)
    wrong = p.where("wrong").drop("same", "wrong")
    wrong = wrong.withColumn("said", F.coalesce(F.when(kind != "phone", loose_form(said, kind, F.pmod(F.xxhash64("h"), F.lit(4)).cast("int"))), said))
    return good.withColumn("label", F.lit(1.0)).unionByName(bad.unionByName(wrong).withColumn("label", F.lit(0.0)))


def disjoint(spans: DataFrame) -> DataFrame:
    """``(row, doc_id, kind, base, start, stop)`` of ``spans`` that touch no kept earlier one; of those with one start the longest counts as first.

    Only spans that hang together are folded over, one chain at a time.
    """
    order = W.partitionBy("row").orderBy("start", F.col("stop").desc(), "kind")
    ended = F.max("stop").over(order.rowsBetween(W.unboundedPreceding, -1))
    d = spans.withColumn("fresh", (ended.isNull() | (ended <= F.col("start"))).cast("int")).withColumn("chain", F.sum("fresh").over(order.rowsBetween(W.unboundedPreceding, 0)))
    one = F.struct("start", (-F.col("stop")).alias("back"), "kind", "base")
    d = d.groupBy("row", "doc_id", "chain").agg(F.array_sort(F.collect_list(one)).alias("all"))
    none = F.struct(F.lit(0).cast("bigint").alias("at"), F.slice("all", 1, 0).alias("kept"))
    step = lambda a, s: F.when(s["start"] >= a["at"], F.struct((-s["back"]).alias("at"), F.concat(a["kept"], F.array(s)).alias("kept"))).otherwise(a)
    d = d.select("row", "doc_id", F.explode(F.aggregate("all", none, step)["kept"]).alias("s"))
    return d.select("row", "doc_id", "s.kind", "s.base", "s.start", (-F.col("s.back")).alias("stop"))


@dataclass
class Booster:
    """Fitted trees and the threshold of each kind; ``trees`` is None where the training rows are of one class."""

    trees: GBTClassificationModel | None
    thresholds: dict[str, float]


def fit_booster(proposals: DataFrame, trees: int = 10, depth: int = 3, precision: float = 0.99) -> Booster:
    """Fits on all ``training_rows`` but a fifth, which chooses the thresholds. Rows of equal features are one row with their number as weight.

    A threshold is the least of 0.50, 0.52 ... at which the share of right proposals of the kind, among those scored so or higher, is at
    least ``precision``; with no such value the kind gets no further spans.
    """
    names = [f"f_{k}" for k in FEATURES]
    every = features(training_rows(proposals)).withColumn("held", F.pmod("h", F.lit(5)) == 0)
    equal = written(every.groupBy("held", "label", "kind", *names).agg(F.count(F.lit(1)).cast("double").alias("weight")), "pii-training")
    if equal.select("label").distinct().count() < 2:
        return Booster(None, {})
    rows = VectorAssembler(inputCols=names, outputCol="features").transform(equal)
    held = F.col("held")
    model = GBTClassifier(maxIter=trees, maxDepth=depth, seed=7, subsamplingRate=1.0, weightCol="weight").fit(rows.where(~held).select("features", "label", "weight"))
    score = F.floor(vector_to_array("probability")[1] * 50) / 50
    bins = model.transform(rows.where(held)).groupBy("kind", score.alias("s")).agg(F.sum(F.col("label") * F.col("weight")).alias("right"), F.sum("weight").alias("n")).collect()
    thresholds = {}
    for kind in KINDS:
        for step in range(25, 50):
            cut = [b for b in bins if b.kind == kind and b.s >= step / 50 - 1e-9]
            n = sum(b.n for b in cut)
            if n and sum(b.right for b in cut) >= precision * n:
                thresholds[kind] = step / 50
                break
    return Booster(model, thresholds)


def find_spans(docs: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """All spans: ``(row, doc_id, kind, base, start, stop)``, plus one row without kind for every input row (options as in ``fit_booster``)."""
    c = written(_touching(candidates(docs, text, key)), "pii-candidates")
    model = fit_booster(c, **options)
    kept = c.where(F.col("kind").isNull() | F.col("base")).select("row", "doc_id", "kind", "base", "start", "stop")
    if not model.thresholds:
        return kept
    asked = features(c.where(F.col("kind").isNotNull() & ~F.col("base") & ~F.col("near") & ~F.col("failed")))
    scored = model.trees.transform(VectorAssembler(inputCols=[f"f_{k}" for k in FEATURES], outputCol="features").transform(asked))
    least = F.coalesce(*[F.when(F.col("kind") == k, F.lit(v)) for k, v in model.thresholds.items()], F.lit(2.0))
    more = scored.where(vector_to_array("probability")[1] >= least).select("row", "doc_id", "kind", "base", "start", "stop")
    return kept.unionByName(disjoint(more))


def redact(text: Column, spans: Column) -> Column:
    """``text`` with each of ``spans`` (array of structs kind, start, stop; in order, not overlapping) replaced by its kind in brackets."""
    first = F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at"))
    step = lambda a, s: F.struct(F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), (s["start"].cast("bigint") - a["at"]).cast("int")), F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("out"), s["stop"].cast("bigint").alias("at"))
    done = F.aggregate(spans, first, step)
    return F.concat(done["out"], F.substring(text, (done["at"] + 1).cast("int"), F.length(text)))


def op2_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = find_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    number = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    item = F.struct(number.alias("k"), F.col("start"), F.col("stop"), F.col("kind"))
    joined = lambda a: F.array_join(F.transform(F.array_sort(a), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
    base = F.col("base") & F.col("kind").isNotNull()
    g = spans.groupBy("row", "doc_id").agg(*[F.count_if(base & (F.col("kind") == k)).alias(f"n_{k}") for k in KINDS],
                                           F.collect_list(F.when(base, item)).alias("b"), F.collect_list(F.when(F.col("kind").isNotNull(), item)).alias("a"))
    return g.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2(joined(F.col("b")).cast("binary"), 256).alias("base_sha256"), joined(F.col("a")).alias("spans"))
