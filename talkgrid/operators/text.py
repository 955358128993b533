"""Transcript features. Words stay rows: nothing ever holds the text of a whole call.

``words(call_id, channel, pos, text, start_s, end_s, logprob)``; order within a channel is
``start_s`` then ``pos``, cut into ten-minute blocks for the operators that need a neighbour.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.fixed import DISFLUENCIES, DISFLUENCY_PHRASES, REGIONAL_PHRASES, REGIONALISMS, SCRIPT_TICS
from ..functions.ordered import quantiles, scan
from ..functions.scalar import safe_div

ORDER = ["start_s", "pos"]
SENTENCE_MARKS = "[.!?¿¡]+"


def _block() -> Column:
    return F.floor(F.col("start_s") / 600)


def token(text: Column) -> Column:
    """Lower case, letters, digits and underscore only."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]", "")


def tokenize(words: DataFrame) -> DataFrame:
    return words.withColumn("token", token(F.col("text"))).where(F.col("token") != "")


def vocabulary_rate(tok: Column, entries: Sequence[str]) -> Column:
    """Tokens in a word list; a list entry of several words can never be a single token."""
    return F.count_if(tok.isin(*[e for e in entries if " " not in e]))


def phrase_hit(prev: Column, tok: Column, phrase: str) -> Column:
    """A two-word phrase in the running text: it may start and end inside a word."""
    head, tail = phrase.split(" ")
    return prev.endswith(head) & tok.startswith(tail)


def transcript_features(words: DataFrame, keys: Sequence[str] = ("call_id",), n_turns: DataFrame | None = None) -> DataFrame:
    """Word-list rates, richness, sentence length and recogniser confidence of one side of a call."""
    keys = list(keys)
    pieces = F.transform(F.split("text", SENTENCE_MARKS), lambda s: F.trim(s) != "")
    w = words.withColumns({"token": F.nullif(token(F.col("text")), F.lit("")), "p": pieces})
    # a sentence runs on into the next word unless a mark closed it; blank words leave the state as it was
    state = F.when((F.size("p") > 1) | F.col("p")[0], F.element_at("p", -1).cast("int"))
    w = w.withColumn("state", state)
    s = scan(w, keys, _block(), ORDER, {"prev": ("last", "token"), "open": ("last", "state")}, inclusive=False)
    filled = F.size(F.filter("p", lambda x: x))
    starts = filled - F.when(F.col("p")[0] & (F.col("open") == 1), 1).otherwise(0)
    tok, lp = F.col("token"), F.col("logprob")
    phrases = lambda ps: sum((F.count_if(phrase_hit(F.col("prev"), tok, p)) for p in ps), F.lit(0))
    g = s.groupBy(*keys).agg(
        F.count(tok).alias("n_tokens"), F.count_distinct(tok).alias("n_types"), F.sum(starts).alias("n_sentences"),
        (vocabulary_rate(tok, DISFLUENCIES) + phrases(DISFLUENCY_PHRASES)).alias("disfluency"),
        (vocabulary_rate(tok, REGIONALISMS) + phrases(REGIONAL_PHRASES)).alias("regional"),
        vocabulary_rate(tok, SCRIPT_TICS).alias("tic"),
        F.count_if(F.col("text").contains("--") | F.col("text").endswith("-")).alias("cut"),
        F.avg(lp).alias("logprob_mean"), F.stddev_pop(lp).alias("logprob_std"), F.min(lp).alias("logprob_min"),
        F.avg((lp < -0.05).cast("double")).alias("logprob_low_frac"),
        F.coalesce(F.avg(F.when(F.col("start_s") < 30, lp)), F.avg(lp)).alias("logprob_first30"))
    g = g.join(quantiles(words, keys, "logprob", {"logprob_p10": .1}), keys, "left")
    turns = F.lit(1)
    if n_turns is not None:
        g, turns = g.join(n_turns, keys, "left"), F.coalesce("n_turns", F.lit(0))
    n = F.greatest("n_tokens", F.lit(1))
    return g.select(
        *keys, "logprob_mean", "logprob_std", "logprob_p10", (F.col("disfluency") / n).alias("disfluency_rate"),
        (F.col("regional") / n).alias("regional_rate"), (F.col("cut") / n).alias("false_start_rate"), (F.col("n_types") / n).alias("ttr"),
        (n / F.greatest("n_sentences", F.lit(1))).alias("mean_sentence_len"), (n / F.greatest(turns, F.lit(1))).alias("words_per_turn"),
        n.cast("double").alias("n_words"), "logprob_min", "logprob_low_frac", "logprob_first30", (F.col("tic") / n).alias("script_tic_rate"))


def vocabulary_overlap(words: DataFrame, keys: Sequence[str] = ("call_id",)) -> DataFrame:
    """Share of the caller's vocabulary the agent said too."""
    t = tokenize(words).groupBy(*keys, "token").agg(F.max((F.col("channel") == 0).cast("int")).alias("c"),
                                                    F.max((F.col("channel") == 1).cast("int")).alias("a"))
    return t.groupBy(*keys).agg((F.sum(F.col("c") * F.col("a")) / F.greatest(F.sum("c"), F.lit(1))).alias("overlap_agent"))


def clock(t: Column) -> Column:
    return F.format_string("%d:%05.2f", F.floor(t / 60), t - F.floor(t / 60) * 60)


def annotate(words: DataFrame, keys: Sequence[str] = ("call_id",), names: Sequence[str] = ("CALLER", "AGENT"),
             line_gap: float = 1.0, silence_gap: float = 2.0) -> DataFrame:
    """Both sides in time as lines: a new one on a change of speaker or a pause; long silences before a line noted."""
    keys = list(keys)
    order = ["start_s", "end_s", "channel", "pos"]
    w = words.withColumns({"said": F.struct("channel", "end_s")})
    s = scan(w, keys, _block(), order, {"prev": ("last", "said"), "heard_until": ("max", "end_s")}, inclusive=False)
    new = F.col("prev").isNull() | (F.col("prev.channel") != F.col("channel")) | (F.col("start_s") - F.col("prev.end_s") > line_gap)
    s = s.withColumn("opens", F.when(new, 1).otherwise(0))
    s = scan(s, keys, _block(), order, {"line": ("sum", "opens")})
    pause = F.when((F.col("opens") == 1) & (F.col("start_s") - F.col("heard_until") > silence_gap), F.col("start_s") - F.col("heard_until"))
    g = s.groupBy(*keys, "line").agg(
        F.max("channel").alias("channel"), F.min("start_s").alias("start_s"), F.max(pause).alias("silence_s"),
        F.sort_array(F.collect_list(F.struct(*order, "text"))).alias("w"))
    name = F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("channel") + 1).cast("int"))
    text = F.array_join(F.transform("w", lambda x: x["text"]), " ")
    return g.select(*keys, "line", "channel", "start_s", "silence_s",
                    F.concat(F.lit("["), F.rpad(name, 7, " "), F.lit(" "), clock(F.col("start_s")), F.lit("] "), text).alias("text"))


def repetition_loops(words: DataFrame, keys: Sequence[str] = ("call_id",), n: int = 4, times: int = 4) -> DataFrame:
    """Calls where some ``n`` words in a row come back at least ``times`` times.

    Every word joins the ``n`` grams it is part of by its number; no window over a call.
    """
    keys = list(keys)
    t = words.select(*keys, *ORDER, F.posexplode(F.split(F.lower("text"), r"\s+")).alias("sub", "w")).where("w <> ''")
    t = scan(t.withColumn("one", F.lit(1)), keys, _block(), [*ORDER, "sub"], {"seq": ("sum", "one")})
    g = t.select(*keys, "w", F.posexplode(F.sequence(F.col("seq"), F.col("seq") - (n - 1), F.lit(-1))).alias("i", "start"))
    words_at = [F.max(F.when(F.col("i") == i, F.col("w"))).alias(f"w{i}") for i in range(n)]
    grams = g.where("start >= 1").groupBy(*keys, "start").agg(*words_at).dropna(subset=[f"w{i}" for i in range(n)])
    c = grams.groupBy(*keys, *[f"w{i}" for i in range(n)]).agg(F.count(F.lit(1)).alias("times")).where(F.col("times") >= times)
    return c.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_grams"), F.max("times").alias("most"))


def rubric_stats(rubric: DataFrame, calls: DataFrame) -> DataFrame:
    """Per dimension: validation AUC, class means and how often the answer is exactly undecided."""
    from .metrics import ranking
    j = rubric.select("call_id", "dimension", "score").join(calls.select("call_id", "y", "split"), "call_id")
    # answers out of the validation split are counted beside the others, so one pass over distinct scores serves all columns
    j = j.withColumn("__val", F.when(F.col("split") == "val", F.col("y")))
    s = F.col("score").cast("double")
    counts = {"n0": F.count_if(F.col("y") == 0), "n1": F.count_if(F.col("y") == 1), "rows": F.count(F.lit(1))}
    sums = {f"s{i}": F.sum(F.when(F.col(f"n{i}") > 0, F.col(f"n{i}") * s)) for i in (0, 1)} | {c: F.sum(c) for c in counts} | {"undecided": F.sum(F.when(s == 0.5, F.col("rows")).otherwise(0))}
    m = ranking(j, ["dimension"], y="__val", counts=counts, extra=sums)
    return m.select("dimension", safe_div(F.col("s0"), F.col("n0")).alias("human_mean"), safe_div(F.col("s1"), F.col("n1")).alias("synthetic_mean"),
                    safe_div(F.col("undecided"), F.col("rows").cast("double")).alias("undecided_share"), "auc")
