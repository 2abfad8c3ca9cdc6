"""Quotation linking: conversations in reply order and without quotes, with DataFrame operations alone.

A line's quote level is the number of ``>`` before its text. Lines of one level that follow each other without an empty
one are a passage; passages above level 0 are quoted, those of level 0 are the message's own. A passage is normalised, so
that lines wrapped anew make no difference, and hashed as a whole, by sentence and by line: a quoted passage is linked to
the first earlier messages of its conversation that wrote it or, if only a part was quoted, its sentences or lines. A message
answers the message that most of this leads to at level one (at the deeper levels, if nothing does there). Threads are the
trees that these answers make.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import broadcast_if_small, materialize, shuffled_join, small

MARK = r"^[ \t]*(>[> \t]*)"
#: A line that introduces a quote, such as "On Monday Ann wrote:".
INTRO = r"(?i)^\s*(on\b.*\bwrote|.*\b(wrote|writes|said)):\s*$"
SENTENCE = r"[^.!?]+[.!?]*"
BREAK, LEVEL = "\x01", "\x02"  # in no normalised text


def _normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[\x00-\x20]+", " "))


def _line(x: Column) -> Column:
    marks = F.regexp_extract(x, MARK, 1)
    level = F.length(F.regexp_replace(marks, r"[ \t]+", ""))
    body = F.when(level > 0, F.regexp_replace(x, MARK, "")).otherwise(x)
    return F.struct(level.alias("level"), body.alias("text"), _normal(body).alias("norm"))


def parse(messages: DataFrame) -> DataFrame:
    """Adds lines (level, text, norm) and passages (level, text): arrays in the order of the text."""
    rows = messages.withColumn("lines", F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), _line))

    def joined(x: Column, before: Column) -> Column:
        goes_on = (before["level"] == x["level"]) & (before["norm"] != "")
        fresh = F.concat(F.lit(BREAK), x["level"].cast("string"), F.lit(LEVEL))
        return F.when(x["norm"] == "", F.lit(BREAK)).otherwise(F.concat(F.when(goes_on, F.lit(" ")).otherwise(fresh), x["norm"]))

    none = F.array(F.lit(None).cast("struct<level:int,text:string,norm:string>"))
    before = F.concat(none, F.slice("lines", 1, F.size("lines") - 1))
    pieces = F.filter(F.split(F.array_join(F.zip_with("lines", before, joined), ""), BREAK, -1), lambda p: p != "")
    passage = lambda p: F.struct(F.substring_index(p, LEVEL, 1).cast("int").alias("level"), F.substring_index(p, LEVEL, -1).alias("text"))
    return rows.withColumn("passages", F.transform(pieces, passage))


def _units(text: Column) -> Column:
    """Hashes of a passage and of its sentences."""
    sentences = F.transform(F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0)), lambda s: F.trim(s))
    return F.transform(F.array_append(F.filter(sentences, lambda s: s != ""), text), lambda u: F.xxhash64(u))


def _exploded(rows: DataFrame, quoted: bool) -> DataFrame:
    """(conv_id, turn, level, passage, unit) of quoted passages, or (conv_id, turn, unit) of own ones: hashes of passages, sentences and lines."""
    wanted = lambda x: (x["level"] > 0) if quoted else (x["level"] == 0)
    keys = ["conv_id", "turn"]
    passages = rows.select(*keys, F.explode(F.filter("passages", wanted)).alias("p"))
    passages = passages.select(*keys, F.col("p.level").alias("level"), F.xxhash64("p.text").alias("passage"), F.explode(_units(F.col("p.text"))).alias("unit"))
    lines = rows.select(*keys, F.explode(F.filter("lines", lambda x: wanted(x) & (x["norm"] != ""))).alias("x"))
    lines = lines.select(*keys, F.col("x.level").alias("level"), F.lit(None).cast("bigint").alias("passage"), F.xxhash64("x.norm").alias("unit"))
    every = passages.unionByName(lines)
    return every.distinct() if quoted else every.select(*keys, "unit")


LINKED = "conv_id bigint, turn bigint, n_linked bigint, reply_to bigint, thread bigint"


def _linked(named: DataFrame, asked: DataFrame) -> DataFrame:
    """LINKED of each message of named of whose quotes, asked, some are found."""
    talks = broadcast_if_small(asked.select("conv_id").distinct())
    own = _exploded(parse(named.join(talks, "conv_id", "left_semi")), False)
    wanted = asked.select("conv_id", "unit").distinct()
    first = shuffled_join(own, wanted, ["conv_id", "unit"], "left_semi").groupBy("conv_id", "unit").agg(F.min("turn").alias("origin"))
    found = materialize(shuffled_join(asked, first, ["conv_id", "unit"]).filter("origin < turn"), "found")
    votes = found.groupBy("conv_id", "turn", "level", "origin").agg(F.count("*").alias("n"))
    answers = votes.groupBy("conv_id", "turn").agg(F.min(F.struct("level", (-F.col("n")).alias("fewer"), (-F.col("origin")).alias("later"))).alias("best"))
    linked = found.filter("passage IS NOT NULL").select("conv_id", "turn", "passage").distinct().groupBy("conv_id", "turn").agg(F.count("*").alias("n_linked"))
    answers = shuffled_join(answers, linked, ["conv_id", "turn"], "left")
    answers = materialize(answers.select("conv_id", "turn", "n_linked", (-F.col("best.later")).alias("reply_to")), "answers")

    # Roots by pointer jumping: each round doubles the steps walked; earlier turns only, so there is no cycle.
    root = answers.select("conv_id", "turn", F.col("reply_to").alias("thread"))
    while True:
        nxt = root.select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("further"))
        jumped = root.join(nxt, ["conv_id", "thread"], "left")
        jumped = materialize(jumped.select("conv_id", "turn", F.coalesce("further", "thread").alias("thread"), F.col("further").isNotNull().alias("moved")), "roots")
        root = jumped.select("conv_id", "turn", "thread")
        if not jumped.filter("moved").limit(1).count():
            break
    return materialize(shuffled_join(answers, root, ["conv_id", "turn"]).select("conv_id", "turn", "n_linked", "reply_to", "thread"), "linked")


def link(conversations: DataFrame) -> DataFrame:
    """One row a message: conv_id, turn, role, reply_to, thread, n_quoted, n_linked, depth, text (without quotes).

    reply_to is the turn answered, null if nothing quoted is found earlier in the conversation; thread the turn at the root of
    the message's tree (its own, if it answers nothing); reading order is conv_id, thread, turn. n_quoted counts
    quoted passages, n_linked those of which the whole or a sentence is found, depth is the deepest level. Ties between
    answered messages go to the latest. A line that introduces a quote goes with the quote; a null text stays null. Messages
    with a null conv_id or turn link with nothing. Rows that share conv_id and turn count as one message for links, and each
    stays a row. Lines may have any number of marks and texts any length.
    """
    rows = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    named = rows.filter("conv_id IS NOT NULL AND turn IS NOT NULL")
    asked = materialize(_exploded(parse(named.filter(F.col("text").contains(">"))), True), "asked")
    linked = _linked(named, asked) if asked.limit(1).count() else conversations.sparkSession.createDataFrame([], LINKED)

    # The lines of a message that are kept: its own, but for an introduction right before a quote.
    parsed = parse(rows)
    after = F.concat(F.slice("lines", 2, F.size("lines")), F.array(F.lit(None).cast("struct<level:int,text:string,norm:string>")))
    marked = F.zip_with("lines", after, lambda x, y: F.when((x["level"] == 0) & ~(F.coalesce(y["level"] > 0, F.lit(False)) & x["text"].rlike(INTRO)), x["text"]))
    body = F.when(F.col("text").isNotNull(), F.trim(F.array_join(F.filter(marked, lambda x: x.isNotNull()), "\n")))
    depth = F.array_max(F.transform("lines", lambda x: x["level"])).cast("bigint")
    n_quoted = F.size(F.filter("passages", lambda p: p["level"] > 0)).cast("bigint")
    told = parsed.select("conv_id", "turn", "role", n_quoted.alias("n_quoted"), depth.alias("depth"), body.alias("text"))
    joined = told.join(F.broadcast(linked), ["conv_id", "turn"], "left") if small(linked) else shuffled_join(told, linked, ["conv_id", "turn"], "left")
    return joined.select("conv_id", "turn", "role", "reply_to", F.coalesce("thread", "turn").alias("thread"), "n_quoted", F.coalesce("n_linked", F.lit(0)).alias("n_linked"), "depth", "text")
