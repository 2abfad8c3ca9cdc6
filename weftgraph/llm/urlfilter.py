"""URL filter: listed rules first, else a ratio of two character language models, with DataFrame operations alone.

URLs that a rule allows or blocks teach two smoothed variable-order Markov models. A character's context is as long as
the evidence goes, up to ORDER characters: a context counts in a model that has met it EVIDENCE times, and is smoothed with
the next shorter one by the number of different characters met after it (Witten-Bell). More URLs give more and longer
contexts; their counts stay in a table that is joined by a shuffle once it is large. A URL's score is the mean over its
characters of the log-likelihood difference, so length does not count. The cut between verdicts is calibrated on the third
of the taught URLs, chosen by hash, that the models do not see.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import materialize, shuffled_join, small

ORDER = 5  # characters of the longest context
EVIDENCE = 4  # times that a model must have met a context to use it
START = "\x02"
HELD = 3  # one taught URL of so many calibrates
STEPS = 400  # cuts tried, evenly over the scores met
HOT = 1000  # a gram with more than 1 of so many characters is joined by broadcast: fewer than so many can be


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path

    def fits(self) -> Column:
        host, path = F.col("host"), F.col("path")
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


RULES = (
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def _ruled(rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.text)):  # the longest is asked first
        text, verdict = F.when(rule.fits(), rule.text).otherwise(text), F.when(rule.fits(), rule.verdict).otherwise(verdict)
    return text, verdict


def _grams(rows: DataFrame, *keep: str) -> DataFrame:
    """(keep, gram) of each character of the URLs: the character with ORDER before it, each of them counted once by position."""
    padded = F.concat(F.array_repeat(F.lit(START), ORDER), F.filter(F.split(F.lower("url"), ""), lambda c: c != ""))
    rows = rows.withColumn("_padded", padded)
    size = F.size("_padded") - ORDER
    grams = F.slice("_padded", 1, size)
    for at in range(2, ORDER + 2):
        grams = F.zip_with(grams, F.slice("_padded", at, size), lambda x, y: F.concat(x, y))
    return rows.select(*keep, F.explode(grams).alias("gram"))


def _model(counts: DataFrame) -> DataFrame:
    """(gram, n, allow, block) of every gram of ORDER + 1 characters to (gram, n, ratio), ratio the difference of log-probabilities."""
    kinds = ("allow", "block")
    letters = counts.groupBy(F.substring("gram", ORDER + 1, 1).alias("gram")).agg(*(F.sum(k).alias(k) for k in kinds))
    total = letters.agg(F.count("*").alias("n"), *(F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in kinds)).first()
    if not total["allow"] or not total["block"]:
        return counts.select("gram", "n", F.lit(0.0).alias("ratio"))
    known = letters.select("gram", *(((F.col(k) + 1) / F.lit(float(total[k] + total["n"]))).alias(f"p_{k}") for k in kinds))
    for order in range(1, ORDER + 1):
        sums = counts if order == ORDER else counts.groupBy(F.substring("gram", ORDER - order + 1, order + 1).alias("gram")).agg(*(F.sum(k).alias(k) for k in kinds))
        after = Window.partitionBy(F.substring("gram", 1, order))  # as many rows as characters follow a context
        met = {f"n_{k}": F.sum(k).over(after) for k in kinds} | {f"kinds_{k}": F.sum((F.col(k) > 0).cast("int")).over(after) for k in kinds}
        shorter = known.select(F.col("gram").alias("_shorter"), *(F.col(f"p_{k}").alias(f"q_{k}") for k in kinds))
        joined = sums.withColumns(met).join(shorter, F.substring("gram", 2, order) == F.col("_shorter"))
        p = lambda k: F.when(F.col(f"n_{k}") >= EVIDENCE, (F.col(k) + F.col(f"kinds_{k}") * F.col(f"q_{k}")) / (F.col(f"n_{k}") + F.col(f"kinds_{k}"))).otherwise(F.col(f"q_{k}"))
        known = joined.select("gram", *(["n"] if order == ORDER else []), *(p(k).alias(f"p_{k}") for k in kinds))
    return known.select("gram", "n", (F.log("p_allow") - F.log("p_block")).alias("ratio"))


def _scored(rows: DataFrame, model: DataFrame, keep: list[str]) -> DataFrame:
    """rows (row, url, keep) with the score of each; 0 for an empty URL."""
    grams = _grams(rows, "row")
    if small(model):
        met = grams.join(F.broadcast(model), "gram")
    else:
        every = model.agg(F.sum("n")).first()[0]
        often = F.col("n") * HOT > F.lit(every)
        hot = F.broadcast(model.filter(often))  # fewer than HOT rows, since their n add up to no more than all
        met = grams.join(hot, "gram").select("row", "ratio").unionByName(shuffled_join(grams.join(hot, "gram", "left_anti"), model.filter(~often), ["gram"]).select("row", "ratio"))
    scores = met.groupBy("row").agg(F.avg("ratio").alias("score"))
    joined = shuffled_join(rows.select("row", *keep), scores, ["row"], "left")
    return joined.select(*keep, F.round(F.coalesce("score", F.lit(0.0)), 9).alias("score"))


def _cut(tested: DataFrame) -> float:
    """From (ruled, score), the cut with the best balanced accuracy, of evenly spaced ones; half way down to the next score met."""
    span = tested.agg(F.min("score").alias("low"), F.max("score").alias("high")).first()
    if span["low"] is None or span["low"] == span["high"]:
        return span["low"] or 0.0
    low, width = span["low"], (span["high"] - span["low"]) / STEPS
    step = F.least(F.floor((F.col("score") - low) / width), F.lit(STEPS - 1)).cast("int")
    kinds = ("allow", "block")
    counts = tested.groupBy(step.alias("step")).agg(*(F.sum((F.col("ruled") == k).cast("long")).alias(k) for k in kinds))  # STEPS rows at most
    below, every, order = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(), Window.orderBy("step")
    under, share = lambda k: F.coalesce(F.sum(k).over(below), F.lit(0)), lambda n, k: n / F.greatest(F.sum(k).over(every), F.lit(1))
    good = share(under("block"), "block") + share(F.sum("allow").over(every) - under("allow"), "allow")
    before = F.coalesce(F.lag("step").over(order), F.col("step") - 1)
    judged = counts.withColumns({"good": F.round(good, 12), "cut": (F.col("step") + before + 1) / 2 * width + low})
    return judged.agg(F.max(F.struct("good", (-F.abs("cut")).alias("near"), "cut")).alias("best")).first()["best"]["cut"]


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row a page: page_id, host, path, rule, verdict, score (null where a rule decides).

    Null URLs and URLs without :// have an empty host and path and fit no rule; a null or empty URL scores 0. If no URL
    is allowed, or none blocked, nothing is learnt, scores are 0 and the verdict is allow. Repeated rows are judged
    alike. Other columns of pages are not looked at.
    """
    host, path = host_and_path(F.col("url"))
    base = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url")).withColumns({"host": host, "path": path})
    text, ruled = _ruled(rules)
    base = materialize(base.withColumns({"rule": text, "ruled": ruled, "row": F.monotonically_increasing_id()}), "urls")

    held = F.conv(F.substring(F.md5(F.col("url").cast("binary")), 1, 8), 16, 10).cast("bigint") % HELD == 0
    taught = F.when(~held, F.col("ruled"))
    grams = _grams(base.select("url", taught.alias("taught")), "taught")
    counts = grams.groupBy("gram").agg(F.count("*").alias("n"), *(F.sum((F.col("taught").eqNullSafe(k)).cast("long")).alias(k) for k in ("allow", "block")))
    model = materialize(_model(materialize(counts, "grams")), "urlmodel")
    cut = _cut(materialize(_scored(base.filter(F.col("ruled").isNotNull() & held), model, ["ruled"]), "tested"))

    fields = ["page_id", "host", "path", "rule"]
    by_rule = base.filter("ruled IS NOT NULL").select(*fields, F.col("ruled").alias("verdict"), F.lit(None).cast("double").alias("score"))
    rest = _scored(base.filter("ruled IS NULL"), model, fields)
    by_model = rest.select(*fields, F.when(F.col("score") >= F.lit(cut), "allow").otherwise("block").alias("verdict"), "score")
    return by_rule.unionByName(by_model)
