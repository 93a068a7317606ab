"""Quality rules: a threshold table compiled into one projection (native expressions only)."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"


class Rule(NamedTuple):
    """Reject where ``metric`` is below ``low`` or above ``high`` (None: no bound).

    ``least``: number of words from which the rule holds; ratios of a few words say little.
    """
    name: str
    metric: str
    low: float | None
    high: float | None
    least: int = 0


#: Function words of the four languages of the corpus; fixed values.
STOP_WORDS = (
    "the of and to in a is that for it as was with be by on not he his but at are this "
    "have from or had an they which "
    "le la les de des du et un une que en dans est pour qui il au par sur pas ne ce se "
    "der die das und ist von den zu mit sich des auf für nicht ein eine als auch es dem "
    "el los las y que en del se por con una para no su al lo como más pero sus"
).split()

#: The default table.  Lower bounds are low and upper bounds high: a clean text of any
#: genre passes, and what fails is a list of symbols, a wall of one word or a broken line.
RULES = (
    Rule("mean_word", "word_mean", 2.0, 12.0, 20),
    Rule("symbols", "symbol_ratio", None, 0.08, 20),
    Rule("stop_words", "stop_ratio", 0.05, None, 50),
    Rule("same_lines", "dup_line_ratio", None, 0.5, 20),
)


def _row(docs: DataFrame, text: str) -> DataFrame:
    """All columns of the input in one struct, so that no name of theirs can clash."""
    return docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"),
                       F.coalesce(docs[f"`{text}`"], F.lit("")).alias("text"))


def measure(docs: DataFrame, text: str = "text",
            stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """``row`` (the input) beside the counts of its text.

    Null and empty texts have zero in every count.  Repeated rows are measured alike.
    """
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    parts = _row(docs, text).select(
        "row", "text", lines.alias("lines"),
        F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("words"))
    n = F.size("words").cast("long")
    bare = F.translate("text", SPACE, "")
    grams = F.when(F.size("words") >= 3, F.sort_array(F.transform(
        F.sequence(F.lit(0), F.size("words") - 3),
        lambda i: F.struct(F.xxhash64(F.get("words", i), F.get("words", i + 1),
                                      F.get("words", i + 2)).alias("h"), i.alias("i")))))
    stop = list(dict.fromkeys(stop_words))
    counted = parts.select(
        "row", n.alias("n_words"), F.length(bare).cast("long").alias("word_chars"),
        (F.length(bare) - F.length(F.translate(bare, SYMBOLS, ""))).cast("long")
        .alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.filter("words", lambda w: F.lower(w).isin(stop)))
        .cast("long").alias("n_stop"), grams.alias("grams"))
    # equal windows are neighbours once sorted by hash; their places, in text order, each
    # add the words up to the next place, three at most
    kept = [c for c in counted.columns if c != "grams"]
    twice = F.filter("grams", lambda g, k: (F.get("grams", k - 1)["h"].eqNullSafe(g["h"]))
                     | (F.get("grams", k + 1)["h"].eqNullSafe(g["h"])))
    placed = counted.select(*kept, twice.alias("twice"))
    placed = placed.select(*kept, F.sort_array(F.transform("twice", lambda g: g["i"]))
                           .alias("at"))
    cover = F.aggregate(
        F.transform("at", lambda x, k: F.least(F.coalesce(F.get("at", k + 1) - x, F.lit(3)),
                                               F.lit(3))), F.lit(0), lambda a, x: a + x)
    return placed.select(*kept, F.coalesce(cover, F.lit(0)).cast("long")
                         .alias("n_repeat_words"))


def compiled(rules: Sequence[Rule]) -> Column:
    """The rule table as one expression: an array with the names of the rules that fail."""
    ratio = {"word_mean": F.col("word_chars") / F.col("n_words"),
             "symbol_ratio": F.col("n_symbols") / F.col("word_chars"),
             "stop_ratio": F.col("n_stop") / F.col("n_words"),
             "dup_line_ratio": F.col("n_dup_lines") / F.col("n_lines")}

    def fails(rule: Rule) -> Column:
        value = ratio[rule.metric] if rule.metric in ratio else F.col(rule.metric)
        bad = F.lit(False)
        if rule.low is not None:
            bad = bad | (value < rule.low)
        if rule.high is not None:
            bad = bad | (value > rule.high)
        return F.when((F.col("n_words") >= rule.least) & bad, F.lit(rule.name))
    return F.array_compact(F.array(*[fails(r) for r in rules])) if rules else F.array()


def judge(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text") -> DataFrame:
    """:func:`measure` with ``base_failed``, ``failed`` (names of rules) and ``kept``.

    The base rule: under 50 words, or over half of the words in repeated windows.
    """
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    # a column that a filter can't pass: pushed down, the verdict would be written out in
    # terms of the text, each metric again wherever it is used
    measured = measure(docs, text).withColumn("nth", F.monotonically_increasing_id())
    out = measured.withColumns({"base_failed": base, "failed": compiled(rules)})
    kept = ~F.col("base_failed") & (F.size("failed") == 0) & (F.col("nth") >= 0)
    return out.withColumn("kept", kept).drop("nth")


def keep_good(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text") -> DataFrame:
    """The rows that no rule rejects, with the columns they came with."""
    return judge(docs, rules, text).where("kept").select("row.*")
