"""Operator 4, quality rules: a threshold table compiled into one Spark projection.

Everything here is a built-in Spark expression; no user function runs.

Defined results: a null or empty text has no words, fails the base rule and is
not kept. Repeated rows are judged one by one. Columns named like the results
replace input columns of that name; other input columns are left out unless
``keep_columns`` names them. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.llm.common import SPACE

SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "a and are as at be by for from had has have he her his in is it not of on or that the they this to was were which with you "
    "au avec ce dans de des du elle en est et il la le les mais ne nous ou par pas pour que qui se sur un une vous "
    "als auf aus bei das dem den der die ein eine er es ist mit nicht sich sie sind und von wir zu zum "
    "como con del el las lo los más no para pero por su una y"
).split()


@dataclass(frozen=True)
class Rule:
    """A text passes while ``numerator`` is between ``low`` and ``high`` hundredths of ``denominator``.

    A rule says nothing on texts with fewer than ``from_words`` words.
    """

    name: str
    numerator: str
    denominator: str
    low: int | None = None
    high: int | None = None
    from_words: int = 0


#: The threshold table. Counts are columns of ``measures``.
RULES = (
    Rule("mean_word_length", "word_chars", "n_words", low=200, high=1500),
    Rule("symbol_ratio", "n_symbols", "n_words", high=10),
    Rule("shout_ratio", "n_shouts", "n_words", high=40),
    Rule("stop_words", "n_stop_words", "n_words", low=5, from_words=60),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", high=50),
)


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_columns: tuple[str, ...] = ()) -> DataFrame:
    """The counts that rules read, one row for each input row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    blank = F.lit(SPACE)
    base = docs.select(F.col(id_col), *[F.col(c) for c in keep_columns], text.alias("_t"))
    base = base.withColumn("_w", F.when(F.btrim("_t", blank) == "", F.array().cast("array<string>")).otherwise(F.split(F.btrim("_t", blank), "[ \\t\\n\\x0B\\f\\r]+")))
    base = base.withColumn("_lines", F.filter(F.split("_t", "\n"), lambda s: F.btrim(s, blank) != ""))
    base = base.withColumn("_h", F.transform("_w", lambda w: F.xxhash64(w)))
    n = F.size("_w")
    # A transform of a one-element array binds the hashes to a name: named inside the inner lambda, the
    # optimizer would inline their computation there and repeat it for every window.
    windows = F.element_at(F.transform(F.array("_h"), lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(h, i, F.lit(WINDOW))))), 1)
    base = base.withColumn("_win", F.when(n >= WINDOW, windows).otherwise(F.array().cast("array<bigint>")))
    stop = F.size(F.filter("_w", lambda w: F.lower(w).isin(STOP_WORDS)))
    return base.select(
        id_col,
        *keep_columns,
        n.cast("long").alias("n_words"),
        (F.length("_t") - _count_of("_t", SPACE)).cast("long").alias("word_chars"),
        _count_of("_t", SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words().cast("long").alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        stop.cast("long").alias("n_stop_words"),
        _count_of("_t", "!").cast("long").alias("n_shouts"),
    )


def _count_of(col: str, chars: str) -> Column:
    return F.length(col) - F.length(F.translate(col, chars, ""))


def _repeat_words() -> Column:
    """Words covered by windows that occur again. Windows compare by 64-bit fingerprints within one text.

    Only texts with a repeated fingerprint sort their windows.
    """
    placed = F.transform("_win", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    # A one-element transform binds the sorted windows to a name.
    bound = F.transform(F.array(F.array_sort(placed)), _covered_words)
    return F.when(F.size(F.array_distinct("_win")) < F.size("_win"), F.element_at(bound, 1)).otherwise(F.lit(0))


def _covered_words(s: Column) -> Column:
    """Words in the union of the windows that share their fingerprint with a neighbour in the sorted ``s``."""
    again = F.filter(
        F.transform(s, lambda x, j: F.struct(x["i"].alias("i"), (F.coalesce((j > 0) & (x["h"] == F.get(s, j - 1)["h"]), F.lit(False)) | F.coalesce(x["h"] == F.get(s, j + 1)["h"], F.lit(False))).alias("again"))),
        lambda x: x["again"],
    )
    starts = F.array_sort(F.transform(again, lambda x: x["i"]))
    zero = F.struct(F.lit(-1_000_000).alias("last"), F.lit(0).cast("long").alias("total"))
    return F.aggregate(starts, zero, lambda acc, i: F.struct(i.alias("last"), (acc["total"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("total")), lambda acc: acc["total"])


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """The threshold table as one boolean expression over the columns of ``measures``."""
    ok = F.lit(True)
    for r in rules:
        num, den = F.col(r.numerator) * 100, F.col(r.denominator)
        inside = F.lit(True)
        if r.low is not None:
            inside = inside & (num >= den * r.low)
        if r.high is not None:
            inside = inside & (num <= den * r.high)
        ok = ok & ((F.col("n_words") < r.from_words) | inside)
    return ok


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, keep_columns: tuple[str, ...] = ()) -> DataFrame:
    """Counts and verdict for each document."""
    m = measures(docs, id_col, text_col, keep_columns)
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    return m.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & verdict(rules))
