"""Quality rules: a table of thresholds compiled into one projection.

Counts of a text (words, characters, symbols, repeated lines and windows, stop
words, line ends) are column expressions; each rule bounds the ratio of two of
them, and the table compiles into one expression. No user function and
no shuffle: a text is judged by its own row.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathweave.llm.common import WORD, count_of, let, no_name_clash, without_space

#: Frequent function words of the languages served.
STOP_WORDS = (
    "the of and to in a is that for it as with was on be by this are from or an at "
    "der die und den von zu das mit sich des auf für ist im dem nicht ein eine "
    "de la le et les des en un du une que est pour qui dans par pas sur au avec "
    "el los del se las por con para su al lo como más y"
).split()


class Rule(NamedTuple):
    """low <= over / under <= high; a rule without ``under`` bounds ``over`` itself. A ratio over 0 holds."""

    name: str
    over: str
    under: str | None
    low: float | None
    high: float | None


#: The thresholds.
BASE_MIN_WORDS, BASE_REPEAT_PERCENT = 50, 50
RULES = (
    Rule("too_long", "n_words", None, None, 2_000_000),
    Rule("word_length", "word_chars", "n_words", 2.0, 15.0),
    Rule("symbols", "n_symbols", "n_words", None, 0.25),
    Rule("stop_words", "n_stop", "n_words", 0.02, None),
    Rule("repeated_lines", "n_dup_lines", "n_lines", None, 0.5),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", None, 0.9),
    Rule("cut_lines", "n_cut_lines", "n_lines", None, 0.3),
)
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_stop", "n_lines", "n_bullet_lines", "n_cut_lines"]
OUTPUTS = [*COUNTS, *MORE, "base_failed", "failed_rules", "kept"]

SYMBOL = "[#*$%&|<>]"


def repeated_words(words: Column) -> Column:
    """Words that lie in a window of three words found twice or more in the text.

    Windows are hashed first; where all hashes differ, nothing repeats. Else the
    windows are sorted with their places, so equal ones are neighbours, and the
    places of those with an equal neighbour are put in order again: each covers
    the words from its place that the one before has not covered.
    """
    windows = F.transform(
        F.sequence(F.lit(1), F.size(words) - 2), lambda i: F.concat_ws(" ", words[i - 1], words[i], words[i + 1]))

    def covered(w: Column) -> Column:
        return let(F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("w"), i.alias("i")))), lambda s: let(
            F.sort_array(F.filter(F.transform(s, lambda x, j: F.when(
                (x["w"] == F.get(s, j - 1)["w"]) | (x["w"] == F.get(s, j + 1)["w"]), x["i"])), lambda i: i.isNotNull())),
            lambda at: F.aggregate(F.transform(at, lambda i, j: F.least(
                F.lit(3), F.coalesce(i - F.get(at, j - 1), F.lit(3)))), F.lit(0), lambda a, x: a + x)))

    def count(w: Column) -> Column:
        unlike = let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: F.size(F.array_distinct(h)) == F.size(h))
        return F.when(unlike, F.lit(0)).otherwise(covered(w))

    return F.when(F.size(words) < 4, F.lit(0)).otherwise(let(windows, count))


def compile_rules(rules: tuple[Rule, ...] = RULES) -> Column:
    """Names of the rules that a row's counts break, as one array expression."""
    def broken(r: Rule) -> Column:
        value = F.col(r.over) if r.under is None else F.col(r.over) / F.nullif(F.col(r.under), F.lit(0))
        out = [value < r.low] if r.low is not None else []
        out += [value > r.high] if r.high is not None else []
        bad = out[0] if len(out) == 1 else out[0] | out[1]
        return F.when(F.coalesce(bad, F.lit(False)), F.lit(r.name))

    return F.array_compact(F.array(*[broken(r) for r in rules]))


def counts(text: Column) -> Column:
    """All counts of a text as one struct; null is the empty text."""
    t = F.coalesce(text, F.lit(""))

    def of_lines(lines: Column) -> list[Column]:
        return [
            (F.size(lines) - F.size(F.array_distinct(lines))).alias("n_dup_lines"),
            F.size(lines).alias("n_lines"),
            F.size(F.filter(lines, lambda x: F.substring(F.ltrim(x), 1, 1).isin("-", "*", "•", "‣"))).alias("n_bullet_lines"),
            F.size(F.filter(lines, lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…"))).alias("n_cut_lines"),
        ]

    def of(x: Column) -> Column:
        words, lines = x["words"], x["lines"]
        return F.struct(
            F.size(words).alias("n_words"),
            F.length(without_space(t)).alias("word_chars"),
            count_of(t, SYMBOL).alias("n_symbols"),
            repeated_words(words).alias("n_repeat_words"),
            F.size(F.filter(words, lambda w: F.lower(w).isin(STOP_WORDS))).alias("n_stop"),
            *of_lines(lines))

    parts = F.struct(F.regexp_extract_all(t, F.lit(WORD), F.lit(0)).alias("words"),
                     F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD)).alias("lines"))
    return let(parts, of)


def judge(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with the counts, base_failed, failed_rules and kept.

    Null and empty texts have no words, so they fail the base rules. Every row is
    judged alone: repeated rows repeat their verdict, extra columns stay, input
    columns named like an output are replaced, an empty table gives an empty table.
    """
    c = F.col("_counts")
    rest = no_name_clash(docs, [x for x in OUTPUTS if x != text])
    out = rest.withColumn("_counts", counts(F.col(text))).select(
        *[F.col(x) for x in rest.columns], *[c[x].cast("bigint").alias(x) for x in [*COUNTS, *MORE]])
    base = (F.col("n_words") < BASE_MIN_WORDS) | (100 * F.col("n_repeat_words") > BASE_REPEAT_PERCENT * F.col("n_words"))
    out = out.withColumn("base_failed", base).withColumn("failed_rules", compile_rules(rules))
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
