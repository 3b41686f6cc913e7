"""Quality rules as a short-circuit cascade of column expressions, the cheapest rejection first."""

import random
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from piisieve.functions.arrays import let
from piisieve.llm.common import SPACE

# Rows on which costs and selectivities are estimated, drawn from all partitions with a fixed seed; timed runs per rule.
# They only order the rules; the verdict is the same in any order.
SAMPLE_ROWS = 500
SAMPLE_SEED = 17
TIMINGS = 3

FEWEST_WORDS = 10
REPEAT_PERCENT = 20
WINDOW_WORDS = 5


def spaced(text: Column) -> Column:
    """The words of a text with one space between them; empty for null."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), f"[{SPACE}]+", " "))


def _without_spaces(words: Column) -> Column:
    return F.length(F.replace(words, F.lit(" "), F.lit("")))


def word_chars(text: Column) -> Column:
    return _without_spaces(spaced(text)).cast("long")


def _count_words(words: Column) -> Column:
    return F.when(words == "", 0).otherwise(F.length(words) - _without_spaces(words) + 1).cast("long")


def n_words(text: Column) -> Column:
    return let(spaced(text), _count_words)


def n_symbols(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[#*$%&|<>]")), F.lit(0)).cast("long")


def lines_with_words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda line: line.rlike(f"[^{SPACE}]"))


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that are equal to an earlier line."""
    return let(lines_with_words(text), lambda lines: F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def n_repeat_words(text: Column) -> Column:
    """Words covered by 5-word windows that stand twice or more in the text."""
    return _count_repeated(spaced(text))


def _count_repeated(words: Column) -> Column:
    """`n_repeat_words` of spaced words.

    Windows come from one pattern with a look-ahead. Most texts repeat none, which a set of the windows tells;
    only the others sort them to find the equal ones and add up what these cover.
    """
    # The window is looked at, then one word is passed, so that each match begins at a word.
    window = rf"(?=([^ ]++(?: [^ ]++){{{WINDOW_WORDS - 1}}}))[^ ]++ ?"

    def covered(windows: Column) -> Column:
        placed = F.sort_array(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))

        def starts(rows: Column) -> Column:
            def repeated(row: Column, at: Column) -> Column:
                after = F.get(rows, at + 1)["w"] == row["w"]
                before = F.when(at > 0, F.get(rows, at - 1)["w"] == row["w"])
                return F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False))

            return F.sort_array(F.transform(F.filter(rows, repeated), lambda row: row["i"]))

        return F.aggregate(
            let(placed, starts),
            F.struct(F.lit(-WINDOW_WORDS).alias("last"), F.lit(0).alias("n")),
            lambda sum_, at: F.struct(
                at.alias("last"), (sum_["n"] + F.least(F.lit(WINDOW_WORDS), at - sum_["last"])).alias("n")
            ),
            lambda sum_: sum_["n"],
        )

    return let(
        F.regexp_extract_all(words, F.lit(window), 1),
        lambda windows: F.when(F.size(windows) == F.size(F.array_distinct(windows)), 0).otherwise(covered(windows)),
    ).cast("long")


@dataclass(frozen=True)
class Rule:
    """`rejects` gives, for a text column, whether the text is bad; null counts as no."""

    name: str
    rejects: Callable[[Column], Column]


def _odd_word_length(text: Column) -> Column:
    def odd(words: Column) -> Column:
        return ~(F.length(words) / (F.length(words) - _without_spaces(words) + 1)).between(2.5, 15)

    return let(spaced(text), odd)


def _per_words(pattern: str) -> Callable[[Column], Column]:
    """Whether the pattern matches more than 0.2 times per word. Words are counted only where it matches at all."""

    def rejects(text: Column) -> Column:
        return let(F.regexp_count(text, F.lit(pattern)), lambda n: F.when(n > 0, 10 * n > 2 * n_words(text)))

    return rejects


BASE_RULES = [
    Rule("few words", lambda text: n_words(text) < FEWEST_WORDS),
    Rule("repeated words", lambda text: 100 * n_repeat_words(text) > REPEAT_PERCENT * n_words(text)),
]
METHOD_RULES = [
    Rule("symbols", _per_words(r"[#*$%&|<>]")),
    Rule("repeated lines", lambda text: 10 * n_dup_lines(text) > 3 * F.size(lines_with_words(text))),
    Rule("word length", _odd_word_length),
    Rule("shouting", _per_words("[!?]{2,}")),
    Rule("capitals", lambda text: 2 * F.regexp_count(text, F.lit(r"\p{Lu}")) > word_chars(text)),
]


def ordered(df: DataFrame, rules: Sequence[Rule], *, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by falling share of rejected rows per second, both measured on a sample of about `sample_rows` rows.

    The sample is drawn with one seeded Bernoulli fraction from all partitions (the fraction from the row count, which a
    file scan takes from its footers), so it stands for the whole table and not its first files. The rejections of all
    rules come from one aggregate over the sample; the cost of each is the least of `TIMINGS` timed runs over the cached
    sample, less that of a run that evaluates nothing. Without rows the order stays. Only the order depends on the
    sample: the verdict is the same in any order.
    """
    rows = df.count()
    if rows == 0 or not rules:
        return list(rules)
    spark = df.sparkSession
    fraction = min(1.0, 2.0 * sample_rows / rows)
    # All of the drawn rows (twice `sample_rows` expected), then a seeded choice: a limit would stop at the first partitions.
    drawn = df.select(F.col(text_col).alias("text")).sample(fraction=fraction, seed=SAMPLE_SEED).collect()
    chosen = random.Random(SAMPLE_SEED).sample(drawn, min(len(drawn), sample_rows))
    sample = spark.createDataFrame(chosen, "text string").coalesce(1).cache()
    text = F.col("text")
    flags = [F.sum(F.coalesce(rule.rejects(text), F.lit(False)).cast("int")).alias(f"r{i}") for i, rule in enumerate(rules)]
    counted = sample.agg(F.count(F.lit(1)).alias("n"), *flags).first()
    size = max(1, counted["n"])

    def seconds(verdict: Column) -> float:
        best = float("inf")
        for _ in range(TIMINGS):
            begun = time.perf_counter()
            sample.agg(F.sum(F.coalesce(verdict, F.lit(False)).cast("int"))).collect()
            best = min(best, time.perf_counter() - begun)
        return best

    least = seconds(F.length(text) < 0)
    rated = []
    for at, rule in enumerate(rules):
        share = counted[f"r{at}"] / size
        rated.append((-share / max(seconds(rule.rejects(text)) - least, 1e-3), at, rule))
    sample.unpersist()
    return [rule for _, _, rule in sorted(rated, key=lambda r: r[:2])]


def cascade(rules: Sequence[Rule], text: Column) -> Column:
    """Whether a text passes all rules. A rule is evaluated only if the ones before it have not rejected the text."""
    if not rules:
        return F.lit(True)
    chain = F.when(F.coalesce(rules[0].rejects(text), F.lit(False)), False)
    for rule in rules[1:]:
        chain = chain.when(F.coalesce(rule.rejects(text), F.lit(False)), False)
    return chain.otherwise(True)


def passes_rules(df: DataFrame, rules: Sequence[Rule] = (*BASE_RULES, *METHOD_RULES), *, text_col: str = "text") -> Column:
    """The cascade of `rules` for the texts of `df`, in the order that a sample of its rows suggests.

    A null or empty text has no words and is rejected by the rule on few words.
    """
    return cascade(ordered(df, rules, text_col=text_col), F.col(text_col))


def quality_rules(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept).

    Null texts count as empty; repeated rows give repeated results; other columns are not read. One narrow
    pass of column expressions. Very long texts are judged whole; an empty table gives an empty result (and the
    rules keep their written order).
    """
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    verdict = passes_rules(docs, METHOD_RULES)
    text = F.col("text")
    # Also bound once: the words with single spaces, from which three of the counts come.
    docs = docs.withColumn("words", spaced(text))
    counted = docs.select(
        "id",
        "text",
        _count_words(F.col("words")).alias("n_words"),
        _without_spaces(F.col("words")).cast("long").alias("word_chars"),
        n_symbols(text).alias("n_symbols"),
        n_dup_lines(text).alias("n_dup_lines"),
        _count_repeated(F.col("words")).alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < FEWEST_WORDS) | (
        100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")
    )
    counted = counted.withColumn("base_failed", failed)
    return counted.withColumn("kept", F.when(F.col("base_failed"), False).otherwise(verdict)).drop("text").withColumnRenamed("id", id_col)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
