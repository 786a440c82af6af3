"""Operator 1: document quality rules, run as a short-circuit cascade.

A document is kept when it passes every rule. The rules commute, so only their
order is a matter of cost: each rule's time and its verdicts are measured on a
sample, row by row in one task, and the cascade takes the rule with the most
rejections per unit of time first, then the one with the most among what that
rule leaves, and so on. The expressions are Spark built-ins joined by AND; the
generated filter code leaves a row at its first failed rule, and no row leaves
the JVM.

Results that hold by definition:

* a null, empty or blank text fails ``not_blank`` and is rejected; very long
  texts are read whole;
* columns other than the text are never read, so nulls in them change nothing
  and extra columns (whatever their names) pass through;
* equal rows get equal decisions: all are kept or all go;
* ties in the order go to the rule named first, and never change the result;
* an empty table gives an empty table.

The sample never touches the result, only the order of evaluation: it is the
first ``SAMPLE_ROWS`` texts of at most ``SAMPLE_LENGTH`` characters in as few
splits as hold them, and texts beyond that length are judged like all others.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import OWN, col, table

SYMBOLS = r"[#$%&*|~^<>{}\[\]\\=_@]"
CAPITALS = "[A-ZÀ-ÖØ-Þ]"
#: Words of personal abuse; one of them alone may be a plain statement, so a rule needs two, or one in a short text.
INSULTS = ("clown", "disgusting", "idiot", "loser", "moron", "pathetic", "scum", "stupid", "trash", "worthless")
ANY_INSULT = "(" + "|".join(INSULTS) + ")"

#: Rows of the sample on which costs and rejections are measured, their length at most, and how often each is judged.
SAMPLE_ROWS = 400
SAMPLE_LENGTH = 50_000
REPEATS = 5


@dataclass(frozen=True)
class Rule:
    """A rule: ``passes`` as Spark SQL over ``text``, and the same condition for DuckDB."""

    name: str
    passes: str
    duckdb: str


def _q(s: str) -> str:
    return s.replace("\\", "\\\\")


def _count(pattern: str) -> tuple[str, str]:
    """Occurrences of a pattern, in both dialects."""
    return f"regexp_count(text, '{_q(pattern)}')", f"len(regexp_extract_all(text, '{pattern}'))"


def _rules() -> tuple[Rule, ...]:
    symbols, symbols_d = _count(SYMBOLS)
    capitals, capitals_d = _count(CAPITALS)
    digits, digits_d = _count("[0-9]")
    # RE2's word boundary over lower case, in terms that all Java versions read alike
    insults = f"regexp_count(lower(text), '(?<![a-z0-9_]){ANY_INSULT}(?![a-z0-9_])')"
    insults_d = rf"len(regexp_extract_all(lower(text), '\b{ANY_INSULT}\b'))"
    words = "(length(text) - length(replace(text, ' ', '')) + 1)"
    lines, lines_d = "split(text, '\\n')", "string_split(text, chr(10))"
    # words that equal the next one; a match consumes one word, so a run of n counts n - 1
    same = r"regexp_count(text, '(?<![^ ])([^ ]++)(?= \\1(?![^ ]))')"
    split_d = "string_split(text, ' ')"
    same_d = f"len(list_filter(list_zip({split_d}[:-2], {split_d}[2:]), lambda x: x[1] = x[2] and x[1] <> ''))"
    return (
        Rule("not_blank", "length(trim(text)) > 0", "length(trim(text)) > 0"),
        Rule("symbols", f"{symbols} <= 0.05 * length(text)", f"{symbols_d} <= 0.05 * length(text)"),
        Rule("capitals", f"length(text) < 100 or {capitals} <= 0.3 * length(text)", f"length(text) < 100 or {capitals_d} <= 0.3 * length(text)"),
        Rule("digits", f"{digits} <= 0.5 * length(text)", f"{digits_d} <= 0.5 * length(text)"),
        Rule("word_length", f"length(text) <= 14 * {words}", f"length(text) <= 14 * {words}"),
        Rule(
            "repeated_lines",
            f"size({lines}) < 4 or size(array_distinct({lines})) >= 0.6 * size({lines})",
            f"len({lines_d}) < 4 or len(list_distinct({lines_d})) >= 0.6 * len({lines_d})",
        ),
        Rule("stutter", f"{words} < 20 or {same} <= 0.1 * {words}", f"{words} < 20 or {same_d} <= 0.1 * {words}"),
        Rule("abuse", f"{insults} <= least(1, {words} / 20)", f"{insults_d} <= least(1, {words} / 20)"),
    )


RULES = _rules()


def _condition(rule: Rule, text: Column) -> Column:
    """The rule over another column; a rule that is unknown (null text) is failed."""
    return F.coalesce(F.expr(rule.passes.replace("text", f"{OWN}text")), F.lit(False))


def measure(sample: DataFrame, rules: tuple[Rule, ...] = RULES, repeats: int = REPEATS) -> tuple[np.ndarray, np.ndarray]:
    """(nanoseconds of each rule a row, whether each row fails each rule) on a bounded sample of texts.

    One task reads the clock between the rules of each row. The median of the
    later repeats counts, so that neither compiling nor another job's load does.
    """
    clock = F.expr("cast(reflect('java.lang.System', 'nanoTime') as bigint)")
    text = F.col(f"{OWN}text")
    steps = [clock.alias("t0")]
    for i, rule in enumerate(rules):
        steps += [_condition(rule, text).alias(f"p{i}"), clock.alias(f"t{i + 1}")]
    again = sample.coalesce(1).withColumn(f"{OWN}again", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    got = again.select(f"{OWN}again", f"{OWN}row", *steps).toPandas()
    if not len(got):
        return np.ones(len(rules)), np.zeros((0, len(rules)), bool)
    spent = np.stack([(got[f"t{i + 1}"] - got[f"t{i}"]).to_numpy() for i in range(len(rules))], axis=1)
    late = (got[f"{OWN}again"] > repeats // 2).to_numpy()
    last = (got[f"{OWN}again"] == repeats).to_numpy()
    rows = got[f"{OWN}row"].to_numpy()[late]
    order = np.argsort(rows, kind="stable")
    each = np.median(spent[late][order].reshape(len(np.unique(rows)), -1, len(rules)), axis=1)
    fails = ~np.stack([got[f"p{i}"].to_numpy(bool) for i in range(len(rules))], axis=1)[last]
    return np.maximum(each.mean(axis=0), 1.0), fails


def greedy(cost: np.ndarray, fails: np.ndarray) -> list[int]:
    """The cascade's order: most rejections of what is left per cost first; what rejects nothing any more, cheapest first."""
    left, alive, order = list(range(len(cost))), np.ones(len(fails), bool), []
    while left:
        best = max(left, key=lambda r: (fails[alive, r].sum() / cost[r], -cost[r], -r))
        order.append(best)
        left.remove(best)
        alive &= ~fails[:, best]
    return order


def order_rules(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The order of the cascade, from a sample of at most ``rows`` documents (only the order depends on it)."""
    spark, text = docs.sparkSession, col(text_col).cast("string")
    # taken split by split until there are enough: at most rows x SAMPLE_LENGTH characters come to the driver
    some = docs.select(text.alias("t")).where(F.length("t") <= SAMPLE_LENGTH).take(rows)
    sample = spark.createDataFrame([(i, r["t"]) for i, r in enumerate(some)], f"{OWN}row int, {OWN}text string")
    return [rules[i] for i in greedy(*measure(sample, rules))]


def quality_filter(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that pass all rules, with all their columns."""
    text = col(text_col).cast("string")
    passed = docs.withColumn(f"{OWN}text", text)
    for rule in order_rules(docs, text_col, rules):
        passed = passed.where(_condition(rule, F.col(f"{OWN}text")))
    return passed.drop(f"{OWN}text")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_filter(table(spark, sf_dir, "documents")).select("doc_id", "lang", "source", "n_chars")


SQL = "SELECT doc_id, lang, source, n_chars FROM documents WHERE " + " AND ".join(f"coalesce({r.duckdb}, false)" for r in RULES)
