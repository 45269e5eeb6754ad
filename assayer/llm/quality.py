"""Quality rules: a decision list learned from labelled statistics, as one ordered Spark expression.

Every text gets exact counts (words, characters in words, symbols, repeated lines, words in repeated three-word
windows) and ratios of them. The list is learned by sequential covering. A rule is a conjunction of thresholds on
ratios; it is grown on two thirds of the labelled rows by the gain in information about bad texts, pruned on the rest
to the prefix with the best balance of bad and good, and kept if it is precise enough there; then the rows it covers
are set aside and the next is grown. What remains is good. The list is a chain of ``when`` expressions in that order.

All work is DataFrame operations. Counts of a text are array expressions in its own row: three-word windows are
hashed, packed with their place into one integer and sorted, and neighbours with equal hash are compared word by
word. Learning turns each ratio into its place on a fixed ladder of thresholds; every step is one grouped count by
(ratio, place), which returns at most a few hundred rows, over all learnable labelled rows, without sampling. The
narrow table of counts is written once and used for learning and for the verdict.

* null text: no words, all counts 0. Null ids and null labels are not learned; several labels of an id: the lowest.
* no labels or only one kind: the list is empty, and only the base rule (under 50 words, or more than half of the
  words in repeated windows) rejects. Repeated rows: one output row each; empty table: no rows. Very long texts:
  memory in proportion to the text.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from assayer.functions.columns import quoted
from assayer.functions.cutting import checkpointed
from assayer.llm.common import held_out, query, table

SPACE = r"[\x20\x09-\x0D]"
MIN_WORDS = 50

#: Ladders of thresholds a rule may use.
RATIOS = (0.01, 0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0, 1.5, 2.0, 3.0)
LADDERS: dict[str, tuple[float, ...]] = {
    "symbol_ratio": RATIOS, "dup_line_ratio": RATIOS, "repeat_ratio": RATIOS, "upper_ratio": RATIOS,
    "mark_ratio": RATIOS, "digit_ratio": RATIOS,
    "mean_word": (2.0, 2.5, 3.0, 3.5, 4.0, 4.5, 5.0, 5.5, 6.0, 6.5, 7.0, 8.0, 9.0, 10.0, 12.0, 15.0, 20.0),
    "words": (1.0, 5.0, 10.0, 20.0, 50.0, 100.0, 200.0, 500.0, 1e3, 2e3, 5e3, 1e4),
}
MAX_RULES = 8
MAX_CONDITIONS = 3
MIN_PRECISION = 0.75
MIN_COVERED = 5


def _packed() -> Column:
    """Sorted (hash of a three-word window, place of the window), one integer each."""
    def one(i: Column) -> Column:
        h = F.xxhash64(F.get("__codes", i), F.get("__codes", i + 1), F.get("__codes", i + 2))
        return h.bitwiseAND(-F.col("__two")).bitwiseOR(i.cast("bigint"))

    return F.sort_array(F.transform(F.sequence(F.lit(0), F.col("n_words").cast("int") - 3), one))


def _place(t: Column) -> Column:
    return F.get("__packed", t).bitwiseAND(F.col("__two") - 1).cast("int")


def _same(t: Column) -> Column:
    a, b = _place(t), _place(t - 1)
    close = F.get("__packed", t).bitwiseXOR(F.get("__packed", t - 1)).bitwiseAND(-F.col("__two")) == 0
    words = [F.get("__codes", a + k) == F.get("__codes", b + k) for k in range(3)]
    return close & words[0] & words[1] & words[2]


def measure(df: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` with the counts of each row's text."""
    body = F.coalesce(quoted(text), F.lit(""))
    lines = F.filter(F.split(body, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    first = df.select(
        *(quoted(c) for c in keep),
        F.filter(F.split(body, SPACE + "+"), lambda w: w != "").alias("__words"),
        lines.alias("__lines"),
        F.regexp_count(body, F.lit(r"[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        F.regexp_count(body, F.lit(r"\p{Lu}")).cast("bigint").alias("n_upper"),
        F.regexp_count(body, F.lit(r"[0-9]")).cast("bigint").alias("n_digits"),
        F.regexp_count(body, F.lit(r"[!?;:\x22'(){}=/_~^-]|\[|\]")).cast("bigint").alias("n_marks"),
    )
    names = [*(quoted(c) for c in keep), "n_symbols", "n_upper", "n_digits", "n_marks"]
    second = first.select(
        *names,
        F.size("__words").cast("bigint").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("bigint").alias("word_chars"),
        F.size("__lines").cast("bigint").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("bigint").alias("n_dup_lines"),
        F.transform("__words", lambda w: F.xxhash64(w)).alias("__codes"),
    )
    names += ["n_words", "word_chars", "n_lines", "n_dup_lines"]
    many = F.col("n_words") >= 4
    third = second.select(
        *names, "__codes",
        F.expr("shiftleft(1L, cast(ceil(log2(greatest(n_words, 2))) as int))").alias("__two"),
    )
    fourth = third.select(*names, "__codes", "__two", F.when(many, _packed()).alias("__packed"))
    pairs = F.filter(F.sequence(F.lit(1), F.size("__packed") - 1), _same)
    fifth = fourth.select(*names, "__packed", "__two", F.when(many, pairs).alias("__pairs"))
    starts = F.sort_array(
        F.array_distinct(F.concat(F.transform("__pairs", _place), F.transform("__pairs", lambda t: _place(t - 1))))
    )
    sixth = fifth.select(*names, F.when(F.size("__pairs") > 0, starts).alias("__starts"))
    gaps = F.aggregate(
        F.sequence(F.lit(1), F.size("__starts") - 1), F.lit(3),
        lambda n, k: n + F.least(F.lit(3), F.get("__starts", k) - F.get("__starts", k - 1)),
    )
    return sixth.select(*names, F.coalesce(F.when(F.col("__starts").isNotNull(), gaps), F.lit(0)).cast("bigint").alias("n_repeat_words"))


def ratios() -> dict[str, Column]:
    def share(n: str, of: str) -> Column:
        return F.when(F.col(of) > 0, F.col(n) / F.col(of)).otherwise(F.lit(0.0))

    return {
        "symbol_ratio": share("n_symbols", "n_words"), "dup_line_ratio": share("n_dup_lines", "n_lines"),
        "repeat_ratio": share("n_repeat_words", "n_words"), "upper_ratio": share("n_upper", "word_chars"),
        "mark_ratio": share("n_marks", "n_words"), "digit_ratio": share("n_digits", "word_chars"),
        "mean_word": share("word_chars", "n_words"), "words": F.col("n_words").cast("double"),
    }


@dataclass(frozen=True)
class Condition:
    ratio: str
    at_least: bool
    threshold: float

    def column(self) -> Column:
        value = ratios()[self.ratio]
        return value >= self.threshold if self.at_least else value < self.threshold

    def on_places(self) -> Column:
        place = LADDERS[self.ratio].index(self.threshold)
        return F.col(self.ratio) > place if self.at_least else F.col(self.ratio) <= place


def _all(conditions: Sequence[Condition], places: bool = True) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & (c.on_places() if places else c.column())
    return out


def _covered(rules: Sequence[Sequence[Condition]]) -> Column:
    out = F.lit(False)
    for r in rules:
        out = out | _all(r)
    return out


def _grow(rows: DataFrame) -> tuple[Condition, int, int] | None:
    """The condition with the most information gain over ``rows`` and the bad and good rows that meet it."""
    cells = F.array(*(F.struct(F.lit(n).alias("ratio"), F.col(n).alias("place")) for n in LADDERS))
    counts = (
        rows.select("bad", F.inline(cells)).groupBy("ratio", "place")
        .agg(F.sum("bad").alias("p"), F.sum(1 - F.col("bad")).alias("n")).collect()
    )
    table_of = {(r["ratio"], r["place"]): (r["p"], r["n"]) for r in counts}
    best: tuple[float, tuple, Condition, int, int] | None = None
    for name, ladder in LADDERS.items():
        each = [table_of.get((name, k), (0, 0)) for k in range(len(ladder) + 1)]
        whole = (sum(p for p, _ in each), sum(n for _, n in each))
        if not whole[0]:
            return None
        p = n = 0
        for k, threshold in enumerate(ladder):
            p, n = p + each[k][0], n + each[k][1]
            for at_least, (a, b) in ((False, (p, n)), (True, (whole[0] - p, whole[1] - n))):
                if a < MIN_COVERED or (a, b) == whole:
                    continue
                gain = a * (math.log2(a / (a + b)) - math.log2(whole[0] / sum(whole)))
                rank = (gain, (name, not at_least, -k))
                if best is None or rank > best[:2]:
                    best = (*rank, Condition(name, at_least, threshold), a, b)
    return None if best is None or best[0] <= 0 else best[2:]


def learn(measured: DataFrame, labels: DataFrame, learnable: Column, key: str = "doc_id", label: str = "quality") -> list[tuple[Condition, ...]]:
    """The ordered rules that reject; labels of 0 are bad."""
    marks = (
        labels.where(quoted(label).isNotNull() & quoted(key).isNotNull())
        .groupBy(quoted(key).alias("__key")).agg(F.min(quoted(label)).alias("__label"))
    )
    places = {
        n: sum(((F.col(f"__{n}") >= t).cast("int") for t in ladder), F.lit(0)).cast("int") for n, ladder in LADDERS.items()
    }
    values = ratios()
    rows = checkpointed(
        measured.where(learnable).join(marks, quoted(key) == F.col("__key"))
        .select((F.col("__label") <= 0).cast("int").alias("bad"), F.pmod(F.xxhash64("__key"), F.lit(3)).alias("__part"),
                *(v.alias(f"__{n}") for n, v in values.items()))
        .select("bad", "__part", *(c.alias(n) for n, c in places.items()))
    )
    grown, held = rows.where("__part > 0"), rows.where("__part = 0")
    rules: list[tuple[Condition, ...]] = []
    while len(rules) < MAX_RULES:
        left, conditions = grown.where(~_covered(rules)), []
        while len(conditions) < MAX_CONDITIONS:
            found = _grow(left.where(_all(conditions)))
            if found is None:
                break
            conditions.append(found[0])
            if found[2] <= 0.01 * found[1]:
                break
        if not conditions:
            break
        prefixes = [conditions[: k + 1] for k in range(len(conditions))]
        sums = [
            e for k, c in enumerate(prefixes)
            for e in (F.sum(F.when(_all(c), F.col("bad")).otherwise(0)).alias(f"p{k}"),
                      F.sum(F.when(_all(c), 1 - F.col("bad")).otherwise(0)).alias(f"n{k}"))
        ]
        seen = held.where(~_covered(rules)).agg(*sums).first()
        worth = [
            ((p - n) / (p + n) if p + n else -1.0, -k, p, n)
            for k in range(len(prefixes)) for p, n in [(seen[f"p{k}"] or 0, seen[f"n{k}"] or 0)]
        ]
        _, k, p, n = max(worth)
        if p + n == 0 or p / (p + n) < MIN_PRECISION:
            break
        rules.append(tuple(prefixes[-k]))
    return rules


def rule_of(rules: Sequence[Sequence[Condition]]) -> Column:
    """Number of the first rule that rejects a measured row, from 1; 0 if none does."""
    out = F.lit(0)
    for k in range(len(rules), 0, -1):
        out = F.when(_all(rules[k - 1], places=False), F.lit(k)).otherwise(out)
    return out


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@query("op8_quality_rules")
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document, rules learned from the rows that are not held out."""
    measured = checkpointed(measure(table(spark, sf_dir, "documents")))
    rules = learn(measured, table(spark, sf_dir, "labels"), ~held_out(F.col("doc_id")))
    return measured.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"), (~base_failed() & (rule_of(rules) == 0)).alias("kept"),
        rule_of(rules).alias("rule"),
    )
