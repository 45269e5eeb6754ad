"""Mixing sources to target weights by raking, then sampling documents by calibrated probabilities.

Tokens are summed over cells of source, language and topic. Iterative proportional fitting scales the cell sums to
each margin's target shares in turn, ``ROUNDS`` times; a cell's weight is its fitted over its actual share. Documents
of a cell are kept with probability min(1, c * weight), where c is calibrated on the cells so that the expected
number of tokens is the budget. A document's draw is a hash of its id, so it is repeatable and needs no order.

Default targets temper the corpus' own shares, share ** ``TEMPER`` made to sum to one: large sources, languages and
topics give way to small ones. Targets may also be given. The cells stay a Spark table however many there are; a
step of a round is a window sum over one margin of it. Documents are only summed into cells, map-side first, and joined with cells'
probabilities; a source with a third of all rows is one row of a margin.

* a null margin value is a group of its own; null or empty text has no tokens and the weight of its cell; a cell
  without tokens has weight 1; values without a target keep their share. Null ids draw as the empty text.
* repeated rows share a draw when their ids are equal; empty table: no rows; other columns pass unchanged, except
  that names beginning with ``__mix`` are taken.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from assayer.functions.columns import quoted
from assayer.functions.cutting import checkpointed
from assayer.llm.common import query, table, uniform

MARGINS = ("source", "lang", "topic")
TEMPER = 0.7
ROUNDS = 8
KEEP_SHARE = 0.6
#: Cells that are broadcast to the documents; more are joined.
MAX_CELLS = 100_000
SEED = "mix"
#: Fills for cells that c alone would lift above one.
CALIBRATIONS = 12


def topic_of(text: Column) -> Column:
    """A coarse kind of text, for tables without a topic column."""
    return (
        F.when(text.rlike("[Ll]icen[sc]"), "license").when(text.rlike("@[a-z0-9]"), "contact")
        .when(text.rlike("[#$%&|<>]"), "marked").when(F.length(text) < 1000, "short").when(text.isNull(), "none")
        .otherwise("long")
    )


def tokens_of(text: Column) -> Column:
    """Words between blanks."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t-\r]+")), F.lit(0)).cast("bigint")


def tempered(cells: DataFrame, margin: str, temper: float) -> DataFrame:
    """(value, target share) from the corpus' own shares."""
    sums = cells.groupBy(margin).agg(F.sum("__mix_tokens").alias("__mix_n"))
    lifted = sums.select(margin, F.pow(F.col("__mix_n").cast("double"), F.lit(temper)).alias("__mix_p"))
    whole = lifted.agg(F.sum("__mix_p").alias("__mix_s"))
    return lifted.join(F.broadcast(whole)).select(margin, (F.col("__mix_p") / F.col("__mix_s")).alias("__mix_target"))


def rake(
    cells: DataFrame, margins: Sequence[str] = MARGINS, targets: dict[str, DataFrame] | None = None,
    temper: float = TEMPER, rounds: int = ROUNDS,
) -> DataFrame:
    """``cells`` (margins, __mix_tokens) with __mix_fitted: tokens scaled to all margins' target shares."""
    cells = checkpointed(cells)
    whole = cells.agg(F.sum("__mix_tokens").alias("__mix_all"))
    fitted, goals = cells.withColumn("__mix_fitted", F.col("__mix_tokens").cast("double")), {}
    for i, m in enumerate(margins):
        given = (targets or {}).get(m)
        share = tempered(cells, m, temper) if given is None else given.toDF(m, "__mix_target")
        goals[m] = f"__mix_goal{i}"
        goal = share.toDF("__mix_value", "__mix_target").join(F.broadcast(whole)).select(
            "__mix_value", (F.col("__mix_target") * F.col("__mix_all")).alias(goals[m])
        )
        fitted = fitted.join(goal, F.col(m).eqNullSafe(F.col("__mix_value")), "left").drop("__mix_value")
    for _ in range(rounds):
        for m in margins:
            now = F.sum("__mix_fitted").over(Window.partitionBy(m))
            scale = F.when(now > 0, F.coalesce(F.col(goals[m]) / now, F.lit(1.0))).otherwise(F.lit(1.0))
            fitted = fitted.withColumn("__mix_fitted", F.col("__mix_fitted") * scale)
    return checkpointed(fitted.drop(*goals.values()))


def probabilities(fitted: DataFrame, margins: Sequence[str], budget_share: float = KEEP_SHARE) -> DataFrame:
    """(margins, weight, probability): min(1, c * weight), c such that the expected tokens are the budget."""
    weighed = fitted.withColumn(
        "weight",
        F.when(F.col("__mix_tokens") > 0, F.col("__mix_fitted") / F.col("__mix_tokens")).otherwise(F.lit(1.0)),
    )
    full = F.col("__mix_c") * F.col("weight") >= 1
    c = 0.0
    for _ in range(CALIBRATIONS):
        sums = weighed.withColumn("__mix_c", F.lit(c)).agg(
            F.sum("__mix_tokens").alias("all"),
            F.sum(F.when(full, F.col("__mix_tokens")).otherwise(0)).alias("full"),
            F.sum(F.when(~full, F.col("__mix_tokens") * F.col("weight")).otherwise(0.0)).alias("rest"),
        ).first()
        if not sums["rest"]:
            break
        following = (budget_share * sums["all"] - sums["full"]) / sums["rest"]
        if following <= c * (1 + 1e-12):
            break
        c = following
    return weighed.select(*margins, "weight", F.least(F.lit(1.0), F.lit(c) * F.col("weight")).alias("probability"))


def mix(
    df: DataFrame, text: str = "text", key: str = "doc_id", margins: Sequence[str] = MARGINS,
    targets: dict[str, DataFrame] | None = None, temper: float = TEMPER, budget_share: float = KEEP_SHARE,
    seed: str = SEED, rounds: int = ROUNDS,
) -> DataFrame:
    """``df`` with __mix_tokens, weight, probability and chosen; a missing topic column is made by ``topic_of``."""
    names = [f"__mix_m{i}" for i in range(len(margins))]
    value = [
        quoted(m) if m.lower() in [c.lower() for c in df.columns] else topic_of(quoted(text)) for m in margins
    ]
    marked = df.withColumns({**dict(zip(names, value)), "__mix_tokens": tokens_of(quoted(text))})
    cells = marked.groupBy(*names).agg(F.sum("__mix_tokens").alias("__mix_tokens"))
    renamed = {n: targets[m] for n, m in zip(names, margins) if targets and m in targets}
    chances = probabilities(rake(cells, names, renamed, temper, rounds), names, budget_share)
    chances = chances.toDF(*(f"{n}c" for n in names), "weight", "probability")
    clash = [c for c in df.columns if c.lower() in ("weight", "probability", "chosen")]
    # Few cells go to the documents, so that no document moves and no busy cell meets in one task; many are joined.
    chances = checkpointed(chances)
    few = len(chances.take(MAX_CELLS + 1)) <= MAX_CELLS
    joined = marked.drop(*clash).join(
        F.broadcast(chances) if few else chances, [F.col(n).eqNullSafe(F.col(f"{n}c")) for n in names]
    )
    return joined.drop(*(f"{n}c" for n in names)).withColumn(
        "chosen", uniform(quoted(key), seed) < F.col("probability")
    )


def oracle() -> str:
    steps, now = [], "c0"
    for k in range(ROUNDS):
        for m in MARGINS:
            following = f"{now}_{m}" if m != MARGINS[-1] else f"c{k + 1}"
            steps.append(
                f"{following} AS MATERIALIZED (SELECT c.source, c.lang, c.topic, c.tokens, c.fitted * coalesce(CASE WHEN s.now > 0 "
                f"THEN g.goal / s.now END, 1.0) AS fitted FROM {now} c "
                f"JOIN (SELECT {m}, sum(fitted) AS now FROM {now} GROUP BY 1) s ON c.{m} IS NOT DISTINCT FROM s.{m} "
                f"JOIN goal_{m} g ON c.{m} IS NOT DISTINCT FROM g.{m})"
            )
            now = following
    goals = [
        f"goal_{m} AS MATERIALIZED (SELECT {m}, p / sum(p) OVER () * (SELECT sum(tokens) FROM c0) AS goal FROM "
        f"(SELECT {m}, pow(sum(tokens)::DOUBLE, {TEMPER}) AS p FROM c0 GROUP BY 1))"
        for m in MARGINS
    ]
    return f"""
    WITH RECURSIVE marked AS MATERIALIZED (
      SELECT doc_id, source, lang, CASE WHEN regexp_matches(text, '[Ll]icen[sc]') THEN 'license'
          WHEN regexp_matches(text, '@[a-z0-9]') THEN 'contact' WHEN regexp_matches(text, '[#$%&|<>]') THEN 'marked'
          WHEN length(text) < 1000 THEN 'short' WHEN text IS NULL THEN 'none' ELSE 'long' END AS topic,
        coalesce(len(regexp_extract_all(text, '[^ \\t-\\r]+')), 0)::BIGINT AS tokens FROM documents),
    c0 AS MATERIALIZED (SELECT source, lang, topic, sum(tokens)::BIGINT AS tokens, sum(tokens)::DOUBLE AS fitted FROM marked GROUP BY ALL),
    {", ".join(goals)},
    {", ".join(steps)},
    w AS MATERIALIZED (SELECT *, CASE WHEN tokens > 0 THEN fitted / tokens ELSE 1.0 END AS weight FROM {now}),
    fill(k, c) AS (
      SELECT 0, 0.0::DOUBLE UNION ALL
      SELECT k + 1, greatest(c, (SELECT ({KEEP_SHARE} * sum(tokens)
          - sum(CASE WHEN f.c * weight >= 1 THEN tokens ELSE 0 END))
          / nullif(sum(CASE WHEN f.c * weight >= 1 THEN 0.0 ELSE tokens * weight END), 0) FROM w))
      FROM fill f WHERE k < {CALIBRATIONS}),
    chance AS (SELECT w.*, least(1.0, weight * (SELECT max(c) FROM fill)) AS probability FROM w)
    SELECT m.doc_id, m.topic, m.tokens AS n_tokens, round(p.weight, 6) AS weight, round(p.probability, 6) AS probability,
      ('0x' || substr(md5('{SEED}:' || coalesce(m.doc_id::VARCHAR, '')), 1, 13))::BIGINT / {float(16**13)} < p.probability AS chosen
    FROM marked m JOIN chance p ON m.source IS NOT DISTINCT FROM p.source AND m.lang IS NOT DISTINCT FROM p.lang
      AND m.topic = p.topic"""


@query("op6_source_mixture", oracle())
def op6_source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its weight, its chance to be kept and the draw."""
    return mix(table(spark, sf_dir, "documents")).select(
        "doc_id", F.col("__mix_m2").alias("topic"), F.col("__mix_tokens").alias("n_tokens"),
        F.round("weight", 6).alias("weight"), F.round("probability", 6).alias("probability"), "chosen",
    )
