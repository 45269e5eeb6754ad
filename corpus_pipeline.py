"""Preparing a corpus in five stages, each an operator of ``assayer.llm`` whose decisions take effect.

``STAGES`` names them in order. A stage takes (spark, docs, sf_dir) and returns the documents it keeps, with the
columns it got; the last adds the shard. The caller writes each result as Parquet and hands it, read again, to the
next, so every stage works on all that its predecessor kept and a lost executor never reaches back across stages.

* toxicity: learns from ``labels`` and the documents that are not held out; documents scored at or above the cut go.
* near_duplicates: of each class of similar texts the representative stays; texts without words all stay.
* decontamination: documents that hold a benchmark item go.
* mixture: sources, languages and topics are raked to tempered shares, documents drawn by calibrated probability.
* shards: every document gets its slot and shard.

Columns are found by the names doc_id, text, lang and source; others pass. Null texts count as clean, without words
and without benchmark items. Rows repeated with id and text are one document to near_duplicates. Empty tables pass.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from assayer.functions.cutting import checkpointed, shared_folder
from assayer.functions.shipping import ship
from assayer.llm import decontamination, mixing, sharding, similarity, toxicity
from assayer.llm.common import held_out, shielded, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"), ~held_out(F.col("doc_id")))
    plain, name = shielded(docs)
    scored = toxicity.score(plain, model, plain.columns, name["text"])
    return scored.where(F.col("score") < toxicity.CUT).select(*plain.columns).toDF(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    joined = similarity.join_similar(docs.select("doc_id", "text"))
    plain, name = shielded(docs)
    hashed = plain.withColumn("__own", F.xxhash64(name["text"]))
    counted = checkpointed(
        joined.groupBy(F.col("doc_id").alias("__id"), F.col("__text").alias("__hash")).agg(F.max("is_first").alias("first"), F.count("*").alias("n"))
    )
    # Documents that go, and those that stand there more than once, are few: the rest never leave their tasks. Its hashes
    # fall outside a broadcast table of at most NEAR_BUCKETS numbers; once that is full, the join decides about all.
    touched = counted.where("not first or n > 1")
    bucket = F.pmod(F.col("__hash"), F.lit(similarity.NEAR_BUCKETS))
    near = F.broadcast(touched.select(bucket.alias("__bucket")).distinct())
    inside = F.pmod(F.col("__own"), F.lit(similarity.NEAR_BUCKETS)) == F.col("__bucket")
    same = F.col(name["doc_id"]).eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__hash"))
    # A representative may stand there several times with the same id and text: one row stays.
    decided = hashed.join(near, inside, "left_semi").join(counted.where("first").select("__id", "__hash"), same, "left_semi")
    kept = hashed.join(near, inside, "left_anti").union(decided.dropDuplicates([name["doc_id"], "__own"]))
    return kept.select(*plain.columns).toDF(*docs.columns)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    index = decontamination.build_index(table(spark, sf_dir, "benchmark"))
    plain, name = shielded(docs)
    found = decontamination.find_items(plain, index, plain.columns, name["text"])
    return found.where(F.size("items") == 0).select(*plain.columns).toDF(*docs.columns)


def draw_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    plain, name = shielded(docs)
    drawn = mixing.mix(plain, name["text"], name["doc_id"], (name["source"], name["lang"], "topic"))
    return drawn.where("chosen").select(*plain.columns).toDF(*docs.columns)


def place_on_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("mixture", draw_mixture),
    ("shards", place_on_shards),
]

#: SQL expresses neither the learned scores nor the similarity join; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        made = stage(spark, docs, sf_dir)
        made.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
