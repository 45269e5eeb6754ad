"""Content, configuration and run identities."""

from __future__ import annotations

import hashlib
import inspect
import json
from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

PREFIX = "sha256:"  # fixed value


def sha_text(text: str) -> str:
    return PREFIX + hashlib.sha256(text.encode("utf-8")).hexdigest()


def hash_bytes(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def hash_source(fn: Callable) -> str:
    """Identity of a transform's code."""
    return sha_text(inspect.getsource(fn))


def hash_config(config: Mapping[str, Any] | None) -> str:
    """Hash of the compact JSON array [k1, v1, k2, v2, ...] with keys in order."""
    flat = [x for k in sorted(config or {}) for x in (k, (config or {})[k])]
    return sha_text(json.dumps(flat, separators=(",", ":"), ensure_ascii=False))


def sha_column(text: Column) -> Column:
    return F.concat(F.lit(PREFIX), F.sha2(text, 256))


def hash_config_columns(values: Mapping[str, Column]) -> Column:
    """``hash_config`` of one configuration per row, built from columns."""
    parts = []
    for key in sorted(values):
        item = F.to_json(F.struct(values[key].alias("v")), {"ignoreNullFields": "false"})
        parts += [F.lit(json.dumps(key)), _inner(item)]
    return sha_column(F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]")))


def _inner(item: Column) -> Column:
    """{"v":<json>} -> <json>"""
    return F.substring(item, F.lit(6), F.length(item) - 6)


def run_key(content_hash: Column, config_hash: Column, git_sha: Column) -> Column:
    return sha_column(F.concat_ws("|", content_hash, config_hash, git_sha))


def hash_dataframe(df: DataFrame) -> DataFrame:
    """One row (n_rows, content_hash): schema, row count and row hashes.

    Spark rows have no order, so the hash does not depend on it; repeated rows still count, and
    values, column order and types all matter.
    """
    schema = json.dumps([[f.name, f.dataType.simpleString()] for f in df.schema], separators=(",", ":"))
    hashable = [
        F.to_json(F.struct(F.col(f"`{f.name}`"))) if _nested(f.dataType.typeName()) else F.col(f"`{f.name}`")
        for f in df.schema
    ]
    # NULL cells are skipped by the hash, so their positions are hashed too
    gaps = F.concat(F.lit(""), *(F.when(h.isNull(), "1").otherwise("0") for h in hashable))
    row = F.xxhash64(gaps, *hashable)
    total = df.agg(
        F.count("*").alias("n_rows"),
        F.coalesce(F.sum(row.cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("_sum"),
        F.coalesce(F.bit_xor(row), F.lit(0)).alias("_xor"),
    )
    return total.select(
        "n_rows",
        sha_column(F.concat_ws("|", F.lit(schema), "n_rows", "_sum", "_xor")).alias("content_hash"),
    )


def _nested(kind: str) -> bool:
    return kind in ("map", "variant")


def content_hash(df: DataFrame) -> str:
    return hash_dataframe(df).first()["content_hash"]


def verify_output_hash(recorded: Column, recomputed: Column) -> Column:
    return F.coalesce(recorded == recomputed, F.lit(False))
