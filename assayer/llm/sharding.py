"""Placing rows on shards through a lookup table that the shards fill by turns.

Every shard has a preference order over the slots of a table of prime size: a start and a stride, both from md5 of
its name. Shards take turns; each claims the first slot of its order that is still free, until none is left, so
shares differ by at most one slot. A row's slot is md5 of its key modulo the size, and one broadcast lookup gives
its shard in constant time. When a shard leaves, its slots are dealt to the others and few other slots move.

The table depends on the shard names and the slot count alone. Its size is checked against ``MAX_SLOTS`` before it
is broadcast, so what is sent never grows with the rows.

* null key: placed as the empty text; repeated keys: same shard; empty table: no rows.
* other columns, nulls among them, pass unchanged; a column named as an output column is replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from assayer.functions.columns import quoted
from assayer.llm.common import query, table

#: Bound of the broadcast table: two integers a slot, 16 MB.
MAX_SLOTS = 1_000_003
SLOTS_PER_SHARD = 100
SHARDS = tuple(f"shard-{i:02d}" for i in range(64))


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def prime_from(n: int) -> int:
    while not is_prime(n):
        n += 1
    return n


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def preference(name: str, slots: int) -> tuple[int, int]:
    """(first slot, stride) of a shard's order over the slots."""
    return _number(name + ":offset") % slots, _number(name + ":skip") % (slots - 1) + 1


def fill(shards: Sequence[str], slots: int) -> list[int]:
    """The index of the shard that holds each slot."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards need distinct names")
    if not is_prime(slots) or slots < max(3, len(shards)):
        raise ValueError(f"{slots} slots: a prime no smaller than the number of shards is needed")
    if slots > MAX_SLOTS:
        raise ValueError(f"{slots} slots: the table is broadcast, {MAX_SLOTS} are the most")
    order = [preference(s, slots) for s in shards]
    at, owner, left = [0] * len(shards), [-1] * slots, slots
    while left:
        for i, (first, stride) in enumerate(order):
            if not left:
                break
            slot = (first + at[i] * stride) % slots
            while owner[slot] >= 0:
                at[i] += 1
                slot = (first + at[i] * stride) % slots
            owner[slot] = i
            at[i] += 1
            left -= 1
    return owner


def lookup(spark: SparkSession, shards: Sequence[str], slots: int) -> DataFrame:
    """The filled table as rows (slot, shard), made in the JVM from one literal."""
    text = ",".join(map(str, fill(shards, slots)))
    cells = F.split(F.lit(text), ",").cast("array<int>")
    return spark.range(1, numPartitions=1).select(F.posexplode(cells).alias("slot", "shard"))


def slot_of(key: Column, slots: int) -> Column:
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    return (F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint") % slots).cast("int")


def assign_shards(
    df: DataFrame, key: str = "doc_id", shards: Sequence[str] = SHARDS, slots: int | None = None,
    slot_column: str = "slot", shard_column: str = "shard",
) -> DataFrame:
    """``df`` with the slot of each row's key and the index of the shard that holds it."""
    slots = slots or prime_from(max(3, SLOTS_PER_SHARD * len(shards)))
    names = lookup(df.sparkSession, shards, slots).toDF("__slot", "__shard")
    kept = [c for c in df.columns if c.lower() not in (slot_column.lower(), shard_column.lower())]
    placed = df.select(*(quoted(c) for c in kept), slot_of(quoted(key), slots).alias("__at"))
    return placed.join(F.broadcast(names), F.col("__at") == F.col("__slot")).select(
        *(quoted(c) for c in kept), F.col("__at").alias(slot_column), F.col("__shard").alias(shard_column)
    )


def oracle(shards: Sequence[str] = SHARDS) -> str:
    """The same placement by turns in recursive SQL."""
    n, slots = len(shards), prime_from(max(3, SLOTS_PER_SHARD * len(shards)))
    names = ", ".join(f"({i}, '{s}')" for i, s in enumerate(shards))

    def number(suffix: str) -> str:
        return f"('0x' || substr(md5(name || ':{suffix}'), 1, 15))::BIGINT"

    return f"""
    WITH RECURSIVE pref AS (
      SELECT i, {number('offset')} % {slots} AS first, {number('skip')} % {slots - 1} + 1 AS stride
      FROM (VALUES {names}) v(i, name)),
    turns AS (
      SELECT 0 AS turn, NULL::BIGINT AS slot, bitstring('0', {slots}) AS taken
      UNION ALL
      SELECT turn + 1, s, set_bit(taken, s::INTEGER, 1) FROM (
        SELECT t.turn, t.taken,
          list_filter(range({slots}), lambda j: get_bit(t.taken, ((p.first + j * p.stride) % {slots})::INTEGER) = 0)[1]
            * p.stride + p.first AS free, p.first
        FROM turns t JOIN pref p ON p.i = t.turn % {n} WHERE t.turn < {slots}) x, LATERAL (SELECT free % {slots} AS s)),
    owner AS (SELECT slot, (turn - 1) % {n} AS shard FROM turns WHERE turn > 0)
    SELECT d.doc_id, o.slot::INTEGER AS slot, o.shard::INTEGER AS shard
    FROM documents d JOIN owner o
      ON ('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, '')), 1, 15))::BIGINT % {slots} = o.slot"""


@query("op3_shard_table", oracle())
def op3_shard_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document on one of 64 shards."""
    return assign_shards(table(spark, sf_dir, "documents").select("doc_id"))
