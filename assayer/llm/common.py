"""Small pieces the corpus operators share."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from assayer.functions.columns import quoted
from assayer.functions.shipping import ship

WORD = re.compile(r"[^\W_]+")

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters and digits."""
    return WORD.findall(text.lower()) if text else []


def held_out(key: Column) -> Column:
    """True where crc32 of the key as text leaves 2 modulo 4; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % 4 == 2


def uniform(key: Column, seed: str) -> Column:
    """A number in [0, 1) from md5 of seed and key, the same in any SQL engine; a null key counts as ''."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") / F.lit(float(16**13))


class WordCodes(dict):
    """64-bit codes of words, kept between calls up to ``limit`` entries; forgetting only costs time."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: str) -> int:
        code = xxhash.xxh3_64_intdigest(word)
        if len(self) >= self.limit:
            self.clear()
        self[word] = code
        return code

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


CODES = WordCodes()

# Word codes from arrays of characters: a polynomial in an odd base over the characters of each word, modulo 2**64.
_BASE = 0x9FB21C651E98DF25
_tables: dict[str, np.ndarray] = {}


def _is_word_character() -> np.ndarray:
    if "word" not in _tables:
        _tables["word"] = np.fromiter((chr(i).isalnum() for i in range(0x110000)), bool, 0x110000)
    return _tables["word"]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least ``n`` of each; the tables of one long text are not kept."""
    if "up" not in _tables or len(_tables["up"]) < n:
        size = max(n, 1 << 20)
        inverse = pow(_BASE, -1, 2**64)
        up, down = (
            np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size - 1, b, np.uint64)]))
            for b in (_BASE, inverse)
        )
        if n > 1 << 22:
            return up, down
        _tables["up"], _tables["down"] = up, down
    return _tables["up"], _tables["down"]


def coded_words(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, starts, characters): 64-bit codes and first places of the words of a text as it is, and its characters."""
    characters = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = np.zeros(len(characters) + 2, bool)
    inside[1:-1] = _is_word_character()[characters]
    starts = np.flatnonzero(inside[1:-1] & ~inside[:-2])
    ends = np.flatnonzero(inside[1:-1] & ~inside[2:]) + 1
    return range_codes(characters, starts, ends), starts, characters


def range_codes(characters: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit codes of the stretches from ``starts`` to ``ends``."""
    up, down = _powers(len(characters) + 1)
    sums = np.zeros(len(characters) + 1, np.uint64)
    np.cumsum((characters.astype(np.uint64) + np.uint64(1)) * up[: len(characters)], out=sums[1:])
    return stirred((sums[ends] - sums[starts]) * down[starts])


_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def stirred(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(29))


def shingles(codes: np.ndarray, width: int = 5) -> np.ndarray:
    """Codes of all runs of ``width`` words in order of place; a shorter text is one shingle, an empty one none."""
    n = len(codes)
    if n == 0:
        return codes
    width = min(width, n)
    out = codes[: n - width + 1].copy()
    for k in range(1, width):
        out = stirred(out * _STEP + codes[k : n - width + 1 + k])
    return out if width > 1 else stirred(out * _STEP)


def map_texts(
    df: DataFrame, run: Callable[[list[str | None]], Sequence[Sequence]], fields: Sequence[T.StructField],
    keep: Sequence[str], text: str = "text", at_once: int = 256,
) -> DataFrame:
    """Columns ``keep`` as they are and ``fields``, which ``run`` makes from ``at_once`` texts at a time.

    A kept column with the name of a field gives way to it.
    """
    taken = {f.name.lower() for f in fields}
    keep = [c for c in keep if c.lower() not in taken]
    schema = T.StructType([*(df.schema[c] for c in keep), *fields])
    kinds = [to_arrow_type(f.dataType) for f in fields]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, at_once):
                batch = whole.slice(start, at_once)
                made = run(batch.column(batch.num_columns - 1).to_pylist())
                cells = [*batch.columns[:-1], *(pa.array(c, k) for c, k in zip(made, kinds))]
                yield pa.RecordBatch.from_arrays(cells, names=schema.names)

    return df.select(*(quoted(c) for c in keep), quoted(text).alias("__mapped_text")).mapInArrow(task, schema)


_made: dict[str, object] = {}


def once(make: Callable[[], object]) -> Callable[[], object]:
    """``make``'s result, made once in each Python worker; only the latest few are kept."""
    name = uuid.uuid4().hex

    def get() -> object:
        if name not in _made:
            while len(_made) >= 3:
                del _made[next(iter(_made))]
            _made[name] = make()
        return _made[name]

    return get


def shielded(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` under column names no operator uses, and the new name of each lower-cased old one."""
    names = [f"__c{i}" for i in range(len(df.columns))]
    return df.toDF(*names), {old.lower(): new for old, new in zip(df.columns, names)}
