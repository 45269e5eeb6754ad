"""Language of a text by which language's dictionary compresses it best.

For every language in the learnable rows a raw-content dictionary is built from excerpts of its texts. A text, as
lower-case words, is cut into chunks, and each chunk is compressed with zstandard once per dictionary; the language
with the fewest bytes in all wins. Chunks keep the dictionary in play to the end of a long text, where the text's
own past would otherwise hide it. Equal sizes go to the language with more learnable rows, then to the smaller name.
The score is the winner's share when a byte more costs a factor e**-0.3; ``rejected`` marks a winner that saves
less than ``margin`` of the runner-up's bytes.

Learning reads text and language alone, from rows that are not held out. Dictionaries come from a bounded sample:
per language the ``SAMPLE_ROWS`` distinct texts with the smallest hashes, or all if there are fewer, one excerpt of ``EXCERPT`` characters
from a hashed place in each, cut at ``DICTIONARY_BYTES``. What the driver holds and broadcasts is that many bytes a
language, for at most ``MAX_LANGUAGES``, checked. Scoring is row by row without a shuffle.

* null text or one without letters: language ``und``, score 0, rejected.
* no learnable row: every text is ``und``; null languages are not learned; empty table: no rows.
* repeated rows: one output row each, the same answer; other columns pass if named in ``keep``.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from assayer.functions.columns import quoted
from assayer.llm.common import held_out, map_texts, once, query, table

UNKNOWN = "und"
LEVEL = 6
CHUNK_BYTES = 2_048
DICTIONARY_BYTES = 65_536
SAMPLE_ROWS = 400
EXCERPT = 400
MAX_LANGUAGES = 400
MARGIN = 0.005
BYTE_COST = 0.3

_NOT_LETTERS = re.compile(r"[\W\d_]+")


def letters(text: str | None) -> bytes:
    """Lower-case words with a blank before and after each; empty if there is no letter (Unicode category L)."""
    words = _NOT_LETTERS.sub(" ", text.lower()).strip() if text else ""
    return f" {words} ".encode("utf-8", "surrogatepass") if any(map(str.isalpha, words)) else b""


def learn(
    df: DataFrame, learnable: Column, text: str = "text", lang: str = "lang", sample_rows: int = SAMPLE_ROWS,
) -> list[tuple[str, bytes]]:
    """(language, dictionary) pairs, the language with the most learnable rows first."""
    rows = df.select(quoted(lang).alias("lang"), quoted(text).alias("text"), learnable.alias("ok")).where(
        "ok and lang is not null and text is not null"
    )
    place = F.xxhash64("text")
    low = place.bitwiseAND(F.lit(2**40 - 1))
    lettered = F.col("text").rlike(r"\p{L}")
    # Copies are folded before texts are counted, so the sample does not depend on how many there are.
    folded = rows.groupBy("lang", place.alias("place")).agg(F.count("*").alias("n"), F.max(lettered).alias("lettered"))
    found = folded.groupBy("lang").agg(F.sum("n").alias("n"), F.count_if("lettered").alias("texts")).take(MAX_LANGUAGES + 1)
    counts = {r["lang"]: r["n"] for r in found}
    texts = {r["lang"]: r["texts"] for r in found}
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages: each needs a dictionary on every executor")
    if not counts:
        return []
    order = sorted(counts, key=lambda k: (-counts[k], k))
    # Twice as many texts as wanted are let through by a hash threshold, so the ranking below sees few rows.
    share = F.coalesce(*(F.when(F.col("lang") == k, F.lit(2.0 * sample_rows / max(texts[k], 1))) for k in order))
    drawn = rows.where((low / F.lit(float(2**40)) < share) & lettered)
    start = F.pmod(F.shiftright(place, 20), F.greatest(F.length("text") - EXCERPT, F.lit(1))) + 1
    excerpts = (
        drawn.select("lang", place.alias("place"), F.col("text").substr(start.cast("int"), F.lit(EXCERPT)).alias("part"))
        .groupBy("lang", "place").agg(F.min("part").alias("part"))
        .withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.col("place").bitwiseAND(F.lit(2**40 - 1)), "place")))
        .where(F.col("rank") <= sample_rows)
    )
    parts: dict[str, list[tuple[int, bytes]]] = {k: [] for k in order}
    for r in excerpts.collect():
        parts[r["lang"]].append((r["place"], letters(r["part"])))
    made = [(k, b"".join(p for _, p in sorted(parts[k]))[-DICTIONARY_BYTES:]) for k in order]
    return [(k, d) for k, d in made if len(d) >= 8]


class Compressors:
    def __init__(self, dictionaries: Sequence[tuple[str, bytes]]):
        self.names, self.each = [], []
        for name, content in dictionaries:
            held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(level=LEVEL)
            self.names.append(name)
            self.each.append(
                zstandard.ZstdCompressor(
                    level=LEVEL, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False
                ).compress
            )

    def sizes(self, content: bytes) -> list[int]:
        chunks = [content[i : i + CHUNK_BYTES] for i in range(0, len(content), CHUNK_BYTES)]
        return [sum(len(press(c)) for c in chunks) for press in self.each]

    def classify(self, text: str | None, margin: float) -> tuple[str, float, bool]:
        content = letters(text)
        if not content or not self.names:
            return UNKNOWN, 0.0, True
        sizes = self.sizes(content)
        best = min(sizes)
        second = sorted(sizes)[1] if len(sizes) > 1 else math.inf
        score = 1.0 / sum(math.exp(-BYTE_COST * min(s - best, 1000)) for s in sizes)
        return self.names[sizes.index(best)], score, second - best < margin * second


def classify(
    df: DataFrame, dictionaries: Sequence[tuple[str, bytes]], text: str = "text", keep: Sequence[str] = ("doc_id",),
    margin: float = MARGIN,
) -> DataFrame:
    """Columns ``keep`` with lang_pred, score and rejected of each row's text."""
    sent = df.sparkSession.sparkContext.broadcast(list(dictionaries))

    ready = once(lambda: Compressors(sent.value))

    def run(texts: list[str | None]):
        pressers = ready()
        return list(zip(*(pressers.classify(t, margin) for t in texts))) or [[], [], []]

    fields = [
        T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
        T.StructField("rejected", T.BooleanType()),
    ]
    return map_texts(df, run, fields, keep, text)


@query("op2_language_id")
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    found = classify(docs, learn(docs, ~held_out(F.col("doc_id"))))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
