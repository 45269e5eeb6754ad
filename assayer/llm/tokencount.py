"""Token counts of a greedy longest-match tokenizer by one walk over the bytes.

The vocabulary is a trie over bytes. Each node has a failure link and the number of pieces that greedy matching
cuts off when it leaves the node that way; both are computed once, breadth first. Counting a word then takes one
step a byte plus one a failure link, so time is linear in its length, and no piece is ever built.

Two roots are kept: one for pieces that start a word, one for pieces that continue it. A byte-level vocabulary
needs only one, since its pieces say by a leading blank that they start a word. Words that no pieces cover count
as one unknown token.

The pieces (at most ``MAX_PIECES``, checked) are read on the driver and broadcast; every Python worker builds the
automaton once. Counts of words seen before come from a bounded cache. Texts are handled row by row with no
shuffle, so a lost executor costs only its own tasks.

* null or empty text: 0 words, 0 tokens; very long texts: time linear, memory a list of words.
* repeated rows and ids: one output row each; empty table: no rows; other columns pass if named in ``keep``.
"""

from __future__ import annotations

import base64
import re
from collections import deque
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession, types as T

from assayer.llm.common import map_texts, once, query, table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
MAX_PIECES = 1_000_000
#: A word, a run of marks or of underscores, each with the blank before it; or white space.
UNIT = re.compile(r" ?[^\W_]+| ?[^\w\s]+| ?_+|\s+(?!\S)|\s")


class Automaton:
    """Trie with failure links; ``count(word)`` is the number of greedy longest-match pieces."""

    START, CONTINUE, NONE = 0, 1, -1

    def __init__(self, start: Iterable[bytes], follow: Iterable[bytes] | None = None):
        """``follow`` None: the pieces of ``start`` may also continue a word."""
        self.next: dict[int, int] = {}
        self.fail, self.popped, self.depth = [self.NONE], [0], [0]
        final = [False]
        self.inner = self.START
        if follow is not None:
            self.inner = self.CONTINUE
            for values, new in ((self.fail, self.NONE), (self.popped, 0), (self.depth, 0), (final, False)):
                values.append(new)
        for root, pieces in ((self.START, start), (self.inner, follow or ())):
            for piece in pieces:
                node = root
                for byte in piece:
                    key = node << 8 | byte
                    node = self.next.get(key, self.NONE)
                    if node < 0:
                        node = self.next[key] = len(final)
                        self.fail.append(self.NONE)
                        self.popped.append(0)
                        self.depth.append(0)
                        final.append(False)
                if piece:
                    final[node] = True
        self._link(final)

    def _link(self, final: list[bool]) -> None:
        below: dict[int, list[tuple[int, int]]] = {}
        for key, node in self.next.items():
            below.setdefault(key >> 8, []).append((key & 255, node))
        waiting = deque([self.START] if self.inner == self.START else [self.START, self.inner])
        while waiting:
            parent = waiting.popleft()
            for byte, node in below.get(parent, ()):
                if final[node]:
                    self.fail[node], self.popped[node] = self.inner, 1
                else:
                    at, cut = self.fail[parent], self.popped[parent]
                    while at >= 0 and (at << 8 | byte) not in self.next:
                        cut, at = cut + self.popped[at], self.fail[at]
                    if at >= 0:
                        self.fail[node], self.popped[node] = self.next[at << 8 | byte], cut
                waiting.append(node)

    def count(self, word: bytes) -> int:
        following, fail, popped = self.next, self.fail, self.popped
        node, n = self.START, 0
        for byte in word:
            to = following.get(node << 8 | byte, -1)
            while to < 0:
                n, node = n + popped[node], fail[node]
                if node < 0:
                    return 1
                to = following.get(node << 8 | byte, -1)
            node = to
        while node != self.inner and word:
            n, node = n + popped[node], fail[node]
            if node < 0:
                return 1
        return n


class Counter(dict):
    """Token counts of units, remembered up to a limit."""

    def __init__(self, automaton: Automaton, limit: int = 300_000):
        super().__init__()
        self.automaton, self.limit = automaton, limit

    def __missing__(self, unit: str) -> int:
        n = self.automaton.count(unit.encode("utf-8", "surrogatepass"))
        if len(self) >= self.limit:
            self.clear()
        self[unit] = n
        return n


def read_pieces(path: str = VOCABULARY) -> list[bytes]:
    """Pieces of a rank file: base64 of a piece and its rank on each line."""
    with open(path, "rb") as lines:
        pieces = [base64.b64decode(line.split()[0]) for line in lines if line.strip()]
    if len(pieces) > MAX_PIECES:
        raise ValueError(f"{len(pieces)} pieces: the vocabulary is broadcast, {MAX_PIECES} are the most")
    return pieces


def count_tokens(
    df: DataFrame, pieces: Sequence[bytes], follow: Sequence[bytes] | None = None, text: str = "text",
    keep: Sequence[str] = ("doc_id",),
) -> DataFrame:
    """Columns ``keep`` with n_units and n_tokens of each row's text."""
    vocabulary = df.sparkSession.sparkContext.broadcast((list(pieces), None if follow is None else list(follow)))

    counter_of = once(lambda: Counter(Automaton(*vocabulary.value)))

    def run(texts: list[str | None]) -> tuple[list[int], list[int]]:
        counter = counter_of()
        units, tokens = [], []
        for value in texts:
            found = UNIT.findall(value) if value else []
            units.append(len(found))
            tokens.append(sum(map(counter.__getitem__, found)))
        return units, tokens

    fields = [T.StructField("n_units", T.LongType()), T.StructField("n_tokens", T.LongType())]
    return map_texts(df, run, fields, keep, text)


@query("op4_token_counts")
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy token counts of every document with a public vocabulary."""
    return count_tokens(table(spark, sf_dir, "documents"), read_pieces())
