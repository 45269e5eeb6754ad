"""Token-id files: the ids of many documents in one array, document boundaries in Elias-Fano code.

1. *Ids.* Texts are cut by array operations where the tokenizer's own pre-tokenizer cuts them. Each different piece of a
   batch is encoded once by the ``tokenizers`` library, or comes from a bounded cache of the worker. Texts with
   characters whose class differs between versions of Unicode, or with a special token's string, go to the library whole.
   Every document ends with ``END``.
2. *Order.* Documents go by (key, hash of the text), null keys first. Key ranges of about ``ROWS_A_RANGE`` rows are read
   off a bounded sample of the keys; a range is one partition, sorted by Spark, so one key that holds many of
   the rows is cut by the hash of the text.
3. *Files.* A task streams its sorted rows and starts a new file after ``IDS_A_FILE`` ids, so it holds one file or one
   document at most. Files go to the shared folder through the filesystem its address names, under names of their own for each
   attempt; the manifest lists those of the attempts that Spark kept, so a repeated task leaves no double rows.
4. *Reading.* The manifest gives each file the number of ids before it. Inside a file, the boundaries and the keys are
   selected from their codes, so an offset costs a few words and no table of 64-bit offsets exists.

File: magic, bytes an id (2 or 4), documents, ids, documents with a null key, least key, sizes of both codes; the code of the
boundaries (documents + 1 values), the code of the keys less the least key, the ids.

* null text and empty text: the end id alone. Null key: first in the order, kept as null. Repeated rows and keys: a
  document each, in the order of the hash; equal rows are interchangeable. Very long texts: whole, a file of their own size at least.
* empty table: no files, no rows. Other columns are not written, so their names do not matter. Keys must be integers.

The manifest is the only thing the driver holds: a row of about 100 bytes a file.
"""

from __future__ import annotations

import os
import re
import struct
import unicodedata
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from assayer.functions.columns import quoted
from assayer.functions.cutting import checkpointed, shared_folder
from assayer.llm.common import once, query, range_codes, stirred, table
from assayer.llm.eliasfano import EliasFano

END = 2
ROWS_A_RANGE = 16_384
IDS_A_FILE = 1 << 25
#: Bounds of what the driver holds of the keys: ranges, and sampled rows for each.
MAX_RANGES, SAMPLE_A_RANGE = 65_536, 20
#: Pieces whose ids a worker keeps.
CACHED = 3_000_000

MAGIC = b"IDFILE01"
_HEAD = struct.Struct("<8sQQQQqQQ")
#: Characters that are cut into pieces at once; longer texts are cut before white space.
AT_ONCE = 1 << 20
_CUT = re.compile(r"(?<=\S)\s")
_ODD, _LETTER, _NUMBER, _BLANK, _MARK = range(5)


def _classes() -> np.ndarray:
    """The class of each code point; odd where it depends on the version of Unicode.

    All characters that came later than the oldest version at hand count as odd.
    """
    old = unicodedata.ucd_3_2_0.category
    out = np.full(0x110000, _ODD, np.uint8)
    for i in range(0x30000):
        c = chr(i)
        kind = unicodedata.category(c)
        if kind == old(c) and kind not in ("Cn", "Cs"):
            blank = kind[0] == "Z" or c in "\t\n\v\f\r\x85"
            out[i] = _BLANK if blank else {"L": _LETTER, "N": _NUMBER}.get(kind[0], _MARK)
    return out


def piece_starts(chars: np.ndarray, kinds: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Places where a byte-level pre-tokenizer starts a piece; ``first``: where texts start.

    A piece is a run of letters, numbers or marks with the blank before it, the common endings after an apostrophe,
    or white space up to what the next piece takes.
    """
    n = len(chars)
    starting = np.zeros(n + 1, bool)
    starting[first] = starting[n] = True
    run = starting[:n].copy()
    run[1:] |= kinds[1:] != kinds[:-1]
    blank = kinds == _BLANK
    taken = np.zeros(n, bool)
    taken[1:] = (chars[:-1] == 32) & ~starting[1:n]
    out = run & (blank | ~taken)
    # The last white space before anything else is a piece, or starts one.
    out[:-1] |= blank[:-1] & ~blank[1:] & ~starting[1:n]
    at = np.flatnonzero((chars == 39) & out)
    if len(at):
        end = np.append(chars, [0, 0])
        a, b = np.where(starting[np.minimum(at + 1, n)], 0, end[at + 1]), end[at + 2]
        b = np.where(starting[np.minimum(at + 2, n)], 0, b)
        two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        one = np.isin(a, [ord(c) for c in "stmd"])
        out[at[one | two] + 1] = False
        for places, size in ((at[one], 2), (at[two], 3)):
            after = places + size
            out[after[after < n]] = True
    return np.flatnonzero(out)


def _checks(chars: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sums of a mixed number for each character of a stretch: equal codes with unequal sums are different pieces."""
    sums = np.zeros(len(chars) + 1, np.uint64)
    np.cumsum(stirred(chars.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)), out=sums[1:])
    return sums[end] - sums[start]


class Cache:
    """Ids of pieces by two hashes of 64 bits, in sorted arrays: about 30 bytes a piece, at most ``CACHED`` of them.

    New pieces collect in a small tier that is merged into the large one as it fills; pieces not used since the last trim go first.
    """

    def __init__(self, dtype: np.dtype):
        self.dtype = dtype
        self._empty()

    def _empty(self) -> None:
        self.ids, self.held = np.zeros(1 << 16, self.dtype), 0
        kinds = (np.uint64, np.uint64, np.int64, np.int32, bool)  # code, check, place, size, used
        self.tiers = [[np.zeros(0, k) for k in kinds] for _ in range(2)]

    def find(self, codes: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, sizes); place -1 where a piece is not held."""
        places, sizes = np.full(len(codes), -1, np.int64), np.zeros(len(codes), np.int64)
        for known, check, place, size, used in self.tiers:
            if len(known):
                at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
                hit = np.flatnonzero((known[at] == codes) & (check[at] == checks))
                at = at[hit]
                places[hit], sizes[hit], used[at] = place[at], size[at], True
        return places, sizes

    def add(self, codes: np.ndarray, checks: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Hold pieces of increasing ``codes`` with their ids one after the other; their places."""
        while self.held + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.held : self.held + len(flat)] = flat
        places = self.held + np.cumsum(sizes) - sizes
        self.held += len(flat)
        self.tiers[1] = self._merged(self.tiers[1], [codes, checks, places, sizes.astype(np.int32), np.ones(len(codes), bool)])
        if len(self.tiers[1][0]) > max(1 << 16, len(self.tiers[0][0]) // 4):
            self.tiers = [self._merged(*self.tiers), [c[:0] for c in self.tiers[1]]]
        return places

    @staticmethod
    def _merged(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
        order = np.argsort(np.concatenate([a[0], b[0]]), kind="stable")
        return [np.concatenate([x, y])[order] for x, y in zip(a, b)]

    def trim(self) -> None:
        """Above the bound, keep what was used since the last trim, if that is at most half of it."""
        if sum(len(t[0]) for t in self.tiers) <= CACHED:
            return
        codes, checks, places, sizes, used = self._merged(*self.tiers)
        ids = self.ids
        self._empty()
        kept = np.flatnonzero(used)
        if len(kept) <= CACHED // 2:
            count = sizes[kept].astype(np.int64)
            upto = np.cumsum(count)
            flat = ids[np.repeat(places[kept] - (upto - count), count) + np.arange(upto[-1] if len(upto) else 0)]
            self.add(codes[kept], checks[kept], flat, count)
            for tier in self.tiers:
                tier[4][:] = False


class Encoder:
    """Ids of texts as bytes of ``dtype``, one worker's own."""

    def __init__(self, path: str, piecewise: bool = True):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has a task for each core already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.kinds = _classes() if piecewise else None
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cache = Cache(self.dtype)

    def encoded(self, codes: np.ndarray, checks: np.ndarray, piece: Callable[[int], str]) -> tuple[np.ndarray, np.ndarray]:
        """(places in the cache's ids, sizes) of the pieces with increasing ``codes``; ``piece`` gives their text."""
        places, sizes = self.cache.find(codes, checks)
        missed = np.flatnonzero(places < 0)
        if len(missed):
            found = self.tokenizer.encode_batch_fast([piece(i) for i in missed.tolist()], add_special_tokens=False)
            ids = [e.ids for e in found]
            sizes[missed] = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter(chain.from_iterable(ids), self.dtype, int(sizes[missed].sum()))
            places[missed] = self.cache.add(codes[missed], checks[missed], flat, sizes[missed])
        return places, sizes

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        held: list[tuple[int, str]] = []
        size = 0
        for i, t in enumerate(texts):
            if not t:
                continue
            if self.kinds is None or any(s in t for s in self.special):
                out[i] = self.whole(t)
                continue
            while len(t) > AT_ONCE and (cut := _CUT.search(t, AT_ONCE)):
                self._into(out, [(i, t[: cut.start()])])
                t = t[cut.start() :]
            if held and size + len(t) > AT_ONCE:
                self._into(out, held)
                held, size = [], 0
            held.append((i, t))
            size += len(t)
        self._into(out, held)
        return out

    def _into(self, out: list[bytes], held: list[tuple[int, str]]) -> None:
        """Add the ids of each (place, text) to the place."""
        if not held:
            return
        joined = "".join(t for _, t in held)
        chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds = self.kinds[chars]
        first = np.cumsum([0, *(len(t) for _, t in held[:-1])])
        if (kinds == _ODD).any():
            odd = np.bitwise_or.reduceat(kinds == _ODD, first)
            for (i, t), is_odd in zip(held, odd.tolist()):
                if is_odd:
                    out[i] += self.whole(t)
            self._into(out, [h for h, is_odd in zip(held, odd.tolist()) if not is_odd])
            return
        start = piece_starts(chars, kinds, first)
        end = np.append(start[1:], len(chars))
        codes, checks = range_codes(chars, start, end), _checks(chars, start, end)
        codes, place, number = np.unique(codes, return_index=True, return_inverse=True)
        if (checks != checks[place][number]).any():  # two pieces with one code
            for i, t in held:
                out[i] += self.whole(t)
            return
        begin, stop = start[place].tolist(), end[place].tolist()
        places, sizes = self.encoded(codes, checks[place], lambda i: joined[begin[i] : stop[i]])
        count = sizes[number]
        upto = np.cumsum(count)
        made = self.cache.ids[np.repeat(places[number] - (upto - count), count) + np.arange(upto[-1])]
        self.cache.trim()
        at = np.append(0, upto)[np.append(np.searchsorted(start, first), len(start))].tolist()
        for (i, _), a, b in zip(held, at[:-1], at[1:]):
            out[i] += made[a:b].tobytes()


def cuts_into_known_pieces(path: str) -> bool:
    """Whether the tokenizer cuts text by the pattern of byte-level vocabularies and changes nothing before."""
    import json

    from tokenizers import Tokenizer

    made = json.loads(Tokenizer.from_file(path).to_str())
    cut = made["pre_tokenizer"] or {}
    return (
        made["normalizer"] is None and cut.get("type") == "ByteLevel" and cut.get("use_regex", True)
        and not cut.get("add_prefix_space", True) and made["post_processor"] is None
    )


def _bounds(keyed: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Keys and hashes at which ranges of the rows begin, from a sample of a bounded number of rows."""
    rows = keyed.count()
    ranges = min(MAX_RANGES, max(1, -(-rows // ROWS_A_RANGE)))
    if ranges == 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # Rows whose hash falls into a share that holds SAMPLE_A_RANGE rows a range on average.
    share = min(1.0, ranges * SAMPLE_A_RANGE / rows)
    taken = keyed.where(F.pmod(F.xxhash64("__key", "__tie"), F.lit(1_000_000)) < int(share * 1_000_000) + 1).where("__key is not null")
    found = taken.select("__key", "__tie").toPandas().sort_values(["__key", "__tie"])
    at = np.unique(np.linspace(0, max(0, len(found) - 1), ranges + 1).astype(int)[1:-1]) if len(found) else []
    return found["__key"].to_numpy(np.int64)[at], found["__tie"].to_numpy(np.int64)[at]


def _range_of(keys: np.ndarray, ties: np.ndarray, starts: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    low, high = (np.searchsorted(starts[0], keys, side) for side in ("left", "right"))
    for i in np.flatnonzero(low < high):
        low[i] += np.searchsorted(starts[1][low[i] : high[i]], ties[i], "right")
    return low


def pack(keys: list[int | None], ids: list[bytes], width: int) -> bytes:
    """A file of documents in the order given, null keys first."""
    nulls = sum(k is None for k in keys)
    known = np.array(keys[nulls:], np.int64)
    least = int(known[0]) if len(known) else 0
    ends = np.cumsum([0, *(len(i) // width for i in ids)], dtype=np.uint64)
    bounds = EliasFano.encode(ends).to_bytes()
    names = EliasFano.encode(known.view(np.uint64) - np.uint64(least % 2**64)).to_bytes()
    head = _HEAD.pack(MAGIC, width, len(keys), int(ends[-1]), nulls, least, len(bounds), len(names))
    return b"".join([head, bounds, names, *ids])


class TokenFile:
    """A file read from bytes: ``keys``, ``offsets`` and ``ids`` of documents by number."""

    def __init__(self, data: bytes):
        magic, self.width, self.n_docs, self.n_ids, self.nulls, self.least, a, b = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a file of token ids")
        at = _HEAD.size
        self._bounds = EliasFano.from_bytes(data[at : at + a])
        self._names = EliasFano.from_bytes(data[at + a : at + a + b])
        self._ids = np.frombuffer(data, f"<u{self.width}", self.n_ids, at + a + b)

    def offsets(self, k: np.ndarray) -> np.ndarray:
        """Number of ids before the documents ``k``; the number of documents asks for the number of all ids."""
        return self._bounds.get(k)

    def keys(self) -> list[int | None]:
        known = self._names.get(np.arange(self.n_docs - self.nulls)) + np.uint64(self.least % 2**64)
        return [None] * self.nulls + known.view(np.int64).tolist()

    def ids(self, k: int) -> np.ndarray:
        a, b = self.offsets(np.array([k, k + 1])).tolist()
        return self._ids[a:b].astype("<u4")


def _opened(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder)


_MANIFEST = "range int, part int, file string, n_docs long, n_ids long"


@dataclass
class TokenFiles:
    """A written set of files: the folder and (file, documents, ids, ids before), in order."""

    folder: str
    files: list[tuple[str, int, int, int]]


def write_files(df: DataFrame, tokenizer: str, folder: str | None = None, text: str = "text", key: str = "doc_id", end: int = END) -> TokenFiles:
    """The files of all rows of ``df``, in ascending order of ``key``."""
    spark = df.sparkSession
    if not isinstance(df.select(quoted(key)).schema[0].dataType, T.IntegralType):
        raise TypeError(f"{key}: keys of token files are integers")
    folder = folder or f"{shared_folder(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    keyed = df.select(
        quoted(key).cast("bigint").alias("__key"), F.xxhash64(quoted(text)).alias("__tie"), quoted(text).cast("string").alias("__text")
    )
    starts = _bounds(keyed)
    piecewise = cuts_into_known_pieces(tokenizer)
    encoder = once(lambda: Encoder(tokenizer, piecewise))
    schema = "range int, key long, tie long, ids binary"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = encoder()
        last = np.array([end], run.dtype).tobytes()
        for whole in batches:
            for s in range(0, whole.num_rows, 256):
                b = whole.slice(s, 256)
                ids = [i + last for i in run(b.column(2).to_pylist())]
                known = b.column(0).is_valid().to_numpy(zero_copy_only=False)
                keys = b.column(0).fill_null(0).to_numpy(zero_copy_only=False)
                at = np.where(known, _range_of(keys, b.column(1).to_numpy(), starts), 0).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(at), b.column(0), b.column(1), pa.array(ids, pa.binary())], names=["range", "key", "tie", "ids"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = encoder().dtype.itemsize
        store, base = _opened(folder)
        store.create_dir(base, recursive=True)
        keys: list[int | None] = []
        ids: list[bytes] = []
        held, part, now = 0, 0, None

        def closed() -> pa.RecordBatch:
            nonlocal held, part
            name = f"{now:06d}-{part:04d}-{uuid.uuid4().hex}.ids"
            data = pack(keys, ids, width)
            with store.open_output_stream(f"{base}/{name}") as out:
                out.write(data)
            row = [[now], [part], [name], [len(keys)], [held]]
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64())
            keys.clear()
            ids.clear()
            held, part = 0, part + 1
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(row, kinds)], names=["range", "part", "file", "n_docs", "n_ids"])

        for whole in batches:
            for s in range(0, whole.num_rows, 256):
                b = whole.slice(s, 256)
                for at, k, i in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist()):
                    n = len(i) // width
                    if keys and (at != now or held + n > IDS_A_FILE):
                        yield closed()
                    part = 0 if at != now else part
                    now = at
                    keys.append(k)
                    ids.append(i)
                    held += n
        if keys:
            yield closed()

    order = ["range", "key", "tie"]
    dealt = keyed.select("__key", "__tie", "__text").mapInArrow(encode, schema).repartitionById(len(starts[0]) + 1, F.col("range"))
    manifest = checkpointed(dealt.sortWithinPartitions(*order).mapInArrow(write, _MANIFEST))
    files, before = [], 0
    for r in sorted(manifest.collect(), key=lambda r: (r["range"], r["part"])):
        files.append((r["file"], r["n_docs"], r["n_ids"], before))
        before += r["n_ids"]
    return TokenFiles(folder, files)


def read_files(spark: SparkSession, written: TokenFiles, key: str = "doc_id", ids: bool = False) -> DataFrame:
    """A row a document, from the files: key, start, n_tokens, ids_crc32 and, if asked for, the ids."""
    listed = spark.createDataFrame(written.files, "file string, n_docs long, n_ids long, before long").select("file", "before")
    folder = written.folder
    schema = T.StructType([
        T.StructField(key, T.LongType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_crc32", T.LongType()), *([T.StructField("ids", T.ArrayType(T.IntegerType(), False))] if ids else []),
    ])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _opened(folder)
        for batch in batches:
            for name, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with store.open_input_stream(f"{base}/{name}") as source:
                    found = TokenFile(source.read())
                keys = found.keys()
                for s in range(0, found.n_docs, 4096):
                    stop = min(s + 4096, found.n_docs)
                    at = found.offsets(np.arange(s, stop + 1)).astype(np.int64)
                    cut = [found._ids[a:b].astype("<u4") for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                    cells = [
                        pa.array(keys[s:stop], pa.int64()), pa.array(at[:-1] + before), pa.array(np.diff(at)),
                        pa.array([zlib.crc32(c.tobytes()) for c in cut], pa.int64()),
                    ]
                    if ids:
                        cells.append(pa.array([c.astype(np.int32) for c in cut], pa.list_(pa.int32())))
                    yield pa.RecordBatch.from_arrays(cells, names=schema.names)

    dealt = listed.repartition(len(written.files), "file") if written.files else listed
    return dealt.mapInArrow(read, schema)


@query("op13_token_files")
def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place, length and checksum in the token files, read back from them."""
    import public_tokenizers

    written = write_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return read_files(spark, written)
