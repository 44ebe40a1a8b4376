"""Problem 8: encoding of whole texts with a public byte-level BPE vocabulary.

Pre-tokenisation works on the code points of a whole batch at once.  Every code
point gets a class from a table; where the classes change, runs begin, and two
associative scans (a running maximum from the left, a running minimum from the
right) give each position the begin and end of its run.  From these the token
boundaries of the usual pattern follow without a regular expression: a blank
before a run belongs to it, the last white-space character before a text stands
alone, and the short English endings after an apostrophe are cut off.  The
slices between boundaries are merged pair by pair, lowest rank first, and kept
in a cache; their offsets are kept for decoding.

Defined results: null and empty texts give an empty list; strings that look
like special tokens are ordinary text; texts of any length are encoded whole.
"""

from __future__ import annotations

import base64
import heapq
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: A batch of texts is encoded in pieces of about so many characters, so memory doesn't follow the batch.
PIECE = 1 << 20
CACHE = 1 << 18

END, SPACE, OTHER, LETTER, NUMBER = range(5)
# The code points of white space, and the endings that the pattern cuts off after an apostrophe.
WHITE = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
BLANK, APOSTROPHE, STOP = 0x20, 0x27, 0x110000


@lru_cache(1)
def class_table() -> np.ndarray:
    """Class of every code point, and of the mark that stands between two texts."""
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)), dtype=np.uint8, count=sys.maxunicode + 1)
    table[list(WHITE)] = SPACE
    return np.append(table, np.uint8(END))


def boundaries(cps: np.ndarray) -> np.ndarray:
    """Begin of every token in code points that end with STOP; STOP also stands between texts."""
    kind = class_table()[cps]
    n = len(cps)
    begins = np.empty(n, dtype=bool)
    begins[0] = True
    np.not_equal(kind[1:], kind[:-1], out=begins[1:])
    begins |= kind == END
    at = np.arange(n)
    first = np.maximum.accumulate(np.where(begins, at, 0))
    ends = np.empty(n, dtype=np.int64)
    ends[-1] = n
    ends[:-1] = np.where(begins[1:], at[1:], n)
    end = np.minimum.accumulate(ends[::-1])[::-1]
    start = begins.copy()
    # white space before a text: its last character is apart, and a blank takes the run after it along
    last = (kind == SPACE) & (end == at + 1)
    last[-1] = False
    before_text = last.copy()
    before_text[:-1] &= kind[1:] != END
    start |= before_text
    joined = np.zeros(n, dtype=bool)
    joined[1:] = before_text[:-1] & (cps[:-1] == BLANK)
    start &= ~joined
    # endings: an apostrophe that begins a token and is followed by one of them
    mark = np.flatnonzero((cps == APOSTROPHE) & start & (end == at + 1) & (first == at))
    mark = mark[kind[mark + 1] == LETTER]
    if len(mark):
        one = cps[mark + 1]
        two = cps[np.minimum(mark + 2, n - 1)]
        size = np.zeros(len(mark), dtype=np.int64)
        for tail in ENDINGS:
            hit = one == ord(tail[0])
            if len(tail) == 2:
                hit &= two == ord(tail[1])
            size[hit & (size == 0)] = len(tail)
        cut = size > 0
        mark, size = mark[cut], size[cut]
        start[mark + 1] = False
        start[mark + 1 + size] = True
    return np.flatnonzero(start)


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Pair merging, lowest rank first and from the left; a heap over a linked list, so long pieces stay cheap."""
    n = len(piece)
    if n == 1:
        return [ranks[piece]]
    begin, after, before = list(range(n)), list(range(1, n + 1)), list(range(-1, n - 1))
    stop = list(range(1, n + 1))
    alive = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, e = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or j >= n or stop[j] != e:
            continue
        stop[i] = e
        alive[j] = False
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if (r := ranks.get(piece[begin[i] : stop[k]])) is not None:
                heapq.heappush(heap, (r, i, stop[k]))
        h = before[i]
        if h >= 0 and (r := ranks.get(piece[begin[h] : e])) is not None:
            heapq.heappush(heap, (r, h, e))
    return [ranks[piece[begin[i] : stop[i]]] for i in range(n) if alive[i]]


class Encoder:
    """Encodes batches of texts; slices seen before come from a cache."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.cache: dict[str, list[int]] = {}
        self.pieces = {i: b for b, i in ranks.items()}

    def slice_ids(self, word: str) -> list[int]:
        ids = self.cache.get(word)
        if ids is None:
            raw = word.encode("utf-8")
            whole = self.ranks.get(raw)
            ids = [whole] if whole is not None else merge(raw, self.ranks)
            if len(word) < 100:
                if len(self.cache) >= CACHE:
                    self.cache.clear()
                self.cache[word] = ids
        return ids

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids, ends of each text in ids, begin of each slice in its text, ids of each slice)."""
        filled = [t or "" for t in texts]
        joined = "\x00".join(filled) + "\x00"
        cps = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32).copy()
        lengths = np.fromiter(map(len, filled), dtype=np.int64, count=len(filled))
        stops = np.cumsum(lengths + 1) - 1
        cps[stops] = STOP
        begins = boundaries(cps)
        ends = np.append(begins[1:], len(cps))
        real = cps[begins] != STOP
        begins, ends = begins[real], ends[real]
        get, miss = self.cache.get, self.slice_ids
        found = [get(w) or miss(w) for w in (joined[a:b] for a, b in zip(begins.tolist(), ends.tolist()))]
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        ids = np.fromiter((i for ids in found for i in ids), dtype=np.int32, count=int(sizes.sum()))
        upto = np.concatenate([[0], np.cumsum(sizes)])
        text_ends = upto[np.searchsorted(begins, stops)]
        offsets = begins - np.concatenate([[0], stops[:-1] + 1])[np.searchsorted(stops, begins)]
        return ids, text_ends, offsets, sizes

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.pieces[i] for i in ids).decode("utf-8")


_ENCODERS: dict[int, Encoder] = {}


def _encoder(shared: Broadcast) -> Encoder:
    key = id(shared.value)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(read_ranks(shared.value))
    return _ENCODERS[key]


def share_vocabulary(spark: SparkSession, path: str = VOCABULARY) -> Broadcast:
    """The vocabulary file (under 1 MB) for all executors, which need no copy of their own."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows in stretches of about PIECE characters; a longer text is a stretch of its own."""
    text = batch.column(1)
    sizes = np.cumsum([len(x) if x else 0 for x in text.to_pylist()])
    at = 0
    while at < batch.num_rows:
        base = sizes[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(sizes, base + PIECE, side="right")))
        yield batch.slice(at, to - at)
        at = to


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str = VOCABULARY, count_only: bool = False) -> DataFrame:
    """(key, ids) of each row, or (key, n_tokens) if ``count_only``."""
    shared = share_vocabulary(docs.sparkSession, path)
    value = T.StructField("n_tokens", T.LongType()) if count_only else T.StructField("ids", T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared)
        for batch in batches:
            for piece in _pieces(batch):
                ids, ends, _, _ = encoder.encode(piece.column(1).to_pylist())
                if count_only:
                    out = pa.array(np.diff(ends, prepend=0))
                else:
                    out = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([piece.column(0), out], names=[key, value.name])

    return docs.select(key, text).mapInArrow(run, T.StructType([docs.schema[key], value]))


def slices(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """(key, begins, sizes): where each slice begins in the text and how many ids it has."""
    shared = share_vocabulary(docs.sparkSession, path)
    whole = T.ArrayType(T.IntegerType())
    schema = T.StructType([docs.schema[key], T.StructField("begins", whole), T.StructField("sizes", whole)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared)
        for batch in batches:
            for piece in _pieces(batch):
                _, ends, offsets, sizes = encoder.encode(piece.column(1).to_pylist())
                # slices hold an id at least, so the ids before a text's end tell its last slice
                upto = np.concatenate([[0], np.searchsorted(np.cumsum(sizes), ends, side="right")]).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(upto), pa.array(x.astype(np.int32))) for x in (offsets, sizes)]
                yield pa.RecordBatch.from_arrays([piece.column(0), *lists], names=[key, "begins", "sizes"])

    return docs.select(key, text).mapInArrow(run, schema)
