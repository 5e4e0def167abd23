"""Cost-balanced packing of token sequences.

A sequence's cost is `linear` per token plus `quadratic` per squared piece length, as attention stays
inside a piece.  Documents of a window, cut at the capacity, go in descending order of length to the
sequence of lowest cost that still has room for the whole piece; where none has, the piece is cut and
fills the sequence of lowest cost.

A window is what a task has read until it holds `window_tokens` tokens, so packing needs no shuffle,
its memory is bounded, and it is as good at any input size.  Sequences of a window have the capacity,
but for its last tokens, which form sequences of power-of-two lengths: those need no padding either.

Ids come from a cache in the worker: lower-casing, NFC and the pre-tokenizer never join what white space
parts, so a text's ids are those of its words in turn, and a plain word's those of its pre-tokens.  A text with a special token's string, or with
a separator that only Python takes for white space, goes through the library whole.

Defined cases: a null or empty text is its end token alone; equal rows are packed as often as they
occur; a null id is passed through; other columns are ignored; an empty table gives an empty result;
documents of equal length keep the order in which they were read.
"""

from __future__ import annotations

import gc
import heapq
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.common import documents, small_batches, worker_state
from palimpsest.llm.tokens import tokenizer_path

CAPACITY = 4096
#: Tokens packed at a time by one task; eight bytes and a few objects each at most.
WINDOW = 2_000_000
END = 2
#: Words in one of the two generations of a worker's cache: some 120 bytes each.
ROOM = 500_000
#: Longer words are not remembered but encoded each time.
LONGEST = 256
_ODD = re.compile("[\x1c-\x1f]")


#: Lower-case letters that NFC leaves alone; runs of them, of ASCII punctuation and single digits are pre-tokens of their own.
_LETTERS = "a-z\xe0-\xf6\xf8-\xff\xdf"
_PUNCTUATION = "!-&(-/:-@\\[-`{-~"  # without the apostrophe, which begins contractions
_SIMPLE = re.compile(f"[{_LETTERS}{_PUNCTUATION}0-9]+")
_PIECE_OF = re.compile(f"[{_LETTERS}]+|[0-9]|[{_PUNCTUATION}]+")


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 stands for itself, the other bytes follow from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (b for b in range(256) if b not in plain)
    return {b: chr(256 + i) for i, b in enumerate(others)}


_SPELT = _byte_letters()


class Ids:
    """Little-endian 32-bit ids of texts, by a cache of words as they stand and the pre-tokens that they consist of.

    The cache has two generations: what is met goes into the young one; when that is full it becomes the old
    one, from which words that are met again come back.  So frequent words stay and memory is bounded.
    """

    STOPS = frozenset(".,!?;:")

    def __init__(self, path: str, room: int = ROOM):
        from tokenizers import Tokenizer

        self.room = room
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.specials = [t.content for t in self.library.get_added_tokens_decoder().values()]

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _add(self, new: set[str]) -> None:
        young, old, stops = self.young, self.old, self.STOPS
        if old:
            again = [w for w in new if w in old]
            young.update({w: old[w] for w in again})
            new.difference_update(again)
        parts: dict[str, list[str]] = {}  # of words that are not a pre-token themselves
        pieces = set()
        for w in new:
            if len(w) > LONGEST:
                continue
            low = w.lower()
            if low.isascii() and low.isalpha():  # most words are letters, with or without a stop
                own = [low]
            elif low.isascii() and low[-1] in stops and low[:-1].isalpha():
                own = [low[:-1], low[-1]]
            elif _SIMPLE.fullmatch(low):
                own = _PIECE_OF.findall(low)
            else:
                young[w] = self.whole(w)
                continue
            pieces.update(own)
            if own[0] != w:
                parts[w] = own
        tokenize = self.library.model.tokenize  # a piece is normal already; its bytes are spelt as the model's letters
        for p in pieces.difference(young):
            if p in old:
                young[p] = old[p]
            else:
                spelt = p if p.isascii() else p.encode().decode("latin-1").translate(_SPELT)
                young[p] = array("I", [t.id for t in tokenize(spelt)]).tobytes()
        young.update({w: b"".join([young[p] for p in own]) for w, own in parts.items()})

    def batch(self, texts: list[str | None]) -> list[bytes]:
        gc.disable()  # a great many strings and no cycles
        try:
            return self._batch(texts)
        finally:
            gc.enable()

    def _batch(self, texts: list[str | None]) -> list[bytes]:
        if len(self.young) > self.room:
            self.old, self.young = self.young, {}
        odd = [t is not None and (_ODD.search(t) is not None or any(s in t for s in self.specials)) for t in texts]
        cut = [[] if o else (t or "").split() for t, o in zip(texts, odd, strict=True)]
        get = self.young.get
        found = [list(map(get, w)) for w in cut]
        gaps = [[i for i, x in enumerate(f) if x is None] for f in found]
        self._add({w[i] for w, g in zip(cut, gaps, strict=True) for i in g})
        for w, f, g in zip(cut, found, gaps, strict=True):
            for i in g:
                f[i] = get(w[i]) or self.whole(w[i])
        return [self.whole(t) if o else b"".join(f) for t, o, f in zip(texts, odd, found, strict=True)]

    def of(self, text: str | None) -> bytes:
        return self.batch([text])[0]


class Open:
    """Open sequences by room; finds the cheapest with enough room in logarithmic time.

    A tournament over room classes 0..capacity holds in each leaf a heap of (cost, sequence).
    """

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.heaps: list[list] = [[] for _ in range(capacity + 1)]
        self.best: list = [(float("inf"), -1)] * (2 * self.size)

    def _mend(self, room: int) -> None:
        i = room + self.size
        best = self.best
        best[i] = self.heaps[room][0] if self.heaps[room] else (float("inf"), -1)
        i >>= 1
        while i:
            best[i] = min(best[2 * i], best[2 * i + 1])
            i >>= 1

    def put(self, room: int, cost: float, seq: int) -> None:
        heapq.heappush(self.heaps[room], (cost, seq))
        self._mend(room)

    def cheapest(self, least_room: int) -> tuple[float, int]:
        lo, hi, best = least_room + self.size, 2 * self.size, (float("inf"), -1)
        while lo < hi:
            if lo & 1:
                best = min(best, self.best[lo])
                lo += 1
            if hi & 1:
                hi -= 1
                best = min(best, self.best[hi])
            lo >>= 1
            hi >>= 1
        return best

    def take(self, room: int) -> tuple[float, int]:
        got = heapq.heappop(self.heaps[room])
        self._mend(room)
        return got


def sizes_of(total: int, capacity: int) -> list[int]:
    """Lengths of the sequences for total tokens: full ones, and powers of two for the rest."""
    rest = total % capacity
    return [capacity] * (total // capacity) + [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]


def pack(lengths: list[int], capacity: int = CAPACITY, linear: float = 1.0, quadratic: float = 1 / 4096) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece; sequences are filled to their sizes."""
    sizes = sizes_of(sum(lengths), capacity)
    room = list(sizes)
    out: list[tuple[int, int, int, int, int]] = []
    queue: list[tuple[int, int, int]] = []  # (length, document, start)
    seq = 0
    for d, n in enumerate(lengths):
        start = 0
        while n - start >= capacity:  # a full sequence is as dear as any can be
            out.append((d, start, capacity, seq, 0))
            room[seq] = 0
            start += capacity
            seq += 1
        if start < n:
            queue.append((n - start, d, start))
    queue.sort(key=lambda x: -x[0])
    free = Open(capacity)
    for s in range(seq, len(sizes)):
        free.put(room[s], 0.0, s)
    for n, d, start in queue:
        while n:
            cost, s = free.cheapest(n)
            if s < 0:
                cost, s = free.cheapest(1)
            free.take(room[s])
            part = min(n, room[s])
            out.append((d, start, part, s, sizes[s] - room[s]))
            room[s] -= part
            if room[s]:
                free.put(room[s], cost + linear * part + quadratic * part * part, s)
            start += part
            n -= part
    return out


_PIECE = [("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType()), ("doc_tokens", T.LongType()), ("sequence_id", T.LongType()), ("offset", T.LongType())]


def packed(
    df: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    window_tokens: int = WINDOW,
    linear: float = 1.0,
    quadratic: float = 1 / 4096,
    with_ids: bool = False,
) -> DataFrame:
    """A row for each piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and its ids if asked for.

    The upper bits of sequence_id are the task's partition, so ids are unique without any exchange.
    """
    narrow = df.select(F.col(id_col).alias("pack_id"), F.col(text_col).cast("string").alias("pack_text"))
    fields = [narrow.schema["pack_id"]] + [T.StructField(n, t) for n, t in _PIECE]
    if with_ids:
        fields.append(T.StructField("ids", T.BinaryType()))
    small_batches(df.sparkSession)
    end = np.array([END], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = worker_state(("ids", path), lambda: Ids(path))  # outlives the task
        first = TaskContext.get().partitionId() << 40
        keys: list = []
        texts: list[bytes] = []
        held = 0

        def flush(kind: pa.DataType) -> pa.RecordBatch:
            nonlocal first, held
            lengths = [len(t) // 4 for t in texts]
            pieces = pack(lengths, capacity, linear, quadratic)
            parts = [memoryview(texts[d])[4 * s : 4 * (s + n)] for d, s, n, _, _ in pieces]
            columns = [pa.array([keys[d] for d, *_ in pieces], kind)]
            columns += [
                pa.array(v, pa.int64())
                for v in (
                    [p[1] for p in pieces], [p[2] for p in pieces], [zlib.crc32(p) for p in parts],
                    [lengths[p[0]] for p in pieces], [first + p[3] for p in pieces], [p[4] for p in pieces],
                )
            ]
            if with_ids:
                columns.append(pa.array([bytes(p) for p in parts], pa.binary()))
            first += len(sizes_of(held, capacity))
            keys.clear()
            texts.clear()
            held = 0
            return pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

        kind = None
        for b in batches:
            kind = b.column(0).type
            for key, text in zip(b.column(0).to_pylist(), words.batch(b.column(1).to_pylist()), strict=True):
                ids = text + end
                keys.append(key)
                texts.append(ids)
                held += len(ids) // 4
                if held >= window_tokens:
                    yield flush(kind)
        if keys:
            yield flush(kind)

    return narrow.mapInArrow(run, T.StructType(fields)).withColumnRenamed("pack_id", id_col)


def op8_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))
