"""Byte-level byte-pair encoding and decoding.

A pre-token is looked up in two tiers. First, a minimal perfect hash over the vocabulary finds pre-tokens that are
whole tokens: one hash, one displacement, one comparison. The rest are merged with a heap of candidate pairs over a
linked list of bytes, in O(n log n) for a pre-token of n bytes.
"""

from __future__ import annotations

import base64
import functools
import heapq
import re
import struct
import unicodedata
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROWS, slices, trim_memory

#: Bytes that remembered pre-tokens may take in a worker: half for the latest, half for those before.
MEMO_BYTES = 96 << 20

#: The letters and numbers of Unicode 16 that the tables of Unicode 15.1 do not have.
LATER_LETTERS = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
LATER_NUMBERS = ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA))


@functools.cache
def _ranges(kind: str, limit: int) -> str:
    """The inside of a character class below ``limit``: letters (L) and numbers (N) of Unicode 16, or white space (s)."""
    later = {c for a, b in {"L": LATER_LETTERS, "N": LATER_NUMBERS, "s": ()}[kind] for c in range(a, b + 1)}

    def held(c: int) -> bool:
        return chr(c).isspace() and not 0x1C <= c <= 0x1F if kind == "s" else unicodedata.category(chr(c))[0] == kind or c in later

    out, start = [], None
    for c in range(limit + 1):
        if c < limit and held(c):
            start = c if start is None else start
        elif start is not None:
            out.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return "".join(out)


class Splitter:
    r"""``findall`` of a pattern with \p{L}, \p{N}, \s and \S, which it writes out as plain character classes.

    Texts of ASCII or Latin-1 alone have patterns of their own, with smaller classes.
    """

    def __init__(self, pattern: str):
        self.ascii, self.latin, self.any = (re.compile(self._written(pattern, x)) for x in (0x80, 0x100, 0x110000))

    @staticmethod
    def _written(pattern: str, limit: int) -> str:
        out, inside, at = [], False, 0
        for m in re.finditer(r"\\p\{([LN])\}|\\([sS])|\\.|[\[\]]", pattern, re.DOTALL):
            out.append(pattern[at : m.start()])
            at = m.end()
            if m[1] or m[2]:
                r = _ranges(m[1] or "s", limit)
                if inside and m[2] == "S":
                    raise ValueError("\\S inside a class")
                out.append(r if inside else f"[{'^' * (m[2] == 'S')}{r}]")
            else:
                inside = m[0] == "[" or inside and m[0] != "]"
                out.append(m[0])
        return "".join(out) + pattern[at:]

    def findall(self, text: str) -> list[str]:
        if text.isascii():
            return self.ascii.findall(text)
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.any.findall(text)
        return self.latin.findall(text)


class Merges:
    """Ranks of the pairs that merge: for each symbol, what may follow it; ``made`` is what each rank becomes."""

    def __init__(self, pairs: dict[tuple[int, int], int], made: Sequence[int], symbols: int):
        after: list[dict[int, int] | None] = [None] * symbols
        for (a, b), r in pairs.items():
            if after[a] is None:
                after[a] = {}
            after[a][b] = r
        self.made = made
        none: dict[int, int] = {}
        self.after = [none if x is None else x for x in after]
        self.get = [x.get for x in self.after]

    def __getstate__(self):
        return self.after, self.made

    def __setstate__(self, state):
        self.after, self.made = state
        self.get = [x.get for x in self.after]

    def merge(self, part: list[int]) -> list[int]:
        """Merge neighbours, the pair of least rank and then the leftmost first, until none has a rank.

        The heap holds rank and place in one integer; the parts are a linked list.
        """
        n, get, made = len(part), self.get, self.made
        ranks = [get[a](b, -1) for a, b in zip(part, part[1:], strict=False)]
        ranks.append(-1)
        bits = 14 if n < 1 << 14 else 32  # short pieces keep the heap's integers small
        low = (1 << bits) - 1
        heap = [r << bits | i for i, r in enumerate(ranks) if r >= 0]
        if not heap:
            return part
        part = list(part)
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            x = pop(heap)
            i, r = x & low, x >> bits
            if ranks[i] != r:
                continue  # one of the two has been merged since
            j = after[i]
            part[i] = new = made[r]
            part[j] = ranks[j] = -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                ranks[i] = r = get[new](part[k], -1)
                if r >= 0:
                    push(heap, r << bits | i)
            else:
                ranks[i] = -1
            h = before[i]
            if h >= 0:
                ranks[h] = r = get[part[h]](new, -1)
                if r >= 0:
                    push(heap, r << bits | h)
        return [x for x in part if x >= 0]


class PerfectHash:
    """Minimal perfect hash (hash and displace) from byte strings to 0..n-1; others map anywhere, so compare keys."""

    def __init__(self, keys: list[bytes]):
        self.n = n = len(keys)
        self.buckets = max(1, n // 3)
        by: dict[int, list[int]] = {}
        for i, k in enumerate(keys):
            by.setdefault(xxhash.xxh64_intdigest(k) % self.buckets, []).append(i)
        self.displace = [0] * self.buckets
        self.index = [-1] * n
        order = sorted(by.items(), key=lambda x: (-len(x[1]), x[0]))
        for b, members in order:
            if len(members) == 1:
                break
            seed = 1
            while True:
                slots = [xxhash.xxh64_intdigest(keys[i], seed) % n for i in members]
                if len(set(slots)) == len(slots) and all(self.index[s] < 0 for s in slots):
                    break
                seed += 1
            self.displace[b] = seed
            for s, i in zip(slots, members, strict=True):
                self.index[s] = i
        free = (s for s in range(n) if self.index[s] < 0)
        for b, members in order:
            if len(members) == 1:  # a lone key takes any free slot, which is written down as such
                s = next(free)
                self.displace[b], self.index[s] = -1 - s, members[0]

    def slot(self, key: bytes) -> int:
        d = self.displace[xxhash.xxh64_intdigest(key) % self.buckets]
        return -1 - d if d < 0 else xxhash.xxh64_intdigest(key, d) % self.n


class ByteBPE:
    """Encoder and decoder over a table of ranks, which are the ids. Its tables are built once and travel with it."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.tokens = list(ranks)
        self.ids = list(ranks.values())
        self.hash = PerfectHash(self.tokens)
        self.split = Splitter(pattern)
        self.byte_ids = [ranks.get(bytes([b])) for b in range(256)]
        self.table = bytes(self.byte_ids) if all(i is not None and i < 256 for i in self.byte_ids) else None
        symbols = max(self.ids, default=0) + 1
        pairs = {
            (a, b): r for t, r in ranks.items() for i in range(1, len(t)) if (a := ranks.get(t[:i])) is not None and (b := ranks.get(t[i:])) is not None
        }
        self.merges = Merges(pairs, range(symbols), symbols)  # a pair's rank is the id of what it becomes
        spelled: list[bytes | None] = [None] * symbols
        for i, t in zip(self.ids, self.tokens, strict=True):
            spelled[i] = t
        self.spelled = pa.array(spelled, pa.binary())
        self.memo = Memo(self.encode_piece)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "memo"}

    def __setstate__(self, state):
        self.__dict__ = state
        self.memo = Memo(self.encode_piece)

    @classmethod
    def from_file(cls, path: str, pattern: str) -> ByteBPE:
        """From lines of a token in base64 and its rank."""
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)

    def encode_piece(self, piece: str) -> bytes:
        """The ids of one pre-token, as int32 bytes."""
        raw = piece.encode()
        at = self.hash.index[self.hash.slot(raw)]
        if self.tokens[at] == raw:
            return struct.pack("=i", self.ids[at])
        merged = self.merges.merge(list(raw.translate(self.table)) if self.table else [self.byte_ids[b] for b in raw])
        return struct.pack(f"={len(merged)}i", *merged)

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.memo.__getitem__, self.split.findall(text)))

    def decode(self, ids: pa.Array, ends: np.ndarray) -> pa.Array:
        """The bytes of each run ids[ends[i] : ends[i + 1]]."""
        spelled = self.spelled.take(ids)
        _, offsets, data = spelled.buffers()
        at = np.frombuffer(offsets, np.int32)[spelled.offset :][ends] if offsets is not None and len(ids) else np.zeros(len(ends), np.int32)
        return pa.BinaryArray.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(np.ascontiguousarray(at)), data])


class Memo(dict):
    """Remembers what ``make`` gave, in two generations: the older goes when the younger is full."""

    def __init__(self, make: Callable, size: int = MEMO_BYTES // 2):
        self.make, self.size, self.held, self.older = make, size, 0, {}

    def __missing__(self, piece):
        out = self.older.get(piece)
        if out is None:
            out = self.make(piece)
        if self.held > self.size:
            self.older, self.held = dict(self), 0
            self.clear()
        self.held += 220 + 5 * len(piece)
        self[piece] = out
        return out


def _offsets(lengths: list[int]) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)


def bpe_encode(documents: DataFrame, bpe: ByteBPE, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """(id, ids array<int>) of each row; with ``decoded`` also the bytes that the ids decode to, in the same pass.

    A null or empty text has no ids. Rows with a null or repeated id are rows like others. An empty table gives an
    empty result; other columns are not read.
    """
    held = documents.sparkSession.sparkContext.broadcast(bpe)  # the vocabulary's size bounds it

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = held.value
        for batch in slices(batches, 1):
            coded = [bpe.encode(t) if t else b"" for t in batch.column(1).to_pylist()]
            ends = _offsets([len(x) // 4 for x in coded])
            ids = pa.array(np.frombuffer(b"".join(coded), np.int32), pa.int32())
            out = [batch.column(0), pa.ListArray.from_arrays(pa.array(ends), ids)]
            yield pa.RecordBatch.from_arrays(out + [bpe.decode(ids, ends)] * decoded, ["doc_id", "ids", "decoded"][: 2 + decoded])
        trim_memory()

    rows = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    like = rows.select("doc_id", F.array(F.lit(0)).alias("ids"), F.lit(b"").alias("decoded"))
    return rows.mapInArrow(run, (like if decoded else like.drop("decoded")).schema)


def bpe_decode(encoded: DataFrame, bpe: ByteBPE) -> DataFrame:
    """(doc_id, ids, decoded binary) of each row of (doc_id, ids array<int>); null ids decode to nothing."""
    held = encoded.sparkSession.sparkContext.broadcast(bpe)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = held.value
        for batch in batches:
            length = np.asarray(pc.fill_null(pc.list_value_length(batch.column(1)), 0))
            ends = np.concatenate([[0], np.cumsum(length)]).astype(np.int64)
            for at in range(0, batch.num_rows, ROWS):
                some = batch.slice(at, ROWS)
                flat = pc.list_flatten(some.column(1))
                own = ends[at : at + some.num_rows + 1] - ends[at]
                yield pa.RecordBatch.from_arrays([*some.columns, bpe.decode(flat, own)], ["doc_id", "ids", "decoded"])

    rows = encoded.select("doc_id", "ids")
    return rows.mapInArrow(run, rows.withColumn("decoded", F.lit(b"")).schema)
