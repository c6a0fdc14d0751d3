"""Exact deduplication with counting quotient filters.

Each input partition builds counting quotient filters over the 64-bit fingerprints of its normalised texts. A
fingerprint splits into a quotient (its slot) and a remainder; nothing is cut off, so filters merge losslessly by
merging their sorted remainders. Only fingerprints counted more than once lead to a comparison of bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import collapse_space, hex_sha256, join_hot, materialize, partitions

#: Fingerprints that one filter holds at most before it is passed on: what a task keeps in memory.
FILTER_CAPACITY = 1 << 20
#: Repeated fingerprints are broadcast only if they are no more than this (8 MB); more are joined by a shuffle.
BROADCAST_FINGERPRINTS = 1 << 20


class CountingQuotientFilter:
    """A static counting quotient filter: occupied bits by quotient, run-end bits by slot, sorted remainders, counts."""

    def __init__(self, q: int, occupied: bytes, run_ends: bytes, remainders: np.ndarray, counts: np.ndarray):
        self.q, self.occupied, self.run_ends, self.remainders, self.counts = q, occupied, run_ends, remainders, counts

    @classmethod
    def build(cls, fingerprints: np.ndarray) -> CountingQuotientFilter:
        """From uint64 fingerprints in any order."""
        fp, n = np.unique(fingerprints, return_counts=True)
        return cls.from_sorted(fp, n.astype(np.int64))

    @classmethod
    def from_sorted(cls, fp: np.ndarray, n: np.ndarray) -> CountingQuotientFilter:
        """From sorted, distinct fingerprints and the count of each."""
        q = max(1, int(len(fp)).bit_length())
        quotient = (fp >> np.uint64(64 - q)).astype(np.int64)
        occupied = np.zeros(1 << q, bool)
        occupied[quotient] = True
        ends = np.r_[quotient[1:] != quotient[:-1], True] if len(fp) else np.empty(0, bool)
        return cls(q, np.packbits(occupied).tobytes(), np.packbits(ends).tobytes(), fp & np.uint64((1 << (64 - q)) - 1), n)

    def fingerprints(self) -> np.ndarray:
        """The sorted fingerprints, put together again from quotients and remainders."""
        n = len(self.remainders)
        slots = np.flatnonzero(np.unpackbits(np.frombuffer(self.occupied, np.uint8), count=1 << self.q))
        ends = np.unpackbits(np.frombuffer(self.run_ends, np.uint8), count=n).astype(bool)
        run = np.cumsum(ends) - ends
        return (slots[run].astype(np.uint64) << np.uint64(64 - self.q)) | self.remainders

    def merged(self, other: CountingQuotientFilter) -> CountingQuotientFilter:
        """Both filters' sorted remainders, run by run in one pass; counts of equal fingerprints add up."""
        one, two = self.fingerprints(), other.fingerprints()
        at = np.searchsorted(one, two)  # where two's go among one's, both in order already
        same = one[np.minimum(at, len(one) - 1)] == two if len(one) else np.zeros(len(two), bool)
        counts = self.counts.copy()
        counts[at[same]] += other.counts[same]
        return self.from_sorted(np.insert(one, at[~same], two[~same]), np.insert(counts, at[~same], other.counts[~same]))

    @staticmethod
    def merge(filters: list[CountingQuotientFilter]) -> CountingQuotientFilter:
        """Two by two, so that each fingerprint is merged logarithmically often."""
        filters = filters or [CountingQuotientFilter.build(np.empty(0, np.uint64))]
        while len(filters) > 1:
            filters = [a.merged(b) for a, b in zip(filters[::2], filters[1::2], strict=False)] + filters[len(filters) & ~1 :]
        return filters[0]


_FILTER = "block int, q int, occupied binary, run_ends binary, remainders binary, counts binary"


def _filters(blocks: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush():
            fp = np.concatenate(held)
            held.clear()
            block = (fp >> np.uint64(32)).astype(np.int64) * blocks >> 32
            for b in np.unique(block):
                f = CountingQuotientFilter.build(fp[block == b])
                yield pa.RecordBatch.from_pydict(
                    {"block": pa.array([b], pa.int32()), "q": pa.array([f.q], pa.int32()), "occupied": [f.occupied], "run_ends": [f.run_ends], "remainders": [f.remainders.tobytes()], "counts": [f.counts.tobytes()]}
                )

        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            if sum(map(len, held)) >= FILTER_CAPACITY:
                yield from flush()
        if sum(map(len, held)):
            yield from flush()

    return build


def _repeated(table: pa.Table) -> pa.Table:
    rows = table.to_pydict()
    merged = CountingQuotientFilter.merge(
        [CountingQuotientFilter(*x[:3], np.frombuffer(x[3], np.uint64), np.frombuffer(x[4], np.int64)) for x in zip(rows["q"], rows["occupied"], rows["run_ends"], rows["remainders"], rows["counts"], strict=True)]
    )
    more = merged.counts > 1
    return pa.table({"fp": merged.fingerprints()[more].view(np.int64), "n": merged.counts[more]})


def repeated_fingerprints(fingerprints: DataFrame, total: int) -> DataFrame:
    """(fp, n) of every 64-bit fingerprint that the one column of ``fingerprints`` holds more than once."""
    spark = fingerprints.sparkSession
    blocks = max(partitions(spark), total // FILTER_CAPACITY + 1)
    filters = fingerprints.mapInArrow(_filters(blocks), _FILTER)
    return filters.groupBy("block").applyInArrow(_repeated, "fp long, n long")


def exact_dedup(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row: (id, keep_id, group_size long, kept boolean, text_sha256 string).

    Texts are equal when identical after each run of ASCII white space becomes one space. Null counts as empty; of
    equal texts the row with the smallest id stays (a null id only if it has no other). Rows that repeat an id and
    its text count in group_size and share their verdict. An empty table gives an empty result; other columns are
    not read.
    """
    source = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    norm = collapse_space(F.col("text"))
    keys = materialize(source.select("doc_id", F.xxhash64(norm).alias("fp"), hex_sha256(norm).alias("text_sha256")))
    total = keys.count()
    repeated = materialize(repeated_fingerprints(keys.select("fp"), total))
    texts = source.withColumn("fp", F.xxhash64(norm))
    if repeated.count() <= BROADCAST_FINGERPRINTS:
        texts = texts.join(F.broadcast(repeated.select("fp")), "fp", "left_semi")  # no text moves that none may equal
    else:
        texts = join_hot(texts, repeated, ["fp"], "n", total)
    # Bytes decide: the key is the normalised text itself, combined before it is shuffled.
    same = texts.groupBy(norm.alias("t")).agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    groups = materialize(same.filter("group_size > 1").select(hex_sha256(F.col("t")).alias("text_sha256"), "keep_id", "group_size"))
    out = join_hot(keys, groups, ["text_sha256"], "group_size", total, "left")
    keep = F.coalesce("keep_id", "doc_id")
    return out.select(
        "doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256",
    )
