"""Line deduplication with two Bloom filters.

One blocked Bloom filter is for hashes of lines seen once, the other for hashes seen in a second document. A slot that
is seen once twice is seen twice. Only lines that the twice-seen filter suspects are shuffled, to be confirmed exactly
by their own characters.

Where the twice-seen filter is small, tasks fill filters of their own, these are merged block by block on the
executors, and the merged filter is broadcast. Where it would be larger than MAX_FILTER_BITS, both filters are
partitioned by ranges of the hash, and the lines' hashes go to their range; the filters then stay where they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, join_hot, materialize, slices, trim_memory

BLOCK_BITS = 1 << 16
#: A filter is broadcast only if it has at most so many bits (32 MB); a larger one is partitioned.
MAX_FILTER_BITS = 1 << 28
BITS_A_DOCUMENT = 256
#: Bits of each range of a partitioned filter, and so documents a range on average.
RANGE_BITS = 1 << 24


def _keys(batch: pa.RecordBatch, min_chars: int) -> tuple[np.ndarray, pa.Array]:
    """Row number and key of each line of at least min_chars code points; each key once a row."""
    lines = pc.split_pattern(pc.fill_null(batch.column("text"), ""), "\n")
    row = pc.list_parent_indices(lines)
    key = pc.ascii_lower(pc.utf8_trim(pc.list_flatten(lines), ASCII_SPACE))
    long = pc.greater_equal(pc.utf8_length(key), min_chars)
    pairs = pa.table({"row": pc.filter(row, long), "key": pc.filter(key, long)}).group_by(["row", "key"]).aggregate([])
    return pairs["row"].to_numpy().astype(np.int64), pairs["key"].combine_chunks()


def _hashes(keys: pa.Array) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(k.as_buffer()) if k.as_buffer() else xxhash.xxh64_intdigest(b"") for k in keys), np.uint64, len(keys))


def _slots(h: np.ndarray, bits: int) -> np.ndarray:
    """Two bits of one block for each hash, as numbers below ``bits``."""
    block = (h >> np.uint64(32)) % np.uint64(bits // BLOCK_BITS) * np.uint64(BLOCK_BITS)
    return np.stack([block + (h & np.uint64(0xFFFF)), block + (h >> np.uint64(16) & np.uint64(0xFFFF))]).astype(np.int64)


def _both(filter_: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (filter_[slots >> 3] >> (7 - (slots & 7)).astype(np.uint8) & 1).all(0)


def _set(filter_: np.ndarray, slots: np.ndarray) -> None:
    np.bitwise_or.at(filter_, slots.ravel() >> 3, (128 >> (slots.ravel() & 7)).astype(np.uint8))


def _see(once: np.ndarray, twice: np.ndarray, h: np.ndarray, n: np.ndarray, bits: int) -> None:
    """Enter distinct hashes, each with the documents that it was just found in, into both filters."""
    s = _slots(h, bits)
    again = (n > 1) | _both(once, s)  # both bits were set before: perhaps a second document
    _set(twice, s[:, again])
    _set(once, s)


def _counted(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(h, kind="stable")
    h, n = h[order], n[order]
    first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]][: len(h)])
    return h[first], np.add.reduceat(n, first) if len(h) else n


def _fill(bits: int, min_chars: int):
    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for batch in slices(batches, 1):
            _, keys = _keys(batch, min_chars)
            if len(keys):
                h = _hashes(keys)
                _see(once, twice, *_counted(h, np.ones(len(h), np.int64)), bits)
        for is_twice, held in ((False, once), (True, twice)):
            for block, own in enumerate(held.reshape(-1, BLOCK_BITS // 8)):
                if own.any():
                    at = np.flatnonzero(np.unpackbits(own)).astype(np.uint16)
                    dense = 2 * len(at) >= len(own)
                    yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "twice": [is_twice], "dense": [dense], "bits": [own.tobytes() if dense else at.tobytes()]})
        trim_memory()

    return fill


def _merge(table: pa.Table) -> pa.Table:
    once, twice = np.zeros(BLOCK_BITS, bool), np.zeros(BLOCK_BITS, bool)
    for is_twice, dense, bits in zip(table["twice"].to_pylist(), table["dense"].to_pylist(), table["bits"].to_pylist(), strict=True):
        at = np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8))) if dense else np.frombuffer(bits, np.uint16)
        if is_twice:
            twice[at] = True
        else:
            twice[at[once[at]]] = True
            once[at] = True
    return pa.table({"block": pa.array([table["block"][0].as_py()], pa.int32()), "bits": [np.packbits(twice).tobytes()]})


def _suspects(held, bits: int, min_chars: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = np.frombuffer(held.value, np.uint8)
        for batch in slices(batches, 1):
            rows, keys = _keys(batch, min_chars)
            if len(keys):
                hit = pa.array(_both(twice, _slots(_hashes(keys), bits)))
                yield pa.RecordBatch.from_arrays([pc.take(batch.column("doc_id"), pa.array(rows)).filter(hit), keys.filter(hit)], ["doc_id", "key"])
        trim_memory()

    return find


def _by_broadcast(documents: DataFrame, min_chars: int, bits: int) -> DataFrame:
    filled = documents.mapInArrow(_fill(bits, min_chars), "block int, twice boolean, dense boolean, bits binary")
    merged = filled.groupBy("block").applyInArrow(_merge, "block int, bits binary")
    twice = bytearray(bits // 8)  # at most MAX_FILTER_BITS / 8
    for block, found in merged.toLocalIterator():
        twice[block * BLOCK_BITS // 8 : (block + 1) * BLOCK_BITS // 8] = found
    held = documents.sparkSession.sparkContext.broadcast(bytes(twice))
    return documents.mapInArrow(_suspects(held, bits, min_chars), documents.select("doc_id", F.lit("").alias("key")).schema)


def _by_ranges(documents: DataFrame, min_chars: int, bits: int) -> DataFrame:
    ranges, own = -(-bits // RANGE_BITS), max(RANGE_BITS, BLOCK_BITS)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, n, held = np.empty(0, np.uint64), np.empty(0, np.int64), []
        for batch in slices(batches, 1):
            held.append(_hashes(_keys(batch, min_chars)[1]))
            if sum(map(len, held)) > 1 << 20:
                more = np.concatenate(held)
                h, n = _counted(np.concatenate([h, more]), np.concatenate([n, np.ones(len(more), np.int64)]))
                held.clear()
        more = np.concatenate([np.empty(0, np.uint64), *held])
        h, n = _counted(np.concatenate([h, more]), np.concatenate([n, np.ones(len(more), np.int64)]))
        for at in range(0, len(h), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(h[at : at + (1 << 16)].view(np.int64)), pa.array(n[at : at + (1 << 16)])], ["h", "n"])
        trim_memory()

    def suspects(table: pa.Table) -> pa.Table:
        once, twice = np.zeros(own // 8, np.uint8), np.zeros(own // 8, np.uint8)
        h, n = _counted(table["h"].to_numpy().view(np.uint64), table["n"].to_numpy())
        for at in range(0, len(h), 1 << 16):
            _see(once, twice, h[at : at + (1 << 16)], n[at : at + (1 << 16)], own)
        hit = _both(twice, _slots(h, own))
        trim_memory()
        return pa.table({"h": h[hit].view(np.int64), "n": n[hit]})

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            rows, keys = _keys(batch, min_chars)
            yield pa.RecordBatch.from_arrays([pc.take(batch.column("doc_id"), pa.array(rows)), pa.array(_hashes(keys).view(np.int64))], ["doc_id", "h"])
        trim_memory()

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            rows, keys = _keys(batch, min_chars)
            wanted = [set(x or ()) for x in batch.column("hs").to_pylist()]
            hit = pa.array([h in wanted[r] for r, h in zip(rows.tolist(), _hashes(keys).view(np.int64).tolist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([pc.take(batch.column("doc_id"), pa.array(rows)).filter(hit), keys.filter(hit)], ["doc_id", "key"])
        trim_memory()

    # a task sends each hash once, with its number of documents, so that no range gets a common line's documents
    seen = documents.mapInArrow(counted, "h long, n long").withColumn("range", F.pmod(F.xxhash64("h"), F.lit(ranges)))
    found = materialize(seen.groupBy("range").applyInArrow(suspects, "h long, n long"))
    lines = documents.mapInArrow(hashes, documents.select("doc_id", F.lit(0).cast("long").alias("h")).schema)
    by = join_hot(lines, found, ["h"], "n", found.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]).groupBy("doc_id").agg(F.collect_set("h").alias("hs"))
    return documents.join(by, "doc_id").select("doc_id", "text", "hs").mapInArrow(texts, documents.select("doc_id", F.lit("").alias("key")).schema)


def suspected_lines(documents: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, key) of the lines that may stand in a second document; holds every line that does."""
    n = max(1, documents.count())
    bits = max(1 << 20, 1 << (n * BITS_A_DOCUMENT - 1).bit_length())
    return (_by_broadcast if bits <= MAX_FILTER_BITS else _by_ranges)(documents, min_chars, bits)


def line_dedup(documents: DataFrame, min_chars: int = 20, min_docs: int = 3, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """Each row's (id, n_lines long, n_dropped long, kept string): its text without lines that other documents hold.
    With carry, also ``row``: a struct of all columns of the input row.

    A text splits at line feeds (null or empty: one empty line). A line's key is the line without ASCII white space
    at both ends, with A-Z in lower case. Keys of at least min_chars code points found in at least min_docs ids lose
    all their lines except in the largest id that holds them; other lines stay, joined by line feeds. Rows that share
    an id count as one document; rows whose id is null keep all lines. An empty table gives an empty result; other
    columns are not read.
    """
    row = [F.struct(*[F.col(c) for c in documents.columns]).alias("row")] if carry else []
    source = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *row)
    suspects = materialize(suspected_lines(source.select("doc_id", "text").filter("doc_id IS NOT NULL"), min_chars).dropDuplicates(["doc_id", "key"]))
    total = suspects.count()
    found = suspects.groupBy("key").agg(F.count("*").alias("docs"), F.max("doc_id").alias("last")).filter(F.col("docs") >= min_docs)
    repeated = materialize(found.select(F.sha2("key", 256).alias("digest"), "docs", "last"))  # narrow, however long the line
    drops = join_hot(suspects.withColumn("digest", F.sha2("key", 256)), repeated, ["digest"], "docs", total).filter("doc_id <> last")
    dropped = drops.groupBy("doc_id").agg(F.collect_list("key").alias("drops"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            kept, n_lines, n_dropped = [], [], []
            for text, drops in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                text = text or ""
                lost = 0
                n_lines.append(text.count("\n") + 1)
                if drops:
                    gone = {x.encode() for x in drops}
                    lines = text.split("\n")
                    own = [x for x in lines if x.encode().strip(b" \t\n\v\f\r").lower() not in gone]
                    text, lost = "\n".join(own), len(lines) - len(own)
                kept.append(text)
                n_dropped.append(lost)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.string()), *batch.columns[3:]], names)
        trim_memory()

    names = ["doc_id", "n_lines", "n_dropped", "kept", *["row"] * carry]
    rows = source.join(dropped, "doc_id", "left").select("doc_id", "text", "drops", *["row"] * carry)
    long = F.lit(0).cast("long")
    return rows.mapInArrow(keep, rows.select("doc_id", long.alias("n_lines"), long.alias("n_dropped"), F.lit("").alias("kept"), *["row"] * carry).schema)
