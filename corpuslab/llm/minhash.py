"""Near deduplication with BagMinHash.

A text is a multiset of word shingles. Each shingle has Poisson processes over time and weight, with the weights
discretised to whole counts: one process for each of the strips [0, 1), [1, 2), [2, 4), [4, 8), ... that the count
reaches. A wide process gives its first point and then splits into one process for each half of its strip, both from
that point's time on; halves above the count are dropped, and a process one count wide goes on giving points. A point
goes to one random component of the signature. A text stops once its processes are later than all of its components.
Each component is the earliest point that it got; two texts agree in it with the probability of their weighted
Jaccard similarity, since what a process gives depends on its shingle and strip alone.

Signatures are banded. In each bucket all texts are first compared with the bucket's first text. Then texts that meet
in a bucket and that this leaves in different classes are compared by signature, and the multisets of pairs that may
be similar decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dense, join_hot, materialize, one_row_per_id, partitions, slices, small_batches, trim_memory
from .components import components
from .shingles import mix, shingle_counts

BANDS, ROWS = 25, 5
COMPONENTS = BANDS * ROWS
#: Similar means 5 * overlap >= 4 * union, counted with multiplicity.
THRESHOLD = (4, 5)
#: Pairs that agree in fewer components are not similar: 80 % agree in 100 +- 4.5, so 80 are 4.5 deviations less.
LEAST_AGREEING = 80
#: Ids of texts to compare are broadcast only if they are no more than this (8 MB); of more, a filter of at most
#: FILTER_BITS (32 MB) is. Texts are never shuffled: what the filter lets through besides is not asked for later.
BROADCAST_IDS = 1 << 20
FILTER_BITS, FILTER_CHUNK = 1 << 28, 1 << 20
#: Processes that are followed at a time.
ITEMS = 1 << 16
#: Shingles that one side of a comparison holds in a task, if one text alone does not have more.
PART = 1 << 18

_STEP = np.uint64(0x9E3779B97F4A7C15)
_STRIP = np.uint64(0xA0761D6478BD642F)
_HALVES = np.array([0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], np.uint64)


def _follow(row: np.ndarray, shingle: np.ndarray, count: np.ndarray, best: np.ndarray) -> None:
    """Lower the times in ``best`` (rows, COMPONENTS) by what the processes of these shingles give."""
    slot_of, weight_of = row, count
    strips = np.ceil(np.log2(np.maximum(count, 1))).astype(np.int64) + 1
    item = np.repeat(np.arange(len(row)), strips)
    strip = np.arange(len(item)) - np.repeat(np.cumsum(strips) - strips, strips)
    low = np.where(strip == 0, 0, 1 << np.maximum(strip - 1, 0))
    width = np.where(strip == 0, 1, low)
    state = mix(shingle[item] ^ mix(strip.astype(np.uint64) * _STRIP))
    time, step = np.zeros(len(item)), np.zeros(len(item), np.uint64)
    flat = best.reshape(-1)

    def draw(state: np.ndarray, step: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Waiting time (at rate 1), place in ``best`` and 32 more random bits of each step."""
        x = mix(state + step * _STEP)
        wait = -np.log(((x >> np.uint64(11)).astype(float) + 1) * 2.0**-53)
        y = mix(x ^ _STRIP)  # another scrambling, for component and weight
        part = ((y >> np.uint64(40)) * np.uint64(COMPONENTS) >> np.uint64(24)).astype(np.int64)
        return wait, slot_of[item] * COMPONENTS + part, y & np.uint64(0xFFFFFFFF)

    while len(item):
        wide = width > 1
        split = []
        if wide.any():
            i, lo, w, st = item[wide], low[wide], width[wide], state[wide]
            wait, slot, bits = draw(st, np.ones(len(i), np.uint64), i)
            t = time[wide] + wait / (w * float(COMPONENTS))
            at = lo + (bits * w.astype(np.uint64) >> np.uint64(32)).astype(np.int64)
            good = at < weight_of[i]
            np.minimum.at(flat, slot[good], t[good])
            half = w // 2
            for own, from_ in zip(_HALVES, (lo, lo + half), strict=True):
                there = from_ < weight_of[i]
                split.append((i[there], from_[there], half[there], mix(st[there] ^ own), t[there], np.zeros(there.sum(), np.uint64)))
        i, st, k, t0 = item[~wide], state[~wide], step[~wide], time[~wide]
        lo, w = low[~wide], width[~wide]
        if len(i):
            m = int(np.clip(ITEMS // len(i), 1, 32))
            wait, slot, _ = draw(st[:, None], k[:, None] + np.arange(1, m + 1, dtype=np.uint64), i[:, None])
            t = t0[:, None] + np.cumsum(wait, 1) / COMPONENTS
            np.minimum.at(flat, slot.ravel(), t.ravel())
            t0, k = t[:, -1], k + np.uint64(m)
        item, low, width, state, time, step = (np.concatenate(x) for x in zip((i, lo, w, st, t0, k), *split, strict=True))
        limit = best.max(1)
        live = time < limit[slot_of[item]]
        item, low, width, state, time, step = item[live], low[live], width[live], state[live], time[live], step[live]


def signatures(row: np.ndarray, shingle: np.ndarray, count: np.ndarray, rows: int) -> np.ndarray:
    """The (rows, COMPONENTS) earliest times; rows without shingles keep infinity."""
    best = np.full((rows, COMPONENTS), np.inf)
    for at in range(0, len(row), ITEMS):
        _follow(row[at : at + ITEMS], shingle[at : at + ITEMS], count[at : at + ITEMS].astype(np.int64), best)
    return best


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 1):
        for a, b, row, shingle, count in shingle_counts(batch.column(1).to_pylist()):
            n = b - a
            best = signatures(row, shingle, count, n)
            word = mix(best.view(np.uint64).reshape(n, COMPONENTS) + np.uint64(1))
            band = mix(word.reshape(n, BANDS, ROWS) * (2 * np.arange(ROWS, dtype=np.uint64) + np.uint64(1))).sum(2, dtype=np.uint64)
            band = mix(band + np.arange(BANDS, dtype=np.uint64) * _STEP)
            total = np.bincount(row, count, n).astype(np.int64)
            m = [np.zeros(n, np.uint64), np.zeros(n, np.uint64)]
            one = mix(shingle * (2 * count.astype(np.uint64) + np.uint64(1)))
            for held, x in zip(m, (one, mix(one + _STEP)), strict=True):
                np.add.at(held, row, x)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, n), pa.array(m[0].view(np.int64)), pa.array(m[1].view(np.int64)), pa.array(total),
                 pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * BANDS), pa.array(band.ravel().view(np.int64))),
                 pa.array([(x >> np.uint64(32)).astype(np.uint32).tobytes() for x in word])],
                ["doc_id", "m1", "m2", "n_shingles", "bands", "signature"],
            )
    trim_memory()


def sign(documents: DataFrame) -> DataFrame:
    """(doc_id, m1, m2, n_shingles, bands, signature) of (doc_id, text): m1 and m2 identify the multiset."""
    like = documents.select("doc_id", *[F.lit(0).cast("long").alias(x) for x in ("m1", "m2", "n_shingles")], F.array(F.lit(0).cast("long")).alias("bands"), F.lit(b"").alias("signature"))
    return documents.mapInArrow(_sign, like.schema)


def _multisets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 1):
        for a, b, row, shingle, count in shingle_counts(batch.column(1).to_pylist()):
            cut = np.searchsorted(row, np.arange(b - a + 1))
            part = lambda x, cut=cut: [x[i:j].tobytes() for i, j in zip(cut, cut[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(part(shingle), pa.binary()), pa.array(part(count.astype(np.uint32)), pa.binary())], ["doc_id", "shingles", "counts"])
    trim_memory()


def multisets(texts: DataFrame) -> DataFrame:
    """(doc_id, shingles, counts) of (doc_id, text), packed: what is compared, and all that is shuffled of a text."""
    return texts.mapInArrow(_multisets, texts.select("doc_id", F.lit(b"").alias("shingles"), F.lit(b"").alias("counts")).schema)


def _chunk(table: pa.Table) -> pa.Table:
    bits = np.zeros(FILTER_CHUNK, bool)
    bits[table["at"].to_numpy()] = True
    return pa.table({"chunk": pa.array([table["chunk"][0].as_py()], pa.int32()), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})


def multisets_of(texts: DataFrame, needed: DataFrame, count: int) -> DataFrame:
    """The multisets of the texts whose ids are among the ``count`` needed ones, and of a few others; no text moves."""
    size = max(FILTER_CHUNK, min(FILTER_BITS, 1 << (16 * count).bit_length()))
    places = F.array(*[F.pmod(F.xxhash64(F.lit(i), "doc_id"), F.lit(size)) for i in (1, 2)])
    marks = needed.select(F.explode(places).alias("p")).select(F.expr(f"cast(p div {FILTER_CHUNK} as int)").alias("chunk"), F.expr(f"cast(p % {FILTER_CHUNK} as int)").alias("at"))
    chunks = {r.chunk: bytes(r.bits) for r in marks.groupBy("chunk").applyInArrow(_chunk, "chunk int, bits binary").collect()}  # FILTER_BITS at most
    sent = texts.sparkSession.sparkContext.broadcast(np.frombuffer(b"".join(chunks.get(i, bytes(FILTER_CHUNK // 8)) for i in range(size // FILTER_CHUNK)), np.uint8))

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = dense(batch.column(2))
            yield batch.filter(pa.array((sent.value[p >> 3] >> (p & 7).astype(np.uint8) & 1).all(1))).select([0, 1])

    rows = texts.filter(F.col("doc_id").isNotNull()).select("doc_id", "text", places.alias("places"))
    return rows.mapInArrow(lambda batches: _multisets(wanted(batches)), rows.select("doc_id", F.lit(b"").alias("shingles"), F.lit(b"").alias("counts")).schema)


def _overlaps(one: tuple[np.ndarray, np.ndarray], others: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The overlap, counted with multiplicity, of one multiset with each of some."""
    s, c = one
    all_s, all_c = np.concatenate([x for x, _ in others]), np.concatenate([x for _, x in others])
    starts = np.cumsum([0] + [len(x) for x, _ in others[:-1]])
    at = np.minimum(np.searchsorted(s, all_s), len(s) - 1)
    return np.add.reduceat(np.where(s[at] == all_s, np.minimum(c[at], all_c), 0).astype(np.int64), starts)


def _set(table: pa.Table, i: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(table["shingles"][i].as_buffer(), np.uint64), np.frombuffer(table["counts"][i].as_buffer(), np.uint32)


def _similar(pairs: pa.Table, firsts: pa.Table) -> pa.Table:
    """The pairs (a, b) that are similar; pairs has the multisets of a, firsts those of each b (``first``)."""
    found = []
    if pairs.num_rows and firsts.num_rows:
        place = {b: i for i, b in enumerate(firsts["first"].to_pylist())}
        b = pairs["b"].to_numpy()
        a, n_a, n_b = (pairs[x].to_numpy() for x in ("a", "n_a", "n_b"))
        order = np.argsort(b, kind="stable")
        for group in np.split(order, np.flatnonzero(np.diff(b[order])) + 1):
            one = _set(firsts, place[int(b[group[0]])])
            for at in range(0, len(group), 64):
                some = group[at : at + 64]
                overlap = _overlaps(one, [_set(pairs, int(i)) for i in some])
                good = overlap * THRESHOLD[1] >= (n_a[some] + n_b[some] - overlap) * THRESHOLD[0]
                found.append(np.stack([a[some][good], b[some][good]]))
    x = np.concatenate(found, 1) if found else np.empty((2, 0), np.int64)
    trim_memory()
    return pa.table({"a": pa.array(x[0], pa.int64()), "b": pa.array(x[1], pa.int64())})


def compatible(a: str, b: str):
    """Sizes that similar multisets may have: the smaller is at least 4/5 of the larger."""
    return F.least(a, b) * THRESHOLD[1] >= F.greatest(a, b) * THRESHOLD[0]


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that are similar, by their multisets. pairs: distinct (a, b, n_a, n_b) with numbers of shingles.

    A text b that has many partners is sent once for some PART shingles of them, so that no task gets them all.
    """
    size = pairs.groupBy("b").agg(F.count("*").alias("pairs"), F.sum("n_a").alias("work"))
    size = size.select("b", "pairs", F.expr(f"cast(work div {PART} + 1 as int)").alias("parts"))
    size = materialize(size)
    rows, work = pairs.agg(F.count("*"), F.coalesce(F.sum("n_a"), F.lit(0))).first()
    cells = max(partitions(pairs.sparkSession), 2 * work // PART + 1)
    cell = F.pmod(F.xxhash64("b", F.pmod(F.xxhash64("a"), F.col("parts"))), F.lit(cells)).cast("int")
    keyed = materialize(join_hot(pairs, size, ["b"], "pairs", rows).select("a", "b", "n_a", "n_b", cell.alias("cell")))
    left = keyed.join(sets.withColumnRenamed("doc_id", "a"), "a")
    right = keyed.select("b", "cell").distinct().join(sets.withColumnRenamed("doc_id", "b"), "b").toDF("first", "at", "shingles", "counts")
    return left.groupBy("cell").cogroup(right.groupBy("at")).applyInArrow(_similar, "a long, b long")


def _links_between(doc: np.ndarray, tile: np.ndarray, label: np.ndarray, sig: np.ndarray, sets: list, crossed: bool) -> list[tuple[int, int]]:
    """Links (a, b), a > b, that join different labels; of each two labels, as soon as one is found no more are sought.

    With ``crossed`` there are two tiles, and only pairs across them count.
    """
    _, code, size = np.unique(label, return_inverse=True, return_counts=True)
    order = np.lexsort((label, size[code]))  # small classes first: each of their texts meets the large ones in one pass
    root = list(range(len(size)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    doc, tile, code, sig = doc[order], tile[order], code[order], sig[order]
    sets = [sets[i] for i in order.tolist()]
    total = np.array([int(c.sum()) for _, c in sets])
    found = []
    for i in range(len(doc)):
        own = find(code[i])
        rest = np.arange(i + 1, len(doc))
        if crossed:
            rest = rest[tile[rest] != tile[i]]
        now = np.fromiter(map(find, range(len(root))), np.int64, len(root))
        rest = rest[now[code[rest]] != own]
        rest = rest[np.minimum(total[rest], total[i]) * THRESHOLD[1] >= np.maximum(total[rest], total[i]) * THRESHOLD[0]]
        rest = rest[(sig[rest] == sig[i]).sum(1) >= LEAST_AGREEING]
        for at in range(0, len(rest), 64):
            some = rest[at : at + 64]
            overlap = _overlaps(sets[i], [sets[j] for j in some])
            for j in some[overlap * THRESHOLD[1] >= (total[some] + total[i] - overlap) * THRESHOLD[0]].tolist():
                if (other := find(code[j])) != find(code[i]):
                    root[other] = find(code[i])
                    found.append((max(doc[i], doc[j]), min(doc[i], doc[j])))
    return found


def _links_of_tiles(table: pa.Table) -> pa.Table:
    table = table.sort_by([(x, "ascending") for x in ("b", "x", "y")]).combine_chunks()
    b, x, y, doc, label, tile = (table[c].to_numpy() for c in ("b", "x", "y", "doc_id", "label", "tile"))
    found = []
    for group in np.split(np.arange(len(b)), np.flatnonzero((np.diff(b) != 0) | (np.diff(x) != 0) | (np.diff(y) != 0)) + 1):
        if len(group) > 1:
            sig = np.array([np.frombuffer(table["signature"][int(i)].as_buffer(), np.uint32) for i in group])
            found += _links_between(doc[group], tile[group], label[group], sig, [_set(table, int(i)) for i in group], x[group[0]] != y[group[0]])
    out = np.array(sorted(set(found)), np.int64).reshape(-1, 2)
    trim_memory()
    return pa.table({"a": out[:, 0], "b": out[:, 1]})


def links_between_classes(members: DataFrame, labels: DataFrame, reps: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between texts that meet in a bucket and that the labels leave in different classes.

    members: (a, b, n_a, n_b), texts and the first text of their buckets. Around each b, the texts with b's label are
    its main ones, all others the rest. Where there is a rest, it is compared with the main ones and within itself:
    both are cut into tiles of some PART shingles by a hash, each two tiles that need it meet in a group of their
    own, and no pair is a row. Main ones are not compared with each other, and where there is no rest, nothing is.
    """
    of = lambda id_: labels.select(F.col("node").alias(id_), F.col("label").alias(f"label_{id_}"))
    rows = members.join(of("a"), "a", "left").withColumn("label_a", F.coalesce("label_a", "a"))
    firsts = members.groupBy("b").agg(F.count("*").alias("n"), F.max("n_b").alias("n_b")).join(of("b"), "b", "left").withColumn("label_b", F.coalesce("label_b", "b"))
    firsts = materialize(firsts)
    rows = materialize(join_hot(rows.drop("n_b"), firsts.select("b", "n", "n_b", "label_b"), ["b"], "n", members.count()).withColumn("rest", F.expr("label_a <> label_b")))
    several = rows.groupBy("b").agg(
        F.count("*").alias("n"), F.sum(F.when(F.col("rest"), F.col("n_a"))).alias("rest_work"),
        (F.coalesce(F.sum(F.when(~F.col("rest"), F.col("n_a"))), F.lit(0)) + F.max("n_b")).alias("main_work"),
    ).filter("rest_work IS NOT NULL").select("b", "n", F.expr(f"cast(main_work div {PART} + 1 as int) AS m"), F.expr(f"cast(rest_work div {PART} + 1 as int) AS r"))
    several = materialize(several)
    own = rows.select("b", "label_b", "n_b").distinct().selectExpr("b", "b AS doc_id", "label_b AS label", "false AS rest", "n_b AS n_shingles")
    all_ = rows.selectExpr("b", "a AS doc_id", "label_a AS label", "rest", "n_a AS n_shingles").unionByName(own)
    all_ = join_hot(all_, several, ["b"], "n", members.count())
    tile = F.when(F.col("rest"), F.col("m") + F.pmod(F.xxhash64("doc_id"), F.col("r"))).otherwise(F.pmod(F.xxhash64("doc_id"), F.col("m"))).cast("int")
    all_ = all_.withColumn("tile", tile)
    all_ = materialize(all_)
    to_rest, to_all = F.sequence(F.col("m"), F.col("m") + F.col("r") - 1), F.sequence(F.lit(0), F.col("m") + F.col("r") - 1)
    pair = F.explode(F.transform(F.when(F.col("rest"), to_all).otherwise(to_rest), lambda o: F.struct(F.least("tile", o).alias("x"), F.greatest("tile", o).alias("y"))))
    work = all_.agg(F.coalesce(F.expr("sum(n_shingles * if(rest, m + r, r))"), F.lit(0))).first()[0]
    cells = max(partitions(members.sparkSession), work // PART + 1)
    full = all_.join(reps.select("doc_id", "signature"), "doc_id").join(sets, "doc_id").select("b", "doc_id", "label", "signature", "shingles", "counts", "tile", pair.alias("p"))
    full = full.select("*", "p.x", "p.y").drop("p")
    return full.groupBy(F.pmod(F.xxhash64("b", "x", "y"), F.lit(cells)).alias("cell")).applyInArrow(_links_of_tiles, "a long, b long")


def near_dedup(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each id: (doc_id, class_id, class_size long, n_shingles long, kept boolean).

    Words are lower-case runs between ASCII white space; a text is the multiset of its shingles of five words (all of
    its words, if fewer). Texts are linked if their weighted Jaccard similarity is at least 0.8, and a class is what
    links connect, named by its smallest id, which stays. Null, empty and blank texts are classes of their own. Of
    rows that share an id the one with the greatest text stands for all. Each row whose id is null is kept, with a
    null class of size 1, and is compared with nothing. Ids are whole numbers. An empty table gives an empty result;
    other columns are not read.
    """
    spark = documents.sparkSession
    source = one_row_per_id(documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), "doc_id", "text")
    with small_batches(spark):
        signed = materialize(sign(source))
    # equal multisets are one text from here on
    groups = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("m1", "m2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    groups = materialize(groups)
    reps = signed.join(groups.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")

    banded = reps.select("doc_id", F.explode("bands").alias("bucket"))
    buckets = materialize(banded.groupBy("bucket").agg(F.count("*").alias("texts"), F.min("doc_id").alias("b")).filter("texts > 1"))
    members = join_hot(banded, buckets, ["bucket"], "texts", buckets.agg(F.sum("texts")).first()[0] or 0).filter("doc_id <> b")
    members = materialize(members.select(F.col("doc_id").alias("a"), "b").distinct())
    sizes = reps.select("doc_id", "n_shingles")
    firsts = members.groupBy("b").agg(F.count("*").alias("pairs")).join(sizes.withColumnsRenamed({"doc_id": "b", "n_shingles": "n_b"}), "b")
    members = join_hot(members.join(sizes.withColumnsRenamed({"doc_id": "a", "n_shingles": "n_a"}), "a"), materialize(firsts), ["b"], "pairs", members.count())
    members = materialize(members.select("a", "b", "n_a", "n_b"))
    needed = materialize(members.select(F.col("a").alias("doc_id")).unionByName(members.select(F.col("b").alias("doc_id"))).distinct())
    count = needed.count()
    with small_batches(spark):
        few = count <= BROADCAST_IDS
        sets = materialize(multisets(source.join(F.broadcast(needed), "doc_id", "left_semi")) if few else multisets_of(source, needed, count))
    links = materialize(verify(members.filter(compatible("n_a", "n_b")), sets))
    first = components(links)
    more = materialize(links_between_classes(members, first, reps, sets))
    labels = first if more.isEmpty() else components(more.unionByName(first.select(F.col("node").alias("a"), F.col("label").alias("b"))))
    labels = labels.withColumnRenamed("node", "rep")
    classes = groups.join(labels, "rep", "left").select("m1", "m2", "copies", F.coalesce("label", "rep").alias("class_id"))
    size = classes.groupBy("class_id").agg(F.sum("copies").alias("class_size"))
    classes = materialize(classes.join(size, "class_id"))
    out = join_hot(signed.select("doc_id", "m1", "m2", "n_shingles"), classes, ["m1", "m2"], "copies", signed.count(), "left")
    own = (F.col("n_shingles") == 0) | F.col("class_id").isNull() | F.col("doc_id").isNull()
    class_id = F.when(own, F.col("doc_id")).otherwise(F.col("class_id"))
    return out.select(
        "doc_id", class_id.alias("class_id"), F.when(own, F.lit(1)).otherwise(F.col("class_size")).cast("long").alias("class_size"),
        "n_shingles", F.col("doc_id").eqNullSafe(class_id).alias("kept"),
    )
