"""Grouping of spelling variants: words one edit apart, found in a trie of letter-group counts.

A word's vector counts its letters by group (code point modulo GROUPS). One edit changes it by a surplus of one letter at
most and a deficit of one at most. The trie arranges words by successive counts; a depth-first search goes down with a
budget of one surplus and one deficit, and the words of the leaves that it reaches are verified.

Spark deals the words out so that no trie is large: one edit leaves one half of the shorter word whole, so words meet by
(length, side, whole half), the first level of every trie. Where many words share a half, the rest of the word is
halved again for that group alone, until its groups are small, so that no task takes more than about GROUP words.
Each pair has one group of its own by the place of its edit, and is counted there only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, join_hot, materialize, release, trim_memory, without_hot

#: Letter groups, and so levels of the trie.
GROUPS = 12
#: Rows that one task takes at a time, and rows of one key from which on the key is split.
GROUP = 1 << 17
#: Candidates, and code points of them, that are verified at a time.
PAIRS, CODES = 1 << 18, 1 << 22

_RUN = r"[A-Za-zÀ-ÿ]"
_NEAR = "word string, near long, best struct<minus:bigint,word:string>"


def word_counts(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 7, min_count: int = 2, slip: int = 31) -> DataFrame:
    """(word, n): how often each word occurs in all texts, if it has min_chars code points and occurs min_count times.

    A word is a maximal run of Latin letters with A-Z lower-cased; one occurrence in ``slip``, by crc32 of
    ``<id>:<word>``, has lost the letter that the same number picks. A null text has no words; where the id is null
    nothing is lost.
    """
    runs = documents.select(F.col(id_col).alias("i"), F.explode(F.regexp_extract_all(F.col(text_col), F.lit(f"{_RUN}{{{min_chars},}}"), F.lit(0))).alias("w"))
    low = F.translate("w", UPPER, LOWER)
    h = F.crc32(F.concat(F.col("i").cast("string"), F.lit(":"), F.col("w")).cast("binary"))
    rows = runs.select("i", low.alias("w")).select("w", h.alias("h")).select("w", "h", (F.col("h") % F.length("w")).cast("int").alias("at"))
    word = F.when(F.col("h") % slip == 0, F.expr("concat(substring(w, 1, at), substring(w, at + 2))")).otherwise(F.col("w"))
    return rows.select(word.alias("word")).filter(F.length("word") >= min_chars).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count)


def _halves(first: bool) -> Column:
    """The groups of a row's word, by the part that is whole, of the window [lo, hi) of the m code points of the shorter.

    If the common prefix of a pair ends in the window's first half, at ``top`` at the latest, the last half is whole.
    """
    word, m, lo, hi, top, key = map(F.col, ("word", "m", "lo", "hi", "top", "key"))
    h = F.floor((hi - lo) / 2).cast("int")
    longer = F.length(word) - m  # 0 or 1
    left = F.substring(word, lo + 1, h)
    right = F.substring(word, hi - h + longer + 1, h)
    seed = [m] if first else [key]
    return F.array(
        F.struct(F.xxhash64(*seed, F.lit("left"), left).alias("key"), m.alias("m"), (lo + h).alias("lo"), hi.alias("hi"), top.alias("top")),
        F.struct(F.xxhash64(*seed, F.lit("right"), right).alias("key"), m.alias("m"), lo.alias("lo"), (hi - h).alias("hi"), (lo + h).alias("top")),
    )


def _split(rows: DataFrame, first: bool = False) -> DataFrame:
    return rows.select("word", "n", F.explode(_halves(first)).alias("g")).select("word", "n", "g.*")


class Trie:
    """Rows under (key, counts of each letter group); a node is its number among the nodes of its level."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.span = int(counts.max(initial=0)) + 2
        roots, node = np.unique(keys, return_inverse=True)
        self.levels, paths = [], [node]
        for g in range(counts.shape[1]):
            below, node = np.unique(node * self.span + counts[:, g], return_inverse=True)
            self.levels.append(below)
            paths.append(node)
        order = np.argsort(node, kind="stable")
        self.rows, self.starts = order, np.searchsorted(node[order], np.arange(len(self.levels[-1]) + 1))
        first = order[self.starts[:-1]]
        self.root, self.counts = paths[0][first], counts[first]  # of each leaf

    def _child(self, level: int, node: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        want = node * self.span + count
        at = np.searchsorted(self.levels[level], want)
        at[at == len(self.levels[level])] = 0
        there = np.flatnonzero((self.levels[level][at] == want) & (count >= 0))
        return there, at[there]

    def search(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of leaves (a, b) where b has a's counts, or a surplus of one, or first that and then a deficit of one."""
        depth = self.counts.shape[1]
        stack = [(0, np.arange(len(self.root)), self.root, 0)]  # level, leaves that search, their nodes, steps spent
        while stack:
            level, leaf, node, spent = stack.pop()
            if level == depth:
                yield leaf, node
                continue
            own = self.counts[leaf, level]
            moves = ((0, spent), (1, 1)) if spent == 0 else ((0, spent), (-1, 2)) if spent == 1 else ((0, spent),)
            for step, after in moves:
                there, child = self._child(level, node, own + step)
                if len(there):
                    stack.append((level + 1, leaf[there], child, after))


def _expand(trie: Trie, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of the pairs of leaves, PAIRS at a time if one pair of leaves has no more."""
    na, nb = np.diff(trie.starts)[a], np.diff(trie.starts)[b]
    total = np.cumsum(na * nb)
    at = 0
    while at < len(a):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, "right")))
        n = (na * nb)[at:end]
        which = np.repeat(np.arange(at, end), n)
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        yield trie.rows[trie.starts[a[which]] + k // nb[which]], trie.rows[trie.starts[b[which]] + k % nb[which]]
        at = end


def _prefix(code: np.ndarray, start: np.ndarray, length: np.ndarray, a: np.ndarray, b: np.ndarray, back: bool = False) -> np.ndarray:
    """Length of the common prefix (or suffix) of the words a and b, for a no longer than b."""
    out = np.empty(len(a), np.int64)
    size = length[a]
    order = np.argsort(size, kind="stable")
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and end - at < max(1, CODES // max(1, int(size[order[min(end * 2 - at, len(order) - 1)]]))):
            end = min(len(order), end * 2 - at)
        own = order[at:end]
        i, width = np.arange(size[own[-1]]), size[own, None]
        inside = i[None, :] < width
        if back:
            x, y = (start + length)[a[own], None] - 1 - i, (start + length)[b[own], None] - 1 - i
        else:
            x, y = start[a[own], None] + i, start[b[own], None] + i
        last = len(code) - 1
        same = (code[np.clip(x, 0, last)] == code[np.clip(y, 0, last)]) & inside
        out[own] = np.where(same.all(1), width[:, 0], same.argmin(1))
        at = end
    return out


def near_words(table: pa.Table) -> pa.Table:
    """For each word of some groups, how many near words the groups show and which is the most frequent."""
    none = pa.table({"word": pa.array([], pa.string()), "near": pa.array([], pa.int64()), "best": pa.array([], pa.struct([("minus", pa.int64()), ("word", pa.string())]))})
    words = table["word"].to_pylist()
    if len(words) < 2:
        return none
    key, m, lo, top, n = (table[x].to_numpy() for x in ("key", "m", "lo", "top", "n"))
    length = np.fromiter(map(len, words), np.int64, len(words))
    start = np.cumsum(length) - length
    code = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    counts = np.bincount(np.repeat(np.arange(len(words)), length) * GROUPS + code % GROUPS, minlength=len(words) * GROUPS).reshape(-1, GROUPS)
    trie = Trie(key, counts)
    found = []
    for x, y in trie.search():
        for a, b in _expand(trie, x, y):
            same = length[a] == length[b]
            good = (length[a] == m[a]) & (key[a] == key[b]) & (m[a] == m[b]) & (lo[a] == lo[b]) & np.where(same, (length[b] == m[a]) & (a != b), length[b] == m[a] + 1)
            a, b = a[good], b[good]
            if not len(a):
                continue
            front = _prefix(code, start, length, a, b)
            near = (front >= lo[a]) & (front < top[a])
            a, b, front = a[near], b[near], front[near]
            if not len(a):
                continue
            left = length[b] - 1 - front  # after the edit; the words of one vector come in both orders
            back = _prefix(code, start, length, a, b, back=True)
            near = (front < length[b]) & (back >= left)
            if near.any():
                found.append(np.sort(np.stack([a[near], b[near]]), axis=0))
    if not found:
        return none
    pairs = np.unique(np.concatenate(found, axis=1), axis=1)
    one, other = np.concatenate([pairs[0], pairs[1]]), np.concatenate([pairs[1], pairs[0]])
    rank = np.empty(len(words), np.int64)  # code-point order
    rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    order = np.lexsort((rank[other], -n[other], one))
    one, other = one[order], other[order]
    first = np.flatnonzero(np.concatenate([[True], one[1:] != one[:-1]]))
    best = pa.StructArray.from_arrays([pa.array(-n[other[first]]), pa.array([words[i] for i in other[first]], pa.string())], ["minus", "word"])
    out = pa.table({"word": pa.array([words[i] for i in one[first]], pa.string()), "near": np.diff(np.append(first, len(one))), "best": best})
    trim_memory()
    return out


def near_counts(words: DataFrame) -> DataFrame:
    """(word, n_near long, best struct<minus, word>) of each word that has near words among (word, n), unique by word.

    Near words differ by exactly one inserted, deleted or replaced code point; best is the one of largest n (minus its
    n, so that the least struct is the best), ties to the smallest.
    """
    spark, held = words.sparkSession, []
    size = F.length("word")
    # as the shorter or equal word of a pair, and as the longer
    pair = words.filter(size > 0).select("word", "n", F.explode(F.array(size, size - 1)).alias("m"))
    rows = pair.select("word", "n", F.lit(0).cast("long").alias("key"), "m", F.lit(0).alias("lo"), F.col("m").alias("hi"), (F.col("m") + 1).alias("top"))
    rows = materialize(_split(rows, first=True), held)
    parts = []
    while True:
        total = rows.count()
        sizes = rows.groupBy("key").agg(F.count("*").alias("size"), F.max(F.col("hi") - F.col("lo")).alias("open"))
        large = sizes.filter((F.col("size") > GROUP) & (F.col("open") > 2))
        hot = materialize(large, held)
        if hot.isEmpty():
            parts.append((rows, total))
            break
        parts.append((without_hot(rows, hot, ["key"], "size", total), total))
        rows = materialize(_split(join_hot(rows, hot, ["key"], "size", total).select(*rows.columns)), held)
    found = None
    for part, total in parts:
        bucket = F.pmod("key", F.lit(-(-2 * total // GROUP) + 1))
        near = part.groupBy(bucket.alias("bucket")).applyInArrow(near_words, _NEAR)
        found = near if found is None else found.unionByName(near)
    out = materialize(found.groupBy("word").agg(F.sum("near").alias("n_near"), F.min("best").alias("best")))
    release(spark, held)
    return out


def spelling_variants(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 10, **words) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of ``word_counts``.

    A word's form is its most frequent near word, if that is ``least`` times as frequent as the word at least; its root
    is the last form that forms lead to. Each form has ``least`` times the occurrences of the one before, so paths are
    short, and they are followed by doubling. No words, no rows; other columns are not read.
    """
    spark, held = documents.sparkSession, []
    counted = materialize(word_counts(documents, id_col, text_col, **words))
    rows = counted.join(near_counts(counted), "word", "left")
    has = -F.col("best.minus") >= least * F.col("n")
    rows = materialize(rows.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(has, F.col("best.word")).alias("form"), F.when(has, -F.col("best.minus")).alias("form_n")))
    links = materialize(rows.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), held)
    while True:
        above = links.select(F.col("word").alias("root"), F.col("root").alias("top"))
        nearer = materialize(links.join(above, "root", "left").select("word", F.coalesce("top", "root").alias("root"), F.col("top").isNotNull().alias("moved")), held)
        links = nearer.select("word", "root")
        if nearer.filter("moved").isEmpty():
            break
    links = materialize(links)
    release(spark, held)
    return rows.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
