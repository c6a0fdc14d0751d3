"""Plain versions of the training-data operators, for small tables."""

import hashlib
import math
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np

SPACE = "[\x20\x09-\x0d]"


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def suffix_dedup(docs, length=50):
    """{id: (n_bytes, n_removed, n_spans, kept)} of (id, text) with unique ids."""
    first = {}
    raw = sorted((i, (t or "").encode()) for i, t in docs)
    for i, b in raw:
        for p in range(len(b) - length + 1):
            first.setdefault(b[p : p + length], i)
    out = {}
    for i, b in raw:
        m = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < i:
                m[p : p + length] = b"\1" * length
        out[i] = (len(b), sum(m), sum(1 for q in range(len(m)) if m[q] and (q == 0 or not m[q - 1])), bytes(x for x, y in zip(b, m, strict=True) if not y))
    return out


def multiset(text):
    w = [x for x in re.split(f"{SPACE}+", (text or "").lower()) if x]
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def near_classes(docs):
    """{id: class id} of (id, text) with unique ids: what pairs of weighted Jaccard similarity 0.8 or more connect."""
    sets = {i: multiset(t) for i, t in docs}
    holders = defaultdict(list)
    for i, s in sets.items():
        for x, n in s.items():
            holders[x].append((i, n))
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sorted(sets):
        overlap = Counter()
        for x, n in sets[a].items():
            for b, m in holders[x]:
                if b > a:
                    overlap[b] += min(n, m)
        for b, inter in overlap.items():
            if 5 * inter >= 4 * (sets[a].total() + sets[b].total() - inter):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def line_dedup(docs, min_chars=20, min_docs=3):
    """{id: kept text} of (id, text) with unique ids."""
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\v\f\r"))
    holders = defaultdict(set)
    for i, t in docs:
        for x in (t or "").split("\n"):
            if len(key(x)) >= min_chars:
                holders[key(x)].add(i)
    return {i: "\n".join(x for x in (t or "").split("\n") if len(h := holders.get(key(x), ())) < min_docs or max(h) == i) for i, t in docs}


SLOTS = 1 << 15


def ngram_slots(text):
    """Slots of the 2-grams and of the 3-grams of ' text '."""
    low = text.lower() if len(text.lower()) == len(text) else text
    c = [ord(x) for x in f" {low} "]
    mask = 0xFFFFFFFF
    scramble = lambda x: ((x ^ x >> 15) * 0x2C1B3C6D & mask) >> 17
    pair = [(a * 0x9E3779B1 + b * 0x85EBCA77) & mask for a, b in zip(c, c[1:], strict=False)]
    return [scramble(a) for a in pair], [scramble((a * 0xC2B2AE3D + b * 0x27D4EB2F) & mask) for a, b in zip(pair, c[2:], strict=False)]


def language_id(docs):
    """{id: (held_out, language, score)} of (id, text, lang): multinomial naive Bayes in plain loops."""
    held = {i: zlib.crc32(str(i).encode()) % 5 == 0 for i, _, _ in docs}
    count, n = defaultdict(lambda: (Counter(), Counter())), Counter()
    for i, t, lang in docs:
        if not held[i] and t is not None and lang is not None:
            n[lang] += 1
            for c, s in zip(count[lang], ngram_slots(t), strict=True):
                c.update(s)
    totals = {lang: [c.total() + 0.5 * SLOTS for c in cs] for lang, cs in count.items()}
    out = {}
    for i, t, _ in docs:
        if t is None or not any(unicodedata.category(c)[0] == "L" for c in t) or not n:
            out[i] = held[i], "und", 0.0
            continue
        grams = [Counter(s) for s in ngram_slots(t)]
        log = {
            lang: math.log(n[lang] / n.total()) + sum(k * math.log((count[lang][j][s] + 0.5) / totals[lang][j]) for j in (0, 1) for s, k in grams[j].items())
            for lang in sorted(n)
        }
        best = max(log, key=lambda x: (round(log[x], 6), [-ord(c) for c in x]))
        out[i] = held[i], best, float(1 / np.exp([x - max(log.values()) for x in log.values()]).sum())
    return out


def word_counts(docs, least=7):
    """Words of the texts of (id, text), with the letter that a slip takes, that occur twice at least."""
    n = Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(x.lower() if x.isascii() else x for x in run)
            if i is not None and (h := zlib.crc32(f"{i}:{w}".encode())) % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    return {w: k for w, k in n.items() if len(w) >= least and k >= 2}


def spelling(n):
    """{word: (form, root, n, near words, n of the form)}; near words share what is left without one letter."""
    holes = defaultdict(set)
    for w in n:
        for p in range(len(w)):
            holes[w[:p] + w[p + 1 :], p].add(w)
    near = defaultdict(set)
    for (rest, _), ws in holes.items():
        for w in ws:
            near[w] |= ws - {w}
            if rest in n and rest != w:
                near[w].add(rest)
                near[rest].add(w)
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return {w: (form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}
