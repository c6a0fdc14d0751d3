"""Toxicity by a weighted finite-state grammar of clauses.

Words become symbols: insult, hint (a learned stem), threat, target (who is spoken to or of), negation, reporting verb, quotation mark, clause
end, line end, other. Transducers for negation, reported speech and targets mark each symbol; a last one finds clauses
and puts out one event for each: an insult, hint or threat, aimed at a target or not, plain, negated or reported. Their
composition is one table of states, through which a text goes in one pass. A text's score is logistic in the events.

Two things are learned, from a bounded sample of labelled rows, of which near copies count once. First the insult words: stems and words that far more
toxic than other texts hold, a stem at least twice, beyond chance for the number of candidates. Then the weights of the events, by logistic
regression around stated prior weights, so that a few labels do not unlearn them.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Callable, Hashable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices, trim_memory
from .language_id import held_out

#: Labelled rows that are learned from: if there are more, about so many, drawn by a hash of the id.
MAX_LABELS = 1 << 18
#: Candidate stems and words: the most frequent in toxic texts, where there are more.
MAX_TERMS = 1 << 16
#: Letters of a stem; toxic texts that must hold a term; their least share among the texts that do; odds of a chance find.
STEM, LEAST_TEXTS, LEAST_SHARE, CHANCE = (3, 8), 3, 0.7, 0.1
#: Words after which a negation or a target no longer counts, and which an insult or threat waits for a target.
NEGATED, TARGETED, WAIT = 3, 4, 4
#: Code points of a text, or a few more, that are taken at a time; words whose symbols a task remembers.
PIECE, MEMO = 1 << 20, 1 << 17

OTHER, INSULT, HINT, THREAT, TARGET, NEGATION, REPORT, QUOTE, BREAK, LINE = range(10)
KINDS = (INSULT, HINT, THREAT)
PLAIN, DENIED, REPORTED = range(3)
#: Events: kind, whether aimed, mode.
EVENTS = [(kind, aimed, mode) for kind in KINDS for aimed in (False, True) for mode in (PLAIN, DENIED, REPORTED)]
#: Prior weights of the events, in that order, and of a text without any; how firm the two are.
PRIOR, BIAS, FIRM = (2.0, 0.2, 0.6, 2.6, 0.3, 0.8, 1.0, 0.1, 0.3, 1.3, 0.2, 0.4, 0.4, 0.1, 0.2, 2.6, 0.4, 1.0), -2.5, (1.0, 0.02)

#: Words to begin with: short, and the same for every corpus.
WORDS: dict[int, str] = {
    INSULT: """idiot idiots moron morons imbecile stupid dumb fool loser losers scum trash pathetic worthless disgusting clown jerk bastard bitch asshole
        dummkopf trottel arschloch blödmann versager abschaum widerlich idiota imbécil estúpido estúpida tonto basura asqueroso cabrón
        imbécile stupide connard connasse salaud ordure minable crétin abruti""",
    THREAT: "kill murder hurt destroy burn töten umbringen vernichten tuer tuerai frapper matar mataré golpear",
    TARGET: "you your you're yours ya u du dich dein deine ihr euch tu te toi ton vous votre tú ti vosotros usted ustedes he she they him her them",
    NEGATION: "not no never without isn't aren't wasn't don't doesn't didn't won't can't cannot ain't nicht kein keine keinen nie niemals ne pas jamais nunca jamás sin",
    REPORT: "said says say told called calls wrote claimed according quoted sagte sagt nannte schrieb laut dit disait appelle appelait selon écrit dijo dice llamó escribió según",
}

_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|[.!?;\n]|[\"“”„«»]")
_SIGNS = dict.fromkeys(".!?;", BREAK) | {"\n": LINE} | dict.fromkeys('"“”„«»', QUOTE)


class Transducer:
    """A sequential transducer: step(state, symbol) gives the next state and what is put out."""

    def __init__(self, start: Hashable, step: Callable[[Hashable, Hashable], tuple[Hashable, Hashable]]):
        self.start, self.step = start, step

    def then(self, other: Transducer) -> Transducer:
        """The composition: the other one reads what this one puts out."""

        def step(state, symbol):
            a, middle = self.step(state[0], symbol)
            b, out = other.step(state[1], middle)
            return (a, b), out

        return Transducer((self.start, other.start), step)

    def table(self, alphabet: Iterable[Hashable]) -> tuple[list[list[int]], list[list[Hashable]]]:
        """Next states and outputs, by number of state and symbol, of all states that can be reached."""
        number, queue, following, out = {self.start: 0}, [self.start], [], []
        for state in queue:
            steps = [self.step(state, x) for x in alphabet]
            for after, _ in steps:
                if after not in number:
                    number[after] = len(queue)
                    queue.append(after)
            following.append([number[after] for after, _ in steps])
            out.append([o for _, o in steps])
        return following, out


def _window(kind: int, width: int) -> Transducer:
    """Marks each symbol that stands within so many words after one of the kind, in the same clause."""

    def step(left, x):
        after = 0 if x[0] in (BREAK, LINE) else width if x[0] == kind else max(0, left - 1)
        return after, (*x, left > 0)

    return Transducer(0, step)


def _reported() -> Transducer:
    """Marks what follows a reporting verb in its sentence, and what stands in quotation marks in its line."""

    def step(state, x):
        said, quoted = state
        if x[0] == LINE:
            after = (False, False)
        elif x[0] == BREAK:
            after = (said and quoted, quoted)
        elif x[0] == QUOTE:
            after = (said, not quoted)
        else:
            after = (said or x[0] == REPORT, quoted)
        return after, (*x, said or quoted)

    return Transducer((False, False), step)


def _clauses() -> Transducer:
    """Of symbols marked (symbol, negated, reported, near a target): the events of clauses that end here."""

    def step(waits, x):
        symbol, negated, reported, near = x
        out = []
        if waits:
            kind, mode, left = waits
            if symbol == TARGET or symbol in (*KINDS, BREAK, LINE) or not left:
                out.append((kind, symbol == TARGET, mode))
                waits = None
            else:
                waits = (kind, mode, left - 1)
        if symbol in KINDS:
            mode = DENIED if negated else REPORTED if reported else PLAIN
            if near:
                out.append((symbol, True, mode))
            else:
                waits = (symbol, mode, WAIT)
        return waits, tuple(EVENTS.index(e) for e in out)

    return Transducer(None, step)


def grammar() -> Transducer:
    start = Transducer(None, lambda s, x: (s, (x,)))
    return start.then(_window(NEGATION, NEGATED)).then(_reported()).then(_window(TARGET, TARGETED)).then(_clauses())


def tokens(text: str) -> Iterator[list[str]]:
    """Words and signs of the lower-cased text, a piece at a time; a piece ends at white space."""
    at, space = 0, re.compile(r"\s")
    while at < len(text):
        cut = space.search(text, at + PIECE)
        end = cut.end() if cut else len(text)
        yield _TOKEN.findall(text[at:end].lower())
        at = end


class Scorer:
    """The grammar with its insult words and weights; counts and scores texts."""

    def __init__(self, learned: Iterable[str] = (), weights: np.ndarray | None = None):
        """learned: stems, which are hints, and whole words, which begin with '=' and are insults."""
        self.words = {w: kind for kind, words in WORDS.items() for w in words.split()} | {t[1:]: INSULT for t in learned if t[0] == "="}
        self.stems = {t for t in learned if t[0] != "="}
        self.weights = np.array([BIAS, *PRIOR]) if weights is None else weights
        self.next, self.out = grammar().table(range(10))

    def symbol(self, token: str) -> int:
        if token in _SIGNS:
            return _SIGNS[token]
        if (kind := self.words.get(token)) is not None:
            return kind
        if any(token[:k] in self.stems for k in range(STEM[0], min(STEM[1], len(token) - 1) + 1)):
            return HINT
        if len(token) > 2 and token[1] in "'’":  # n'es, t'es
            return {"n": NEGATION, "t": TARGET}.get(token[0], OTHER)
        return OTHER

    def counts(self, texts: list[str | None]) -> np.ndarray:
        """(texts, events): how many clauses of each kind there are."""
        out = np.zeros((len(texts), len(EVENTS)), np.int64)
        memo: dict[str, int] = {}
        for i, text in enumerate(texts):
            state = 0
            for piece in tokens(text or ""):
                symbols = [memo[t] if t in memo else memo.setdefault(t, self.symbol(t)) for t in piece]
                if len(memo) > MEMO:
                    memo.clear()
                if state == 0 and len(text) <= PIECE and not any(k in symbols for k in KINDS):  # nothing that is left open matters
                    continue
                for x in symbols:
                    for e in self.out[state][x]:
                        out[i, e] += 1
                    state = self.next[state][x]
            for e in self.out[state][LINE]:
                out[i, e] += 1
        return out

    def score(self, counts: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + np.log1p(counts) @ self.weights[1:], -500, 500)))


def _terms(text: str) -> set[str]:
    """Words of a text, and stems that it uses twice."""
    words = Counter(t for piece in tokens(text) for t in piece if len(t) >= STEM[0])
    stems: dict[str, int] = {}
    for w, n in words.items():
        for k in range(STEM[0], min(STEM[1], len(w) - 1) + 1):
            stems[w[:k]] = stems.get(w[:k], 0) + n
    return {s for s, n in stems.items() if n > 1} | {f"={w}" for w in words}


def _count_terms(wanted: Callable[[], set[str] | None]) -> Callable:
    """Counts of texts by term, of all terms or of those wanted, summed in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only, n = wanted(), Counter()
        for batch in slices(batches, 0):
            for text in batch.column(0).to_pylist():
                n.update(_terms(text) if only is None else _terms(text) & only)
        found = list(n.items())
        for at in range(0, len(found), 10_000):
            terms, counts = zip(*found[at : at + 10_000], strict=True)
            yield pa.RecordBatch.from_pydict({"term": pa.array(terms, pa.string()), "n": pa.array(counts, pa.int64())})
        trim_memory()

    return run


def sketches(text: str, n: int = 3) -> list[int]:
    """n least hashes of the text's runs of three words, each by its own hash: near copies have most in common."""
    words = np.fromiter((zlib.crc32(t.encode("utf-8", "surrogatepass")) for piece in tokens(text) for t in piece), np.uint64)
    words = np.pad(words, (0, max(0, 3 - len(words))))
    runs = words[:-2] * np.uint64(0x9E3779B97F4A7C15) + words[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + words[2:] * np.uint64(0x165667B19E3779F9)
    out = []
    for i in range(n):
        x = (runs ^ runs >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9 + 2 * i)
        out.append(int((x ^ x >> np.uint64(32)).min() >> np.uint64(1)))
    return out


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 2):
        found = [sketches(t) for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(x, pa.int64()) for x in zip(*found, strict=True)]], ["id", "toxic", "s0", "s1", "s2"])


def _one_of_copies(rows: DataFrame) -> DataFrame:
    """(id) of rows (id, toxic, text) that stand for their near copies: of rows with a sketch in common the least id,
    for each of three sketches in turn, so that large groups of copies leave a few rows."""
    row = rows.select("id", "toxic", "text").mapInArrow(_sketched, rows.select("id", "toxic", *[F.lit(0).cast("long").alias(f"s{i}") for i in range(3)]).schema)
    for i in range(3):
        row = row.groupBy("toxic", f"s{i}").agg(F.min(F.struct(F.col("id"), *[F.col(f"s{j}") for j in range(3) if j != i])).alias("x")).select("toxic", f"s{i}", "x.*")
    return row.select("id")


def _above(term: str) -> str:
    """The term that this one makes more specific, or ''."""
    if term[0] == "=":
        return term[1 : 1 + min(STEM[1], len(term) - 2)] if len(term) - 1 > STEM[0] else ""
    return term[:-1] if len(term) > STEM[0] else ""


def _tail(t: int, n: int, share: float) -> float:
    """Probability that t of n or more texts are toxic by chance."""
    if share <= 0 or share >= 1:
        return float(share >= 1)
    log = lambda k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(share) + (n - k) * math.log1p(-share)
    return min(1.0, sum(math.exp(log(k)) for k in range(t, n + 1)))


def choose_terms(found: list[tuple[str, int, int]], toxic: int, clean: int) -> list[str]:
    """The terms of (term, toxic texts, clean texts) to take as insults: pure and beyond chance.

    CHANCE is dealt out evenly over the lengths of stems and the words, and there over the candidates. A stem gives way
    to a longer one that has nearly all its texts, or to those below it if over one in twenty of its texts is clean. What a chosen stem covers is not taken beside it.
    """
    n = {t: (a, b) for t, a, b in found}
    level = lambda t: 0 if t[0] == "=" else len(t)
    tests = Counter(map(level, n))
    share = toxic / max(1, toxic + clean)
    kept = {t for t, (a, b) in n.items() if a >= LEAST_TEXTS and a >= LEAST_SHARE * (a + b) and _tail(a, a + b, share) * tests[level(t)] * len(tests) <= CHANCE}
    below = defaultdict(list)
    for t in sorted(kept):
        below[_above(t)].append(t)
    out, stack = [], [t for t in sorted(kept) if _above(t) not in kept]
    while stack:
        t = stack.pop()
        a, b = n[t]
        kids = below[t] if t[0] != "=" else []
        if kids and (20 * b > a + b or any(n[k][0] >= 0.9 * a for k in kids)):
            stack += kids
        else:
            out.append(t)
    stems = {t for t in out if t[0] != "="}
    return sorted(t for t in out if not any(t.lstrip("=")[:k] in stems - {t} for k in range(STEM[0], STEM[1] + 1)))


def fit_weights(counts: np.ndarray, toxic: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Logistic regression on log1p of the counts by Newton's method, with a normal prior around the stated weights."""
    x = np.concatenate([np.ones((len(counts), 1)), np.log1p(counts)], axis=1) if len(counts) else np.zeros((0, 1 + len(EVENTS)))
    prior = np.array([BIAS, *PRIOR])
    firm = np.array([FIRM[1], *[FIRM[0]] * len(PRIOR)])
    loss = lambda w: float((times * (np.logaddexp(0, x @ w) - toxic * (x @ w))).sum() + (firm * (w - prior) ** 2).sum() / 2)
    w = prior.copy()
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        slope = x.T @ (times * (p - toxic)) + firm * (w - prior)
        step = np.linalg.solve((x * (times * p * (1 - p))[:, None]).T @ x + np.diag(firm), slope)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if abs(step).max() < 1e-10:
            break
    return w


def _event_counts(scorer: Callable[[], Scorer], at: int) -> Callable:
    """Adds the array n of event counts to rows whose column ``at`` is the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = scorer()
        for batch in slices(batches, at):
            n = own.counts(batch.column(at).to_pylist())
            rest = [i for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in rest], pa.array(n.tolist(), pa.list_(pa.int64()))], [*[batch.schema.names[i] for i in rest], "n"])
        trim_memory()

    return run


def train_toxicity(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Scorer:
    """Learn from the labelled rows that are not held out.

    A document with several labels counts as toxic if one is not 0; null labels and texts do not count. The labels are
    at most about MAX_LABELS rows and are broadcast; the driver gets as many candidate terms as MAX_TERMS and a row for
    each different vector of event counts among those texts. Without labels the prior weights and first words stand.
    """
    spark = documents.sparkSession
    given = labels.filter(F.col(label_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("id")).agg(F.max((F.col(label_col) != 0).cast("int")).alias("toxic"))
    total = given.count()
    if total > MAX_LABELS:
        given = given.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 40)) < F.lit((MAX_LABELS << 40) // total))
    texts = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(F.col("text").isNotNull()).join(F.broadcast(given), "id")
    texts = texts.join(F.broadcast(materialize(_one_of_copies(texts))), "id", "left_semi").select("text", "toxic")
    size = {r.toxic: r.n for r in texts.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    in_toxic = texts.filter("toxic = 1").select("text").mapInArrow(_count_terms(lambda: None), "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    held = in_toxic.filter(F.col("n") >= LEAST_TEXTS).orderBy(F.desc("n"), "term").limit(MAX_TERMS).collect()
    wanted = spark.sparkContext.broadcast({r.term for r in held})
    in_clean = texts.filter("toxic = 0").select("text").mapInArrow(_count_terms(lambda: wanted.value), "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    clean = {r.term: r.n for r in in_clean.collect()}
    learned = choose_terms([(r.term, r.n, clean.get(r.term, 0)) for r in held], size.get(1, 0), size.get(0, 0))
    scorer = Scorer(learned)
    sent = spark.sparkContext.broadcast(scorer)
    rows = texts.mapInArrow(_event_counts(lambda: sent.value, 0), "toxic int, n array<long>").groupBy("toxic", "n").agg(F.count("*").alias("times")).collect()
    rows.sort(key=lambda r: (r.toxic, r.n))
    n = np.array([r.n for r in rows]).reshape(len(rows), len(EVENTS))
    return Scorer(learned, fit_weights(n, np.array([r.toxic for r in rows], float), np.array([r.times for r in rows], float)))


def toxicity(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(doc_id, held_out, score double 0 to 1, predicted int) of each document, by its text alone.

    A null or empty text has no clause, and so the score of such texts. Rows that share an id are scored each by its
    own text. held_out: crc32 of the id as text is a multiple of 5, or the id is null; such rows are not learned from.
    """
    model = train_toxicity(documents, labels, id_col, text_col, label_col)
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in slices(batches, 1):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own.score(own.counts(batch.column(1).to_pylist())))], ["doc_id", "score"])
        trim_memory()

    rows = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(run, rows.select("doc_id", F.lit(0.0).alias("score")).schema)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
