"""Toxicity by a weighted finite-state pattern grammar over clauses.

Acceptors turn words into classes: insult, threat, target, negation, report and intent. Insult acceptors (whole
words, and stems with any ending) and their weights are learned from labels, as are words that are insulting
only where someone is addressed; the function words are fixed. Transducers, given as tables of moves, each follow
one thing through a clause: whether someone is addressed (before or behind), whether a negation still reaches,
whether speech is reported, whether something is intended. Their composition is one machine that reads a clause
from left to right and one that reads it from right to left; at each insult or threat the two states name a
pattern, whose matches are weighed. A document's score comes from its matched clauses, never from single words.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, Texts, hashed, mix, spans, spread, texts, written
from .sampling import sample_per_label, sampled_texts

#: Labelled documents of each label that the lexicon and weights are learned on at most.
SAMPLE = 3000
STEMS = (4, 5, 6, 7, 8)
#: Toxic documents, copies of each other counted once, that must hold an acceptor before it counts, and how many
#: times more often it must stand in toxic text than in clean text.
LEAST_DOCS, LEAST_RATIO = 3, 8.0
MOST_WEIGHT, MOST_FOUND, COVERED = 8.0, 24.0, 9.0
#: Weight of the fixed threats, as of a learned acceptor.
THREAT_WEIGHT = 6.0
#: A clause ends at punctuation, and after so many words without any.
CLAUSE_WORDS = 64

# Function words of the grammar's classes.
THREAT = "kill hurt destroy beat shoot stab burn hang punch töten umbringen schlagen tuer frapper matar golpear".split()
TARGET = "you your yours yourself u he she they them him her his du dich dir dein ihr euch sie tu toi vous votre tú usted ustedes vosotros ella ellos".split()
NEGATION = "not never nor cannot don't isn't aren't wasn't won't nicht kein keine niemals jamais aucun pas nunca jamás tampoco".split()
REPORTED = "said says say claimed claims reported wrote quoted called calls sagte sagt schrieb nannte dit écrit appelle dijo dice escribió llamó".split()
INTENT = "will i'll we'll shall gonna going must should deserve deserves werde werden wird vais va voy vamos".split()

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_LETTER[ord("'")] = True
_BREAK = np.zeros(256, bool)
_BREAK[list(b".,;:!?\n\r|()\"")] = True

#: Word classes.
OTHER, INSULT, THREATS, TARGETS, NEGATIONS, REPORTS, INTENTS = range(7)
CLASSES = 7
#: A negation reaches so many words ahead.
REACH = 3


@dataclass(frozen=True)
class Transducer:
    """Follows one thing through a clause. moves: (state, class) to state; any other word leads where `fades` says, or leaves the state as it is. on: the states in which it holds."""

    start: str
    moves: dict[tuple[str, int], str]
    on: tuple[str, ...]
    fades: dict[str, str] = field(default_factory=dict)

    @property
    def states(self) -> list[str]:
        named = [self.start, *(s for s, _ in self.moves), *self.moves.values(), *self.fades, *self.fades.values()]
        return list(dict.fromkeys(named))

    def step(self, state: str, kind: int) -> str:
        return self.moves.get((state, kind), self.fades.get(state, state))


def seen(kind: int) -> Transducer:
    """Holds from a word of the class on."""
    return Transducer("no", {("no", kind): "yes", ("yes", kind): "yes"}, ("yes",))


_LEFT = [f"{n} left" for n in range(REACH + 1)]
ADDRESSED, REPORTING, INTENDING = seen(TARGETS), seen(REPORTS), seen(INTENTS)
NEGATING = Transducer(_LEFT[0], {(s, NEGATIONS): _LEFT[REACH] for s in _LEFT}, tuple(_LEFT[1:]), dict(zip(_LEFT[1:], _LEFT)))


@dataclass(frozen=True)
class Machine:
    """Transducers composed: moves[state, class]; idle[n, state]: after n words of no class; holds[state]: which of the transducers hold."""

    moves: np.ndarray
    idle: np.ndarray
    holds: np.ndarray


def compose(*parts: Transducer) -> Machine:
    """Their product; state 0 is the start."""
    states = list(product(*([p.start, *(s for s in p.states if s != p.start)] for p in parts)))
    number = {s: n for n, s in enumerate(states)}
    moves = np.array([[number[tuple(p.step(x, kind) for p, x in zip(parts, s))] for kind in range(CLASSES)] for s in states])
    idle = [np.arange(len(states))]
    for _ in range(REACH + 1):
        idle.append(moves[idle[-1], OTHER])
    return Machine(moves, np.array(idle), np.array([[x in p.on for p, x in zip(parts, s)] for s in states]))


FORWARD, BACKWARD = compose(ADDRESSED, NEGATING, REPORTING, INTENDING), compose(ADDRESSED)


def pattern(threat: bool, aimed: bool, negated: bool, reported: bool) -> int:
    """The number of a pattern. Of a threat, which must be aimed at someone, `aimed` says that it is intended."""
    return 8 * threat + 4 * aimed + 2 * negated + reported


PATTERNS = 16
PLAIN, AIMED, NEGATED = pattern(False, False, False, False), pattern(False, True, False, False), pattern(False, False, True, False)
#: Weights of the patterns where labels say nothing.
PRIOR = np.array([1.0 if negated or reported else 3.0 + 2 * aimed if threat else 4.0 + aimed for threat, aimed, negated, reported in product((False, True), repeat=4)])


@lru_cache(1)
def emissions() -> np.ndarray:
    """What a match emits, by class (insult, threat), forward and backward state: its pattern, or -1."""
    out = np.full((2, len(FORWARD.holds), len(BACKWARD.holds)), -1)
    for (f, (before, negated, reported, intended)), (b, (behind,)) in product(enumerate(FORWARD.holds), enumerate(BACKWARD.holds)):
        aimed = before or behind
        out[0, f, b] = pattern(False, aimed, negated, reported)
        if aimed:
            out[1, f, b] = pattern(True, intended, negated, reported)
    return out


def transduce(machine: Machine, kind: np.ndarray, gap: np.ndarray, clause: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The machine's state before each word of a class, in every clause at once: a step takes each clause's next such word. gap: words of no class before it; clause and place number clauses, and the words in one."""
    before, by = np.zeros(len(kind), np.int64), np.argsort(place, kind="stable")
    state = np.zeros(clause.max(initial=-1) + 1, np.int64)
    ends = np.searchsorted(place[by], np.arange(place.max(initial=-1) + 2))
    for a, b in zip(ends[:-1], ends[1:]):
        at = by[a:b]
        now = machine.idle[gap[at], state[clause[at]]]
        before[at] = now
        state[clause[at]] = machine.moves[now, kind[at]]
    return before


def fold_case(data: np.ndarray) -> np.ndarray:
    """Lower case for A-Z and the Latin-1 capitals in UTF-8."""
    low = LOWER[data]
    if len(low) > 1:
        upper = (low[:-1] == 0xC3) & (low[1:] >= 0x80) & (low[1:] <= 0x9E) & (low[1:] != 0x97)
        low[1:][upper] += 0x20
    return low


def tokens(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Folded bytes, starts and ends of the letter runs, and each text's first word."""
    low = fold_case(t.data)
    starts, ends = spans(_LETTER[low], t.offsets)
    return low, starts, ends, np.searchsorted(starts, t.offsets)


def _on_boundary(low: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (low[np.minimum(at, max(len(low) - 1, 0))] & 0xC0) != 0x80


def acceptor_keys(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(words, hashes) of every acceptor that could take them: the word itself, then its stems of each length."""
    everything = np.arange(len(starts))
    yield everything, hashed(low, starts, ends)
    for n in STEMS:
        longer = np.flatnonzero(ends - starts > n)
        longer = longer[_on_boundary(low, starts[longer] + n)]
        yield longer, hashed(low, starts[longer], starts[longer] + n) ^ np.uint64(n * 0x9E3779B97F4A7C15 % 2**64)


def _hashes_of(words: list[str]) -> np.ndarray:
    raw = [w.encode() for w in words]
    ends = np.cumsum([len(r) for r in raw])
    return hashed(np.frombuffer(b"".join(raw), np.uint8), ends - [len(r) for r in raw], ends)


def clauses(low: np.ndarray, starts: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The clause of each word, by number. A text's first word begins one, as does a word behind a break or CLAUSE_WORDS words without any."""
    if not len(starts):
        return np.zeros(0, np.int64)
    breaks = np.cumsum(_BREAK[low])[starts]
    new = np.r_[True, (np.diff(breaks) > 0) | (np.diff(doc) > 0)]
    first = np.flatnonzero(new)
    since = np.arange(len(starts)) - np.repeat(first, np.diff(np.r_[first, len(starts)]))
    return np.cumsum(new | (since % CLAUSE_WORDS == 0)) - 1


_FUNCTION = {TARGETS: TARGET, NEGATIONS: NEGATION, REPORTS: REPORTED, INTENTS: INTENT}


@lru_cache(1)
def _function_words() -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the function words and their classes."""
    h = np.concatenate([_hashes_of(w) for w in _FUNCTION.values()])
    c = np.repeat(list(_FUNCTION), [len(w) for w in _FUNCTION.values()])
    by = np.argsort(h)
    return h[by], c[by]


def _find(sorted_: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether, where) each hash stands in a sorted array."""
    if not len(sorted_):
        return np.zeros(len(h), bool), np.zeros(len(h), np.int64)
    at = np.minimum(np.searchsorted(sorted_, h), len(sorted_) - 1)
    return sorted_[at] == h, at


def surroundings(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every word: its function class or OTHER, which of the forward transducers hold before it, and whether someone is addressed in its clause."""
    hit, k = _find(_function_words()[0], hashed(low, starts, ends))
    kind = np.where(hit, _function_words()[1][k], OTHER)
    clause, at = clauses(low, starts, doc), np.flatnonzero(hit)
    addressed = np.zeros(clause.max(initial=-1) + 1, bool)
    addressed[clause[kind == TARGETS]] = True
    state = np.zeros(len(kind), np.int64)
    if len(at):
        _, begins, c = np.unique(clause[at], return_index=True, return_inverse=True)
        place = np.arange(len(at)) - begins[c]
        gap = np.where(place == 0, 0, np.minimum(np.r_[0, np.diff(at) - 1], REACH + 1))
        after = FORWARD.moves[transduce(FORWARD, kind[at], gap, c, place), kind[at]]
        last = np.searchsorted(at, np.arange(len(kind))) - 1  # the function word before each word
        same = (last >= 0) & (clause[at[last]] == clause)
        state[same] = FORWARD.idle[np.minimum(np.flatnonzero(same) - at[last[same]] - 1, REACH + 1), after[last[same]]]
    return kind, FORWARD.holds[state], addressed[clause]


@dataclass
class Grammar:
    """acceptors: sorted hashes of the learned acceptors; weights: log of how many times more often each stands in toxic text; aimed: of those that count only where someone is addressed, as a threat does.

    theta has a weight for each pattern's matches, then one for the weight that a text of its length gathers
    by chance (chance: that weight per word of clean text).
    """

    acceptors: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    aimed: np.ndarray | None = None
    chance: float = 0.0
    theta: np.ndarray = field(default_factory=lambda: np.r_[PRIOR, -1.0])
    bias: float = -3.0

    def classes(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class of every word and its weight. A function word is no insult; of the acceptors that take a word the heaviest counts."""
        kind, weight = np.full(len(starts), OTHER, np.int8), np.zeros(len(starts))
        for which, (at, h) in enumerate(acceptor_keys(low, starts, ends)):
            if which == 0:
                hit, k = _find(_function_words()[0], h)
                kind[hit] = _function_words()[1][k[hit]]
                threat = np.isin(h, _hashes_of(THREAT))
                kind[threat], weight[threat] = THREATS, THREAT_WEIGHT
            hit, k = _find(self.acceptors, h)
            hit &= (kind[at] <= THREATS) & (self.weights[k] > weight[at]) if len(self.weights) else False
            at, k = at[hit], k[hit]
            kind[at] = INSULT if self.aimed is None else np.where(self.aimed[k], THREATS, INSULT)
            weight[at] = self.weights[k]
        return kind, weight

    def matches(self, t: Texts) -> np.ndarray:
        """For each text: the summed weight of its matches by pattern, and its words."""
        low, starts, ends, first = tokens(t)
        n = np.diff(first)
        out = np.zeros((t.hi - t.lo, PATTERNS + 1))
        out[:, PATTERNS] = n
        kind, weight = self.classes(low, starts, ends)
        doc = np.repeat(np.arange(len(n)), n)
        clause = clauses(low, starts, doc)
        has_head = np.bincount(clause, (kind == INSULT) | (kind == THREATS), clause[-1] + 1 if len(clause) else 0) > 0
        at = np.flatnonzero((kind != OTHER) & has_head[clause])
        if not len(at):
            return out
        _, begins, c, size = np.unique(clause[at], return_index=True, return_inverse=True, return_counts=True)
        place = np.arange(len(at)) - begins[c]
        ahead = np.r_[0, np.diff(at) - 1]
        near = lambda gap, edge: np.where(edge, 0, np.minimum(gap, REACH + 1))
        f = transduce(FORWARD, kind[at], near(ahead, place == 0), c, place)
        last = place == size[c] - 1
        b = transduce(BACKWARD, kind[at], near(np.r_[ahead[1:], 0], last), c, size[c] - 1 - place)
        head = np.flatnonzero((kind[at] == INSULT) | (kind[at] == THREATS))
        emitted = emissions()[(kind[at[head]] == THREATS).astype(int), f[head], b[head]]
        head, emitted = head[emitted >= 0], emitted[emitted >= 0]
        np.add.at(out, (doc[at[head]], emitted), weight[at[head]])
        return out

    def features(self, found: np.ndarray) -> np.ndarray:
        return np.c_[np.minimum(found[:, :PATTERNS], MOST_FOUND), found[:, PATTERNS] * self.chance] / MOST_WEIGHT

    def score(self, found: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.bias + self.features(found) @ self.theta, -30, 30)))


def _cover(docs: dict[int, list[tuple[int, int]]], weight: dict[tuple[int, int], float], left: dict[int, float]) -> list[tuple[int, int]]:
    """Greedy cover of toxic documents by acceptors (hash, size), heaviest total first, so that a word that only rides along with others isn't learned. A document is covered, and goes from left, once its acceptors weigh COVERED."""
    holders: dict[tuple[int, int], set[int]] = {}
    for d, keys in docs.items():
        for key in keys:
            holders.setdefault(key, set()).add(d)
    chosen = []
    queue = [(-len(v) * weight[k], -k[1], k[0]) for k, v in holders.items()]
    heapq.heapify(queue)
    while left and queue:
        least, size, h = heapq.heappop(queue)
        key = (h, -size)
        held = holders[key] & left.keys()
        now = len(held) * weight[key]
        if len(held) < LEAST_DOCS:
            continue
        if now < -least:
            heapq.heappush(queue, (-now, size, h))
        else:
            chosen.append(key)
            for d in held:
                left[d] += weight[key]
                if left[d] >= COVERED:
                    del left[d]
    return chosen


#: The size that stands for whole words, and what is added to the sizes of acceptors that are seen where someone is addressed.
WHOLE, AIMED_SIZE = 99, 1000


def learn(documents: DataFrame, labels: DataFrame, *, label_col: str = "toxic", sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Grammar:
    """Learn insult acceptors and match weights from at most `sample` documents of each label. No labels: the bare grammar.

    Documents of a label that agree in their least hash of three words in a row are copies: together they count
    as one document that holds every acceptor of any of them. Rows without id, text or label teach nothing; an id
    that is repeated counts with each of its texts; other columns are ignored.
    """
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).filter("label in (0, 1)")
    share = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    rows = sampled_texts(documents, sample_per_label(known, "id", "label", sample), id_col, text_col)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, label = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for t in texts(batch):
                low, starts, ends, first = tokens(t)
                n = np.diff(first)
                doc = np.searchsorted(first, np.arange(len(starts)), "right") - 1
                each = list(acceptor_keys(low, starts, ends))
                word = each[0][1]
                left = first[1:][doc] - np.arange(len(word))  # words from here to the text's end
                second, third = (np.where(left > k, np.roll(word, -k), np.uint64(0)) for k in (1, 2))
                triple = mix(word * np.uint64(3) + second * np.uint64(5) + third * np.uint64(7))
                triple[(left < 3) & (n[doc] >= 3)] = np.uint64(2**64 - 1)
                own = np.zeros(len(n), np.uint64)
                if len(word):
                    own[n > 0] = np.minimum.reduceat(triple, first[:-1][n > 0])
                kind, holds, addressed = surroundings(low, starts, ends, doc)
                # a word that is negated or reported vouches for nothing, in toxic or in clean text
                direct = (kind == OTHER) & ~holds[:, 1] & ~holds[:, 2]
                for size, (at, h) in zip((WHOLE, *STEMS), each):
                    for more, some in ((0, direct[at]), (AIMED_SIZE, (direct & addressed)[at])):
                        d, g = doc[at[some]], h[some]
                        if not len(g):
                            continue
                        by = np.lexsort((g, d))
                        d, g = d[by], g[by]
                        new = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (g[1:] != g[:-1])])
                        d, g, times = d[new], g[new], np.diff(np.r_[new, len(d)])
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[d + t.lo], label[d + t.lo].astype(np.int64), g.view(np.int64), np.full(len(d), size + more), times, own[d].view(np.int64), n[d])], ["id", "label", "key", "size", "times", "own", "words"])

    held = rows.mapInArrow(keys, "id long, label long, key long, size long, times long, own long, words long")
    once = written(held.groupBy("label", "own", "key", "size").agg(F.max("times").alias("times")), "acceptors")
    all_words = {r.label: r.n for r in once.filter(F.col("size") == WHOLE).groupBy("label").agg(F.sum("times").alias("n")).collect()}
    toxic_words, clean_words = all_words.get(1, 0) + 1, all_words.get(0, 0) + 1
    ratio = (F.col("toxic") / toxic_words) / ((F.col("clean") + 0.5) / clean_words)
    counts = once.groupBy("key", "size").agg(F.sum("label").alias("docs"), F.sum(F.col("times") * F.col("label")).alias("toxic"), F.sum(F.col("times") * (1 - F.col("label"))).alias("clean"))
    counts = counts.withColumn("ratio", ratio).filter((F.col("docs") >= LEAST_DOCS) & (F.col("ratio") >= LEAST_RATIO))
    listed = once.filter("label = 1").join(counts, ["key", "size"])
    known_of = {(r.key, r.size): (r.ratio, r.clean) for r in counts.collect()}
    docs: list[dict[int, list[tuple[int, int]]]] = [{}, {}]
    for batch in listed.select("own", "key", "size").toArrow().to_batches():
        for own, key, size in zip(*(c.to_pylist() for c in batch.columns)):
            docs[size >= AIMED_SIZE].setdefault(own, []).append((key, size))
    weight = {k: min(np.log(v[0]), MOST_WEIGHT) for k, v in known_of.items()}
    # words that are toxic wherever they stand; then, for documents without any, words that are so where someone is addressed
    left = dict.fromkeys(docs[0].keys() | docs[1].keys(), 0.0)
    picked = _cover(docs[0], weight, left)
    picked += _cover(docs[1], weight, {d: 0.0 for d, w in left.items() if not w})
    chosen = {}
    for k in picked:
        h = int(np.int64(k[0]).view(np.uint64))
        chosen.setdefault(h, (weight[k], known_of[k][1], k[1] >= AIMED_SIZE))
    order = sorted(chosen)
    weights, clean, aimed = (np.array([chosen[h][c] for h in order], t) for c, t in enumerate((float, float, bool)))
    grammar = Grammar(np.array(order, np.uint64), weights, aimed, float(sum(weights * clean) / clean_words))
    shared = documents.sparkSession.sparkContext.broadcast(grammar)

    def emitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in texts(batch):
                found = shared.value.matches(t)
                yield pa.RecordBatch.from_arrays([batch.column(k).slice(t.lo, t.hi - t.lo) for k in (0, 1)] + [pa.array(list(found), pa.list_(pa.float64()))], ["id", "label", "found"])

    seen = sorted((r.id, r.label, r.found) for r in rows.mapInArrow(emitted, "id long, label int, found array<double>").collect())
    if len({r[1] for r in seen}) < 2:
        return grammar
    x, y = grammar.features(np.array([r[2] for r in seen])), np.array([r[1] for r in seen], np.float64)
    got = {k: max(1, int((y == k).sum())) for k in (0, 1)}
    grammar.theta, grammar.bias = _weights(x, y, np.where(y == 1, share.get(1, 0) / got[1], share.get(0, 0) / got[0]), grammar)
    return grammar


def _weights(x: np.ndarray, y: np.ndarray, weight: np.ndarray, start: Grammar, steps: int = 800, rate: float = 0.05) -> tuple[np.ndarray, float]:
    """Logistic weights of the patterns, drawn to the grammar's own where labels say nothing and never against the grammar's sense."""
    prior = np.r_[start.theta, start.bias]
    p, m, v, weight = prior.copy(), 0.0, 0.0, weight / weight.sum()
    x1 = np.c_[x, np.ones(len(x))]
    for step in range(1, steps + 1):
        g = x1.T @ ((1 / (1 + np.exp(-np.clip(x1 @ p, -30, 30))) - y) * weight) + 1e-4 * (p - prior)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        p = p - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        p[:-2] = np.maximum(p[:-2], 0)
        p[-2] = min(p[-2], 0)
    return p[:-1], float(p[-1])


def score(documents: DataFrame, grammar: Grammar, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score and found (summed match weights by pattern) for every row.

    Null, empty and blank texts match nothing and get the score of no match; rows that repeat an id, or have
    none, get a row each; other columns are ignored; an empty table gives no rows.
    """
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    shared = documents.sparkSession.sparkContext.broadcast(grammar)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in texts(batch):
                found = shared.value.matches(t)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(t.lo, t.hi - t.lo), pa.array(shared.value.score(found)), pa.array(list(found), pa.list_(pa.float64()))], ["doc_id", "score", "found"])

    return spread(rows).mapInArrow(run, "doc_id long, score double, found array<double>")
