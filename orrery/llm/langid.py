"""Language identification of mixed text: script ranges, per-word scores, Viterbi with a switching penalty.

Byte 4-gram models of each language are learned from a bounded sample of documents. A word's script
decides its candidate languages, and only those are scored: others are impossible. A word's score is the
sum of its 4-grams' log probabilities; a 4-gram that a language hasn't shown has the same probability in
every language, so that little training is no advantage. Viterbi
over the words of a text, where changing the language costs a penalty, labels spans; the language of most
letters is the document's. All documents of a run of bytes take each Viterbi step together.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Texts, spans, spread, texts
from .sampling import sample_per_label, sampled_texts
from .toxicity import fold_case

#: Documents of each language that are learned from at most.
SAMPLE = 2500
BUCKETS = 1 << 16
SWITCH = 12.0
#: A language is a candidate for a script if so many of its words are written in it.
SCRIPT_SHARE = 0.005
#: Share of a 4-gram's probability that comes from all languages together; it is all that an unseen one has.
SHARED = 0.001
#: 4-grams that are taken as seen besides a language's own: a chance sight in little text counts for little.
UNSURE = 200.0
CHUNK = 4 << 20
UNKNOWN = "und"

# Scripts by ranges of code points (both ends in), as the Unicode blocks lie; other letters are of the last script.
SCRIPTS = [
    ("latin", 0x0041, 0x02AF), ("greek", 0x0370, 0x03FF), ("cyrillic", 0x0400, 0x052F), ("armenian", 0x0530, 0x058F), ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x06FF), ("arabic", 0x0750, 0x077F), ("arabic", 0x0870, 0x08FF),
    ("devanagari", 0x0900, 0x097F), ("bengali", 0x0980, 0x09FF), ("gurmukhi", 0x0A00, 0x0A7F), ("gujarati", 0x0A80, 0x0AFF), ("oriya", 0x0B00, 0x0B7F), ("tamil", 0x0B80, 0x0BFF), ("telugu", 0x0C00, 0x0C7F), ("kannada", 0x0C80, 0x0CFF), ("malayalam", 0x0D00, 0x0D7F), ("sinhala", 0x0D80, 0x0DFF),
    ("thai", 0x0E00, 0x0E7F), ("lao", 0x0E80, 0x0EFF), ("tibetan", 0x0F00, 0x0FFF), ("myanmar", 0x1000, 0x109F), ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF), ("ethiopic", 0x1200, 0x139F), ("khmer", 0x1780, 0x17FF), ("mongolian", 0x1800, 0x18AF), ("georgian", 0x1C90, 0x1CBF),
    ("latin", 0x1D00, 0x1EFF), ("greek", 0x1F00, 0x1FFF), ("latin", 0x2090, 0x209F), ("latin", 0x2C60, 0x2C7F), ("kana", 0x3040, 0x30FF), ("hangul", 0x3130, 0x318F), ("kana", 0x31F0, 0x31FF), ("han", 0x3400, 0x4DBF), ("han", 0x4E00, 0x9FFF), ("cyrillic", 0xA640, 0xA69F), ("latin", 0xA720, 0xA7FF), ("hangul", 0xAC00, 0xD7AF),
    ("han", 0xF900, 0xFAFF), ("latin", 0xFB00, 0xFB06), ("armenian", 0xFB13, 0xFB17), ("hebrew", 0xFB1D, 0xFB4F), ("arabic", 0xFB50, 0xFDFF), ("arabic", 0xFE70, 0xFEFF), ("latin", 0xFF21, 0xFF5A), ("kana", 0xFF66, 0xFF9F), ("han", 0x20000, 0x323AF),
]
SCRIPT_NAMES = [*dict.fromkeys(s for s, _, _ in SCRIPTS), "other"]
#: No letter or mark has a greater code point but for the variation selectors, which are no part of words here.
_LAST = 0x323AF
#: Of a code point: no part of a word, a mark, or (from here on, by script) a letter.
_NONE, _MARK, _LETTERS = 0, 1, 2


@lru_cache(1)
def kinds() -> np.ndarray:
    """By code point: no part of a word, a combining mark, or a letter and its script."""
    out = np.full(_LAST + 2, _NONE, np.uint8)
    script = np.full(_LAST + 2, len(SCRIPT_NAMES) - 1, np.uint8)
    for name, lo, hi in SCRIPTS:
        script[lo : hi + 1] = SCRIPT_NAMES.index(name)
    for c in range(_LAST + 1):
        category = unicodedata.category(chr(c))[0]
        if category == "L":
            out[c] = _LETTERS + script[c]
        elif category == "M":
            out[c] = _MARK
    return out


def characters(data: np.ndarray) -> np.ndarray:
    """For every byte the kind of its character."""
    table = kinds()
    out = table[np.minimum(data, 127)]
    lead = np.flatnonzero(data >= 0xC0)
    if not len(lead):
        out[data >= 128] = _NONE
        return out
    first = data[lead].astype(np.int64)
    size = 2 + (first >= 0xE0) + (first >= 0xF0)
    code = first & np.array([0, 0, 0x1F, 0x0F, 0x07])[size]
    last = len(data) - 1
    for k in range(1, 4):
        more = size > k
        code[more] = code[more] << 6 | (data[np.minimum(lead[more] + k, last)] & 0x3F)
    kind = table[np.minimum(code, _LAST + 1)]
    out[data >= 128] = _NONE
    for k in range(4):
        inside = size > k
        out[np.minimum(lead[inside] + k, last)] = kind[inside]
    return out


def grams(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For every byte the bucket of the 4-gram that ends there within its word (one blank before it), and starts, ends, scripts of words and each text's first word.

    Words are runs of letters and of the marks on them, with a letter at least; a word's script is its first letter's.
    """
    low = fold_case(t.data)
    kind = characters(low)
    starts, ends = spans(kind > _NONE, t.offsets)
    letter = np.r_[np.flatnonzero(kind >= _LETTERS), len(low)]
    head = letter[np.searchsorted(letter, starts)] if len(starts) else np.zeros(0, np.int64)
    starts, ends, head = starts[head < ends], ends[head < ends], head[head < ends]
    inside = np.zeros(len(low) + 1, np.int8)
    inside[starts] = 1
    inside[ends] -= 1
    inside = np.cumsum(inside[:-1], dtype=np.int8) > 0
    b = np.where(inside, low, 32).astype(np.uint32)
    code = b.copy()
    lead = np.zeros(len(b), bool)
    lead[starts] = True
    broken = lead.copy()
    for k in range(1, 4):
        prev = np.empty_like(b)
        prev[:k], prev[k:] = 32, b[:-k] if len(b) > k else 0
        prev[broken] = 32
        code = code * np.uint32(0x01000193) ^ prev
        nxt = broken.copy()
        nxt[k:] |= lead[:-k] if len(b) > k else False
        broken = nxt
    code *= np.uint32(0x9E3779B1)
    return (code >> np.uint32(16)).astype(np.int32), starts, ends, (kind[head] - _LETTERS).astype(np.int64), np.searchsorted(starts, t.offsets)


@dataclass
class Model:
    languages: list[str] = field(default_factory=list)
    log_p: np.ndarray = field(default_factory=lambda: np.zeros((0, BUCKETS), np.float32))
    #: by language and script: whether words of the script may be of the language
    allowed: np.ndarray = field(default_factory=lambda: np.zeros((0, len(SCRIPT_NAMES)), bool))
    switch: float = SWITCH

    def word_scores(self, t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Scores (words x languages, relative to a word's best; impossible ones infinitely low), starts, ends, first words."""
        code, starts, ends, script, first = grams(t)
        e = np.full((len(starts), len(self.languages)), -np.inf, np.float32)
        may = np.where(self.allowed.any(0), self.allowed, True).T  # by script; one that no language is known in leaves all
        sets, of_script = np.unique(may, axis=0, return_inverse=True)
        kind = of_script.ravel()[script]
        for c, candidates in enumerate(sets):
            on = np.flatnonzero(kind == c)
            if not len(on):
                continue
            size = ends[on] - starts[on]
            begin = np.cumsum(size) - size
            own = code[np.arange(size.sum()) - np.repeat(begin, size) + np.repeat(starts[on], size)]
            for k in np.flatnonzero(candidates):
                e[on, k] = np.add.reduceat(self.log_p[k][own], begin, dtype=np.float64)
        if len(e):
            e -= e.max(1, keepdims=True)
        return e, starts, ends, first

    def label(self, t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Language of every word by Viterbi, starts, ends, first words."""
        e, starts, ends, first = self.word_scores(t)
        n, words, size = np.diff(first), len(e), len(self.languages)
        best = np.zeros(words, np.int16)
        if not words:
            return best, starts, ends, first
        by = np.argsort(-n, kind="stable")
        begin, count = first[:-1][by], n[by]
        # texts that still have a word at step i: the first active[i] ones
        active = np.searchsorted(-count, -np.arange(count[0]), "left")
        back = np.zeros((words, size), np.int16)
        v = e[begin[: active[0]]].astype(np.float64)
        same = np.arange(size, dtype=np.int16)
        tops = np.zeros(len(by), np.int16)
        for i in range(1, int(count[0]) + 1):
            k = active[i] if i < count[0] else 0
            if k < len(v):
                tops[k : len(v)] = v[k:].argmax(1)
                v = v[:k]
                if not k:
                    break
            at = begin[:k] + i
            top = v.argmax(1)
            jump = v[np.arange(k), top] - self.switch
            stay = v >= jump[:, None]
            back[at] = np.where(stay, same, top[:, None].astype(np.int16))
            v = np.where(stay, v, jump[:, None]) + e[at]
            v -= v.max(1, keepdims=True)
        now = np.zeros(len(by), np.int16)
        for i in range(int(count[0]) - 1, -1, -1):
            k = active[i]
            longer = active[i + 1] if i + 1 < count[0] else 0
            now[longer:k] = tops[longer:k]
            if longer:
                now[:longer] = back[begin[:longer] + i + 1, now[:longer]]
            best[begin[:k] + i] = now[:k]
        return best, starts, ends, first


def learn(documents: DataFrame, *, sample: int = SAMPLE, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> Model:
    """4-gram counts of at most `sample` documents of each language; rows without language or text teach nothing."""
    known = documents.select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).cast("string").alias("label"))
    rows = sampled_texts(documents, sample_per_label(known, "id", "label", sample), id_col, text_col, parts=6)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams_of: dict[str, np.ndarray] = {}
        scripts_of: dict[str, np.ndarray] = {}
        for batch in batches:
            label = batch.column(1).to_pylist()
            for t in texts(batch):
                code, starts, ends, script, first = grams(t)
                for k in range(t.hi - t.lo):
                    a, b = first[k], first[k + 1]
                    if a == b:
                        continue
                    name = label[t.lo + k]
                    got = grams_of.setdefault(name, np.zeros(BUCKETS, np.int64))
                    within = code[starts[a] : ends[b - 1]]
                    got += np.bincount(within, minlength=BUCKETS)
                    scripts_of.setdefault(name, np.zeros(len(SCRIPT_NAMES), np.int64))[:] += np.bincount(script[a:b], minlength=len(SCRIPT_NAMES))
        for name, got in grams_of.items():
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([got.astype("<i4").tobytes()]), pa.array([scripts_of[name].tobytes()])], ["lang", "grams", "scripts"])

    total: dict[str, np.ndarray] = {}
    scripts: dict[str, np.ndarray] = {}
    for r in rows.mapInArrow(count, "lang string, grams binary, scripts binary").collect():
        total[r.lang] = total.get(r.lang, 0) + np.frombuffer(r.grams, "<i4").astype(np.int64)
        scripts[r.lang] = scripts.get(r.lang, 0) + np.frombuffer(r.scripts, np.int64)
    names = sorted(total)
    if not names:
        return Model()
    all_ = sum(total.values())
    prior = (all_ + 0.1) / (all_.sum() + 0.1 * BUCKETS)
    log_p = np.stack([np.log(SHARED * prior + (1 - SHARED) * total[n] / (total[n].sum() + UNSURE)) for n in names]).astype(np.float32)
    allowed = np.stack([scripts[n] >= np.maximum(1, SCRIPT_SHARE * scripts[n].sum()) for n in names])
    return Model(names, log_p, allowed)


def identify(documents: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, lang_pred, score, spans (lang, start and end in bytes of each labelled span).

    lang_pred has the most letters; score is its share of them. A text that is null, empty or has no letter (as
    Unicode classes characters) is `und` with score 0 and no spans, as is every text if the model knows no
    language. Letters of a script that no language is known in are weighed by their 4-grams alone. Ties go to
    the first language by name. Rows that repeat an id, or have none, get a row each; other columns are ignored;
    an empty table gives no rows. A text is labelled as a whole, however long: memory is six bytes for each of
    its words and languages.
    """
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    shared = documents.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        for batch in batches:
            for t in texts(batch, limit=CHUNK * 4 // max(4, len(m.languages))):
                docs = t.hi - t.lo
                lang, score, parts = [UNKNOWN] * docs, np.zeros(docs), [[] for _ in range(docs)]
                if m.languages:
                    best, starts, ends, first = m.label(t)
                    doc = np.repeat(np.arange(docs), np.diff(first))
                    size = len(m.languages)
                    share = np.bincount(doc * size + best, ends - starts, docs * size).reshape(docs, size)
                    top, all_ = share.argmax(1), share.sum(1)
                    turn = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (best[1:] != best[:-1])]) if len(doc) else np.zeros(0, np.int64)
                    for a, b in zip(turn, np.r_[turn[1:], len(doc)] - 1):
                        d = doc[a]
                        parts[d].append({"lang": m.languages[best[a]], "start": int(starts[a] - t.offsets[d]), "end": int(ends[b] - t.offsets[d])})
                    for d in range(docs):
                        if all_[d]:
                            lang[d], score[d] = m.languages[top[d]], share[d, top[d]] / all_[d]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(t.lo, docs), pa.array(lang), pa.array(score), pa.array(parts, kind)], ["doc_id", "lang_pred", "score", "spans"])

    return spread(rows).mapInArrow(run, "doc_id long, lang_pred string, score double, spans array<struct<lang: string, start: int, end: int>>")
