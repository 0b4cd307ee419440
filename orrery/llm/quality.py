"""Document quality by attention-based multiple-instance learning (Ilse, Tomczak, Welling 2018).

A document is a bag of passages of a fixed number of words. Each passage is described by its words, in hashed
buckets, by how its text is written and by how much of it stands in earlier passages, encoded by a learned layer, weighted by gated attention that is learned from document labels
alone, and the weighted mean is scored. Training fits numpy parameters on a bounded sample of labelled
rows on the driver; scoring is one pass over the documents without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NOT_SPACE, Texts, mix, spread, texts, words
from .sampling import sample_per_label, sampled_texts

PASSAGE_WORDS = 80
#: The least score of a good document: label 1 of op3_quality, and what the pipeline's stage keeps.
THRESHOLD = 0.7
#: Labelled documents of each label that are fitted on at most.
SAMPLE = 1500
HIDDEN = 16
_MARKS = b".,!?;:|*#$%&@\"'()[]{}<>/\\-_=+~^`"
_CHAR_GROUPS = [b".", b",", b"!", b"?", b";:", b"|", b"*", b"#", b"$", b"%", b"&", b"\"'()[]{}", b"<>/\\=+~^`@_-", b"\n"]


def _flag(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_UPPER, _DIGIT, _LETTER, _MARK = _flag(bytes(range(65, 91))), _flag(b"0123456789"), _flag(bytes([*range(65, 91), *range(97, 123), *range(128, 256)])), _flag(_MARKS)
_GROUP = np.full(256, len(_CHAR_GROUPS), np.int64)
for _k, _chars in enumerate(_CHAR_GROUPS):
    _GROUP[list(_chars)] = _k
#: Buckets that words are hashed into.
WORD_BUCKETS = 64
SURFACE = len(_CHAR_GROUPS) + 14
FEATURES = SURFACE + WORD_BUCKETS


def _distinct(passage: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """Distinct hashes of each passage."""
    by = np.argsort(h, kind="stable")
    by = by[np.argsort(passage[by], kind="stable")]
    p, g = passage[by], h[by]
    new = np.ones(len(p), bool)
    new[1:] = (p[1:] != p[:-1]) | (g[1:] != g[:-1])
    return np.bincount(p[new], minlength=n)


def _first_of(doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether a hash stands for the first time in its document."""
    by = np.argsort(h, kind="stable")
    by = by[np.argsort(doc[by], kind="stable")]
    new = np.ones(len(by), bool)
    new[1:] = (doc[by[1:]] != doc[by[:-1]]) | (h[by[1:]] != h[by[:-1]])
    out = np.zeros(len(by), bool)
    out[by[new]] = True
    return out


def passages(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """A feature row for every passage, and each text's first passage (one more entry than texts). A text without words has one passage of zeros."""
    w = words(t, NOT_SPACE)
    docs, n_words = t.hi - t.lo, np.diff(w.first)
    count = np.maximum(1, -(-n_words // PASSAGE_WORDS))
    first = np.r_[0, np.cumsum(count)]
    n = int(first[-1])
    doc = np.repeat(np.arange(docs), n_words)
    passage = first[doc] + (np.arange(len(doc)) - w.first[doc]) // PASSAGE_WORDS
    x = np.zeros((n, FEATURES), np.float32)
    if not len(doc):
        return x, first
    begin = np.r_[True, passage[1:] != passage[:-1]]
    at = passage[begin]
    starts = w.starts[begin]
    ends = w.ends[np.r_[np.flatnonzero(begin)[1:] - 1, len(doc) - 1]]
    size = np.maximum(1, ends - starts)

    def per_byte(flag: np.ndarray) -> np.ndarray:
        sums = np.r_[0, np.cumsum(flag, dtype=np.int64)]
        return sums[ends] - sums[starts]

    group = _GROUP[t.data]
    for k in range(len(_CHAR_GROUPS)):
        x[at, k] = np.log1p(100 * per_byte(group == k) / size)
    c = len(_CHAR_GROUPS)
    length = (w.ends - w.starts).astype(np.float64)
    n_in = np.bincount(passage, minlength=n)
    here = np.maximum(1, n_in)
    mean = np.bincount(passage, length, n) / here
    last = t.data[w.ends - 1]
    head = t.data[w.starts]
    upper, digit, letter = _UPPER[t.data], _DIGIT[t.data], _LETTER[t.data]
    letters = per_byte(letter)
    x[at, c] = per_byte(upper) / np.maximum(1, letters)
    x[at, c + 1] = per_byte(digit) / size
    x[at, c + 2] = letters / size
    x[at, c + 3] = per_byte(t.data >= 128) / size
    x[:, c + 4] = np.minimum(mean, 40) / 10
    x[:, c + 5] = np.sqrt(np.maximum(0, np.bincount(passage, length * length, n) / here - mean * mean)).clip(0, 40) / 10
    x[:, c + 6] = np.bincount(passage, _MARK[last], n) / here
    x[:, c + 7] = np.bincount(passage, _UPPER[head], n) / here
    x[:, c + 8] = np.bincount(passage, length <= 3, n) / here
    x[:, c + 9] = np.bincount(passage, length == 1, n) / here
    x[:, c + 10] = _distinct(passage, w.hashes, n) / here
    triple = mix(w.hashes * np.uint64(3) + np.roll(w.hashes, -1) * np.uint64(5) + np.roll(w.hashes, -2) * np.uint64(7))
    x[:, c + 11] = _distinct(passage, triple, n) / here
    x[:, c + 12] = np.bincount(passage[~_first_of(doc, triple)], minlength=n) / here
    x[:, c + 13] = np.log1p(n_in) / 5
    bucket = (mix(w.hashes) >> np.uint64(58)).astype(np.int64)
    x[:, SURFACE:] = np.bincount(passage * WORD_BUCKETS + bucket, minlength=n * WORD_BUCKETS).reshape(n, WORD_BUCKETS) / here[:, None]
    return x, first


@dataclass
class Model:
    """Parameters by name; `mean` and `scale` standardise features."""

    p: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        x = ((x - p["mean"]) / p["scale"]).clip(-6, 6)
        h = np.tanh(x @ p["We"] + p["be"])
        v, u = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        logit = (v * u) @ p["w"]
        n = np.diff(first)
        top = np.maximum.reduceat(logit, first[:-1])
        e = np.exp(logit - np.repeat(top, n))
        a = e / np.repeat(np.add.reduceat(e, first[:-1]), n)
        z = np.add.reduceat(a[:, None] * h, first[:-1])
        s = (z @ p["c"] + p["b"]).clip(-30, 30)
        return {"x": x, "h": h, "v": v, "u": u, "a": a, "z": z, "y": 1 / (1 + np.exp(-s))}

    def score(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        return self.forward(x, first)["y"]

    def attention(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Each passage's share of its document's score."""
        return self.forward(x, first)["a"]


def fit(x: np.ndarray, first: np.ndarray, label: np.ndarray, weight: np.ndarray, *, steps: int = 160, rate: float = 0.02, decay: float = 1e-4, seed: int = 7) -> Model:
    """Full-batch Adam on the weighted log loss of document labels."""
    rng = np.random.default_rng(seed)
    f = x.shape[1]
    p = {
        "mean": x.mean(0), "scale": x.std(0) + 1e-3, "We": rng.normal(0, f**-0.5, (f, HIDDEN)), "be": np.zeros(HIDDEN),
        "V": rng.normal(0, 0.3, (HIDDEN, HIDDEN)), "U": rng.normal(0, 0.3, (HIDDEN, HIDDEN)), "w": rng.normal(0, 0.3, HIDDEN), "c": rng.normal(0, 0.3, HIDDEN), "b": np.zeros(1),
    }
    p = {k: a.astype(np.float32) for k, a in p.items()}
    model, n = Model(p), np.diff(first)
    m = {k: [0.0, 0.0] for k in p if k not in ("mean", "scale")}
    label, weight = label.astype(np.float32), (weight / weight.sum()).astype(np.float32)
    for step in range(1, steps + 1):
        o = model.forward(x, first)
        d = (o["y"] - label) * weight
        dz = d[:, None] * p["c"]
        g = {"c": o["z"].T @ d, "b": np.array([d.sum()])}
        dz_each = np.repeat(dz, n, 0)
        da = (dz_each * o["h"]).sum(1)
        mean = np.repeat(np.add.reduceat(o["a"] * da, first[:-1]), n)
        dl = o["a"] * (da - mean)
        g["w"] = (o["v"] * o["u"]).T @ dl
        dvu = dl[:, None] * p["w"]
        dv, du = dvu * o["u"] * (1 - o["v"] ** 2), dvu * o["v"] * o["u"] * (1 - o["u"])
        g["V"], g["U"] = o["h"].T @ dv, o["h"].T @ du
        dh = (o["a"][:, None] * dz_each + dv @ p["V"].T + du @ p["U"].T) * (1 - o["h"] ** 2)
        g["We"], g["be"] = o["x"].T @ dh, dh.sum(0)
        for k, s in m.items():
            grad = g[k] + decay * p[k]
            s[0] = 0.9 * s[0] + 0.1 * grad
            s[1] = 0.99 * s[1] + 0.01 * grad**2
            p[k] = p[k] - rate * (s[0] / (1 - 0.9**step)) / (np.sqrt(s[1] / (1 - 0.99**step)) + 1e-8)
    return model


def train(documents: DataFrame, labels: DataFrame, *, label_col: str = "quality", sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Model | None:
    """Fit on at most `sample` documents of each label, weighted back to the labels' own shares. None if there is nothing to learn from."""
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).filter("label in (0, 1)")
    share = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    rows = sampled_texts(documents, sample_per_label(known, "id", "label", sample), id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in texts(batch):
                x, first = passages(t)
                raw = [x[a:b].tobytes() for a, b in zip(first[:-1], first[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(t.lo, t.hi - t.lo), batch.column(1).slice(t.lo, t.hi - t.lo), pa.array(raw, pa.binary())], ["id", "label", "x"])

    bags = sorted((r.id, r.label, bytes(r.x)) for r in rows.mapInArrow(run, "id long, label int, x binary").collect())
    if not bags:
        return None
    xs = [np.frombuffer(r[2], np.float32).reshape(-1, FEATURES) for r in bags]
    label = np.array([r[1] for r in bags], np.float64)
    got = {k: max(1, int((label == k).sum())) for k in (0, 1)}
    weight = np.where(label == 1, share.get(1, 0) / got[1], share.get(0, 0) / got[0])
    return fit(np.concatenate(xs), np.r_[0, np.cumsum([len(x) for x in xs])], label, weight)


def score(documents: DataFrame, model: Model | None, *, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """doc_id (or the columns of keep) and score, the chance of label 1, for every row.

    Null, empty and blank texts are a passage of zeros and get the model's score of it; without a model
    (no labels) the score is 0.5. Rows that repeat an id, or have none, get a row each; a kept column named score
    gives way to the score; an empty table gives no rows.
    """
    keep = [c for c in keep or [id_col] if c != "score"]
    rows = documents.select(*keep, F.col(text_col).cast("string").alias("_text"))
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in texts(batch, "_text"):
                if shared.value is None:
                    y = np.full(t.hi - t.lo, 0.5)
                else:
                    x, first = passages(t)
                    y = shared.value.score(x, first).astype(np.float64)
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(t.lo, t.hi - t.lo) for k in range(len(keep))), pa.array(y)], [*keep, "score"])

    schema = rows.drop("_text").schema.add("score", "double")
    return spread(rows).mapInArrow(run, schema)


def accepted(documents: DataFrame, model: Model | None, *, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The documents of at least that score, every column kept. Null and empty texts are scored as score() does; rows that repeat an id are judged each by its own text. Without a model all stay."""
    if model is None:
        return documents
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in texts(batch, text_col):
                good = shared.value.score(*passages(t)) >= threshold
                yield batch.slice(t.lo, t.hi - t.lo).filter(pa.array(good))

    return documents.mapInArrow(run, documents.schema)
