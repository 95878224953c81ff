"""Document quality from a linear-chain conditional random field over lines.

Every line with a word gets a vector: length, shares of character classes, word length, distinct words, whether an
equal line came before; and the vectors of the line before and after it. A chain of two labels (bad, good) with
transition weights is fitted by maximum conditional likelihood, where each line of a training document carries the
document's label. A document's quality is the mean of its lines' forward-backward marginals of "good", weighted by
line length, passed through a monotone calibration fitted on the same training documents.

Training reads labels and texts of a bounded sample only: at most `per_class` documents of either label with at
most `max_lines` lines, those of the smallest hash of the id, from rows whose crc32(doc_id) mod 3 isn't 1. Scoring
reads whole texts in one pass without a shuffle.

Defined results: a text without a line that has a word (null, empty, blank) scores 0; documents are scored one by
one, so repeated rows score alike; a null id counts as not held out; without labels of both kinds every text with a
word scores 0.5; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from cellweave.llm.common import chunks, free_memory, guarded, table, text_or_empty

CLASSES = 8  # other, lower, upper, digit, space, sentence mark, symbol, bar
N_FEATURES = 12


@dataclass(frozen=True)
class Params:
    per_class: int = 3000
    #: of a training document; with 52 bytes a line, the driver gets per_class * max_lines * 104 bytes at most
    max_lines: int = 500
    steps: int = 250
    rate: float = 0.08
    l2: float = 1e-3
    chunk: int = 1 << 20


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # of "good" over the vector, its neighbours and a constant
    transitions: np.ndarray
    slope: float = 1.0
    offset: float = 0.0


@cache
def _class_table() -> np.ndarray:
    """Character class by code point; the last entry is for all beyond the Latin blocks."""
    found = np.zeros(0x251, np.int64)
    for i in range(0x250):
        c = chr(i)
        if c == "|":
            found[i] = 7
        elif c.isspace():
            found[i] = 4
        elif c.isdigit():
            found[i] = 3
        elif c.isupper():
            found[i] = 2
        elif c.isalpha():
            found[i] = 1
        elif c in ".,;:!?'\"()-":
            found[i] = 5
        elif c.isprintable():
            found[i] = 6
    found[0x250] = 1
    return found


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vectors of all lines with a word, their lengths in characters, lines per text)."""
    joined = "\n".join(texts)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = _class_table()[np.minimum(codes, 0x250)]
    breaks = codes == 10
    line = np.cumsum(breaks) - breaks
    n = joined.count("\n") + 1
    counts = np.bincount(line * CLASSES + kinds, minlength=n * CLASSES).reshape(n, CLASSES).astype(np.float64)
    counts[:-1, 4] -= 1  # the break itself
    words, distinct, repeated, per_text = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(len(texts), np.int64)
    keep, i = np.zeros(n, bool), 0
    for t, text in enumerate(texts):
        seen = set()
        for own in text.split("\n"):
            found = own.split()
            if found:
                keep[i] = True
                words[i], distinct[i] = len(found), len(set(found))
                repeated[i] = own in seen
                seen.add(own)
                per_text[t] += 1
            i += 1
    counts, words, distinct, repeated = counts[keep], words[keep], distinct[keep], repeated[keep]
    chars = counts.sum(axis=1)
    solid = np.maximum(chars - counts[:, 4], 1)
    shares = counts[:, [1, 2, 3, 5, 6, 7]] / solid[:, None]
    letters = np.maximum(counts[:, 1] + counts[:, 2], 1)
    own = [np.log1p(chars), np.log1p(words), solid / words, distinct / words, repeated, counts[:, 2] / letters]
    return np.column_stack([shares, *own]), chars, per_text


def chained(vectors: np.ndarray, per_text: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Standardised vectors with those of the neighbouring lines of the same text and a constant."""
    x = (vectors - mean) / scale
    before, after = np.zeros_like(x), np.zeros_like(x)
    if len(x) > 1:
        before[1:], after[:-1] = x[:-1], x[1:]
    full = per_text[per_text > 0]
    ends = np.cumsum(full)
    before[ends - full] = 0
    after[ends - 1] = 0
    return np.column_stack([x, before, after, np.ones(len(x))])


def marginals(scores: np.ndarray, per_text: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(P(good) of each line, expected transition counts, log partition sum): all texts go step by step together."""
    order = np.argsort(-per_text, kind="stable")
    lengths = per_text[order]
    lengths = lengths[lengths > 0]
    starts = (np.cumsum(per_text) - per_text)[order][: len(lengths)]
    steps = int(lengths[0]) if len(lengths) else 0
    live = np.searchsorted(-lengths, -np.arange(1, steps + 1), side="right")  # texts with a line t
    m = np.exp(transitions)
    emit = np.column_stack([np.ones(len(scores)), np.exp(np.clip(scores, -30, 30))])
    forward, norm = np.zeros((len(scores), 2)), np.ones(len(scores))
    for t in range(steps):
        at = starts[: live[t]] + t
        a = emit[at] if t == 0 else (forward[at - 1] @ m) * emit[at]
        norm[at] = a.sum(axis=1)
        forward[at] = a / norm[at][:, None]
    backward = np.ones((len(scores), 2))
    pairs = np.zeros((2, 2))
    for t in range(steps - 2, -1, -1):
        at = starts[: live[t + 1]] + t
        ahead = emit[at + 1] * backward[at + 1] / norm[at + 1][:, None]
        pairs += (forward[at].T @ ahead) * m
        backward[at] = ahead @ m.T
    both = forward * backward
    return both[:, 1] / both.sum(axis=1), pairs, np.log(norm).sum()


def qualities(model: Model, texts: list[str]) -> np.ndarray:
    """Score of each text; 0 where no line has a word."""
    vectors, chars, per_text = line_features(texts)
    return _aggregate(model, vectors, chars, per_text, True)


def _aggregate(model: Model, vectors, chars, per_text, calibrated: bool) -> np.ndarray:
    out = np.zeros(len(per_text))
    if not len(vectors):
        return out
    good, *_ = marginals(chained(vectors, per_text, model.mean, model.scale) @ model.weights, per_text, model.transitions)
    owner = np.repeat(np.arange(len(per_text)), per_text)
    mean = np.bincount(owner, good * chars, len(per_text)) / np.maximum(np.bincount(owner, chars, len(per_text)), 1)
    if calibrated:
        mean = 1 / (1 + np.exp(-(model.slope * _logit(mean) + model.offset)))
    return np.where(per_text > 0, mean, out)


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def fit(vectors: np.ndarray, chars: np.ndarray, per_text: np.ndarray, labels: np.ndarray, params: Params = Params()) -> Model:
    """Maximum likelihood by Adam over the whole sample; every text weighs by its class's share and its lines."""
    if not len(vectors) or len(np.unique(labels)) < 2:
        d = max(vectors.shape[1] if vectors.ndim == 2 else 0, N_FEATURES)
        return Model(np.zeros(d), np.ones(d), np.zeros(3 * d + 1), np.zeros((2, 2)), 0.0, 0.0)
    mean, scale = vectors.mean(axis=0), np.maximum(vectors.std(axis=0), 1e-3)
    x = chained(vectors, per_text, mean, scale)
    y = np.repeat(labels, per_text).astype(np.float64)
    same = np.ones(len(y), bool)
    full = per_text[per_text > 0]
    same[np.cumsum(full) - full] = False
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[np.flatnonzero(same) - 1].astype(int), y[same].astype(int)), 1)
    w, tr = np.zeros(x.shape[1]), np.zeros((2, 2))
    theta = np.concatenate([w, tr.ravel()])
    m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, params.steps + 1):
        w, tr = theta[:-4], theta[-4:].reshape(2, 2)
        good, pairs, _ = marginals(x @ w, per_text, tr)
        grad = np.concatenate([x.T @ (y - good), (seen - pairs).ravel()]) / len(y) - params.l2 * theta
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad**2
        theta = theta + params.rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
    model = Model(mean, scale, theta[:-4], theta[-4:].reshape(2, 2))
    z = _logit(_aggregate(model, vectors, chars, per_text, False))
    slope, offset = 1.0, 0.0
    for _ in range(50):  # Newton steps of a logistic regression on one number, slightly regularised
        p = 1 / (1 + np.exp(-(slope * z + offset)))
        g = np.array([((labels - p) * z).sum() - 0.1 * (slope - 1), (labels - p).sum() - 0.1 * offset])
        v = p * (1 - p)
        h = np.array([[(v * z * z).sum() + 0.1, (v * z).sum()], [(v * z).sum(), v.sum() + 0.1]])
        d = np.linalg.solve(h, g)
        slope, offset = slope + d[0], offset + d[1]
        if np.abs(d).max() < 1e-6:
            break
    return Model(model.mean, model.scale, model.weights, model.transitions, float(max(slope, 1e-3)), float(offset))


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, params: Params = Params()) -> Model:
    """A model from labels(doc_id, quality) and docs(doc_id, text) of rows that aren't held out."""
    known = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").where(~held_out()).groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    order = F.xxhash64("doc_id")
    picked = [known.where(F.col("quality") == k).orderBy(order, "doc_id").limit(params.per_class) for k in (0, 1)]
    sample = picked[0].unionByName(picked[1])  # 2 * per_class rows: a bound for the broadcast
    texts = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(sample), "doc_id").select("quality", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                vectors, chars, _ = line_features([text])
                if 0 < len(vectors) <= params.max_lines:
                    rows.append((label, vectors.astype("<f4").tobytes(), chars.astype("<f4").tobytes()))
            if rows:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))], names=["quality", "vectors", "chars"])

    # repeated ids could repeat rows: the same bound holds for what reaches the driver
    rows = texts.mapInArrow(run, "quality int, vectors binary, chars binary").limit(4 * params.per_class).collect()
    rows = sorted(rows, key=lambda r: (r.quality, bytes(r.vectors)))
    vectors = [np.frombuffer(r.vectors, "<f4").reshape(-1, N_FEATURES) for r in rows]
    if not vectors:
        return fit(np.zeros((0, N_FEATURES)), np.zeros(0), np.zeros(0, np.int64), np.zeros(0), params)
    chars = np.concatenate([np.frombuffer(r.chars, "<f4") for r in rows])
    return fit(np.concatenate(vectors).astype(np.float64), chars.astype(np.float64), np.array([len(v) for v in vectors]), np.array([r.quality for r in rows]), params)


def with_scores(docs: DataFrame, model: Model, name: str = "score", keep: list[str] | None = None, params: Params = Params()) -> DataFrame:
    """The columns `keep` of docs (all, if None) and the score of its column text, in one pass."""
    kept = [f for f in docs.schema.fields if f.name in (docs.columns if keep is None else keep) and f.name != name]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [np.zeros(0)]
            for _, _, texts in chunks(batch.column("text"), params.chunk):
                scores.append(qualities(model, [x or "" for x in texts]))
            yield pa.record_batch([*(batch.column(n) for n in names), pa.array(np.concatenate(scores))], names=[*names, name])
        free_memory()

    return docs.mapInArrow(run, StructType([*kept, StructField(name, DoubleType())]))


def filter_documents(spark: SparkSession, docs: DataFrame, sf_dir: str, threshold: float = 0.5, params: Params = Params()) -> DataFrame:
    """The rows of docs that score at least threshold, by a model of the labelled documents of sf_dir."""
    model = train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), params)
    columns = docs.columns
    docs, hidden = guarded(docs, "__crf_")
    return with_scores(docs, model, "__crf_score", params=params).where(F.col("__crf_score") >= threshold).select(*docs.columns).withColumnsRenamed(hidden).select(*columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))

    scored = with_scores(docs, model, keep=["doc_id"])
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
