"""Toxicity of documents by multiple-instance learning: sentences are scored, only documents have labels.

A sentence's score is a logistic function of the words in it and of their beginnings, which stand for
stems: a stem may be harmless by itself and not in its other forms, so only beginnings shorter than the word count. A document is toxic if one of its sentences is: its score
is the noisy-or 1 - prod(1 - p) over its sentences. The weights are fitted by maximum likelihood of the documents'
labels through that noisy-or, so nothing says which sentence of a toxic document is meant; the fit finds them. Labels
are taken to be wrong with small probabilities, of which the one for clean documents is fitted too: a toxic label
that no word explains is put down to it and not to some rare word of that text.

Fitting reads a bounded sample: at most `positives` and `negatives` labelled documents, those of the smallest hash of
the id, from rows whose crc32(doc_id) mod 3 isn't 1, of at most `max_words` words. Copies and near copies that share
their sentence of the smallest hash count once, or one mislabelled and much-copied text would make its words
suspicious. Words and beginnings are counted by documents and label with Spark; the `vocabulary` of those whose counts
differ most between the labels (G statistic), and the sample's sentences as numbers of these, reach the driver. Scoring
reads whole texts in one pass without a shuffle.

A sentence ends at a line break or after `.`, `!` or `?`; longer ones than `longest` characters are cut between words.
Words are runs of letters, digits and marks, in lower case.

Defined results: a null or empty text has no sentence and scores 0; documents are scored one by one, so repeated rows
score alike, and a word or sentence that is repeated counts each time; a null id counts as not held out; of several
labels of an id the highest counts; without labels of both kinds every text scores 0; an empty table gives an empty
result. Columns of the input are kept, whatever their names, except those that the scores replace.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from cellweave.llm.common import chunks, free_memory, staged, table, text_or_empty

SENTENCE = re.compile(r"[^.!?\n]+[.!?]*|[.!?]+")
WORD = re.compile(r"\w+")


@dataclass(frozen=True)
class Params:
    #: labelled documents that are used for fitting, by label
    positives: int = 3000
    negatives: int = 6000
    #: of a document used for fitting; the staged sample has (positives + negatives) * max_words words at most
    max_words: int = 5000
    vocabulary: int = 2000
    #: lengths of the beginnings that count
    shortest_stem: int = 3
    longest_stem: int = 8
    #: documents of the sample that a word or beginning must stand in, and its least G statistic
    least_documents: int = 4
    least_g: float = 12.0
    longest: int = 2000
    steps: int = 400
    rate: float = 0.1
    l2: float = 0.02
    #: probability that a toxic document is labelled clean
    missed: float = 0.01
    #: sentences of at least this probability are located
    offending: float = 0.5
    chunk: int = 1 << 20
    #: words whose numbers a task keeps at hand between chunks
    remembered: int = 200_000


@dataclass(frozen=True)
class Model:
    words: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = -np.inf
    #: fitted probability that a clean document is labelled toxic
    noise: float = 0.0


def sentences(text: str, longest: int) -> Iterator[tuple[int, int]]:
    """(start, stop) of the sentences that hold a word."""
    for found in SENTENCE.finditer(text):
        start, stop = found.span()
        while stop - start > longest:
            cut = text.rfind(" ", start + 1, start + longest)
            cut = start + longest if cut < 0 else cut
            if WORD.search(text, start, cut):
                yield start, cut
            start = cut
        if WORD.search(text, start, stop):
            yield start, stop


def parts(word: str, params: Params) -> list[str]:
    """A word marked as whole, and its beginnings."""
    return [f"={word}", *(word[:k] for k in range(params.shortest_stem, min(params.longest_stem, len(word) - 1) + 1))]


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def _bags(params: Params):
    """Rows (toxic, text) -> (key, toxic, bags): words and beginnings of each sentence, and the hash by which near copies meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                lower = text.lower()
                bags = [WORD.findall(lower, a, b) for a, b in sentences(lower, params.longest)]
                if bags and sum(map(len, bags)) <= params.max_words:
                    long = [b for b in bags if len(b) >= 5] or [[w for b in bags for w in b]]
                    key = min(hashlib.md5(" ".join(b).encode()).digest() for b in long)
                    rows.append((key, label, [sorted({p for w in set(b) for p in parts(w, params)}) for b in bags]))
            if rows:
                kinds = (pa.binary(), pa.int32(), pa.list_(pa.list_(pa.string())))
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["key", "toxic", "bags"])

    return run


def sample(docs: DataFrame, labels: DataFrame, params: Params = Params()) -> DataFrame:
    """(toxic, bags) of the labelled documents that are used for fitting, staged."""
    known = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    order = F.xxhash64(F.col("doc_id").cast("string"))
    picked = [known.where(F.col("toxic") == k).orderBy(order, "doc_id").limit(n) for k, n in ((1, params.positives), (0, params.negatives))]
    # positives + negatives rows: a bound for the broadcast
    texts = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(picked[0].unionByName(picked[1])), "doc_id").select("toxic", "text")
    rows = texts.mapInArrow(_bags(params), "key binary, toxic int, bags array<array<string>>")
    return staged(rows.groupBy("key").agg(F.max(F.struct("toxic", "bags")).alias("top")).select("top.toxic", "top.bags"), "bags")


def vocabulary(bags: DataFrame, params: Params = Params()) -> tuple[list[tuple[str, int, int]], int, int]:
    """([(word, documents with it labelled 1, labelled 0)], documents labelled 1, labelled 0) of the words that tell the
    labels apart best."""
    totals = bags.agg(F.coalesce(F.sum("toxic"), F.lit(0)).alias("p"), F.count(F.lit(1)).alias("n")).first()
    pos, neg = int(totals.p), int(totals.n - totals.p)
    if not pos or not neg:
        return [], pos, neg
    words = bags.select("toxic", F.explode(F.array_distinct(F.flatten("bags"))).alias("word"))
    counts = words.groupBy("word").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b")).where(F.col("a") + F.col("b") >= params.least_documents)

    def part(seen: Column, total: Column | float) -> Column:  # seen * ln(seen / expected)
        return F.when(seen > 0, seen * F.ln(seen / total)).otherwise(0.0)

    n, a, b = float(pos + neg), F.col("a").cast("double"), F.col("b").cast("double")
    with_it, without = a + b, n - a - b
    g = 2 * (part(a, with_it * pos / n) + part(b, with_it * neg / n) + part(pos - a, without * pos / n) + part(neg - b, without * neg / n))
    top = counts.select("word", "a", "b", F.round(g, 6).alias("g")).where(F.col("g") >= params.least_g).orderBy(F.desc("g"), "word").limit(params.vocabulary)
    return [(r.word, int(r.a), int(r.b)) for r in top.collect()], pos, neg


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def noisy_or(z: np.ndarray, counts: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """log prod(1 - p) of each of n documents: z are logits of groups of equal sentences."""
    return -np.bincount(owner, counts * np.logaddexp(0, z), n)


def fit(docs: list[tuple[int, list[list[int]], int]], odds: np.ndarray, scale: tuple[float, float], params: Params = Params()) -> tuple[np.ndarray, float, float]:
    """(weights, bias, noise) from docs (label, word numbers of each sentence with some, other sentences).

    odds: where the weights start. scale: weight of a document by label. Adam over the whole sample.
    """
    labels = np.array([d[0] for d in docs], np.float64)
    n, v = len(docs), len(odds)
    rows, cols, counts, owner = [], [], [], []
    for i, (_, bags, plain) in enumerate(docs):
        if plain:
            counts.append(plain)
            owner.append(i)
        for bag in bags:
            rows += [len(counts)] * len(bag)
            cols += bag
            counts.append(1)
            owner.append(i)
    rows, cols, counts, owner = np.array(rows, np.int64), np.array(cols, np.int64), np.array(counts, np.float64), np.array(owner, np.int64)
    of = np.where(labels > 0, scale[1], scale[0])
    # weights, bias, logit of the noise
    theta = np.concatenate([odds, [-8.0, -4.0]])
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, params.steps + 1):
        w, bias, noise = theta[:v], theta[v], float(sigmoid(theta[v + 1]))
        z = bias + np.bincount(rows, w[cols], len(counts))
        clean = np.exp(noisy_or(z, counts, owner, n))
        seen = np.clip(noise + (1 - noise - params.missed) * (1 - clean), 1e-9, 1 - 1e-9)
        d_seen = of * (labels - seen) / (seen * (1 - seen))
        d_z = (d_seen * (1 - noise - params.missed) * clean)[owner] * counts * sigmoid(z)
        grad = np.concatenate([np.bincount(cols, d_z[rows], v) - params.l2 * w, [d_z.sum(), (d_seen * clean).sum() * noise * (1 - noise)]])
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        theta = theta + params.rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        theta[v + 1] = min(theta[v + 1], -1.0)
    return theta[:v], float(theta[v]), float(sigmoid(theta[v + 1]))


def train(docs: DataFrame, labels: DataFrame, params: Params = Params()) -> Model:
    """A model from docs(doc_id, text) and labels(doc_id, toxic) of rows that aren't held out."""
    bags = sample(docs, labels, params)
    words, pos, neg = vocabulary(bags, params)
    if not pos or not neg:
        return Model()
    at = {w: i for i, (w, *_) in enumerate(words)}

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = [[[at[w] for w in b if w in at] for b in bags] for bags in batch.column("bags").to_pylist()]
            found = pa.array([[b for b in bags if b] for bags in coded], pa.list_(pa.list_(pa.int32())))
            plain = pa.array([sum(not b for b in bags) for bags in coded], pa.int32())
            yield pa.record_batch([batch.column("toxic"), found, plain], names=["toxic", "n", "plain"])

    coded = bags.mapInArrow(numbers, "toxic int, n array<array<int>>, plain int")
    # at most positives + negatives rows of at most max_words numbers
    rows = sorted((r.toxic, [list(b) for b in r.n], r.plain) for r in coded.collect())
    if not words:
        return Model({}, np.zeros(0), -np.inf)
    ratio = np.array([np.log((a + 0.5) / (pos + 1)) - np.log((b + 0.5) / (neg + 1)) for _, a, b in words])
    weights, bias, noise = fit(rows, ratio, (1.0, 1.0), params)
    return Model(at, weights, bias, noise)


def scored(model: Model, text: str, params: Params = Params(), known: dict[str, tuple[int, ...]] | None = None) -> tuple[float, int, list[tuple[int, int, float]]]:
    """(score, sentences, [(start, stop, probability)] of the offending ones) of a text. known: numbers of words seen before."""
    known = {} if known is None else known
    lower = text.lower()
    same = len(lower) == len(text)  # a letter may become two: then places are found again in the text as it is
    words, n, log_clean, found = model.words, 0, 0.0, []
    plain = float(np.logaddexp(0, model.bias))
    weights = model.weights
    for at, (a, b) in enumerate(sentences(lower, params.longest)):
        n += 1
        hits: set[int] = set()
        for w in set(WORD.findall(lower, a, b)):
            own = known.get(w)
            if own is None:
                own = known[w] = tuple(words[p] for p in parts(w, params) if p in words)
            hits.update(own)
        if not hits:
            log_clean -= plain
            continue
        z = model.bias + sum(weights[i] for i in hits)
        log_clean -= float(np.logaddexp(0, z))
        if z >= np.log(params.offending / (1 - params.offending)):
            found.append((at if not same else a, b, float(sigmoid(np.array(z)))))
    if found and not same:
        places = list(sentences(text, params.longest))
        found = [(*places[min(at, len(places) - 1)], p) for at, _, p in found]
    return float(-np.expm1(log_clean)), n, found


SPAN = StructType([StructField("start", LongType()), StructField("stop", LongType()), StructField("p", DoubleType())])
ADDED = [StructField("score", DoubleType()), StructField("sentences", IntegerType()), StructField("offending", ArrayType(SPAN))]


def with_scores(docs: DataFrame, model: Model, keep: list[str] | None = None, params: Params = Params()) -> DataFrame:
    """The columns `keep` of docs (all, if None), the score of its column text, the number of its sentences, and the places
    (code points) and probabilities of the offending ones, in one pass."""
    taken = {f.name for f in ADDED}
    kept = [f for f in docs.schema.fields if f.name in (docs.columns if keep is None else keep) and f.name.lower() not in taken]
    names = [f.name for f in kept]
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("p", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            for start, stop, texts in chunks(batch.column("text"), params.chunk):
                if len(known) > params.remembered:
                    known.clear()
                rows = [scored(model, x or "", params, known) for x in texts]
                own = batch.slice(start, stop - start)
                out = [pa.array([r[0] for r in rows], pa.float64()), pa.array([r[1] for r in rows], pa.int32())]
                out.append(pa.array([[{"start": a, "stop": b, "p": p} for a, b, p in r[2]] for r in rows], span))
                yield pa.record_batch([*(own.column(n) for n in names), *out], names=[*names, *(f.name for f in ADDED)])
        free_memory()

    return docs.withColumn("text", F.col("text").cast("string")).mapInArrow(run, StructType([*kept, *ADDED]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with scores, and how many of their sentences offend, the worst one's place and probability."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    worst = F.array_max(F.transform("offending", lambda s: F.struct(s["p"].alias("p"), (-s["start"]).alias("at"), s["stop"].alias("stop"))))
    out = with_scores(docs, model, ["doc_id"]).withColumn("worst", worst)
    return out.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "sentences", F.size("offending").alias("n_offending"),
        (-F.col("worst.at")).alias("worst_start"), F.col("worst.stop").alias("worst_stop"), F.col("worst.p").alias("worst_p"),
    )
