"""Near-duplicate classes by improved consistent weighted sampling over TF-IDF shingles.

1. A document is a weighted set of word 5-grams: weight = tf * idf. Document frequencies are taken over all
   documents in a hashed table of fixed size, so the table that is broadcast is bounded whatever the corpus
   holds. Shingles that share a counter add up, so a document frequency is seen as at least (shingles of a document)
   / 2**df_bits of the corpus, at any size of the corpus. idf = 1 + gain * ln(N / df) / ln(N), between 1 and
   1 + gain: copying a passage lowers its idf, and an unbounded idf would let copies hide each other.
2. Improved consistent weighted sampling (r, c ~ Gamma(2, 1), beta ~ U(0, 1); t = floor(ln w / r + beta),
   y = exp(r (t - beta)), a = c / (y exp(r)); the sample is (shingle, t) of the smallest a). Weights are rounded
   to a fixed ladder, so ln a and t come from a table over (rung of the ladder, slot); a shingle's slot differs
   for each of the samples, and of shingles in one slot the one of the smallest hash counts. For weights above the
   ladder (3) they are computed from the weight itself.
3. Samples are banded, without shuffling texts. Rows of equal texts are collapsed by the text's md5, so groups
   of thousands of copies count once from here on.
4. A bucket's leader is the member that shares most places in all its buckets, so that the original of many variants
   leads them wherever they meet. Every member is compared with its leaders: as many pairs as places in buckets.
5. Then the followers of a leader that the links so far leave in different components are compared among themselves,
   all of them, exactly. That is done where their texts are: the followers are dealt into blocks of bounded size, a
   task holds two blocks and gives the links that join components, at most one less than there are. A follower that
   is linked leaves its component's others out, and two followers are passed over only if their overlaps with the
   leader rule a link out (they share at most the smaller of these overlaps, and the smaller of what they have
   beyond). Blocks of followers that are in their leader's component already don't meet each other.
6. Similarity is always the exact weighted Jaccard similarity of the two texts; links are joined into classes by
   alternating smallest-neighbour steps with a written table between them.

Defined results: a null or empty text belongs to the class of the empty texts; texts under five words are one
shingle of all their words; rows with a null id take part, and a class's id is its smallest id that isn't null
(null where all are); repeated rows give repeated rows of one class. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm.bpe import gathered
from cellweave.llm.common import chunks, discard, free_memory, guarded, staged, table, text_or_empty

SLOT_BITS = 17
RUNGS, RUNGS_PER_E = 8, 6  # the ladder of weights: rungs, and how many make a factor e
PIECES, LANES = 64, 512
HOT = 1000
CHUNK = 1 << 20  # bytes of text that one step holds
OUT = ("root", "class_id", "class_size")


@dataclass(frozen=True)
class Params:
    words: int = 5
    threshold: float = 0.8
    bands: int = 20
    rows: int = 6
    df_bits: int = 20
    idf_gain: float = 0.1
    #: characters of a block of followers
    block: int = 4 << 20
    seed: int = 20240229


@cache
def _salts(seed: int, count: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, count, dtype=np.uint64) | np.uint64(1)


@cache
def _draws(seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """r, ln c and beta by slot."""
    rng = np.random.default_rng(seed)
    slots = 1 << SLOT_BITS
    r, c, beta = rng.gamma(2.0, 1.0, slots), rng.gamma(2.0, 1.0, slots), rng.random(slots)
    return r, np.log(c), beta


@cache
def _sampling_tables(seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(ranks of ln a by rung and slot, in the upper half of 64 bits; t by rank)."""
    r, log_c, beta = _draws(seed)
    log_a, t = np.empty((RUNGS, len(r)), np.float32), np.empty((RUNGS, len(r)), np.uint32)
    for rung in range(RUNGS):
        step = np.floor((rung / RUNGS_PER_E) / r + beta)
        log_a[rung], t[rung] = log_c - r * (step - beta) - r, step
    order = np.argsort(log_a.ravel(), kind="stable")
    ranks = np.empty(len(order), np.uint64)
    ranks[order] = np.arange(len(order), dtype=np.uint64) << np.uint64(32)
    return ranks, t.ravel()[order]


class Sampler:
    """The samples of the texts of a chunk, given their shingles' hashes and weights and each text's offset."""

    def __init__(self, seed: int, hashes: np.ndarray, weights: np.ndarray, offsets: np.ndarray):
        self.r, self.log_c, self.beta = _draws(seed)
        self.ranks, self.steps = _sampling_tables(seed)
        self.hashes, self.begin = hashes, offsets[:-1]
        self.place = np.arange(len(hashes), dtype=np.uint64)
        # the lowest rung is weight 1, the least that a shingle can have
        log_w = np.log(weights)
        rung = np.floor(log_w * RUNGS_PER_E + 0.5).astype(np.int64)
        self.rung = np.minimum(rung, RUNGS - 1) << SLOT_BITS
        # heavy ones are above the ladder: their samples come from the weights themselves
        self.heavy = np.flatnonzero(rung >= RUNGS)
        self.log_w = log_w[self.heavy]
        self.owners, self.starts, self.group = np.unique(np.searchsorted(offsets, self.heavy, "right") - 1, return_index=True, return_inverse=True)
        self.slot, self.found = np.empty(len(hashes), np.uint64), np.empty(len(hashes), np.uint64)

    def _log_a(self, slot: np.ndarray, t: np.ndarray) -> np.ndarray:
        return self.log_c[slot] - self.r[slot] * (t - self.beta[slot]) - self.r[slot]

    def __call__(self, salt: np.uint64) -> tuple[np.ndarray, np.ndarray]:
        """(hash of the sampled shingle, t) by text."""
        np.multiply(self.hashes, salt, out=self.slot)
        np.right_shift(self.slot, np.uint64(64 - SLOT_BITS), out=self.slot)
        slot = self.slot.view(np.int64)
        slot += self.rung
        np.take(self.ranks, slot, out=self.found, mode="clip")
        np.add(self.found, self.place, out=self.found)
        least = np.minimum.reduceat(self.found, self.begin)
        at, t = (least & np.uint64(0xFFFFFFFF)).astype(np.int64), self.steps[(least >> np.uint64(32)).astype(np.int64)].astype(float)
        if len(self.heavy):
            # a falls with the weight; a heavy shingle may also stand in the table, with the top rung
            low = (1 << SLOT_BITS) - 1
            own = slot[self.heavy] & low
            own_t = np.floor(self.log_w / self.r[own] + self.beta[own])
            log_a = self._log_a(own, own_t)
            light = self._log_a(slot[at[self.owners]] & low, t[self.owners])
            smallest = np.minimum(np.minimum.reduceat(log_a, self.starts), light)
            better = np.flatnonzero((log_a <= smallest[self.group]) & (log_a < light[self.group]))
            texts = self.owners[self.group[better]]
            at[texts], t[texts] = self.heavy[better], own_t[better]
        return self.hashes[at], t


class Shingler:
    """Hashed shingles of many texts at once; word hashes are remembered up to a bound."""

    def __init__(self, words: int, seed: int, remembered: int = 1 << 17):
        self.words, self.remembered, self.known = words, remembered, {}
        self.multipliers = _salts(seed, words)

    def _hash(self, word: str) -> int:
        if len(self.known) >= self.remembered:
            self.known.clear()
        return self.known.setdefault(word, xxhash.xxh3_64_intdigest(word))

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(hashes of all texts' shingles one after another, count per text)."""
        k, known, one = self.words, self.known.get, self._hash
        hashed = []
        for text in texts:
            own = text.lower().split()
            found = list(map(known, own))
            if None in found:
                found = [one(w) if x is None else x for x, w in zip(found, own)]
            if len(found) < k:  # one shingle of what there is
                found += [len(own)] * (k - len(found))
            hashed.append(np.array(found, np.uint64))
        flat = np.concatenate(hashed)
        lengths = np.fromiter(map(len, hashed), np.int64, len(hashed))
        with np.errstate(over="ignore"):
            rolled = np.zeros(len(flat), np.uint64)
            for i in range(k):
                rolled[: len(flat) - i] += flat[i:] * self.multipliers[i]
            rolled ^= rolled >> np.uint64(32)
            rolled *= np.uint64(0x9E3779B97F4A7C15)
            rolled ^= rolled >> np.uint64(29)
        ends = np.cumsum(lengths)
        keep = np.ones(len(flat), bool)
        for i in range(1, k):
            keep[ends - i] = False
        return rolled[keep], lengths - (k - 1)


def weighted(texts: list[str], shingler: Shingler) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct shingle hashes, their counts, offsets per text): hashes ascend within a text."""
    flat, lengths = shingler(texts)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    for a, b in zip(starts.tolist(), ends.tolist()):
        flat[a:b].sort()
    first = np.ones(len(flat), bool)
    first[1:] = flat[1:] != flat[:-1]
    first[starts] = True
    at = np.flatnonzero(first)
    return flat[at], np.diff(np.append(at, len(flat))), np.append(np.searchsorted(at, starts), len(at))


def document_frequencies(rows: DataFrame, params: Params) -> tuple[np.ndarray, int]:
    """(hashed document frequencies, number of documents) of rows(text); 2**df_bits numbers reach the driver."""
    bits, shift = params.df_bits, np.uint64(64 - params.df_bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shingler, total, n = Shingler(params.words, params.seed), np.zeros(1 << bits, np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for _, _, texts in chunks(batch.column(0), CHUNK):
                hashes, _, offsets = weighted(texts, shingler)
                slot = (hashes >> shift).astype(np.int64)
                first = np.ones(len(slot), bool)
                first[1:] = slot[1:] != slot[:-1]
                first[offsets[:-1]] = True
                total += np.bincount(slot[first], minlength=1 << bits)
        free_memory()
        if n:
            parts = [total[:0] + n, *np.split(total, PIECES)]
            parts[0] = np.array([n])
            yield pa.record_batch(
                {
                    "piece": pa.array(range(-1, PIECES), pa.int32()),
                    "lane": pa.array([TaskContext.get().partitionId() % LANES] * len(parts), pa.int32()),
                    "counts": pa.array([zlib.compress(x.astype("<i8").tobytes(), 1) for x in parts], pa.binary()),
                }
            )

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(zlib.decompress(x), "<i8") for x in frame["counts"])
        return frame.iloc[:1].assign(counts=[zlib.compress(total.tobytes(), 1)])

    schema = "piece int, lane int, counts binary"
    parts = rows.select("text").mapInArrow(count, schema)
    summed = parts.groupBy("piece", "lane").applyInPandas(add, schema).groupBy("piece").applyInPandas(add, schema)
    found = {row.piece: np.frombuffer(zlib.decompress(row.counts), "<i8") for row in summed.collect()}
    if not found:
        return np.zeros(1 << bits, np.int64), 0
    return np.concatenate([found[k] for k in range(PIECES)]), int(found[-1][0])


def idf_table(frequencies: np.ndarray, n: int, gain: float) -> np.ndarray:
    if n < 2:
        return np.ones(len(frequencies), np.float32)
    df = np.clip(frequencies, 1, n)
    return (1 + gain * np.log(n / df) / np.log(n)).astype(np.float32)


def signatures(rows: DataFrame, idf, params: Params) -> DataFrame:
    """rows(doc_id, rep, text) -> (doc_id, rep, keys): one key per band."""
    bands, per_band, shift = params.bands, params.rows, np.uint64(64 - params.df_bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, weights = Shingler(params.words, params.seed), idf.value
        salts = _salts(params.seed + 1, bands * per_band)
        mixers = _salts(params.seed + 2, per_band)
        for batch in batches:
            for a, b, texts in chunks(batch.column(2), CHUNK):
                hashes, tf, offsets = weighted(texts, shingler)
                sampler = Sampler(params.seed, hashes, tf * weights[(hashes >> shift).astype(np.int64)].astype(float), offsets)
                keys = np.zeros((bands, len(texts)), np.uint64)
                with np.errstate(over="ignore"):
                    for j, salt in enumerate(salts):
                        shingle, t = sampler(salt)
                        keys[j // per_band] += (shingle + t.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) * mixers[j % per_band]
                    keys ^= keys >> np.uint64(31)
                    keys *= np.uint64(0x94D049BB133111EB)
                    keys ^= keys >> np.uint64(29)
                ends = np.arange(0, keys.size + 1, bands, dtype=np.int32)
                listed = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(keys.T).view(np.int64).ravel()))
                yield pa.record_batch([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), listed], names=["doc_id", "rep", "keys"])
        free_memory()

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "rep", "text").mapInArrow(run, f"doc_id {kind}, rep binary, keys array<long>")


class Vectors:
    """Weighted shingles of some texts, and the exact overlaps of one of them with others."""

    def __init__(self, texts: list[str], shingler: Shingler, idf: np.ndarray, shift: np.uint64):
        hashes, tf, offsets = weighted(texts, shingler)
        self.weights = tf * idf[(hashes >> shift).astype(np.int64)].astype(float)
        kinds, self.ids = np.unique(hashes, return_inverse=True)
        self.begin, self.count = offsets[:-1], np.diff(offsets)
        self.total = np.add.reduceat(self.weights, self.begin)
        self.own = np.zeros(len(kinds))

    def overlaps(self, x: int, others: np.ndarray) -> np.ndarray:
        """The sum of the smaller weights of what text x shares with each of the others."""
        span = slice(self.begin[x], self.begin[x] + self.count[x])
        self.own[self.ids[span]] = self.weights[span]
        count = self.count[others]
        ids, weights = (gathered(v, self.begin[others], count) for v in (self.ids, self.weights))
        low = np.add.reduceat(np.minimum(self.own[ids], weights), np.cumsum(count) - count)
        self.own[self.ids[span]] = 0
        return low


def similarities(pairs: DataFrame, texts: DataFrame, idf, params: Params) -> DataFrame:
    """pairs(leader, rep) with `sim`, the weighted Jaccard similarity of their texts of texts(rep, text), `o`, the weight
    of what they share, and `w`, the weight of rep's text."""
    shift = np.uint64(64 - params.df_bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(params.words, params.seed)
        for batch in batches:
            leaders = batch.column(0).to_pylist()
            first = [i for i, x in enumerate(leaders) if not i or x != leaders[i - 1]]
            start = 0
            for i, j in zip(first, [*first[1:], len(leaders)]):
                lead = batch.column(2)[i].as_py()
                for a, b, own in chunks(batch.column(3).slice(i, j - i), CHUNK):
                    vectors = Vectors([lead, *own], shingler, idf.value, shift)
                    low, w = vectors.overlaps(0, np.arange(1, len(own) + 1)), vectors.total[1:]
                    numbers = [pa.array(x, pa.float64()) for x in (low / (vectors.total[0] + w - low), low, w)]
                    yield pa.record_batch([batch.column(0).slice(i + a, b - a), batch.column(1).slice(i + a, b - a), *numbers], names=["leader", "rep", "sim", "o", "w"])
        free_memory()

    joined = pairs.join(texts, "rep").join(texts.toDF("leader", "lead"), "leader").select("leader", "rep", "lead", "text")
    return joined.mapInArrow(run, "leader binary, rep binary, sim double, o double, w double")


def block_links(group: pa.Table, vectors: Vectors, i: int, j: int, threshold: float) -> list[tuple[int, int]]:
    """Rows (x, y) of group(block, root, o, w) that are linked, x in block i and y in block j: enough of them to join all
    components that links between the two blocks join."""
    block, o, w = (group.column(c).to_numpy() for c in ("block", "o", "w"))
    label = np.unique(np.array(group.column("root").to_pylist(), object).astype("S16"), return_inverse=True)[1]
    found = []
    order = np.argsort(-o, kind="stable")  # the leader's closest followers first
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    right = block == j
    for x in order[block[order] == i].tolist():
        most = np.minimum(o, o[x]) + np.minimum(w - o, w[x] - o[x])
        able = right & (label != label[x]) & (most >= (threshold - 1e-6) * (w + w[x] - most))
        if i == j:
            able &= rank > rank[x]
        others = np.flatnonzero(able)
        if not len(others):
            continue
        low = vectors.overlaps(x, others)
        linked = others[low / (vectors.total[x] + vectors.total[others] - low) >= threshold]
        kinds, first = np.unique(label[linked], return_index=True)
        found += [(x, y) for y in linked[first].tolist()]
        label[np.isin(label, kinds)] = label[x]
    return found


def apart(sims: DataFrame, known: DataFrame, texts: DataFrame, idf, params: Params) -> DataFrame:
    """Links (a, b) between followers of one leader that `known` leaves in different components."""
    shift = np.uint64(64 - params.df_bits)
    roots = known.select(F.col("node").alias("rep"), "root")
    # who equals the leader was compared with whom the leader was compared with
    placed = sims.where("sim < 1").join(roots, "rep", "left").select("leader", "rep", "o", "w", F.coalesce("root", "rep").alias("root"))
    led = roots.toDF("leader", "home")
    placed = placed.join(texts.select("rep", (F.length("text") + 256).alias("size")), "rep").join(led, "leader", "left")
    placed = staged(placed.select("leader", "rep", "o", "w", "root", "size", F.col("root").eqNullSafe(F.col("home")).alias("at_home")), "placed")
    size = lambda c: F.coalesce(F.sum(F.when(c, F.col("size"))), F.lit(0))
    leaders = placed.groupBy("leader").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), size(F.col("at_home")).alias("inside"), size(~F.col("at_home")).alias("outside")).where("r0 <> r1")
    blocks = lambda c: F.ceil(F.col(c) / params.block).cast("int")
    small = F.col("inside") + F.col("outside") <= params.block
    leaders = leaders.select("leader", small.alias("small"), F.when(small, 1).otherwise(blocks("outside")).alias("m"), F.when(small, 0).otherwise(blocks("inside")).alias("n"))
    # block pairs (i, j), i <= j, of m blocks of outside followers and n of inside ones, which come last as j only
    dealt = placed.join(leaders, "leader").withColumn("h", F.xxhash64("rep"))
    dealt = dealt.withColumn("block", F.when(F.col("small"), F.lit(0)).when(F.col("at_home"), F.expr("m + pmod(h, n)")).otherwise(F.expr("pmod(h, m)")).cast("int"))
    left = F.expr("CASE WHEN block < m THEN transform(sequence(block, m + n - 1), k -> struct(block AS i, k AS j)) ELSE array() END")
    right = F.expr("CASE WHEN least(block, m) > 0 THEN transform(sequence(0, least(block, m) - 1), k -> struct(k AS i, block AS j)) ELSE array() END")
    dealt = dealt.select("leader", "rep", "root", "o", "w", "block", F.explode(F.concat(left, right)).alias("at"))
    dealt = dealt.join(texts, "rep").select("leader", "at.i", "at.j", "rep", "root", "o", "w", "block", "text")
    kept: list[Shingler] = []

    def run(key: tuple, group: pa.Table) -> pa.Table:
        kept[:] = kept or [Shingler(params.words, params.seed)]
        vectors = Vectors(group.column("text").to_pylist(), kept[0], idf.value, shift)
        pairs = block_links(group, vectors, key[1].as_py(), key[2].as_py(), params.threshold)
        reps = group.column("rep")
        return pa.table({c: reps.take(pa.array([p[k] for p in pairs], pa.int64())) for k, c in enumerate("ab")})

    found = staged(dealt.groupBy("leader", "i", "j").applyInArrow(run, "a binary, b binary"), "more")
    discard(placed)
    return found


def links(reps: DataFrame, rows: DataFrame, idf, params: Params) -> DataFrame:
    """Verified links (a, b) of reps(rep, keys, first) that join each class; rows(doc_id, rep, text) has each one's text."""
    bucket = ["band", "key"]
    members = reps.select("rep", F.posexplode("keys").alias("band", "key"))
    shared = members.groupBy(*bucket).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = staged(members.join(shared, bucket), "shared")
    fame = shared.groupBy("rep").agg(F.sum("n").alias("fame"))
    # a text is taken from its first row: copies are dealt by their ids, not all to one task
    wanted = fame.select(F.col("rep").alias("r")).join(reps.select("rep", "first"), F.col("r") == F.col("rep")).select("r", "first")
    texts = rows.join(wanted, (F.col("rep") == F.col("r")) & F.col("doc_id").eqNullSafe(F.col("first")), "left_semi")
    texts = staged(texts.select("rep", "text").dropDuplicates(["rep"]), "candidates")
    state = shared.join(fame, "rep").select(*bucket, "rep", F.struct(-F.col("fame"), F.xxhash64("rep"), "rep").alias("rank"))
    lead = state.groupBy(*bucket).agg(F.min("rank").alias("rank")).select(*bucket, F.col("rank.rep").alias("leader"))
    led = state.join(lead, bucket).where("rep <> leader").select("leader", "rep").distinct()
    sims = staged(similarities(led, texts, idf, params), "sims")
    known = staged(components(sims.where(F.col("sim") >= params.threshold).select(F.col("leader").alias("a"), F.col("rep").alias("b"))), "known")
    more = apart(sims, known, texts, idf, params)
    found = staged(known.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more), "links")
    discard(shared, texts, sims, known, more)
    return found


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each connected component of edges(a, b).

    Large-star and small-star steps in turn, each written to the shared folder, until no edge changes.
    """
    now = staged(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    mark = None
    while True:
        before = now
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = staged(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = staged(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small")
        discard(before, large)
        last, mark = mark, now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == last:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def classes(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, rep, root, class_id, class_size), a row per row of docs.

    rep is the text's md5 and root the smallest one of the class.
    """
    rows = docs.select("doc_id", text_or_empty().alias("text")).withColumn("rep", F.unhex(F.md5(F.col("text").cast("binary"))))
    frequencies, n = document_frequencies(rows, params)
    idf = docs.sparkSession.sparkContext.broadcast(idf_table(frequencies, n, params.idf_gain))
    signed = staged(signatures(rows, idf, params), "signatures")
    reps = signed.groupBy("rep").agg(F.first("keys").alias("keys"), F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    reps = staged(reps, "reps")
    found = links(reps.drop("copies"), rows, idf, params)
    roots = components(found)
    groups = reps.select("rep", "first", "copies")
    rooted = staged(groups.join(roots, F.col("rep") == F.col("node"), "left").select("rep", F.coalesce("root", "rep").alias("root"), "first", "copies"), "roots")
    sizes = rooted.groupBy("root").agg(F.min("first").alias("class_id"), F.sum("copies").alias("class_size"))
    named = staged(rooted.select("rep", "root", "copies").join(sizes, "root"), "named")
    discard(found, reps, rooted)
    # texts of which there are more than a HOT-th of all rows number less than HOT: their rows join without a shuffle
    frequent = (F.col("copies") * HOT > n) & (F.col("copies") > 1)
    hot = F.broadcast(named.where(frequent).select("rep", *OUT))
    rest = signed.select("doc_id", "rep").join(hot.select("rep"), "rep", "left_anti").join(named.where(~frequent), "rep")
    return signed.select("doc_id", "rep").join(hot, "rep").select("doc_id", "rep", *OUT).unionByName(rest.select("doc_id", "rep", *OUT))


def deduplicated(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """One row of docs for each class: the row of its smallest id (of equal ids the one of the smallest text hash)."""
    columns = docs.columns
    docs, hidden = guarded(docs, "__nd_")
    key = F.unhex(F.md5(text_or_empty().cast("binary")))
    found = classes(docs, params).where(F.col("doc_id").eqNullSafe(F.col("class_id")))
    kept = found.groupBy("root").agg(F.min("rep").alias("__nd_rep"), F.first("class_id").alias("__nd_id")).drop("root")
    marked = docs.withColumn("__nd_key", key)
    joined = marked.join(kept, (F.col("__nd_key") == F.col("__nd_rep")) & F.col("doc_id").eqNullSafe(F.col("__nd_id")), "left_semi")
    return joined.dropDuplicates(["doc_id", "__nd_key"]).select(*docs.columns).withColumnsRenamed(hidden).select(*columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size")
