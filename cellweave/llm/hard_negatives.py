"""Hard negatives by a block matrix product in two dimensions.

All rows are multiplied with the anchors. Rows are put in the order of their labels and written as blocks of at most
`rows` rows, in whole numbers of as few bytes as they need; the anchors likewise in blocks of at most `anchors` rows. Both
are dealt to the cells of a grid: a block of anchors to all cells of its line, a block of rows to all cells of its column.
A tile is the product of a block of anchors and a block of rows; it is made where the two meet, as the sum of partial tiles
of `width` dimensions, and never leaves its task. A cell keeps the best rows of each of its anchors while blocks of rows
pass by; what leaves it are these, which windows over (anchor) or (anchor, positive) then reduce.

So what is shuffled are the rows, once per line of the grid, the anchors, once per column, and the few best rows of each
anchor and cell. The grid has as many lines as the anchors need to fit `held` bytes each, and some cells for each core.

Every tile is made once or, if its blocks share a label and aren't of that label alone, twice: first the tiles whose
blocks share a label yield the positives, then all that have different labels yield the negatives, by the bounds that
each positive sets. The bounds travel with the blocks of anchors.

Defined results: rows with a null id, label or vector, or a null or non-finite component, take no part. Components
are cut to whole numbers of 64 bits; where a product's sum could pass 2^53 it is made in whole numbers, which wrap at
64 bits. Of vectors of unequal lengths the missing components count as 0. Rows of one id are rows of their own: they may
be each other's positives; ties go by id, then by the order of the rows. An empty table, or one without anchors, gives an
empty result; columns besides the three play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellweave.llm.common import discard, free_memory, partitions, staged, table


@dataclass(frozen=True)
class Params:
    #: rows of a block of anchors and of a block of rows: a tile holds anchors * rows numbers of 8 bytes at most
    anchors: int = 128
    rows: int = 1024
    #: dimensions of a partial tile
    width: int = 64
    #: bytes of the anchors of a cell with the rows that it keeps for them
    held: int = 256 << 20
    #: cells of the grid for each core
    cells: int = 4
    positives: int = 5
    negatives: int = 5
    #: least and most of a negative's score, in hundredths of the positive's
    least: int = 80
    most: int = 100


def usable(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """(id, label, q) of the rows that take part, with the contract's change of labels left to the caller."""
    bad = F.exists(F.col(vector), lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    q = F.transform(F.col(vector), lambda x: F.floor(F.lit(256.0) * x.cast("double")).cast("long"))
    return df.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col(vector).isNotNull()).where(~bad).select("id", "label", q.alias("q"))


def blocks(rows: DataFrame, size: int, dims: int, name: str) -> DataFrame:
    """(block, lo, hi, ids, labels, marks, data) of rows(id, label, mark, q), staged: runs of at most `size` rows in the
    order of (label, id, mark). lo and hi: its labels' bounds."""
    spark = rows.sparkSession

    def cut(held: list[pa.RecordBatch], number: int) -> pa.RecordBatch:
        own = pa.Table.from_batches(held)
        ids, labels, marks = (own.column(c).to_numpy() for c in ("id", "label", "mark"))
        lists = own.column("q").combine_chunks()
        lengths = np.diff(np.asarray(lists.offsets))
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        q = np.zeros((len(ids), dims), np.int64)
        at = np.repeat(np.arange(len(ids)), lengths)
        q[at, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
        order = np.lexsort((marks, ids))
        q, ids, labels, marks = q[order], ids[order], labels[order], marks[order]
        whole = [x.astype("<i8").tobytes() for x in (ids, labels, marks)]
        kind = next(k for k in KINDS if np.iinfo(k).min <= q.min(initial=0) and q.max(initial=0) <= np.iinfo(k).max)
        return pa.record_batch([pa.array([x], k) for x, k in zip((number, int(labels.min()), int(labels.max()), *whole, q.astype(kind).tobytes()), [pa.int64()] * 3 + [pa.binary()] * 4)], names=NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, number, first = [], 0, 0, None
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                if first is None:
                    first = int(batch.column("part")[0].as_py()) << 33
                take = min(size - n, batch.num_rows - at)
                held.append(batch.slice(at, take))
                n, at = n + take, at + take
                if n == size:
                    yield cut(held, first + number)
                    held, n, number = [], 0, number + 1
        if n:
            yield cut(held, first + number)
        free_memory()

    ordered = rows.repartitionByRange(partitions(spark), "label", "id", "mark").sortWithinPartitions("label", "id", "mark")
    return staged(ordered.withColumn("part", F.spark_partition_id()).mapInArrow(run, BLOCKS), name)


KINDS = ("<i1", "<i2", "<i4", "<i8")
NAMES = ["block", "lo", "hi", "ids", "labels", "marks", "data"]
BLOCKS = "block long, lo long, hi long, ids binary, labels binary, marks binary, data binary"


def numbered(pieces: DataFrame) -> tuple[DataFrame, int]:
    """pieces with `at`, their number from 0 in the order of blocks, and how many there are. The numbers of blocks,
    a row per `size` rows, are found per partition and added up."""
    counts = pieces.select(F.shiftright("block", 33).alias("part")).groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # a row per partition
    starts = F.broadcast(counts.select(F.col("part").alias("__p"), before.alias("__b")))
    out = pieces.join(starts, F.shiftright("block", 33) == F.col("__p"))
    at = (F.col("__b") + F.col("block").bitwiseAND((1 << 33) - 1)).cast("long")
    return out.withColumn("at", at).drop("__p", "__b", "block"), int(counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])


class Block:
    """A block of rows in a task, its matrix in each kind of number that products ask for."""

    def __init__(self, batch: pa.RecordBatch, at: int):
        self.lo, self.hi = (batch.column(c)[at].as_py() for c in ("lo", "hi"))
        self.ids, self.labels, self.marks, self.bounds = (np.frombuffer(batch.column(c)[at].as_py() or b"", "<i8") for c in ("ids", "labels", "marks", "bounds"))
        data = batch.column("data")[at].as_py()
        size = len(data) // (len(self.ids) or 1)
        dims = batch.column("dims")[at].as_py()
        self.q = np.frombuffer(data, KINDS[(size // (dims or 1)).bit_length() - 1 if dims else 0]).reshape(len(self.ids), dims)
        self.top, self.made = max(int(self.q.max(initial=0)), -int(self.q.min(initial=0))), {}

    def matrix(self, kind: type) -> np.ndarray:
        if kind not in self.made:
            self.made[kind] = self.q.astype(kind)
        return self.made[kind]


#: of the kinds of numbers in which products are made: below this every whole number is exact
EXACT = {np.float32: 1 << 24, np.float64: 1 << 53}


def product(a: Block, b: Block, width: int) -> np.ndarray:
    """a times b transposed in whole numbers, the sum of the partial tiles of `width` dimensions: by floating point while every
    sum is sure to be exact there."""
    dims = a.q.shape[1]
    kind = next((k for k, most in EXACT.items() if a.top * b.top * dims < most), np.int64)
    left, right = a.matrix(kind), b.matrix(kind)
    total = left[:, :width] @ right[:, :width].T
    for k in range(width, dims, width):
        total += left[:, k : k + width] @ right[:, k : k + width].T
    return total


class Best:
    """The best rows of each slot of a block of anchors, while blocks of rows pass by: of an anchor its rows of the same label,
    or of an anchor and positive the rows of other labels within the positive's bounds."""

    def __init__(self, block: Block, same: bool, params: Params):
        self.block, self.same, self.width = block, same, params.width
        lines = len(block.ids)
        if same:
            self.n, self.line = params.positives, np.arange(lines)
            self.bar, self.most = np.full(lines, np.iinfo(np.int64).min), None
        else:
            # per positive: the anchor's line, its id, mark and score, and the least and most of a negative's score
            self.bounds = block.bounds.reshape(-1, 6)
            self.n, self.line = params.negatives, self.bounds[:, 0]
            self.bar, self.most = self.bounds[:, 4].copy(), self.bounds[:, 5]
        self.first = np.searchsorted(self.line, np.arange(lines))
        self.count = np.searchsorted(self.line, np.arange(lines), side="right") - self.first
        self.slot = self.score = self.id = self.mark = np.zeros(0, np.int64)
        self._lines()

    def _lines(self) -> None:
        """The least and most score of each anchor that may still count."""
        self.least = np.full(len(self.count), np.iinfo(np.int64).max)
        np.minimum.at(self.least, self.line, self.bar)
        if self.most is not None:
            self.highest = np.full(len(self.count), np.iinfo(np.int64).min)
            np.maximum.at(self.highest, self.line, self.most)

    def meet(self, other: Block) -> None:
        own = self.block
        if not len(self.line) or (not (own.lo <= other.hi and other.lo <= own.hi) if self.same else own.lo == own.hi == other.lo == other.hi):
            return
        tile = product(own, other, self.width)
        edge = EXACT.get(tile.dtype.type)
        bound = lambda x: (x if edge is None else np.clip(x, -edge, edge)).astype(tile.dtype)[:, None]
        ok = tile >= bound(self.least)
        if self.most is not None:
            ok &= tile <= bound(self.highest)
        if not (own.lo == own.hi == other.lo == other.hi) and (self.same or (own.lo <= other.hi and other.lo <= own.hi)):
            ok &= (own.labels[:, None] == other.labels[None, :]) == self.same
        line, column = np.divmod(np.flatnonzero(ok), len(other.ids))
        if self.same:
            others = own.marks[line] != other.marks[column]
            line, column = line[others], column[others]
        if not len(line):
            return
        score = tile[line, column].astype(np.int64)
        # an anchor's slots stand one after another
        times = self.count[line]
        slot = np.repeat(self.first[line] - np.cumsum(times) + times, times) + np.arange(times.sum())
        score, column = np.repeat(score, times), np.repeat(column, times)
        fits = score >= self.bar[slot]
        if self.most is not None:
            fits &= score <= self.most[slot]
        if fits.any():
            self._keep(slot[fits], score[fits], other.ids[column[fits]], other.marks[column[fits]])

    def _keep(self, *new: np.ndarray) -> None:
        slot, score, ids, marks = (np.concatenate(x) for x in zip((self.slot, self.score, self.id, self.mark), new))
        order = np.lexsort((marks, ids, ~score, slot))
        slot = slot[order]
        rank = np.arange(len(slot)) - np.searchsorted(slot, slot)
        kept = order[rank < self.n]
        self.slot, self.score, self.id, self.mark = slot[rank < self.n], score[kept], ids[kept], marks[kept]
        last = rank[rank < self.n] == self.n - 1
        self.bar[self.slot[last]] = self.score[last]
        self._lines()

    def rows(self) -> pa.RecordBatch:
        line = self.line[self.slot]
        out = {"anchor": self.block.marks[line], "anchor_id": self.block.ids[line]}
        if not self.same:
            out |= {c: self.bounds[self.slot, k] for k, c in enumerate(("positive", "pmark", "pscore"), 1)}
        return pa.record_batch({c: pa.array(x, pa.int64()) for c, x in (out | {"id": self.id, "mark": self.mark, "score": self.score}).items()})


def grid(n_left: int, n_right: int, dims: int, cores: int, params: Params) -> tuple[int, int]:
    """Lines and columns of cells. An anchor is held with its matrix and its best rows, and leaves some 13 times as many bytes in a
    column as a hundred rows do in a line: so as not to deal more than need be, there are as many more columns than lines."""
    each = params.anchors * (10 * dims + 40 * params.positives * params.negatives)
    cells = params.cells * cores
    lines = min(max(-(-n_left * each // params.held), math.isqrt(cells // 13), 1), n_left)
    return lines, min(max(-(-cells // lines), 1), n_right)


def met(left: DataFrame, right: DataFrame, shape: tuple[int, int], dims: int, same: bool, params: Params) -> DataFrame:
    """The best rows of each anchor (same: of its label; else of others, by its bounds) in each cell of the grid."""
    lines, columns = shape
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    part = ["at", "lo", "hi", "ids", "labels", "marks", "bounds", "data", F.lit(dims).alias("dims")]
    a = left.select((F.col("at") % lines).alias("i"), every(columns).alias("j"), F.lit(0).alias("side"), *part)
    b = right.withColumn("bounds", F.lit(None).cast("binary")).select(every(lines).alias("i"), (F.col("at") % columns).alias("j"), F.lit(1).alias("side"), *part)
    dealt = a.unionByName(b).repartition(max(partitions(left.sparkSession), lines * columns), "i", "j").sortWithinPartitions("i", "j", "side", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, []
        for batch in batches:
            for at, (i, j, side) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("i", "j", "side")))):
                if (i, j) != cell:
                    yield from (x.rows() for x in held)
                    cell, held = (i, j), []
                block = Block(batch, at)
                if side == 0:
                    held.append(Best(block, same, params))
                else:
                    for x in held:
                        x.meet(block)
        yield from (x.rows() for x in held)
        free_memory()

    more = "" if same else "positive long, pmark long, pscore long, "
    return dealt.mapInArrow(run, f"anchor long, anchor_id long, {more}id long, mark long, score long")


def mined(rows: DataFrame, anchor: Column, params: Params = Params()) -> DataFrame:
    """rows(id, label, q) -> (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    anchor: which rows are anchors.
    """
    rows = staged(rows.select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), "q").withColumn("mark", F.monotonically_increasing_id()), "vectors")
    dims = rows.agg(F.coalesce(F.max(F.size("q")), F.lit(0))).first()[0]
    right, n_right = numbered(blocks(rows, params.rows, dims, "rows"))
    left, n_left = numbered(blocks(rows.where(anchor), params.anchors, dims, "anchors"))
    discard(rows)
    if not n_left:
        return rows.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    shape = grid(n_left, n_right, dims, rows.sparkSession.sparkContext.defaultParallelism, params)
    found = met(left.withColumn("bounds", F.lit(None).cast("binary")), right, shape, dims, True, params)
    top = Window.partitionBy("anchor").orderBy(F.desc("score"), "id", "mark")
    positives = found.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= params.positives)
    near = met(with_bounds(left, positives, params), right, shape, dims, False, params)
    window = Window.partitionBy("anchor", "pmark").orderBy(F.desc("score"), "id", "mark")
    kept = near.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= params.negatives)
    return kept.select("anchor_id", F.col("positive").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("pscore").alias("positive_score"), F.col("score").alias("negative_score"))


def with_bounds(left: DataFrame, positives: DataFrame, params: Params) -> DataFrame:
    """left with `bounds`: the positives of a block's anchors (line, id, mark, score, the least and most of a negative's score), in the
    order of lines; staged. A block has at most anchors * positives of them."""
    top = np.iinfo(np.int64).max
    held = lambda x: max(min(x, top), -top - 1)

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, marks in zip(batch.column("at").to_pylist(), batch.column("marks").to_pylist()):
                own = np.frombuffer(marks, "<i8")
                yield pa.record_batch([pa.array(np.full(len(own), at)), pa.array(own), pa.array(np.arange(len(own)))], names=["at", "anchor", "line"])

    where = left.select("at", "marks").mapInArrow(lines, "at long, anchor long, line long")
    rows = positives.join(where, "anchor").groupBy("at").agg(F.sort_array(F.collect_list(F.struct("line", "rank", "id", "mark", "score"))).alias("own"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [np.array([[r["line"], r["id"], r["mark"], r["score"], held(-(-params.least * r["score"] // 100)), held(params.most * r["score"] // 100)] for r in own], "<i8").tobytes() for own in batch.column("own").to_pylist()]
            yield pa.record_batch([batch.column("at"), pa.array(data, pa.binary())], names=["__at", "bounds"])

    bounds = rows.mapInArrow(packed, "__at long, bounds binary")
    out = left.join(bounds, F.col("at") == F.col("__at"), "left").drop("__at")
    return staged(out, "bounds")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors are the rows whose vec_id is divisible by 100; those divisible by 7 get the next label."""
    raw = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", "embedding")
    label = F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mined(usable(raw.withColumn("label", label)), F.col("id") % 100 == 0)
