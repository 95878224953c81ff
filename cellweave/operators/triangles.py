"""Counts of three-node motifs of a graph of whole numbers without colors, for graphs whose pairs of neighbours fill disks.

Nodes are in GROUPS groups by a hash. Edges are packed by the groups of their ends into compressed pieces of some bytes an
edge. Then groups are gathered into parts, so many that the edges between three parts fit a task, and pieces are dealt to
cells: one for each three parts, which counts the triangles with a node in each, and one for each two, which counts those in
both and, for one pair of each part, those in one. A cell directs its edges from the lower to the higher (degree, place) and
looks up the third edge of what two neighbours span, so a hub costs its degree. An edge is dealt to as many cells as there are
parts less one; pairs of neighbours exist in tasks only. Degrees are packed and added up by group.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.plans.lineage import discard, written

GROUPS = 64
#: edges that are packed at a time, and that a cell may have
RUN, CELL = 1 << 21, 12_000_000
#: wedges that are looked up at a time, and what a mark of a neighbour keeps of its number
WEDGES, SLOTS = 1 << 22, 1 << 12
PACKED = "a int, b int, n long, data binary"


def group_of(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        mixed = x.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return (mixed >> np.uint64(58)).astype(np.int64)


def squeezed(*columns: np.ndarray) -> bytes:
    """Columns of whole numbers of one length, the first ascending, in few bytes."""
    out = []
    for k, x in enumerate(columns):
        low = int(x[0]) if k == 0 else int(x.min())
        rest = np.diff(x, prepend=x[:1]) if k == 0 else x - low
        # of a difference beyond 63 bits the wrapped number is kept, and adding wraps back
        kind = next(t for t in "BHIq" if t == "q" or (rest.min() >= 0 and rest.max() <= np.iinfo(t).max))
        out.append((kind, low, zlib.compress(rest.astype(np.dtype(kind).newbyteorder("<")).tobytes(), 1)))
    return b"".join(kind.encode() + low.to_bytes(8, "little", signed=True) + len(data).to_bytes(8, "little") + data for kind, low, data in out)


def unsqueezed(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        kind, low = chr(data[at]), int.from_bytes(data[at + 1 : at + 9], "little", signed=True)
        size = int.from_bytes(data[at + 9 : at + 17], "little")
        rest = np.frombuffer(zlib.decompress(data[at + 17 : at + 17 + size]), np.dtype(kind).newbyteorder("<")).astype(np.int64)
        out.append((np.cumsum(rest) if not out else rest) + np.int64(low))
        at += 17 + size
    return out


def packed(edges: DataFrame) -> DataFrame:
    """Pieces (a, b, n, data) of distinct edges(source, target): n edges from group a to group b, or with b = -1 the numbers of
    edges at n nodes of group a."""

    def pack(x: np.ndarray, y: np.ndarray) -> Iterator[pa.RecordBatch]:
        g, h = group_of(x), group_of(y)
        turned = (g > h) | ((g == h) & (x > y))
        x, y = np.where(turned, y, x), np.where(turned, x, y)
        block = np.minimum(g, h) * GROUPS + np.maximum(g, h)
        order = np.lexsort((y, x, block))
        x, y, block = x[order], y[order], block[order]
        ends, degree = np.unique(np.concatenate([x, y]), return_counts=True)
        own = group_of(ends)
        order = np.argsort(own, kind="stable")
        rows = []
        for key, columns in ((block, (x, y)), (own[order] * GROUPS, (ends[order], degree[order]))):
            cuts = np.flatnonzero(np.diff(key, prepend=-1))
            for s, e in zip(cuts.tolist(), [*cuts[1:].tolist(), len(key)]):
                rows.append((int(key[s]) // GROUPS, int(key[s]) % GROUPS if key is block else -1, e - s, squeezed(*(c[s:e] for c in columns))))
        for s in range(0, len(rows), 256):
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows[s : s + 256]), (pa.int32(), pa.int32(), pa.int64(), pa.binary()))], names=["a", "b", "n", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append([batch.column(c).to_numpy() for c in (0, 1)])
            n += batch.num_rows
            if n >= RUN:
                yield from pack(*map(np.concatenate, zip(*held)))
                held, n = [], 0
        if n:
            yield from pack(*map(np.concatenate, zip(*held)))

    return edges.select("source", "target").mapInArrow(run, PACKED)


def count_triangles(pieces: list[bytes]) -> int:
    """Triangles of the distinct edges of some pieces."""
    if not pieces:
        return 0
    nodes = np.unique(np.concatenate([np.unique(np.concatenate([x[np.diff(x, prepend=x[0] - 1) != 0], np.unique(y)])) for x, y in map(unsqueezed, pieces)]))
    ends = [np.concatenate(c) for c in zip(*([np.searchsorted(nodes, c).astype(np.int32) for c in unsqueezed(p)] for p in pieces))]
    n = len(nodes)
    degree = np.bincount(ends[0], minlength=n) + np.bincount(ends[1], minlength=n)
    rank = np.empty(n, np.int64)
    rank[np.argsort(degree, kind="stable")] = np.arange(n)
    first, second = (rank[c] for c in ends)
    key = (np.minimum(first, second) << 32) | np.maximum(first, second)
    del first, second, ends
    key.sort()
    low, high = (key >> 32).astype(np.int32), key.astype(np.int32)
    start = np.searchsorted(low, np.arange(n + 1, dtype=np.int32))
    out = np.diff(start)
    work = np.cumsum(out[high])
    marks = np.zeros((1024, SLOTS), bool)
    found, s, m = 0, 0, len(key)
    while s < m:
        u = int(low[s])
        e = min(int(np.searchsorted(work, (work[s - 1] if s else 0) + WEDGES, "right")), int(start[min(u + len(marks), n)]))
        e = max(e, s + 1)
        last = int(start[low[e - 1] + 1])
        at = slice(int(start[u]), last)
        marks[low[at] - u, high[at] & (SLOTS - 1)] = True
        many = out[high[s:e]]
        total = int(many.sum())
        if total:
            w = high[np.arange(total) + np.repeat(start[high[s:e]] - np.cumsum(many) + many, many)]
            of = np.repeat(low[s:e] - u, many)
            near = np.flatnonzero(marks.ravel()[of * SLOTS + (w & (SLOTS - 1))])
            third = ((of[near].astype(np.int64) + u) << 32) | w[near]
            own = key[at]
            place = np.minimum(np.searchsorted(own, third), len(own) - 1)
            found += int((own[place] == third).sum())
        marks[low[at] - u, high[at] & (SLOTS - 1)] = False
        s = e
    return found


def triangle_counts(pieces: DataFrame, parts: int, tasks: int) -> DataFrame:
    """(n): triangles by cell."""
    part = lambda c: F.expr(f"{c} * {parts} div {GROUPS}").cast("int")
    blocks = pieces.where("b >= 0").select(part("a").alias("p"), part("b").alias("q"), "data")
    cells = f"transform(sequence(0, {parts - 1}), x -> CASE WHEN p = q AND x = p AND {parts} > 1 THEN null WHEN p < q AND x = p THEN null WHEN x = q THEN array(p, q, {parts}) WHEN p = q THEN array_sort(array(p, x, {parts})) ELSE array_sort(array(p, q, x)) END)"
    dealt = blocks.select("p", "q", "data", F.explode(F.filter(F.expr(cells), lambda x: x.isNotNull())).alias("cell"))
    dealt = dealt.repartition(tasks, "cell").sortWithinPartitions("cell")

    def count(cell: list[int], held: list[tuple]) -> pa.RecordBatch:
        found = count_triangles([d for _, _, d in held])
        if cell[2] == parts:
            # triangles within one part are counted in the cell of this part and the next
            for one, other in {(cell[0], cell[1]), (cell[1], cell[0])}:
                if (one + 1) % parts != other:
                    found -= count_triangles([d for p, q, d in held if p == q == one])
        return pa.record_batch([pa.array([found])], names=["n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, []
        for batch in batches:
            for p, q, data, own in zip(*(batch.column(c).to_pylist() for c in ("p", "q", "data", "cell"))):
                if own != cell:
                    if held:
                        yield count(cell, held)
                    cell, held = own, []
                held.append((p, q, data))
        if held:
            yield count(cell, held)

    return dealt.mapInArrow(run, "n long")


def node_sums(pieces: DataFrame, nodes: DataFrame, tasks: int) -> DataFrame:
    """(paths, unknown) by group: pairs of neighbours of its nodes, and how many of its nodes nodes(id) lacks."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.unique(batch.column(0).to_numpy())
            g = group_of(x)
            own = [(int(k), -2, int((g == k).sum()), squeezed(x[g == k])) for k in np.unique(g)]
            if own:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*own), (pa.int32(), pa.int32(), pa.int64(), pa.binary()))], names=["a", "b", "n", "data"])

    def done(held: list[tuple]) -> pa.RecordBatch:
        known = [unsqueezed(d)[0] for b, d in held if b == -2]
        ends = [unsqueezed(d) for b, d in held if b == -1]
        paths, unknown = 0, 0
        if ends:
            ids, place = np.unique(np.concatenate([x for x, _ in ends]), return_inverse=True)
            degree = np.zeros(len(ids), np.int64)
            np.add.at(degree, place, np.concatenate([d for _, d in ends]))
            paths = int((degree * (degree - 1) // 2).sum())
            unknown = int((~np.isin(ids, np.concatenate(known))).sum()) if known else len(ids)
        return pa.record_batch([pa.array([paths]), pa.array([unknown])], names=["paths", "unknown"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []
        for batch in batches:
            for a, b, data in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "data"))):
                if a != group:
                    if held:
                        yield done(held)
                    group, held = a, []
                held.append((b, data))
        if held:
            yield done(held)

    known = nodes.select(F.col("id").cast("long").alias("id")).where("id IS NOT NULL").mapInArrow(pack, PACKED)
    both = pieces.where("b = -1").unionByName(known).select("a", "b", "data")
    return both.repartition(min(tasks, GROUPS), "a").sortWithinPartitions("a").mapInArrow(run, "paths long, unknown long")


def number_catalog(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(topology, count) of nodes(id) and edges(source, target), whole numbers in any order and number; edges that end in no
    node are left out."""
    spark = edges.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    plain = edges.where("source <> target").select(F.least("source", "target").cast("long").alias("source"), F.greatest("source", "target").cast("long").alias("target")).distinct()
    pieces = written(packed(plain), "pieces")
    paths, unknown = node_sums(pieces, nodes, tasks).agg(F.coalesce(F.sum("paths"), F.lit(0)), F.coalesce(F.sum("unknown"), F.lit(0))).first()
    if unknown:
        discard(pieces)
        for c in ("source", "target"):
            plain = plain.join(nodes.select(F.col("id").cast("long").alias(c)), c, "left_semi")
        pieces = written(packed(plain), "pieces")
        paths = node_sums(pieces, nodes, tasks).agg(F.coalesce(F.sum("paths"), F.lit(0))).first()[0]
    m = pieces.where("b >= 0").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    parts = min(max(math.isqrt(max(6 * m // CELL - 1, 0)) + 1, 1), GROUPS)
    closed = triangle_counts(pieces, parts, tasks).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("closed"))
    counts = F.explode(F.array(F.struct(F.lit("wedge").alias("topology"), (F.lit(paths) - 3 * F.col("closed")).alias("count")), F.struct(F.lit("triangle").alias("topology"), F.col("closed").alias("count"))))
    return closed.select(counts.alias("c")).select("c.topology", "c.count").where("count > 0")
