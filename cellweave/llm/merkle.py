"""A Merkle manifest of a dataset: one tree of leaves per source, and one tree over the sources.

A leaf is the sha256 of a row's fields, each written as its UTF-8 byte count, a colon and the value, or `-` if null. A
node is the sha256 of the texts of its (up to) `fan` consecutive children. Leaves of a source ascend by doc_id.

Rows are put in order by a range partitioning of (source, doc_id) that is written once; a row's place in its source
then follows from counts per partition and source, so no task holds a source, however large. The places are cut into
aligned buckets of fan ** height places. Executors load whole buckets as Arrow tables into a DuckDB of their own and
build the levels of all of them at once: an ordered string_agg and a sha256 per node and level. The roots of buckets are
the places of the next round, until every source has one node, its subroot; the subroots are a group of their own,
treated alike. On the way back each round's buckets meet the proofs of their roots (a row per bucket, dealt to the
same partition), and DuckDB makes the proofs of the places from them: siblings before and after the node, level by
level. Digests of the proofs, and the root folded from each row's present content with them, are made the same way.

Defined results: rows of one source and doc_id ascend by their leaf; a null doc_id comes first, as does the null
source; repeated rows are leaves of their own; an empty table gives an empty result; columns besides the fields play no
part. Texts and fields are whole. What rounds stage stays in the shared folder for the rows that are read from it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellweave.llm.common import discard, free_memory, partitions, staged, table

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


@dataclass(frozen=True)
class Params:
    fan: int = 3
    #: levels of a bucket: it has fan ** height places at most
    height: int = 6
    #: places that a task hands to DuckDB at once, at least, if it has as many
    batch: int = 20_000
    memory: str = "256MB"


def leaf(fields: dict[str, Column]) -> Column:
    """The digest of a row's fields, in their order."""
    parts = []
    for value in fields.values():
        text = value.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def placed(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows with place, from 0 in the order of `order` within `group`, and size, the group's rows; staged. Nulls come first.

    No task holds a group; what is joined are counts per partition and group.
    """
    dealt = rows.repartitionByRange(partitions(rows.sparkSession), group, order[0])
    ordered = staged(dealt.sortWithinPartitions(group, *order).withColumn("__at", F.monotonically_increasing_id()), "ordered")
    lane = F.shiftright("__at", 33)
    runs = ordered.groupBy(lane.alias("__lane"), group).agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    of = Window.partitionBy(group)
    before = F.coalesce(F.sum("__n").over(of.orderBy("__lane").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # a row per partition and group: a group has as many here as partitions
    starts = runs.select("__lane", F.col(group).alias("__k"), (before - F.col("__first")).alias("__shift"), F.sum("__n").over(of).alias("size"))
    joined = ordered.withColumn("__l", lane).join(starts, (F.col("__lane") == F.col("__l")) & F.col(group).eqNullSafe(F.col("__k")))
    out = staged(joined.select(*rows.columns, (F.col("__at") + F.col("__shift")).cast("long").alias("place"), "size"), "placed")
    discard(ordered)
    return out


def _levels(size: Column, params: Params) -> Column:
    """Levels that a bucket of a group of so many nodes has: as many as leave one node, `height` at most."""
    return F.least(F.lit(params.height), sum(((size > params.fan**k).cast("int") for k in range(params.height)), F.lit(0)))


def _deal(nodes: DataFrame, params: Params) -> DataFrame:
    """nodes(grp, place, size, ...) with bucket and levels, whole buckets to a partition and in order there."""
    return nodes.withColumns({"bucket": F.floor(F.col("place") / params.fan**params.height).cast("long"), "levels": _levels(F.col("size"), params)})


def _whole(batches: Iterator[pa.RecordBatch], params: Params) -> Iterator[pa.Table]:
    """Tables of whole buckets from batches that come in the order of (grp, bucket)."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows >= params.batch:
            # the last bucket may go on in the next batch
            both = pa.Table.from_batches(held).combine_chunks()
            grp, bucket = both.column("grp").to_pylist(), both.column("bucket").to_pylist()
            cut = both.num_rows - 1
            while cut > 0 and (grp[cut - 1], bucket[cut - 1]) == (grp[-1], bucket[-1]):
                cut -= 1
            if cut:
                yield both.slice(0, cut)
                held, rows = both.slice(cut).to_batches(), both.num_rows - cut
    if rows:
        yield pa.Table.from_batches(held)


def _engine(params: Params):
    import duckdb

    return duckdb.connect(":memory:", config={"threads": 1, "memory_limit": params.memory})


#: level 0 of the buckets: their nodes, numbered from the bucket's first place
NODES = "CREATE OR REPLACE TABLE n0 AS SELECT grp, bucket, levels, place % {span} AS i, hash FROM own"
#: a run of a level: its nodes' digests in order, as one text; runs that lie above a bucket's top are left out
RUNS = "CREATE OR REPLACE TABLE r{k} AS SELECT grp, bucket, levels, i // {fan} AS i, string_agg(hash, '' ORDER BY i) AS run FROM n{k} WHERE levels > {k} GROUP BY ALL"
NEXT = "CREATE OR REPLACE TABLE n{up} AS SELECT grp, bucket, levels, i, sha256(run) AS hash FROM r{k}"


def _build(con, params: Params) -> None:
    """Tables n0.. of nodes and r0.. of runs of the table `own`."""
    con.execute(NODES.format(span=params.fan**params.height))
    for k in range(params.height):
        con.execute(RUNS.format(k=k, fan=params.fan))
        con.execute(NEXT.format(k=k, up=k + 1))


def _cut(k: int, fan: int) -> str:
    """Siblings before and after node i // fan^k in its run, as texts of 64 letters a digest."""
    own = f"((o.i // {fan**k}) % {fan})"
    return f"left(r{k}.run, 64 * {own}::int) AS b{k}, substr(r{k}.run, 64 * ({own}::int + 1) + 1) AS a{k}"


def _joined(params: Params, columns: str) -> str:
    """The places with their siblings on all levels of the bucket."""
    fan, levels = params.fan, range(params.height)
    cuts = ", ".join(_cut(k, fan) for k in levels)
    joins = " ".join(f"LEFT JOIN r{k} ON r{k}.grp IS NOT DISTINCT FROM o.grp AND r{k}.bucket = o.bucket AND r{k}.i = o.i // {fan ** (k + 1)}" for k in levels)
    return f"SELECT {columns}, {cuts} FROM (SELECT *, place % {fan**params.height} AS i FROM own) o {joins}"


def bucket_roots(nodes: DataFrame, params: Params) -> DataFrame:
    """nodes(grp, place, size, hash) -> (grp, place, size, hash) of the roots of their buckets, staged."""
    kind, span = dict(nodes.dtypes)["grp"], params.fan**params.height

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _engine(params)
        for own in _whole(batches, params):
            con.register("own", own)
            _build(con, params)
            tops = " UNION ALL ".join(f"SELECT n{k}.grp, n{k}.bucket AS place, z.size, n{k}.hash FROM n{k} JOIN z ON z.grp IS NOT DISTINCT FROM n{k}.grp AND z.bucket = n{k}.bucket WHERE levels = {k}" for k in range(params.height + 1))
            con.execute("CREATE OR REPLACE TABLE z AS SELECT grp, bucket, max(size) AS size FROM own GROUP BY ALL")
            yield from _batches(con, tops, [("grp", own.schema.field("grp").type), ("place", pa.int64()), ("size", pa.int64()), ("hash", pa.string())])
            con.unregister("own")
        con.close()
        free_memory()

    dealt = _deal(nodes.select("grp", "place", "size", "hash"), params).withColumn("size", F.ceil(F.col("size") / span).cast("long"))
    dealt = dealt.repartition(partitions(nodes.sparkSession), "grp", "bucket").sortWithinPartitions("grp", "bucket")
    return staged(dealt.mapInArrow(run, f"grp {kind}, place long, size long, hash string"), "roots")


def _batches(con, sql: str, fields: list[tuple[str, pa.DataType]]) -> list[pa.RecordBatch]:
    return con.sql(sql).to_arrow_table().cast(pa.schema(fields)).to_batches()


STEPS = "array<struct<before:string,after:string>>"
ARROW_STEPS = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))


def _met(nodes: DataFrame, above: DataFrame, params: Params, schema: str, make) -> DataFrame:
    """Whole buckets and the proofs of their roots in one partition, handed to make(connection, places, params).

    above(grp, place, proof, top): a row per bucket; it is the table `upper`, nodes are the table `own` of the connection.
    """
    kinds = dict(nodes.dtypes)
    extra = [c for c in nodes.columns if c not in ("grp", "place", "size", "hash")]
    null = lambda kind: F.lit(None).cast(kind)
    own = _deal(nodes, params).select("grp", "bucket", "levels", "place", "hash", *extra, null(STEPS).alias("proof"), null("string").alias("top"))
    roots = above.select("grp", F.col("place").alias("bucket"), null("int").alias("levels"), null("long").alias("place"), null("string").alias("hash"), *[null(kinds[c]).alias(c) for c in extra], "proof", "top")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _engine(params)
        for both in _whole(batches, params):
            mark = pc.is_valid(both.column("place"))
            places = both.filter(mark).drop_columns(["proof", "top"])
            con.register("own", places)
            con.register("upper", both.filter(pc.invert(mark)).select(["grp", "bucket", "proof", "top"]))
            _build(con, params)
            yield from make(con, places, params)
            con.unregister("own")
            con.unregister("upper")
        con.close()
        free_memory()

    dealt = own.unionByName(roots).repartition(partitions(nodes.sparkSession), "grp", "bucket").sortWithinPartitions("grp", "bucket")
    return dealt.mapInArrow(run, schema)


UPPER = "LEFT JOIN upper u ON u.grp IS NOT DISTINCT FROM s.grp AND u.bucket = s.bucket"


def proofs(nodes: DataFrame, above: DataFrame, params: Params) -> DataFrame:
    """(grp, place, proof, top) of nodes: the siblings [(before, after)] level by level, and top of `above`; staged."""

    def make(con, places: pa.Table, params: Params) -> list[pa.RecordBatch]:
        inner = ", ".join(f"{{'before': b{k}, 'after': a{k}}}" for k in range(params.height))
        sql = f"SELECT s.grp, s.place, [{inner}][:s.levels] || coalesce(u.proof, []) AS proof, u.top FROM ({_joined(params, 'o.grp, o.bucket, o.place, o.levels')}) s {UPPER}"
        return _batches(con, sql, [("grp", places.schema.field("grp").type), ("place", pa.int64()), ("proof", ARROW_STEPS), ("top", pa.string())])

    return staged(_met(nodes, above, params, f"grp {dict(nodes.dtypes)['grp']}, place long, proof {STEPS}, top string", make), "proofs")


def verdicts(leaves: DataFrame, above: DataFrame, params: Params) -> DataFrame:
    """(doc_id, leaf, top, proof, folded) of leaves(grp, place, size, hash, doc_id, changed): the proof's digest, and the
    root that the leaf folds to with it, or its changed leaf where that isn't null."""

    def make(con, places: pa.Table, params: Params) -> list[pa.RecordBatch]:
        levels = range(params.height)
        con.execute(f"CREATE OR REPLACE TABLE s AS {_joined(params, 'o.grp, o.bucket, o.levels, o.doc_id, o.hash AS leaf, coalesce(o.changed, o.hash) AS h')}")
        inner = " || ".join(f"CASE WHEN levels > {k} THEN b{k} || a{k} ELSE '' END" for k in levels)
        outer = "array_to_string(list_transform(coalesce(u.proof, []), lambda x: x.before || x.after), '')"
        for k in levels:
            con.execute(f"UPDATE s SET h = sha256(b{k} || h || a{k}) WHERE levels > {k}")
        con.execute(f"CREATE OR REPLACE TABLE v AS SELECT s.doc_id, s.leaf, u.top, sha256({inner} || {outer}) AS proof, s.h, u.proof AS steps FROM s {UPPER}")
        for k in range(1, (con.sql("SELECT max(len(steps)) FROM v").fetchall()[0][0] or 0) + 1):
            con.execute(f"UPDATE v SET h = sha256(steps[{k}].before || h || steps[{k}].after) WHERE len(steps) >= {k}")
        fields = [("doc_id", places.schema.field("doc_id").type), *((c, pa.string()) for c in ("leaf", "top", "proof", "folded"))]
        return _batches(con, "SELECT doc_id, leaf, top, proof, h AS folded FROM v", fields)

    return _met(leaves, above, params, f"doc_id {dict(leaves.dtypes)['doc_id']}, leaf string, top string, proof string, folded string", make)


def climbed(nodes: DataFrame, params: Params) -> list[DataFrame]:
    """nodes and the roots of their buckets, round by round, until each group has one."""
    rounds = [nodes]
    while True:
        rounds.append(bucket_roots(rounds[-1], params))
        if (rounds[-1].agg(F.max("size")).first()[0] or 1) <= 1:
            return rounds


def manifest(docs: DataFrame, tampered: Column | None = None, params: Params = Params()) -> tuple[DataFrame, str]:
    """((doc_id, leaf, subroot, root, proof_sha256, folded_root, verified), root) of docs with the columns FIELDS.

    tampered: what the texts are at the time of verification; None: as they are.
    """
    fields = {c: F.col(c) for c in FIELDS}
    original = leaf(fields)
    now = original if tampered is None else leaf(fields | {"text": tampered})
    rows = staged(docs.select("doc_id", F.col("source").cast("string").alias("grp"), original.alias("hash"), now.alias("now")), "leaves")
    rows = rows.select("doc_id", "grp", "hash", F.when(F.col("now") != F.col("hash"), F.col("now")).alias("changed"))
    leaves = placed(rows, "grp", ["doc_id", "hash"])
    rounds = climbed(leaves, params)
    tops = rounds[-1].select(F.lit(0).alias("grp"), F.col("grp").alias("source"), "hash")
    sources = placed(tops, "grp", ["source"])
    outer = climbed(sources.select("grp", "place", "size", "hash"), params)
    root = outer[-1].first()
    above = outer[-1].select("grp", "place", F.array().cast(STEPS).alias("proof"), F.lit(None).cast("string").alias("top"))
    for nodes in reversed(outer[:-1]):
        above = proofs(nodes, above, params)
    # a row per source: its proof, as that of the last round's only place
    named = sources.select("source", "hash", F.col("place").alias("at"))
    above = above.join(named, F.col("place") == F.col("at")).select(F.col("source").alias("grp"), F.lit(0).cast("long").alias("place"), "proof", F.col("hash").alias("top"))
    for nodes in reversed(rounds[1:-1]):
        above = proofs(nodes, above, params)
    digest = "" if root is None else root.hash
    found = verdicts(leaves, above, params)
    out = found.select("doc_id", "leaf", F.col("top").alias("subroot"), F.lit(digest).alias("root"), F.col("proof").alias("proof_sha256"), F.col("folded").alias("folded_root"), (F.col("folded") == digest).alias("verified"))
    return out, digest


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; where 2 divides the crc32 of the doc_id the text has lost its line breaks when it is verified."""
    even = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    tampered = F.when(even, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return manifest(table(spark, sf_dir, "documents"), tampered)[0]
