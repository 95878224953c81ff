"""Rule-based quality filter whose cutoffs carry a statistical guarantee.

Every document gets counts of words, symbols, repeated lines and repeated three-word windows. A base rule
rejects the very short and the mostly repeated. Beyond that every rule has a ladder of cutoffs; a document's
severity is the highest rung that one of its measures passes. Per length stratum the rung from which documents
are rejected is taken from labelled documents: for a rung with k of n good documents on it or above, the exact
binomial probability P(Bin(n, a) <= k) is the p-value of "this rung falsely rejects more than a share a". Rungs
are tested from the loosest to the strictest and testing stops at the first that fails (a fixed sequence needs
no correction inside it); across strata the level is divided (Bonferroni). Of the certified rungs the one that
best separates bad from good is used; a stratum in which none can be certified rejects nothing.

Everything here is DataFrame functions: per-row array functions for the counts, no shuffle of texts; only
measures are shuffled to their labels, and a histogram per stratum. A filter stages documents with their measures
once, certifies from the measures and reads the documents again.

Defined results: a null text counts as empty (all counts 0, base_failed). Rows are judged one by one, so repeated
rows, ties and repeated ids give equal verdicts. Without labels only the base rule rejects. Columns of the input
are kept as they are, whatever their names; the internal columns carry the prefix `__qr_`, and with_measures() alone
replaces columns of such names.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellweave.llm.common import ROW_GROUP, guarded, small_scans, staged, table

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
P = "__qr_"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rules:
    """max_false_reject: share of good documents of a stratum that may be rejected; delta: risk that this fails.

    bands: lower word counts of the length strata. cutoffs: per rule a ladder from strict to loose, all of one
    length. good_weight: a rejected share of good documents weighs so many times a rejected share of bad ones
    when one of the certified rungs is picked.
    """

    max_false_reject: float = 0.01
    delta: float = 0.05
    bands: tuple[int, ...] = (0, 250, 700)
    good_weight: float = 20.0
    cutoffs: tuple[tuple[str, tuple[float, ...]], ...] = (
        ("symbols", (0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.75, 1.0)),
        ("dup_lines", (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8)),
        ("repeats", (0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4)),
        ("capitals", (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8)),
    )


def with_measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the columns `__qr_<count>`; the repeated windows are found by sorting 64-bit keys per document.

    A key holds a window's hash above and its position below, so one primitive sort brings equal windows
    together. Whether windows of equal hash are equal is told by their words: of a neighbour in the order of keys, and
    if that differs of all keys of the hash.
    """
    col = lambda name: f"{P}{name}"
    df = docs.drop(*[c for c in docs.columns if c.startswith(P)])
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    trimmed = F.btrim(body, F.lit(SPACES))
    df = df.withColumn(col("words"), F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[ \t-\r]+")))
    df = df.withColumn(col("n_words"), F.size(col("words")).cast("long"))
    df = df.withColumn(col("m"), F.coalesce(F.col(col("n_words")) - 2, F.lit(0)).cast("int"))
    df = df.withColumn(col("bits"), F.coalesce(F.length(F.bin(F.greatest(F.col(col("m")), F.lit(1)).cast("long"))), F.lit(1)))
    place = lambda x: f"cast({x} & (shiftleft(1L, {P}bits) - 1) as int)"
    alike = lambda y: f"shiftright({y}, {P}bits) = shiftright(x, {P}bits)"
    same = lambda y: f"{alike(y)} AND " + " AND ".join(f"{P}words[{place('x')} + {k}] = {P}words[{place(y)} + {k}]" for k in range(3))
    df = df.withColumn(
        col("keys"),
        F.expr(
            f"""CASE WHEN {P}m < 2 THEN cast(array() as array<bigint>) ELSE sort_array(transform(sequence(0, {P}m - 1), i ->
                coalesce(shiftleft(xxhash64({P}words[i], {P}words[i + 1], {P}words[i + 2]), {P}bits) | cast(i as bigint), 0L))) END"""
        ),
    )
    df = df.withColumn(
        col("spots"),
        F.expr(
            f"""sort_array(transform(filter({P}keys, (x, i) -> CASE
                WHEN i > 0 AND {same(f'{P}keys[i - 1]')} THEN true
                WHEN i < {P}m - 1 AND {same(f'{P}keys[i + 1]')} THEN true
                WHEN (i > 0 AND {alike(f'{P}keys[i - 1]')}) OR (i < {P}m - 1 AND {alike(f'{P}keys[i + 1]')})
                    THEN exists({P}keys, y -> y <> x AND {same('y')})
                ELSE false END), x -> cast({place('x')} as bigint)))"""
        ),
    )
    df = df.withColumn(col("lines"), F.filter(F.split(body, "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != ""))
    measures = {
        "word_chars": F.char_length(F.array_join(col("words"), "")).cast("long"),
        "n_symbols": (F.char_length(body) - F.char_length(F.translate(body, SYMBOLS, ""))).cast("long"),
        "n_lines": F.size(col("lines")).cast("long"),
        "n_dup_lines": (F.size(col("lines")) - F.size(F.array_distinct(col("lines")))).cast("long"),
        "n_repeat_words": F.expr(f"aggregate({P}spots, named_struct('c', 0L, 'e', 0L), (a, x) -> named_struct('c', a.c + x + 3 - greatest(a.e, x), 'e', x + 3), a -> a.c)"),
        "n_capitals": F.char_length(F.regexp_replace(body, r"[^\p{Lu}]+", "")).cast("long"),
    }
    df = df.withColumns({col(k): v for k, v in measures.items()})
    return df.drop(*map(col, ("words", "m", "bits", "keys", "spots", "lines")))


def with_scores(df: DataFrame, rules: Rules) -> DataFrame:
    """Adds the base verdict, the stratum and one share per rule."""
    share = lambda a, b: F.coalesce(F.try_divide(F.col(P + a).cast("double"), F.col(P + b)), F.lit(0.0))
    words = F.col(P + "n_words")
    stratum = reduce(lambda acc, i: F.when(words >= rules.bands[i], i).otherwise(acc), range(1, len(rules.bands)), F.lit(0))
    df = df.withColumns(
        {
            P + "base_failed": (words < 50) | (100 * F.col(P + "n_repeat_words") > 50 * words),
            P + "stratum": stratum.cast("int"),
            P + "symbols": share("n_symbols", "n_words"),
            P + "dup_lines": share("n_dup_lines", "n_lines"),
            P + "repeats": share("n_repeat_words", "n_words"),
            P + "capitals": share("n_capitals", "word_chars"),
        }
    )
    rungs = [reduce(lambda a, b: a + b, [(F.col(P + k) > F.lit(float(c))).cast("int") for c in cuts]) for k, cuts in rules.cutoffs]
    # the partition's number isn't deterministic to the optimizer: a filter on what stands here isn't pushed below
    # it, where every measure would be computed anew for each time the filter names it
    return df.withColumns({P + "severity": F.greatest(*rungs, F.lit(0)), P + "part": F.spark_partition_id()})


def binomial_tail(n, k, share: float):
    """P(Bin(n, share) <= k) by summing log terms; 1 where k is above the mean, where no cutoff passes anyway."""
    odds = share / (1 - share)
    return F.expr(
        f"""CASE WHEN {k} > {n} * {share!r}D THEN 1.0D WHEN {k} = 0 THEN exp({n} * ln(1 - {share!r}D)) ELSE
            aggregate(sequence(1L, {k}), named_struct('t', {n} * ln(1 - {share!r}D), 's', {n} * ln(1 - {share!r}D)), (a, i) ->
                named_struct('t', a.t + ln(({n} - i + 1) * {odds!r}D / i),
                    's', greatest(a.s, a.t + ln(({n} - i + 1) * {odds!r}D / i))
                        + ln(1 + exp(-abs(a.s - (a.t + ln(({n} - i + 1) * {odds!r}D / i)))))), a -> exp(a.s)) END"""
    )


def certified_rungs(labelled: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """(stratum, rung) for the strata in which a rung is certified. labelled: with_scores() and `__qr_quality`."""
    level = rules.delta / len(rules.bands)
    top = len(rules.cutoffs[0][1])
    counts = (
        labelled.where(~F.col(P + "base_failed") & (F.col(P + "part") >= 0))
        .groupBy(P + "stratum", P + "severity")
        .agg(F.sum(P + "quality").alias("g"), F.sum(1 - F.col(P + "quality")).alias("b"))
    )
    per = (
        counts.groupBy(P + "stratum")
        .agg(F.collect_list(F.struct(F.col(P + "severity").alias("s"), "g", "b")).alias("h"), F.sum("g").cast("long").alias("n"), F.sum("b").cast("long").alias("m"))
        .select(P + "stratum", "n", "m", "h", F.explode(F.sequence(F.lit(1), F.lit(top))).alias("rung"))
        .withColumn("k", F.expr("aggregate(filter(h, x -> x.s >= rung), 0L, (a, x) -> a + x.g)"))
        .withColumn("rejected", F.expr("aggregate(filter(h, x -> x.s >= rung), 0L, (a, x) -> a + x.b)"))
        .withColumn("p", binomial_tail("n", "k", rules.max_false_reject))
    )
    loosest_first = Window.partitionBy(P + "stratum").orderBy(F.desc("rung"))
    passed = per.withColumn("ok", F.min(F.col("p") <= level).over(loosest_first)).where("ok")
    gain = F.try_divide(F.col("rejected").cast("double"), F.col("m")) - rules.good_weight * F.try_divide(F.col("k").cast("double"), F.col("n"))
    return passed.groupBy(P + "stratum").agg(F.max_by("rung", F.struct(F.coalesce(gain, F.lit(0.0)), F.col("rung"))).alias(P + "rung"))


def judged(scored: DataFrame, rungs: DataFrame) -> DataFrame:
    """scored with `__qr_kept`. rungs has a row per stratum at most, so its broadcast is bounded by `Rules.bands`."""
    hit = F.coalesce(F.col(P + "severity") >= F.col(P + "rung"), F.lit(False))
    return scored.join(F.broadcast(rungs), P + "stratum", "left").withColumn(P + "kept", ~F.col(P + "base_failed") & ~hit)


def with_labels(scored: DataFrame, labels: DataFrame) -> DataFrame:
    """Inner join; a document with several labels is good if one of them says so."""
    one = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").alias(P + "id")).agg(F.max(F.col("quality").cast("long")).alias(P + "quality"))
    return scored.join(one, F.col("doc_id") == F.col(P + "id")).drop(P + "id")


def filter_documents(docs: DataFrame, labels: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The rows of docs that the rules keep, with the columns of docs."""
    columns = docs.columns
    docs, hidden = guarded(docs, P)
    with small_scans(docs.sparkSession):
        measured = staged(with_measures(docs), "measured", ROW_GROUP)
    scored = with_scores(measured, rules)
    rungs = staged(certified_rungs(with_labels(scored, labels), rules), "rungs")
    return judged(scored, rungs).where(F.col(P + "kept")).select(*docs.columns).withColumnsRenamed(hidden).select(*columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their counts and verdicts; the measures are taken once and staged without the texts."""
    rules = Rules()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = with_scores(staged(with_measures(docs).drop("text"), "measures"), rules)
    rungs = certified_rungs(with_labels(scored, table(spark, sf_dir, "labels")), rules)
    out = judged(scored, rungs)
    return out.select("doc_id", *[F.col(P + k).cast("long").alias(k) for k in BASE], F.col(P + "base_failed").alias("base_failed"), F.col(P + "kept").alias("kept"))
