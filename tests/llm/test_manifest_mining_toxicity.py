"""Hard negatives, Merkle manifests and sentence toxicity against plain versions, with odd rows."""

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.llm import hard_negatives, merkle, toxicity
from cellweave.llm.queries import QUERIES

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def write(spark, path, name, rows, schema):
    df = spark.createDataFrame(rows, schema)
    df.write.parquet(f"{path}/{name}.parquet")
    return df


# ---- hard negatives ----------------------------------------------------------------------------------------------


def plain_negatives(rows, least=80, most=100, n=5):
    """rows (id, label, vector) in the order of the table."""
    usable = []
    for vec_id, label, v in rows:
        if vec_id is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        usable.append((vec_id, (label + 1) % 10 if vec_id % 7 == 0 else label, [math.floor(256 * x) for x in v]))
    out = []
    for a, (aid, alabel, av) in enumerate(usable):
        if aid % 100:
            continue
        scores = [(-sum(x * y for x, y in zip(av, v)), vid, i) for i, (vid, _, v) in enumerate(usable)]
        positives = sorted(s for s in scores if usable[s[2]][1] == alabel and s[2] != a)[:n]
        for p, pid, _ in positives:
            window = sorted(s for s in scores if usable[s[2]][1] != alabel and least * -p <= 100 * -s[0] <= most * -p)[:n]
            out += [(aid, pid, r, nid, -p, -s) for r, (s, nid, _) in enumerate(window, 1)]
    return sorted(out)


def vectors(rng, n, d):
    """Rows with ties, a label that a third has, nulls and odd numbers."""
    common = [rng.uniform(0, 1) for _ in range(d)]
    rows = [(i, 3 if i % 3 == 0 else rng.randrange(10), common if i % 5 == 0 else [rng.uniform(-0.2, 1) for _ in range(d)]) for i in range(n)]
    rows += [(n, None, common), (n + 1, 1, None), (None, 1, common), (n + 2, 1, [None] * d), (n + 3, 1, [float("nan")] * d), (n + 4, 1, [float("inf")] * d), (n + 5, 1, common[: d - 2]), (n + 6, 1, [])]
    return rows


@pytest.mark.parametrize("shape", [{}, {"anchors": 2, "rows": 7, "width": 3}])
def test_negatives_against_plain(spark, shape):
    rows = vectors(random.Random(3), 420, 8)
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, label int, embedding array<float>, score int, mark int").repartition(3)
    rows = [(r.vec_id, r.label, r.embedding) for r in df.collect()]
    raw = df.select(F.col("vec_id").alias("id"), F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"), "embedding")
    found = hard_negatives.mined(hard_negatives.usable(raw), F.col("id") % 100 == 0, hard_negatives.Params(**shape))
    assert sorted(map(tuple, found.collect())) == plain_negatives(rows)
    assert len(plain_negatives(rows)) > 50


def test_negatives_of_repeated_ids(spark):
    rows = [(100, 1, [1.0]), (100, 1, [1.0]), (1, 2, [0.9]), (1, 2, [0.9]), (2, 2, [5.0])]
    df = spark.createDataFrame(rows, "id long, label int, embedding array<float>")
    found = sorted(map(tuple, hard_negatives.mined(hard_negatives.usable(df), F.col("id") % 100 == 0).collect()))
    s, n = 256 * 256, 256 * 230
    assert found == sorted([(100, 100, 1, 1, s, n), (100, 100, 2, 1, s, n)] * 2)


def test_negatives_beyond_exact_floats(spark):
    big = float(2**20)
    rows = [(0, 1, [big, 1.0]), (1, 1, [big, 1.0]), (2, 2, [big, 0.5])]
    found = hard_negatives.mined(hard_negatives.usable(spark.createDataFrame(rows, "id long, label int, embedding array<double>")), F.col("id") % 100 == 0).collect()
    assert [(r.positive_score, r.negative_score) for r in found] == [(2**56 + 65536, 2**56 + 32768)]


def test_negatives_query_without_rows_or_anchors(spark, tmp_path):
    write(spark, f"{tmp_path}/a", "embeddings", [], "vec_id long, label int, embedding array<float>")
    write(spark, f"{tmp_path}/b", "embeddings", [(1, 1, [0.5])], "vec_id long, label int, embedding array<float>")
    assert QUERIES["op11_block_negatives"](spark, f"{tmp_path}/a").collect() == QUERIES["op11_block_negatives"](spark, f"{tmp_path}/b").collect() == []


@pytest.mark.parametrize("shape", [{"held": 1, "anchors": 3, "rows": 11, "width": 5, "cells": 9}, {"cells": 1, "rows": 1}])
def test_negatives_of_a_grid_of_cells(spark, shape):
    rows = [r for r in vectors(random.Random(8), 420, 8) if r[0] is not None]
    df = spark.createDataFrame(rows, "id long, label int, embedding array<float>")
    rows = [(r.id, r.label, r.embedding) for r in df.collect()]
    other = df.withColumn("label", F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    found = hard_negatives.mined(hard_negatives.usable(other), F.col("id") % 100 == 0, hard_negatives.Params(**shape))
    assert sorted(map(tuple, found.collect())) == plain_negatives(rows)


def test_products_of_pairs_are_not_shuffled(spark):
    """2000 anchors and 8000 rows are 16 million pairs, 128 MB as whole numbers."""
    shuffled = lambda: sum(x.totalShuffleWrite() for x in [spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark.sparkContext._jsc.sc().statusStore().executorList(False)).get(0)])
    q = F.transform(F.sequence(F.lit(1), F.lit(8)), lambda k: F.pmod(F.xxhash64("id", k), F.lit(200)))
    rows = spark.range(8000).select("id", (F.col("id") % 10).alias("label"), q.alias("q"))
    before = shuffled()
    assert hard_negatives.mined(rows, F.col("id") % 4 == 1).count() > 2000
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30000)
    assert shuffled() - before < 40 << 20


# ---- Merkle manifest ---------------------------------------------------------------------------------------------


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain_tree(leaves, fan=3):
    """(root, siblings [(before, after)] of each leaf)."""
    proofs, at, nodes = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(nodes) > 1:
        for i, p in enumerate(at):
            run = nodes[p // fan * fan : p // fan * fan + fan]
            proofs[i].append(("".join(run[: p % fan]), "".join(run[p % fan + 1 :])))
        at = [p // fan for p in at]
        nodes = [sha("".join(nodes[i : i + fan])) for i in range(0, len(nodes), fan)]
    return nodes[0], proofs


def plain_manifest(rows, tampered):
    """rows (doc_id, source, lang, n_chars, text)."""
    by = defaultdict(list)
    for r in rows:
        by[r[1]].append((r[0] is not None, r[0] or 0, plain_leaf(r), r))
    first = lambda s: (s is not None, (s or "").encode())
    order = sorted(by, key=first)
    trees = {s: plain_tree([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in order}
    root, outer = plain_tree([trees[s][0] for s in order])
    out = []
    for s, up in zip(order, outer):
        for (_, _, leaf, r), own in zip(sorted(by[s], key=lambda x: x[:3]), trees[s][1]):
            steps = own + up
            h = plain_leaf((*r[:4], tampered(r)))
            for before, after in steps:
                h = sha(before + h + after)
            out.append((r[0], leaf, trees[s][0], root, sha("".join(b + a for b, a in steps)), h, h == root))
    return sorted(out, key=repr)


def documents(rng, n):
    source = lambda i: None if i % 11 == 0 else "hot" if i % 3 == 0 else f"é{i % 5}"
    rows = [(i, source(i), rng.choice(["en", None]), rng.choice([None, i, -1]), rng.choice([None, "", "a\nb", f"text {i} ünïcode\n"])) for i in range(n)]
    return rows + [(None, "hot", "en", 1, "no id"), (5, "hot", "en", 1, "id twice"), (5, "hot", "en", 1, "id twice"), (2**60, "alone", None, None, "x" * 5000 + "\n")]


@pytest.mark.parametrize("params", [merkle.Params(), merkle.Params(height=1, batch=5), merkle.Params(height=2, batch=1), merkle.Params(fan=2, height=3, batch=30)])
def test_manifest_against_plain(spark, params):
    rows = documents(random.Random(8), 240)
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5).withColumns({c: F.lit(1) for c in ("grp", "hash", "place", "size")})
    if params.fan == 3:
        want = plain_manifest(rows, lambda r: r[4] and r[4].replace("\n", ""))
        found, root = merkle.manifest(df, F.replace(F.col("text"), F.lit("\n"), F.lit("")), params)
        assert sorted(map(tuple, found.collect()), key=repr) == want
        assert root == want[0][3] and 0 < sum(x[-1] for x in want) < len(want)
    else:
        found, root = merkle.manifest(df, None, params)
        assert found.where("verified AND root = folded_root").count() == len(rows)


def test_manifest_query(spark, tmp_path):
    rows = documents(random.Random(9), 60)
    write(spark, f"{tmp_path}/a", "documents", [(r[0], r[4], r[2], r[1], r[3]) for r in rows], DOC)
    write(spark, f"{tmp_path}/b", "documents", [], DOC)
    write(spark, f"{tmp_path}/c", "documents", [(1, "one", "en", "s", 3)], DOC)
    import zlib

    want = plain_manifest(rows, lambda r: r[4].replace("\n", "") if r[4] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 else r[4])
    columns = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, QUERIES["op12_merkle_manifest"](spark, f"{tmp_path}/a").select(*columns).collect()), key=repr) == want
    assert QUERIES["op12_merkle_manifest"](spark, f"{tmp_path}/b").collect() == []
    leaf = plain_leaf((1, "s", "en", 3, "one"))
    assert [tuple(r) for r in QUERIES["op12_merkle_manifest"](spark, f"{tmp_path}/c").collect()] == [(1, leaf, leaf, leaf, sha(""), leaf, True)]


# ---- toxicity ----------------------------------------------------------------------------------------------------


def sentence(rng, extra=None):
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 5))) for _ in range(rng.randint(4, 12))]
    if extra:
        words[rng.randrange(1, len(words))] = extra
    return " ".join(words).capitalize() + rng.choice(".!?")


@pytest.fixture(scope="module")
def toxic_tables(spark, tmp_path_factory):
    """Documents with a vile word or an inflected vile stem in one sentence; a twentieth of the labels is wrong."""
    path, rng, docs, labels = str(tmp_path_factory.mktemp("toxic")), random.Random(4), [], []
    for i in range(1500):
        vile = i % 5 == 0
        word = rng.choice(["zvile", "Zfoul,", "zrot" + rng.choice("abcd")]) if vile else "zrot" if i % 7 == 0 else None
        n = rng.randint(1, 12)
        lines = [sentence(rng) for _ in range(n)]
        at = rng.randrange(n)
        lines[at] = sentence(rng, word)
        docs.append((i, " ".join(lines), "en", "s", 0, int(vile)))
        if i % 2 == 0:
            labels.append((i, 1, int(vile) if rng.random() > 0.05 else 1 - int(vile)))
    docs += [(5000, None, "en", "s", 0, 0), (5001, "", "en", "s", 0, 0), (None, "Some zvile thing.", "en", "s", 0, 1), (5002, "x" * 9000 + " zvile " + "y" * 9000, "en", "s", 0, 1), (5003, "...!", "en", "s", 0, 0)]
    labels += [(0, 1, 1), (None, 1, 1), (7, 1, None)]
    write(spark, path, "documents", docs, DOC + ", vile int")
    write(spark, path, "labels", labels, "doc_id long, quality int, toxic int")
    return path


def test_toxicity_query(spark, toxic_tables):
    truth = {r.doc_id: r.vile for r in spark.read.parquet(f"{toxic_tables}/documents.parquet").collect()}
    found = QUERIES["op13_sentence_toxicity"](spark, toxic_tables).collect()
    assert len(found) == 1505 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in found)
    held = [r for r in found if r.held_out]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held) and len(held) > 400
    assert {r.doc_id: (r.score, r.sentences) for r in found if r.doc_id in (5000, 5001, 5003)} == {k: (0.0, 0) for k in (5000, 5001, 5003)}
    assert next(r for r in found if r.doc_id is None).held_out is False
    assert next(r for r in found if r.doc_id == 5002).predicted == 1


def test_toxic_sentences_are_located(spark, toxic_tables):
    docs = spark.read.parquet(f"{toxic_tables}/documents.parquet").withColumns({"score": F.lit("x"), "offending": F.lit(2), "known": F.lit(1)})
    model = toxicity.train(docs, spark.read.parquet(f"{toxic_tables}/labels.parquet"))
    hit = missed = 0
    for r in toxicity.with_scores(docs, model).where("vile = 1 AND score > 0.7 AND doc_id < 5000").collect():
        spans = [r.text[s.start : s.stop].lower() for s in r.offending]
        hit += any(w in x for x in spans for w in ("zvile", "zfoul", "zrot"))
        missed += not spans or any("z" not in x for x in spans)
    assert hit > 250 and missed <= 0.02 * hit
    assert 0.005 < model.noise < 0.12


def test_scores_are_the_noisy_or_of_sentences():
    model = toxicity.Model({"=bad": 0, "wor": 1, "=word": 2}, np.array([6.0, 3.0, -2.5]), -5.0)
    text = "Bad day. A word here!\nWorlds and words? İstanbul bad bad"
    p = [1 / (1 + math.exp(-z)) for z in (1.0, -4.5, -2.0, 1.0)]
    score, n, found = toxicity.scored(model, text)
    assert n == 4 and abs(score - (1 - math.prod(1 - x for x in p))) < 1e-12
    assert [text[a:b] for a, b, _ in found] == ["Bad day.", " İstanbul bad bad"]
    assert toxicity.scored(model, "Bad day. " * 3)[0] == pytest.approx(1 - (1 - p[0]) ** 3)
    long = "good " * 5000 + "bad"
    assert toxicity.scored(model, long)[1] >= 12 and "bad" in long[slice(*toxicity.scored(model, long)[2][0][:2])]


def test_fit_raises_the_likelihood():
    rng = random.Random(1)
    docs = [(int(i % 4 == 0), ([[0]] if i % 4 == 0 else []) + [[rng.choice([1, 2])]], 3) for i in range(200)]
    weights, bias, noise = toxicity.fit(docs, np.zeros(3), (1.0, 1.0))
    assert weights[0] + bias > 2 and weights[1] + bias < -2 and weights[2] + bias < -2 and noise < 0.05


def test_toxicity_without_labels_or_rows(spark, tmp_path):
    write(spark, f"{tmp_path}/a", "documents", [(1, "Text here.", "en", "s", 1)], DOC)
    write(spark, f"{tmp_path}/a", "labels", [(1, 1, 1)], "doc_id long, quality int, toxic int")
    write(spark, f"{tmp_path}/b", "documents", [], DOC)
    write(spark, f"{tmp_path}/b", "labels", [], "doc_id long, quality int, toxic int")
    assert [r.score for r in QUERIES["op13_sentence_toxicity"](spark, f"{tmp_path}/a").collect()] == [0.0]
    assert QUERIES["op13_sentence_toxicity"](spark, f"{tmp_path}/b").collect() == []
