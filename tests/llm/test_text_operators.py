"""Rules, classifier, extraction, tokenizing and packing against plain versions."""

import base64
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers as tokenizers_
import pytest
from pyspark.sql import functions as F

from cellweave.llm import bpe, html_text, line_crf, packing, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_measures(text):
    text = text or ""
    words = WORD.findall(text)
    windows = collections.Counter(zip(words, words[1:], words[2:]))
    spots = set()
    for i, w in enumerate(zip(words, words[1:], words[2:])):
        if windows[w] > 1:
            spots |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(spots)


def test_measures(docs, odd_texts):
    random.seed(3)
    texts = odd_texts + [" ".join(random.choice("abc") for _ in range(n)) for n in (2, 3, 4, 40, 400)] + ["a b\na b\n\n a b\nc | # $", "w " * 3000]
    rows = quality_rules.with_measures(docs(texts)).orderBy("doc_id").collect()
    for r, t in zip(rows, texts):
        assert tuple(r[f"__qr_{k}"] for k in quality_rules.BASE) == plain_measures(t), t


def test_binomial_tail(spark):
    from math import comb

    df = spark.createDataFrame([(n, k) for n in (1, 50, 700) for k in (0, 1, 3, 6)], "n long, k long")
    for r in df.withColumn("p", quality_rules.binomial_tail("n", "k", 0.01)).collect():
        want = sum(comb(r.n, i) * 0.01**i * 0.99 ** (r.n - i) for i in range(r.k + 1))
        assert r.p == pytest.approx(want if r.k <= r.n * 0.01 else 1.0)


def test_rules_certify_and_keep_good(spark, docs):
    good = [" ".join(f"w{i}x{j}" for j in range(80)) for i in range(900)]
    bad = [" ".join(f"w{i}x{j}###" for j in range(80)) for i in range(60)]
    d = docs(good + bad)
    labels = spark.createDataFrame([(i, int(i < 900), 0) for i in range(960)], "doc_id long, quality int, toxic int")
    kept = quality_rules.filter_documents(d, labels)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == set(range(900))
    # too few labels certify nothing: only the base rule rejects
    assert quality_rules.filter_documents(d, labels.where("doc_id > 880")).count() == 960
    assert quality_rules.filter_documents(d, labels.limit(0)).count() == 960
    assert quality_rules.filter_documents(d.limit(0), labels).count() == 0


def test_line_model(spark, docs, odd_texts):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("aeioustrn") for _ in range(rng.randint(2, 8)))
    line = lambda bad: " ".join(word() + ("###" if bad else "") for _ in range(rng.randint(4, 12)))
    texts = ["\n".join(line(i % 4 == 0) for _ in range(rng.randint(1, 6))) for i in range(400)]
    d = docs(texts)
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(400)], "doc_id long, quality int")
    model = line_crf.train(d, labels, line_crf.Params(steps=80))
    scored = line_crf.with_scores(d, model, "__s").collect()
    assert sum((r["__s"] >= 0.5) == (r.doc_id % 4 != 0) for r in scored) >= 398
    held = {r.doc_id: r.h for r in d.select("doc_id", line_crf.held_out().alias("h")).collect()}
    assert all(h == (zlib.crc32(str(i).encode()) % 3 == 1) for i, h in held.items())
    # labels of held-out rows make no difference
    flipped = labels.withColumn("quality", F.when(line_crf.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert np.allclose(line_crf.train(d, flipped, line_crf.Params(steps=80)).weights, model.weights)
    odd = [r["__s"] for r in line_crf.with_scores(docs(odd_texts), model, "__s").orderBy("doc_id").collect()]
    assert odd[:3] == [0, 0, 0] and all(0 <= s <= 1 for s in odd) and odd[-1] == odd[-2]
    none = line_crf.train(d, labels.where("quality = 1"))
    assert {r["__s"] for r in line_crf.with_scores(d, none, "__s").collect()} == {0.5}
    assert line_crf.with_scores(d.limit(0), model).count() == 0


def test_marginals_against_enumeration():
    import itertools

    rng = np.random.default_rng(0)
    scores, tr, lengths = rng.normal(size=7), rng.normal(size=(2, 2)), np.array([3, 0, 4])
    got, pairs, log_z = line_crf.marginals(scores, lengths, tr)
    want, total, both = [], 0.0, np.zeros((2, 2))
    for a, n in ((0, 3), (3, 4)):
        weights = {y: np.exp(sum(scores[a + i] * y[i] for i in range(n)) + sum(tr[y[i], y[i + 1]] for i in range(n - 1))) for y in itertools.product((0, 1), repeat=n)}
        z = sum(weights.values())
        total += np.log(z)
        want += [sum(w for y, w in weights.items() if y[i]) / z for i in range(n)]
        for y, w in weights.items():
            for i in range(n - 1):
                both[y[i], y[i + 1]] += w / z
    assert np.allclose(got, want) and np.allclose(pairs, both) and np.isclose(log_z, total)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body><header>Site <b>name</b></header><nav><ul><li><a href=/a>A</a></ul></nav>
<div class="cookie-notice">We use cookies on this site and need a long notice to say so, really.</div><div class="ad">Buy &amp; win</div><aside>Side</aside>
<article><h1>Head&nbsp;line</h1><p><b>First <i>part</i>.<br>Second &lt;x&gt; &#169;<p>Short.</p><form>Name <input> <button>Go</button></form><section class="comments"><p>Nice!</p></section></article><footer>&copy; Foot</footer></body></html>"""


def test_main_text(spark):
    assert html_text.main_text(PAGE) == "Head line First part. Second <x> © Short."
    assert html_text.main_text("") == "" and html_text.main_text("<p>") == "" and html_text.main_text("plain words") == "plain words"
    long = "<body><div><a href=1>Menu</a> <a href=2>Entry</a></div>" + "".join(f"<p>Paragraph {i} with words enough to count in the sums of windows.</p>" for i in range(5)) + "<div><a href=3>Imprint</a></div>"
    got = html_text.main_text(long)
    assert got.startswith("Paragraph 0") and got.endswith("windows.") and "Menu" not in got and "Imprint" not in got
    df = spark.createDataFrame([(1, "u", PAGE, 5), (1, "u", PAGE, 5), (2, None, None, 5), (None, "v", "", 5)], "page_id long, url string, html string, text int")
    rows = html_text.extract(df).collect()
    assert len(rows) == 4 and rows[0] == rows[1] and [r.n_chars for r in rows[2:]] == [0, 0]
    assert html_text.extract(df.limit(0)).count() == 0


def test_line_blocks_decide_around_and_in_marked_articles():
    text = "".join(f"<p>Paragraph {i} with words enough to count in the sums of windows.</p>" for i in range(5))
    shown = " ".join(f"Paragraph {i} with words enough to count in the sums of windows." for i in range(5))
    teaser = html_text.main_text(f"<body><article><h2>Teaser</h2></article><div>Share</div>{text}<div><a href=1>Imprint</a></div></body>")
    assert shown in teaser and "Imprint" not in teaser
    links = "".join(f"<li><a href={i}>Other story {i}</a></li>" for i in range(12))
    assert html_text.main_text(f"<body><p>Note</p><article>{text}<p>End.</p><ul class=more>{links}</ul></article><p>Foot</p></body>") == f"{shown} End."
    # short paragraphs of an article stay
    assert html_text.main_text("<article>" + "<p>Yes.</p><p>No.</p>" * 4 + "</article><p>Foot</p>") == " ".join(["Yes. No."] * 4)


BYTE = tokenizers_.path("byte_bpe_multi_50k.tiktoken")


def test_byte_bpe(docs, odd_texts):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BYTE, "rb"))}
    enc = tiktoken.Encoding("t", pat_str=tokenizers_.PATTERN, mergeable_ranks=ranks, special_tokens={})
    d = docs(odd_texts + [(None, "no id"), (2**60 + 1, "large id")])
    for block in (30, 1 << 20):
        got = collections.defaultdict(list)
        for r in bpe.encode(d, BYTE, tokenizers_.PATTERN, block).collect():
            got[r.doc_id].append(list(r.ids))
        for r in d.collect():
            want = enc.encode_ordinary(r.text or "")
            assert want in got[r.doc_id]
            assert bpe.decode(np.array(want), BYTE) == (r.text or "").encode()
        assert sum(map(len, got.values())) == d.count()
    assert bpe.encode(d.limit(0), BYTE, tokenizers_.PATTERN).count() == 0


def test_a_word_is_encoded_once(spark, monkeypatch):
    """However many blocks, partitions and buckets there are, a word goes to one bucket; and ids may have any type."""
    monkeypatch.setattr(bpe, "BUCKET_BYTES", 1)
    texts = [" ".join(f"w{(i * j) % 97}" for j in range(60)) for i in range(200)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(50)
    rows = bpe.explode_blocks(d, tokenizers_.PATTERN, 100).where("bucket >= 0").collect()
    homes = collections.defaultdict(set)
    for r in rows:
        for w in bpe.unpack_words(r["data"]):
            homes[w].add(r["bucket"])
    assert all(len(x) == 1 for x in homes.values()) and max(r["bucket"] for r in rows) >= bpe.LEAST_BUCKETS
    want = sorted(r.ids for r in bpe.encode(d, BYTE, tokenizers_.PATTERN).collect())
    for kind in ("date_add(date'2020-01-01', cast(doc_id as int))", "cast(doc_id as decimal(20, 2))", "named_struct('n', doc_id)", "cast(doc_id as string)"):
        named = d.selectExpr(f"{kind} doc_id", "text")
        found = bpe.encode(named, BYTE, tokenizers_.PATTERN, 100)
        assert found.schema["doc_id"].dataType == named.schema["doc_id"].dataType
        rows = found.collect()
        assert len({str(r.doc_id) for r in rows}) == 200 and sorted(r.ids for r in rows) == want


def test_packed_numbers():
    for n in (0, 1, 1000):
        x = np.random.default_rng(n).integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)
        assert (bpe.unpacked(bpe.packed(x)) == x).all()
        small = x % 700
        assert (bpe.unpack_stream(*bpe.pack_stream(small)) == small).all()
    words = ["a", "", "ü\n", "汉" * 9]
    assert bpe.unpack_words(bpe.pack_words(words)) == [w.encode() for w in words]


WORD_BPE = tokenizers_.path("word_bpe_49k.json")


def test_word_tokenizer_equals_library(odd_texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORD_BPE)
    t.encode_special_tokens = True
    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyzABCéÜñß'.,!?-%0123456789 \n\t\x7f\xa0"
    texts = [x or "" for x in odd_texts] + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 200))) for _ in range(400)]
    own = packing.WordTokenizer(WORD_BPE)
    for got in (own(texts), [own([x])[0] for x in texts]):
        for x, ids in zip(texts, got):
            assert list(ids) == t.encode(x, add_special_tokens=False).ids, x
    assert own([]) == []


def test_packing(docs, odd_texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORD_BPE)
    t.encode_special_tokens = True
    rng = random.Random(2)
    texts = odd_texts + [" ".join(rng.choice(("red", "green", "blue", "house", "tree")) for _ in range(rng.randint(1, 300))) for _ in range(60)]
    d = docs([*texts, (2**60 + 1, "large id"), (None, "no id")])
    params = packing.Params(window=128, shard_tokens=3000)
    rows = packing.packed(d, WORD_BPE, params, with_ids=True).collect()
    want = collections.Counter((r.doc_id, np.array(t.encode(r.text or "", add_special_tokens=False).ids + [1], "<u4").tobytes()) for r in d.collect())
    pieces, windows = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        pieces[r.doc_id].append(r)
        windows[r.sequence_id].append((r.offset, r.length))
    for key, own in pieces.items():
        assert b"".join(x.ids for x in sorted(own, key=lambda x: x.start)) == next(i for k, i in want if k == key)
    assert set(pieces) == {k for k, _ in want}
    short = 0
    for w in windows.values():
        at = 0
        for o, n in sorted(w):
            assert o == at
            at += n
        assert at <= 128
        short += at < 128
    assert short <= len({s >> 32 for s in windows})
    assert packing.packed(d.limit(0), WORD_BPE).count() == 0


def test_neighbours_come_by_score():
    ids = [np.array([5, 6, 7] * 10, np.uint16), np.array([8] * 30, np.uint16), np.array([5, 6, 7] * 9, np.uint16), np.array([8, 9] * 10, np.uint16)]
    idf = np.ones(20)
    index = packing.Index(ids, idf, 25.0, packing.Params())
    # brute force BM25
    def score(q, d):
        total = 0.0
        for term in set(ids[q].tolist()):
            tf = (ids[d] == term).sum()
            total += tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(ids[d]) / 25.0)) if tf else 0.0
        return total

    for q in range(4):
        assert np.allclose(index.scores(q), [score(q, d) for d in range(4)])
    first = next(packing.pack_shard(ids, index, packing.Params(window=60)))
    assert [d for d, *_ in first][:2] == [0, 2]


def test_shards_of_topics():
    rng = random.Random(3)
    for most in (10, 100, 1000):
        sizes = [(t, rng.choice((1, 3, 9, 40, 300))) for t in rng.sample(range(500), 60)]
        load, owners = collections.Counter(), collections.defaultdict(set)
        for topic, first, pieces in packing.shards_by_topic(sizes, most):
            for k in range(pieces):
                load[first + k] += dict(sizes)[topic] / pieces
                owners[first + k].add(topic)
            assert pieces == 1 or all(owners[first + k] == {topic} for k in range(pieces))
        assert max(load.values()) <= most and sorted(load) == list(range(len(load)))
        assert sum(load.values()) == pytest.approx(sum(n for _, n in sizes))
        assert all(load[k] + load[k + 1] > most for k in range(len(load) - 1) if len(owners[k]) > 1 and len(owners[k + 1]) > 1) or most == 10
    assert packing.shards_by_topic([], 5) == []


def test_documents_of_one_topic_meet(docs):
    rng = random.Random(8)
    own = ["".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(4)) for _ in range(12)]
    texts = [" ".join([w] * 12 + ["red", "green", "blue", "house", "tree"] * 3) for w in own for _ in range(6)]
    rng.shuffle(texts)
    rows = packing.packed(docs(texts), WORD_BPE, packing.Params(window=256, shard_tokens=1200)).collect()
    sequences = collections.defaultdict(set)
    for r in rows:
        sequences[r.sequence_id].add(texts[r.doc_id])
    # windows hold few kinds of text, where documents at random would mix most of them
    assert np.mean([len(x) for x in sequences.values()]) < 2.6


def test_all_terms_ask_and_windows_fill_by_score():
    rng = np.random.default_rng(4)
    # every document has more than 64 distinct terms, shared ones among them
    ids = [rng.integers(0, 600, 300).astype(np.uint16) for _ in range(40)]
    idf = rng.random(600) + 0.1
    index = packing.Index(ids, idf, 300.0, packing.Params())
    for q in range(3):
        want = [sum(idf[t] * tf * 2.2 / (tf + 1.2) for t in set(ids[q].tolist()) if (tf := (ids[d] == t).sum())) for d in range(40)]
        assert np.allclose(index.scores(q), want)
    # a seed with 60 short neighbours, then documents without its terms: all neighbours come before those
    ids = [np.full(10, 5, np.uint16)] + [np.full(9, 7, np.uint16)] * 5 + [np.full(3, 5, np.uint16)] * 60
    first = next(packing.pack_shard(ids, packing.Index(ids, np.ones(10), 4.0, packing.Params()), packing.Params(window=190)))
    assert sorted(d for d, *_ in first) == [0, *range(6, 66)]


def test_sha_of_query_columns(spark, tmp_path):
    df = spark.createDataFrame([(1, "Hello wörld"), (2, None)], "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in bpe.query(spark, str(tmp_path)).collect()}
    assert rows[1].decoded_sha256 == hashlib.sha256("Hello wörld".encode()).hexdigest()
    assert rows[2].n_tokens == 0 and rows[2].ids_sha256 == hashlib.sha256(b"").hexdigest()
