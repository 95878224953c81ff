"""Packing documents into fixed windows by lexical retrieval.

1. Documents are tokenized once and staged as compressed ids (plus an end id each), together with the document
   frequencies of all vocabulary ids. That vector's length is the vocabulary's size, whatever the corpus holds.
   A document's topic is its term of the largest tf * idf, by the documents that its task has seen so far.
2. Documents are dealt into shards of at most some `shard_tokens` tokens by their topics, so that neighbours tend to meet:
   small topics share a shard, large ones are dealt to several by a hash of the row. The sizes of topics, one number per
   vocabulary id, reach the driver. Each shard is one group with an inverted index of its own: postings by vocabulary id
   with BM25 weights, idf and mean length taken over the whole corpus.
3. In a shard, documents of a window or more give full windows of their own. The rest, longest first, are seeds:
   a seed asks the index with all its terms, and the unused neighbours it returns fill its window greedily, best
   first, where they fit. Once `fan` of them were tried and one did not fit, what is left of the window takes the
   head of the best that did not, whose rest stays unused. So only a shard's last window has padding.

Each id lies in exactly one piece. Defined results: null and empty texts are the end id alone; rows are packed one
by one, so repeated rows and ids take part as often as they come; ties go by place in the shard, which is ordered by
row. An empty table gives an empty result. Texts are never cut short.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm.bpe import gathered, squeezed, unsqueezed
from cellweave.llm.common import ROW_GROUP, chunks, free_memory, small_scans, staged, table, text_or_empty

LANES = 512
#: texts whose ids are put together at a time
RUN = 64


@dataclass(frozen=True)
class Params:
    window: int = 2048
    end_id: int = 1
    shard_tokens: int = 2_000_000
    #: what a document counts as in a shard besides its tokens: bounds a shard's documents too
    doc_tokens: int = 100
    fan: int = 24  # neighbours that are tried before the best of them is cut
    k1: float = 1.2
    b: float = 0.75


#: characters whose normal form, lower case and class the fast path shares with the tokenizer
UNSURE = r"[^\x00-\x1b\x20-\x7e\x80-\x84\x86-įı-ɏ]"
MARKS = ".,;:!?"
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _byte_chars() -> dict[str, int]:
    """The printable characters that stand for bytes in byte-level vocabularies."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class FastWords:
    """Ids of single lower-case pre-tokens by a byte-pair encoder that merges whatever joins to a known token.

    The tokenizer merges listed pairs only. The two agree on a word if every token of the result arises from listed
    pairs alone when its own bytes are merged; the tokens for which that fails are found once, and a word that has
    one of them is left to the tokenizer. Byte 127, which no sure text has, marks the end of a word.
    """

    END = b"\x7f"

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        model = data["model"]
        self.size = 1 + max([*model["vocab"].values(), *(x["id"] for x in data.get("added_tokens", ()))])
        chars, suffix, vocab, end = _byte_chars(), model["end_of_word_suffix"], model["vocab"], self.END

        def coded(token: str) -> bytes:
            return bytes(chars[c] for c in token.removesuffix(suffix)) + (end if token.endswith(suffix) else b"")

        inner = [b for b in range(256) if b != end[0]]
        ranks = {bytes([b]): b for b in range(256)} | {bytes([b]) + end: 256 + b for b in inner}
        names = {i: c for c, i in chars.items()}
        self.ids = np.full(512 + len(model["merges"]), -1, np.int32)
        for b in inner:
            self.ids[b], self.ids[256 + b] = vocab.get(names[b], -1), vocab.get(names[b] + suffix, -1)
        listed: dict[bytes, tuple[bytes, bytes]] = {}
        for i, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            whole = coded(left) + coded(right)
            if end in whole[:-1] or whole in ranks:
                continue  # never met, or a second way to the same token, which isn't taken here
            ranks[whole] = 512 + i
            self.ids[512 + i] = vocab[left + right]
            listed[whole] = (coded(left), coded(right))
        for token, (left, right) in listed.items():
            if not self._arises(token, left, right, ranks, listed):
                self.ids[ranks[token]] = -1
        self.last = np.zeros(len(self.ids), bool)
        self.last[[i for token, i in ranks.items() if token.endswith(end) and len(token) > 1]] = True
        self.encode = tiktoken.Encoding("words", pat_str="[^ ]+", mergeable_ranks=ranks, special_tokens={}).encode_to_numpy

    @classmethod
    def _arises(cls, token: bytes, left: bytes, right: bytes, ranks: dict, listed: dict) -> bool:
        parts = [token[i : i + 1] for i in range(len(token))]
        if len(parts) > 1 and parts[-1] == cls.END:
            parts[-2:] = [parts[-2] + cls.END]
        while len(parts) > 1:
            best, at = min((ranks.get(x + y, 1 << 30), i) for i, (x, y) in enumerate(zip(parts, parts[1:])))
            if best == 1 << 30:
                return False
            whole = parts[at] + parts[at + 1]
            if listed.get(whole) != (parts[at], parts[at + 1]):
                return False
            parts[at : at + 2] = [whole]
        return True

    def __call__(self, words: pa.Array, slow) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after another, count per word); slow(words) encodes those that can't be told here."""
        if not len(words):
            return np.zeros(0, np.uint16), np.zeros(0, np.int64)
        end = self.END.decode()
        whole = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words.cast(pa.string()))
        tokens = self.encode(pc.binary_join(whole, f"{end} ")[0].as_py() + end).astype(np.int64)
        ids, ends = self.ids[tokens], np.flatnonzero(self.last[tokens]) + 1
        begin = np.append(0, ends[:-1])
        count = ends - begin
        left = np.flatnonzero(np.minimum.reduceat(ids, begin) < 0)
        if len(left):
            found = slow(words.take(pa.array(left)).to_pylist())
            count[left] = np.fromiter(map(len, found), np.int64, len(found))
            begin[left] = len(ids) + np.cumsum(count[left]) - count[left]
            ids = gathered(np.append(ids, np.array([x for own in found for x in own], np.int32)), begin, count)
        return ids.astype(np.uint16), count


class WordTokenizer:
    """The ids of whole texts. No pre-token crosses white space, so texts are cut there by Arrow, whose white space is
    Python's. A piece is a word and a mark at its end; each distinct word is encoded once for all texts of a call."""

    def __init__(self, path: str):
        import re

        import regex

        self.path = path
        self.unsure, self.find = re.compile(UNSURE).search, regex.compile(PRE_TOKENS).findall
        self.words = FastWords(path)
        self.size = self.words.size

    @cached_property
    def tokenizer(self):
        """The library's tokenizer, which few texts need."""
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        found = Tokenizer.from_file(self.path)
        found.encode_special_tokens = True
        return found

    def _slow(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _encoded(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, begin, count): the ids of piece i are ids[begin[i] : begin[i] + count[i]]. Most pieces are letters and
        need no pattern."""
        letters = pc.utf8_is_alpha(pieces)
        other = [self.find(x) for x in pieces.filter(pc.invert(letters)).to_pylist()]
        plain = pieces.filter(letters)
        flat = pa.concat_arrays([plain, pa.array([w for x in other for w in x], plain.type)])
        ids, lengths = self.words(flat, self._slow)
        words = np.append(np.ones(len(plain), np.int64), np.fromiter(map(len, other), np.int64, len(other)))
        ends = np.append(0, np.cumsum(lengths))[np.append(0, np.cumsum(words))]
        order = np.argsort(~letters.to_numpy(zero_copy_only=False), kind="stable")
        begin, count = np.empty(len(pieces), np.int64), np.empty(len(pieces), np.int64)
        begin[order], count[order] = ends[:-1], np.diff(ends)
        return ids, begin, count

    def _sure(self, texts: list[str]) -> list[np.ndarray]:
        cut = pc.utf8_split_whitespace(pa.array(texts, pa.large_string()))
        low = pc.utf8_lower(cut.values)
        word = pc.utf8_rtrim(low, MARKS)
        marked = pc.and_(pc.equal(pc.subtract(pc.utf8_length(low), pc.utf8_length(word)), 1), pc.utf8_is_alpha(pc.utf8_slice_codeunits(word, -1)))
        words = pc.if_else(marked, word, low).dictionary_encode()
        marks = pc.if_else(marked, pc.utf8_slice_codeunits(low, -1), "").dictionary_encode()
        places = cut.offsets.to_numpy()
        del cut, low, word, marked
        ids, begin, count = self._encoded(pa.concat_arrays([words.dictionary, marks.dictionary]))
        words, marks, out = words.indices.to_numpy(), marks.indices.to_numpy() + np.int64(len(words.dictionary)), []
        for k in range(0, len(texts), RUN):
            own = places[k : k + RUN + 1]
            at = np.empty(2 * (own[-1] - own[0]), np.int64)
            at[::2], at[1::2] = words[own[0] : own[-1]], marks[own[0] : own[-1]]
            n = count[at]
            flat, ends = gathered(ids, begin[at], n), np.append(0, np.cumsum(n))[2 * (own - own[0])]
            out += [flat[a:b] for a, b in zip(ends.tolist(), ends[1:].tolist())]
        return out

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        out: list = [None] * len(texts)
        for i, text in enumerate(texts):
            if self.unsure(text):
                out[i] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint16)
        sure = [i for i, x in enumerate(out) if x is None]
        for i, ids in zip(sure, self._sure([texts[i] for i in sure]) if sure else ()):
            out[i] = ids
        return out


@cache
def _tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def _pack_ids(ids: np.ndarray) -> bytes:
    return squeezed(ids.view(np.uint8).reshape(-1, 2).T.tobytes(), 1)


def _unpack_ids(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(unsqueezed(data), np.uint8).reshape(2, -1).T).view(np.uint16).ravel()


def tokenized(docs: DataFrame, path: str, params: Params = Params(), chunk: int = 1 << 21) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, row, n, topic, ids, lane, df): a row per document, and one with df per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokenizer, part, row, df, total = _tokenizer(path), TaskContext.get().partitionId(), 0, None, 0
        end = np.array([params.end_id], np.uint16)
        names = ["doc_id", "row", "n", "topic", "ids", "lane", "df"]
        for batch in batches:
            df = np.zeros(max(tokenizer.size, params.end_id + 1), np.int64) if df is None else df
            kind = batch.schema.field(0).type
            for start, stop, texts in chunks(batch.column(1), chunk):
                ids = [np.append(x, end) for x in tokenizer(texts)]
                found = [np.unique(x, return_counts=True) for x in ids]
                for terms, _ in found:
                    df[terms] += 1
                idf = np.log(1 + (row + len(ids) - df + 0.5) / (df + 0.5))
                topic = [int(terms[(tf * idf[terms]).argmax()]) for terms, tf in found]
                n = [len(x) for x in ids]
                total += sum(n)
                rows = np.arange(row, row + len(ids), dtype=np.int64) + (part << 33)
                row += len(ids)
                none = pa.nulls(len(ids), pa.int32()), pa.nulls(len(ids), pa.binary())
                yield pa.record_batch([batch.column(0).slice(start, stop - start), pa.array(rows), pa.array(n, pa.int64()), pa.array(topic, pa.int32()), pa.array(map(_pack_ids, ids), pa.binary()), *none], names=names)
        if df is not None:
            counts = squeezed(np.append(df, [row, total]).astype("<i8").tobytes())
            free_memory()
            yield pa.record_batch([pa.nulls(1, kind), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.binary()), pa.array([part % LANES], pa.int32()), pa.array([counts], pa.binary())], names=names)

    rows = docs.select("doc_id", text_or_empty().alias("text"))
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, row long, n long, topic int, ids binary, lane int, df binary")


def corpus_counts(tokens: DataFrame) -> tuple[np.ndarray, int, int]:
    """(document frequencies by vocabulary id, documents, tokens): one number per vocabulary id reaches the driver."""

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(unsqueezed(x), "<i8") for x in frame["df"])
        return pd.DataFrame({"lane": frame["lane"].iloc[:1], "df": [squeezed(total.tobytes())]})

    lanes = tokens.where("df IS NOT NULL").select("lane", "df").groupBy("lane").applyInPandas(add, "lane int, df binary")
    found = [np.frombuffer(unsqueezed(r.df), "<i8") for r in lanes.withColumn("lane", F.lit(0)).groupBy("lane").applyInPandas(add, "lane int, df binary").collect()]
    return (found[0][:-2], int(found[0][-2]), int(found[0][-1])) if found else (np.zeros(0, np.int64), 0, 0)


def shards_by_topic(sizes: list[tuple[int, int]], most: int) -> list[tuple[int, int, int]]:
    """(topic, first shard, number of shards) of (topic, size): shards of at most some `most`. A topic above that is dealt
    to shards of its own; of the others, in the order of topics, each goes to the last shard as long as there is room."""
    out, shard, held = [], -1, most + 1
    for topic, size in sorted(sizes):
        pieces = max(1, -(-size // most))
        if pieces > 1 or held + size > most:
            shard, held = shard + 1, 0
        out.append((topic, shard, pieces))
        held += size
        if pieces > 1:
            shard, held = shard + pieces - 1, most + 1
    return out


class Index:
    """BM25 postings of a shard by vocabulary id."""

    def __init__(self, ids: list[np.ndarray], idf: np.ndarray, mean_length: float, params: Params):
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        found = [np.unique(x, return_counts=True) for x in ids]
        terms, tf = np.concatenate([t for t, _ in found]), np.concatenate([c for _, c in found])
        sizes = np.fromiter((len(t) for t, _ in found), np.int64, len(ids))
        norm = params.k1 * (1 - params.b + params.b * lengths / max(mean_length, 1e-9))
        weights = idf[terms] * tf * (params.k1 + 1) / (tf + np.repeat(norm, sizes))
        self.queries = [own for own, _ in found]
        order = np.argsort(terms, kind="stable")
        self.docs, self.weights = np.repeat(np.arange(len(ids)), sizes)[order], weights[order]
        self.begin = np.searchsorted(terms[order], np.arange(len(idf) + 1))
        self.n = len(ids)
        # terms of more than an eighth of the documents as rows over all of them
        common = np.flatnonzero(np.diff(self.begin) * 8 > self.n)
        self.row = np.full(len(idf), -1, np.int32)
        self.row[common] = np.arange(len(common))
        self.dense = np.zeros((len(common), self.n))
        for k, t in enumerate(common.tolist()):
            own = slice(self.begin[t], self.begin[t + 1])
            self.dense[k, self.docs[own]] = self.weights[own]

    def scores(self, doc: int) -> np.ndarray:
        terms = self.queries[doc].astype(np.int64)
        row = self.row[terms]
        total, terms = self.dense[row[row >= 0]].sum(0), terms[row < 0]
        if len(terms):
            begin = self.begin[terms]
            count = self.begin[terms + 1] - begin
            total += np.bincount(gathered(self.docs, begin, count), gathered(self.weights, begin, count), self.n)
        return total


def pack_shard(ids: list[np.ndarray], index: Index, params: Params) -> Iterator[list[tuple[int, int, int]]]:
    """Windows as lists of pieces (document, start, length)."""
    size = params.window
    start = np.zeros(len(ids), np.int64)
    left = np.fromiter(map(len, ids), np.int64, len(ids))
    for d in np.flatnonzero(left >= size):
        while left[d] >= size:
            yield [(int(d), int(start[d]), size)]
            start[d] += size
            left[d] -= size
    unused = left > 0
    for d in np.argsort(-left, kind="stable"):
        if not unused[d]:
            continue
        pieces, room = [(int(d), int(start[d]), int(left[d]))], size - int(left[d])
        unused[d] = False
        if room and unused.any():
            scores = np.where(unused, index.scores(d), -1.0)
            best = np.argpartition(-scores, params.fan)[: params.fan] if len(scores) > params.fan else np.arange(len(scores))
            best = [int(x) for x in best[np.lexsort((best, -scores[best]))] if unused[x]]
            for x in best:
                if left[x] <= room:
                    pieces.append((x, int(start[x]), int(left[x])))
                    room -= int(left[x])
                    unused[x] = False
            rest = [x for x in best if unused[x]]
            if room and not rest:
                # all that were tried fit: the next ones by score
                for x in np.flatnonzero(unused)[np.argsort(-scores[unused], kind="stable")].tolist():
                    if left[x] > room:
                        rest = [x]
                        break
                    pieces.append((x, int(start[x]), int(left[x])))
                    room -= int(left[x])
                    unused[x] = False
            while room and rest:
                # nothing fits: the best that is left gives its head
                x = rest.pop(0)
                n = min(room, int(left[x]))
                pieces.append((x, int(start[x]), n))
                start[x] += n
                left[x] -= n
                room -= n
                unused[x] = left[x] > 0
        yield pieces


NUMBERS = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def packed(docs: DataFrame, path: str, params: Params = Params(), with_ids: bool = False) -> DataFrame:
    """docs(doc_id, text) -> a row per piece: doc_id, where it starts in the document, where it stands in its sequence."""
    with small_scans(docs.sparkSession):
        tokens = staged(tokenized(docs, path, params), "tokens", ROW_GROUP)
    df, n, total = corpus_counts(tokens)
    documents = tokens.where("df IS NULL")
    size = F.sum(F.col("n") + params.doc_tokens)
    topics = shards_by_topic([tuple(r) for r in documents.groupBy("topic").agg(size).collect()], params.shard_tokens)
    idf = docs.sparkSession.sparkContext.broadcast(np.log(1 + (n - df + 0.5) / (df + 0.5)))
    mean_length = total / max(n, 1)
    kind = dict(tokens.dtypes)["doc_id"]

    def run(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by("row")
        ids = [_unpack_ids(x) for x in group.column("ids").to_pylist()]
        rows, base = [], key[0].as_py() << 32
        for i, pieces in enumerate(pack_shard(ids, Index(ids, idf.value, mean_length, params), params)):
            at = 0
            for d, start, length in pieces:
                own = ids[d][start : start + length].astype("<u4").tobytes()
                rows.append((d, start, length, zlib.crc32(own), len(ids[d]), base + i, at, own))
                at += length
        doc, *numbers, own = zip(*rows)
        columns = {"doc_id": group.column("doc_id").take(pa.array(doc)), **{k: pa.array(v, pa.int64()) for k, v in zip(NUMBERS, numbers)}}
        out = pa.table(columns | ({"ids": pa.array(own, pa.binary())} if with_ids else {}))
        del ids, rows, own
        free_memory()
        return out

    places = docs.sparkSession.createDataFrame(topics, "topic int, first int, pieces int")
    # a row per vocabulary id at most
    placed = documents.join(F.broadcast(places), "topic")
    dealt = placed.select("doc_id", "row", "ids", (F.col("first") + F.pmod(F.xxhash64("row"), F.col("pieces").cast("long"))).alias("shard"))
    return dealt.groupBy("shard").applyInArrow(run, f"doc_id {kind}, " + ", ".join(f"`{k}` long" for k in NUMBERS) + (", ids binary" if with_ids else ""))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
