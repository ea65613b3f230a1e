"""Language-model scores by subword lattices over an existing vocabulary.

A text is its words, lower-cased, and one end. A word's spelling has the sum over all
segmentations into vocabulary pieces of the product of their unigram weights: a forward
recursion in log space. The pieces are those of an existing byte-level vocabulary, so
every word has a segmentation. Their weights are counts over the distinct training
words, apart for pieces that begin a word and those that go on or stop. The lattice has
one more arc for each training word as a whole: with c of n training tokens and v
distinct ones, a word weighs (c + v * spelling) / (n + v), which sums to 1 over all
strings. Tokens are independent, so each distinct word of the corpus goes through the
recursion once, and a document adds up its words.

Frequent words (at most ``hot_words``, the bound of what is broadcast) are added up
where the text is read. All other words go through an exact join with the word table.

* NULL text is empty: one token, the end. Bytes that aren't UTF-8 are words like others.
* NULL ids are learned from and not held out. Repeated rows are counted and scored each.
* Without training rows all counts are 0; an empty table gives no rows.
* Further columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlsight.llm.common import remainder
from crawlsight.llm.packing import public_path
from crawlsight.session import stage

_LOG10 = math.log(10)
_LOG2_10 = math.log2(10)


@dataclass(frozen=True)
class LatticeOptions:
    vocabulary: str = "byte_bpe_50k.tiktoken"
    held_out: int = 2  # remainder of ids, modulo 7, that aren't learned from
    hot_words: int = 200_000
    flush: int = 300_000  # distinct words that a task counts before it passes them on
    smooth: float = 0.05  # added to the count of every piece


# --- Lattice ----------------------------------------------------------------


class Lattice:
    """Log probabilities of byte strings, summed over all segmentations."""

    def __init__(self, pieces: list[bytes], logs: np.ndarray):
        self.logs = dict(zip(pieces, logs.tolist()))
        self.longest = max(map(len, pieces))
        hashes = np.array([self._hash(p) for p in pieces], np.uint64)
        # Tables in which each piece has a slot of its own; those without one go to the next.
        self.tables, left = [], np.arange(len(pieces))
        while len(left):
            bits = max(8, int(len(left)).bit_length() + 2)
            shift, odd = np.uint64(64 - bits), np.uint64(0x9E3779B97F4A7C15 + 2 * 0x1234567 * len(self.tables))
            keys, values = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -np.inf)
            with np.errstate(over="ignore"):
                slots = (hashes[left] * odd) >> shift
            _, first = np.unique(slots, return_index=True)
            keys[slots[first]], values[slots[first]] = hashes[left[first]], logs[left[first]]
            self.tables.append((shift, odd, keys, values))
            left = np.delete(left, first)

    _BASE = 0x100000001B3

    def _hash(self, piece: bytes) -> int:
        h = 0
        for b in piece:
            h = (h * self._BASE + b + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def _lookup(self, h: np.ndarray) -> np.ndarray:
        out = np.full(h.shape, -np.inf)
        for shift, odd, keys, values in self.tables:
            slot = (h * odd) >> shift
            np.copyto(out, values[slot], where=keys[slot] == h)
        return out

    def one(self, word: bytes) -> float:
        alpha = [0.0] + [-math.inf] * len(word)
        for i in range(1, len(word) + 1):
            terms = [alpha[j] + self.logs[p] for j in range(max(0, i - self.longest), i) if (p := word[j:i]) in self.logs]
            top = max(terms, default=-math.inf)
            if top > -math.inf:
                alpha[i] = top + math.log(sum(math.exp(t - top) for t in terms))
        return alpha[-1]

    def many(self, words: list[bytes]) -> np.ndarray:
        """Words of one length go through the recursion together."""
        out = np.empty(len(words))
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(lengths, kind="stable")
        borders = np.flatnonzero(np.diff(lengths[order])) + 1
        for group in np.split(order, borders):
            n = int(lengths[group[0]]) if len(group) else 0
            if len(group) < 32 or n > 256:
                for k in group:
                    out[k] = self.one(words[k])
                continue
            for part in np.array_split(group, max(1, len(group) * n // 200_000)):
                out[part] = self._group(np.frombuffer(b"".join(words[k] for k in part), np.uint8).reshape(len(part), n).T)
        return out

    def _group(self, letters: np.ndarray) -> np.ndarray:
        n, m = letters.shape
        alpha = np.full((n + 1, m), -np.inf)
        alpha[0] = 0
        h = np.zeros((n, m), np.uint64)
        with np.errstate(over="ignore"):
            for i in range(1, n + 1):
                low = max(0, i - self.longest)
                h[low:i] = h[low:i] * np.uint64(self._BASE) + (letters[i - 1].astype(np.uint64) + np.uint64(1))
                terms = alpha[low:i] + self._lookup(h[low:i])
                top = terms.max(0)
                safe = np.where(np.isfinite(top), top, 0)
                with np.errstate(divide="ignore"):
                    alpha[i] = safe + np.log(np.exp(terms - safe).sum(0))
        return alpha[n]


def _vocabulary(name: str) -> list[bytes]:
    import base64

    with open(public_path(name), "rb") as f:
        return [base64.b64decode(line.split()[0]) for line in f]


def _encoder(name: str):
    import base64

    import public_tokenizers
    import tiktoken

    with open(public_path(name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return own._encode_bytes


# --- Counts -----------------------------------------------------------------


def _words(text: bytes | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return text.lower().split() if text else []


def word_counts(docs: DataFrame, options: LatticeOptions) -> DataFrame:
    """word (NULL: the end of a text), c (in training texts), total, over the whole table."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trained, other = Counter(), Counter()

        def out():
            keys = list(trained.keys() | other.keys())
            c = np.fromiter((trained[k] for k in keys), np.int64, len(keys))
            total = c + np.fromiter((other[k] for k in keys), np.int64, len(keys))
            trained.clear()
            other.clear()
            for at in range(0, len(keys), 50_000):
                part = slice(at, at + 50_000)
                yield pa.RecordBatch.from_arrays([pa.array(keys[part], pa.binary()), pa.array(c[part]), pa.array(total[part])], names=["word", "c", "total"])

        for batch in batches:
            for text, held in zip(batch.column(0).cast(pa.binary()), batch.column(1)):
                into = other if held.as_py() else trained
                into.update(_words(text.as_py()))
                into[None] += 1
                if len(trained) + len(other) > options.flush:
                    yield from out()
        yield from out()

    held = F.expr(f"{remainder('doc_id', 7)} = {options.held_out}")
    partial = docs.select("text", held.alias("held")).mapInArrow(count, "word binary, c bigint, total bigint")
    return partial.groupBy("word").agg(F.sum("c").alias("c"), F.sum("total").alias("total"))


def piece_weights(words: DataFrame, options: LatticeOptions) -> tuple[list[bytes], np.ndarray, float]:
    """Pieces, their log weights and the log weight of a word's stop, from the distinct training words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, size = _encoder(options.vocabulary), len(_vocabulary(options.vocabulary))
        total = np.zeros(size + 1, np.int64)  # the last one: words
        for batch in batches:
            ids: list[int] = []
            for word in batch.column(0).to_pylist():
                ids += encode(b" " + word)
            total += np.bincount(np.array(ids, np.int64), minlength=size + 1)
            total[size] += batch.num_rows
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(total[found])], names=["id", "n"])

    counted = words.filter("word is not null and c > 0").select("word").mapInArrow(count, "id bigint, n bigint")
    rows = counted.groupBy("id").agg(F.sum("n").alias("n")).collect()  # at most the vocabulary
    pieces = _vocabulary(options.vocabulary)
    counts = np.full(len(pieces) + 1, options.smooth)
    for r in rows:
        counts[r.id] += r.n
    first = np.array([p[:1] == b" " for p in pieces] + [False])
    logs = np.log(counts / np.where(first, counts[first].sum(), counts[~first].sum()))
    return pieces, logs[:-1], float(logs[-1])


# --- Scores -----------------------------------------------------------------


def _with_lattice(words: DataFrame, pieces: list[bytes], logs: np.ndarray, stop: float, n: int, v: int) -> DataFrame:
    """The words (without the end) with ``lp``, the log10 of their weight."""
    shared = words.sparkSession.sparkContext.broadcast((pieces, logs))  # the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(*shared.value)
        for batch in batches:
            got = (lattice.many([b" " + w for w in batch.column(0).to_pylist()]) + stop) / _LOG10
            if n + v:  # else nothing was learned
                c = batch.column(1).to_numpy()
                with np.errstate(divide="ignore"):
                    got = np.logaddexp2(np.log2(c), (got + math.log10(v)) * _LOG2_10) / _LOG2_10 - math.log10(n + v)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got)], names=["word", "c", "total", "lp"])

    return words.filter("word is not null").mapInArrow(run, "word binary, c bigint, total bigint, lp double")


def _hot_from(words: DataFrame, most: int) -> int:
    """The least count of which no more than ``most`` words reach it."""
    sizes = words.groupBy("total").count().orderBy(F.desc("total")).limit(most).collect()
    held, least = 0, None
    for r in sizes:
        held += r["count"]
        if held > most:
            break
        least = r.total
    return least if least is not None else 2**62


def score(docs: DataFrame, options: LatticeOptions = LatticeOptions()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, per row."""
    spark = docs.sparkSession
    counts = stage(word_counts(docs, options), "lm_counts")
    size = counts.agg(F.sum("c").alias("n"), F.count_if(F.col("c") > 0).alias("v"), F.sum(F.expr("if(word is null, c, 0)")).alias("ends")).first()
    n, v, ends = size.n or 0, size.v or 0, size.ends or 0
    base = f"log10((c + 1) / {n + v + 1}D)"
    words = stage(_with_lattice(counts, *piece_weights(counts, options), n, v).withColumn("base", F.expr(base)), "lm_words")
    least = _hot_from(words, options.hot_words)
    top = words.filter(F.col("total") >= least).select("word", "c", "base", "lp").toPandas()  # at most hot_words rows
    hot = spark.sparkContext.broadcast(
        ({bytes(w): k for k, w in enumerate(top["word"])}, *(top[k].to_numpy() for k in ("c", "base", "lp")))
    )
    # In the training texts or not, log10 of base and model.
    end = (ends > 0, math.log10((ends + 1) / (n + v + 1)), math.log10(max(1, ends) / max(1, n + v)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, c, base_of, lp_of = hot.value
        known_of, key = c > 0, TaskContext.get().partitionId() << 40
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                rows = batch.slice(start, 512)
                tokens, known, base_sum, lp_sum, rest = [], [], [], [], []
                for text in rows.column(2).cast(pa.binary()):
                    words = _words(text.as_py())
                    k = np.fromiter(map(at.get, words, repeat(-1)), np.int64, len(words))
                    found = k[k >= 0]
                    tokens.append(len(words) + 1)
                    known.append(int(known_of[found].sum()) + end[0])
                    base_sum.append(float(base_of[found].sum()) + end[1])
                    lp_sum.append(float(lp_of[found].sum()) + end[2])
                    rest.append([words[i] for i in np.flatnonzero(k < 0)])
                keys = np.arange(key, key + rows.num_rows)
                key += rows.num_rows
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys), rows.column(0), rows.column(1), pa.array(tokens, pa.int64()), pa.array(known, pa.int64()),
                     pa.array(base_sum, pa.float64()), pa.array(lp_sum, pa.float64()), pa.array(rest, pa.list_(pa.binary()))],
                    names=["key", "doc_id", "held_out", "n_tokens", "known", "base", "lp", "rest"],
                )

    held = F.expr(f"{remainder('doc_id', 7)} = {options.held_out}").alias("held_out")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held, "text").mapInArrow(
        run, "key bigint, doc_id bigint, held_out boolean, n_tokens bigint, known bigint, base double, lp double, rest array<binary>"
    )
    rows = stage(rows, "lm_rows")
    cold = words.filter(F.col("total") < least).select("word", F.expr("c > 0").cast("int").alias("k"), F.col("base").alias("b"), F.col("lp").alias("l"))
    rest = rows.select("key", F.explode("rest").alias("word")).join(cold, "word").groupBy("key").agg(
        F.sum("k").alias("k"), F.sum("b").alias("b"), F.sum("l").alias("l")
    )
    return rows.drop("rest").join(rest, "key", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        F.expr("known + coalesce(k, 0)").alias("n_known"),
        F.lit(n).cast("bigint").alias("train_tokens"),
        F.expr("base + coalesce(b, 0)").alias("base_score"),
        F.expr("lp + coalesce(l, 0)").alias("score"),
    )
