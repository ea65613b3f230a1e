"""Periodic runs: stretches of words that repeat with a period, found by suffix-tree LCE.

A run has a smallest period q, at least ``least_exponent`` periods and ``least_words`` words,
and cannot be extended on either side. Every run holds a Lyndon word of its period's length
as root, under the order of the words or under its reverse. So the longest Lyndon word at
each place, under either order, is a candidate root: two equal places a period apart. How
far they agree to the right is the depth of a lowest common ancestor in the suffix tree of
the words, how far to the left one in the suffix tree of the reversed words. Trees are built
by Ukkonen's algorithm, ancestors come from range minima over an Euler tour, looked up for
all candidates at once.

Words that occur fewer than ``least_exponent`` times in a stretch can be in no run of it,
and no run reaches over them: stretches are cut there until none is left to cut, and only
what remains gets trees. Documents share nothing, so there is no shuffle.

* NULL and blank texts have no words and no runs. Texts of any length are searched whole; the
  trees take about 1 KB for each word of the longest stretch.
* Runs may overlap; equal stretches differ by their period. Of equal exponents the one with
  the smallest start, then period, is the strongest.
* Repeated rows are searched each. An empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WORD = re.compile(r"[^\x20\x09-\x0D]+")


@dataclass(frozen=True)
class RunOptions:
    least_words: int = 6
    least_exponent: int = 4


class SuffixTree:
    """Ukkonen's tree of a sequence of small numbers from 0, closed by a number of its own.

    Nodes are numbered; 0 is the root. ``start`` and ``stop`` bound the edge into a node, ``kids``
    maps ``node * size + symbol`` to the child whose edge begins with the symbol.
    """

    def __init__(self, symbols: list[int]):
        text = [*symbols, max(symbols, default=-1) + 1]
        n, size = len(text), max(symbols, default=-1) + 2
        start, stop, link = array("i", [-1]), array("i", [0]), array("i", [0])
        kids: dict[int, int] = {}
        node = edge = length = pending = 0
        for i, symbol in enumerate(text):
            pending += 1
            last = 0
            while pending:
                if not length:
                    edge = i
                key = node * size + text[edge]
                child = kids.get(key)
                if child is None:
                    kids[key] = len(start)
                    start.append(i)
                    stop.append(n)
                    link.append(0)
                    if last:
                        link[last] = node
                    last = node
                else:
                    first = start[child]
                    span = min(stop[child], i + 1) - first
                    if length >= span:
                        edge += span
                        length -= span
                        node = child
                        continue
                    if text[first + length] == symbol:
                        length += 1
                        if last:
                            link[last] = node
                        break
                    middle = len(start)
                    start.append(first)
                    stop.append(first + length)
                    link.append(0)
                    kids[key] = middle
                    kids[middle * size + symbol] = middle + 1
                    start.append(i)
                    stop.append(n)
                    link.append(0)
                    start[child] = first + length
                    kids[middle * size + text[first + length]] = child
                    if last:
                        link[last] = middle
                    last = middle
                pending -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - pending + 1
        self.n, self.size, self.kids, self.start, self.stop = n, size, kids, start, stop

    def tour(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Depths along the Euler tour, the tour place of each suffix's leaf, and suffixes in order.

        Children come in the order of their first symbols, so leaves come in the order of suffixes.
        """
        n, count = self.n, len(self.start)
        keys = np.fromiter(self.kids.keys(), np.int64, len(self.kids))
        ends = np.fromiter(self.kids.values(), np.int64, len(self.kids))
        order = np.argsort(keys)
        child = ends[order].tolist()
        at = np.searchsorted(keys[order], np.arange(count + 1) * self.size).tolist()
        begin, close = self.start, self.stop
        depths, leaf_at, leaves = array("i"), array("i", bytes(4 * n)), array("i")
        stack, depth = [(0, 0)], 0
        place = at[:count]
        path = [0]
        depths.append(0)
        stack = [0]
        while stack:
            node = stack[-1]
            k = place[node]
            if k == at[node + 1]:
                stack.pop()
                path.pop()
                if stack:
                    depths.append(path[-1])
                continue
            place[node] = k + 1
            kid = child[k]
            if close[kid] == n:  # a leaf: its suffix begins where its path does
                depth = path[-1] + n - begin[kid]
                leaf_at[n - depth] = len(depths)
                leaves.append(n - depth)
                depths.append(depth)
                depths.append(path[-1])
            else:
                depth = path[-1] + close[kid] - begin[kid]
                depths.append(depth)
                stack.append(kid)
                path.append(depth)
        return np.frombuffer(depths, np.int32), np.frombuffer(leaf_at, np.int32), np.frombuffer(leaves, np.int32)


class RangeMinimum:
    """Minima of ranges in constant time: of whole blocks by doubling, at the ends by running minima."""

    BLOCK = 32

    def __init__(self, values: np.ndarray):
        b, top = self.BLOCK, np.iinfo(np.int32).max
        blocks = np.full((-(-len(values) // b)) * b, top, np.int32)
        blocks[: len(values)] = values
        blocks = blocks.reshape(-1, b)
        self.values = values
        self.from_left = np.minimum.accumulate(blocks, axis=1).ravel()
        self.from_right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        self.levels = [blocks.min(axis=1)]
        while (step := 1 << (len(self.levels) - 1)) * 2 <= len(blocks):
            row = self.levels[-1]
            self.levels.append(np.minimum(row[:-step], row[step:]))

    def between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Minimum from place a to place b, both included, for arrays of places."""
        low, high = np.minimum(a, b), np.maximum(a, b)
        i, j = low // self.BLOCK, high // self.BLOCK
        out = np.minimum(self.from_right[low], self.from_left[high])
        inner = np.flatnonzero(j - i > 1)
        if len(inner):
            first, last = i[inner] + 1, j[inner] - 1
            level = np.log2(last - first + 1).astype(np.int64)
            for k in np.unique(level):
                of = level == k
                row = self.levels[k]
                best = np.minimum(row[first[of]], row[last[of] - (1 << int(k)) + 1])
                out[inner[of]] = np.minimum(out[inner[of]], best)
        within = np.flatnonzero(i == j)
        if len(within):  # both in one block: at most BLOCK steps
            lo, hi = low[within], high[within]
            best = self.values[lo].copy()
            for k in range(1, int((hi - lo).max()) + 1):
                np.minimum(best, self.values[np.minimum(lo + k, hi)], out=best)
            out[within] = best
        return out


class Lce:
    """Longest common extensions of a sequence to the right, in constant time."""

    def __init__(self, symbols: list[int]):
        depths, self.leaf, self.order = SuffixTree(symbols).tour()
        self.minimum, self.n = RangeMinimum(depths), len(symbols)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols from places a and b on are equal; places up to the length, a != b."""
        return self.minimum.between(self.leaf[a], self.leaf[b]).astype(np.int64)


def _next_smaller(ranks: list[int]) -> list[int]:
    """For each place the next one with a smaller rank."""
    out, stack = [0] * len(ranks), []
    for i, r in enumerate(ranks):
        while stack and ranks[stack[-1]] > r:
            out[stack.pop()] = i
        stack.append(i)
    for i in stack:
        out[i] = len(ranks)
    return out


def maximal_runs(symbols: list[int], options: RunOptions = RunOptions()) -> list[tuple[int, int, int]]:
    """(start, period, length) of every run of a sequence of small numbers, by start, then period."""
    n = len(symbols)
    if n < options.least_words:
        return []
    right = Lce(symbols)
    left = Lce(symbols[::-1])
    ranks = np.empty(n + 1, np.int64)
    ranks[right.order] = np.arange(n + 1)
    found = []
    # The end counts as a symbol of its own: the largest under one order, the smallest under its reverse.
    for signed in (ranks, -ranks):
        ends = np.array(_next_smaller(signed.tolist())[:n], np.int64)
        at = np.arange(n, dtype=np.int64)
        fits = ends < n
        i, j = at[fits], ends[fits]
        ahead = right(i, j)
        inner = i > 0
        behind = np.zeros(len(i), np.int64)
        behind[inner] = left(n - i[inner], n - j[inner])
        period = j - i
        length = ahead + behind + period
        good = (length >= options.least_exponent * period) & (length >= options.least_words) & (length >= 2 * period)
        found.append(np.stack([i[good] - behind[good], period[good], length[good]], axis=1))
    return [tuple(r) for r in np.unique(np.concatenate(found), axis=0).tolist()]


def _stretches(symbols: list[int], options: RunOptions) -> list[tuple[int, int]]:
    """Bounds of the stretches that can hold a run: each symbol of one occurs in it often enough."""
    often, least = options.least_exponent, max(options.least_words, options.least_exponent)
    done, todo = [], [(0, len(symbols))]
    while todo:
        a, b = todo.pop()
        if b - a < least:
            continue
        counts = Counter(symbols[a:b])
        rare = {s for s, c in counts.items() if c < often}
        if not rare:
            done.append((a, b))
            continue
        cut = [k for k in range(a, b) if symbols[k] in rare]
        todo += [(x + 1, y) for x, y in zip([a - 1, *cut], [*cut, b]) if y - x > least]
    return sorted(done)


def runs(words: list[str], options: RunOptions = RunOptions()) -> list[tuple[int, int, int]]:
    """(start, period, length) of every run of the words, by start, then period."""
    found = []
    for a, b in _stretches(words, options):
        numbers: dict[str, int] = {}
        symbols = [numbers.setdefault(w, len(numbers)) for w in words[a:b]]
        found += [(a + s, p, n) for s, p, n in maximal_runs(symbols, options)]
    return found


def collapsed(words: list[str], found: list[tuple[int, int, int]]) -> list[str]:
    """The words without those that any run holds after its first period."""
    if not found:
        return words
    change = [0] * (len(words) + 1)
    for start, period, length in found:
        change[start + period] += 1
        change[start + length] -= 1
    return [w for w, c in zip(words, accumulate(change)) if not c]


def strongest(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest exponent."""
    best = None
    for run in found:  # by start and period, so only a greater exponent takes over
        if best is None or run[2] * best[1] > best[2] * run[1]:
            best = run
    return best


def _mapped(docs: DataFrame, schema: str, row: Callable[[object, list[str]], tuple], options: RunOptions) -> DataFrame:
    kind = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    names = [f.split()[0] for f in schema.split(", ")]
    types = {"bigint": pa.int64(), "string": pa.string()}
    arrow = pa.schema([(n, types[f.split()[1]]) for n, f in zip(names, schema.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [row(d.as_py(), _WORD.findall(t.as_py() or "")) for d, t in zip(batch.column(0), batch.column(1))]
            columns = [pa.array(c, f.type) for c, f in zip(zip(*out), arrow)] if out else [pa.array([], f.type) for f in arrow]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return kind.mapInArrow(run, schema)


def find(docs: DataFrame, options: RunOptions = RunOptions()) -> DataFrame:
    """doc_id and, for each run, its first word's number, period and length in words: a row per run."""

    def row(doc: int | None, words: list[str]) -> tuple:
        return doc, ";".join(f"{s},{p},{n}" for s, p, n in runs(words, options))

    listed = _mapped(docs, "doc_id bigint, runs string", row, options)
    rows = listed.filter("runs <> ''").select("doc_id", F.explode(F.split("runs", ";")).alias("r"))
    return rows.selectExpr("doc_id", *(f"cast(split(r, ',')[{k}] as bigint) as {c}" for k, c in enumerate(("start", "period", "length"))))


def without_repeats(docs: DataFrame, options: RunOptions = RunOptions()) -> DataFrame:
    """doc_id and the words that remain when every run keeps one period, joined by one space."""
    return _mapped(docs, "doc_id bigint, text string", lambda d, w: (d, " ".join(collapsed(w, runs(w, options)))), options)


def looped(doc: int | None, words: list[str]) -> list[str]:
    """The contract's words: for a tenth of the ids the text ends in a loop. NULL ids keep theirs."""
    n = len(words)
    if doc is None or not n:
        return words
    h = zlib.crc32(str(doc).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


DIGEST = (
    "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint,"
    " runs_sha256 string, collapsed_sha256 string"
)


def digest(docs: DataFrame, options: RunOptions = RunOptions()) -> DataFrame:
    """Per document the number of runs, the strongest one, and checksums of all runs and of what collapsing leaves."""

    def row(doc: int | None, words: list[str]) -> tuple:
        words = looped(doc, words)
        found = runs(words, options)
        best = strongest(found)
        listed = "".join(f"{s},{n},{p}\n" for s, p, n in found)
        text = " ".join(collapsed(words, found))
        of_best = (best[0], best[2], best[1], 1000 * best[2] // best[1]) if best else (None,) * 4
        return doc, len(found), *of_best, *(hashlib.sha256(x.encode()).hexdigest() for x in (listed, text))

    return _mapped(docs, DIGEST, row, options)
