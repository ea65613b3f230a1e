"""Near duplicates by bottom-k sketches.

One hash function orders all shingles; the ``sketch`` smallest values of a set are its
sketch. Inverted lists of retained values propose pairs, the sketch of the union
estimates their similarity, and exact Jaccard similarity of the whole sets decides.

What keeps this complete and still far from all pairs:

* Texts with the same words are one class, compared once.
* Two sets with similarity 0.8 share 4/5 of a sketch on average, and at least c values,
  six standard deviations below (exactly where sets fit into sketches). Sketches of s
  values that share c also share one among the rarest s - c + 1 of each (prefix filter),
  so only those are indexed. Any value may be among them; none is dropped for being frequent.
* Pairs are left out before the estimate only if their sizes rule the similarity out.
* In each list all members are first compared with one leader, the member whose values
  are least its own, then those of other components with further leaders. Members of
  one component need no links among each other.
* The rest of a list, the members far from the leader, are compared with each other.
  With members near the leader they can only be linked if the distances differ by at
  most 0.2 (Jaccard distance is a metric), so only those pairs are compared. Where the
  distance wasn't taken, sizes alone decide.

* NULL, blank text: an empty set, linked with nothing, kept. One word is one shingle.
* NULL ids: never linked, component_id NULL, kept.
* Rows that share an id are one node; repeated rows are returned as often as they occur.
* An empty table gives no rows. Further columns are ignored, or kept by ``kept_documents``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlsight.session import stage


@dataclass(frozen=True)
class NearOptions:
    shingle: int = 5  # words
    similarity: float = 0.8
    sketch: int = 64  # values retained
    estimate: float = 0.55  # pairs estimated below aren't verified: 5 standard deviations below 0.8
    distance: float = 0.3  # the same where distances up to 0.4 are needed: 5 below 0.6
    rounds: int = 2  # leaders that members are compared with before the rest of a list
    pair_list: int = 64  # members up to which the rest of a list is paired by a join
    block: int = 250_000  # shingles of a block of a longer list
    broadcast_rows: int = 500_000  # lists of ids up to this length (about 60 MB) are broadcast


# --- Sketches ---------------------------------------------------------------


class _WordHashes(dict):
    """64-bit hash of each word, remembered for a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 100_000:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(words: list[bytes], size: int, hashes: dict) -> np.ndarray:
    """Sorted distinct hashes (63 bits) of the shingles; fewer words are one shingle."""
    if not words:
        return np.empty(0, np.int64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    width = min(size, len(words))
    n = len(words) - width + 1
    with np.errstate(over="ignore"):
        x = np.full(n, width, np.uint64)
        for k in range(width):
            x = _mix(x * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n])
    return np.unique(x >> np.uint64(1)).view(np.int64)


def split_words(text: bytes) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return text.lower().split()


_SKETCH = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary()), ("n", pa.int64()), ("sketch", pa.list_(pa.int64()))])


def sketches(docs: DataFrame, options: NearOptions) -> DataFrame:
    """doc_id, digest of the words, n (set size), sketch, per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                rows = batch.slice(at, 512)
                digest, n, kept = [], [], []
                for text in rows.column(1).cast(pa.binary()):
                    words = split_words(text.as_py() or b"")
                    x = shingle_hashes(words, options.shingle, hashes)
                    digest.append(hashlib.md5(b" ".join(words)).digest())
                    n.append(len(x))
                    kept.append(x[: options.sketch])
                arrays = [rows.column(0), pa.array(digest, pa.binary()), pa.array(n, pa.int64()), pa.array(kept, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(arrays, schema=_SKETCH)

    return docs.selectExpr("cast(doc_id as bigint) as doc_id", "text").mapInArrow(
        run, "doc_id bigint, digest binary, n bigint, sketch array<bigint>"
    )


# --- Candidates -------------------------------------------------------------


def _only(df: DataFrame, ids: DataFrame, on: str, options: NearOptions) -> DataFrame:
    """Rows of ``df`` with ids in ``ids`` (staged); without a shuffle of ``df`` while the list is short."""
    small = ids.count() <= options.broadcast_rows
    ids = ids.select(F.col(ids.columns[0]).alias("_id"))
    return df.join(F.broadcast(ids) if small else ids, F.col(on) == F.col("_id"), "left_semi")


def _index(nodes: DataFrame, options: NearOptions) -> DataFrame:
    """Inverted lists: value, id, n, own, for the rarer values of each sketch.

    ``own`` counts values found in no other sketch. Larger sets may still hold them above
    their sketch, so it says nothing about what whole sets share.
    """
    k, t = options.sketch, options.similarity
    values = nodes.select("id", F.expr("n * 128 + size(sketch)").alias("meta"), F.explode("sketch").alias("value"))
    shared = values.groupBy("value").agg(F.count("*").alias("df")).filter("df > 1")
    rows = values.join(shared, "value").groupBy("id", "meta").agg(F.array_sort(F.collect_list(F.struct("df", "value"))).alias("v"))
    rows = rows.select("id", F.expr("meta div 128").alias("n"), F.expr("cast(meta % 128 as int)").alias("s"), "v")
    # The least number of values that two sketches of similar sets share.
    common = (
        f"if(n <= {k}, least(ceil({t}D * n), {k} * 3 div 4),"
        f" floor({t * k}D - 6 * sqrt({t * (1 - t) * k}D * (1 - {k} * {t}D / n))))"
    )
    rows = rows.select("id", "n", "s", (F.col("s") - F.size("v")).alias("own"), "v", F.expr(common).alias("common"))
    rows = rows.select("id", "n", "own", F.explode(F.expr("slice(v, 1, cast(greatest(0, s - common + 1 - own) as int))")).alias("e"))
    return rows.select("id", "n", "own", F.col("e.value").alias("value"))


def _alike(a: str, b: str, similarity: float) -> str:
    """SQL: the sizes of both sets allow the similarity."""
    return f"least({a}n, {b}n) >= {similarity}D * greatest({a}n, {b}n) - 1e-6D"


def _far(a: str, options: NearOptions) -> str:
    """SQL: not known to be similar to the leader."""
    return f"({a}d is null or {a}d > {1 - options.similarity}D)"


def _estimated(pairs: DataFrame, nodes: DataFrame, least: float, options: NearOptions) -> DataFrame:
    """Pairs (a, b) whose similarity, estimated from the sketch of the union, is at least ``least``."""
    k = options.sketch
    a = nodes.select(F.col("id").alias("a"), F.col("sketch").alias("sa"))
    b = nodes.select(F.col("id").alias("b"), F.col("sketch").alias("sb"))
    both = pairs.join(a, "a").join(b, "b")
    both = both.select("a", "b", "sa", "sb", F.expr(f"slice(array_sort(array_union(sa, sb)), 1, {k})").alias("u"))
    share = F.expr("size(array_intersect(array_intersect(u, sa), sb)) / size(u)")
    return both.select("a", "b", share.alias("estimate")).filter(F.col("estimate") >= least).select("a", "b").distinct()


# --- Exact similarity -------------------------------------------------------


def _shingle_set(text: bytes, size: int) -> set:
    words = split_words(text)
    if len(words) < size:
        return {tuple(words)} if words else set()
    return set(zip(*(words[k:] for k in range(size))))


def _verified(pairs: DataFrame, docs: DataFrame, options: NearOptions) -> DataFrame:
    """a, b and the exact Jaccard similarity of their whole shingle sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, set()
        for batch in batches:
            out = []
            for ta, tb in zip(batch.column(2).cast(pa.binary()), batch.column(3).cast(pa.binary())):
                ta, tb = ta.as_py() or b"", tb.as_py() or b""
                if ta != last:
                    last, held = ta, _shingle_set(ta, options.shingle)
                other = _shingle_set(tb, options.shingle)
                common = len(held & other)
                union = len(held) + len(other) - common
                # In whole numbers first, so the bound itself is exact.
                out.append(common / union if union else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64())], names=["a", "b", "jaccard"])

    pairs = stage(pairs, "near_pairs")
    ids = stage(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "near_ids")
    texts = _only(docs.selectExpr("cast(doc_id as bigint) as doc_id", "text"), ids, "doc_id", options)
    a = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta"))
    b = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))
    both = pairs.join(a, "a").join(b, "b").select("a", "b", "ta", "tb")
    return both.mapInArrow(run, "a bigint, b bigint, jaccard double").groupBy("a", "b").agg(F.max("jaccard").alias("jaccard"))


# --- Components -------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for every id in the edges (a, b) but the roots; the root is the smallest id.

    Alternating stars: all larger neighbours of a node are tied to its smallest one, then
    all smaller ones, until nothing changes. Every step is a partial aggregation and a
    join of the edges.
    """
    now = stage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    before = None
    while True:
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if mark == before or not mark.n:
            return now.select(F.col("u").alias("id"), F.col("v").alias("root"))
        before = mark
        ways = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = ways.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = ways.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        now = stage(small.select("e.u", "e.v").filter("u <> v").distinct(), "edges")


def _linked_blocks(options: NearOptions):
    """Links between two blocks of a list (or within one): one for each pair of components."""

    def run(key, table):
        p, q = key[1].as_py(), key[2].as_py()
        ids, block, root = (table.column(k).to_numpy() for k in ("id", "part", "root"))
        far = table.column("far").to_numpy(zero_copy_only=False)
        sets = table.column("hashes").combine_chunks()
        n = np.diff(sets.offsets.to_numpy())
        _, at = np.unique(sets.flatten().to_numpy(), return_inverse=True)
        ends = np.concatenate([[0], np.cumsum(n)])
        mark = np.zeros(int(at.max()) + 1 if len(at) else 1, np.int32)
        found: dict[tuple[int, int], tuple[int, int]] = {}
        for k in np.flatnonzero(far):
            mark[at[ends[k] : ends[k + 1]]] = 1
            common = np.add.reduceat(mark[at], ends[:-1])
            mark[at[ends[k] : ends[k + 1]]] = 0
            alike = common >= (options.similarity - 1e-9) * (n + n[k] - common)
            other = block != block[k] if p != q else True
            for j in np.flatnonzero(alike & (root != root[k]) & other):
                found.setdefault((min(root[k], root[j]), max(root[k], root[j])), (min(ids[k], ids[j]), max(ids[k], ids[j])))
        pairs = np.array(list(found.values()), np.int64).reshape(-1, 2)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return run


def _long_lists(members: DataFrame, docs: DataFrame, options: NearOptions) -> DataFrame:
    """Pairs to verify from long lists: whole sets, block by block."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256)
                sets = [shingle_hashes(split_words(t.as_py() or b""), options.shingle, hashes) for t in rows.column(1).cast(pa.binary())]
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["_id", "hashes"])

    ids = stage(members.select("id").distinct(), "near_long_ids")
    texts = _only(docs.selectExpr("cast(doc_id as bigint) as doc_id", "text"), ids, "doc_id", options)
    sets = texts.mapInArrow(hashed, "_id bigint, hashes array<bigint>")
    blocks = f"cast(ceil(weight / {options.block}D) as int)"
    rows = members.select("value", "id", "root", F.expr(_far("", options)).alias("far"), F.expr(blocks).alias("parts"))
    rows = rows.withColumn("part", F.expr("cast(pmod(xxhash64(id), parts) as int)"))
    rows = rows.select("value", "id", "root", "far", "part", F.explode(F.expr("sequence(0, parts - 1)")).alias("other"))
    rows = rows.join(sets, F.expr("id = _id")).select(
        "value", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "id", "root", "far", "part", "hashes"
    )
    return rows.groupBy("value", "p", "q").applyInArrow(_linked_blocks(options), "a bigint, b bigint")


def _rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """``rows`` with the root of their ``id``: itself if it has no link."""
    joined = rows.join(roots.withColumnRenamed("id", "_i"), F.expr("id = _i"), "left").drop("_i")
    return joined.withColumn("root", F.expr("coalesce(root, id)"))


# --- Links ------------------------------------------------------------------


def links(docs: DataFrame, sketched: DataFrame, options: NearOptions) -> DataFrame:
    """Links (a, b) between class representatives that make up all components."""
    nodes = sketched.filter("n > 0 and doc_id is not null")
    classes = stage(nodes.groupBy("digest").agg(F.min("doc_id").alias("id")), "near_classes")
    small = classes.count() <= options.broadcast_rows
    first = F.broadcast(classes) if small else classes
    nodes = nodes.join(first.select(F.col("digest").alias("_d"), "id"), F.expr("digest = _d and doc_id = id"), "left_semi")
    nodes = nodes.select(F.col("doc_id").alias("id"), "n", "sketch")
    index = stage(_index(nodes, options), "near_index")
    near, far_apart = options.similarity, 1 - options.similarity
    # The first leader is the member whose values are least its own.
    leaders = index.groupBy("value").agg(F.min(F.struct("own", "id")).alias("l"), F.count("*").alias("members")).filter("members > 1")
    lists = index.join(leaders.select("value", F.col("l.id").alias("leader")), "value")
    lists = stage(lists.select("value", "id", "n", "leader"), "near_lists")
    heads = lists.filter("id = leader").select("value", F.struct("n").alias("l"))
    to_leader = lists.filter("id <> leader").join(heads, "value").filter(_alike("", "l.", 1 - 2 * far_apart))
    stars = to_leader.select(F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b")).distinct()
    tested = stage(_verified(_estimated(stars, nodes, options.distance, options), docs, options), "near_stars")
    edges = tested.filter(F.col("jaccard") >= near).select("a", "b")
    roots = stage(components(edges), "near_roots")
    for turn in range(1, options.rounds):
        # Other leaders, different ones from list to list, for members that aren't in their component yet.
        rooted = _rooted(lists, roots)
        pick = rooted.groupBy("value").agg(F.min(F.struct(F.xxhash64("id", "value", F.lit(turn)).alias("h"), "id", "n", "root")).alias("l"))
        pairs = rooted.join(pick, "value").filter(f"root <> l.root and {_alike('', 'l.', near)}")
        pairs = pairs.select(F.least("id", "l.id").alias("a"), F.greatest("id", "l.id").alias("b")).distinct()
        more = _verified(_estimated(pairs, nodes, options.estimate, options), docs, options).filter(F.col("jaccard") >= near)
        edges = stage(edges.unionByName(more.select("a", "b")), "near_edges")
        roots = stage(components(edges), "near_roots")

    # Members of each list with their distance from the leader, if it was taken, and their component so far.
    known = tested.select(F.col("a").alias("_a"), F.col("b").alias("_b"), (1 - F.col("jaccard")).alias("d"))
    placed = (
        _rooted(lists, roots)
        .filter("id <> leader")
        .join(known, F.expr("least(id, leader) = _a and greatest(id, leader) = _b"), "left")
        .select("value", "id", "n", "d", "root")
    )
    length = placed.groupBy("value").agg(F.count("*").alias("members"), F.sum("n").alias("weight"), F.min("root").alias("r0"), F.max("root").alias("r1"))
    length = length.filter("r0 <> r1").select("value", "members", "weight")
    placed = stage(placed.join(length, "value"), "near_rest")
    short, long = placed.filter(f"members <= {options.pair_list}"), placed.filter(f"members > {options.pair_list}")
    x, y = short.alias("x"), short.alias("y")
    within = f"x.value = y.value and x.root <> y.root and {_alike('x.', 'y.', near)}"
    rest = x.filter(_far("x.", options)).join(y.filter(_far("y.", options)), F.expr(f"{within} and x.id < y.id"))
    middle = x.filter(f"{_far('x.', options)} and (x.d is null or x.d <= {2 * far_apart}D + 1e-9D)").join(
        y.filter(f"not {_far('y.', options)}"), F.expr(f"{within} and (x.d is null or x.d - y.d <= {far_apart}D + 1e-9D)")
    )
    pair = [F.expr("least(x.id, y.id)").alias("a"), F.expr("greatest(x.id, y.id)").alias("b")]
    more = _estimated(rest.select(*pair).unionByName(middle.select(*pair)).distinct(), nodes, options.estimate, options)
    late = more.unionByName(_long_lists(long, docs, options)).distinct()
    return edges.unionByName(_verified(late, docs, options).filter(F.col("jaccard") >= near).select("a", "b"))


def near_duplicates(docs: DataFrame, options: NearOptions = NearOptions()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row."""
    sketched = stage(sketches(docs, options), "near_sketches")
    sets = sketched.filter("n > 0 and doc_id is not null").select("doc_id", "digest")
    classes = sets.groupBy("digest").agg(F.min("doc_id").alias("id"))
    home = stage(sets.join(classes, "digest").select("doc_id", "id"), "near_home")
    # An id with several texts ties their classes together.
    shared = home.groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("b")).filter("a <> b").select("doc_id", "a")
    ties = home.join(shared, "doc_id").select("a", F.col("id").alias("b"))
    roots = components(links(docs, sketched, options).unionByName(ties))
    placed = home.distinct().join(roots.withColumnRenamed("id", "_i"), F.expr("id = _i"), "left")
    placed = placed.groupBy("doc_id").agg(F.min(F.expr("coalesce(root, id)")).alias("root")).withColumnRenamed("doc_id", "_id")
    rows = sketched.select("doc_id", F.col("n").alias("n_shingles")).join(placed, F.expr("doc_id = _id"), "left")
    return rows.select("doc_id", "n_shingles", F.expr("coalesce(root, doc_id)").alias("component_id")).withColumn(
        "kept", F.expr("doc_id is null or doc_id = component_id")
    )


def kept_documents(docs: DataFrame, options: NearOptions = NearOptions()) -> DataFrame:
    """The documents that stay, with all their columns: the smallest id of each component."""
    gone = stage(near_duplicates(docs, options).filter("not kept").select("doc_id").distinct(), "near_gone")
    small = gone.count() <= options.broadcast_rows
    gone = gone.select(F.col("doc_id").alias("_gone"))
    return docs.join(F.broadcast(gone) if small else gone, docs["doc_id"] == gone["_gone"], "left_anti")
