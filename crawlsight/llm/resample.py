"""Importance resampling towards a target corpus.

A feature is a run of up to ``max_words`` consecutive words; its bucket is a checksum. How
often every bucket occurs in the documents and in the target texts gives its gain, a
document's weight is the sum of gains over its features: an array of gains that the
document's array of buckets looks up. A noise term that is a function of the id turns the
highest scores into a draw in proportion to the weights.

The cut is found without sorting the table: scores are staged, and counting jobs narrow the
range that holds the last drawn score, then, among rows with that score, the last id, then
the last row. Only drawn rows are dealt out by range of score and numbered.

* NULL and empty texts have no features, weight 0, and are not drawn. A text of any length
  is one array of buckets, at 4 bytes a feature.
* Equal scores go to the smaller id, NULL ids last; a NULL id's noise is that of an empty id.
* Repeated rows are drawn each by itself; if the cut falls among rows of one id and score,
  the place in the staged table decides.
* Empty documents give no rows; without target texts the gains are those of counts 0.
  Further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlsight.llm.common import sql_pattern
from crawlsight.session import stage

#: What stands between words, as a Java pattern.
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class ResampleOptions:
    max_words: int = 1  # longest run that is a feature
    buckets: int = 10_000
    seed: str = "2024"
    least: int = 20  # words of a document that may be drawn
    percent: int = 10  # of those documents are drawn
    cuts: int = 31  # values that one counting job tries


def _buckets(text: str, options: ResampleOptions) -> list[Column]:
    """The number of words, and the bucket of every feature."""
    lowered = f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = f"array_remove(split({lowered}, {sql_pattern(_BETWEEN)}), '')"

    def bucket(x: str) -> str:
        return f"cast(crc32(cast({x} as binary)) % {options.buckets} as int)"

    runs = [f"transform(w, x -> {bucket('x')})"]
    for n in range(2, options.max_words + 1):
        run = bucket("array_join(slice(w, i, " + str(n) + "), ' ')")
        runs.append(f"if(size(w) >= {n}, transform(sequence(1, size(w) - {n - 1}), i -> {run}), array())")
    every = runs[0] if len(runs) == 1 else f"concat({', '.join(runs)})"
    return [F.expr(words).alias("w")], [F.expr("size(w)").alias("n_words"), F.expr(every).alias("buckets")]


def _featured(rows: DataFrame, options: ResampleOptions, *kept: Column) -> DataFrame:
    first, then = _buckets("text", options)
    names = [f"_c{k}" for k in range(len(kept))]
    rows = rows.select(*(c.alias(n) for n, c in zip(names, kept)), *first)
    return rows.select(*names, *then)


def _counts(featured: DataFrame, name: str) -> DataFrame:
    return featured.select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count("*").alias(name))


def gains(documents: DataFrame, target: DataFrame, options: ResampleOptions) -> list[int]:
    """The gain of each bucket, from two tables with arrays ``buckets``; as many numbers as there are buckets."""
    spark, n = documents.sparkSession, options.buckets
    both = (
        spark.range(n)
        .select(F.col("id").cast("int").alias("bucket"))
        .join(_counts(documents, "s"), "bucket", "left")
        .join(_counts(target, "t"), "bucket", "left")
        .selectExpr("bucket", "coalesce(s, 0L) as s", "coalesce(t, 0L) as t")
    )
    every = Window.partitionBy(F.lit(1))  # the buckets, no more
    rows = both.select("*", F.sum("s").over(every).alias("ss"), F.sum("t").over(every).alias("tt"))
    ratio = f"(cast(t + 1 as double) * (ss + {n})) / (cast(s + 1 as double) * (tt + {n}))"
    rows = rows.selectExpr("bucket", f"cast(floor(1000D * ln({ratio})) as bigint) as gain").orderBy("bucket").collect()
    return [r.gain for r in rows]


def scores(documents: DataFrame, target: DataFrame, options: ResampleOptions = ResampleOptions()) -> DataFrame:
    """row, doc_id, n_words, n_features, weight, score of every document, staged."""
    featured = stage(
        _featured(documents, options, F.col("doc_id").cast("bigint"), F.monotonically_increasing_id())
        .withColumnsRenamed({"_c0": "doc_id", "_c1": "row"}),
        "resample_buckets",
    )
    table = gains(featured, _featured(target, options), options)
    listed = f"cast(split('{','.join(map(str, table))}', ',') as array<bigint>)"
    weighed = featured.selectExpr(
        "row",
        "doc_id",
        "cast(n_words as bigint) as n_words",
        "cast(size(buckets) as bigint) as n_features",
        f"aggregate(buckets, 0L, (a, b) -> a + get({listed}, b)) as weight",
        f"cast(conv(substring(sha2(concat('{options.seed}:', coalesce(cast(doc_id as string), '')), 256), 1, 8), 16, 10) as bigint) as h",
    )
    noise = "cast(floor(-1000D * ln(-ln((h + 0.5D) / 4294967296D))) as bigint)"
    return stage(weighed.selectExpr("*", f"weight + {noise} as score").drop("h"), "resample_scores")


def nth(rows: DataFrame, value: Column, n: int, cuts: int = 31) -> int:
    """The ``n``-th smallest integer ``value`` of the rows (which have as many at least).

    Every round is one job that counts the rows up to each of a few values between the
    bounds, and takes the narrowest range that still holds the answer.
    """
    low, high = rows.agg(F.min(value), F.max(value)).first()
    while low < high:
        step = max(1, (high - low) // (cuts + 1))
        tried = list(range(low, high, step))[: cuts + 1]
        found = rows.agg(*(F.count_if(value <= F.lit(x)) for x in tried)).first()
        enough = [x for x, c in zip(tried, found) if c >= n]
        short = [x for x, c in zip(tried, found) if c < n]
        high = min(enough, default=high)
        low = max(short, default=low - 1) + 1
    return low


def _drawn(rows: DataFrame, total: int, options: ResampleOptions) -> Column:
    """Whether a row is among the ``total`` highest, as a condition on score, id and place."""
    if total == 0:
        return F.lit(False)
    score, doc, row = F.col("score"), F.col("doc_id"), F.col("row")
    cut = -nth(rows, -score, total, options.cuts)
    tied = rows.filter(score == cut)
    above, ties = rows.agg(F.count_if(score > cut), F.count_if(score == cut)).first()
    open_ = total - above
    if open_ == ties:
        return score >= cut
    known = tied.filter(doc.isNotNull())
    with_id = known.count()
    if open_ <= with_id:
        last = nth(known, doc, open_, options.cuts)
        before, same = known.agg(F.count_if(doc < last), F.count_if(doc == last)).first()
        earlier, of_last = doc < last, doc == last
    else:
        before, same = with_id, ties - with_id
        earlier, of_last = doc.isNotNull(), doc.isNull()
    if open_ - before < same:
        of_last &= row <= nth(tied.filter(of_last), row, open_ - before, options.cuts)
    return (score > cut) | ((score == cut) & F.coalesce(earlier | of_last, F.lit(False)))


def resample(documents: DataFrame, target: DataFrame, options: ResampleOptions = ResampleOptions()) -> DataFrame:
    """doc_id, n_features, weight, score, rank (NULL if not drawn) of every document."""
    scored = scores(documents, target, options)
    may = F.col("n_words") >= options.least
    eligible = scored.filter(may)
    total = options.percent * eligible.count() // 100
    drawn = may & _drawn(eligible, total, options)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row")]
    # Sorted ranges: a row's rank is its place in its range after all rows of the ranges before.
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranges = stage(
        scored.filter(drawn).repartitionByRange(*order).sortWithinPartitions(*order)
        .select("*", F.spark_partition_id().alias("part"), place.alias("place")),
        "resample_ranges",
    )
    earlier = Window.partitionBy(F.lit(1)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranges.groupBy("part").agg(F.count("*").alias("n"))  # a row per range
    offsets = sizes.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    fields = ["doc_id", "n_features", "weight", "score"]
    ranked = ranges.join(F.broadcast(offsets), "part").select(*fields, (F.col("before") + F.col("place") + 1).alias("rank"))
    rest = scored.filter(~drawn).select(*fields, F.lit(None).cast("bigint").alias("rank"))
    return rest.unionByName(ranked)


def selected(documents: DataFrame, target: DataFrame, options: ResampleOptions = ResampleOptions()) -> DataFrame:
    """The drawn documents with all their columns and a last column ``_rank``; documents need distinct ids."""
    ranks = resample(documents, target, options).filter("rank is not null").selectExpr("doc_id as _id", "rank as _rank")
    return documents.join(ranks, F.col("doc_id").eqNullSafe(F.col("_id"))).drop("_id")
