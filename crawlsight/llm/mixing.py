"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are shuffled (by a digest of their ids). Every copy of a
document gets a virtual finish time: the words of its source up to its own end,
divided by the source's target. All copies are ordered by it over the whole table
and cut at the total budget. A source's second pass follows its first, so a
document is taken at most ``CAP`` times.

* NULL text has size 0; documents of size 0 cost nothing and follow their place.
* NULL source is a source of its own, ordered last.
* Rows that share an id (NULL ids too) are numbered, and each copy has a place of its own, so
  no id weighs more than a row. Which copy of one id is taken may depend on the order of the files;
  all else is the same on every run.
* Very long texts count whole; the last document that fits ends the mix, so the words taken
  fall short of the budget by less than one document.
* An empty table gives no rows. Further columns are ignored, or kept by ``mixed``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crawlsight.llm.common import n_words, running
from crawlsight.session import stage

#: Copies of one document at most.
CAP = 2


@dataclass(frozen=True)
class MixOptions:
    weights: tuple[int, ...] = (3, 1, 2)  # of the sources in order, repeating
    share: float = 1.5  # of all words
    seed: str = "mix"
    bucket_rows: int = 2_000  # rows that are ordered at a time
    buckets: int = 100_000  # at most, so that the totals of all buckets stay a small table


_ID = "coalesce(cast({}doc_id as string), '')"


def _sized(row: str = "") -> list:
    return [F.col(f"{row}doc_id").alias("doc_id"), F.col(f"{row}source").alias("source"), F.expr(n_words(f"{row}text")).alias("size")]


def _place(seed: str, row: str = "", copy: str | None = None):
    """The place of a document is a digest of its id, and from the second copy on of the copy's number."""
    more = "''" if copy is None else f"if({copy} = 0, '', concat(':', {copy}))"
    return F.expr(f"md5(cast(concat({_ID.format(row)}, ':{seed}', {more}) as binary))").alias("place")


def _repeated(docs: DataFrame) -> DataFrame:
    """Staged: ids of more than one row, as text."""
    ids = docs.select(F.expr(_ID.format("")).alias("again")).groupBy("again").agg(F.count("*").alias("n"))
    return stage(ids.filter("n > 1").select("again"), "mix_repeated")


def _numbered(rows: DataFrame, options: MixOptions) -> DataFrame:
    """Rows with ``copy``, their number among those of one id. Counted by ranges of ``row``, so an id may hold any share of them."""
    keyed = rows.select("*", F.expr(_ID.format("")).alias("again"), F.expr(f"row div {options.bucket_rows}").alias("range"), F.lit(1).alias("one"))
    return running(keyed, ["again"], "range", ["row"], {"upto": "one"}).withColumn("copy", F.col("upto") - 1).drop("again", "range", "one", "upto")


def targets(sizes: DataFrame, options: MixOptions) -> DataFrame:
    """One row per source: source, source_rank, source_size, target.

    A source is capped if the level at which it reaches its cap costs no more than
    the budget; the others share the rest by weight.
    """
    every = Window.partitionBy(F.lit(1))
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = totals.select("*", (F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())) - 1).alias("source_rank"))
    weights = F.array(*(F.lit(w) for w in options.weights))
    rows = ranked.select(
        "*",
        F.element_at(weights, (F.col("source_rank") % len(options.weights) + 1).cast("int")).alias("weight"),
        (F.col("source_size") * CAP).alias("cap"),
        (F.sum("source_size").over(every) * options.share).alias("budget"),
    ).withColumn("level", F.col("cap") / F.col("weight"))
    upto = every.orderBy("level").rangeBetween(Window.unboundedPreceding, 0)
    rows = rows.select(
        "*",
        (
            F.sum("cap").over(upto) + F.col("level") * (F.sum("weight").over(every) - F.sum("weight").over(upto))
            <= F.col("budget")
        ).alias("capped"),
    )
    spent = F.sum(F.expr("if(capped, cap, 0)")).over(every)
    open_weight = F.sum(F.expr("if(capped, 0, weight)")).over(every)
    share = F.expr("weight") * ((F.col("budget") - spent) / F.nullif(open_weight, F.lit(0)))
    return rows.select(
        "source",
        "source_rank",
        "source_size",
        F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(share).alias("target"),
        "budget",
    )


def _cuts(sizes: DataFrame, sources: DataFrame, options: MixOptions) -> DataFrame:
    """Sources with the last place taken in each pass (NULL: none)."""
    buckets = min(options.buckets, max(1, -(-sizes.count() // options.bucket_rows)))
    rows = sizes.join(sources.withColumnRenamed("source", "_source"), F.expr("source <=> _source")).select(
        "source_rank",
        "source_size",
        "target",
        "budget",
        "doc_id",
        "size",
        "place",
        F.expr(f"cast(conv(substring(place, 1, 8), 16, 10) as bigint) * {buckets} div 4294967296").alias("part"),
    )
    key = ["place", "doc_id", "size"]
    summed = running(rows, ["source_rank"], "part", key, {"words": "size"})
    copies = summed.select(
        "source_rank",
        "size",
        "place",
        "doc_id",
        "target",
        "budget",
        F.posexplode(F.expr(f"transform(sequence(0, {CAP - 1}), p -> words + p * source_size)")).alias("turn", "end"),
    ).select("*", F.coalesce(F.try_divide(F.col("end"), F.col("target")), F.lit(0.0)).alias("finish"))
    # Finish times run evenly by construction, so equal steps are even ranges.
    ranged = copies.withColumn("step", F.floor(F.col("finish") * buckets)).withColumn("one", F.lit(0))
    order = ["finish", "source_rank", "turn", *key]
    taken = running(ranged, ["one"], "step", order, {"spent": "size"}).filter("spent <= budget")
    last = [F.max(F.when(F.col("turn") == p, F.struct(*key))).alias(f"last{p}") for p in range(CAP)]
    return sources.join(taken.groupBy("source_rank").agg(*last), "source_rank", "left")


def _copies() -> str:
    key = "struct(place, doc_id, size)"
    return " + ".join(f"if(coalesce({key} <= last{p}, false), 1, 0)" for p in range(CAP))


def _sizes(docs: DataFrame, options: MixOptions, whole: bool) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Staged sizes with places; the ids of more than one row; and if there are any their rows with places, ``whole`` ones as ``_row``."""
    again = _repeated(docs)
    if again.isEmpty():
        return stage(docs.select(*_sized(), _place(options.seed)), "mix_sizes"), again, None
    rows = docs.select(F.struct("*").alias("_row"), F.expr(_ID.format("")).alias("_again"))
    same_id = F.col("_again") == F.col("again")
    kept = ["_row"] if whole else []
    copies = rows.join(again, same_id, "left_semi").select(*kept, *_sized("_row."), F.monotonically_increasing_id().alias("row"))
    copies = stage(copies, "mix_copies")
    numbers = _numbered(copies.drop(*kept), options)
    numbers = stage(numbers.select("*", _place(options.seed, copy="copy")), "mix_numbers")
    single = docs.select(*_sized(), F.expr(_ID.format("")).alias("_again")).join(again, same_id, "left_anti")
    fields = ["doc_id", "source", "size", "place"]
    sizes = single.select("doc_id", "source", "size", _place(options.seed)).unionByName(numbers.select(*fields))
    return stage(sizes, "mix_sizes"), again, copies.join(numbers.select("row", "place"), "row")


def mix(docs: DataFrame, options: MixOptions = MixOptions()) -> DataFrame:
    """doc_id, size, source_size, target, taken (words, copies counted)."""
    sizes, _, _ = _sizes(docs, options, False)
    cuts = stage(_cuts(sizes, targets(sizes, options), options), "mix_cuts").withColumnRenamed("source", "_source")
    return sizes.join(cuts, F.expr("source <=> _source")).select(
        "doc_id", "size", "source_size", "target", F.expr(f"cast(size * ({_copies()}) as bigint)").alias("taken")
    )


def mixed(docs: DataFrame, options: MixOptions = MixOptions()) -> DataFrame:
    """The documents of the mix with all their columns, repeated as often as taken.

    What is taken is known from each source's last place, so texts aren't shuffled, but for those of repeated ids.
    """
    sizes, again, copies = _sizes(docs, options, True)
    cuts = stage(_cuts(sizes, targets(sizes, options), options), "mix_cuts").withColumnRenamed("source", "_source")
    cuts = cuts.drop("source_rank", "source_size", "target", "budget")
    rows = docs.select(F.struct("*").alias("_row"))
    if copies is not None:
        rows = rows.select("_row", F.expr(_ID.format("_row.")).alias("_again")).join(again, F.col("_again") == F.col("again"), "left_anti")
    fields = ["_row", "doc_id", "source", "size", "place"]
    rows = rows.select("_row", *_sized("_row."), _place(options.seed, "_row."))
    if copies is not None:
        rows = rows.unionByName(copies.select(*fields))
    taken = rows.join(cuts, F.expr("source <=> _source")).select("_row", F.explode(F.expr(f"array_repeat(0, {_copies()})")).alias("_"))
    return taken.select("_row.*")
