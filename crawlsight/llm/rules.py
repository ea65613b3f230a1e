"""Quality rules: a decision list learned by sequential covering.

Rules drop documents, beyond a fixed base rule. Each is a conjunction of thresholds on text rates, grown literal
by literal on two thirds of the labelled rows and pruned on the rest; the rows it covers
leave, and the next rule is learned. The driver sees counts per feature and bin only.
The list is one Spark conditional expression, applied to all documents.

* NULL or blank text: 0 words, dropped by the base rule.
* Labels with a NULL id or quality are left out; of several labels of one id the lowest counts.
* No labels, or labels of one kind: an empty list, which drops nothing.
* Repeated rows are judged alike. Further columns are ignored, or kept by ``kept_documents``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlsight.llm.features import RATES, base_counts, rates
from crawlsight.session import stage

#: The base rule of the contract.
BASE_FAILED = "n_words < 10 or 100 * n_repeat_words > 20 * n_words"


@dataclass(frozen=True)
class RuleOptions:
    bins: int = 32  # thresholds per feature
    max_rules: int = 12
    max_literals: int = 4
    min_precision: float = 0.9  # of a rule, on the pruning rows
    min_covered: int = 5  # pruning rows of label 0 that a rule must cover


@dataclass(frozen=True)
class Literal:
    feature: str
    above: bool
    threshold: float

    def sql(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold!r}D"


@dataclass(frozen=True)
class Rule:
    literals: tuple[Literal, ...]
    low: int  # pruning rows covered, by label
    good: int

    def sql(self) -> str:
        return " and ".join(x.sql() for x in self.literals)


@dataclass(frozen=True)
class DecisionList:
    rules: tuple[Rule, ...]

    def fired(self) -> Column:
        """Number of the first rule that holds, from 1; NULL if none does."""
        if not self.rules:
            return F.lit(None).cast("int")
        out = F  # F.when begins the chain
        for n, rule in enumerate(self.rules, 1):
            out = out.when(F.expr(rule.sql()), F.lit(n))
        return out


def statistics(docs: DataFrame) -> DataFrame:
    """Counts and rates of every document."""
    return base_counts(docs, more=True).select("*", *rates())


def learn(stats: DataFrame, labels: DataFrame, options: RuleOptions = RuleOptions()) -> DecisionList:
    """The decision list for ``quality`` from staged statistics, for what the base rule leaves."""
    truth = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = stats.filter(f"not ({BASE_FAILED})").join(truth, "doc_id").select(
        *RATES, (F.col("quality") == 0).alias("low"), (F.pmod(F.xxhash64("doc_id"), F.lit(3)) > 0).alias("growing")
    )
    rows = stage(rows, "rule_rows")
    marks = [k / options.bins for k in range(1, options.bins)]
    quantiles = rows.select(*(F.percentile_approx(f, marks, 2000).alias(f) for f in RATES)).first()
    cuts = {f: sorted(set(quantiles[f] or [])) for f in RATES}
    rules: list[Rule] = []
    while len(rules) < options.max_rules:
        open_rows = rows
        for rule in rules:
            open_rows = open_rows.filter(f"not ({rule.sql()})")
        rule = _pruned(open_rows, _grown(open_rows.filter("growing"), cuts, options))
        if rule is None or rule.low < options.min_covered or rule.low < options.min_precision * (rule.low + rule.good):
            break
        rules.append(_centred(open_rows, rule))
    return DecisionList(tuple(rules))


def _centred(rows: DataFrame, rule: Rule) -> Rule:
    """Thresholds halfway between the values on both sides: the same rows are covered, and
    a text that barely differs from the uncovered ones stays with them."""
    sides = [f(F.expr(f"if({x.feature} {op} {x.threshold!r}D, {x.feature}, null)")).alias(f"{side}{k}")
             for k, x in enumerate(rule.literals) for side, op, f in (("a", "<=", F.max), ("b", ">", F.min))]
    got = rows.agg(*sides).first()
    moved = []
    for k, x in enumerate(rule.literals):
        a, b = got[f"a{k}"], got[f"b{k}"]
        middle = x.threshold if a is None or b is None else (a + b) / 2
        moved.append(replace(x, threshold=middle if a is None or b is None or a <= middle < b else x.threshold))
    return replace(rule, literals=tuple(moved))


def _grown(rows: DataFrame, cuts: dict[str, list[float]], options: RuleOptions) -> list[Literal]:
    """Literals of most information gain, one after the other."""
    chosen: list[Literal] = []
    while len(chosen) < options.max_literals:
        part = rows.filter(" and ".join(x.sql() for x in chosen)) if chosen else rows
        bins = F.array(
            *(
                F.struct(F.lit(k).alias("f"), F.expr(f"size(filter(array({', '.join(f'{c!r}D' for c in cuts[f])}), c -> {f} > c))" if cuts[f] else "0").alias("b"))
                for k, f in enumerate(RATES)
            )
        )
        counted = part.select("low", F.inline(bins)).groupBy("f", "b").agg(F.count_if("low").alias("n0"), F.count("*").alias("n"))
        table = {(r.f, r.b): (r.n0, r.n - r.n0) for r in counted.collect()}  # features x bins rows
        low = sum(v[0] for (f, _), v in table.items() if f == 0)
        good = sum(v[1] for (f, _), v in table.items() if f == 0)
        if not low or not good:
            break
        best, gain = None, 1e-9
        for k, f in enumerate(RATES):
            p = n = 0
            for b, cut in enumerate(cuts[f]):
                p, n = p + table.get((k, b), (0, 0))[0], n + table.get((k, b), (0, 0))[1]
                for above, (x, y) in ((False, (p, n)), (True, (low - p, good - n))):
                    # Laplace keeps a handful of rows from looking certain.
                    g = x * (math.log2((x + 1) / (x + y + 2)) - math.log2((low + 1) / (low + good + 2)))
                    if g > gain:
                        best, gain = Literal(f, above, cut), g
        if best is None:
            break
        chosen.append(best)
    return chosen


def _pruned(rows: DataFrame, literals: list[Literal]) -> Rule | None:
    """The beginning of the conjunction that is worth most on the pruning rows."""
    if not literals:
        return None
    heads = [literals[: k + 1] for k in range(len(literals))]
    sql = [" and ".join(x.sql() for x in head) for head in heads]
    counts = rows.filter("not growing").select(
        *(F.count_if(F.expr(f"low and {s}")).alias(f"p{k}") for k, s in enumerate(sql)),
        *(F.count_if(F.expr(f"not low and {s}")).alias(f"n{k}") for k, s in enumerate(sql)),
    ).first()
    rules = [Rule(tuple(head), counts[f"p{k}"], counts[f"n{k}"]) for k, head in enumerate(heads)]
    return max(rules, key=lambda r: ((r.low - r.good) / max(1, r.low + r.good), r.low, -len(r.literals)))


def judge(docs: DataFrame, labels: DataFrame, options: RuleOptions = RuleOptions()) -> DataFrame:
    """Counts, base_failed, rule (number of the rule that drops the row) and kept, per document."""
    stats = stage(statistics(docs), "rule_statistics")
    fired = learn(stats, labels, options).fired()
    return stats.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        F.expr(BASE_FAILED).alias("base_failed"), fired.alias("rule"),
    ).withColumn("kept", F.expr("not base_failed and rule is null"))
