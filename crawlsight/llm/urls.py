"""URL filters: pattern rules, indexed by their rarest literal token.

Every rule has literal tokens that a URL must contain if the rule fits. How many URLs of
the table hold each of them is counted, and a rule is filed under its rarest. A URL's
tokens then fetch the few rules it may fit, and only those run their patterns. Rules
without a literal run on every URL.

Listed rules (a host with its subdomains, and the beginning of a path) come first; of
those that fit the longest decides. Else a pattern rule that fits decides, in the order
given, else the URL is allowed.

Only A-Z are lower-cased, in urls and rules alike: letters that a full lower-casing folds to
ASCII (such as the KELVIN SIGN) stay what they are and separate tokens, as they do for the patterns.

* Of two listed rules of one length, and of two pattern rules that fit, the first given decides.
* A url of any length is judged whole; each of its tokens is looked up once.
* NULL urls and urls without ``://`` have empty host and path, and are allowed.
* Repeated rows are judged each. An empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ASCII = str.maketrans(_UPPER, _LOWER)


@dataclass(frozen=True)
class Rule:
    name: str  # host and path of a listed rule
    action: str  # allow or block
    pattern: str  # over host + path, the host in lower case
    literals: tuple[str, ...]  # whole tokens of what it fits, in lower case
    listed: bool = False


def listed(action: str, name: str) -> Rule:
    """The rule for ``host/path``. A path's last token may go on in a URL, so it's no literal."""
    host, slash, rest = name.partition("/")
    path = slash + rest
    whole = re.findall(r"[a-z0-9]+", host.translate(_ASCII)) + re.findall(r"[a-z0-9]+(?=[^A-Za-z0-9])", path.translate(_ASCII))
    return Rule(name, action, rf"\A(?:[^/]*\.)?{re.escape(host.translate(_ASCII))}{re.escape(path)}", tuple(dict.fromkeys(whole)), True)


def on_host(action: str, *words: str) -> Rule:
    """A rule for hosts that hold the words as tokens, one right after the other."""
    run = r"[^A-Za-z0-9/]".join(map(re.escape, words))
    return Rule("-".join(words), action, rf"\A(?:[^/]*[^A-Za-z0-9/])?{run}(?![A-Za-z0-9])", words)


#: Listed rules of the contract.
LISTED = (
    listed("allow", "org/"),
    listed("block", "example.org/es/"),
    listed("block", "example.org/en/1"),
    listed("allow", "com/fr/"),
    listed("block", "com/de/"),
)
#: Hosts that sell rather than tell.
PATTERNS = (
    on_host("block", "casino"),
    on_host("block", "bets"),
    on_host("block", "pills"),
    on_host("block", "ads", "track"),
)


def split(url: str = "url") -> list:
    """Columns host (A-Z lower-cased) and path."""
    parts = r"://([^/?#]*)([^?#]*)"
    return [
        F.translate(F.coalesce(F.regexp_extract(url, parts, 1), F.lit("")), _UPPER, _LOWER).alias("host"),
        F.coalesce(F.regexp_extract(url, parts, 2), F.lit("")).alias("path"),
    ]


def frequencies(parts: DataFrame, rules: Iterable[Rule]) -> dict[str, int]:
    """How many rows of (host, path) hold each literal of the rules."""
    spark = parts.sparkSession
    literals = sorted({x for r in rules for x in r.literals})
    if not literals:
        return {}
    wanted = F.broadcast(spark.createDataFrame([(x,) for x in literals], "token string"))  # no more than the rules have
    tokens = F.array_distinct(F.expr(f"regexp_extract_all(translate(concat(host, path), '{_UPPER}', '{_LOWER}'), '[a-z0-9]+', 0)"))
    rows = parts.select(F.explode(tokens).alias("token")).join(wanted, "token").groupBy("token").count().collect()
    return {x: 0 for x in literals} | {r.token: r["count"] for r in rows}


class Index:
    """Rules by their rarest literal."""

    def __init__(self, rules: Iterable[Rule], counts: dict[str, int]):
        self.always, self.by_token = [], defaultdict(list)
        for place, rule in enumerate(rules):
            entry = (place, rule, re.compile(rule.pattern))
            if rule.literals:
                self.by_token[min(rule.literals, key=lambda x: (counts.get(x, 0), x))].append(entry)
            else:
                self.always.append(entry)

    def judge(self, host: str, path: str) -> tuple[str | None, str, str | None]:
        """Listed rule that decides, verdict, pattern rule that decides."""
        text = host + path
        found = [e for t in set(re.findall(r"[a-z0-9]+", text.translate(_ASCII))) for e in self.by_token.get(t, ())] + self.always
        fits = [(place, rule) for place, rule, pattern in found if pattern.search(text)]
        named = [(len(rule.name), -place, rule) for place, rule in fits if rule.listed]
        if named:
            best = max(named)[2]
            return best.name, best.action, None
        if fits:
            best = min(fits)[1]
            return None, best.action, best.name
        return None, "allow", None


def judge(pages: DataFrame, rules: tuple[Rule, ...] = LISTED + PATTERNS) -> DataFrame:
    """page_id, host, path, rule, verdict, pattern_rule for every page."""
    parts = pages.select("page_id", *split())
    index = Index(rules, frequencies(parts, rules))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [index.judge(h, p) for h, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            more = [pa.array([f[k] for f in found], pa.string()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=["page_id", "host", "path", "rule", "verdict", "pattern_rule"])

    return parts.withColumn("page_id", F.col("page_id").cast("bigint")).mapInArrow(
        run, "page_id bigint, host string, path string, rule string, verdict string, pattern_rule string"
    )
