"""robots.txt as tables: rules per host, and the gate for one user agent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from crawlsight.functions import text as X
from crawlsight.functions import url as U
from crawlsight.functions.sql import lit

BLOCKED = "Blocked by robots.txt"
# Rules of a host that each of its URLs goes through; the rules of larger hosts are looked up.
SCANNED = 64
_DIRECTIVES = r"^(user-agent|allow|disallow|crawl-delay|request-rate)$"


def unquote(x: str) -> str:
    """Percent-decoded text; incomplete escapes stay as they are."""
    whole = f"regexp_replace({x}, '%(?![0-9A-Fa-f]{{2}})', '%25')"
    return f"if(contains({x}, '%'), coalesce(try_url_decode(replace({whole}, '+', '%2B')), {x}), {x})"


def quote(x: str) -> str:
    """Percent-encoded text; letters, digits and ``_.-~/`` stay."""
    steps = (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%2F", "/"))
    out = f"url_encode({x})"
    for old, new in steps:
        out = f"replace({out}, '{old}', '{new}')"
    return out


def robots_rules(files: DataFrame) -> DataFrame:
    """Agent groups of each host with their ordered rules.

    ``files`` is one row per host. Files that are missing, failed or answered
    with 400 or more give no group, so everything stays allowed. A group is a run
    of agent lines and the rules after it; a blank line ends it.
    """
    usable = files.filter(f"not {X.filled('error')} and coalesce(status_code, 0) < 400")
    lines = usable.selectExpr("host", r"posexplode(split(body, '\\r\\n|[\\n\\r]')) as (pos, raw)").selectExpr(
        "host", "pos", "raw", f"{X.strip('regexp_replace(raw, {}, {})'.format(lit('#.*$'), lit('')))} as text"
    )
    parts = lines.selectExpr(
        "host",
        "pos",
        "raw = '' as blank",
        f"lower({X.strip('substring_index(text, {}, 1)'.format(lit(':')))}) as name",
        f"{X.strip('substr(text, instr(text, {}) + 1)'.format(lit(':')))} as value",
        "contains(text, ':') as pair",
    ).filter(f"blank or (pair and name rlike {lit(_DIRECTIVES)})")
    parts = parts.selectExpr(
        "host",
        "pos",
        f"{unquote('value')} as value",
        "case when blank then 'blank' when name = 'user-agent' then 'agent' else name end as kind",
    )
    by_host = W.partitionBy("host").orderBy("pos")
    starts = F.expr("kind = 'blank' or (kind = 'agent' and coalesce(before, 'blank') <> 'agent')")
    grouped = (
        parts.withColumn("before", F.lag("kind").over(by_host))
        .withColumn("group_ord", F.sum(starts.cast("int")).over(by_host))
        .groupBy("host", "group_ord")
        .agg(
            F.expr("collect_set(lower(value)) filter (where kind = 'agent') as agents"),
            F.expr("count_if(kind not in ('agent', 'blank')) as n_rules"),
            F.expr(
                "array_sort(collect_list(struct(pos, kind = 'allow' or value = '' as allow,"
                f" {quote('regexp_replace(value, {}, {})'.format(lit('[?]$'), lit('')))} as prefix))"
                " filter (where kind in ('allow', 'disallow'))) as rules"
            ),
        )
    )
    return grouped.filter("size(agents) > 0 and n_rules > 0").selectExpr(
        "host",
        "group_ord",
        "agents",
        "array_contains(agents, '*') as is_default",
        "transform(rules, r -> struct(r.allow, r.prefix)) as rules",
    )


def rules_for_agent(rules: DataFrame, user_agent: str) -> DataFrame:
    """The one group of each host that applies: the first naming the agent, else the first default."""
    product = user_agent.split("/")[0].lower()
    named = f"not is_default and exists(agents, a -> contains({lit(product)}, a))"
    return (
        rules.filter(f"is_default or ({named})")
        .groupBy("host")
        .agg(F.min_by("rules", F.struct("is_default", "group_ord")).alias("rules"))
    )


def gate(urls: DataFrame, host_rules: DataFrame, column: str = "url", scan: int = SCANNED) -> DataFrame:
    """``urls`` with a column ``allowed``: the first rule whose prefix fits decides.

    The rules of a host with at most ``scan`` of them are one array, which each of its URLs goes
    through, so they never multiply its rows. The rules of larger hosts are a table by host and
    prefix: a path looks up its own beginnings, of the lengths that its host's rules have, so
    its cost doesn't grow with the number of rules. Equal paths of a host are looked up once.

    A URL without a host, and a host without rules, is allowed. Equal prefixes of a host count as the first.
    """
    target = f"regexp_replace(regexp_replace({unquote(column)}, '^[^:/?#]+://[^/?#]*', ''), '[?]$', '')"
    path = f"coalesce(nullif({quote(target)}, ''), '/')"
    names = urls.columns
    hosts = host_rules.selectExpr(
        "host as _host",
        f"if(size(rules) <= {scan}, rules, null) as _few",
        f"if(size(rules) > {scan}, array_distinct(transform(rules, r -> length(r.prefix))), null) as _lengths",
    )
    # One key of host and path: rows grouped by host alone would keep a large host in one task.
    rows = urls.selectExpr("*", f"{U.host(column)} as _host", f"{path} as _path").join(hosts, "_host", "left")
    rows = rows.withColumn("_at", F.expr("struct(_host, _path)"))
    decided = _looked_up(rows, host_rules.filter(f"size(rules) > {scan}"))
    return rows.join(decided, "_at", "left").selectExpr(
        *(f"`{n}`" for n in names),
        "coalesce(_decision, get(filter(_few, r -> startswith(_path, r.prefix)), 0).allow, true) as allowed",
    )


def _looked_up(rows: DataFrame, host_rules: DataFrame) -> DataFrame:
    """Decision for each path of the hosts with ``_lengths``, where a rule fits."""
    prefixes = (
        host_rules.selectExpr("host as _host", "posexplode(rules) as (pos, rule)")
        .groupBy("_host", F.col("rule.prefix").alias("_prefix"))
        .agg(F.min(F.struct("pos", "rule.allow")).alias("_rule"))
    )
    paths = rows.filter("_lengths is not null").groupBy("_at").agg(F.first("_lengths").alias("_lengths"))
    return (
        paths.selectExpr("_at", "explode(filter(_lengths, n -> n <= length(_at._path))) as n")
        .selectExpr("_at", "_at._host as _host", "substr(_at._path, 1, n) as _prefix")
        .join(prefixes, ["_host", "_prefix"])
        .groupBy("_at")
        .agg(F.min("_rule").alias("_rule"))
        .selectExpr("_at", "_rule.allow as _decision")
    )
