"""Registered queries of the training-data operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlsight.llm import exact, gam, lattice, mixing, near, packing, periodic, pii, resample, rules, shards, templates, urls
from crawlsight.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: DuckDB: the words of ``text``.
WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"


def query(sql: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


@query()
def op1_quality_rules(spark, d):
    return rules.judge(table(spark, d, "documents"), table(spark, d, "labels"))


@query(
    f"""
    WITH s AS (SELECT doc_id, source, len({WORDS})::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '') || ':mix') AS place FROM documents),
    t AS (SELECT source, sum(size)::BIGINT AS source_size FROM s GROUP BY 1),
    r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k, 2 * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS budget FROM t),
    w AS (SELECT *, [3, 1, 2][(k % 3) + 1] AS weight FROM r),
    l AS (SELECT *, cap::DOUBLE / weight AS level FROM w),
    c AS (SELECT *, sum(cap) OVER x + level * (sum(weight) OVER () - sum(weight) OVER x) <= budget AS capped FROM l
          WINDOW x AS (ORDER BY level RANGE UNBOUNDED PRECEDING)),
    g AS (SELECT *, CASE WHEN capped THEN cap::DOUBLE ELSE weight * ((budget - sum(CASE WHEN capped THEN cap ELSE 0 END) OVER ())
          / sum(CASE WHEN capped THEN 0 ELSE weight END) OVER ()) END AS target FROM c),
    q AS (SELECT s.*, k, source_size, target, budget, sum(size) OVER (PARTITION BY k ORDER BY place, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto
          FROM s JOIN g ON s.source IS NOT DISTINCT FROM g.source),
    p AS (SELECT q.*, turn, coalesce((upto + turn * source_size)::DOUBLE / nullif(target, 0), 0) AS finish FROM q, (VALUES (0), (1)) v(turn)),
    o AS (SELECT *, sum(size) OVER (ORDER BY finish, k, turn, place, doc_id, size ROWS UNBOUNDED PRECEDING) <= budget AS taken FROM p)
    SELECT doc_id, size, source_size, target, sum(CASE WHEN taken THEN size ELSE 0 END)::BIGINT AS taken FROM o GROUP BY ALL
    """
)
def op2_fair_mix(spark, d):
    return mixing.mix(table(spark, d, "documents"))


@query(
    r"""
    WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS n FROM documents),
    k AS (SELECT *, first_value(doc_id) OVER (PARTITION BY n ORDER BY length(text) DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY n) AS group_size FROM t)
    SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(n) AS text_sha256 FROM k
    """
)
def op9_exact_dedup(spark, d):
    return exact.dedup(table(spark, d, "documents"))


@query()
def op4_concat_pack(spark, d):
    return packing.pieces(table(spark, d, "documents"))


@query()
def op7_kd_shards(spark, d):
    rows = shards.assign(table(spark, d, "documents"))
    return rows.select("*", F.lit("bytes").alias("law"), F.lit(None).cast("int").alias("grown_shard"))


@query()
def op10_gam_quality(spark, d):
    return gam.classify(table(spark, d, "documents"), table(spark, d, "labels"))


@query()
def op3_lattice_lm(spark, d):
    return lattice.score(table(spark, d, "documents"))


@query(
    f"""
    WITH RECURSIVE t AS (SELECT doc_id, {WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w
      ELSE list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1]) END) AS shingle FROM t),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
    p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY 1, 2),
    l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
    e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
    r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
    m AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1)
    SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM m LEFT JOIN n USING (doc_id)
    """
)
def op8_bottom_k_near(spark, d):
    return near.near_duplicates(table(spark, d, "documents"), near.NearOptions(shingle=2))


@query(
    r"""
    WITH p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
      coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
    r AS (SELECT *, CASE WHEN '.' || host LIKE '%.example.org' AND starts_with(path, '/en/1') THEN 'example.org/en/1'
      WHEN '.' || host LIKE '%.example.org' AND starts_with(path, '/es/') THEN 'example.org/es/'
      WHEN '.' || host LIKE '%.com' AND starts_with(path, '/fr/') THEN 'com/fr/'
      WHEN '.' || host LIKE '%.com' AND starts_with(path, '/de/') THEN 'com/de/'
      WHEN '.' || host LIKE '%.org' AND starts_with(path, '/') THEN 'org/' END AS rule FROM p),
    m AS (SELECT *, CASE WHEN rule IS NOT NULL THEN NULL WHEN regexp_matches(host, '(^|[^a-z0-9])casino($|[^a-z0-9])') THEN 'casino'
      WHEN regexp_matches(host, '(^|[^a-z0-9])bets($|[^a-z0-9])') THEN 'bets' WHEN regexp_matches(host, '(^|[^a-z0-9])pills($|[^a-z0-9])') THEN 'pills'
      WHEN regexp_matches(host, '(^|[^a-z0-9])ads[^a-z0-9]track($|[^a-z0-9])') THEN 'ads-track' END AS pattern_rule FROM r)
    SELECT *, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL OR pattern_rule IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict FROM m
    """
)
def op5_rarest_token_urls(spark, d):
    return urls.judge(table(spark, d, "pages"))


@query()
def op6_checked_pii(spark, d):
    return pii.digest(pii.find(table(spark, d, "documents")))


@query()
def op11_periodic_runs(spark, d):
    return periodic.digest(table(spark, d, "documents"))


@query(
    r"""
    WITH a AS (SELECT page_id, url, regexp_extract(html, '(?s)<article>(.*?)</article>', 1) AS a FROM pages),
    b AS (SELECT *, regexp_replace(regexp_replace(a, '</?(p|h1|br)\b[^>]*>', ' ', 'g'), '<[^>]*>', '', 'g') AS b FROM a),
    c AS (SELECT *, regexp_replace(replace(replace(replace(b, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g') AS c FROM b),
    t AS (SELECT page_id, url, trim(regexp_replace(c, '\s+', ' ', 'g')) AS text FROM c)
    SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM t
    """
)
def op12_template_text(spark, d):
    return templates.extract(table(spark, d, "pages"))


#: DuckDB: unsigned CRC-32 of a text's UTF-8 bytes, by a table that the query makes.
_CRC = (
    "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(generate_series(1, strlen({x})), lambda i: ('0x' || substr(hex({x}), 2 * i - 1, 2))::BIGINT)),"
    " lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295)"
)
_FEATURES = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
)


@query(
    f"""
    WITH tab AS (SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_prepend(i::BIGINT, generate_series(1, 8)),
      lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c FROM range(256) r(i))),
    d AS (SELECT row_number() OVER () AS r, doc_id, {_FEATURES} AS w FROM documents),
    e AS (SELECT r, unnest(w) AS w FROM d),
    b AS (SELECT unnest({_FEATURES}) AS w FROM benchmark),
    k AS (SELECT w, {_CRC.format(x="w")} % 10000 AS bucket FROM (SELECT w FROM e UNION SELECT w FROM b), tab),
    s AS (SELECT bucket, count(*) AS s FROM e JOIN k USING (w) GROUP BY 1),
    t AS (SELECT bucket, count(*) AS t FROM b JOIN k USING (w) GROUP BY 1),
    c AS (SELECT i AS bucket, coalesce(s, 0) AS s, coalesce(t, 0) AS t FROM range(10000) r(i) LEFT JOIN s ON s.bucket = i LEFT JOIN t ON t.bucket = i),
    g AS (SELECT bucket, floor(1000::DOUBLE * ln(((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE)
      / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS gain FROM c),
    v AS (SELECT r, sum(gain)::BIGINT AS weight FROM e JOIN k USING (w) JOIN g USING (bucket) GROUP BY 1),
    h AS (SELECT r, doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
      ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM d LEFT JOIN v USING (r)),
    x AS (SELECT *, weight + floor(-1000::DOUBLE * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM h),
    n AS (SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST, r) END AS place,
      count(*) FILTER (n_features >= 20) OVER () AS n FROM x)
    SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank FROM n
    """
)
def op13_importance_resample(spark, d):
    return resample.resample(table(spark, d, "documents"), table(spark, d, "benchmark"))
