"""Queries of the training-data operators over the test tables, and their SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import license_scan, mixing, ngram_join, quality_gbt, quality_rules, secret_scan, sentencepiece_codec, suffix_dedup, url_reputation, va_topk
from sluice.session import table

#: Where the SentencePiece model lies.
MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suffix-array removal of repeated strings over all documents."""
    return suffix_dedup.remove(table(spark, sf_dir, "documents")).drop("spans")


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixing sources to target weights over all documents."""
    plan = mixing.plan(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality rules over all documents."""
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License scan over all documents."""
    found = license_scan.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "licenses", F.size("matches").cast("long").alias("n_licenses"), F.coalesce(F.array_max(F.transform("matches", lambda m: m["containment"])), F.lit(0.0)).alias("containment"), F.array_join("spdx_tags", ",").alias("spdx_tags"))


def op5_quality_gbt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality classifier over all documents."""
    return quality_gbt.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret scan over all documents."""
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SentencePiece encoding and decoding of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sentencepiece_codec.digest(sentencepiece_codec.encode(docs, sentencepiece_codec.read_model(MODEL_PATH)))


def op8_va_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact top-k search over all embeddings; queries are the rows whose number is divisible by 20."""
    return va_topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op9_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URL filter over all pages. The labelled outcomes are the rows of labels with the page's number: bad is quality 0."""
    labels = table(spark, sf_dir, "labels").where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    outcomes = labels.groupBy(F.col("doc_id").alias("page_id")).agg((1 - F.min("quality")).cast("long").alias("bad"))
    judged = url_reputation.judge(table(spark, sf_dir, "pages"), outcomes)
    return judged.withColumns({c: F.round(c, 6) for c in ("bad_mean", "bad_lower")})


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N-gram Jaccard self-join of all documents."""
    return ngram_join.join(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_source_mix, op3_quality_rules, op4_license_scan, op5_quality_gbt, op6_secret_scan, op7_sentencepiece, op8_va_topk, op9_url_reputation, op10_ngram_join)}
_TEMPLATES = ", ".join(f"({i}, '{n}', '{t.replace(chr(39), chr(39) * 2)}')" for i, (n, t) in enumerate(license_scan.TEMPLATES))
_URL = "CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END"


def _shrunk_sql(level: str, parents: str, key: str, parent: str) -> str:
    """One level of shrinkage of op9 as SQL: (key, n, bad, a, b, strength, mean)."""
    rows = f"SELECT l.*, p.mean AS prior, p.strength AS ps FROM {level} l JOIN {parents} p ON l.{parent} = p.{parent}"
    v = "(prior * (1 - prior))"
    rho = f"(sum(n * pow(bad / n::double - prior, 2) / {v} - 1) FILTER (n > 0 AND {v} > 0) / sum(n - 1) FILTER (n > 0 AND {v} > 0))"
    tells = f"sum(n - 1) FILTER (n > 0 AND {v} > 0) > 0 AND count(*) FILTER (n > 0 AND {v} > 0) > 1"
    weight = f"coalesce(CASE WHEN {tells} THEN CASE WHEN {rho} <= 0 THEN 1000.0 ELSE least(1000.0, greatest(2.0, (1 - {rho}) / {rho})) END ELSE 2.0 END, 2.0)"
    fitted = f"SELECT r.*, least(m, ps) AS w FROM ({rows}) r CROSS JOIN (SELECT ({weight})::double AS m FROM ({rows}))"
    return f"SELECT *, a + b AS strength, a / (a + b) AS mean FROM (SELECT {key}, n, bad, w * prior + bad AS a, w * (1 - prior) + n - bad AS b FROM ({fitted}))"


ORACLES: dict[str, str] = {
    "op1_suffix_dedup": """
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS x FROM documents
        ), w AS (SELECT r, i, hash(x[i + 1 : i + 200]) AS h FROM (SELECT r, x, unnest(range(0, octet_length(x) - 199)) AS i FROM d WHERE octet_length(x) >= 200)
        ), hit AS (SELECT r, i FROM w WHERE h IN (SELECT h FROM w GROUP BY h HAVING count(*) > 1)
        ), e AS (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 200 THEN 0 ELSE 1 END AS new FROM hit
        ), g AS (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i ROWS UNBOUNDED PRECEDING) AS g FROM e
        ), s AS (SELECT r, g, min(i) AS a, max(i) + 200 AS b FROM g GROUP BY r, g
        ), k AS (SELECT r, g, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS p FROM s
        ), o AS (
          SELECT r, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS tail, string_agg(hex(x[p + 1 : a]), '' ORDER BY a) AS head FROM k JOIN d USING (r) GROUP BY r)
        SELECT doc_id, octet_length(x)::bigint AS n_bytes, coalesce(n_removed, 0)::bigint AS n_removed, coalesce(n_spans, 0)::bigint AS n_spans,
          sha256(unhex(coalesce(head, '') || hex(x[coalesce(tail, 0) + 1 :]))) AS kept_sha256
        FROM d LEFT JOIN o USING (r)
    """,
    "op2_source_mix": r"""
        WITH d AS (
          SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint AS size,
            (('0x' || substr(md5('mix' || chr(31) || coalesce(doc_id::varchar, chr(0)) || chr(31) || md5(coalesce(text, ''))), 1, 12))::bigint + 0.5::double) / 281474976710656.0::double AS u FROM documents
        ), s AS (SELECT source, sum(size)::bigint AS source_size FROM d GROUP BY source
        ), w AS (
          SELECT *, ([1, 2, 3][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::int])::double AS w, (3 * source_size)::double AS cap FROM s
        ), l AS (
          SELECT *, ((SELECT sum(source_size)::double FROM s) - coalesce(sum(cap) OVER b, 0)) / ((SELECT sum(w) FROM w) - coalesce(sum(w) OVER b, 0)) AS level FROM w
          WINDOW b AS (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
        ), t AS (SELECT source, source_size, least(cap, w * coalesce((SELECT max(level) FROM l WHERE cap > w * level), 'infinity'::double)) AS target FROM l
        ), e AS (
          SELECT d.*, source_size, target, length(bin(size)) AS rel FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
        ), v AS (SELECT source, rel, any_value(target) AS target, sum(size) AS words FROM e GROUP BY source, rel
        ), g AS (
          SELECT *, (target - 3 * coalesce(sum(words) OVER (PARTITION BY source ORDER BY rel DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / nullif(sum(words * rel) OVER (PARTITION BY source ORDER BY rel DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0)::double AS level FROM v
        ), h AS (SELECT source, coalesce(max(level) FILTER (level * rel <= 3), 'infinity'::double) AS level FROM g GROUP BY source
        ), f AS (
          SELECT e.*, CASE WHEN size > 0 THEN least(3.0::double, level * rel) ELSE 0.0::double END AS x FROM e JOIN h ON e.source IS NOT DISTINCT FROM h.source
        ), c AS (SELECT *, floor(x + 1e-12)::bigint AS sure, greatest(0.0::double, x - floor(x + 1e-12)) AS p FROM f
        ), r AS (
          SELECT *, CASE WHEN p > 0 THEN u / (u + (1 - u) * (p / (1 - p))) END AS rank, greatest(0.0::double, target - sum(size * sure) OVER (PARTITION BY source)) AS need FROM c
        ), b AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source, p > 0 ORDER BY rank, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r)
        SELECT doc_id, size, source_size, target, (size * copies)::bigint AS taken, copies FROM (
          SELECT *, (sure + CASE WHEN p > 0 AND before < need AND 2 * (need - before) >= size THEN 1 ELSE 0 END)::bigint AS copies FROM b)
    """,
    "op4_license_scan": rf"""
        WITH RECURSIVE texts AS (
          SELECT i AS id, true AS template, text FROM (VALUES {_TEMPLATES}) t(i, license, text) UNION ALL SELECT row_number() OVER (), false, coalesce(text, '') FROM documents
        ), w AS (
          SELECT id, template, list_filter(string_split_regex(translate(lower(text), '{license_scan.DROPPED.replace("'", "''")}', ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM texts
        ), s AS (SELECT id, template, i - 1 AS pos, list_aggregate(ws[i : i + 4], 'string_agg', ' ') AS s FROM (SELECT *, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)
        ), t AS MATERIALIZED (SELECT DISTINCT id AS i, s FROM s WHERE template
        ), n AS (SELECT i, count(*) AS n, ceil(log2(count(*)))::int AS c FROM t GROUP BY i
        ), hit AS MATERIALIZED (SELECT d.id, t.i, d.pos, d.s FROM s d JOIN t USING (s) WHERE NOT d.template
        ), windows AS (
          SELECT id, i, s, n, unnest([pos // (1 << c), pos // (1 << c) - 1]) AS win FROM hit JOIN n USING (i)
        ), m AS MATERIALIZED (
          SELECT id, i, n, max(k / n::double) AS containment FROM (SELECT id, i, n, win, count(DISTINCT s) AS k FROM windows WHERE win >= 0 GROUP BY ALL) GROUP BY ALL HAVING max(k / n::double) >= {license_scan.CONTAINED}
        ), covers AS (
          SELECT a.i, b.i AS j FROM t a JOIN t b ON a.s = b.s AND a.i <> b.i JOIN n ON n.i = a.i GROUP BY a.i, b.i, n.n HAVING count(*) >= {license_scan.CONTAINED} * n.n
        ), kept AS (
          SELECT m.* FROM m WHERE NOT EXISTS (SELECT 1 FROM covers c JOIN m o ON o.i = c.j WHERE c.i = m.i AND o.id = m.id AND (o.containment > m.containment OR (o.containment = m.containment AND o.n > m.n)))
        ), f AS (
          SELECT id, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses, count(DISTINCT license) AS n, max(containment) AS containment FROM kept JOIN (VALUES {_TEMPLATES}) t(i, license, text) USING (i) GROUP BY id
        ), d AS (SELECT row_number() OVER () AS id, * FROM documents)
        SELECT doc_id, coalesce(f.licenses, '') AS licenses, coalesce(f.n, 0)::bigint AS n_licenses, coalesce(f.containment, 0.0)::double AS containment,
          array_to_string(list_sort(list_distinct(regexp_extract_all(coalesce(d.text, ''), 'SPDX-License-Identifier:[\x20\t]*([A-Za-z0-9.+-]+)', 1))), ',') AS spdx_tags
        FROM d LEFT JOIN f USING (id)
    """,
    "op8_va_topk": """
        WITH v AS (
          SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) AS v FROM embeddings
          WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::bigint AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0)
        SELECT query_id, rank, vec_id, score FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::int AS rank FROM s) WHERE rank <= 20
    """,
    "op9_url_reputation": f"""
        WITH u AS (SELECT page_id, coalesce({_URL}, '') AS x FROM pages
        ), base AS (
          SELECT page_id, translate(regexp_extract(x, '(?s)^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(x, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM u
        ), marks AS (SELECT doc_id AS page_id, 1 - min(quality) AS bad FROM labels WHERE quality IS NOT NULL GROUP BY 1
        ), hosts AS (
          SELECT host, array_to_string(ls[-k - 1 :], '.') AS domain, CASE WHEN ip THEN 'ip' ELSE array_to_string(ls[-k:], '.') END AS suffix, n, bad FROM (
            SELECT *, string_split(name, '.') AS ls, regexp_matches(name, '^([0-9]+([.][0-9]+){{3}}|\\[.*)$') AS ip,
              CASE WHEN regexp_matches(name, '^([0-9]+([.][0-9]+){{3}}|\\[.*)$') THEN len(string_split(name, '.')) WHEN regexp_matches(name, '(^|[.])({"|".join(url_reputation.SECOND_LEVEL)})[.][a-z]{{2}}$') THEN 2 ELSE 1 END AS k FROM (
              SELECT *, regexp_replace(regexp_replace(host, '^.*@', ''), '(:[0-9]*)?[.]?$', '') AS name FROM (
                SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS bad FROM base LEFT JOIN marks USING (page_id) GROUP BY ALL)))
        ), domains AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY ALL
        ), suffixes AS (SELECT suffix, 'all' AS root, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY ALL
        ), root AS (SELECT 'all' AS root, (sum(bad) + 0.5) / (sum(n) + 1)::double AS mean, sum(n) + 1.0 AS strength FROM hosts
        ), s AS ({_shrunk_sql("suffixes", "root", "suffix", "root")}
        ), d AS ({_shrunk_sql("domains", "s", "domain", "suffix")}
        ), h AS ({_shrunk_sql("hosts", "d", "host", "domain")}
        ), j AS (
          SELECT page_id, host, path, mean, mean - 1.645 * sqrt(a * b / (pow(a + b, 2) * (a + b + 1))) AS lower,
            CASE WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND path LIKE '/en/%' THEN 'www.example.com/en/' WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/%' THEN 'example.com/en/'
              WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/es/%' THEN 'net/es/' WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/fr/%' THEN 'net/fr/' WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/%' THEN 'com/' END AS rule
          FROM base JOIN h USING (host))
        SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN lower > 0.3 THEN 'block' ELSE 'allow' END AS verdict, round(mean, 6) AS bad_mean, round(lower, 6) AS bad_lower FROM j
    """,
    "op10_ngram_join": r"""
        WITH RECURSIVE w AS (
          SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
        ), g AS (
          SELECT DISTINCT doc_id, list_aggregate(ws[i : i + 3], 'string_agg', ' ') AS s
          FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM w WHERE len(ws) > 0)
        ), n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id
        ), o AS (
          SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
        ), l AS MATERIALIZED (
          SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)
        ), e AS MATERIALIZED (SELECT a, b FROM l UNION SELECT b, a FROM l
        ), r AS (
          SELECT doc_id AS node, doc_id AS seen FROM n UNION SELECT r.node, e.b FROM r JOIN e ON r.seen = e.a
        )
        SELECT d.doc_id, coalesce(n.n, 0)::bigint AS n_shingles, coalesce(c.m, d.doc_id) AS component_id
        FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT node, min(seen) AS m FROM r GROUP BY node) c ON c.node = d.doc_id
    """,
}
