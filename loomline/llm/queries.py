"""The registered queries of this subpackage, one for each operator, with their SQL where SQL can say it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_folder
from . import chat, collocations, decontamination, mixing, quality_rules, secrets, simhash, substring_dedup, suffix_dedup, toxicity, url_filters, vector_codes, warc
from .common import table


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removals(table(spark, sf_dir, "documents"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_key")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.toxicity(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels are by doc_id; a page's outcome is that of its number, bad if toxic or of low quality."""
    labels = table(spark, sf_dir, "labels")
    bad = F.when((F.col("toxic") == 1) | (F.col("quality") == 0), 1).otherwise(0)
    return url_filters.url_verdicts(table(spark, sf_dir, "pages"), labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad")))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{scratch_folder(spark)}/warc-{uuid.uuid4().hex}"
    written = warc.write_archives(warc.revisit_plan(table(spark, sf_dir, "pages")), folder)
    if not written:
        return spark.createDataFrame([], warc.READ).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "error")
    return warc.read_archives(spark, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "error")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.role_repair(table(spark, sf_dir, "conversations"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    ratio = quality_rules.fitted_ratio(docs, table(spark, sf_dir, "labels").where("quality = 1"))
    return quality_rules.quality_report(docs, ratio)


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.removals(table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compressed(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_secrets": op2_secrets,
    "op3_decontamination": op3_decontamination,
    "op4_toxicity": op4_toxicity,
    "op5_simhash": op5_simhash,
    "op6_url_filters": op6_url_filters,
    "op7_warc": op7_warc,
    "op8_mixing": op8_mixing,
    "op9_chat": op9_chat,
    "op10_quality_rules": op10_quality_rules,
    "op11_substring_dedup": op11_substring_dedup,
    "op12_collocations": op12_collocations,
    "op13_vector_codes": op13_vector_codes,
}

def _strength(level: str) -> str:
    """The method of moments over a CTE with bad, n and the parent's mean p."""
    low, high = url_filters.LEAST_STRENGTH, url_filters.MOST_STRENGTH
    return f"""(SELECT coalesce(CASE WHEN total > noise AND spread > noise THEN least(greatest((total - noise) / (spread - noise) - 1, {low}), {high}) ELSE {high} END, {high})::DOUBLE AS m FROM
 (SELECT sum(n * pow(bad / n - p, 2)) AS spread, sum(p * (1 - p)) AS noise, sum(n * p * (1 - p)) AS total FROM {level} WHERE n > 0))"""


def _fits(host: str, path: str) -> str:
    return f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}')"


_RULES = sorted(url_filters.RULES, key=lambda r: -len(r[1] + r[2]))
_SECOND = ", ".join(f"'{x}'" for x in url_filters.SECOND_LEVEL)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP6_SQL = rf"""WITH urls AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
out AS (SELECT doc_id AS page_id, max(CASE WHEN toxic = 1 OR quality = 0 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
h0 AS (SELECT host, sum(coalesce(bad, 0))::DOUBLE AS bad, count(bad)::DOUBLE AS n FROM urls LEFT JOIN out USING (page_id) GROUP BY host),
h1 AS (SELECT *, regexp_replace(host, ':[0-9]*$', '') AS bare, string_split(regexp_replace(host, ':[0-9]*$', ''), '.') AS l FROM h0),
h2 AS (SELECT *, len(l) AS c, CASE WHEN len(l) >= 3 AND l[-2] IN ({_SECOND}) AND length(l[-1]) = 2 THEN 2 ELSE 1 END AS keep, regexp_matches(bare, '^[0-9.]+$') AS num FROM h1),
h AS (SELECT host, bad, n, CASE WHEN num OR c = 1 THEN bare ELSE array_to_string(l[c - keep + 1:], '.') END AS suffix, CASE WHEN num OR c <= keep THEN bare ELSE array_to_string(l[c - keep:], '.') END AS domain FROM h2),
d AS (SELECT suffix, domain, sum(bad) AS bad, sum(n) AS n FROM h GROUP BY ALL), s AS (SELECT suffix, sum(bad) AS bad, sum(n) AS n FROM d GROUP BY ALL),
s1 AS (SELECT *, (SELECT (coalesce(sum(bad), 0) + {url_filters.PRIOR_RATE * url_filters.PRIOR_COUNT}::DOUBLE) / (coalesce(sum(n), 0) + {url_filters.PRIOR_COUNT}::DOUBLE) FROM s) AS p FROM s),
s2 AS (SELECT suffix, (bad + m * p) / (n + m) AS p FROM s1, {_strength("s1")}),
d1 AS (SELECT d.*, p FROM d JOIN s2 USING (suffix)), d2 AS (SELECT suffix, domain, (bad + m * p) / (n + m) AS p FROM d1, {_strength("d1")}),
h3 AS (SELECT h.*, p FROM h JOIN d2 USING (suffix, domain)), h4 AS (SELECT host, n + m AS w, (bad + m * p) / (n + m) AS mean FROM h3, {_strength("h3")}),
r AS (SELECT host, mean, mean - {url_filters.Z}::DOUBLE * sqrt(mean * (1 - mean) / (w + 1)) AS low FROM h4)
SELECT page_id, host, path, CASE {" ".join(f"WHEN {_fits(h, p)} THEN '{h}{p}'" for _, h, p in _RULES)} END AS rule,
 CASE {" ".join(f"WHEN {_fits(h, p)} THEN '{k}'" for k, h, p in _RULES)} WHEN low > {url_filters.BAD_RATE} THEN 'block' ELSE 'allow' END AS verdict, round(mean, 6) AS bad_rate, round(low, 6) AS bad_rate_low FROM urls JOIN r USING (host)"""

OP7_SQL = f"""WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT payload_digest, payload_bytes, max(page_id) AS first FROM p WHERE payload_bytes >= {warc.REVISIT_BYTES} GROUP BY ALL)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to, CAST(NULL AS VARCHAR) AS error FROM p LEFT JOIN g USING (payload_digest, payload_bytes)"""


OP11_SQL = r"""WITH w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS MATERIALIZED (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w)),
hit AS MATERIALIZED (SELECT doc_id, i FROM win JOIN (SELECT h, min(doc_id) AS least FROM win GROUP BY h) USING (h) WHERE doc_id > least),
each AS (SELECT w.doc_id, word, j, coalesce(max(hit.i) OVER (PARTITION BY w.doc_id ORDER BY j ROWS UNBOUNDED PRECEDING) >= j - 49, false) AS gone
 FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM w) w LEFT JOIN hit ON hit.doc_id = w.doc_id AND hit.i = j),
k AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY j) FILTER (NOT gone) AS kept FROM each GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)"""

OP12_SQL = rf"""WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d), n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
g AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, range(1, {collocations.LONGEST + 1}) t(k))) GROUP BY ALL HAVING count(*) >= {collocations.LEAST}),
c AS MATERIALIZED (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS w FROM g WHERE k > 1),
cuts AS (SELECT c.lang, c.phrase, a, j, l.f AS l, r.f AS r, n, ((1000::HUGEINT * a * n) // (l.f::HUGEINT * r.f))::BIGINT AS score FROM (SELECT *, unnest(range(1, k)) AS j FROM c) c
 JOIN g l ON l.lang = c.lang AND l.phrase = array_to_string(w[1:j], ' ') JOIN g r ON r.lang = c.lang AND r.phrase = array_to_string(w[j + 1:], ' ') JOIN n ON n.lang = c.lang),
best AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS nth FROM cuts),
inside AS (SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, array_to_string(w[1:k - 1], ' ') AS phrase, a FROM c UNION ALL SELECT lang, array_to_string(w[2:], ' '), a FROM c) GROUP BY ALL),
x AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM best LEFT JOIN inside USING (lang, phrase) WHERE nth = 1 AND (longer IS NULL OR longer < a))
SELECT * FROM x WHERE rank <= {collocations.BEST}"""


def _op13_sql(rounds: int = vector_codes.ROUNDS) -> str:
    """All vectors of one length, a multiple of 8; integers that fit in longs."""
    out = f"""WITH kept AS (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, embedding AS v, len(embedding) // 8 AS s FROM embeddings
 WHERE len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
e AS MATERIALIZED (SELECT r, i // s AS p, i % s AS j, floor(4096 * v[i + 1]::DOUBLE)::BIGINT AS x FROM (SELECT *, unnest(range(len(v))) AS i FROM kept)),
b0 AS MATERIALIZED (SELECT p, r - 1 AS k, j, x AS c FROM e WHERE r <= {vector_codes.ENTRIES})"""
    for t in range(rounds + 1):
        out += f""",
d{t} AS (SELECT r, p, k, sum((x - c) * (x - c))::BIGINT AS d FROM e JOIN b{t} USING (p, j) GROUP BY ALL), a{t} AS MATERIALIZED (SELECT r, p, arg_min(k, d::HUGEINT * 16 + k) AS k, min(d) AS d FROM d{t} GROUP BY ALL)"""
        if t < rounds:
            out += f""",
s{t} AS (SELECT p, k, j, sum(x)::BIGINT AS s, count(*) AS n FROM e JOIN a{t} USING (r, p) GROUP BY ALL),
b{t + 1} AS MATERIALIZED (SELECT p, k, j, coalesce((s - ((s % n) + n) % n) // n, c)::BIGINT AS c FROM b{t} LEFT JOIN s{t} USING (p, k, j))"""
    return f"""{out},
w AS (SELECT r, string_agg(printf('%02x', k), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY r)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY p, k, j)) FROM b{rounds}) AS codebooks_sha256 FROM w JOIN kept USING (r)"""


OP13_SQL = _op13_sql()

#: The others hash words, fit models, search or iterate; tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {"op6_url_filters": OP6_SQL, "op7_warc": OP7_SQL, "op11_substring_dedup": OP11_SQL, "op12_collocations": OP12_SQL, "op13_vector_codes": OP13_SQL}
