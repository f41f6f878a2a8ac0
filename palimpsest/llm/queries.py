"""The operators' registered queries, over whole tables with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import table

#: The tokenizer's file; None: the one that the installed public_tokenizers names.
TOKENIZER: str | None = None
CAPACITY = 2048


def tokenizer_path() -> str:
    if TOKENIZER:
        return TOKENIZER
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.secrets import scan_secrets

    found = scan_secrets(table(spark, sf_dir, "documents"))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"] != "markov")
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents stand in a tree: source, then 4096 and then 64 consecutive ids; the first of each 64 is named LICENSE."""
    from palimpsest.llm.licenses import scan_licenses

    docs = table(spark, sf_dir, "documents")
    path = F.expr("concat(coalesce(source, 'unknown'), '/', doc_id div 4096, '/', doc_id div 64, '/', if(doc_id % 64 = 0, 'LICENSE', concat(doc_id, '.txt')))")
    return scan_licenses(docs.select("doc_id", path.alias("path"), "text"))


def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.fingerprints import compare_with_next

    return compare_with_next(table(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), CAPACITY)


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.topk import integer_vectors, search

    return search(integer_vectors(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 50 == 0)


OP5_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages fetched on a day of 2024 that follows from their id; list entries that follow from the hosts and their parents."""
    from palimpsest.llm.urls import filter_urls, host_of, suffixes_of

    pages = table(spark, sf_dir, "pages")
    captures = pages.select("page_id", "url", F.expr("date_add(date'2024-01-01', cast(page_id * 37 % 366 as int))").alias("fetched_on"))
    hosts = pages.select(host_of(F.col("url")).alias("host")).where("host is not null").distinct()
    domains = hosts.select(F.explode(suffixes_of(F.col("host"))).alias("domain")).distinct()
    number = lambda a: F.conv(F.substring(F.md5(F.col("domain").cast("binary")), a, 6), 16, 10).cast("int")
    dated = domains.where(number(1) % 3 != 0).select("domain", (number(7) % 200).alias("a"), (number(13) % 60 + 1).alias("b"), (number(19) % 90 + 1).alias("c"))
    start = F.lit("2024-01-01").cast("date")
    steps = F.array(F.struct(F.col("a").alias("d"), F.lit("add").alias("x")), F.struct(F.expr("a + b").alias("d"), F.lit("remove").alias("x")), F.struct(F.expr("a + b + c").alias("d"), F.lit("add").alias("x")))
    entries = dated.select("domain", F.explode(steps).alias("e")).select("domain", F.date_add(start, F.col("e.d")).alias("listed_on"), F.col("e.x").alias("action"))
    return filter_urls(captures, entries).withColumns({c: F.col(c).cast("string") for c in ("fetched_on", "listed_on")})


OP6_SQL = r"""
WITH c AS (
  SELECT page_id, nullif(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '') AS host,
         DATE '2024-01-01' + CAST(page_id * 37 % 366 AS INTEGER) AS fetched_on
  FROM pages
), h AS (
  SELECT host, string_split(host, '.') AS l FROM (SELECT DISTINCT host FROM c WHERE host IS NOT NULL)
), s AS (
  SELECT host, array_to_string(l[i:], '.') AS domain
  FROM (SELECT host, l, unnest(range(1, greatest(1, len(l) - 1) + 1)) AS i FROM h)
), n AS (
  SELECT domain, ('0x' || substr(md5(domain), 1, 6))::INTEGER AS p, ('0x' || substr(md5(domain), 7, 6))::INTEGER % 200 AS a,
         ('0x' || substr(md5(domain), 13, 6))::INTEGER % 60 + 1 AS b, ('0x' || substr(md5(domain), 19, 6))::INTEGER % 90 + 1 AS c
  FROM (SELECT DISTINCT domain FROM s)
), i AS (
  SELECT domain, DATE '2024-01-01' + a AS valid_from, DATE '2024-01-01' + a + b AS valid_to FROM n WHERE p % 3 <> 0
  UNION ALL
  SELECT domain, DATE '2024-01-01' + a + b + c, DATE '9999-12-31' FROM n WHERE p % 3 <> 0
), hit AS (
  SELECT c.host, c.fetched_on, arg_max(i.domain, length(i.domain)) AS matched, arg_max(i.valid_from, length(i.domain)) AS listed_on
  FROM (SELECT DISTINCT host, fetched_on FROM c) c JOIN s ON s.host = c.host
  JOIN i ON i.domain = s.domain AND c.fetched_on >= i.valid_from AND c.fetched_on < i.valid_to GROUP BY 1, 2
)
SELECT c.page_id, c.host, CAST(c.fetched_on AS VARCHAR) AS fetched_on, hit.matched IS NOT NULL AS blocked, hit.matched, CAST(hit.listed_on AS VARCHAR) AS listed_on
FROM c LEFT JOIN hit ON hit.host = c.host AND hit.fetched_on = c.fetched_on
"""


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.toxicity import fit_toxicity, score_toxicity

    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nr FROM d GROUP BY source
), w AS (
  SELECT *, CASE (nr % 3) WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 2 * source_size AS cap FROM s
), r AS (
  SELECT *, sum(cap) OVER o AS caps, sum(weight) OVER o AS weights, sum(source_size) OVER () AS total, sum(weight) OVER () AS all_weights
  FROM w WINDOW o AS (ORDER BY cap / weight, nr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (
  SELECT max(CAST(1.5 * total - coalesce(caps, 0) AS DOUBLE) / CAST(all_weights - coalesce(weights, 0) AS DOUBLE)) AS level FROM r
), t AS (
  SELECT w.*, least(CAST(cap AS DOUBLE), weight * coalesce(level, 0.0)) AS target FROM w, l
), p AS (
  SELECT row_number() OVER () AS id, d.doc_id, d.size, t.nr, t.source_size, t.target,
         CAST(coalesce(sum(d.size) OVER (PARTITION BY t.nr ORDER BY md5('mix:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), need AS (
  SELECT nr, source_size AS size, words, (source_size + 4095) // 4096 AS blocks, words % source_size AS rest,
         words // source_size * ((source_size + 4095) // 4096) + (words % source_size + 4095) // 4096 AS need
  FROM (SELECT *, CAST(floor(target) AS BIGINT) AS words FROM t WHERE source_size > 0 AND target >= 1)
), axis AS (
  SELECT *, coalesce(sum(need) OVER (ORDER BY nr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT AS low, (sum(need) OVER ())::HUGEINT AS n FROM need
), grid AS (
  SELECT n, length(bin(CAST(n - 1 AS BIGINT))) AS bits FROM (SELECT max(n) AS n FROM axis) WHERE n IS NOT NULL
), point AS (
  SELECT slot, n, bits, list_sum(list_transform(range(bits), lambda j: ((slot >> j) & 1) << (bits - 1 - j))) AS x
  FROM (SELECT n, bits, unnest(range(1::BIGINT << bits)) AS slot FROM grid)
), slots AS (
  SELECT nr, slot, size, rest, need, blocks, row_number() OVER (PARTITION BY nr ORDER BY slot) - 1 AS rank
  FROM point p JOIN axis a ON p.x * a.n >= a.low * (1::HUGEINT << p.bits) AND p.x * a.n < (a.low + a.need) * (1::HUGEINT << p.bits)
), drawn AS (
  SELECT nr, slot, rank % blocks AS block, CASE WHEN rank = need - 1 AND rest > 0 THEN rest ELSE size END AS until FROM slots WHERE rank < need
), part AS (
  SELECT id, nr, start, size, unnest(range(start // 4096, (start + size - 1) // 4096 + 1)) AS block FROM p WHERE size > 0
), met AS (
  SELECT id, slot, least(part.start + part.size, (block + 1) * 4096, until) - greatest(part.start, block * 4096) AS words FROM part JOIN drawn USING (nr, block)
), sums AS (
  SELECT id, CAST(sum(words) AS BIGINT) AS taken, min(slot) AS first_slot, count(*) AS n_slots FROM met WHERE words > 0 GROUP BY id
)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken, first_slot, coalesce(n_slots, 0) AS n_slots FROM p LEFT JOIN sums USING (id)
"""


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.simhash import simhash_components

    return simhash_components(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.quality import fit_quality, score_quality

    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_license_scan, op3_document_fingerprints, op4_best_fit_packing, op5_exact_topk, op6_url_filter, op7_toxicity, op8_source_mixing, op9_simhash, op10_quality)}
ORACLES = {"op5_exact_topk": OP5_SQL, "op6_url_filter": OP6_SQL, "op8_source_mixing": OP8_SQL}
