"""A query for each operator over its whole table, and DuckDB SQL where there is some."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_count import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), keep=("doc_id",))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .shared import Scratch
    from .warc import captures, read_records, write_warc

    path = Scratch(spark, "op3").path("archives")
    write_warc(table(spark, sf_dir, "pages"), path, "page_id", "url", "html")
    return captures(read_records(spark, path)).withColumnRenamed("key", "page_id").drop("status")


OP3_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to
FROM f
"""


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import identify, learn

    docs = table(spark, sf_dir, "documents")
    rest = F.crc32(F.col("doc_id").cast("string")) % 4
    learned = learn(docs, rest != 2)
    out = identify(docs.withColumn("held_out", F.coalesce(rest == 2, F.lit(False))), learned, keep=("doc_id", "held_out"))
    return out.select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op6_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm import Model, learned, score

    docs = table(spark, sf_dir, "documents")
    known = learned(F.col("doc_id"))
    return score(docs.withColumn("held_out", ~known), Model(docs.where(known)), keep=("doc_id", "held_out"), trained=known)


def op8_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .cross_polytope import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


def op9_packed_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.tiktoken"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .weighted_minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).drop("class_no")


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import without_repeats

    return without_repeats(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
w AS (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM d WHERE len(words) >= 13),
k AS (SELECT doc_id, i, sha256(array_to_string(words[i:i + 12], ' ')) AS win FROM w),
f AS (SELECT win, min(doc_id) AS first FROM k GROUP BY win),
gone AS (SELECT doc_id, i + j AS place FROM (SELECT k.doc_id, k.i, unnest(range(0, 13)) AS j FROM k JOIN f ON f.win = k.win WHERE k.doc_id > f.first)),
g AS (SELECT doc_id, list(DISTINCT place) AS places FROM gone GROUP BY doc_id),
kept AS (SELECT d.doc_id, len(words) AS n, CASE WHEN places IS NULL THEN words ELSE list_filter(list_transform(words, lambda x, i: CASE WHEN list_contains(places, i) THEN NULL ELSE x END), lambda x: x IS NOT NULL) END AS words
         FROM d LEFT JOIN g ON g.doc_id = d.doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(n - len(words) AS BIGINT) AS n_removed, sha256(array_to_string(words, ' ')) AS kept_sha256 FROM kept
"""


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .alignment import aligned

    return aligned(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))


def fetch_times(pages: DataFrame) -> DataFrame:
    """Pages carry no time of their own: each is taken as fetched at a minute of 2024 that follows from its page_id."""
    minute = F.pmod(F.col("page_id") * 7919, F.lit(366 * 1440)).cast("int")
    return pages.select("page_id", "url", F.expr("timestamp_ntz '2024-01-01 00:00:00'").alias("t0"), minute.alias("minute")).select("page_id", "url", (F.col("t0") + F.make_dt_interval(mins=F.col("minute"))).alias("fetched"))


def list_entries(pages: DataFrame) -> DataFrame:
    """Dated entries made from the pages: each host is put on a list, taken off, and every other one put on again; each
    first folder of a host is put on another list for good."""
    from .url_filter import host, path

    hosts = pages.where(host(F.col("url")) != "").groupBy(host(F.col("url")).alias("pattern")).agg(F.min("page_id").alias("k"))
    day = lambda shift: F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("k") * 31, F.lit(180)).cast("int") + shift)
    entry = lambda name, listed, shift: F.struct(F.lit(name).alias("list_name"), F.lit(listed).alias("listed"), day(shift).alias("day"))
    turns = F.array(entry("hosts", True, 0), entry("hosts", False, 45), entry("hosts", True, 120))
    on_hosts = hosts.withColumn("e", F.explode(F.slice(turns, 1, F.when(F.col("k") % 2 == 0, 3).otherwise(2))))
    folder = F.regexp_extract(path(F.col("url")), r"^/[^/]*/", 0)
    folders = pages.where((host(F.col("url")) != "") & (folder != "")).groupBy(F.concat(host(F.col("url")), folder).alias("pattern")).agg(F.min("page_id").alias("k"))
    on_folders = folders.where("k % 3 = 0").withColumn("e", entry("folders", True, 90))
    return on_hosts.unionByName(on_folders).select("e.list_name", "pattern", "e.listed", "e.day")


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import filter_urls

    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    out = filter_urls(fetch_times(pages), list_entries(pages))
    return out.select("page_id", "url", "fetched", F.concat_ws(",", "lists").alias("lists"), "blocked")


_HOST = r"regexp_replace(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^.*@', ''), '\.?(:[0-9]*)?$', '')"
_PATH = r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1)"

OP4_SQL = rf"""
WITH p AS (
  SELECT page_id, url, {_HOST} AS host, {_PATH} AS path,
         TIMESTAMP '2024-01-01' + to_minutes(CAST((page_id * 7919) % (366 * 1440) AS BIGINT)) AS fetched
  FROM pages
), hosts AS (SELECT host AS pattern, min(page_id) AS k FROM p WHERE host <> '' GROUP BY host),
folders AS (
  SELECT host || regexp_extract(path, '^/[^/]*/') AS pattern, min(page_id) AS k
  FROM p WHERE host <> '' AND regexp_extract(path, '^/[^/]*/') <> '' GROUP BY 1
), ranges AS (
  SELECT 'hosts' AS list_name, pattern, DATE '2024-01-01' + CAST((k * 31) % 180 AS INTEGER) AS since, DATE '2024-01-01' + CAST((k * 31) % 180 + 45 AS INTEGER) AS until FROM hosts
  UNION ALL
  SELECT 'hosts', pattern, DATE '2024-01-01' + CAST((k * 31) % 180 + 120 AS INTEGER), DATE '9999-01-01' FROM hosts WHERE k % 2 = 0
  UNION ALL
  SELECT 'folders', pattern, DATE '2024-01-01' + CAST((k * 31) % 180 + 90 AS INTEGER), DATE '9999-01-01' FROM folders WHERE k % 3 = 0
), hits AS (
  SELECT DISTINCT p.page_id, p.url, r.list_name FROM p JOIN ranges r
    ON (r.list_name = 'hosts' AND r.pattern = p.host OR r.list_name = 'folders' AND r.pattern = p.host || regexp_extract(p.path, '^/[^/]*/'))
   AND CAST(p.fetched AS DATE) >= r.since AND CAST(p.fetched AS DATE) < r.until
  UNION
  SELECT DISTINCT p.page_id, p.url, 'hosts' FROM p JOIN ranges r
    ON r.list_name = 'hosts' AND ends_with(p.host, '.' || r.pattern)
   AND CAST(p.fetched AS DATE) >= r.since AND CAST(p.fetched AS DATE) < r.until
), found AS (SELECT page_id, url, string_agg(list_name, ',' ORDER BY list_name) AS lists FROM hits GROUP BY page_id, url)
SELECT p.page_id, p.url, p.fetched, coalesce(f.lists, '') AS lists, f.lists IS NOT NULL AS blocked
FROM p LEFT JOIN found f ON f.page_id = p.page_id AND f.url = p.url
"""


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix
    from .shared import Scratch

    mixed = mix(table(spark, sf_dir, "documents"), keep=("doc_id",))
    mixed = mixed.withColumn("last_position", F.array_max("positions")).drop("positions")
    return Scratch(spark, "op7").keep(mixed, "mixed").sort("position", "doc_id")


def _position(share: str) -> str:
    """SQL of the training position at which ``share`` of a source's budget is due."""
    x = f"""CASE rank % 3 WHEN 0 THEN (sqrt(0.25::DOUBLE + 2.0::DOUBLE * {share}) - 0.5::DOUBLE) / 1.0::DOUBLE WHEN 1 THEN {share}
         ELSE (sqrt(2.25::DOUBLE + -2.0::DOUBLE * {share}) - 1.5::DOUBLE) / -1.0::DOUBLE END"""
    return f"(a * ({x}) * ({x}) + b * ({x})) / total_goal"


OP7_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS h,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents
), s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS rank FROM s),
w AS (SELECT *, CASE rank % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, 4 * source_size AS cap, 3 * sum(source_size) OVER () AS total FROM r),
f AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY source_size / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above,
            sum(w) OVER (ORDER BY source_size / w, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_left FROM w
), g AS (SELECT *, cap * w_left <= w * (total - above) AS stopped FROM f),
k AS (
  SELECT *, CAST(sum(CASE WHEN stopped THEN 0 ELSE w END) OVER () AS BIGINT) AS free,
            CAST(total - sum(CASE WHEN stopped THEN cap ELSE 0 END) OVER () AS BIGINT) AS rest FROM g
), t AS (
  SELECT source, source_size, rank,
         CASE WHEN stopped THEN CAST(cap AS DOUBLE) / 2.0 ELSE CAST(w * rest AS DOUBLE) / (2.0::DOUBLE * free) END AS target,
         CAST(CASE WHEN stopped THEN cap // 2 ELSE (w * rest) // (2 * free) END AS BIGINT) AS goal FROM k
), y AS (
  SELECT *, sum(goal) OVER () AS total_goal, sum(goal * CASE rank % 3 WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 0.0::DOUBLE ELSE -0.5::DOUBLE END) OVER () AS a,
         sum(goal * CASE rank % 3 WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 1.5::DOUBLE END) OVER () AS b FROM t
), p AS (
  SELECT d.doc_id, d.size, y.*,
         CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS begin
  FROM d JOIN y ON d.source IS NOT DISTINCT FROM y.source
), x AS (
  SELECT *, size > 0 AND goal > begin AND 2 * (goal - begin) >= size AS first, size > 0 AND goal > begin + source_size AND 2 * (goal - begin - source_size) >= size AS second,
         CASE WHEN goal > begin THEN CAST(begin AS DOUBLE) / goal END AS s1, CASE WHEN goal > begin + source_size THEN CAST(begin + source_size AS DOUBLE) / goal END AS s2 FROM p
), z AS (
  SELECT *, CASE WHEN first THEN {_position("s1")} END AS position, CASE WHEN second THEN {_position("s2")} END AS again FROM x
)
SELECT doc_id, size, source_size, CAST(target AS DOUBLE) AS target, size * (CAST(first AS BIGINT) + CAST(second AS BIGINT)) AS taken, position, coalesce(again, position) AS last_position
FROM z
"""

QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_token_counts": op2_token_counts,
    "op3_warc": op3_warc,
    "op4_url_filters": op4_url_filters,
    "op5_language": op5_language,
    "op6_lm_scores": op6_lm_scores,
    "op7_source_mix": op7_source_mix,
    "op8_near_vectors": op8_near_vectors,
    "op9_packed_tokens": op9_packed_tokens,
    "op10_near_duplicates": op10_near_duplicates,
    "op11_substring_dedup": op11_substring_dedup,
    "op12_token_alignment": op12_token_alignment,
}

ORACLE_SQL = {
    "op3_warc": OP3_SQL,
    "op4_url_filters": OP4_SQL,
    "op7_source_mix": OP7_SQL,
    "op11_substring_dedup": OP11_SQL,
}
