"""One query per operator over its whole table, and the same in SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladefreq.llm import (
    bpe,
    embedding_dedup,
    extraction,
    importance,
    language_id,
    merkle,
    multi_index,
    near_dedup,
    packing,
    suffix_dedup,
    token_files,
    topk_search,
    url_filters,
)
from cladefreq.llm.common import shared_folder, ship

Query = Callable[[SparkSession, str], DataFrame]

ALLOW = ("org/", "com/fr/")
BLOCK = ("example.org/es/", "example.org/en/1", "com/de/")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of pages are the labels of the documents with their numbers: good means of quality and not toxic."""
    labels = _table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("page_id"), ((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("long").alias("good")
    )
    found = url_filters.judge_urls(_table(spark, sf_dir, "pages"), labels, ALLOW, BLOCK)
    return found.select("page_id", "host", "path", "rule", "verdict")


def packed_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack(_table(spark, sf_dir, "documents"), path, end_id=2, capacity=4096)


def without_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"), 50)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def near_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), 0.8)


def main_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(_table(spark, sf_dir, "pages"))


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Whether a document takes no part in learning."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = language_id.identify(docs.select("doc_id", "text", "lang"), ~held_out())
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def token_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "token-files")
    path = public_tokenizers.path("byte_bpe_50k.json")
    token_files.write_token_files(_table(spark, sf_dir, "documents"), folder, path, end_id=0)
    return token_files.read_token_files(spark, folder).select(
        F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32")
    )


def top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256.0)


def bpe_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.encode_documents(_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, digests=True)


def near_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(_table(spark, sf_dir, "embeddings"), threshold=0.93)


def document_proofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where 7 divides the id's crc32, the presented document has one character more than the manifest's."""
    docs = _table(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    more = F.when(tampered, 1).otherwise(0).cast("decimal(20,0)") + F.col("n_chars")
    digest = lambda n: merkle.digest(*(merkle.field(c) for c in (F.col("doc_id"), F.col("source"), F.col("lang"), n, F.col("text"))))
    return merkle.manifest(docs, digest(F.col("n_chars")), digest(more))


def near_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.nearest_neighbours(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def drawn_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def llm_queries() -> dict[str, Query]:
    return {
        "op1_url_filters": url_verdicts,
        "op2_packing": packed_pieces,
        "op3_suffix_dedup": without_repeats,
        "op4_near_dedup": near_documents,
        "op5_html_extraction": main_texts,
        "op6_language_id": languages,
        "op7_token_files": token_digests,
        "op8_topk_search": top_products,
        "op9_bpe": bpe_digests,
        "op10_embedding_dedup": near_embeddings,
        "op11_merkle_manifest": document_proofs,
        "op12_multi_index": near_neighbours,
        "op13_importance_resampling": drawn_documents,
    }


def llm_oracles() -> dict[str, str]:
    return {
        "op1_url_filters": URL_SQL,
        "op8_topk_search": TOPK_SQL,
        "op11_merkle_manifest": MERKLE_SQL,
        "op13_importance_resampling": IMPORTANCE_SQL,
    }


_RULES = "('org', '/', 'allow'), ('com', '/fr/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/de/', 'block')"

URL_SQL = rf"""
WITH RECURSIVE rules(rule_host, prefix, verdict) AS (VALUES {_RULES}),
parts AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') AS path
  FROM pages),
fits AS (
  SELECT host, path, arg_max(rule_host || prefix, length(rule_host || prefix)) AS rule,
    arg_max(verdict, length(rule_host || prefix)) AS verdict
  FROM (SELECT DISTINCT host, path FROM parts) p JOIN rules r
    ON (p.host = r.rule_host OR ends_with(p.host, '.' || r.rule_host)) AND starts_with(p.path, r.prefix)
  GROUP BY 1, 2),
outcomes AS (
  SELECT doc_id AS page_id, sum(CASE WHEN quality = 1 AND toxic = 0 THEN 1 ELSE 0 END) AS good, count(*) AS n
  FROM labels WHERE (quality = 1 AND toxic = 0) IS NOT NULL GROUP BY 1),
hosts AS (
  SELECT host, split_part(host, '.', -1) AS suffix,
    CASE WHEN host LIKE '%.%' THEN split_part(host, '.', -2) || '.' || split_part(host, '.', -1) ELSE host END AS domain,
    coalesce(sum(good), 0) AS good, coalesce(sum(n), 0) AS n
  FROM parts LEFT JOIN outcomes USING (page_id) GROUP BY 1, 2, 3),
levels AS (
  SELECT 'suffix' AS level, suffix AS name, sum(good) AS k, sum(n) AS n FROM hosts WHERE n > 0 GROUP BY 2
  UNION ALL SELECT 'domain', domain, sum(good), sum(n) FROM hosts WHERE n > 0 GROUP BY 2
  UNION ALL SELECT 'host', host, good, n FROM hosts WHERE n > 0),
moments AS (
  SELECT level, sum(k * k / n::DOUBLE) AS q, sum(k)::DOUBLE AS k, sum(n)::DOUBLE AS n, sum(n * n)::DOUBLE AS n2, count(*) AS g
  FROM levels GROUP BY 1),
shares AS (
  SELECT level,
    CASE WHEN k / n * (1 - k / n) * (n - n2 / n - (g - 1)) > 0
      THEN (q - k / n * k - k / n * (1 - k / n) * (g - 1)) / (k / n * (1 - k / n) * (n - n2 / n - (g - 1))) END AS share
  FROM moments),
weights AS (
  SELECT s.level, coalesce(CASE WHEN share > 0 THEN least(greatest(1 / share - 1, 1.0), 1000.0) END, 1000.0) AS w
  FROM (SELECT unnest(['suffix', 'domain', 'host']) AS level) s LEFT JOIN shares USING (level)),
whole AS (SELECT coalesce(sum(good) / nullif(sum(n), 0)::DOUBLE, 1.0) AS m0 FROM hosts WHERE n > 0),
posteriors AS (
  SELECT h.host, h.n + wh.w AS weight,
    (h.good + wh.w * ((coalesce(d.k, 0) + wd.w * ((coalesce(s.k, 0) + ws.w * m0) / (coalesce(s.n, 0) + ws.w)))
      / (coalesce(d.n, 0) + wd.w))) / (h.n + wh.w) AS m
  FROM hosts h
  LEFT JOIN levels s ON s.level = 'suffix' AND s.name = h.suffix
  LEFT JOIN levels d ON d.level = 'domain' AND d.name = h.domain
  JOIN weights ws ON ws.level = 'suffix' JOIN weights wd ON wd.level = 'domain' JOIN weights wh ON wh.level = 'host'
  CROSS JOIN whole)
SELECT p.page_id, p.host, p.path, f.rule,
  coalesce(f.verdict, CASE WHEN b.m + 1.645 * sqrt(b.m * (1 - b.m) / (b.weight + 1)) < 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM parts p LEFT JOIN fits f ON f.host = p.host AND f.path = p.path JOIN posteriors b ON b.host = p.host
"""

TOPK_SQL = """
WITH whole AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT q.row, q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM whole q JOIN whole c ON q.vec_id % 50 = 0 AND q.row <> c.row AND len(q.v) = len(c.v)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS rank FROM scores)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""

#: CRC-32 of a text's bytes (a list of numbers), bit by bit.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295, {bytes}), lambda c, b:
    list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))))"""
_BYTES = "list_transform(range(0, octet_length(encode({0}))), lambda i: ('0x' || substr(hex(encode({0})), 2 * i + 1, 2))::BIGINT)"


def _field(value: str) -> str:
    return f"coalesce(octet_length(encode({value}::VARCHAR)) || ':' || {value}, '-')"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(map(_field, ("doc_id", "source", "lang", n_chars, "text"))) + ")"


MERKLE_SQL = f"""
WITH RECURSIVE hashed AS (
  SELECT doc_id, lang, {_leaf("n_chars")} AS leaf,
    CASE WHEN {_CRC.format(bytes=_BYTES.format("doc_id::VARCHAR"))} % 7 = 0
      THEN {_leaf("(n_chars + 1)")} ELSE {_leaf("n_chars")} END AS claimed
  FROM documents),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
    count(*) OVER (PARTITION BY lang) AS n
  FROM hashed),
tree AS (
  SELECT lang, n AS width, 0 AS level, pos, leaf AS h FROM leaves
  UNION ALL
  SELECT lang, (width + 1) // 2, level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos))
  FROM tree WHERE width > 1 GROUP BY lang, width, level, pos // 2),
subroots AS (
  SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n
  FROM tree WHERE width = 1),
top AS (
  SELECT n AS width, 0 AS level, pos, subroot AS h FROM subroots
  UNION ALL
  SELECT (width + 1) // 2, level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos))
  FROM top WHERE width > 1 GROUP BY width, level, pos // 2),
climb AS (
  SELECT doc_id, l.lang, l.pos, l.n AS width, 0 AS level, claimed AS h, '' AS path, leaf, l.pos AS place FROM leaves l
  UNION ALL
  SELECT c.doc_id, c.lang, c.pos, (c.width + 1) // 2, c.level + 1,
    sha256(CASE WHEN place % 2 = 1 THEN coalesce(t.h, '') || c.h ELSE c.h || coalesce(t.h, '') END),
    path || coalesce(t.h, ''), leaf, place // 2
  FROM climb c LEFT JOIN tree t ON t.lang IS NOT DISTINCT FROM c.lang AND t.level = c.level AND t.pos = xor(c.place, 1)
  WHERE c.width > 1),
landed AS (
  SELECT doc_id, leaf, subroot, h, path, s.pos AS place, s.n AS width
  FROM climb c JOIN subroots s ON s.lang IS NOT DISTINCT FROM c.lang WHERE c.width = 1),
rise AS (
  SELECT *, 0 AS level FROM landed
  UNION ALL
  SELECT doc_id, leaf, subroot,
    sha256(CASE WHEN place % 2 = 1 THEN coalesce(t.h, '') || r.h ELSE r.h || coalesce(t.h, '') END),
    path || coalesce(t.h, ''), place // 2, (r.width + 1) // 2, r.level + 1
  FROM rise r LEFT JOIN top t ON t.level = r.level AND t.pos = xor(r.place, 1)
  WHERE r.width > 1)
SELECT doc_id, leaf, subroot, top.h AS root, sha256(path) AS proof_sha256, r.h AS folded_root, r.h = top.h AS verified
FROM rise r, top WHERE r.width = 1 AND top.width = 1
"""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

IMPORTANCE_SQL = f"""
WITH texts AS (
  SELECT row_number() OVER () AS row, 'corpus' AS side, doc_id, {_WORDS} AS w FROM documents
  UNION ALL SELECT row_number() OVER (), 'target', NULL, {_WORDS} FROM benchmark),
found AS (
  SELECT row, side, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS feature
  FROM texts),
buckets AS (
  SELECT feature, {_CRC.format(bytes=_BYTES.format("feature"))} % 10000 AS bucket FROM (SELECT DISTINCT feature FROM found)),
counts AS (
  SELECT bucket, count(*) FILTER (side = 'corpus') AS s, count(*) FILTER (side = 'target') AS t
  FROM found JOIN buckets USING (feature) GROUP BY 1),
gains AS (
  SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE)
    / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS gain
  FROM counts),
weights AS (
  SELECT row, count(*) AS n, floor(sum(gain) / count(*)::DOUBLE)::BIGINT AS weight
  FROM found JOIN buckets USING (feature) JOIN gains USING (bucket) WHERE side = 'corpus' GROUP BY 1),
scored AS (
  SELECT doc_id, len(w) AS words, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln(
      (('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM texts t LEFT JOIN weights USING (row) WHERE t.side = 'corpus'),
ranked AS (
  SELECT *, CASE WHEN words >= 20 THEN row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id) END AS place,
    count(*) FILTER (words >= 20) OVER () AS n
  FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 25 * n // 100 THEN place END AS rank FROM ranked
"""
