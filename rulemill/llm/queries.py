"""The queries of the training-data operators, over whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, common, decontam, langid, lm, neardup, quality, sharding, spiece, toxicity, warc


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    common.ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spiece.encode(_read(spark, sf_dir, "documents"), spiece.default_model(), ids=False, decoded=False)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, _read(spark, sf_dir, "labels")))


def op4_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.fit_and_score(_read(spark, sf_dir, "documents"), order=3)


def op5_itq_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.near_vectors(_read(spark, sf_dir, "embeddings"))


def op6_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(_read(spark, sf_dir, "documents"), shards=16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number", "place")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.decontaminate(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def decontamination_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every exact occurrence of a window: document, item, first word (from 0) and number of words."""
    index = common.stored(decontam.build_index(_read(spark, sf_dir, "documents")), "postings")
    found = decontam.search(index, _read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("matches").alias("m")).select("doc_id", F.col("m.item").alias("item_id"), F.col("m.position").alias("first_word"), F.col("m.n").alias("n"))


def decontamination_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the items of which all words of a window stand within four words more, in any order."""
    index = common.stored(decontam.build_index(_read(spark, sf_dir, "documents")), "postings")
    found = decontam.search(index, _read(spark, sf_dir, "benchmark"), slop=4, matches=False)
    return found.select("doc_id", F.size("items").cast("long").alias("n_items"), F.size("near").cast("long").alias("n_near"), decontam.items_digest(F.col("near")).alias("near_sha256"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, _read(spark, sf_dir, "labels")))


def op9_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_read(spark, sf_dir, "documents"), width=3, percent=85)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.round_trip(_read(spark, sf_dir, "pages"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id,
        op2_sentencepiece,
        op3_toxicity,
        op4_kneser_ney,
        op5_itq_links,
        op6_feistel_shards,
        op7_decontamination,
        op8_quality,
        op9_chosen_path,
        op10_warc,
        decontamination_matches,
        decontamination_near,
    )
}


def _components(links: str, nodes: str, node: str) -> str:
    """CTEs: reach (every pair of connected vertices) and comp (the smallest reachable one of each vertex)."""
    return f"reach AS (SELECT {node} AS x, {node} AS y FROM {nodes} UNION SELECT r.x, l.b FROM reach r JOIN {links} l ON r.y = l.a), comp AS (SELECT x, min(y) AS component_id FROM reach GROUP BY 1)"


_ASCII_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(" + _ASCII_LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_TOKENS = r"regexp_extract_all(" + _ASCII_LOWER.format("coalesce(text, '')") + r", '[^\x20\x09-\x0D]+')"

_HITS = f"""WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents), i AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
    k AS (SELECT item_id, ws, least(8, len(ws)) AS k FROM i WHERE len(ws) > 0),
    win AS (SELECT DISTINCT item_id, k, array_to_string(ws[j:j + k - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(ws) - k + 2)) AS j FROM k)),
    dw AS (SELECT doc_id, j, k, array_to_string(ws[j:j + k - 1], ' ') AS g FROM (SELECT doc_id, ws, s.k, unnest(range(1, len(ws) - s.k + 2)) AS j FROM d, (SELECT DISTINCT k FROM win) s)),
    hit AS (SELECT doc_id, j, k, item_id FROM dw JOIN win USING (k, g))"""

#: DuckDB SQL by other means than the operators': all pairs, joins on whole windows, recursion. The rest is tested against brute force.
ORACLE_SQL: dict[str, str] = {
    "op5_itq_links": "WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), links AS (SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.vec_id <> q.vec_id AND list_cosine_similarity(p.e, q.e) >= 0.95), "
    + _components("links", "v", "vec_id")
    + " SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN comp ON x = vec_id",
    "decontamination_matches": f"""{_HITS} SELECT doc_id, item_id, (j - 1)::BIGINT AS first_word, k::INTEGER AS n FROM hit""",
    "op7_decontamination": f"""{_HITS},
    words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(j, j + k)) AS p FROM hit) GROUP BY 1),
    items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hit) GROUP BY 1)
    SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op9_chosen_path": f"""WITH RECURSIVE d AS (SELECT doc_id, {_TOKENS} AS ws FROM documents),
    s AS (SELECT DISTINCT doc_id, array_to_string(ws[j:j + 2], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) AS j FROM d WHERE len(ws) > 0)),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
    links AS (SELECT a, b FROM (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS shared FROM s p JOIN s q ON p.g = q.g AND p.doc_id <> q.doc_id GROUP BY 1, 2) JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
    {_components("links", "d", "doc_id")}
    SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM d LEFT JOIN n USING (doc_id) JOIN comp ON x = doc_id""",
    "op10_warc": """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), f AS (SELECT h, min(page_id) AS first FROM p WHERE strlen(h) >= 100 GROUP BY 1)
    SELECT page_id, strlen(p.h)::BIGINT AS payload_bytes, sha256(p.h) AS payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to FROM p LEFT JOIN f USING (h)""",
}
