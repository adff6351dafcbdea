"""The registered queries of this subpackage: thin uses of its operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import bpe, chat, decontaminate, langid, licenses, simhash, token_file, topk, toxicity, warc
from tidelog.llm.common import new_path, only, table

RANKS = "byte_bpe_50k.tiktoken"


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token ids by prefix dynamic programming, and their decoding."""
    model = bpe.BpeModel(spark, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    docs = only(table(spark, sf_dir, "documents"), "doc_id", "text")
    return bpe.bpe_encode(docs, model, decoded="decoded").select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document shares with the benchmark."""
    docs = only(table(spark, sf_dir, "documents"), "doc_id", "text")
    found = decontaminate.find_phrases(docs, table(spark, sf_dir, "benchmark")).drop("text")
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s.stop - s.start)
    ids = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def op4_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, written as rANS blocks and read back."""
    folder = new_path(spark, "token-file")
    token_file.write_tokens(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return token_file.read_tokens(spark, folder).select(
        F.col("id").alias("doc_id"),
        "start",
        F.expr("octet_length(ids) div 4").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"),
    )


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(only(docs, "doc_id", "text"), langid.fitted(docs)).drop("text")
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "entropy", "rejected")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    docs = only(table(spark, sf_dir, "documents"), "doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    found = toxicity.score(docs, model).drop("text")
    return found.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted", "n_matches")


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best rows by inner product for each row whose id is divisible by 100."""
    index = topk.Index(table(spark, sf_dir, "embeddings"), 10)
    return topk.search(index, index.rows.where(F.col("id") % 100 == 0))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, formatted and read back."""
    return chat.read_back(chat.format_conversations(chat.planted(table(spark, sf_dir, "conversations"))))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, written to WARC archives and read back."""
    path = new_path(spark, "warc")
    warc.write_warc(table(spark, sf_dir, "pages"), path, least_bytes=0)
    records = warc.read_warc(spark, path, payloads=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every license template that a document contains."""
    return licenses.scan(table(spark, sf_dir, "documents"), licenses.template_table(spark))


def op3_licenses_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for whole license texts and more notices."""
    return licenses.scan(table(spark, sf_dir, "documents"), licenses.template_table(spark, licenses.whole_templates()))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_simhash": op2_simhash,
    "op6_decontaminate": op6_decontaminate,
    "op4_token_file": op4_token_file,
    "op10_langid": op10_langid,
    "op7_toxicity": op7_toxicity,
    "op5_topk": op5_topk,
    "op8_chat": op8_chat,
    "op9_warc": op9_warc,
    "op3_licenses": op3_licenses,
    "op3_licenses_whole": op3_licenses_whole,
}

OP5_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS x FROM embeddings
 WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.x, c.x) AS BIGINT) AS score
 FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 10
"""

OP6_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
bi AS (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM bi),
sizes AS (SELECT DISTINCT n FROM bw),
di AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d JOIN sizes ON len(w) >= n),
hit AS (SELECT di.doc_id, bw.item_id, di.i, di.n FROM di JOIN bw ON di.n = bw.n AND array_to_string(di.w[di.i:di.i + di.n - 1], ' ') = bw.s),
spots AS (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS at FROM hit),
hits AS (SELECT doc_id, count(*) AS n_hit FROM spots GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names
 FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS name FROM hit) x GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
 sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits ON d.doc_id = hits.doc_id LEFT JOIN found ON d.doc_id = found.doc_id
"""

ORACLES: dict[str, str] = {"op3_licenses": licenses.oracle_sql(), "op3_licenses_whole": licenses.oracle_sql(licenses.whole_templates()), "op5_topk": OP5_SQL, "op6_decontaminate": OP6_SQL}
