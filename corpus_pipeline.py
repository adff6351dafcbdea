"""The corpus pipeline: toxicity, language, near-duplicates, benchmark passages, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next
stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import bpe, decontaminate, langid, simhash, toxicity
from tidelog.llm.common import join_split, only, table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Not expressible in SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def _documents(df: DataFrame) -> DataFrame:
    return only(df, *COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score rejects go.

    Null and empty texts have no match and stay unless most labelled texts are toxic; texts of any length are scored whole,
    repeated rows each on their own; without labels or documents nothing is rejected.
    """
    docs = _documents(docs)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return _documents(toxicity.score(docs, model).where("predicted = 0"))


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null and empty ones too), or in no learned language, go; `lang` stays what it was.

    Texts of any length are judged whole, repeated rows each on their own. With nothing to learn from, all go.
    """
    docs = _documents(docs)
    return _documents(langid.identify(docs, langid.fitted(docs)).where("NOT rejected"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays (of equal ids, one by the hash of its text).

    Rows are told apart by id and text, so other texts of a repeated or null id are judged on their own; of rows that agree in
    both, one stays. Null and empty texts are one group. What goes is decided on keys alone; then the texts meet it once.
    """
    docs = _documents(docs)
    none = F.col("doc_id").isNull()
    key = F.struct(none.alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64("text").alias("hash"))
    found = simhash.near_duplicates(docs.select(key.alias("row_key"), "text"), "row_key")
    each = written(found.groupBy("row_key").agg(F.min("component_id").alias("component_id"), F.count("*").alias("n")), "judged")
    total = each.agg(F.sum("n")).first()[0] or 0
    flat = lambda k: F.concat_ws(":", k.none.cast("string"), k.id.cast("string"), k.hash.cast("string")).cast("binary")
    odd = each.select(flat(F.col("row_key")).alias("row_key"), "n", F.when(F.col("component_id") != F.col("row_key"), "gone").when(F.col("n") > 1, "repeated").alias("why")).where("why IS NOT NULL")
    judged = join_split(docs.withColumn("row_key", flat(key)), written(odd, "odd"), "row_key", "n", total, "why")
    once, repeated = judged.where("why IS NULL"), judged.where("why = 'repeated'").dropDuplicates(["row_key"])
    return _documents(once.unionByName(repeated))


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark are cut out of the texts; n_chars follows where a text was cut.

    Null texts stay null, empty ones empty; texts of any length are searched whole; an empty benchmark changes nothing.
    """
    cut = decontaminate.find_phrases(_documents(docs), table(spark, sf_dir, "benchmark"), cut=True)
    return cut.withColumn("n_chars", F.when(F.size("spans") > 0, F.length("text")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, with their digests; `same` says whether they decode to the text.

    A null text counts as empty: no ids. Repeated rows stay repeated; no documents, no rows.
    """
    model = bpe.BpeModel(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return bpe.bpe_encode(docs.select("doc_id", "text"), model, decoded="decoded").select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        (F.col("decoded") == F.coalesce(F.col("text").cast("binary"), F.lit(b""))).alias("same"),
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_unknown_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", remove_benchmark),
    ("tokens", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
