"""A corpus pipeline of five training-data operators; part of the llm subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm import common, line_dedup, mixing, quality, sentencepiece, simhash
from pulsegrid.llm.queries import MAX_EPOCHS, MAX_RATIO, MIN_PAGES, model_path, small_batches

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without the lines that are common on their host; n_chars follows. Rows with a
    null text go, rows with a null id or equal ids are judged by themselves."""
    return quality.keep_good(docs.select(*COLUMNS)).withColumn("n_chars", F.char_length("text").cast("long"))


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their site's boilerplate lines; n_chars follows. Copies of a text are one page."""
    lines = line_dedup.dedup_lines(docs, "source", "text", MAX_RATIO, MIN_PAGES, distinct=True)
    return lines.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates (Jaccard similarity of five-word shingles 0.8 or more): the one with the
    smallest doc_id, one without a doc_id only where no other is there, then by the row's key."""
    key = F.struct(F.col("id").isNull().alias("no_id"), "id", "k1", "k2")
    first = simhash.similar(docs, COLUMNS).groupBy("root").agg(F.min(key).alias("f")).select(F.col("f.k1").alias("_k1"), F.col("f.k2").alias("_k2"))
    k1, k2 = common.full_key(COLUMNS)
    kept = docs.select(*COLUMNS).withColumns({"_k1": k1, "_k2": k2}).join(first, ["_k1", "_k2"], "left_semi")
    return kept.dropDuplicates(["_k1", "_k2"]).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target weights: every document at least once, small sources repeated. Null sources are one."""
    return mixing.realise(mixing.plan(docs, max_epochs=MAX_EPOCHS)).select(*COLUMNS)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with a check that they decode to its text. A null text has no tokens, and no round trip."""
    small_batches(spark)
    docs = docs.select("doc_id", "source", "text", F.sha2("text", 256).alias("sha256"))
    coded = sentencepiece.decode(sentencepiece.encode(docs, model_path(), keep_text=False), model_path())
    return coded.select("doc_id", "source", "n_tokens", "tokens", F.col("sha256").eqNullSafe(F.sha2("decoded", 256)).alias("round_trip"))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", drop_boilerplate),
    ("SimHash near-dedup", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", encode_pieces),
]

#: SimHash, the components and the tokenizer have no SQL form; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each but the last is materialised in the shared checkpoint folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.cut(docs)
    return docs
