"""The corpus pipeline: toxicity filter, near copies, benchmark leaks, secrets, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's
docs. All but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspark.llm.bpe import default_vocabulary, encode_texts
from vecspark.llm.common import checkpointed, free_name, scratch_folder, table
from vecspark.llm.decontamination import find_contamination
from vecspark.llm.secrets import redact
from vecspark.llm.simhash import fingerprint_texts, near_duplicates
from vecspark.llm.toxicity import fit_for, score_texts


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below 0.5 stay; labels are learned from the rows that aren't held out."""
    model = fit_for(docs, table(spark, sf_dir, "labels"))
    score, passages = free_name(docs, "toxicity"), free_name(docs, "toxic_passages")
    return score_texts(docs, model, new=(score, passages)).where(F.col(score) < 0.5).select(docs.columns)


def _by_text(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """docs without what rows name: doc_id and the hash of its text, so each row goes or stays by its own text."""
    gone = rows.select(F.col("doc_id").alias("_gone"), F.col("text_hash").alias("_hash")).distinct()
    same = docs["doc_id"].eqNullSafe(gone["_gone"]) & (F.xxhash64(docs["text"]) == gone["_hash"])
    return docs.join(gone, same, "left_anti").select(*(docs[c] for c in docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints the document of the smallest doc_id stays; rows with a null doc_id all stay.

    Rows that share the smallest doc_id stay together: they can't be told apart by it.
    """
    texts = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    prints = checkpointed(fingerprint_texts(texts).select("doc_id", "text_hash", "fingerprint"))
    return _by_text(docs, near_duplicates(prints).where("doc_id <> component_id"))


def drop_leaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no test item to 0.8 or more stay."""
    keyed = docs.select(F.struct("doc_id", F.xxhash64("text").alias("text_hash")).alias("doc_id"), "text")
    return _by_text(docs, checkpointed(find_contamination(keyed, table(spark, sf_dir, "benchmark")).select("doc_id.*").distinct()))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay, with [REDACTED] in the place of secrets; n_chars follows where a text was changed."""
    changed = free_name(docs, "changed")
    clean = redact(docs, changed=changed)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.when(F.col(changed), F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return clean.select(docs.columns)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and the ids of each text, their number, and the digests of ids and decoded text."""
    return encode_texts(docs.select("doc_id", "text"), default_vocabulary(), digests=True).drop("text")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("benchmark_leaks", drop_leaked),
    ("secrets", redact_secrets),
    ("tokens", tokenise),
]

#: Fingerprints, fitted scores and merges have no SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written to the shared checkpoint folder (a temporary one in a local session without it)."""
    base = scratch_folder(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{i}-{name}")
        docs = spark.read.parquet(f"{base}/{i}-{name}")
    return docs
