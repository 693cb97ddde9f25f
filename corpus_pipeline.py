"""The training-corpus pipeline: documents in, token ids of the documents worth training on out.

Each stage is (spark, docs, sf_dir) -> DataFrame; its result is written as Parquet and read again as the next one's docs.
Every stage works on all that its predecessor kept and all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylva.llm.bpe import encode_texts
from sylva.llm.common import discard, fold, small_batches, stored, table
from sylva.llm.decontaminate import find_leaks
from sylva.llm.ngram_join import keep_one
from sylva.llm.pii import find_pii, fit_tagger
from sylva.llm.queries import tokenizer_file
from sylva.llm.toxicity import fit, score


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier holds for toxic go. Null and empty texts score as texts without features and stay, as
    do rows with a null id; repeated rows are judged alike. Without labels or documents nothing is held for toxic."""
    small_batches(spark)
    labels = table(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0)
    model = fit(docs.where(fold("doc_id", 5) != 0), labels)
    kept = score(docs.withColumns({f"_{c}": F.col(c) for c in CLASH if c in docs.columns}), model).where("predicted = 0")
    return kept.withColumns({c: F.col(f"_{c}") for c in CLASH if c in docs.columns}).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays, with its repeated rows. Null texts, texts
    without words and rows with a null id are no one's duplicates and stay."""
    small_batches(spark)
    return keep_one(docs).select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark item stands go. Null and empty texts and rows with a null id stay; repeated rows are
    judged alike; items without words match nothing, and with an empty benchmark all documents stay."""
    small_batches(spark)
    own = {"_leaks": F.col("leaks")} if "leaks" in docs.columns else {}
    kept = find_leaks(docs.withColumns(own), table(spark, sf_dir, "benchmark")).where(F.size("leaks") == 0)
    return (kept.withColumn("leaks", F.col("_leaks")) if own else kept).select(docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; personal data in their texts is replaced by its kind, and n_chars follows the text. Null and empty
    texts stay as they are; repeated rows are masked alike; of spans of several kinds that overlap the first names the whole."""
    small_batches(spark)
    clash = [c for c in FOUND if c in docs.columns]
    masked = find_pii(docs.withColumns({f"_{c}": F.col(c) for c in clash}), fit_tagger(docs), mask=True)
    new = {c: F.col(f"_{c}" if c in clash else c) for c in docs.columns}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("spans") != "", F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return masked.select(*[new[c].alias(c) for c in docs.columns])


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of every document that is left; a null or empty text has none, and repeated rows each get a
    row. Slices are small and few pieces are remembered, since the executors come here with the heap that the stages before
    have filled."""
    small_batches(spark)
    return encode_texts(docs.select("doc_id", "text"), tokenizer_file("word_bpe_49k.json"), slice_bytes=1 << 20, remembered=120_000)


#: Columns that scoring and tagging add; documents that have columns of these names get their own back.
CLASH = ("score", "predicted")
FOUND = ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")

STAGES = [
    ("toxicity", toxicity),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("pii", personal_data),
    ("bpe", token_ids),
]

#: SQL can express neither the trained stages nor the transducer; tests/llm compares run() with planted rows and each stage's
#: operator with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; a stage's Parquet goes as soon as the next one has written its own."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
