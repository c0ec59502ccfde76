"""A corpus pipeline: language, near duplicates, secrets, mixture, tokens.

Each stage takes (spark, docs, sf_dir) and decides on the rows the stage before
it kept; what it returns is written and read again as the next one's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import blob_ledger, bpe, lang_crf, mixing, simhash_trie
from gridloom.llm.tables import packed, stash

#: Documents go whose words' best labels, of whichever languages, have a lower mean.
LEAST_SURE = 0.5
TOKENIZER = "word_bpe_49k.json"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in learned languages, one or several; null texts and texts without a letter are rejected.

    Where no row is labelled nothing is learned, and every text with a letter stays.
    """
    model = lang_crf.train(docs)
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    told = docs.select(packed(docs), lang_crf.identify(F.col("text"), model).alias("told"))
    return told.where((F.col("told.lang_pred") != lang_crf.UNKNOWN) & (F.col("told.sure") >= LEAST_SURE)).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts whose fingerprints of 3-word shingles link at 2 bits or fewer, the one of the smallest id.

    Null and empty texts have fingerprint zero and link like any other; null ids come last. No rows give no rows.
    """
    return simhash_trie.one_of_each(docs, simhash_trie.BUDGET)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced in the text. Null and empty texts stay as they are; no rows give no rows."""
    clean = blob_ledger.redact(docs, blob_ledger.new_ledger(spark))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice. Texts that are null or hold no word are not taken; no rows give no rows."""
    return mixing.apply_mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, n_tokens, ids) of every row; null and empty texts have no ids."""
    import public_tokenizers

    vocabulary = bpe.Vocabulary.load(public_tokenizers.path(TOKENIZER))
    encoded = docs.select("doc_id", "source", bpe.encode(F.col("text"), vocabulary).alias("ids"))
    return encoded.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("language", language), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mixture", mixture), ("tokens", tokens),
]
#: A fitted model and a tokenizer are no SQL. The pipeline's tests hold near_duplicates to tokens, and run() behind the
#: language stage, against plain Python, row by row, and language against fixed texts.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
