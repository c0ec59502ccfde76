"""The operators of this subpackage as registered queries, each over its whole table, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import blob_ledger, bpe, fill_middle, hard_negatives, lang_crf, mixing, multi_index, shards, simhash_trie, suffix_dedup, token_counts, tool_calls, top_k

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("op1_tool_calls", tool_calls.SQL)
def _(spark, sf):
    linked = tool_calls.link(tool_calls.as_messages(table(spark, sf, "conversations")), tool_calls.SCHEMAS)
    # Every call here has an id; a plain turn after no assistant's turn is no result.
    return linked.where("call_id is not null").withColumn("errors", F.array_join("errors", ";"))


@query("op2_shards")
def _(spark, sf):
    packed = shards.pack(table(spark, sf, "documents"), shards=40)
    return packed.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


@query("op3_secrets", blob_ledger.SQL)
def _(spark, sf):
    versions = table(spark, sf, "documents").select(F.col("doc_id").alias("path"), F.col("text").alias("content"))
    found = blob_ledger.find_secrets(versions, blob_ledger.new_ledger(spark))
    count = {f"n_{r.name}": blob_ledger.count_of(F.col("spans"), r) for r in blob_ledger.RULES}
    spans = blob_ledger.as_text(F.col("spans"))
    return found.withColumns({**count, "spans": spans, "base_sha256": F.sha2(spans, 256)}).select(
        F.col("path").alias("doc_id"), *count, "base_sha256", "spans")


@query("op4_vectors")
def _(spark, sf):
    return multi_index.near_duplicates(table(spark, sf, "embeddings"))


@query("op5_bpe")
def _(spark, sf):
    import public_tokenizers

    vocabulary = bpe.Vocabulary.load(public_tokenizers.path("word_bpe_49k.json"))
    coded = table(spark, sf, "documents").select("doc_id", bpe.encode_and_decode(F.col("text"), vocabulary).alias("coded"))
    coded = coded.select("doc_id", "coded.*")
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op6_mix", mixing.SQL)
def _(spark, sf):
    return mixing.mix(table(spark, sf, "documents"))


@query("op7_suffixes")
def _(spark, sf):
    return suffix_dedup.remove_repeats(table(spark, sf, "documents"))


@query("op8_top_k", top_k.SQL)
def _(spark, sf):
    return top_k.search(table(spark, sf, "embeddings"), F.col("vec_id") % 50 == 0)


@query("op9_language")
def _(spark, sf):
    docs = table(spark, sf, "documents")
    told = docs.select("doc_id", lang_crf.held_out(F.col("doc_id")).alias("held_out"), lang_crf.identify(F.col("text"), lang_crf.train(docs)).alias("told"))
    return told.select("doc_id", "held_out", "told.lang_pred", "told.score")


@query("op10_simhash")
def _(spark, sf):
    rows, components = simhash_trie.near_duplicates(table(spark, sf, "documents"))
    fp = simhash_trie.as_hex(F.col("fp")).alias("fingerprint")
    return rows.join(components, "fp").select("doc_id", fp, "component_id")


@query("op11_hard_negatives", hard_negatives.SQL)
def _(spark, sf):
    vec_id, label = F.col("vec_id"), F.col("label")
    vectors = table(spark, sf, "embeddings").select("vec_id", "embedding", F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"))
    return hard_negatives.mine(vectors, vec_id % 100 == 0)


@query("op12_token_counts")
def _(spark, sf):
    import public_tokenizers

    tokenizer = token_counts.Tokenizer.load(public_tokenizers.path("byte_bpe_50k.json"))
    n_bytes, n_tokens = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"), token_counts.token_count(F.col("text"), tokenizer)
    counted = table(spark, sf, "documents").select("doc_id", n_bytes.alias("n_bytes"), n_tokens.alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 1024)


@query("op13_fill_middle", fill_middle.SQL)
def _(spark, sf):
    cut = fill_middle.transform(table(spark, sf, "documents"))
    output = F.sha2("output", 256).alias("output_sha256")
    restored = F.sha2(fill_middle.restore(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", output, restored)
