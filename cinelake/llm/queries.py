"""The numbered queries: each operator applied, with its production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cinelake.llm import conversation_repair, conversation_trie, language, licenses, minhash, mixing, packing, pii, quality, substring_dedup, suffix_dedup, topk_segments, toxicity
from cinelake.llm.registry import ORACLES, QUERIES, query, table  # noqa: F401


@query("op7_quality_rules")
def op7_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Repetition counts and the verdict for every document."""
    return quality.repetition_report(table(spark, folder, "documents"))


@query(
    "op2_exact_topk",
    """
    WITH v AS (
        SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    ), pairs AS (
        SELECT q.vec_id AS query_id, r.vec_id, list_inner_product(q.x, r.x)::BIGINT AS score
        FROM v q JOIN v r ON q.vec_id % 50 = 0 AND q.vec_id <> r.vec_id
    ), ranked AS (
        SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM pairs
    )
    SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
    """,
)
def op2_exact_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The five best partners of every vector whose id is divisible by 50."""
    vectors = table(spark, folder, "embeddings")
    return topk_segments.exact_top_k(vectors, vectors.filter("vec_id % 50 = 0"), k=5)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op6_best_fit_packing")
def op6_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens."""
    return packing.pack_documents(table(spark, folder, "documents"), tokenizer_path())


@query("op5_toxicity")
def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """A toxicity score for every document."""
    return toxicity.score_documents(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op3_source_mix")
def op3_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    """How many words of every document the mix takes."""
    return mixing.mix(table(spark, folder, "documents"))


@query("op4_personal_data")
def op4_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data in every document."""
    return pii.report(table(spark, folder, "documents"))


@query("op9_near_duplicates")
def op9_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return minhash.near_duplicates(table(spark, folder, "documents"))


@query("op1_substring_dedup")
def op1_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the passages of 35 words that occur elsewhere."""
    return substring_dedup.remove_repeated_passages(table(spark, folder, "documents"))


@query("op8_suffix_dedup")
def op8_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the strings of 400 bytes that occur elsewhere."""
    return suffix_dedup.remove_repeated_bytes(table(spark, folder, "documents"))


@query("op10_license_scan", licenses.oracle())
def op10_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """The licence of every document, found in it or inherited; its path is source, language and id."""
    return licenses.scan(table(spark, folder, "documents"), F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")))


@query("op12_language_id")
def op12_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """The language of every document, learned from three quarters of them."""
    fold = "crc32(cast(doc_id as string)) % 4"
    found = language.predict(table(spark, folder, "documents"), learn=f"{fold} <> 2")
    return found.select("doc_id", F.expr(f"coalesce({fold} = 2, false)").alias("held_out"), "lang_pred", "score", "n_words")


@query("op13_conversation_repair")
def op13_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    """Every conversation, damaged by a fixed rule, with its faults and its cheapest repair."""
    return conversation_repair.repair_damaged(table(spark, folder, "conversations"))


@query("op11_conversation_trie")
def op11_conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    """Every distinct beginning of the conversations, each of which starts like the first of its hundred."""
    turns, members = conversation_trie.rebuilt(conversation_trie.turn_digests(table(spark, folder, "conversations")))
    return conversation_trie.prefix_trie(turns, members)
