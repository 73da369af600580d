"""The queries of this package, each a thin projection of its operator's result."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphstream.llm import bpe, chat, line_dedup, near_dup, packing, pii, quality, sharding, spelling, topk, toxicity, trees, trie
from glyphstream.runtime import table

MULTI_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: The ranks of the vocabulary and merges of byte_bpe_50k.json; tests hold both libraries' ids equal.
PACK_RANKS, PACK_CLOSING_ID, PACK_SIZE = public_tokenizers.path("byte_bpe_50k.tiktoken"), 2, 1024
#: Its added tokens are ids of their own.
PACK_ADDED = public_tokenizers.path("byte_bpe_50k.json")


def op1_segment_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each query's 5 highest inner products over ``embeddings``."""
    found = topk.top_k(table(spark, sf_dir, "embeddings"), lambda i: i % 50 == 0, k=5)
    return found.withColumnRenamed("id", "vec_id")


#: Documents at this score or above are rejected.
TOXIC = 0.7
#: The contract's similarity: 3-word shingles, 85 hundredths.
NEAR = near_dup.Settings(words=3, threshold=85, bands=25, rows=5)


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-duplicate ``documents``."""
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), NEAR)


def op3_toxicity_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every text of ``documents``, learnt from ``labels`` that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.learn_from(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id",
        toxicity.held_out().alias("held_out"),
        "score",
        (F.col("score") >= TOXIC).cast("int").alias("predicted"),
        F.array_join(F.transform("toxic_spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ",").alias("spans"),
    )


def op4_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every text of ``documents``; digests of ids and bytes."""
    ids = bpe.encode(table(spark, sf_dir, "documents"), MULTI_RANKS, public_tokenizers.PATTERN)
    back = bpe.decode(ids, MULTI_RANKS, public_tokenizers.PATTERN)
    return back.select(
        "doc_id",
        "n_tokens",
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` without later repeated runs, and the runs removed."""
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "removed_runs")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all ``documents`` into sequences of at most 1024 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), PACK_RANKS, public_tokenizers.PATTERN, PACK_CLOSING_ID, PACK_SIZE, added=PACK_ADDED)


def op7_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every text of ``documents``."""
    found = pii.find(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *(count(k.name) for k in pii.BASE),
        F.sha2(pii.listed(F.col("spans"), pii.BASE), 256).alias("base_sha256"),
        pii.listed(F.col("spans"), pii.KINDS).alias("spans"),
    )


def op8_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule ledger of all ``documents`` and the verdict of policy v1."""
    rows = quality.ledger(table(spark, sf_dir, "documents"))
    failed = F.col("failures").bitwiseAND(F.lit(quality.POLICIES["base"])) != 0
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), quality.passes("v1").alias("kept"), "failures",
    )


def op9_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format all ``conversations`` and one with control strings; digests read back from the output."""
    said = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"select * from values (-7L, 0L, 'user', '{said}'), (-7L, 1L, 'assistant', '{said}') as t(conv_id, turn, role, text)")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    back = chat.read_back(chat.windows(rows))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op10_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Put all ``documents`` into shards 0 to 23 of near equal bytes."""
    placed = sharding.shard(table(spark, sf_dir, "documents"), 24)
    return placed.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all ``documents``, damaged as stated, with their more frequent near forms."""
    return spelling.variants(spelling.vocabulary(table(spark, sf_dir, "documents")))


#: Documents at this score or above are of good quality.
GOOD = 0.3


def op12_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every text of ``documents``, learnt from ``labels`` that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    scored = trees.score(docs, trees.learn_from(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", trees.held_out().alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all rebuilt ``conversations``."""
    return trie.prefix_trie(trie.rebuilt(trie.paths(table(spark, sf_dir, "conversations"))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_segment_topk": op1_segment_topk,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_toxicity_crf": op3_toxicity_crf,
    "op4_bpe_codec": op4_bpe_codec,
    "op5_line_dedup": op5_line_dedup,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_pii_spans": op7_pii_spans,
    "op8_quality_ledger": op8_quality_ledger,
    "op9_chat_windows": op9_chat_windows,
    "op10_histogram_shards": op10_histogram_shards,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_quality_trees": op12_quality_trees,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLE_SQL: dict[str, str] = {
    "op1_segment_topk": topk.SQL,
    "op2_near_duplicates": near_dup.SQL,
    "op7_pii_spans": pii.SQL,
    "op8_quality_ledger": quality.SQL,
    "op11_spelling_variants": spelling.SQL,
    "op13_prefix_trie": trie.SQL,
}
