"""Queries of the training-data operators: name -> callable(spark, sf_dir) -> DataFrame."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathweave.llm import (chat, html_paths, minhash_forest, mixing, packing, prefix_trie, quality_classifier, quality_rules, range_join, repair,
                           sharding, toxicity, warc)
from pathweave.llm.common import checkpointed, shared_dir, table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ensemble = quality_classifier.fit(docs, table(spark, sf_dir, "labels"))
    return quality_classifier.score(docs, ensemble).select("doc_id", "held_out", "score", "predicted")


def op2_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack_documents(docs, TOKENIZER).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op3_host_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_paths.extract_main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op4_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.arc_to_warc(warc.arc_files(table(spark, sf_dir, "pages")), at)
    return warc.read_warc(spark, at).select(
        F.col("source_key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_forest.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "kept")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", "held_out", "score", "predicted", *toxicity.FEATURES)


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    tricky = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)],
                                  "conv_id bigint, turn bigint, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    log = chat.streamed(chat.as_events(rows))  # deltas, edits and regenerations, of which the fold makes the rows again
    return chat.read_back(chat.render(chat.fold_events(log)))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.judge(docs).select("doc_id", *quality_rules.COUNTS, "base_failed", "kept")


def op9_metric_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return range_join.near_vectors(table(spark, sf_dir, "embeddings"))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    return mixing.mix_sources(checkpointed(docs), "size").select("doc_id", "size", "source_size", "target", "taken")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    done = repair.repair(repair.damage(rows)).withColumnRenamed("conv_id", "c")
    every = rows.select("conv_id").distinct()
    counts = [F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    said = F.transform(F.arrays_zip("repaired_roles", "repaired_texts"),
                       lambda t: F.concat(t["repaired_roles"], F.lit(":"), t["repaired_texts"]))
    said = F.coalesce(F.array_join(said, "\n"), F.lit(""))
    return every.join(done, every["conv_id"].eqNullSafe(done["c"]), "left").select(
        "conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"),
        F.sha2(F.encode(said, "UTF-8"), 256).alias("repaired_sha256"))


def op12_karmarkar_karp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])


def op13_rollup_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = checkpointed(prefix_trie.turns_of(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")))
    return prefix_trie.trie(*prefix_trie.rebuilt(turns))


QUERIES = {f.__name__: f for f in (
    op1_rule_ensemble, op2_vector_packing, op3_host_paths, op4_arc_to_warc, op5_minhash_forest, op6_toxicity, op7_chat_formatting, op8_quality_rules,
    op9_metric_range_join, op10_mix_sources, op11_conversation_repair, op12_karmarkar_karp, op13_rollup_trie)}
