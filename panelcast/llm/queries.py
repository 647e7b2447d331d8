"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm import (chat_format, decontaminate, embed_dedup, hilbert_kmeans, html_extract, lang_crf, line_dedup,
                           mix_sources, quality_rules, simhash_dedup, token_count, topk_pivots, turn_repair)
from panelcast.llm.common import doc_mod, spool, table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(spark, table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.match(spark, table(spark, sf_dir, "documents").select("doc_id", "text"),
                              table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items",
                      F.sha2(F.encode(F.concat_ws(",", "items"), "UTF-8"), 256).alias("items_sha256"), "contaminated")


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(spark, table(spark, sf_dir, "embeddings"))


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_extract.extract(spark, table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    sp = spool(spark)
    rows = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    rows = rows.unionByName(spark.createDataFrame(chat_format.PROBE, rows.schema))
    messages = chat_format.number_turns(spark, rows, sp)          # written before the turns are numbered
    out = chat_format.read_back(chat_format.format_paths(spark, messages))
    return out.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = mix_sources.sized(table(spark, sf_dir, "documents"))
    docs = spool(spark).put(docs.select("doc_id", "source", "size", "_mx_hash"))
    return mix_sources.mix_sized(spark, docs).select("doc_id", "size", "source_size", "target", "taken")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = doc_mod(F.col("doc_id"), 4) == 2
    docs = table(spark, sf_dir, "documents")
    model = lang_crf.fit(spark, docs, ~held_out)
    out = lang_crf.identify(spark, docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    out = token_count.count_tokens(spark, table(spark, sf_dir, "documents").select("doc_id", "text"),
                                   public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_dedup.near_duplicates(spark, table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = doc_mod(F.col("doc_id"), 5) == 0
    out = quality_rules.classify(spark, table(spark, sf_dir, "documents").select("doc_id", "text"),
                                 table(spark, sf_dir, "labels"), ~held_out)
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op11_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_pivots.search(spark, table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_kmeans.summarise(spark, *hilbert_kmeans.cluster(spark, table(spark, sf_dir, "embeddings")))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found = turn_repair.digests(turn_repair.repair(spark, turn_repair.damage(given)))
    ids = given.select(F.col("conv_id").alias("_id")).distinct()
    empty = F.sha2(F.encode(F.lit(""), "UTF-8"), 256)
    return ids.join(found, F.col("_id").eqNullSafe(F.col("conv_id")), "left").select(
        F.col("_id").alias("conv_id"), *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in turn_repair.COUNTS],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", empty).alias("repaired_sha256"))


QUERIES = {f.__name__: f for f in (
    op1_line_dedup, op2_decontaminate, op3_embedding_near_dedup, op4_html_extract, op5_chat_format, op6_mix_sources, op7_language_id, op8_token_counts,
    op9_simhash_near_dedup, op10_quality_rules, op11_exact_top_k, op12_centroid_clustering, op13_conversation_repair)}

ORACLES = {"op1_line_dedup": line_dedup.ORACLE, "op2_decontaminate": decontaminate.ORACLE,
           "op3_embedding_near_dedup": embed_dedup.ORACLE, "op5_chat_format": chat_format.ORACLE,
           "op6_mix_sources": mix_sources.ORACLE, "op11_exact_top_k": topk_pivots.ORACLE,
           "op12_centroid_clustering": hilbert_kmeans.ORACLE, "op13_conversation_repair": turn_repair.ORACLE}
