"""The numbered queries: each applies one operator of this package, with its production settings, to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leeward.llm import (decontaminate, licences, manifest, mixing, neighbours, negatives, ngramjoin, perplexity, pii, quality, repeats,
                         sharding, suffixes, twins)
from leeward.llm.shared import read_table, ship

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(build):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            ship(spark)
            return build(spark, folder)
        _QUERIES[build.__name__] = run
        if sql is not None:
            _SQL[build.__name__] = sql
        return run
    return register


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def llm_sql() -> dict[str, str]:
    return dict(_SQL)


def fold(column: str, folds: int):
    return F.pmod(F.crc32(F.col(column).cast("string")), F.lit(folds))


@query()
def op1_quality_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = read_table(spark, folder, "documents"), read_table(spark, folder, "labels")
    held_out = F.coalesce(fold("doc_id", 3) == 1, F.lit(False))
    model = quality.fit(docs, labels.where(~held_out))
    return (quality.score(docs.select("doc_id", "text"), model)
            .select("doc_id", held_out.alias("held_out"), "score",
                    F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")))


@query()
def op5_two_pass_shards(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    return sharding.shuffled(docs, shards=40).select(
        "r.doc_id", sharding.size_of(F.col("r.text")).alias("size"),
        F.crc32(F.coalesce("r.text", F.lit(""))).alias("text_crc32"), F.lit("rows").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query()
def op6_budget_mix(spark: SparkSession, folder: str) -> DataFrame:
    made = mixing.mixed(read_table(spark, folder, "documents"), keep=["doc_id"])
    return made.select("r.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


@query()
def op3_boosted_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.report(read_table(spark, folder, "documents"))


@query()
def op4_spaced_seeds(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document and benchmark item that it holds."""
    found = decontaminate.overlaps(read_table(spark, folder, "documents"), read_table(spark, folder, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "matched", "compared")


@query(twins.WORD_WINDOWS)
def op8_rabin_karp(spark: SparkSession, folder: str) -> DataFrame:
    left = repeats.remove_repeats(read_table(spark, folder, "documents").select("doc_id", "text"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query(twins.JACCARD_GROUPS)
def op7_t_occurrence(spark: SparkSession, folder: str) -> DataFrame:
    found = ngramjoin.groups(read_table(spark, folder, "documents"), n=3, num=90, den=100)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


@query()
def op9_kneser_ney(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    held_out = F.coalesce(fold("doc_id", 5) == 1, F.lit(False))
    model = perplexity.fit(docs.where(~held_out))
    return perplexity.score(docs, model).select(
        "doc_id", held_out.alias("held_out"), "lm.n_tokens", "lm.n_known", F.lit(model.train_tokens).cast("long").alias("train_tokens"),
        "lm.base_score", "lm.score")


@query()
def op2_cross_polytope(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.search(read_table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


@query(twins.BYTE_STRINGS)
def op10_suffix_levels(spark: SparkSession, folder: str) -> DataFrame:
    left = suffixes.remove_repeats(read_table(spark, folder, "documents").select("doc_id", "text"))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query(twins.HARD_NEGATIVES)
def op11_hilbert_negatives(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(rows.select("vec_id", "embedding", label.alias("label")), F.col("vec_id") % 50 == 0)


@query(twins.MERKLE_LEAVES)
def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    def tampered(docs: DataFrame) -> dict:
        lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
        return {"when": F.crc32(F.col("doc_id").cast("string")) % 3 == 0, "text": lower}
    made = manifest.manifest(read_table(spark, folder, "documents"), tampered=tampered)
    return made.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root",
                       (F.col("folded_root") == F.col("root")).alias("verified"))


@query()
def op13_rare_licences(spark: SparkSession, folder: str) -> DataFrame:
    return licences.report(read_table(spark, folder, "documents")).drop("notices")
