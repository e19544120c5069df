"""Registered queries of the numbered operators, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm import ann, language_model, mixing, periods, pieces, pii, quality_model, quality_rules, secret_scan, simhash, token_counts, variants, warc
from pulsegrid.llm.common import ship, table


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = pieces.encode_decode(docs, keep=["doc_id"])
    decoded = F.encode("decoded", "UTF-8")
    return coded.select("doc_id", "n_tokens", F.sha2("ids_le", 256).alias("ids_sha256"), F.sha2(decoded, 256).alias("decoded_sha256"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.scan(docs)
    digest = F.sha2(F.encode(pii.joined(F.col("base")), "UTF-8"), 256)
    counts = [f"n_{k}" for k in pii.KINDS]
    return found.select("doc_id", *counts, digest.alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_model.train(docs, table(spark, sf_dir, "labels"))
    scored = quality_model.score(docs, model, keep=["doc_id"])
    return scored.select("doc_id", quality_model.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, limit=4096, keep=["doc_id"])


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return quality_rules.apply_rules(docs).select("doc_id", *columns)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    return mixing.mix(docs, mixing.WEIGHTS).drop(mixing.RATE)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = simhash.near_duplicates(docs)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secret_scan.scan(docs)
    digest = F.sha2(F.encode("base_spans", "UTF-8"), 256)
    return found.select("doc_id", "n_assign", "n_access", "n_hex", digest.alias("base_sha256"), "spans")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return warc.round_trip(pages, with_payload=False).drop("payload")


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.search(vectors, F.col("vec_id") % 50 == 0, k=5)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", periods.planted(F.col("doc_id"), F.col("text")).alias("text"))
    found = periods.periodic_runs(docs, keep=["doc_id"])
    best = periods.longest(F.col("runs"))
    digest = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    milli = F.floor(1000 * best["length"] / best["period"]).cast("long")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        milli.alias("exponent_milli"), digest(periods.listed(F.col("runs"))).alias("runs_sha256"), digest(F.col("collapsed")).alias("collapsed_sha256"),
    )


def op12_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = language_model.score(docs, language_model.train(docs), keep=["doc_id"])
    return scored.select("doc_id", language_model.held_out(F.col("doc_id")).alias("held_out"), *language_model.SCORES)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return variants.variant_groups(variants.count_words(docs, damage=variants.DAMAGE))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_sentencepiece, op2_pii, op3_quality, op4_token_counts, op5_quality_rules, op6_mixing, op7_simhash, op8_secret_scan, op9_warc,
        op10_nearest, op11_periodic_runs, op12_language_model, op13_spelling_variants,
    )
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def shipped(query):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return query(spark, sf_dir)

        return run

    return {name: shipped(query) for name, query in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {"op5_quality_rules": quality_rules.RULES_SQL, "op6_mixing": mixing.MIX_SQL, "op9_warc": warc.ROUND_TRIP_SQL}
