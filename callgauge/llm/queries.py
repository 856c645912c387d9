"""One registered query per corpus operator: ``(spark, sf_dir) -> DataFrame``.

Queries only read their table, call the operator and derive the columns that are compared.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callgauge.llm import (
    alignment,
    exact,
    lines,
    lm,
    merkle,
    packing,
    pieces,
    secrets,
    shards,
    simhash,
    topk,
    toxicity,
    warc,
)
from callgauge.llm.common import stored, table
from callgauge.session import scratch_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

MODEL_PATH = "file:///opt/tokenizers/piece_bpe_32k.model"
BYTES_PATH = "file:///opt/tokenizers/byte_bpe_50k.json"


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


@query
def op1_warc_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), path)
    return warc.read(spark, path).select(
        warc.page_id("record_id").cast("long").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        warc.page_id("refers_to").cast("long").alias("refers_to"),
    )


def _line_dedup(spark: SparkSession, sf_dir: str, **least: int) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return lines.drop_boilerplate(
        pages,
        id_col="page_id",
        host=lines.host_of("url"),
        lines=lines.html_lines("html"),
        **least,
    ).withColumnRenamed("id", "page_id")


@query
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _line_dedup(spark, sf_dir)  # the guard of the SQL twin: MIN_PAGES


@query
def op2_line_dedup_small_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _line_dedup(spark, sf_dir, min_pages=2, min_seen=2)


@query
def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = docs.select("doc_id", secrets.spans("text").alias("found"))
    base = secrets.KINDS[:3]

    def count(kind: str):
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        *(count(kind).alias(f"n_{kind}") for kind in base),
        F.sha2(secrets.listed(F.col("found"), base), 256).alias("base_sha256"),
        secrets.listed(F.col("found")).alias("spans"),
    )


@query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    score = toxicity.scorer(spark, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return docs.select("doc_id", score("text").alias("s")).select("doc_id", "s.*")


@query
def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack(docs, length=packing.words("text")).withColumnRenamed("id", "doc_id")


@query
def op5_best_fit_packing_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    encode = pieces.encoder(spark, pieces.read_model(spark, MODEL_PATH))
    sized = stored(
        docs.select("doc_id", F.coalesce(F.size(encode("text")), F.lit(0)).alias("n")),
        "piece-counts",
    )
    length = F.greatest(F.col("n"), F.lit(0))  # the size of null may be -1
    return packing.pack(sized, length=length).withColumnRenamed("id", "doc_id")


@query
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.groups(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def _lm_score(spark: SparkSession, sf_dir: str, order: int) -> DataFrame:
    scored = lm.score(table(spark, sf_dir, "documents"), order=order)
    return scored.select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_backoff",
        F.round("log_score", 4).alias("log_score"),
        F.round("mean_log_score", 6).alias("mean_log_score"),
    )


@query
def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lm_score(spark, sf_dir, lm.ORDER)  # the order of the SQL twin


@query
def op7_lm_score_order3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lm_score(spark, sf_dir, 3)


@query
def op8_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


@query
def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = pieces.read_model(spark, MODEL_PATH)
    return pieces.round_trips(docs, model, id_col="doc_id", text_col="text").select(
        F.col("id").alias("doc_id"),
        F.size("ids").cast("long").alias("n_pieces"),
        "ids",
        F.col("same").alias("round_trip"),
    )


@query
def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query
def op11_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", *shards.sizes("text"))
    placed = shards.assign(docs, order_by=("doc_id", "size", "text_crc32"))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    picked = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    tampered = F.when(picked, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    found = merkle.manifest(docs, changed={"n_chars": tampered})
    again = merkle.folded(F.col("current"), F.col("path"))
    return found.select(
        F.col("id").alias("doc_id"),
        "leaf",
        "subroot",
        "root",
        "proof_sha256",
        again.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


@query
def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found, _ = alignment.align(
        docs,
        alignment.ByteBpe(pieces.read_model(spark, BYTES_PATH)),
        alignment.PieceModel(pieces.read_model(spark, MODEL_PATH)),
    )
    return found.withColumnRenamed("id", "doc_id")
