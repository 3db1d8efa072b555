"""One registered query per corpus operator, with production parameters, over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from geoweft.llm import bpe, decontamination, fingerprints, linededup, packing, phrases, pii, quality, secrets, simhash, token_store, warc, whitening
from geoweft.llm.common import shared_dir, table

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
#: Target mixture of op4: these sources in equal shares while they last, others after them.
MIXTURE = {f"src{k}": 1.0 for k in range(20)}


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digests(table(spark, sf_dir, "documents"), WORD_BPE)


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_neighbours(table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_archives(table(spark, sf_dir, "pages"), out)
    index = warc.capture_index(spark, out)
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "timestamp")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), BYTE_BPE, weights=MIXTURE)


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = f"{shared_dir(spark)}/token-store-{uuid.uuid4().hex}"
    token_store.write_store(table(spark, sf_dir, "documents"), out, WORD_BPE)
    return token_store.read_digests(spark, out)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.report(table(spark, sf_dir, "documents"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents")).drop("found", "row")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(table(spark, sf_dir, "documents"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_bpe, op2_fingerprints, op3_warc, op4_packing, op5_token_store, op6_simhash, op7_quality, op8_line_dedup, op9_secrets, op10_pii, op11_phrases, op12_decontamination, op13_whitening)}


def oracle_sql() -> dict[str, str]:
    return {"op3_warc": warc.ORACLE_SQL, "op8_line_dedup": linededup.ORACLE_SQL, "op11_phrases": phrases.ORACLE_SQL, "op12_decontamination": decontamination.ORACLE_SQL}
