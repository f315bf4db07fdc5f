"""The registered queries of the training-data operators: thin calls with production parameters on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm import crossentropy, language, licenses, mixing, packing, quality, repeats, resampling, sharding, simhash, vectors, warc_fixity, whitening
from cellweave.session import ship_package


PRIOR = 50.0
LEAST_SHARE = 0.75


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.decisions(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op2_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return warc_fixity.fixity(pages, warc_fixity.damaged_copy(pages))


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.removed(documents(spark, sf_dir))


def op4_crossentropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = crossentropy.scored(documents(spark, sf_dir), trusted(spark, sf_dir), PRIOR)
    return found.select("doc_id", "n_words", *[F.round(k, 6).alias(k) for k in ("loss_target", "loss_background", "score")])


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(documents(spark, sf_dir), tokenizer())


def op6_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.languages_of(documents(spark, sf_dir))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def trusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of the documents that people labelled as good."""
    return spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1 and coalesce(toxic, 0) = 0").select("doc_id")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(documents(spark, sf_dir), trusted(spark, sf_dir))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shuffled(documents(spark, sf_dir))


def op11_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(documents(spark, sf_dir), LEAST_SHARE)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resampled(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_QUERIES = [op1_mixing, op2_warc_fixity, op3_repeats, op4_crossentropy, op5_packing, op6_vectors, op7_language, op8_simhash, op9_quality, op10_sharding, op11_licenses, op12_whitening, op13_resampling]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def shipped(f):
        def run(spark, sf_dir):
            ship_package(spark)
            return f(spark, sf_dir)

        return run

    return {f.__name__: shipped(f) for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_warc_fixity": warc_fixity.SQL,
        "op3_repeats": repeats.SQL,
        "op4_crossentropy": crossentropy.SQL.format(prior=PRIOR),
        "op6_vectors": vectors.SQL,
        "op11_licenses": licenses.SQL.format(least=LEAST_SHARE),
        "op13_resampling": resampling.SQL,
    }
