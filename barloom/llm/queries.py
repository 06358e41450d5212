"""The registered queries of this subpackage over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barloom.llm import (
    decontaminate, divergence, fingerprints, html_text, language, licenses, line_dedup, mixing, ngram_jaccard, periodic, pii, quality, toxicity)

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql=None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query()
def op1_language(spark, sf_dir):
    return language.language_of_documents(table(spark, sf_dir, "documents"))


@query()
def op2_decontamination(spark, sf_dir):
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op3_toxicity(spark, sf_dir):
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query()
def op4_html_text(spark, sf_dir):
    return html_text.extracted(table(spark, sf_dir, "pages"))


@query(mixing.MIXTURE_SQL)
def op5_mixing(spark, sf_dir):
    return mixing.mixture(table(spark, sf_dir, "documents"))


@query()
def op6_licenses(spark, sf_dir):
    return licenses.scanned(table(spark, sf_dir, "documents"))


@query()
def op7_ngram_jaccard(spark, sf_dir):
    return ngram_jaccard.jaccard_components(table(spark, sf_dir, "documents"))


@query()
def op8_fingerprints(spark, sf_dir):
    return fingerprints.edited_likeness(table(spark, sf_dir, "documents"))


@query()
def op9_quality(spark, sf_dir):
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query()
def op10_line_dedup(spark, sf_dir):
    return line_dedup.repeats(table(spark, sf_dir, "documents"))


@query()
def op11_pii(spark, sf_dir):
    return pii.digest(table(spark, sf_dir, "documents"))


@query()
def op12_periodic(spark, sf_dir):
    return periodic.digest(table(spark, sf_dir, "documents"))


@query(divergence.AUDIT_SQL)
def op13_divergence(spark, sf_dir):
    return divergence.audit(table(spark, sf_dir, "documents"))
