"""Corpus preparation: quality rules, near-dedup, decontamination, secret redaction, source mixing.

Each stage is (name, function of spark, docs and the tables' folder).  All but the last return the
columns that they were given, whatever their names; the last adds size, source_size, target and taken
(with _ appended to a name that is taken).  Null texts have no words, so quality rules drop them; an empty
table stays empty; repeated rows are one document to near-dedup.  Quality rules drop
rejected rows, near-dedup keeps one row of each component, decontamination drops rows that hold a
benchmark passage, the secret scan replaces secrets in the texts, and the mix keeps the rows it takes
words of.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import decontam, mixing, neardup, quality, secrets
from quillon.llm.common import cut, documents, table

#: Near copies are at least this similar, by five-word shingles.
NEAR_PERCENT = 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.good_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.one_of_each(docs, NEAR_PERCENT)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.take(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("redact_secrets", redact_secrets),
    ("mix_sources", mix_sources),
]
#: Near-duplicates, learned references and banded alignment are not expressible; tested by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stage's rows materialised before the next reads them."""
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {}
