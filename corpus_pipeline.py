"""A corpus pipeline of five stages, each one operator applied to all that the stage before it kept.

quality rules -> SimHash near-dedup -> benchmark decontamination -> mixing to target weights -> token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet below the shared
folder and rereads it as the next stage's docs.  All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from supplyscope.llm.common import for_workers, materialize, table
from supplyscope.llm.decontaminate import drop_contaminated
from supplyscope.llm.mixing import sample_mixture
from supplyscope.llm.quality import keep_good
from supplyscope.llm.simhash import keep_one
from supplyscope.llm.token_store import write_tokens


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and are no robust outliers of their language and source."""
    return keep_good(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of fingerprints within 3 bits (3-word shingles), the document with the smallest doc_id."""
    return keep_one(docs, shingle=3, max_bits=3)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the table ``benchmark``."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose expected tokens have the target shares of sources, languages and topics."""
    return sample_mixture(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token-id files with their index; one row a document, read back: doc_id, start, n_tokens, ids_crc32."""
    store = write_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return store.read_all(docs.select("doc_id"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    (name, for_workers(f)) for name, f in (
        ("quality_rules", quality_rules), ("simhash_near_dedup", simhash_near_dedup), ("benchmark_decontamination", benchmark_decontamination),
        ("mixing", mixing), ("token_output", token_output))]

#: Fingerprints, latent retrieval and tokens can't be said in SQL.  tests/llm checks that each stage keeps a subset, not yet which rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the table ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
