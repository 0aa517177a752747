"""The corpus pipeline over documents: quality rules, near-duplicate removal, pseudonyms, mixing, token ids.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept; all but the last return the
columns of documents. `run` applies them in order, writing each result to the shared folder before the next reads it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltagrid.llm import bpe, jaccard, mixing, pii, rules
from deltagrid.llm.common import cut, table
from deltagrid.llm.queries import VOCABULARY, secret


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised rules keep. Null and empty texts go, as they fail the base rules; equal texts stay or go together, repeated rows keep their number."""
    return rules.kept_rows(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component: the one with the least id, of equal ids a fixed one; documents without an id count after those with one. Documents without words are linked with nothing and stay."""
    return jaccard.deduplicate(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data under pseudonyms of the same format. Null and empty texts stay as they are; every row stays, and every other column, whatever its name."""
    other = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    safe = pii.protect(docs.select(F.struct(*other).alias("packed"), "text"), secret(spark))
    return safe.select(*(F.col("text" if c == "text" else f"packed.`{c}`") for c in docs.columns))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, at most three times. A null source is one of its own; rows of one id are rows of their own. Columns stay as they are, whatever their names."""
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("packed"), "doc_id", "source", mixing.words(F.col("text")).alias("n"))
    return mixing.repeated(mixing.mix(packed, size=F.col("n"))).select("packed.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text; a null or empty one has none. An input column named ids or n_tokens is replaced."""
    coded = bpe.encode(docs.select("doc_id", "source", "lang", "text"), VOCABULARY, drop=("text",))
    return coded.withColumn("n_tokens", F.size("ids").cast("bigint"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("pii", private),
    ("mixing", mixed),
    ("bpe", tokens),
]
#: SQL can express neither the rules' expectation-maximisation nor token ids; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
