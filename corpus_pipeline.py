"""The corpus pipeline: five stages over the documents, each written as Parquet and read again by the next.

Quality rules drop documents; near-duplicates leave one of each class; documents that hold a benchmark item go; sources
are mixed to their target weights (a document may then stand there twice, or not at all); every row gets its shard.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from pagelens.llm import decontaminate, mixing, near_dups, quality, sharding
from pagelens.llm.common import Scratch, materialize, release

SHARDS = 8

#: Paths that the stage called last has written on the shared folder.
_left: list[str] = []


def _roots(docs: DataFrame) -> list[str]:
    """The paths that docs was read from, as its plan names them; no folder is listed."""
    leaves = docs._jdf.queryExecution().analyzed().collectLeaves()
    relations = [leaf for leaf in map(leaves.apply, range(leaves.size())) if leaf.getClass().getSimpleName() == "LogicalRelation"]
    found = [r.relation().location().rootPaths() for r in relations if r.relation().getClass().getSimpleName() == "HadoopFsRelation"]
    return [paths.apply(k).toString() for paths in found for k in range(paths.size())]


def _stage(work: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage that first deletes what the stage before has left on the shared folder, unless its docs are read from there.

    A stage's result is written before the next stage begins, as the contract of STAGES has it; who calls stages by hand
    must write each result, or pass it on as the next one's docs, before calling another.
    """

    @wraps(work)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        read = _roots(docs)
        release(spark, [p for p in _left if not any(p.rpartition("/")[2] in f for f in read)])
        scope = Scratch(spark)
        out = work(spark, docs, sf_dir)
        _left[:] = scope.paths()
        return out

    return run_stage


@_stage
def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality rules keep."""
    return quality.filter_quality(docs)


@_stage
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, the one with the least doc_id."""
    return near_dups.drop_near_duplicates(docs)


@_stage
def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without a benchmark item."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixing.apply_mix(docs)


@_stage
def to_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows with their shard."""
    return sharding.with_shard(docs, SHARDS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("near_duplicates", drop_copies),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("sharding", to_shards),
]

#: SQL can't express the first four stages; tests compare the whole run with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to the table documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs)
    return docs
