"""All registered queries of the library (those of the llm folder register themselves)."""

from __future__ import annotations

import importlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusloom.operators.kept import Kept, stamp
from corpusloom.operators.textindex import TextIndex, kept_index, open_index
from corpusloom.plans.lineage import shared_dir
from corpusloom.sources.views import duck, view

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
_INDEXES: dict[tuple, Kept] = {}
_MODULES = ["scans", "selects", "joins", "aggregates", "windows", "toplists", "scalars", "corpus", "identity", "graphs", "retrieval", "checks", "streams", "bibliographies"]


class Tables:
    """The tables and adapter views of one folder, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def document_index(self) -> TextIndex:
        """The index of ``documents``: written when first asked for, then opened by all queries of the application while the table's files are the same."""
        docs = self.documents.select("doc_id", "text")
        known = (self.spark.sparkContext.applicationId, self.sf_dir, stamp(self.spark, f"{self.sf_dir}/documents.parquet"))
        if known not in _INDEXES:
            kept = kept_index(f"{shared_dir(self.spark)}/documents-index-{uuid.uuid4().hex}", "doc_id", "text")
            kept.apply(docs, 0)
            _INDEXES[known] = kept
        return open_index(_INDEXES[known], docs)

    def __getattr__(self, name: str) -> DataFrame:
        return view(self.spark, self.sf_dir, name)


def query(sql: str | None = None, like: str | None = None) -> Callable:
    """Registers a function of ``Tables``; ``sql`` is the same as DuckDB SQL over {tables and views}, ``like`` another query that gives the same rows."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable:
        _QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            _SQL[f.__name__] = duck(sql)
        if like:
            _SQL[f.__name__] = _SQL[like]
        return f

    return add


def _load() -> None:
    for m in _MODULES:
        importlib.import_module(f"corpusloom.plans.{m}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)


def entry(spark: SparkSession) -> DataFrame:
    _load()
    return _QUERIES["r5_top_spans"](spark, "/root/testdata/sf0.001")
