"""Registered queries and, where SQL can say the same, their oracle text.

Each query runs one operator over whole tables. ``present`` gives results a
form that compares across engines: dates as text, flags and integers as
bigint, doubles rounded to six digits.
"""

from __future__ import annotations

from importlib import import_module

from pyspark.sql import functions as F

from panelweave.session import prepare
from panelweave.sources.readers import widen

QUERIES: dict = {}
ORACLES: dict = {}
AREAS: dict = {}
TEXT_KEYS = {"documents": "doc_id", "pages": "page_id"}

_MODULES = ("io_queries", "filter_queries", "join_queries", "aggregate_queries", "window_queries",
            "text_queries", "stats_queries", "model_queries", "graph_queries", "stream_queries", "composite_queries")


def present(df, digits=6):
    cols = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("date",):
            c = c.cast("string")
        elif kind.startswith("timestamp"):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif kind in ("boolean", "int", "smallint", "tinyint"):
            c = c.cast("bigint")
        elif kind in ("double", "float"):
            c = F.round(c.cast("double"), digits)
        cols.append(c.alias(name))
    return df.select(*cols)


class Tables:
    """Lazy access to the given tables by name."""

    def __init__(self, spark, folder):
        self.spark, self.folder = prepare(spark), folder.rstrip("/")

    def path(self, name):
        return f"{self.folder}/{name}.parquet"

    def __getattr__(self, name):
        rows = self.spark.read.parquet(self.path(name))
        # long texts: use all cores even where the table is one small file
        return widen(rows, TEXT_KEYS[name]) if name in TEXT_KEYS else rows


def query(name, sql=None, area=""):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, folder: present(fn(Tables(spark, folder)))
        AREAS[name] = area
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn
    return register


def load():
    for module in _MODULES:
        import_module(f"catalog.{module}")
    return QUERIES, ORACLES
