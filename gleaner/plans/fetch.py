"""Fetch: rows to documents, by trace.

A fetcher adds columns of documents to a table with ``_trace`` and ``_trace_key`` and keeps all other columns. Wide localities give it
the distinct keys and join documents back last, so page contents are not shuffled with the rows; the others give it the
rows themselves, where they are.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..conf import Conf
from ..sources.store import Store
from . import cache
from .actions import trace_key

Fetcher = Callable[[DataFrame], DataFrame]
DOC = ["uri", "kind", "error", "content"]
#: As many keys of ``key_by`` have their documents broadcast, so that rows stay where they are however few keys they share.
FEW_KEYS = 64


def table_fetcher(pages: DataFrame, uri: str = "url", content: str = "html") -> Fetcher:
    """Resolves the last address of a trace in a table; a missing one is an error row, not a failure."""
    known = pages.select(F.col(uri).alias("_uri"), F.col(content).alias("content"), F.lit(True).alias("_found"))

    def fetch(keys: DataFrame) -> DataFrame:
        wanted = keys.withColumn("_uri", F.try_element_at("_trace", F.lit(-1))["uri"])
        got = wanted.join(known, "_uri", "left")
        kind = F.when(F.col("_found"), "doc").when(F.size("_trace") == 0, "nodoc").otherwise("error")
        error = F.when(kind == "error", F.concat(F.lit("not found: "), F.coalesce("_uri", F.lit("?"))))
        return got.select(*keys.columns, F.col("_uri").alias("uri"), kind.alias("kind"), error.alias("error"), "content")

    return fetch


def keyed(rows: DataFrame, traces: Column, key_by: Column | None = None, how: str = "inner", first_n: int | None = None, collection: bool = True, order: Column | None = None) -> DataFrame:
    """rows, once for each of their traces, with ``_trace``, ``_trace_key``, ``_index`` (the place among the row's traces) and ``_place`` (that of the row).

    ``traces`` is an array of traces; equal ones of a row count once. ``how="inner"`` drops rows without a trace, "outer" keeps them.
    """
    one = F.array_distinct(traces) if collection else traces
    if first_n is not None:
        one = F.slice(one, 1, first_n)
    explode = F.posexplode if how == "inner" else F.posexplode_outer
    place = order if order is not None else F.monotonically_increasing_id()
    out = rows.select("*", place.alias("_place"), explode(one).alias("_index", "_trace"))
    empty = F.col("_trace").isNull()
    key = F.when(empty, F.lit("")).otherwise(trace_key(F.col("_trace")) if key_by is None else key_by.cast("string"))
    return out.withColumn("_trace_key", key).withColumn("_trace", F.coalesce("_trace", F.from_json(F.lit("[]"), rows.select(traces.alias("t")).schema["t"].dataType.elementType)))


def fetch(
    rows: DataFrame,
    traces: Column,
    fetcher: Fetcher,
    key_by: Column | None = None,
    how: str = "inner",
    locality: str = "wide",
    first_n: int | None = None,
    cached: DataFrame | None = None,
    remote: bool = True,
    order: Column | None = None,
) -> DataFrame:
    """rows with the columns ``uri, kind, error, content`` of their documents.

    locality: ``wide`` fetches each key once for all rows; ``narrow`` once for each partition, after a sort inside it; ``passthrough`` once for each row;
    neither of these moves rows. ``cache_aware`` is wide with rows and documents partitioned alike, so that later fetches of the same
    keys need no new exchange. Of the traces that ``key_by`` makes the same, the one of the first row runs (by ``order``, else as the table lies).
    ``cached`` holds documents by ``_trace_key`` that are not fetched again; with ``remote`` false all others are errors.
    Rows without a trace join no exchange of keys, so any number of them is harmless. With ``key_by`` the keys are counted at once (no trace runs for that).
    """
    if locality not in ("wide", "narrow", "passthrough", "cache_aware"):
        raise ValueError(f"unknown locality {locality}")
    if not remote and cached is None:
        raise ValueError("remote access is off and there is no cache")
    marked = keyed(rows, traces, key_by, how, first_n, order=order)
    bare = F.size("_trace") == 0
    none = {"uri": F.lit(None).cast("string"), "kind": F.lit("nodoc"), "error": F.lit(None).cast("string"), "content": F.lit(None).cast("string")}
    full = marked.filter(~bare)
    if locality in ("narrow", "passthrough"):
        here = full.sortWithinPartitions("_trace_key", "_place") if locality == "narrow" else full
        out = _resolve(here, _once_a_run(fetcher, locality == "narrow"), cached, remote)
    else:
        if locality == "cache_aware":
            full = full.repartition("_trace_key")
        keys = _first_traces(full)
        docs = _resolve(keys, fetcher, cached, remote).drop("_trace")
        few = key_by is not None and locality == "wide" and len(full.select("_trace_key").distinct().limit(FEW_KEYS + 1).collect()) <= FEW_KEYS
        out = full.join(F.broadcast(docs) if few else docs, "_trace_key", "left")
    more = {f.name: F.lit(None).cast(f.dataType) for f in out.schema if f.name not in (*marked.columns, *none)}
    return out.unionByName(marked.filter(bare).withColumns(none | more)).drop("_place")


def _first_traces(full: DataFrame) -> DataFrame:
    """Each key with the trace of its first row. Equal traces of a key are merged first: that keeps numbers only and needs no sort of all rows."""
    merged = full.groupBy("_trace_key", "_trace", "_index", F.col("_place").isNull().alias("_no_place")).agg(F.min("_place").alias("_place"))
    return merged.groupBy("_trace_key").agg(F.min_by("_trace", F.struct("_place", "_index")).alias("_trace"))


def _once_a_run(fetcher: Fetcher, merge: bool) -> Fetcher:
    """Fetchers that can share documents between rows of one key that follow each other are told to."""
    sharing = getattr(fetcher, "sharing", None)
    return sharing if merge and sharing is not None else fetcher


def _resolve(keys: DataFrame, fetcher: Fetcher, cached: DataFrame | None, remote: bool) -> DataFrame:
    """keys with documents, from the cache where it has them."""
    if cached is None:
        return fetcher(keys)
    hit = cached.select("_trace_key", *DOC)
    held = keys.join(hit, "_trace_key")
    missing = keys.join(hit.select("_trace_key"), "_trace_key", "left_anti")
    if remote:
        return held.unionByName(fetcher(missing), allowMissingColumns=True)
    gone = {"uri": F.lit(None).cast("string"), "kind": F.lit("error"), "error": F.lit("remote access is off"), "content": F.lit(None).cast("string")}
    return held.unionByName(missing.withColumns(gone))


def fetch_through(rows: DataFrame, traces: Column, fetcher: Fetcher, path: str, conf: Conf | None = None, wayback: Column | None = None, **options: object) -> DataFrame:
    """Fetch with a versioned cache at ``path``: what it holds in the time range of the settings is not fetched, and what is fetched is added.

    The documents are resolved at once (they have to be written before anything can read them); traces with an error are not kept.
    """
    conf = conf or Conf()
    spark = rows.sparkSession
    kept, store = f"{path.rstrip('/')}/versions", Store(spark)
    cached = None
    if conf.cache_read and store.exists(kept):
        before = F.lit(conf.ignore_cached_before).cast("timestamp") if conf.ignore_cached_before else None
        earliest, latest = cache.time_range(F.current_timestamp(), conf.cache_life_seconds, wayback, before)
        cached = cache.as_of(spark.read.parquet(kept), "_trace_key", "ts", earliest, latest)
    if not conf.remote:
        return fetch(rows, traces, fetcher, cached=cached, remote=False, **options)
    keys = keyed(rows, traces, how="inner").filter(F.size("_trace") > 0).groupBy("_trace_key").agg(F.min_by("_trace", "_place").alias("_trace"))
    missing = keys if cached is None else keys.join(cached.select("_trace_key"), "_trace_key", "left_anti")
    fresh = f"{path.rstrip('/')}/fetched-{uuid.uuid4().hex}"
    fetcher(missing).select("_trace_key", *DOC, F.current_timestamp().alias("ts")).write.parquet(fresh)
    got = spark.read.parquet(fresh)
    if conf.cache_write:
        cache.append(got, kept)
    docs = got.select("_trace_key", *DOC)
    if cached is not None:
        docs = docs.unionByName(cached.select("_trace_key", *DOC))
    return fetch(rows, traces, fetcher, cached=docs, remote=False, **options)


def fetch_index(rows: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """Places (from 0) of all outputs of one input group."""
    return rows.withColumn("index", F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1)


def observations(fetched: DataFrame, by: list[str], name: Column, value: Column, order: Column) -> DataFrame:
    """A trajectory for each row group: its ordered (name, value) observations. Groups are single rows' traces, so they are bounded."""
    return fetched.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(order.alias("at"), name.alias("name"), value.alias("value")))).alias("trajectory"))


def by_name(trajectory: Column, name: str) -> Column:
    return F.filter(trajectory, lambda o: o["name"] == name)


def visible(trajectory: Column, scope: Column) -> Column:
    """The observations of a scope, an array of their places (``at``)."""
    return F.filter(trajectory, lambda o: F.array_contains(scope, o["at"]))


def head(trajectory: Column) -> Column:
    """The first observation, NULL for none."""
    return F.try_element_at(trajectory, F.lit(1))


def only(trajectory: Column) -> Column:
    """The only observation, NULL for none; several are an error."""
    return F.when(F.size(trajectory) > 1, F.raise_error(F.lit("several observations"))).otherwise(head(trajectory))


def succeeded(docs: DataFrame) -> DataFrame:
    return docs.filter("kind = 'doc'")


def failed(docs: DataFrame) -> DataFrame:
    return docs.filter("kind = 'error'")


__all__ = ["cache", "table_fetcher", "keyed", "fetch", "fetch_through", "fetch_index", "observations", "by_name", "visible", "head", "only", "succeeded", "failed"]
