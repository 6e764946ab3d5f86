"""A View: a DataFrame with the engine's settings and operators. Every operator returns a new, lazy View."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .conf import Conf
from .operators import records, sampling
from .plans import explore as ex
from .plans import fetch as fe
from .sources import files


def exploded(df: DataFrame, kept: list[str], array: Column, pos: str, name: str) -> DataFrame:
    """A row for each element. Rows with none are dropped afterwards: from an inner explode the optimizer makes a filter on the array, and where
    Python makes that, every page would be parsed twice, in two workers."""
    return df.select(*kept, F.posexplode_outer(array).alias(pos, name)).filter(F.col(pos).isNotNull())


class View:
    def __init__(self, df: DataFrame, conf: Conf | None = None) -> None:
        self.df, self.conf = df.select("*"), conf or Conf()

    # sources
    @classmethod
    def blank(cls, spark: SparkSession, conf: Conf | None = None) -> View:
        return cls(spark.range(1).select(), conf)

    @classmethod
    def create(cls, spark: SparkSession, rows: list, schema: str, slices: int | None = None, conf: Conf | None = None) -> View:
        df = spark.createDataFrame(rows, schema)
        return cls(df.repartition(slices) if slices else df, conf)

    def _with(self, df: DataFrame) -> View:
        return View(df, self.conf)

    # projections
    def select(self, *cols: Column | str) -> View:
        return self._with(self.df.select(*cols))

    def filter(self, cond: Column | str) -> View:
        return self._with(self.df.filter(cond))

    def flat_map(self, array: Column, name: str = "value", keep: list[str] | None = None, index: str | None = None) -> View:
        """One row for each element, with its index among them if asked for; rows with none are dropped."""
        kept = keep if keep is not None else self.df.columns
        out = exploded(self.df, kept, array, index or "_pos", name)
        return self._with(out if index else out.drop("_pos"))

    def fork(self, array: Column, name: str = "value", ordinal: str | None = None, how: str = "outer") -> View:
        """One row for each element with its place; ``inner`` drops rows with none, ``outer`` keeps them with nulls. Places are arrays of one int."""
        out = exploded(self.df, ["*"], array, "_pos", name) if how == "inner" else self.df.select("*", F.posexplode_outer(array).alias("_pos", name))
        if ordinal:
            out = out.withColumn(ordinal, F.when(F.col("_pos").isNotNull(), F.array("_pos")))
        return self._with(out.drop("_pos"))

    def with_columns(self, **cols: Column) -> View:
        """Adds fields; one that exists already is an error."""
        clash = set(cols) & set(self.df.columns)
        if clash:
            raise records.Conflict(f"fields exist: {sorted(clash)}")
        return self._with(self.df.withColumns(cols))

    def with_columns_many(self, structs: Column) -> View:
        """Each row with each of an array of structs; rows with none are dropped."""
        out = self.df.select("*", F.explode(structs).alias("_s"))
        fields = [f.name for f in out.schema["_s"].dataType.fields]
        clash = set(fields) & set(self.df.columns)
        if clash:
            raise records.Conflict(f"fields exist: {sorted(clash)}")
        return self._with(out.select(*self.df.columns, *[F.col("_s")[f].alias(f) for f in fields]))

    def drop(self, *names: str) -> View:
        return self._with(self.df.drop(*names))

    def append_to(self, name: str, value: Column) -> View:
        return self._with(records.append_to_array(self.df, name, value))

    def sample(self, array: Column, name: str = "value") -> View:
        """The configured down-sampling of an array, exploded."""
        kind, _, n = self.conf.sampling.partition(":")
        pick = {"identity": lambda a: a, "first": lambda a: sampling.first_n(a, int(n)), "ratio": lambda a: sampling.by_ratio(a, float(n)), "size": lambda a: sampling.to_size(a, int(n))}
        return self.flat_map(pick[kind](array), name)

    # order, sets, partitions
    def sort_by(self, *cols: Column | str, ascending: bool = True, partitions: int | None = None) -> View:
        if partitions:
            return self._with(self.df.repartitionByRange(partitions, *cols).sortWithinPartitions(*cols, ascending=ascending))
        return self._with(self.df.orderBy(*cols, ascending=ascending))

    def sorted(self, ascending: bool = True, partitions: int | None = None) -> View:
        """In the order of the rows themselves: by all columns that have an order, from the left."""
        kinds = ("map", "variant")
        return self.sort_by(*[c for c, t in self.df.dtypes if not t.startswith(kinds)], ascending=ascending, partitions=partitions)

    def sort_by_exploration(self, *ordinals: str) -> View:
        """Crawled rows as a reader would meet them: by the places of their forks, then by depth."""
        return self.sort_by(*ordinals, "depth")

    def union(self, *others: View) -> View:
        df = self.df
        for o in others:
            df = df.unionByName(o.df)
        return self._with(df)

    def coalesce(self, n: int, shuffle: bool = False) -> View:
        return self._with(self.df.repartition(n) if shuffle else self.df.coalesce(n))

    def repartition(self, n: int, *keys: str) -> View:
        return self._with(self.df.repartition(n, *keys))

    def persist(self, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> View:
        self.df.persist(level)
        return self

    def unpersist(self) -> View:
        self.df.unpersist()
        return self

    @property
    def is_cached(self) -> bool:
        return self.df.is_cached

    def checkpoint(self) -> View:
        out = self._with(ex.cut(self.df))
        out.checkpointed = True
        return out

    checkpointed = False

    # documents
    def fetch(self, traces: Column, fetcher: fe.Fetcher, **options: object) -> View:
        """``cache_path`` names the versioned cache of documents, used as the settings say."""
        options.setdefault("locality", self.conf.locality)
        path = options.pop("cache_path", None)
        if path is not None:
            return self._with(fe.fetch_through(self.df, traces, fetcher, path, self.conf, **options))
        options.setdefault("remote", self.conf.remote)
        return self._with(fe.fetch(self.df, traces, fetcher, **options))

    def audited(self, path: str, normalised: Column | None = None) -> View:
        """Keeps the documents at ``path`` as the ``auditing`` setting says."""
        files.audit(self.df, path, normalised, self.conf.auditing)
        return self

    def without_errors(self, path: str, fallback: str | None = None) -> View:
        """Documents that are no errors; the ``error_dump`` setting says if those are kept at ``path``."""
        return self._with(files.dump_errors(self.df, path, fallback) if self.conf.error_dump else self.df.filter("kind <> 'error'"))

    def explore(self, step: Callable[[DataFrame], DataFrame], key: str, **options: object) -> View:
        options.setdefault("min_depth", self.conf.min_depth)
        options.setdefault("max_depth", self.conf.max_depth)
        options.setdefault("checkpoint_interval", self.conf.checkpoint_interval)
        return self._with(ex.explore(self.df, step, key, **options))

    # results
    def to_json(self) -> DataFrame:
        return self.df.select(F.to_json(F.struct("*")).alias("value"))

    def execute(self) -> None:
        self.df.write.format("noop").mode("overwrite").save()

    def foreach_partition(self, fn: Callable[[Iterator], None]) -> None:
        self.df.foreachPartition(fn)

    def local(self) -> Iterator:
        """Rows on the driver, a partition at a time with the next one on its way."""
        return self.df.toLocalIterator(prefetchPartitions=True)
