"""Files and directories as documents, delimited text, and sinks."""

from __future__ import annotations

import importlib.resources
import uuid

from pyarrow import fs as pa_fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import DumpFailed, ReadFailed, WriteFailed
from ..functions.nodes import canonize_file_name, detect_mime


def files(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """(uri, ts, length, content, mime) of the files under a path."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(path)
    return raw.select(F.col("path").alias("uri"), F.col("modificationTime").alias("ts"), "length", "content", detect_mime(F.col("content"), name=F.col("path")).alias("mime"))


def listing(spark: SparkSession, path: str) -> DataFrame:
    """Directory documents: (dir, entries), the entries as structs of name, uri, length and time; contents are not read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "modificationTime", "length")
    parts = raw.select(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("dir"), F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), F.col("path").alias("uri"), "length", F.col("modificationTime").alias("ts"))
    return parts.groupBy("dir").agg(F.sort_array(F.collect_list(F.struct("name", "uri", "length", "ts"))).alias("entries"))


def delimited_to_map(line: Column, header: str, sep: str = ",") -> Column:
    """A line as a map of the header's names; missing fields are null."""
    names = [h.strip() for h in header.split(sep)]
    pattern = "\\" + sep if sep in "|.^$*+?()[]{}\\" else sep
    cells = F.split(line, pattern, -1)
    return F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[F.try_element_at(cells, F.lit(i + 1)) for i in range(len(names))]))


def tsv_to_map(line: Column, header: str) -> Column:
    return delimited_to_map(line, header, "\t")


MODES = {"append": "append", "error": "errorifexists", "overwrite": "overwrite", "ignore": "ignore"}


def save(df: DataFrame, path: str, mode: str = "error", fmt: str = "parquet") -> None:
    """``read_only`` writes nothing and is an error if there is nothing to read."""
    if mode == "read_only":
        df.sparkSession.read.format(fmt).load(path)
        return
    df.write.format(fmt).mode(MODES[mode]).save(path)


def with_saved_path(docs: DataFrame, folder: str, name: Column, ext: str = "html") -> DataFrame:
    """docs with the path each is saved under, a function of its name and content."""
    return docs.withColumn("saved", F.concat(F.lit(folder.rstrip("/") + "/"), canonize_file_name(name), F.lit("-"), F.substring(F.sha2("content", 256), 1, 12), F.lit(f".{ext}")))


def write_bytes(path: str, data: bytes) -> None:
    """Through the file system of the path's scheme (``hdfs``, ``s3``, ``gs``, ``file`` or none); readers see all of it or nothing."""
    fs, place = pa_fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pa_fs.LocalFileSystem(), path)
    part = f"{place}.{uuid.uuid4().hex}.part"
    fs.create_dir(place.rpartition("/")[0], recursive=True)
    try:
        with fs.open_output_stream(part) as out:
            out.write(data)
        fs.move(part, place)
    except OSError as e:
        raise WriteFailed(f"{path}: {e}") from e


def read_bytes(path: str) -> bytes:
    try:
        fs, place = pa_fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pa_fs.LocalFileSystem(), path)
        with fs.open_input_stream(place) as f:
            return f.read()
    except OSError as e:
        raise ReadFailed(f"{path}: {e}") from e


def save_contents(docs: DataFrame) -> None:
    """Writes each document's content to its saved path, where the executors are. A task that runs again writes the same files."""

    def write(rows) -> None:  # noqa: ANN001
        for r in rows:
            write_bytes(r.saved, r.content if isinstance(r.content, (bytes, bytearray)) else (r.content or "").encode())

    docs.select("saved", "content").foreachPartition(write)


def package_file(address: str) -> bytes:
    """A file that lies in a Python package, ``resource:package/path``."""
    package, _, path = address.removeprefix("resource:").partition("/")
    try:
        return importlib.resources.files(package).joinpath(path).read_bytes()
    except (OSError, ModuleNotFoundError) as e:
        raise ReadFailed(f"{address}: {e}") from e


def audit(docs: DataFrame, path: str, normalised: Column | None = None, kind: str = "both") -> None:
    """Keeps originals, normalised contents, or both beside each other."""
    if kind == "disabled":
        return
    cols = [] if kind == "normalised" else [F.col("content").alias("original")]
    if normalised is not None and kind in ("normalised", "both"):
        cols.append(normalised.alias("normalised"))
    docs.select("uri", *cols).write.mode("append").parquet(path)


def dump_errors(docs: DataFrame, path: str, fallback: str | None = None) -> DataFrame:
    """Writes error rows to a table of their own (to ``fallback`` if that fails) and returns the others."""
    _dump(docs.filter("kind = 'error'"), path, fallback)
    return docs.filter("kind <> 'error'")


def _dump(rows: DataFrame, path: str, fallback: str | None) -> None:
    try:
        rows.write.mode("append").parquet(path)
    except Exception as e:
        if fallback is None:
            raise DumpFailed(f"{path}: {e}") from e
        _dump(rows, fallback, None)
