"""JSON nodes, document detection and validation, safe casts, names and paths, and small text functions, as Columns."""

from __future__ import annotations

import json
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _json_search(value: object, name: str, deep: bool) -> list[object]:
    """Values of the field, arrays flattened and nulls dropped, in document order."""
    out: list[object] = []

    def take(x: object) -> None:
        if isinstance(x, list):
            for y in x:
                take(y)
        elif x is not None:
            out.append(x)

    def go(x: object, level: int) -> None:
        if isinstance(x, dict):
            if name in x:
                take(x[name])
            if deep:
                for y in x.values():
                    go(y, level + 1)
        elif isinstance(x, list):
            for y in x:
                go(y, level)

    go(value, 0)
    return out


def json_find_all(doc: Column, name: str, deep: bool = True) -> Column:
    """ARRAY<STRING> of all fields of that name at any depth (``deep``) or at the top; objects come as JSON text."""

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        out = []
        for text in s:
            try:
                got = _json_search(json.loads(text), name, deep) if text is not None else []
            except ValueError:
                got = []
            out.append([x if isinstance(x, str) else json.dumps(x, ensure_ascii=False) for x in got])
        return pd.Series(out)

    return run(doc)


def json_path(doc: Column, path: str) -> Column:
    """One scalar at a path; stays in the JVM."""
    return F.try_variant_get(F.try_parse_json(doc), path, "string")


_MAGIC = [(b"%PDF", "application/pdf"), (b"\x89PNG", "image/png"), (b"\xff\xd8\xff", "image/jpeg"), (b"GIF8", "image/gif"), (b"PK\x03\x04", "application/zip")]


def detect_mime(content: Column, declared: Column | None = None, name: Column | None = None) -> Column:
    """Declared type first, then the leading bytes, then the name's extension."""
    head = F.substring(content, 1, 512)
    text = F.lower(F.ltrim(head.cast("string")))
    known = F.lit(None).cast("string")
    for magic, mime in _MAGIC:
        known = F.coalesce(known, F.when(F.substring(content, 1, len(magic)) == F.lit(magic), mime))
    ext = F.lower(F.regexp_extract(name if name is not None else F.lit(""), r"\.(\w+)$", 1))
    by_ext = F.create_map(*[F.lit(x) for kv in {"html": "text/html", "htm": "text/html", "xml": "application/xml", "json": "application/json", "csv": "text/csv", "txt": "text/plain"}.items() for x in kv])
    by_text = (
        F.when(text.rlike(r"^(<!doctype html|<html)"), "text/html").when(text.rlike(r"^<\?xml"), "application/xml").when(text.rlike(r"^[{\[]"), "application/json")
    )
    return F.coalesce(declared if declared is not None else F.lit(None), known, by_text, F.try_element_at(by_ext, ext), F.lit("text/plain"))


def detect_charset(content: Column, mime: Column) -> Column:
    """Byte order marks, then valid UTF-8, then the default of the type."""
    return (
        F.when(F.substring(content, 1, 3) == F.lit(b"\xef\xbb\xbf"), "UTF-8")
        .when(F.substring(content, 1, 2) == F.lit(b"\xff\xfe"), "UTF-16LE")
        .when(F.substring(content, 1, 2) == F.lit(b"\xfe\xff"), "UTF-16BE")
        .when(F.is_valid_utf8(content.cast("string")), "UTF-8")
        .when(mime.startswith("text/"), "ISO-8859-1")
        .otherwise("UTF-8")
    )


def accept(kind: str, status: Column | None = None, html: Column | None = None) -> Column:
    """NULL for an acceptable document, else why not: ``bypass``, ``status2xx``, ``has_title`` or ``has_head``."""
    if kind == "bypass":
        return F.lit(None).cast("string")
    if kind == "status2xx":
        return F.when(~F.coalesce(status.between(200, 299), F.lit(False)), F.concat(F.lit("status "), F.coalesce(status.cast("string"), F.lit("missing"))))
    tag = {"has_title": "title", "has_head": "head"}[kind]
    return F.when(~F.coalesce(html.rlike(rf"(?is)<{tag}\b[^>]*>\s*\S"), F.lit(False)), F.lit(f"no {tag}"))


def text_or_null(value: Column) -> Column:
    """Blank and non-breaking text counts as missing."""
    return F.when(F.trim(F.regexp_replace(value, " ", " ")) != "", value)


def canonize_file_name(name: Column) -> Column:
    """At most 255 characters; what a file system may reject becomes an underscore."""
    return F.substring(F.regexp_replace(name, r"[^\w.\-~]", "_"), 1, 255)


def canonize_urn(name: Column) -> Column:
    """The same with separators of parts as slashes."""
    parts = F.split(F.regexp_replace(name, r"[/?&=:#]+", "/"), "/")
    return F.array_join(F.filter(F.transform(parts, canonize_file_name), lambda p: p != ""), "/")


def canonize_column_name(name: Column) -> Column:
    return F.regexp_replace(name, r"[^A-Za-z0-9_]", "_")


def long_hash(text: Column) -> Column:
    """The 31-polynomial over the UTF-16 units, from a large prime on, wrapped to 64 bits. NULL for NULL."""

    @F.pandas_udf("long")
    def run(s: pd.Series) -> pd.Series:
        raw = [("" if t is None else t).encode("utf-16-le", "surrogatepass") for t in s]
        size = np.array([len(r) // 2 for r in raw], dtype=np.int64)
        units = np.frombuffer(b"".join(raw), dtype="<u2").astype(np.uint64)
        power = np.ones(int(size.max(initial=0)) + 1, dtype=np.uint64)
        power[1:] = np.multiply.accumulate(np.full(len(power) - 1, 31, dtype=np.uint64))
        ends = np.cumsum(size)
        sums = np.zeros(len(units) + 1, dtype=np.uint64)
        np.cumsum(units * power[np.repeat(ends, size) - 1 - np.arange(len(units))], out=sums[1:])
        out = np.uint64(1125899906842597) * power[size] + sums[ends] - sums[ends - size]
        return pd.Series(out.view(np.int64), dtype="Int64").mask(s.isna().to_numpy())

    return run(text)


def try_boolean(text: Column) -> Column:
    """true/yes/1/empty and false/no/0/-1, in any case; NULL for all else."""
    low = F.lower(F.trim(text))
    return F.when(low.isin("true", "yes", "y", "1", ""), True).when(low.isin("false", "no", "n", "0", "-1"), False)


def lifted(applies: Column, value: Column) -> Column:
    """A partial function: NULL where it does not apply."""
    return F.when(applies, value)


def json_children(doc: Column, name: str) -> Column:
    """Fields of that name at the top alone."""
    return json_find_all(doc, name, deep=False)


def json_attribute(doc: Column, name: str) -> Column:
    """The attribute ``@name`` of an object, NULL if it is blank."""
    return text_or_null(F.try_element_at(json_find_all(doc, "@" + name, deep=False), F.lit(1)))


def as_array(value: Column, is_array: bool) -> Column:
    return value if is_array else F.when(value.isNull(), F.array().cast("array<string>")).otherwise(F.array(value.cast("string")))


def lookup(attributes: Column, name: str, *aliases: str, default: str | None = None, ignore_case: bool = True) -> Column:
    """A schemaless attribute by name or alias."""
    found = F.transform_keys(attributes, lambda k, _: F.lower(k)) if ignore_case else attributes
    keys = [n.lower() if ignore_case else n for n in (name, *aliases)]
    return F.coalesce(*[F.try_element_at(found, F.lit(k)) for k in keys], F.lit(default).cast("string"))


def merge_attributes(left: Column, right: Column, policy: str = "right") -> Column:
    """Maps merged: ``right`` or ``left`` wins, or ``equal`` values are required."""
    both = lambda k, a, b: F.coalesce(b, a) if policy == "right" else F.coalesce(a, b)
    if policy == "equal":
        both = lambda k, a, b: F.when(a.isNull() | b.isNull() | (a == b), F.coalesce(a, b)).otherwise(F.raise_error(F.concat(F.lit("conflict on "), k)))
    return F.map_zip_with(left, right, both)


def in_range(value: Column, low: int | None = None, high: int | None = None, high_inclusive: bool = False) -> Column:
    ok = F.lit(True)
    if low is not None:
        ok = ok & (value >= low)
    if high is not None:
        ok = ok & (value <= high if high_inclusive else value < high)
    return ok


def fill_template(template: Column, values: Column) -> Column:
    """``${key}`` replaced by the map's value; ``$$`` is a dollar sign; an unknown key stays."""

    @F.pandas_udf("string")
    def run(t: pd.Series, v: pd.Series) -> pd.Series:
        def one(text: str | None, known: object) -> str | None:
            known = dict(known) if known is not None else {}
            return None if text is None else re.sub(r"\$\$|\$\{([^}]*)\}", lambda m: "$" if m.group() == "$$" else str(known.get(m.group(1), m.group())), text)

        return pd.Series([one(a, b) for a, b in zip(t, v)])

    return run(template, values)


def trace_path_flat(parts: Column, most: int = 4) -> Column:
    """``a~b~c~hash``; of more than ``most`` parts the middle ones are left out."""
    n = F.size(parts)
    shown = F.when(n > most, F.concat(F.slice(parts, 1, most - 1), F.array(F.concat(F.lit("..."), (n - most).cast("string"))), F.slice(parts, -1, 1))).otherwise(parts)
    return F.concat_ws("~", F.transform(shown, canonize_file_name), F.substring(F.sha2(F.array_join(parts, "\u0001"), 256), 1, 16))


def trace_path_hierarchical(parts: Column) -> Column:
    return F.concat_ws("/", F.transform(parts, canonize_file_name), F.substring(F.sha2(F.array_join(parts, "\u0001"), 256), 1, 16))


def doc_path(name: Column, ts: Column | None = None, uid: Column | None = None, ext: str = "") -> Column:
    """By time if given, else by the document's id; both are stable."""
    mark = F.date_format(ts, "yyyyMMdd'T'HHmmss.SSS") if ts is not None else uid
    return F.concat(canonize_file_name(name), F.lit("-"), mark, F.lit(f".{ext}" if ext else ""))


def file_extension(mime: Column) -> Column:
    kinds = {"text/html": "html", "application/json": "json", "application/xml": "xml", "text/plain": "txt", "text/csv": "csv", "image/png": "png", "application/pdf": "pdf"}
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv]), mime)


def distinct_name_scopes(names: Column) -> Column:
    """Segment number of each name: a new segment begins where a name would repeat in it."""
    start = F.struct(F.array().cast("array<string>").alias("seen"), F.lit(0).alias("seg"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, name: Column) -> Column:
        again = F.array_contains(acc["seen"], name)
        seg = acc["seg"] + F.when(again, 1).otherwise(0)
        seen = F.when(again, F.array(name)).otherwise(F.array_append(acc["seen"], name))
        return F.struct(seen.alias("seen"), seg.alias("seg"), F.array_append(acc["out"], seg).alias("out"))

    return F.aggregate(names, start, step, lambda acc: acc["out"])
