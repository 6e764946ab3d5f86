"""Arrays, maps and documents as structures: products, interleaving, typed filters, and JSON and XML forms of a row."""

from __future__ import annotations

from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from ..plans.explore import cut


def array_product(*arrays: Column) -> Column:
    """ARRAY<ARRAY<STRING>>: every choice of one element of each array, the first array varying slowest."""

    def extended(have: Column, more: Column) -> Column:
        return F.transform(more, lambda x: F.concat(have, F.array(x.cast("string"))))

    def times(out: Column, more: Column) -> Column:
        return F.flatten(F.transform(out, lambda have: extended(have, more)))

    return reduce(times, arrays[1:], F.transform(arrays[0], lambda x: F.array(x.cast("string"))))


def interleave(*arrays: Column) -> Column:
    """Elements in turn; arrays of different sizes are an error."""
    sizes = F.array(*[F.size(a) for a in arrays])
    turned = F.flatten(F.transform(F.arrays_zip(*[a.alias(f"a{i}") for i, a in enumerate(arrays)]), lambda s: F.array(*[s[f"a{i}"] for i in range(len(arrays))])))
    return F.when(F.array_size(F.array_distinct(sizes)) == 1, turned).otherwise(F.raise_error(F.lit("arrays of different sizes")))


def keep_typed(texts: Column, kind: str) -> Column:
    """Those elements of an array of text that are of a type, as that type."""
    return F.array_compact(F.transform(texts, lambda x: x.try_cast(kind)))


def canonical_keys(attributes: Column) -> Column:
    """Map keys with all but letters, digits and underscores replaced; of equal ones the last wins."""
    entries = F.transform(F.map_entries(attributes), lambda e: F.struct(F.regexp_replace(e["key"], r"[^A-Za-z0-9_]", "_").alias("key"), e["value"].alias("value")))
    return F.aggregate(entries, F.create_map().cast("map<string,string>"), lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != e["key"]), F.create_map(e["key"], e["value"])))


def ordered_groups(df: DataFrame, by: str, value: str, place: str) -> DataFrame:
    """(key, values, first): groups of bounded size with their values in input order, and where each group first occurs."""
    pairs = F.sort_array(F.collect_list(F.struct(place, value)))
    return df.groupBy(by).agg(F.transform(pairs, lambda p: p[value]).alias("values"), F.min(place).alias("first"))


def to_json_text(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias("value"))


def from_json_text(df: DataFrame, schema: StructType | str, column: str = "value") -> DataFrame:
    return df.select(F.from_json(column, schema).alias("v")).select("v.*")


def to_xml_text(df: DataFrame, tag: str = "row") -> DataFrame:
    return df.select(F.to_xml(F.struct("*"), {"rowTag": tag}).alias("value"))


def from_xml_text(df: DataFrame, schema: StructType | str, column: str = "value", tag: str = "row") -> DataFrame:
    """Lenient: one element where the schema has an array is an array of one, and text is cast to the schema's types."""
    return df.select(F.from_xml(column, schema, {"rowTag": tag}).alias("v")).select("v.*")


def same_type(a: DataType, b: DataType) -> bool:
    """Equal but for nullability."""
    if isinstance(a, StructType) and isinstance(b, StructType):
        return len(a.fields) == len(b.fields) and all(x.name == y.name and same_type(x.dataType, y.dataType) for x, y in zip(a.fields, b.fields))
    if isinstance(a, ArrayType) and isinstance(b, ArrayType):
        return same_type(a.elementType, b.elementType)
    return a.simpleString() == b.simpleString()


def several_passes(df: DataFrame, passes: list[Column], name: str = "value") -> DataFrame:
    """The first pass that gives a result, for each row; later passes are evaluated only where earlier ones gave none."""
    return df.withColumn(name, F.coalesce(*passes))


def numbered(df: DataFrame, name: str = "place") -> DataFrame:
    """Rows of an ordered table with their place (from 0): sizes of the partitions are summed first, so no task sees all rows."""
    marked = cut(df.withColumn("_id", F.monotonically_increasing_id()))  # the partitions counted are those numbered
    marked = marked.withColumn("_part", F.shiftrightunsigned("_id", 33)).withColumn("_in", F.col("_id").bitwiseAND((1 << 33) - 1))
    sizes = sorted((r["_part"], r["n"]) for r in marked.groupBy("_part").agg(F.count("*").alias("n")).collect())
    first = dict(zip([p for p, _ in sizes], accumulate([n for _, n in sizes], initial=0)))
    if not first:
        return df.withColumn(name, F.lit(0).cast("long"))
    begin = F.create_map(*[F.lit(x) for p, n in first.items() for x in (p, n)])
    return marked.withColumn(name, (begin[F.col("_part")] + F.col("_in")).cast("long")).drop("_id", "_part", "_in")
