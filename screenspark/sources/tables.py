"""Table files in and out."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from screenspark import fixed_values as fixed
from screenspark.names import cols, quoted
from screenspark.session import written
from screenspark.sources import ranges
from screenspark.sources.keyed_json import struct_of_variant


CSV_OPTIONS = {"escape": '"', "multiLine": "true"}


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, split_bytes: int | None = None
) -> DataFrame:
    """CSV with header; texts may hold line breaks and doubled quotes.

    Give a schema for large inputs: finding one takes a pass of its own, in which a
    file is one task. With a schema, files longer than ``split_bytes`` (unless given,
    the size by which Spark splits files) are read in byte ranges.
    """
    reader = spark.read.option("header", True).options(**CSV_OPTIONS)
    if schema is None:
        return reader.option("inferSchema", True).csv(path)
    size = ranges.split_size(spark, split_bytes)
    if ranges.longest_file(spark, path) <= size:
        return reader.schema(schema).csv(path)

    def records(file, row):
        found = ranges.csv_records(file, *(row[c] for c in ("start", "end", "length", "quoted")))
        if row["start"] == 0:
            next(found, None)  # the header
        return (r for r in found if r.strip())

    kind = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    lines = ranges.read_records(ranges.range_states(ranges.file_ranges(spark, path, size), json=False), records)
    parsed = lines.select(F.from_csv("value", kind.toDDL(), CSV_OPTIONS).alias("row"))
    return parsed.select(*[F.col(f"row.{quoted(n)}") for n in kind.names])


def read_table(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, split_bytes: int | None = None
) -> DataFrame:
    """Parquet for ``.parquet`` and ``.pq``, CSV for anything else; only CSV needs ``split_bytes``."""
    if path.lower().endswith((".parquet", ".pq")):
        return spark.read.schema(schema).parquet(path) if schema else spark.read.parquet(path)
    return read_csv(spark, path, schema, split_bytes)


def _as_doubles(kind: T.DataType) -> T.DataType:
    """Decimals as doubles, as Spark's own reader takes fractions."""
    if isinstance(kind, T.DecimalType):
        return T.DoubleType()
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_as_doubles(kind.elementType))
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _as_doubles(f.dataType)) for f in kind.fields])
    return kind


def read_json_table(spark: SparkSession, path: str, lines: bool = False, split_bytes: int | None = None) -> DataFrame:
    """JSON rows: a whole document (object or list) per file, or one object per line.

    Where a file is longer than ``split_bytes`` (unless given, the size by which Spark
    splits files) all files are read in byte ranges: the values of a list are rows
    that any task may read, while an outermost object stays one row.
    """
    size = ranges.split_size(spark, split_bytes)
    if lines or ranges.longest_file(spark, path) <= size:
        return spark.read.option("multiLine", not lines).json(path)

    def entries(file, row):
        whole = ranges.first_byte(file) == b"{"
        return ranges.json_records(file, *(row[c] for c in ("start", "end", "length", "quoted", "depth")), whole)

    texts = written(ranges.read_records(ranges.range_states(ranges.file_ranges(spark, path, size), json=True), entries))
    found = texts.agg(F.schema_of_variant_agg(F.parse_json("value"))).first()[0]
    kind = _as_doubles(struct_of_variant(found))
    parsed = texts.select(F.from_json("value", kind, {"mode": "FAILFAST"}).alias("row"))
    return parsed.select(*[F.col(f"row.{quoted(n)}") for n in sorted(kind.names)])


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with header that ``read_csv`` reads back, line breaks, quotes and outer blanks included."""
    blanks = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.write.mode("overwrite").options(header=True, escape='"', **blanks).csv(path)


def write_bucketed(df: DataFrame, name: str, key: str, buckets: int, path: str) -> DataFrame:
    """``df`` as a table of the session's catalog in ``buckets`` files by ``key``, each sorted by it.

    Two tables with the same number of buckets join on that key without a shuffle of
    either, as often as they are joined. A key that holds a large share of the rows
    makes its bucket as large: ``joins.skew_join`` is for those.
    """
    dealt = df.repartition(buckets, *cols([key])).write.mode("overwrite").option("path", path)
    dealt.bucketBy(buckets, key).sortBy(key).saveAsTable(name)
    return df.sparkSession.table(name)


def json_rows(df: DataFrame, out: str = "value", keep_nulls: bool = False) -> DataFrame:
    """Each row as one JSON document."""
    options = {"ignoreNullFields": "false" if keep_nulls else "true"}
    return df.select(F.to_json(F.struct(*cols(df.columns)), options).alias(out))


def write_json(df: DataFrame, path: str, keep_nulls: bool = False) -> None:
    json_rows(df, keep_nulls=keep_nulls).write.mode("overwrite").text(path)


def load_feature_map(spark: SparkSession, path: str, strict: bool = True) -> dict[str, Any]:
    """Roles to column names, from a JSON file of a few kilobytes.

    A missing file is an error, or an empty map when not strict; broken JSON is
    always an error.
    """
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(jvm_path):
        if strict:
            raise FileNotFoundError(path)
        return {}
    text = spark.read.text(path, wholetext=True).first()["value"]
    try:
        return json.loads(text)
    except json.JSONDecodeError as error:
        raise RuntimeError(f"feature map {path} is not valid JSON: {error}") from error


def missing_roles(feature_map: dict[str, Any]) -> list[str]:
    return [r for r in fixed.EXPECTED_ROLES if r not in feature_map]
