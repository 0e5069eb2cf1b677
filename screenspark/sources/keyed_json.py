"""Readers for JSON objects whose keys are the record ids."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from screenspark.names import col, quoted
from screenspark.sources import ranges

# Fields of a prospect and the names they get; the source
# spells the stage field with a d.
PROSPECT_FIELDS = {
    "codigo": "codigo_applicant",
    "nome": "nome_candidato",
    "situacao_candidado": "situacao_candidato",
    "data_candidatura": "data_candidatura",
    "ultima_atualizacao": "ultima_atualizacao",
    "comentario": "comentario",
    "recrutador": "recrutador",
}
PROSPECTS_SCHEMA = T.StructType(
    [
        T.StructField("titulo", T.StringType()),
        T.StructField("modalidade", T.StringType()),
        T.StructField(
            "prospects",
            T.ArrayType(T.StructType([T.StructField(f, T.StringType()) for f in PROSPECT_FIELDS])),
        ),
    ]
)


def read_documents(spark: SparkSession, path: str, lines: bool = False, split_bytes: int | None = None) -> DataFrame:
    """Keyed JSON objects in column ``value``: one per file, or one per line.

    Where a file is longer than ``split_bytes`` (unless given, the size by which Spark
    splits files) all files are read in byte ranges, and every record is an object
    ``{key: record}`` of its own. Compressed files are one row each.
    """
    if lines:
        return spark.read.text(path)
    size = ranges.split_size(spark, split_bytes)
    if ranges.longest_file(spark, path) <= size:
        return spark.read.text(path, wholetext=True)

    def entries(file, row):
        if ranges.first_byte(file) != b"{":
            raise ValueError(f"malformed keyed JSON: {row['path']} is no object")
        for entry in ranges.json_records(file, *(row[c] for c in ("start", "end", "length", "quoted", "depth"))):
            yield b"{" + entry + b"}"

    return ranges.read_records(ranges.range_states(ranges.file_ranges(spark, path, size), json=True), entries)


def _one_object(tables):
    first = True
    for table in tables:
        if table.num_rows:
            entries = [v[1:-1] for v in table["value"].to_pylist()]
            yield pa.record_batch({"value": [("{" if first else ",") + entries[0], *("," + e for e in entries[1:])]})
            first = False
    yield pa.record_batch({"value": ["{}" if first else "}"]})


def write_documents(documents: DataFrame, path: str, text: str = "value") -> None:
    """Objects of one or more records as one keyed object per task; keys are not compared."""
    full = documents.select(F.trim(col(text)).alias("value")).filter(~F.col("value").rlike(r"^\{\s*\}$"))
    full.mapInArrow(_one_object, "value string").write.text(path)


def leaves(schema: T.StructType, sep: str = ".", prefix: str = "") -> list[tuple[str, str]]:
    """(flat name, quoted path) of every leaf; lists and maps are leaves."""
    found = []
    for f in schema.fields:
        path = f"{prefix}{sep}{f.name}" if prefix else f.name
        if isinstance(f.dataType, T.StructType):
            found += [
                (name, f"{quoted(f.name)}.{inner}")
                for name, inner in leaves(f.dataType, sep, path)
            ]
        else:
            found.append((path, quoted(f.name)))
    return found


def flatten_structs(df: DataFrame, record: str, keep: list[str], sep: str = ".") -> DataFrame:
    """Project the struct column ``record`` to one flat column per leaf."""
    schema = df.schema[record].dataType
    flat = [F.col(f"{quoted(record)}.{path}").alias(name) for name, path in leaves(schema, sep)]
    return df.select(*[col(k) for k in keep], *flat)


def _records(documents: DataFrame, record: T.StructType, text: str) -> DataFrame:
    kind = T.MapType(T.StringType(), record)
    parsed = F.from_json(col(text), kind, {"mode": "FAILFAST"})
    return documents.select(F.explode(parsed).alias("key", "record"))


def flatten_keyed_json(
    documents: DataFrame, record: T.StructType, id_col: str, text: str = "value", sep: str = "."
) -> DataFrame:
    """One row per record: the key as ``id_col`` and nested fields as flat columns."""
    rows = _records(documents, record, text).withColumnRenamed("key", id_col)
    return flatten_structs(rows, "record", [id_col], sep)


def keyed_json_schema(documents: DataFrame, text: str = "value") -> T.StructType:
    """Record schema found by one pass over the documents."""
    entries = documents.select(F.parse_json(col(text)).alias("doc"))
    each = documents.sparkSession.tvf.variant_explode(F.col("doc").outer())
    found = entries.lateralJoin(each).agg(F.schema_of_variant_agg("value")).first()[0]
    return struct_of_variant(found)


def struct_of_variant(schema: str | None) -> T.StructType:
    """The struct that a variant schema of objects describes."""
    if not schema or schema.upper() in ("VOID", "OBJECT<>"):
        return T.StructType([])
    return T.StructType.fromDDL(_as_ddl(schema)[len("STRUCT<") : -1])


# A quoted field name, or a type word where a type stands.
TYPE_WORD = re.compile(r"`(?:``|[^`])*`|(?:(?<=: )|(?<=ARRAY<)|\A)(?:VOID\b|OBJECT<)")


def _as_ddl(variant_schema: str) -> str:
    """Objects as structs and values that are always null as strings; names stay as they are."""
    words = {"VOID": "STRING", "OBJECT<": "STRUCT<"}
    return TYPE_WORD.sub(lambda m: words.get(m[0], m[0]), variant_schema)


def load_prospects(documents: DataFrame, text: str = "value") -> DataFrame:
    """One row per prospect with its job's key, title and modality.

    Jobs without prospects give no row; fields a prospect lacks are null.
    """
    jobs = _records(documents, PROSPECTS_SCHEMA, text)
    each = jobs.select(
        F.col("key").alias("codigo_vaga"),
        F.col("record.titulo").alias("titulo_vaga"),
        F.col("record.modalidade").alias("modalidade"),
        F.explode("record.prospects").alias("p"),
    )
    return each.select(
        "codigo_vaga",
        "titulo_vaga",
        "modalidade",
        *[F.col(f"p.{field}").alias(name) for field, name in PROSPECT_FIELDS.items()],
    )


def keyed_document(key: Column, record: Column) -> Column:
    """JSON text ``{key: record}``; null fields are kept."""
    return F.to_json(F.create_map(key.cast("string"), record), {"ignoreNullFields": "false"})
