"""Scalar expressions on ids, labels, maps and typed values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenspark import fixed_values as fixed
from screenspark.functions.text import stripped
from screenspark.names import col


def level_match(required: Column, offered: Column) -> Column:
    """1 where two levels are the same text, ignoring case and outer blanks."""

    def clean(c: Column) -> Column:
        return stripped(F.lower(F.coalesce(c.cast("string"), F.lit(""))))

    return (clean(required) == clean(offered)).cast("int")


def stage(status: Column) -> Column:
    return F.lower(F.coalesce(status, F.lit("")))


def stage_outcome(status: Column, outcomes: Mapping[str, str] = fixed.STAGE_OUTCOMES) -> Column:
    """Outcome of a process stage; case is ignored, outer blanks are not."""
    lookup = F.create_map(*[F.lit(x) for pair in outcomes.items() for x in pair])
    return F.coalesce(F.element_at(lookup, stage(status)), F.lit(fixed.OUTCOME_UNKNOWN))


def screening_target(outcome: Column) -> Column:
    return outcome.isin(*fixed.ADVANCED_OUTCOMES).cast("int")


def hiring_target(outcome: Column) -> Column:
    return (outcome == "contratado").cast("int")


def normalized_id(value: Column) -> Column:
    """Id as text without the ``.0`` a float round trip leaves; none-like ids are empty.

    Spark writes large doubles as ``1.1225E7``; those become whole numbers again.
    """
    text = stripped(F.coalesce(value.cast("string"), F.lit("")))
    missing = F.lower(text).isin("nan", "none")
    whole = text.try_cast("decimal(38,0)").cast("string")
    return (
        F.when(missing, F.lit(""))
        .when(text.rlike("\\A\\d\\.\\d+E\\d+\\z"), whole)
        .otherwise(F.regexp_replace(text, "\\.0\\z", ""))
    )


def threshold_label(probability: Column, threshold: float = fixed.THRESHOLD) -> Column:
    return (probability >= F.lit(float(threshold))).cast("int")


def as_text(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def merged_maps(base: Column, override: Column) -> Column:
    """Entries of both maps; on shared keys ``override`` wins, even with a null value.

    A null map counts as empty.
    """
    none = F.create_map().cast("map<string,string>")
    first, second = F.coalesce(base, none), F.coalesce(override, none)
    kept = F.map_filter(first, lambda k, _: ~F.map_contains_key(second, k))
    return F.map_concat(kept, second)


# What reads as a number: sign, digits with or without a point, exponent, outer blanks.
READABLE_NUMBER = r"\A\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*\z"


def read_number(text: Column) -> Column:
    """Text as a double; null where it is not a plain number (``10d`` and ``nan`` are none)."""
    return F.when(text.rlike(READABLE_NUMBER), F.trim(text).try_cast("double"))


def known_number(value: Column) -> Column:
    """A number as double with NaN as null: both mean that it is missing."""
    return F.nanvl(value.cast("double"), F.lit(None).cast("double"))


def input_signature(features: Column) -> Column:
    """16 hex digits of SHA-256 over the key-sorted JSON text of a string map."""

    def text(value: Column) -> Column:
        out = value
        for raw, escaped in [("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")]:
            out = F.replace(out, F.lit(raw), F.lit(escaped))
        return F.coalesce(F.concat(F.lit('"'), out, F.lit('"')), F.lit("null"))

    entries = F.array_sort(F.map_entries(features))
    items = F.transform(entries, lambda e: F.concat(text(e["key"]), F.lit(": "), text(e["value"])))
    document = F.concat(F.lit("{"), F.array_join(items, ", "), F.lit("}"))
    return F.substring(F.sha2(document.cast("binary"), 256), 1, 16)


def coerced(
    df: DataFrame,
    numbers: Sequence[str] = (),
    categories: Sequence[str] = (),
    texts: Sequence[str] = (),
) -> DataFrame:
    """Declared numbers become doubles (null where unreadable), declared categories
    and texts become strings without nulls; absent columns are ignored."""
    declared = set(categories) | set(texts)
    kinds = dict(df.dtypes)

    def typed(name: str) -> Column:
        if name in numbers:
            return read_number(col(name)) if kinds[name] == "string" else known_number(col(name))
        return as_text(col(name)) if name in declared else col(name)

    return df.select(*[typed(c).alias(c) for c in df.columns])


# Fixed value: the prefix of job profile fields.
JOB_PROFILE = "perfil_vaga."
# A whole or decimal number with an optional minus sign, nothing around it.
NUMBER_PATTERN = "\\A-?\\d+(\\.\\d+)?\\z"


def coerced_by_content(df: DataFrame, categories: Sequence[str] = (), texts: Sequence[str] = ()) -> DataFrame:
    """Without declared numbers, a string column whose non-null values all read as
    numbers becomes double; everything else becomes a string without nulls.

    One aggregate over the whole table decides, so the outcome does not depend
    on row order; its single row is the only thing read back.
    """
    declared = set(categories) | set(texts)
    strings = [c for c, t in df.dtypes if t == "string" and c not in declared]
    numeric = set()
    if strings:
        checks = [F.bool_and(col(c).rlike(NUMBER_PATTERN)).alias(f"c{i}") for i, c in enumerate(strings)]
        found = df.agg(*checks).first()
        numeric = {c for c, ok in zip(strings, found, strict=True) if ok}
    kinds = dict(df.dtypes)

    def typed(name: str) -> Column:
        if name in numeric:
            return col(name).cast("double")
        is_text = name in declared or kinds[name] == "string"
        return as_text(col(name)) if is_text else col(name)

    return df.select(*[typed(c).alias(c) for c in df.columns])


def filled(df: DataFrame, texts: Sequence[str] = ()) -> DataFrame:
    """Last guard before a model: null text becomes empty, any other null 0."""
    kinds = dict(df.dtypes)

    def guard(name: str) -> Column:
        empty = F.lit("") if name in texts else F.lit(0)
        return F.coalesce(col(name), empty.cast(kinds[name]))

    simple = ("string", "double", "float", "int", "bigint", "smallint", "tinyint", "boolean")
    return df.select(*[guard(c).alias(c) if kinds[c] in simple else col(c) for c in df.columns])


def compact_json(df: DataFrame, names: Sequence[str]) -> Column:
    """JSON object of the named columns: nulls left out, numbers as doubles, rest as text.

    Fields of the job profile are always text, also where a reader found numbers.
    """
    kinds = {c: "string" if c.startswith(JOB_PROFILE) else k for c, k in df.dtypes}
    number = ("double", "float", "int", "bigint", "smallint", "tinyint")
    return F.to_json(
        F.struct(
            *[
                (col(n).cast("double") if kinds[n] in number or kinds[n].startswith("decimal")
                 else col(n).cast("string")).alias(n)
                for n in names
            ]
        )
    )
