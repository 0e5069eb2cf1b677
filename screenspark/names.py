"""Column-name helpers: flattened records carry dots and spaces in their names."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quoted(name: str) -> str:
    """Back-tick a column name so that dots are not read as struct access."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quoted(name))


def cols(names: Iterable[str]) -> list[Column]:
    return [col(n) for n in names]


def ml_name(name: str) -> str:
    """Spark ML cannot address names with dots; give it a plain spelling."""
    return name.replace(".", "__").replace(" ", "_")


def with_ml_names(df: DataFrame) -> DataFrame:
    return df.select(*[col(c).alias(ml_name(c)) for c in df.columns])


def free_name(df: DataFrame, wish: str) -> str:
    """A helper-column name that does not collide with the table's own."""
    name = wish
    while name in df.columns:
        name = "_" + name
    return name


def hashable(df: DataFrame) -> list[str]:
    """Columns a row hash can read; maps have no defined order."""
    return [c for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind]
