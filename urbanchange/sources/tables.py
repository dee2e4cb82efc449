"""CSV tables with explicit schemas, cleaned headers and an encoding fallback."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_BOM = "﻿ï»¿"  # byte-order mark, also as it looks when read as latin-1


def clean_header(name: str) -> str:
    return name.strip().lstrip(_BOM).strip().lower()


def read_csv(
    spark: SparkSession,
    path: str,
    types: dict[str, str] | None = None,
    *,
    lower: bool = True,
    encoding: str | None = None,
) -> DataFrame:
    """Read a headed CSV; ``types`` maps cleaned column names to Spark types.

    Without ``encoding`` the file is read as UTF-8 when every line is valid UTF-8, and as
    latin-1 otherwise.
    """
    def reader(enc: str):
        return spark.read.option("header", True).option("encoding", enc)

    if encoding is None:
        text = spark.read.text(path)
        valid = text.where(~F.is_valid_utf8("value")).isEmpty()
        encoding = "UTF-8" if valid else "ISO-8859-1"
    raw = reader(encoding).csv(path)
    if not lower:
        raw = raw.toDF(*[c.strip().lstrip(_BOM) for c in raw.columns])
    else:
        raw = raw.toDF(*[clean_header(c) for c in raw.columns])
    missing = set(types or {}) - set(raw.columns)
    if missing:
        raise ValueError(f"{path} lacks the columns {sorted(missing)}")
    return raw.select(
        *[
            F.col(f"`{c}`").cast((types or {})[c]).alias(c) if c in (types or {}) else F.col(f"`{c}`")
            for c in raw.columns
        ]
    )


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write a headed CSV directory, one file per partition."""
    df.write.option("header", True).mode(mode).csv(path)


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise KeyError(f"missing columns {missing}")
    return df

