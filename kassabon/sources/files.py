"""Landed files: JSON lines, CSV exports, JSON documents and pages."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kassabon.functions.text import clean_text


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(value) of each line that isn't blank, trimmed. The text stays as it landed: stores differ too much for one schema."""
    return spark.read.text(path).select(F.trim("value").alias("value")).filter("value <> ''")


def read_csv(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """All columns as text; a byte order mark before the first name goes. Lines may be quoted over several rows."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    df = df.toDF(*[c.lstrip("﻿") for c in df.columns])
    return df if limit is None else df.limit(limit)


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(url, html) of whole page files; the file's name is its address."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("url"), F.col("value").alias("html"))


def plain(name: str) -> str:
    return re.sub("[^a-z0-9]", "", name.lower())


def find_column(df: DataFrame, *names: str) -> Column:
    """The first of several columns, found by plain name, that says something in a row."""
    by = {plain(c): c for c in df.columns}
    found = [clean_text(F.col(f"`{by[plain(n)]}`")) for n in names if plain(n) in by]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def promotion_columns(df: DataFrame) -> tuple[Column, Column]:
    """Maps of the columns that speak of promotions, and of all others, without empty values."""
    spoken = [c for c in df.columns if re.search("bonus|promo|offer|discount", c.lower())]

    def gathered(columns: list[str]) -> Column:
        if not columns:
            return F.lit(None).cast("map<string,string>")
        pairs = F.create_map(*[x for c in columns for x in (F.lit(c), F.col(f"`{c}`").cast("string"))])
        return F.map_filter(pairs, lambda _, v: v.isNotNull() & (v != ""))

    return gathered(spoken), gathered([c for c in df.columns if c not in spoken])
