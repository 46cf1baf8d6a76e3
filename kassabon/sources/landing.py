"""Recorded pages of stores, as a data source.

A recorder writes what a store answered under ``<store>/<kind>/<leaf>/<any name>``: one answer a line,
``{"page": n, "body": ...}``, pages ascending within a file, with ``"key"`` where a single product was
asked for; a leaf that has many pages may have several files. Folders may be named ``store=ah`` as Spark's own writers do (``record``). Format ``recorded_pages`` reads them with one partition a file, so leaves, and ranges of
pages of a large leaf, are read side by side. Stores, kinds and leaves are chosen before any file is
opened; a bound of the page, the store's own bound and its stop at an empty page end a file early.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any
from urllib.parse import unquote

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from kassabon.workers import sent_whole

sent_whole(__name__)

COLUMNS = {"store": "string", "kind": "string", "leaf": "string", "page": "long", "key": "string", "body": "string"}


@dataclass(frozen=True)
class Rule:
    """How a store lists products: first page, distance of pages, where an answer holds the number of pages (or of products) and the products, and what ends a leaf."""

    total: str | None
    products: str
    first: int = 0
    step: int = 1
    none_said: int = 1
    most: int | None = None
    stops_empty: bool = False


# How stores answer.
RULES = {
    "ah": Rule("page.totalPages", "products", most=30),
    "jumbo": Rule("data.searchProducts.count", "data.searchProducts.products", step=24, none_said=0),
    "dirk": Rule(None, "data.listWebGroupProducts.productAssortment"),
    "plus": Rule("data.TotalPages", "data.ProductList.List", first=1, stops_empty=True),
    "aldi": Rule("nbPages", "hits"),
}


def inside(value: Any, path: str) -> Any:
    for part in path.split("."):
        value = value.get(part) if isinstance(value, dict) else None
    return value


@dataclass
class File(InputPartition):
    path: str
    store: str
    kind: str
    leaf: str
    before: int | None


class Reader(DataSourceReader):
    """Takes its choice of files from options. Filters aren't pushed: two scans of one loaded table would share those of the last one."""

    def __init__(self, options: dict[str, str], columns: list[str]):
        self.root = options["path"]
        self.columns = columns
        self.wanted = {name: set(json.loads(options[name])) for name in ("store", "kind", "leaf") if name in options}
        self.before = int(options["before"]) if "before" in options else None

    def system(self) -> tuple[fs.FileSystem, str]:
        if "://" in self.root or self.root.startswith("file:"):
            return fs.FileSystem.from_uri(self.root)
        return fs.LocalFileSystem(), self.root

    def partitions(self) -> list[File]:
        system, root = self.system()
        root = root.rstrip("/")
        out = []
        for info in system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
            parts = info.path[len(root) :].strip("/").split("/")
            if info.type != fs.FileType.File or len(parts) != 4 or parts[3][0] in "._":
                continue
            said = {name: unquote(part.removeprefix(f"{name}=")) for name, part in zip(("store", "kind", "leaf"), parts, strict=False)}
            if all(said[k] in v for k, v in self.wanted.items()):
                out.append(File(info.path, **said, before=self.before))
        return sorted(out, key=lambda f: f.path)

    def read(self, partition: File | None) -> Iterator[tuple]:
        if partition is None:  # there are no files
            return
        system, _ = self.system()
        rule = RULES.get(partition.store) if partition.kind == "listing" else None
        with system.open_input_stream(partition.path) as raw:
            for line in lines(raw):
                said = json.loads(line)
                page, body = int(said.get("page") or 0), said.get("body")
                if partition.before is not None and page >= partition.before or rule and rule.most is not None and page >= rule.most:
                    return
                if rule and rule.stops_empty and not inside(body, rule.products):
                    return
                row = {"store": partition.store, "kind": partition.kind, "leaf": partition.leaf, "page": page, "key": None if said.get("key") is None else str(said["key"])}
                if "body" in self.columns:
                    row["body"] = body if isinstance(body, str) else None if body is None else json.dumps(body, ensure_ascii=False, separators=(",", ":"))
                yield tuple(row[c] for c in self.columns)


def lines(raw: Any, size: int = 1 << 20) -> Iterator[bytes]:
    """Lines of a stream that aren't blank, whatever their length."""
    rest = b""
    while block := raw.read(size):
        *whole, rest = (rest + block).split(b"\n")
        yield from (line for line in whole if line.strip())
    if rest.strip():
        yield rest


class RecordedPages(DataSource):
    """Options: path; store, kind and leaf, JSON lists of those to read; before, the first page not to read; columns, a comma-separated part of COLUMNS, of which only those are made."""

    @classmethod
    def name(cls) -> str:
        return "recorded_pages"

    def columns(self) -> list[str]:
        chosen = [c.strip() for c in self.options.get("columns", "").split(",") if c.strip()]
        return chosen or list(COLUMNS)

    def schema(self) -> str:
        return ", ".join(f"{c} {COLUMNS[c]}" for c in self.columns())

    def reader(self, schema: Any) -> Reader:
        return Reader(dict(self.options), self.columns())


def read_recorded(spark: SparkSession, path: str, *columns: str, store: str | None = None, kind: str | None = None, leaves: list[str] | None = None, before: int | None = None) -> DataFrame:
    """Pages of a landing folder, or those of a store, kind or leaves, up to a page: (store, kind, leaf, page, key, body), or ``columns`` of these."""
    spark.dataSource.register(RecordedPages)
    reader = spark.read.format("recorded_pages").option("path", path)
    for name, value in (("store", store and [store]), ("kind", kind and [kind]), ("leaf", leaves)):
        reader = reader if value is None else reader.option(name, json.dumps(value))
    reader = reader if before is None else reader.option("before", before)
    return (reader.option("columns", ",".join(columns)) if columns else reader).load()


def record(pages: DataFrame, path: str, pages_per_file: int = 1000) -> None:
    """Write pages (store, kind, leaf, page, key, body as JSON text) as a landing folder: a file for each leaf and range of its pages."""
    keys = ["store", "kind", "leaf"]
    rows = pages.repartition(*keys, F.floor(F.col("page") / pages_per_file)).sortWithinPartitions(*keys, "page")
    line = F.concat(F.lit('{"page":'), F.col("page").cast("string"), F.coalesce(F.concat(F.lit(',"key":'), F.to_json(F.array("key")).substr(F.lit(2), F.length(F.to_json(F.array("key"))) - 2)), F.lit("")), F.lit(',"body":'), F.coalesce("body", F.lit("null")), F.lit("}"))
    rows.select(*keys, line.alias("value")).write.option("maxRecordsPerFile", pages_per_file).partitionBy(*keys).text(path)
