"""Writers and upserts. Tables are Parquet folders; an upsert gives the new state, which is written beside the old one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kassabon.operators.keyed import one_per_key


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object a line, without null fields."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode(mode).text(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep: tuple[str, ...] = (), when: Callable[[Callable[[str], Column]], Column] | None = None, order: list[Column] | None = None) -> DataFrame:
    """The table after each new row has replaced the old one of its key, or was added.

    ``keep`` columns stay as they were where the key exists. ``when`` (from a function that gives
    old columns) says which old rows may be replaced. Several new rows of a key would be
    ambiguous: the first by ``order`` counts, without one the first by a hash of the row, so
    that reruns agree.
    """
    new = one_per_key(new, keys, order or settled(new))
    columns = old.columns
    o = old.select(*[F.col(c).alias(f"old_{c}") for c in columns], F.lit(True).alias("old_row"))
    n = new.select(*[F.col(c).alias(f"new_{c}") for c in columns], F.lit(True).alias("new_row"))
    same = [F.col(f"old_{k}").eqNullSafe(F.col(f"new_{k}")) for k in keys]
    both = o.join(n, same, "full_outer")
    replaceable = when(lambda c: F.col(f"old_{c}")) if when else F.lit(True)
    take = F.col("new_row").isNotNull() & (F.col("old_row").isNull() | F.coalesce(replaceable, F.lit(False)))
    chosen = []
    for c in columns:
        fresh = F.when(F.col("old_row").isNotNull(), F.col(f"old_{c}")).otherwise(F.col(f"new_{c}")) if c in keep else F.col(f"new_{c}")
        chosen.append(F.when(take, fresh).otherwise(F.col(f"old_{c}")).alias(c))
    return both.select(*chosen)


def settled(df: DataFrame) -> list[Column]:
    """An order of rows that doesn't depend on how they are dealt out."""
    return [F.xxhash64(*df.columns)]


def insert_new(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """Rows of ``new`` whose key the table lacks, the first of each key: what an insert that ignores conflicts appends."""
    return one_per_key(new, keys, order or settled(new)).join(old.select(*keys), keys, "left_anti")


def deactivate_missing(table: DataFrame, present: DataFrame, keys: list[str], flag: str = "is_available") -> DataFrame:
    """``flag`` becomes false where the key is not among ``present``; rows stay."""
    here = present.select(*keys).distinct().withColumn("_here", F.lit(True))
    joined = table.join(here, keys, "left")
    return joined.withColumn(flag, F.col(flag) & F.coalesce("_here", F.lit(False))).drop("_here").select(*table.columns)


def changes(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Rows of ``new`` that differ from the old row of their key in one of the columns, nulls compared as values."""
    o = old.select(*keys, *[F.col(c).alias(f"_old_{c}") for c in columns])
    differs = F.lit(False)
    for c in columns:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"_old_{c}"))
    return new.join(o, keys).filter(differs).select(*new.columns)


def remap_keys(tags: DataFrame, remap: DataFrame, key: str = "canonical_key") -> DataFrame:
    """Tags whose key ``remap`` (old_key, new_key, display_name, confidence) renames; confidence never falls."""
    to = one_per_key(remap, ["old_key"], settled(remap)).select(F.col("old_key").alias(key), "new_key", F.col("display_name").alias("_name"), F.coalesce("confidence", F.lit(0.8)).alias("_sure"))
    hit = F.col("new_key").isNotNull() & ~F.col("new_key").eqNullSafe(F.col(key))
    changed = tags.join(to, key, "left").withColumns(
        {
            "display_name": F.when(hit, F.coalesce("_name", "display_name")).otherwise(F.col("display_name")),
            "confidence": F.when(hit, F.greatest(F.coalesce("confidence", F.lit(0.0)), "_sure")).otherwise(F.col("confidence")),
            "source": F.when(hit, "ai_batch").otherwise(F.col("source")),
            key: F.when(hit, F.col("new_key")).otherwise(F.col(key)),
        }
    )
    return changed.select(*tags.columns)


def delete_cascading(parents: DataFrame, children: DataFrame, gone: Column, key: str, child_key: str) -> tuple[DataFrame, DataFrame]:
    """(parents, children) without the parents of a condition and without their children."""
    lost = parents.filter(gone).select(F.col(key).alias(child_key))
    return parents.filter(~F.coalesce(gone, F.lit(False))), children.join(lost, child_key, "left_anti").select(*children.columns)


def replace_children(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All children of each parent among ``new`` give way to the new ones."""
    return old.join(new.select(key), key, "left_anti").select(*old.columns).unionByName(new)


def with_current(old: DataFrame, new: DataFrame, keys: list[str], run: str) -> DataFrame:
    """Versions of old and new rows; the one of the latest run is current, of several the first by a hash of the row."""
    latest = Window.partitionBy(*keys).orderBy(F.desc(run), F.xxhash64(*[c for c in old.columns if c != "is_current"]))
    rows = old.drop("is_current").unionByName(new.drop("is_current"))
    return rows.withColumn("is_current", F.row_number().over(latest) == 1)


def artifacts(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(path, bytes, sha256) of landed files."""
    data = F.col(content).cast("binary")
    return files.select(path, F.octet_length(data).alias("bytes"), F.sha2(data, 256).alias("sha256"))


def run_finished(log: DataFrame, results: DataFrame) -> DataFrame:
    """The run log after ``results`` (run_id, rows, error, finished_at): running runs complete, or fail with 2000 characters of their error.

    Errors are cut before they travel, and both sides are shuffled: Spark takes a text for 20 bytes, and would broadcast results whose errors fill a gigabyte.
    """
    done = results.select("run_id", F.col("rows").alias("_rows"), F.substring("error", 1, 2000).alias("_error"), F.col("finished_at").alias("_at")).hint("merge")
    over = (F.col("status") == "running") & F.col("_at").isNotNull()
    status = F.when(over, F.when(F.col("_error").isNull(), "completed").otherwise("failed")).otherwise(F.col("status"))
    fields = {"rows": F.when(over, F.col("_rows")).otherwise(F.col("rows")), "error": F.when(over, F.col("_error")).otherwise(F.col("error")), "finished_at": F.when(over, F.col("_at")).otherwise(F.col("finished_at")), "status": status}
    return log.join(done, "run_id", "left").withColumns(fields).select(*log.columns)


def last_written(rows: DataFrame, key: str, place: str, rank: str) -> DataFrame:
    """The last row of each key by place, for an export that goes by rank, without one last, then by key."""
    order = F.when(F.col(rank).cast("string").rlike("^[0-9]+$"), F.col(rank).cast("long"))
    return one_per_key(rows, [key], [F.desc(place), *settled(rows)]).orderBy(order.asc_nulls_last(), key)


def first_written(rows: DataFrame, keys: list[str], place: str, *then: str) -> DataFrame:
    """The first row of each key by place, and of several there the first by ``then``, such as where a row lies in its files."""
    return one_per_key(rows, keys, [F.col(place), *map(F.col, then), *settled(rows)])


def enriched(base: DataFrame, details: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``base`` with the columns of its detail row that say something; the last detail row by hash where a key has several."""
    more = one_per_key(details, [key], settled(details)).select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    had = lambda c: F.col(c) if c in base.columns else F.lit(None).cast("string")
    fields = {c: F.coalesce(F.nullif(F.col(f"_{c}"), F.lit("")), had(c)) for c in columns}
    return base.join(more, key, "left").withColumns(fields).drop(*[f"_{c}" for c in columns])


def sync(local: DataFrame, hosted: DataFrame, store: str | None = None, limit: int | None = None, drop_missing: bool = True) -> DataFrame:
    """The hosted products after local ones went over: upserted by (store_id, external_id); those absent here are no longer available.

    A ``store`` bounds both steps. With a ``limit`` only the first products by key go and none is taken off.
    """
    keys = ["store_id", "external_id"]
    rows = local if store is None else local.filter(F.col("store_id") == store)
    rows = rows if limit is None else rows.orderBy(*keys).limit(limit)
    after = upsert(hosted, rows, keys)
    if not drop_missing or limit is not None:
        return after
    if store is None:
        return deactivate_missing(after, rows, keys)
    other = after.filter(~F.col("store_id").eqNullSafe(F.lit(store)))
    return other.unionByName(deactivate_missing(after.filter(F.col("store_id") == store), rows, keys))
