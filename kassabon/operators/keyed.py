"""One row for each key, price matrices, bands and positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def one_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order; null keys are a key. Ties must be settled by the order."""
    return df.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_place = 1").drop("_place")


def latest_per_key(df: DataFrame, keys: list[str], *times: str) -> DataFrame:
    return one_per_key(df, keys, [F.col(t).desc_nulls_last() for t in times])


def best_of(df: DataFrame, keys: list[str], pick: str, *order: Column) -> DataFrame:
    """(keys, pick) of the smallest order values, as an aggregate: it combines before it shuffles."""
    return df.groupBy(*keys).agg(F.min(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], F.col(pick).alias("x")))["x"].alias(pick))


def price_matrix(df: DataFrame, key: str, store: str, cents: str, stores: tuple[str, ...], how: str, *more: Column) -> DataFrame:
    """One column of cents for each store, smallest or largest, and how many stores have the key."""
    pick = {"min": F.min, "max": F.max}[how]
    columns = [pick(F.when(F.col(store) == s, F.col(cents))).alias(f"{s}_cents") for s in stores]
    return df.groupBy(key).agg(*more, *columns, F.count_distinct(store).alias("store_count"))


def within_band(df: DataFrame, keys: list[str], score: str, price: str, width: float = 0.12, least: float = 0.5) -> DataFrame:
    """Priced rows whose score is near the best of their key."""
    usable = df.filter(F.col(score).isNotNull() & F.col(price).isNotNull() & ~F.isnan(F.col(score).cast("double")))
    best = F.max(score).over(Window.partitionBy(*keys))
    return usable.withColumn("_best", best).filter(F.col(score) >= F.greatest(F.lit(least), F.col("_best") - width)).drop("_best")


def cheapest_relevant(df: DataFrame, keys: list[str], score: str, price: str, name: str, width: float = 0.12, least: float = 0.5) -> DataFrame:
    near = within_band(df, keys, score, price, width, least)
    return one_per_key(near, keys, [F.col(price), F.col(score).desc(), F.col(name)])


def members_with_position(df: DataFrame, keys: list[str], member: str, *order: str) -> DataFrame:
    """(keys, member, position from 1) in the given order."""
    window = Window.partitionBy(*keys).orderBy(*[F.col(o).asc_nulls_last() for o in order], F.col(member))
    return df.select(*keys, member, F.row_number().over(window).alias("position"))


def ordered_list(member: str, *order: str) -> Column:
    """Aggregate: the members in the order of other columns."""
    items = F.array_sort(F.collect_list(F.struct(*order, member)))
    return F.transform(items, lambda x: x[member])


def list_position(df: DataFrame, keys: list[str], *order: str) -> Column:
    """Position from 0 within a list."""
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.col(o).asc_nulls_last() for o in order])) - 1


def coverage(df: DataFrame, *columns: str) -> DataFrame:
    """One row: rows and non-null values of each column."""
    return df.agg(F.count(F.lit(1)).alias("rows"), *[F.count(c).alias(f"{c}_count") for c in columns])


def for_user(df: DataFrame, user: str, column: str = "user_id") -> DataFrame:
    return df.filter(F.col(column) == user)


def children_for_user(children: DataFrame, parents: DataFrame, user: str, key: str, parent_key: str = "id") -> DataFrame:
    """Rows whose parent the user owns."""
    own = for_user(parents, user).select(F.col(parent_key).alias(key))
    return children.join(own, key, "left_semi")


def largest_groups(df: DataFrame, key: str, member: str, count: int = 40, shown: int = 6) -> DataFrame:
    """The keys with the most rows and the first few of their distinct members; ties go by key."""
    names = df.select(key, member).distinct().withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(member))).filter(F.col("_n") <= shown)
    names = names.groupBy(key).agg(F.array_sort(F.collect_list(member)).alias("members"))
    top = df.groupBy(key).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), key).limit(count)
    return top.join(names, key)


def with_member_of(df: DataFrame, items: str, value: str) -> DataFrame:
    """Rows whose array holds a value."""
    return df.filter(F.array_contains(items, value))


def complete(df: DataFrame, *columns: str) -> DataFrame:
    """Rows whose columns all say something."""
    return df.filter(" and ".join(f"nullif(trim(cast(`{c}` as string)), '') is not null" for c in columns))


def menu_order(df: DataFrame, parent: str, place: str, name: str) -> DataFrame:
    """``position`` within a menu: entries of the top level first, then by place and name."""
    order = Window.partitionBy("menu").orderBy(F.col(parent).isNotNull(), F.col(place).asc_nulls_last(), F.lower(name), name)
    return df.withColumn("position", F.row_number().over(order))


def in_language_order(items: Column, language: str = "nl") -> Column:
    """Texts as readers of a language sort them: letters before their case."""
    return F.transform(F.array_sort(F.transform(items, lambda x: F.struct(F.collate(x, language).alias("k"), x.alias("x")))), lambda s: s["x"])


def first_listed(lists: list[DataFrame], column: str, place: str, limit: int | None = None) -> DataFrame:
    """Distinct values in the order in which several lists, one after the other, first name them."""
    rows = None
    for i, df in enumerate(lists):
        part = df.select(column, F.struct(F.lit(i).alias("list"), F.col(place).alias("place")).alias("at"))
        rows = part if rows is None else rows.unionByName(part)
    firsts = rows.groupBy(column).agg(F.min("at").alias("at")).orderBy("at")
    return (firsts if limit is None else firsts.limit(limit)).select(column)


def replaceable(rows: DataFrame, groups: DataFrame, key: str, source: str = "ean") -> DataFrame:
    """Rows without a group, or whose group is of that source: what a refresh may overwrite."""
    known = groups.filter(F.col("source") == source).select(F.col("group_key").alias(key)).distinct().withColumn("_known", F.lit(True))
    return rows.join(known, key, "left").filter(F.col(key).isNull() | F.col("_known")).drop("_known")
