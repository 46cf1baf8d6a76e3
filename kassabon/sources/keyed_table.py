"""A table laid out by its keys, so that an upsert rewrites only the parts whose rows change.

Rows lie in buckets by a hash of their keys: ``data/<writing>/bucket=<n>``. A commit is one small file
that says in which writing each bucket is; readers take the last commit. Whatever a job wrote before it
was lost belongs to no commit, so the table stays as it was, and a commit of a number that is there
already fails: of two writers one has to begin anew.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kassabon.operators.keyed import one_per_key

from .sinks import settled

BUCKET, HASH = "_bucket", "_hash"
COMMIT = "number long, bucket int, writing string, mark long, buckets int"


class KeyedTable:
    """The table of ``path``, with a row for each value of ``keys`` (null is a value). ``kept`` columns stay as they were where a row is replaced, and make no change by themselves. Buckets go by all keys, or by those of ``by``."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: list[str], buckets: int = 64, kept: tuple[str, ...] = (), by: list[str] | None = None):
        self.spark, self.path, self.keys, self.buckets, self.kept, self.by = spark, path.rstrip("/"), keys, buckets, kept, by or keys
        self.schema = T.StructType([T.StructField(f.name, f.dataType) for f in schema.fields])
        self.columns = self.schema.fieldNames()

    def _folder(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _names(self, folder: str) -> list[str]:
        system, path = self._folder(folder)
        return [s.getPath().getName() for s in system.listStatus(path)] if system.exists(path) else []

    def commits(self) -> list[int]:
        """Numbers of the commits there are. A folder counts when its one file is there."""
        numbers = [int(n) for n in self._names("commits") if n.isdigit()]
        return sorted(n for n in numbers if any(f.startswith("part-") for f in self._names(f"commits/{n}")))

    def state(self, number: int | None = None) -> tuple[int, int, dict[int, str]]:
        """(number, mark, writing of each bucket) of a commit, the last one if none is named; number -1 if there is none."""
        known = [n for n in self.commits() if number is None or n <= number]
        if not known:
            return -1, -1, {}
        rows = self.spark.read.schema(COMMIT).json(f"{self.path}/commits/{known[-1]}").collect()  # a row a bucket
        if rows[0]["buckets"] != self.buckets:
            raise ValueError(f"the table has {rows[0]['buckets']} buckets")
        return known[-1], rows[0]["mark"], {r["bucket"]: r["writing"] for r in rows if r["writing"]}

    def _read(self, writings: dict[int, str], buckets: list[int] | None = None) -> DataFrame:
        """Rows of some buckets with bucket and hash. Only the folders of these are listed."""
        schema = T.StructType([*self.schema.fields, T.StructField(BUCKET, T.IntegerType()), T.StructField(HASH, T.LongType())])
        paths = [f"{self.path}/data/{w}/bucket={b}" for b, w in sorted(writings.items()) if buckets is None or b in set(buckets)]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def bucket_of(self, *keys: str) -> Column:
        return F.pmod(F.xxhash64(*keys), F.lit(self.buckets)).cast("int")

    def read(self, number: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The rows as of a commit, the last one if none is named; those of some buckets, if they are."""
        return self._read(self.state(number)[2], buckets).select(*self.columns)

    def _placed(self, rows: DataFrame) -> DataFrame:
        rows = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields])
        said = [F.to_json(F.struct(c)) if isinstance(self.schema[c].dataType, T.MapType | T.VariantType) else F.col(c) for c in self.columns if c not in self.kept]
        return rows.withColumns({BUCKET: self.bucket_of(*self.by), HASH: F.xxhash64(*said)})

    def upsert(self, new: DataFrame, when: Callable[[Callable[[str], Column]], Column] | None = None, order: list[Column] | None = None, mark: int = -1) -> list[int]:
        """Replace or add rows; gives the buckets that were written anew.

        Several new rows of a key: the first by ``order``, else by a hash of the row. ``when`` gets functions
        of the old and of the new columns and says whether a row may be replaced. ``mark`` is kept with the commit.
        """
        number, _, writings = self.state()
        fresh = self._placed(one_per_key(new, self.keys, order or settled(new.select(*self.columns))))
        held = self._read(writings)
        names = lambda side: [F.col(c).alias(f"_{side}_{c}") for c in [*self.columns, HASH]]

        def met(old: DataFrame, how: str) -> DataFrame:
            o = old.repartition(BUCKET).select(F.col(BUCKET).alias("_o_bucket"), *names("o"), F.lit(True).alias("_o_there"))
            n = fresh.repartition(BUCKET).select(F.col(BUCKET).alias("_n_bucket"), *names("n"), F.lit(True).alias("_n_there"))
            on = [F.col("_o_bucket") == F.col("_n_bucket"), *[F.col(f"_o_{k}").eqNullSafe(F.col(f"_n_{k}")) for k in self.keys]]
            return n.join(o, on, how)

        may = when(lambda c: F.col(f"_o_{c}"), lambda c: F.col(f"_n_{c}")) if when else F.lit(True)
        taken = F.col("_n_there").isNotNull() & (F.col("_o_there").isNull() | (F.coalesce(may, F.lit(False)) & (F.col(f"_o_{HASH}") != F.col(f"_n_{HASH}"))))
        changed = sorted(r[0] for r in met(held, "left").filter(taken).select("_n_bucket").distinct().collect())  # at most the number of buckets
        if not changed and number >= 0 and mark == self.state()[1]:
            return []
        writing = uuid.uuid4().hex
        if changed:
            fresh = fresh.filter(F.col(BUCKET).isin(changed))
            after = met(self._read(writings, changed), "full_outer")
            pick = lambda c: F.when(taken & ~(F.lit(c in self.kept) & F.coalesce(F.col("_o_there"), F.lit(False))), F.col(f"_n_{c}")).otherwise(F.col(f"_o_{c}")).alias(c)
            rows = self._placed(after.select(*[pick(c) for c in self.columns]))
            rows.withColumn("bucket", F.col(BUCKET)).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/data/{writing}")
        self._commit(number + 1, mark, writings | dict.fromkeys(changed, writing))
        return changed

    def _commit(self, number: int, mark: int, writings: dict[int, str]) -> None:
        rows = [(number, b, writings.get(b, ""), mark, self.buckets) for b in range(self.buckets)]
        self.spark.createDataFrame(rows, COMMIT).coalesce(1).write.mode("errorifexists").json(f"{self.path}/commits/{number}")

    def missing(self, present: DataFrame) -> DataFrame:
        """Rows of the table whose keys ``present`` lacks; the table's side is pruned to what is asked for."""
        return self.read().join(present.select(*self.keys).distinct(), self.keys, "left_anti")

    def clean(self, keep: int = 10) -> int:
        """Remove commits but the last ``keep``, and what no remaining commit refers to; gives the number of writings removed. Not beside a running upsert."""
        for n in self.commits()[:-keep]:
            system, path = self._folder(f"commits/{n}")
            system.delete(path, True)
        used = {w for n in self.commits() for w in self.state(n)[2].values()}
        gone = [w for w in self._names("data") if w not in used]
        for w in gone:
            system, path = self._folder(f"data/{w}")
            system.delete(path, True)
        return len(gone)


def sync_table(local: DataFrame, hosted: KeyedTable, store: str | None = None, drop_missing: bool = True) -> list[int]:
    """The hosted products after local ones went over, as ``sinks.sync``: rows of (store_id, external_id) upserted, those absent here no longer available. Gives the buckets written."""
    rows = local if store is None else local.filter(F.col("store_id") == store)
    if drop_missing:
        gone = hosted.missing(rows).filter("is_available")
        gone = gone if store is None else gone.filter(F.col("store_id") == store)
        rows = rows.select(*hosted.columns).unionByName(gone.withColumn("is_available", F.lit(False)))
    return hosted.upsert(rows)
