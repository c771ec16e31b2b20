"""Versioned Parquet snapshots and the table maintenance on top of them.

A version is a pointer: a small file that names the data folders it is made of. A
writer puts its rows into a folder of its own, writes the whole pointer under a name
of its own, and publishes by giving it the next number; that fails when another
writer was first. So nobody touches what a published version reads, and a writer
that stops half-way leaves nothing that counts as a version. An append adds one folder to the list of the version
before. Older versions stay as backups.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.clean import split_valid, validate_rows


class ConcurrentEdit(RuntimeError):
    """Another writer committed first, or rows changed since they were read."""


class SnapshotTable:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    # -- versions --

    def versions(self) -> list[int]:
        commits = self._path(f"{self.folder}/commits")
        if not self._fs.exists(commits):
            return []
        return sorted(int(s.getPath().getName()) for s in self._fs.listStatus(commits) if s.getPath().getName().isdigit())

    def version(self) -> int:
        found = self.versions()
        return found[-1] if found else 0

    def folders(self, version: int) -> list[str]:
        """The data folders of a version."""
        named = [r.value for r in self.spark.read.text(f"{self.folder}/commits/{version}").collect()]
        if not named:
            raise ValueError(f"version {version} of {self.folder} names no data")
        return named

    def read(self, version: int | None = None) -> DataFrame:
        v = self.version() if version is None else version
        if v == 0:
            raise FileNotFoundError(f"{self.folder} has no committed version")
        return self.spark.read.option("mergeSchema", True).parquet(*[f"{self.folder}/data/{name}" for name in self.folders(v)])

    def commit(self, df: DataFrame, expected: int | None = None, append: bool = False) -> int:
        """Write rows and publish the next version; `expected` is the version the change was made from.

        With `append` the rows join those of that version, which are not written again; else they replace them.
        """
        base = self.version() if expected is None else expected
        if self.version() != base:
            raise ConcurrentEdit(f"version is {self.version()}, not {base}")
        own = uuid.uuid4().hex
        df.write.parquet(f"{self.folder}/data/{own}")
        names = [*(self.folders(base) if append and base else []), own]
        pending = self._path(f"{self.folder}/commits/pending-{own}")
        pointer = self._fs.create(pending, False)
        pointer.writeBytes("".join(f"{n}\n" for n in names))
        pointer.close()
        if not self._publish(pending, self._path(f"{self.folder}/commits/{base + 1}")):
            raise ConcurrentEdit(f"version {base + 1} was committed by another writer")
        return base + 1

    def _publish(self, pending, final) -> bool:
        """Give a whole pointer its number in one step, unless the number is taken."""
        if self._fs.getUri().getScheme() == "file":  # renaming would replace a file here, linking does not
            file = lambda p: self.spark._jvm.java.io.File(p.toUri().getPath()).toPath()
            try:
                self.spark._jvm.java.nio.file.Files.createLink(file(final), file(pending))
            except Exception:
                if self._fs.exists(final):
                    return False
                raise
            self._fs.delete(pending, False)
            return True
        return not self._fs.exists(final) and self._fs.rename(pending, final)

    def backups(self) -> list[int]:
        """The versions before the current one, newest first."""
        return self.versions()[-2::-1]


# -- pure plans, usable without a table --------------------------------------------


def accepted_rows(table: DataFrame, rows: DataFrame, required: Sequence[str], score: str,
                  enrich: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows to append, with the table's types; rejected rows with reasons); new fields become columns."""
    accepted, rejected = split_valid(validate_rows(rows, required, score))
    accepted = enrich(accepted) if enrich else accepted
    casts = dict(table.dtypes)
    accepted = accepted.withColumns({c: F.col(c).cast(casts[c]) for c in accepted.columns if c in casts})
    return accepted, rejected


def check_identity(table: DataFrame, key: str, expected: DataFrame) -> None:
    """Every expected key must be present exactly once, else fail before anything is written."""
    found = expected.select(key).distinct().join(table.groupBy(key).agg(F.count(F.lit(1)).alias("__n")), key, "left")
    bad = [r[0] for r in found.filter(F.coalesce(F.col("__n"), F.lit(0)) != 1).select(key).limit(5).collect()]
    if bad:
        raise ConcurrentEdit(f"rows changed or missing for {key}: {bad}")


def update_rows(table: DataFrame, updates: DataFrame, key: str, changed: Sequence[str], derived: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """Set `changed` columns from the updates (null keeps the old value); new columns are allowed.

    `derived` maps a changed column to outputs computed from it: they are set to
    null on the updated rows so that incremental enrichment fills them again.
    """
    new = updates.select(F.col(key), *[F.col(c).alias(f"__new_{c}") for c in changed], F.lit(True).alias("__hit"))
    joined = table.join(new, key, "left")
    hit = F.coalesce(F.col("__hit"), F.lit(False))
    fresh = {}
    for c in changed:
        value = F.col(f"__new_{c}")
        fresh[c] = F.coalesce(value.cast(dict(table.dtypes)[c]), F.col(c)) if c in table.columns else value
    stale = sorted({o for c in changed for o in (derived or {}).get(c, ()) if o in table.columns})
    fresh |= {o: F.when(~hit, F.col(o)) for o in stale}
    return joined.withColumns(fresh).drop("__hit", *[f"__new_{c}" for c in changed])


def delete_rows(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """E3."""
    return table.join(keys.select(key).distinct(), key, "left_anti")


def tombstones(old: DataFrame, add: DataFrame | None = None, restore: DataFrame | None = None, keys: Sequence[str] = ("iteration", "rank")) -> DataFrame:
    """E5: dismissed picks after adding and restoring some; duplicates collapse."""
    out = old.select(*keys)
    out = out.unionByName(add.select(*keys)) if add is not None else out
    out = out.distinct()
    return out.join(restore.select(*keys).distinct(), list(keys), "left_anti") if restore is not None else out


def replace_batch(spark: SparkSession, folder: str, batch: DataFrame, iteration: int, column: str = "iteration") -> None:
    """Replace one batch of a table partitioned by iteration; fail when it is absent."""
    table = spark.read.parquet(folder)
    if not table.filter(F.col(column) == iteration).limit(1).count():
        raise KeyError(f"no batch {iteration}")
    rows = batch.withColumn(column, F.lit(iteration)).select(*table.columns)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(folder)


def pending_picks(batches: DataFrame, iteration: str, picks: str, dismissed: DataFrame | None = None, before: str | None = None) -> DataFrame:
    """Nested batches to (iteration, rank, pick...), newest first, dismissed ones left out.

    A batch may be kept in several rows; the column `before` then tells how many picks of the batch come before those of the row.
    """
    ahead = F.lit(0) if before is None else F.col(before)
    flat = batches.select(F.col(iteration).alias("iteration"), ahead.alias("__ahead"), F.posexplode(picks).alias("pos", "pick"))
    flat = flat.select("iteration", (F.col("__ahead") + F.col("pos") + 1).cast("int").alias("rank"), "pick.*")
    if dismissed is not None:
        flat = flat.join(dismissed.select("iteration", "rank").distinct(), ["iteration", "rank"], "left_anti")
    return flat.orderBy(F.desc("iteration"), "rank")


class Memo:
    """Per-key results kept as Parquet by namespace; only new keys are computed.

    `compute` is given the distinct new keys as a DataFrame and returns (key,
    value): built-in columns, or `mapInPandas` with a caller's function. A new
    namespace (which ends in a version tag) starts empty.
    """

    def __init__(self, spark: SparkSession, folder: str, namespace: str, value_type: str):
        self.spark, self.namespace = spark, namespace
        self.path = f"{folder.rstrip('/')}/namespace={namespace}"
        self.schema = f"key string, value {value_type}"

    def known(self) -> DataFrame:
        try:
            return self.spark.read.schema(self.schema).parquet(self.path)
        except Exception as error:
            if "PATH_NOT_FOUND" in str(error):
                return self.spark.createDataFrame([], self.schema)
            raise

    def attach(self, df: DataFrame, key: str, compute: Callable[[DataFrame], DataFrame], out: str = "value") -> DataFrame:
        wanted = df.select(F.col(key).cast("string").alias("key")).where(F.col(key).isNotNull()).distinct()
        fresh = wanted.join(self.known().select("key"), "key", "left_anti")
        compute(fresh).select("key", "value").write.mode("append").parquet(self.path)
        # only the wanted keys are looked up; two writers may have added one key, and either value serves
        table = self.known().join(wanted, "key", "left_semi").groupBy("key").agg(F.any_value("value").alias(out))
        return df.join(table, F.col(key).cast("string") == F.col("key"), "left").drop("key")
