"""Scans, sinks, sidecars, catalogs and derived-table caches."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpoint_dir


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def read_table(spark: SparkSession, path: str, format: str = "parquet", schema: T.StructType | str | None = None,
               drop_prefix: str = "Unnamed", only_empty: bool = False) -> DataFrame:
    """Scan a table and drop the columns whose name starts with a prefix (when asked, only the empty ones)."""
    reader = spark.read.format(format)
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.option("header", True).load(path) if format == "csv" else reader.load(path)
    junk = [c for c in df.columns if c.startswith(drop_prefix)]
    if only_empty and junk:
        row = df.agg(*[F.count(F.col(c)).alias(f"n{i}") for i, c in enumerate(junk)]).first()
        junk = [c for i, c in enumerate(junk) if row[f"n{i}"] == 0]
    return df.drop(*junk)


def select_names(df: DataFrame, keep: Callable[[str], bool]) -> DataFrame:
    """Columns by a predicate on their name; the scan reads only those."""
    return df.select(*[c for c in df.columns if keep(c)])


def write_profiles(lines: DataFrame, path: str) -> None:
    """S3: the lines (name, value) of many profile files in few files, each line behind its file's name (without tabs or line breaks) and a tab."""
    lines.select(F.concat_ws("\t", "name", "value").alias("value")).write.text(path)


def read_profiles(spark: SparkSession, glob: str, pattern: str, rows: int, bundled: bool = False) -> DataFrame:
    """S3: whitespace-separated profile files to (index_no, area array); `pattern` captures the number in the path.

    A file counts only with exactly `rows` rows. When two names give one number
    the longer (padded) name wins. `bundled`: the files are those of `write_profiles`,
    whose names take the place of paths; each small file costs processes, tasks and memory of the driver.
    """
    text = spark.read.text(glob)
    if bundled:
        cut = F.split("value", "\t", 2)
        lines = text.select(cut[0].alias("path"), F.coalesce(F.get(cut, F.lit(1)), F.lit("")).alias("value"))
    else:
        lines = text.select(F.col("_metadata.file_path").alias("path"), F.col("value"))
    parts = F.split(F.trim("value"), r"\s+")
    points = lines.select(
        "path", F.regexp_extract("path", pattern, 1).alias("digits"),
        parts[0].try_cast("double").alias("sigma"), F.get(parts, F.lit(1)).try_cast("double").alias("area"),
    ).filter(F.col("digits") != "")
    # sizes first, so that only files of the right length are ever gathered
    sized = points.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("sigma").isNull() | F.col("area").isNull()).alias("bad"))
    fitting = points.join(sized.filter((F.col("n") == rows) & (F.col("bad") == 0)).select("path"), "path", "left_semi")
    whole = fitting.groupBy("path", "digits").agg(F.array_sort(F.collect_list(F.struct("sigma", "area"))).alias("points"))
    number = F.col("digits").cast("int")
    best = whole.groupBy(number.alias("index_no")).agg(F.max_by("points", F.length("digits")).alias("points"))
    return best.select("index_no", F.transform("points", lambda p: p["sigma"]).alias("sigma"), F.transform("points", lambda p: p["area"]).alias("area"))


def load_dimension(df: DataFrame, name: str, numeric: Sequence[str], position: str) -> DataFrame:
    """Keyed by the trimmed upper-case name, numbers coerced, the last duplicate wins."""
    from ..operators.clean import to_number

    rows = df.select(F.upper(F.trim(F.col(name))).alias("name"), *[to_number(c).alias(c) for c in numeric], F.col(position).alias("__pos"))
    return rows.groupBy("name").agg(*[F.max_by(c, "__pos").alias(c) for c in numeric])


def write_csv(df: DataFrame, path: str) -> None:
    """S6."""
    df.write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """S5."""
    return spark.read.schema(schema).option("header", True).csv(path)


def write_top(df: DataFrame, order: Sequence[Column | str], path: str, n: int = 100) -> None:
    """The first n rows of a ranked result."""
    write_csv(df.orderBy(*order).limit(n), path)


def write_json(df: DataFrame, path: str) -> None:
    """S8."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Records that do not parse are left out."""
    rows = spark.read.text(path).select(F.from_json("value", schema).alias("r"), F.get_json_object("value", "$").alias("ok"))
    return rows.filter(F.col("ok").isNotNull() & F.col("r").isNotNull()).select("r.*")


def layout_hash(catalog: DataFrame, order: str, columns: Sequence[str]) -> DataFrame:
    """Fingerprint of a catalog in its order and of its width. A catalog has one row per feature column."""
    entry = F.concat_ws(":", *[F.col(c).cast("string") for c in columns])
    rows = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), entry.alias("e"))))
    text = F.concat_ws("|", F.transform(rows, lambda r: r["e"]))
    return catalog.agg(F.sha2(F.concat(text, F.lit("|"), F.count(F.lit(1)).cast("string")), 256).alias("layout"))


def list_files(spark: SparkSession, folder: str, suffix: str = "") -> DataFrame:
    """(path, modified, size) of the files below a folder, newest first; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").load(folder)
    return files.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size")).orderBy(F.desc("modified"), "path")


def newest_per_key(files: DataFrame, pattern: str) -> DataFrame:
    """The newest file for each key captured from its path."""
    keyed = files.withColumn("key", F.regexp_extract("path", pattern, 1)).filter(F.col("key") != "")
    newest = F.row_number().over(W.partitionBy("key").orderBy(F.desc("modified"), F.desc("path")))
    return keyed.withColumn("rn", newest).filter("rn = 1").drop("rn")


def staleness(derived: DataFrame, sources: DataFrame, key: str) -> DataFrame:
    """Whether each derived table is missing or older than its source. Both sides: (key, modified)."""
    a = derived.groupBy(key).agg(F.min("modified").alias("derived_at"))
    b = sources.groupBy(key).agg(F.max("modified").alias("source_at"))
    joined = b.join(a, key, "left")
    return joined.withColumn("stale", F.coalesce(F.col("derived_at") < F.col("source_at"), F.lit(True)))


def fingerprint(spark: SparkSession, path: str) -> str:
    """Hash over the names, sizes and times of a source's files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    row = files.agg(
        F.sum(F.xxhash64("path", "length", F.unix_micros("modificationTime")).cast("decimal(38,0)")).alias("h"), F.count(F.lit(1)).alias("n")
    ).first()
    return f"{row['n']}:{row['h']}"


class DerivedCache:
    """A derived table kept as Parquet and reused while source fingerprint and schema version both match."""

    def __init__(self, spark: SparkSession, folder: str, schema_version: str):
        self.spark, self.folder, self.version = spark, folder.rstrip("/"), schema_version

    def _manifest(self) -> DataFrame | None:
        try:
            return self.spark.read.schema("source string, fingerprint string, version string, path string, at timestamp").json(f"{self.folder}/manifest")
        except Exception as error:
            if "PATH_NOT_FOUND" in str(error):
                return None
            raise

    def get(self, source: str, build: Callable[[], DataFrame]) -> DataFrame:
        mark = fingerprint(self.spark, source)
        manifest = self._manifest()
        if manifest is not None:
            hit = manifest.filter((F.col("source") == source) & (F.col("fingerprint") == mark) & (F.col("version") == self.version))
            row = hit.orderBy(F.desc("at")).first()
            if row is not None:
                return self.spark.read.parquet(row["path"])
        path = f"{self.folder}/data-{uuid.uuid4().hex}"
        build().write.parquet(path)
        entry = self.spark.createDataFrame([(source, mark, self.version, path)], "source string, fingerprint string, version string, path string")
        entry.withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").json(f"{self.folder}/manifest")
        return self.spark.read.parquet(path)
