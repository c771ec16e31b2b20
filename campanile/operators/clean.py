"""Cleaning, validation and audit of experiment tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.quantile import fit_quantiles
from ..functions.scan import as_column, running

# fixed values: words that stand for "no value"
PLACEHOLDERS = ("", "none", "nan")
NULL_WORDS = ("", "none", "nan", "null", "na")

NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"
INTEGER = r"^[+-]?\d+$"


def placeholder_to_null(column, words: Sequence[str] = PLACEHOLDERS) -> Column:
    """Trimmed text, null when it is one of `words` in any letter case."""
    text = F.trim(as_column(column))
    return F.when(~F.lower(text).isin([w.lower() for w in words]), text)


def to_number(column, default: float | None = None) -> Column:
    """Text to double; bad text, NaN and null become `default`."""
    text = F.trim(as_column(column).cast("string"))
    number = F.when(text.rlike(NUMBER), text.try_cast("double"))
    return number if default is None else F.coalesce(number, F.lit(float(default)))


def to_text(column, default: str = "") -> Column:
    """Trimmed text or `default`."""
    return F.coalesce(F.trim(as_column(column).cast("string")), F.lit(default))


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fail before any job runs when a column is missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def key_report(df: DataFrame, key: str) -> DataFrame:
    """Rows, null keys and surplus rows of duplicate keys."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(F.col(key).isNull().cast("int")).alias("n_null"),
        (F.count(key) - F.countDistinct(key)).alias("n_duplicate"),
    )


def validate_rows(df: DataFrame, required: Sequence[str], score: str, low: float = 0, high: float = 9) -> DataFrame:
    """Add `reasons`, the array of failed checks (empty for an accepted row)."""
    checks = []
    for c in required:
        blank = F.col(c).isNull() | F.coalesce(F.trim(F.col(c).cast("string")) == "", F.lit(False))
        checks.append(F.when(blank, F.lit(f"{c} is missing")))
    number = to_number(score)
    checks.append(F.when(number.isNull(), F.lit(f"{score} is not a number")))
    checks.append(F.when((number < low) | (number > high), F.lit(f"{score} is out of range")))
    return df.withColumn("reasons", F.array_compact(F.array(*checks)))


def split_valid(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted rows and quarantined rows."""
    ok = F.size("reasons") == 0
    return validated.filter(ok).drop("reasons"), validated.filter(~ok)


def parse_diagnostics(df: DataFrame, column: str, is_ok: Column) -> DataFrame:
    """P5: add the ok flag of a parse."""
    return df.withColumn(f"{column}_ok", F.coalesce(is_ok, F.lit(False)))


def parse_rate(diagnosed: DataFrame, column: str) -> DataFrame:
    """P5: row count and ok rate."""
    return diagnosed.agg(F.count(F.lit(1)).alias("n_rows"), F.avg(F.col(f"{column}_ok").cast("double")).alias("ok_rate"))


def top_failures(diagnosed: DataFrame, column: str, n: int = 15) -> DataFrame:
    """P5: the most frequent failing values, null included."""
    failing = diagnosed.filter(~F.col(f"{column}_ok")).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return failing.orderBy(F.desc("n"), F.col(column).asc_nulls_first()).limit(n)


def member_rows(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """Rows whose key is in another table."""
    return df.join(wanted.select(key).distinct(), key, "left_semi")


def is_finite(column) -> Column:
    c = as_column(column)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def finite_labels(df: DataFrame, score: str, out: str = "label") -> DataFrame:
    """Rows with a finite score, and the score cut to an integer."""
    return df.withColumn("__y", to_number(score)).filter(is_finite("__y")).withColumn(out, F.col("__y").cast("int")).drop("__y")


def bins_at_most(column, cuts: Sequence[float], labels: Sequence) -> Column:
    """First label whose cut is not below the value, else the last label."""
    c = as_column(column)
    head = reduce(lambda e, p: e.when(c <= p[0], F.lit(p[1])), zip(cuts[1:], labels[1:]), F.when(c <= cuts[0], F.lit(labels[0])))
    return head.otherwise(F.lit(labels[len(cuts)]))


def bins_at_least(column, cuts: Sequence[float], labels: Sequence) -> Column:
    """First label whose cut is not above the value, else the last label."""
    c = as_column(column)
    head = reduce(lambda e, p: e.when(c >= p[0], F.lit(p[1])), zip(cuts[1:], labels[1:]), F.when(c >= cuts[0], F.lit(labels[0])))
    return head.otherwise(F.lit(labels[len(cuts)]))


@dataclass(frozen=True)
class MissingFill:
    """P10: structural columns to 0; gap columns flagged, then filled with a global median."""

    structural: tuple[str, ...]
    medians: Mapping[str, float | None]

    @classmethod
    def fit(cls, df: DataFrame, structural: Sequence[str], gaps: Sequence[str]) -> "MissingFill":
        found = fit_quantiles(df, list(gaps), [0.5]) if gaps else {}
        return cls(tuple(structural), {c: found[c].get(0.5) for c in gaps})

    def transform(self, df: DataFrame) -> DataFrame:
        flags = {f"{c}_missing": F.col(c).isNull().cast("double") for c in self.medians}
        fills = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in self.structural}
        fills |= {c: F.coalesce(F.col(c).cast("double"), F.lit(m)) for c, m in self.medians.items()}
        return df.withColumns(flags).withColumns(fills)


def fold_medians(df: DataFrame, columns: Sequence[str], fold: str, n_folds: int) -> DataFrame:
    """Median of each column over the rows outside each fold.

    Values are folded to one counted row each; the counts of the training rows of
    every fold are running sums over the same ordered pass. A column without
    values in a training set gets 0.
    """
    stack = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns]))
    long = df.select(F.col(fold).alias("__fold"), stack.alias("s")).select("__fold", "s.column", "s.value").filter(F.col("value").isNotNull())
    names = [f"n{f}" for f in range(n_folds)]
    counted = long.groupBy("column", "value").agg(
        *[F.sum((F.col("__fold") != f).cast("long")).alias(n) for f, n in enumerate(names)]
    )
    scanned = running(
        counted, ["column"], "value", F.lit(0),
        {f"u{f}": ("sum", n) for f, n in enumerate(names)}, {f"a{f}": ("sum", n) for f, n in enumerate(names)},
    )
    spans = F.array(*[
        F.struct(F.lit(f).alias("fold"), F.col(n).alias("n"), F.col(f"u{f}").alias("upto"), F.col(f"a{f}").alias("all"))
        for f, n in enumerate(names)
    ])
    at = scanned.select("column", "value", F.explode(spans).alias("s")).select("column", "value", "s.*")
    low, high = F.floor((F.col("all") - 1) / 2), F.ceil((F.col("all") - 1) / 2)
    first, last = F.col("upto") - F.col("n"), F.col("upto") - 1
    found = at.filter((F.col("n") > 0) & (low.between(first, last) | high.between(first, last)))
    medians = found.groupBy("column", "fold").agg(
        ((F.max(F.when(low.between(first, last), F.col("value"))) + F.max(F.when(high.between(first, last), F.col("value")))) / 2).alias("median")
    )
    return medians


def impute_by_fold(df: DataFrame, columns: Sequence[str], fold: str, n_folds: int) -> DataFrame:
    """Fill nulls of each row with the medians of the rows outside its fold (columns x folds numbers)."""
    model = {(r["column"], r["fold"]): r["median"] for r in fold_medians(df, columns, fold, n_folds).collect()}
    fills = {}
    for c in columns:
        fill = reduce(
            lambda e, f: e.when(F.col(fold) == f, F.lit(float(model.get((c, f), 0.0)))), range(1, n_folds),
            F.when(F.col(fold) == 0, F.lit(float(model.get((c, 0), 0.0)))),
        )
        fills[c] = F.coalesce(F.col(c).cast("double"), fill)
    return df.withColumns(fills)


def finite_or(column, default: float = 0.0) -> Column:
    """Null, NaN and infinite to `default`."""
    return F.when(is_finite(column), as_column(column)).otherwise(F.lit(default))


def range_counts(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    """P13."""
    c = to_number(column)
    return df.agg(
        F.count_if(c.isNull()).alias("n_null"), F.count_if(c < low).alias("n_below"), F.count_if(c > high).alias("n_above")
    )


def pair_filter(candidates: DataFrame, first: str, second: str, allowed: Sequence[str], mode: str) -> DataFrame:
    """Keep pairs from a set: 'strict' (both, empty second allowed), 'permissive' (at least one) or 'off'.

    When no row qualifies the unfiltered candidates are returned.
    """
    if mode == "off" or not allowed:
        return candidates
    empty = F.coalesce(F.upper(F.trim(F.col(second))), F.lit("")).isin("", "NAN", "NONE", "NA")
    a, b = F.upper(F.trim(F.col(first))).isin(list(allowed)), F.upper(F.trim(F.col(second))).isin(list(allowed))
    keep = F.coalesce(a & (b | empty) if mode == "strict" else a | b, F.lit(False))
    kept = candidates.filter(keep)
    return kept if kept.limit(1).count() else candidates


def columns_with_prefix(df: DataFrame, prefix: str) -> list[str]:
    """P15."""
    return [c for c in df.columns if c.startswith(prefix)]


def token_key(token, ions: Mapping[str, str]) -> Column:
    """Ion map first; null for an empty token or one with a space inside."""
    text = F.trim(as_column(token))
    mapped = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in ions.items() for x in kv]), text), text) if ions else text
    return F.when((F.length(mapped) > 0) & (F.instr(mapped, " ") == 0), mapped)


def kelvin_to_celsius(column, digits: int = 0) -> Column:
    """P24."""
    return F.bround(as_column(column) - 273.15, digits)


def split_volume(total, fraction, digits: int = 2) -> tuple[Column, Column]:
    """First and second share of a volume, rounded half to even."""
    first = F.bround(as_column(total) * as_column(fraction), digits)
    return first, F.bround(as_column(total) * (1 - as_column(fraction)), digits)


def effective_fraction(fraction, second) -> Column:
    """P25: 1 when there is no second member, else the fraction clipped to [0, 1]."""
    empty = F.coalesce(F.upper(F.trim(as_column(second))), F.lit("")).isin("", "NAN", "NONE")
    return F.when(empty, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), as_column(fraction).cast("double"))))


def friendly_columns(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Rename the columns that are present."""
    return df.withColumnsRenamed({k: v for k, v in names.items() if k in df.columns})


def smart_cast(column) -> Column:
    """struct(kind, as_int, as_float, as_text)."""
    text = F.trim(as_column(column).cast("string"))
    null = text.isNull() | F.lower(text).isin(list(NULL_WORDS))
    whole, number = text.rlike(INTEGER), text.rlike(NUMBER)
    kind = F.when(null, "null").when(whole, "int").when(number, "float").otherwise("text")
    return F.struct(
        kind.alias("kind"),
        F.when(~null & whole, text.try_cast("bigint")).alias("as_int"),
        F.when(~null & ~whole & number, text.try_cast("double")).alias("as_float"),
        F.when(~null & ~number, text).alias("as_text"),
    )


def value_counts(df: DataFrame, column: str, with_null: bool = False) -> DataFrame:
    """A1."""
    base = df if with_null else df.filter(F.col(column).isNotNull())
    return base.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.col(column).asc_nulls_last())


def _to_long(row: DataFrame, columns: Sequence[str], parts: Mapping[str, str]) -> DataFrame:
    """One-row aggregate `<column>__<part>` to one row per column."""
    structs = [F.struct(F.lit(c).alias("column"), *[F.col(f"{c}__{p}").cast(t).alias(p) for p, t in parts.items()]) for c in columns]
    return row.select(F.explode(F.array(*structs)).alias("s")).select("s.*")


def null_audit(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A2: null count and percent of the columns with at least one null."""
    row = df.agg(
        F.count(F.lit(1)).alias("__n"),
        *[F.count_if(F.col(c).isNull()).alias(f"{c}__n_null") for c in columns],
    ).withColumns({f"{c}__pct_null": F.try_divide(F.col(f"{c}__n_null") * 100.0, F.col("__n")) for c in columns})
    return _to_long(row, columns, {"n_null": "long", "pct_null": "double"}).filter(F.col("n_null") > 0)


def coercion_failures(df: DataFrame, columns: Sequence[str], key: str, n_ids: int = 10) -> DataFrame:
    """A3: per column the texts that are no number: count, distinct texts, first ids.

    The first ids come from a rank limit that Spark applies before the shuffle.
    """
    stack = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("raw")) for c in columns]))
    bad = df.select(F.col(key), stack.alias("s")).select(key, "s.column", "s.raw").filter(
        F.col("raw").isNotNull() & to_number("raw").isNull()
    )
    first = (
        bad.withColumn("__rn", F.row_number().over(W.partitionBy("column").orderBy(key)))
        .filter(F.col("__rn") <= n_ids)
        .groupBy("column")
        .agg(F.array_sort(F.collect_list(key)).alias("first_ids"))
    )
    counts = bad.groupBy("column").agg(F.count(F.lit(1)).alias("n_bad"), F.countDistinct("raw").alias("n_distinct"))
    return counts.join(first, "column")


def offending_rows(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """A4: rows with nulls: which columns, how many, worst first."""
    nulls = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in columns]))
    return (
        df.withColumn("null_columns", nulls)
        .withColumn("n_null", F.size("null_columns"))
        .filter(F.col("n_null") > 0)
        .orderBy(F.desc("n_null"), key)
    )


def column_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A5: distinct, min, max and mean per column.

    Equal values of a column fold into one counted row first, in each task before they move, so columns share one shuffle and a hot value is one row. An empty
    table, or a column of nulls, has 0 distinct values and nulls besides.
    """
    values = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])
    folded = df.select(F.explode(values).alias("s")).groupBy("s.column", "s.v").agg(F.count(F.lit(1)).alias("n"))
    found = folded.groupBy("column").agg(
        F.count("v").alias("n_distinct"), F.min("v").alias("low"), F.max("v").alias("high"),
        F.try_divide(F.sum(F.col("v") * F.col("n")), F.sum(F.when(F.col("v").isNotNull(), F.col("n")))).alias("mean"),
    )
    named = df.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, columns))).alias("column"))
    return named.join(found, "column", "left").select("column", F.coalesce("n_distinct", F.lit(0)).cast("long").alias("n_distinct"), "low", "high", "mean")
