"""Feature statistics, scaling and catalogs."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numeric import digamma
from ..functions.quantile import quantiles
from ..functions.scan import as_column, number_rows, running, with_halo
from ..session import cut


@dataclass(frozen=True)
class Ranges:
    """Minimum and maximum per column from one aggregate."""

    low: Mapping[str, float]
    high: Mapping[str, float]

    @classmethod
    def fit(cls, df: DataFrame, columns: Sequence[str]) -> "Ranges":
        row = df.agg(*[F.min(F.col(c).cast("double")).alias(f"lo_{i}") for i, c in enumerate(columns)],
                     *[F.max(F.col(c).cast("double")).alias(f"hi_{i}") for i, c in enumerate(columns)]).first()
        return cls({c: row[f"lo_{i}"] for i, c in enumerate(columns)}, {c: row[f"hi_{i}"] for i, c in enumerate(columns)})

    def kept(self) -> list[str]:
        """The columns that vary."""
        return [c for c in self.low if self.low[c] is not None and self.low[c] != self.high[c]]

    def scaled(self, column: str, clip: bool = False) -> Column:
        """To [0, 1]; a constant column gives 0."""
        span = (self.high[column] or 0.0) - (self.low[column] or 0.0)
        if span == 0:
            return F.lit(0.0)
        value = (F.col(column).cast("double") - F.lit(self.low[column])) / F.lit(span)
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)) if clip else value


@dataclass(frozen=True)
class Standard:
    """P20: mean and population deviation per column; a constant column gives 0."""

    mean: Mapping[str, float]
    std: Mapping[str, float]

    @classmethod
    def fit(cls, df: DataFrame, columns: Sequence[str]) -> "Standard":
        row = df.agg(*[F.avg(c).alias(f"m_{i}") for i, c in enumerate(columns)], *[F.stddev_pop(c).alias(f"s_{i}") for i, c in enumerate(columns)]).first()
        return cls({c: row[f"m_{i}"] for i, c in enumerate(columns)}, {c: row[f"s_{i}"] for i, c in enumerate(columns)})

    def scaled(self, column: str) -> Column:
        return (F.col(column) - F.lit(self.mean[column])) / F.lit(self.std[column] or 1.0)


def varying_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The names of the columns that hold more than one value, as rows; one scan."""
    ranges = F.array(*[F.struct(F.lit(c).alias("column"), (F.min(c) < F.max(c)).alias("varies")) for c in columns])
    return df.agg(ranges.alias("r")).select(F.explode("r").alias("r")).filter("r.varies").select("r.column")


#: Columns of a block, and bytes of block products a task adds up at once; more blocks are more passes over the rows.
COLUMNS_PER_BLOCK, PRODUCT_BYTES = 256, 256 << 20


def _batches(frames, missing_as: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Matrices of rows and whether their places hold a number; the others hold `missing_as`."""
    for frame in frames:
        if len(frame):
            x = np.stack(frame["x"].to_numpy()).astype(np.float64)
            there = np.isfinite(x)
            yield np.where(there, x, missing_as), there


def _column_totals(rows: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Count of numbers, mean, and whether it varies, per column: one row of totals a task, added up before they reach the driver."""

    def run(frames):
        n, total, low, high = np.zeros(width), np.zeros(width), np.full(width, np.inf), np.full(width, -np.inf)
        for x, there in _batches(frames, 0.0):
            n, total = n + there.sum(0), total + x.sum(0)
            low, high = np.minimum(low, np.where(there, x, np.inf).min(0)), np.maximum(high, np.where(there, x, -np.inf).max(0))
        yield pd.DataFrame({"n": [n], "total": [total], "low": [low], "high": [high]})

    told = rows.mapInPandas(run, "n array<double>, total array<double>, low array<double>, high array<double>")
    of = lambda c, how: getattr(Summarizer, how)(array_to_vector(c)).alias(c)
    row = told.agg(of("n", "sum"), of("total", "sum"), of("low", "min"), of("high", "max")).first()
    n, total, low, high = (np.array(row[c].toArray()) for c in ("n", "total", "low", "high"))
    return n, total / np.maximum(n, 1), low < high


def _products(rows: DataFrame, centre: np.ndarray, pairs: Sequence[tuple[int, int]], block: int, whole: bool) -> DataFrame:
    """Rows (i, first, kind, v): sums over the rows of products of column i with the columns from `first` on; a task adds up its rows before any of it moves.

    Kinds: 0 values with values; with missing places also 1 presence with presence, 2 values with presence, 3 presence with values, 4 squares with presence, 5 presence with squares.
    """

    def run(frames):
        sums: dict[tuple[int, int, int], np.ndarray] = {}
        for x, there in _batches(frames, np.nan):
            x = np.where(there, x - centre, 0.0)
            forms = {0: (x, x)}
            if not whole:
                present, squares = there.astype(np.float64), x * x
                forms |= {1: (present, present), 2: (x, present), 3: (present, x), 4: (squares, present), 5: (present, squares)}
            for p, q in pairs:
                for kind, (left, right) in forms.items():
                    part = left[:, p * block : (p + 1) * block].T @ right[:, q * block : (q + 1) * block]
                    key = (p, q, kind)
                    sums[key] = sums[key] + part if key in sums else part
        for (p, q, kind), total in sums.items():
            yield pd.DataFrame({"i": np.arange(p * block, p * block + len(total)), "first": q * block, "kind": kind, "v": list(total)})

    return rows.mapInPandas(run, "i int, first int, kind int, v array<double>")


def correlation_blocks(df: DataFrame, columns: Sequence[str] | str, block: int = COLUMNS_PER_BLOCK) -> DataFrame:
    """Rows (i, first, r): the correlations of column i with the `block` columns from `first` on, for blocks not left of i's own; null where a side is constant.

    `columns` names number columns or one array column. Values are centred first, so large means cost no digits. Missing places (null or not finite) leave a pair of
    columns out of a row, as SQL does. Products are made by blocks of rows and columns and added up in each task; neither plan nor result of a task grows with the square of the columns.
    """
    width = len(columns) if not isinstance(columns, str) else df.agg(F.max(F.size(columns))).first()[0] or 0
    rows = df.select((F.array(*[F.col(c).cast("double") for c in columns]) if not isinstance(columns, str) else F.col(columns).cast("array<double>")).alias("x"))
    size = rows.count()
    if not size or not width:
        return df.sparkSession.createDataFrame([], "i int, first int, r array<double>")
    n, centre, varies = _column_totals(rows, width)
    whole = n.min() == size
    blocks = -(-width // block)
    pairs = [(p, q) for p in range(blocks) for q in range(p, blocks)]
    most = max(1, PRODUCT_BYTES // (8 * block * block * (1 if whole else 6)))
    parts = [_products(rows, centre, pairs[a : a + most], block, whole) for a in range(0, len(pairs), most)]
    sums = reduce(DataFrame.unionByName, parts).groupBy("i", "first", "kind").agg(vector_to_array(Summarizer.sum(array_to_vector("v"))).alias("v"))
    changes = lambda j: F.get(F.from_json(F.lit(json.dumps(varies.tolist())), "array<boolean>"), j)
    if whole:
        sums = cut(sums)
        own = sums.filter(F.col("i").between(F.col("first"), F.col("first") + block - 1)).select("i", F.get("v", F.col("i") - F.col("first")).alias("s"))
        squares = [0.0] * width
        for r in own.collect():  # a number a column
            squares[r["i"]] = r["s"]
        of = lambda j: F.get(F.from_json(F.lit(json.dumps(squares)), "array<double>"), j)
        r = F.transform("v", lambda x, t: F.when(changes(F.col("i")) & changes(F.col("first") + t), x / F.sqrt(of(F.col("i")) * of(F.col("first") + t))))
        return sums.select("i", "first", r.alias("r"))
    wide = sums.groupBy("i", "first").agg(*[F.first(F.when(F.col("kind") == k, F.col("v")), ignorenulls=True).alias(c) for k, c in enumerate(["xy", "n", "sx", "sy", "xx", "yy"])])

    def pair(z):
        spread = (z["n"] * z["xx"] - z["sx"] * z["sx"]) * (z["n"] * z["yy"] - z["sy"] * z["sy"])
        return F.when(spread > 0, (z["n"] * z["xy"] - z["sx"] * z["sy"]) / F.sqrt(spread))

    r = F.transform(F.arrays_zip("xy", "n", "sx", "sy", "xx", "yy"), lambda z, t: F.when(changes(F.col("i")) & changes(F.col("first") + t), pair(z)))
    return wide.select("i", "first", r.alias("r"))


def _pairs(df: DataFrame, columns: Sequence[str] | str, keep: Callable[[Column], Column]) -> DataFrame:
    """Rows (i, j, r) with i < j of the pairs `keep` takes, chosen before they become rows."""
    told = F.transform("r", lambda r, t: F.struct((F.col("first") + t).alias("j"), r.alias("r")))
    chosen = F.filter(told, lambda s: (s["j"] > F.col("i")) & keep(s["r"]))
    return correlation_blocks(df, columns).select("i", F.explode(chosen).alias("s")).select("i", "s.j", "s.r")


def _named(columns: Sequence[str] | str) -> Column:
    return F.col("j").cast("string") if isinstance(columns, str) else F.get(F.from_json(F.lit(json.dumps(list(columns))), "array<string>"), F.col("j"))


def correlations(df: DataFrame, columns: Sequence[str] | str) -> DataFrame:
    """R for every column pair i < j; a place of an array column is named by its number."""
    return _pairs(df, columns, lambda r: F.lit(True)).select("i", "j", _named(columns).alias("column"), "r")


def correlated_columns(df: DataFrame, columns: Sequence[str] | str, threshold: float = 0.95) -> DataFrame:
    """The columns with |r| above the threshold to any earlier column, dropped or not."""
    found = _pairs(df, columns, lambda r: F.abs(r) > threshold)
    return found.groupBy(_named(columns).alias("column")).agg(F.max(F.abs("r")).alias("max_r"))


def interactions(t: Column, r: Column, h: Column, high: float = 0.85) -> dict[str, Column]:
    """Six interaction columns of min-max scaled temperature, ratio and hours."""
    return {
        "t_x_ratio": t * r, "t_x_hours": t * h, "ratio_x_hours": r * h,
        "t_squared": t * t, "ratio_squared": r * r, "high_t": (t > high).cast("double"),
    }


def concentrations(base, ratio, equivalents, volume, guard: bool = True) -> dict[str, Column]:
    """Derived concentrations and amounts; with `guard` a ratio that is not positive counts as 1."""
    c, q, e, v = as_column(base), as_column(ratio), as_column(equivalents), as_column(volume)
    q = F.when(q > 0, q).otherwise(F.lit(1.0)) if guard else q
    return {
        "metal_conc": q * c, "mod_conc": e * c, "total_conc": c * (1 + q + e),
        "metal_umol": q * c * v, "linker_umol": c * v, "mod_umol": e * c * v,
    }


def feasibility(temperature, limit, margin: float = 15.0, default: float = 500.0, scale: float = 15.0) -> Column:
    """1 up to the limit, then exponential decay; an unknown limit is `default`."""
    t, top = as_column(temperature), F.coalesce(as_column(limit), F.lit(default)) - margin
    return F.when(t <= top, F.lit(1.0)).otherwise(F.exp(-(t - top) / scale))


def feature_catalog(blocks: DataFrame, kept: DataFrame | None = None) -> DataFrame:
    """Ordered (pos, name, group, is_discrete) from block rows (block_no, prefix, group, width, is_discrete)."""
    laid = running(blocks, [], "block_no", F.xxhash64("prefix"), {"upto": ("sum", "width")})
    spread = laid.select("prefix", "group", "is_discrete", (F.col("upto") - F.col("width")).alias("start"), F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("i"))
    full = spread.select((F.col("start") + F.col("i")).alias("pos"), F.concat("prefix", F.lit("_"), F.col("i").cast("string")).alias("name"), "group", "is_discrete")
    return full if kept is None else full.join(kept, "pos", "left_semi")


def lineage(catalog: DataFrame, steps: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """Follow names through ('select', kept names), ('drop', dropped names) and ('append', new rows) steps."""
    out = catalog
    for kind, table in steps:
        if kind == "select":
            out = out.join(table.select("name"), "name", "left_semi")
        elif kind == "drop":
            out = out.join(table.select("name"), "name", "left_anti")
        elif kind == "append":
            out = out.unionByName(table, allowMissingColumns=True)
        else:
            raise ValueError(f"unknown step {kind}")
    return out


def sanitise_vector(column) -> dict[str, Column]:
    """Vector with non-finite entries set to 0, any-bad flag and bad fraction."""
    v = as_column(column)
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    n_bad = F.size(F.filter(v, bad))
    return {
        "clean": F.transform(v, lambda x: F.when(bad(x), F.lit(0.0)).otherwise(x.cast("double"))),
        "any_bad": (n_bad > 0).cast("double"),
        "bad_fraction": F.coalesce(F.try_divide(n_bad.cast("double"), F.size(v).cast("double")), F.lit(0.0)),
    }


def zero_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """One row: parsed vectors, all-zero ones and their share."""
    zero = F.forall(vector, lambda x: x == 0)
    return df.agg(
        F.count(vector).alias("n_parsed"), F.count_if(zero).alias("n_zero"),
        F.try_divide(F.count_if(zero).cast("double"), F.count(vector).cast("double")).alias("zero_share"),
    )


def zero_vector_examples(df: DataFrame, key: str, vector: str, n: int = 10) -> DataFrame:
    """The first examples."""
    return df.filter(F.forall(vector, lambda x: x == 0)).select(key).orderBy(key).limit(n)


def mutual_information(long: DataFrame, feature: str = "feature", value: str = "value", label: str = "label") -> DataFrame:
    """Plug-in mutual information in nats of a discrete value and a class, per feature, from counts."""
    cells = long.groupBy(feature, value, label).agg(F.count(F.lit(1)).alias("n_xy"))
    per_value = cells.groupBy(feature, value).agg(F.sum("n_xy").alias("n_x"))
    per_label = cells.groupBy(feature, label).agg(F.sum("n_xy").alias("n_y"))
    total = cells.groupBy(feature).agg(F.sum("n_xy").alias("n"))
    joined = cells.join(per_value, [feature, value]).join(per_label, [feature, label]).join(total, feature)
    term = F.col("n_xy") / F.col("n") * F.log(F.col("n_xy") * F.col("n") / (F.col("n_x") * F.col("n_y")))
    return joined.groupBy(feature).agg(F.greatest(F.sum(term), F.lit(0.0)).alias("mi"))


def signal_class(score, strong: float = 0.05, weak: float = 0.01) -> Column:
    """A49."""
    s = as_column(score)
    return F.when(s >= strong, "strong").when(s >= weak, "weak").otherwise("noise")


def survival_report(catalog: DataFrame, after_variance: DataFrame, after_ranking: DataFrame) -> DataFrame:
    """Per feature, whether it survived each selection step."""
    v = after_variance.select("name", F.lit(True).alias("in_variance"))
    r = after_ranking.select("name", F.lit(True).alias("in_ranking"))
    joined = catalog.join(v, "name", "left").join(r, "name", "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(False)) for c in ("in_variance", "in_ranking")})


def stratified_top(scores: DataFrame, stratum: str, budgets: Mapping, score: str, tie: str) -> DataFrame:
    """T5: best rows of each stratum within its own budget; the rank limit is applied before the shuffle."""
    parts = [scores.filter(F.col(stratum) == k).orderBy(F.desc(score), tie).limit(n) for k, n in budgets.items()]
    return reduce(DataFrame.unionByName, parts)


def elbow(scores: DataFrame, score: str, name: str, least: int = 50, most: int | None = None) -> DataFrame:
    """Rank of the largest second difference of the sorted, peak-normalised scores of a feature table.

    Null scores come last. Equal scores are interchangeable, as only ranks come out; rows are numbered by blocks, and a second difference sees two rows before its own.
    """
    rows = scores.select(F.col(score).cast("double").alias("s"), F.xxhash64(name).alias("__t"))
    down = F.coalesce(-F.col("s"), F.lit(float("inf")))
    ranked = running(rows.withColumn("__o", down), [], "__o", "__t", {"rn": ("count", F.lit(1))}, {"n": ("count", F.lit(1)), "peak": ("max", F.col("s"))})
    curve = ranked if most is None else ranked.filter(F.col("rn") <= most)
    around = with_halo(curve.select("s", "rn", "n", "peak"), "rn", 2, 100_000)
    by_rank = W.partitionBy("chunk").orderBy("rn")
    change = F.try_divide(F.col("s") - 2 * F.lag("s", 1).over(by_rank) + F.lag("s", 2).over(by_rank), F.col("peak"))
    second = around.withColumn("d2", change).filter(~F.col("is_halo"))
    best = second.agg(
        F.max("n").alias("n"), F.max("peak").alias("peak"),
        F.min_by("rn", F.when(F.col("d2").isNotNull(), F.struct((-F.col("d2")).alias("k"), F.col("rn")))).alias("third"),
        F.min(F.when(F.col("s") < F.col("peak") * 0.05, F.col("rn") - 1)).alias("below_5pct"),
    ).withColumn("at", F.col("third") - 2)
    cap = F.col("n") if most is None else F.least(F.col("n"), F.lit(most))
    chosen = F.when(F.col("n") <= least, F.col("n")).when(F.col("peak") == 0, cap).otherwise(F.greatest(F.lit(least), F.least(F.coalesce("at", cap), cap)))
    cliff = F.greatest(F.lit(1), F.least(F.coalesce("below_5pct", "n"), F.coalesce("at", "n"), F.col("n")))
    return best.select(chosen.cast("long").alias("elbow"), cliff.cast("long").alias("cliff"))


def binned_information(long: DataFrame, n_bins: int = 10, feature: str = "feature", value: str = "value", label: str = "label") -> DataFrame:
    """Mutual information of a continuous value after equal-frequency binning (an estimate).

    Edges are a table of n_bins - 1 numbers per feature, joined on the feature.
    """
    probs = [i / n_bins for i in range(1, n_bins)]
    edges = quantiles(long, [feature], value, probs).groupBy(feature).agg(F.sort_array(F.collect_list("q")).alias("edges"))
    at = F.size(F.filter("edges", lambda e: e <= F.col(value)))
    binned = long.join(edges, feature).select(feature, at.alias(value), label)
    return mutual_information(binned, feature, value, label)


def concat_blocks(blocks: Sequence[DataFrame], key: str, vectors: Mapping[str, Sequence[str]]) -> DataFrame:
    """Join blocks on the id and put scalar and array columns together into one array per vector.

    Blocks written bucketed by the key join without moving rows.
    """
    wide = reduce(lambda a, b: a.join(b, key), blocks)
    kinds = dict(wide.dtypes)
    part = lambda c: F.col(c) if kinds[c].startswith("array") else F.array(F.col(c).cast("double"))
    return wide.withColumns({name: F.concat(*[part(c) for c in cols]) for name, cols in vectors.items()})


def neighbour_information(long: DataFrame, key: str, k: int = 3, feature: str = "feature", value: str = "value", label: str = "label") -> DataFrame:
    """Mutual information of a continuous value and a class by nearest neighbours on the line.

    Per row the radius is the distance to its k-th nearest value of the same
    class (k at most the class size less one), and m counts the rows of any
    class strictly inside it, itself included. The estimate is
    psi(n) + mean psi(k) - mean psi(class size) - mean psi(m), at least 0; rows
    of classes with one member are left out. Neighbours of a sorted row lie
    within k rows of it, so the search is one scan with a halo of k rows.
    """
    rows = long.select(F.col(key).alias("__id"), F.col(feature).alias("__f"), F.col(label).alias("__c"), F.col(value).cast("double").alias("__x"))
    ordered = number_rows(rows, ["__f", "__c"], "__x", "__id", out="__rn", total="__n", settle=True)
    used = ordered.filter(F.col("__n") > 1)
    around = _both_halos(used, "__rn", k, 100_000)
    order = W.partitionBy("__f", "__c", "chunk").orderBy("__rn")
    gaps = [F.abs(step("__x", i).over(order) - F.col("__x")) for i in range(1, k + 1) for step in (F.lag, F.lead)]
    near = around.withColumn("__gaps", F.array_sort(F.array_compact(F.array(*gaps)))).filter(~F.col("is_halo"))
    near = near.withColumn("__k", F.least(F.lit(k).cast("bigint"), F.col("__n") - 1)).withColumn("__r", F.element_at("__gaps", F.col("__k").cast("int")))
    # rows strictly inside (x - r, x + r): those below x + r, less those not above x - r
    asks = near.select("__id", "__f", "__x", "__k", "__n", F.explode(F.array(
        F.struct(F.lit(1).alias("sign"), (F.col("__x") + F.col("__r")).alias("at")), F.struct(F.lit(-1).alias("sign"), (F.col("__x") - F.col("__r")).alias("at")),
    )).alias("a")).select("__id", "__f", "__x", "__k", "__n", "a.*")
    folded = used.groupBy("__f", F.col("__x").alias("at")).agg(F.count(F.lit(1)).alias("w"))
    events = asks.withColumn("w", F.lit(0).cast("bigint")).unionByName(folded, allowMissingColumns=True)
    # at one position: asks for "below" first, then the values, then asks for "not above"
    tie = F.when(F.col("w") > 0, F.lit(1 << 30)).when(F.col("sign") == 1, F.pmod(F.xxhash64("__id"), F.lit(1 << 30))).otherwise(F.lit((1 << 30) + 1) + F.pmod(F.xxhash64("__id"), F.lit(1 << 30)))
    counted = running(events.withColumn("__tie", tie), ["__f"], "at", "__tie", {"upto": ("sum", "w")})
    inside = counted.filter(F.col("w") == 0).groupBy("__f", "__id").agg(F.sum(F.col("sign") * F.col("upto")).alias("m"), F.max("__k").alias("k"), F.max("__n").alias("n"))
    # with radius 0 no value is strictly inside but the row counts itself and its copies as one
    m = F.greatest(F.col("m"), F.lit(1))
    sums = inside.groupBy("__f").agg(F.count(F.lit(1)).alias("n_all"), F.avg(digamma("k")).alias("pk"), F.avg(digamma("n")).alias("pn"), F.avg(digamma(m)).alias("pm"))
    return sums.select(F.col("__f").alias(feature), F.greatest(digamma("n_all") + F.col("pk") - F.col("pn") - F.col("pm"), F.lit(0.0)).alias("mi"))


def _both_halos(df: DataFrame, rn: str, width: int, chunk: int) -> DataFrame:
    """Copies of edge rows into both neighbouring chunks of row numbers."""
    home, pos = F.floor((F.col(rn) - 1) / chunk), (F.col(rn) - 1) % chunk
    copies = F.array_compact(F.array(home, F.when(pos >= chunk - width, home + 1), F.when(pos < width, home - 1)))
    return df.withColumn("chunk", F.explode(copies)).withColumn("is_halo", F.col("chunk") != home)
