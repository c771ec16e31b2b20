"""Ordered computations over groups of any size.

A plain window puts a whole group into one task. Here a group is cut into
blocks that follow the sort order, each block is scanned on its own, and the
block totals (one small row per group and block) supply the offsets. Rows move
once, on (keys, block); the totals are combined map-side before they move.

Blocks are a pure function of the row, built from value cuts fixed before the
plan is made, so every branch of a plan and every retried task agrees on them.
A value so frequent that it fills whole blocks gets blocks of its own, cut
further by the tie-break column.

Key columns must not be null; order columns must be numeric. Descending order
is ascending order of the negated column.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut

ROWS_PER_BLOCK_CONF = "spark.campanile.rowsPerBlock"
ROWS_PER_BLOCK = 1_000_000
MAX_CUTS = 1_023
SKETCH_ACCURACY = 4_096

_BLOCK = "__scan_block"


def as_column(value) -> Column:
    return value if isinstance(value, Column) else F.col(value)


def rows_per_block(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(ROWS_PER_BLOCK_CONF, str(ROWS_PER_BLOCK)))


def count_at_most(cuts: Sequence[float], column: str, out: str, df: DataFrame, strict: bool) -> DataFrame:
    """Add `out`: how many cuts are below `column` (`strict`) or not above it.

    Binary search over a literal array, one projection per halving.
    """
    if not cuts:
        return df.withColumn(out, F.lit(0))
    size = 1 << len(cuts).bit_length()
    padded = F.array(*[F.lit(c) for c in cuts])
    step = size // 2
    df = df.withColumn(out, F.lit(0))
    while step >= 1:
        at = F.get(padded, F.col(out) + F.lit(step - 1))
        below = at < F.col(column) if strict else at <= F.col(column)
        df = df.withColumn(out, F.when(below, F.col(out) + F.lit(step)).otherwise(F.col(out)))
        step //= 2
    return df


@dataclass(frozen=True)
class Blocks:
    """Cuts of a (primary, tie) order."""

    cuts: tuple = ()
    heavy: tuple = ()
    tie_cuts: tuple = ()

    @property
    def single(self) -> bool:
        return not self.cuts

    @property
    def width(self) -> int:
        return len(self.tie_cuts) + 1

    def attach(self, df: DataFrame, primary: Column, tie: Column | None) -> DataFrame:
        if self.single:
            return df.withColumn(_BLOCK, F.lit(0))
        df = df.withColumn("__scan_p", primary)
        df = count_at_most(self.cuts, "__scan_p", "__scan_c", df, strict=True)
        if not self.heavy:
            return df.withColumn(_BLOCK, F.col("__scan_c") * F.lit(2 * self.width)).drop("__scan_p", "__scan_c")
        is_heavy = F.coalesce(F.col("__scan_p").isin(list(self.heavy)), F.lit(False))
        df = df.withColumn("__scan_t", F.when(is_heavy, tie) if tie is not None else F.lit(None).cast("long"))
        df = count_at_most(self.tie_cuts, "__scan_t", "__scan_s", df, strict=False)
        cell = F.col("__scan_c") * 2 + is_heavy.cast("int")
        return df.withColumn(_BLOCK, cell * F.lit(self.width) + F.col("__scan_s")).drop("__scan_p", "__scan_c", "__scan_t", "__scan_s")


def plan_blocks(df: DataFrame, primary, tie=None) -> Blocks:
    """Choose cuts from one aggregate over the order columns (bounded result)."""
    probs = "array(" + ", ".join(f"{i / (MAX_CUTS + 1)}D" for i in range(1, MAX_CUTS + 1)) + ")"
    order = [as_column(primary).alias("__scan_p")] + ([] if tie is None else [as_column(tie).alias("__scan_t")])
    aggs = [F.count(F.lit(1)).alias("n"), F.expr(f"percentile_approx(__scan_p, {probs}, {SKETCH_ACCURACY})").alias("p")]
    if tie is not None:
        aggs.append(F.expr(f"percentile_approx(__scan_t, {probs}, {SKETCH_ACCURACY})").alias("t"))
    row = df.select(*order).agg(*aggs).first()
    target = rows_per_block(df)
    if row["n"] <= target or not row["p"]:
        return Blocks()
    wanted = min(MAX_CUTS, -(-row["n"] // target) * 2)
    every = max(1, (MAX_CUTS + 1) // (wanted + 1))
    values = row["p"][every - 1 :: every]
    cuts = tuple(sorted(set(values)))
    if tie is None:
        return Blocks(cuts)
    heavy = tuple(sorted({v for v, w in zip(values, values[1:]) if v == w}))
    return Blocks(cuts, heavy, tuple(sorted(set(row["t"][every - 1 :: every]))) if heavy else ())


_KINDS = {
    "sum": (F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))),
    "count": (F.count, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))),
    "max": (F.max, F.greatest),
    "min": (F.min, F.least),
}
# offsets of earlier blocks are themselves added up, not counted
_ROLLUP = {"sum": F.sum, "count": F.sum, "max": F.max, "min": F.min}


def running(
    df: DataFrame,
    keys: Sequence[str],
    primary,
    tie,
    measures: Mapping[str, tuple[str, object]],
    totals: Mapping[str, tuple[str, object]] | None = None,
    blocks: Blocks | None = None,
    settle: bool = False,
) -> DataFrame:
    """Running aggregates from the first row of each group to the current row.

    `measures` maps an output name to (kind, column) with kind one of sum,
    count, max, min. `totals` gives whole-group aggregates from the same pass.

    A scan over several blocks reads its input for the cuts, the totals and the
    rows. Where its result feeds another scan, `settle` writes it once to a
    checkpoint instead of letting the passes multiply.
    """
    keys, totals = list(keys), dict(totals or {})
    primary, tie = as_column(primary), as_column(tie)
    blocks = plan_blocks(df, primary, tie) if blocks is None else blocks
    order = [primary.asc(), tie.asc()]
    if blocks.single:
        scan = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
        whole = W.partitionBy(*keys)
        out = {name: _KINDS[kind][0](as_column(col)).over(scan) for name, (kind, col) in measures.items()}
        out |= {name: _KINDS[kind][0](as_column(col)).over(whole) for name, (kind, col) in totals.items()}
        return df.withColumns(out)
    blocked = blocks.attach(df, primary, tie)
    scan = W.partitionBy(*keys, _BLOCK).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    local = blocked.withColumns({f"__scan_l_{m}": _KINDS[k][0](as_column(c)).over(scan) for m, (k, c) in measures.items()})
    per_block = blocked.groupBy(*keys, _BLOCK).agg(
        *[_KINDS[k][0](as_column(c)).alias(f"__scan_a_{m}") for m, (k, c) in {**measures, **totals}.items()]
    )
    before = W.partitionBy(*keys).orderBy(_BLOCK).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*keys)
    offsets = per_block.select(
        *keys,
        _BLOCK,
        *[_ROLLUP[k](f"__scan_a_{m}").over(before).alias(f"__scan_o_{m}") for m, (k, _) in measures.items()],
        *[_ROLLUP[k](f"__scan_a_{m}").over(whole).alias(m) for m, (k, _) in totals.items()],
    )
    joined = local.join(offsets, [*keys, _BLOCK])
    out = {m: _KINDS[k][1](F.col(f"__scan_l_{m}"), F.col(f"__scan_o_{m}")) for m, (k, _) in measures.items()}
    result = joined.withColumns(out).select(*df.columns, *measures, *totals)
    return cut(result) if settle else result


def number_rows(df: DataFrame, keys: Sequence[str], primary, tie, out: str = "rn", total: str | None = None,
                blocks: Blocks | None = None, settle: bool = False) -> DataFrame:
    """Row number in (primary, tie) order, and the group size when asked."""
    one = F.lit(1)
    return running(df, keys, primary, tie, {out: ("count", one)}, {total: ("count", one)} if total else None, blocks, settle)


def rank_counts(df: DataFrame, keys: Sequence[str], value, tie, lt: str = "n_lt", eq: str = "n_eq", total: str = "n_all",
                rn: str | None = None, blocks: Blocks | None = None, settle: bool = False) -> DataFrame:
    """Per row: how many group members are smaller, how many equal, how many in all; and its row number when asked."""
    keys = list(keys)
    value, tie = as_column(value), as_column(tie)
    blocks = plan_blocks(df, value, tie) if blocks is None else blocks
    df_v = df.withColumns({"__scan_v": value, "__scan_w": tie})
    extra = [rn] if rn else []
    if blocks.single:
        out = {
            lt: (F.rank().over(W.partitionBy(*keys).orderBy("__scan_v")) - 1).cast("long"),
            eq: F.count(F.lit(1)).over(W.partitionBy(*keys, "__scan_v")),
            total: F.count(F.lit(1)).over(W.partitionBy(*keys)),
        }
        if rn:
            out[rn] = F.row_number().over(W.partitionBy(*keys).orderBy("__scan_v", "__scan_w")).cast("long")
        return df_v.withColumns(out).drop("__scan_v", "__scan_w")
    blocked = blocks.attach(df_v, F.col("__scan_v"), F.col("__scan_w"))
    cell = F.floor(F.col(_BLOCK) / blocks.width)
    local = blocked.withColumns({
        "__scan_lt": (F.rank().over(W.partitionBy(*keys, _BLOCK).orderBy("__scan_v")) - 1).cast("long"),
        "__scan_eq": F.count(F.lit(1)).over(W.partitionBy(*keys, _BLOCK, "__scan_v")),
    })
    if rn:
        local = local.withColumn("__scan_rn", F.row_number().over(W.partitionBy(*keys, _BLOCK).orderBy("__scan_v", "__scan_w")))
    per_block = blocked.groupBy(*keys, _BLOCK).agg(F.count(F.lit(1)).alias("__scan_n")).withColumn("__scan_cell", cell)
    by_cell = W.partitionBy(*keys).orderBy("__scan_cell")
    by_block = W.partitionBy(*keys).orderBy(_BLOCK)
    offsets = per_block.select(
        *keys,
        _BLOCK,
        F.col("__scan_cell"),
        F.coalesce(F.sum("__scan_n").over(by_block.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__scan_ahead"),
        F.coalesce(F.sum("__scan_n").over(by_cell.rangeBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__scan_before"),
        F.sum("__scan_n").over(W.partitionBy(*keys, "__scan_cell")).alias("__scan_in_cell"),
        F.sum("__scan_n").over(W.partitionBy(*keys)).alias(total),
    )
    # an odd cell holds one value, spread over several blocks
    heavy = (F.col("__scan_cell") % 2) == 1
    out = {
        lt: F.col("__scan_before") + F.when(heavy, F.lit(0)).otherwise(F.col("__scan_lt")),
        eq: F.when(heavy, F.col("__scan_in_cell")).otherwise(F.col("__scan_eq")),
    }
    if rn:
        out[rn] = F.col("__scan_ahead") + F.col("__scan_rn")
    result = local.join(offsets, [*keys, _BLOCK]).withColumns(out).select(*df.columns, lt, eq, total, *extra)
    return cut(result) if settle else result


def average_rank(lt: str = "n_lt", eq: str = "n_eq") -> Column:
    """Rank with ties sharing their mean, from `rank_counts` columns."""
    return F.col(lt) + (F.col(eq) + 1) / F.lit(2.0)


def with_halo(df: DataFrame, rn: str, before: int, chunk: int, out: str = "chunk") -> DataFrame:
    """Copy the last `before` rows of each chunk of row numbers into the next chunk.

    Lets trailing frames and lags run per (keys, chunk) and still see the rows
    just before the chunk. Rows where `is_halo` is true are the copies.
    """
    home = F.floor((F.col(rn) - 1) / chunk)
    pos = (F.col(rn) - 1) % chunk
    copies = F.when(pos >= chunk - before, F.array(home, home + 1)).otherwise(F.array(home))
    return df.withColumn(out, F.explode(copies)).withColumn("is_halo", F.col(out) != home)


def lagged(df: DataFrame, keys: Sequence[str], value: str, rn: str, out: str, chunk: int = 100_000) -> DataFrame:
    """Value of the previous row of the group; `rn` numbers the rows from 1 without gaps."""
    wide = with_halo(df, rn, 1, chunk)
    order = W.partitionBy(*keys, "chunk").orderBy(rn)
    return wide.withColumn(out, F.lag(value).over(order)).filter(~F.col("is_halo")).drop("chunk", "is_halo")
