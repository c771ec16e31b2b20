"""Neighbour and pair diagnostics on vectors.

Distances are computed by tiles: rows are cut into blocks of bounded size, a
tile is a pair of blocks, and a task turns one tile into a small result (the
nearest rows, or sums per distance bin). Pairs never become rows. Spark
partitions and shuffles the blocks; NumPy does the arithmetic inside a tile.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.hashing import draw, long_draw
from ..functions.numeric import euclidean
from ..functions.scan import number_rows, running
from ..session import cut

ROWS_PER_BLOCK = 4_096
# blocks grow with the table up to these bytes: what moves grows with the number of blocks
BLOCK_BYTES = 64 << 20
LEAST_ROWS = 16_384
ASKING_ROWS = 32_768
PIVOT_BYTES = 64 << 20
HISTOGRAM = 1 << 18
# rows and columns of a piece of a tile that is worked out at once; its arrays should stay in a core's cache
PIECE = (128, 1_024)
# parts over which the tiles are dealt, a tile each while there are no more
TILE_PARTS = 1_024


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, 0))


def _packed(column: pd.Series) -> pd.Series:
    return column.map(lambda v: np.asarray(v, dtype=np.float64).tobytes())


def _unpacked(column: pd.Series) -> np.ndarray:
    if column.map(len).nunique() > 1:
        raise ValueError("vectors of different lengths")
    return np.frombuffer(b"".join(column), dtype=np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _distances(a: np.ndarray, b: np.ndarray):
    """Row blocks of the distance matrix between two tiles, from plain differences."""
    step = max(1, 8_000_000 // max(1, b.size))
    for start in range(0, len(a), step):
        gap = a[start : start + step, None, :] - b[None, :, :]
        yield start, np.sqrt(np.einsum("ijk,ijk->ij", gap, gap))


def _squares(a: np.ndarray, b: np.ndarray):
    """Row blocks of squared distances by matrix products, and what rounding may put them off by. They are for leaving pairs out; what counts is worked out by `_between`."""
    na, nb = np.square(a).sum(axis=1), np.square(b).sum(axis=1)
    off = 8 * np.finfo(np.float64).eps * (a.shape[1] + 8) * (na.max() + nb.max())
    step = max(1, 1_000_000 // len(b))
    for start in range(0, len(a), step):
        d = a[start : start + step] @ b.T
        d *= -2
        d += na[start : start + step, None]
        d += nb[None, :]
        yield start, d, off


def _between(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Distances of single pairs of rows from plain differences, added up position by position."""
    out = np.zeros(len(i))
    for start in range(0, len(i), 2_000):
        part = slice(start, start + 2_000)
        for gap in np.ascontiguousarray((a[i[part]] - b[j[part]]).T):
            out[part] += gap * gap
    return np.sqrt(out)


def _cells(reps: DataFrame, centres: np.ndarray, kind: str) -> DataFrame:
    """Add the cell of each row (its nearest pivot, counted on per group) and the distance to the pivot."""

    def run(frames):
        for frame in frames:
            x = _matrix(frame["vec"])
            best, near = np.zeros(len(frame), dtype=np.int64), np.zeros(len(frame))
            for start, d in _distances(x, centres) if len(frame) else ():
                at = d.argmin(axis=1)
                best[start : start + len(d)], near[start : start + len(d)] = at, d[np.arange(len(d)), at]
            yield frame.assign(cell=frame["grp"].to_numpy() * len(centres) + best, near=near)

    return reps.select("id", "grp", "vec", "asks").mapInPandas(run, f"id {kind}, grp int, vec array<double>, asks boolean, cell long, near double")


def _first(i: np.ndarray, j: np.ndarray, distance: np.ndarray, k: int) -> np.ndarray:
    """Places of the k least of each row i, rows in order, the first column j of equals first."""
    order = np.lexsort((j, distance, i))
    rows = i[order]
    return order[np.arange(len(rows)) - np.searchsorted(rows, rows) < k]


def _inside(blocks: DataFrame, k: int, kind: str) -> DataFrame:
    """Every row's k nearest within its own block, and the distance of the last of them: no row farther off can be among its k nearest."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id", ignore_index=True)
        x, names = _matrix(frame["vec"]), frame["id"].to_numpy()
        near, far, bound, most = [], [], [], min(k, len(x) - 1)
        for start, d, off in _squares(x, x):
            own = start + np.arange(len(d))
            d[np.arange(len(d)), own] = np.inf
            limit = np.partition(d, most - 1, axis=1)[:, most - 1] + 2 * off if most else np.full(len(d), -np.inf)
            i, j = np.nonzero(~(d > limit[:, None]))
            i, j = i[own[i] != j], j[own[i] != j]
            exact = _between(x, x, start + i, j)
            at = _first(i, j, exact, most).reshape(len(d), most)
            near += list(names[j[at]])
            far += list(exact[at])
            bound += list(exact[at][:, -1] if most == k else np.full(len(d), np.inf))
        asks = frame["asks"].to_numpy(dtype=bool)
        return frame[["id", "grp", "vec", "block"]].assign(neighbours=near, distances=far, bound=np.where(asks, bound, -1.0))

    return blocks.groupBy("block").applyInPandas(run, f"id {kind}, grp int, vec array<double>, block long, neighbours array<{kind}>, distances array<double>, bound double")


def _asks(inside: DataFrame, centres: np.ndarray, told: pd.DataFrame, kind: str) -> DataFrame:
    """Rows that have to be compared with other blocks, and those blocks: a ring about a pivot is asked if it comes as near as the row's bound."""
    key, cell, low, high = (told[c].to_numpy() for c in ("block", "cell", "low", "high"))
    pivot, group = cell % len(centres), cell // len(centres)

    def run(frames):
        for frame in frames:
            frame = frame[frame["bound"] >= 0].reset_index(drop=True)
            x, asked = _matrix(frame["vec"]), []
            step = max(1, 4_000_000 // len(key))
            for begin in range(0, len(frame), step):
                part = frame.iloc[begin : begin + step]
                to = np.concatenate([d for _, d in _distances(x[begin : begin + step], centres)])[:, pivot]
                reach = part["bound"].to_numpy()[:, None] * (1 + 1e-9) + 1e-9
                meets = (to - high <= reach) & (low - to <= reach) & (group == part["grp"].to_numpy()[:, None]) & (key != part["block"].to_numpy()[:, None])
                asked += [key[m] for m in meets]
            yield frame[["id", "vec", "bound"]].assign(blocks=asked)

    return inside.select("id", "grp", "vec", "block", "bound").mapInPandas(run, f"id {kind}, vec array<double>, bound double, blocks array<long>")


def _across(asks: DataFrame, blocks: DataFrame, k: int, rows_per_block: int, kind: str) -> DataFrame:
    """For every row and block it asks, the k nearest rows there that its bound lets in. A block asked by many is sent once for every few thousand of them."""
    asked = asks.select("id", "vec", "bound", F.explode("blocks").alias("block"))
    salts = asked.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / min(4 * rows_per_block, ASKING_ROWS)).cast("int").alias("salts"))
    left = asked.join(salts, "block").withColumn("salt", F.pmod(F.xxhash64("id"), "salts"))
    right = blocks.select("block", F.col("id").alias("id_q"), F.col("vec").alias("vec_q")).join(salts, "block")
    right = right.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("salts") - 1).cast("long"))))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"id": left["id"][:0], "neighbour": left["id"][:0], "distance": np.zeros(0)})]
        if len(left) and len(right):
            right = right.sort_values("id_q", ignore_index=True)
            ids, names, bound = left["id"].to_numpy(), right["id_q"].to_numpy(), left["bound"].to_numpy() * (1 + 1e-9) + 1e-9
            x, y = _matrix(left["vec"]), _matrix(right["vec_q"])
            for start, d, off in _squares(x, y):
                within = bound[start : start + len(d)]
                limit = within * within + off
                if np.isinf(within).any() and k < d.shape[1]:
                    limit = np.minimum(limit, np.partition(d, k - 1, axis=1)[:, k - 1] + 2 * off)
                i, j = np.nonzero(~(d > limit[:, None]))
                found = _between(x, y, start + i, j)
                i, j, found = (part[found <= within[i]] for part in (i, j, found))
                at = _first(i, j, found, k)
                out.append(pd.DataFrame({"id": ids[start + i[at]], "neighbour": names[j[at]], "distance": found[at]}))
        return pd.concat(out, ignore_index=True)

    # the work of a part is not in its bytes, so parts of few bytes must not be put together: their number is given
    parts = 4 * int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left, right = (x.repartition(parts, "block", "salt") for x in (left.select("id", "vec", "bound", "block", "salt"), right.select("id_q", "vec_q", "block", "salt")))
    columns = left.groupBy("block", "salt").cogroup(right.groupBy("block", "salt"))
    return columns.applyInPandas(run, f"id {kind}, neighbour {kind}, distance double")


def nearest_neighbours(df: DataFrame, key: str, vector: str, k: int, rows_per_block: int | None = None, pivots: int | None = None,
                       within: str | None = None, groups: Sequence = ()) -> DataFrame:
    """Exact k nearest other rows by Euclidean distance: (id, neighbour, distance, rank); ids must be unique and break ties.

    With `within` only rows of one of the `groups` are used, and neighbours come from the row's own group.

    Rows of one vector are one row with the least k + 1 of their ids, so many copies cost nothing. Rows go to the cell of their nearest pivot; a cell is cut into
    rings of bounded size by the distance from the pivot. A first pass compares the rows of a ring with one another: the k-th distance there bounds what can still
    be among the k nearest. A second pass sends a row to those rings only that come as near as its bound (triangle inequality), so no result is lost.

    Where no ring can be left out, a row meets every ring, so there are few: a block holds an eighth of a group's rows, up to `BLOCK_BYTES`, unless `rows_per_block`
    is given, and there are about four cells a block. Pairs are left out by matrix products with a margin for rounding; the rest is worked out from differences.
    Pivots are at most the square root of the rows (and `PIVOT_BYTES`, which every task holds), and the driver keeps four numbers a ring.
    """
    kind, group = dict(df.dtypes)[key], F.lit(0)
    if within is not None:
        df = df.filter(F.col(within).isin(list(groups)))
        group = F.element_at(F.create_map(*[x for i, g in enumerate(groups) for x in (F.lit(g), F.lit(i))]), F.col(within))
    rows = df.select(F.col(key).alias("id"), group.cast("int").alias("grp"), F.col(vector).cast("array<double>").alias("vec"))
    first = rows.withColumn("rn", F.row_number().over(W.partitionBy("grp", "vec").orderBy("id"))).filter(F.col("rn") <= k + 1)
    same = first.groupBy("grp", "vec").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    reps = cut(same.withColumn("id", F.get("ids", F.lit(0))).withColumn("asks", F.size("ids") <= k))
    told = reps.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("width")).first()
    if not told["n"]:
        raise ValueError("no rows")
    parts = max(1, len(groups))
    if rows_per_block is None:
        rows_per_block = max(1, min(max(LEAST_ROWS, told["n"] // (8 * parts)), BLOCK_BYTES // (8 * max(1, told["width"]))))
    # a cell, the rows of a group about a pivot, should fill a good part of a block, or blocks become many and tiny
    most = min(math.isqrt(told["n"]), 4 * told["n"] // (rows_per_block * parts), PIVOT_BYTES // (8 * told["width"])) if pivots is None else pivots
    chosen = reps.select("id", "grp", "vec", draw("id", "grp").alias("d")).orderBy("d", "id", "grp").limit(max(1, most)).collect()
    centres = np.array([r["vec"] for r in chosen])

    ringed = number_rows(_cells(reps, centres, kind), ["cell"], "near", F.xxhash64("id"), out="rn")
    block = F.shiftleft(F.col("cell"), 24) + F.floor((F.col("rn") - 1) / rows_per_block)
    blocks = cut(ringed.withColumn("block", block.cast("long")).select("id", "grp", "vec", "asks", "block", "cell", "near"))
    rings = blocks.groupBy("block").agg(F.max("cell").alias("cell"), F.min("near").alias("low"), F.max("near").alias("high")).toPandas()
    inside = cut(_inside(blocks.select("id", "grp", "vec", "asks", "block"), k, kind))
    asks = cut(_asks(inside, centres, rings, kind))
    own = inside.filter("bound >= 0").select("id", F.explode(F.arrays_zip("neighbours", "distances")).alias("n")).select("id", F.col("n.neighbours").alias("neighbour"), F.col("n.distances").alias("distance"))
    best = W.partitionBy("id").orderBy("distance", "neighbour")
    found = own.unionByName(_across(asks, blocks, k, rows_per_block, kind)).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)

    # from vectors back to rows: copies are at distance 0, and any copy of a near vector is as near
    copies = reps.select(F.col("id").alias("neighbour"), F.col("ids").alias("others"))
    near = found.join(copies, "neighbour").groupBy("id").agg(F.collect_list(F.struct("distance", "others")).alias("near"))
    others = lambda x: F.transform(x["others"], lambda o: F.struct(x["distance"].alias("distance"), o.alias("neighbour")))
    alike = F.transform("ids", lambda o: F.struct(F.lit(0.0).alias("distance"), o.alias("neighbour")))
    listed = F.array_sort(F.concat(alike, F.flatten(F.transform(F.coalesce("near", F.array().cast(near.schema["near"].dataType)), others))))
    answers = reps.join(near, "id", "left").select("grp", "vec", listed.alias("listed"))
    each = rows.join(answers, ["grp", "vec"]).select("id", F.posexplode(F.slice(F.filter("listed", lambda x: x["neighbour"] != F.col("id")), 1, k)).alias("at", "n"))
    return each.select("id", F.col("n.neighbour").alias("neighbour"), F.col("n.distance").alias("distance"), (F.col("at") + 1).cast("int").alias("rank"))


def label_agreement(neighbours: DataFrame, labels: DataFrame, key: str, label: str) -> DataFrame:
    """C14: per row the share of its neighbours with its own label."""
    own = labels.select(F.col(key).alias("id"), F.col(label).alias("own"))
    other = labels.select(F.col(key).alias("neighbour"), F.col(label).alias("other"))
    joined = neighbours.join(own, "id").join(other, "neighbour")
    return joined.groupBy("id").agg(F.avg((F.col("own") == F.col("other")).cast("double")).alias("agreement"))


def agreement_verdict(agreement: DataFrame, threshold: float = 0.70) -> DataFrame:
    """C14: the mean over rows and whether it passes."""
    return agreement.agg(F.avg("agreement").alias("mean_agreement")).withColumn("passes", F.col("mean_agreement") >= threshold)


def sampled_pairs(df: DataFrame, key: str, vector: str, y: str, n_pairs: int = 2_000, seed: int = 42) -> DataFrame:
    """Exactly `n_pairs` distinct random pairs with their distance and |dy|, or all when there are no more.

    Four times as many pairs are drawn as two row numbers, and the first distinct
    ones in a hashed order stay; a table with hardly more pairs than that offers
    all of them. The work is one numbering scan and two joins with the draws; no
    other pair is ever formed.
    """
    rows = number_rows(df.select(F.col(key).alias("id"), F.col(vector).alias("vec"), F.col(y).cast("double").alias("y")), [], "id", F.lit(0))
    n = rows.count()
    if n * (n - 1) // 2 <= 4 * n_pairs:
        later = F.explode(F.sequence(F.col("i") + 1, F.lit(n)))
        offered = df.sparkSession.range(1, n).select(F.col("id").alias("i")).select("i", later.alias("j"))
    else:
        number = lambda side: (long_draw("id", F.lit(seed), F.lit(side)) % n + 1).alias(side)
        drawn = df.sparkSession.range(4 * n_pairs).select(number("a"), number("b"))
        offered = drawn.filter("a <> b").select(F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j")).distinct()
    pairs = offered.orderBy(long_draw("i", "j", F.lit(seed)), "i", "j").limit(n_pairs)
    left = rows.select(F.col("rn").alias("i"), F.col("id").alias("id_a"), F.col("vec").alias("va"), F.col("y").alias("ya"))
    right = rows.select(F.col("rn").alias("j"), F.col("id").alias("id_b"), F.col("vec").alias("vb"), F.col("y").alias("yb"))
    joined = pairs.join(left, "i").join(right, "j")
    return joined.select("id_a", "id_b", euclidean("va", "vb").alias("distance"), F.abs(F.col("ya") - F.col("yb")).alias("dy"))


# ---- sums over all pairs -----------------------------------------------------------------


def _over_pairs(df: DataFrame, key: str, vector: str, y: str, rows_per_block: int | None, work, schema: str) -> DataFrame:
    """Apply `work(x, y of x, z, y of z, same)` to every tile of two blocks and add up what it returns by its columns but n and s2. Rows come in the order of y; of a block with itself (`same`) only pairs i < j count.

    Without `rows_per_block` a block holds a 32nd of the rows within bounds, so what moves grows with the rows.
    """
    rows = df.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("vec"), F.col(y).cast("double").alias("y"))
    told = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("width")).first()
    if rows_per_block is None:
        rows_per_block = max(1, min(max(ROWS_PER_BLOCK, told["n"] // 32), BLOCK_BYTES // (32 * max(1, told["width"] or 1))))
    blocks = max(1, -(-told["n"] // rows_per_block))
    # a vector is copied to every tile of its block, so it is made bytes once and moves as these; a table of few files is dealt out before
    spread = 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocked = rows.repartition(spread, "id").select("id", F.pandas_udf(_packed, "binary")("vec").alias("vec"), "y", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"))
    later, earlier = F.explode(F.sequence(F.col("block"), F.lit(blocks - 1))), F.explode(F.sequence(F.lit(0), F.col("block")))
    left = blocked.select(F.col("block").alias("a"), later.alias("b"), "id", "vec", "y")
    right = blocked.select(earlier.alias("a"), F.col("block").alias("b"), *[F.col(c).alias(f"{c}_q") for c in ("id", "vec", "y")])

    def tile(keys, p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        p, q = p.sort_values(["y", "id"], ignore_index=True), q.sort_values(["y_q", "id_q"], ignore_index=True)
        return work(_unpacked(p["vec"]), p["y"].to_numpy(), _unpacked(q["vec_q"]), q["y_q"].to_numpy(), keys[0] == keys[1])

    # the work of a tile is not in its bytes, so tiles must not be put together by these: the number of parts is given. Parts get tiles by a hash, so many small parts fill the cores more evenly
    parts = min(blocks * (blocks + 1) // 2, max(TILE_PARTS, spread))
    left, right = (x.repartition(parts, "a", "b") for x in (left, right))
    return left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInPandas(tile, schema)


def _spans(y: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Places from and to of pieces of at most `size` rows; where runs of equal y are long, no piece has two of them."""
    ends = np.flatnonzero(y[1:] != y[:-1]) + 1
    runs = [0, *(ends if len(y) >= 256 * (len(ends) + 1) else []), len(y)]
    return [(start, min(start + size, end)) for begin, end in zip(runs, runs[1:]) for start in range(begin, end, size)]


def _pieces(yp: np.ndarray, yq: np.ndarray, same: bool):
    """Pieces (rows from, to, columns from, to) of a tile that hold a pair, a list for each piece of the columns."""
    rows = _spans(yp, PIECE[0])
    for first, last in _spans(yq, PIECE[1]):
        yield [(top, bottom, first, last) for top, bottom in rows if not same or last - 1 > top]


def _factors(x: np.ndarray, z: np.ndarray, kind) -> tuple[np.ndarray, np.ndarray, float]:
    """Two matrices of `kind` whose product is the squared distances, and twice what rounding may put these off by."""
    nx, nz = np.square(x).sum(axis=1), np.square(z).sum(axis=1)
    left = np.column_stack([x, nx, np.ones(len(x))]).astype(kind)
    right = np.vstack([-2 * z.T, np.ones(len(z)), nz]).astype(kind)
    return left, right, 2 * float(np.finfo(kind).eps) * (x.shape[1] + 8) * (nx.max() + nz.max())


def _count_slots(x, yp, z, yq, same: bool, centre: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs and sums of dy^2 of a tile by slot of the distance. Slots come from a matrix product where it leaves no doubt, else from plain differences."""
    n, s2, held = np.zeros(HISTOGRAM + 2, dtype=np.int64), np.zeros(HISTOGRAM + 2), {}
    left, right, off = _factors((x - centre) / width, (z - centre) / width, np.float64)
    off *= 4
    near = 2 * off + 1e-6
    room, places, less = np.empty((2, PIECE[0] * PIECE[1])), np.empty(PIECE[0] * PIECE[1], dtype=np.int64), np.empty(PIECE[0] * PIECE[1], dtype=bool)

    def fold():
        for weight, counts in held.items():
            np.add(n, counts, out=n)
            np.add(s2, counts * weight, out=s2)
        held.clear()

    for pieces in _pieces(yp, yq, same):
        for top, bottom, first, last in pieces:
            shape = bottom - top, last - first
            d, rest, slot, small = (r[: shape[0] * shape[1]].reshape(shape) for r in (*room, places, less))
            np.matmul(left[top:bottom], right[:, first:last], out=d)
            np.sqrt(np.abs(d, out=d), out=d)
            np.copyto(slot, d, casting="unsafe")
            np.subtract(np.rint(d, out=rest), d, out=rest)
            doubt = np.flatnonzero(np.less(np.abs(rest, out=rest), near, out=small))
            v2 = np.square(d.ravel()[doubt])
            doubt = doubt[np.floor(np.sqrt(np.maximum(v2 - off, 0))) != np.floor(np.sqrt(v2 + off))]
            if len(doubt):
                i, j = np.divmod(doubt, shape[1])
                slot[i, j] = (_between(x, z, top + i, first + j) / width).astype(np.int64)
            if same and first < bottom:
                # pairs i >= j go to the last place, which is no slot
                slot[np.arange(first, last)[None, :] <= np.arange(top, bottom)[:, None]] = HISTOGRAM + 1
            if yp[top] == yp[bottom - 1] and yq[first] == yq[last - 1]:
                weight = (yp[top] - yq[first]) ** 2
                if weight not in held:
                    if len(held) == 16:
                        fold()
                    held[weight] = np.zeros(HISTOGRAM + 2, dtype=np.int64)
                np.add.at(held[weight], slot.ravel(), 1)
            else:
                np.square(np.subtract.outer(yp[top:bottom], yq[first:last], out=rest), out=rest)
                np.add.at(n, slot.ravel(), 1)
                np.add.at(s2, slot.ravel(), rest.ravel())
    fold()
    return n[:-1], s2[:-1]


def _slot_values(x, yp, z, yq, same: bool, centre: np.ndarray, width: float, wanted: np.ndarray) -> pd.DataFrame:
    """The distinct distances of a tile within the slots that are `wanted`, with pairs and sums of dy^2. Products of single precision leave out pairs that are surely elsewhere."""
    left, right, off = _factors((x - centre) / width, (z - centre) / width, np.float32)
    # cells of equal squared distance that may hold a pair of a wanted slot
    ends = np.flatnonzero(np.diff(np.concatenate([[False], wanted, [False]]).astype(np.int8))).astype(float)
    scale = HISTOGRAM / (HISTOGRAM + 2.0) ** 2
    meets = np.zeros(HISTOGRAM + HISTOGRAM // 8, dtype=bool)
    for low, high in zip(ends[::2], ends[1::2]):
        meets[int(max(0, (low * low - off) * scale - 1)) : int((high * high + off) * scale + 2)] = True
    room, cells, less = np.empty(PIECE[0] * PIECE[1], dtype=np.float32), np.empty(PIECE[0] * PIECE[1], dtype=np.int64), np.empty(PIECE[0] * PIECE[1], dtype=bool)
    out = []
    for pieces in _pieces(yp, yq, same):
        rows, columns = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for top, bottom, first, last in pieces:
            shape = bottom - top, last - first
            d, cell, some = (r[: shape[0] * shape[1]].reshape(shape) for r in (room, cells, less))
            np.matmul(left[top:bottom], right[:, first:last], out=d)
            np.abs(d, out=d)
            d *= np.float32(scale)
            np.copyto(cell, d, casting="unsafe")
            i, j = np.divmod(np.flatnonzero(meets.take(cell, out=some, mode="clip")), shape[1])
            rows.append(top + i)
            columns.append(first + j)
        i, j = np.concatenate(rows), np.concatenate(columns)
        if same:
            i, j = i[i < j], j[i < j]
        exact = _between(x, z, i, j)
        sure = wanted[(exact / width).astype(np.int64)]
        value, at = np.unique(exact[sure], return_inverse=True)
        s2 = np.bincount(at, weights=np.square(yp[i[sure]] - yq[j[sure]]), minlength=len(value))
        out.append(pd.DataFrame({"slot": (value / width).astype(np.int64), "value": value, "n": np.bincount(at, minlength=len(value)), "s2": s2}))
    return pd.concat(out, ignore_index=True).groupby(["slot", "value"], as_index=False).sum()


class PairDistances:
    """Order statistics and sums of dy^2 of all pair distances, exact, from two passes over the pairs.

    The first counts pairs and sums dy^2 by `HISTOGRAM` equal slots of the distance. The second gives the distinct distances of a few slots. Distances come from matrix products
    where these leave no doubt about the slot, and from plain differences for all other pairs and for those of the second pass.
    """

    def __init__(self, df: DataFrame, key: str, vector: str, y: str, rows_per_block: int | None = None):
        self.args = (df, key, vector, y, rows_per_block)
        first = df.select(F.col(vector).cast("array<double>").alias("v")).orderBy(key).limit(1)
        far = df.withColumn("__v", first.scalar()).agg(F.count(F.lit(1)).alias("n"), F.max(euclidean(vector, "__v")).alias("r"), F.first("__v").alias("centre")).first()
        self.n_pairs = far["n"] * (far["n"] - 1) // 2
        self.width = width = max(2 * (far["r"] or 0.0), 1e-12) * (1 + 1e-9) / HISTOGRAM
        self.centre = centre = np.array(far["centre"] or [], dtype=np.float64)

        def work(x, yp, z, yq, same):
            n, s2 = _count_slots(x, yp, z, yq, same, centre, width) if len(x) and len(z) else (np.zeros(0, dtype=np.int64), np.zeros(0))
            some = np.flatnonzero(n)
            return pd.DataFrame({"slot": some, "n": n[some], "s2": s2[some]})

        counts = _over_pairs(*self.args, work, "slot long, n long, s2 double")
        told = counts.groupBy("slot").agg(F.sum("n").alias("n"), F.sum("s2").alias("s2"))
        # about HISTOGRAM rows at most
        self.slots = told.toPandas().sort_values("slot", ignore_index=True)
        self.before = np.concatenate([[0], np.cumsum(self.slots["n"].to_numpy())])
        self.fine: DataFrame | None = None
        self.looked_at = np.zeros(len(self.slots), dtype=bool)

    def slot_of(self, positions: np.ndarray) -> np.ndarray:
        """Rows of the histogram that hold positions of the sorted distances."""
        return np.searchsorted(self.before, positions, "right") - 1

    def refine(self, spans: Sequence[tuple[int, int]]) -> None:
        """The second pass: the distinct distances of all slots that hold one of the positions from the first to the last of a span."""
        for low, high in spans:
            first, last = self.slot_of(np.array([low, high]))
            self.looked_at[first : last + 1] = True
        width, centre, keep = self.width, self.centre, self.slots["slot"].to_numpy()[self.looked_at]
        wanted = np.zeros(HISTOGRAM + 2, dtype=bool)
        wanted[keep] = True

        def work(x, yp, z, yq, same):
            if not len(x) or not len(z):
                return pd.DataFrame({"slot": np.zeros(0, dtype=np.int64), "value": np.zeros(0), "n": np.zeros(0, dtype=np.int64), "s2": np.zeros(0)})
            return _slot_values(x, yp, z, yq, same, centre, width, wanted)

        if len(keep):
            values = _over_pairs(*self.args, work, "slot long, value double, n long, s2 double")
            self.fine = cut(values.groupBy("slot", "value").agg(F.sum("n").alias("n"), F.sum("s2").alias("s2")))

    def at(self, positions: Sequence[int]) -> dict[int, float]:
        """The distances at positions (from 0) of the sorted list, whose slots must have been refined."""
        wanted = np.unique(np.array(positions, dtype=np.int64))
        slots = self.slot_of(wanted)
        out: dict[int, float] = {}
        rest = [(int(self.slots["slot"][s]), int(p), int(p - self.before[s])) for p, s in zip(wanted, slots)]
        if rest:
            hits = F.array(*[F.struct(F.lit(s).cast("long").alias("slot"), F.lit(p).cast("long").alias("pos"), F.lit(k).cast("long").alias("at")) for s, p, k in rest])
            scanned = running(self.fine, ["slot"], "value", F.lit(0), {"upto": ("sum", "n")}).withColumn("h", F.explode(hits))
            found = scanned.filter((F.col("h.slot") == F.col("slot")) & (F.col("h.at") < F.col("upto")) & (F.col("h.at") >= F.col("upto") - F.col("n")))
            out |= {r["pos"]: r["value"] for r in found.select("h.pos", "value").collect()}
        return out

    def quantile(self, positions: Sequence[float]) -> list[float]:
        """Linear interpolation at fractional positions."""
        low = [int(np.floor(h)) for h in positions]
        at = self.at([*low, *(min(k + 1, self.n_pairs - 1) for k in low)])
        return [at[k] + (at[min(k + 1, self.n_pairs - 1)] - at[k]) * (h - k) for h, k in zip(positions, low)]

    def sums(self, edges: np.ndarray) -> dict[int, tuple[int, float]]:
        """Per bin (how many edges are at or below a distance): pairs and sum of dy^2."""
        out: dict[int, list] = {}
        rough = self.slots[~self.looked_at]
        # no edge lies within a slot that was not looked at
        told = list(zip(np.digitize((rough["slot"] + 0.5) * self.width, edges), rough["n"], rough["s2"]))
        if self.fine is not None:
            at = F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e <= F.col("value")))
            told += [(r["bin"], r["n"], r["s2"]) for r in self.fine.groupBy(at.alias("bin")).agg(F.sum("n").alias("n"), F.sum("s2").alias("s2")).collect()]
        for k, n, s2 in told:
            total = out.setdefault(int(k), [0, 0.0])
            total[0], total[1] = total[0] + int(n), total[1] + float(s2)
        return {k: tuple(v) for k, v in out.items()}


def semivariogram(df: DataFrame, key: str, vector: str, y: str, n_bins: int = 10, least: int = 3, rows_per_block: int | None = None, medians: bool = True) -> DataFrame:
    """Per equal-frequency distance bin over all pairs: pairs, median distance (null without `medians`), mean(dy^2) / 2.

    All pairs are formed twice. After the first pass it is known between which positions each edge and each median lies; the second looks at the slots that hold these.
    """
    pairs = PairDistances(df, key, vector, y, rows_per_block)
    last = pairs.n_pairs - 1
    out = []
    if last >= 0:
        cuts = [last * i / n_bins for i in range(n_bins + 1)]
        low = [int(np.floor(h)) for h in cuts]
        spans = [(k, min(k + 1, last)) for k in low]
        # pairs below an edge: those of the slots before its own at least, and those up to its position at most
        least_below, most_below = pairs.before[pairs.slot_of(np.array(low))], np.array(low) + 1
        for i in range(n_bins if medians else 0):
            first, final = least_below[i] + least_below[i + 1] - 1, most_below[i] + most_below[i + 1] - 1
            spans.append((max(0, first // 2), min(last, -(-final // 2) + 1)))  # a quantile also reads the position after its own
        pairs.refine(spans)
        edges = np.array(pairs.quantile(cuts))
        sums, before, centre = pairs.sums(edges), 0, {}
        for k in sorted(sums):
            n = sums[k][0]
            if 1 <= k <= n_bins and n >= least:
                centre[k] = before + (n - 1) / 2
            before += n
        middle = pairs.quantile(list(centre.values())) if centre and medians else [None] * len(centre)
        out = [(k, sums[k][0], m if m is None else float(m), float(sums[k][1] / sums[k][0] / 2)) for k, m in zip(centre, middle)]
    return df.sparkSession.createDataFrame(out, "bin int, n long, median_distance double, semivariance double")


def sill_verdict(bins: DataFrame) -> DataFrame:
    """Share of rising steps in the first half, variation of the second half, and the sill test (one row per bin in)."""
    order = W.orderBy("bin")
    ranked = bins.withColumns({"rn": F.row_number().over(order), "previous": F.lag("semivariance").over(order), "m": F.count(F.lit(1)).over(W.partitionBy())})
    mid = F.floor(F.col("m") / 2)
    row = ranked.agg(
        F.coalesce(F.avg(F.when((F.col("rn") <= mid + 1) & F.col("previous").isNotNull(), (F.col("semivariance") > F.col("previous")).cast("double"))), F.lit(0.0)).alias("rising"),
        (F.stddev_pop(F.when(F.col("rn") > mid, F.col("semivariance"))) / (F.avg(F.when(F.col("rn") > mid, F.col("semivariance"))) + 1e-9)).alias("flat"),
    )
    return row.withColumn("has_sill", (F.col("rising") >= 0.5) & (F.col("flat") < 0.25))
