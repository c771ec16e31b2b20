"""Contiguous shards of least greatest size over ordered groups that stay whole."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from campanile.session import cut

#: Group starts looked at in one round of the search, however many there are: each stands for those near it.
STARTS = 65_536


class Starts:
    """What the driver knows of where groups start, in bytes before them: some starts, the rows before each, and which gaps between neighbours hold no others."""

    def __init__(self, total: int, rows: int):
        self.at, self.closed, self.rows = [0, total], [total <= 1], {0: 0, total: rows}
        self.touched: set[int] = set()

    @property
    def total(self) -> int:
        return self.at[-1]

    def last_up_to(self, x: int) -> int:
        """The last known start at `x` or before; a gap that may hold a later one is noted."""
        i = bisect_right(self.at, x) - 1
        if i < len(self.closed) and not self.closed[i] and self.at[i] < x:
            self.touched.add(self.at[i])
        return self.at[i]

    def first_from(self, x: int) -> int:
        """The first known start at `x` or after; a gap that may hold an earlier one is noted."""
        i = bisect_left(self.at, x)
        if i and self.at[i] > x and not self.closed[i - 1]:
            self.touched.add(self.at[i - 1])
        return self.at[i]

    def roomiest(self, x: int) -> int:
        """As `last_up_to`, with a start wherever one may be."""
        i = bisect_right(self.at, x) - 1
        return self.at[i] if i == len(self.closed) or self.closed[i] else x

    def gaps(self, between: list[tuple[int, int]]) -> set[int]:
        """Left ends of the open gaps that meet one of the stretches."""
        found = set()
        for low, high in between:
            first, last = bisect_right(self.at, low) - 1, bisect_right(self.at, high)
            found |= {self.at[i] for i in range(max(0, first), min(last, len(self.closed))) if not self.closed[i]}
        return found

    def learn(self, gaps: list[tuple[int, int]], met: dict[int, list[tuple]]) -> None:
        """Put in what a round found in each gap: (first start, rows, last start, rows, starts) of its parts, in order."""
        at, closed, k = [], [], 0
        inside = {low: met.get(g, []) for g, (low, _) in enumerate(gaps)}
        for k, here in enumerate(self.at):
            at.append(here)
            if k == len(self.closed):
                break
            closed.append(self.closed[k] or here in inside)
            for low, low_rows, high, high_rows, n in inside.get(here, []):
                at.append(low)
                self.rows[low] = low_rows
                if n > 1:
                    closed.append(n == 2)
                    at.append(high)
                    self.rows[high] = high_rows
                closed.append(True)
        self.at, self.closed = at, closed
        self.rows = {x: self.rows[x] for x in at}


def _ends(look: Callable[[int], int], total: int, capacity: int, shards: int) -> list[int]:
    """Where shards filled one after another end."""
    ends = [0]
    while len(ends) <= shards:
        ends.append(look(min(total, ends[-1] + capacity)))
    return ends[1:]


def _least(feasible: Callable[[int], bool], low: int, high: int) -> int:
    """The smallest of low to high that is feasible; the last one is."""
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if feasible(middle) else (middle + 1, high)
    return low


def least_capacity(starts: Starts, shards: int) -> tuple[int, int]:
    """Bounds of the smallest capacity with which filling shards one after another takes up everything: a start wherever one may be, and known starts only.

    Gaps that matter for capacities between the two are noted in `touched`.
    """
    total = starts.total
    known = lambda x: starts.at[bisect_right(starts.at, x) - 1]
    low = _least(lambda c: _ends(starts.roomiest, total, c, shards)[-1] == total, -(-total // shards), total)
    high = _least(lambda c: _ends(known, total, c, shards)[-1] == total, low, total)
    if low < high:
        starts.touched |= starts.gaps(list(zip(_ends(known, total, low, shards), _ends(starts.roomiest, total, high, shards))))
    return low, high


def even_cuts(starts: Starts, shards: int, capacity: int) -> list[int]:
    """Ends of the shards: each the start nearest to an even share of what is left (the lower of two), such that no shard passes the capacity and none stays empty without need."""
    total = starts.total
    latest = [total]  # from latest[k] on, k shards are enough
    for _ in range(shards):
        latest.append(starts.first_from(max(0, latest[-1] - capacity)))
    ends = [0]
    for left in range(shards, 0, -1):
        here = ends[-1]
        if here == total:
            ends.append(total)
            continue
        share = here + (total - here) // left
        low = max(latest[left - 1], starts.first_from(here + 1))
        high = starts.last_up_to(min(total, here + capacity))
        below, above = starts.last_up_to(share), starts.first_from(share)
        ends.append(min(max(below if share - below <= above - share else above, low), high))
    return ends[1:]


class Numbered:
    """Rows in the order of their groups, spread over partitions by ranges and written once, with what comes before each partition."""

    def __init__(self, rows: DataFrame):
        self.rows = rows.withColumn("__part", F.spark_partition_id())
        told = self.rows.groupBy("__part").agg(F.count(F.lit(1)).alias("n"), F.sum("__size").alias("bytes"), F.max("__group").alias("last")).collect()
        self.before, size, n, last = {}, 0, 0, None
        for part in sorted(told, key=lambda r: r["__part"]):
            self.before[part["__part"]] = (size, n, last)
            size, n, last = size + part.bytes, n + part.n, bytes(part["last"])
        self.starts = Starts(size, n)

    def scan(self, handle: Callable[[Iterator], Iterator[pa.RecordBatch]], schema: T.StructType) -> DataFrame:
        """`handle` gets (batch, bytes before each row, rows before the batch, whether each row starts a group)."""
        before = self.before

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            size, n, last = before.get(TaskContext.get().partitionId(), (0, 0, None))

            def numbered():
                nonlocal size, n, last
                for batch in batches:
                    if batch.num_rows:
                        group, sizes = batch.column("__group"), batch.column("__size").to_numpy()
                        opens = np.ones(batch.num_rows, bool)
                        opens[0] = last is None or group[0].as_py() != last
                        opens[1:] = pc.not_equal(group.slice(1), group.slice(0, batch.num_rows - 1)).to_numpy(zero_copy_only=False)
                        ends = size + np.cumsum(sizes)
                        yield batch, ends - sizes, n, opens
                        size, n, last = int(ends[-1]), n + batch.num_rows, group[-1].as_py()

            yield from handle(numbered())

        return self.rows.mapInArrow(run, schema)

    def look(self, gaps: list[tuple[int, int]]) -> None:
        """One pass over the rows that refines the gaps; a few numbers per part of a gap come back."""
        per = max(2, STARTS // len(gaps))
        lows, highs = (np.array(x, np.int64) for x in zip(*gaps))
        widths = -(-(highs - lows) // per)
        schema = T.StructType.fromDDL("gap int, part int, low long, low_rows long, high long, high_rows long, n long")

        def handle(numbered: Iterator) -> Iterator[pa.RecordBatch]:
            for _, at, n, opens in numbered:
                rows = n + np.flatnonzero(opens)
                at = at[opens]
                gap = np.searchsorted(lows, at, "left") - 1
                inside = (gap >= 0) & (at < highs[np.maximum(gap, 0)])
                at, gap, rows = at[inside], gap[inside], rows[inside]
                if not at.size:
                    continue
                part = (at - lows[gap]) // widths[gap]
                first = np.flatnonzero(np.concatenate([[True], (np.diff(gap) != 0) | (np.diff(part) != 0)]))
                last = np.concatenate([first[1:], [at.size]]) - 1
                columns = [gap[first].astype(np.int32), part[first].astype(np.int32), at[first], rows[first], at[last], rows[last], last - first + 1]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=schema.names)

        least, most = (lambda c: F.min(c).alias(c)), (lambda c: F.max(c).alias(c))
        told = self.scan(handle, schema).groupBy("gap", "part").agg(least("low"), least("low_rows"), most("high"), most("high_rows"), F.sum("n").alias("n"))
        met: dict[int, list] = {}
        for r in sorted(told.collect()):
            met.setdefault(r.gap, []).append(tuple(r)[2:])
        self.starts.learn(gaps, met)

    def refined(self, search: Callable[[Starts], object], settled: Callable[[object], bool] = lambda _: False):
        """What `search` finds once it touches no gap that may hold other starts."""
        while True:
            self.starts.touched = set()
            found = search(self.starts)
            touched = self.starts.touched
            if settled(found) or not touched:
                return found
            right = dict(zip(self.starts.at, self.starts.at[1:]))
            self.look(sorted((low, right[low]) for low in touched))


def contiguous_shards(df: DataFrame, shards: int = 8, carry: tuple[str, ...] = ("doc_id",), text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """Columns `carry`, size (UTF-8 bytes of the text and 1), shard (from 0) and slot (place in the shard, gapless from 0), one row a row.

    Equal texts are a group and share a shard. Groups are ordered by the SHA-256 of their text, rows of a group by id and then by a hash of their carried columns, which need not tell
    repeated rows apart. The shards are stretches of that order with the least possible greatest size: the smallest capacity is found by binary search, each capacity checked by filling
    shards one after another. Within that capacity the cuts lie nearest to even shares of what is left, so that a group larger than a share leaves no shard empty beside it.

    Narrow rows move once, to ranges of (group, id), so a text of which there are many copies is spread over partitions. The driver sees a line per partition, and at most
    65,536 group starts a round: gaps between these that the search touches are refined by another pass until it touches none. Null and empty texts are equal and of size 1;
    null ids come first. More shards than groups leave the last ones empty; no rows give no rows. A carried column with a name of the result gives way to it.
    """
    if shards < 1:
        raise ValueError("at least one shard")
    carry = [c for c in dict.fromkeys(carry) if c.lower() not in ("size", "shard", "slot")]
    whole = F.coalesce(F.col(text), F.lit(""))
    keyed = df.select(*carry, F.col(id_column).alias("__id"), F.unhex(F.sha2(whole, 256)).alias("__group"), (F.octet_length(whole) + 1).cast("long").alias("__size"))
    order = ["__group", "__id", F.xxhash64(*carry)] if carry else ["__group", "__id"]
    rows = Numbered(cut(keyed.repartitionByRange(*order).sortWithinPartitions(*order).drop("__id")))
    capacity, _ = rows.refined(lambda s: least_capacity(s, shards), lambda bounds: bounds[0] == bounds[1])
    ends = rows.refined(lambda s: even_cuts(s, shards, capacity))
    cuts, first = np.array(ends[:-1], np.int64), np.array([0, *(rows.starts.rows[e] for e in ends[:-1])], np.int64)
    schema = T.StructType([rows.rows.schema[c] for c in carry] + list(T.StructType.fromDDL("size long, shard int, slot long")))

    def place(numbered: Iterator) -> Iterator[pa.RecordBatch]:
        for batch, at, n, _ in numbered:
            shard = np.searchsorted(cuts, at, "right")
            made = [batch.column("__size"), pa.array(shard.astype(np.int32)), pa.array(n + np.arange(batch.num_rows) - first[shard])]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in carry] + made, names=schema.names)

    return rows.scan(place, schema)
