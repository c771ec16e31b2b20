"""Document fingerprints by winnowing, in SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Code points in a k-gram, and k-grams in a window: any match of K + WINDOW - 1 code points shares a fingerprint.
K, WINDOW = 12, 8
#: k-grams handled together; a text of any length is a row of such blocks, so no array of all its hashes is made.
BLOCK = 4096
#: Rows of neighbouring ids that meet in one sort group.
NEIGHBOURS = 4_000
#: Beyond so many groups they grow with the table; they are sorted and read one after another, with spilling.
MOST_GROUPS = 10_000

_POSITION_BITS = 32
_HASH_MASK = (2**31 - 1) << _POSITION_BITS


def _utf32(text: Column) -> Column:
    """Four bytes a code point, so that a k-gram is cut out in constant time."""
    return F.encode(F.coalesce(text, F.lit("")), "UTF-32")


def fingerprint(text: Column, k: int = K, window: int = WINDOW) -> Column:
    """The winnowed k-grams of a text: longs that hold 31 bits of hash above 32 bits of (2**32 - 1 - position).

    As such a long sorts by hash and then from the right, the least of a window is its minimum with ties to the right. A text of fewer than `window` k-grams is one
    window; one shorter than `k` is one k-gram of its own length; an empty or null one has none. Positions ascend and do not repeat.
    """
    return _winnowed(text, F.lit(0), k, window)


def spliced_fingerprint(found: Column, shared: Column, text: Column, k: int = K, window: int = WINDOW) -> Column:
    """The fingerprint of `text`, which has its first `shared` code points in common with the text whose fingerprint is `found`.

    Whether a k-gram is chosen depends on the `window` - 1 k-grams on either side only. So those with all these in the common part are taken from `found`, and the rest of the
    text alone is winnowed, from as far back as its windows reach.
    """
    own = F.greatest(shared - k + 1 - (window - 1), F.lit(0))  # k-grams before this one are decided within the common part
    begin = F.greatest(own - (window - 1), F.lit(0))
    place = lambda x: F.lit(2**_POSITION_BITS - 1) - x.bitwiseAND(F.lit(2**_POSITION_BITS - 1))
    # a text too short for one whole window is winnowed whole
    whole = F.length(text) < k + window - 1
    own, begin = F.when(whole, 0).otherwise(own), F.when(whole, 0).otherwise(begin)
    # and so is one whose rest is too short for a window of its own
    begin = F.least(begin, F.greatest(F.length(text) - (k + window - 1), F.lit(0)))
    bound = F.array(F.struct(own.alias("own"), found.alias("found"), _winnowed(F.substring(text, begin + 1, F.length(text)), begin, k, window).alias("rest")))
    return F.transform(bound, lambda x: F.concat(F.filter(x["found"], lambda v: place(v) < x["own"]), F.filter(x["rest"], lambda v: place(v) >= x["own"])))[0]


def _winnowed(text: Column, begin: Column, k: int, window: int) -> Column:
    """The fingerprint, positions counted from `begin`."""
    points = _utf32(text)
    bound = F.array(F.struct(points.alias("b"), (F.octet_length(points) / 4).cast("int").alias("n"), begin.cast("long").alias("begin")))
    return F.transform(bound, lambda x: _winnow(x["b"], x["n"], x["begin"], k, window))[0]


def _least_with(step: int):
    return lambda h: F.zip_with(h, F.slice(h, step + 1, F.size(h)), lambda x, y: F.least(x, y))


def _winnow(points: Column, n: Column, begin: Column, k: int, window: int) -> Column:
    grams = F.greatest(n - k + 1, F.least(n, F.lit(1)))
    windows = F.greatest(grams - window + 1, F.least(n, F.lit(1)))

    def block(b: Column) -> Column:
        first = b * BLOCK
        count = F.least(windows - first, F.lit(BLOCK))  # windows of this block
        last = F.least(first + count - 1 + window, grams) - 1  # and their last k-gram
        base = F.array(F.struct(F.sequence(4 * first + 1, 4 * last + 1, F.lit(4)).alias("at"), (F.lit(2**_POSITION_BITS - 1) - begin - first).alias("top")))
        hashed = lambda x: F.transform(x["at"], lambda q, i: F.xxhash64(F.substring(points, q, F.lit(4 * k))).bitwiseAND(F.lit(_HASH_MASK)).bitwiseOR(x["top"] - i))
        least = F.transform(base, hashed)
        reach = 1
        while reach < window:  # minima of 2, 4, 8, ... neighbours, then of `window`; what runs over the end is null, which least() passes over
            step = min(reach, window - reach)
            least = F.transform(least, _least_with(step))
            reach += step
        return F.array_distinct(F.slice(least[0], 1, count))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((windows - 1) / BLOCK).cast("int")), block)
    return F.when(n > 0, F.array_distinct(F.flatten(blocks))).otherwise(F.array().cast("array<long>"))


def hashes(found: Column) -> Column:
    """The distinct hashes of a fingerprint."""
    return F.array_distinct(F.transform(found, lambda x: F.shiftright(x, _POSITION_BITS).cast("int")))


def positions(found: Column) -> Column:
    """Where its k-grams begin, in code points."""
    return F.transform(found, lambda x: F.lit(2**_POSITION_BITS - 1) - x.bitwiseAND(F.lit(2**_POSITION_BITS - 1)))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard index of two arrays of distinct hashes; two empty ones are alike."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, 1.0).otherwise(both / union)


def digest(found: Column) -> Column:
    """A short name of a fingerprint, hashes and positions."""
    return F.md5(F.array_join(F.transform(found, lambda x: F.hex(x)), ","))


def _ranges(df: DataFrame, per_group: int) -> tuple[list[int], Column]:
    """Cuts of `id`, descending, and the number of cuts above a row's id: two short searches in arrays instead of one long."""
    n = df.count()
    parts = min(MOST_GROUPS, max(1, -(-n // per_group)))
    cuts = sorted(set((df.select(F.percentile_approx("id", [k / parts for k in range(1, parts)], 100 * parts)).first()[0] or []) if parts > 1 else []), reverse=True)
    if not cuts:
        return [], F.lit(0)
    array = lambda values: "array(" + ",".join(f"{v}L" for v in values) + ")"
    step = 64
    rows = [cuts[k : k + step] for k in range(0, len(cuts), step)]
    above = lambda values: F.size(F.filter(values, lambda c: F.coalesce(c > F.col("id"), F.lit(True))))
    coarse = above(F.expr(array(r[-1] for r in rows)))
    fine = above(F.coalesce(F.get(F.expr("array(" + ",".join(map(array, rows)) + ")"), coarse), F.expr("cast(array() as array<bigint>)")))
    return cuts, coarse * step + fine


def in_order(df: DataFrame, id_column: str, columns: list[str], per_group: int = NEIGHBOURS) -> DataFrame:
    """Rows `id`, `row` (the struct of `columns`), `part`, `guest`: sorted within parts by falling id, then a guest, the first row of the next part.

    The parts are ranges of ids, cut by a sketch at about every `per_group` rows, so that all rows but the guests move once and no task gets the whole table.
    The last part's guest is the first row of all. Rows of one id stay together, null ids come last; equal ids follow one another by a hash of the row.
    """
    chosen = df.select(F.col(id_column).cast("long").alias("id"), F.struct(*columns).alias("row"))
    _, part = _ranges(chosen.select("id"), per_group)
    own = chosen.withColumn("part", part)
    first = {r.part: r.id for r in own.select("id", "part").groupBy("part").agg(F.max("id").alias("id")).collect()}
    before = dict(zip(sorted(first), [max(first, default=0), *sorted(first)]))
    leads = F.col("id").isin([i for i in first.values() if i is not None])
    if None in first.values():
        leads = leads | F.col("id").isNull()
    to = F.get(F.expr("array(" + ",".join(str(before.get(k, 0)) for k in range(max(first, default=0) + 1)) + ")"), F.col("part"))
    guests = own.where(leads).withColumn("part", to)
    both = own.withColumn("guest", F.lit(False)).unionByName(guests.withColumn("guest", F.lit(True)))
    return both.withColumn("tie", F.xxhash64("row")).repartition("part").sortWithinPartitions("part", "guest", F.col("id").desc_nulls_last(), "tie")


def edited_likeness(df: DataFrame, id_column: str = "doc_id", text: str = "text", k: int = K, window: int = WINDOW, per_group: int = NEIGHBOURS) -> DataFrame:
    """Each text's fingerprint beside that of its edited text and of the next text, by falling id (after the last: the first).

    The edited text has the last third of its code points replaced by the first as many of the next text. Columns: the id, n_chars, edited (the text), fingerprint,
    edited_fingerprint (arrays as `fingerprint` gives them), near_edited and near_next (Jaccard index of the hashes). The fingerprints are made after the rows
    have moved. Null texts are empty; two empty fingerprints are alike; a lone row is its own next.
    """
    rows = in_order(df.select(F.col(id_column), F.coalesce(F.col(text), F.lit("")).alias("__text")), id_column, ["__text"], per_group)
    rows = rows.withColumn("text", F.col("row.__text")).withColumn("found", fingerprint(F.col("text"), k, window)).withColumn("hashes", hashes(F.col("found"))).drop("row")
    ordered = Window.partitionBy("part").orderBy("guest", F.col("id").desc_nulls_last(), "tie")
    rows = rows.withColumn("next", F.lead(F.struct("text", "hashes")).over(ordered)).where(~F.col("guest"))
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - third), F.substring("next.text", F.lit(1), third)))
    rows = rows.withColumn("edited_found", spliced_fingerprint(F.col("found"), n - third, F.col("edited"), k, window))
    return rows.select(
        F.col("id").alias(id_column), n.cast("long").alias("n_chars"), "edited", F.col("found").alias("fingerprint"), F.col("edited_found").alias("edited_fingerprint"),
        likeness(F.col("hashes"), hashes(F.col("edited_found"))).alias("near_edited"), likeness(F.col("hashes"), F.col("next.hashes")).alias("near_next"),
    )
