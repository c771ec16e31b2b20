"""Near-duplicate documents by DartMinHash signatures, a banded join and exact checks."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from campanile.llm.common import Memo, map_texts, words_of
from campanile.session import cut

WORDS, THRESHOLD = 5, 0.8
#: A pair of similarity 0.8 meets in none of the bands with probability (1 - 0.8**5)**32 = 3e-6.
BANDS, ROWS = 32, 5
#: Texts of a bucket that are compared with one another in one place.
TILE = 256


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finalizer of a well-known generator: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniform(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


@lru_cache(maxsize=256)
def poisson_steps(mean: float) -> np.ndarray:
    """Distribution function of a Poisson number at 0, 1, 2, ... until it reaches 1 in floating point."""
    most = int(mean + 12 * math.sqrt(mean) + 40)
    return np.minimum(np.cumsum([math.exp(k * math.log(mean) - mean - math.lgamma(k + 1)) for k in range(most)]), 1.0)


def cells(first: float, most: float) -> list[tuple[float, float]]:
    """Intervals from 0 on that double in length after the first, until `most` is covered."""
    found, low, high = [], 0.0, first
    while low < most:
        found.append((low, high))
        low, high = high, 2 * high
    return found


def throw(elements: np.ndarray, weights: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Darts under the elements' weights and below `ranks` (one for each element): the element's index, the dart's hash and its rank.

    Darts lie in (element, weight, rank) space with density 1. Each cell of the doubling grid over weight and rank gets a Poisson number of them, from a hash of element and
    cell alone, so all sets that hold the element up to a dart's weight have that dart. Most cells are empty; the work is about that of the darts.
    """
    index, darts, heights = [], [], []
    for a, (low, high) in enumerate(cells(1.0, weights.max(initial=0.0))):
        for b, (near, far) in enumerate(cells(0.125, ranks.max(initial=0.0))):
            here = np.flatnonzero((weights > low) & (ranks > near))
            if not len(here):
                continue
            seed = mix(elements[here] ^ mix(np.array([a * 4096 + b + 1], np.uint64)))
            n = np.searchsorted(poisson_steps((high - low) * (far - near)), uniform(seed), "right")
            some = np.flatnonzero(n)
            here, seed, n = here[some], seed[some], n[some]
            nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            here, dart = np.repeat(here, n), mix(np.repeat(seed, n) + (nth + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            rank = near + (far - near) * uniform(mix(dart ^ np.uint64(0x5851F42D4C957F2D)))
            weight = low + (high - low) * uniform(mix(dart ^ np.uint64(0x14057B7EF767814F)))
            kept = (rank < ranks[here]) & (weight < weights[here])
            index.append(here[kept])
            darts.append(dart[kept])
            heights.append(rank[kept])
    if not index:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0)
    return np.concatenate(index), np.concatenate(darts), np.concatenate(heights)


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], k: int) -> np.ndarray:
    """k dart hashes for each weighted set (elements as 64-bit hashes, weights): at each coordinate the dart of lowest rank.

    Two sets agree at a coordinate with the probability of their weighted Jaccard index. The rank limit is set so that a set expects k (ln k + 3) darts; sets with a
    coordinate left empty are thrown again to twice the rank, whose lower darts are the same. An empty set has zeros.
    """
    out = np.zeros((len(sets), k), np.uint64)
    todo, darts = [i for i, (e, _) in enumerate(sets) if len(e)], k * (math.log(k) + 3)
    while todo:
        sizes = [len(sets[i][0]) for i in todo]
        owner = np.repeat(np.arange(len(todo)), sizes)
        elements, weights = (np.concatenate([sets[i][c] for i in todo]) for c in (0, 1))
        limit = darts / np.bincount(owner, weights, len(todo))
        index, dart, rank = throw(elements, weights, limit[owner])
        at = owner[index] * k + (mix(dart ^ np.uint64(0x2545F4914F6CDD1D)) % np.uint64(k)).astype(np.int64)
        order = np.lexsort((rank, at))
        at, dart = at[order], dart[order]
        first = np.flatnonzero(np.diff(at, prepend=-1))
        found = np.zeros(len(todo) * k, bool)
        found[at[first]] = True
        rows = np.zeros(len(todo) * k, np.uint64)
        rows[at[first]] = dart[first]
        full = found.reshape(-1, k).all(1)
        out[np.array(todo)[full]] = rows.reshape(-1, k)[full]
        todo, darts = [i for i, done in zip(todo, full) if not done], 2 * darts
    return out


class Shingler:
    """Sets of word n-grams as 64-bit hashes, with weights."""

    def __init__(self, words: int, weights: str):
        self.n, self.weights = words, weights
        self.words = Memo(lambda w: xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")))

    def shingles(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Distinct shingles, sorted, and their weights: 1 ("set") or how often they occur ("count"). Fewer words than n are one shingle, no words none."""
        found = words_of(text)
        if not found:
            return np.zeros(0, np.uint64), np.zeros(0)
        hashes = np.fromiter(map(self.words.__getitem__, found), np.uint64, len(found))
        width = min(self.n, len(hashes))
        rolled = hashes[: len(hashes) - width + 1]
        for k in range(1, width):
            rolled = mix(rolled * np.uint64(0x9E3779B97F4A7C15) + hashes[k : len(hashes) - width + 1 + k])
        if width < self.n:
            rolled = mix(rolled + np.uint64(width))
        distinct, counts = np.unique(rolled, return_counts=True)
        return distinct, counts.astype(float) if self.weights == "count" else np.ones(len(distinct))


    def multiset(self, text: str) -> np.ndarray:
        """The shingles, sorted, a further element for each time one counts: Jaccard indices of these sets are those of the weights."""
        elements, weights = self.shingles(text)
        times = weights.astype(np.int64)
        if times.max(initial=1) > 1:
            nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            elements = np.repeat(elements, times)
            elements = np.unique(np.where(nth > 0, mix(elements + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), elements))
        return elements


def links(sets: list[np.ndarray], left: np.ndarray, classes: list, threshold: float) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of sets (sorted, distinct) with a Jaccard index of `threshold` or more, of different classes and one of them `left`.

    Common elements are counted by products of incidence matrices, some thousand elements at a time; elements of one set alone count for nothing.
    """
    sizes = np.array([len(s) for s in sets])
    if len(sets) == 2:
        both = len(np.intersect1d(*sets, assume_unique=True))
        return [(0, 1)] if classes[0] != classes[1] and sizes.sum() and both >= threshold * (sizes.sum() - both) else []
    _, codes, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rows = np.repeat(np.arange(len(sets)), sizes)
    kept = counts[codes] > 1
    rows, codes = rows[kept], (np.cumsum(counts > 1) - 1)[codes[kept]]
    common = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(codes, kind="stable")
    rows, codes = rows[order], codes[order]
    for low in range(0, int(codes[-1]) + 1 if len(codes) else 0, 2048):
        a, b = np.searchsorted(codes, (low, low + 2048))
        part = np.zeros((len(sets), 2048), np.float32)
        part[rows[a:b], codes[a:b] - low] = 1
        common += part @ part.T
    number = np.unique(np.array(classes), return_inverse=True)[1]
    near = (common >= threshold * (sizes[:, None] + sizes[None, :] - common)) & (number[:, None] != number[None, :]) & (sizes[:, None] > 0)
    near &= left[:, None] | left[None, :]
    if not left.all():  # two tiles: pairs within either are met elsewhere
        near &= left[:, None] != left[None, :]
    found, fresh = [], np.ones(len(sets), bool)
    for root in np.flatnonzero(near.any(1)):
        if not fresh[root]:
            continue
        fresh[root], stack = False, [root]
        while stack:
            at = stack.pop()
            new = np.flatnonzero(near[at] & fresh)
            fresh[new] = False
            stack += new.tolist()
            found += [(int(at), int(n)) for n in new]
    return found


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of undirected `edges` (a, b): the root is the least node of the component.

    Alternating large and small stars: each node hands its larger neighbours, then its smaller ones, to the least it knows. Each round is written to the checkpoint folder;
    rounds grow with the logarithm of the longest path. Hubs are keys of an aggregation and of a join that adaptive execution splits.
    """
    def star(links: DataFrame, larger: bool) -> DataFrame:
        both = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        side = both if larger else both.where("b < a")
        least = side.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        joined = side.join(least, "a")
        linked = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")) if larger else joined.select("b", "m").where("b > m").toDF("a", "b").unionAll(least.select("a", F.col("m").alias("b")))
        return linked.where("a > b").distinct()

    links = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        links = cut(star(star(links, True), False))
        now = links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == state:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        state = now


def _text_key(text: str):
    return F.md5(F.coalesce(F.col(text), F.lit("")))


def near_classes(df: DataFrame, text: str = "text", words: int = WORDS, threshold: float = THRESHOLD, weights: str = "set", bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(text_key, class_key) for each distinct text of `df`: texts linked by chains of pairs with a similarity of `threshold` or more share a class_key.

    The similarity is the weighted Jaccard index of word shingles: by default every shingle weighs 1, with weights="count" as often as it occurs. Equal texts are one
    (their key is the MD5 of the text). Signatures meet in buckets of equal bands. First each text is compared with one centre of its buckets, and the classes so found are
    joined; then the texts of each bucket that is not of one class are compared with one another, by tiles of bounded size, and only links come out, at most one for each
    text and tile. All links are checked by the whole sets. Texts that meet in no bucket are not compared. Null and empty texts have no shingles and are one text.
    """

    def start():
        shingler = Shingler(words, weights)

        def banded(texts):
            sign = signatures([shingler.shingles(t) for t in texts], bands * rows).reshape(len(texts), bands, rows)
            found = np.zeros((len(texts), bands), np.uint64)
            for k in range(rows):
                found = mix(found * np.uint64(0x9E3779B97F4A7C15) + sign[:, :, k] + np.uint64(k))
            found = mix(found + np.arange(bands, dtype=np.uint64))
            return [[b.view(np.int64).tolist() if s.any() else [] for b, s in zip(found, sign)]]

        return banded

    def measured():
        shingler = Shingler(words, weights)
        return lambda texts: [[shingler.multiset(t).view(np.int64).tolist() for t in texts]]

    def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """The pairs whose sets are like enough."""
        a, b = (sets.select(*(F.col(c).alias(f"{c}_{side}") for c in sets.columns)) for side in "ab")
        joined = pairs.join(a, pairs["a"] == a["text_key_a"]).join(b, pairs["b"] == b["text_key_b"])
        both = F.size(F.array_intersect("shingles_a", "shingles_b"))
        return joined.select("a", "b", both.alias("both"), (F.size("shingles_a") + F.size("shingles_b")).alias("total")).where(F.col("both") >= threshold * (F.col("total") - F.col("both"))).select("a", "b")

    def tile_links(batches):
        """Links within the tiles, whose rows follow one another."""

        def close(rows_):
            keys, classes, left, sets = zip(*rows_)
            sets = [np.unique(np.asarray(s, np.int32)) for s in sets]
            return [(keys[a], keys[b]) for a, b in links(sets, np.array(left), list(classes), threshold)]

        def pack(pairs):
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.string()) for k in (0, 1)], names=["a", "b"])

        tile, held = None, []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("bucket", "i", "j", "text_key", "class_key", "left")]
            shingles = batch.column("shingles")
            found = []
            for n, (bucket, i, j, key, cls, left) in enumerate(zip(*columns)):
                if (bucket, i, j) != tile:
                    if len(held) > 1:
                        found += close(held)
                    tile, held = (bucket, i, j), []
                held.append((key, cls, left, shingles[n].values.to_numpy()))
            if found:
                yield pack(found)
        if len(held) > 1 and (found := close(held)):
            yield pack(found)

    keyed = df.select(_text_key(text).alias("text_key"), F.col(text).alias("text"))
    signed = map_texts(keyed, ["text_key"], "text", "bands array<long>", start, rows=128)
    one = cut(signed.groupBy("text_key").agg(F.first("bands").alias("bands")))
    held = one.select("text_key", F.explode("bands").alias("bucket"))
    shared = held.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.xxhash64("text_key"), "text_key")).alias("centre")).where("n > 1")
    members = cut(held.join(shared, "bucket").select("bucket", "text_key", "n", F.col("centre.text_key").alias("centre"), F.col("centre.col1").alias("order")))
    wanted = members.select("text_key").distinct()
    texts = keyed.join(wanted, "text_key", "left_semi").groupBy("text_key").agg(F.first("text").alias("text"))
    sets = cut(map_texts(texts, ["text_key"], "text", "shingles array<long>", measured, rows=128))

    def joined(edges: DataFrame) -> DataFrame:
        roots = components(edges)
        return wanted.join(roots.withColumnRenamed("node", "text_key"), "text_key", "left").select("text_key", F.coalesce("root", "text_key").alias("class_key"))

    stars = members.where("text_key <> centre").groupBy("text_key").agg(F.min(F.struct("order", "centre")).alias("best")).select(F.col("text_key").alias("a"), F.col("best.centre").alias("b"))
    stars = cut(similar(stars, sets))
    classes = cut(joined(stars))

    apart = members.select("bucket", "text_key", "n").join(classes, "text_key")
    mixed = apart.groupBy("bucket").agg(F.min("class_key").alias("low"), F.max("class_key").alias("high")).where("low < high").select("bucket")
    tiles = F.ceil(F.col("n") / TILE).cast("int")
    placed = apart.join(mixed, "bucket").withColumn("at", F.pmod(F.xxhash64("text_key"), tiles).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), tiles - 1)))
    # the fold to 32 bits only finds pairs to check
    folded = sets.select("text_key", F.transform("shingles", lambda x: x.bitwiseAND(F.lit(2**31 - 1)).cast("int")).alias("shingles"))
    rows_ = placed.select("bucket", F.least("at", "other").alias("i"), F.greatest("at", "other").alias("j"), "text_key", "class_key", (F.col("at") <= F.col("other")).alias("left")).join(folded, "text_key")
    met = rows_.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInArrow(tile_links, "a string, b string")
    pairs = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    classes = joined(stars.unionAll(similar(cut(pairs), sets)))
    return one.select("text_key").join(classes, "text_key", "left").select("text_key", F.coalesce("class_key", "text_key").alias("class_key"))


def near_duplicates(df: DataFrame, id_column: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """One row per row of `df`: the id, class_id (the least id of its class of near duplicates), class_rows, and kept (whether its id is that least one).

    See `near_classes`. Rows without an id have the class_id of the others in their class, null if there is none, and are kept only then. Repeated rows of the kept id are all kept.
    """
    keyed = df.select(F.col(id_column).alias("id"), _text_key(text).alias("text_key"))
    classes = near_classes(df, text, **settings)
    least = keyed.groupBy("text_key").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")).join(classes, "text_key")
    named = least.select("text_key", "class_key").join(least.groupBy("class_key").agg(F.min("least").alias("class_id"), F.sum("n").alias("class_rows")), "class_key")
    out = keyed.join(named, "text_key")
    return out.select(F.col("id").alias(id_column), "class_id", "class_rows", F.col("id").eqNullSafe(F.col("class_id")).alias("kept"))


def keep_one(df: DataFrame, id_column: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """The rows of `df` without near duplicates: of each class the row with the least id stays, once (see `near_classes`).

    Rows without an id stay only if none of their class has one; of texts without ids that with the least MD5 stays. Rows are matched by id and text, so that a text with many copies
    does not meet in one task.
    """
    last = F.lit(2**63 - 1)
    keyed = df.withColumn("__key", _text_key(text)).withColumn("__id", F.coalesce(F.col(id_column).cast("long"), last))
    least = keyed.groupBy("__key").agg(F.min("__id").alias("__id"))
    classes = near_classes(df, text, **settings).select(F.col("text_key").alias("__key"), "class_key")
    best = least.join(classes, "__key").groupBy("class_key").agg(F.min(F.struct("__id", "__key")).alias("best")).select("best.__id", "best.__key")
    return keyed.join(best, ["__key", "__id"], "left_semi").dropDuplicates(["__key", "__id"]).select(df.columns)
