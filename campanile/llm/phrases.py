"""Collocations: the phrases of each language whose words keep together most, by best-first growth from prefixes."""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from campanile.session import cut

#: Words of a phrase at most; how often a candidate occurs at least; how many phrases of a language are asked for.
LONGEST, LEAST, LIMIT = 4, 30, 2000
#: A candidate goes if a longer one that contains it occurs in so many percent of its places.
COVERED = 80
#: The first frontier holds so many times the asked-for phrases, each later one so many times the one before.
FIRST, GROWTH = 2, 4
#: Tokens counted together in a task, words it remembers, and bytes of a long text cut into words together.
CHUNK, WORDS, SLICE = 1 << 20, 400_000, 1 << 20
#: The marks of phrases lie in 2**BITS bytes, whatever their number; phrases of one place share their marks, which only lets more phrases be counted.
BITS, PAGE_BITS = 24, 12
FREQUENT, PREFIX, SUFFIX, SCORE = 1, 2, 4, 8

_MIX = np.uint64(0x9E3779B97F4A7C15)
_END = b"\xff"  # between pieces; no byte of UTF-8
#: Upper to lower case for A to Z, tabs to spaces, signs and line ends between pieces to _END.
_READ = bytes(0xFF if chr(b) in ".,;:!?\n\x0b\x0c\r" else 0x20 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))


class Vocabulary(dict):
    """Numbers of a language's words in the order they are met; 0 is the end of a piece."""

    def __init__(self, lang: str):
        super().__init__({_END: 0})
        self.seed = xxhash.xxh3_64_intdigest(lang.encode())
        self.words, self.hashes = [_END], [0]

    def __missing__(self, word: bytes) -> int:
        self[word] = at = len(self.words)
        self.words.append(word)
        self.hashes.append(xxhash.xxh3_64_intdigest(word, self.seed))
        return at


def places(columns: list[np.ndarray], bits: int) -> np.ndarray:
    """Where the marks of phrases are, by the hashes of their first, second, ... words."""
    mixed = columns[0].copy()
    for column in columns[1:]:
        mixed = mixed * _MIX + column
    return (mixed * _MIX >> np.uint64(64 - bits)).astype(np.int64)


def wanted(k: int, marks: np.ndarray) -> np.ndarray:
    """Whether the k words from each position on are counted, by the marks of the k - 1 words there and one further on."""
    head, tail = marks[:-1], marks[1:]
    if k == 2:
        return (head & tail & FREQUENT) > 0
    if k == 3:  # both halves frequent; it grows from a prefix, or is the rest of a phrase that does
        return ((head & tail & FREQUENT) > 0) & (((head & PREFIX) | (tail & SUFFIX)) > 0)
    return (((head & PREFIX) > 0) & ((tail & SUFFIX) > 0)) | (((head | tail) & SCORE) > 0)


class Counter:
    """Counts phrases of k words in a task, a chunk of tokens at a time."""

    def __init__(self, k: int, marks: np.ndarray | None, chunk: int, words: int, slice_: int):
        self.k, self.marks = k, marks
        self.chunk, self.words, self.slice = chunk, words, slice_
        self.known: dict[str, Vocabulary] = {}
        self.read: dict[str, array] = {}
        self.held = 0

    def add(self, lang: str, text: bytes) -> Iterator[tuple[str, list[bytes], list[int]]]:
        text = text.translate(_READ).replace(_END, b" " + _END + b" ")
        at = 0
        while at < len(text):
            end = text.find(b" ", at + self.slice)
            end = len(text) if end < 0 else end
            self.known.setdefault(lang, Vocabulary(lang))
            read = self.read.setdefault(lang, array("i", [0]))
            before = len(read)
            read.extend(map(self.known[lang].__getitem__, text[at:end].split()))
            self.held += len(read) - before
            if self.held >= self.chunk:
                yield from self.flush(lang)
            at = end
        if lang in self.read:
            self.read[lang].append(0)

    def flush(self, going_on: str | None = None) -> Iterator[tuple[str, list[bytes], list[int]]]:
        """The counts of what was read. A text that goes on begins the next chunk with its last k - 1 words, which are no phrase by themselves."""
        tail = []
        for lang, read in self.read.items():
            words = self.known[lang].words
            if lang == going_on and self.k > 1:
                tail = [words[i] for i in read[1 - self.k :]]
            yield from self.counted(lang, np.frombuffer(read, np.int32).astype(np.int64))
        if sum(map(len, self.known.values())) > self.words:
            self.known = {}
        self.read, self.held = {}, 0
        if going_on is not None:
            self.known.setdefault(going_on, Vocabulary(going_on))
            self.read[going_on] = array("i", map(self.known[going_on].__getitem__, tail))

    def counted(self, lang: str, ids: np.ndarray) -> Iterator[tuple[str, list[bytes], list[int]]]:
        words, k = self.known[lang].words, self.k
        if k == 1:
            n = np.bincount(ids, minlength=len(words))
            n[0] = 0
            met = np.flatnonzero(n)
            yield lang, [b"", *(words[i] for i in met)], [int(n.sum()), *n[met].tolist()]
            return
        if len(ids) < k:
            return
        hashes = np.array(self.known[lang].hashes, np.uint64)[ids]
        whole = np.lib.stride_tricks.sliding_window_view(ids > 0, k).all(axis=1)
        heads = [hashes[j : len(ids) - k + 2 + j] for j in range(k - 1)]
        at = np.flatnonzero(whole & wanted(k, self.marks[places(heads, len(self.marks).bit_length() - 1)]))
        key, base = ids[at], len(words)
        for j in range(1, k):
            if at.size and int(key.max()) > (1 << 62) // base:
                key = np.unique(key, return_inverse=True)[1]
            key = key * base + ids[at + j]
        _, first, n = np.unique(key, return_index=True, return_counts=True)
        rows = ids[at[first][:, None] + np.arange(k)].tolist()
        yield lang, [b" ".join([words[i] for i in row]) for row in rows], n.tolist()


def counts(df: DataFrame, k: int, least: int, marks=None) -> DataFrame:
    """Rows (lang, phrase, n): phrases of k words that occur `least` times, of those the marks (a broadcast value) let in; for k = 1 also the empty phrase, n being all words.

    Every task adds up its own chunks before the shuffle on (lang, phrase), so neither a language nor a phrase with a large part of all rows meets in one task.
    """
    sizes = CHUNK, WORDS, SLICE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(k, None if marks is None else np.frombuffer(marks.value, np.uint8), *sizes)

        def told() -> Iterator[tuple[str, list[bytes], list[int]]]:
            for batch in batches:
                for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
                    yield from counter.add(lang, text)
            yield from counter.flush()

        for lang, phrases, n in told():
            for a in range(0, len(phrases), 50_000):
                part = phrases[a : a + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), pa.array(part, pa.binary()).cast(pa.string()), pa.array(n[a : a + 50_000], pa.int64())], names=["lang", "phrase", "n"])

    summed = df.mapInArrow(run, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    return cut(summed.where((F.col("n") >= least) | (F.col("phrase") == "")))


def marked(df: DataFrame, k: int):
    """The marks of rows (lang, phrase, bits) of k words, sent to every task: 2**BITS bytes, made page by page."""
    bits, page_bits = BITS, PAGE_BITS

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            hashes = np.array([[xxhash.xxh3_64_intdigest(w.encode(), seed) for w in p.split(" ")] for seed, p in zip(map(xxhash.xxh3_64_intdigest, frame.lang), frame.phrase)], np.uint64).reshape(-1, k)
            yield pd.DataFrame({"place": places(list(hashes.T), bits), "bits": frame.bits})

    def page(frame: pd.DataFrame) -> pd.DataFrame:
        content = np.zeros(1 << page_bits, np.uint8)
        content[frame.place & ((1 << page_bits) - 1)] = frame.bits
        return pd.DataFrame({"page": [int(frame.page.iloc[0])], "content": [content.tobytes()]})

    found = df.select("lang", "phrase", "bits").mapInPandas(place, "place long, bits int").groupBy("place").agg(F.bit_or("bits").alias("bits"))
    pages = found.withColumn("page", F.shiftright("place", page_bits)).groupBy("page").applyInPandas(page, "page long, content binary").collect()
    marks = np.zeros((1 << (bits - page_bits), 1 << page_bits), np.uint8)
    for p in pages:
        marks[p.page] = np.frombuffer(p.content, np.uint8)
    return df.sparkSession.sparkContext.broadcast(marks.tobytes())


def ratio(a: Column, total: Column) -> Column:
    """floor(2000000 a / total) for a <= total / 2, exact for counts up to 9e15: two steps of long division."""
    thousand = a * 1000
    exact = lambda x, y: F.call_function("div", x, y)
    return exact(thousand, total) * 2000 + exact(thousand % total * 2000, total)


def scored(found: DataFrame, k: int, parts: DataFrame) -> DataFrame:
    """Rows (lang, phrase, a, l, r, score, prefix, suffix) of phrases of k words: the lowest cut, and bounds on the scores of phrases that begin or end with this one.

    A phrase that begins with P occurs a <= f(P) times, and its rest at least a times; so behind P's first word its score is 2000000 a / (f(first) + f(rest)) or less, which grows
    with a and is at most that of f(P) / (f(first) + f(P)). From the right it is the same with the last word. Parts that were not counted leave the score null.
    """
    sides = [F.struct(F.lit(side * k + j).alias("role"), F.substring_index("phrase", " ", j if side == 0 else j - k).alias("part")) for j in range(1, k) for side in (0, 1)]
    wide = found.withColumnRenamed("n", "a").withColumn("s", F.explode(F.array(*sides))).select("lang", "phrase", "a", "s.role", "s.part")
    known = wide.join(parts.select("lang", F.col("phrase").alias("part"), F.col("n").alias("f")), ["lang", "part"])
    of = lambda side, j: F.max(F.when(F.col("role") == side * k + j, F.col("f")))
    row = known.groupBy("lang", "phrase", "a").agg(*[of(side, j).alias(f"{'lr'[side]}{j}") for j in range(1, k) for side in (0, 1)])
    a = F.col("a")
    each = F.array(*[F.struct(ratio(a, F.col(f"l{j}") + F.col(f"r{j}")).alias("score"), F.lit(j).alias("j"), F.col(f"l{j}").alias("l"), F.col(f"r{j}").alias("r")) for j in range(1, k)])
    told = F.forall(each, lambda x: x["score"].isNotNull())
    row = row.withColumn("best", F.when(told, F.array_min(each)))
    return row.select("lang", "phrase", "a", "best.l", "best.r", "best.score", ratio(a, F.col("l1") + a).alias("prefix"), ratio(a, a + F.col(f"r{k - 1}")).alias("suffix"))


def thresholds(pairs: DataFrame, wanted_: int) -> DataFrame:
    """Rows (lang, floor): a score that `wanted_` of the language's pairs reach or pass, 0 if there are not so many; by a histogram of 10,000 steps of scores."""
    steps = pairs.groupBy("lang", F.expr("score div 100").alias("step")).agg(F.count(F.lit(1)).alias("n"))
    above = Window.partitionBy("lang").orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, 0)
    reached = steps.withColumn("upto", F.sum("n").over(above))
    return reached.groupBy("lang").agg((F.coalesce(F.max(F.when(F.col("upto") >= wanted_, F.col("step"))), F.lit(0)) * 100).alias("floor"))


def survivors(found: DataFrame, k: int, longer: DataFrame) -> DataFrame:
    """Rows of `found` that no longer candidate covers. What a longer one covers, one of a word more covers as well, as it is part of it."""
    parts = F.array(F.substring_index("phrase", " ", k), F.substring_index("phrase", " ", -k))
    most = longer.select("lang", F.explode(F.array_distinct(parts)).alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    both = found.join(most, ["lang", "phrase"], "left")
    return both.where(F.col("longer").isNull() | (100 * F.col("longer") < COVERED * F.col("a"))).drop("longer")


def collocations(df: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST, limit: int = LIMIT) -> DataFrame:
    """The first `limit` phrases of each language: lang, rank (from 1), phrase, a, l, r, n, score, by score and a descending, then phrase.

    Texts are lower-cased (A to Z) and cut into pieces at `.,;:!?` and line ends, pieces into words at spaces and tabs. A candidate is 2 to 4 words that follow one another in pieces
    `least` times (a). Its score is the least floor(2000000 a / (l + r)) over its cuts, l and r being how often the parts before and behind the cut occur. A candidate goes if a
    longer one that contains it occurs in 80 % of its places or more. n counts all words of the language.

    All words and pairs of frequent words are counted. Then the frontier takes in phrases best bound first: a score is set that many pairs reach, phrases whose bound reaches it are
    grown by a word and counted, and so twice. All phrases of that score or more, and whatever covers them, are then known. A language is settled when `limit` of them survive
    (ties included, as they have the score), or nothing is left below; the others go on with a lower score. Each pass reads the texts once and moves counts, added up in each task.

    Null texts are empty; a null language counts as `und`. Repeated rows count as often as they are there. Long texts are read in slices. Languages without a candidate, and tables
    without rows, have no rows in the result.
    """
    docs = df.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    words = counts(docs, 1, least)
    total = words.where(F.col("phrase") == "").select("lang", F.col("n").alias("words"))
    words = words.where(F.col("phrase") != "")
    pairs = counts(docs, 2, least, marked(words.withColumn("bits", F.lit(FREQUENT)), 1))
    parts = words.unionByName(pairs)
    pairs_scored = cut(scored(pairs, 2, parts))
    done: list[DataFrame] = []
    open_ = pairs_scored.select("lang").distinct()
    size = FIRST * limit
    while True:
        level = cut(thresholds(pairs_scored.join(open_, "lang", "left_semi"), size))
        if level.isEmpty():
            break
        reach = lambda c: F.col(c) >= F.col("floor")
        bits = lambda: (F.lit(FREQUENT) + F.when(reach("prefix"), PREFIX).otherwise(0) + F.when(reach("suffix"), SUFFIX).otherwise(0) + F.when(reach("score"), SCORE).otherwise(0)).cast("int").alias("bits")
        found = {2: pairs_scored}
        grown = {2: pairs}
        for k in range(3, LONGEST + 1):
            front = found[k - 1].join(level, "lang")
            grown[k] = counts(docs, k, least, marked(front.select("lang", "phrase", bits()), k - 1))
            found[k] = cut(scored(grown[k], k, parts.unionByName(grown[3]) if k > 3 else parts))
        reached = {k: f.join(level, "lang").where(reach("score")).drop("floor", "prefix", "suffix") for k, f in found.items()}
        kept = reached[LONGEST]
        for k in range(2, LONGEST):
            kept = kept.unionByName(survivors(reached[k], k, grown[k + 1]))
        kept = cut(kept)
        settled = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept")).join(level, "lang", "right").where((F.col("kept") >= limit) | (F.col("floor") == 0)).select("lang")
        settled = cut(settled)
        done.append(kept.join(settled, "lang", "left_semi"))
        open_ = cut(level.select("lang").join(settled, "lang", "left_anti"))
        size *= GROWTH
    rows = pairs_scored.select("lang", "phrase", "a", "l", "r", "score").limit(0)
    for part in done:
        rows = rows.unionByName(part)
    ranked = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    first = rows.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= limit)
    return first.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("words").alias("n"), "score")
