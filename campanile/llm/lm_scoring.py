"""Language-model scores of documents: a word unigram base, and a causal self-attention model over subword ids."""

from __future__ import annotations

import base64
import itertools
import math
from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from campanile.llm.attention import SIDE, Parameters, Scorer, Stream, blocks, keep_memory
from campanile.llm.common import OTHER_SPACE, file_bytes, map_texts, shared_folder

#: The most frequent words, sent to every task: at most so many, of at most so many characters, so under 20 MB. All others are joined.
FREQUENT, LONGEST = 250_000, 64
#: Every training text is learned from, whole, in one of so many rounds, by one trainer for each TRAINER texts of the round (on average).
ROUNDS, TRAINER = 2, 2000
#: The common starting point is learned from one text in so many, drawn from all, by one trainer for each PILOT of them (from PILOT texts where that is more).
PILOT_SHARE, PILOT = 64, 1000
#: Steps each trainer takes at least (over the same texts again where they are few), and the first round's rate.
LEAST_STEPS, RATE = 400, 0.06
#: As many vectors of parameters are added up in a task, and come to the driver, at most.
FAN_IN = 32
END, OTHER = 0, 1


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """How many words each text has, and all words one after another, with A to Z in lower case."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    words, bounds = lists.flatten(), lists.offsets.to_numpy()
    there = pc.binary_length(words).to_numpy() > 0  # white space at an end of a text leaves an empty word
    counts = np.diff(np.concatenate([[0], np.cumsum(there)])[bounds - bounds[0]])
    return counts, words if there.all() else words.filter(pa.array(there))


def word_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """(word, n) over all rows. Counts are combined in each task, 2000 texts at a time, and again before the shuffle."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                found = split_words(batch.column("text").slice(at, 2000))[1].value_counts()
                yield pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], names=["word", "n"])

    counted = df.select(F.col(text).alias("text")).mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(counts: DataFrame) -> dict[str, int]:
    """The words above a count that at most FREQUENT reach. The count comes from a histogram of eighths of powers of two, so nothing is sorted."""
    kept = counts.where(F.length("word") <= LONGEST).withColumn("bin", F.floor(F.log2("n") * 8))
    total, least = 0, None
    for r in sorted(kept.groupBy("bin").agg(F.count(F.lit(1)).alias("words")).collect(), key=lambda r: -r.bin):
        total += r.words
        if total > FREQUENT:
            break
        least = r.bin
    return {} if least is None else {r.word: r.n for r in kept.where(F.col("bin") >= least).collect()}


class Subwords:
    """Ids of single words in a byte-level vocabulary of the tiktoken library, the space before the word included."""

    def __init__(self, file: bytes):
        import public_tokenizers
        import tiktoken

        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file.splitlines())}
        self.size = len(ranks)
        self.ids = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.begins = np.zeros(max(ranks.values(), default=-1) + 1, bool)
        self.begins[[i for token, i in ranks.items() if token[:1] == b" "]] = True

    def of(self, word: str) -> list[int]:
        return self.ids(" " + word)

    def of_all(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words one after another, and how many each has.

        Words joined by spaces have the ids they have alone: a space goes with what follows it, and only a word's first id begins with one. Words with other white space are taken alone.
        """
        parts, lengths = [], []
        for at in range(0, len(words), 1000):
            some = words[at : at + 1000]
            joined = " ".join(some)
            ids = [] if OTHER_SPACE.search(joined) else self.ids(" " + joined)
            starts = np.flatnonzero(self.begins[ids]) if ids else []
            if len(starts) == len(some):
                lengths.append(np.diff(starts, append=len(ids)))
            else:
                each = [self.of(w) for w in some]
                ids = [i for word in each for i in word]
                lengths.append([len(word) for word in each])
            parts.append(ids)
        return tuple(np.concatenate([*map(np.asarray, x), []]).astype(np.int64) for x in (parts, lengths))


def subword_counts(counts: DataFrame, file: bytes) -> np.ndarray:
    """How often each id occurs in the words counted; the table has as many rows as the vocabulary at most."""

    def run(batches):
        subwords = Subwords(file)
        total = np.zeros(subwords.size, np.int64)
        for batch in batches:
            ids, lengths = subwords.of_all(batch.column("word").to_numpy(zero_copy_only=False).tolist())
            np.add.at(total, ids, np.repeat(batch.column("n").to_numpy(), lengths))
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total[ids], pa.int64())], names=["id", "n"])

    rows = counts.select("word", "n").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(Subwords(file).size, np.int64)
    for r in rows:
        total[r.id] = r.n
    return total


@dataclass
class Symbols:
    """The model's symbols: the end, one for all rare ids, and the most frequent ids. A rare id has its share of the rare ones besides."""

    number: dict[int, int]
    counts: np.ndarray
    rest: np.ndarray

    @classmethod
    def of(cls, counts: np.ndarray, documents: int) -> Symbols:
        order = np.argsort(-counts, kind="stable")
        known = order[: SIDE * SIDE - 2].tolist()
        rare = counts.astype(float)
        rare[known] = 0
        share = np.log((rare + 0.5) / (rare.sum() + 0.5 * (len(counts) - len(known))))
        return cls({i: k + 2 for k, i in enumerate(known)}, np.concatenate([[documents, rare.sum()], counts[known]]).astype(float), share)

    def encode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids' symbols as 16-bit numbers, and the logarithms of the rare ids' shares (0 for the others)."""
        table = np.full(len(self.rest), OTHER, np.uint16)
        table[list(self.number)] = list(self.number.values())
        symbols = table[ids]
        return symbols, np.where(symbols == OTHER, self.rest[ids], 0.0)


@dataclass
class Entries:
    """What is known of words by their numbers: where their symbols begin and how many they are, the rare ids' shares, the base (NaN if not frequent)."""

    symbols: np.ndarray
    begins: np.ndarray
    lengths: np.ndarray
    rests: np.ndarray
    bases: np.ndarray

    @classmethod
    def end(cls) -> Entries:
        """The end alone."""
        return cls(np.array([END], np.uint16), np.zeros(1, np.int64), np.ones(1, np.int64), np.zeros(1), np.zeros(1))

    def with_words(self, words: list[str], bases: np.ndarray, subwords: Subwords, marks: Symbols) -> Entries:
        if not words:
            return self
        ids, lengths = subwords.of_all(words)
        symbols, rests = marks.encode(ids)
        begins = np.cumsum(lengths) - lengths
        new = (symbols, begins + len(self.symbols), lengths, np.add.reduceat(rests, begins), bases)
        return Entries(*(np.concatenate(x) for x in zip((self.symbols, self.begins, self.lengths, self.rests, self.bases), new)))


class Lexicon(defaultdict):
    """Numbers of words: 0 is the end, as the word "", then come the frequent words, whose entries every task is given, and those met, in the order they came.

    It is emptied down to the frequent words where it has grown beyond its room; that never changes a result.
    """

    def __init__(self, subwords: Subwords, marks: Symbols, given: dict[str, int], entries: Entries, room: int = 400_000, characters: int = 8_000_000):
        super().__init__()
        self.subwords, self.marks, self.given, self.first, self.room, self.characters = subwords, marks, given, entries, room, characters
        self.empty()

    def empty(self) -> None:
        self.clear()
        self.update(self.given)
        self.default_factory = itertools.count(len(self)).__next__
        self.names, self.held, self.entries = [], 0, self.first

    def numbers(self, words: list[str]) -> np.ndarray:
        if self.names and (len(self) > self.room or self.held > self.characters):
            self.empty()
        known = len(self)
        found = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        new = list(itertools.islice(reversed(self), len(self) - known))[::-1]
        self.entries = self.entries.with_words(new, np.full(len(new), np.nan), self.subwords, self.marks)
        self.names += new
        self.held += sum(map(len, new))
        return found


def _drawn(seed: int, below: int) -> Column:
    """A whole number from 0 to below - 1 for each row, by its column `draw`."""
    return F.pmod(F.xxhash64("draw", F.lit(seed)), F.lit(below))


def _pilot(rows: DataFrame, documents: int) -> tuple[DataFrame, int]:
    """The rows the starting point is learned from, each with its `trainer`, and how many trainers there are."""
    n = max(documents / PILOT_SHARE, PILOT)
    trainers = math.ceil(n / PILOT)
    return rows.where(_drawn(0, 2**31) * F.lit(1.0) < n / max(documents, 1) * 2**31).withColumn("trainer", _drawn(2, trainers)), trainers


def _round(rows: DataFrame, documents: int, turn: int) -> tuple[DataFrame, int]:
    """The rows learned from in a round from 1 to ROUNDS, each with its `trainer`, and how many trainers there are. Each row is in one round."""
    trainers = math.ceil(max(documents, 1) / ROUNDS / TRAINER)
    return rows.where(_drawn(1, ROUNDS) == turn - 1).withColumn("trainer", _drawn(2, trainers)), trainers


def _learned(rows: DataFrame, trainers: int, begin: Parameters, rate: float) -> Parameters | None:
    """The mean, by tokens, of what the trainers make of `begin`, each from the rows of its own in the order of their draws.

    Which rows a trainer has, and their order, follow from ids and texts, so the result does not depend on the partitions (but for the last digits of sums).
    A task goes through its trainers one after another, holds a buffer of windows, and gives one sum; sums are added in tasks until few are left.
    """

    def run(batches):
        total, tokens, now, stream = 0.0, 0, None, None
        for batch in batches:
            ids, raws = batch.column("trainer").to_numpy(), batch.column("symbols").to_pylist()
            cuts = [0, *(1 + np.flatnonzero(np.diff(ids))).tolist(), len(ids)]
            for begins, ends in zip(cuts, cuts[1:]):
                if begins == ends:
                    continue
                if ids[begins] != now:
                    if stream:
                        total, tokens = total + stream.tokens * stream.end().flat().astype(float), tokens + stream.tokens
                    now, stream = ids[begins], Stream(begin, rate, LEAST_STEPS)
                for at in range(begins, ends, 64):
                    stream.add(*blocks([symbols_of(raw) for raw in raws[at : min(at + 64, ends)]], END)[:2])
        if stream:
            total, tokens = total + stream.tokens * stream.end().flat().astype(float), tokens + stream.tokens
            yield _weighted(total / tokens, tokens)

    def add(batches):
        total, tokens = 0.0, 0
        for batch in batches:
            for n, raw in zip(batch.column("n").to_pylist(), batch.column("parameters").to_pylist()):
                total, tokens = total + n * np.frombuffer(raw, "<f8"), tokens + n
        if tokens:
            yield _weighted(total / tokens, tokens)

    spark = rows.sparkSession
    parts = min(trainers, max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism))
    dealt = rows.select("trainer", "draw", "symbols").repartition(parts, "trainer").sortWithinPartitions("trainer", "draw")
    sums = dealt.mapInArrow(run, "n long, parameters binary")
    while parts > FAN_IN:
        parts = math.ceil(parts / FAN_IN)
        sums = sums.repartition(parts).mapInArrow(add, "n long, parameters binary")
    return _mean(sums)


def _weighted(parameters: np.ndarray, tokens: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([tokens], pa.int64()), pa.array([parameters.astype("<f8").tobytes()], pa.binary())], names=["n", "parameters"])


def _mean(sums: DataFrame) -> Parameters | None:
    """The mean of a few rows of parameters by tokens; None without rows."""
    rows = sorted(sums.collect(), key=lambda r: (r.n, r.parameters))
    if not rows:
        return None
    return Parameters.of(sum(r.n * np.frombuffer(r.parameters, "<f8") for r in rows) / sum(r.n for r in rows))


def train(rows: DataFrame, symbols: Symbols) -> Parameters:
    """Parameters learned from all `rows` (draw, symbols), which are `symbols.counts[END]`.

    Starting from the corpus-wide counts, a common starting point is learned from texts drawn from all; with more texts there are more trainers of it, whose mean is
    taken. Then trainers, each with about TRAINER texts drawn for it, go on from there in each of two rounds, and the mean of all is taken after each; more texts mean
    more trainers, not shorter ones. Each token of each text, its end too, is learned from in one round. Rows equal in id and text have the same trainer.
    """
    documents = int(symbols.counts[END])
    now = Parameters.start(symbols.counts)
    now = _learned(*_pilot(rows, documents), now, RATE) or now
    for turn in range(1, ROUNDS + 1):
        now = _learned(*_round(rows, documents, turn), now, RATE / 2**turn) or now
    return now


def symbols_of(raw: bytes) -> np.ndarray:
    """A text's symbols and the end, from the bytes of the symbols."""
    return np.frombuffer(raw, np.uint16).astype(np.int32)


def _lists(kind: pa.DataType, offsets: np.ndarray, values: pa.Buffer) -> pa.Array:
    return pa.Array.from_buffers(kind, len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), values])


def prepared(df: DataFrame, text: str, carry: list[str], file: bytes, symbols: Symbols, frequent: dict[str, int], base: Callable[[int], float]) -> DataFrame:
    """Each row's columns `carry` and its words once for all: their symbols with the end, the rare ids' shares, the base's sum over frequent words, and the other words with their counts."""
    given = {w: i for i, w in enumerate(["", *frequent])}
    entries = Entries.end().with_words(list(frequent), np.array([base(n) for n in frequent.values()]), Subwords(file), symbols)
    sent = df.sparkSession.sparkContext.broadcast((given, entries, symbols))

    def start():
        given, entries, marks = sent.value
        lexicon = Lexicon(Subwords(file), marks, given, entries)
        keep_memory()

        def read(texts):
            n_words, words = split_words(pa.array(texts, pa.string()))
            coded = words.dictionary_encode()
            each = lexicon.numbers(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
            ends = np.cumsum(n_words + 1)
            begins, known = ends - n_words - 1, lexicon.entries
            is_word = np.ones(ends[-1], bool)
            is_word[ends - 1] = False
            numbers = np.zeros(ends[-1], np.int64)
            numbers[is_word] = each[coded.indices.to_numpy()]
            lengths, bases = known.lengths[numbers], known.bases[numbers]
            after = np.cumsum(lengths)
            symbols = known.symbols[np.repeat(known.begins[numbers] - after + lengths, lengths) + np.arange(after[-1])]
            joined = _lists(pa.binary(), 2 * np.append(0, after[ends - 1]), pa.py_buffer(symbols))
            # words that are not frequent, once in each text
            rare = np.flatnonzero(np.isnan(bases))
            bases[rare] = 0
            owner = np.searchsorted(ends, rare, side="right")
            each, times = np.unique(owner * len(lexicon) + numbers[rare], return_counts=True)
            cuts = np.searchsorted(each, np.arange(len(ends) + 1) * len(lexicon))
            names = pa.array([lexicon.names[i] for i in (each % len(lexicon) - len(given)).tolist()], pa.string())
            rests, sums = np.add.reduceat(known.rests[numbers], begins), np.add.reduceat(bases, begins)
            offsets = pa.array(cuts, pa.int32())
            lists = pa.ListArray.from_arrays(offsets, names), pa.ListArray.from_arrays(offsets, pa.array(times, pa.int64()))
            return [n_words, n_words - np.bincount(owner, minlength=len(ends)), sums, joined, rests, *lists]

        return read

    return map_texts(df, carry, text, "n_words long, n_frequent long, base_frequent double, symbols binary, rest double, words array<string>, times array<long>", start, rows=256)


def scored(rows: DataFrame, model: Parameters, carry: list[str]) -> DataFrame:
    """The columns `carry` of prepared rows and the model's log10 probability of each."""
    sent = rows.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([rows.schema[c] for c in carry] + [T.StructField("score", T.DoubleType())])

    def run(batches):
        probability = Scorer(sent.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                scores = np.array(part.column("rest").to_pylist())
                seen, wanted, owner = blocks([symbols_of(raw) for raw in part.column("symbols").to_pylist()], END)
                for first in range(0, len(seen), 1024):  # so many windows stay in the processor's cache
                    some = slice(first, first + 1024)
                    np.add.at(scores, owner[some], probability(seen[some], wanted[some]).sum(1, dtype=float))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carry), pa.array(scores / math.log(10))], names=schema.names)

    return rows.select(*carry, "symbols", "rest").mapInArrow(run, schema)


def score(df: DataFrame, usable: Column, path: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of `df`: the id, n_tokens, n_known, train_tokens, base_score and score, learned from the rows for which `usable` holds.

    Tokens are words (A to Z in lower case) and one end. base_score is the unigram's log10 probability, score the attention model's: the product over the subword ids
    of the words and the end. Frequent words' counts go to all tasks; the other words of each row are joined to theirs, combined by row. Null and empty texts are
    the end alone; long ones are scored whole, window by window; repeated rows get a row each. Without training rows every word is unknown. An empty table gives no rows.

    Words are made symbols once, in a table in the shared folder (2 bytes a symbol), which training and scoring read. What is learned depends on ids and texts only,
    not on the partitions.
    """
    spark, file = df.sparkSession, file_bytes(path)
    folder = shared_folder(spark, "lm")
    learned = df.where(usable)
    word_counts(learned, text).write.parquet(f"{folder}/counts")
    counts = spark.read.parquet(f"{folder}/counts")
    documents = learned.count()
    words, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    n, below = words + documents, words + documents + 0.5 * (distinct + (documents > 0) + 1)
    base = lambda c: math.log10((c + 0.5) / below)
    frequent = frequent_words(counts)
    symbols = Symbols.of(subword_counts(counts, file), documents)
    # copies of a text under other ids are drawn apart
    drawn = F.when(usable, F.xxhash64(id_column, text)).alias("draw")
    numbered = df.select(F.col(id_column), F.col(text), drawn, F.monotonically_increasing_id().alias("row_id"))
    prepared(numbered, text, [id_column, "row_id", "draw"], file, symbols, frequent, base).write.parquet(f"{folder}/prepared")
    rows = spark.read.parquet(f"{folder}/prepared")
    model = train(rows.where("draw IS NOT NULL"), symbols)
    rare = rows.select("row_id", F.explode(F.arrays_zip("words", "times")).alias("w")).select("row_id", F.col("w.words").alias("word"), F.col("w.times").alias("times"))
    found = rare.join(counts, "word", "left").select("row_id", (F.col("times") * F.log10((F.coalesce("n", F.lit(0)) + 0.5) / below)).alias("base"), F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0).alias("known"))
    sums = found.groupBy("row_id").agg(F.sum("base").alias("base_rare"), F.sum("known").alias("n_rare"))
    out = scored(rows, model, [id_column, "row_id", "n_words", "n_frequent", "base_frequent"]).join(sums, "row_id", "left")
    return out.select(
        id_column, (F.col("n_words") + 1).alias("n_tokens"), (F.col("n_frequent") + F.coalesce("n_rare", F.lit(0)) + int(documents > 0)).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base_frequent") + F.coalesce("base_rare", F.lit(0.0)) + base(documents)).alias("base_score"), "score",
    )
