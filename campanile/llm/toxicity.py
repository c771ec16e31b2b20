"""Toxicity of documents: a subsequence-kernel support vector machine over words, with Nyström landmarks."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from campanile.llm.common import map_texts
from campanile.session import cut

#: Labelled documents learned from, at most; those with the smallest hashes of their ids.
MAX_DOCUMENTS = 20_000
#: Words without a clean text that are looked at in one toxic text.
MAX_WORDS = 2_000
#: Words of clean documents learned from: drawn by hash, the most frequent, and in each round the worst mistakes.
NEGATIVE, FREQUENT, HARD, ROUNDS = 5_000, 1_500, 2_000, 3
LANDMARKS = 192
DECAY = 0.4
#: Letters of a word looked at together; longer words are read in overlapping stretches.
STRETCH, STEP = 22, 8
#: Begin, end, a to z, and what is left for other letters and digits, by their number; neighbouring letters differ.
SIZE = 65
#: Digits and signs that are read as the letter they look like.
LOOKS_LIKE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
#: Signs about a word.
EDGES = ".,;:!?\"'()[]{}#*$%&|<>-_"
#: Letters spelled out one by one, three or more. No sign is both letter and separator, so that a run of one sign is read in one way only.
SPELLED = re.compile(r"(?<!\S)[^\W_](?:[ \t.\-_*]++[^\W_]){2,}(?!\S)")


def letters(word: str) -> list[int]:
    """Codes of a word's letters, signs within it left out, look-alikes read as letters (but for marks at its ends)."""
    codes = []
    for c in word.lower().strip(EDGES):
        c = LOOKS_LIKE.get(c, c)
        if "a" <= c <= "z":
            codes.append(ord(c) - 95)
        elif c.isalnum():
            codes.append(28 + ord(c) % (SIZE - 28))
    return codes


def stretches(word: str) -> list[tuple[int, ...]]:
    """The codes between begin and end marks, in overlapping stretches if there are many."""
    codes = [0, *letters(word), 1]
    if len(codes) <= STRETCH + 2:
        return [tuple(codes)] if len(codes) > 3 else []
    return [tuple(codes[a : a + STRETCH + 2]) for a in range(0, len(codes) - STRETCH - 2 + STEP, STEP)]


@lru_cache(maxsize=64)
def triples(n: int) -> tuple[np.ndarray, np.ndarray]:
    """All index triples of a word of n codes, and the decay to the power of their span."""
    at = np.array(list(combinations(range(n), 3)), np.int64).reshape(-1, 3)
    return at, DECAY ** (at[:, 2] - at[:, 0] + 1.0)


def subsequences(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For words of one length, a row each: the number of every subsequence of three codes, and the triples' weights."""
    at, weight = triples(codes.shape[1])
    return (codes[:, at[:, 0]] * SIZE + codes[:, at[:, 1]]) * SIZE + codes[:, at[:, 2]], weight


def norms(codes: np.ndarray) -> np.ndarray:
    """Square roots of the words' kernels with themselves.

    Dynamic programming over pairs of positions: common subsequences that end at a pair extend those that end before it, decayed by the steps between.
    """
    n = codes.shape[1]
    step = np.tril(DECAY ** (np.arange(n)[:, None] - np.arange(n)[None, :]).clip(0).astype(float), -1)
    same = (codes[:, :, None] == codes[:, None, :]).astype(float)
    ends = same * DECAY**2
    for _ in range(2):
        ends = same * (step @ ends @ step.T)
    return np.sqrt(ends.sum((1, 2)))


def by_length(words: list[tuple[int, ...]]):
    """Numbers and code rows of the words, one length after another, some thousand at a time."""
    order: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        order.setdefault(len(w), []).append(i)
    for rows in order.values():
        for at in range(0, len(rows), 1024):
            part = rows[at : at + 1024]
            yield part, np.array([words[i] for i in part], np.int64)


def table_of(words: list[tuple[int, ...]], weights: np.ndarray) -> np.ndarray:
    """The weighted sum of the words' normalized feature vectors: how much each subsequence counts."""
    table = np.zeros(SIZE**3)
    for rows, codes in by_length(words):
        number, weight = subsequences(codes)
        np.add.at(table, number, weight[None, :] * (weights[rows] / norms(codes))[:, None])
    return table


def apply_tables(words: list[tuple[int, ...]], tables: np.ndarray, place: np.ndarray | None = None) -> np.ndarray:
    """Normalized kernel of each word with each table's vector. `place` says where a subsequence is in tables that leave most out."""
    out = np.zeros((len(words), len(tables)))
    for rows, codes in by_length(words):
        number, weight = subsequences(codes)
        number = number if place is None else place[number]
        length = norms(codes)
        for k, table in enumerate(tables):
            out[rows, k] = table[number] @ weight / length
    return out


@dataclass
class Machine:
    """Margins of words. As the margin is linear in the kernel's explicit features, the landmarks and their coefficients are folded into one table."""

    table: np.ndarray
    bias: float

    def margins(self, words: list[str]) -> np.ndarray:
        """The greatest margin of a word's stretches; words without letters get -2."""
        parts, owner = [], []
        for i, w in enumerate(words):
            own = stretches(w)
            parts += own
            owner += [i] * len(own)
        out = np.full(len(words), -2.0)
        if parts:
            np.maximum.at(out, owner, apply_tables(parts, self.table[None, :])[:, 0] + self.bias)
        return out


def learn(positive: dict[str, float], negative: list[str], seed: int = 0, cost: float = 10.0) -> Machine:
    """A squared-hinge support vector machine in the Nyström space of landmarks: the weightiest positive words and some negative ones. Each kind weighs half."""
    good, weights = zip(*[(s, w) for word, w in sorted(positive.items()) for s in stretches(word)[:1]]) if positive else ((), ())
    bad = [s for w in negative for s in stretches(w)[:1]]
    if not good:
        return Machine(np.zeros(SIZE**3), -1.0)
    words, y = [*good, *bad], np.repeat([1.0, -1.0], [len(good), len(bad)])
    marks = [good[i] for i in sorted(range(len(good)), key=lambda i: (-weights[i], i))[: LANDMARKS // 2]]
    marks += [bad[i] for i in np.random.default_rng(seed).permutation(len(bad))[: LANDMARKS // 2]]
    used = np.unique(np.concatenate([subsequences(np.array([m]))[0].ravel() for m in marks]))
    place = np.full(SIZE**3, len(used), np.int32)  # what no landmark has is in a last column of zeros
    place[used] = np.arange(len(used))
    tables = np.zeros((len(marks), len(used) + 1), np.float32)
    for row, mark in zip(tables, marks):
        row[:-1] = table_of([mark], np.ones(1))[used]
    values, vectors = np.linalg.eigh(apply_tables(marks, tables, place))
    kept = values > 1e-8 * values.max()
    root = vectors[:, kept] / np.sqrt(values[kept])
    x = np.column_stack([apply_tables(words, tables, place) @ root, np.ones(len(words))])
    weight = np.concatenate([np.sqrt(np.array(weights)), np.ones(len(bad))])
    for side in (1.0, -1.0):
        weight[y == side] *= cost * 0.5 * len(y) / max(1.0, weight[y == side].sum())
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    w, active = np.zeros(x.shape[1]), None
    for _ in range(50):  # Newton steps until the set of support vectors stays
        now = y * (x @ w) < 1
        if active is not None and (now == active).all():
            break
        active = now
        z = x[active] * weight[active, None]
        w = np.linalg.solve(ridge + z.T @ x[active], z.T @ y[active])
    return Machine((tables.T @ (root @ w[:-1]))[place], float(w[-1]))


def cover(bags: list[set[str]]) -> dict[str, int]:
    """Words that, taken greedily, are in most bags not met yet, and how many those were; words of one bag alone are not taken."""
    holders: dict[str, set[int]] = {}
    for i, bag in enumerate(bags):
        for word in bag:
            holders.setdefault(word, set()).add(i)
    chosen = {}
    while holders:
        best = max(holders, key=lambda w: (len(holders[w]), w))
        met = holders.pop(best)
        if len(met) < 2:
            break
        chosen[best] = len(met)
        holders = {w: left for w, own in holders.items() if (left := own - met)}
    return chosen


def spelled(text: str) -> list[str]:
    return ["".join(re.findall(r"[^\W_]", m)) for m in SPELLED.findall(text)]


class Scorer:
    """Greatest margin of a text's words; the margins of words met before are looked up."""

    def __init__(self, machine: Machine, room: int = 500_000):
        self.machine, self.room, self.known = machine, room, {}

    def margins(self, texts: list[str]) -> list[float]:
        words = [{*t.lower().split(), *spelled(t)} for t in texts]
        new = list(set().union(*words) - self.known.keys())
        if len(self.known) + len(new) > self.room:
            self.known.clear()
            new = list(set().union(*words))
        self.known.update(zip(new, self.machine.margins(new).tolist()))
        return [max(map(self.known.__getitem__, own), default=-2.0) for own in words]


@dataclass
class Model:
    """A machine, and slope and offset that turn a document's margin into a probability."""

    machine: Machine
    slope: float
    offset: float


def document_margins(df: DataFrame, machine: Machine, carry: list[str], text: str) -> DataFrame:
    sent = df.sparkSession.sparkContext.broadcast(machine)

    def start():
        scorer = Scorer(sent.value)
        return lambda texts: [scorer.margins(texts)]

    return map_texts(df, carry, text, "toxic_margin double", start)


def platt(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve through the labels, with targets drawn in a little as Platt does."""
    up, down = label.sum(), (1 - label).sum()
    target = np.where(label > 0, (up + 1) / (up + 2), 1 / (down + 2))
    x = np.column_stack([margin, np.ones(len(margin))])
    w = np.array([4.0, 0.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p) + 1e-9)[:, None]) + 1e-3 * np.eye(2), x.T @ (p - target) + 1e-3 * (w - [4.0, 0.0]))
        w = w - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def train(df: DataFrame, labels: DataFrame, usable: Column, id_column: str = "doc_id", text: str = "text", label: str = "toxic", most: int = MAX_DOCUMENTS, most_words: int = MAX_WORDS) -> Model:
    """Learn words that make documents toxic from document labels, on at most `most` labelled documents for which `usable` holds.

    A toxic document has some toxic word and a clean one none, so the words sought are those of toxic documents that no clean one has. At first they are the fewest that meet
    most toxic documents; after each training, the word of each toxic document with the greatest margin, if that is enough. The worst mistakes among clean words
    join the negatives. Of each toxic text at most `most_words` such words are looked at, those in the most toxic texts first, so what the driver gets is at most
    `most` times `most_words` short strings however long the texts are. Documents with equal texts count once. Rows with a null label or id are not learned from; without a toxic word all margins are equal.
    """
    ids = labels.where(F.col(id_column).isNotNull() & F.col(label).isNotNull() & usable).groupBy(id_column).agg(F.max(F.col(label).cast("int")).alias("__toxic"))
    ids = ids.orderBy(F.xxhash64(id_column), id_column).limit(most)
    docs = df.join(F.broadcast(ids), id_column).select("__toxic", F.coalesce(F.col(text), F.lit("")).alias("text"))
    parts = F.array_distinct(F.split(F.translate(F.lower("text"), EDGES, " " * len(EDGES)), r"\s+"))
    # the name of the text is made before its words are rows, not once for each
    words = docs.withColumn("copy", F.md5("text")).select("copy", "__toxic", F.explode(parts).alias("word")).where(F.length("word") > 1)
    words = cut(words.groupBy("word", "copy").agg(F.max("__toxic").alias("toxic")))
    counts = words.groupBy("word").agg(F.sum("toxic").alias("up"), F.sum(1 - F.col("toxic")).alias("down"))
    clean = counts.where("down >= 1")
    negative = [r.word for r in clean.orderBy(F.xxhash64("word"), "word").limit(NEGATIVE).collect()]
    negative += [r.word for r in clean.orderBy(F.desc("down"), "word").limit(FREQUENT).collect()]
    only = words.join(counts.where("down = 0"), "word").select("word", "copy", "up")
    place = F.row_number().over(W.partitionBy("copy").orderBy(F.desc("up"), F.xxhash64("word"), "word"))
    only = only.withColumn("place", place).where(F.col("place") <= most_words).drop("place")
    bags: dict[str, set[str]] = {}
    seen = {}
    for r in only.collect():  # at most `most` * `most_words` rows
        bags.setdefault(r.copy, set()).add(r.word)
        seen[r.word] = r.up
    everything = sorted(seen)
    witnesses = cover(list(bags.values()))
    machine = learn(witnesses, negative)
    for turn in range(ROUNDS if witnesses else 0):
        sent = machine

        def start():
            return lambda texts: [sent.margins(texts).tolist()]

        worst = map_texts(clean, ["word"], "word", "margin double", start, rows=4096)
        negative = list(dict.fromkeys(negative + [r.word for r in worst.orderBy(F.desc("margin"), "word").limit(HARD).collect()]))
        margin = dict(zip(everything, machine.margins(everything).tolist()))
        best = [max(bag, key=lambda w: (margin[w] + 0.5 * np.log(seen[w]), w)) for bag in bags.values()]
        witnesses = Counter(w for w in best if margin[w] >= 0.5)
        machine = learn(witnesses, negative, seed=turn + 1)
    found = document_margins(docs, machine, ["__toxic"], "text").collect()
    if not found:
        return Model(machine, 4.0, 0.0)
    return Model(machine, *platt(np.array([r.toxic_margin for r in found]), np.array([float(r["__toxic"]) for r in found])))


def score(df: DataFrame, model: Model, carry: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """Columns `carry`, score (0 to 1, higher: likelier toxic) and predicted (score >= 0.5).

    A document's margin is the greatest of its words and of letters spelled out singly. One pass without shuffle over whole texts; null and empty texts have the lowest
    margin; repeated rows get equal scores.
    """
    margins = document_margins(df, model.machine, list(carry), text)
    value = 1 / (1 + F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), F.lit(model.slope) * F.col("toxic_margin") + F.lit(model.offset)))))
    return margins.withColumn("score", value).withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0)).drop("toxic_margin")
