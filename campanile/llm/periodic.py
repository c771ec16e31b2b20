"""Periodic runs of words in texts, by a dictionary of basic factors."""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from campanile.llm.common import map_texts, words_of

#: A run has so many words at least, and repeats its period so often.
LEAST_WORDS, LEAST_REPEATS = 24, 3


def basic_factors(ids: np.ndarray, propose_from: int) -> tuple[list[np.ndarray], list[tuple[np.ndarray, np.ndarray]]]:
    """Names of the factors of 1, 2, 4, ... words at every position, and the successors they propose.

    Equal factors of one length have the same name; a factor that occurs once has the name -1. A factor of twice the length is a pair of names, so only positions where both
    halves occur again need naming, and the levels end where no factor does. Successors are pairs (position, distance to the next occurrence) for levels from `propose_from`
    on, where the distance is at most twice the length; of a progression of occurrences at one distance, and of such pairs at neighbouring positions, the first stands for all.
    """
    alive, keys = np.arange(len(ids)), ids
    names, proposed = [], []
    while alive.size:
        order = np.argsort(keys, kind="stable")
        ranked = keys[order]
        same = ranked[1:] == ranked[:-1]
        level = np.full(len(ids), -1, np.int64)
        again = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        level[alive[order[again]]] = np.cumsum(np.concatenate([[True], ~same]))[again] - 1
        if not again.any():
            break
        k = len(names)
        if k >= propose_from:
            at = alive[order[:-1]]
            gap = np.where(same, alive[order[1:]] - at, 0)
            follows = np.concatenate([[False], (gap[1:] == gap[:-1]) & same[:-1]])  # goes on with the progression before it
            heads = (gap > 0) & (gap <= 2 << k) & ~follows
            at, gap = at[heads], gap[heads]
            by_gap = np.lexsort((at, gap))
            at, gap = at[by_gap], gap[by_gap]
            first = np.concatenate([[True], (np.diff(at) != 1) | (np.diff(gap) != 0)])[: at.size]
            proposed.append((at[first], gap[first]))
        names.append(level)
        left = np.flatnonzero(level[: max(0, len(ids) - (1 << k))] >= 0)
        alive = left[level[left + (1 << k)] >= 0]
        keys = level[alive] * (level.max() + 1) + level[alive + (1 << k)]
    return names, proposed


def extended(names: list[np.ndarray], at: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each pair the longest stretch about it whose words are equal `gap` apart: its start and length, found by one look at each level, longest factors first."""
    n = len(names[0]) if names else 0
    ahead, behind = np.zeros_like(at), np.zeros_like(at)
    for k in range(len(names) - 1, -1, -1):
        level, size = names[k], 1 << k
        for from_, grown, step in ((at + ahead, ahead, size), (at - behind - size, behind, size)):
            inside = (from_ >= 0) & (from_ + gap + size <= n)
            here = level[np.where(inside, from_, 0)]
            grown += step * (inside & (here >= 0) & (here == level[np.where(inside, from_ + gap, 0)]))
    return at - behind, ahead + behind + gap


def runs_of(words: list[str], least_words: int = LEAST_WORDS, least_repeats: int = LEAST_REPEATS) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs by start, then period.

    A run of period q and at least max(least_words, 3 q) words holds a factor of 2**k words and its occurrence q words on, for the least 2**k >= q and also for the greatest
    2**k <= 2/3 least_words. A factor at least as long as the smallest period occurs again no sooner than one period on. So every run is proposed by a successor.
    """
    if len(words) < max(least_words, least_repeats):
        return []
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    names, proposed = basic_factors(ids, max(0, (2 * least_words // 3).bit_length() - 1))
    if not proposed:
        return []
    at, gap = (np.concatenate(x) for x in zip(*proposed))
    start, length = extended(names, at, gap)
    long = length >= np.maximum(least_words, least_repeats * gap)
    shortest: dict[tuple[int, int], int] = {}
    for s, size, q in zip(start[long].tolist(), length[long].tolist(), gap[long].tolist()):
        shortest[s, size] = min(q, shortest.get((s, size), q))  # a multiple of a stretch's smallest period is none of its runs
    return sorted(((s, size, q) for (s, size), q in shortest.items()), key=lambda r: (r[0], r[2]))


def collapsed(words: list[str], runs: list[tuple[int, int, int]]) -> list[str]:
    """The words without those that lie in a run behind its first period."""
    if not runs:
        return words
    kept = np.ones(len(words), bool)
    for start, length, period in runs:
        kept[start + period : start + length] = False
    return list(compress(words, kept.tolist()))


def periodic_runs(df: DataFrame, carry: tuple[str, ...] = ("doc_id",), text: str = "text", least_words: int = LEAST_WORDS, least_repeats: int = LEAST_REPEATS) -> DataFrame:
    """Columns `carry`, n_words, runs (array of start, length, period, counted in words from 0, by start, then period) and collapsed (the text with each run cut to one period).

    A run is a stretch of words with smallest period q, at least `least_words` and `least_repeats` (3 or more) periods long, that no neighbouring word extends. Collapsed texts
    are words joined by single spaces. Each row is its own work: one pass, no shuffle, so repeated rows and hot keys do not matter; a text of n words takes n log n steps and
    8 bytes a word for every length that still repeats. Null, empty and blank texts have no words and no runs; no rows give no rows. A carried column with a name of the
    result gives way to it; other columns are left out.
    """
    if least_repeats < 3:
        raise ValueError("runs of fewer than three periods are not proposed by this method")

    def start():
        def work(texts: list[str]) -> list:
            n, parts, short = [], [], []
            for words in map(words_of, texts):
                runs = runs_of(words, least_words, least_repeats)
                n.append(len(words))
                parts.append(runs)
                short.append(" ".join(collapsed(words, runs)))
            columns = [pa.array([[r[c] for r in runs] for runs in parts], pa.list_(pa.int64())) for c in range(3)]
            return [n, *columns, short]

        return work

    carry = [c for c in carry if c.lower() not in ("runs", "start", "length", "period")]
    found = map_texts(df, carry, text, "n_words long, start array<long>, length array<long>, period array<long>, collapsed string", start)
    return found.select(*[c for c in found.columns if c not in ("start", "length", "period", "collapsed")], F.arrays_zip("start", "length", "period").alias("runs"), "collapsed")
