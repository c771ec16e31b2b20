"""Quality rules as a short-circuit cascade, ordered by what a sample says of their cost and selectivity."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from campanile.llm.common import map_texts, words_of

SYMBOLS = "#*$%&|<>"


class Document:
    """What the rules ask of a text, each computed when first asked for."""

    def __init__(self, text: str):
        self.text = text

    @cached_property
    def words(self) -> list[str]:
        return words_of(self.text)

    @property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return sum(map(len, self.words))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def lines(self) -> list[str]:
        """The lines that have a word."""
        return [x for x in self.text.split("\n") if x.strip(" \t\n\v\f\r")]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words in windows of three that occur twice or more, the first occurrence included."""
        n = self.n_words
        if n < 4:
            return 0
        seen: dict[str, int] = {}
        ids = np.fromiter((seen.setdefault(w, len(seen)) for w in self.words), np.int64, n)
        pairs = ids[:-1] * len(seen) + ids[1:]
        if len(seen) >= 2_000_000:  # the product of three would not fit
            pairs = np.unique(pairs, return_inverse=True)[1]
        windows = pairs[:-1] * len(seen) + ids[2:]
        ordered = np.sort(windows)
        twice = ordered[1:][ordered[1:] == ordered[:-1]]
        if not len(twice):
            return 0
        again = np.flatnonzero(np.isin(windows, twice))
        marked = np.zeros(n, bool)
        for k in range(3):
            marked[again + k] = True
        return int(marked.sum())

    @cached_property
    def n_lettered(self) -> int:
        """Words with a letter or digit in them."""
        return sum(any(map(str.isalnum, w)) for w in self.words)


@dataclass(frozen=True)
class Rule:
    """A name and whether a document fails it."""

    name: str
    fails: Callable[[Document], bool]


#: The two rules that decide base_failed.
BASE = (
    Rule("few_words", lambda d: d.n_words < 50),
    Rule("repeated_words", lambda d: 100 * d.n_repeat_words > 50 * d.n_words),
)
RULES = (
    *BASE,
    Rule("symbols", lambda d: 10 * d.n_symbols > d.n_words),
    Rule("duplicate_lines", lambda d: 2 * d.n_dup_lines > len(d.lines)),
    Rule("word_length", lambda d: not 2 * d.n_words <= d.word_chars <= 20 * d.n_words),
    Rule("unlettered_words", lambda d: 10 * d.n_lettered < 7 * d.n_words),
)


def ordered_rules(df: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", sample: int = 400) -> list[Rule]:
    """The rules by documents rejected per second, the best first, measured on the first `sample` rows found.

    The order changes the cost of a cascade, never its verdict.
    Each rule is timed on a fresh document, so its features count as its own. Equal rules, and all rules without rows, stay in the given order.
    """

    def start():
        def measure(texts):
            seconds, rejected = [], []
            for t in texts:
                spent, failed = [], []
                for rule in rules:
                    began = time.perf_counter_ns()
                    failed.append(int(bool(rule.fails(Document(t)))))
                    spent.append(time.perf_counter_ns() - began)
                seconds.append(spent)
                rejected.append(failed)
            return [seconds, rejected]

        return measure

    some = df.where(F.col(text).isNotNull()).limit(sample)
    rows = map_texts(some, [], text, "spent array<long>, rejected array<long>", start).select(F.posexplode(F.arrays_zip("spent", "rejected")).alias("rule", "x"))
    found = {r.rule: r.rejected / max(r.spent, 1) for r in rows.groupBy("rule").agg(F.sum("x.spent").alias("spent"), F.sum("x.rejected").alias("rejected")).collect()}
    return [rules[k] for k in sorted(range(len(rules)), key=lambda k: (-found.get(k, 0.0), k))]


def cascade(df: DataFrame, rules: Sequence[Rule] = RULES, metrics: Sequence[str] = (), carry: Sequence[str] = ("doc_id",), text: str = "text", sample: int = 400) -> DataFrame:
    """Columns `carry`, the `metrics` (features of Document) asked for, kept, failed_rule (the first that rejects; null if kept) and rules_tried.

    One pass without shuffle; a rejected row is spared the later rules. Null and empty texts have no words and so fail few_words. Texts of any length are judged
    whole, repeated rows each get their verdict, no rows give no rows.
    """
    order = ordered_rules(df, rules, text, sample)

    def start():
        def judge(texts):
            columns = [[] for _ in range(len(metrics) + 3)]
            for document in map(Document, texts):
                tried, failed = 0, None
                for rule in order:
                    tried += 1
                    if rule.fails(document):
                        failed = rule.name
                        break
                for column, value in zip(columns, [*(getattr(document, m) for m in metrics), failed is None, failed, tried]):
                    column.append(value)
            return columns

        return judge

    fields = ", ".join([*(f"{m} long" for m in metrics), "kept boolean", "failed_rule string", "rules_tried int"])
    return map_texts(df, list(carry), text, fields, start)
