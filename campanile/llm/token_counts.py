"""Token counts by byte-pair merging, without token ids."""

from __future__ import annotations

import heapq
import json

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from campanile.llm.common import Memo, file_bytes, map_texts


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself if it is visible in Latin-1, else the next from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in visible else chr(next(others)) for b in range(256)]


def merges(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """How many merges byte-pair encoding makes: the adjacent pair of lowest rank first, the leftmost of equals.

    The symbols are a doubly linked list; a heap holds the ranks of adjacent pairs. An entry whose symbols have changed meanwhile is stale and skipped.
    """
    left, right = list(range(-1, len(symbols) - 1)), list(range(1, len(symbols) + 1))
    end = len(symbols)
    heap = [(rank, i, a, b) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if (rank := ranks.get((a, b))) is not None]
    heapq.heapify(heap)
    done = 0
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = right[i]
        if symbols[i] != a or j == end or symbols[j] != b:
            continue
        symbols[i], symbols[j] = a + b, ""
        right[i] = after = right[j]
        if after != end:
            left[after] = i
        done += 1
        if (before := left[i]) >= 0 and (rank := ranks.get((symbols[before], a + b))) is not None:
            heapq.heappush(heap, (rank, before, symbols[before], a + b))
        if after != end and (rank := ranks.get((a + b, symbols[after]))) is not None:
            heapq.heappush(heap, (rank, i, a + b, symbols[after]))
    return done


class Counter:
    """Counts the tokens of texts as a byte-level BPE file of the tokenizers library defines them."""

    def __init__(self, file: str):
        spec = json.loads(file)
        split = spec["pre_tokenizer"]
        if spec["model"]["type"] != "BPE" or spec["normalizer"] or split["type"] != "ByteLevel" or split["add_prefix_space"] or not split["use_regex"]:
            raise ValueError("not a byte-level BPE vocabulary")
        import public_tokenizers

        self.pieces = regex.compile(public_tokenizers.PATTERN)
        self.ranks = {tuple(pair.split(" ") if isinstance(pair, str) else pair): i for i, pair in enumerate(spec["model"]["merges"])}
        self.symbols = byte_symbols()
        added = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.added = regex.compile("|".join(map(regex.escape, added))) if added else None
        self.words = Memo(self.count_word)

    def count_word(self, word: str) -> int:
        raw = [self.symbols[b] for b in word.encode("utf-8", "surrogatepass")]
        return len(raw) - merges(raw, self.ranks)

    def count(self, text: str) -> int:
        """Added tokens in the text count one each, as the library matches them by default."""
        if self.added and self.added.search(text):
            parts = self.added.split(text)
            return len(parts) - 1 + sum(map(self.count, parts))
        return sum(map(self.words.__getitem__, self.pieces.findall(text)))


def count_tokens(df: DataFrame, path: str, limit: int = 512, carry: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """Columns `carry`, n_bytes, n_tokens and over_limit (more than `limit` tokens) of each row.

    One pass over the rows and no shuffle, so neither hot keys nor repeated rows matter. A word met before in a task is looked up. Null and empty texts have 0 tokens;
    a text or word of any length is counted whole, in n log n time. No rows give no rows.
    """
    file = file_bytes(path).decode()

    def start():
        counter = Counter(file)
        return lambda texts: [[len(t.encode("utf-8", "surrogatepass")) for t in texts], [counter.count(t) for t in texts]]

    return map_texts(df, list(carry), text, "n_bytes long, n_tokens long", start).withColumn("over_limit", F.col("n_tokens") > limit)
