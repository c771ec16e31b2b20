"""Packing documents into sequences of a fixed number of tokens, by minimum bin slack."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from campanile.llm.common import Memo, file_bytes, map_texts
from campanile.llm.token_counts import byte_symbols
from campanile.session import cut

#: Characters for which white space parts tokens and lower case is taken letter by letter, in Python as in the library. Texts with others go to it whole.
PLAIN = re.compile("[^\x00-\x1b -\x84\x86-\x9f¡-įı-ſ]")
CONTROL = re.compile("[\x1c-\x1f]")
#: Shares of the rows that are ranked on their own.
SHARES, LEAST_SHARE = 4096, 256


class Encoder:
    """Token ids of texts as little-endian unsigned 32-bit numbers, by a vocabulary of the tokenizers library that drops white space."""

    def __init__(self, file: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(file)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        spec = json.loads(file)
        split, _ = spec["pre_tokenizer"]["pretokenizers"]
        if [n["type"] for n in spec["normalizer"]["normalizers"]] != ["NFC", "Replace", "Lowercase"] or split["behavior"] != "Removed" or not split["invert"]:
            raise ValueError("not a vocabulary whose words are parted by white space and lower-cased")
        self.parts = regex.compile(split["pattern"]["Regex"])
        self.model, self.symbols = self.library.model, byte_symbols()
        self.words = Memo(self.word, room=600_000)
        self.tokens = Memo(self.token, room=600_000)

    def word(self, word: str) -> bytes:
        return b"".join(map(self.tokens.__getitem__, self.parts.findall(word)))

    def token(self, part: str) -> bytes:
        """A part as the library's model merges it."""
        return np.array([t.id for t in self.model.tokenize("".join(map(self.symbols.__getitem__, part.encode())))], "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """White space parts tokens, so words that were met before are looked up. Texts with added tokens or unusual characters take the library's own way."""
        if not text.isascii() and PLAIN.search(text) or text.isascii() and CONTROL.search(text) or any(s in text for s in self.special):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.words.__getitem__, text.lower().split()))


@lru_cache(maxsize=2)
def encoder(file: str) -> Encoder:
    """One for each worker process, so that its memory of words outlives a task."""
    return Encoder(file)


def pieces(df: DataFrame, path: str, capacity: int = 2048, end_id: int = 1, carry: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The documents' ids, each with `end_id` after them, cut at multiples of `capacity`: columns `carry`, start, length, ids_crc32, doc_tokens.

    One pass without shuffle; a null text is empty and gives the one piece of `end_id`. The ids of a document are in memory once, as its text is.
    """
    file = file_bytes(path).decode()
    tail = np.array([end_id], "<u4").tobytes()

    def start() -> Callable:
        encode = encoder(file).encode

        def cut_up(texts):
            raw = [encode(t) + tail for t in texts]
            return [[len(r) // 4 for r in raw], [[zlib.crc32(r[at : at + 4 * capacity]) for at in range(0, len(r), 4 * capacity)] for r in raw]]

        return cut_up

    whole = map_texts(df, list(carry), text, "doc_tokens long, ids_crc32s array<long>", start, rows=128)
    each = whole.select(*carry, "doc_tokens", F.posexplode("ids_crc32s").alias("k", "ids_crc32")).withColumn("start", F.col("k").cast("long") * capacity)
    return each.select(*carry, "start", F.least(F.lit(capacity), F.col("doc_tokens") - F.col("start")).cast("long").alias("length"), "ids_crc32", "doc_tokens")


def fullest(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """How many of each length (each at most as often as counted) sum closest to `capacity` from below.

    Bit t of `reach` says whether some of the lengths so far sum to t. A length's copies are added in powers of two, and each state is kept to read the choice back.
    Longer lengths come first, and of equal sums the one with the longest is taken.
    """
    reach, mask, states = 1, (1 << capacity + 1) - 1, []
    for length in sorted(counts, reverse=True):
        left = min(counts[length], capacity // length)
        step = 1
        while left > 0:
            n = min(step, left)
            states.append((length, n, reach))
            reach |= reach << n * length & mask
            left -= n
            step *= 2
        if reach >> capacity & 1:
            break
    total, chosen = reach.bit_length() - 1, {}
    for length, n, before in reversed(states):
        if not before >> total & 1:
            chosen[length] = chosen.get(length, 0) + n
            total -= n * length
    return chosen


def plan(counts: dict[int, int], capacity: int = 2048) -> list[tuple[dict[int, int], int]]:
    """Fillings of a sequence (how often each length) and how many sequences take each, until all lengths are used up.

    A filling has the longest length left and the multiset of the others that leaves least slack; it is repeated as often as the counts last. After it some length
    has fewer copies left than it took, so the fillings number at most the sum over lengths of capacity / length, whatever the counts.
    """
    left = {length: n for length, n in counts.items() if n > 0}
    if any(not 0 < length <= capacity for length in left):
        raise ValueError("lengths must be from 1 to the capacity")
    made = []
    while left:
        longest = max(left)
        rest = {k: n - (k == longest) for k, n in left.items() if k <= capacity - longest and n > (k == longest)}
        filling = fullest(rest, capacity - longest)
        filling[longest] = filling.get(longest, 0) + 1
        times = min(left[k] // n for k, n in filling.items())
        made.append((filling, times))
        for k, n in filling.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
    return made


def pack(parts: DataFrame, capacity: int = 2048, key: tuple[str, ...] = ("doc_id", "start", "ids_crc32")) -> DataFrame:
    """The rows of `parts` (column length, 1 to `capacity`) with sequence_id and offset.

    Only the number of pieces of each length goes to the driver, and the plan comes back: both are bounded by the capacity. Pieces of a length are
    interchangeable, so their numbers among their length give sequence and place. These numbers are counted in shares, by a hash of `key`, of about a
    4096th of all rows, however frequent a length. Rows equal in `key` are ranked one after another. `parts` is read three times, so hand over a written table.
    """
    hist = {r.length: r.n for r in parts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = max(LEAST_SHARE, sum(hist.values()) // SHARES)
    spark = parts.sparkSession
    cuts = spark.createDataFrame([(k, -(-n // share)) for k, n in hist.items()], "length long, shares long")
    dealt = parts.join(F.broadcast(cuts), "length").withColumn("__share", F.pmod(F.xxhash64(*key), F.col("shares"))).drop("shares")
    sizes = sorted((r.length, r.share, r.n) for r in dealt.groupBy("length", F.col("__share").alias("share")).agg(F.count(F.lit(1)).alias("n")).collect())
    before, offsets = {}, []
    for length, k, n in sizes:
        offsets.append((length, k, before.get(length, 0)))
        before[length] = before.get(length, 0) + n

    slots, taken, sequence = {}, {}, 0
    for filling, times in plan(hist, capacity):
        at = 0
        for length in sorted(filling, reverse=True):
            n = filling[length]
            slots.setdefault(length, []).append((taken.get(length, 0), n, sequence, at))
            taken[length] = taken.get(length, 0) + n * times
            at += n * length
        sequence += times
    lookup = spark.createDataFrame(sorted(slots.items()), "length long, slots array<struct<first: long, n: long, sequence: long, at: long>>")
    starts = spark.createDataFrame(offsets, "length long, __share long, __before long")

    rank = F.row_number().over(Window.partitionBy("length", "__share").orderBy(*key)) - 1
    ranked = dealt.withColumn("__rank", rank).join(F.broadcast(starts), ["length", "__share"]).withColumn("__rank", F.col("__rank") + F.col("__before"))
    # slots ascend by first: the last one that begins at or before the rank
    slot = F.element_at(F.filter("slots", lambda s: s["first"] <= F.col("__rank")), -1)
    found = ranked.join(F.broadcast(lookup), "length").withColumn("__slot", slot).withColumn("__nth", F.col("__rank") - F.col("__slot.first"))
    return found.select(
        *parts.columns, (F.col("__slot.sequence") + F.floor(F.col("__nth") / F.col("__slot.n"))).cast("long").alias("sequence_id"),
        (F.col("__slot.at") + F.col("__nth") % F.col("__slot.n") * F.col("length")).cast("long").alias("offset"),
    )


def pack_documents(df: DataFrame, path: str, capacity: int = 2048, end_id: int = 1, carry: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """Documents tokenized, cut and packed: a row for each piece, with its sequence and its place in it.

    Full pieces fill a sequence alone, the rests are packed by minimum bin slack. The pieces are written to the checkpoint folder once, as the plan needs their
    lengths. Repeated rows and null ids are documents of their own; no rows give no rows.
    """
    return pack(cut(pieces(df, path, capacity, end_id, carry, text)), capacity, (*carry, "start", "ids_crc32"))
