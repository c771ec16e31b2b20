"""SentencePiece encoding and decoding by a max-plus scan over chunks of the texts."""

from __future__ import annotations

import re
from array import array
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from campanile.llm.common import Memo, file_bytes, map_texts
from campanile.session import cut

SPACE = "▁"
#: Code points in a chunk, and chunks whose matrices are multiplied together at a time.
CHUNK, FAN = 16_384, 64
#: No path.
NEVER = -(2**60)
#: Words worked out at a time, and a sum that no path has (two of them can still be added).
TOGETHER, ABSENT = 2048, -(2**61)


class Pieces:
    """The pieces of a SentencePiece file with whole-number scores; a text's encoding is the sequence of pieces with the greatest sum.

    A unigram file's scores are its own. A BPE file has only an order; a piece of rank r then scores -ln(r + 20), as Zipf's law has it. Characters without a piece become byte
    pieces and cost as much as the rarest piece and 10 more. A hash of the piece in the low bits parts most ties; of the same pieces in another order, any may be taken.
    """

    def __init__(self, file: bytes):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=file)
        n = model.get_piece_size()
        self.bytes = [0] * 256
        self.text: list[bytes] = []
        names, raw = [], []
        for i in range(n):
            name = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes[int(name[3:5], 16)] = i
                self.text.append(bytes([int(name[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i):
                self.text.append(b"")
            else:
                self.text.append(name.replace(SPACE, " ").encode())
                names.append((name, i))
                raw.append(model.get_score(i))
        unigram = not all(float(s).is_integer() for s in raw)
        scores = np.array(raw) if unigram else -np.log(np.arange(len(raw)) + 20.0)
        self.real = {name: float(s) for (name, _), s in zip(names, scores)}
        self.other = float(scores.min()) - 10.0
        # scores of pieces; beginnings of pieces that are none have no score
        self.prefixes: dict[str, int | None] = {name[:n]: None for name in self.real for n in range(1, len(name))}
        self.prefixes |= {name: self.whole(name, s) for name, s in self.real.items()}
        self.id = dict(names)
        self.longest = max(map(len, self.id))
        # where a run of spaces begins after another character no piece can lie across, if no piece has a space within
        self.seams = not any(SPACE in name.lstrip(SPACE) for name in self.id)
        self.units = Memo(self.unit, room=120_000)
        self.code = None

    @staticmethod
    def whole(name: str, score: float) -> int:
        return (round(score * 1e4) << 20) + xxhash.xxh32_intdigest(name.encode()) % (1 << 20)

    def _tree(self) -> None:
        """The tree of all beginnings of pieces as arrays, for steps on many places at once: the next state is `onward[state] + code`, if its `parent` is the state.

        Codes number the characters that pieces have, and are the states of these; all others have code 0. The number of a character that is no piece is -1 less its code point.
        """
        rng = np.random.default_rng(1)
        letters = sorted({c for name in self.real for c in name})
        self.code = np.zeros(0x110000, np.uint16 if len(letters) < 2**16 else np.uint32)
        self.code[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        number = dict(zip(letters, range(1, len(letters) + 1)))
        below: dict[str, list[str]] = {}
        for name in self.prefixes:
            if len(name) > 1:
                below.setdefault(name[:-1], []).append(name)
        size = 8 * len(self.prefixes) + len(letters) + 2
        self.onward, self.parent = np.zeros(size, np.int32), np.full(size, -1, np.int32)
        self.score, self.own = np.zeros(size, np.int64), np.full(size, -1, np.int32)  # true scores are below 0
        # children lie at a drawn distance where all of them find room, the largest families first
        families = [(np.array([number[n[-1]] for n in names]), name, names) for name, names in sorted(below.items(), key=lambda x: -len(x[1]))]
        taken = np.zeros(size, bool)
        taken[: len(letters) + 1] = True
        at, place = dict(number), []  # the state of each beginning
        for codes, _, names in families:
            while taken[states := codes + int(rng.integers(1, size - len(letters) - 1))].any():
                pass
            taken[states] = True
            place.append(states)
            at.update(zip(names, states.tolist()))
        for (codes, name, _), states in zip(families, place):
            self.onward[at[name]] = states[0] - codes[0]
            self.parent[states] = at[name]
        for name, state in at.items():
            if self.prefixes[name] is not None:
                self.score[state], self.own[state] = self.prefixes[name], self.id[name]
            elif len(name) == 1:
                self.score[state], self.own[state] = self.whole(name, self.other), -1 - ord(name)

    def units_of(self, words: list[str]) -> list[tuple[bytes, int]]:
        """What `units` gives for each of the words; those not met before are worked out together."""
        units = self.units
        found = list(map(units.get, words))
        blank = [i for i, unit in enumerate(found) if unit is None]
        if blank:
            new = [w for w in {words[i] for i in blank} if len(w) <= units.longest] if self.longest < 32 else []
            if len(units) + len(new) > units.room:
                units.clear()
            new.sort(key=len, reverse=True)
            for first in range(0, len(new), TOGETHER):
                self._meet(new[first : first + TOGETHER])
            for i in blank:
                found[i] = units[words[i]]
        return found

    def _meet(self, words: list[str]) -> None:
        """Puts ids and sums of words, the longest first, into `units`: the steps of `best` on all words at once, place by place.

        `edges` has, for each place j, a row for each length of a piece that ends there (the longest first), over the words that have a place j; a sum is held 32 times with
        the length of the last piece added, so that the greatest tells both and of equal sums the longest last piece is taken, as in `best`.
        """
        if self.code is None:  # workers that only decode need no tree
            self._tree()
        lengths = np.array([len(w) for w in words])
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        code = self.code[points]
        width, longest = self.longest, int(lengths[0])
        row = np.repeat(np.arange(len(words)), lengths)
        ends = np.cumsum(lengths)
        index = np.arange(len(code)) - np.repeat(ends - lengths, lengths)
        active = np.searchsorted(-lengths, -np.arange(longest + 1), side="right")  # words of at least so many places
        begins = np.concatenate([[0, 0], np.cumsum(active[1:-1]) * width])  # of the rows of place j
        edges = np.full(int(active[1:].sum()) * width, ABSENT, np.int64)
        owns = np.zeros(len(edges), np.int32)
        alone = np.flatnonzero(code == 0)
        cell = begins[index[alone] + 1] + (width - 1) * active[index[alone] + 1] + row[alone]
        edges[cell] = np.array([self.whole(chr(c), self.other) for c in points[alone]], np.int64) * 32 + 1
        owns[cell] = -1 - points[alone].astype(np.int32)
        at, state = np.flatnonzero(code), code[code != 0].astype(np.int32)
        tops, left = begins + width * active, np.repeat(ends, lengths) - np.arange(len(code))
        for n in range(1, width + 1):
            score = self.score.take(state)
            real = np.flatnonzero(score)
            some = at.take(real)
            j = index.take(some) + n
            cell = tops.take(j) - n * active.take(j) + row.take(some)
            edges[cell] = score.take(real) * 32 + n
            owns[cell] = self.own.take(state.take(real))
            begin = self.onward.take(state)
            inside = np.flatnonzero((begin > 0) & (left.take(at) > n))
            at, state = at.take(inside), state.take(inside)
            letter = code.take(at + n)
            onward = begin.take(inside) + letter
            found = np.flatnonzero((self.parent.take(onward) == state) & (letter > 0))
            at, state = at.take(found), onward.take(found)
            if not len(at):
                break
        sums = np.full((width + longest + 1, len(words)), ABSENT, np.int64)
        sums[width] = 0
        last = np.zeros((longest + 1, len(words)), np.int64)
        for j in range(1, longest + 1):
            n = active[j]
            greatest = (sums[j : j + width, :n] + edges[begins[j] : begins[j] + width * n].reshape(width, n)).max(0)
            last[j, :n] = greatest & 31
            sums[j + width, :n] = greatest & ~31
        places, rows, back = lengths.copy(), np.arange(len(words)), []
        while len(rows):
            j = places[rows]
            length = last[j, rows]
            back.append((rows, owns[begins[j] + (width - length) * active[j] + rows]))
            places[rows] -= length
            rows = rows[places[rows] > 0]
        counts = np.zeros(len(words), np.int64)
        for rows, _ in back:
            counts[rows] += 1
        stops = np.cumsum(counts)
        ids = np.zeros(int(stops[-1]), "<i4")
        for n, (rows, own) in enumerate(back):
            ids[stops[rows] - 1 - n] = own
        raw, totals = ids.tobytes(), (sums[width + lengths, np.arange(len(words))] >> 5).tolist()
        pairs = [(raw[a:b], total) for a, b, total in zip(((stops - counts) * 4).tolist(), (stops * 4).tolist(), totals)]
        for r in set(np.repeat(np.arange(len(words)), counts)[ids < 0].tolist()):
            pairs[r] = self._in_bytes(ids[stops[r] - counts[r] : stops[r]].tolist()), totals[r]
        self.units.update(zip(words, pairs))

    def _in_bytes(self, ids: list[int]) -> bytes:
        """Ids in which each character without a piece is replaced by those of its bytes."""
        parts = [[i] if i >= 0 else [self.bytes[b] for b in chr(-1 - i).encode("utf-8", "surrogatepass")] for i in ids]
        return array("i", [i for part in parts for i in part]).tobytes()

    def best(self, text: str, begin: int, end: int) -> tuple[list[int], list[int]]:
        """For each place from `begin` on, the greatest sum of pieces from there to it that begin before `end`, and the length of the last."""
        size = len(text)
        total, last = [NEVER] * (size + 1), [0] * (size + 1)
        total[begin] = 0
        look_up = self.prefixes.get
        for at in range(begin, end):
            here = total[at]
            if here == NEVER:
                continue
            score = look_up(text[at])
            if score is None:  # no piece of its own
                score = self.whole(text[at], self.other)
            if here + score > total[at + 1]:
                total[at + 1], last[at + 1] = here + score, 1
            for stop in range(at + 2, min(at + self.longest, size) + 1):
                score = look_up(text[at:stop], 0)  # true scores are below 0
                if score == 0:
                    break
                if score is not None and here + score > total[stop]:
                    total[stop], last[stop] = here + score, stop - at
        return total, last

    def path(self, text: str, begin: int, end: int, stop: int) -> bytes:
        """Ids, as 32-bit numbers, of the best pieces from `begin` to `stop` that begin before `end`."""
        return self.traced(text, begin, stop, self.best(text, begin, end)[1])

    def traced(self, text: str, begin: int, stop: int, last: list[int]) -> bytes:
        ids, at = [], stop
        while at > begin:
            piece = text[at - last[at] : at]
            own = self.id.get(piece)
            ids += [own] if own is not None else [self.bytes[b] for b in reversed(piece.encode("utf-8", "surrogatepass"))]
            at -= last[at]
        ids.reverse()
        return array("i", ids).tobytes()

    def unit(self, text: str) -> tuple[bytes, int]:
        """Ids and sum of a stretch that is encoded by itself."""
        total, last = self.best(text, 0, len(text))
        return self.traced(text, 0, len(text), last), total[-1]

    def split(self, text: str) -> list[str]:
        """Stretches no piece lies across."""
        return _UNITS.findall(text) if self.seams else [text]

    def encode(self, text: str) -> bytes:
        return b"".join([ids for ids, _ in self.units_of(self.split(text))])

    def encode_all(self, texts: list[str]) -> list[bytes]:
        words = list(map(self.split, texts))
        ids = [ids for ids, _ in self.units_of([w for some in words for w in some])]
        ends = np.cumsum([0, *map(len, words)]).tolist()
        return [b"".join(ids[a:b]) for a, b in zip(ends, ends[1:])]

    def first_seam(self, text: str, size: int) -> int | None:
        if not self.seams:
            return None
        found = _SEAM.search(text, 0, min(len(text), size + 1))
        return found.start() + 1 if found and 0 < found.start() + 1 < size else None

    def last_seam(self, text: str, size: int) -> int:
        at = text.rfind(SPACE, 0, size)
        while at > 0 and text[at - 1] == SPACE:
            at -= 1
        return at

    def transfer(self, text: str, size: int) -> np.ndarray:
        """Greatest sums between the boundaries of a chunk: its first `size` code points, with some that follow. Row: the code points at its begin that a piece from before
        covers; column: those after its end that its last piece covers."""
        width = self.longest
        out = np.full((width, width), NEVER, np.int64)
        seam = self.first_seam(text, size)
        if seam is None:
            for entry in range(min(width, size + 1)):
                total, _ = self.best(text, entry, size)
                ends = total[size : size + width]
                out[entry, : len(ends)] = ends
            if size < width:  # a piece over the whole chunk and more
                for entry in range(size, width):
                    out[entry, entry - size] = max(out[entry, entry - size], 0)
            return out
        final = max(seam, self.last_seam(text, size))
        heads = [self.best(text[:seam], entry, seam)[0][seam] if entry <= seam else NEVER for entry in range(width)]
        middle = sum([total for _, total in self.units_of(self.split(text[seam:final]))])
        tails = self.best(text[final:], 0, size - final)[0][size - final : size - final + width]
        for entry, head in enumerate(heads):
            if head > NEVER:
                for leave, tail in enumerate(tails):
                    if tail > NEVER:
                        out[entry, leave] = head + middle + tail
        return out

    def chunk_path(self, text: str, size: int, entry: int, leave: int) -> bytes:
        """Ids of the pieces that begin in a chunk, between the boundary states that the scan has found."""
        seam = self.first_seam(text, size)
        if seam is None:
            return self.path(text, entry, size, size + leave) if entry < size + leave else b""
        final = max(seam, self.last_seam(text, size))
        return self.path(text[:seam], entry, seam, seam) + self.encode(text[seam:final]) + self.path(text[final:], 0, size - final, size - final + leave)


_UNITS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
_SEAM = re.compile(f"[^{SPACE}]{SPACE}")


@lru_cache(maxsize=2)
def pieces_of(file: bytes) -> Pieces:
    """One for each worker process, so that its memory of words outlives a task."""
    return Pieces(file)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product of transfer matrices: the associative step of the scan."""
    return np.maximum((a[:, :, None] + b[None, :, :]).max(1), NEVER)


def boundary_states(matrices: list[np.ndarray], entry: int, leave: int) -> list[tuple[int, int]]:
    """The states before and after each of a row of matrices on the best path from `entry` to `leave`."""
    reached = [np.full(len(matrices[0]), NEVER, np.int64)]
    reached[0][entry] = 0
    for m in matrices:
        sums = (reached[-1][:, None] + m).max(0)
        reached.append(np.maximum(sums - sums.max(), NEVER))  # only differences matter
    states = [leave]
    for m, before in zip(reversed(matrices), reversed(reached[:-1])):
        states.append(int((before + m[:, states[-1]]).argmax()))
    states.reverse()
    return list(zip(states, states[1:]))


def _read(raw: bytes) -> np.ndarray:
    flat = np.frombuffer(raw, np.int64)
    return flat.reshape(int(len(flat) ** 0.5), -1)


def _scan(matrices: DataFrame) -> DataFrame:
    """(text_key, chunk, entry, leave) from (text_key, chunk, matrix): products of FAN chunks, states between these, and then within each."""

    def multiply(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("chunk")
        total = _read(rows["matrix"].iloc[0])
        for raw in rows["matrix"].iloc[1:]:
            total = product(total, _read(raw))
        return pd.DataFrame({"text_key": [rows["text_key"].iloc[0]], "fan": [rows["fan"].iloc[0]], "matrix": [total.tobytes()]})

    def outer(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("fan")
        states = boundary_states([_read(raw) for raw in rows["matrix"]], 0, 0)
        return pd.DataFrame({"text_key": rows["text_key"].to_numpy(), "fan": rows["fan"].to_numpy(), "entry": [a for a, _ in states], "leave": [b for _, b in states]})

    def inner(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("chunk")
        states = boundary_states([_read(raw) for raw in rows["matrix"]], int(rows["entry"].iloc[0]), int(rows["leave"].iloc[0]))
        return pd.DataFrame({"text_key": rows["text_key"].to_numpy(), "chunk": rows["chunk"].to_numpy(), "entry": [a for a, _ in states], "leave": [b for _, b in states]})

    fans = matrices.withColumn("fan", F.floor(F.col("chunk") / FAN).cast("int"))
    products = fans.groupBy("text_key", "fan").applyInPandas(multiply, "text_key string, fan int, matrix binary")
    between = products.groupBy("text_key").applyInPandas(outer, "text_key string, fan int, entry int, leave int")
    return fans.join(between, ["text_key", "fan"]).groupBy("text_key", "fan").applyInPandas(inner, "text_key string, chunk int, entry int, leave int")


def encode(df: DataFrame, path: str, carry: tuple[str, ...] = ("doc_id",), text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """Columns `carry` and ids (array of int): the pieces of each row's text, with a space before it and spaces as the file writes them.

    Texts of at most `chunk` code points are encoded where they are. Longer ones, once for equal texts, are cut into chunks that are spread over the tasks: each gives the matrix of
    the best sums between its boundary states, the matrices are combined, and each chunk is then traced back by itself. Null and empty texts have no pieces;
    repeated rows get equal ids. Only the long texts are shuffled.
    """
    file = file_bytes(path)
    plain = F.coalesce(F.col(text), F.lit(""))
    columns = list(dict.fromkeys(carry))

    def start():
        encoder = pieces_of(file)

        def ids(texts):
            raw = encoder.encode_all([SPACE + t.replace(" ", SPACE) if t else "" for t in texts])
            ends = np.cumsum([0, *(len(r) // 4 for r in raw)])
            return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(raw), "<i4")))]

        return ids

    short = map_texts(df.where(F.length(plain) <= chunk), columns, text, "ids array<int>", start, rows=32)

    long = df.where(F.length(plain) > chunk)
    written = F.concat(F.lit(SPACE), F.translate(plain, " ", SPACE))
    ahead = pieces_of(file).longest - 1
    parts = long.select(F.md5(plain).alias("text_key"), written.alias("t")).select("text_key", "t", F.explode(F.sequence(F.lit(0), ((F.length("t") - 1) / chunk).cast("int"))).alias("chunk"))
    parts = parts.select("text_key", "chunk", F.substring("t", F.col("chunk") * chunk + 1, F.lit(chunk + ahead)).alias("part")).groupBy("text_key", "chunk").agg(F.first("part").alias("part"))

    def measure():
        encoder = pieces_of(file)
        return lambda texts: [[encoder.transfer(t, min(chunk, len(t))).tobytes() for t in texts]]

    # written once, as the scan reads the matrices on the way up and on the way down
    states = _scan(cut(map_texts(parts, ["text_key", "chunk"], "part", "matrix binary", measure, rows=16)))

    def trace(batches):
        encoder = pieces_of(file)
        for batch in batches:
            got = [encoder.chunk_path(t, min(chunk, len(t)), a, b) for t, a, b in zip(*(batch.column(c).to_pylist() for c in ("part", "entry", "leave")))]
            ends = np.cumsum([0, *(len(r) // 4 for r in got)])
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(got), "<i4")))
            yield pa.RecordBatch.from_arrays([batch.column("text_key"), batch.column("chunk"), ids], names=["text_key", "chunk", "ids"])

    traced = parts.join(states, ["text_key", "chunk"]).select("text_key", "chunk", "part", "entry", "leave").mapInArrow(trace, "text_key string, chunk int, ids array<int>")
    whole = traced.groupBy("text_key").agg(F.sort_array(F.collect_list(F.struct("chunk", "ids"))).alias("parts")).select("text_key", F.flatten("parts.ids").alias("ids"))
    rows = long.select(*[F.col(c).alias(f"__{c}") for c in columns], F.md5(plain).alias("text_key")).join(whole, "text_key")
    return short.unionByName(rows.select(*[F.col(f"__{c}").alias(c) for c in columns], "ids"))


def decode(df: DataFrame, path: str, carry: tuple[str, ...] = ("doc_id",), ids: str = "ids", into: str = "decoded") -> DataFrame:
    """Columns `carry` and the text of the pieces, without the space before it. Null ids give an empty text; bytes that are no UTF-8 become U+FFFD."""
    file = file_bytes(path)
    chosen = df.select(*dict.fromkeys([*carry, ids]))

    def run(batches):
        table = np.array(pieces_of(file).text, object)
        for batch in batches:
            for at in range(0, batch.num_rows, 32):
                part = batch.slice(at, 32)
                rows = part.column(ids)
                ends = np.cumsum([0, *(n or 0 for n in rows.value_lengths().to_pylist())]).tolist()
                pieces = table[rows.flatten().to_numpy(zero_copy_only=False)].tolist()
                texts = [b"".join(pieces[a:b]).decode("utf-8", "replace") for a, b in zip(ends, ends[1:])]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carry), pa.array([t.removeprefix(" ") for t in texts], pa.string())], names=[*carry, into])

    schema = chosen.select(*carry).schema.add(into, "string")
    return chosen.mapInArrow(run, schema)
