"""Helpers the operators of this subpackage share."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.types import StructType

from campanile.session import checkpoint_dir

# Characters str.split() takes as white space and the contracts do not.
OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0  -     　]")
WORD = re.compile("[^\x20\x09-\x0d]+")

ARROW = {
    T.StringType(): pa.string(), T.LongType(): pa.int64(), T.IntegerType(): pa.int32(), T.DoubleType(): pa.float64(), T.BooleanType(): pa.bool_(), T.BinaryType(): pa.binary(),
    T.ArrayType(T.IntegerType()): pa.list_(pa.int32()), T.ArrayType(T.LongType()): pa.list_(pa.int64()), T.ArrayType(T.StringType()): pa.list_(pa.string()),
}


def words_of(text: str) -> list[str]:
    """Runs of characters other than space and \\t to \\r."""
    return WORD.findall(text) if OTHER_SPACE.search(text) else text.split()


class Memo(dict):
    """What `work` gives for a key, kept while there is room; a cache only, it never changes a result."""

    def __init__(self, work: Callable, room: int = 400_000, longest: int = 64):
        super().__init__()
        self.work, self.room, self.longest = work, room, longest

    def __missing__(self, key):
        value = self.work(key)
        if len(key) <= self.longest:
            if len(self) >= self.room:
                self.clear()
            self[key] = value
        return value


def map_texts(df: DataFrame, carry: list[str], text: str, fields: str, start: Callable[[], Callable[[list[str]], list]], rows: int = 512) -> DataFrame:
    """One output row per input row: the columns `carry` as they are, then `fields` as `start()(texts)` gives them, a list for each.

    `start` runs once in a task. A null text counts as empty. Other columns are left out; a carried column with a name of the result gives way to it.
    """
    added = StructType.fromDDL(fields)
    taken = {f.name.lower() for f in added}
    carry = [c for c in carry if c.lower() not in taken]
    chosen = df.select(*dict.fromkeys([*carry, text]))
    kinds = [ARROW[f.dataType] for f in added]
    schema = T.StructType([chosen.schema[c] for c in carry] + list(added))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                made = work([x or "" for x in part.column(text).to_pylist()])
                arrays = [part.column(c) for c in carry] + [x if isinstance(x, pa.Array) else pa.array(x, k) for x, k in zip(made, kinds)]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return chosen.mapInArrow(run, schema)


def file_bytes(path: str) -> bytes:
    """A vocabulary file, read on the driver; its content then travels with the job, as executors may not have it."""
    with open(path, "rb") as file:
        return file.read()


def vocabulary(name: str) -> str:
    """Where the installed vocabulary file `name` is."""
    import public_tokenizers

    return public_tokenizers.path(name)


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new folder under the one the cluster shares. What is written there stays until its owner deletes it."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def held_out(column: str, remainder: int, of: int = 5) -> Column:
    """Whether crc32 of the id as text leaves `remainder`; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % of == remainder, F.lit(False))
