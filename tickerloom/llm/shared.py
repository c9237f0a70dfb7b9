"""What the text operators have in common: stored intermediate tables, buffers of text columns, runs of a mask."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Words of two contracts: ASCII white space, and what is neither a digit, a lower-case letter nor beyond ASCII.
BLANKS = r"[\x20\x09-\x0D]+"
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_own_folder: dict[str, str] = {}
_kept: dict = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share. A local session that names none (as in tests) gets one of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return _own_folder.setdefault("path", "file://" + tempfile.mkdtemp(prefix="tickerloom-"))


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: later stages neither recompute it nor depend on the executors that made it."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def texts_of(docs: DataFrame, *columns: str) -> DataFrame:
    """Only the columns an operator needs, null text as empty; other columns can bear any name."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *columns)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or a longer one if a column of ``df`` bears it (in any case of letters)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"{name}_"
    return name


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column in one array, and where each row begins (one entry more than rows)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    ends = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return body[ends[0] : ends[-1]], ends - ends[0]


def kept(name, build):
    """What a worker remembers between its tasks: one thing at a time, so that memories of different operators do not add up."""
    if name not in _kept:
        _kept.clear()
        _kept[name] = build()
    return _kept[name]


def forget() -> None:
    _kept.clear()


def in_blocks(starts: np.ndarray, most: int):
    """Slices of rows whose texts have about ``most`` bytes together; a longer text is a block of its own."""
    row, n = 0, len(starts) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(starts, starts[row] + most, "right")) - 1)
        yield row, min(end, n)
        row = min(end, n)


def ranges(lengths: np.ndarray) -> np.ndarray:
    """0..n-1 for each length n, one after the other."""
    lengths = np.asarray(lengths, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)


def mixed(x: np.ndarray) -> np.ndarray:
    """A well-mixed 64-bit hash of 64-bit numbers (wrapping arithmetic)."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
