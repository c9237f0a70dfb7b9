"""Token ids as length-delimited binary records with an offset index.

A record is: length of the data (8 bytes), masked CRC-32C of those 8 bytes (4), the data, masked CRC-32C of the data (4); numbers are
little-endian. The data of a text are its doc_id (8 bytes, then one byte 1 if it is null), the bytes an id takes (1: 2 or 4), and the ids. Beside each
file of records lies an index: for every record its place and the length of its data (8 bytes each), so that a reader can take records in any order.

Files are written by tasks to the shared folder, each attempt under a name of its own; the stored manifest names the files of the attempts that
counted, in order of doc_id (nulls first, equal ids in any order). Null text is empty and gives the end id alone. An empty table gives an empty manifest.
A task holds one block of texts and one index.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.llm.shared import in_blocks, new_path, ranges, stored, text_bytes, texts_of
from tickerloom.llm.tokens import encoder, vocabulary

VOCABULARY = "word_bpe_49k.json"
BLOCK = 1 << 22
MANIFEST = "shard int, path string, n_records long, n_tokens long, n_bytes long"
RECORDS = "doc_id long, start long, n_tokens long, ids_crc32 long"
_HEAD = "<qBB"

POLYNOMIAL = 0x82F63B78  # Castagnoli, bits reversed
WIDTH = 64  # bytes that one step of the checksum takes together


def _byte_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(POLYNOMIAL), table >> 1).astype(np.uint32)
    return table


def _apply(tables: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A linear map of 32-bit registers, given as four tables by byte."""
    return tables[0][x & 255] ^ tables[1][(x >> 8) & 255] ^ tables[2][(x >> 16) & 255] ^ tables[3][x >> 24]


_ONE = _byte_table()
_BYTES = np.arange(256, dtype=np.uint32)
#: _SHIFTS[b]: what 2**b zero bytes do to the register.
_SHIFTS = [np.stack([_ONE, *[_BYTES << np.uint32(8 * (i - 1)) for i in (1, 2, 3)]])]
for _ in range(47):
    _SHIFTS.append(np.stack([_apply(_SHIFTS[-1], _apply(_SHIFTS[-1], _BYTES << np.uint32(8 * i))) for i in range(4)]))
#: _AT[j]: what byte j of a block adds to the register behind the block.
_AT = [_ONE]
for _ in range(WIDTH - 1):
    _AT.append(_apply(_SHIFTS[0], _AT[-1]))
_AT = _AT[::-1]


def crc32c(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32C of many slices of ``data``. The register is linear in the bytes: fixed blocks are summed up by tables, then pairs of neighbours."""
    starts, lengths = np.asarray(starts, np.int64), np.asarray(lengths, np.int64)
    count = -(-lengths // WIDTH)
    first = np.cumsum(count) - count
    padded = np.zeros(int(count.sum()) * WIDTH, np.uint8)  # zero bytes in front change nothing
    for end, a, n in zip(((first + count) * WIDTH).tolist(), starts.tolist(), lengths.tolist()):
        padded[end - n : end] = data[a : a + n]
    blocks = padded.reshape(-1, WIDTH)
    part = np.zeros(len(blocks), np.uint32)
    for a in range(0, len(blocks), 4096):
        for j, column in enumerate(np.ascontiguousarray(blocks[a : a + 4096].T)):
            part[a : a + 4096] ^= _AT[j].take(column)
    part = part[np.repeat(first + count - 1, count) - ranges(count)]  # last block of a slice first
    level = WIDTH.bit_length() - 1
    while len(count) and count.max() > 1:
        half = (count + 1) // 2
        low = np.repeat(np.cumsum(count) - count, half) + 2 * ranges(half)
        has = np.repeat(count, half) > 2 * ranges(half) + 1
        high = np.where(has, part[np.minimum(low + 1, len(part) - 1)], np.uint32(0))
        part, count, level = part[low] ^ _apply(_SHIFTS[level], high), half, level + 1
    out = np.zeros(len(lengths), np.uint32)
    out[lengths > 0] = part
    initial = np.full(len(lengths), 0xFFFFFFFF, np.uint32)
    for b in range(int(lengths.max()).bit_length() if len(lengths) else 0):
        initial = np.where((lengths >> b) & 1, _apply(_SHIFTS[b], initial), initial)
    return out ^ initial ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(0xA282EAD8)


def framed(items: list[bytes]) -> list[bytes]:
    """The records of some data, in order."""
    sizes = np.array([len(i) for i in items], np.int64)
    heads = sizes.astype("<u8").tobytes()
    of_heads = masked(crc32c(np.frombuffer(heads, np.uint8), 8 * np.arange(len(items)), np.full(len(items), 8))).astype("<u4").tobytes()
    of_data = masked(crc32c(np.frombuffer(b"".join(items), np.uint8), np.cumsum(sizes) - sizes, sizes)).astype("<u4").tobytes()
    return [heads[8 * i : 8 * i + 8] + of_heads[4 * i : 4 * i + 4] + item + of_data[4 * i : 4 * i + 4] for i, item in enumerate(items)]


def unframed(data: bytes, starts: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """The data of records at these places of ``data``; an error if a length or checksum does not hold."""
    raw = np.frombuffer(data, np.uint8)
    words = lambda at, n: raw[np.repeat(at, n) + np.tile(np.arange(n), len(at))].tobytes()
    good = np.frombuffer(words(starts, 8), "<u8").astype(np.int64) == sizes
    good &= np.frombuffer(words(starts + 8, 4), "<u4") == masked(crc32c(raw, starts, np.full(len(starts), 8)))
    good &= np.frombuffer(words(starts + 12 + sizes, 4), "<u4") == masked(crc32c(raw, starts + 12, sizes))
    if not good.all():
        raise ValueError(f"record {int(np.argmin(good))} of a block is damaged")
    return [data[a + 12 : a + 12 + n] for a, n in zip(starts.tolist(), sizes.tolist())]


def _writer(folder: str, vocabulary_file: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(vocabulary(vocabulary_file))
        width = tokens.width
        shard = TaskContext.get().partitionId()
        store, root = fs.FileSystem.from_uri(folder)
        name = f"part-{shard:06d}-{uuid.uuid4().hex[:8]}"
        out, index, place, n_tokens = None, [], 0, 0
        for batch in batches:
            if out is None:
                store.create_dir(root, recursive=True)
                out = store.open_output_stream(f"{root}/{name}.records")
            _, starts = text_bytes(batch.column(1))
            for a, b in in_blocks(starts, BLOCK):
                bodies = tokens.packed(batch.column(1)[a:b].to_pylist())
                doc_ids = batch.column(0)[a:b].to_pylist()
                items = [struct.pack(_HEAD, d or 0, d is None, width) + body for d, body in zip(doc_ids, bodies)]
                records = framed(items)
                out.write(b"".join(records))
                sizes = np.array([len(r) for r in records], np.int64)
                index.append(np.stack([place + np.cumsum(sizes) - sizes, sizes - 16], 1))
                place, n_tokens = place + int(sizes.sum()), n_tokens + sum(map(len, bodies)) // width
        if out is None:
            return
        out.close()
        with store.open_output_stream(f"{root}/{name}.index") as side:
            side.write(np.concatenate(index).astype("<u8").tobytes())
        row = [[shard], [f"{folder}/{name}"], [sum(len(i) for i in index)], [n_tokens], [place]]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()))], ["shard", "path", "n_records", "n_tokens", "n_bytes"])

    return run


def write_records(docs: DataFrame, folder: str, vocabulary_file: str = VOCABULARY) -> DataFrame:
    """Write all texts in order of doc_id; the stored manifest, one row per file."""
    ordered = texts_of(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return stored(ordered.mapInArrow(_writer(folder, vocabulary_file), MANIFEST), "manifest")


def read_index(store: fs.FileSystem, path: str) -> np.ndarray:
    with store.open_input_file(f"{path}.index") as side:
        return np.frombuffer(side.read(), "<u8").astype(np.int64).reshape(-1, 2)


def read_file(path: str, order: np.ndarray | None = None, block: int = BLOCK) -> Iterator[tuple[int, int | None, np.ndarray]]:
    """Number of the record in its file, doc_id and ids; all in order, or those in ``order`` (a permutation, for shuffled reads)."""
    store, root = fs.FileSystem.from_uri(path)
    index = read_index(store, root)
    with store.open_input_file(f"{root}.records") as file:
        if order is not None:
            for r in order.tolist():
                file.seek(index[r, 0])
                yield (r, *_sequence(unframed(file.read(int(index[r, 1]) + 16), np.zeros(1, np.int64), index[r : r + 1, 1])[0]))
            return
        ends = np.concatenate([index[:, 0], index[-1:].sum(1) + 16])
        for a, b in in_blocks(ends, block):
            file.seek(int(ends[a]))
            data = file.read(int(ends[b] - ends[a]))
            for r, item in enumerate(unframed(data, ends[a:b] - ends[a], index[a:b, 1]), a):
                yield (r, *_sequence(item))


def _sequence(item: bytes) -> tuple[int | None, np.ndarray]:
    doc_id, empty, width = struct.unpack_from(_HEAD, item)
    return None if empty else doc_id, np.frombuffer(item, f"<u{width}", offset=struct.calcsize(_HEAD))


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(c.split()[0], pa.int64()) for c in RECORDS.split(", ")])
    for batch in batches:
        for path, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            rows = []
            for _, doc_id, ids in read_file(path):
                rows.append((doc_id, before, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                before += len(ids)
                if len(rows) == 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def read_records(manifest: DataFrame) -> DataFrame:
    """A row for each record, read back from the files: doc_id, start (ids of all records before it), n_tokens, ids_crc32."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    files = manifest.select("shard", "path", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("start"))
    files = files.repartitionByRange(max(1, manifest.count()), "shard").select("path", "start")  # a task for each file
    return files.mapInArrow(_reader, RECORDS)


def token_records(docs: DataFrame, vocabulary_file: str = VOCABULARY) -> DataFrame:
    return read_records(write_records(docs, new_path(docs.sparkSession, "records"), vocabulary_file))
