"""Packing of token ids into windows whose mixture of sources is controlled.

Every source is a queue of ids, and windows are served by deficit round-robin: with each window a source is granted its
share of the window's length, takes as many whole ids as its credit covers, and carries the rest to the next window. Queues are
served in a tree: of t ids the left half of the queues gives floor(t * its share), the right half the rest, and so on down. So windows are full, a queue is never
further than the depth of the tree (in ids) from its share, where an id goes follows from its place in its queue alone, and partitions carry the
deficits without exchanging anything but counts. When a queue runs dry before the others a phase ends, and its share is dealt to them in proportion.

Shares are by default those of the corpus, in which case all queues end together. Tokens are counted over all documents first (one row per
partition and source), the ids are kept in a written table, and the second pass cuts them. A hot source is cut in as many tasks as its texts lie in.

Null text is empty (the end id alone). A null source is a source. Rows with equal doc_id are documents of their own. An
empty table gives an empty result. Sequences shorter than ``size`` are padded to it unless their length is a power of two.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from itertools import accumulate
from math import lcm

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.llm.shared import in_blocks, stored, text_bytes, texts_of
from tickerloom.llm.tokens import encoder, vocabulary

VOCABULARY = "byte_bpe_50k.json"
SIZE = 2048
BLOCK = 1 << 22
IDS = "part int, queue string, doc_id long, before long, n_tokens long, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, pad long"
_PIECES = pa.schema([(c.split()[0], pa.int64()) for c in PIECES.split(", ")])


def _tokenized(vocabulary_file: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(vocabulary(vocabulary_file))
        width = tokens.width
        part, served = TaskContext.get().partitionId(), {}
        for batch in batches:
            _, starts = text_bytes(batch.column(1))
            for a, b in in_blocks(starts, BLOCK):
                kept = tokens.packed(batch.column(1)[a:b].to_pylist())
                lengths = np.array([len(k) // width for k in kept], np.int64)
                queues, before = batch.column(2)[a:b].to_pylist(), []
                for q, n in zip(queues, lengths.tolist()):
                    before.append(served.get(q, 0))
                    served[q] = before[-1] + n
                columns = [pa.array([part] * (b - a), pa.int32()), pa.array(queues, pa.string()), batch.column(0)[a:b], pa.array(before, pa.int64()), pa.array(lengths), pa.array(kept, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in IDS.split(", ")])

    return run


@dataclass(frozen=True)
class Phase:
    """A stretch of ids dealt with the same shares: ``length`` ids from the ``begin``-th on. ``top`` are the running sums of the weights,
    ``served`` the ids each queue had given before."""

    begin: int
    length: int
    top: tuple[int, ...]
    served: tuple[int, ...]

    def dealt(self, j: int, t: int) -> tuple[int, int]:
        """Of the first t ids of this phase: how many the queues before j have given, and how many j."""
        low, high, before = 0, len(self.top) - 1, 0
        while high - low > 1:
            mid = (low + high) // 2
            left = t * (self.top[mid] - self.top[low]) // max(1, self.top[high] - self.top[low])
            if j < mid:
                high, t = mid, left
            else:
                low, t, before = mid, t - left, before + left
        return before, t

    def given(self, j: int, t: int) -> int:
        return self.dealt(j, t)[1]


def _first(low: int, test) -> int:
    """The smallest number from ``low`` on that passes a test which all larger ones pass."""
    step = 1
    while not test(low + step - 1):
        low, step = low + step, 2 * step
    high = low + step - 1
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if test(mid) else (mid + 1, high)
    return low


def phases(totals: list[int], weights: list[int]) -> list[Phase]:
    """Stretches between which no queue runs dry: one if weights are the totals, else each ends with a queue that is dry."""
    left, begin, plan = list(totals), 0, []
    while any(left):
        live = [w if x else 0 for w, x in zip(weights, left)]
        live = live if any(live) else left  # queues without a share come last
        served, n = tuple(t - x for t, x in zip(totals, left)), len(left)
        phase = Phase(begin, 0, (0, *accumulate(live)), served)
        if weights == left:
            length = sum(left)
        else:
            length = _first(0, lambda t: t == sum(left) or any(phase.given(j, t + 1) > left[j] for j in range(n)))
        plan.append(Phase(begin, length, (0, *accumulate(live)), served))
        left = [x - plan[-1].given(j, length) for j, x in enumerate(left)]
        begin += length
    return plan


def places(plan: list[Phase], j: int, first: int, n: int, size: int) -> Iterator[tuple[int, int, int, int]]:
    """Where ids first..first+n-1 of queue j go: window, place in the window, first id there, number of ids."""
    for p in plan:
        a, b = max(first, p.served[j]) - p.served[j], min(first + n - p.served[j], p.given(j, p.length))
        if a >= b:
            continue
        behind = len(p.top).bit_length()  # ids that rounding can put a queue ahead of its share
        window = (p.begin + max(0, a - behind) * p.top[-1] // (p.top[j + 1] - p.top[j])) // size
        window = _first(window, lambda w: p.given(j, min(p.length, (w + 1) * size - p.begin)) > a)
        below, own = p.dealt(j, max(0, window * size - p.begin))
        while True:
            below_end, own_end = p.dealt(j, min(p.length, (window + 1) * size - p.begin))
            if own_end > a:
                yield window, max(0, p.begin - window * size) + below_end - below + a - own, p.served[j] + a, min(b, own_end) - a
                a = own_end
                if a >= b:
                    break
                below, own, window = below_end, own_end, window + 1
            else:  # a queue with a small share has windows without it
                window = _first(window + 1, lambda w: p.given(j, min(p.length, (w + 1) * size - p.begin)) > a)
                below, own = p.dealt(j, window * size - p.begin)


def padding(length: int, size: int) -> int:
    return size - length if length & (length - 1) else 0


def _cutter(plan: list[Phase], queues: dict[str | None, int], size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum(p.length for p in plan)
        for batch in batches:
            rows = []
            for doc_id, queue, first, n, ids in zip(*(c.to_pylist() for c in batch.columns)):
                body = memoryview(np.frombuffer(ids, f"<u{len(ids) // n}").astype("<u4").tobytes())
                for window, place, a, k in places(plan, queues[queue], first, n, size):
                    a -= first
                    rows.append((doc_id, a, k, zlib.crc32(body[4 * a : 4 * (a + k)]), n, window, place, padding(min(size, total - window * size), size)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=_PIECES)

    return run


def pack(docs: DataFrame, size: int = SIZE, weights: dict[str | None, float] | None = None, vocabulary_file: str = VOCABULARY) -> DataFrame:
    """One row per piece of a document. ``weights`` are target token shares by source (others get none until those queues are
    dry); by default the shares of the corpus. The driver holds one row per source."""
    ids = stored(texts_of(docs, F.col("source").cast("string").alias("queue")).mapInArrow(_tokenized(vocabulary_file), IDS), "ids")
    parts = ids.groupBy("queue", "part").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.partitionBy("queue").orderBy("part")
    parts = stored(parts.select("queue", "part", "n", (F.sum("n").over(earlier) - F.col("n")).alias("base")), "parts")
    totals = {r.queue: r.n for r in parts.groupBy("queue").agg(F.sum("n").alias("n")).collect()}
    names = sorted(totals, key=lambda q: (q is None, q))
    if weights:
        shares = [Fraction(weights.get(q, 0)).limit_denominator(10**6) for q in names]
        unit = lcm(*(s.denominator for s in shares))
        plan = phases([totals[q] for q in names], [int(s * unit) for s in shares])
    else:
        plan = phases([totals[q] for q in names], [totals[q] for q in names])
    base = parts.select(F.col("queue").alias("q"), F.col("part").alias("p"), "base")
    placed = ids.join(base, F.col("queue").eqNullSafe(F.col("q")) & (F.col("part") == F.col("p")))
    placed = placed.select("doc_id", "queue", (F.col("base") + F.col("before")).alias("first"), "n_tokens", "ids")
    return placed.mapInArrow(_cutter(plan, {q: j for j, q in enumerate(names)}, size), PIECES)
