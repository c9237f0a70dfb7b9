"""Byte strings of a least length that stand more than once in the corpus, by Burrows-Wheeler transforms of groups of places that can be equal.

Every window of ``LENGTH`` bytes chooses an anchor: its run of ``ANCHOR`` bytes with the smallest hash (the last of equals). Equal windows choose the same
run at the same place, so windows can only be equal if their anchors are. The windows of a document that choose one anchor are a stretch. Anchors seen once are
dropped, equal stretches are counted once, and the stretches of an anchor form a group. Groups are packed into batches. A batch is transformed, and its common
prefixes are derived by increasing value: breadth-first backward extension finds all intervals of suffixes that share 0, 1, 2, ... bytes, each
boundary once, and stops at ``LENGTH``. Where no boundary was found, windows are equal.

A group larger than ``GROUP`` stretches (an anchor in a passage of very many documents) is split first: the places of its windows, counted from the
anchor, are halved, and each half is keyed by the bytes that all its windows share, until groups are small or a half is a single place, in which
case equal stretches have become one. So the work of a task is bounded, and no window is left out.

Texts are judged as UTF-8 bytes, null as empty. Texts shorter than ``LENGTH`` repeat nothing. Rows with equal doc_id and text are two places. An empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.llm.shared import in_blocks, mixed, ranges, stored, text_bytes, texts_of

LENGTH, ANCHOR = 400, 128
GROUP = 1000
BATCH = 1 << 20  # bytes transformed together; places and ranks take 21 bits each
BLOCK = 1 << 20
ANCHORS = "doc_id long, mark long, key long, stretch long, begin int, n int, lead int"
STRETCHES = "key long, stretch long, m long, n int, lead int, body binary"
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_OF_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_PLACE = np.uint64((1 << 24) - 1)


@lru_cache(maxsize=2)
def _powers(base: int, bits: int) -> np.ndarray:
    out = np.ones(1 << bits, np.uint64)
    for b in range(bits):  # doubling: the second half is the first times base**(2**b)
        out[1 << b : 2 << b] = out[: 1 << b] * np.uint64(pow(base, 1 << b, 1 << 64))
    return out


class Hashes:
    """Hashes of all runs of some bytes from one running sum."""

    def __init__(self, data: np.ndarray):
        bits = max(20, int(len(data)).bit_length())
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_OF_BYTE[data] * _powers(_BASE, bits)[: len(data)], out=self.sums[1:])
        self.back = _powers(_INVERSE, bits)

    def runs(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[begin]) * self.back[begin])

    def every(self, k: int) -> np.ndarray:
        n = len(self.sums) - k
        return mixed((self.sums[k:] - self.sums[:n]) * self.back[:n])


def _least_in_windows(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values: of the rest of its first block and the head of the next."""
    n = len(values)
    padded = np.concatenate([values, np.full(-n % width + width, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    head = np.minimum.accumulate(padded, axis=1).reshape(-1)
    tail = np.ascontiguousarray(np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1]).reshape(-1)
    return np.minimum(tail[: n - width + 1], head[width - 1 : n])


def stretches(data: np.ndarray, starts: np.ndarray, length: int, anchor: int):
    """Row, anchor hash, stretch hash, first window, number of windows, and distance to the anchor, of all stretches."""
    n = len(data) - length + 1
    if n <= 0:
        return None
    if len(data) >= 1 << 24:
        return _long_text(data, starts, length, anchor)
    hashes = Hashes(data)
    grams = hashes.every(anchor)
    place = _PLACE - np.arange(len(grams), dtype=np.uint64)
    chosen = (_PLACE - (_least_in_windows((grams & ~_PLACE) | place, length - anchor + 1) & _PLACE)).astype(np.int64)
    row = np.repeat(np.arange(len(starts) - 1), np.diff(starts))[:n]
    whole = np.arange(n) + length <= starts[row + 1]
    new = np.ones(n, bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (row[1:] != row[:-1])
    edge = new | np.concatenate([[False], whole[1:] != whole[:-1]])
    first = np.flatnonzero(edge)
    count = np.diff(first, append=n)
    first, count = first[whole[first]], count[whole[first]]
    lead = chosen[first] - first
    key = mixed(grams[chosen[first]])
    body = hashes.runs(first, first + count + length - 1)
    return row[first], key, mixed(body ^ mixed((lead << 32 | count).astype(np.uint64))), first - starts[row[first]], count, lead


def _long_text(data, starts, length, anchor):
    """A text of 16 MB or more in pieces that overlap by a window."""
    out = []
    for i in range(len(starts) - 1):
        for a in range(int(starts[i]), int(starts[i + 1]), 1 << 23):
            part = data[a : min(a + (1 << 23) + length - 1, int(starts[i + 1]))]
            found = stretches(part, np.array([0, len(part)]), length, anchor)
            if found is not None:
                row, key, own, first, count, lead = found
                out.append((row + i, key, own, first + a - starts[i], count, lead))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else None


def _anchors(length: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts = text_bytes(batch.column(2))
            for a, b in in_blocks(starts, BLOCK):
                found = stretches(data[starts[a] : starts[b]], starts[a : b + 1] - starts[a], length, anchor)
                if found is not None and len(found[0]):
                    row, key, own, first, count, lead = found
                    row = pa.array(row + a)
                    columns = [batch.column(0).take(row), batch.column(1).take(row), pa.array(key.view(np.int64)), pa.array(own.view(np.int64))]
                    columns += [pa.array(c.astype(np.int32)) for c in (first, count, lead)]
                    yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in ANCHORS.split(", ")])

    return run


def _bodies(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts = text_bytes(batch.column(0))
            cut = batch.column(1)
            flat, ends = cut.flatten(), cut.offsets.to_numpy().astype(np.int64)
            ends = ends - ends[0]
            row = np.repeat(np.arange(len(cut)), np.diff(ends))
            begin = starts[row] + flat.field("begin").to_numpy()
            end = begin + flat.field("n").to_numpy() + length - 1
            bodies = pa.array([data[x:y].tobytes() for x, y in zip(begin.tolist(), end.tolist())], pa.binary())
            yield pa.RecordBatch.from_arrays([*[flat.field(c) for c in ("key", "stretch", "m", "n", "lead")], bodies], [c.split()[0] for c in STRETCHES.split(", ")])

    return run


class Transform:
    """Burrows-Wheeler transform of numbers, ordered by the first ``depth`` numbers of each suffix at least, with a wavelet matrix for ranks."""

    def __init__(self, text: np.ndarray, depth: int):
        self.n, self.order = len(text), _ordered(text, depth)
        self.kinds = int(text.max()) + 1
        bits = max(1, (self.kinds - 1).bit_length())
        self.less = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=1 << bits))])
        level = text[self.order - 1]
        self.ones, self.zeros = [], []
        for b in range(bits - 1, -1, -1):
            bit = (level >> b) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(self.n - int(self.ones[-1][-1]))
            level = np.concatenate([level[bit == 0], level[bit == 1]])

    def extended(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals [low, high) with each number in front that stands before one of their suffixes, 0 (an end) excepted."""
        symbol, start = np.zeros(len(low), np.int64), np.zeros(len(low), np.int64)
        for ones, zeros in zip(self.ones, self.zeros):
            a, b, s = ones[low], ones[high], ones[start]
            to0, to1 = high - b > low - a, b > a
            low, high = np.concatenate([(low - a)[to0], (zeros + a)[to1]]), np.concatenate([(high - b)[to0], (zeros + b)[to1]])
            start = np.concatenate([(start - s)[to0], (zeros + s)[to1]])
            symbol = np.concatenate([symbol[to0] << 1, symbol[to1] << 1 | 1])
        keep = symbol > 0
        base = self.less[symbol[keep]] - start[keep]
        return base + low[keep], base + high[keep]

    def boundaries(self, length: int) -> np.ndarray:
        """Whether suffix i shares fewer than ``length`` numbers with the one before it (ends are like no number)."""
        known = np.zeros(self.n + 1, bool)
        known[[0, self.n]] = True
        low, high = np.zeros(1, np.int64), np.full(1, self.n)
        for _ in range(length):  # all boundaries of common prefixes of this many numbers
            low, high = self.extended(low, high)
            new = ~known[high]
            low, high = low[new], high[new]
            if not len(low):
                break
            known[high] = True
        return known[: self.n]


def _ordered(text: np.ndarray, depth: int) -> np.ndarray:
    """Order of suffixes by their first ``depth`` numbers, by doubling; a key holds two ranks and a place in 63 bits."""
    n, kinds = len(text), int(text.max()) + 1
    place = np.arange(n, dtype=np.uint64)
    rank, width = text.astype(np.uint64), 1
    while kinds**2 <= 1 << 21 and width < 8:  # pack a few numbers before the first sort
        ahead = np.concatenate([rank[width:], np.zeros(min(width, n), np.uint64)])[:n]
        rank, kinds, width = rank * np.uint64(kinds) + ahead, kinds**2, 2 * width
    while True:
        ahead = np.concatenate([rank[width:], np.zeros(min(width, n), np.uint64)])[:n]
        key = np.sort(rank << np.uint64(42) | ahead << np.uint64(21) | place)
        order = (key & np.uint64((1 << 21) - 1)).astype(np.int64)
        width *= 2
        pair = key >> np.uint64(21)
        head = np.concatenate([[True], pair[1:] != pair[:-1]])
        if width >= depth or head.all():
            return order
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(head, dtype=np.uint64) - np.uint64(1)


def equal_windows(bodies: list[bytes], m: np.ndarray, n: np.ndarray, length: int) -> list[list[dict]]:
    """Of each stretch the runs of windows (first, last) that stand more than once: in another stretch or in a stretch that does."""
    raw = np.frombuffer(b"".join(bodies), np.uint8)
    sizes = np.array([len(b) for b in bodies], np.int64)
    present = np.bincount(raw, minlength=256) > 0
    text = np.zeros(len(raw) + len(bodies), np.int64)
    at = np.cumsum(sizes + 1) - sizes - 1
    text[np.repeat(at, sizes) + ranges(sizes)] = np.cumsum(present)[raw]
    transform = Transform(text, length)
    group = np.cumsum(transform.boundaries(length)) - 1
    of = np.full(len(text), -1, np.int64)  # the stretch that a valid window belongs to
    valid = np.repeat(at, n) + ranges(n)
    of[valid] = np.repeat(np.arange(len(bodies)), n)
    here = of[transform.order]
    counted = here >= 0
    total = np.bincount(group[counted], weights=m[here[counted]].astype(np.float64), minlength=len(text))
    again = np.zeros(len(text) + 1, bool)
    again[transform.order[counted]] = total[group[counted]] > 1
    again = again[valid]
    new = np.flatnonzero(again & ~np.concatenate([[False], again[:-1] & (of[valid][1:] == of[valid][:-1])]))
    out: list[list[dict]] = [[] for _ in bodies]
    stop = np.flatnonzero(again & ~np.concatenate([again[1:] & (of[valid][1:] == of[valid][:-1]), [False]]))
    owner = of[valid][new]
    for i, a, b in zip(owner.tolist(), (valid[new] - at[owner]).tolist(), (valid[stop] - at[owner]).tolist()):
        out[i].append({"first": a, "last": b})
    return out


def _transformed(length: int):
    spans = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))

    def solved(table: pa.Table) -> Iterator[pa.RecordBatch]:
        found = equal_windows(table.column("body").to_pylist(), table.column("m").to_numpy(), table.column("n").to_numpy().astype(np.int64), length)
        some = [i for i, f in enumerate(found) if f]
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(table.column("stretch").to_numpy()[some]), pa.array([found[i] for i in some], spans)], ["stretch", "spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole groups (rows come sorted by key) until a batch is full."""
        rest = None
        for batch in batches:
            table = pa.table(batch.columns, names=batch.schema.names)
            rest = table if rest is None else pa.concat_tables([rest, table])
            key, sizes = rest.column("key").to_numpy(), rest.column("n").to_numpy().astype(np.int64) + length
            ends = np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, len(key))
            held, a = np.cumsum(sizes), 0
            for last, end in zip(ends[:-1].tolist(), ends[1:].tolist()):
                if held[end - 1] - (held[a - 1] if a else 0) > BATCH and last > a:
                    yield from solved(rest.slice(a, last - a))
                    a = last
            rest = rest.slice(a)
        if rest is not None and rest.num_rows:
            yield from solved(rest)

    return run


def _split_groups(units: DataFrame, length: int, anchor: int, group: int) -> tuple[DataFrame, DataFrame]:
    """Groups of bounded size, and for each stretch that was cut its parts: stretch, shift (windows before the part), part.

    ``low`` and ``high`` bound the distance from a group's windows to the anchor.
    """
    units = units.withColumn("low", F.lit(0)).withColumn("high", F.lit(length - anchor))
    done, parts = None, None
    while True:
        size = units.groupBy("key").agg(F.count("*").alias("units"), F.sum("m").alias("places"))
        hot = stored(size.filter((F.col("units") > group) & (F.col("places") > 1)).select("key"), "hot")
        if hot.isEmpty():
            return (units if done is None else done.unionByName(units)).select("key", "stretch", "m", "n", "lead", "body"), parts
        calm = units.join(hot, "key", "left_anti")
        done = calm if done is None else done.unionByName(calm)
        mid = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
        halves = F.array(F.struct(F.col("low").alias("low"), mid.alias("high")), F.struct((mid + 1).alias("low"), F.col("high").alias("high")))
        cut = units.join(hot, "key", "left_semi").withColumn("half", F.explode(F.filter(halves, lambda h: h["low"] <= h["high"])))
        far, near = F.least("lead", "half.high"), F.greatest(F.col("lead") - F.col("n") + 1, F.col("half.low"))
        cut = cut.withColumn("far", far).withColumn("near", near).filter("near <= far")
        shift = F.col("lead") - F.col("far")
        shared = F.substring("body", F.col("lead") - F.col("half.low") + 1, length - F.col("half.high") + F.col("half.low"))
        body = F.substring("body", shift + 1, F.col("far") - F.col("near") + length)
        cut = cut.select(
            F.xxhash64("key", "half.low", "half.high", shared).alias("key"), "stretch", "m", shift.alias("shift"), (F.col("far") - F.col("near") + 1).alias("n"),
            F.col("far").alias("lead"), body.alias("body"), F.col("half.low").alias("low"), F.col("half.high").alias("high"),
        )
        cut = stored(cut.withColumn("part", F.xxhash64("key", "n", "lead", "body")), "cut")
        step = cut.select("stretch", "shift", "part")
        if parts is not None:  # parts of parts lead back to the stretch
            again = parts.join(step.select(F.col("stretch").alias("part"), F.col("shift").alias("more"), F.col("part").alias("to")), "part", "left")
            first = step.join(parts.select(F.col("part").alias("stretch")).distinct(), "stretch", "left_anti")
            parts = again.select("stretch", (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift"), F.coalesce("to", "part").alias("part")).unionByName(first)
        else:
            parts = step
        parts = stored(parts, "parts")
        # dealt by both: the stored rows lie by nothing, and one anchor's parts must not meet in one task
        one = cut.repartition("key", "part").groupBy("key", "part").agg(F.sum("m").alias("m"), *[F.first(c).alias(c) for c in ("n", "lead", "body", "low", "high")]).withColumnRenamed("part", "stretch")
        several = one.groupBy("key").agg(F.sum("m").alias("places")).filter("places > 1").select("key")
        units = stored(one.join(several, "key", "left_semi"), "units")


def repeated(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, group: int = GROUP) -> tuple[DataFrame, DataFrame]:
    """Documents with repeated windows as doc_id, mark, spans (first and last window of each run), and their texts as doc_id, mark, text. ``mark`` is a
    hash of the text."""
    own = texts_of(docs).select("doc_id", F.xxhash64("text").alias("mark"), "text")
    anchors = stored(own.filter(F.octet_length("text") >= length).mapInArrow(_anchors(length, anchor), ANCHORS), "anchors")
    # stored, so that the join deals both sides out by itself and can split a key that very many places share
    several = stored(anchors.groupBy("key").agg(F.count("*").alias("places")).filter("places > 1").select("key"), "keys")
    met = stored(anchors.join(several, "key", "left_semi"), "met")
    holders = met.select("doc_id", "mark").distinct()
    texts = stored(own.join(holders, own["doc_id"].eqNullSafe(holders["doc_id"]) & (own["mark"] == holders["mark"]), "left_semi").dropDuplicates(["doc_id", "mark"]), "texts")
    units = met.groupBy("key", "stretch").agg(F.count("*").alias("m"), F.min(F.struct("doc_id", "mark", "begin")).alias("at"), F.first("n").alias("n"), F.first("lead").alias("lead"))
    cuts = units.select(F.col("at.doc_id").alias("d"), F.col("at.mark").alias("k"), F.struct("key", "stretch", "m", "n", "lead", F.col("at.begin").alias("begin")).alias("c"))
    cuts = cuts.groupBy("d", "k").agg(F.collect_list("c").alias("cuts"))
    bodies = texts.join(cuts, texts["doc_id"].eqNullSafe(cuts["d"]) & (texts["mark"] == cuts["k"])).select("text", "cuts")
    units, parts = _split_groups(stored(bodies.mapInArrow(_bodies(length), STRETCHES), "stretches"), length, anchor, group)
    found = units.repartition("key").sortWithinPartitions("key").mapInArrow(_transformed(length), "stretch long, spans array<struct<first:int,last:int>>")
    found = stored(found, "found")
    if parts is not None:
        back = parts.join(found.withColumnRenamed("stretch", "part"), "part").select("stretch", F.transform("spans", lambda s: F.struct((s["first"] + F.col("shift")).alias("first"), (s["last"] + F.col("shift")).alias("last"))).alias("spans"))
        found = found.join(parts.select(F.col("part").alias("stretch")).distinct(), "stretch", "left_anti").unionByName(back)
    placed = met.select("doc_id", "mark", "stretch", "begin").join(found, "stretch")
    placed = placed.select("doc_id", "mark", F.transform("spans", lambda s: F.struct((s["first"] + F.col("begin")).alias("first"), (s["last"] + F.col("begin")).alias("last"))).alias("spans"))
    return placed.groupBy("doc_id", "mark").agg(F.flatten(F.collect_list("spans")).alias("spans")), texts


def _removed(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {"n_removed": [], "n_spans": [], "kept_sha256": []}
            for text, spans in zip(batch.column(2).to_pylist(), batch.column(3)):
                body, spans = text.encode(), spans.values
                first, last = np.sort(spans.field("first").to_numpy()).astype(np.int64), np.sort(spans.field("last").to_numpy()).astype(np.int64) + length
                new = np.concatenate([[True], first[1:] > last[:-1]])
                first, last = first[new], last[np.append(np.flatnonzero(new)[1:], len(new)) - 1]
                kept, end = hashlib.sha256(), 0
                for a, b in zip(first.tolist(), last.tolist()):
                    kept.update(body[end:a])
                    end = b
                kept.update(body[end:])
                for name, value in (("n_removed", int((last - first).sum())), ("n_spans", len(first)), ("kept_sha256", kept.hexdigest())):
                    out[name].append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, out.values())], ["doc_id", "mark", *out])

    return run


def without_repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, group: int = GROUP) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    spans, texts = repeated(docs, length, anchor, group)
    spans = spans.withColumnsRenamed({"doc_id": "d", "mark": "k"})
    cut = texts.join(spans, texts["doc_id"].eqNullSafe(spans["d"]) & (texts["mark"] == spans["k"])).select("doc_id", "mark", "text", "spans")
    cut = cut.mapInArrow(_removed(length), "d long, k long, n_removed long, n_spans long, kept_sha256 string")
    whole = texts_of(docs).select("doc_id", F.xxhash64("text").alias("mark"), F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha"))
    return whole.join(cut, whole["doc_id"].eqNullSafe(cut["d"]) & (whole["mark"] == cut["k"]), "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256")
    )
