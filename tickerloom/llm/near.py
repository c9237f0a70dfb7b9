"""Near duplicates by SuperMinHash signatures, banding, exact verification and union of linked groups.

A text is the set of its k-word runs (the whole sequence if it has fewer words). Each element ranks the registers of a signature by a random
permutation of its own: in round j it offers j plus a random part to the j-th register of its permutation, and rounds end
once no register can fall any further. Texts that agree on all registers of a band meet; bands are so many that a pair at the threshold is missed with a probability
under ``MISSED``. Links are confirmed on the full sets.

Scale: texts with the same set are one class and are compared once. In each meeting place every class is compared with one hub, the class that meets
most others, so a group of any size gives a link per member. What remains are pairs that share a hub but not a group. Of those only pairs that can reach the threshold
are looked at: were two sets alike, then so would be their differences from the hub, and the first few elements of these (in one fixed
order, those that the hub lacks first) would have to meet; and pairs whose differences are too large to be made up by what both lack of the hub meet by an element that
the hub lacks. So members of a hub meet again by these elements, in blocks of ``BLOCK_OF``, and pairs whose
sizes, distances to the hub and sketches allow the threshold are verified. Sets are kept only for classes that met another.

Null or empty text has the empty set and is linked with nothing. A row without doc_id is a group of its own. Rows with the same doc_id are compared each with its
own text. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.llm.shared import LOWER, forget, in_blocks, mixed, ranges, stored, text_bytes, texts_of

WORDS, SAME_OF_100 = 5, 80
ROWS = 7  # registers of a band
MISSED = 1e-6
SKETCH = 64  # registers of which a byte each is kept
BLOCK_OF = 256
BLOCK_BYTES = 1 << 18
PIECE = 1 << 15  # elements of a set that are ranked together; a register is the least over all pieces
SIGNED = "doc_id long, mark long, class long, n_shingles long, bands array<long>, sketch binary"
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def bands_for(same_of_100: int, rows: int = ROWS) -> int:
    """Bands that miss a pair at the threshold with a probability under MISSED."""
    return math.ceil(math.log(MISSED) / math.log(1 - (same_of_100 / 100) ** rows))


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _FACTOR, np.uint64)]))


def word_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of lower-cased texts in order, and how many words each text has."""
    inside = ~_BLANK[data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    heads = starts[:-1][starts[:-1] < starts[1:]]
    begin[heads] |= inside[heads]
    at = np.flatnonzero(begin)
    counts = np.diff(np.searchsorted(at, starts))
    if not len(at):
        return np.zeros(0, np.uint64), counts
    ends = np.append(at[1:], len(data))
    place = np.arange(at[0], len(data)) - np.repeat(at, ends - at)
    value = np.where(inside[at[0] :], (data[at[0] :].astype(np.uint64) + np.uint64(1)) * _powers(int(place.max()) + 1)[place], np.uint64(0))
    return mixed(np.add.reduceat(value, at - at[0])), counts


def shingle_sets(data: np.ndarray, starts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of the k-word runs of each text, as one array, and where each text begins."""
    n = len(starts) - 1
    words, counts = word_hashes(np.frombuffer(data.tobytes().translate(LOWER), np.uint8), starts)
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    m = np.where(counts > 0, np.maximum(counts - k + 1, 1), 0)
    first = np.repeat(np.cumsum(counts) - counts, m) + ranges(m)
    own, run = np.repeat(np.minimum(counts, k), m), np.zeros(int(m.sum()), np.uint64)
    for j in range(k):
        more = own > j
        run = np.where(more, mixed(run * _FACTOR + words[np.minimum(first + j, len(words) - 1)] + np.uint64(j)), run)
    sets, sizes, a = [], np.zeros(n, np.int64), 0
    for i, size in enumerate(m.tolist()):
        if size:
            own_set = np.unique(run[a : a + size])
            sets.append(own_set)
            sizes[i], a = len(own_set), a + size
    return np.concatenate(sets), np.concatenate([[0], np.cumsum(sizes)])


def super_min_hash(elements: np.ndarray, starts: np.ndarray, m: int) -> np.ndarray:
    """Signatures (one row of m registers each) of non-empty sets. A register's upper 16 bits are the round, the others random."""
    n = len(starts) - 1
    sizes = np.diff(starts)
    out = np.full((n, m), np.iinfo(np.int64).max, np.int64)
    flat = out.reshape(-1)
    permutation = np.tile(np.arange(m, dtype=np.uint16), (len(elements), 1))
    of, live = np.repeat(np.arange(n), sizes), np.arange(len(elements))
    for j in range(m):
        draw = mixed(elements[live] + np.uint64(int(_FACTOR) * (2 * j + 1) % (1 << 64)))
        k = j + ((draw & np.uint64(0xFFFF)) * np.uint64(m - j) >> np.uint64(16)).astype(np.int64)
        register = permutation[live, k].astype(np.int64)
        permutation[live, k] = permutation[live, j]
        value = (np.int64(j) << 48) | (mixed(draw) >> np.uint64(16)).astype(np.int64)
        np.minimum.at(flat, of[live] * m + register, value)
        still = (out >> 48).max(1) > j  # a register above this round can still fall
        live = live[still[of[live]]]
        if not len(live):
            break
    return out


def signatures(elements: np.ndarray, sizes: np.ndarray, m: int) -> np.ndarray:
    """Signatures of sets that follow each other; large ones are ranked in pieces."""
    pieces = -(-sizes // PIECE)
    of, k = np.repeat(np.arange(len(sizes)), pieces), ranges(pieces)
    parts = np.minimum(PIECE, sizes[of] - k * PIECE)
    ends, out = np.concatenate([[0], np.cumsum(parts)]), []
    for a, b in in_blocks(ends, 2 * PIECE):
        out.append(super_min_hash(elements[ends[a] : ends[b]], ends[a : b + 1] - ends[a], m))
    return np.minimum.reduceat(np.concatenate(out), np.cumsum(pieces) - pieces, axis=0)


def _sign(k: int, bands: int, rows: int):
    m = bands * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            data, starts = text_bytes(batch.column(2))
            for a, b in in_blocks(starts, BLOCK_BYTES):
                sets, ends = shingle_sets(data[starts[a] : starts[b]], starts[a : b + 1] - starts[a], k)
                sizes = np.diff(ends)
                full = np.flatnonzero(sizes)
                classes = np.zeros(b - a, np.uint64)
                keys, sketch = [[] for _ in range(b - a)], [None] * (b - a)
                if len(full):
                    classes[full] = class_of(sets, ends[:-1][full], sizes[full])
                    _, first, again = np.unique(classes[full], return_index=True, return_inverse=True)
                    chosen = full[first]
                    at = np.repeat(ends[:-1][chosen], sizes[chosen]) + ranges(sizes[chosen])
                    signature = signatures(sets[at], sizes[chosen], m)
                    own = np.zeros((len(chosen), bands), np.uint64) + np.arange(bands, dtype=np.uint64)
                    for r in range(rows):
                        own = mixed(own * _FACTOR + signature[:, r::rows].astype(np.uint64))
                    small = mixed(signature[:, :SKETCH].astype(np.uint64)).astype(np.uint8)
                    for i, row in zip(full.tolist(), again.tolist()):
                        keys[i], sketch[i] = own[row].view(np.int64), small[row].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b], batch.column(1)[a:b], pa.array(classes.view(np.int64)), pa.array(sizes), pa.array(keys, pa.list_(pa.int64())), pa.array(sketch, pa.binary())],
                    ["doc_id", "mark", "class", "n_shingles", "bands", "sketch"],
                )

    return run


def class_of(sets: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One number for each set: equal sets have equal numbers."""
    total = np.add.reduceat(mixed(sets), starts)
    twist = np.bitwise_xor.reduceat(mixed(sets ^ _FACTOR), starts)
    return mixed(mixed(total) + twist * _FACTOR + sizes.astype(np.uint64))


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts = text_bytes(batch.column(1))
            for a, b in in_blocks(starts, BLOCK_BYTES):
                sets, ends = shingle_sets(data[starts[a] : starts[b]], starts[a : b + 1] - starts[a], k)
                full = np.flatnonzero(np.diff(ends))
                if len(full):
                    classes = class_of(sets, ends[:-1][full], np.diff(ends)[full]).view(np.int64)
                    own = [sets[ends[i] : ends[i + 1]].tobytes() for i in full.tolist()]
                    good = classes == batch.column(0)[a:b].to_numpy()[full]  # a doc_id may stand for several texts
                    yield pa.RecordBatch.from_arrays([pa.array(classes[good]), pa.array([o for o, g in zip(own, good) if g], pa.binary())], ["class", "hashes"])

    return run


COMPARED = "class long, hub long, linked boolean, apart int, added int, head array<int>"


def _compare(same_of_100: int, heads: bool):
    """Whether two sets are alike, the size of their difference, and its first elements: as many as two like sets can differ by, and one."""
    room = (100 - same_of_100) / same_of_100

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked, apart, added, head = [], [], [], []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                shared = y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x
                both = int(shared.sum())
                linked.append(100 * both >= same_of_100 * (len(x) + len(y) - both))
                apart.append(len(x) + len(y) - 2 * both)
                own = x[~shared]
                added.append(len(own))
                wanted = int(len(x) * room + 1e-9) + 1 if heads else 0
                if len(own) < wanted:
                    own = np.concatenate([own, y[x[np.minimum(np.searchsorted(x, y), len(x) - 1)] != y]])
                head.append((own[:wanted] >> np.uint64(32)).astype(np.uint32).view(np.int32))
            columns = [pa.array(linked, pa.bool_()), pa.array(apart, pa.int32()), pa.array(added, pa.int32()), pa.array(head, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["class", "hub", "linked", "apart", "added", "head"])

    return run


def compared(docs: DataFrame, classes: DataFrame, pairs: DataFrame, k: int, same_of_100: int, heads: bool) -> DataFrame:
    """Pairs (class, hub) of classes with the comparison of their full sets."""
    met = pairs.select("class").union(pairs.select("hub")).distinct()
    wanted = classes.join(met, "class", "left_semi").select("class", F.col("rep").alias("wanted"))
    texts = texts_of(docs).join(wanted, F.col("doc_id") == F.col("wanted")).select("class", "text")
    sets = stored(texts.mapInArrow(_sets(k), "class long, hashes binary").dropDuplicates(["class"]), "sets")
    left = pairs.join(sets.withColumnRenamed("hashes", "x"), "class")
    both = left.join(sets.select(F.col("class").alias("hub"), F.col("hashes").alias("y")), "hub").select("class", "hub", "x", "y")
    return stored(both.mapInArrow(_compare(same_of_100, heads), COMPARED), "compared")


def components(links: DataFrame) -> DataFrame:
    """class, root (smallest class of its group) for all classes with a link, by turns of joining every class's larger neighbours, then its smaller ones, to its
    smallest; a turn ends in a written table, and a star is finished in one."""
    edges = links.filter("linked").select(F.greatest("class", "hub").alias("u"), F.least("class", "hub").alias("v")).filter("u > v").distinct()
    state = None
    while True:
        both = edges.union(edges.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stored(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").union(least).distinct()
        edges = stored(small, "edges")
        now = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
        if state == now:
            return edges.select(F.col("u").alias("class"), F.col("v").alias("root")).union(edges.select(F.col("v"), F.col("v")).distinct())
        state = now


def _open_pairs(same_of_100: int):
    """Pairs of two blocks of one place that lie in different groups and whose sizes, distances and sketches allow the threshold."""
    share = same_of_100 / 100

    def pairs(part: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        x, y = np.flatnonzero(part["mine"] == part["i"]), np.flatnonzero(part["mine"] == part["j"])
        n, root, c, apart, sketch = (part[k] for k in ("n", "root", "class", "apart", "sketch"))
        nx, ny = n[x][:, None], n[y]
        can = (root[x][:, None] != root[y]) & (np.minimum(nx, ny) >= share * np.maximum(nx, ny) - 1e-6)
        room = (1 - share) / (1 + share) * (nx + ny) + 1e-6
        can &= np.abs(apart[x][:, None] - apart[y]) <= room
        if not part["lacking"][0]:  # an element of the hub: pairs that need to share others too meet there
            a, r = part["added"], apart - part["added"]
            can &= a[x][:, None] + a[y] + np.abs(r[x][:, None] - r[y]) <= room
        if part["i"][0] == part["j"][0]:
            can &= c[x][:, None] < c[y]
        p, q = np.nonzero(can)
        width = sketch.shape[1]
        least = (share - 6 * math.sqrt(share * (1 - share) / width)) * width  # six standard deviations of the estimate
        good = (sketch[x[p]] == sketch[y[q]]).sum(1) >= least
        return c[x[p[good]]], c[y[q[good]]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.table(batch.columns, names=batch.schema.names)
            rest = table if rest is None else pa.concat_tables([rest, table])
            done, rest = _split(rest)
            yield from emit(done)
        if rest is not None:
            yield from emit(rest)

    def emit(table: pa.Table) -> Iterator[pa.RecordBatch]:
        if table is None or not table.num_rows:
            return
        part = {n: table.column(n).to_numpy(zero_copy_only=False) for n in ("place", "i", "j", "mine", "class", "root", "n", "apart", "added", "lacking")}
        part["sketch"] = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(table.num_rows, -1)
        new = np.flatnonzero((np.diff(part["place"]) != 0) | (np.diff(part["i"]) != 0) | (np.diff(part["j"]) != 0)) + 1
        for a, b in zip([0, *new.tolist()], [*new.tolist(), table.num_rows]):
            x, y = pairs({k: v[a:b] for k, v in part.items()})
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["class", "hub"])

    return run


def _split(table: pa.Table) -> tuple[pa.Table | None, pa.Table]:
    """All but the last group of rows with the same place and blocks, and the last one, which may go on."""
    keys = [table.column(n).to_numpy() for n in ("place", "i", "j")]
    other = np.flatnonzero(np.any([k != k[-1] for k in keys], axis=0))
    cut = int(other[-1]) + 1 if len(other) else 0
    return (table.slice(0, cut) if cut else None), table.slice(cut)


def unsettled(links: DataFrame, classes: DataFrame, groups: DataFrame, same_of_100: int) -> DataFrame:
    """Candidate pairs of classes that were compared with one hub and do not share a group."""
    root_of = groups.select("class", "root")
    named = links.join(root_of, "class", "left").withColumn("root", F.coalesce("root", "class"))
    open_ = named.groupBy("hub").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("hub")
    met = named.join(open_, "hub", "left_semi").select(F.posexplode("head").alias("at", "element"), "hub", "class", "root", "apart", "added")
    lacking = (F.col("at") < F.col("added")).alias("lacking")
    met = met.select(F.xxhash64("hub", "element", lacking).alias("place"), "class", "root", "apart", "added", lacking).dropDuplicates(["place", "class"])
    split = met.groupBy("place").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("members")).filter("low < high")
    split = split.select("place", F.ceil(F.col("members") / BLOCK_OF).cast("int").alias("blocks"))
    rows = met.join(split, "place").join(classes.select("class", F.col("n_shingles").alias("n"), "sketch"), "class")
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("place", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "class", "root", "n", "apart", "added", "lacking", "sketch")
    rows = rows.repartition("place", "i", "j").sortWithinPartitions("place", "i", "j")
    return rows.mapInArrow(_open_pairs(same_of_100), "class long, hub long").distinct()


def near_groups(docs: DataFrame, words: int = WORDS, same_of_100: int = SAME_OF_100, rows: int = ROWS) -> DataFrame:
    """doc_id, mark (hash of the text), n_shingles, component_id (smallest doc_id reachable by links, itself included), kept."""
    marked = texts_of(docs).select("doc_id", F.xxhash64("text").alias("mark"), "text")
    signed = stored(marked.mapInArrow(_sign(words, bands_for(same_of_100, rows), rows), SIGNED), "signed")
    linked = signed.filter("doc_id is not null and n_shingles > 0")
    classes = stored(linked.groupBy("class").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "classes")
    met = classes.select("class", F.explode("bands").alias("place"))
    shared = met.groupBy("place").agg(F.count("*").alias("members")).filter("members > 1")
    places = stored(met.join(shared, "place"), "places")  # only where several classes meet
    degrees = places.groupBy("class").agg(F.sum("members").alias("degree"))
    hubs = places.join(degrees, "class").groupBy("place").agg(F.max(F.struct("degree", "class")).alias("top")).select("place", F.col("top.class").alias("hub"))
    pairs = stored(places.join(hubs, "place").select("class", "hub").filter("class <> hub").distinct(), "pairs")
    links = compared(docs, classes, pairs, words, same_of_100, heads=True)
    more = stored(unsettled(links, classes, components(links), same_of_100).join(pairs, ["class", "hub"], "left_anti"), "more")
    links = links.unionByName(compared(docs, classes, more, words, same_of_100, heads=False))
    roots = classes.select("class", "rep").join(components(links), "class", "left").select("class", F.coalesce("root", "class").alias("root"), "rep")
    least = roots.groupBy("root").agg(F.min("rep").alias("component_id"))
    found = roots.join(least, "root").select("class", "component_id")
    own = signed.select("doc_id", "mark", "n_shingles", F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("class")).alias("class"))
    joined = own.join(found, "class", "left").select("doc_id", "mark", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return joined.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each_group(docs: DataFrame, words: int = WORDS, same_of_100: int = SAME_OF_100) -> DataFrame:
    """The rows of ``docs`` that stay: those of the smallest doc_id of each group."""
    gone = near_groups(docs, words, same_of_100).filter("not kept").select(F.col("doc_id").alias("_doc_id"), F.col("mark").alias("_mark")).distinct()
    same = (docs["doc_id"].cast("long") == gone["_doc_id"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == gone["_mark"])
    return docs.join(gone, same, "left_anti")
