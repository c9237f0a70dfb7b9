"""Ranked lexical search: an inverted index of all terms in shards of documents, searched by Block-Max MaxScore.

Index: each task cuts its documents into shards (``SHARD_BYTES`` of text or ``SHARD_DOCS`` rows; a longer text is a shard of its own), in each of
which documents are numbered by ascending doc_id, null last. A term's list in a shard is a row: its documents in blocks of 64 numbers (a byte each),
its counts, and the largest part of a score it gives in any document, for the list and for every block. Scores need the number of documents and terms
of the whole table, which are counted first.

Search: the lists of the items' terms meet by shard. In a shard an item's lists stand by rising bound (weight times largest part). The lists that even
together cannot lift a document over the score to beat are not essential: only documents of essential lists are looked at, and only where the block
maxima of all lists add up to more than that score. A candidate whose score so far, with the block maxima of the other lists, stays at or under it is
left before their blocks are read. Blocks are read in ascending order, so a later document with an equal score never replaces an earlier one. The best of
each shard are merged by a ranked window. Items are searched in blocks of about ``ITEM_TERMS`` terms, whose weights are broadcast; an item is never split.

Nulls: a text that is null or has no term is in no list; an item without id gives no rows, rows with one item_id are one item with the terms of all;
documents without an id are ranked behind others of the same score. Repeated rows are documents of their own. Empty tables give an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.llm.shared import LOWER, in_blocks, ranges, stored, text_bytes, texts_of

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHARD_BYTES, SHARD_DOCS = 8 << 20, 1 << 15
BITS = 6  # a block holds 2**BITS numbers of documents
ITEM_TERMS = 100_000
ROWS_AT_ONCE = 50_000
FIRST_WINDOW, LAST_WINDOW = 8, 256  # blocks
PART = 1_000_000_000
LISTS = (
    "shard long, term string, n int, peak int, blocks binary, sizes binary, peaks binary, low binary, counts binary, more binary"
)
FOUND = "item_id long, doc_id long, score long"

_lower = np.frombuffer(LOWER, np.uint8)
_in_term = np.array([b > 127 or chr(b).isalnum() for b in range(256)])


@dataclass
class Index:
    """Rows of lists (a row with the empty term holds the documents of a shard) and the totals their parts rest on."""

    lists: DataFrame
    n_docs: int
    n_terms: int


def build_index(docs: DataFrame) -> Index:
    """The stored index of all terms of all documents."""
    texts = texts_of(docs)
    totals = texts.select("text").mapInArrow(_counted, "docs long, terms long").agg(F.sum("docs").alias("docs"), F.sum("terms").alias("terms")).first()
    n_docs, n_terms = totals.docs or 0, totals.terms or 0

    def run(batches):
        first, number, held, size = TaskContext.get().partitionId() << 32, 0, [], 0
        for batch in batches:
            starts = text_bytes(batch.column("text"))[1]
            for a, b in in_blocks(starts, SHARD_BYTES):
                for c in range(a, b, SHARD_DOCS):
                    held.append(batch.slice(c, min(b, c + SHARD_DOCS) - c))
                    size += int(starts[min(b, c + SHARD_DOCS)] - starts[c])
                    if size >= SHARD_BYTES or sum(h.num_rows for h in held) >= SHARD_DOCS:
                        yield from _shard(first + number, held, n_docs, n_terms)
                        held, size, number = [], 0, number + 1
        if held:
            yield from _shard(first + number, held, n_docs, n_terms)

    return Index(stored(texts.mapInArrow(run, LISTS), "lexical-index"), n_docs, n_terms)


def search(index: Index, items: DataFrame, k: int = 50) -> DataFrame:
    """The ``k`` best documents (or fewer, with scores above 0) of every item: item_id, rank, doc_id, score."""
    lowered = F.translate(F.col("text"), UPPER, LOWER_LETTERS)
    terms = stored(
        items.select(F.col("item_id").cast("long").alias("item_id"), F.explode(F.array_distinct(F.regexp_extract_all(lowered, F.lit(TERM), F.lit(0)))).alias("term"))
        .filter("item_id IS NOT NULL").distinct(),
        "item-terms",
    )
    n_blocks = max(1, math.ceil(terms.count() / ITEM_TERMS))
    found = None
    for number in range(n_blocks):
        own = terms.filter(F.pmod(F.hash("item_id"), F.lit(n_blocks)) == number)
        best = _search_block(index, own, k)
        found = best if found is None else found.union(best)
    ranked = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _search_block(index: Index, terms: DataFrame, k: int) -> DataFrame:
    wanted = F.broadcast(terms.groupBy("term").agg(F.collect_list("item_id").alias("items")))  # one block of items
    held = index.lists.select("term", "n").join(wanted, "term").groupBy("term").agg(F.sum("n").alias("df"), F.first("items").alias("items"))
    weight = F.floor(1000 * F.ln(F.lit(2.0 * index.n_docs + 2) / (2.0 * F.col("df") + 1)))
    weights = F.broadcast(held.select("term", weight.cast("long").alias("weight"), "items").filter("weight > 0"))
    columns = ["shard", "n", "peak", "blocks", "sizes", "peaks", "low", "counts", "more"]
    lists = index.lists.join(weights, "term").select("weight", "items", *columns)
    shards = index.lists.filter("term = ''").select(F.lit(None).cast("long").alias("weight"), F.lit(None).cast("array<long>").alias("items"), *columns)
    return lists.union(shards).groupBy("shard").applyInArrow(lambda table: _search_shard(table, k), FOUND)


# --- building


def _counted(batches):
    for batch in batches:
        docs = terms = 0
        starts = text_bytes(batch.column("text"))[1]
        for a, b in in_blocks(starts, SHARD_BYTES):
            data, own = text_bytes(batch.column("text").slice(a, b - a))
            n = np.diff(np.searchsorted(_terms(_in_term[data], own)[0], own))
            docs, terms = docs + int((n > 0).sum()), terms + int(n.sum())
        yield pa.RecordBatch.from_pydict({"docs": [docs], "terms": [terms]})


def _terms(inside: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where terms begin and end; none goes on from one text into the next."""
    edge = np.zeros(len(inside) + 1, bool)  # between two bytes: something begins or ends
    edge[1:-1] = inside[1:] != inside[:-1]
    edge[starts] = True
    edge = np.flatnonzero(edge)
    held = inside[np.minimum(edge[:-1], len(inside) - 1)] if len(inside) else np.zeros(0, bool)
    return edge[:-1][held], edge[1:][held]


def _shard(shard: int, parts: list[pa.RecordBatch], n_docs: int, n_terms: int):
    """Rows of lists of the documents of one shard."""
    rows = pa.Table.from_batches(parts).combine_chunks().to_batches()[0] if sum(p.num_rows for p in parts) else None
    if rows is None or not n_terms:
        return
    ids = rows.column("doc_id")
    missing = np.asarray(ids.is_null())
    ids = ids.fill_null(0).to_numpy()
    number = np.empty(len(ids), np.int64)
    order = np.lexsort((ids, missing))
    number[order] = np.arange(len(ids))
    data, starts = text_bytes(rows.column("text"))
    inside = _in_term[data]
    at, ends = _terms(inside, starts)
    doc = number[np.searchsorted(starts, at, "right") - 1]
    n = np.bincount(doc, minlength=len(ids))
    m = 50 + (50 * n * n_docs) // n_terms
    if len(at):
        offsets = np.concatenate([[0], np.cumsum(ends - at)]).astype(np.int32)
        coded = pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(_lower[data[inside]])).dictionary_encode()
        key = coded.indices.to_numpy() * np.int64(len(ids)) + doc
        del at, ends, doc, offsets, inside, data, rows, parts
        key.sort()
        first = np.flatnonzero(np.diff(key, prepend=-1))
        counts = np.diff(first, append=len(key))
        term, doc = key[first] // len(ids), key[first] % len(ids)
        yield from _lists(shard, coded.dictionary, term, doc, counts, (PART * counts) // (1000 * counts + 20 * m[doc]))
    one = [np.array([0, 8 * len(ids)]), np.array([0, len(ids)])]
    yield _batch(shard, pa.array([""]), [len(ids)], [0], {
        "low": (ids[order].astype("<i8"), one[0]), "counts": (m.astype("<i8"), one[0]), "more": (missing[order].astype(np.uint8), one[1]),
    })


def _lists(shard: int, names: pa.Array, term: np.ndarray, doc: np.ndarray, counts: np.ndarray, part: np.ndarray):
    lists = np.flatnonzero(np.diff(term, prepend=-1))
    block_key = term * (1 << 40) + (doc >> BITS)
    blocks = np.flatnonzero(np.diff(block_key, prepend=-1))
    n, peak = np.diff(lists, append=len(term)), np.maximum.reduceat(part, lists)
    sizes, peaks, number = np.diff(blocks, append=len(term)), np.maximum.reduceat(part, blocks), doc[blocks] >> BITS
    first_block = np.append(np.searchsorted(blocks, lists), len(blocks))
    wide = np.maximum.reduceat(counts, lists) > 255
    list_of = np.repeat(np.arange(len(lists)), n)
    high = counts[wide[list_of]] >> 8
    high_ends = np.concatenate([[0], np.cumsum(np.where(wide, n, 0))])
    lists_end = np.append(lists, len(term))
    names = names.take(pa.array(term[lists]))
    low, narrow = (doc & ((1 << BITS) - 1)).astype(np.uint8), (counts & 255).astype(np.uint8)
    for a in range(0, len(lists), ROWS_AT_ONCE):
        b = min(len(lists), a + ROWS_AT_ONCE)
        x, y, z = first_block[a : b + 1], lists_end[a : b + 1], high_ends[a : b + 1]
        yield _batch(shard, names.slice(a, b - a), n[a:b], peak[a:b], {
            "blocks": (number[x[0] : x[-1]].astype("<u2"), 2 * (x - x[0])), "sizes": (sizes[x[0] : x[-1]].astype("<u2"), 2 * (x - x[0])),
            "peaks": (peaks[x[0] : x[-1]].astype("<i4"), 4 * (x - x[0])), "low": (low[y[0] : y[-1]], y - y[0]),
            "counts": (narrow[y[0] : y[-1]], y - y[0]), "more": (high[z[0] : z[-1]].astype("<u4"), 4 * (z - z[0])),
        })


def _batch(shard: int, names: pa.Array, n, peak, bodies: dict) -> pa.RecordBatch:
    columns = {"shard": pa.array(np.full(len(n), shard, np.int64)), "term": names.cast(pa.string()), "n": pa.array(n, pa.int32()), "peak": pa.array(peak, pa.int32())}
    for name in ("blocks", "sizes", "peaks", "low", "counts", "more"):
        data, offsets = bodies.get(name, (np.zeros(0, np.uint8), np.zeros(len(n) + 1, np.int64)))
        columns[name] = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
    return pa.RecordBatch.from_pydict(columns)


# --- searching


class Shard:
    """The lists of one shard that some item wants, their blocks as one directory; postings stay as stored until a block is read."""

    def __init__(self, table: pa.Table):
        head = np.asarray(table["weight"].is_null())
        documents = table.filter(pa.array(head))
        self.ids = np.frombuffer(documents["low"][0].as_py(), "<i8")
        self.m = np.frombuffer(documents["counts"][0].as_py(), "<i8")
        self.missing = np.frombuffer(documents["more"][0].as_py(), np.uint8).astype(bool)
        lists = table.filter(pa.array(~head)).combine_chunks()
        self.items = lists["items"].combine_chunks() if lists.num_rows else pa.array([], pa.list_(pa.int64()))
        self.weight = lists["weight"].to_numpy()
        self.peak = lists["peak"].to_numpy().astype(np.int64)
        joined = {name: b"".join(lists[name].to_pylist()) for name in ("blocks", "sizes", "peaks", "low", "counts", "more")}
        self.block = np.frombuffer(joined["blocks"], "<u2").astype(np.int64)
        self.size = np.frombuffer(joined["sizes"], "<u2").astype(np.int64)
        self.block_peak = np.frombuffer(joined["peaks"], "<i4").astype(np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.low, self.counts = np.frombuffer(joined["low"], np.uint8), np.frombuffer(joined["counts"], np.uint8)
        self.n = lists["n"].to_numpy().astype(np.int64)
        n_blocks = np.array([len(b.as_py()) // 2 for b in lists["blocks"]], np.int64)
        self.first = np.concatenate([[0], np.cumsum(n_blocks)])
        more = np.array([len(b.as_py()) // 4 for b in lists["more"]], np.int64)
        if more.any():
            high = np.zeros(len(self.counts), np.int64)
            high[np.repeat(more > 0, self.n)] = np.frombuffer(joined["more"], "<u4")
            self.counts = self.counts + (high << 8)
        self.read = 0

    def postings(self, entries: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents of directory entries and what each adds to the score, given the weight of each entry's list."""
        sizes = self.size[entries]
        self.read += int(sizes.sum())
        at = np.repeat(self.start[entries], sizes) + ranges(sizes)
        docs = np.repeat(self.block[entries] << BITS, sizes) + self.low[at]
        tf = self.counts[at].astype(np.int64)
        return docs, np.repeat(weights, sizes) * ((PART * tf) // (1000 * tf + 20 * self.m[docs]))

    def best(self, lists: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and scores of the ``k`` best documents for the terms of ``lists``, best first."""
        bound = self.weight[lists] * self.peak[lists]
        order = np.argsort(bound, kind="stable")
        lists, reach = lists[order], np.cumsum(bound[order])
        weights = self.weight[lists]
        n_blocks = (len(self.ids) + (1 << BITS) - 1) >> BITS
        counts = self.first[lists + 1] - self.first[lists]
        entries = np.repeat(self.first[lists], counts) + ranges(counts)
        row = np.repeat(np.arange(len(lists)), counts)
        entry = np.full((len(lists), n_blocks), -1, np.int64)
        entry[row, self.block[entries]] = entries
        peak = np.zeros((len(lists), n_blocks), np.int64)
        peak[row, self.block[entries]] = weights[row] * self.block_peak[entries]
        total = peak.sum(axis=0)
        top, score, beat, begin, width = np.zeros(0, np.int64), np.zeros(0, np.int64), 0, 0, FIRST_WINDOW
        while begin < n_blocks:
            end = min(n_blocks, begin + width)
            optional = int(np.searchsorted(reach, beat, "right")) if beat else 0  # lists that are not essential
            if optional == len(lists):
                break
            active = np.flatnonzero(total[begin:end] > beat) + begin
            if len(active):
                docs, scores = self._window(entry, peak, weights, active, begin, end, optional, beat)
                top, score = np.concatenate([top, docs]), np.concatenate([score, scores])
                if len(top) > k:
                    kept = np.lexsort((top, -score))[:k]
                    top, score = top[kept], score[kept]
                if len(top) == k:
                    beat = int(score.min())
            begin, width = end, min(LAST_WINDOW, 2 * width)
        kept = np.lexsort((top, -score))
        return top[kept], score[kept]

    def _window(self, entry, peak, weights, active, begin, end, optional, beat) -> tuple[np.ndarray, np.ndarray]:
        """Documents of the blocks ``begin`` to ``end`` with more than ``beat``, and their scores."""
        base, length = begin << BITS, (end - begin) << BITS
        essential = entry[optional:, active]
        row, column = np.nonzero(essential >= 0)
        docs, adds = self.postings(essential[row, column], weights[optional:][row])
        sums = np.bincount(docs - base, adds, length).astype(np.int64)  # whole numbers far below 2**53
        found = np.flatnonzero(sums > 0)
        if optional:
            rest = np.cumsum(peak[:optional, begin:end], axis=0)
            found = found[sums[found] + rest[-1, found >> BITS] > beat]
            for j in range(optional - 1, -1, -1):
                if not len(found):
                    break
                own = entry[j, begin + np.unique(found >> BITS)]
                own = own[own >= 0]
                if len(own):
                    docs, adds = self.postings(own, np.full(len(own), weights[j]))
                    sums[docs - base] += adds
                if j:
                    found = found[sums[found] + rest[j - 1, found >> BITS] > beat]
        found = found[sums[found] > beat]
        return found + base, sums[found]


def _search_shard(table: pa.Table, k: int) -> pa.Table:
    shard = Shard(table)
    of = np.repeat(np.arange(len(shard.items)), np.diff(shard.items.offsets.to_numpy()))
    item = shard.items.flatten().to_numpy()
    order = np.argsort(item, kind="stable")
    of, item = of[order], item[order]
    begins = np.flatnonzero(np.diff(item, prepend=item[0] - 1)) if len(item) else np.zeros(0, np.int64)
    items, numbers, scores = [], [], []
    for a, b in zip(begins, np.append(begins[1:], len(item))):
        docs, points = shard.best(of[a:b], k)
        items.append(np.full(len(docs), item[a]))
        numbers.append(docs)
        scores.append(points)
    docs = np.concatenate([*numbers, np.zeros(0, np.int64)]).astype(np.int64)
    return pa.table({
        "item_id": pa.array(np.concatenate([*items, np.zeros(0, np.int64)]).astype(np.int64)), "doc_id": pa.array(shard.ids[docs], mask=shard.missing[docs]),
        "score": pa.array(np.concatenate([*scores, np.zeros(0, np.int64)]).astype(np.int64)),
    })
