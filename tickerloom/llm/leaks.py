"""Benchmark passages in training texts, found with an FM-index of each shard.

A shard is a block of whole documents as numbers of words. Words that no item has are ends of stretches, since no window crosses them; so are the ends of
documents. Equal texts of a shard are indexed once. The index is the Burrows-Wheeler transform of the stretches, a wavelet tree over
word numbers for ranks, and the positions of every 16th word. All windows of a block of items are searched at once, backwards word by
word; each occurrence is located by walking to the next sampled position, and the covered words of a document are merged into spans.

Items are read in blocks of a bounded number, each searched in every shard, whatever their number is. A document without words and null text have
nothing hit; items without words match nothing. Rows with one doc_id are documents of their own; several items may share a window. An empty
table gives an empty result, an empty list of items leaves every document clean.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.llm.shared import free_name, ranges, text_bytes, texts_of

WINDOW = 10
SAMPLED = 16
SHARD_WORDS = 1 << 20
ITEMS = 10_000  # a block of items whose windows every task holds at once
# words: digits, letters a-z after A-Z are lowered, and all that is not ASCII
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
HITS = "struct<n_words:long,spans:array<struct<first:int,last:int>>,items:array<string>>"
_SPANS = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
_HITS = pa.struct([("n_words", pa.int64()), ("spans", _SPANS), ("items", pa.list_(pa.string()))])
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


class Windows:
    """The windows of a block of items as rows of word numbers; shorter items are rows of their own length."""

    def __init__(self, items: list[tuple[str, str]], size: int):
        self.numbers: dict[bytes, int] = {}
        rows: dict[tuple[int, ...], set[int]] = {}
        self.items = [i for i, _ in items]
        for k, (_, text) in enumerate(items):
            own = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words_of((text or "").encode())]
            for a in range(max(1, len(own) - size + 1) if own else 0):
                rows.setdefault(tuple(own[a : a + size]), set()).add(k)
        self.lengths = np.array([len(r) for r in rows], np.int64)
        self.least = int(self.lengths.min()) if rows else 1
        self.owner_ends = np.cumsum([len(o) for o in rows.values()], dtype=np.int64)
        self.owners = np.array([k for o in rows.values() for k in sorted(o)], np.int64)
        self.last_first = np.zeros((len(rows), size), np.int32)
        for i, r in enumerate(rows):
            self.last_first[i, : len(r)] = r[::-1]

    def items_of(self, which: set[int]) -> list[str]:
        owners = (self.owners[self.owner_ends[w - 1] if w else 0 : self.owner_ends[w]] for w in which)
        return sorted({self.items[k] for own in owners for k in own.tolist()})


class Index:
    """FM-index of numbers >= 0, in which 0 ends a stretch; the last number must be 0."""

    def __init__(self, text: np.ndarray):
        n = len(text)
        order = _suffixes(text)
        self.n, self.bits = n, max(1, int(text.max()).bit_length())
        self.less = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=1 << self.bits))])
        level = text[order - 1]
        self.ones, self.zeros, self.levels = [], [], []
        for b in range(self.bits - 1, -1, -1):  # a wavelet matrix: each level sorts stably by one bit
            bit = (level >> b) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit, dtype=np.int32)]).astype(np.int32))
            self.zeros.append(n - int(self.ones[-1][-1]))
            level = np.concatenate([level[bit == 0], level[bit == 1]])
        self.sampled = (order % SAMPLED == 0) | (text[order - 1] == 0)  # no walk leaves its stretch, as ends have no order of their own
        self.sample_rank = np.concatenate([[0], np.cumsum(self.sampled, dtype=np.int32)])
        self.places = order[self.sampled]

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How many of the first i numbers of the transform are ``symbol``."""
        low = np.zeros_like(i)
        for k in range(self.bits):
            one = (symbol >> (self.bits - 1 - k)) & 1 == 1
            a, b = self.ones[k][low], self.ones[k][i]
            low, i = np.where(one, self.zeros[k] + a, low - a), np.where(one, self.zeros[k] + b, i - b)
        return i - low

    def back(self, i: np.ndarray) -> np.ndarray:
        """The row of the suffix one number longer."""
        symbol, row = np.zeros_like(i), i
        for k in range(self.bits):
            bit = self.ones[k][row + 1] - self.ones[k][row]
            row = np.where(bit == 1, self.zeros[k] + self.ones[k][row], row - self.ones[k][row])
            symbol = (symbol << 1) | bit
        return self.less[symbol] + self.rank(symbol, i)

    def search(self, last_first: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of the suffixes that begin with each pattern."""
        low, high = np.zeros(len(lengths), np.int64), np.full(len(lengths), self.n)
        for step in range(last_first.shape[1]):
            live = np.flatnonzero((lengths > step) & (low < high))
            if not len(live):
                break
            symbol = last_first[live, step].astype(np.int64)
            known = symbol < len(self.less) - 1
            symbol = np.where(known, symbol, 0)
            base = self.less[symbol]
            low[live] = np.where(known, base + self.rank(symbol, low[live]), 0)
            high[live] = np.where(known, base + self.rank(symbol, high[live]), 0)
        return low, np.maximum(low, high)

    def locate(self, row: np.ndarray) -> np.ndarray:
        """Positions of suffixes, by walking back to a sampled one."""
        place = np.full(len(row), -1, np.int64)
        open_, row, steps = np.arange(len(row)), row.copy(), 0
        while len(open_):
            hit = self.sampled[row]
            place[open_[hit]] = self.places[self.sample_rank[row[hit]]] + steps
            open_, row = open_[~hit], self.back(row[~hit])
            steps += 1
        return place


def _suffixes(text: np.ndarray) -> np.ndarray:
    """Suffix order by doubling. Ends of stretches differ by their place, so every suffix is decided within its stretch; only
    undecided groups are sorted again."""
    n = len(text)
    ends = np.flatnonzero(text == 0)
    key = text.astype(np.int64) + len(ends)
    key[ends] = np.arange(len(ends))
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)
    head = np.concatenate([[True], key[order[1:]] != key[order[:-1]]])
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    width = 1
    while True:
        first = np.flatnonzero(head)
        size = np.diff(first, append=n)
        first, size = first[size > 1], size[size > 1]
        if not len(first):
            return order
        at = np.repeat(first, size) + ranges(size)
        sub = order[at]
        follow = rank[np.minimum(sub + width, n - 1)]
        group = np.repeat(first, size)
        again = np.lexsort((follow, group))
        order[at], follow = sub[again], follow[again]
        head[at[1:]] |= (follow[1:] != follow[:-1]) | (group[1:] != group[:-1])
        rank[order[at]] = np.maximum.accumulate(np.where(head[at], at, 0))
        width *= 2


def _shard_hits(texts: list[np.ndarray], windows: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first word and window of every occurrence. A text is its word numbers, 0 for words no item has."""
    stretches, text_of, first_of = [], [], []
    for i, own in enumerate(texts):
        cuts = np.flatnonzero(np.concatenate([[True], own == 0, [True]]))
        long = np.flatnonzero(np.diff(cuts) > windows.least)
        for a, b in zip(cuts[long].tolist(), cuts[long + 1].tolist()):
            stretches += [own[a : b - 1], np.zeros(1, np.int64)]
            text_of.append(i)
            first_of.append(a)
    if not stretches:
        return (np.zeros(0, np.int64),) * 3
    text = np.concatenate(stretches)
    starts = np.cumsum([0, *[len(s) + 1 for s in stretches[::2]]])[:-1]
    index = Index(text)
    low, high = index.search(windows.last_first, windows.lengths)
    which = np.repeat(np.arange(len(low)), high - low)
    place = index.locate(np.repeat(low, high - low) + ranges(high - low))
    stretch = np.searchsorted(starts, place, "right") - 1
    return np.array(text_of)[stretch], np.array(first_of)[stretch] + place - starts[stretch], which


def _search(windows: Windows, shard_words: int, text_at: int, earlier: bool, names: list[str], column: str):
    """Hits of every row; the columns ``names`` are handed on. With ``earlier`` the last column has the hits of other items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts = text_bytes(batch.column(text_at))
            body, hits, a = data.tobytes(), [], 0
            while a < batch.num_rows:
                known, rows, n_words, held = {}, [], [], 0
                while a < batch.num_rows and held < shard_words:
                    text = body[starts[a] : starts[a + 1]]
                    key = hashlib.blake2b(text, digest_size=16).digest()
                    if key not in known:
                        words = words_of(text)
                        known[key] = (len(known), np.fromiter(map(windows.numbers.get, words, repeat(0)), np.int64, len(words)))
                        held += len(words)
                    rows.append(known[key][0])
                    n_words.append(len(known[key][1]))
                    a += 1
                spans, items = _found(len(known), *_shard_hits([own for _, own in known.values()], windows), windows)
                hits += [{"n_words": n, "spans": spans[r], "items": items[r]} for n, r in zip(n_words, rows)]
            if earlier:
                old = batch.column(batch.num_columns - 1).to_pylist()
                hits = [{"n_words": h["n_words"], "spans": merged(o["spans"] + h["spans"]), "items": sorted({*o["items"], *h["items"]})} for o, h in zip(old, hits)]
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.names.index(n)) for n in names], pa.array(hits, _HITS)], [*names, column])

    return run


def merged(spans: list[dict]) -> list[dict]:
    """Spans in order, those that touch as one."""
    own: list[dict] = []
    for s in sorted(spans, key=lambda s: s["first"]):
        if own and s["first"] <= own[-1]["last"] + 1:
            own[-1]["last"] = max(own[-1]["last"], s["last"])
        else:
            own.append(dict(s))
    return own


def _found(n_texts: int, text: np.ndarray, first: np.ndarray, which: np.ndarray, windows: Windows) -> tuple[list, list]:
    """Occurrences as merged spans and items of every text of a shard."""
    order = np.lexsort((first, text))
    text, first, which = text[order], first[order], which[order]
    last = first + windows.lengths[which] - 1
    bounds = np.searchsorted(text, np.arange(n_texts + 1)).tolist()
    spans, items = [], []
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        own: list[dict] = []
        if lo < hi:
            reach = np.maximum.accumulate(last[lo:hi])
            new = np.flatnonzero(np.concatenate([[True], first[lo + 1 : hi] > reach[:-1] + 1]))
            ends = np.append(new[1:], hi - lo) - 1
            own = [{"first": x, "last": y} for x, y in zip(first[lo:hi][new].tolist(), reach[ends].tolist())]
        spans.append(own)
        items.append(windows.items_of(set(which[lo:hi].tolist())) if lo < hi else [])
    return spans, items


def _blocks(benchmark: DataFrame, size: int) -> Iterator[list[tuple[str, str]]]:
    block: list[tuple[str, str]] = []
    for r in benchmark.select(F.col("item_id").cast("string").alias("i"), F.coalesce("text", F.lit("")).alias("t")).toLocalIterator():
        block.append((r.i, r.t))
        if len(block) == size:
            yield block
            block = []
    if block:
        yield block


def searched(docs: DataFrame, benchmark: DataFrame, keep_text: bool = True, column: str = "hits", window: int = WINDOW, items_at_once: int = ITEMS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``docs`` with a last column (``hits``): n_words, spans (first and last word of merged hits, words from 0) and items (sorted).
    A column of ``docs`` with that name is left out; so is the text without ``keep_text``. No rows move."""
    frame = docs.drop(column)
    names, blocks = frame.columns, [Windows(b, window) for b in _blocks(benchmark, items_at_once)] or [Windows([], window)]
    for i, windows in enumerate(blocks):
        kept = names if keep_text or i + 1 < len(blocks) else [n for n in names if n != "text"]
        schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in frame.select(kept).schema], f"`{column}` {HITS}"])
        frame = frame.mapInArrow(_search(windows, shard_words, names.index("text"), i > 0, kept, column), schema)
    return frame


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Figures of the hits of every document."""
    hit = F.aggregate("hits.spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)
    return searched(texts_of(docs), benchmark, keep_text=False, **options).select(
        "doc_id", "hits.n_words", hit.alias("n_hit"), F.size("hits.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hits.items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"), "hits.spans",
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` in which nothing is hit."""
    own = free_name(docs, "hits")
    return searched(docs, benchmark, column=own, **options).filter(F.size(F.col(own)["spans"]) == 0).drop(own)


def cut_hits(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` with the hit words taken out of the text, and what stands between the words of a span."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.names.index("text")
            texts = []
            for text, hits in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
                if hits["spans"]:
                    body = text.encode()
                    words = [(m.start(), m.end()) for m in WORD.finditer(body)]
                    kept, end = [], 0
                    for s in hits["spans"]:
                        kept.append(body[end : words[s["first"]][0]])
                        end = words[s["last"]][1]
                    text = b"".join([*kept, body[end:]]).decode()
                texts.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(batch.columns[:-1])], batch.schema.names[:-1])

    return searched(docs, benchmark, column=free_name(docs, "hits"), **options).mapInArrow(cut, docs.schema)
