"""Language of whole texts by prediction by partial matching.

For each language a tree of byte contexts up to ``ORDER`` long holds counts of the byte that follows. A byte costs its code length in the longest
context in which it was seen, and an escape for each longer one in which it was not (escape weight: the number of different
bytes seen there); below the root all bytes are equally likely. Contexts reach back to the space before a word, so a word has one
exact code length in each language, and a text the sum over its words. The statistics are frozen after training; a worker remembers
the lengths of words it has met, within bounds.

Training counts the byte runs of every labelled document, whole texts, on Spark; prediction covers everything. Runs are at most ``ORDER + 1`` bytes, so the
trees grow with what is new in the texts, not with the texts. Null text or text without a letter is ``und`` with score 0, as is everything if nothing is
labelled. Ties go to the first language by name. Rows with one doc_id are predicted on their own; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerloom.llm.shared import LOWER, free_name, in_blocks, text_bytes
from tickerloom.llm.shared import kept as remembered

ORDER = 4
COUNTED_BYTES, RUNS_BYTES = 32 << 20, 1 << 21  # texts whose words are counted at once, distinct words whose runs are
ENOUGH_BYTES, FAR, RAW_BITS, SPARE_BITS = 200, 1.25, 8, 400  # what a text of some language costs at most
UNKNOWN = "und"
REMEMBERED, REMEMBERED_BYTES = 400_000, 32 << 20
LETTER = re.compile(r"[^\W\d_]")
GRAMS = "lang string, gram long, n long"
FOUND = "struct<lang:string,score:double,bits_per_byte:double>"
_FOUND = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("bits_per_byte", pa.float64())])


def has_letter(text: str) -> bool:
    first = LETTER.search(text)  # also finds signs like superscript digits, so these are looked at closely
    return first is not None and (first.group().isalpha() or any(map(str.isalpha, text)))


def held_out(doc_id: Column, parts: int = 4, which: int = 2) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(parts)) == which


def _runs(words: list[bytes], n: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the runs of up to ``order + 1`` bytes in words that stand ``n`` times each, behind a space and before one, and how often they stand there."""
    lengths = np.array([len(w) for w in words], np.int64) + 2
    body = np.frombuffer(b" " + b"  ".join(words) + b" ", np.uint8).astype(np.uint64)
    at, weight = np.arange(len(body)) - np.repeat(np.cumsum(lengths) - lengths, lengths), np.repeat(n, lengths)
    keys, counts = [], []
    for k in range(order + 1):
        rows = np.flatnonzero(at >= max(k, 1))
        run = np.zeros(len(rows), np.uint64)
        for back in range(k, -1, -1):
            run = (run << np.uint64(8)) | body[rows - back]
        key, where = np.unique(run, return_inverse=True)
        keys.append(key | np.uint64((k + 1) << 56))
        counts.append(np.bincount(where, weight[rows]).astype(np.int64))
    return np.concatenate(keys), np.concatenate(counts)


def _count_grams(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = {}
        held = 0

        def counted() -> Iterator[pa.RecordBatch]:
            for lang, own in words.items():
                distinct, n = list(own), np.array(list(own.values()), np.int64)
                ends = np.concatenate([[0], np.cumsum([len(w) + 2 for w in distinct], dtype=np.int64)])
                for a, b in in_blocks(ends, RUNS_BYTES):
                    key, times = _runs(distinct[a:b], n[a:b], order)
                    yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(key)), pa.array(key.view(np.int64)), pa.array(times)], ["lang", "gram", "n"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words.setdefault(lang, Counter()).update(text.encode().translate(LOWER).split())
                held += len(text)
                if held > COUNTED_BYTES:
                    yield from counted()
                    words, held = {}, 0
        yield from counted()

    return run


def train(labelled: DataFrame, order: int = ORDER) -> "Trees":
    """Context trees from text and lang of all rows that have both. The driver gets the distinct byte runs."""
    used = labelled.filter("text is not null and lang is not null").select("lang", "text")
    counted = used.mapInArrow(_count_grams(order), GRAMS).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    return Trees(counted.toArrow(), order)


def _keys(grams: pa.ChunkedArray) -> np.ndarray:
    """The length and the bytes of each run in one number; runs that Spark counted come as such numbers."""
    if pa.types.is_integer(grams.type):
        return grams.to_numpy().view(np.uint64)
    return np.array([(len(g) << 56) | int.from_bytes(g, "big") for g in grams.to_pylist()], np.uint64)


class Trees:
    """Code lengths of all languages: for each byte run seen, the cost of its last byte in the context of the others (infinite where a language has not seen
    it), and for each context the cost of an escape."""

    def __init__(self, counted: pa.Table, order: int):
        self.order, self.name = order, uuid.uuid4().hex
        lang = counted.column("lang").combine_chunks().dictionary_encode()
        self.langs = sorted(lang.dictionary.to_pylist())
        of = np.array([self.langs.index(x) for x in lang.dictionary.to_pylist()], np.int64)
        keys, col, n = _keys(counted.column("gram")), of[lang.indices.to_numpy()], counted.column("n").to_numpy().astype(np.float64)
        size = keys >> np.uint64(56)
        contexts = ((size - np.uint64(1)) << np.uint64(56)) | ((keys ^ (size << np.uint64(56))) >> np.uint64(8))
        self.grams, row = np.unique(keys, return_inverse=True)
        self.contexts, under = np.unique(contexts, return_inverse=True)
        total, kinds = np.zeros((2, len(self.contexts), len(self.langs)))
        np.add.at(total, (under, col), n)
        np.add.at(kinds, (under, col), 1)
        self.cost = np.full((len(self.grams), len(self.langs)), np.inf, np.float32)
        self.cost[row, col] = np.log2(total[under, col] + kinds[under, col]) - np.log2(n)
        seen = kinds > 0
        self.escape = np.zeros(seen.shape, np.float32)
        self.escape[seen] = np.log2(total[seen] + kinds[seen]) - np.log2(kinds[seen])

    def word_bits(self, words: list[bytes]) -> np.ndarray:
        """Code length of each word and the space behind it, by language."""
        lengths = np.array([len(w) for w in words], np.int64) + 2
        body = np.frombuffer(b" " + b"  ".join(words) + b" ", np.uint8).astype(np.uint64)
        at = np.arange(len(body)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        bits, open_ = np.zeros((len(body), len(self.langs)), np.float32), np.ones((len(body), len(self.langs)), bool)
        open_[at == 0] = False
        for k in range(self.order, -1, -1):
            rows = np.flatnonzero((at >= k) & open_.any(1))
            run = np.zeros(len(rows), np.uint64)
            for back in range(k, -1, -1):
                if back == 0:
                    context = run | np.uint64(k << 56)
                run = (run << np.uint64(8)) | body[rows - back]
            bits_in, esc = self._look(self.grams, self.cost, run | np.uint64((k + 1) << 56), np.inf), self._look(self.contexts, self.escape, context, 0)
            live, hit = open_[rows], np.isfinite(bits_in)
            bits[rows] += np.where(live, np.where(hit, bits_in, esc), 0)
            open_[rows] = live & ~hit
        bits[open_] += 8
        return np.add.reduceat(bits, np.cumsum(lengths) - lengths, axis=0)

    @staticmethod
    def _look(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, absent: float) -> np.ndarray:
        place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where((keys[place] == wanted)[:, None], values[place], np.float32(absent))


class Remembered:
    """Rows of numbers by word, computed once while there is room."""

    def __init__(self, compute, width: int):
        self.compute, self.width = compute, width
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.held, self.rows = 0, np.zeros((1 << 12, self.width), np.float32)

    def of(self, words: list[bytes]) -> np.ndarray:
        where = list(map(self.known.get, words))
        if None in where:
            new = list({w for w, i in zip(words, where) if i is None})
            if len(self.known) + len(new) > REMEMBERED or self.held > REMEMBERED_BYTES:
                self._forget()
                new = list(set(words))
            self._learn(new)
            where = list(map(self.known.__getitem__, words))
        return self.rows[where]

    def _learn(self, new: list[bytes]) -> None:
        ends = np.concatenate([[0], np.cumsum([len(w) + 2 for w in new], dtype=np.int64)])
        for a, b in in_blocks(ends, 1 << 17):
            n = len(self.known)
            while n + b - a > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.rows[n : n + b - a] = self.compute(new[a:b])
            self.known.update(zip(new[a:b], range(n, n + b - a)))
        self.held += int(ends[-1])


def memory_of(trees: Trees) -> Remembered:
    """What a worker remembers for these trees, across its tasks."""
    return remembered(("language", trees.name), lambda: Remembered(trees.word_bits, len(trees.langs)))


def _predict(trees: Trees, kept: list[str], column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = memory_of(trees)
        for batch in batches:
            found: list[dict] = []
            data, starts = text_bytes(batch.column("text"))
            body = data.tobytes().translate(LOWER)
            for a, b in in_blocks(starts, 1 << 21):
                cut = [body[starts[i] : starts[i + 1]].split() for i in range(a, b)]
                counts = np.array([len(c) for c in cut])
                bits = np.zeros((b - a, len(trees.langs)))
                if trees.langs and counts.any():
                    own = memory.of([w for c in cut for w in c])
                    full = np.flatnonzero(counts)
                    bits[full] = np.add.reduceat(own, (np.cumsum(counts) - counts)[full], axis=0, dtype=np.float64)
                for i in range(a, b):
                    if not trees.langs or not has_letter(body[starts[i] : starts[i + 1]].decode()):
                        found.append({"lang": UNKNOWN, "score": 0.0, "bits_per_byte": None})
                        continue
                    own = bits[i - a]
                    best = int(own.argmin())
                    score = float(1 / np.exp2(np.maximum(own[best] - own, -1000)).sum())
                    found.append({"lang": trees.langs[best], "score": score, "bits_per_byte": float(own[best]) / int(starts[i + 1] - starts[i])})
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in kept], pa.array(found, _FOUND)], [*kept, column])

    return run


def predicted(docs: DataFrame, trees: Trees, keep_text: bool = True, column: str = "predicted") -> DataFrame:
    """``docs`` with a last column (``predicted``): lang, score (probability of the language, all being as likely before), bits_per_byte.
    A column of ``docs`` with that name is left out; so is the text without ``keep_text``. No rows move."""
    own = docs.drop(column)
    kept = [c for c in own.columns if keep_text or c != "text"]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in own.select(kept).schema], f"`{column}` {FOUND}"])
    return own.mapInArrow(_predict(trees, kept, column), schema)


def learned(docs: DataFrame) -> Trees:
    """Trees of the labelled documents that are not held out."""
    return train(docs.filter(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, bits_per_byte of all documents."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return predicted(own, learned(docs), keep_text=False).select("doc_id", "held_out", F.col("predicted.lang").alias("lang_pred"), "predicted.score", "predicted.bits_per_byte")


def costliest(docs: DataFrame, trees: Trees) -> float | None:
    """The most bits a byte that a labelled document (of ``ENOUGH_BYTES`` or more) takes in its best language."""
    labelled = docs.filter(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang").filter("text is not null and lang is not null")
    costs = predicted(labelled.filter(F.octet_length("text") >= ENOUGH_BYTES), trees, keep_text=False)
    return costs.agg(F.max("predicted.bits_per_byte")).first()[0]


def with_language(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` in some language. Those that are ``und`` go, and those that every learned language would rather lengthen than shorten: more than
    ``RAW_BITS`` a byte, more than ``FAR`` times what the costliest labelled text takes, and ``SPARE_BITS`` besides, so that names, numbers and keys in a
    short text do not count against it."""
    trees, own = learned(docs), free_name(docs, "predicted")
    most = costliest(docs, trees)
    found = predicted(docs, trees, column=own)
    kept = F.col(own)["lang"] != UNKNOWN
    if most is not None:
        size = F.octet_length("text")
        kept &= F.col(own)["bits_per_byte"] * size <= max(RAW_BITS, FAR * most) * size + SPARE_BITS
    return found.filter(kept).drop(own)
