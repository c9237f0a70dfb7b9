"""Ids of a SentencePiece BPE vocabulary for whole texts, and the texts back from ids.

A text gets a mark for each space and one in front (the identity normaliser with a dummy prefix). No piece holds a mark behind another sign, and
none a line end, so nothing merges across those places: the text is cut there and each distinct word is encoded once per worker. New words are
encoded together in rounds over flat arrays of symbols: every word finds its best pair (best score, then leftmost) as a segmented minimum, all
words merge at once, the arrays are compacted and words without a pair leave, until none has one. In a round a word merges all places of its best
pair, from the left, up to the first one that makes a pair at least as good, which the library would take before the rest; so the ids are the
library's. Signs outside the vocabulary become the ids of their bytes.

Memory: a worker remembers at most ``REMEMBERED`` words (emptied when full), and rows are worked on in blocks of ``BLOCK`` bytes; a longer text is a
block of its own. Null and empty texts have no ids and decode to the empty text; repeated rows give repeated rows; an empty table stays empty; other
columns are not read, a null doc_id is handed on.
"""

from __future__ import annotations

import gc
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.llm.shared import in_blocks, kept, ranges, text_bytes, texts_of
from tickerloom.llm.tokens import vocabulary

VOCABULARY = "piece_bpe_32k.model"
MARK = "▁"  # the sign the library writes for a space
UNKNOWN = " ⁇ "  # what it writes for the id of unknown signs
REMEMBERED = 600_000
LONGEST_REMEMBERED = 64
AT_ONCE = 20_000  # new words encoded together
BLOCK = 4 << 20
NO_SCORE = -np.inf
ENCODED, DECODED = "doc_id long, ids array<int>", "doc_id long, ids array<int>, decoded string"


def encode(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id and ids (array of int) of every text."""
    path = model or vocabulary(VOCABULARY)

    def run(batches):
        pieces = kept(("pieces", path), lambda: Pieces(path))
        for batch in batches:
            starts = text_bytes(batch.column("text"))[1]
            for a, b in in_blocks(starts, BLOCK):
                ids, lengths = pieces.encode(batch.column("text").slice(a, b - a).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), _lists(ids, lengths)], ["doc_id", "ids"])

    return texts_of(docs).mapInArrow(run, ENCODED)


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """The rows with the text of their ids as ``decoded``; null ids give the empty text, an id outside the vocabulary stops the task."""
    path = model or vocabulary(VOCABULARY)

    def run(batches):
        pieces = kept(("pieces", path), lambda: Pieces(path))
        for batch in batches:
            column = batch.column("ids").fill_null([]) if batch.column("ids").null_count else batch.column("ids")
            lengths = np.diff(column.offsets.to_numpy())
            for a, b in in_blocks(4 * np.concatenate([[0], np.cumsum(lengths)]), BLOCK):
                ids = column.slice(a, b - a)
                texts = pieces.decode(ids.flatten().to_numpy(zero_copy_only=False), lengths[a:b])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), ids, pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, DECODED)


def digests(decoded: DataFrame) -> DataFrame:
    """Number and digests of ids and decoded text."""
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def _lists(ids: np.ndarray, lengths: np.ndarray) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32)))


class Pieces:
    """A vocabulary as tables: symbols of signs, pairs of symbols with what they merge to and its score, bytes of every id."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        self.n = n = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(n)]
        control = [model.is_control(i) for i in range(n)]
        self.of_byte = np.zeros(256, np.int32)
        self.is_byte = np.zeros(n, bool)
        plain: dict[str, int] = {}
        for i, name in enumerate(names):
            if model.is_byte(i):
                self.is_byte[i] = True
                self.of_byte[int(name[3:5], 16)] = i
            elif not (control[i] or model.is_unknown(i) or model.is_unused(i)):
                plain[name] = i
        # the cut in front of a mark and around a line end needs these two
        self.cuts = not any(a != MARK and b == MARK for p in plain for a, b in zip(p, p[1:])) and not any("\n" in p for p in plain)
        # symbols: the ids, and behind them every code point that is no piece of its own
        self.symbol = np.arange(n, n + 0x110000, dtype=np.int32)
        for name, i in plain.items():
            if len(name) == 1:
                self.symbol[ord(name)] = i
        pairs = []
        for name, i in plain.items():
            for k in range(1, len(name)):
                left, right = name[:k], name[k:]
                a = plain.get(left, n + ord(left) if len(left) == 1 else None)
                b = plain.get(right, n + ord(right) if len(right) == 1 else None)
                if a is not None and b is not None:
                    pairs.append((self._key(a, b), i, model.get_score(i)))
        self.pairs = Places(np.array([p[0] for p in pairs], np.int64))
        self.pair_ids = np.array([p[1] for p in pairs] + [0], np.int32)  # the last entry is what place -1 reads
        self.pair_scores = np.array([p[2] for p in pairs] + [NO_SCORE], np.float64)
        # signs that stand side by side in some piece; between others nothing merges
        self.beside = Places(np.array(sorted({self._key(ord(a), ord(b)) for p in plain for a, b in zip(p, p[1:])}), np.int64))
        if self.is_byte.sum() != 256:
            raise ValueError(f"{path} has no pieces for single bytes")
        self.surfaces = [
            bytes([int(m[3:5], 16)]) if self.is_byte[i] else b"" if control[i] else (UNKNOWN if model.is_unknown(i) else m.replace(MARK, " ")).encode()
            for i, m in enumerate(names)
        ]
        self.begins_marked = [m.startswith(MARK) for m in names]
        self.known: dict[str, bytes] = {}

    @staticmethod
    def _key(a, b):
        return a * (1 << 22) + b

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts as one array, and the number of ids of each."""
        collects = gc.isenabled()
        gc.disable()  # millions of short-lived strings and no cycles
        try:
            return self._encoded(texts)
        finally:
            if collects:
                gc.enable()

    def _encoded(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        cut, known = [self._words(t) if t else [] for t in texts], self.known
        parts = [list(map(known.get, words)) for words in cut]
        whole, lacking = [b""] * len(texts), []
        for i, part in enumerate(parts):
            try:
                whole[i] = b"".join(part)
            except TypeError:  # some word is not known yet
                lacking.append(i)
        new = list({w for i in lacking for w, k in zip(cut[i], parts[i]) if k is None})
        if len(known) + len(new) > REMEMBERED:
            known.clear()
        for a in range(0, len(new), AT_ONCE):
            words = new[a : a + AT_ONCE]
            ids, lengths = self.of_words([self._unit(w) for w in words])
            data, ends = ids.astype("<i4").tobytes(), (4 * np.cumsum(lengths)).tolist()
            known.update(zip(words, [data[i:j] for i, j in zip([0, *ends], ends)]))
        for i in lacking:
            whole[i] = b"".join([known[w] if k is None else k for w, k in zip(cut[i], parts[i])])
        for word in new:
            if len(word) > LONGEST_REMEMBERED:
                del known[word]
        return np.frombuffer(b"".join(whole), "<i4"), np.array([len(w) // 4 for w in whole], np.int64)

    def _words(self, text: str) -> list[str]:
        """Keys of the words: a plain key stands for a mark and the key, one behind a carriage return for the rest of it, one with a mark for itself."""
        if not self.cuts:
            return [MARK + text.replace(" ", MARK)]
        if "  " in text or text[0] == " " or MARK in text or "\r" in text:
            words = re.findall(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n", MARK + text.replace(" ", MARK))
            return [w if w[0] == MARK or w == "\n" else "\r" + w for w in words]
        if "\n" in text:
            text = text.replace("\n", " \n \r")
        return text.split(" ")

    @staticmethod
    def _unit(key: str) -> str:
        return key[1:] if key[:1] == "\r" else key if key[:1] == MARK or key == "\n" else MARK + key

    def of_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that are encoded apart from each other, as one array, and the number of ids of each."""
        signs = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        first = np.concatenate([[0], np.cumsum([len(w) for w in words], dtype=np.int64)])
        begins = np.zeros(len(signs) + 1, bool)
        begins[first] = True
        begins = begins[:-1]
        begins[1:] |= self.beside(self._key(signs[:-1], signs[1:])) < 0
        final = self._merged(self.symbol[signs], begins)
        place = np.flatnonzero(final >= 0)
        ids = final[place]
        n_bytes = np.ones(len(ids), np.int64)
        unknown = np.flatnonzero(ids >= self.n)
        if len(unknown):
            coded = [self.of_byte[list(chr(c).encode())] for c in (ids[unknown] - self.n).tolist()]
            n_bytes[unknown] = [len(c) for c in coded]
            ids = np.repeat(ids, n_bytes)
            ids[ids >= self.n] = np.concatenate(coded)
        return ids, np.diff(np.concatenate([[0], np.cumsum(n_bytes)])[np.searchsorted(place, first)])

    def _pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = self.pairs(self._key(left.astype(np.int64), right))
        return self.pair_scores[at], self.pair_ids[at]

    def _merged(self, symbols: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Symbols after all merges, each where its first sign stood; -1 where a sign went into the symbol before it."""
        final = np.full(len(symbols), -1, np.int32)
        place, sym, run = np.arange(len(symbols)), symbols, np.cumsum(begins) - 1
        score, into = np.full(len(sym), NO_SCORE), np.zeros(len(sym), np.int32)
        inner = np.flatnonzero(~begins) - 1
        score[inner], into[inner] = self._pair(sym[inner], sym[inner + 1])
        while len(sym):
            heads = np.flatnonzero(np.diff(run, prepend=-1))
            sizes = np.diff(heads, append=len(run))
            best = np.maximum.reduceat(score, heads)
            open_, best = np.repeat(best > NO_SCORE, sizes), np.repeat(best, sizes)
            if not open_.all():
                final[place[~open_]] = sym[~open_]
                place, sym, run, score, into, best = (x[open_] for x in (place, sym, run, score, into, best))
                if not len(sym):
                    break
            at = self._chosen(np.flatnonzero(score == best), sym, run, into, best)
            sym[at] = into[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            at = (np.cumsum(keep) - 1)[at]
            place, sym, run, score, into = (x[keep] for x in (place, sym, run, score, into))
            changed = np.concatenate([at, at[at > 0] - 1])
            last = changed + 1 >= len(sym)
            last[~last] = run[changed[~last]] != run[changed[~last] + 1]
            score[changed[last]] = NO_SCORE
            changed = changed[~last]
            score[changed], into[changed] = self._pair(sym[changed], sym[changed + 1])
        return final

    def _chosen(self, at: np.ndarray, sym: np.ndarray, run: np.ndarray, into: np.ndarray, best: np.ndarray) -> np.ndarray:
        """Of the best pairs ``at`` those that merge in this round."""
        of = run[at]
        leads = np.diff(of, prepend=-1) != 0
        if leads.all():
            return at
        group = np.cumsum(leads) - 1
        mixed = np.zeros(group[-1] + 1, bool)  # words with another pair of equal score: their leftmost alone
        mixed[group[into[at] != into[at[leads]][group]]] = True
        # of neighbours that share a symbol every second one
        apart = np.diff(at, prepend=-9) != 1
        apart |= leads
        since = np.arange(len(at)) - np.maximum.accumulate(np.where(apart, np.arange(len(at)), 0))
        chosen = (since % 2 == 0) & (leads | ~mixed[group])
        at, leads, group = at[chosen], leads[chosen], group[chosen]
        new = into[at]
        # would a new pair come before the places that follow?
        joined = np.diff(at, prepend=-9) == 2
        left = np.where(joined & ~leads, new, sym[np.maximum(at - 1, 0)])
        before = (at > 0) & (run[np.maximum(at - 1, 0)] == run[at])
        behind = np.minimum(at + 2, len(sym) - 1)
        after = (at + 2 < len(sym)) & (run[behind] == run[at])
        stop = (before & (self._pair(left, new)[0] >= best[at])) | (after & (self._pair(new, sym[behind])[0] >= best[at]))
        earlier = np.cumsum(stop) - stop
        return at[earlier == earlier[np.flatnonzero(leads)][group]]

    def decode(self, ids: np.ndarray, lengths: np.ndarray) -> list[str]:
        """Texts of runs of ids."""
        if len(ids) and (ids.min() < 0 or ids.max() >= self.n):
            raise ValueError("an id is not in the vocabulary")
        ends, surface, texts = np.cumsum(lengths), self.surfaces.__getitem__, []
        for a, b in zip((ends - lengths).tolist(), ends.tolist()):
            own = ids[a:b].tolist()
            data = b"".join(map(surface, own))
            try:
                text = data.decode()
            except UnicodeDecodeError:
                text = self._broken(own)
            # the mark in front is that of the first piece that writes something
            head = next((i for i in own if self.surfaces[i]), None)
            texts.append(text[1:] if head is not None and self.begins_marked[head] else text)
        return texts

    def _broken(self, ids: list[int]) -> str:
        """Text of ids whose bytes are not all signs: each byte that is none becomes the replacement sign."""
        parts, run = [], b""
        for i in ids:
            if self.is_byte[i]:
                run += self.surfaces[i]
            else:
                parts += [_signs(run), self.surfaces[i].decode()]
                run = b""
        return "".join(parts) + _signs(run)


def _signs(data: bytes) -> str:
    out, i = [], 0
    while i < len(data):
        for k in (1, 2, 3, 4):
            try:
                out.append(data[i : i + k].decode())
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("\ufffd")
            k = 1
        i += k
    return "".join(out)


class Places:
    """Where each of a set of keys stands: an open table of keys, looked up many at a time."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(4 * len(keys)).bit_length())
        self.keys, self.at = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int64)
        slots = self._slots(keys)
        left = np.arange(len(keys))
        while len(left):
            free = left[self.keys[slots[left]] < 0]
            self.keys[slots[free]], self.at[slots[free]] = keys[free], free  # of several keys for a slot one stays
            left = left[self.keys[slots[left]] != keys[left]]
            slots[left] = (slots[left] + 1) & ((1 << self.bits) - 1)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 where it is none of the set."""
        slots = self._slots(keys)
        held = self.keys[slots]
        found = np.where(held == keys, self.at[slots], -1)
        left = np.flatnonzero((held != keys) & (held >= 0))
        while len(left):
            slots[left] = (slots[left] + 1) & ((1 << self.bits) - 1)
            held = self.keys[slots[left]]
            same = held == keys[left]
            found[left[same]] = self.at[slots[left[same]]]
            left = left[~same & (held >= 0)]
        return found
