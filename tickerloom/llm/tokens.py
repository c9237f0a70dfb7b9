"""Token ids of whole texts, with a vocabulary file of the tokenizers library.

Both vocabularies split a text before they merge bytes, and never merge across a single ASCII space or a line end. So a text is
cut there, each distinct piece is encoded once by the library and remembered (a bounded memory, emptied when full), and the ids
of a text are the ids of its pieces in order. Texts with other or repeated white space are encoded whole: the result is always what the
library gives for the whole text.
"""

from __future__ import annotations

import gc
import os
from itertools import chain

import numpy as np

from tickerloom.llm.shared import kept

END_ID = 1
REMEMBERED = 900_000  # pieces a Python worker holds at most
# white space that no piece may hold: all but the single space and the line end
ODD_SPACE = [chr(i) for i in range(0x3001) if chr(i).isspace() and chr(i) not in " \n"]


def vocabulary(name: str) -> str:
    """Path of a vocabulary file installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str) -> "Encoder":
    """A worker's encoder, which serves many tasks."""
    return kept(("tokens", path), lambda: Encoder(path))


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # with a byte-level vocabulary a space belongs to the word behind it and a line end stands alone; else white space is dropped
        self.spaced = bool(self.whole([" a"])[0] != self.whole(["a"])[0])
        self.marks = {s: self.whole([s])[0] for s in ".,"}
        # ids that begin a word with its space, or end one: they tell the words of a joined text apart
        edge = (lambda t: t.startswith("Ġ")) if self.spaced else (lambda t: t.endswith("</w>"))
        self.edges = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.edges[[i for t, i in self.tokenizer.get_vocab().items() if edge(t)]] = True
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4  # bytes of an id
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, bytes] = {}  # ids of each piece as bytes, by its key

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each followed by the end id, as one array, and the number of ids of each text."""
        parts = self.packed(texts)
        return np.frombuffer(b"".join(parts), f"<u{self.width}").astype(np.uint32), np.array([len(p) // self.width for p in parts], np.int64)

    def packed(self, texts: list[str]) -> list[bytes]:
        """Ids of each text and the end id, as little-endian numbers of ``width`` bytes."""
        collects = gc.isenabled()
        gc.disable()  # millions of short-lived strings and no cycles
        try:
            return self._packed(texts)
        finally:
            if collects:
                gc.enable()

    def _packed(self, texts: list[str]) -> list[bytes]:
        cut, known = [self._keys(t) for t in texts], self.known
        parts = [list(map(known.get, keys)) for keys in cut]
        out, lacking = [b""] * len(texts), []
        for i, part in enumerate(parts):
            try:
                out[i] = b"".join(part)
            except TypeError:  # some piece is not known yet
                lacking.append(i)
        if lacking:
            new = {p for i in lacking for p, k in zip(cut[i], parts[i]) if k is None}
            if len(known) + len(new) > REMEMBERED:
                self._forget()
            self._learn(new)
            known = self.known
            for i in lacking:
                out[i] = b"".join([known[p] if k is None else k for p, k in zip(cut[i], parts[i])])
        odd = [i for i, keys in enumerate(cut) if not keys]
        for i, own in zip(odd, self.whole([texts[i] for i in odd]) if odd else ()):
            out[i] = np.array(own, f"<u{self.width}").tobytes()
        end = np.array([END_ID], f"<u{self.width}").tobytes()
        return [ids + end for ids in out]

    def _keys(self, text: str) -> list[str]:
        """Keys of the pieces, or nothing if white space is not single spaces and line ends between words (or the text is empty).

        Where a space belongs to the word behind it, a key stands for a space and the key, one behind a carriage return for the rest of it.
        """
        text = text.lower() if text.isascii() and not self.spaced else text
        broken = "\n" in text
        if not text or text[0] in " \n" or text[-1] in " \n" or "  " in text or broken and (" \n" in text or "\n " in text or "\n\n" in text):
            return []
        for space in ODD_SPACE[:9] if text.isascii() else ODD_SPACE:
            if space in text:
                return []
        if not self.spaced:
            return text.split()
        keys = (text.replace("\n", " \n \r") if broken else text).split(" ")
        keys[0] = "\r" + keys[0]
        return keys

    def _piece(self, key: str) -> str:
        return key if not self.spaced or key == "\n" else key[1:] if key[0] == "\r" else " " + key

    def _learn(self, new: set[str]) -> None:
        """A piece that is a word and one stop or comma is the ids of both; the word alone is seen more often."""
        stops = [p for p in new if p[-1] in ".," and len(p) > 1 and p[-2].isalpha()]
        plain = list({p[:-1] for p in stops}.union(new.difference(stops)).difference(self.known))
        joined = [p for p in plain if p.isalpha()]
        apart = list(set(plain).difference(joined)) if len(joined) < len(plain) else []
        for a in range(0, len(joined), 50_000):
            self._add_joined(joined[a : a + 50_000])
        for a in range(0, len(apart), 50_000):
            self._add_each(apart[a : a + 50_000])
        marks = {s: np.array(ids, f"<u{self.width}").tobytes() for s, ids in self.marks.items()}
        self.known.update([(p, self.known[p[:-1]] + marks[p[-1]]) for p in stops])

    def _add_joined(self, words: list[str]) -> None:
        """Words of letters alone, many in one text; each is one unit of the vocabulary's own split."""
        lead, between = (" ", " ") if self.spaced else ("", " ")
        parts = self.whole([lead + between.join(words[a : a + 64]) for a in range(0, len(words), 64)])
        ids = np.fromiter(chain.from_iterable(parts), np.uint32)
        edges = np.flatnonzero(self.edges[ids])
        if len(edges) != len(words):
            self._add_each(words)
        else:
            self._add(words, ids, np.diff(edges, append=len(ids)) if self.spaced else np.diff(edges, prepend=-1))

    def _add_each(self, keys: list[str]) -> None:
        ids = self.whole([self._piece(k) for k in keys])
        self._add(keys, np.fromiter(chain.from_iterable(ids), np.uint32), np.array([len(i) for i in ids], np.int64))

    def _add(self, keys: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        data, ends = ids.astype(f"<u{self.width}").tobytes(), (self.width * np.cumsum(lengths)).tolist()
        self.known.update(zip(keys, [data[a:b] for a, b in zip([0, *ends], ends)]))
