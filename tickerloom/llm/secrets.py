"""Secrets in whole texts: fixed forms, and random strings that a token vocabulary writes badly.

Text and code come out of a byte-pair vocabulary at several characters a token, random strings at fewer than two. A long run
without blanks is a finding if its characters per token under a tiktoken vocabulary stay below a limit, after known digests, UUIDs,
numbers and identifiers (words joined by case, hyphens, underscores or slashes, each of them at the limit or above by itself) are excluded, and
where no fixed form already covers it.

Spans are code points, end exclusive. Null or empty text has no spans. Every row gives a row, repeated ones too; an empty table
gives an empty result. A text is looked at whole; only the texts of one Arrow batch are in memory.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tickerloom.llm.shared import LOWER, in_blocks, text_bytes, texts_of
from tickerloom.llm.tokens import vocabulary

VOCABULARY = "byte_bpe_50k.tiktoken"
# fixed forms, letters of the names in either case (ASCII only)
ASSIGN = re.compile(
    r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd])|(?:[Pp][Aa][Ss][Ss][Ww][Dd])|(?:[Ss][Ee][Cc][Rr][Ee][Tt])|(?:[Tt][Oo][Kk][Ee][Nn])|(?:[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ["assign", "access", "hex", "random"]
NAMES = [b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key"]
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 12, 18, 16

RUN_CHARS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
LEAST_RUN = 20
RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % LEAST_RUN)
CHARS_PER_TOKEN = 2.0
# forms that are not secrets: digests by their length, UUIDs, numbers, and identifiers made of words
DIGEST = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})", re.I)
UUID = re.compile(r"[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}", re.I)
NUMBER = re.compile(r"[-+/_=0-9]+")
# a piece is all letters up to a change of case, a digit or a sign: each letter belongs to one piece only, so cutting takes linear time
PIECE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[A-Z]|[0-9]+")
LEAST_PIECE, MOST_DIGITS = 2, 4

SCHEMA = "doc_id long, spans array<struct<kind:string,start:long,end:long,chars_per_token:double>>"


@lru_cache(maxsize=2)
def token_counter(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    coder = tiktoken.Encoding("runs", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda text: len(coder.encode_ordinary(text))


def fixed_spans(text: str) -> list[tuple[str, int, int]]:
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    return found + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


def is_identifier(run: str, counter, limit: float) -> bool:
    """All pieces are words that the vocabulary writes well, as they stand or in lower case behind a space, or short numbers behind a word."""
    pieces = PIECE.findall(run)
    if not pieces or not pieces[0].isalpha():
        return False
    for p in pieces:
        if p.isdigit():
            if len(p) > MOST_DIGITS:
                return False
        elif len(p) < LEAST_PIECE or len(p) / min(counter(p), counter(" " + p.lower())) < limit:
            return False
    return True


def random_spans(text: str, covered: list[tuple[str, int, int]], counter, limit: float) -> list[tuple[str, int, int, float]]:
    found = []
    for m in RUN.finditer(text):
        run = m.group()
        if DIGEST.fullmatch(run) or UUID.fullmatch(run) or NUMBER.fullmatch(run):
            continue
        if any(a < m.end() and m.start() < b for _, a, b in covered):
            continue
        ratio = len(run) / max(1, counter(run))
        if ratio < limit and not is_identifier(run, counter, limit):
            found.append(("random", m.start(), m.end(), ratio))
    return found


def _long_runs(inside: np.ndarray, least: int) -> np.ndarray:
    """Positions at which a run of at least ``least`` true values begins or goes on for that long."""
    done, width = inside, 1
    while width < least:
        step = min(width, least - width)
        done = done[: len(done) - step] & done[step:]
        width += step
    return np.flatnonzero(done)


def _suspects(data: np.ndarray, starts: np.ndarray) -> set[int]:
    """Rows of a block that can hold a span. Cheap tests over all bytes; a row named in vain only costs time."""
    raw = data.tobytes()
    lower, at = raw.translate(LOWER), []
    for name, body in [*((n, lower) for n in NAMES), (b"AKIA", raw)]:
        i = body.find(name)
        while i >= 0:
            at.append(i)
            i = body.find(name, i + 1)
    is_hex, is_run = np.zeros(256, bool), np.zeros(256, bool)
    is_hex[list(b"0123456789abcdef")] = True
    is_run[list(RUN_CHARS)] = True
    places = np.concatenate([np.array(at, np.int64), _long_runs(is_hex[data], LEAST_HEX), _long_runs(is_run[data], LEAST_RUN)])
    return set((np.searchsorted(starts, places, "right") - 1).tolist())


def _scan(limit: float, vocabulary_file: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = token_counter(vocabulary(vocabulary_file))
        for batch in batches:
            texts, rows = batch.column(1), []
            data, starts = text_bytes(texts)
            for a, b in in_blocks(starts, 1 << 22):
                suspects = _suspects(data[starts[a] : starts[b]], starts[a:b] - starts[a])
                for i in range(a, b):
                    spans = []
                    if i - a in suspects:
                        text = texts[i].as_py()
                        fixed = fixed_spans(text)
                        spans = [(*s, None) for s in fixed] + random_spans(text, fixed, counter, limit)
                        spans.sort(key=lambda s: (s[1], KINDS.index(s[0])))
                    rows.append([dict(zip(("kind", "start", "end", "chars_per_token"), s)) for s in spans])
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("chars_per_token", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], ["doc_id", "spans"])

    return run


def secret_spans(docs: DataFrame, chars_per_token: float = CHARS_PER_TOKEN, vocabulary_file: str = VOCABULARY) -> DataFrame:
    """doc_id and its spans by start, then kind; chars_per_token is null for the fixed forms."""
    return texts_of(docs).select("doc_id", "text").mapInArrow(_scan(chars_per_token, vocabulary_file), SCHEMA)


def span_digest(spans: DataFrame) -> DataFrame:
    """Counts of the fixed forms, a digest of them, and all spans as text."""

    def digest(batches):
        for batch in batches:
            out = {n: [] for n in ("n_assign", "n_access", "n_hex", "base_sha256", "spans")}
            for row in batch.column(1).to_pylist():
                said = [(s["kind"], f"{s['kind']}:{s['start']}:{s['end']}") for s in row]
                for kind in KINDS[:3]:
                    out[f"n_{kind}"].append(sum(k == kind for k, _ in said))
                out["base_sha256"].append(hashlib.sha256(",".join(t for k, t in said if k != "random").encode()).hexdigest())
                out["spans"].append(",".join(t for _, t in said))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(v, pa.int64() if k.startswith("n_") else pa.string()) for k, v in out.items()]], ["doc_id", *out])

    return spans.mapInArrow(digest, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
