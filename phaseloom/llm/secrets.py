"""Secret scan (operator 1).

Base patterns: assignments, access keys and hexadecimal runs.  The method adds
spans of kind ``random``: runs of key characters that a tiktoken vocabulary
needs many tokens for.  Prose has three or more characters a token, random
strings about one and a half, with digits or without.  Known digests and
identifiers (UUIDs, plain numbers, hexadecimal digests of the usual lengths) are not
tested, by their form and not by their alphabet; words and words joined by dashes,
underscores or slashes have a high ratio.  A run that is not random as a whole is
tested again without the words at its ends, and part by part, as paths and names
dilute the ratio.  Dots separate runs, but neighbours of DOTTED_LENGTH characters or
more, which versions and abbreviations haven't, are also tested as one.  Offsets are
code points.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phaseloom.llm.bpe import codec
from phaseloom.llm.common import released, text_or_empty, utf8_of

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
ASSIGN_VALUE, ACCESS_LENGTH, HEX_LENGTH = 6, 20, 24
#: A run of at least so many key characters is tested, and is random under so many characters a token.
RUN_LENGTH, CHARS_PER_TOKEN, DOTTED_LENGTH = 20, 2.0, 6
DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)
KNOWN = re.compile(rb"[0-9]+|[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}|(.)\2*")
WORDS = re.compile(rb"[A-Za-z]+([-_/=][A-Za-z]+)*")
PART = re.compile(rb"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}(?![^-_/=])|[^-_/=]+")
DIGEST = re.compile(rb"[0-9a-f]+|[0-9A-F]+")

_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True
_KEY = np.zeros(256, bool)
_KEY[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-.")] = True


def _long_runs(inside: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of True within one text, as byte bounds."""
    edge = np.zeros(len(inside) + 1, np.int8)
    edge[:-1] = inside
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    firsts = offsets[:-1][offsets[:-1] < len(inside)]
    start[firsts] |= inside[firsts]
    a = np.flatnonzero(start)
    stop = inside.copy()
    stop[:-1] &= ~inside[1:]
    lasts = offsets[1:][offsets[1:] > 0] - 1
    stop[lasts] |= inside[lasts]
    b = np.flatnonzero(stop) + 1
    keep = b - a >= least
    return a[keep], b[keep]


def _tokens(run: bytes, vocabulary) -> int:
    ((_, ids),) = vocabulary.encode([run.decode("ascii")])
    return len(ids)


def _known(run: bytes) -> bool:
    return bool(KNOWN.fullmatch(run) or (len(run) in DIGEST_LENGTHS and DIGEST.fullmatch(run)))


def _looks_random(run: bytes, vocabulary) -> bool:
    if _known(run):
        return False
    if not re.search(rb"[A-Za-z]", run):
        return False
    if WORDS.fullmatch(run):  # dashes between short words cost a token each
        parts = PART.findall(run)
        return sum(map(len, parts)) < CHARS_PER_TOKEN * sum(_tokens(p, vocabulary) for p in parts)
    return len(run) < CHARS_PER_TOKEN * _tokens(run, vocabulary)


def _is_word(part: bytes, vocabulary) -> bool:
    """Of a part between separators: a known one or letters of a high ratio."""
    if _known(part):
        return True
    n = _tokens(part, vocabulary) if part.isalpha() else 0
    return n == 1 or (n > 0 and len(part) >= CHARS_PER_TOKEN * n)


def _random_bounds(run: bytes, vocabulary) -> list[tuple[int, int]]:
    """The whole run if it is random, else what is left without the words at its ends
    if that is, else the random ones of its parts."""
    if _looks_random(run, vocabulary):
        return [(0, len(run))]
    parts = [m.span() for m in PART.finditer(run)]
    if len(parts) < 2:
        return []
    i, j = 0, len(parts)
    while i < j and _is_word(run[slice(*parts[i])], vocabulary):
        i += 1
    while i < j and _is_word(run[slice(*parts[j - 1])], vocabulary):
        j -= 1
    core = [(parts[i][0], parts[j - 1][1])] if i < j else []
    for bounds in (core, parts):
        found = [(a, b) for a, b in bounds if b - a >= RUN_LENGTH and _looks_random(run[a:b], vocabulary)]
        if found:
            return found
    return []


def _dotted_bounds(run: bytes, vocabulary) -> list[tuple[int, int]]:
    """Random bounds within a run that may have dots."""
    found, chain = [], []

    def close() -> None:
        own = [run[a:b] for a, b in chain]
        size = sum(map(len, own))
        if len(own) > 1 and size >= RUN_LENGTH and not all(map(_known, own)) and size < CHARS_PER_TOKEN * sum(_tokens(p, vocabulary) for p in own):
            found.append((chain[0][0], chain[-1][1]))
        chain.clear()

    at = 0
    for part in [*run.split(b"."), b""]:
        span = (at, at + len(part))
        at += len(part) + 1
        inside = _random_bounds(part, vocabulary) if len(part) >= RUN_LENGTH else []
        if inside or len(part) < DOTTED_LENGTH:
            close()
            found += [(span[0] + a, span[0] + b) for a, b in inside]
        else:
            chain.append(span)
    return sorted(found)


def scan(texts: pa.Array, vocabulary) -> list[list[tuple[str, int, int]]]:
    """Spans of each text, by start and then kind; offsets are code points."""
    data, off = utf8_of(texts)
    n = len(off) - 1
    found: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]
    if len(data):
        blob = data.tobytes()
        text_of = lambda at: np.searchsorted(off, at, "right") - 1
        signs = np.flatnonzero((data == 0x3A) | (data == 0x3D))
        for i in np.unique(text_of(signs)).tolist():
            for m in ASSIGN.finditer(blob[off[i] : off[i + 1]]):
                if m.end(2) - m.start(2) >= ASSIGN_VALUE:
                    found[i].append((m.start(), 0, m.end()))
        at, hits = blob.find(b"AKIA"), []
        while at >= 0:
            hits.append(at)
            at = blob.find(b"AKIA", at + 1)
        for i in np.unique(text_of(np.array(hits, np.int64))).tolist():
            for m in ACCESS.finditer(blob[off[i] : off[i + 1]]):
                if m.end() - m.start() >= ACCESS_LENGTH:
                    found[i].append((m.start(), 1, m.end()))
        for a, b in zip(*_long_runs(_HEX[data], off, HEX_LENGTH), strict=True):
            i = int(text_of(a))
            found[i].append((int(a - off[i]), 2, int(b - off[i])))
        for a, b in zip(*_long_runs(_KEY[data], off, RUN_LENGTH), strict=True):
            i = int(text_of(a))
            for p, q in _dotted_bounds(blob[a:b], vocabulary):
                found[i].append((int(a + p - off[i]), 3, int(a + q - off[i])))
    out = []
    for i, spans in enumerate(found):
        if spans:
            own = data[off[i] : off[i + 1]]
            place = np.concatenate(([0], np.cumsum((own & 0xC0) != 0x80)))
            spans = [(int(place[a]), k, int(place[b])) for a, k, b in sorted(spans)]
        out.append([(KINDS[k], a, b) for a, k, b in spans])
    return out


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def default_vocabulary() -> str:
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def find_secrets(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base_sha256 and spans per row.

    Null text counts as empty: no spans, and base_sha256 is that of the empty
    string.  Rows are independent, so repeated rows and null doc_id pass through.
    Empty table: no rows.  Other columns of docs are not read.
    """
    path = path or default_vocabulary()

    @released
    def run(batches):
        vocabulary = codec(path, public_tokenizers.PATTERN)
        for b in batches:
            all_spans = scan(b.column("text"), vocabulary)
            count = lambda kind: pa.array([sum(k == kind for k, _, _ in s) for s in all_spans], pa.int64())  # noqa: B023, E731
            base = [hashlib.sha256(_joined([x for x in s if x[0] != "random"]).encode()).hexdigest() for s in all_spans]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *map(count, KINDS), pa.array(base, pa.string()), pa.array([_joined(s) for s in all_spans], pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_or_empty(docs).alias("text")).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string")


def redacted(text: Column, path: str | None = None, mark: str = "[secret]") -> Column:
    """The text with every span replaced by ``mark`` (overlapping spans by one);
    null stays null."""
    path = path or default_vocabulary()

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        out = s.astype(object).copy()
        known = s.fillna("")
        spans_of = scan(pa.array(known.tolist(), pa.large_string()), codec(path, public_tokenizers.PATTERN))
        for i, spans in enumerate(spans_of):
            if not spans:
                continue
            text, parts, at = known.iloc[i], [], 0
            for _, a, b in sorted(spans, key=lambda x: (x[1], -x[2])):
                if b <= at:
                    continue
                if a >= at:
                    parts += [text[at:a], mark]
                at = b
            out.iloc[i] = "".join([*parts, text[at:]])
        return out

    return run(text)
