"""Pre-tokens of many texts at once, and a memo from pre-token to ids.

Splitting and hashing run over whole arrays of code points; only pre-tokens
that a worker has not met before reach a tokenizer.  ``Splitter`` reproduces
``public_tokenizers.PATTERN`` (mode "spaced") and the splitter of word_bpe_49k
(mode "words").  Code points above the basic plane go through ``regex``
instead, since Unicode versions differ there between libraries.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import regex

from phaseloom.llm.mph import mix

_U = np.uint64
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
WORDS_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SAFE_CUT = re.compile(r"(?<=\S) (?=\S)")
CHUNK_CHARS = 500_000
#: Entries of a worker's memo; at this many it starts anew, which costs time and changes no result.
MEMO_ENTRIES = 1 << 19


@functools.cache
def classes() -> np.ndarray:
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)]))
    out = np.zeros(0x10000, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, every):
            a, b = ord(m[0][0]), ord(m[0][-1])
            cps = np.fromiter(map(ord, m[0]), np.int64) if b - a + 1 != len(m[0]) else np.arange(a, b + 1)
            out[cps] = kind
    return out


def runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the concatenated ranges [start, start + length)."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def pieces(texts: Sequence[str], most: int = CHUNK_CHARS) -> Iterator[tuple[list[str], list[int]]]:
    """Groups of (parts, index of the text of each part).  A text over ``most``
    is cut before a lone space, where a pre-token begins in either mode."""
    parts: list[str] = []
    of: list[int] = []
    held = 0
    for i, text in enumerate(texts):
        at = 0
        while at < len(text) or (not text and at == 0):
            end = len(text)
            if end - at > most and (m := SAFE_CUT.search(text, at + most)):
                end = m.start()
            if parts and held + end - at > most:
                yield parts, of
                parts, of, held = [], [], 0
            parts.append(text[at:end])
            of.append(i)
            held += end - at
            at = max(end, 1)
    if parts:
        yield parts, of


class Splitter:
    def __init__(self, mode: str, pattern: str):
        self.mode, self.slow = mode, regex.compile(pattern)

    def bounds(self, parts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
        """(UTF-8 of all parts, byte starts, byte ends, pre-tokens per part)."""
        joined = "".join(parts)
        blob = joined.encode("utf-8", "surrogatepass")
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        ends = np.cumsum(sizes)
        cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
        if len(cp) and int(cp.max()) > 0xFFFF:
            starts, stops = self._by_regex(parts, ends - sizes)
        else:
            starts, stops = self._by_class(cp, ends - sizes, ends)
        per = np.bincount(np.searchsorted(ends, starts, "right"), minlength=len(parts)) if len(starts) else np.zeros(len(parts), np.int64)
        if len(blob) != len(cp):
            wide = 1 + (cp >= 0x80).astype(np.int64) + (cp >= 0x800) + (cp >= 0x10000)
            place = np.concatenate(([0], np.cumsum(wide)))
            starts, stops = place[starts], place[stops]
        return blob, starts, stops, per

    def _by_regex(self, parts: list[str], base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        spans = [(b + m.start(), b + m.end()) for p, b in zip(parts, base.tolist(), strict=True) for m in self.slow.finditer(p)]
        both = np.array(spans, np.int64).reshape(-1, 2)
        return both[:, 0], both[:, 1]

    def _by_class(self, cp: np.ndarray, base: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(cp)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        kind = classes()[cp]
        first = np.zeros(n + 1, bool)  # where a text begins
        first[base] = True
        first[n] = True
        begin = first[:n].copy()
        begin[1:] |= kind[1:] != kind[:-1]
        if self.mode == "words":
            begin[1:] |= (kind[1:] == NUMBER) & (kind[:-1] == NUMBER)
        else:  # the last white space before a word stands apart, and joins it if a blank
            run_start = np.flatnonzero(begin & (kind != SPACE) & ~first[:n])
            run_start = run_start[run_start > 0]
            after = run_start[kind[run_start - 1] == SPACE]
            begin[after - 1] = True
            begin[after[cp[after - 1] == 0x20]] = False
        quote = np.flatnonzero((cp[:-1] == 0x27) & (kind[1:] == LETTER) & ~first[1:n] & begin[:-1]) if n > 1 else np.zeros(0, np.int64)
        if len(quote):
            a = cp[quote + 1]
            has2 = quote + 2 < n
            b = np.where(has2 & ~first[np.minimum(quote + 2, n)], cp[np.minimum(quote + 2, n - 1)], 0)
            two = np.isin(a, [ord(c) for c in "stmd"])
            three = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
            begin[quote[two | three] + 1] = False
            for which, step in ((two, 2), (three, 3)):
                to = quote[which] + step
                begin[to[to < n]] = True
        starts = np.flatnonzero(begin)
        stops = np.append(starts[1:], n)
        if self.mode == "words":
            keep = kind[starts] != SPACE
            starts, stops = starts[keep], stops[keep]
        return starts, stops


def hash_spans(blob: bytes, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, never 0."""
    data = np.frombuffer(blob + bytes(8), np.uint8)
    words = np.ndarray((max(len(data) - 7, 0),), "<u8", data, 0, (1,))
    size = stops - starts
    h = mix(size.astype(_U), 3)
    live, at = np.arange(len(starts)), starts
    left = size
    step = 0
    with np.errstate(over="ignore"):
        while len(live):
            w = words[at].astype(_U)
            short = left < 8
            w[short] &= (_U(1) << (left[short].astype(_U) * _U(8))) - _U(1)
            h[live] = mix(h[live] ^ w, 5)
            step += 1
            more = left > 8
            live, at, left = live[more], at[more] + 8, left[more] - 8
    h[h == 0] = _U(1)
    return h


def padded(blob: bytes) -> np.ndarray:
    """The bytes with room for a whole word behind the last."""
    return np.frombuffer(blob + bytes(8), np.uint8)


def equal_spans(x: np.ndarray, x_at: np.ndarray, y: np.ndarray, y_at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether size bytes from x_at of x are those from y_at of y (both padded)."""
    xs, ys = (np.ndarray((max(len(z) - 7, 0),), "<u8", z, 0, (1,)) for z in (x, y))
    out = np.ones(len(size), bool)
    live, a, b, left = np.arange(len(size)), x_at, y_at, size
    while len(live):
        off = xs[a] ^ ys[b]
        short = left < 8
        off[short] &= (_U(1) << (left[short].astype(_U) * _U(8))) - _U(1)
        out[live[off != 0]] = False
        more = (left > 8) & (off == 0)
        live, a, b, left = live[more], a[more] + 8, b[more] + 8, left[more] - 8
    return out


class Memo:
    """Open addressing from a 64-bit hash to a run of ids, in arrays.  The bytes that
    brought an entry are kept, as other bytes may have its hash."""

    def __init__(self, entries: int = MEMO_ENTRIES):
        self.entries = entries
        self.bits = max(10, int(entries * 2 - 1).bit_length())
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(1 << self.bits, _U)
        self.where = np.zeros(1 << self.bits, np.int32)
        self.start = np.zeros(1024, np.int64)
        self.count = np.zeros(1024, np.int32)
        self.pool = np.zeros(4096, np.uint32)
        self.text = np.zeros(4096, np.uint8)
        self.text_at = np.zeros(1024, np.int64)
        self.text_size = np.zeros(1024, np.int64)
        self.used = self.pooled = self.written = 0

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (h >> _U(64 - self.bits)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -1, np.int64)
        todo, slot = np.arange(len(h)), self._slot(h)
        while len(todo):
            k = self.keys[slot]
            hit = k == h[todo]
            out[todo[hit]] = self.where[slot[hit]]
            go = ~hit & (k != 0)
            todo, slot = todo[go], (slot[go] + 1) & ((1 << self.bits) - 1)
        return out

    def holds(self, at: np.ndarray, data: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the entries are of just these bytes of data."""
        out = self.text_size[at] == size
        out[out] = equal_spans(self.text, self.text_at[at[out]], data, starts[out], size[out])
        return out

    def add(self, h: np.ndarray, ids: np.ndarray, counts: np.ndarray, data: np.ndarray, starts: np.ndarray, size: np.ndarray) -> None:
        """h: distinct and not held yet; ids: the runs one after another; and the bytes."""
        n, written = len(h), int(size.sum())
        while self.used + n > len(self.start):
            self.start, self.count, self.text_at, self.text_size = (np.resize(x, 2 * len(x)) for x in (self.start, self.count, self.text_at, self.text_size))
        while self.pooled + len(ids) > len(self.pool):
            self.pool = np.resize(self.pool, 2 * len(self.pool))
        while self.written + written + 8 > len(self.text):
            self.text = np.resize(self.text, 2 * len(self.text))
        own = np.arange(self.used, self.used + n)
        self.text_at[own] = self.written + np.cumsum(size) - size
        self.text_size[own] = size
        self.text[self.written : self.written + written] = data[runs(starts, size)]
        self.written += written
        self.start[own] = self.pooled + np.cumsum(counts) - counts
        self.count[own] = counts
        self.pool[self.pooled : self.pooled + len(ids)] = ids
        self.used, self.pooled = self.used + n, self.pooled + len(ids)
        todo, slot = np.arange(n), self._slot(h)
        while len(todo):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = h[todo[free]]
            won = free & (self.keys[slot] == h[todo])
            self.where[slot[won]] = own[todo[won]]
            todo, slot = todo[~won], (slot[~won] + 1) & ((1 << self.bits) - 1)


Encode = Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]


class PretokenEncoder:
    """Ids of whole texts.  ``encode``: ids and counts for distinct pre-tokens.
    ``front``: an optional first tier, from (hashes, bytes, starts, sizes) to an id or -1.

    Both tiers go by hash and then compare bytes.  A pre-token whose hash belongs to
    other bytes is encoded by itself."""

    def __init__(self, mode: str, pattern: str, encode: Encode, front: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray] | None = None):
        self.split, self.encode, self.front, self.memo = Splitter(mode, pattern), encode, front, Memo()

    def batch(self, texts: Sequence[str]) -> Iterator[tuple[int, np.ndarray]]:
        """(index of the text, ids), in order."""
        held: list[np.ndarray] = []
        last = 0
        for parts, of in pieces(texts):
            ids, per = self._ids(parts)
            ends = np.cumsum(per)
            for k, i in enumerate(of):
                if i != last:
                    yield last, held[0] if len(held) == 1 else np.concatenate(held)
                    held, last = [], i
                held.append(ids[ends[k] - per[k] : ends[k]])
        if held:
            yield last, held[0] if len(held) == 1 else np.concatenate(held)

    def _ids(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        blob, starts, stops, per = self.split.bounds(parts)
        h, data, size = hash_spans(blob, starts, stops), padded(blob), stops - starts
        whole = self.front(h, data, starts, size) if self.front else np.full(len(h), -1, np.int64)
        rest = np.flatnonzero(whole < 0)
        hr = h[rest]
        at = self.memo.find(hr)
        new = np.flatnonzero(at < 0)
        if len(new):
            fresh, one = np.unique(hr[new], return_index=True)
            if self.memo.used + len(fresh) > self.memo.entries:
                self.memo.clear()
                fresh, one = np.unique(hr, return_index=True)
                new = np.arange(len(hr))
            if len(fresh) > self.memo.entries:
                self.memo = Memo(len(fresh))
            src = rest[new[one]]
            ids, counts = self.encode([blob[a:b] for a, b in zip(starts[src].tolist(), stops[src].tolist(), strict=True)])
            self.memo.add(fresh, ids, counts, data, starts[src], size[src])
            at[new] = self.memo.find(hr[new])
        held = self.memo.holds(at, data, starts[rest], size[rest])
        alone = rest[~held]  # of another text's hash
        rest, at = rest[held], at[held]
        count = np.ones(len(h), np.int64)
        count[rest] = self.memo.count[at]
        if len(alone):
            own, count[alone] = self.encode([blob[a:b] for a, b in zip(starts[alone].tolist(), stops[alone].tolist(), strict=True)])
        end = np.cumsum(count)
        out = np.empty(int(end[-1]) if len(end) else 0, np.uint32)
        direct = whole >= 0
        out[(end - count)[direct]] = whole[direct]
        out[runs((end - count)[rest], count[rest])] = self.memo.pool[runs(self.memo.start[at], count[rest])]
        if len(alone):
            out[runs((end - count)[alone], count[alone])] = own
        upto = np.concatenate(([0], end))
        cut = np.concatenate(([0], np.cumsum(per)))
        return out, upto[cut[1:]] - upto[cut[:-1]]
