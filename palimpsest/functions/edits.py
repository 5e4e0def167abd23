"""Edit distance and partial ratio in bit vectors, many texts or windows at a time.

Both are dynamic programs over a text's characters whose columns are bits of 64-bit words (Myers; Hyyrö): a step is a few
operations on an array with one entry for each text or window, whatever they are.  Patterns of over 64 characters take several words.
"""

from __future__ import annotations

import numpy as np

ONE, ALL = np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF)
#: Windows of a text that are aligned at a time.
WINDOWS = 1 << 16


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


class Pattern:
    """The places of each character of a pattern as bits."""

    def __init__(self, text: str):
        self.length = len(text)
        self.words = -(-self.length // 64) or 1
        self.alphabet, at = np.unique(codes(text), return_inverse=True)
        self.bits = np.zeros((len(self.alphabet) + 1, self.words), np.uint64)  # the last row: no character of the pattern
        for i, c in enumerate(at):
            self.bits[c, i >> 6] |= ONE << np.uint64(i & 63)

    def numbered(self, chars: np.ndarray) -> np.ndarray:
        """Characters as rows of bits."""
        if not len(self.alphabet):
            return np.zeros(chars.shape, np.int64)
        at = np.minimum(np.searchsorted(self.alphabet, chars), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == chars, at, len(self.alphabet))


def _sum(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a + b over words, lowest first, carries handed on."""
    out, carry = np.empty_like(a), np.zeros(len(a), np.uint64)
    for w in range(a.shape[1]):
        s = a[:, w] + b[:, w]
        over = s < a[:, w]
        out[:, w] = s + carry
        carry = (over | (out[:, w] < s)).astype(np.uint64)
    return out


def _up(a: np.ndarray, low: int) -> np.ndarray:
    """a shifted up by one bit over words; low comes in."""
    out = a << ONE
    out[:, 1:] |= a[:, :-1] >> np.uint64(63)
    out[:, 0] |= np.uint64(low)
    return out


def common(pattern: Pattern, windows: np.ndarray, lengths: np.ndarray | None = None) -> np.ndarray:
    """Length of the longest common subsequence with each row of windows (rows of bits; of its first `lengths`)."""
    state = np.full((len(windows), pattern.words), ALL)
    for j in range(windows.shape[1]):
        here = state if lengths is None else state[lengths > j]
        rows = windows[:, j] if lengths is None else windows[lengths > j, j]
        u = here & pattern.bits[rows]
        new = _sum(here, u) | (here & ~u)
        if lengths is None:
            state = new
        else:
            state[lengths > j] = new
    used = np.full(pattern.words, ALL)
    if pattern.length & 63 or not pattern.length:
        used[-1] = (ONE << np.uint64(pattern.length & 63)) - ONE
    return np.bitwise_count(~state & used).sum(1)


def _best_window(pattern: Pattern, text: np.ndarray) -> float:
    """The best ratio of the pattern with a window of a text that is at least as long: of its length, or cut off at an end."""
    m, n = pattern.length, len(text)
    rows = pattern.numbered(text)
    best = 0.0
    whole = np.lib.stride_tricks.sliding_window_view(rows, m)
    for at in range(0, len(whole), WINDOWS):
        best = max(best, common(pattern, whole[at : at + WINDOWS]).max() / m)
    few = max(1, (WINDOWS * 64) // m)
    for at in range(1, m if best < 1 else 1, few):
        lengths = np.arange(at, min(m, at + few))
        head = np.broadcast_to(rows[: m - 1], (len(lengths), m - 1))
        tail = np.stack([np.concatenate([rows[n - k :], np.zeros(m - 1 - k, rows.dtype)]) for k in lengths])
        for ends in (head, tail):
            best = max(best, (2 * common(pattern, ends, lengths) / (m + lengths)).max())
    return float(best)


class Partial:
    """Partial ratio of one query with texts, from 0 to 100."""

    def __init__(self, query: str):
        self.query, self.chars, self.pattern = query, codes(query), Pattern(query)

    def __call__(self, text: str) -> float:
        if not text or not self.query:
            return 100.0 if text == self.query else 0.0
        if self.query in text or text in self.query:
            return 100.0
        chars = codes(text)
        best = 0.0
        if len(chars) >= self.pattern.length:
            best = _best_window(self.pattern, chars)
        if len(chars) <= self.pattern.length:
            best = max(best, _best_window(Pattern(text), self.chars))
        return 100 * best


    def many(self, texts: list[str]) -> np.ndarray:
        """The ratios with many texts; those longer than the query are aligned in common passes."""
        m, out = self.pattern.length, np.zeros(len(texts))
        longer = [i for i, t in enumerate(texts) if len(t) > m > 0 and self.query not in t]
        rest = set(range(len(texts))).difference(longer)
        for i in rest:
            out[i] = self(texts[i])
        at = 0
        while at < len(longer):
            some, size = [], 0
            while at < len(longer) and (not some or size + len(texts[longer[at]]) + 2 * m <= WINDOWS):
                size += len(texts[longer[at]]) + 2 * m
                some.append(longer[at])
                at += 1
            if len(some) == 1:
                out[some[0]] = self(texts[some[0]])
                continue
            sizes = np.array([len(texts[i]) for i in some])
            flat = self.pattern.numbered(codes("".join(texts[i] for i in some)))
            first = np.cumsum(sizes) - sizes
            owner = np.repeat(np.arange(len(some)), sizes - m + 1)
            begin = first[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(sizes - m + 1) - (sizes - m + 1), sizes - m + 1)
            best = np.zeros(len(some))
            np.maximum.at(best, owner, common(self.pattern, flat[begin[:, None] + np.arange(m)]) / m)
            if m > 1:
                owner, cut = np.repeat(np.arange(len(some)), m - 1), np.tile(np.arange(1, m), len(some))
                for begin in (first[owner], first[owner] + sizes[owner] - cut):
                    places = np.minimum(begin[:, None] + np.arange(m - 1), len(flat) - 1)
                    np.maximum.at(best, owner, 2 * common(self.pattern, flat[places], cut) / (m + cut))
            out[some] = 100 * best
        return out


def distances(text: str, others: list[str]) -> np.ndarray:
    """Edit distances of a text to others: one bit-parallel pass over all of them."""
    lengths = np.array([len(o) for o in others], np.int64)
    if not text:
        return lengths
    pattern = Pattern(text)
    longest = int(lengths.max(initial=0))
    chars = np.full((len(others), longest), 0xFFFFFFFF, np.uint32)
    for i, o in enumerate(others):
        chars[i, : len(o)] = codes(o)
    rows = pattern.numbered(chars)
    plus, minus = np.full((len(others), pattern.words), ALL), np.zeros((len(others), pattern.words), np.uint64)
    top, bit = pattern.words - 1, np.uint64((pattern.length - 1) & 63)
    score = np.full(len(others), pattern.length, np.int64)
    out = np.where(lengths == 0, pattern.length, 0)
    for j in range(longest):
        eq = pattern.bits[rows[:, j]]
        d0 = (_sum(eq & plus, plus) ^ plus) | eq | minus
        up, down = minus | ~(d0 | plus), plus & d0
        score += ((up[:, top] >> bit) & ONE).astype(np.int64) - ((down[:, top] >> bit) & ONE).astype(np.int64)
        up, down = _up(up, 1), _up(down, 0)
        plus, minus = down | ~(d0 | up), up & d0
        out = np.where(lengths == j + 1, score, out)
    return out
