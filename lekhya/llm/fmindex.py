"""A compressed FM-index in numpy: Burrows-Wheeler transform, wavelet matrix over packed bits, batched backward search."""

from __future__ import annotations

import numpy as np

#: Ends every indexed text; smaller than any character's code, never part of a pattern.
SEPARATOR = 0


class Bits:
    """A bit vector packed into 64-bit words, with a rank count per word."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        padded = np.zeros(-(-(n + 1) // 64) * 64, dtype=np.uint8)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words))[:-1]]).astype(np.int32)
        self.ones = int(bits.sum())

    def rank1(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first i bits."""
        word, bit = i >> 6, (i & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))


class FMIndex:
    """Index over integer codes (SEPARATOR behind each text) that computes matching statistics.

    Kept are the Burrows-Wheeler transform as a wavelet matrix, the longest common prefixes of neighbouring suffixes
    with their range minima (16 bits each), and running counts of how often the owner changes along the suffixes. The
    suffix order itself is only used while the index is built.
    """

    def __init__(self, codes: np.ndarray, owners: np.ndarray, depth: int):
        """``owners`` names the record of each code; no text is longer than ``depth``."""
        self.n = len(codes)
        self.sigma = int(codes.max(initial=0)) + 1
        order, ranks = self._sorted(codes.astype(np.int64), depth)
        common = self._common(codes, order, ranks, depth)
        owner = owners[order]
        self.changes = np.cumsum(np.concatenate([[0], owner[1:] != owner[:-1]])).astype(np.int32) if self.n else np.zeros(0, np.int32)
        self.common = common
        self.minima = [common]
        while (width := 1 << len(self.minima)) <= self.n:
            last = self.minima[-1]
            self.minima.append(np.minimum(last[: len(last) - width // 2], last[width // 2 :]))
        transform = codes[order - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=self.sigma))]).astype(np.int64)
        self.levels: list[tuple[int, Bits, int]] = []
        for shift in range(max(1, (self.sigma - 1).bit_length()) - 1, -1, -1):
            bit = (transform >> shift) & 1
            packed = Bits(bit)
            self.levels.append((shift, packed, self.n - packed.ones))
            transform = np.concatenate([transform[bit == 0], transform[bit == 1]])

    def _sorted(self, codes: np.ndarray, depth: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
        """Suffixes by their first ``depth`` codes at least, by prefix doubling, and (width, ranks) of each round."""
        bits = max(1, (self.sigma - 1).bit_length())
        h = min(max(1, 60 // bits), depth)
        rank = np.zeros(self.n, dtype=np.int64)
        padded = np.concatenate([codes, np.zeros(h, dtype=np.int64)])
        for i in range(h):
            rank = (rank << bits) | padded[i : i + self.n]
        rounds = []
        while True:
            order = np.argsort(rank)
            ordered = rank[order]
            fresh = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])]) if self.n else ordered
            rank = np.empty(self.n, dtype=np.int64)
            rank[order] = fresh
            rounds.append((h, rank.astype(np.int32)))
            if h >= depth or (self.n and fresh[-1] == self.n - 1):
                return order, rounds
            ahead = np.zeros(self.n, dtype=np.int64)
            ahead[: self.n - h] = rank[h:] + 1
            rank = rank * (self.n + 1) + ahead
            h *= 2

    def _common(self, codes: np.ndarray, order: np.ndarray, rounds: list[tuple[int, np.ndarray]], depth: int) -> np.ndarray:
        """For each suffix how many codes it shares with the one before it in order, up to the end of its text, with a 0 behind the last."""
        out = np.zeros(self.n + 1, dtype=np.uint16)
        if self.n < 2:
            return out
        ends = np.flatnonzero(codes == SEPARATOR)
        left, right = order[:-1].copy(), order[1:].copy()
        most = np.minimum(*(ends[np.searchsorted(ends, x)] - x for x in (left, right)))
        shared = np.zeros(self.n - 1, dtype=np.int64)
        for width, rank in reversed(rounds):
            while True:  # the widest round may be met again, each narrower one fits once
                inside = (left < self.n) & (right < self.n)
                same = np.flatnonzero(inside & (rank[np.minimum(left, self.n - 1)] == rank[np.minimum(right, self.n - 1)]) & (shared < most))
                shared[same] += width
                left[same] += width
                right[same] += width
                if width < rounds[-1][0] or not len(same):
                    break
        live = np.flatnonzero((shared < most) & (left < self.n) & (right < self.n))
        while len(live):  # fewer codes than the narrowest round
            live = live[(codes[left[live]] == codes[right[live]]) & (shared[live] < most[live])]
            shared[live] += 1
            left[live] += 1
            right[live] += 1
            live = live[(left[live] < self.n) & (right[live] < self.n)]
        out[1:-1] = np.minimum(shared, most)
        return out

    def rank(self, codes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """For each pair, how often the code stands among the first ``at`` signs of the transform."""
        begin, end = np.zeros_like(at), at
        for shift, bits, zeros in self.levels:
            one = ((codes >> shift) & 1).astype(bool)
            b, e = bits.rank1(begin), bits.rank1(end)
            begin = np.where(one, zeros + b, begin - b)
            end = np.where(one, zeros + e, end - e)
        return end - begin

    def stepped(self, codes: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of backward search: the ranges of code + pattern for ranges of patterns."""
        ranks = self.rank(np.concatenate([codes, codes]), np.concatenate([low, high]))
        return self.first[codes] + ranks[: len(codes)], self.first[codes] + ranks[len(codes) :]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges [low, high) of the rows of ``patterns``, by backward search of all rows in step."""
        low, high = np.zeros(len(patterns), dtype=np.int64), np.full(len(patterns), self.n, dtype=np.int64)
        for step in range(patterns.shape[1] - 1, -1, -1):
            low, high = self.stepped(patterns[:, step].astype(np.int64), low, high)
        return low, high

    def widened(self, low: np.ndarray, high: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ranges of all suffixes that share ``length`` codes with those of [low, high)."""
        low, high = low.copy(), high.copy()
        for k in range(len(self.minima) - 1, -1, -1):
            table, width = self.minima[k], 1 << k
            at = low - width
            down = np.flatnonzero((at >= 0) & (table[np.clip(at + 1, 0, len(table) - 1)] >= length))
            low[down] -= width
            up = np.flatnonzero((high + width <= self.n) & (table[np.minimum(high, len(table) - 1)] >= length))
            high[up] += width
        return low, high

    def statistics(self, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, place, length, range): matching statistics of streamed texts, where they reach ``least``.

        A text is ``codes`` from its start on, and must be one that was indexed. The length at a place is that of the longest
        string beginning there that a text of another owner holds too; the range is its first suffix. Streamed from
        its end to its beginning, all texts in step: a code is put before the match by backward search; where no other
        owner holds that, the match gives up codes at its end until its range widens.
        """
        texts = len(starts)
        place, length = lengths.astype(np.int64).copy(), np.zeros(texts, dtype=np.int64)
        low, high = np.zeros(texts, dtype=np.int64), np.full(texts, self.n, dtype=np.int64)
        live = np.flatnonzero(place > 0)
        out = []
        while len(live):
            code = codes[starts[live] + place[live] - 1]
            l, h = self.stepped(code, low[live], high[live])
            met = (h - l > 1) & (self.changes[np.maximum(h - 1, 0)] > self.changes[np.minimum(l, self.n - 1)])
            on = live[met]
            low[on], high[on] = l[met], h[met]
            length[on] += 1
            place[on] -= 1
            long = on[length[on] >= least]
            if len(long):
                out.append(np.stack([long, place[long], length[long], low[long]]))
            off = live[~met]
            empty = off[length[off] == 0]
            place[empty] -= 1
            off = off[length[off] > 0]
            if len(off):
                length[off] = np.maximum(self.common[low[off]], self.common[high[off]])
                low[off], high[off] = self.widened(low[off], high[off], length[off])
            live = live[place[live] > 0]
        return tuple(np.concatenate(out, axis=1)) if out else tuple(np.zeros((4, 0), dtype=np.int64))

    def classes(self, least: int) -> np.ndarray:
        """For each suffix in order the number of its class: suffixes of one class share their first ``least`` codes."""
        return np.cumsum(self.common[: self.n] < least)
