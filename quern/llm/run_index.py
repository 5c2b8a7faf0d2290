"""A run-length index of short strings, and matching statistics streamed through it.

Of the Burrows-Wheeler transform of the strings only its runs are kept: where each begins,
its symbol, how often the symbol came before, and the places in the text of the suffixes at
the run's two ends. A query is read from its end to its start. While the symbol at hand is
that of the run the search stands in, the search steps back by the run's counts; else it
moves to the end of the nearest run of that symbol above or the start of the nearest below,
the one whose sampled suffix shares more with the suffix it leaves. The sample gives its
place in the text. The lengths of the matches at these places are then read from start to
end, each at least the one before less one. These are the matching statistics: for every
start in the query the longest match that the text has, and a place of it.

Each string ends in a sentinel that is less than any byte; equal suffixes order as their
strings do. No match runs over a sentinel.
"""

from __future__ import annotations

import numpy as np


def _dense(keys: np.ndarray) -> tuple[np.ndarray, int]:
    """Rank of each key among the distinct ones, from 1, and their number."""
    order = np.argsort(keys, kind="stable")
    new = np.empty(len(keys), np.int32)
    sorted_keys = keys[order]
    step = np.empty(len(keys), bool)
    step[:1] = True
    np.not_equal(sorted_keys[1:], sorted_keys[:-1], out=step[1:])
    ranks = np.cumsum(step, dtype=np.int32)
    new[order] = ranks
    return new, int(ranks[-1]) if len(ranks) else 0


def _joined(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols (bytes from 1 on, a 0 after each string), begins and sizes of the strings."""
    sizes = np.array([len(s) for s in strings], np.int64)
    begin = np.cumsum(sizes + 1) - (sizes + 1)
    text = np.zeros(int((sizes + 1).sum()), np.int16)
    if len(text):
        inside = np.ones(len(text), bool)
        inside[begin + sizes] = False
        text[inside] = np.frombuffer(b"".join(strings), np.uint8).astype(np.int16) + 1
    return text, begin, sizes


class RunIndex:
    def __init__(self, strings: list[bytes]):
        self.text, begin, sizes = _joined(strings)
        n = len(self.text)
        self.size = n
        # Ranks by the first 4 symbols, then by twice as many, kept for comparing suffixes later; what starts past the sentinel counts as 0.
        stop = np.repeat(begin + sizes, sizes + 1)
        place = np.arange(n)
        key = np.zeros(n, np.int64)
        for k in range(4):
            at = np.minimum(place + k, stop)
            key = key * 257 + self.text[at]
        self.depths, self.ranks = [4], []
        rank, kinds = _dense(key)
        self.ranks.append(rank)
        longest = int(sizes.max(initial=0))
        while self.depths[-1] <= longest and kinds < n:
            ahead = place + self.depths[-1]
            after = np.where(ahead <= stop, rank[np.minimum(ahead, n - 1)], 0)
            rank, kinds = _dense(rank.astype(np.int64) * (n + 2) + after)
            self.depths.append(2 * self.depths[-1])
            self.ranks.append(rank)
        order = np.argsort(rank, kind="stable").astype(np.int32)
        self.where = np.empty(n, np.int32)  # row of each suffix
        self.where[order] = np.arange(n, dtype=np.int32)
        first = np.zeros(n, bool)
        first[begin] = True
        before = np.where(first, 0, self.text[place - 1])[order] if n else self.text
        head = np.flatnonzero(np.concatenate([[True], before[1:] != before[:-1]])) if n else np.zeros(0, np.int64)
        size = np.diff(np.append(head, n))
        symbol = before[head].astype(np.int64)
        self.head, self.symbol = head, symbol
        self.at_head, self.at_end = order[head].astype(np.int64), order[head + size - 1].astype(np.int64)
        by_symbol = np.argsort(symbol, kind="stable")
        seen = np.cumsum(size[by_symbol]) - size[by_symbol]
        same = np.searchsorted(symbol[by_symbol], symbol[by_symbol], "left")
        rank_before = np.empty(len(head), np.int64)
        rank_before[by_symbol] = seen - seen[same] if len(head) else seen
        smaller = np.concatenate([[0], np.cumsum(np.bincount(self.text, minlength=258))])
        self.target = smaller[symbol] + rank_before
        # Runs of each symbol in order, to find the nearest one.
        self.run_keys = symbol[by_symbol] * (len(head) + 1) + by_symbol
        self.by_symbol = by_symbol
        self.stop = stop

    @property
    def runs(self) -> int:
        return len(self.head)

    def _shared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols the suffixes at ``a`` and ``b`` share, to within the least rank depth kept."""
        out, a, b = np.zeros(len(a), np.int64), a.copy(), b.copy()
        for depth, rank in zip(reversed(self.depths), reversed(self.ranks)):
            same = rank[a] == rank[b]
            inside = same & (a + depth <= self.stop[a]) & (b + depth <= self.stop[b])
            out += np.where(same, depth, 0)
            a, b = np.where(inside, a + depth, a), np.where(inside, b + depth, b)
        for _ in range(self.depths[0]):
            same = (self.text[a] == self.text[b]) & (self.text[a] > 0)
            out += same
            a, b = np.where(same, a + 1, a), np.where(same, b + 1, b)
        return out

    def _places(self, text: np.ndarray, end: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """For each symbol of the queries a place of the longest match that starts there; -1 where there is none."""
        out = np.full(len(text), -1, np.int64)
        row = np.zeros(len(sizes), np.int64)
        place = np.full(len(sizes), self.at_head[0], np.int64)
        alive = np.arange(len(sizes))
        last, many = int(sizes.max(initial=0)), len(self.head)
        for step in range(1, last + 1):
            alive = alive[sizes[alive] >= step]
            c = text[end[alive] - step].astype(np.int64)
            r = row[alive]
            run = np.searchsorted(self.head, r, "right") - 1
            go = self.symbol[run] == c
            if not go.all():
                off = np.flatnonzero(~go)
                k = np.searchsorted(self.run_keys, c[off] * (many + 1) + run[off])
                up, down = k - 1, k
                has_up = (up >= 0) & (self.symbol[self.by_symbol[np.maximum(up, 0)]] == c[off])
                has_down = (down < many) & (self.symbol[self.by_symbol[np.minimum(down, many - 1)]] == c[off])
                a, b = self.by_symbol[np.maximum(up, 0)], self.by_symbol[np.minimum(down, many - 1)]
                here = place[alive[off]]
                take_up = has_up & (~has_down | (self._shared(here, self.at_end[a]) >= self._shared(here, self.at_head[b])))
                found = has_up | has_down
                new = np.where(take_up, a, b)
                at_end = np.append(self.head[1:], self.size)[new] - 1
                off, new = off[found], new[found]
                run[off] = new
                r[off] = np.where(take_up[found], at_end[found], self.head[new])
                place[alive[off]] = np.where(take_up[found], self.at_end[new], self.at_head[new])
                go[off] = True
            # The symbol is in no run: the match is empty, and starts anew.
            row[alive] = np.where(go, self.target[run] + r - self.head[run], 0)
            place[alive] = np.where(go, place[alive] - 1, self.at_head[0])
            out[end[alive] - step] = np.where(go, place[alive], -1)
        return out

    def matching_statistics(self, queries: list[bytes]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Of each query, for every start, the length of the longest match in the strings and a place of it in the text (-1: none)."""
        text, begin, sizes = _joined(queries)
        lengths = np.zeros(len(text), np.int64)
        places = np.full(len(text), -1, np.int64)
        if self.size and len(text):
            places = self._places(text, begin + sizes, sizes)
            now = np.zeros(len(sizes), np.int64)
            alive = np.arange(len(sizes))
            for step in range(int(sizes.max())):
                alive = alive[sizes[alive] > step]
                at = begin[alive] + step
                there = places[at]
                length = np.where(there >= 0, np.maximum(now[alive] - 1, 0), 0)
                open_ = np.flatnonzero(there >= 0)
                while len(open_):  # sentinels end a match on either side
                    t = self.text[there[open_] + length[open_]]
                    open_ = open_[(t > 0) & (t == text[at[open_] + length[open_]])]
                    length[open_] += 1
                now[alive] = length
                lengths[at] = length
        return [lengths[b : b + s] for b, s in zip(begin, sizes)], [places[b : b + s] for b, s in zip(begin, sizes)]
