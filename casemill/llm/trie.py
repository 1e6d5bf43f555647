"""Tries of names and the automaton that walks them: every stored key within two edits of a probe.

The automaton is the bit-parallel form of the edit-distance automaton in which an insertion, a deletion, a replacement and a
swap of two neighbours each cost one (optimal string alignment). Its state is a tuple of bit sets; a branch of the trie is left
as soon as no bit is set.

``Trie`` is the plain form. ``near_pairs`` joins many strings with one another: ``shards`` gives each string the shards in which
it stands, so that any two strings within two edits meet in at least one, and ``walk`` runs the automata of all strings of many
shards through the forest of their tries at once, level by level.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np

_MOST = 58  # letters of a stored string that the forest holds; longer ones are compared again as wholes
_LETTERS = 64  # letters that the forest tells apart; where a batch has more, pairs are compared again


class Trie:
    """A set of strings as nested dicts; the key of an end is ''."""

    def __init__(self, keys: Iterable[str] = ()) -> None:
        self.root: dict = {}
        for k in keys:
            self.add(k)

    def add(self, key: str) -> None:
        node = self.root
        for ch in key:
            node = node.setdefault(ch, {})
        node[""] = key

    def near(self, probe: str) -> Iterator[tuple[str, int]]:
        """(key, edits) of every stored key within two edits of ``probe``.

        r0, r1, r2: which prefixes of the probe are reached with at most 0, 1, 2 edits; t1, t2: those one letter into a swap.
        """
        n = len(probe)
        masks: dict[str, int] = {}
        for i, ch in enumerate(probe):
            masks[ch] = masks.get(ch, 0) | 1 << i
        full, goal, get = (1 << (n + 1)) - 1, 1 << n, masks.get
        stack = [(self.root, 1, 3 & full, 7 & full, 0, 0)]
        while stack:
            node, r0, r1, r2, t1, t2 = stack.pop()
            for ch, child in node.items():
                if ch == "":
                    if r2 & goal:
                        yield child, 0 if r0 & goal else 1 if r1 & goal else 2
                    continue
                m = get(ch, 0)
                s0 = ((r0 & m) << 1) & full
                s1 = (((r1 & m) << 1) | r0 | (r0 << 1) | (s0 << 1) | ((t1 & m) << 2)) & full
                s2 = (((r2 & m) << 1) | r1 | (r1 << 1) | (s1 << 1) | ((t2 & m) << 2)) & full
                if s2:
                    stack.append((child, s0, s1, s2, r0 & (m >> 1), r1 & (m >> 1)))


HEAD = 4  # letters at the front of which a shard of the forward tries takes one away
_SHORT = 8  # strings up to this length are compared in shards of their own


def _tail(n: int) -> int:
    """Letters at the end that a string of ``n`` letters shares with the partners that its forward walk may miss."""
    return max(4, n - (n - 10) % 4 - 5) if n > 9 else 4


def shards(s: str) -> Iterator[tuple[str, str, int, int]]:
    """(shard, string to store there, letters h1, letters h2) of one string.

    Of at most two edits, at most one starts in the first n - 1 - t letters (t: ``_tail``), or else the last t letters are free of
    edits. In the first case the heads of both strings are equal, and the walk is free of edits there; or one edit starts in the
    heads, which then have a common form after one letter is taken away (also if a swap reaches out of the head), and only walks
    with an edit in the head go on. Both allow one edit in the first n - 1 - t letters. In the second case the strings turned
    around begin with the same t letters. The longer of two strings finds the other, so a string also stands where one that is up
    to two letters longer looks for it. Short strings have no room for that: they share a form after up to two letters are taken
    away.

    h1 > 0: no edit in so many letters; h1 < 0: an edit in the first -h1 letters. h2: at most one edit in so many letters; h2 < 0:
    the string is only found there, and looks for nothing.
    """
    n = len(s)
    if n <= _SHORT:
        one = {s[:i] + s[i + 1 :] for i in range(n)}
        for x in {s, *one, *(x[:i] + x[i + 1 :] for x in one for i in range(len(x)))}:
            yield f"s{x}", s, 0, 0
    if n > _SHORT - 2:
        looks = n > _SHORT
        t = _tail(n) if looks else 0
        h2 = n - 1 - t if looks else -1
        yield f"e{s[:HEAD]}", s, HEAD, h2
        for x in sorted({s[:i] + s[i + 1 : HEAD] for i in range(HEAD)}):
            yield f"f{x}", s, -HEAD, h2
        back = s[::-1]
        if looks:
            yield f"b{t:03d}{back[:t]}", back, t, t
        for longer in {_tail(n + 1), _tail(n + 2)} - {t}:
            if n + 2 > _SHORT and len(s) >= longer:
                yield f"b{longer:03d}{back[:longer]}", back, longer, -1


def walk(shard: np.ndarray, strings: list[str], h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, edits) of the strings i that look and the strings j of the same shard within two edits of them, i != j.

    ``shard`` holds adjacent equal numbers. A pair may come out from either side. Edits are exact for strings up to the length
    that the forest holds.
    """
    n = len(strings)
    none = (np.zeros(0, np.int64),) * 3
    if n < 2:
        return none
    order = sorted(range(n), key=lambda i: (shard[i], strings[i][:_MOST]))
    at = np.array(order)
    width = min(60, max(1, max(map(len, strings))))
    chars = np.array([strings[i][:60] for i in order], dtype=f"U{width}").view(np.uint32).reshape(n, width)
    length = (chars != 0).sum(axis=1)
    seen = np.zeros(int(chars.max()) + 1, bool)
    seen[chars] = True
    seen[0] = False
    size = int(seen.sum())
    of = np.cumsum(seen)
    of[~seen] = 0
    codes = of[chars]
    if size > _LETTERS:
        codes = np.where(codes > _LETTERS, codes % _LETTERS + 1, codes)
    letters = int(codes.max()) + 1
    word = np.uint32 if width < 30 else np.uint64  # one bit for each prefix of a probe, and two to spare
    masks = np.zeros((n, letters), word)
    rows = np.arange(n)
    for k in range(int(length.max())):
        has = length > k
        masks[rows[has], codes[has, k]] |= word(1 << k)
    stored = np.minimum(length, _MOST)
    lead = np.asarray(shard)[at]
    h1, h2 = np.asarray(h1)[at], np.asarray(h2)[at]
    new = np.ones(n, bool)
    new[1:] = lead[1:] != lead[:-1]
    node = np.cumsum(new) - 1  # of each string, the node of the level
    looks = np.flatnonzero(h2 >= 0)
    bits = length.astype(word)
    one, two = word(1), word(2)
    full = (two << bits) - one
    goal, cut = one << bits, word(31 << (_MOST - 2) if width >= _MOST else 0)
    low = lambda h: ~((one << np.maximum(h, 0).astype(word)) - one)
    free1, free2 = low(h1), low(h2)  # prefixes that may be reached with one and with two edits
    free0 = np.where(h1 < 0, (one << np.maximum(-h1, 0).astype(word)) - one, ~(one - one))  # and with none
    p, v = looks, node[looks]
    r0 = np.ones(len(p), word)
    r1 = np.where(h1[p] <= 0, word(3), one) & full[p]
    r2 = (r1 | (word(7) & free2[p])) & full[p]
    t1 = t2 = np.zeros(len(p), word)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for level in range(min(_MOST, width)):
        # children: strings longer than the level, grouped by (node, letter); sorted strings keep the children of a node together
        live = np.flatnonzero(stored > level)
        if not len(live) or not len(p):
            break
        parent, letter = node[live], codes[live, level]
        first = np.ones(len(live), bool)
        first[1:] = (parent[1:] != parent[:-1]) | (letter[1:] != letter[:-1])
        child = np.cumsum(first) - 1
        kids_parent, kids_letter = parent[first], letter[first]
        start = np.searchsorted(kids_parent, np.arange(int(node.max()) + 2))
        count = (start[1:] - start[:-1])[v]
        rep = np.repeat(np.arange(len(p)), count)
        if not len(rep):
            break
        kid = start[v][rep] + np.arange(len(rep)) - np.repeat(np.cumsum(count) - count, count)
        pp = p[rep]
        m = masks[pp, kids_letter[kid]]
        f = full[pp]
        a0, a1, a2 = r0[rep], r1[rep], r2[rep]
        s0 = ((a0 & m) << one) & f & free0[pp]
        s1 = s0 | ((((a1 & m) << one) | a0 | (a0 << one) | (s0 << one) | ((t1[rep] & m) << two)) & f & free1[pp])
        s2 = s1 | ((((a2 & m) << one) | a1 | (a1 << one) | (s1 << one) | ((t2[rep] & m) << two)) & f & free2[pp])
        keep = np.flatnonzero(s2)
        half = m[keep] >> one
        t1, t2 = a0[keep] & half, a1[keep] & half
        p, v, r0, r1, r2 = pp[keep], kid[keep], s0[keep], s1[keep], s2[keep]
        fresh = np.full(n, -1)
        fresh[live] = child
        node = fresh
        # strings that end at this level
        ends = np.flatnonzero(stored == level + 1)
        if len(ends):
            wide = level + 1 == _MOST
            hit = np.flatnonzero(r2 & (cut if wide else goal[p]))
            e_node = node[ends]
            lo, hi = np.searchsorted(e_node, v[hit], "left"), np.searchsorted(e_node, v[hit], "right")
            k = hi - lo
            rep = np.repeat(np.arange(len(hit)), k)
            j = ends[lo[rep] + np.arange(len(rep)) - np.repeat(np.cumsum(k) - k, k)]
            i = p[hit][rep]
            g, q0, q1 = cut if wide else goal[i], r0[hit][rep], r1[hit][rep]
            d = np.where(q0 & g, 0, np.where(q1 & g, 1, 2))
            other = i != j
            out.append((at[i[other]], at[j[other]], d[other]))
    if not out:
        return none
    i, j, d = (np.concatenate(x) for x in zip(*out))
    doubtful = (np.maximum(length[np.argsort(at)][i], length[np.argsort(at)][j]) >= _MOST) | (size > _LETTERS)
    if doubtful.any():
        real = np.array([edits(strings[a], strings[b]) if x else e for a, b, x, e in zip(i, j, doubtful, d)])
        i, j, d = i[real <= 2], j[real <= 2], real[real <= 2]
    return i, j, d


def differing(a: str, b: str) -> tuple[str, str]:
    """Two strings without what they share at both ends, which no least alignment touches."""
    i, most = 0, min(len(a), len(b))
    while i < most and a[i] == b[i]:
        i += 1
    k, most = 0, most - i
    while k < most and a[-1 - k] == b[-1 - k]:
        k += 1
    return a[i : len(a) - k], b[i : len(b) - k]


@lru_cache(100_000)
def edits(a: str, b: str, most: int = 2) -> int:
    """The edit distance with swaps of neighbours, or ``most + 1`` if it is larger."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    a, b = differing(a, b)
    prev2: list[int] = []
    prev = list(range(len(b) + 1))
    for i, ca in enumerate(a, 1):
        row = [i]
        for j, cb in enumerate(b, 1):
            d = min(prev[j] + 1, row[j - 1] + 1, prev[j - 1] + (ca != cb))
            if i > 1 and j > 1 and ca == b[j - 2] and a[i - 2] == cb:
                d = min(d, prev2[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        prev2, prev = prev, row
    return min(prev[-1], most + 1)
