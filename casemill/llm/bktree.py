"""BK-tree under the Levenshtein metric, with the distance computed on bit vectors."""

from __future__ import annotations

from collections.abc import Iterable


def levenshtein(a: str, b: str) -> int:
    """Insertions, deletions and replacements between two strings (a true metric), one bit vector step per letter of ``b``."""
    m = len(a)
    if not m:
        return len(b)
    peq: dict[str, int] = {}
    for i, ch in enumerate(a):
        peq[ch] = peq.get(ch, 0) | 1 << i
    return _steps(peq, m, b)


def _steps(peq: dict[str, int], m: int, b: str) -> int:
    mask, last = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = mask, 0, m
    for ch in b:
        eq = peq.get(ch, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & mask)
        mh = pv & xh
        if ph & last:
            score += 1
        elif mh & last:
            score -= 1
        ph = (ph << 1) | 1
        pv = ((mh << 1) | (~(xv | ph))) & mask
        mv = ph & xv & mask
    return score


class BKTree:
    """Every stored key within a distance of a query, by the triangle inequality."""

    def __init__(self, keys: Iterable[str] = ()) -> None:
        self.root: tuple[str, dict] | None = None
        for k in dict.fromkeys(keys):
            self.add(k)

    def add(self, key: str) -> None:
        if self.root is None:
            self.root = (key, {})
            return
        node = self.root
        while True:
            d = levenshtein(key, node[0])
            if d == 0:
                return
            if d not in node[1]:
                node[1][d] = (key, {})
                return
            node = node[1][d]

    def within(self, query: str, most: int) -> list[tuple[str, int]]:
        """(key, distance) of every key at most ``most`` away."""
        if self.root is None:
            return []
        out, stack, m = [], [self.root], len(query)
        peq: dict[str, int] = {}
        for i, ch in enumerate(query):
            peq[ch] = peq.get(ch, 0) | 1 << i
        while stack:
            key, children = stack.pop()
            d = _steps(peq, m, key) if m else len(key)
            if d <= most:
                out.append((key, d))
            for e, child in children.items():
                if d - most <= e <= d + most:
                    stack.append(child)
        return out
