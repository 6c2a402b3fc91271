"""Merge of sorted, front-coded runs by a loser tree that knows common prefixes."""

from __future__ import annotations


def merge(runs: list[list[list[int]]], shared: list[list[int]]) -> tuple[list[int], list[int], list[int]]:
    """Merges runs of symbol sequences of one depth.

    ``runs[r][d][i]`` is symbol d of entry i of run r, ``shared[r][i]`` the number of leading symbols
    that this entry shares with the one before it in its run. Returns, in merged order, each entry's
    run, its index there, and the number of leading symbols that it shares with the entry before it.
    A common prefix that is known is never compared again: a loser keeps the length of its common
    prefix with the winner that beat it, and symbols are read from that depth on.
    """
    depth = len(runs[0]) if runs else 0
    sizes = [len(r[0]) for r in runs]
    leaves = 1
    while leaves < max(1, len(runs)):
        leaves *= 2
    # known prefix with the last entry that won on the way to the root; -1: the run is used up
    known = [0 if r < len(runs) and sizes[r] else -1 for r in range(leaves)]
    at = [0] * leaves
    first = [r[0] for r in runs] + [[]] * (leaves - len(runs))

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser."""
        h = known[a]
        if h != known[b]:
            return (a, b) if h > known[b] else (b, a)
        if h < 0:
            return a, b
        i, j = at[a], at[b]
        while h < depth:
            x, y = runs[a][h][i], runs[b][h][j]
            if x != y:
                if x < y:
                    known[b] = h
                    return a, b
                known[a] = h
                return b, a
            h += 1
        known[b] = h
        return a, b

    losers = [0] * leaves
    level = list(range(leaves))
    base = leaves
    while len(level) > 1:
        base //= 2
        nxt = []
        for k in range(0, len(level), 2):
            w, lost = play(level[k], level[k + 1])
            losers[base + k // 2] = lost
            nxt.append(w)
        level = nxt
    top = level[0]
    out_run: list[int] = []
    out_at: list[int] = []
    out_shared: list[int] = []
    while known[top] >= 0:
        i = at[top]
        out_run.append(top)
        out_at.append(i)
        out_shared.append(known[top])
        i += 1
        at[top] = i
        known[top] = shared[top][i] if i < sizes[top] else -1
        node, c = (leaves + top) >> 1, top
        h = known[c]
        while node:
            other = losers[node]
            g = known[other]
            if g > h:
                losers[node], c, h = c, other, g
            elif g == h and h >= 0:
                if h == 0 and (x := first[c][at[c]]) != (y := first[other][at[other]]):
                    if y < x:
                        losers[node], c = c, other
                else:
                    c, losers[node] = play(c, other)
                    h = known[c]
            node >>= 1
        top = c
    return out_run, out_at, out_shared
