"""Byte-pair merging as a deterministic machine that reads a word from left to right, token by token.

The encoding of a word is the one sequence of tokens in which each two neighbours are stable side by side. So the
machine's state is its last token; from it the longest token that is stable there is read, and on failure the next
shorter one (a failure transition), which may undo the last step. A position that failed once fails always, since
a prefix has one encoding only; so every position is left at most once and the work is linear.

Two tokens are stable side by side if merging a + b gives a, b again. That is read off the right edge of a's merge
tree and the left edge of b's: whether an edge symbol of a and one of b that exist at the same time merge before
either is merged away within its own token.
"""

from __future__ import annotations

from collections.abc import Callable

END = float("inf")


class Merging:
    """rank(x, y): order in which x and y merge, or None. tokens: all strings that are a token."""

    def __init__(self, rank: Callable[[str, str], float | None], tokens: frozenset[str] | set[str] | dict, pairs: int = 500_000) -> None:
        self.rank, self.tokens, self.most_pairs = rank, tokens, pairs
        self.longest = max(map(len, tokens), default=1)
        self.reach: dict[str, int] = {}
        for t in tokens:
            self.reach[t[:2]] = max(self.reach.get(t[:2], 1), len(t))
        self.edges: dict[str, tuple[list, list] | None] = {}
        self.pairs: dict[tuple[str, str], bool] = {}

    def merge(self, s: str) -> tuple[list[str], list[tuple[str, str, float]]]:
        """Encoding of a short string by merging, least rank first, then leftmost; and the merges made."""
        parts, made = list(s), []
        while len(parts) > 1:
            best, at = END, -1
            for i in range(len(parts) - 1):
                r = self.rank(parts[i], parts[i + 1])
                if r is not None and r < best:
                    best, at = r, i
            if at < 0:
                break
            made.append((parts[at], parts[at + 1], best))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts, made

    def edge(self, token: str) -> tuple[list, list] | None:
        """(symbol, rank at which it is merged away) along the right edge, and along the left; None if not its own encoding or out of order."""
        if token not in self.edges:
            parts, made = self.merge(token)
            if len(parts) != 1:
                self.edges[token] = None
            else:
                tree = {x + y: (x, y, r) for x, y, r in made}
                right, left, x, rank = [(token, END)], [(token, END)], token, END
                ok = True
                for side, out in ((1, right), (0, left)):
                    x, rank = token, END
                    while len(x) > 1:
                        ok &= tree[x][2] < rank
                        rank = tree[x][2]
                        x = tree[x][side]
                        out.append((x, rank))
                self.edges[token] = (right[::-1], left[::-1]) if ok else ([], [])
        return self.edges[token]

    def whole(self, token: str) -> bool:
        return len(token) == 1 or (token in self.tokens and self.edge(token) is not None)

    def stable(self, a: str, b: str) -> bool:
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= self.most_pairs:
                self.pairs.clear()
            known = self.pairs[(a, b)] = self._stable(a, b)
        return known

    def _stable(self, a: str, b: str) -> bool:
        x, y = self.edge(a)[0], self.edge(b)[1]
        if not x or not y:
            return self.merge(a + b)[0] == [a, b]
        i = j = 0
        while True:
            (p, p_end), (q, q_end) = x[i], y[j]
            r = self.rank(p, q)
            if r is not None and r < p_end and r <= q_end:
                return False
            if p_end == END and q_end == END:
                return True
            if p_end <= q_end:
                i += 1
            else:
                j += 1

    def path(self, word: str) -> list[str]:
        n, at, most = len(word), 0, 1 << 30
        out: list[str] = []
        dead: set[int] = set()
        tokens, pairs, edges = self.tokens, self.pairs, self.edges
        while at < n:
            for k in range(min(most, self.reach.get(word[at : at + 2], 1), n - at), 0, -1):
                t = word[at : at + k]
                if k > 1 and (t not in tokens or (edges[t] if t in edges else self.edge(t)) is None) or at + k in dead:
                    continue
                if not out:
                    break
                ok = pairs.get((out[-1], t))
                if ok or ok is None and self.stable(out[-1], t):
                    break
            else:
                dead.add(at)
                most = len(out[-1]) - 1
                at -= len(out.pop())
                continue
            out.append(t)
            at += k
            most = 1 << 30
        return out
