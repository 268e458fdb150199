"""Many patterns of any lengths found in one pass: an automaton of all patterns in flat arrays, run over many texts at once."""

from __future__ import annotations

import numpy as np

CHUNK = 2048  # letters of a text that are one row of a run
ROWS = 4096  # rows that advance together


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Automaton:
    """States are the distinct prefixes of patterns, numbered by length; state 0 is the empty one.

    go[state, letter] leads to the longest suffix of what was read that is a prefix of a pattern. `own` names the pattern that a state
    is, `link` the longest proper suffix of it that is a pattern. All of it is built level by level, so no step is one letter of one pattern."""

    def __init__(self, patterns: list[str]):
        self.patterns = [p for p in dict.fromkeys(patterns) if p]
        self.size = np.array([len(p) for p in self.patterns], np.int64)
        self.longest = int(self.size.max(initial=0))
        flat = codes_of("".join(self.patterns))
        self.letters, code = np.unique(flat, return_inverse=True)
        code, first = code.astype(np.int64) + 1, np.cumsum(self.size) - self.size
        self.width = width = len(self.letters) + 1  # letter 0 is any that no pattern has
        node, levels, total = np.zeros(len(self.patterns), np.int64), [], 1
        ends = np.zeros(len(self.patterns), np.int64)
        for j in range(self.longest):
            live = np.flatnonzero(self.size > j)
            key, at = np.unique(node[live] * width + code[first[live] + j], return_inverse=True)
            levels.append((key // width, key % width, total))
            node[live] = total + at
            total += len(key)
            ends[live] = node[live]
        self.own = np.full(total, -1, np.int32)
        self.own[ends] = np.arange(len(self.patterns), dtype=np.int32)
        if not len(self.patterns):
            self.own[0] = -1
        self.go = np.zeros((total, width), np.int32)
        fail = np.zeros(total, np.int64)
        self.link = np.full(total, -1, np.int32)
        for j, (parent, letter, base) in enumerate(levels):
            child = base + np.arange(len(parent))
            if j:
                fail[child] = self.go[fail[parent], letter]
            # children of this level take their row from their suffix, whose row is complete
            self.go[parent, letter] = child
            self.link[child] = np.where(self.own[fail[child]] >= 0, fail[child], self.link[fail[child]])
            if j + 1 < len(levels):
                self.go[child] = self.go[fail[child]]
        if levels:
            child = levels[-1][2] + np.arange(len(levels[-1][0]))
            self.go[child] = self.go[fail[child]]
        self.hit = (self.own >= 0) | (self.link >= 0)

    def coded(self, text: str) -> np.ndarray:
        c = codes_of(text)
        at = np.minimum(np.searchsorted(self.letters, c), max(0, len(self.letters) - 1))
        return np.where(self.letters[at] == c, at + 1, 0) if len(self.letters) else np.zeros(len(c), np.int64)

    def find(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text number, pattern number and place of every occurrence, in order of the text and place."""
        if not self.longest:
            return tuple(np.empty(0, np.int64) for _ in range(3))
        sizes = np.array([len(t) for t in texts], np.int64)
        codes = np.concatenate([self.coded("".join(texts)), [0]])
        begin = np.cumsum(sizes) - sizes
        parts = -(-sizes // CHUNK)
        text = np.repeat(np.arange(len(texts)), parts)
        at = CHUNK * (np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts))
        long = np.minimum(sizes[text] - at, CHUNK + self.longest - 1)
        order = np.argsort(long, kind="stable")  # rows of like length together
        out: list[list[np.ndarray]] = [[], [], []]
        go = self.go.reshape(-1)
        for a in range(0, len(order), ROWS):
            r = order[a : a + ROWS]
            step = np.arange(int(long[r].max()))
            inside = step[:, None] < long[r]
            letter = codes[np.where(inside, begin[text[r]] + at[r] + step[:, None], len(codes) - 1)]
            state, states = np.zeros(len(r), np.int32), np.empty(inside.shape, np.int32)
            for j in step.tolist():
                state = go[state * np.int64(self.width) + letter[j]]
                states[j] = state
            j, i = np.nonzero(self.hit[states])
            s = states[j, i]
            s = np.where(self.own[s] >= 0, s, self.link[s])
            while len(s):
                p = self.own[s]
                place = j - self.size[p] + 1
                mine = place < CHUNK  # later ones are the next row's
                row = r[i[mine]]
                for o, x in zip(out, (text[row], p[mine], at[row] + place[mine])):
                    o.append(x)
                s = self.link[s]
                on = s >= 0
                s, i, j = s[on], i[on], j[on]
        found, p, place = (np.concatenate(o) if o else np.empty(0, np.int64) for o in out)
        order = np.lexsort((p, place, found))
        return found[order], p[order], place[order]
