"""Plain versions of the operators, for small tables."""

import hashlib
import itertools
import math
import re
from collections import Counter

SPACES = re.compile(r"[\x20\x09-\x0D]+")


def words(text):
    return [w for w in SPACES.split(text or "") if w]


def quality(text):
    ws = words(text)
    windows = [tuple(ws[i : i + 8]) for i in range(len(ws) - 7)]
    seen = Counter(windows)
    covered = {j for i, w in enumerate(windows) if seen[w] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


BAD_LINE = [
    lambda x: len(x) >= 80 and not re.search("[.?!:;\"'»”…。！？؟।]", x),
    lambda x: len(x) - len(x.replace("!!", "!")) > 0.03 * len(x),
    lambda x: x.count("|") >= 3,
    lambda x: len(re.findall(r"[#*$%&|<>]", x)) > 0.05 * len(x),
    lambda x: len(x) >= 20 and x.upper() == x and x.lower() != x,
    lambda x: len(x) <= 200 and any(p in x.lower() for p in ("privacy policy", "cookie", "all rights reserved", "click here", "subscribe")),
]


def clean(text):
    """The text without failing lines (of the phrases only some), and the characters lost."""
    bad = [bool(words(x)) and any(f(x) for f in BAD_LINE) for x in text.split("\n")]
    return "\n".join(x for x, b in zip(text.split("\n"), bad) if not b), sum(len(x) for x, b in zip(text.split("\n"), bad) if b)


def exact(rows):
    """(doc_id, text) rows -> sorted (doc_id, keep_id, group_size, sha)."""
    groups = {}
    for i, t in rows:
        groups.setdefault(SPACES.sub("", t or ""), []).append((-len(t or ""), i))
    return sorted((i, min(g)[1], len(g), hashlib.sha256(n.encode()).hexdigest()) for n, g in groups.items() for _, i in g)


def shingles(text, n=4):
    w = [x for x in re.split(rb"[\x20\x09-\x0D]+", (text or "").encode().lower()) if x]
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def jaccard(rows, percent=85, n=4):
    """(doc_id, text) rows -> sorted (doc_id, n_shingles, component_id)."""
    sets = [(i, shingles(t, n)) for i, t in rows]
    top = {i: i for i, _ in rows}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for (a, x), (b, y) in itertools.combinations(sets, 2):
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            a, b = find(a), find(b)
            top[max(a, b)] = min(a, b)
    return sorted((i, len(s), find(i)) for i, s in sets)


def suffix(texts, length=200):
    """[(n_bytes, n_removed, n_spans, kept)] of byte strings."""
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(t), sum(gone), runs, bytes(c for c, g in zip(t, gone) if not g)))
    return out


def url_verdicts(tokens, seeds, rounds=30):
    """tokens by id -> verdict by id: naive Bayes by expectation maximisation from the examples that hold a seed in the host."""
    bad = {i for i, ts in tokens.items() if any(t[:2] == "h:" and t[2:] in seeds for t in ts)}
    own = {i: [t for t in ts if t[2:] not in seeds] for i, ts in tokens.items()}
    share, score = {i: float(i in bad) for i in own}, dict.fromkeys(own, 0.0)
    for last in range(rounds + 1):
        seen = ({}, {})
        for i, ts in own.items():
            for t in ts:
                for side, x in enumerate((share[i], 1 - share[i])):
                    seen[side][t] = seen[side].get(t, 0) + x
        size = len(seen[0]) + 1
        total = [sum(x.values()) + size for x in seen]
        weight = {t: math.log((seen[0][t] + 1) / total[0]) - math.log((seen[1][t] + 1) / total[1]) for t in seen[0]}
        prior = math.log((sum(share.values()) + 1) / (len(own) - sum(share.values()) + 1))
        score = {i: prior + sum(weight[t] for t in ts) for i, ts in own.items()}
        new = {i: 1.0 if i in bad else 1 / (1 + math.exp(-s)) for i, s in score.items()}
        moved, share = max(abs(new[i] - share[i]) for i in new), new if last < rounds else share
        if moved < 0.01:
            break
    return {i: "block" if i in bad or score[i] > 0 else "allow" for i in own}
