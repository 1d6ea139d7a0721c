"""Plain Python versions of what the operators compute."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingle_set(text, k):
    words = WORD.findall(lower(text))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


class Forest:
    def __init__(self):
        self.up = {}

    def find(self, x):
        while self.up.setdefault(x, x) != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def near_components(rows, k, percent):
    """doc_id -> (set size, least doc_id reachable) of rows (doc_id, text) with distinct ids."""
    sets = {i: shingle_set(t, k) for i, t in rows}
    by, forest = {}, Forest()
    for i, s in sets.items():
        forest.find(i)
        for x in s:
            by.setdefault(x, []).append(i)
    ids = sorted(sets)
    common = {}
    for i in ids:
        counts = {}
        for x in sets[i]:
            for j in by[x]:
                if j < i:
                    counts[j] = counts.get(j, 0) + 1
        common[i] = counts
    for i, counts in common.items():
        for j, c in counts.items():
            if 100 * c >= percent * (len(sets[i]) + len(sets[j]) - c):
                forest.join(i, j)
    return {i: (len(sets[i]), forest.find(i)) for i in ids}


def lines_of(text):
    """(number, normalised line) of the lines that are not blank."""
    stripped = (x.strip(b" \t\n\x0b\x0c\r").lower() for x in (text or "").encode().split(b"\n"))
    return [(i, x) for i, x in enumerate(stripped) if x]
