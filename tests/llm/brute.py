"""Plain versions of the operators, for small inputs."""

import re
from collections import Counter, defaultdict

WORD = re.compile("[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


def shingles(text, n=5):
    w = words((text or "").translate(LOWER))
    if not w:
        return set()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)}


def near_components(docs, percent=85):
    """{key: (set size, component, kept)} of {key: text}."""
    sets = {k: shingles(t) for k, t in docs.items()}
    index, shared = defaultdict(list), Counter()
    for k, s in sets.items():
        for g in s:
            index[g].append(k)
    for keys in index.values():
        for i, a in enumerate(keys):
            for b in keys[:i]:
                shared[a, b] += 1
    parent = {k: k for k in docs}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    return {k: (len(sets[k]), root(k), root(k) == k) for k in docs}


def kept_lines(docs, percent=90):
    """{key: [line numbers that stay]} of {key: text}, by comparing every line with all before it."""
    earlier, kept = [], {}
    for key in sorted(docs):
        kept[key] = []
        for i, line in enumerate((docs[key] or "").split("\n")):
            s = frozenset(words(line))
            if not s:
                continue
            if not any(100 * len(s & e) >= percent * len(s | e) for e in earlier):
                kept[key].append(i)
            earlier.append(s)
    return kept


def without_repeats(texts, window=35):
    """[(n words, n removed, kept words)] of the texts."""
    split, seen = [words(t) for t in texts], Counter()
    for w in split:
        seen.update(tuple(w[i : i + window]) for i in range(len(w) - window + 1))
    out = []
    for w in split:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append((len(w), sum(gone), [x for x, g in zip(w, gone, strict=True) if not g]))
    return out
