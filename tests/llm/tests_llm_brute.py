"""Plain Python versions of what the operators compute."""

import re
from collections import Counter

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def measures(text):
    w = words(text)
    windows = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    covered = {k + d for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for d in range(3)}
    return {"n_words": len(w), "n_repeat_words": len(covered), "base_failed": len(w) < 50 or 100 * len(covered) > 50 * len(w)}


def shingle_set(text):
    w = [x.translate(LOWER) for x in words(text)]
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components_of(data):
    """For each (id, text) the smallest id of its component."""
    sets = [shingle_set(t) for _, t in data]
    root = list(range(len(data)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(data)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(data):
        least.setdefault(find(i), []).append(doc)
    return [min((d for d in least[find(i)] if d is not None), default=None) for i in range(len(data))]
