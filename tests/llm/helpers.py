"""Fixture texts and plain re-statements of the operators, used as brute force."""

import random
import re

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ENGLISH = "the quick brown fox jumps over lazy dogs while many people watch from their old house near river and think about winter".split()
GERMAN = "der schnelle braune fuchs springt über faule hunde während viele leute aus ihrem alten haus am fluss zusehen und nachdenken".split()


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))


def shingle_set(text, width):
    w = words(text)
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


def prose(seed, n, vocabulary=ENGLISH):
    r = random.Random(seed)
    return " ".join(r.choice(vocabulary) + (str(r.randrange(60)) if r.random() < 0.5 else "") for _ in range(n))


def roots(nodes, pairs):
    parent = {x: x for x in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def near_components(docs, width, percent):
    """{id: (n, component)} by comparing all pairs."""
    sets = {i: shingle_set(t, width) for i, t in docs}
    ids = sorted(i for i in sets if sets[i])
    pairs = []
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            same = len(sets[a] & sets[b])
            if 100 * same >= percent * (len(sets[a]) + len(sets[b]) - same):
                pairs.append((a, b))
    found = roots(sets, pairs)
    return {i: (len(sets[i]), found[i]) for i in sets}
