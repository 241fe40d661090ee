"""Plain versions of what the operators compute, and small tables."""

import collections
import math
import random
import re

UP = {i: i + 32 for i in range(65, 91)}
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text, lower=True):
    return WORD.findall((text or "").translate(UP) if lower else (text or ""))


def shingle_set(text):
    w = words(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def components(texts):
    """Smallest index reachable for each text."""
    sets = [shingle_set(t) for t in texts]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            same = len(sets[i] & sets[j])
            if same and 100 * same >= 80 * (len(sets[i]) + len(sets[j]) - same):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(len(sets))]


def prose(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


def edited(rng, text, edits):
    w = text.split(" ")
    for _ in range(edits):
        i = rng.randrange(len(w))
        kind = rng.random()
        if kind < 0.6:
            w[i] = f"x{rng.randrange(10**6)}"
        elif kind < 0.8:
            w.insert(i, f"y{rng.randrange(10**6)}")
        elif len(w) > 1:
            del w[i]
    return " ".join(w)


def near_texts(seed=0):
    """Copies, chains of near copies, clusters around one text, passages in common, short and empty texts."""
    rng = random.Random(seed)
    base = [prose(rng, rng.choice([3, 5, 12, 40, 60, 150, 400])) for _ in range(25)]
    passage = prose(rng, 60)
    out = list(base)
    for b in base[:12]:
        out += [b, b.upper(), edited(rng, b, 1), edited(rng, b, 3)]
    hub = prose(rng, 146)
    out += [hub] + [edited(rng, hub, rng.randrange(1, 8)) for _ in range(60)]
    step = prose(rng, 120)
    for _ in range(8):
        step = edited(rng, step, 1)
        out.append(step)
    out += [f"{prose(rng, 30)} {passage} {prose(rng, 20)}" for _ in range(25)]
    out += ["", " \n", None, "one", "ONE", "one two", "a b c d", "a b c d e", "A b c d e"]
    rng.shuffle(out)
    return out


def weighted_hits(docs, items, percent=80):
    """(doc, item): best similarity of item-sized windows, from weighted five-word shingles."""
    low = lambda t: WORD.findall((t or "").lower())
    grams = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)]
    split = {i: low(t) for i, t in items.items() if low(t)}
    df = collections.Counter(g for w in split.values() for g in set(grams(w)))
    weight = lambda g: 1 + math.log(len(split) / df.get(g, 1))
    out = {}
    for d, text in docs.items():
        w = low(text)
        for i, own in split.items():
            it, best = collections.Counter(grams(own)), 0
            for s in range(max(1, len(w) - len(own) + 1)):
                part = w[s : s + len(own)]
                if len(part) < min(5, len(own)):
                    continue
                win = collections.Counter(tuple(part[k : k + min(5, len(own))]) for k in range(len(part) - min(5, len(own)) + 1))
                both = sum(weight(g) * min(it[g], win[g]) for g in it)
                if both:
                    best = max(best, both / sum(weight(g) * max(it[g], win[g]) for g in set(it) | set(win)))
            if best >= percent / 100 - 1e-9:
                out[d, i] = best
    return out
