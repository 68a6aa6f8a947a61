"""Plain-Python counterparts of the operators, for small fixtures."""

import random
import re

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def shingles(text):
    data = (text or "").encode()
    words = WORDS.findall(bytes(b + 32 if 65 <= b <= 90 else b for b in data))
    if not words:
        return set()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def roots(nodes, links):
    up = {n: n for n in nodes}

    def find(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return {n: find(n) for n in nodes}


def jaccard(texts):
    sets = {i: shingles(t) for i, t in texts.items()}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    root = roots(sets, links)
    return {i: (len(s), root[i]) for i, s in sets.items()}


def repeats(texts, length=100):
    """Per document: the bytes that an earlier equal string covers."""
    first, out = {}, {}
    for i in sorted(texts):
        data = (texts[i] or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - length + 1):
            w = data[p : p + length]
            if w in first:
                gone[p : p + length] = b"\1" * length
            else:
                first[w] = (i, p)
        out[i] = (data, bytes(gone))
    return out


def corpus(seed, n=120, vocabulary=400):
    """Documents with copies, near copies, shared passages, long runs and short texts."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeéxyz") for _ in range(rng.randint(1, 7))) for _ in range(vocabulary)]
    prose = lambda k: " ".join(rng.choice(words) for _ in range(k))
    passages = [prose(60) for _ in range(3)]
    texts = {}
    for i in range(n):
        kind = rng.random()
        if i and kind < 0.15:
            texts[i] = texts[rng.randrange(i)]
        elif i and kind < 0.45:
            own = (texts[rng.randrange(i)] or "a b").split(" ")
            for _ in range(rng.randint(1, 3)):
                own[rng.randrange(len(own))] = rng.choice(words)
            texts[i] = " ".join(own)
        elif kind < 0.6:
            texts[i] = prose(rng.randint(0, 40)) + " " + rng.choice(passages) + "\n" + prose(rng.randint(0, 30))
        elif kind < 0.65:
            texts[i] = rng.choice(["", None, " \n", "one", "One", "two words", "é" * 90, "ab" * 150, "=" * 260, "x y " * 60])
        else:
            texts[i] = prose(rng.randint(1, 120))
    return texts
