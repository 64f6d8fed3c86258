"""Made-up rows for the tests of this folder."""

import random


def rows_of(texts, first=0, lang="en", source="src0"):
    return [(first + k, t, lang, source, 1, 0.5, "x", 2, "y", 3) for k, t in enumerate(texts)]


def prose(seed, n, vocabulary=400):
    r = random.Random(seed)
    return " ".join(word(r.randrange(vocabulary)) for _ in range(n))


def word(k):
    out = "w"
    while k:
        k, at = divmod(k, 20)
        out += "abcdefghijklmnopqrst"[at]
    return out
