"""Invented prose for the tests."""

import random

WORDS = "the of and to in is that for with was on as are by at from this be have or an which you it not".split()


def prose(rng: random.Random, n: int) -> str:
    out = []
    for _ in range(n):
        w = rng.choice(WORDS) if rng.random() < 0.4 else "".join(rng.choice(["an", "er", "in", "on", "at", "en", "nd", "ti", "es", "or"]) for _ in range(rng.randint(1, 4)))
        out.append(w + rng.choice(["", "", "", ",", ".", "\n"]))
    return " ".join(out)
