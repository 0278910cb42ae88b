"""Awkward texts that the tests of several operators share."""

import random


def texts():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice(("an", "ti", "é", "ou", "st", "the")) for _ in range(rng.randint(1, 4)))
    base = [" ".join(word() for _ in range(n)) for n in (4, 40, 80, 300, 2000)]
    edited = [" ".join("changed" if i == k else w for i, w in enumerate(base[2].split())) for k in (5, 40, 70)]
    return [None, "", " \n ", "!!!", base[0], *base[1:], base[2], base[2], *edited, base[3][:200] + " new words " + base[1], base[3], "x" * 120, "x" * 60, "日本語" * 30, "日本語" * 31, "it's <|endoftext|> <|im_end|> \\ <\\|"]
