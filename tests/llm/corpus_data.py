"""Texts that the corpus tests are made of."""

import random
import re

SF = "/root/testdata/sf0.001"
WORDS = "the of and river stone light over under seven garden paper wind house never again table morning quiet green road".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "s", "ed", "ing", str(r.randint(0, 99))]) for _ in range(n))


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


BLANK_WORD = r"[^\x20\x09-\x0D]+"
