"""Texts for the tests."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    parts = ["an", "the", "ing", "er", "on", "th", "re", "st", "ti", "ou", "é", "ha", "wh", "ble"]
    return " ".join("".join(r.choice(parts) for _ in range(r.randint(1, 4))) for _ in range(n))
