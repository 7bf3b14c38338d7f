"""Rows for the tests of the training-data operators."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _doc string, _row string, _text string, _in string, n_words string, size string, kept string, fingerprint string, copies string"
EXTRA = ("x",) * 9


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    syllables = ["the", "an", "of", "er", "tion", "ou", "re", "in", "st", "ha", "nd", "ble"]
    words = ["".join(r.choice(syllables) for _ in range(r.randint(1, 3))) for _ in range(n)]
    return "\n".join(" ".join(words[i : i + 12]) + "." for i in range(0, n, 12))
