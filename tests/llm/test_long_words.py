import numpy as np

from factline.llm import quality_classifier as q


def test_symbols_late_in_a_long_word_are_seen():
    reader = q.Reader()
    plain, marked = "abcde" * 400, "abcde" * 20 + "#a*b$c&d|e" * 190
    votes, n, x = reader.read(marked)
    assert n == 1 and votes[q.LABELLERS.index("marked")] == -1
    other, _, y = reader.read(plain)
    assert other[q.LABELLERS.index("marked")] == 0 and np.abs(x - y).max() > 0.1


def test_a_long_text_of_one_word_is_not_short():
    assert np.linalg.norm(q.Reader().read("abcde" * 400)[2]) > 0.9
