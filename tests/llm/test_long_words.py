"""Texts without white space: all of a long word makes features."""

from tracewright.llm import quality
from tracewright.llm.common import Memo


def of(*texts):
    doc, feature = quality.features(list(texts), Memo(quality.code, 1000))
    return [set(feature[doc == i].tolist()) for i in range(len(texts))]


def test_the_end_of_a_long_word_counts():
    plain, late, other = of("a" * 200, "a" * 150 + "!?" * 25, "a" * 150 + "7;" * 25)
    assert plain != late != other != plain
    a, b = of("x-Y7" * 8 + "abc", "x-Y7" * 8 + "9!!")
    assert a != b


def test_short_words_are_one_piece():
    text = "Some words, " + "w" * 64 + " and 12 more"
    assert quality.pieces(text) == text.split()
    assert "".join(quality.pieces("ab" * 500)) == "ab" * 500
