"""Shapes of long words."""

from factorloom.llm import quality


def test_shape_of_the_whole_word():
    shape = quality.Featurizer()._shape
    assert shape(b"ABCdefg12") == b"Aa0" and shape(b"!!x") == b"!a" and shape(b"") == b""
    head = b"aB" * 40
    assert shape(head + b"123+") == b"aA" * 40 + b"0+" != shape(head + b"==")
