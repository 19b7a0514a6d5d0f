"""Cutting text at the places where byte-level BPE never merges."""

from __future__ import annotations

import re

import regex

#: Fixed value: the usual split pattern of byte-level tokenizers.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same pattern over the first 256 code points, spelt out for the faster standard module.
_LETTER, _NUMBER, _SPACE = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼-¾", r"\t-\r \x85\xa0"
_LATIN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^{_SPACE}{_LETTER}{_NUMBER}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")


def is_latin(text: str) -> bool:
    """Whether all code points are below U+0100."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Splitter:
    """Cuts texts by the tokenizer's split pattern: _LATIN where it says the same, else the pattern itself."""

    def __init__(self, pattern: str):
        self.wide, self.same = regex.compile(pattern), pattern == BYTE_LEVEL

    def __call__(self, text: str) -> list[str]:
        return _LATIN.findall(text) if self.same and is_latin(text) else self.wide.findall(text)
