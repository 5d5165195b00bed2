"""Character classes of the public tokenizers' patterns, spelt out for ``re``.

``re`` has no ``\\p{L}``. A class of ranges up to U+FFFF is looked up in constant time; with
higher characters in it, it is searched range by range, so those are left to a second
pattern for the few texts that have any.
"""

from __future__ import annotations

import re
import sys
import unicodedata

# Characters with the Unicode property White_Space.
WHITE_SPACE = "\t\n\v\f\r \x85\xa0                　"


def ranges(member, top: int) -> str:
    """The code points up to ``top`` for which ``member`` holds, as the inside of a character class."""
    out, start = [], None
    for c in range(top + 2):
        held = c <= top and member(chr(c))
        if held and start is None:
            start = c
        elif not held and start is not None:
            out.append(re.escape(chr(start)) + (f"-{re.escape(chr(c - 1))}" if c - 1 > start else ""))
            start = None
    return "".join(out)


class Splitter:
    """All matches of a pattern in a text; L, N and S stand for letters, numbers and white space in its classes."""

    def __init__(self, pattern: str):
        self.low, self.full = (re.compile(pattern.format(
            L=ranges(lambda c: unicodedata.category(c)[0] == "L", top), N=ranges(lambda c: unicodedata.category(c)[0] == "N", top),
            S=re.escape(WHITE_SPACE))).findall for top in (0xFFFF, sys.maxunicode))
        self.high = re.compile("[\U00010000-\U0010ffff]").search

    def __call__(self, text: str) -> list[str]:
        return self.full(text) if self.high(text) else self.low(text)


def byte_level_words() -> Splitter:
    """Words of the byte-level vocabulary, one optional space in front."""
    return Splitter(" ?[{L}]+|'(?:[stmd]|re|ve|ll)| ?[{N}]+| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+")


def word_level_words() -> Splitter:
    """Words of the vocabulary with word ends; single digits, no white space."""
    return Splitter("[{L}]+|'(?:[stmd]|re|ve|ll)|[{N}]|[^{S}{L}{N}]+")
