"""Patterns for Unicode text, as Java regular expressions."""

from __future__ import annotations

import re

WORD = r"\p{L}\p{N}_"
SPACE = r"\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: blanks that do not end a line
INLINE_SPACE = r"\t\x0b-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"

_OPENING = f"(?<![{WORD}])"
_CLOSING = f"(?![{WORD}])"
_BOUNDARY = f"(?:(?<![{WORD}])(?=[{WORD}])|(?<=[{WORD}])(?![{WORD}]))"


def pattern(text: str, opens_word: bool = True) -> str:
    """``text`` with its character classes spelled out, so that the JVM reads them as Unicode ones.

    In all patterns here the first ``\\b`` opens a word and the others close one, which one look to
    the side decides; ``opens_word=False`` asks for the full test at the first one. ``(?d)`` makes a
    newline the only line end, as in the diff format.
    """
    spelled = (
        text.replace(r"[\w", f"[{WORD}")
        .replace(r"\w", f"[{WORD}]")
        .replace(r"\s", f"[{SPACE}]")
        .replace(r"\S", f"[^{SPACE}]")
        .replace(r"\d", r"\p{Nd}")
        .replace(r"\b", _OPENING if opens_word else _BOUNDARY, 1)
        .replace(r"\b", _CLOSING)
    )
    return "(?d)" + spelled


def opening(words: list[str]) -> str:
    """A look ahead at the first characters of a match, three at most, each of which one of ``words`` has there.

    Every match has to start with one of them. Put before a pattern it spares most positions the look behind and the alternatives.
    """
    depth = min(3, *map(len, words))
    escaped = [sorted({re.sub(r"[^\w ]", r"\\\g<0>", word[at]) for word in words}) for at in range(depth)]
    return "(?=" + "".join(f"[{''.join(chars)}]" for chars in escaped) + ")"


def folded_pattern(text: str) -> str:
    """The pattern for :func:`patchloom.functions.text.folded` text: search without regard to case.

    One folding per text and plain comparisons cost a third of the JVM's Unicode case matching.
    """
    return pattern(text.lower())
