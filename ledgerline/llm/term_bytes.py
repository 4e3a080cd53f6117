"""Terms of texts as UTF-8 bytes: runs of digits, letters a-z and everything beyond ASCII, A-Z lower-cased."""

from __future__ import annotations

import re
from collections.abc import Iterator

TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
GAP = re.compile(rb"[^0-9a-z\x80-\xff]")
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
# The same terms as a pattern over a text whose A-Z are lower-cased, for Spark and SQL.
TERM_PATTERN = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
STEP = 1 << 20


def term_lists(text: str) -> Iterator[list[bytes]]:
    """The terms of a text, a bounded part of it at a time (every byte of a character beyond ASCII is 128 or more)."""
    body = text.encode().translate(LOWER)
    at = 0
    while at < len(body):
        cut = GAP.search(body, at + STEP) if at + STEP < len(body) else None
        end = cut.start() if cut else len(body)
        yield TERM.findall(body, at, end)
        at = end


class Numbered(dict):
    """term -> number in order of first use."""

    def __missing__(self, term: bytes) -> int:
        value = self[term] = len(self)
        return value


class Wanted(dict):
    """term -> number for a fixed set of terms; -1 for all others, which are not kept."""

    def __missing__(self, term: bytes) -> int:
        return -1
