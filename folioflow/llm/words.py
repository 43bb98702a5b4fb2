"""Words of texts as bytes: runs of ASCII letters and digits and of all that lies beyond ASCII, only A-Z in lower case."""

from __future__ import annotations

from collections.abc import Iterator

#: Separators become blanks, capitals small letters; bytes of code points beyond ASCII stay.
_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
AT_ONCE = 1 << 20


def words(text: bytes, at_once: int = AT_ONCE) -> Iterator[list[bytes]]:
    """The words of a UTF-8 text in order, in lists that hold some ``at_once`` bytes of it each."""
    plain = text.translate(_BYTES)
    start = 0
    while start < len(plain):
        end = plain.find(b" ", start + at_once) if start + at_once < len(plain) else -1
        end = len(plain) if end < 0 else end
        found = plain[start:end].split()
        if found:
            yield found
        start = end
