"""The printable characters that byte-level vocabularies write bytes as."""

from __future__ import annotations

from functools import cache


@cache
def byte_symbols() -> str:
    """Character of each byte: printable Latin-1 stands for itself, the rest follow from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return "".join(chr(b if b in printable else next(rest)) for b in range(256))
