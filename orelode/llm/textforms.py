"""Texts without differences of form."""

from __future__ import annotations

import re
import unicodedata

_WORD = re.compile(r"[^\W_]+")
_SKIPPED = dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF])
_ESCAPED = re.compile(r"\\([\\`*_{}\[\]()#+\-.!|>~])")
_ASCII = "".join(c if c.isalnum() else " " for c in map(chr, range(128)))


def words(text: str) -> list[str]:
    """Words in lower case, without marks of layout: compatibility forms, invisible characters, escapes, emphasis."""
    if "\\" in text:
        text = _ESCAPED.sub(r"\1", text)
    if text.isascii():
        return text.lower().translate(_ASCII).split()
    return _WORD.findall(unicodedata.normalize("NFKC", text).translate(_SKIPPED).lower())
