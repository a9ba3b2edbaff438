"""Folding of characters that look or mean the same."""

from __future__ import annotations

import re
import unicodedata

import regex

#: Cyrillic and Greek letters that look like Latin ones.
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y",
    "х": "x", "і": "i", "ї": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ӏ": "l", "α": "a", "ο": "o", "ρ": "p", "ν": "v",
    "ι": "i", "κ": "k", "τ": "t", "υ": "u", "χ": "x", "ε": "e",
}
_LOOKALIKE = str.maketrans(LOOKALIKES | {k.upper(): v.upper() for k, v in LOOKALIKES.items() if len(k.upper()) == 1})
_DROPPED = regex.compile(r"[\p{Mn}\p{Cf}]+")
_ALIKE = re.compile("[" + "".join(sorted({chr(k) for k in _LOOKALIKE})) + "]")
_LATIN = re.compile(r"[A-Za-z]")
_MIXED = re.compile(r"[^\W\d_]+")


def fold(text: str) -> str:
    """Compatibility forms, accents, invisible characters and look-alikes folded; case is kept.

    Look-alikes are folded only in words that hold a Latin letter too, or in texts where no word is wholly of the other
    script, so that text in another script stays what it is.
    """
    if text.isascii():
        return text
    text = _DROPPED.sub("", unicodedata.normalize("NFKD", text))
    if text.isascii() or not _ALIKE.search(text):
        return text
    return _MIXED.sub(lambda m: m[0].translate(_LOOKALIKE) if _LATIN.search(m[0]) else m[0], text)
