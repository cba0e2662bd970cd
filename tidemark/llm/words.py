"""Words of a text, free of what doesn't change what is said."""

from __future__ import annotations

import re
import unicodedata

import regex

_TAG = regex.compile(r"<[/!?]?[A-Za-z][^<>]*>|&(?:#\d+|#x[0-9a-fA-F]+|[a-zA-Z]{2,8});")
#: Format characters (zero width, soft hyphen, direction marks), controls but white space, combining marks.
_INVISIBLE = regex.compile(r"[\p{Cf}\p{Co}\p{Cn}\p{Mn}]|[\p{Cc}--\s]", regex.V1)
#: A letter of a script written without spaces is a word of its own.
_SPACELESS = re.compile("[\u2e80-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff]")
_PLAIN_WORD = re.compile(r"[^\W_]+")
_ASCII_CONTROLS = {i: None for i in range(32) if not chr(i).isspace()} | {127: None}
_WORD = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]|(?:(?![\p{Han}\p{Hiragana}\p{Katakana}])[\p{L}\p{N}])+")


def words(text: str | None) -> list[str]:
    """Lower case, without marks, accents, punctuation and mark-up; compatibility forms (ligatures, styled or full-width
    letters) are what they stand for. Null, empty and blank texts have none."""
    if not text:
        return []
    flat = _TAG.sub(" ", text) if "<" in text or "&" in text else text
    if flat.isascii():
        return _PLAIN_WORD.findall(flat.translate(_ASCII_CONTROLS).lower())
    flat = _INVISIBLE.sub("", unicodedata.normalize("NFKD", flat)).casefold()
    return (_WORD if _SPACELESS.search(flat) else _PLAIN_WORD).findall(flat)
