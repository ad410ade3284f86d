"""Character folding shared by the operators on free text.

The tables come from the Unicode database by rule; only look-alike letters, which Unicode does not
relate by decomposition, are listed.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters of other scripts that look like a Latin letter.
LOOK_ALIKE = {
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "у": "y", "х": "x", "ԝ": "w",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "У": "Y", "Х": "X",
    "α": "a", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "ϲ": "c", "ϳ": "j",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ո": "n", "օ": "o", "ս": "u",
}

#: Decompositions whose result differs from the source only in width, font or line breaking.
SAME_LOOK = {"<wide>", "<narrow>", "<noBreak>", "<font>"}


def is_invisible(ch: str) -> bool:
    """Format characters, variation selectors and fillers that show nothing."""
    return unicodedata.category(ch) == "Cf" or "︀" <= ch <= "️" or ch in "͏ᅟᅠ឴឵ㅤﾠ"


@lru_cache(maxsize=None)
def plain_letters() -> tuple[str, str]:
    """``(from, to)`` for ``translate``: accents, width and look-alikes folded to lower-case ASCII, marks and invisible characters dropped (``from`` is longer than ``to``)."""
    pairs, drop = [], []
    for cp in (*range(0x80, 0x590), *range(0x1E00, 0x2070), *range(0x3000, 0x3001), *range(0xFE00, 0xFE10), 0xFEFF, *range(0xFF00, 0xFFF0)):
        ch = chr(cp)
        if unicodedata.combining(ch) or is_invisible(ch):
            drop.append(ch)
            continue
        if ch.isspace() or unicodedata.category(ch) == "Zs":
            pairs.append((ch, " "))
            continue
        base = "".join(LOOK_ALIKE.get(c, c) for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c)).lower()
        base = "".join(LOOK_ALIKE.get(c, c) for c in base)
        if len(base) == 1 and base != ch:
            pairs.append((ch, base))
    return "".join(a for a, _ in pairs) + "".join(drop), "".join(b for _, b in pairs)


def folded(c: Column) -> Column:
    """Lower-case, accent-free, width-free, look-alike-free form of a short text column; runs of white space become one blank."""
    a, b = plain_letters()
    return F.trim(F.regexp_replace(F.lower(F.translate(c, a, b)), r"\s+", " "))


def folded_py(text: str) -> str:
    """:func:`folded` for a Python string, used where a text is already in a Python worker."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFKD", text).translate(_py_table())
    return "".join(c for c in text.lower() if not unicodedata.combining(c))


@lru_cache(maxsize=None)
def _py_table() -> dict[int, str | None]:
    table: dict[int, str | None] = {ord(k): v for k, v in LOOK_ALIKE.items()}
    for cp in (*range(0x80, 0x3002), *range(0xFE00, 0xFE10), 0xFEFF, *range(0xFFF0, 0x10000)):
        if is_invisible(chr(cp)):
            table[cp] = None
    return table
