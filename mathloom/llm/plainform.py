"""Plain form of text: look-alike characters, invisible characters and odd blanks brought to one spelling.

The tables below are data about Unicode, not about any corpus.  Everything that Unicode itself can say (width and
font variants, Kangxi radicals, combining accents, format characters, blanks) is derived from ``unicodedata``;
only letters and signs of other scripts that merely look like ASCII need a list.
"""

from __future__ import annotations

import re
import unicodedata

# Marks that count as plain although they have a narrower twin (fixed values of the task).
PLAIN_MARKS = "×÷，。？！：；（）、“”【】《》"

# Look-alikes of ASCII: fixed values, one pair of equally long strings a script.
_LOOK = (
    # Cyrillic
    ("АВСЕНІЈКМОРЅТХУҮЗԚԜԌасеһіјорѕхуѵԛԝԁӏкмтвнпгь", "ABCEHIJKMOPSTXYY3QWGacehijopsxyvqwdlkmtbnnrb"),
    # Greek
    ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϜαγικνορτυχωϲϳ", "ABEZHIKMNOPTYXFayikvoptuxwcj"),
    # Armenian and Latin extensions
    ("օսոհցɡıɑⱭƖǀʟƅ", "ounhggiaAllLb"),
    # Signs
    ("⁄∕−‐‑∶‚ꓸ․∗⁎٪", "//---:,..**%"),
)
LOOKALIKE = {a: b for one, other in _LOOK for a, b in zip(one, other, strict=True)}
# Letters that also pass for a digit when one stands beside them.
DIGIT_TWIN = {"О": "0", "о": "0", "Ο": "0", "ο": "0", "օ": "0", "З": "3", "І": "1", "Ι": "1", "ӏ": "1", "ǀ": "1", "ⅼ": "1", "б": "6"}

_SAME_LOOK = ("<wide>", "<narrow>", "<font>", "<noBreak>", "<square>")


def _is_ignorable(c: str) -> bool:
    o = ord(c)
    return o > 127 and (
        unicodedata.category(c) == "Cf" or o in (0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0) or 0x180B <= o <= 0x180F or 0xFE00 <= o <= 0xFE0F or 0xE0000 <= o <= 0xE0FFF
    )


def _fold(c: str) -> str | None:
    """Plain twin of one character, "" if it is not seen, None if it is plain itself."""
    o = ord(c)
    if o < 128 or c in PLAIN_MARKS or 0x4E00 <= o <= 0x9FFF or 0xAC00 <= o <= 0xD7A3:
        return None
    if c in LOOKALIKE:
        return LOOKALIKE[c]
    if _is_ignorable(c):
        return ""
    kind = unicodedata.category(c)
    if kind in ("Zs", "Zl", "Zp") or o == 0x85:
        return " "
    how = unicodedata.decomposition(c)
    if how:
        head = how.split(" ")[0]
        twin = unicodedata.normalize("NFKC", c)
        letters = twin.isascii() and twin.isalpha()  # ligatures and Roman numerals
        if head in _SAME_LOOK or (head == "<compat>" and (len(twin) == 1 or letters)) or (head[0] != "<" and unicodedata.normalize("NFC", c) != c):
            return twin
    return None


class _Table(dict):
    """``str.translate`` table that derives each character's entry once."""

    def __missing__(self, o: int) -> int | str:
        twin = _fold(chr(o))
        self[o] = o if twin is None else twin
        return self[o]


# Text made of these only is plain: a cheap test that spares nearly all values the rest.
SURE = "\\x00-\\x7f\\u4e00-\\u9fff\\u3400-\\u4dbf\\u00c0-\\u00d6\\u00d8-\\u00f6\\u00f8-\\u0130\\u0132-\\u017f\\u1ea0-\\u1ef9" + PLAIN_MARKS
_UNSURE = re.compile(f"[^{SURE}]")
_COMBINING = re.compile("[̀-゙゚ͯ]")
_TWIN_BESIDE_DIGIT = re.compile(f"(?<=[0-9])[{''.join(DIGIT_TWIN)}]+|[{''.join(DIGIT_TWIN)}]+(?=\\.?[0-9])")
_PICTURE = re.compile("(?<=[←-⯿️\U0001f000-\U0001faff])[‍️]")
_WORD = re.compile(r"[^\W㐀-鿿]+")
_FOREIGN = re.compile("[Ͱ-ԯԱ-֏]")


def fold_text(s: str) -> str:
    """Plain form by the tables alone: total, idempotent, the same for equal-looking texts."""
    if not _UNSURE.search(s):
        return s
    if _COMBINING.search(s):
        s = unicodedata.normalize("NFC", "".join(c for c in s if not _is_ignorable(c)))
    s = s.translate(_DIGIT_FIRST)
    s = _TWIN_BESIDE_DIGIT.sub(lambda m: "".join(DIGIT_TWIN[c] for c in m.group()), s)
    # a word with a letter that looks like nothing in ASCII belongs to its own script
    s = _WORD.sub(lambda m: m.group() if foreign_word(m.group()) else m.group().translate(TABLE), s)
    s = s.translate(_NOT_WORD)
    return unicodedata.normalize("NFC", s) if _COMBINING.search(unicodedata.normalize("NFD", s)) else s


def _decompose_lookalike(c: str) -> str | None:
    """ύ and the like: a look-alike with an accent becomes the accented plain letter."""
    parts = unicodedata.normalize("NFD", c)
    if len(parts) > 1 and parts[0] in LOOKALIKE:
        return unicodedata.normalize("NFC", LOOKALIKE[parts[0]] + parts[1:])
    return None


class _WordFree(_Table):
    """Everything but letters of other scripts, which need their word to decide."""

    def __missing__(self, o: int) -> int | str:
        c = chr(o)
        twin = None if _FOREIGN.match(c) else _fold(c)
        self[o] = o if twin is None else twin
        return self[o]


_DIGIT_FIRST = _WordFree()
_NOT_WORD = _WordFree()


class _Letters(_Table):
    def __missing__(self, o: int) -> int | str:
        c = chr(o)
        twin = _decompose_lookalike(c)
        if twin is None:
            twin = _fold(c)
        self[o] = o if twin is None else twin
        return self[o]


TABLE = _Letters()


def foreign_word(word: str) -> bool:
    """Wholly in another script: only Greek, Cyrillic or Armenian letters, at least one unlike any Latin letter."""
    if not _FOREIGN.search(word):
        return False
    odd = False
    for c in word:
        if ord(c) < 0x250 and c.isalpha() or c.isdigit():
            return False
        if _FOREIGN.match(c):
            odd |= c not in LOOKALIKE and _decompose_lookalike(c) is None
    return odd


def similarity_form(s: str) -> str:
    """Plain form, lower case, letters and digits only: what the similarities of records compare."""
    return re.sub(r"[\W_]+", "", fold_text(s).lower())
