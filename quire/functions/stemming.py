"""Words of a text as a full-text index sees them, and Porter's stemmer (Program 14(3), 1980)."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

WORD = re.compile(r"[^\W_]+")

# The endings of the published algorithm, by step.
PLURALS = {"sses": "ss", "ies": "i", "ss": "ss", "s": ""}
DERIVED = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize",
    "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
FORMED = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
DROPPED = dict.fromkeys(["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"], "")


def _shape(word: str) -> str:
    """Each letter as v or c; y is a vowel after a consonant."""
    out = ""
    for letter in word:
        out += "v" if letter in "aeiou" or (letter == "y" and out.endswith("c")) else "c"
    return out


def _measure(stem: str) -> int:
    """How often vowels are followed by consonants."""
    return len(re.findall("v+c+", _shape(stem)))


def _doubled(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word).endswith("c")


def _short_end(word: str) -> bool:
    """Consonant, vowel, consonant, the last of which is not w, x or y."""
    return _shape(word).endswith("cvc") and word[-1] not in "wxy"


def _replaced(word: str, endings: dict[str, str], least: int) -> str:
    """The longest ending that fits is replaced if what is before it has a measure of ``least`` or more; no other is tried."""
    fits = max((e for e in endings if word.endswith(e)), key=len, default=None)
    if fits is None:
        return word
    stem = word[: len(word) - len(fits)]
    if _measure(stem) < least or (fits == "ion" and not stem.endswith(("s", "t"))):
        return word
    return stem + endings[fits]


def _past(word: str) -> str:
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) else word
    ending = next((e for e in ("ed", "ing") if word.endswith(e) and "v" in _shape(word[: -len(e)])), None)
    if ending is None:
        return word
    stem = word[: -len(ending)]
    if stem.endswith(("at", "bl", "iz")):
        return stem + "e"
    if _doubled(stem) and stem[-1] not in "lsz":
        return stem[:-1]
    return stem + "e" if _measure(stem) == 1 and _short_end(stem) else stem


def _last(word: str) -> str:
    if word.endswith("e") and (_measure(word[:-1]) > 1 or (_measure(word[:-1]) == 1 and not _short_end(word[:-1]))):
        word = word[:-1]
    return word[:-1] if word.endswith("ll") and _measure(word[:-1]) > 1 else word


@lru_cache(1 << 16)
def stem(word: str) -> str:
    """Porter's stem of a lower-case word. What is no vowel of English counts as a consonant; words under three bytes or over 64 stay."""
    if not 3 <= len(word.encode("utf-8", "surrogatepass")) <= 64:
        return word
    word = _past(_replaced(word, PLURALS, 0))
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    return _last(_replaced(_replaced(_replaced(word, DERIVED, 1), FORMED, 1), DROPPED, 2))


@lru_cache(1 << 16)
def folded(word: str) -> str:
    """Without the marks on its letters."""
    return word if word.isascii() else "".join(c for c in unicodedata.normalize("NFD", word) if unicodedata.category(c) != "Mn")


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def stems(text: str | None) -> list[str]:
    """Stems of the words of a text, marks taken off, in order."""
    return [stem(folded(w)) for w in words(text)]
