"""Words as a keyword index holds them: without marks, in lower case, stemmed by Porter's rules."""

from __future__ import annotations

import re
import unicodedata

_WORD = re.compile(r"[^\W_]+")
#: Lengths that are stemmed; shorter and longer words stay.
SHORTEST, LONGEST = 3, 64

#: The endings of Porter's steps 2, 3 and 4 (with the published revisions bli and logi), in the paper's order.
STEP_2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"),
    ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("logi", "log"),
)
STEP_3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")
#: The same rules by ending, longest endings first.
_STEP_2, _STEP_3 = (dict(sorted(rules, key=lambda r: -len(r[0]))) for rules in (STEP_2, STEP_3))
_ENDS_2, _ENDS_3, _ENDS_4 = tuple(_STEP_2), tuple(_STEP_3), tuple(sorted(STEP_4, key=len, reverse=True))


class _Marks(dict):
    """For str.translate: None for a combining mark, else the character itself."""

    def __missing__(self, c: int) -> int | None:
        self[c] = None if unicodedata.category(chr(c)) == "Mn" else c
        return self[c]


_MARKS = _Marks()


def plain(text: str) -> str:
    """Lower case, without combining marks."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", unicodedata.normalize("NFD", text).translate(_MARKS))
    return text.lower()


def words(text: str) -> list[str]:
    return _WORD.findall(plain(text))


def _shape(w: str) -> str:
    """c for each consonant and v for each vowel; y after a consonant is a vowel."""
    out = ""
    for c in w:
        out += "v" if c in "aeiou" or c == "y" and out.endswith("c") else "c"
    return out


def _measure(w: str) -> int:
    return _shape(w).count("vc")


def _closed(w: str) -> bool:
    """Ends with consonant, vowel, consonant, the last none of w, x and y."""
    return _shape(w).endswith("cvc") and w[-1] not in "wxy"


def _ending(w: str, endings: tuple[str, ...]) -> str | None:
    """The longest ending that the word has, of endings with the longest first; most words have none."""
    return next(filter(w.endswith, endings)) if w.endswith(endings) else None


def _plural(w: str) -> str:
    if w[1:].endswith(("sses", "ies")):  # an ending is not the whole word
        return w[:-2]
    return w[:-1] if w.endswith("s") and not w.endswith("ss") else w


def _past(w: str) -> str:
    if w[1:].endswith("eed"):
        return w[:-1] if _measure(w[:-3]) > 0 else w
    e = _ending(w, ("ing", "ed"))
    if e is None or "v" not in _shape(w[: -len(e)]):
        return w
    w = w[: -len(e)]
    if w.endswith(("at", "bl", "iz")):
        return w + "e"
    if w[-2:-1] == w[-1:] and _shape(w)[-1] == "c" and w[-1] not in "lsz":
        return w[:-1]
    return w + "e" if _measure(w) == 1 and _closed(w) else w


def _replaced(w: str, rules: dict[str, str], endings: tuple[str, ...]) -> str:
    e = _ending(w, endings)
    return w[: -len(e)] + rules[e] if e and _measure(w[: -len(e)]) > 0 else w


def _cut(w: str) -> str:
    e = _ending(w, _ENDS_4)
    if e is None:
        return w
    rest = w[: -len(e)]
    return rest if _measure(rest) > 1 and (e != "ion" or rest.endswith(("s", "t"))) else w


def stem(w: str) -> str:
    """A word (in lower case) without its inflection."""
    if not SHORTEST <= len(w) <= LONGEST:
        return w
    w = _past(_plural(w))
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    w = _cut(_replaced(_replaced(w, _STEP_2, _ENDS_2), _STEP_3, _ENDS_3))
    if w.endswith("e") and (_measure(w[:-1]) > 1 or _measure(w[:-1]) == 1 and not _closed(w[:-1])):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w[:-1]) > 1 else w
