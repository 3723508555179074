"""Porter's suffix stripping (1980, with the later rules bli -> ble and logi -> log).

Two variants differ in one place, the 'e' that is put back after -ed or -ing: `textbook` appends it to a short stem
(hoping -> hope); `compat` measures the stem without its last two letters, and puts the 'e' in their place (hoping -> hop,
entering -> ent). Rules are tables; a word's shape is a string of c and v.
"""

from __future__ import annotations

import re

# Fixed values: (suffix, replacement) in order of trial; the first suffix that fits decides.
DOUBLE_SUFFIXES = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"),
    ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"),
    ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"),
    ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("logi", "log"),
]
FURTHER_SUFFIXES = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
LAST_SUFFIXES = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "sion", "tion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def shape(word: str) -> str:
    """c or v for each letter; y is a vowel after a consonant."""
    out = []
    for i, ch in enumerate(word):
        vowel = ch in "aeiou" or (ch == "y" and i > 0 and out[-1] == "c")
        out.append("v" if vowel else "c")
    return "".join(out)


def measure(stem: str) -> int:
    """How many times a vowel run is followed by a consonant run."""
    return len(re.findall("v+c+", shape(stem)))


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and shape(word)[-1] == "c"


def _short_end(word: str) -> bool:
    """consonant, vowel, consonant other than w, x, y at the end."""
    return len(word) > 2 and shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _replace(word: str, rules: list[tuple[str, str]], least: int = 0) -> str:
    for suffix, new in rules:
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            return stem + new if measure(stem) > least else word
    return word


def _plural_and_past(w: str, compat: bool) -> str:
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        return w[:-1] if measure(w[:-3]) > 0 else w
    ending = next((e for e in ("ed", "ing") if w.endswith(e)), None)
    if ending is None or "v" not in shape(w[: -len(ending)]):
        return w
    w = w[: -len(ending)]
    for cut in ("at", "bl", "iz"):
        if w.endswith(cut):
            return w + "e"
    if _double(w):
        return w if w[-1] in "lsz" else w[:-1]
    if compat:
        return w[:-2] + "e" if measure(w[:-2]) == 1 and _short_end(w) else w
    return w + "e" if measure(w) == 1 and _short_end(w) else w


def _strip_last(w: str) -> str:
    for suffix in LAST_SUFFIXES:
        if w.endswith(suffix):
            keep = 1 if suffix in ("sion", "tion") else 0  # the s or t before -ion stays
            stem = w[: len(w) - len(suffix) + keep]
            return stem if measure(stem) > 1 else w
    return w


def _tidy(w: str) -> str:
    m = measure(w)
    out = w
    if w.endswith("e") and (m > 1 or (m == 1 and not _short_end(w[:-1]))):
        out = w[:-1]
    if out.endswith("l") and _double(out) and m > 1:
        out = out[:-1]
    return out


def stem(word: str, compat: bool = True) -> str:
    """The stem; words of one or two letters stay."""
    if len(word) < 3:
        return word
    w = _plural_and_past(word, compat)
    if w.endswith("y") and "v" in shape(w[:-1]):
        w = w[:-1] + "i"
    w = _replace(w, DOUBLE_SUFFIXES)
    w = _replace(w, FURTHER_SUFFIXES)
    w = _strip_last(w)
    return _tidy(w)
