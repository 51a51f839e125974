"""Porter's stemmer (1980), for distinct terms."""

from __future__ import annotations

import re

_C, _V = "[^aeiou](?:[^aeiouy])*", "[aeiouy](?:[aeiou])*"
_M0 = re.compile(f"^(?:{_C})?{_V}{_C}")
_M1 = re.compile(f"^(?:{_C})?{_V}{_C}(?:{_V})?$")
_M2 = re.compile(f"^(?:{_C})?{_V}{_C}{_V}{_C}")
_HAS_VOWEL = re.compile(f"^(?:{_C})?{_V[:-len('(?:[aeiou])*')]}")
_CVC = re.compile(f"^{_C}[aeiouy][^aeiouwxy]$")
_STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("logi", "log")]
_STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
_STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]
_TABLES = [sorted(t, key=lambda x: -len(x[0])) for t in (_STEP2, _STEP3)]
_ENDS = [tuple(end for end, _ in t) for t in _TABLES]
_STEP4 = sorted([*_STEP4, "ion"], key=len, reverse=True)
_ENDS4 = tuple(_STEP4)


def stem(word: str) -> str:
    """The stem of a lower-case ASCII word; any other word as it is."""
    w = word
    if len(w) < 3 or not (w.isascii() and w.isalpha()):
        return w
    if w[0] == "y":
        w = "Y" + w[1:]
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if _M0.match(w[:-3]):
            w = w[:-1]
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and _HAS_VOWEL.match(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif re.search(r"([^aeiouylsz])\1$", w):
                    w = w[:-1]
                elif _CVC.match(w):
                    w += "e"
                break
    if w.endswith("y") and _HAS_VOWEL.match(w[:-1]):
        w = w[:-1] + "i"
    for table, ends in zip(_TABLES, _ENDS, strict=True):
        for end, new in table if w.endswith(ends) else ():
            if w.endswith(end):
                if _M0.match(w[: -len(end)]):
                    w = w[: -len(end)] + new
                break
    for end in _STEP4 if w.endswith(_ENDS4) else ():
        if w.endswith(end):
            base = w[: -len(end)]
            if _M2.match(base) and (end != "ion" or base.endswith(("s", "t"))):
                w = base
            break
    if w.endswith("e"):
        base = w[:-1]
        if _M2.match(base) or (_M1.match(base) and not _CVC.match(base)):
            w = base
    if w.endswith("ll") and _M2.match(w):
        w = w[:-1]
    return w.lower()
