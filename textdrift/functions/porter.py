"""Porter stemmer (M. F. Porter, "An algorithm for suffix stripping", 1980).

A small per-word helper.  The library applies it to each *distinct* token
once (``mapInPandas`` over the vocabulary) and joins the stems back, or
inside the per-pair METEOR helper with a cache.
"""

from __future__ import annotations

from functools import lru_cache

_VOWELS = frozenset("aeiou")


def _is_cons(w: str, i: int) -> bool:
    ch = w[i]
    if ch in _VOWELS:
        return False
    if ch == "y":
        return i == 0 or not _is_cons(w, i - 1)
    return True


def _measure(stem: str) -> int:
    """m in [C](VC)^m[V]."""
    m, i, n = 0, 0, len(stem)
    while i < n and _is_cons(stem, i):
        i += 1
    while i < n:
        while i < n and not _is_cons(stem, i):
            i += 1
        if i >= n:
            break
        while i < n and _is_cons(stem, i):
            i += 1
        m += 1
    return m


def _has_vowel(stem: str) -> bool:
    return any(not _is_cons(stem, i) for i in range(len(stem)))


def _double_cons(w: str) -> bool:
    return len(w) >= 2 and w[-1] == w[-2] and _is_cons(w, len(w) - 1)


def _cvc(w: str) -> bool:
    if len(w) < 3:
        return False
    return (_is_cons(w, len(w) - 3) and not _is_cons(w, len(w) - 2)
            and _is_cons(w, len(w) - 1) and w[-1] not in "wxy")


# Suffix rules of steps 2, 3 and 4 of the published algorithm,
# in the paper's order (longest alternatives first where they overlap).
STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"),
         ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"),
         ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"),
         ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"),
         ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")]
STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"),
         ("ful", ""), ("ness", "")]
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent",
         "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _longest(word: str, suffixes):
    best = None
    for s in suffixes:
        key = s[0] if isinstance(s, tuple) else s
        if word.endswith(key) and (best is None or len(key) > len(best[0] if isinstance(best, tuple) else best)):
            best = s
    return best


def _step1ab(w: str) -> str:
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("ss"):
        pass
    elif w.endswith("s"):
        w = w[:-1]
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
        return w
    for suf in ("ed", "ing"):
        if w.endswith(suf) and _has_vowel(w[:-len(suf)]):
            w = w[:-len(suf)]
            if w.endswith(("at", "bl", "iz")):
                return w + "e"
            if _double_cons(w) and w[-1] not in "lsz":
                return w[:-1]
            if _measure(w) == 1 and _cvc(w):
                return w + "e"
            return w
    return w


def _step1c(w: str) -> str:
    if w.endswith("y") and _has_vowel(w[:-1]):
        return w[:-1] + "i"
    return w


def _replace(w: str, rules, min_m: int) -> str:
    rule = _longest(w, rules)
    if rule is None:
        return w
    suf, rep = rule
    stem = w[:-len(suf)]
    return stem + rep if _measure(stem) > min_m else w


def _step4(w: str) -> str:
    suf = _longest(w, STEP4)
    if suf is None:
        return w
    stem = w[:-len(suf)]
    if _measure(stem) <= 1:
        return w
    if suf == "ion" and not (stem.endswith("s") or stem.endswith("t")):
        return w
    return stem


def _step5(w: str) -> str:
    if w.endswith("e"):
        stem = w[:-1]
        m = _measure(stem)
        if m > 1 or (m == 1 and not _cvc(stem)):
            w = stem
    if _measure(w) > 1 and _double_cons(w) and w.endswith("l"):
        w = w[:-1]
    return w


@lru_cache(maxsize=1 << 16)
def stem(word: str) -> str:
    """Porter stem of a lower-case word; words of up to 2 letters unchanged."""
    if len(word) <= 2:
        return word
    w = _step1ab(word)
    w = _step1c(w)
    w = _replace(w, STEP2, 0)
    w = _replace(w, STEP3, 0)
    w = _step4(w)
    return _step5(w)
