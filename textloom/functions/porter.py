"""The Porter stemmer (1980), in its author's later variant: words of two letters stay, `logi` and `bli` endings, and no lower-casing."""

from __future__ import annotations

import re

STEP_2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("logi", "log")]
STEP_3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]
VOWELS = "aeiou"


def shape(word: str) -> str:
    """c or v for each letter; y is a vowel after a consonant."""
    out = ""
    for ch in word:
        out += "v" if ch in VOWELS or ch == "y" and out[-1:] == "c" else "c"
    return out


def measure(stem: str) -> int:
    """How often a run of vowels is followed by consonants."""
    return len(re.findall("v+c+", shape(stem)))


def ends_short(stem: str) -> bool:
    return shape(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


def double_consonant(stem: str) -> bool:
    return len(stem) > 1 and stem[-1] == stem[-2] and shape(stem)[-1] == "c"


def longest(word: str, rules: list) -> tuple[str, str] | None:
    """(stem, replacement) of the longest suffix that fits."""
    found = [(len(s), s, r) for s, r in rules if word.endswith(s)]
    if not found:
        return None
    n, _, r = max(found)
    return word[:-n], r


def stem(word: str) -> str:
    if len(word) <= 2:
        return word
    w = word
    # 1a plurals
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    # 1b past and progressive
    if w.endswith("eed"):
        w = w[:-1] if measure(w[:-3]) > 0 else w
    else:
        for suffix in ("ed", "ing"):
            if w.endswith(suffix):
                base = w[: -len(suffix)]
                if "v" in shape(base):
                    if base.endswith(("at", "bl", "iz")):
                        w = base + "e"
                    elif double_consonant(base) and base[-1] not in "lsz":
                        w = base[:-1]
                    else:
                        w = base + "e" if measure(base) == 1 and ends_short(base) else base
                break
    # 1c y
    if w.endswith("y") and "v" in shape(w[:-1]):
        w = w[:-1] + "i"
    for rules in (STEP_2, STEP_3):
        if hit := longest(w, rules):
            w = hit[0] + hit[1] if measure(hit[0]) > 0 else w
    if hit := longest(w, [(s, s) for s in STEP_4]):
        base, suffix = hit
        if measure(base) > 1 and (suffix != "ion" or base[-1:] in ("s", "t") and base):
            w = base
    # 5 final e and double l
    if w.endswith("e"):
        base = w[:-1]
        if measure(base) > 1 or measure(base) == 1 and not ends_short(base):
            w = base
    if w.endswith("ll") and measure(w) > 1:
        w = w[:-1]
    return w
