"""The Porter stemmer, after M. F. Porter, "An algorithm for suffix stripping", 1980."""

from __future__ import annotations

from functools import lru_cache

#: Shorter and longer tokens, in bytes, are left alone.
SHORTEST, LONGEST = 3, 64

#: Suffixes and what replaces them, by step of the algorithm.
STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "logi": "log", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = "al ance ence er ic able ible ant ement ment ent sion tion ou ism ate iti ous ive ize".split()


def _kinds(word: str) -> str:
    """v or c for each letter; y is a vowel after a consonant."""
    out = ""
    for c in word:
        out += "v" if c in "aeiou" or (c == "y" and out[-1:] == "c") else "c"
    return out


def _measure(word: str) -> int:
    return _kinds(word).count("vc")


def _cvc(word: str) -> bool:
    return _kinds(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _replaced(word: str, rules: dict[str, str]) -> str:
    for suffix in sorted(rules, key=len, reverse=True):
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            return stem + rules[suffix] if _measure(stem) > 0 else word
    return word


@lru_cache(maxsize=1 << 17)
def stem(word: str) -> str:
    if not SHORTEST <= len(word.encode()) <= LONGEST:
        return word
    if word.endswith("s"):  # 1a
        word = word[:-2] if word.endswith(("sses", "ies")) else word if word.endswith("ss") else word[:-1]
    if word.endswith("eed"):  # 1b
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        for suffix in ("ed", "ing"):
            base = word[: -len(suffix)]
            if word.endswith(suffix):
                if "v" in _kinds(base):
                    if base.endswith(("at", "bl", "iz")):
                        word = base + "e"
                    elif base[-2:-1] == base[-1:] and _kinds(base)[-1] == "c" and base[-1] not in "lsz":
                        word = base[:-1]
                    else:
                        word = base + "e" if _measure(base) == 1 and _cvc(base) else base
                break
    if word.endswith("y") and "v" in _kinds(word[:-1]):  # 1c
        word = word[:-1] + "i"
    word = _replaced(_replaced(word, STEP2), STEP3)
    for suffix in sorted(STEP4, key=len, reverse=True):  # 4
        if word.endswith(suffix):
            base = word[: -len(suffix)] + ("s" if suffix == "sion" else "t" if suffix == "tion" else "")
            word = base if _measure(base) > 1 else word
            break
    if word.endswith("e"):  # 5
        base = word[:-1]
        if _measure(base) > 1 or (_measure(base) == 1 and not _cvc(base)):
            word = base
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word
