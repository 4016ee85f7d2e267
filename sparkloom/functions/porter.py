"""The English Porter2 stemmer."""

from __future__ import annotations

import functools
import re

# The stemmer's published lists of letters, endings and exceptions.
VOWELS, DOUBLES, LI = "aeiouy", ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt"), "cdeghkmnrt"
EXCEPTIONS = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes"}
KEPT_AFTER_S = frozenset("inning outing canning herring earring proceed exceed succeed".split())
STEP2 = (("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", ""))
STEP3 = (("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", ""))
STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")
_REGION = re.compile(r"[aeiouy][^aeiouy]")


def _after(word: str, start: int) -> int:
    """Where the region after the first vowel and consonant from start begins."""
    found = _REGION.search(word, start)
    return found.end() if found else len(word)


def _short_end(word: str) -> bool:
    """Whether a word ends in a short syllable."""
    if len(word) == 2:
        return word[0] in VOWELS and word[1] not in VOWELS
    return len(word) > 2 and word[-3] not in VOWELS and word[-2] in VOWELS and word[-1] not in VOWELS + "wxY"


@functools.lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    """The stem of a lower-case word."""
    if len(word) < 3:
        return word
    if word in EXCEPTIONS:
        return EXCEPTIONS[word]
    word = word.lstrip("'")
    word = re.sub(r"(?:^|(?<=[aeiouy]))y", "Y", word)
    one = next((len(x) for x in ("gener", "commun", "arsen") if word.startswith(x)), None) or _after(word, 0)
    two = _after(word, one)
    word = next((word[: -len(x)] for x in ("'s'", "'s", "'") if word.endswith(x)), word)
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and any(c in VOWELS for c in word[:-2]):
        word = word[:-1]
    if word in KEPT_AFTER_S:
        return word
    end = next((x for x in ("eedly", "ingly", "edly", "eed", "ing", "ed") if word.endswith(x)), "")
    if end in ("eed", "eedly"):
        word = word[: -len(end)] + "ee" if len(word) - len(end) >= one else word
    elif end and any(c in VOWELS for c in word[: -len(end)]):
        word = word[: -len(end)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif word.endswith(DOUBLES):
            word = word[:-1]
        elif one >= len(word) and _short_end(word):
            word += "e"
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in VOWELS:
        word = word[:-1] + "i"
    for end, new in STEP2:
        if word.endswith(end):
            fits = {"ogi": word[-4:-3] == "l", "li": word[-3:-2] in tuple(LI)}.get(end, True)
            if len(word) - len(end) >= one and fits:
                word = word[: -len(end)] + new
            break
    for end, new in STEP3:
        if word.endswith(end):
            if len(word) - len(end) >= (two if end == "ative" else one):
                word = word[: -len(end)] + new
            break
    for end in STEP4:
        if word.endswith(end):
            if len(word) - len(end) >= two and (end != "ion" or word[-4:-3] in ("s", "t")):
                word = word[: -len(end)]
            break
    if word.endswith("e"):
        if len(word) - 1 >= two or (len(word) - 1 >= one and not _short_end(word[:-1])):
            word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= two:
        word = word[:-1]
    return word.replace("Y", "y")
