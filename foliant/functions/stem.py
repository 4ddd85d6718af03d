"""Snowball stemmers, written from the published descriptions of the English (Porter2) and Russian algorithms.

They run once for each distinct term: tokens are joined to a stemmed vocabulary, never stemmed one by one.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_VOWELS = "aeiouy"
_DOUBLE = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_EXCEPTIONS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli",
    "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos",
    "bias": "bias", "andes": "andes",
}
_PREFIXES = ("gener", "commun", "arsen", "past", "univers", "later", "emerg", "organ", "inter")
_AFTER_1A = {"evening", "inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize",
    "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous",
    "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "ogist": "og", "fulli": "ful", "lessli": "less", "li": "",
}
_STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")


def _region(word: str, start: int, vowels: str) -> int:
    """Where the part after the first non-vowel that follows a vowel begins."""
    after = False
    for i in range(start, len(word)):
        vowel = word[i] in vowels
        if after and not vowel:
            return i + 1
        after = vowel
    return len(word)


def _longest(word: str, endings) -> str | None:
    if not word.endswith(tuple(endings)):  # most words: one call instead of one an ending
        return None
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


def _short_syllable(word: str) -> bool:
    if len(word) == 2:
        return word[0] in _VOWELS and word[1] not in _VOWELS
    return len(word) > 2 and word[-3] not in _VOWELS and word[-2] in _VOWELS and word[-1] not in _VOWELS + "wxY"


@lru_cache(maxsize=1 << 15)
def english(word: str) -> str:
    if len(word) <= 2:
        return word
    word = word.replace("’", "'").replace("‘", "'").removeprefix("'")
    if word in _EXCEPTIONS:
        return _EXCEPTIONS[word]
    if "y" in word:
        word = re.sub("(^|[aeiouy])y", r"\1Y", word)
    start = next((len(p) for p in _PREFIXES if word.startswith(p)), None) if word.startswith(_PREFIXES) else None
    r1 = start if start is not None else _region(word, 0, _VOWELS)
    r2 = _region(word, r1, _VOWELS)
    for e in ("'s'", "'s", "'") if "'" in word else ():
        if word.endswith(e):
            word = word[: -len(e)]
            break
    # 1a
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and any(c in _VOWELS for c in word[:-2]):
        word = word[:-1]
    if word in _AFTER_1A:
        return word.lower()
    # 1b
    e = _longest(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if e in ("eed", "eedly"):
        if len(word) - len(e) >= r1:
            word = word[: -len(e)] + "ee"
    elif e and any(c in _VOWELS for c in word[: -len(e)]):
        word = word[: -len(e)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif word.endswith(_DOUBLE):
            word = word if len(word) == 3 and word[0] in "aeo" else word[:-1]
        elif r1 >= len(word) and _short_syllable(word):
            word += "e"
    # 1c
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in _VOWELS:
        word = word[:-1] + "i"
    # 2
    e = _longest(word, _STEP2)
    if e and len(word) - len(e) >= r1:
        before = word[: -len(e)]
        if e == "ogi":
            word = before + "og" if before.endswith("l") else word
        elif e == "li":
            word = before if before and before[-1] in "cdeghkmnrt" else word
        else:
            word = before + _STEP2[e]
    # 3
    e = _longest(word, _STEP3)
    if e and len(word) - len(e) >= r1:
        if e == "ative":
            word = word[:-5] if len(word) - 5 >= r2 else word
        else:
            word = word[: -len(e)] + _STEP3[e]
    # 4
    e = _longest(word, _STEP4)
    if e and len(word) - len(e) >= r2 and (e != "ion" or word[-4:-3] in ("s", "t")):
        word = word[: -len(e)]
    # 5
    if word.endswith("e"):
        if len(word) - 1 >= r2 or len(word) - 1 >= r1 and not _short_syllable(word[:-1]):
            word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.lower()


_RU_VOWELS = "аеиоуыэюя"
_GERUND1, _GERUND2 = ("в", "вши", "вшись"), ("ив", "ивши", "ившись", "ыв", "ывши", "ывшись")
_ADJECTIVE = "ее ие ые ое ими ыми ей ий ый ой ем им ым ом его ого ему ому их ых ую юю ая яя ою ею".split()
_PARTICIPLE1, _PARTICIPLE2 = "ем нн вш ющ щ".split(), "ивш ывш ующ".split()
_VERB1 = "ла на ете йте ли й л ем н ло но ет ют ны ть ешь нно".split()
_VERB2 = "ила ыла ена ейте уйте ите или ыли ей уй ил ыл им ым ен ило ыло ено ят ует уют ит ыт ены ить ыть ишь ую ю".split()
_NOUN = "а ев ов ие ье е иями ями ами еи ии и ией ей ой ий й иям ям ием ем ам ом о у ах иях ях ы ь ию ью ю ия ья я".split()


def _ending(word: str, rv: int, plain, after_a=()) -> str | None:
    """The longest ending inside RV; those of the second group only after а or я."""
    best = _longest(word[rv:], plain)
    for e in after_a:
        if word[rv:].endswith(e) and len(word) - len(e) > rv and word[: -len(e)][-1] in "ая" and (best is None or len(e) > len(best)):
            best = e
    return best


@lru_cache(maxsize=200_000)
def russian(word: str) -> str:
    word = word.replace("ё", "е")
    rv = next((i + 1 for i, c in enumerate(word) if c in _RU_VOWELS), len(word))
    r2 = _region(word, _region(word, 0, _RU_VOWELS), _RU_VOWELS)

    def drop(e: str | None) -> bool:
        nonlocal word
        if e:
            word = word[: -len(e)]
        return bool(e)

    if not drop(_ending(word, rv, _GERUND2, _GERUND1)):
        drop(_ending(word, rv, ("ся", "сь")))
        if drop(_ending(word, rv, _ADJECTIVE)):
            drop(_ending(word, rv, _PARTICIPLE2, _PARTICIPLE1))
        elif not drop(_ending(word, rv, _VERB2, _VERB1)):
            drop(_ending(word, rv, _NOUN))
    drop(_ending(word, rv, ("и",)))
    e = _longest(word, ("ост", "ость"))
    if e and len(word) - len(e) >= r2:
        drop(e)
    if word[rv:].endswith("нн"):
        word = word[:-1]
    elif drop(_ending(word, rv, ("ейш", "ейше"))):
        if word[rv:].endswith("нн"):
            word = word[:-1]
    else:
        drop(_ending(word, rv, ("ь",)))
    return word


_CYRILLIC, _LATIN = re.compile("[Ѐ-ӿ]").search, re.compile("[a-z]").search


def stem(word: str) -> str:
    """By the word's own script: Cyrillic if it holds such a letter, else Latin if it holds an ASCII letter, else as it is."""
    if _CYRILLIC(word):
        return russian(word)
    if _LATIN(word):
        return english(word)
    return word


@F.pandas_udf(T.StringType())
def stem_udf(words: pd.Series) -> pd.Series:
    return words.map(stem)
