"""The Snowball English stemmer (Porter2), after its published description."""

from __future__ import annotations

import re
from functools import lru_cache

# Fixed values of the algorithm.
_WHOLE = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
_KEPT = {"sky", "news", "howe", "atlas", "cosmos", "bias", "andes"}
_KEPT_AFTER_PLURAL = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_PREFIXES = ("gener", "commun", "arsen")
_STEP2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al",
    "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
_STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
_STEP4 = {s: "" for s in "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split()}
#: Words of English search without meaning.
STOP_WORDS = frozenset(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself
    they them their theirs themselves what which who whom this that these those am is are was were be been being have has had
    having do does did doing a an the and but if or because as until while of at by for with about against between into through
    during before after above below to from up down in out on off over under again further then once here there when where why how
    all any both each few more most other some such no nor not only own same so than too very s t can will just don should now""".split()
)

_REGION = re.compile("[aeiouy][^aeiouy]")
_SHORT_END = re.compile("(?:^|.*[^aeiouy])[aeiouy][^aeiouywxY]$|^[aeiouy][^aeiouy]$", re.DOTALL)
_VOWEL = re.compile("[aeiouy]")
_CONSONANT_Y = re.compile("(^|[aeiouy])y")
#: The last two letters of each step's endings (one step has the ending "li", so that no ending is shorter): most words have no other look.
_LAST2, _LAST3, _LAST4 = (frozenset(e[-2:] for e in endings) for endings in (_STEP2, _STEP3, _STEP4))


def _after(word: str, start: int) -> int:
    """Where the region after the first consonant that follows a vowel begins, from ``start``."""
    found = _REGION.search(word, start)
    return found.end() if found else len(word)


def _longest(word: str, endings: dict[str, str]) -> str | None:
    for n in range(min(7, len(word)), 1, -1):
        if word[-n:] in endings:
            return word[-n:]
    return None


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """The stem of a lower-case word."""
    if len(word) <= 2 or word in _KEPT:
        return word
    if word in _WHOLE:
        return _WHOLE[word]
    word = word.removeprefix("'")
    if "y" in word:
        word = _CONSONANT_Y.sub(r"\1Y", word)
    prefix = next(p for p in _PREFIXES if word.startswith(p)) if word.startswith(_PREFIXES) else None
    r1 = len(prefix) if prefix else _after(word, 0)
    r2 = _after(word, r1)

    if "'" in word:
        for ending in ("'s'", "'s", "'"):
            if word.endswith(ending):
                word = word[: -len(ending)]
                break

    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and _VOWEL.search(word[:-2]):
        word = word[:-1]
    if word in _KEPT_AFTER_PLURAL:
        return word

    ending = next((e for e in ("eedly", "ingly", "edly", "eed", "ing", "ed") if word.endswith(e)), "") if word.endswith(("ed", "ing", "edly", "ingly")) else ""
    left = word[: len(word) - len(ending)]
    if ending in ("eed", "eedly"):
        word = left + "ee" if len(left) >= r1 else word
    elif ending and _VOWEL.search(left):
        word = left
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif word.endswith(("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")):
            word = word[:-1]
        elif len(word) <= r1 and _SHORT_END.match(word):
            word += "e"

    if len(word) > 2 and word[-1] in "yY" and word[-2] not in "aeiouy":
        word = word[:-1] + "i"

    ending = _longest(word, _STEP2) if word[-2:] in _LAST2 else None
    if ending and len(word) - len(ending) >= r1:
        left = word[: len(word) - len(ending)]
        if (ending != "ogi" or left.endswith("l")) and (ending != "li" or left[-1:] in tuple("cdeghkmnrt")):
            word = left + _STEP2[ending]

    ending = _longest(word, _STEP3) if word[-2:] in _LAST3 else None
    if ending and len(word) - len(ending) >= (r2 if ending == "ative" else r1):
        word = word[: len(word) - len(ending)] + _STEP3[ending]

    ending = _longest(word, _STEP4) if word[-2:] in _LAST4 else None
    if ending and len(word) - len(ending) >= r2 and (ending != "ion" or word[-4:-3] in ("s", "t")):
        word = word[: len(word) - len(ending)]

    if word.endswith("e") and (len(word) - 1 >= r2 or (len(word) - 1 >= r1 and not _SHORT_END.match(word[:-1]))):
        word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.replace("Y", "y")
