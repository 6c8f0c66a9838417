"""English stems by the published Porter2 algorithm, for words of lower-case letters and digits."""

from __future__ import annotations

import re

# Words that the algorithm's rules would spoil.
WHOLE = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli",
    "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
AFTER_PLURAL = frozenset("inning outing canning herring earring proceed exceed succeed".split())
STEP2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al",
    "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP4 = dict.fromkeys("al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split(), "")
LI_ENDS = "cdeghkmnrt"

_REGION = re.compile(r"[aeiouy][^aeiouy]")
_SHORT = re.compile(r"(?:(?<![aeiouy])(?<!^)[aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$")
_VOWEL = re.compile("[aeiouy]")


def _longest(word: str, rules: dict[str, str]) -> str | None:
    return max((s for s in rules if word.endswith(s)), key=len, default=None)


def _past(word: str, r1: int) -> str:
    for end in ("eedly", "eed"):
        if word.endswith(end):
            return word[: -len(end)] + "ee" if len(word) - len(end) >= r1 else word
    for end in ("ingly", "edly", "ing", "ed"):
        if word.endswith(end):
            base = word[: -len(end)]
            if not _VOWEL.search(base):
                return word
            if base.endswith(("at", "bl", "iz")):
                return base + "e"
            if len(base) > 1 and base[-1] == base[-2] and base[-1] in "bdfgmnprt":
                return base[:-1]
            return base + "e" if len(base) <= r1 and _SHORT.search(base) else base
    return word


def stem(word: str) -> str:
    """The stem of one word; words of two letters or fewer stay."""
    if word in WHOLE:
        return WHOLE[word]
    if len(word) <= 2:
        return word
    word = re.sub(r"(?:^|(?<=[aeiouy]))y", "Y", word)

    def region(at: int) -> int:
        m = _REGION.search(word, at)
        return m.end() if m else len(word)

    start = next((len(p) for p in ("gener", "commun", "arsen") if word.startswith(p)), None)
    r1 = region(0) if start is None else start
    r2 = region(r1)
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and _VOWEL.search(word[:-2]):
        word = word[:-1]
    if word in AFTER_PLURAL:
        return word
    word = _past(word, r1)
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in "aeiouy":
        word = word[:-1] + "i"
    end = _longest(word, STEP2)
    if end and len(word) - len(end) >= r1 and (end != "ogi" or word[-4:-3] == "l") and (end != "li" or word[-3:-2] in LI_ENDS):
        word = word[: -len(end)] + STEP2[end]
    end = _longest(word, STEP3)
    if end and len(word) - len(end) >= (r2 if end == "ative" else r1):
        word = word[: -len(end)] + STEP3[end]
    end = _longest(word, STEP4)
    if end and len(word) - len(end) >= r2 and (end != "ion" or word[-4:-3] in ("s", "t")):
        word = word[: -len(end)]
    elif word.endswith("e") and (len(word) > r2 or (len(word) > r1 and not _SHORT.search(word[:-1]))):
        word = word[:-1]
    elif word.endswith("ll") and len(word) > r2:
        word = word[:-1]
    return word.replace("Y", "y")
