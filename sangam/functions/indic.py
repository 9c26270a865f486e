"""Roman schemes and Devanagari, both ways, by the published tables of the schemes.

A consonant followed by a vowel takes its sign (none for a); followed by anything else, or by the word's end, it takes a
virama. A vowel that follows no consonant is written as a letter. No inherent vowel is dropped.
"""

import unicodedata
from difflib import SequenceMatcher
from functools import lru_cache

# Vowel letters and signs, by the name of the sound.
VOWELS = {"a": ("अ", ""), "aa": ("आ", "ा"), "i": ("इ", "ि"), "ii": ("ई", "ी"), "u": ("उ", "ु"), "uu": ("ऊ", "ू"), "ri": ("ऋ", "ृ"), "e": ("ए", "े"), "ai": ("ऐ", "ै"), "o": ("ओ", "ो"), "au": ("औ", "ौ")}
CONSONANTS = dict(zip("k kh g gh ng c ch j jh ny tt tth dd ddh nn t th d dh n p ph b bh m y r l v sh ss s h q kx gx z f rr rrh".split(), "क ख ग घ ङ च छ ज झ ञ ट ठ ड ढ ण त थ द ध न प फ ब भ म य र ल व श ष स ह क़ ख़ ग़ ज़ फ़ ड़ ढ़".split()))
SIGNS = {"m": "ं", "h": "ः", "n": "ँ"}
VIRAMA = "्"

# Each scheme's spellings of the sounds, the first one being written, all being read.
_COMMON = {"k": "k", "kh": "kh", "g": "g", "gh": "gh", "j": "j", "jh": "jh", "t": "t", "th": "th", "d": "d", "dh": "dh", "n": "n", "p": "p", "ph": "ph", "b": "b", "bh": "bh", "m": "m", "y": "y", "r": "r", "l": "l", "v": "v", "s": "s", "h": "h"}
SCHEMES = {
    "itrans": {
        "vowels": {"a": "a", "aa": "A aa", "i": "i", "ii": "I ii ee", "u": "u", "uu": "U uu oo", "ri": "RRi R^i", "e": "e", "ai": "ai", "o": "o", "au": "au"},
        "consonants": _COMMON | {"v": "v w", "ng": "~N N^", "c": "ch c", "ch": "Ch chh", "ny": "~n JN", "tt": "T", "tth": "Th", "dd": "D", "ddh": "Dh", "nn": "N", "sh": "sh", "ss": "Sh shh", "q": "q", "kx": "K", "gx": "G", "z": "z J", "f": "f", "rr": ".D", "rrh": ".Dh"},
        "signs": {"m": "M .n", "h": "H", "n": ".N"},
    },
    "hk": {
        "vowels": {"a": "a", "aa": "A", "i": "i", "ii": "I", "u": "u", "uu": "U", "ri": "R", "e": "e", "ai": "ai", "o": "o", "au": "au"},
        "consonants": _COMMON | {"ng": "G", "c": "c", "ch": "ch", "ny": "J", "tt": "T", "tth": "Th", "dd": "D", "ddh": "Dh", "nn": "N", "sh": "z", "ss": "S"},
        "signs": {"m": "M", "h": "H", "n": "~"},
    },
    "iast": {
        "vowels": {"a": "a", "aa": "ā", "i": "i", "ii": "ī", "u": "u", "uu": "ū", "ri": "ṛ", "e": "e", "ai": "ai", "o": "o", "au": "au"},
        "consonants": _COMMON | {"ng": "ṅ", "c": "c", "ch": "ch", "ny": "ñ", "tt": "ṭ", "tth": "ṭh", "dd": "ḍ", "ddh": "ḍh", "nn": "ṇ", "sh": "ś", "ss": "ṣ"},
        "signs": {"m": "ṃ", "h": "ḥ", "n": "m̐"},
    },
    "slp1": {
        "vowels": {"a": "a", "aa": "A", "i": "i", "ii": "I", "u": "u", "uu": "U", "ri": "f", "e": "e", "ai": "E", "o": "o", "au": "O"},
        "consonants": {"k": "k", "kh": "K", "g": "g", "gh": "G", "ng": "N", "c": "c", "ch": "C", "j": "j", "jh": "J", "ny": "Y", "tt": "w", "tth": "W", "dd": "q", "ddh": "Q", "nn": "R", "t": "t", "th": "T", "d": "d", "dh": "D", "n": "n", "p": "p", "ph": "P", "b": "b", "bh": "B", "m": "m", "y": "y", "r": "r", "l": "l", "v": "v", "sh": "S", "ss": "z", "s": "s", "h": "h"},
        "signs": {"m": "M", "h": "H", "n": "~"},
    },
}


def _readings(scheme: str) -> tuple[dict[str, tuple[str, str]], int]:
    t = SCHEMES[scheme]
    out = {sp: (kind, sound) for kind in ("vowels", "consonants", "signs") for sound, sps in t[kind].items() for sp in sps.split()}
    return out, max(map(len, out))


_READ = {s: _readings(s) for s in SCHEMES}
_BACK = {s: {**{l: t["vowels"][k].split()[0] for k, (l, _) in VOWELS.items()}, **{CONSONANTS[k]: v.split()[0] for k, v in t["consonants"].items()}} for s, t in SCHEMES.items()}
_BACK_SIGN = {s: {sign: t["vowels"][k].split()[0] for k, (_, sign) in VOWELS.items() if sign} for s, t in SCHEMES.items()}
_BACK_MARK = {s: {SIGNS[k]: v.split()[0] for k, v in t["signs"].items()} for s, t in SCHEMES.items()}


@lru_cache(maxsize=100_000)
def to_devanagari(word: str, scheme: str = "itrans") -> str:
    read, longest = _READ[scheme]
    out, open_consonant, i = [], False, 0
    while i < len(word):
        for n in range(min(longest, len(word) - i), 0, -1):
            if (hit := read.get(word[i : i + n])) is not None:
                break
        else:
            hit, n = ("other", word[i]), 1
        kind, sound = hit
        if kind == "vowels":
            out.append(VOWELS[sound][1 if open_consonant else 0])
            open_consonant = False
        else:
            if open_consonant:
                out.append(VIRAMA)
            out.append(CONSONANTS[sound] if kind == "consonants" else SIGNS[sound] if kind == "signs" else sound)
            open_consonant = kind == "consonants"
        i += n
    if open_consonant:
        out.append(VIRAMA)
    return "".join(out)


@lru_cache(maxsize=100_000)
def to_roman(word: str, scheme: str = "itrans") -> str:
    letters, signs, marks = _BACK[scheme], _BACK_SIGN[scheme], _BACK_MARK[scheme]
    consonants = set(CONSONANTS.values())
    # letters with a dot stand composed in the tables
    word = unicodedata.normalize("NFC", word)
    for plain in ("क़", "ख़", "ग़", "ज़", "फ़", "ड़", "ढ़"):
        word = word.replace(unicodedata.normalize("NFD", plain), plain)
    out, i = [], 0
    while i < len(word):
        c = word[i]
        if i + 1 < len(word) and word[i + 1] == "़" and c + "़" in letters:
            c, i = c + "़", i + 1
        if c in consonants:
            out.append(letters.get(c, c))
            after = word[i + 1] if i + 1 < len(word) else ""
            if after == VIRAMA:
                i += 1
            elif after in signs:
                out.append(signs[after])
                i += 1
            else:
                out.append("a")
        else:
            out.append(letters.get(c) or marks.get(c) or signs.get(c) or c)
        i += 1
    return "".join(out)


def similarity(a: str, b: str) -> float:
    """Ratio of matching characters, case apart; 1 for two empty words, 0 for one."""
    if not a or not b:
        return float(a == b)
    return SequenceMatcher(None, a.lower(), b.lower()).ratio()


def detect_scheme(word: str) -> str:
    """The scheme that a word's letters give away, in this order."""
    if any(c in "āīūṭḍṇśṣṃḥṅñṛ" for c in word):
        return "iast"
    if any(c in "TKGCJDNPBMYRLVSZH" for c in word):
        return "hk"
    return "slp1" if any("A" <= c <= "Z" and c not in "AEIO" for c in word) else "itrans"


def simplify_roman(text: str, keep_scheme: bool = False) -> str:
    """Without diacritics, lower case, and (unless keep_scheme) with everyday spellings of clusters."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", text) if unicodedata.category(c) != "Mn").lower()
    return plain if keep_scheme else plain.replace("shh", "sh").replace("jn", "gya")


def levenshtein(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
    return row[-1]
