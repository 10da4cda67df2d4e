"""Snowball stemmers for English and Spanish, from the published algorithm descriptions."""

from __future__ import annotations

# Fixed values of the published algorithms.
EN_EXCEPTIONS = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes"}
EN_KEPT = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
EN_STEP2 = {"tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": ""}
EN_STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
EN_STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion"]
ES_PRONOUNS = ["me", "se", "sela", "selo", "selas", "selos", "la", "le", "lo", "las", "les", "los", "nos"]
ES_DELETE = ["anza", "anzas", "ico", "ica", "icos", "icas", "ismo", "ismos", "able", "ables", "ible", "ibles", "ista", "istas", "oso", "osa", "osos", "osas", "amiento", "amientos", "imiento", "imientos"]
ES_AFTER_IC = ["adora", "ador", "ación", "adoras", "adores", "aciones", "ante", "antes", "ancia", "ancias"]
ES_Y = ["ya", "ye", "yan", "yen", "yeron", "yendo", "yo", "yó", "yas", "yes", "yais", "yamos"]
ES_EN = ["en", "es", "éis", "emos"]
ES_VERB = (
    "arían arías arán arás aríais aría aréis aríamos aremos ará aré erían erías erán erás eríais ería eréis eríamos eremos erá eré "
    "irían irías irán irás iríais iría iréis iríamos iremos irá iré aba ada ida ía ara iera ad ed id ase iese aste iste an aban ían "
    "aran ieran asen iesen aron ieron ado ido ando iendo ió ar er ir as abas adas idas ías aras ieras ases ieses ís áis abais íais "
    "arais ierais aseis ieseis asteis isteis ados idos amos ábamos íamos imos áramos iéramos iésemos ásemos"
).split()


def _regions(word: str, vowels: str) -> tuple[int, int]:
    """Starts of R1 and R2: behind the first non-vowel that follows a vowel, and again inside R1."""

    def behind(start: int) -> int:
        for i in range(start + 1, len(word)):
            if word[i] not in vowels and word[i - 1] in vowels:
                return i + 1
        return len(word)

    first = behind(0)
    return first, behind(first)


def _longest(word: str, endings) -> str:
    return max((e for e in endings if word.endswith(e)), key=len, default="")


def english(word: str) -> str:
    if len(word) <= 2:
        return word
    if word in EN_EXCEPTIONS:
        return EN_EXCEPTIONS[word]
    vowels = "aeiouy"
    letters = list(word)
    for i, c in enumerate(letters):
        if c == "y" and (i == 0 or letters[i - 1] in vowels):
            letters[i] = "Y"
    w = "".join(letters)
    r1, r2 = _regions(w, vowels)
    for start in ("gener", "commun", "arsen"):
        if w.startswith(start):
            r1 = len(start)
            r2 = r1 + _regions(w[r1:], vowels)[0]

    def short_syllable(x: str) -> bool:
        if len(x) == 2:
            return x[0] in vowels and x[1] not in vowels
        return len(x) > 2 and x[-3] not in vowels and x[-2] in vowels and x[-1] not in vowels + "wxY"

    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and any(c in vowels for c in w[:-2]):
        w = w[:-1]
    if w in EN_KEPT:
        return w
    e = _longest(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if e in ("eed", "eedly"):
        if len(w) - len(e) >= r1:
            w = w[: len(w) - len(e)] + "ee"
    elif e and any(c in vowels for c in w[: len(w) - len(e)]):
        w = w[: len(w) - len(e)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w[-2:] in ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt"):
            w = w[:-1]
        elif short_syllable(w) and len(w) <= r1:
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in vowels:
        w = w[:-1] + "i"
    e = _longest(w, EN_STEP2)
    if e and len(w) - len(e) >= r1:
        stem = w[: len(w) - len(e)]
        if (e != "ogi" or stem.endswith("l")) and (e != "li" or stem[-1:] in tuple("cdeghkmnrt")):
            w = stem + EN_STEP2[e]
    e = _longest(w, EN_STEP3)
    if e and len(w) - len(e) >= (r2 if e == "ative" else r1):
        w = w[: len(w) - len(e)] + EN_STEP3[e]
    e = _longest(w, EN_STEP4)
    if e and len(w) - len(e) >= r2 and (e != "ion" or w[: len(w) - 3].endswith(("s", "t"))):
        w = w[: len(w) - len(e)]
    if w.endswith("e"):
        if len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not short_syllable(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


def spanish(word: str) -> str:
    vowels = "aeiouáéíóúü"
    w = word
    r1, r2 = _regions(w, vowels)
    rv = len(w)
    if len(w) > 2:
        if w[1] not in vowels:
            rv = next((i + 1 for i in range(2, len(w)) if w[i] in vowels), len(w))
        elif w[0] in vowels:
            rv = next((i + 1 for i in range(2, len(w)) if w[i] not in vowels), len(w))
        else:
            rv = 3
    plain = str.maketrans("áéíóú", "aeiou")

    def inside(e: str, region: int) -> bool:
        return bool(e) and len(w) - len(e) >= region

    e = _longest(w, ES_PRONOUNS)
    if inside(e, rv):
        stem = w[: len(w) - len(e)]
        before = _longest(stem[rv:], ("iéndo", "ándo", "ár", "ér", "ír", "ando", "iendo", "ar", "er", "ir"))
        if before or (stem[rv:].endswith("yendo") and stem.endswith("uyendo")):
            w = stem[: len(stem) - len(before)] + before.translate(plain)
    old = w
    e = _longest(w, [*ES_DELETE, *ES_AFTER_IC, "logía", "logías", "ución", "uciones", "encia", "encias", "amente", "mente", "idad", "idades", "iva", "ivo", "ivas", "ivos"])
    stem = w[: len(w) - len(e)]

    def then(stem: str, *more: str) -> str:
        also = _longest(stem, more)
        return stem[: len(stem) - len(also)] if also and len(stem) - len(also) >= r2 else stem

    if e == "amente":
        if inside(e, r1):
            w = then(stem, "iv", "os", "ic", "ad")
            if stem.endswith("iv") and w != stem:
                w = then(w, "at")
    elif inside(e, r2):
        if e in ES_DELETE:
            w = stem
        elif e in ES_AFTER_IC:
            w = then(stem, "ic")
        elif e in ("logía", "logías"):
            w = stem + "log"
        elif e in ("ución", "uciones"):
            w = stem + "u"
        elif e in ("encia", "encias"):
            w = stem + "ente"
        elif e == "mente":
            w = then(stem, "ante", "able", "ible")
        elif e in ("idad", "idades"):
            w = then(stem, "abil", "ic", "iv")
        else:
            w = then(stem, "at")
    if w == old:
        e = _longest(w[rv:], ES_Y)
        if e and w[: len(w) - len(e)].endswith("u"):
            w = w[: len(w) - len(e)]
        else:
            e = _longest(w[rv:], [*ES_EN, *ES_VERB])
            if e:
                w = w[: len(w) - len(e)]
                if e in ES_EN and w.endswith("gu"):
                    w = w[:-1]
    e = _longest(w[rv:], ("os", "a", "o", "á", "í", "ó", "e", "é"))
    if e:
        w = w[: len(w) - len(e)]
        if e in ("e", "é") and w.endswith("gu") and len(w) - 1 >= rv:
            w = w[:-1]
    return w.translate(plain)
