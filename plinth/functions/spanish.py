"""The Spanish suffix-stripping stemmer, after its published description: attached pronouns, derivational endings, verb
endings, residual endings.  Vectorised over the distinct terms of an Arrow batch."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_VOWELS = set("aeiouáéíóúü")
_PLAIN = str.maketrans("áéíóú", "aeiou")
#: The endings of the published description, by what happens to them.
PRONOUNS = "me se sela selo selas selos la le lo las les los nos".split()
BEFORE_PRONOUNS = "iéndo ándo ár ér ír ando iendo ar er ir".split()
PLAIN = "anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento amientos imiento imientos".split()
AGENT = "adora ador ación acion adoras adores aciones ante antes ancia ancias".split()
REPLACED = {"logía": "log", "logías": "log", "ución": "u", "uciones": "u", "encia": "ente", "encias": "ente"}
QUALITY = "idad idades".split()
ACTIVE = "iva ivo ivas ivos".split()
Y_VERBS = "ya ye yan yen yeron yendo yo yó yas yes yais yamos".split()
E_VERBS = "en es éis emos".split()
VERBS = (
    "arían arías arán arás aríais aría aréis aríamos aremos ará aré erían erías erán erás eríais ería eréis eríamos eremos erá eré "
    "irían irías irán irás iríais iría iréis iríamos iremos irá iré aba ada ida ía ara iera ad ed id ase iese aste iste an aban ían aran ieran "
    "asen iesen aron ieron ado ido ando iendo ió ar er ir as abas adas idas ías aras ieras ases ieses ís áis abais íais arais ierais aseis "
    "ieseis asteis isteis ados idos amos ábamos íamos imos áramos iéramos iésemos ásemos"
).split()
RESIDUAL = "os a o á í ó e é".split()


def _after(word: str, start: int) -> int:
    """After the first consonant that follows a vowel at or after start."""
    return next((i + 1 for i in range(start + 1, len(word)) if word[i] not in _VOWELS and word[i - 1] in _VOWELS), len(word))


def _verb_region(word: str) -> int:
    if len(word) < 3:
        return len(word)
    if word[1] not in _VOWELS:
        return next((i + 1 for i in range(2, len(word)) if word[i] in _VOWELS), len(word))
    if word[0] in _VOWELS:
        return next((i + 1 for i in range(2, len(word)) if word[i] not in _VOWELS), len(word))
    return 3


def _longest(word: str, endings, start: int = 0) -> str:
    """The longest ending of the word that lies after start, else an empty text."""
    return max((e for e in endings if word.endswith(e) and len(word) - len(e) >= start), key=len, default="")


def _without_pronoun(word: str, rv: int) -> str:
    pronoun = _longest(word, PRONOUNS, rv)
    rest = word[: len(word) - len(pronoun)]
    if not pronoun:
        return word
    found = _longest(rest, BEFORE_PRONOUNS, rv)
    if found:
        return rest[: len(rest) - len(found)] + found.translate(_PLAIN)
    return rest if _longest(rest, ["yendo"], rv) and rest.endswith("uyendo") else word


def _derived(word: str, r1: int, r2: int) -> str:
    """Without its derivational ending; the word itself if it has none in its region."""
    found = _longest(word, [*PLAIN, *AGENT, *REPLACED, *QUALITY, *ACTIVE, "amente", "mente"])
    rest = word[: len(word) - len(found)]
    if not found or len(rest) < (r1 if found == "amente" else r2):
        return word

    def cut(endings: list[str]) -> str:
        more = _longest(rest, endings)
        return rest[: len(rest) - len(more)] if more and len(rest) - len(more) >= r2 else rest

    if found in REPLACED:
        return rest + REPLACED[found]
    if found in AGENT:
        return cut(["ic"])
    if found == "amente":
        shorter = cut(["iv", "os", "ic", "ad"])
        if shorter != rest and rest.endswith("iv") and shorter.endswith("at") and len(shorter) - 2 >= r2:
            return shorter[:-2]
        return shorter
    if found == "mente":
        return cut(["ante", "able", "ible"])
    return cut(["abil", "ic", "iv"]) if found in QUALITY else cut(["at"]) if found in ACTIVE else rest


def _unconjugated(word: str, rv: int) -> str:
    found = _longest(word, Y_VERBS, rv)
    if found and word[: len(word) - len(found)].endswith("u"):
        return word[: len(word) - len(found)]
    found = _longest(word, [*E_VERBS, *VERBS], rv)
    rest = word[: len(word) - len(found)]
    return rest[:-1] if found in E_VERBS and rest.endswith("gu") else rest


def stemmed(word: str) -> str:
    r1, rv = _after(word, 0), _verb_region(word)
    r2 = _after(word, r1)
    word = _without_pronoun(word, rv)
    shorter = _derived(word, r1, r2)
    word = _unconjugated(word, rv) if shorter == word else shorter
    found = _longest(word, RESIDUAL, rv)
    if found:
        word = word[: len(word) - len(found)]
        if found in "eé" and word.endswith("gu") and len(word) - 1 >= rv:
            word = word[:-1]
    return word.translate(_PLAIN)


def _stems(terms: pd.Series) -> pd.Series:
    own = {t: stemmed(t) for t in terms.dropna().unique()}
    return terms.map(own)


def stem_terms(term: str | Column) -> Column:
    return F.pandas_udf(_stems, "string")(term)
