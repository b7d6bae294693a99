"""Reading names of people and organisations as people type them."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

#: fixed values: letters that have no decomposition
_PLAIN = str.maketrans({"ł": "l", "ø": "o", "đ": "d", "ð": "d", "þ": "th", "æ": "ae", "œ": "oe", "ß": "ss", "ı": "i"})
#: fixed values: common short forms of given names
NICKNAMES = {
    "aleksandr": "alex sasha sanya", "alexander": "alex sasha sandy", "andrew": "andy drew", "anthony": "tony ant",
    "benjamin": "ben benny", "charles": "charlie chuck", "christopher": "chris kit", "concepcion": "concha conchita",
    "daniel": "dan danny", "deborah": "deb debbie", "dmitri": "dima mitya", "edward": "ed eddie ned ted",
    "ekaterina": "katya katia", "elizabeth": "liz beth lizzie betty eliza", "francisco": "paco pancho fran", "frederick": "fred freddie",
    "giuseppe": "beppe peppe", "gregory": "greg", "guadalupe": "lupe lupita", "ignacio": "nacho", "james": "jim jimmy jamie",
    "jennifer": "jen jenny", "johannes": "hans jo", "john": "jack johnny", "jose": "pepe", "joseph": "joe joey",
    "katherine": "kate kathy katie kat kit", "lawrence": "larry", "leonard": "len lenny leo", "ludmila": "mila lyuda luda",
    "margaret": "peggy maggie meg marge", "maximilian": "max", "michael": "mike mick misha", "nicholas": "nick nico", "patricia": "pat patty tricia trish",
    "philip": "phil", "rafael": "rafa", "richard": "dick rick rich", "robert": "bob rob bobby", "samuel": "sam sammy", "stephanie": "steph",
    "stephen": "steve", "susannah": "sue susie", "theodore": "ted theo teddy", "thomas": "tom tommy", "timothy": "tim",
    "victoria": "vicky tori", "viktor": "vitya", "vladimir": "vova volodya", "william": "bill will billy", "yevgenia": "zhenya", "zachary": "zach zack",
}
_FULL = {short: {full for full, shorts in NICKNAMES.items() if short in shorts.split()} for shorts in NICKNAMES.values() for short in shorts.split()}
#: titles before a name, degrees after a comma; bare capitals at the end are initials
_HONORIFIC = re.compile(r"^\s*(?:(?:prof|professor|dr|sir|dame|mr|mrs|ms)\b\.?\s+)+|,\s*(?:ph\.?\s?d|m\.?d|m\.?sc|b\.?sc|jr|sr)\.?\s*$", re.IGNORECASE)
_NOTE = re.compile(r"\([^)]*\)|\[[^\]]*\]|[¹²³⁰-⁹*†‡§¶#]|\d+")
_WORD = re.compile(r"[a-z]+(?:['’][a-z]+)*")
#: fixed values: words of organisations in their short and foreign forms
_EXPAND = {
    "univ": "university", "uni": "university", "u": "university", "universitat": "university", "universite": "university", "universidad": "university", "universita": "university",
    "technische": "technical", "inst": "institute", "lib": "library", "natl": "national", "nat": "national", "nation": "national", "med": "medical",
    "coll": "college", "col": "college", "doc": "document", "documents": "document", "docs": "document", "stud": "studies", "studs": "studies", "ctr": "centre", "center": "centre",
    "labs": "laboratories", "lab": "laboratories", "laboratory": "laboratories", "res": "research", "sci": "science", "hosp": "hospital", "acad": "academy",
}
_ACRONYMS = {"tu": "technical university", "cds": "centre document studies", "nl": "national library", "rl": "research laboratories", "it": "institute technology", "mc": "medical college"}
_ORG_WORDS = frozenset(
    "university technical institute technology library national medical college document studies centre laboratories research science "
    "hospital academy school museum archive polytechnic college foundation".split()
)
_KINDS = [frozenset(k.split()) for k in (*_ACRONYMS.values(), "university", "hospital", "academy", "museum")]
_TECH = {"tech": "technical", "techn": "technical"}
_DEPARTMENT = re.compile(
    r"^\s*(?:department|dept|faculty|fac|division|div|chair|unit|section|graduate school|reading group|working group|group|school of|institute \d+|lab(?:oratory)? (?:of|for)\s)\b",
    re.IGNORECASE,
)
_LINKS = frozenset("of for the and de la at in und der fur".split())


@lru_cache(maxsize=200_000)
def fold(text: str) -> str:
    """Lower case without accents."""
    text = text.lower()
    if text.isascii():
        return text
    return "".join(c for c in unicodedata.normalize("NFKD", text.translate(_PLAIN)) if not unicodedata.combining(c))


def umlaut(word: str) -> str:
    """One spelling of letters written with or without an added e (mueller, muller)."""
    return re.sub(r"(?<=[aou])e(?![aou])", "", word) if re.search(r"[aou]e", word) else word


def _initials(word: str) -> bool:
    """A run of initials: no vowels inside, at most three letters."""
    return len(word) <= 3


def person(name: str | None, given_words: frozenset[str] = frozenset()) -> tuple[str, tuple[str, ...]] | None:
    """(last word of the surname, given names or initials) of a personal name; None if it has no letters.

    The order is read from a comma, from capitals (SURNAME Given), from trailing
    initials (Surname AB), or from `given_words` (Surname Given); else the last word
    is the surname. Further words of a surname follow the given names.
    """
    plain = _NOTE.sub(" ", _HONORIFIC.sub(" ", name or "")).strip(" ,;.")
    head, comma, tail = plain.partition(",")
    if comma and not re.search(r"\w", tail):
        head, comma = head, ""
    if comma:
        sur, given = head.split(), tail.split()
    else:
        words = plain.split()
        caps = [w for w in words if len(re.sub(r"\W", "", w)) > 3 and w.upper() == w and w.lower() != w]
        if caps and any(w not in caps and w.upper() != w for w in words):
            sur, given = caps, [w for w in words if w not in caps]
        elif len(words) > 1 and re.fullmatch(r"[^\W\d_a-z]{1,3}(?:-[^\W\d_])?", words[-1]) and "." not in words[-1] and len(words[0]) > 3:
            sur, given = words[:-1], words[-1:]
        elif len(words) > 1 and _known(words[-1], given_words) and not _known(words[0], given_words) and len(words[0]) > 3:
            cut = next(i for i, w in enumerate(words) if _known(w, given_words) or i == len(words) - 1)
            sur, given = words[:cut], words[cut:]
        else:
            sur, given = words[-1:], words[:-1]
    surnames = [umlaut(w) for w in _WORD.findall(fold(" ".join(sur)).replace("-", " "))]
    names: list[str] = []
    for word in given:
        for bit in re.split(r"[.\s-]+", word):
            clean = "".join(_WORD.findall(fold(bit)))
            if clean:
                single = clean == fold(bit) and bit.isupper() and _initials(bit) and len(bit) > 1
                names.extend(clean if single else [clean])
    return (surnames[-1], (*names, *surnames[:-1])) if surnames else None


def _known(word: str, given_words: frozenset[str]) -> bool:
    return bool(given_words) and all(b in given_words for b in fold(word).split("-"))


def given_forms(name: str) -> set[str]:
    """The given names a written one may stand for."""
    return {name} | _FULL.get(name, set())


def organisation(name: str | None) -> tuple[str, str] | None:
    """(place, kind) of an organisation's name; departments, numbering and countries are left out.

    Parts between commas are read until both a kind and a place are known.
    """
    text = re.sub(r"^\s*[(\[]?\d+[)\].]?\s*", "", (name or ""))
    text = re.sub(r"['’](?=l\b)", "", text, flags=re.IGNORECASE)
    kind: set[str] = set()
    place: list[str] = []
    for part in text.split(","):
        if _DEPARTMENT.match(part):
            continue
        words = re.findall(r"[a-z]+(?:-[a-z]+)*", fold(part).replace(".", " "))
        got: list[str] = []
        for word in words:
            if word in _LINKS or len(word) == 1 and word not in _EXPAND:  # a letter alone is a shortened link word
                continue
            if word not in _EXPAND and word not in _ACRONYMS and any(len(w) > 4 and w != word for w in words):
                word = _near_form(word) or word
            for w in _ACRONYMS.get(word, _EXPAND.get(word, word)).split():
                if w in _TECH:
                    w = "technology" if "institute" in kind or "inst" in words or "institute" in words else "technical"
                if w in _ORG_WORDS or (near := _near_kind(w)) and (w := near):
                    kind.add(w)
                else:
                    got.append(w)
        if not place:
            place = got
        if kind and place:
            break
    if not place and not kind:
        return None
    fuller = [k for k in _KINDS if kind and kind < k]
    if frozenset(kind) not in _KINDS and len(fuller) == 1:  # one word of the kind is misspelt
        kind, place = set(fuller[0]), sorted(place, key=len)[-1:]
    return umlaut(" ".join(place)), " ".join(sorted(kind))


@lru_cache(maxsize=100_000)
def _near_form(word: str) -> str | None:
    """The short or foreign form that `word` misspells by one letter, if any."""
    if word in _ORG_WORDS or not 2 < len(word) < 5 and len(word) < 8:
        return None
    return next((w for w in sorted(_EXPAND) if len(w) > 2 and (len(w) < 5) == (len(word) < 5) and edits(word, w, 1) <= 1), None)


@lru_cache(maxsize=100_000)
def _near_kind(word: str) -> str | None:
    """The word of organisations that `word` misspells by one letter, if any."""
    if len(word) < 6:
        return None
    return next((w for w in sorted(_ORG_WORDS) if abs(len(w) - len(word)) < 2 and edits(word, w, 1) <= 1), None)


def edits(a: str, b: str, most: int) -> int:
    """Edit distance with swaps of neighbours, or most + 1 if it is larger."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    while a and b and a[0] == b[0]:
        a, b = a[1:], b[1:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    if not a or not b:
        return min(most + 1, max(len(a), len(b)))
    if most == 1:
        return 1 if len(a) == len(b) == 1 or len(a) == len(b) == 2 and a == b[::-1] else 2
    before: list[int] = []
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, now[-1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            now.append(d)
        if min(now) > most:
            return most + 1
        before, last = last, now
    return min(last[-1], most + 1)
