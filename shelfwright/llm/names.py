"""Names as people type them: folding, noise, order, initials, nicknames and a true edit metric."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from typing import NamedTuple

# Letters without a decomposition; words that name nobody; titles; roles; legal forms; nicknames.
LETTERS = str.maketrans({"ø": "o", "ł": "l", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe", "ð": "d", "þ": "th", "ı": "i"})
NOBODY = {
    "", "unknown", "unknown author", "various", "various authors", "anonymous", "n a", "na", "none", "null", "tbd", "tba", "author", "authors", "narrator", "full cast", "cast",
    "audiobook", "audiobooks", "newbooks", "new books", "unsorted", "misc", "original", "incoming", "to fix", "books", "library", "unbekannt", "verschiedene", "varios", "anonimo", "anon",
}
TITLES = {"dr", "prof", "professor", "sir", "dame", "mr", "mrs", "ms", "rev", "by"}
ROLES = r"author|editor|translator|narrator|introduction|foreword|reader|illustrator|contributor|adapter"
LEGAL = {"inc", "ltd", "llc", "gmbh", "co", "limited", "the"}
ORG_WORDS = {
    "press", "guild", "society", "works", "collective", "studio", "studios", "audio", "radio", "publishing", "publishers", "books", "media", "group", "company", "theatre", "ensemble", "story", "listening",
}
NICKNAMES = {
    "nate": "nathaniel", "nat": "nathaniel", "fritz": "frederick", "fred": "frederick", "freddie": "frederick", "kate": "katherine", "kathy": "katherine", "katie": "katherine", "vicky": "victoria", "vicki": "victoria",
    "jon": "jonathan", "tam": "tamsin", "des": "desmond", "hattie": "harriet", "bart": "bartholomew", "gwen": "gwendolyn", "sam": "samuel", "hank": "henry", "harry": "henry", "peggy": "margaret", "maggie": "margaret", "meg": "margaret",
    "bill": "william", "will": "william", "billy": "william", "len": "leonard", "lenny": "leonard", "ted": "edward", "ed": "edward", "eddie": "edward", "ned": "edward", "bella": "isabella", "izzy": "isabella", "sasha": "alexander", "alex": "alexander",
    "sandy": "alexander", "liz": "elizabeth", "beth": "elizabeth", "betty": "elizabeth", "lizzie": "elizabeth", "delia": "cordelia", "dora": "theodora", "thea": "theodora", "dick": "richard", "rick": "richard", "rich": "richard", "trish": "patricia", "pat": "patricia", "patty": "patricia",
    "bob": "robert", "rob": "robert", "bobby": "robert", "pepe": "jose", "jim": "james", "jimmy": "james", "jack": "john", "mike": "michael", "tom": "thomas", "tony": "anthony", "dan": "daniel", "dave": "david", "steve": "stephen", "chris": "christopher",
    "al": "alistair", "ali": "alistair", "wendy": "gwendolyn", "vinnie": "lavinia", "ron": "ronald", "ken": "kenneth", "larry": "lawrence", "andy": "andrew", "ben": "benjamin", "joe": "joseph", "nick": "nicholas", "pete": "peter", "greg": "gregory", "sue": "susan", "jenny": "jennifer",
}
DAMAGED = "?�"


@lru_cache(maxsize=100_000)
def fold(text: str) -> str:
    """Lower case without accents; letters of one form."""
    flat = unicodedata.normalize("NFKD", text.lower())
    return "".join(c for c in flat if not unicodedata.combining(c) and unicodedata.category(c) != "Cf").translate(LETTERS).replace("�", "?")


class Name(NamedTuple):
    """A parsed name. words: folded words in written order; last: how many at the start are the surname (comma form), 0 if unknown."""

    kind: str  # person, org, nobody
    words: tuple[str, ...]
    last: int
    junior: bool
    rest: str  # what follows " - " in a folder name


@lru_cache(maxsize=50_000)
def parse(value: str | None) -> Name:
    """Read a typed name. Separators, titles, roles and legal forms are noise; a folder's title goes to `rest`."""
    text = fold(value or "").replace("_", " ")
    text = re.sub(rf"\(\s*(?:{ROLES})s?\s*\)", " ", text)
    text = re.sub(rf"\s+[-–]\s+(?:{ROLES})s?\b(?=\s*(?:$|[-–]))", " ", text)
    head, _, rest = text.partition(" - ")
    if not head.strip():
        head, rest = rest, ""
    junior = bool(re.search(r"(?:,|\s)\s*(?:jr|junior)\b\.?", head))
    head = re.sub(r"(?:,|\s)\s*(?:jr|junior)\b\.?", " ", head)
    org = bool(re.search(r"\s?[&+]\s?|\sand\s", head)) or bool(set(re.findall(r"\w+", head)) & (ORG_WORDS - {"books"}))
    if org:
        words = re.findall(r"[\w?]+", re.sub(r"[&+]|\band\b", " ", head))
        words = [w for w in words if w not in LEGAL]
        return Name("org", tuple(words), 0, False, rest.strip())
    parts = [re.findall(r"[\w?'’-]+", p) for p in head.split(",")]
    parts = [[w for w in p if w not in TITLES] for p in parts]
    parts = [p for p in parts if p]
    words = [w.strip("'’-") for p in parts for w in p]
    words = [w for w in words if w]
    if " ".join(words) in NOBODY or re.sub(r"\W", "", " ".join(words)) == "" and "?" not in head:
        return Name("nobody", (), 0, False, rest.strip())
    return Name("person", tuple(words), len(parts[0]) if len(parts) > 1 else 0, junior, rest.strip())


@lru_cache(maxsize=200_000)
def distance(a: str, b: str) -> int:
    """Damerau-Levenshtein distance without restrictions (a metric). "?" stands for any one letter and costs nothing."""
    if a == b:
        return 0
    seen: dict[str, int] = {}
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    a, b = a[head:], b[head:]
    tail = 0
    while tail < min(len(a), len(b)) and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    a, b = (a[:-tail], b[:-tail]) if tail else (a, b)  # what is common at the ends costs nothing
    n, m = len(a), len(b)
    if not n or not m:
        return n + m
    big = n + m
    d = [[big] * (m + 2) for _ in range(n + 2)]
    for i in range(n + 1):
        d[i + 1][1] = i
    for j in range(m + 1):
        d[1][j + 1] = j
    for i in range(1, n + 1):
        row = 0
        for j in range(1, m + 1):
            k, at = seen.get(b[j - 1], 0), row
            same = a[i - 1] == b[j - 1] or a[i - 1] == "?" or b[j - 1] == "?"
            if a[i - 1] == b[j - 1]:
                row = j
            d[i + 1][j + 1] = min(d[i][j] + (not same), d[i + 1][j] + 1, d[i][j + 1] + 1, d[k][at] + (i - k - 1) + 1 + (j - at - 1))
        seen[a[i - 1]] = i
    return d[n + 1][m + 1]


def near(a: str, b: str, most: int = 1) -> bool:
    return abs(len(a) - len(b)) <= most and distance(a, b) <= most


def slips(length: int) -> int:
    """Slips that a word of a length can have and still be the same word."""
    return 0 if length < 4 else 1 if length < 9 else 2


def means(word: str, given: str) -> int:
    """How a word says a given name apart from slips: 3 the name or a short form on the list, 2 its beginning or a slip of a short form, 1 its
    initial, 0 not."""
    if word == given or NICKNAMES.get(word) == given or NICKNAMES.get(given) == word:
        return 3
    if len(word) == 1:
        return 1 if word == given[:1] or word == "?" else 0
    if len(word) >= 3 and given.startswith(word):
        return 2
    return 2 if any(f == given and len(n) > 3 and near(word, n) for n, f in NICKNAMES.items()) else 0


def same_given(word: str, given: str) -> int:
    """As `means`, and 2 with a slip."""
    how = means(word, given)
    if how or len(word) == 1:
        return how
    return 2 if near(word, given, min(2, slips(max(len(word), len(given))))) else 0
