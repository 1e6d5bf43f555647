"""Structure of typed names: titles, role words, order, nicknames, initials, legal forms."""

from __future__ import annotations

import os.path
import re
import unicodedata
from functools import lru_cache
from typing import NamedTuple

from casemill.llm.trie import edits

# Titles before a name, and what may follow one.
TITLES = {"mr", "mrs", "ms", "miss", "dr", "prof", "professor", "shri", "sri", "smt", "kumari", "justice", "honble", "hon'ble", "hon", "honourable", "adv", "advocate", "capt", "captain", "col", "colonel", "major", "lt", "gen", "sir", "lady", "judge", "the", "chief", "mx", "rev", "learned", "sh"}
_TAIL = re.compile(
    r"(?:\s*,?\s*\((?:aor|deceased|dead|since deceased|retd?\.?|minor)\))"
    r"|(?:\s*,?\s*(?:&|and)\s+(?:ors|others|anr|another|other)\b\.?)"
    r"|(?:\s*,?\s*(?:through|thru|thr\.?|rep\.?\s+by|represented\s+by|by)\s+(?:its\s+|his\s+|her\s+|their\s+|the\s+)?(?:legal\s+)?(?:lrs?\b\.?|heirs|representatives?|secretary|director|collector|chief secretary|principal secretary|guardian|manager|registrar|president|commissioner|power of attorney|managing director|proprietor).*)"
    r"|(?:\s*,\s*(?:sr\.?\s*adv(?:ocate|\.)?|senior\s+adv(?:ocate|\.)?|adv(?:ocate|\.)?|aor|advocate-on-record|a?\.?c?\.?j\.?(?:\s*i\.)?|jj\.?|esq\.?|k\.c\.|q\.c\.)(?=\s*(?:,|$)))"
    r"|(?:\s+jj?\.)$",
    re.I,
)
_MAYBE_TAIL = re.compile(r"[,(&]| and |\bby\b|thr|rep|JJ?\.$", re.I)
# Short given names and the names they stand for.
NICKNAMES = {
    "jack": "john", "johnny": "john", "jenny": "jennifer", "jen": "jennifer", "dick": "richard", "rick": "richard", "rich": "richard", "ben": "benjamin", "benny": "benjamin", "ted": "edward theodore", "ed": "edward", "eddie": "edward", "ned": "edward", "theo": "theodore",
    "dan": "daniel", "danny": "daniel", "tom": "thomas", "tommy": "thomas", "joe": "joseph", "jim": "james", "jimmy": "james", "jamie": "james", "bob": "robert", "rob": "robert", "bobby": "robert", "bert": "robert albert", "sue": "susan", "susie": "susan", "sam": "samuel samantha",
    "liz": "elizabeth", "beth": "elizabeth", "betty": "elizabeth", "eliza": "elizabeth", "kate": "katherine", "kathy": "katherine", "katie": "katherine", "peggy": "margaret", "meg": "margaret", "maggie": "margaret", "chris": "christopher christine", "matt": "matthew", "mike": "michael", "mick": "michael",
    "steve": "stephen steven", "tony": "anthony", "alex": "alexander alexandra", "greg": "gregory", "phil": "philip", "vicky": "victoria vikram", "ravi": "ravindra", "vic": "victor", "pat": "patricia patrick", "trish": "patricia", "patty": "patricia", "raju": "rajendra raja", "venky": "venkatesh", "becky": "rebecca", "nick": "nicholas", "gene": "eugene",
    "fred": "frederick", "freddie": "frederick", "bill": "william", "will": "william", "billy": "william", "charlie": "charles", "chuck": "charles", "andy": "andrew", "drew": "andrew", "dave": "david", "debbie": "deborah", "deb": "deborah", "larry": "lawrence", "harry": "harold henry harish", "hank": "henry", "zach": "zachary", "zack": "zachary",
    "ray": "raymond", "ron": "ronald", "ken": "kenneth", "jeff": "jeffrey", "josh": "joshua", "abe": "abraham", "al": "albert", "walt": "walter", "leo": "leonard", "barb": "barbara", "cathy": "catherine", "nan": "nandini", "nandu": "nandini",
}
# Short words of organisations that leave open what they stand for, or have other letters.
ORG_WORDS = {"ltd": "limited", "ld": "limited", "pvt": "private", "p": "private", "bd": "board", "co": "company", "inc": "incorporated", "associate": "associates", "govt": "state", "gov": "state", "st": "state", "government": "state"}
# Words of the trades and kinds of organisations; shorter words with some of their letters stand for them.
ORG_KINDS = (
    "associates", "authority", "board", "brothers", "chemicals", "company", "construction", "corporation", "department", "development", "electricity", "engineering", "finance", "foods", "housing", "insurance", "international",
    "logistics", "manufacturing", "mills", "mining", "motor", "municipal", "paper", "parts", "power", "realty", "shipping", "society", "supply", "textiles", "university", "works",
)


def shortens(short: str, word: str) -> bool:
    """May ``short`` be an abbreviation of ``word``: its first letter and some of the others, in order?"""
    if not 1 < len(short) < len(word) or short[0] != word[0]:
        return False
    rest = iter(word)
    return all(c in rest for c in short)


@lru_cache(200_000)
def org_word(word: str, is_first: bool = False) -> str:
    """A word of an organisation written out. After the first word, which names it, an abbreviation stands for the kind that
    begins with it, else for the shortest kind that holds its letters in order; what is left after a common beginning has no
    vowel, as a slip of the hand may have."""
    if word in ORG_WORDS or is_first or len(word) > 6 or word in ORG_KINDS:
        return ORG_WORDS.get(word, word)
    plain = word[:-1] if word.endswith("s") and len(word) > 3 else word
    found = [k for k in ORG_KINDS for w in (word, plain) if shortens(w, k) and not set("aeiou") & set(w[len(os.path.commonprefix((w, k))) :])]
    return min(found, key=lambda k: (not k.startswith(plain), len(k), k), default=word)


# Words of public bodies, in the order in which they are put.
PUBLIC = ("state", "municipal", "electricity", "development", "university", "department", "authority", "council", "commission", "corporation", "board")
LEGAL = {"limited", "private", "company", "incorporated", "llp", "plc"}
_ORG_MARK = {"limited", "company", "associates", "corporation", "board", "state", "private", "society", "works", "mills", "insurance", "university", "authority", "department", "bank", "trust", "municipal", "union", "commission", "council", "incorporated", "llp", "partners", "chambers"}
_INVERTED_BODY = re.compile(r"^(?:the\s+)?(.+?),\s*(.+)$")


class Name(NamedTuple):
    """A parsed spelling. ``core`` is what is indexed; the rest decides whether two near cores are one entity."""

    kind: str  # person or org
    core: str  # initial + surname, or the name of the organisation without its legal form
    surname: str
    given: str  # may be empty (initials only)
    initial: str
    middle: str  # a word, a letter or empty
    legal: str  # private, company or empty


def fold(s: str) -> str:
    """Lower case without accents."""
    if s.isascii():
        return s.lower()
    s = unicodedata.normalize("NFD", s.casefold())
    return "".join(c for c in s if not unicodedata.combining(c))


_SOUNDS = [(re.compile("e{2,}"), "i"), (re.compile("o{2,}"), "u"), (re.compile("ph"), "f"), (re.compile("ck"), "k")]


@lru_cache(100_000)
def sound(word: str) -> str:
    """A word with letters written as they sound: ee as i, oo as u, ph as f, ck as k."""
    for a, b in _SOUNDS:
        word = a.sub(b, word)
    return word


def _org(f: str) -> list[Name]:
    f = re.sub(r"^\s*(?:m/s\.?|messrs\.?)\s*", "", f)
    if "," in f and (m := _INVERTED_BODY.match(f)) and any(w in _ORG_MARK for w in map(org_word, re.findall(r"[a-z]+", m[1]))):
        f = f"{m[2]} {m[1]}"
    words = [org_word(w, not k) for k, w in enumerate(re.findall(r"[^\W_]+", f.replace("&", " and ")))]
    words = [w for w in words if w not in ("the", "m", "s")] if len(words) > 1 else words
    if words[:2] == ["state", "of"]:
        words = [*words[2:], "state"]
    elif len(words) > 2 and words[-2:] == ["state", "of"]:
        words = [*words[:-2], "state"]
    legal = "private" if "private" in words else "company" if "company" in words else ""
    core = [w for w in words if w not in LEGAL and w != "of"]
    if any(w in PUBLIC for w in core):  # Board of X and X Board are one body
        core = [w if w in PUBLIC or len(w) < 5 else next((p for p in PUBLIC if len(p) > 6 and edits(w, p, 2) <= 2), w) for w in core]
        core = [w for w in core if w not in PUBLIC] + [p for p in PUBLIC if p in core]
    if not core:
        core = words
    return [Name("org", " ".join(core), core[0], "", "", "", legal)] if core else []


def is_org(f: str) -> bool:
    if re.match(r"\s*(?:m/s|messrs)\b", f):
        return True
    return any(ORG_WORDS.get(w.rstrip("."), w.rstrip(".")) in _ORG_MARK or (len(w) > 3 and w[-1] == "." and w[:-1] not in TITLES and org_word(w[:-1]) in _ORG_MARK) for w in re.findall(r"[^\W_]{2,}\.?", f))


def parse(spelling: str) -> list[Name]:
    """The readings of one spelling, the likeliest first; empty if there is no name in it."""
    s = spelling
    while _MAYBE_TAIL.search(s):
        t = _TAIL.sub("", s).strip(" ,;")
        if t == s or not t:
            break
        s = t
    f = fold(s)
    if is_org(f):
        return _org(f)
    f = re.sub(r'["“(][^"”)]*["”)]', " ", f)
    inverted = "," in f
    if inverted:
        last, _, first = f.partition(",")
        f = f"{first} {last}"
    words = [w for w in re.findall(r"[^\W\d_]+(?:['’][^\W\d_]+)?", f)]
    n_lead = 0
    while len(words) - n_lead > 1 and words[n_lead] in TITLES:
        n_lead += 1
    words = words[n_lead:]
    if not words:
        return []
    if len(words) == 1:
        return [Name("person", words[0], words[0], "", "", "", "")]
    letters, full = [w for w in words if len(w) == 1], [w for w in words if len(w) > 1]
    out: list[Name] = []

    def add(surname: str, given: str, middle: str) -> None:
        for g in [""] if len(given) == 1 else NICKNAMES.get(given, given).split():
            i = (g or given)[0]
            out.append(Name("person", i + surname, surname, g, i, middle, ""))

    if not full:
        return [Name("person", "".join(words), "".join(words), "", "", "", "")]
    if len(full) == 1:  # initials only
        add(full[0], letters[0], letters[1] if len(letters) > 1 else "")
    elif letters:
        if words[0] == letters[0] and len(letters) == 1 and len(full) == 2:  # X. Middle Surname
            add(full[-1], letters[0], full[0])
        elif len(full) == 2:
            if words[-1] in letters:  # Surname Given X.
                add(full[0], full[1], letters[0])
            else:
                add(full[1], full[0], letters[0])
        else:
            add(full[-1], full[0], letters[0])
    elif len(full) == 2:
        add(full[1], full[0], "")
        if not inverted:
            add(full[0], full[1], "")
    else:
        add(full[-1], full[0], full[1])
        if not inverted:
            add(full[0], full[1], full[2])
    return out


def sounded(n: Name) -> Name:
    """A reading with its surname, or the words of its organisation, written as they sound."""
    if n.kind == "org":
        core = " ".join(map(sound, n.core.split(" ")))
        return n._replace(core=core, surname=core.split(" ")[0])
    surname = sound(n.surname)
    return n._replace(core=n.initial + surname if n.initial else surname, surname=surname)


def orders(got: list[Name]) -> list[list[Name]]:
    """The readings by the word taken for the surname; several in one order are the names that a short given name stands for."""
    out: dict[str, list[Name]] = {}
    for n in got:
        out.setdefault(n.surname, []).append(n)
    return list(out.values())
