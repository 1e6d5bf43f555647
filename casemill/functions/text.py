"""Text normalisation as Column -> Column functions.

Each is a chain of replacements over native expressions. ``sql`` renders the same chain for an ANSI engine with RE2, which is
what the SQL checks run. Null and empty input give '' where a function cleans, and null where it selects.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Step = tuple[str, str]  # pattern, replacement ('$1' for groups)

_MON = r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*"
_SPACES: Step = (r"\s+", " ")


def _strip(chars: str) -> Step:
    return rf"^[{chars}]+|[{chars}]+$", ""


# The steps of each chain, in their order.
PRECLEAN: list[Step] = [
    (r"(?i)Page \d+ of \d+", ""), (r"_{3,}", ""), (r"-{3,}", ""), (r"(\w)-\n(\w+)", "$1$2"), (r"\n{2,}", "\n"), (r"[ \t]+", " "), (r"[’‘]", "'"), (r"[“”]", '"'), _strip(r"\s"),
]
CLEAN: list[Step] = [_SPACES, (r"(?i)\bPage\s+\d+\s+of\s+\d+\b", ""), (r"\.{3,}", "..."), (r"-{3,}", "---"), _strip(r"\s")]
WHITESPACE: list[Step] = [_SPACES, _strip(r" ,;:\n\t")]
ORGANIZATION: list[Step] = [("Ltd", "Limited"), ("Pvt", "Private"), ("&", "and"), ("^In ", ""), (r"^(This Court in\b)(.*)$", "$2"), _strip(r"\s"), (r"^Private\. Limited$", "")]
STATUTE: list[Step] = [
    _strip(r"\s"), (r"(?i)\bNI Act\b", "Negotiable Instruments Act, 1881"), (r"(?i)\bCrPC\b", "Code of Criminal Procedure, 1973"), (r"(?i)\bIPC\b", "Indian Penal Code, 1860"),
    (r"(?i)\bIT Act\b", "Information Technology Act, 2000"), (r"(?i)\bBNS\b", "Bharatiya Nyaya Sanhita, 2023"),
]
#: Abbreviations that stand for the whole value, in the order in which they are tried.
STATUTE_WHOLE: list[tuple[str, str]] = [
    ("CrPC", "Code of Criminal Procedure, 1973"), ("CPC", "Code of Civil Procedure, 1908"), ("IPC", "Indian Penal Code, 1860"), ("NI Act", "Negotiable Instruments Act, 1881"),
    ("IT Act", "Information Technology Act, 2000"), ("BNS", "Bharatiya Nyaya Sanhita, 2023"), ("BNSS", "Bharatiya Nagarik Suraksha Sanhita, 2023"),
]
_ROLE = "petitioner|appellant|respondent|defendant|plaintiff"
PARTY_NAME: list[Step] = [
    *WHITESPACE, (r"(?i)^(?:in the\s+supreme\s+court.*|before\s+the.*|civil\s+appellate\s+jurisdiction.*)", ""), (rf"(?i)^(?:{_ROLE})\s*[:\-]\s*", ""), (r"(?i)\(?\d{4}\)?\s*(?:SCC|SCR|AIR|All ER).*", ""),
    (r"(?is)(?:\brepresented by\b|\bthrough\b|\bfiled\b|\bunder\b).*$", ""), (rf"(?i)\b(?:{_ROLE})\b$", ""), _strip(r" ,;:\-"),
]
PARTY_CHUNK: list[Step] = [
    (r"(?i)\b(?:&\s*Anr\.?|&\s*Ors\.?|and\s+Another|and\s+Others)\b", ""), (r"(?i)\b(?:Petitioner|Appellant|Respondent|Defendant)\b.*$", ""), (r"\b\d{1,2}[./-]\d{1,2}[./-]\d{2,4}\b", ""), (rf"(?i)\b\d{{1,2}}\s+{_MON}\s+\d{{4}}\b", ""),
    (r"\[\d{4}\]", ""), (r"\(\d{4}\)", ""), (r"(?i)\b(?:SCC|SCR|INSC|AIR)\s+\d+", ""), (r"(?i)\bNo\.?\s*\d+", ""), (r"(?i)\bCriminal\s+Appeal\b.*$", ""), (r"(?i)\bCrl\.?O\.?P\.?\b.*$", ""), (r"(?i)\bRep(?:resented)?\.?\s+by\b.*$", ""),
    (r"(?i)\bThrough\b.*$", ""), (r"(?i)\s+(?:in|of|the|at|to)\s*$", ""), _SPACES, _strip(r" .,;:\-"),
]
#: The same for captions, where Crl.O.P. numbers stay.
CAPTION_CHUNK = [s for s in PARTY_CHUNK if "Crl" not in s[0]]
JUDGE_NAME: list[Step] = [
    (r"(?i)\b(?:Hon'?ble|Honorable|Justice|Mr\.?|Mrs\.?|Ms\.?|Dr\.?|Shri|Smt\.?|Lordship|His Lordship|Her Ladyship)\b", ""), _strip(r"\s"), (r"(?i)\bJ{1,2}\.?$", ""), _SPACES, _strip(r"\s"),
]
JUDGE_PREFIX: list[Step] = [(r"(?i)^Hon['’]?\s*ble\.?\s*", ""), _strip(r"\s")]
#: What the classifier's judges lose anywhere in the name.
JUDGE_PREDICTED: list[Step] = [(r"(?i)Hon['’]?\s*ble\.?\s*", ""), (r"\bMr\.?\s+Justice\b", "Justice")]
# Lookaheads for the end of a role word are written as a group that is put back.
ADVOCATE_NAME: list[Step] = [
    (r"^[/:\-\s]+", ""), (r"(?i)^(?:for\s+(?:Applicants?|Respondents?|State|the\s+(?:Appellant|Respondent|Petitioner)))\s*[:\-]?\s*", ""), (r"(?i)^(?:/\s*)?State\s*[:\-]?\s*", ""),
    (r"(?i),?\s*\bSr\.?\s*Advs?\.?(\s*[,;.]|$)", "$1"), (r"(?i),?\s*\bA\.S\.G\.?(\s*[,;.]|$)", "$1"), (r"(?i),?\s*\bA\.A\.G\.?(\s*[,;.]|$)", "$1"),
    (r"(?i)\b(?:Advocate|Senior Advocate|learned counsel|learned senior counsel|AOR|GA|AGA|SG|Counsel|Solicitor General|amicus curiae)\b", ""), (r"(?i)\bAdvs?\b\.?(\s*[^A-Za-z\s]|\s*$)", "$1"),
    (r"\s*\([^)]*\)$", ""), (r"(?i)\b(?:appearing\s+for|represented\s+by|for\s+the)\b.*$", ""), _strip(r" .,;:\n\t\-"), _SPACES,
]
CASE_NAME: list[Step] = [(r"\s+[Vv][Ss]?\.?\s+", " v. "), (r"\s+v\.?\s*$", ""), _SPACES, _strip(r"\s")]


def apply(c: Column, steps: list[Step]) -> Column:
    """A chain of regular-expression replacements; null gives ''."""
    c = F.coalesce(c, F.lit(""))
    for pattern, to in steps:
        c = F.regexp_replace(c, F.lit(pattern), F.lit(to))
    return c


def literal(s: str) -> str:
    """An SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def sql(expr: str, steps: list[Step]) -> str:
    """The chain as an SQL expression."""
    out = f"coalesce({expr}, '')"
    for pattern, to in steps:
        out = f"regexp_replace({out}, {literal(pattern)}, {literal(to.replace('$', chr(92)))}, 'g')"
    return out


def _chain(steps: list[Step]) -> Callable[[Column], Column]:
    return lambda c: apply(c, steps)


preclean = _chain(PRECLEAN)
clean_text = _chain(CLEAN)
clean_whitespace = _chain(WHITESPACE)
normalize_statute = _chain(STATUTE)
clean_party_name = _chain(PARTY_NAME)
clean_party_chunk = _chain(PARTY_CHUNK)
clean_caption_chunk = _chain(CAPTION_CHUNK)
clean_judge_name = _chain(JUDGE_NAME)


def capitalized(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 1_000_000))


def normalize_case_name(c: Column) -> Column:
    """' v. ' between the parties, one space, a capital first; null if nothing is left."""
    x = apply(c, CASE_NAME)
    return F.nullif(capitalized(x), F.lit(""))


def normalize_entity(label: Column, value: Column) -> Column:
    """By label: organisations get full legal forms, statutes their full names; other values stay."""
    act = F.when(value.contains("CrPC"), "Code of Criminal Procedure, 1973").when(value.contains("NI Act") | value.contains("Negotiable Instrument"), "Negotiable Instruments Act, 1881").otherwise(value)
    return F.when(F.lower(label) == "organization", F.btrim(apply(value, ORGANIZATION))).when(F.lower(label) == "statute", act).otherwise(value)


def whole_statute(c: Column) -> Column:
    """A trimmed statute, or the full name if it holds a known abbreviation."""
    x = F.regexp_replace(F.btrim(c), r"[.,;:]+$", "")
    out = x
    for short, full in reversed(STATUTE_WHOLE):
        out = F.when(x.rlike(rf"(?i)\b{short}\b"), full).otherwise(out)
    return out


def whole_statutes(a: Column) -> Column:
    """A list of statutes by ``whole_statute``: blank ones left out, later ones that differ in case only too."""
    return distinct_ci(F.filter(F.transform(F.coalesce(a, F.array().cast("array<string>")), whole_statute), lambda x: x.isNotNull() & (x != "")))


def clean_advocate_name(c: Column) -> Column:
    x = apply(c, ADVOCATE_NAME)
    return F.when((F.upper(x) == "APP") | (F.length(x) < 3) | ~x.rlike("[A-Za-z]"), "").otherwise(x)


def distinct_ci(a: Column) -> Column:
    """Array without later elements that equal an earlier one in lower case; the order stays."""
    keys = F.transform(a, F.lower)
    return F.filter(a, lambda x, i: F.array_position(keys, F.lower(x)) == i + 1)


def safe_text(c: Column) -> Column:
    """XML escape; null becomes a dash."""
    x = F.coalesce(c.cast("string"), F.lit("—"))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def make_case_name(appellants: Column, respondents: Column) -> Column:
    left, right = F.nullif(F.array_join(appellants, ", "), F.lit("")), F.nullif(F.array_join(respondents, ", "), F.lit(""))
    return F.coalesce(F.concat(left, F.lit(" v. "), right), left, right)


def report_file_name(appeal_number: Column, case_name: Column, suffix: str = "_report.pdf") -> Column:
    """A file name from the appeal number (50 characters), else from the case name."""
    a = F.concat(F.substring(F.translate(F.nullif(appeal_number, F.lit("")), "/", "-"), 1, 50), F.lit(suffix))
    b = F.concat(F.substring(F.translate(F.nullif(case_name, F.lit("")), " ", "_"), 1, 50), F.lit(suffix))
    return F.coalesce(a, b, F.lit(suffix.lstrip("_")))


def clean_prediction(label: Column, value: Column) -> Column:
    """A predicted value without leading signs, three characters or more, with a capital first for names; null otherwise."""
    v = F.regexp_replace(F.coalesce(value, F.lit("")), r"^[\W_]+|\s+$", "")
    return F.when(F.length(v) >= 3, F.when(label.isin("JUDGE", "PRECEDENT", "PETITIONER", "RESPONDENT"), capitalized(v)).otherwise(v))
