"""Several values packed in one field: a parsing expression grammar for lists of names.

The grammar (ordered alternatives; the first that matches wins)::

    element  <- bench / list
    bench    <- '[' list tail? ']'
    list     <- (separator / number)* item ((separator / number)+ item)* separator* tail?
    item     <- (quoted / firm / inverted / plain) role*
    quoted   <- '"' ('""' / !'"' .)* '"' &(separator / role / ']' / end)
    firm     <- word ('and' / '&') word firm-word &(separator / end)
    inverted <- word ',' (initials / given initials?) &(separator / role / end)
    plain    <- (!(separator / number / ']') .)+
    role     <- ',' role-word &(separator / end)
    tail     <- ','? 'JJ.' end                       -- belongs to the whole bench

A ``quoted`` that fails (no closing quote, or text straight after it) backtracks to ``plain``, and the entry is flagged.

Defined results: a null list gives no row; null or blank elements are empty places and are skipped; texts of any length are
parsed in linear time without recursion; repeated rows give repeated results only if their ids repeat.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ZERO_WIDTH = "­͏​‌‍⁠﻿"
_WS = rf"[\s{ZERO_WIDTH}]"
_PUNCT = r";|/\n\t&；｜／＆"
_WORD = r"[^\s,，;|/&；｜／＆\"\[\]()]+"
# Words that follow a name after a comma and belong to it.
ROLE_WORDS = (
    "Senior Advocate", "Sr. Advocate", "Sr. Adv.", "Sr Adv", "Advocate-on-Record", "Advocate", "Adv.", "Adv", "AOR", "C.J.I.", "CJI",
    "C.J.", "CJ", "A.C.J.", "ACJ", "J.", "J", "Esq.", "K.C.", "Q.C.", "A.S.G.", "ASG", "A.A.G.", "AAG", "G.P.", "P.P.",
)
FIRM_WORDS = ("Associates", "Associate", "Assocs.", "Assocs", "Assoc.", "Assoc", "Partners", "Chambers", "Solicitors", "LLP", "Co.", "Company", "Law Offices", "Law Firm")

_alt = lambda words: "|".join(re.escape(w).replace(r"\ ", r"\s+") for w in words)
_AND = r"and(?=\s)"
_END = rf"(?={_WS}*(?:[{_PUNCT},，\]]|$)|\s+{_AND}|\s+(?:\(\d{{1,3}}\)|\d{{1,3}}[.)])\s)"
_SEPARATOR = re.compile(rf"{_WS}*[{_PUNCT},，]{_WS}*(?:{_AND}\s*)?|\s+{_AND}\s*|\s+", re.I)
_NUMBER = re.compile(r"\s*(?:\(\d{1,3}\)|\d{1,3}[.)])(?:\s+|$)")
_QUOTED = re.compile(rf'"((?:[^"]|"")*)"{_END}', re.I)
_FIRM = re.compile(rf"{_WORD}\s+(?:and|&)\s+{_WORD}\s+(?:{_alt(FIRM_WORDS)}){_END}", re.I)
_INITIALS = rf"(?:[^\W\d_][{ZERO_WIDTH}]*[.．][\s{ZERO_WIDTH}]*)+"
_INVERTED = re.compile(rf"{_WORD}{_WS}*[,，]{_WS}*(?!(?:{_alt(ROLE_WORDS)}|JJ\.?){_END})(?:{_INITIALS}|{_WORD}(?:\s+{_INITIALS})?){_END}", re.I)
_PLAIN = re.compile(rf"(?:(?!\s+{_AND}|\s+(?:\(\d{{1,3}}\)|\d{{1,3}}[.)])\s|\s*\n)[^{_PUNCT},，\]])+", re.I)
_ROLE = re.compile(rf"{_WS}*[,，]{_WS}*(?:{_alt(ROLE_WORDS)}){_END}", re.I)
_TAIL = re.compile(rf"{_WS}*[,，]?{_WS}*\bJJ\.?{_WS}*$")
_BENCH = re.compile(r"\s*\[([^\[\]]*)(\]?)\s*$")
#: What a text must hold to be more than one bare value; the same test runs in the JVM before rows go to Python, where its
#: classes are written out: Java's \s and \d are ASCII only.
PACKED_HINT = r"(?i)[,，;；|｜/／&＆\n\t\"\[]|\sand\s|\s(\(\d{1,3}\)|\d{1,3}[.)])\s"
_HINT = re.compile(PACKED_HINT)
_JVM_SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_JVM_HINT = PACKED_HINT.replace(r"\s", _JVM_SPACE).replace(r"\d", r"\p{Nd}")


def parse_packed(text: str | None) -> list[tuple[str, str]]:
    """The entries of one element with a flag each: ``ok``, ``malformed_quote`` or ``unclosed_bracket``."""
    if text is None:
        return []
    if not _HINT.search(text):
        one = text.strip()
        one = one[m.end() :].strip() if (m := _NUMBER.match(one)) else one
        return [(one, "ok")] if one else []
    flag = "ok"
    if m := _BENCH.match(text):
        text, flag = m[1], "ok" if m[2] else "unclosed_bracket"
    items = _parse_list(text)
    if len(items) > 1 and (m := _TAIL.search(items[-1][0])) and m.start():
        items[-1] = (items[-1][0][: m.start()].strip(), items[-1][1])
    elif len(items) > 1 and re.fullmatch(r"JJ\.?", items[-1][0]):
        items = items[:-1]
    return [(x, flag if f == "ok" else f) for x, f in items if x]


_COMMA, _PAIR, _DIGIT = re.compile("[,，]"), re.compile(r"&|\sand\s", re.I), re.compile(r"\d")


def _parse_list(s: str) -> list[tuple[str, str]]:
    out: list[tuple[str, str]] = []
    i, n = 0, len(s)
    # alternatives that need a letter which the list lacks are not tried
    comma, pair, digit = _COMMA.search(s), _PAIR.search(s), _DIGIT.search(s)
    while i < n:
        if m := (_NUMBER.match(s, i) if digit else None) or _SEPARATOR.match(s, i):
            i = m.end()
            continue
        flag = "ok"
        if s[i] == '"':
            if m := _QUOTED.match(s, i):
                value, i = m[1].replace('""', '"'), m.end()
            else:  # backtrack: a stray quote is ordinary text
                flag = "malformed_quote"
                m = _PLAIN.match(s, i)
                value, i = m[0], m.end()
        elif m := (_FIRM.match(s, i) if pair else None) or (_INVERTED.match(s, i) if comma else None) or _PLAIN.match(s, i):
            value, i = m[0], m.end()
        else:  # a stray closing bracket
            i += 1
            continue
        while comma and (m := _ROLE.match(s, i)):
            value, i = value + m[0], m.end()
        if value := value.strip():
            out.append((value, flag))
    return out


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, fields, lists = b.column(0), b.column(1), b.column(2).to_pylist()
        at, pos, el, entry, flags, many = [], [], [], [], [], []
        for row, elements in enumerate(lists):
            parsed = [parse_packed(x) for x in elements]
            most, p = max(map(len, parsed), default=0), 0
            for e, entries in enumerate(parsed, 1):
                for value, flag in entries:
                    p += 1
                    at.append(row)
                    pos.append(p)
                    el.append(e)
                    entry.append(value)
                    flags.append(flag)
                    many.append(most > 1)
        idx = pa.array(at, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [ids.take(idx), fields.take(idx), pa.array(pos, pa.int32()), pa.array(el, pa.int32()), pa.array(entry, pa.string()), pa.array(flags, pa.string()), pa.array(many, pa.bool_())],
            ["id", "field_name", "pos", "element_no", "entry", "flag", "is_packed"],
        )


def split_packed(df: DataFrame, id_col: str, fields: dict[str, Column], only_packed: bool = False) -> DataFrame:
    """One row per value of each list column: (id, field_name, pos, element_no, entry, flag, is_packed).

    ``pos`` counts through the whole list; ``is_packed`` says that some element of the list held several values. Lists without
    any delimiter never leave the JVM; with ``only_packed`` only lists that hold a packed element come out.
    """
    long = df.select(
        F.col(id_col).alias("id"),
        F.explode(F.array(*[F.struct(F.lit(name).alias("field_name"), c.cast("array<string>").alias("elements")) for name, c in fields.items()])).alias("s"),
    ).select("id", "s.field_name", "s.elements")
    long = long.where(F.size("elements") > 0)
    hint = F.exists("elements", lambda x: x.rlike(_JVM_HINT))
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, field_name string, pos int, element_no int, entry string, flag string, is_packed boolean"
    parsed = long.where(F.coalesce(hint, F.lit(False))).mapInArrow(_batches, schema)
    if only_packed:
        return parsed.where("is_packed")
    strip = lambda x: F.regexp_replace(F.regexp_replace(x, f"^{_JVM_SPACE}+|{_JVM_SPACE}+$", ""), rf"^(\(\p{{Nd}}{{1,3}}\)|\p{{Nd}}{{1,3}}[.)]){_JVM_SPACE}+", "")
    bare = (
        long.where(~F.coalesce(hint, F.lit(False)))
        .select("id", "field_name", F.transform("elements", lambda x, i: F.struct((i + 1).cast("int").alias("element_no"), strip(x).alias("entry"))).alias("e"))
        .select("id", "field_name", F.filter("e", lambda x: F.length(x["entry"]) > 0).alias("e"))
        .select("id", "field_name", F.posexplode("e").alias("p", "x"))
        .select("id", "field_name", (F.col("p") + 1).cast("int").alias("pos"), "x.element_no", "x.entry", F.lit("ok").alias("flag"), F.lit(False).alias("is_packed"))
    )
    return parsed.unionByName(bare)


def entries_in(df: DataFrame, *columns: Column) -> Column:
    """Array of the given string columns and arrays as one array; nulls are left out."""
    return F.array_compact(reduce(lambda a, b: F.concat(a, b), columns))
