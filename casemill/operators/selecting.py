"""Pick the primary value of a list: case number, court, date. Everything works on arrays, without a shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from casemill.functions import rules
from casemill.functions.text import distinct_ci


def _spaced(a: Column) -> Column:
    """Elements that differ from earlier ones in more than case and white space, in order."""
    keys = F.transform(a, lambda x: F.lower(F.regexp_replace(F.btrim(x), r"\s+", " ")))
    return F.filter(a, lambda x, i: F.array_position(keys, F.lower(F.regexp_replace(F.btrim(x), r"\s+", " "))) == i + 1)


def _first_best(a: Column, score) -> Column:  # noqa: ANN001
    """The element with the highest score, the first among equals; null for an empty array."""
    scored = F.transform(a, lambda x, i: F.struct(score(x).alias("s"), (-i).alias("i"), x.alias("v")))
    return F.array_max(scored)["v"]


def primary_case_number(a: Column) -> Column:
    """The first with the first priority word that any has, else the longest."""
    u = F.transform(_spaced(F.array_compact(a)), lambda x: F.btrim(x))
    n = len(rules.CASE_NUMBER_PRIORITY)

    def score(x: Column) -> Column:
        rank = reduce(lambda acc, p: F.when(F.lower(x).contains(p[1]), n - p[0]).otherwise(acc), reversed(list(enumerate(rules.CASE_NUMBER_PRIORITY))), F.lit(0))
        return F.struct(rank.alias("r"), F.when(rank == 0, F.length(x)).otherwise(0).alias("l"))

    return _first_best(u, score)


def court_score(c: Column) -> Column:
    n = F.lower(c)
    return (
        F.when(n.contains("supreme court"), 100)
        .when(n.contains("high court of judicature") | n.rlike(r"high court of\b"), 80)
        .when(n.contains("high court"), 70)
        .when(n.contains("district court"), 40)
        .when(n.contains("judicial magistrate"), 30)
        .otherwise(10)
    )


def primary_court(a: Column) -> Column:
    u = F.filter(F.transform(F.array_compact(a), lambda x: F.regexp_replace(F.btrim(x), r"\s+", " ")), lambda x: x != "")
    best = _first_best(distinct_ci(u), court_score)
    best = F.regexp_replace(best, r"(?i)\bSUPREME COURT OF INDIA\b", "Supreme Court of India")
    return F.btrim(F.regexp_replace(best, r"(?i)\bHIGH COURT OF JUDICATURE AT\b", "High Court of"))


def parse_date(c: Column) -> Column:
    """The date of a value, null if no format fits; two-digit years from 69 are of the last century."""
    s = F.regexp_replace(F.regexp_replace(F.btrim(c), r"(?i)(\d)(?:st|nd|rd|th)\b", "$1"), r"\s+", " ")
    plain = ["d MMMM yyyy", "d MMM yyyy", "d.M.yyyy", "d/M/yyyy", "d-M-yyyy", "d MMMM, yyyy", "d MMM, yyyy", "d M yyyy"]
    t = F.coalesce(*[F.when(s.rlike(r"\d{4}$"), F.try_to_timestamp(s, F.lit(f))) for f in plain])
    short = F.coalesce(*[F.when(s.rlike(r"\D\d{2}$"), F.try_to_timestamp(s, F.lit(f))) for f in ("d.M.yy", "d/M/yy", "d-M-yy")])
    short = F.when(F.year(short) >= 2069, F.add_months(short.cast("date"), -1200).cast("timestamp")).otherwise(short)
    inner = F.concat_ws(" ", F.regexp_extract(s, r"(\d{1,2})\s+([A-Za-z]{3,9})\s+(\d{4})", 1), F.initcap(F.regexp_extract(s, r"(\d{1,2})\s+([A-Za-z]{3,9})\s+(\d{4})", 2)), F.regexp_extract(s, r"(\d{1,2})\s+([A-Za-z]{3,9})\s+(\d{4})", 3))
    return F.coalesce(t, short, F.try_to_timestamp(inner, F.lit("d MMMM yyyy")), F.try_to_timestamp(inner, F.lit("d MMM yyyy"))).cast("date")


def primary_date(a: Column, as_of: Column, header: Column | None = None) -> Column:
    """A date found in the header, else the latest not after ``as_of``, else the first."""
    u = distinct_ci(F.filter(F.transform(F.array_compact(a), lambda x: F.btrim(x)), lambda x: x != ""))
    dated = F.filter(F.transform(u, lambda x, i: F.struct(parse_date(x).alias("d"), (-i).alias("i"), x.alias("v"))), lambda s: s["d"].isNotNull() & (s["d"] <= as_of))
    best = F.coalesce(F.array_max(dated)["v"], F.try_element_at(u, F.lit(1)))
    if header is None:
        return best
    return F.coalesce(F.try_element_at(F.filter(u, lambda x: F.contains(F.lower(header), F.lower(x))), F.lit(1)), best)
