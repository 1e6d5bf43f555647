"""Normalise timestamps written in many formats, precisions and time zones to one unambiguous form.

One regular expression takes a cleaned value apart in a single pass over Arrow batches; zones are applied in the JVM. Values
without a zone are local time of their place. The place's offset history (an IANA zone) is estimated from all its rows as the
candidate with the fewest violations (``estimate_zones``). A declared zone stands unless the rows speak clearly against it.

Results: ``yyyy-MM`` for a month, ``yyyy-MM-dd`` for a day, ``yyyy-MM-ddTHH:mm:ss.SSSSSSZ`` for a moment. A local time that
occurs twice is the earlier one; one that is skipped takes the offset before the change. Null, empty, unreadable and impossible
values, and values that need a place where none is known, give null. Texts of any length are tried whole. Sessions must run in UTC.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Names of months, and minutes east of UTC that a zone abbreviation may mean.
_MON = "jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?"
_DAY = "mon(?:day)?|tue(?:s(?:day)?)?|wed(?:nesday)?|thu(?:rs(?:day)?)?|fri(?:day)?|sat(?:urday)?|sun(?:day)?"
ABBREVIATIONS = {
    "gmt": [0], "wet": [0], "bst": [60, 360], "ist": [330, 60, 120], "cet": [60], "cest": [120], "west": [60], "eet": [120], "eest": [180], "msk": [180], "eat": [180], "cat": [120], "wat": [60], "sast": [120],
    "est": [-300, 600], "edt": [-240, 660], "cst": [-360, 480, 570], "cdt": [-300, 630], "mst": [-420], "mdt": [-360], "pst": [-480], "pdt": [-420], "akst": [-540], "akdt": [-480], "hst": [-600], "ast": [-240, 180], "adt": [-180],
    "aest": [600], "aedt": [660], "acst": [570], "acdt": [630], "awst": [480], "nzst": [720], "nzdt": [780], "jst": [540], "kst": [540], "hkt": [480], "sgt": [480], "npt": [345], "pkt": [300], "gst": [240], "wib": [420], "myt": [480], "pht": [480], "ict": [420],
}

_PATTERN = (
    r"^(?:(\d{12,13}|\d{9,10})"  # 1 seconds or milliseconds since 1970
    r"|(?:(\d{4})([-/.])(\d{1,2})\3(\d{1,2})"  # 2 year 4 month 5 day
    r"|(\d{4})(\d{2})(\d{2})"  # 6 year 7 month 8 day
    r"|(\d{1,2})([-/. ])(\d{1,2})\10(\d{4}|\d{2})"  # 9 and 11 day and month 12 year
    rf"|(\d{{1,2}})[ -]?({_MON})\.?,?[ -]?(\d{{4}}|\d{{2}})"  # 13 day 14 month 15 year
    rf"|({_MON})\.? ?(\d{{1,2}}),? (\d{{4}}))"  # 16 month 17 day 18 year
    r"(?:(?:t|,? ?(?:at )?)(\d{1,2})[:.](\d{2})(?:[:.](\d{2})(?:[.,](\d{1,9}))?)?(?: ?([ap])\.?m\.?)?(?: ?h(?:ou)?rs\.?)?"  # 19 h 20 min 21 s 22 fraction 23 a/p
    r" ?(z|utc|(?:gmt|utc) ?[+-]\d{1,2}:?\d{2}|[+-]\d{2}:?\d{2}|[a-z]{2,5})?)?"  # 24 zone
    rf"|({_MON})\.?,? (\d{{4}})|(\d{{4}})[-/](\d{{1,2}}))$"  # 25 month 26 year, 27 year 28 month
)


_RE = re.compile(_PATTERN)
_LEAD = re.compile(rf"(?:(?:dated?|dt)\b[.:]? *)?(?:this )?(?:the )?(?:(?:{_DAY})\.?,? +)?")
_ORDINAL = re.compile(r"(?<=\d)(?:st|nd|rd|th)\b")
_MONTHS = {m: i for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1)}
_EPOCH = datetime(1970, 1, 1)


def _year(y: str) -> int:
    n = int(y)
    return n if len(y) > 2 else n + (1900 if n >= 50 else 2000)


def _date(y: int, m: int, d: int) -> datetime | None:
    try:
        return datetime(y, m, d)
    except ValueError:
        return None


def parse_value(value: str | None, order: str | None) -> tuple[str, str | None, int | None, list[int] | None] | None:
    """(kind, text, microseconds of the local clock since 1970, offsets it may have) of one value, or None.

    kind is month, day, epoch or clock; a clock without a zone has no offsets, one with an abbreviation has all that it may
    mean and needs its place (kind ``named``). ``order`` is 'dmy', 'mdy' or None, if it isn't known.
    """
    if not value:
        return None
    s = value.strip().lower()
    s = _ORDINAL.sub("", s[_LEAD.match(s).end() :]).replace(" day of ", " ")
    if (m := _RE.match(s)) is None:
        return None
    g = m.group
    if g(1):
        return "epoch", None, int(g(1)) * (1000 if len(g(1)) > 10 else 1_000_000), [0]
    if g(25) or g(27):
        y, mo = (int(g(26)), _MONTHS[g(25)[:3]]) if g(25) else (int(g(27)), int(g(28)))
        return ("month", f"{y:04d}-{mo:02d}", None, None) if 1 <= mo <= 12 and y else None
    if g(2):
        day = _date(int(g(2)), int(g(4)), int(g(5)))
    elif g(6):
        day = _date(int(g(6)), int(g(7)), int(g(8)))
    elif g(9):
        y, a, b = _year(g(12)), int(g(9)), int(g(11))
        dmy, mdy = _date(y, b, a), _date(y, a, b)
        if dmy and mdy and dmy != mdy:
            day = {"dmy": dmy, "mdy": mdy}.get(order)
        else:
            day = dmy or mdy
    elif g(13):
        day = _date(_year(g(15)), _MONTHS[g(14)[:3]], int(g(13)))
    else:
        day = _date(int(g(18)), _MONTHS[g(16)[:3]], int(g(17)))
    if day is None:
        return None
    if not g(19):
        return "day", f"{day:%Y-%m-%d}" if day.year > 999 else f"{day.year:04d}-{day.month:02d}-{day.day:02d}", None, None
    h, mi, sec = int(g(19)), int(g(20)), int(g(21) or 0)
    if g(23) and h <= 12:
        h = h % 12 + (12 if g(23) == "p" else 0)
    if h > 23 or mi > 59 or sec > 59:
        return None
    micros = (day - _EPOCH).days * 86_400_000_000 + (h * 3600 + mi * 60 + sec) * 1_000_000 + int((g(22) or "").ljust(6, "0")[:6])
    zone = g(24) or ""
    if zone in ("", "z", "utc"):
        return "clock", None, micros, [0] if zone else []
    if m := re.search(r"([+-])(\d{1,2}):?(\d{2})$", zone):
        return "clock", None, micros, [(-1 if m[1] == "-" else 1) * (int(m[2]) * 60 + int(m[3]))]
    return "named", None, micros, ABBREVIATIONS.get(zone, [])


def parse_columns(df: DataFrame, value: str, order: str) -> DataFrame:
    """Add ``_kind``, ``_text``, ``_local`` (clock time as if UTC) and ``_offsets`` (minutes) in one Arrow pass.

    ``order`` names a column with 'dmy', 'mdy' or null (unknown).
    """
    schema = T.StructType([*df.schema.fields, *(T.StructField(n, t) for n, t in (("_kind", T.StringType()), ("_text", T.StringType()), ("_local", T.TimestampType()), ("_offsets", T.ArrayType(T.IntegerType()))))])
    at, by = df.columns.index(value), df.columns.index(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [parse_value(v, o) or (None,) * 4 for v, o in zip(b.column(at).to_pylist(), b.column(by).to_pylist())]
            kind, text, local, zone = zip(*got) if got else ((),) * 4
            new = [pa.array(kind, pa.string()), pa.array(text, pa.string()), pa.array(local, pa.int64()).cast(pa.timestamp("us", tz="UTC")), pa.array(zone, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], names=[*b.schema.names, "_kind", "_text", "_local", "_offsets"])

    return df.mapInArrow(run, schema)


BUSY = 2 / 3  # an hour of work has at least this share of the clock times that the busiest hour has
MARGIN = 0.2  # a declared zone gives way if another has fewer violations by more than this share of the place's values, and 5


def hours_of_work(parsed: DataFrame) -> list[int]:
    """The hours in which most clock times without zone lie (see ``BUSY``); without such times the whole day."""
    rows = parsed.where("_kind = 'clock' AND size(_offsets) = 0").groupBy(F.hour("_local").alias("h")).agg(F.count("*").alias("n")).collect()  # 24 at most
    most = max((r["n"] for r in rows), default=0)
    return sorted(r["h"] for r in rows if r["n"] >= BUSY * most) or list(range(24))


def estimate_zones(parsed: DataFrame, place: str, bounds: list[str], candidates: list[str], declared: str | None = None) -> DataFrame:
    """(place, zone_name, n_values, violations, is_declared, estimated_zone, least_violations): the offset history of each place.

    ``parsed`` comes from ``parse_columns``; ``bounds`` are UTC columns that a value can't lie after; ``candidates`` is a short
    list of IANA zones. Violations of a zone:

    - a clock time without zone that, read with it, lies after the moment the row was keyed or ingested;
    - a moment that is known in UTC (from 1970, or with an offset) but falls, on this zone's clock, outside the hours in which the
      clock times without zone lie: known moments and local times are of one kind, so their clocks must agree;
    - a moment whose offset isn't UTC's and isn't the zone's at that time.

    Of zones with equally few, the one that leaves the least time to the bounds is meant, then the first by name. Counts combine
    before the shuffle, so one place may hold most of the rows. Null places and other kinds of values are left out.
    """
    hours = hours_of_work(parsed)
    lean = parsed.where(F.col(place).isNotNull() & F.col("_kind").isin("clock", "epoch"))
    known = F.size("_offsets") > 0
    offset = F.try_element_at("_offsets", F.lit(1))
    moment = F.timestamp_micros(F.unix_micros("_local") - F.coalesce(offset, F.lit(0)).cast("bigint") * F.lit(60_000_000))
    lean = lean.select(place, "_local", known.alias("_known"), F.when(offset != 0, offset).alias("_off"), moment.alias("_utc"), F.least(*[F.col(b) for b in bounds]).alias("_bound") if len(bounds) > 1 else F.col(bounds[0]).alias("_bound"), (F.col(declared) if declared else F.lit(None).cast("string")).alias("_declared"))
    sums = [F.count("*").alias("n_values"), F.max("_declared").alias("declared")]
    for i, z in enumerate(candidates):
        there = F.from_utc_timestamp("_utc", F.lit(z))
        late = F.coalesce((F.to_utc_timestamp("_local", F.lit(z)) > F.col("_bound")).cast("int"), F.lit(0))
        odd = (~F.hour(there).isin(hours)).cast("int")
        other = F.coalesce(((F.unix_seconds(there) - F.unix_seconds("_utc")) != F.col("_off") * 60).cast("int"), F.lit(0))
        sums.append(F.sum(F.when(F.col("_known"), odd + other).otherwise(late)).alias(f"v{i}"))
        sums.append(F.coalesce(F.sum(F.when(~F.col("_known"), F.unix_seconds("_bound") - F.unix_seconds(F.to_utc_timestamp("_local", F.lit(z))))), F.lit(0)).alias(f"g{i}"))
    per = lean.groupBy(place).agg(*sums)
    options = F.array(*[F.struct(F.col(f"v{i}").alias("violations"), F.col(f"g{i}").alias("gap"), F.lit(z).alias("zone_name")) for i, z in enumerate(candidates)])
    best = F.array_min(options)
    own = F.try_element_at(F.filter(options, lambda o: o["zone_name"] == F.col("declared")), F.lit(1))
    stands = F.coalesce(own["violations"] - best["violations"] <= F.greatest(F.lit(5), MARGIN * F.col("n_values")), F.lit(False))
    taken = per.select(place, "n_values", best.alias("best"), F.when(stands, own).otherwise(best).alias("t"), F.col("declared"))
    return taken.select(place, "t.zone_name", "n_values", "t.violations", F.col("t.zone_name").eqNullSafe(F.col("declared")).alias("is_declared"), F.col("best.zone_name").alias("estimated_zone"), F.col("best.violations").alias("least_violations"))


def normal_form(df: DataFrame, value: str, order: str, zone: str) -> DataFrame:
    """Add ``normal_form`` for ``value``; ``zone`` is the column with the place's IANA zone (null: unknown)."""
    return with_normal_form(parse_columns(df, value, order), zone)


def with_normal_form(p: DataFrame, zone: str) -> DataFrame:
    """``normal_form`` for rows of ``parse_columns``, whose columns go."""
    tz = F.col(zone)
    shifted = lambda m: F.timestamp_micros(F.unix_micros("_local") - m.cast("bigint") * F.lit(60_000_000))
    own = F.filter("_offsets", lambda m: F.from_utc_timestamp(shifted(m), tz) == F.col("_local"))  # what the place's zone observes then
    offset = F.when(F.col("_kind") == "clock", F.try_element_at("_offsets", F.lit(1))).when(tz.isNotNull(), F.coalesce(F.try_element_at(own, F.lit(1)), F.try_element_at("_offsets", F.lit(1))))
    utc = F.when(offset.isNotNull(), shifted(offset)).otherwise(F.to_utc_timestamp("_local", tz))
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    form = F.when(F.col("_kind").isin("month", "day"), F.col("_text")).when(F.col("_kind") == "epoch", stamp(F.col("_local"))).otherwise(stamp(utc))
    return p.withColumn("normal_form", form).drop("_kind", "_text", "_local", "_offsets")
