"""Split a judgment into header, body and order without a shuffle.

States only move forward, so each border is a first position in the array of lines: the order starts at the first order marker;
the body at the first body heading, at the 52nd written line, or at the first line that is no header line and holds a verb.
Null and empty texts give three empty segments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemill.functions import rules

LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\u0085\u2028\u2029]"
HEADER_LINES = 51


def lines_of(text: Column) -> Column:
    """The stripped lines of a text; blank lines are empty strings."""
    return F.transform(F.split(F.coalesce(text, F.lit("")), LINE_END), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))


def is_header_line(line: Column) -> Column:
    marked = F.lit(False)
    lower = F.lower(line)
    for m in rules.HEADER_MARKERS:
        marked = marked | lower.contains(m.lower())
    capitals = line.rlike(rules.HEADER_CAPITALS) & (F.size(F.split(line, r"\s+")) <= 12)
    return (line != "") & (capitals | marked | line.rlike(rules.HEADER_CAPTION) | line.rlike(rules.HEADER_NUMBER))


def is_order_start(line: Column) -> Column:
    return line.rlike(rules.ORDER_START)


def _first(lines: Column, test) -> Column:  # noqa: ANN001
    """1-based position of the first line that passes, null if none does."""
    return F.nullif(F.array_position(F.transform(lines, test), F.lit(True)), F.lit(0).cast("bigint"))


def with_borders(df: DataFrame, text: str) -> DataFrame:
    """Add ``_lines``, ``_body`` and ``_order``: the lines and the positions where body and order start (null: never)."""
    df = df.withColumn("_lines", lines_of(F.col(text)))
    lines = F.col("_lines")
    written = F.filter(F.transform(lines, lambda x, i: F.when(x != "", i + 1)), lambda i: i.isNotNull())
    starts = _first(lines, lambda x: (x != "") & (x.rlike(rules.BODY_START) | (~is_header_line(x) & x.rlike(rules.BODY_VERBS))))
    return df.withColumn("_order", _first(lines, is_order_start)).withColumn("_body", F.least(starts, F.try_element_at(written, F.lit(HEADER_LINES + 1)).cast("bigint")))


def split_segments(df: DataFrame, text: str) -> DataFrame:
    """Add header, body and order_text; a clash with existing columns is an error."""
    if clash := {"header", "body", "order_text"} & set(df.columns):
        raise ValueError(f"columns exist already: {sorted(clash)}")
    d = with_borders(df, text)
    n = F.size("_lines") + 1
    order = F.coalesce("_order", n)
    body = F.least(F.coalesce("_body", n), order)
    # slices are taken with lengths of at least 0, so the positions need no case distinction
    part = lambda a, b: F.slice("_lines", F.least(a, F.size("_lines")).cast("int"), F.greatest(b - a, F.lit(0)).cast("int"))
    written = lambda a: F.array_join(F.filter(a, lambda x: x != ""), "\n")
    d = d.withColumn("header", written(part(F.lit(1), body)))
    d = d.withColumn("_b", F.regexp_replace(F.regexp_replace(F.array_join(part(body, order), "\n"), r"\n{3,}", "\n\n"), r"^\s+|\s+$", ""))
    d = d.withColumn("_o", written(part(order, n)))
    at = F.when((F.col("_o") == "") & (F.col("_b") != ""), F.expr(r"nullif(regexp_instr(_b, '(?i)(?:\\n|^)(?:Held:|ORDER|O R D E R:)'), 0)"))
    d = d.withColumn("_at", at)
    trimmed = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    d = d.withColumn("body", F.when(F.col("_at").isNotNull(), trimmed(F.expr("substring(_b, 1, _at - 1)"))).otherwise(F.col("_b")))
    d = d.withColumn("order_text", F.when(F.col("_at").isNotNull(), trimmed(F.expr("substring(_b, _at)"))).otherwise(F.col("_o")))
    return d.drop("_lines", "_body", "_order", "_b", "_o", "_at")
