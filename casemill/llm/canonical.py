"""One consistent form for text that looks the same but is stored in different characters.

DuckDB runs inside each Arrow partition: one SQL statement removes invisible characters, maps spaces, compatibility forms and
look-alike letters with ``regexp_replace`` and ``translate``, and composes accents with ``nfc_normalize``. Texts that are plain
printable ASCII already pass unchanged through the same statement's first branch.

Defined results: null stays null; an empty text, or one of invisible characters only, becomes ''; texts of any length are
processed whole; other columns, whatever their names, are left alone.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters of other scripts that print like a Latin letter, and that letter.
LOOKALIKES = {
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J", "Ԛ": "Q", "Ԝ": "W", "Ғ": "F", "Ё": "Ë", "Ї": "Ï",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "ԛ": "q", "ԝ": "w", "һ": "h", "ԁ": "d", "ԍ": "g", "ѵ": "v", "ё": "ë", "ї": "ï",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ά": "Á", "Έ": "É", "Ί": "Í", "Ό": "Ó", "Ϊ": "Ï", "Ϋ": "Ÿ",
    "ο": "o", "ν": "v", "ϲ": "c", "ϳ": "j", "ό": "ó", "ɡ": "g", "ɑ": "a", "‐": "-", "‑": "-",
}
# Ligatures and the letters a reader sees.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}


def _tables() -> tuple[dict[str, str], dict[str, str], str, str]:
    """Common compatibility forms, rare font forms, spaces and invisible characters, from the Unicode database by rule."""
    wide, font, spaces, hidden = {}, {}, "", ""
    for cp in [*range(0x80, 0x3300), *range(0xFE00, 0x10000), *range(0x1D400, 0x1D800), *range(0xE0000, 0xE0200)]:
        ch = chr(cp)
        kind, _, to = unicodedata.decomposition(ch).partition("> ")
        cat = unicodedata.category(ch)
        if cat == "Zs":
            spaces += ch
        elif (cat == "Cf" and not (0x600 <= cp <= 0x605 or cp in (0x6DD, 0x70F, 0x8E2))) or cp in (0x34F, 0x115F, 0x1160, 0x3164, 0xFFA0) or 0xFE00 <= cp <= 0xFE0F or 0x180B <= cp <= 0x180F or 0xE0100 <= cp <= 0xE01EF:
            hidden += ch
        elif kind in ("<wide", "<font", "<narrow") and " " not in to:
            (wide if kind == "<wide" else font)[ch] = chr(int(to, 16))
    return wide, font, spaces, hidden


_WIDE, _FONT, _SPACES, _HIDDEN = _tables()
_class = lambda chars: "[" + "".join(f"\\x{{{ord(c):X}}}" for c in chars) + "]"
_quote = lambda s: "'" + s.replace("'", "''") + "'"


def _translate(expr: str, table: dict[str, str]) -> str:
    return f"translate({expr}, {_quote(''.join(table))}, {_quote(''.join(table.values()))})"


def canonical_sql(col: str, separator: str = "\x01") -> str:
    """DuckDB expression for the plain form of ``col``; ``separator`` splits joined list elements, whose ends are stripped too."""
    x = f"regexp_replace({col}, {_quote(_class(_HIDDEN) + '+')}, '', 'g')"
    x = f"regexp_replace({x}, {_quote(_class(_SPACES))}, ' ', 'g')"
    for lig, to in LIGATURES.items():
        x = f"replace({x}, {_quote(lig)}, {_quote(to)})"
    rare = _quote("[\\x{2100}-\\x{214F}\\x{FB20}-\\x{FB29}\\x{FF5F}-\\x{FFEE}\\x{1D400}-\\x{1D7FF}]")
    x = f"CASE WHEN regexp_matches({col}, {rare}) THEN {_translate(x, _FONT)} ELSE {x} END"
    ascii_wide = {k: v for k, v in _WIDE.items() if ord(v) < 0x7F}
    x = f"nfc_normalize({_translate(x, ascii_wide | LOOKALIKES)})"
    x = f"CASE WHEN regexp_matches({col}, '[^\\x01-\\x7e]') THEN {x} ELSE {col} END"
    return f"regexp_replace({x}, '(^|{separator}) +| +({separator}|$)', '\\1\\2', 'g')"


@contextmanager
def plain_forms() -> Iterator[Callable[[list[str]], list[str]]]:
    """A function from texts to their plain forms inside a worker: DuckDB sees the texts that aren't plain ASCII already."""
    import duckdb

    con = duckdb.connect()
    con.execute("SET threads=1")
    con.execute("SET memory_limit='512MB'")
    sql = f"SELECT {canonical_sql('s')} AS p FROM batch ORDER BY n"

    def plain(texts: list[str]) -> list[str]:
        odd = [i for i, t in enumerate(texts) if not t.isascii() or t[:1] == " " or t[-1:] == " "]
        if not odd:
            return texts
        con.register("batch", pa.table({"n": pa.array(range(len(odd)), pa.int64()), "s": pa.array([texts[i] for i in odd], pa.string())}))
        out = list(texts)
        for i, p in zip(odd, con.sql(sql).to_arrow_table().column(0).to_pylist()):
            out[i] = p
        con.unregister("batch")
        return out

    try:
        yield plain
    finally:
        con.close()


def canonicalize(df: DataFrame, columns: list[str], suffix: str = "_plain") -> DataFrame:
    """Add ``<column><suffix>`` for each string column: its plain form, computed by DuckDB inside Arrow batches.

    A clash of the new names with columns of ``df`` is an error rather than a silent overwrite.
    """
    if clash := {c + suffix for c in columns} & set(df.columns):
        raise ValueError(f"columns exist already: {sorted(clash)}")
    schema = T.StructType([*df.schema.fields, *(T.StructField(c + suffix, T.StringType()) for c in columns)])
    at = [df.columns.index(c) for c in columns]
    sql = "SELECT " + ", ".join(f"{canonical_sql(f's{i}')} AS p{i}" for i in range(len(columns))) + " FROM batch ORDER BY n"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect()
        con.execute("SET threads=1")
        con.execute("SET memory_limit='512MB'")
        for b in batches:
            t = pa.table({"n": pa.array(range(b.num_rows), pa.int64())} | {f"s{i}": b.column(k).cast(pa.string()) for i, k in enumerate(at)})
            con.register("batch", t)
            out = con.sql(sql).to_arrow_table().combine_chunks()
            con.unregister("batch")
            yield pa.RecordBatch.from_arrays([*b.columns, *(out.column(i).combine_chunks() if out.column(i).num_chunks != 1 else out.column(i).chunk(0) for i in range(len(at)))], names=[*b.schema.names, *(c + suffix for c in columns)])
        con.close()

    return df.mapInArrow(run, schema)


def joined(list_col: Column) -> Column:
    """A list as one string in which element borders and null elements are kept apart."""
    return F.array_join(F.transform(list_col, lambda x: F.coalesce(x, F.lit("\x02"))), "\x01")


def same_looking_pairs(df: DataFrame, id_col: str, group_col: str, fields: dict[str, Column]) -> DataFrame:
    """Pairs of rows of one group that look the same in a field but are not stored the same: (field_name, record_a, record_b).

    Groups with a single stored form are dropped by a combining aggregate before any pair is made, so a hot group costs pairs
    only for the rows that are results.
    """
    long = df.where(F.col(group_col).isNotNull()).select(
        F.col(id_col).alias("id"),
        F.col(group_col).alias("grp"),
        F.explode(F.array(*[F.struct(F.lit(k).alias("field_name"), c.alias("stored")) for k, c in fields.items()])).alias("f"),
    ).select("id", "grp", "f.field_name", "f.stored").where(F.col("stored").isNotNull())
    plain = canonicalize(long, ["stored"]).select("id", "field_name", F.xxhash64("grp", "field_name", "stored_plain").alias("k"), "grp", "stored_plain", "stored")
    several = plain.groupBy("k").agg(F.min("stored").alias("lo"), F.max("stored").alias("hi")).where("lo <> hi").select("k")
    few = plain.join(several, "k", "left_semi")
    a = few.select("k", "grp", "field_name", "stored_plain", F.col("stored").alias("sa"), F.col("id").alias("record_a"))
    b = few.select("k", F.col("grp").alias("grp_b"), F.col("field_name").alias("field_b"), F.col("stored_plain").alias("plain_b"), F.col("stored").alias("sb"), F.col("id").alias("record_b"))
    return (
        a.join(b, "k")
        .where("record_a < record_b AND sa <> sb AND grp = grp_b AND field_name = field_b AND stored_plain = plain_b")
        .select("field_name", "record_a", "record_b")
        .distinct()
    )
