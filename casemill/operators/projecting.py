"""Field requests: names as people write them to fields of a record, and records to report lines and JSON."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemill.functions import rules, text

CAPS = {"precedents": 15, "provisions": 20, "statutes": 15, "lower_courts": 10, "other_dates": 10, "background_facts": 8}


def resolve_field(name: str | None, strict: bool = False) -> str | None:
    """The field that a name asks for: an alias, else the first alias that holds it or is held by it, else the name itself.

    ``strict`` takes canonical names first, so that 'lower_courts' isn't read as 'court'.
    """
    if name is None:
        return None
    asked = name.lower().strip()
    fields = [f for f, _, _ in rules.FIELDS]
    if strict and asked in fields:
        return asked
    for alias, field in rules.FIELD_ALIASES:
        if asked == alias:
            return field
    for alias, field in rules.FIELD_ALIASES:
        if asked in alias or alias in asked:
            return field
    plain = asked.replace(" ", "_")
    return plain if plain in fields else None


def resolve_fields(names: Iterable[str | None], strict: bool = False) -> list[str]:
    """Fields in the order of the request, each once."""
    return list(dict.fromkeys(f for n in names if (f := resolve_field(n, strict))))


def requested_names(fields: str | None) -> list[str]:
    """The names of a comma list, without outer spaces; null or '' asks for nothing."""
    return [x.strip() for x in fields.split(",")] if fields else []


def named_in_list(fields: Column) -> Column:
    """``requested_names`` as an expression."""
    return F.when(F.length(fields) > 0, F.transform(F.split(fields, ","), lambda x: F.btrim(x))).otherwise(F.array().cast("array<string>"))


def available(df: DataFrame) -> Column:
    """The fields of a record that hold something, in catalogue order."""
    return F.array_compact(F.array(*[F.when(_present(df, f), F.lit(f)) for f, _, _ in rules.FIELDS if f in df.columns]))


def _present(df: DataFrame, f: str) -> Column:
    c, kind = F.col(f), df.schema[f].dataType.typeName()
    return F.coalesce(F.size(c) > 0 if kind == "array" else F.length(c) > 0 if kind == "string" else c.isNotNull(), F.lit(False))


def requested_records(records: DataFrame, requests: DataFrame, id_col: str, names: str) -> DataFrame:
    """(id_col, pos, field, json, error, requested, available): a row for each requested field that its record holds, in the
    order of the request; a single row with ``error`` where none is held. Requests without a record give an error row too."""
    held = records.select(id_col, available(records).alias("available"), F.map_from_entries(F.array(*[F.struct(F.lit(f), F.to_json(F.struct(F.col(f).alias("v")))) for f, _, _ in rules.FIELDS if f in records.columns])).alias("values"))
    asked = F.array_distinct(F.filter(F.transform(F.col(names), resolved), lambda f: f.isNotNull()))
    r = requests.select(id_col, F.col(names).alias("requested"), asked.alias("fields")).join(held, id_col, "left").withColumn("available", F.coalesce("available", F.array().cast("array<string>")))
    got = F.filter("fields", lambda f: F.array_contains("available", f))
    rows = F.when(F.size(got) > 0, F.transform(got, lambda f, i: F.struct((i + 1).cast("bigint").alias("pos"), f.alias("field"), F.try_element_at("values", f).alias("json"), F.lit(None).cast("string").alias("error")))).otherwise(F.array(F.struct(F.lit(0).cast("bigint").alias("pos"), F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("json"), F.lit("No matching fields").alias("error"))))
    wrong = lambda c: F.when(F.col("e.error").isNotNull(), F.col(c)).alias(c)
    return r.select(id_col, F.explode(rows).alias("e"), "requested", "available").select(id_col, "e.*", wrong("requested"), wrong("available"))


def filtered_report_lines(records: DataFrame, requests: DataFrame, id_col: str, names: str) -> DataFrame:
    """(id_col, section_no, section, item_no, line): report lines of the requested fields only, sections in request order."""
    parts = {"for_appellants": "advocates", "for_respondent": "advocates", "background_facts": "content_info", "result": "content_info", "decision": "content_info"}
    lines = report_lines(records, id_col)
    of = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in parts.items() for x in kv]), F.col("section")), F.col("section"))
    asked = field_requests(requests, id_col, names)
    from pyspark.sql import Window

    got = lines.withColumn("field", of).join(asked, [id_col, "field"])
    rank = F.dense_rank().over(Window.partitionBy(id_col).orderBy("pos", "section_no")).cast("bigint")
    return got.select(id_col, rank.alias("section_no"), "section", "item_no", "line")


def project(df: DataFrame, id_col: str, names: Iterable[str]) -> DataFrame:
    """The requested fields only; resolved on the driver, so the scan reads no other column."""
    return df.select(id_col, *[f for f in resolve_fields(names) if f in df.columns])


def resolved(name: Column) -> Column:
    """``resolve_field`` as an expression, for requests that are data."""
    asked = F.lower(F.btrim(name))
    out = F.lit(None).cast("string")
    plain = F.replace(asked, F.lit(" "), F.lit("_"))
    out = F.when(plain.isin([f for f, _, _ in rules.FIELDS]), plain)
    for alias, field in reversed(rules.FIELD_ALIASES):
        out = F.when(F.contains(F.lit(alias), asked) | asked.contains(alias), field).otherwise(out)
    for alias, field in reversed(rules.FIELD_ALIASES):
        out = F.when(asked == alias, field).otherwise(out)
    return out


def field_requests(df: DataFrame, id_col: str, names: str) -> DataFrame:
    """(id_col, pos, field): the fields of each request in order, each once."""
    r = df.select(id_col, F.posexplode(names).alias("i", "name")).select(id_col, "i", resolved(F.col("name")).alias("field")).where("field IS NOT NULL")
    first = r.groupBy(id_col, "field").agg(F.min("i").alias("i"))
    from pyspark.sql import Window

    return first.select(id_col, F.row_number().over(Window.partitionBy(id_col).orderBy("i")).cast("bigint").alias("pos"), "field")


def report_lines(df: DataFrame, id_col: str) -> DataFrame:
    """(id_col, section_no, section, item_no, line): the lines of a full report, escaped, lists capped."""
    one = lambda c: F.array(F.nullif(c, F.lit("")))
    many = lambda f, n: F.slice(F.coalesce(F.col(f), F.array().cast("array<string>")), 1, n)
    o = "content_info.order_summary"
    sections = [
        ("case_name", one(F.col("case_name"))), ("appeal_number", one(F.col("appeal_number"))), ("court", one(F.col("court"))), ("date_of_judgment", one(F.col("date_of_judgment"))),
        ("coram", F.col("coram")), ("appellants", F.col("appellants")), ("respondent", one(F.col("respondent"))), ("for_appellants", F.col("advocates.for_appellants")), ("for_respondent", F.col("advocates.for_respondent")),
        *[(k, many(k, CAPS[k])) for k in ("precedents", "provisions", "statutes", "lower_courts", "other_dates")],
        ("background_facts", many("content_info.background_facts", CAPS["background_facts"])), ("result", one(F.col(f"{o}.result"))), ("decision", one(F.col(f"{o}.decision"))),
    ]
    rows = [_section(n, name, a) for n, (name, a) in enumerate(sections, 1)]
    return df.select(id_col, F.explode(F.flatten(F.array(*rows))).alias("l")).select(id_col, "l.*")


def _section(no: int, name: str, items: Column) -> Column:
    kept = F.array_compact(F.coalesce(items, F.array().cast("array<string>")))
    return F.transform(kept, lambda x, i: F.struct(F.lit(no).cast("bigint").alias("section_no"), F.lit(name).alias("section"), (i + 1).cast("bigint").alias("item_no"), text.safe_text(x).alias("line")))


def sparse_json(df: DataFrame, id_col: str) -> DataFrame:
    """(id_col, json): the record without empty fields."""
    fields = []
    for f, _, kind in rules.FIELDS:
        if f in df.columns:
            c = F.col(f)
            fields.append((F.when(F.size(c) > 0, c) if kind == "list" and df.schema[f].dataType.typeName() == "array" else F.when(F.length(c) > 0, c) if kind == "string" else c).alias(f))
    return df.select(id_col, F.to_json(F.struct(*fields)).alias("json"))


def field_catalog(spark) -> DataFrame:  # noqa: ANN001
    return spark.createDataFrame(rules.FIELDS, "name string, description string, type string")


def page_numbers(lines: DataFrame, id_col: str, order: list[str], per_page: int = 40) -> DataFrame:
    """Add page_no and n_pages to report lines: two-pass numbering as windows."""
    from pyspark.sql import Window

    w = Window.partitionBy(id_col)
    n = F.row_number().over(w.orderBy(*order))
    return lines.withColumn("page_no", (F.floor((n - 1) / per_page) + 1).cast("bigint")).withColumn("n_pages", F.ceil(F.count("*").over(w) / per_page).cast("bigint"))
