"""Validate records: messages in three channels, completeness, grade, status, recommendations and the report of a batch.

A record is a row with the fields of a structured record; ``citations`` (a map of arrays) and ``content_info.issues`` are read if
the row has them. Missing, empty and null are the same. Years are compared with ``as_of_year``, never with the clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The fields that count for completeness, and the weight of each group.
GROUPS = [
    ("critical", ["case_name", "court", "date_of_judgment"], 50),
    ("important", ["appeal_number", "coram", "appellants", "respondent"], 30),
    ("optional", ["advocates", "precedents", "provisions", "statutes", "citations", "content_info"], 20),
]
COURT_WORDS = ["supreme court", "high court", "district", "tribunal", "court", "commission", "authority"]
DATE_FORMS = [r"\d{1,2}[/-]\d{1,2}[/-]\d{2,4}", r"\d{4}[/-]\d{1,2}[/-]\d{1,2}", r"\d{1,2}\s+\w+\s+\d{4}", r"\w+\s+\d{1,2},?\s+\d{4}"]
STATUS = [("A", "Excellent - High quality extraction"), ("B", "Good - Minor issues present"), ("C", "Fair - Several issues to review"), ("D", "Poor - Many issues present"), ("", "Failed - Critical extraction problems")]

_has = lambda df, *path: all(p in names for p, names in _walk(df, path))


def _walk(df: DataFrame, path: tuple[str, ...]) -> list[tuple[str, list[str]]]:
    out, kind = [], df.schema
    for p in path:
        names = kind.fieldNames() if hasattr(kind, "fieldNames") else []
        out.append((p, names))
        kind = kind[p].dataType if p in names else None
    return out


def present(df: DataFrame, field: str) -> Column:
    """Is the field there and not empty?"""
    if field not in df.columns:
        return F.lit(False)
    kind = df.schema[field].dataType.typeName()
    c = F.col(field)
    return F.coalesce(F.size(c) > 0 if kind in ("array", "map") else c.isNotNull() if kind == "struct" else F.length(c.cast("string")) > 0, F.lit(False))


def _any(c: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


def messages(df: DataFrame, as_of_year: int) -> Column:
    """Array of (channel, message) in the order of the rules."""
    has = {f: present(df, f) for g in GROUPS for f in g[1]}
    s = lambda f: F.col(f).cast("string")
    out: list[Column] = []

    def say(channel: str, when: Column, message: Column | str) -> None:
        m = F.lit(message) if isinstance(message, str) else message
        out.append(F.array(F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(channel).alias("channel"), m.alias("message")))))

    def count(channel: str, field: Column, most: int, message: str) -> None:
        n = F.size(field)
        say(channel, n > most, F.format_string(message.replace("{}", "%d"), n))

    name, appeal, court, date = s("case_name"), s("appeal_number"), s("court"), s("date_of_judgment")
    say("error", ~has["case_name"], "Case name is missing")
    say("warning", has["case_name"] & (F.length(name) < 5), "Case name appears too short")
    say("warning", F.length(name) > 500, "Case name appears unusually long")
    say("warning", has["case_name"] & ~_any(F.lower(name), ["vs", "v.", "versus", "and"]), "Case name may be malformed (missing 'vs' or 'v.')")
    say("warning", ~has["appeal_number"], "Appeal number not found")
    say("warning", has["appeal_number"] & ~appeal.rlike(r"(?:19|20)\d{2}"), "Appeal number missing year component")
    say("error", has["appeal_number"] & ~appeal.rlike(r"\d+"), "Appeal number missing numeric component")
    say("warning", F.length(appeal) > 100, "Appeal number appears unusually long")
    say("error", ~has["court"], "Court name is missing - critical field")
    say("warning", has["court"] & (F.length(court) < 5), "Court name appears too short")
    say("warning", has["court"] & ~_any(F.lower(court), COURT_WORDS), "Court name may not be a valid court entity")
    say("warning", ~has["date_of_judgment"], "Judgment date not found")
    say("warning", has["date_of_judgment"] & ~date.rlike("|".join(f"(?:{p})" for p in DATE_FORMS)), "Date format appears non-standard")
    year = F.nullif(F.regexp_extract(date, r"(?:19|20)\d{2}", 0), F.lit("")).cast("int")
    say("error", year > as_of_year, F.format_string("Judgment date is in the future: %d", year))
    say("warning", (year <= as_of_year) & (year < 1947), F.format_string("Judgment date is very old: %d", year))
    say("warning", ~has["coram"], "Coram (judges) not found")
    count("warning", F.col("coram"), 11, "Unusually large bench: {} judges")
    out.append(
        F.transform(
            F.coalesce(F.col("coram"), F.array().cast("array<string>")),
            lambda j: F.when(F.length(j) < 3, F.struct(F.lit("warning").alias("channel"), F.concat(F.lit("Invalid judge name: '"), j, F.lit("'")).alias("message"))).when(
                ~j.rlike("[A-Z]"), F.struct(F.lit("warning").alias("channel"), F.concat(F.lit("Judge name lacks capitalization: '"), j, F.lit("'")).alias("message"))
            ),
        )
    )
    say("warning", ~has["appellants"], "Appellants not found")
    count("warning", F.col("appellants"), 50, "Unusually high appellant count: {}")
    say("warning", F.size("appellants") != F.size(F.array_distinct(F.transform("appellants", F.lower))), "Duplicate appellants detected")
    say("warning", ~has["respondent"], "Respondent not found")
    a, r = F.col("advocates.for_appellants"), F.col("advocates.for_respondent")
    n = lambda c: F.coalesce(F.size(c), F.lit(0))
    say("info", ~has["advocates"], "Advocate information not extracted")
    say("warning", has["advocates"] & (F.greatest(n(a), F.lit(0)) + F.greatest(n(r), F.lit(0)) == 0), "No advocates listed for either party")
    count("warning", a, 20, "Unusually many advocates for appellants: {}")
    count("warning", r, 20, "Unusually many advocates for respondent: {}")
    count("warning", F.col("precedents"), 100, "Very high precedent count ({}) - possible over-extraction")
    count("warning", F.col("provisions"), 50, "Very high provision count: {}")
    short = F.filter(F.slice(F.coalesce(F.col("provisions"), F.array().cast("array<string>")), 1, 10), lambda p: F.length(p) < 3)
    out.append(F.transform(short, lambda p: F.struct(F.lit("warning").alias("channel"), F.concat(F.lit("Malformed provision: '"), p, F.lit("'")).alias("message"))))
    count("warning", F.col("statutes"), 30, "High statute count: {}")
    say("info", ~has["citations"], "No citations extracted")
    if "citations" in df.columns:
        total = F.aggregate(F.map_values("citations"), F.lit(0), lambda acc, v: acc + F.size(v))
        say("warning", total > 50, F.format_string("Very high citation count: %d", total))
    say("info", ~has["content_info"], "No content information extracted")
    if _has(df, "content_info", "issues"):
        i = F.col("content_info.issues")
        count("warning", i, 20, "Unusually high issue count: {}")
        say("warning", F.exists(F.slice(i, 1, 5), lambda x: F.length(x) < 10), "Some issues appear too short")
    count("warning", F.col("content_info.background_facts"), 30, "Very high background fact count: {}")
    o = F.col("content_info.order_summary")
    empty = lambda c: F.coalesce(c, F.lit("")) == ""
    say("warning", o.isNotNull() & empty(F.col("content_info.order_summary.result")) & empty(F.col("content_info.order_summary.decision")), "Order summary lacks result or decision")
    return F.filter(F.flatten(F.array(*out)), lambda m: m.isNotNull())


def completeness(df: DataFrame) -> dict[str, Column]:
    """present counts and scores of the three groups, the percentage, and the missing fields of the first two."""
    out: dict[str, Column] = {}
    total = F.lit(0.0)
    for name, fields, weight in GROUPS:
        n = sum((present(df, f).cast("bigint") for f in fields), F.lit(0).cast("bigint"))
        score = n / F.lit(float(len(fields))) * F.lit(float(weight))
        out[f"{name}_present"], out[f"{name}_score"] = n, F.round(score, 2)
        total = total + score
        if name != "optional":
            out[f"missing_{name}"] = F.array_compact(F.array(*[F.when(~present(df, f), F.lit(f)) for f in fields]))
    out["completeness"] = F.round(total, 2)
    return out


def grade(percent: Column, errors: Column, warnings: Column) -> Column:
    """A to F by completeness, lowered by errors and warnings, with + or -."""
    base = F.when(percent >= 90, 0).when(percent >= 80, 1).when(percent >= 70, 2).when(percent >= 60, 3).otherwise(5)
    drop = F.when(errors > 5, 2).when(errors > 2, 1).otherwise(0)
    lowered = F.least(base + drop, F.lit(5))
    letter = F.substring(F.lit("ABCDEF"), F.least(lowered + F.when(warnings > 10, 1).otherwise(0), F.lit(5)) + 1, F.lit(1))
    sign = F.when((percent >= 95) & (errors == 0) & (warnings <= 2), "+").when((percent < 65) | (errors > 3) | (warnings > 8), "-").otherwise("")
    return F.concat(letter, sign)


def quality_status(grade_: Column) -> Column:
    out = F.lit(STATUS[-1][1])
    for letter, said in reversed(STATUS[:-1]):
        out = F.when(grade_.startswith(letter), said).otherwise(out)
    return out


def quality_report(df: DataFrame, id_col: str, as_of_year: int) -> DataFrame:
    """One row a record: grade, status, counts, completeness, missing fields, messages and recommendations."""
    d = df.select(F.col(id_col), messages(df, as_of_year).alias("messages"), *[c.alias(k) for k, c in completeness(df).items()])
    for k in ("error", "warning", "info"):
        d = d.withColumn(f"{k}s" if k != "info" else k, F.transform(_channel("messages", k), lambda m: m["message"]))
    d = d.withColumns({"n_errors": F.size("errors").cast("bigint"), "n_warnings": F.size("warnings").cast("bigint"), "n_info": F.size("info").cast("bigint")})
    d = d.withColumn("grade", grade(F.col("completeness"), F.col("n_errors"), F.col("n_warnings")))
    advice = F.array_compact(
        F.array(
            F.when(F.col("n_errors") > 0, "CRITICAL: Address all errors before using this extraction in production"),
            F.when(F.col("completeness") < 70, "Low completeness score - consider re-extracting with improved preprocessing"),
            F.when(F.size("missing_critical") > 0, F.concat(F.lit("Missing critical fields: "), F.array_join("missing_critical", ", "), F.lit(" - Manual verification required"))),
            F.when(F.col("n_warnings") > 10, "High warning count - review extraction quality and consider document preprocessing"),
            F.when((F.col("n_errors") == 0) & (F.col("n_warnings") == 0) & (F.col("completeness") >= 90), "Extraction quality is excellent - ready for use"),
        )
    )
    d = d.withColumn("recommendations", F.when(F.size(advice) > 0, advice).otherwise(F.array(F.lit("Review warnings and verify extracted data before use"))))
    return d.withColumn("quality_status", quality_status(F.col("grade"))).withColumn("has_critical_issues", F.col("n_errors") > 0).drop("messages")


def _channel(column: str, channel: str) -> Column:
    return F.filter(column, lambda m: m["channel"] == channel)


def batch_summary(reports: DataFrame) -> DataFrame:
    """One row: documents, average completeness (null without documents), total errors and warnings, recommendations."""
    s = reports.agg(F.count("*").alias("total_documents"), F.avg("completeness").alias("avg"), F.coalesce(F.sum("n_errors"), F.lit(0)).alias("total_errors"), F.coalesce(F.sum("n_warnings"), F.lit(0)).alias("total_warnings"))
    e, w = F.col("total_errors") / F.nullif("total_documents", F.lit(0)), F.col("total_warnings") / F.nullif("total_documents", F.lit(0))
    advice = F.array_compact(
        F.array(
            F.when(F.col("avg") < 70, "Batch has low average completeness - review document quality and extraction pipeline"),
            F.when(e > 2, F.concat(F.lit("High error rate ("), F.format_string("%.1f", e), F.lit(" errors/doc) - investigate extraction issues"))),
            F.when(w > 5, F.concat(F.lit("High warning rate ("), F.format_string("%.1f", w), F.lit(" warnings/doc) - consider preprocessing improvements"))),
            F.when((F.col("avg") >= 85) & (e < 1), "Batch quality is good - suitable for production use"),
        )
    )
    return s.select("total_documents", F.round("avg", 2).alias("average_completeness"), "total_errors", "total_warnings", F.array_join(advice, " | ").alias("batch_recommendations"))


def individual_results(reports: DataFrame, id_col: str) -> DataFrame:
    """(document_index, id_col, grade, completeness, errors, warnings): each record's result with its index in the order of ids.

    Rows are put in ranges of ids and counted within a range; what precedes a range is a sum over a row for each partition.
    """
    from casemill.session import written

    lean = reports.select(id_col, "grade", "completeness", F.col("n_errors").alias("errors"), F.col("n_warnings").alias("warnings"))
    d = written(lean.repartitionByRange(id_col).withColumn("_part", F.spark_partition_id()), "individual")
    counts = sorted((r["_part"], r["n"]) for r in d.groupBy("_part").agg(F.count("*").alias("n")).collect())
    before, rows = 0, []
    for part, n in counts:
        rows.append((part, before))
        before += n
    base = d.sparkSession.createDataFrame(rows, "_part int, _before bigint")
    w = Window.partitionBy("_part").orderBy(id_col)
    indexed = d.join(F.broadcast(base), "_part").withColumn("document_index", F.col("_before") + F.row_number().over(w) - 1)
    return indexed.select("document_index", id_col, "grade", "completeness", "errors", "warnings")


def grade_distribution(reports: DataFrame) -> DataFrame:
    """(grade_letter, n): records by the first letter of their grade."""
    return reports.groupBy(F.substring("grade", 1, 1).alias("grade_letter")).agg(F.count("*").alias("n"))
