from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from casemill.functions import rules, text
from casemill.operators import extracting, finding, merging, projecting, quality, segmenting, selecting


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items()))
    return df.select(column.alias("x")).collect()[0].x


@pytest.mark.parametrize(("raw", "want"), [("appli-\ncation", "application"), ("A\n\n\nB", "A\nB"), ("A\n \nB", "A\n \nB"), (None, ""), ("Page 1 of 3 x ____ “q”", 'x "q"')])
def test_preclean(spark, raw, want):
    assert one(spark, text.preclean(F.col("t")), t=raw) == want


def segments(spark, t):
    return spark.createDataFrame([(1, t)], "id int, t string").transform(lambda d: segmenting.split_segments(d, "t")).collect()[0]


def test_segments(spark):
    r = segments(spark, "CIVIL APPEAL\nJUDGMENT\nFacts")
    assert (r.header, r.body, r.order_text) == ("CIVIL APPEAL", "", "JUDGMENT\nFacts")
    r = segments(spark, "\n".join(["CIVIL APPEAL"] * 60))
    assert (len(r.header.split("\n")), len(r.body.split("\n"))) == (51, 9)
    r = segments(spark, "CASE 1\nFacts\na\n\n\n\nb\nORDER\nx\n\ny")
    assert (r.body, r.order_text) == ("Facts\na\n\nb", "ORDER\nx\ny")
    r = segments(spark, None)
    assert (r.header, r.body, r.order_text) == ("", "", "")


def test_segments_keep_every_line(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    for r in segmenting.split_segments(d, "text").collect():
        squeeze = lambda s: "".join(s.split())
        assert squeeze(r.header + r.body + r.order_text) == squeeze(r.text)


def test_spans(spark):
    tokens = [(1, 0, "JUDGE", 0, 3), (1, 1, "B-JUDGE", 4, 7), (2, 0, "JUDGE", 0, 3), (2, 1, "O", 4, 5), (2, 2, "JUDGE", 4, 7), (3, 0, "DATE", 0, 1)]
    t = spark.createDataFrame(tokens, "id int, seq int, entity string, start int, end int")
    texts = spark.createDataFrame([(i, "Ram Lal") for i in (1, 2, 3)], "id int, text string")
    got = sorted((r.id, r.value) for r in finding.token_spans(t, texts, ["id"], "text").collect())
    assert got == [(1, "Ram Lal"), (2, "Lal"), (2, "Ram")]


def test_bench(spark):
    assert one(spark, finding.bench_names(F.col("t")), t="[B.V. Nagarathna and Satish Chandra Sharma, JJ.]") == ["B.V. Nagarathna", "Satish Chandra Sharma"]
    assert one(spark, finding.bench_names(F.col("t")), t="[2024] 3 SCR 1\nCoram: A. B") == []


def test_places(spark):
    d = spark.createDataFrame([(1, "new delhi")], "id int, t string")
    assert [r.value for r in finding.places(d, "id", "t", rules.PLACES_A, True).collect()] == ["Delhi"]
    assert finding.places(d, "id", "t", rules.PLACES_B, False).count() == 0


def test_merge_order_and_extras(spark):
    rows = [(1, "spacy", 0, "COURT", "Court c"), (1, "body", 1, "COURT", "Court a"), (1, "header", 5, "COURT", "Court b"), (1, "header", 6, "COURT", "court B"), (1, "x", 7, "WITNESS", None), (1, "x", 8, "STATUTE", "IPC")]
    e = spark.createDataFrame(rows, "doc_id int, provenance string, seq int, label string, value string")
    m = merging.merge_entities(e, "doc_id", "provenance", "seq", "label", "value")
    assert sorted((r.key, r.pos, r.value) for r in m.collect()) == [("court", 1, "Court b"), ("court", 2, "Court c"), ("court", 3, "Court a"), ("statute", 1, "Indian Penal Code, 1860")]
    full = merging.merged_map(m, "doc_id").collect()[0]
    assert (full.court, full.extra_courts, full.date) == (["Court b", "Court c", "Court a"], ["Court c", "Court a"], [])


def test_fuzzy_distinct(spark):
    d = spark.createDataFrame([(1, "Ram Lal v. Shyam Das (2020) 5 SCC 1"), (1, "Ram Lal v. Shyam Dass"), (1, "Union v. Other Person"), (1, "short")], "id int, v string")
    assert [r.value for r in merging.fuzzy_distinct(d, "id", "v").orderBy("pos").collect()] == ["Ram Lal v. Shyam Das (2020) 5 SCC 1", "Union v. Other Person"]


def test_selectors(spark):
    assert one(spark, selecting.primary_case_number(F.col("a")), a=["No. 99999999", "Civil Appeal No. 5"]) == "Civil Appeal No. 5"
    assert one(spark, selecting.primary_case_number(F.col("a")), a=["X 1", "X 123"]) == "X 123"
    assert one(spark, selecting.primary_court(F.col("a")), a=["X", "SUPREME COURT OF INDIA"]) == "Supreme Court of India"
    day = F.lit("2025-01-01").cast("date")
    assert one(spark, selecting.primary_date(F.col("a"), day), a=["12-03-85", "01-02-1980"]) == "12-03-85"
    assert one(spark, selecting.primary_date(F.col("a"), day), a=["15-Aug-23"]) == "15-Aug-23"
    assert one(spark, selecting.primary_date(F.col("a"), day), a=[]) is None


def test_parties_and_names(spark):
    def parties(h):
        return extracting.with_parties(spark.createDataFrame([(h,)], "h string"), "h").collect()[0]

    r = parties("RAM LAL\nVERSUS\nSTATE")
    assert (r.appellants, r.respondents) == (["RAM LAL"], ["STATE"])
    r = parties("Petitioner(s): Ram Lal, Shyam\nRespondent: The State")
    assert (r.appellants, r.respondents) == (["Ram Lal", "Shyam"], ["The State"])
    named = extracting.with_case_name(spark.createDataFrame([("Ram Lal v. State of X (2020)",), ("In Re: Abcdefg",), (None,)], "h string"), "h").collect()
    assert [r.case_name for r in named] == ["Ram Lal v. State of X", "In Re Abcdefg", None]
    a = one(spark, extracting.advocates(F.col("h")), h="Advs. for the Appellant: Mr. Ram Lal, Sr. Adv., Shyam Das\nAdvs. for the Respondent: Ms. Gita Sen.")
    assert (a.for_appellants, a.for_respondent) == (["Mr. Ram Lal", "Shyam Das"], ["Ms. Gita Sen"])


def test_order(spark):
    f = lambda o: one(spark, extracting.order_summary(F.col("o")), o=o)
    assert (f("").result, f("").decision) == ("Not found", "")
    assert f("The appeal is partly allowed.").result == "Appeal Is Partly Allowed"
    assert f("The appeals are dismissed.").result == "Appeal Dismissed"
    assert f("Nothing here").result == "Not determined"
    assert f("Nothing here").decision == "Not found"


def test_precedents(spark):
    p = one(spark, extracting.structured_precedent(F.col("p")), p="Ram v. Shyam (2023) 5 SCC 123")
    assert (p.case_name, p.citation, p.year) == ("Ram v. Shyam", "(2023) 5 SCC 123", "2023")
    p = one(spark, extracting.structured_precedent(F.col("p")), p="X v. Y AIR 2020 SC 5")
    assert one(spark, extracting.precedent_category(F.col("c")), c=p.citation) == "other"


def test_projection():
    assert projecting.resolve_fields(["lower_courts"]) == ["court"]
    assert projecting.resolve_fields(["lower_courts"], strict=True) == ["lower_courts"]
    assert projecting.resolve_fields(["lower courts", "Court ", "date", "court"]) == ["lower_courts", "court", "date_of_judgment"]


def test_projection_as_data_agrees_with_driver(spark):
    names = ["lower courts", "Judges ", "facts", "", "zzz", "case_name", "lawyers", "date"]
    got = {r.n: r.f for r in spark.createDataFrame([(n,) for n in names], "n string").select("n", projecting.resolved(F.col("n")).alias("f")).collect()}
    assert got == {n: projecting.resolve_field(n) for n in names}


@pytest.mark.parametrize(("percent", "errors", "warnings", "want"), [(96.67, 0, 0, "A+"), (65.0, 3, 0, "E"), (50.0, 6, 0, "F-"), (85.0, 0, 11, "C-"), (92.0, 0, 3, "A")])
def test_grades(spark, percent, errors, warnings, want):
    d = spark.createDataFrame([(percent, errors, warnings)], "p double, e int, w int")
    assert d.select(quality.grade(F.col("p"), F.col("e"), F.col("w")).alias("g")).collect()[0].g == want


def test_batch_of_nothing(spark, sf):
    s = spark.read.parquet(f"{sf}/structured.parquet").limit(0)
    r = quality.batch_summary(quality.quality_report(s, "record_id", 2025)).collect()[0]
    assert (r.total_documents, r.average_completeness, r.total_errors) == (0, None, 0)


def test_escape_and_file_names(spark):
    assert one(spark, text.safe_text(F.col("t")), t='a<b & "c"') == "a&lt;b &amp; &quot;c&quot;"
    assert one(spark, text.safe_text(F.col("t")), t=None) == "—"
    assert one(spark, text.report_file_name(F.col("a"), F.col("c")), a="C.A. 5/2020", c=None) == "C.A. 5-2020_report.pdf"
    assert one(spark, text.report_file_name(F.col("a"), F.col("c")), a=None, c="A v. B") == "A_v._B_report.pdf"


def test_long_text_has_no_stack_overflow(spark):
    body = "Facts\n" + "word " * 32_000 + "\nHeld\nx"
    assert len(one(spark, extracting.background_facts(F.col("b")), b=body)) == 1


@pytest.mark.parametrize(("raw", "want"), [("Hon'ble Dr. Justice A. Rao, J.", ". A. Rao,"), ("Rich\u0430dr V. Z\u00f4silidal", "Rich\u0430dr V. Z\u00f4silidal"), ("Justice \u00c9mile Dr\u00e9", "\u00c9mile Dr\u00e9"), (None, ""), ("", "")])
def test_judge_names_beside_letters_beyond_ascii(spark, raw, want):
    assert one(spark, text.clean_judge_name(F.col("t")), t=raw) == want
