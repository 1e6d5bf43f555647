from __future__ import annotations

from pyspark.sql import functions as F

from casemill.operators import assembly, projecting


def test_gazetteer_in_parts_gives_the_same(spark, monkeypatch):
    d = spark.createDataFrame([(1, "The High Court of Exby and the High Court sat at Exby"), (2, None), (3, "")], "id bigint, t string")
    g = spark.createDataFrame([("COURT", "High Court of Exby"), ("COURT", "High Court"), ("GPE", "Exby"), ("GPE", "xby")], "label string, name string")
    rows = lambda: sorted(tuple(r) for r in assembly.gazetteer_entities(d, "id", "t", g, "label", "name").collect())
    want = rows()
    assert [r[3] for r in want] == ["High Court of Exby", "High Court", "Exby"]
    monkeypatch.setattr(assembly, "MOST_PATTERNS", 1)
    assert rows() == want


def test_gazetteer_of_nothing(spark):
    d = spark.createDataFrame([(1, "x")], "id bigint, t string")
    assert assembly.gazetteer_entities(d, "id", "t", spark.createDataFrame([], "label string, name string"), "label", "name").count() == 0


def test_filtered_report_keeps_the_order_of_the_request(spark):
    r = spark.createDataFrame([(1, "A v. B", None, "High Court", None, ["J1", "J2"], ["A"], "B", None, None, None, None, None, None, None)], "doc_id bigint, case_name string, appeal_number string, court string, date_of_judgment string, coram array<string>, appellants array<string>, respondent string, advocates struct<for_appellants: array<string>, for_respondent: array<string>>, precedents array<string>, provisions array<string>, statutes array<string>, lower_courts array<string>, other_dates array<string>, content_info struct<background_facts: array<string>, order_summary: struct<result: string, decision: string, directions: array<string>>>")
    asked = spark.createDataFrame([(1, ["coram", "case_name"])], "doc_id bigint, names array<string>")
    got = projecting.filtered_report_lines(r, asked, "doc_id", "names").orderBy("section_no", "item_no").collect()
    assert [(x.section_no, x.section, x.line) for x in got] == [(1, "coram", "J1"), (1, "coram", "J2"), (2, "case_name", "A v. B")]


def test_comma_list(spark):
    assert projecting.requested_names(" a, b ,") == ["a", "b", ""] and projecting.requested_names(None) == []
    d = spark.createDataFrame([(" a, b ,",), (None,), ("",)], "f string").select(projecting.named_in_list(F.col("f")).alias("n"))
    assert [r.n for r in d.collect()] == [["a", "b", ""], [], []]
