"""Operators over a few invented judgments, for rules that the test tables' texts don't exercise.

The rows are inline. Where the rule can be rendered, the SQL runs the same search; where it can't, the SQL states the rows that the
rule's definition gives for these texts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casemill.functions import rules
from casemill.functions.text import literal as q
from casemill.operators import assembly, extracting, finding, merging, projecting, segmenting, selecting
from casemill.plans.extraction import find_sql
from casemill.sources import files

QUERIES: dict = {}
SQL: dict[str, str] = {}

ONE = """IN THE SUPREME COURT OF INDIA
CRIMINAL APPELLATE JURISDICTION
Criminal Appeal No. 123 of 2019
RAM LAL AND SONS
VERSUS
STATE OF MADHYA PRADESH
CORAM: Hon'ble Mr. Justice A. B. Rao, Hon'ble Ms. Justice C. Sen
Date: 12.03.2020
Petitioner(s): Ram Lal; Sohan Lal and Mohan Das
Respondent(s): State of Madhya Pradesh, Union Home Secretary
Advs. for the Appellant: Mr. Gopal Verma, Sr. Adv., Ms. Rita Shah
Advs. for the Respondent: Mr. Hari Om Das
For Petitioner: Suresh Kumar Jain
Facts
The appellant was convicted under Section 302 of the Indian Penal Code, 1860 by the District Court at Bhopal on 5th January 2018.
The prosecution relied on Mohan Singh v. State of Bihar (2011) 9 SCC 272, on AIR 1978 SC 597 and on Article 21 of the Constitution.
It also cited Section 66A of the Information Technology Act, 2000.
Issues for Consideration
1. Whether the conviction under Section 302 can be sustained on the evidence of a single witness.
2. Whether the sentence of imprisonment for life is excessive in the facts of this case.
Discussion
Mr. Gopal Verma and Shri Anil Kapoor argued at Delhi.¹ See the earlier order of this Court in the same matter.
ORDER
Held: The appeal is allowed and the conviction is set aside. The appellant shall be released forthwith.
In conclusion, the appeal stands allowed with no order as to costs in this Court."""
TWO = """IN THE HIGH COURT OF JUDICATURE AT MADRAS
Crl.O.P.No. 4567 of 2021
Petitioner: Ram Lal
Date: 01.02.2021
Heard the learned counsel. Justice Rao Bahadur and Hon'ble Mr. Justice Sen Gupta, JJ., concur.
[RAO BAHADUR AND SEN GUPTA, JJ.]"""
TEXTS = [(1, ONE), (2, TWO), (3, ""), (4, None)]
_TEXTS = "(SELECT * FROM (VALUES " + ", ".join(f"(CAST({i} AS BIGINT), {'NULL' if t is None else q(t)})" for i, t in TEXTS) + ") t(doc_id, text))"


def texts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TEXTS, "doc_id bigint, text string")


def values(rows: list[tuple], columns: str) -> str:
    """SQL that gives these rows."""
    show = lambda x: "NULL" if x is None else q(x) if isinstance(x, str) else f"CAST({x} AS BIGINT)"
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(show, r)) + ")" for r in rows) + f") t({columns})"


def query(name: str, sql: str):  # noqa: ANN201
    def add(fn):  # noqa: ANN001, ANN202
        QUERIES[name] = lambda spark, sf: fn(spark)
        SQL[name] = sql
        return fn

    return add


for _name, _found in {
    "judgment_judges": rules.JUDGES_A, "judgment_lawyers_header": rules.LAWYERS_A, "judgment_lawyers_text": rules.LAWYERS_B, "judgment_precedents_header": rules.PRECEDENTS_A, "judgment_statutes_by_form": rules.STATUTES_A,
    "judgment_citations": rules.CITATIONS, "judgment_legal_references": [*rules.ARTICLES, *rules.SECTIONS_OF_ACTS], "judgment_case_numbers": rules.CASE_NUMBERS_A,
}.items():
    query(_name, find_sql(_TEXTS, "doc_id", "text", _found))(lambda spark, found=_found: finding.find(texts(spark), "doc_id", "text", found))


def _in_text(names: list[str], test) -> str:  # noqa: ANN001
    return " UNION ALL ".join(f"SELECT doc_id, CAST({i} AS BIGINT) AS pos, {q(p)} AS value FROM {_TEXTS} WHERE {test(p)}" for i, p in enumerate(names, 1))


@query("judgment_places_header", _in_text(rules.PLACES_A, lambda p: f"contains(lower(text), {q(p.lower())})"))
def _(spark: SparkSession) -> DataFrame:
    return finding.places(texts(spark), "doc_id", "text", rules.PLACES_A, anywhere=True)


@query("judgment_places_text", _in_text(rules.PLACES_B, lambda p: f"regexp_matches(text, {q(chr(92) + 'b' + p + chr(92) + 'b')})"))
def _(spark: SparkSession) -> DataFrame:
    return finding.places(texts(spark), "doc_id", "text", rules.PLACES_B, anywhere=False)


def _listed(name: str, make, rows: list[tuple]) -> None:  # noqa: ANN001
    """A list of values of each text against the rows that the definition gives."""
    q_ = query(name, values(rows, "doc_id, pos, value"))
    q_(lambda spark: make(texts(spark)).select("doc_id", F.posexplode("a").alias("p", "value")).select("doc_id", (F.col("p") + 1).cast("bigint").alias("pos"), "value"))


def _of_text(column):  # noqa: ANN001, ANN202
    return lambda d: d.select("doc_id", column(F.col("text")).alias("a"))


def _of_segment(segment: str, column):  # noqa: ANN001, ANN202
    return lambda d: segmenting.split_segments(d, "text").select("doc_id", column(F.col(segment)).alias("a"))


_listed("judgment_lawyers_anchored", _of_text(finding.anchored_lawyers), [(1, 1, "Mr. Gopal Verma"), (1, 2, "Ms. Rita Shah"), (1, 3, "Mr. Hari Om Das"), (1, 4, "Suresh Kumar Jain")])
_listed("judgment_lawyers_on_lines", _of_text(finding.named_values), [(1, 1, "Suresh Kumar Jain")])
_listed("judgment_footnotes", _of_text(lambda t: F.transform(finding.footnotes(t), lambda f: F.concat(f["number"], F.lit(": "), f["content"]))), [(1, 1, "1: See the earlier order of this Court in the same matter.\nORDER\nHeld: The appeal is allowed and the conviction is set aside. The appellant shall be released forthwith.\nIn conclusion, the appeal stands allowed with no order as to costs in this Court.")])
_listed("judgment_issues", _of_segment("body", extracting.issues), [(1, 1, "Whether the conviction under Section 302 can be sustained on the evidence of a single witness."), (1, 2, "Whether the sentence of imprisonment for life is excessive in the facts of this case.")])
_listed("judgment_advocates", _of_text(lambda t: F.coalesce(extracting.advocates(t)["for_appellants"], F.array().cast("array<string>"))), [(1, 1, "Mr. Gopal Verma"), (1, 2, "Ms. Rita Shah")])
_listed("judgment_conclusion", _of_segment("order_text", lambda t: F.array(extracting.conclusion(t))), [(1, 1, "the appeal stands allowed with no order as to costs in this Court."), (2, 1, "Conclusion not found"), (3, 1, "Conclusion not found"), (4, 1, "Conclusion not found")])


_listed("judgment_bench_names", _of_text(finding.bench_names), [(1, 1, "Hon'ble Mr. Justice A. B. Rao"), (1, 2, "Hon'ble Ms. Justice C. Sen"), (2, 1, "RAO BAHADUR AND SEN GUPTA")])
_listed("judgment_precedents", _of_text(finding.precedents), [(1, 1, "The prosecution relied on Mohan Singh v. State of Bihar")])
_listed("judgment_background_facts", _of_segment("body", lambda t: F.transform(extracting.background_facts(t), lambda x: F.substring(x, 1, 30))), [(1, 1, "The appellant was convicted un"), (2, 1, "Heard the learned counsel. Jus")])


@query("judgment_captions", values([(1, "RAM LAL AND SONS v. STATE OF MADHYA PRADESH", "RAM LAL|SONS", "STATE OF MADHYA PRADESH"), (2, None, "Ram Lal", ""), (3, None, "", ""), (4, None, "", "")], "doc_id, case_name, appellants, respondents"))
def _(spark: SparkSession) -> DataFrame:
    """Captions and parties of headers."""
    s = segmenting.split_segments(texts(spark), "text")
    d = extracting.with_parties(extracting.with_case_name(s, "header"), "header")
    return d.select("doc_id", "case_name", F.array_join("appellants", "|").alias("appellants"), F.array_join("respondents", "|").alias("respondents"))


@query("judgment_orders", values([(1, "Appeal Is Allowed", "The appeal is allowed and the ", 0), (2, "Not found", "", 0), (3, "Not found", "", 0), (4, "Not found", "", 0)], "doc_id, result, decision, n_directions"))
def _(spark: SparkSession) -> DataFrame:
    o = extracting.order_summary(F.col("order_text"))
    return segmenting.split_segments(texts(spark), "text").select("doc_id", o["result"].alias("result"), F.substring(o["decision"], 1, 30).alias("decision"), F.size(o["directions"]).cast("bigint").alias("n_directions"))


@query("judgment_party_lines_text", values([
    (1, "PETITIONER", 1, 1, 1, "Ram Lal"), (1, "PETITIONER", 1, 1, 2, "Sohan Lal"), (1, "PETITIONER", 1, 1, 3, "Mohan Das"), (1, "RESPONDENT", 3, 1, 1, "State of Madhya Pradesh"), (1, "RESPONDENT", 3, 1, 2, "Union Home Secretary"), (2, "PETITIONER", 1, 1, 1, "Ram Lal"),
], "doc_id, label, rule_no, match_no, pos, value"))
def _(spark: SparkSession) -> DataFrame:
    return finding.party_lines(texts(spark), "doc_id", "text", rules.PARTY_LINES_B)


@query("judgment_party_lines", values([
    (1, "PETITIONER", 1, 1, 1, "Ram Lal; Sohan Lal"), (1, "PETITIONER", 1, 1, 2, "Mohan Das"), (1, "RESPONDENT", 2, 1, 1, "State of Madhya Pradesh"), (1, "RESPONDENT", 2, 1, 2, "Union Home Secretary"),
], "doc_id, label, rule_no, match_no, pos, value"))
def _(spark: SparkSession) -> DataFrame:
    return finding.party_lines(texts(spark), "doc_id", "text", rules.PARTY_LINES_A)


@query("judgment_gazetteer", values([(1, 0, "COURT", "District Court at Bhopal"), (1, 1, "STATUTE", "Indian Penal Code, 1860")], "doc_id, n, label, value"))
def _(spark: SparkSession) -> DataFrame:
    """The longest name counts where names overlap."""
    names = spark.createDataFrame([("COURT", "District Court at Bhopal"), ("STATUTE", "Indian Penal Code, 1860"), ("STATUTE", "Indian Penal Code"), ("GPE", "Bhopal"), ("GPE", "adhya"), ("GPE", None)], "label string, canonical_name string")
    return assembly.gazetteer_entities(texts(spark), "doc_id", "text", names, "label", "canonical_name").select("doc_id", F.when(F.col("label") == "COURT", 0).otherwise(1).cast("bigint").alias("n"), "label", "value")


_RECORDS = [
    (1, "RAM LAL AND SONS v. STATE OF MADHYA PRADESH", "Criminal Appeal No. 123 of 2019", "Supreme Court of India", "12.03.2020", "STATE OF MADHYA PRADESH"),
    (2, None, "Crl.O.P.No. 4567 of 2021", "High Court of MADRAS", "01.02.2021", None), (3, None, None, None, None, None), (4, None, None, None, None, None),
]


@query("judgment_records", values(_RECORDS, "doc_id, case_name, appeal_number, court, date_of_judgment, respondent"))
def _(spark: SparkSession) -> DataFrame:
    """A name is made only where both sides are known; nothing is found in empty texts."""
    r = assembly.structured_record(texts(spark), "doc_id", "text", F.lit("2025-01-01").cast("date"))
    return r.select("doc_id", "case_name", "appeal_number", "court", "date_of_judgment", "respondent")


@query("judgment_record_gaps", values([(1, 1, 1), (2, 0, 1), (3, 0, 0), (4, 0, 0)], "doc_id, has_advocates, has_facts"))
def _(spark: SparkSession) -> DataFrame:
    r = assembly.structured_record(texts(spark), "doc_id", "text", F.lit("2025-01-01").cast("date"))
    return r.select("doc_id", F.col("advocates").isNotNull().cast("bigint").alias("has_advocates"), F.col("content_info.background_facts").isNotNull().cast("bigint").alias("has_facts"))


@query("judgment_spans", values([(1, "header", "COURT", 1, "Supreme Court"), (1, "header", "DATE", 1, "12.03.2020"), (1, "header", "JUDGE", 1, "Rao J"), (1, "header", "STATUTE", 1, "Negotiable Instruments Act, 1881")], "doc_id, provenance, label, pos, value"))
def _(spark: SparkSession) -> DataFrame:
    """The classifier's spans and the rules' matches are one set."""
    s = spark.createDataFrame([(1, "Supreme Court\nDate 12.03.2020", None)], "doc_id bigint, header string, body string")
    spans = spark.createDataFrame([(1, "header", "JUDGE", " Rao\nJ. "), (1, "header", "STATUTE", "the NI Act"), (1, "header", "COURT", "Supreme Court"), (1, "header", "DATE", "...")], "doc_id bigint, provenance string, label string, value string")
    return assembly.segment_entities(s, "doc_id", spans)


@query("judgment_merged", values([(1, "coram", 1, "Justice Rao"), (1, "coram", 2, "C. SEN"), (1, "lawyer", 1, "Gopal Verma,"), (1, "organization", 1, "Acme Ltd"), (1, "petitioner", 1, "Ram Lal"), (1, "precedent", 1, "Mohan Singh v. State of Bihar (2011) 9 SCC 272")], "doc_id, key, pos, value"))
def _(spark: SparkSession) -> DataFrame:
    """Rules of each key: judges, lawyers, banners, one-word parties, precedents near a longer one."""
    rows = [
        (1, "spacy", 9, "JUDGE", "C. SEN"), (1, "header", 1, "JUDGE", "Hon'ble Mr. Justice Rao"), (1, "body", 1, "JUDGE", "and"), (1, "body", 2, "JUDGE", "Sen"), (1, "body", 3, "LAWYER", "Gopal Verma, Advocate"), (1, "body", 4, "LAWYER", "State of Goa"),
        (1, "body", 5, "ORGANIZATION", "THE BIG BANNER"), (1, "body", 6, "ORGANIZATION", "Acme Ltd."), (1, "header", 2, "PETITIONER", "Ram Lal Petitioner"), (1, "header", 3, "PETITIONER", "Ram"), (1, "body", 7, "PRECEDENT", "Mohan Singh v. State of Bihar"),
        (1, "spacy", 8, "PRECEDENT", "Mohan Singh v. State of Bihar (2011) 9 SCC 272"), (1, "spacy", 10, "STATUTE", "Act"),
    ]
    e = spark.createDataFrame(rows, "doc_id bigint, provenance string, seq int, label string, v string")
    return merging.merge_entities(e, "doc_id", "provenance", "seq", "label", "v", fuzzy=True)


@query("judgment_requested", values([(1, 1, "court", None), (1, 2, "case_name", None), (2, 0, None, "No matching fields"), (3, 0, None, "No matching fields")], "doc_id, pos, field, error"))
def _(spark: SparkSession) -> DataFrame:
    """A comma list of fields, in its order; an error row where a record holds none of them."""
    r = spark.createDataFrame([(1, "A v. B", "High Court", None), (2, None, None, ["x"])], "doc_id bigint, case_name string, court string, coram array<string>")
    asked = spark.createDataFrame([(1, " court , case name,zzz"), (2, "court"), (3, "court")], "doc_id bigint, fields string").withColumn("names", projecting.named_in_list(F.col("fields")))
    return projecting.requested_records(r, asked, "doc_id", "names").select("doc_id", "pos", "field", "error")


_DATES = [("5th January 2018", "2018-01-05"), ("12.03.2020", "2020-03-12"), ("1/2/69", "1969-02-01"), ("3-4-68", "2068-04-03"), ("on 7 Mar 2001 at", "2001-03-07"), ("soon", None)]


@query("judgment_dates", values(_DATES, "value, day"))
def _(spark: SparkSession) -> DataFrame:
    d = spark.createDataFrame([(v,) for v, _ in _DATES], "value string")
    return d.select("value", selecting.parse_date(F.col("value")).cast("string").alias("day"))


@query("judgment_statutes", values([(1, 1, "Indian Penal Code, 1860"), (1, 2, "Companies Act")], "id, pos, value"))
def _(spark: SparkSession) -> DataFrame:
    """Whole statutes, each once."""
    from casemill.functions import text

    d = spark.createDataFrame([(1, ["IPC;", " Companies Act. ", "Section 5 ipc", "companies act", "."])], "id bigint, s array<string>")
    return d.select("id", F.posexplode(text.whole_statutes(F.col("s"))).alias("p", "value")).select("id", (F.col("p") + 1).cast("bigint").alias("pos"), "value")


# --- sources and sinks: what is written to the shared folder is read again -------------------------------------------------------


def _place(spark: SparkSession) -> str:
    from casemill.session import own_dir

    return f"{own_dir(spark)}/source-{uuid.uuid4().hex}"


@query("judgment_pages", values([("first\nsecond word", 2)], "text, n_files"))
def _(spark: SparkSession) -> DataFrame:
    """Binary files through a page reader: pages are cleaned and joined; a file that can't be read leaves an error row."""
    at = _place(spark)
    spark.createDataFrame([("Page 1 of 2", 1), ("first", 2), ("--", 3), ("second  word", 4)], "value string, n int").coalesce(1).sortWithinPartitions("n").select("value").write.text(at)
    spark.createDataFrame([("broken",)], "value string").coalesce(1).write.mode("append").text(at)

    def reader(content: bytes) -> list[str]:
        if content.startswith(b"broken"):
            raise ValueError("no pages")
        return content.decode().split("--\n")

    pages = files.pdf_pages(files.read_binary(spark, at, "txt"), reader=reader)
    docs = files.documents_of_pages(pages.where("error IS NULL"), "path").select("text")
    return docs.join(pages.agg(F.countDistinct("path").alias("n_files")), F.lit(True))


@query("judgment_gazetteer_file", values([("COURT", "High Court"), ("GPE", None)], "label, pattern"))
def _(spark: SparkSession) -> DataFrame:
    at = _place(spark)
    files.write_json(spark.createDataFrame([("COURT", "High Court"), ("GPE", None)], files.GAZETTEER), at)
    return files.read_gazetteer(spark, at)


@query("judgment_record_file", values([("A v. B", "X, Y", "allowed"), ("C v. D", None, None)], "case_name, coram, result"))
def _(spark: SparkSession) -> DataFrame:
    """Records as JSON lines, null fields left out, read by their schema."""
    at = _place(spark)
    rows = spark.createDataFrame([('{"case_name": "A v. B", "coram": ["X", "Y"], "content_info": {"order_summary": {"result": "allowed"}}}',), ('{"case_name": "C v. D"}',)], "j string")
    files.write_json(files.parse_records(rows, "j").drop("j"), at)
    return files.read_records(spark, at).select("case_name", F.array_join("coram", ", ").alias("coram"), F.col("content_info.order_summary.result").alias("result"))


@query("judgment_tokens", values([(1, "COURT", "Supreme Court"), (1, "DATE", "12 May"), (2, "DATE", "11 June")], "doc_id, label, value"))
def _(spark: SparkSession) -> DataFrame:
    """A classifier's tokens to spans; the texts are longer than its window."""
    d = spark.createDataFrame([(1, "Supreme Court sat on 12 May"), (2, "Sitting of the 11 June"), (3, None)], "doc_id bigint, text string")

    def load():  # noqa: ANN202
        import re

        label = lambda w: "B-COURT" if w == "Supreme" else "I-COURT" if w == "Court" else "DATE" if w.isdigit() or w in ("May", "June") else "O"
        return lambda t: [{"entity": label(m[0]), "start": m.start(), "end": m.end()} for m in re.finditer(r"\w+", t)]

    t = files.predict_tokens(d, "doc_id", "body", "text", load, window=18)
    return finding.token_spans(t.withColumnRenamed("id", "doc_id"), d, ["doc_id"], "text").select("doc_id", "label", "value")


_RECORD = '{"case_name": "A & B v. C", "coram": ["X", null, "Y"], "advocates": {"for_appellants": ["P"]}, "provisions": [], "content_info": {"background_facts": ["f1"], "order_summary": {"result": "allowed", "directions": []}}}'


def _record(spark: SparkSession) -> DataFrame:
    from casemill.sources import files

    return files.parse_records(spark.createDataFrame([(1, _RECORD)], "doc_id bigint, j string"), "j").drop("j")


@query("judgment_report", values([(1, 1, "case_name", 1, "A &amp; B v. C", 1), (1, 5, "coram", 1, "X", 1), (1, 5, "coram", 2, "Y", 2), (1, 8, "for_appellants", 1, "P", 2), (1, 15, "background_facts", 1, "f1", 3), (1, 16, "result", 1, "allowed", 3)], "doc_id, section_no, section, item_no, line, page_no"))
def _(spark: SparkSession) -> DataFrame:
    """Lines of a report, two to a page."""
    return projecting.page_numbers(projecting.report_lines(_record(spark), "doc_id"), "doc_id", ["section_no", "item_no"], per_page=2).drop("n_pages")


@query("judgment_json", values([(1, '{"case_name":"A & B v. C","coram":["X",null,"Y"],"advocates":{"for_appellants":["P"]},"content_info":{"background_facts":["f1"],"order_summary":{"result":"allowed","directions":[]}}}')], "doc_id, json"))
def _(spark: SparkSession) -> DataFrame:
    return projecting.sparse_json(_record(spark), "doc_id")
