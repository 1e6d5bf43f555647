"""Queries of the extraction engine over the test tables, each with the SQL that gives the same rows where RE2 can express it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casemill.functions import rules, text
from casemill.functions.rules import Rule
from casemill.functions.text import literal as q
from casemill.operators import assembly, extracting, finding, merging, projecting, quality, segmenting, selecting
from casemill.plans import cleaning

AS_OF = "2025-01-01"
AS_OF_YEAR = 2025


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A test table. Texts that lie in fewer splits than half the cores are spread over all cores, as the rules over them cost far
    more than moving them; tables of many files are read as they are."""
    df = cleaning.table(spark, sf, name)
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name in ("documents", "segments") and df.rdd.getNumPartitions() * 2 <= cores else df


QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):  # noqa: ANN201
    def add(fn):  # noqa: ANN001, ANN202
        QUERIES[name or fn.__name__] = fn
        if sql:
            SQL[name or fn.__name__] = sql
        return fn

    return add


# --- find-all rules over whole documents -------------------------------------------------------------------------------------


def find_sql(source: str, key: str, value: str, found: Sequence[Rule]) -> str:
    return "\nUNION ALL\n".join(
        f"SELECT {key}, {q(r.label)} AS label, CAST({k} AS BIGINT) AS rule_no, CAST(generate_subscripts(l, 1) AS BIGINT) AS match_no, regexp_replace(unnest(l), '^\\s+|\\s+$', '', 'g') AS value "
        f"FROM (SELECT {key}, regexp_extract_all(coalesce({value}, ''), {q(r.pattern)}, {r.group}) AS l FROM {source})"
        for k, r in enumerate(found, 1)
    )


def _finder(name: str, found: Sequence[Rule], oracle: bool = True) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return finding.find(table(spark, sf, "documents"), "doc_id", "text", found)

    query(find_sql("documents", "doc_id", "text", found) if oracle else None, name)(run)


for _name, _found in {
    "case_numbers_header": rules.CASE_NUMBERS_A, "case_numbers_text": rules.CASE_NUMBERS_B, "dates_header": rules.DATES_A, "dates_text": rules.DATES_B, "courts_header": rules.COURTS_A, "courts_text": rules.COURTS_B,
    "provisions_header": rules.PROVISIONS_A, "provisions_text": rules.PROVISIONS_B, "statutes_by_form": rules.STATUTES_A, "statutes_by_name": rules.STATUTES_B, "citations": rules.CITATIONS,
    "legal_references": [*rules.ARTICLES, *rules.SECTIONS_OF_ACTS], "priority_matches": rules.PRIORITY_RULES,
}.items():
    _finder(_name, _found)
# a word boundary beside an accented letter differs between the engines, so these have no SQL
for _name, _found in {"judges": rules.JUDGES_A, "lawyers_header": rules.LAWYERS_A, "lawyers_text": rules.LAWYERS_B, "precedents_header": rules.PRECEDENTS_A}.items():
    _finder(_name, _found, oracle=False)


@query("\nUNION ALL\n".join(f"SELECT doc_id, CAST({i} AS BIGINT) AS pos, {q(p)} AS value FROM documents WHERE contains(lower(text), {q(p.lower())})" for i, p in enumerate(rules.PLACES_A, 1)))
def places_header(spark: SparkSession, sf: str) -> DataFrame:
    return finding.places(table(spark, sf, "documents"), "doc_id", "text", rules.PLACES_A, anywhere=True)


@query("\nUNION ALL\n".join(f"SELECT doc_id, CAST({i} AS BIGINT) AS pos, {q(p)} AS value FROM documents WHERE regexp_matches(text, {q(chr(92) + 'b' + p + chr(92) + 'b')})" for i, p in enumerate(rules.PLACES_B, 1)))
def places_text(spark: SparkSession, sf: str) -> DataFrame:
    return finding.places(table(spark, sf, "documents"), "doc_id", "text", rules.PLACES_B, anywhere=False)


def _array_query(name: str, column) -> None:  # noqa: ANN001
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return table(spark, sf, "documents").select("doc_id", F.posexplode(column(F.col("text"))).alias("pos", "value")).withColumn("pos", F.col("pos") + 1)

    query(None, name)(run)


_array_query("bench_names", finding.bench_names)
_array_query("lawyers_anchored", finding.anchored_lawyers)
_array_query("precedents_validated", finding.precedents)


@query()
def party_lines(spark: SparkSession, sf: str) -> DataFrame:
    return finding.party_lines(table(spark, sf, "documents"), "doc_id", "text", rules.PARTY_LINES_B)


@query()
def footnotes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.explode(finding.footnotes(F.col("text"))).alias("f")).select("doc_id", "f.*")


# --- text functions ----------------------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, {text.sql('text', text.PRECLEAN)} AS cleaned FROM documents")
def preclean_documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", text.preclean(F.col("text")).alias("cleaned"))


@query(f"SELECT doc_id, {text.sql('text', text.CLEAN)} AS cleaned FROM documents")
def clean_text_documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", text.clean_text(F.col("text")).alias("cleaned"))


@query("SELECT record_id, coalesce(replace(replace(replace(replace(replace(case_name, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;'), '—') AS escaped FROM structured")
def safe_text_case_names(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "structured").select("record_id", text.safe_text(F.col("case_name")).alias("escaped"))


@query(
    "SELECT record_id, coalesce(substring(replace(nullif(appeal_number, ''), '/', '-'), 1, 50) || '_report.pdf', substring(replace(nullif(case_name, ''), ' ', '_'), 1, 50) || '_report.pdf', 'report.pdf') AS file_name FROM structured"
)
def report_file_names(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "structured").select("record_id", text.report_file_name(F.col("appeal_number"), F.col("case_name")).alias("file_name"))


def _cleaned(name: str, column: str, fn, expr: str | None) -> None:  # noqa: ANN001
    """A text function over every element of an array column of structured; without ``expr`` there is no SQL for it."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        s = table(spark, sf, "structured").select("record_id", F.posexplode(column).alias("pos", "v"))
        return s.select("record_id", (F.col("pos") + 1).cast("bigint").alias("pos"), fn(F.col("v")).alias("cleaned"))

    query(expr and f"SELECT record_id, CAST(pos AS BIGINT) AS pos, {expr} AS cleaned FROM (SELECT record_id, generate_subscripts({column}, 1) AS pos, unnest({column}) AS v FROM structured)", name)(run)


_whole = "regexp_replace(trim(v), '[.,;:]+$', '', 'g')"
_cleaned("party_names", "appellants", text.clean_party_name, text.sql("v", text.PARTY_NAME))
_cleaned("party_chunks", "appellants", text.clean_party_chunk, text.sql("v", text.PARTY_CHUNK))
# RE2 sees a word boundary beside a letter beyond ASCII, so that "Rich\u0430dr" would lose its "dr": no SQL, see the tests
_cleaned("judge_names", "coram", text.clean_judge_name, None)
_cleaned("statutes_expanded", "statutes", text.normalize_statute, text.sql("v", text.STATUTE))
_cleaned("statutes_whole", "statutes", text.whole_statute, "CASE " + " ".join(f"WHEN regexp_matches({_whole}, {q(f'(?i){chr(92)}b{a}{chr(92)}b')}) THEN {q(b)}" for a, b in text.STATUTE_WHOLE) + f" ELSE {_whole} END")
_adv = text.sql("v", text.ADVOCATE_NAME)
_cleaned("advocate_names", "advocates.for_appellants", text.clean_advocate_name, f"CASE WHEN upper({_adv}) = 'APP' OR length({_adv}) < 3 OR NOT regexp_matches({_adv}, '[A-Za-z]') THEN '' ELSE {_adv} END")

_cn = text.sql("case_name", text.CASE_NAME)


@query(f"SELECT record_id, nullif(upper(substring({_cn}, 1, 1)) || substring({_cn}, 2), '') AS case_name FROM structured")
def case_names_normalized(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "structured").select("record_id", text.normalize_case_name(F.col("case_name")).alias("case_name"))


@query(
    "SELECT record_id, CASE WHEN l <> '' AND respondent <> '' THEN l || ' v. ' || respondent WHEN l <> '' THEN l ELSE nullif(respondent, '') END AS made FROM (SELECT record_id, coalesce(array_to_string(appellants, ', '), '') AS l, coalesce(respondent, '') AS respondent FROM structured)"
)
def case_names_made(spark: SparkSession, sf: str) -> DataFrame:
    one = F.array_compact(F.array("respondent"))
    return table(spark, sf, "structured").select("record_id", text.make_case_name(F.col("appellants"), one).alias("made"))


@query(
    "SELECT record_id, CAST(row_number() OVER (PARTITION BY record_id ORDER BY pos) AS BIGINT) AS pos, v AS value FROM (SELECT record_id, pos, v, row_number() OVER (PARTITION BY record_id, lower(v) ORDER BY pos) AS k FROM (SELECT record_id, generate_subscripts(statutes, 1) AS pos, unnest(statutes) AS v FROM structured)) WHERE k = 1"
)
def statutes_distinct(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "structured").select("record_id", F.posexplode(text.distinct_ci(F.col("statutes"))).alias("pos", "value"))
    return s.select("record_id", (F.col("pos") + 1).cast("bigint").alias("pos"), "value")


# --- segmentation ------------------------------------------------------------------------------------------------------------

_MARKED = " OR ".join(f"contains(lower(line), {q(m.lower())})" for m in rules.HEADER_MARKERS)
_IS_HEADER = f"(line <> '' AND ((regexp_matches(line, {q(rules.HEADER_CAPITALS)}) AND len(string_split_regex(line, '\\s+')) <= 12) OR {_MARKED} OR regexp_matches(line, {q(rules.HEADER_CAPTION)}) OR regexp_matches(line, {q(rules.HEADER_NUMBER)})))"
_LINES = (
    "lines AS (SELECT doc_id, generate_subscripts(l, 1) AS pos, regexp_replace(unnest(l), '^\\s+|\\s+$', '', 'g') AS line FROM (SELECT doc_id, string_split_regex(coalesce(text, ''), '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]') AS l FROM documents)), "
    f"flags AS (SELECT *, {_IS_HEADER} AS is_header, regexp_matches(line, {q(rules.ORDER_START)}) AS is_order, (line <> '' AND (regexp_matches(line, {q(rules.BODY_START)}) OR (NOT {_IS_HEADER} AND regexp_matches(line, {q(rules.BODY_VERBS)})))) AS starts, sum(CASE WHEN line <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS nb FROM lines), "
    "borders AS (SELECT *, min(CASE WHEN is_order THEN pos END) OVER (PARTITION BY doc_id) AS order_pos, min(CASE WHEN starts OR (line <> '' AND nb > 51) THEN pos END) OVER (PARTITION BY doc_id) AS body_pos FROM flags), "
    "states AS (SELECT *, CASE WHEN pos >= order_pos THEN 'order' WHEN pos >= body_pos THEN 'body' ELSE 'header' END AS state FROM borders)"
)


@query(f"WITH {_LINES} SELECT doc_id, CAST(pos AS BIGINT) AS pos, line, state FROM states")
def segment_lines(spark: SparkSession, sf: str) -> DataFrame:
    d = segmenting.with_borders(table(spark, sf, "documents").select("doc_id", "text"), "text")
    lines = d.select("doc_id", "_body", "_order", F.posexplode("_lines").alias("i", "line")).withColumn("pos", (F.col("i") + 1).cast("bigint"))
    state = F.when(F.col("pos") >= F.col("_order"), "order").when(F.col("pos") >= F.col("_body"), "body").otherwise("header")
    return lines.select("doc_id", "pos", "line", state.alias("state"))


_CUT = "nullif(length(regexp_extract(b, '(?is)^(.*?)(?:\\n|^)(?:Held:|ORDER|O R D E R:)', 1)) + 1, 0)"


@query(
    f"WITH {_LINES}, joined AS (SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE state = 'header' AND line <> ''), '') AS header, "
    "regexp_replace(regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE state = 'body'), ''), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS b, "
    "coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE state = 'order' AND line <> ''), '') AS o FROM states GROUP BY doc_id), "
    "cut AS (SELECT *, (o = '' AND b <> '' AND regexp_matches(b, '(?i)(?:\\n|^)(?:Held:|ORDER|O R D E R:)')) AS c FROM joined) "
    "SELECT doc_id, header, CASE WHEN c THEN regexp_replace(regexp_extract(b, '(?is)^(.*?)(?:\\n|^)(?:Held:|ORDER|O R D E R:)', 1), '^\\s+|\\s+$', '', 'g') ELSE b END AS body, "
    "CASE WHEN c THEN regexp_replace(substring(b, length(regexp_extract(b, '(?is)^(.*?)(?:\\n|^)(?:Held:|ORDER|O R D E R:)', 1)) + 1), '^\\s+|\\s+$', '', 'g') ELSE o END AS order_text FROM cut"
)
def segment_text(spark: SparkSession, sf: str) -> DataFrame:
    return segmenting.split_segments(table(spark, sf, "documents").select("doc_id", "text"), "text").drop("text")


@query(f"WITH {_LINES} SELECT state, count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS n_chars FROM states GROUP BY state")
def segment_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return segment_lines(spark, sf).groupBy("state").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("n_chars"))


# --- spans, union and merge --------------------------------------------------------------------------------------------------


@query(
    "WITH t AS (SELECT DISTINCT doc_id, seq, label, (seq * 7) AS s, (seq * 7 + 9) AS e FROM entities), w AS (SELECT *, CASE WHEN label IS NOT DISTINCT FROM lag(label) OVER (PARTITION BY doc_id ORDER BY seq, label) THEN 0 ELSE 1 END AS c FROM t), "
    "i AS (SELECT *, sum(c) OVER (PARTITION BY doc_id ORDER BY seq, label ROWS UNBOUNDED PRECEDING) AS island FROM w), g AS (SELECT doc_id, island, label, min(s) AS s, max(e) AS e FROM i GROUP BY ALL), "
    "v AS (SELECT doc_id, CAST(island AS BIGINT) AS island, label, regexp_replace(regexp_replace(substring(text, CAST(s + 1 AS BIGINT), CAST(e - s AS BIGINT)), '\\s+', ' ', 'g'), '^[ ,.;:]+|[ ,.;:]+$', '', 'g') AS value FROM g JOIN documents USING (doc_id)) SELECT * FROM v WHERE length(value) > 1"
)
def token_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Spans over predictions made from the entity table: one of nine characters for each (document, seq, label)."""
    t = table(spark, sf, "entities").select("doc_id", "seq", F.col("label").alias("entity")).distinct()
    t = t.select("doc_id", F.struct("seq", "entity").alias("seq"), "entity", (F.col("seq") * 7).alias("start"), (F.col("seq") * 7 + 9).alias("end"))
    return finding.token_spans(t, table(spark, sf, "documents").select("doc_id", "text"), ["doc_id"], "text")


_KEY = "CASE upper(trim(label)) " + " ".join(f"WHEN {q(a)} THEN {q(b)}" for a, b in rules.LABEL_KEYS.items()) + " ELSE lower(trim(label)) END"
_VALUE = (
    f"(SELECT *, regexp_replace(CASE WHEN key = 'statute' THEN {text.sql('w', text.STATUTE)} ELSE w END, '^[.,;:]+|[.,;:]+$', '', 'g') AS value FROM "
    f"(SELECT doc_id, {_KEY} AS key, CASE WHEN contains(lower(provenance), 'header') THEN 0 WHEN lower(provenance) = 'bert' THEN 1 ELSE 2 END AS rnk, seq, entity_text AS raw, {text.sql('entity_text', text.WHITESPACE)} AS w FROM entities WHERE entity_text IS NOT NULL))"
)
_MERGED = (
    f"(SELECT doc_id, key, CAST(row_number() OVER (PARTITION BY doc_id, key ORDER BY rnk, seq, raw) AS BIGINT) AS pos, value FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, key, lower(value) ORDER BY rnk, seq, raw) AS k FROM {_VALUE} WHERE value <> '' AND NOT (key = 'statute' AND length(value) < 6)) WHERE k = 1)"
)


def _merged(spark: SparkSession, sf: str) -> DataFrame:
    return merging.merge_entities(table(spark, sf, "entities"), "doc_id", "provenance", "seq", "label", "entity_text")


@query(f"SELECT doc_id, key, pos, value FROM {_MERGED}")
def merged_entities(spark: SparkSession, sf: str) -> DataFrame:
    return _merged(spark, sf)


@query(f"SELECT key, count(*) AS n_values, count(DISTINCT doc_id) AS n_documents FROM {_MERGED} GROUP BY key")
def entity_counts_by_label(spark: SparkSession, sf: str) -> DataFrame:
    return _merged(spark, sf).groupBy("key").agg(F.count("*").alias("n_values"), F.countDistinct("doc_id").alias("n_documents"))


@query(f"SELECT doc_id, key, pos, value FROM {_MERGED} WHERE pos > 1 AND key IN ('case_number', 'court', 'date')")
def extra_values(spark: SparkSession, sf: str) -> DataFrame:
    return _merged(spark, sf).where("pos > 1 AND key IN ('case_number', 'court', 'date')")


@query()
def merged_records(spark: SparkSession, sf: str) -> DataFrame:
    return merging.merged_map(_merged(spark, sf), "doc_id")


@query()
def precedent_fuzzy_distinct(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "structured").select("record_id", F.explode("precedents").alias("value"))
    return merging.fuzzy_distinct(s, "record_id", "value")


# --- primary values ----------------------------------------------------------------------------------------------------------


def _listed(spark: SparkSession, sf: str, label: str) -> DataFrame:
    e = table(spark, sf, "entities").where((F.col("label") == label) & F.col("entity_text").isNotNull())
    return e.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "entity_text"))), lambda x: x["entity_text"]).alias("values"))


def _listed_sql(label: str) -> str:
    return f"(SELECT doc_id, entity_text AS v, row_number() OVER (PARTITION BY doc_id ORDER BY seq, entity_text) AS pos FROM entities WHERE label = {q(label)} AND entity_text IS NOT NULL)"


_PRIORITY = "CASE " + " ".join(f"WHEN contains(lower(v), {q(p)}) THEN {i}" for i, p in enumerate(rules.CASE_NUMBER_PRIORITY)) + " ELSE 99 END"


@query(f"SELECT doc_id, trim(v) AS appeal_number FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY {_PRIORITY}, CASE WHEN {_PRIORITY} = 99 THEN -length(trim(v)) ELSE 0 END, pos) AS k FROM {_listed_sql('CASE_NUMBER')}) WHERE k = 1")
def primary_case_number(spark: SparkSession, sf: str) -> DataFrame:
    return _listed(spark, sf, "CASE_NUMBER").select("doc_id", selecting.primary_case_number(F.col("values")).alias("appeal_number"))


_COURT = "CASE WHEN contains(lower(v), 'supreme court') THEN 100 WHEN contains(lower(v), 'high court of judicature') OR regexp_matches(lower(v), 'high court of\\b') THEN 80 WHEN contains(lower(v), 'high court') THEN 70 WHEN contains(lower(v), 'district court') THEN 40 WHEN contains(lower(v), 'judicial magistrate') THEN 30 ELSE 10 END"


@query(
    f"SELECT doc_id, trim(regexp_replace(regexp_replace(v, '(?i)\\bSUPREME COURT OF INDIA\\b', 'Supreme Court of India', 'g'), '(?i)\\bHIGH COURT OF JUDICATURE AT\\b', 'High Court of', 'g')) AS court FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY {_COURT} DESC, pos) AS k FROM (SELECT doc_id, pos, regexp_replace(trim(v), '\\s+', ' ', 'g') AS v FROM {_listed_sql('COURT')}) WHERE v <> '') WHERE k = 1"
)
def primary_court(spark: SparkSession, sf: str) -> DataFrame:
    return _listed(spark, sf, "COURT").select("doc_id", selecting.primary_court(F.col("values")).alias("court"))


@query()
def primary_date(spark: SparkSession, sf: str) -> DataFrame:
    return _listed(spark, sf, "DATE").select("doc_id", selecting.primary_date(F.col("values"), F.lit(AS_OF).cast("date")).alias("date_of_judgment"))


# --- records -----------------------------------------------------------------------------------------------------------------


def _one(name: str, field: str, make) -> None:  # noqa: ANN001
    """A scalar or struct extractor over one column of segments."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        d = table(spark, sf, "segments").select("segment_id", make(F.col(field)).alias("v"))
        return d.select("segment_id", "v.*") if d.schema["v"].dataType.typeName() == "struct" else d.withColumnRenamed("v", name)

    query(None, f"segment_{name}")(run)


def _list(name: str, field: str, make) -> None:  # noqa: ANN001
    """A list extractor over one column of segments, one row for each element."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        d = table(spark, sf, "segments").select("segment_id", F.posexplode(make(F.col(field))).alias("pos", "value"))
        return d.select("segment_id", (F.col("pos") + 1).cast("bigint").alias("pos"), "value")

    query(None, f"segment_{name}")(run)




@query()
def segment_case_name(spark: SparkSession, sf: str) -> DataFrame:
    return extracting.with_case_name(table(spark, sf, "segments").select("segment_id", "header"), "header").select("segment_id", "case_name")


@query()
def segment_parties(spark: SparkSession, sf: str) -> DataFrame:
    return extracting.with_parties(table(spark, sf, "segments").select("segment_id", "header"), "header").select("segment_id", "appellants", "respondents")


def segment_advocates(spark: SparkSession, sf: str) -> DataFrame:
    """Advocates named anywhere in a ruling: header, body and order."""
    s = table(spark, sf, "segments").select("segment_id", F.concat_ws("\n", "header", "body", "order_text").alias("t"))
    return s.select("segment_id", extracting.advocates(F.col("t")).alias("v")).select("segment_id", "v.*")


query()(segment_advocates)
_one("order_summary", "order_text", extracting.order_summary)
_one("conclusion", "order_text", extracting.conclusion)
_list("coram", "header", extracting.coram)
_list("background_facts", "body", extracting.background_facts)
_list("issues", "body", extracting.issues)

_ORDER = text.sql("order_text", text.CLEAN)
_FIRST = f"lower(regexp_extract({_ORDER}, {q(rules.RESULTS[0][0])}, 0))"
_TITLE = f"array_to_string(list_transform(string_split(regexp_replace({_FIRST}, '\\s+', ' ', 'g'), ' '), lambda w: upper(w[1:1]) || w[2:]), ' ')"


@query(
    f"SELECT segment_id, CASE WHEN coalesce(order_text, '') = '' THEN 'Not found' WHEN regexp_matches({_ORDER}, {q(rules.RESULTS[0][0])}) THEN {_TITLE} "
    + " ".join(f"WHEN regexp_matches({_ORDER}, {q(p)}) THEN {q(n)}" for p, n in rules.RESULTS[1:])
    + " ELSE 'Not determined' END AS result FROM segments"
)
def order_results(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "segments").select("segment_id", extracting.order_result(F.col("order_text")).alias("result"))


_CITATION_FORMS = [r"\(\d{4}\)\s*\d+\s*SCC\s*\d+", r"AIR\s+\d{4}\s+\w+\s+\d+", r"\d{4}\s+SCC\s+OnLine\s+\w+\s+\d+"]
_CITED = "CASE WHEN n = '' THEN '' " + " ".join(f"WHEN regexp_matches(v, {q(p)}) THEN regexp_extract(v, {q(p)}, 0)" for p in _CITATION_FORMS) + " ELSE '' END"
_NAMED = q(r"^(.+?)\s*(?:\(\d{4}\)|\bAIR\b|\d{4}\s+SCC)")


@query(
    "SELECT record_id, CAST(pos AS BIGINT) AS pos, trim(CASE WHEN n = '' THEN v ELSE n END) AS case_name, trim(c) AS citation, regexp_extract(c, '\\d{4}', 0) AS year, CASE WHEN contains(lower(c), 'scc') OR contains(lower(c), 'scr') THEN 'supreme_court' ELSE 'other' END AS category "
    f"FROM (SELECT *, {_CITED} AS c FROM (SELECT *, regexp_extract(v, {_NAMED}, 1) AS n FROM (SELECT record_id, generate_subscripts(precedents, 1) AS pos, unnest(precedents) AS v FROM structured))) WHERE v <> ''"
)
def structured_precedents(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "structured").select("record_id", F.posexplode("precedents").alias("pos", "v")).select("record_id", (F.col("pos") + 1).cast("bigint").alias("pos"), extracting.structured_precedent(F.col("v")).alias("p"))
    return s.where("p IS NOT NULL").select("record_id", "pos", "p.*", extracting.precedent_category(F.col("p.citation")).alias("category"))


@query()
def structured_records(spark: SparkSession, sf: str) -> DataFrame:
    """Whole documents to records."""
    return assembly.structured_record(table(spark, sf, "documents"), "doc_id", "text", F.lit(AS_OF).cast("date"), table(spark, sf, "gazetteer"))


# --- projection and reports --------------------------------------------------------------------------------------------------


@query("SELECT * FROM (VALUES " + ", ".join(f"({q(a)}, {q(b)}, {q(c)})" for a, b, c in rules.FIELDS) + ") t(name, description, type)")
def field_catalog(spark: SparkSession, sf: str) -> DataFrame:
    return projecting.field_catalog(spark)


_ALIASES = "(VALUES " + ", ".join(f"({i}, {q(a)}, {q(f)})" for i, (a, f) in enumerate(rules.FIELD_ALIASES)) + ") a(n, alias, field)"
_FIELD_NAMES = ", ".join(q(f) for f, _, _ in rules.FIELDS)


@query(
    "WITH r AS (SELECT doc_id, generate_subscripts(wanted_fields, 1) AS i, lower(trim(unnest(wanted_fields))) AS asked FROM field_requests), "
    f"hits AS (SELECT r.asked, a.field, row_number() OVER (PARTITION BY r.asked ORDER BY CASE WHEN r.asked = a.alias THEN 0 ELSE 1 END, a.n) AS k FROM (SELECT DISTINCT asked FROM r) r JOIN {_ALIASES} ON contains(a.alias, r.asked) OR contains(r.asked, a.alias)), "
    f"got AS (SELECT doc_id, i, coalesce(h.field, CASE WHEN replace(r.asked, ' ', '_') IN ({_FIELD_NAMES}) THEN replace(r.asked, ' ', '_') END) AS field FROM r LEFT JOIN hits h ON h.asked = r.asked AND h.k = 1), "
    "f AS (SELECT doc_id, field, min(i) AS i FROM got WHERE field IS NOT NULL GROUP BY ALL) SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i, field) AS BIGINT) AS pos, field FROM f"
)
def field_projection(spark: SparkSession, sf: str) -> DataFrame:
    return projecting.field_requests(table(spark, sf, "field_requests"), "doc_id", "wanted_fields")


@query()
def report_lines(spark: SparkSession, sf: str) -> DataFrame:
    return projecting.page_numbers(projecting.report_lines(table(spark, sf, "structured"), "record_id"), "record_id", ["section_no", "item_no"])


@query()
def record_json(spark: SparkSession, sf: str) -> DataFrame:
    return projecting.sparse_json(table(spark, sf, "structured"), "record_id")


# --- quality -----------------------------------------------------------------------------------------------------------------


def _reports(spark: SparkSession, sf: str) -> DataFrame:
    return quality.quality_report(table(spark, sf, "structured"), "record_id", AS_OF_YEAR)


def _say(channel: str, when: str, message: str) -> str:
    return f"CASE WHEN {when} THEN {q(channel + '|')} || {message} END"


_TEXTS = ("case_name", "court", "date_of_judgment", "appeal_number", "respondent")
_LISTS = ("coram", "appellants", "precedents", "provisions", "statutes")
_HAS = {f: f"coalesce({f}, '') <> ''" for f in _TEXTS} | {f: f"coalesce(len({f}), 0) > 0" for f in _LISTS} | {"advocates": "advocates IS NOT NULL", "citations": "false", "content_info": "content_info IS NOT NULL"}
_YEAR = "TRY_CAST(nullif(regexp_extract(date_of_judgment, '(?:19|20)\\d{2}', 0), '') AS INT)"
_MESSAGES = [
    _say("error", f"NOT ({_HAS['case_name']})", "'Case name is missing'"),
    _say("warning", f"{_HAS['case_name']} AND length(case_name) < 5", "'Case name appears too short'"),
    _say("warning", "length(case_name) > 500", "'Case name appears unusually long'"),
    _say("warning", f"{_HAS['case_name']} AND NOT (" + " OR ".join(f"contains(lower(case_name), {q(w)})" for w in ("vs", "v.", "versus", "and")) + ")", q("Case name may be malformed (missing 'vs' or 'v.')")),
    _say("warning", f"NOT ({_HAS['appeal_number']})", "'Appeal number not found'"),
    _say("warning", f"{_HAS['appeal_number']} AND NOT regexp_matches(appeal_number, " + q(r"(?:19|20)\d{2}") + ")", "'Appeal number missing year component'"),
    _say("error", f"{_HAS['appeal_number']} AND NOT regexp_matches(appeal_number, " + q(r"\d+") + ")", "'Appeal number missing numeric component'"),
    _say("warning", "length(appeal_number) > 100", "'Appeal number appears unusually long'"),
    _say("error", f"NOT ({_HAS['court']})", "'Court name is missing - critical field'"),
    _say("warning", f"{_HAS['court']} AND length(court) < 5", "'Court name appears too short'"),
    _say("warning", f"{_HAS['court']} AND NOT (" + " OR ".join(f"contains(lower(court), {q(w)})" for w in quality.COURT_WORDS) + ")", "'Court name may not be a valid court entity'"),
    _say("warning", f"NOT ({_HAS['date_of_judgment']})", "'Judgment date not found'"),
    _say("warning", f"{_HAS['date_of_judgment']} AND NOT (" + " OR ".join(f"regexp_matches(date_of_judgment, {q(p)})" for p in quality.DATE_FORMS) + ")", "'Date format appears non-standard'"),
    _say("error", f"{_YEAR} > {AS_OF_YEAR}", f"'Judgment date is in the future: ' || {_YEAR}"),
    _say("warning", f"{_YEAR} < 1947", f"'Judgment date is very old: ' || {_YEAR}"),
    _say("warning", f"NOT ({_HAS['coram']})", "'Coram (judges) not found'"),
    _say("warning", "len(coram) > 11", "'Unusually large bench: ' || len(coram) || ' judges'"),
    _say("warning", f"NOT ({_HAS['appellants']})", "'Appellants not found'"),
    _say("warning", "len(appellants) > 50", "'Unusually high appellant count: ' || len(appellants)"),
    _say("warning", "len(appellants) <> len(list_distinct(list_transform(appellants, lambda x: lower(x))))", "'Duplicate appellants detected'"),
    _say("warning", f"NOT ({_HAS['respondent']})", "'Respondent not found'"),
    _say("info", "advocates IS NULL", "'Advocate information not extracted'"),
    _say("warning", "advocates IS NOT NULL AND coalesce(len(advocates.for_appellants), 0) + coalesce(len(advocates.for_respondent), 0) = 0", "'No advocates listed for either party'"),
    _say("warning", "len(advocates.for_appellants) > 20", "'Unusually many advocates for appellants: ' || len(advocates.for_appellants)"),
    _say("warning", "len(advocates.for_respondent) > 20", "'Unusually many advocates for respondent: ' || len(advocates.for_respondent)"),
    _say("warning", "len(precedents) > 100", "'Very high precedent count (' || len(precedents) || ') - possible over-extraction'"),
    _say("warning", "len(provisions) > 50", "'Very high provision count: ' || len(provisions)"),
    _say("warning", "len(statutes) > 30", "'High statute count: ' || len(statutes)"),
    _say("info", "true", "'No citations extracted'"),
    _say("info", "content_info IS NULL", "'No content information extracted'"),
    _say("warning", "len(content_info.background_facts) > 30", "'Very high background fact count: ' || len(content_info.background_facts)"),
    _say("warning", "content_info.order_summary IS NOT NULL AND coalesce(content_info.order_summary.result, '') = '' AND coalesce(content_info.order_summary.decision, '') = ''", "'Order summary lacks result or decision'"),
]
_JUDGES = "list_filter(list_transform(coalesce(coram, []), lambda j: CASE WHEN length(j) < 3 THEN 'warning|Invalid judge name: ''' || j || '''' WHEN NOT regexp_matches(j, '[A-Z]') THEN 'warning|Judge name lacks capitalization: ''' || j || '''' END), lambda m: m IS NOT NULL)"
_SHORT = "list_transform(list_filter(coalesce(provisions, [])[1:10], lambda p: length(p) < 3), lambda p: 'warning|Malformed provision: ''' || p || '''')"
_MSG = f"(SELECT *, list_concat(list_concat(list_filter([{', '.join(_MESSAGES)}], lambda m: m IS NOT NULL), {_JUDGES}), {_SHORT}) AS msgs FROM structured)"
_COUNTS = ", ".join(f"CAST({' + '.join(f'CAST({_HAS[f]} AS BIGINT)' for f in fields)} AS BIGINT) AS {name}_present" for name, fields, _ in quality.GROUPS)
_SCORED = f"(SELECT *, {_COUNTS}, CAST(len(list_filter(msgs, lambda m: starts_with(m, 'error'))) AS BIGINT) AS n_errors, CAST(len(list_filter(msgs, lambda m: starts_with(m, 'warning'))) AS BIGINT) AS n_warnings FROM {_MSG})"
_SCORED = f"(SELECT *, round(critical_present / 3.0::DOUBLE * 50.0::DOUBLE + important_present / 4.0::DOUBLE * 30.0::DOUBLE + optional_present / 6.0::DOUBLE * 20.0::DOUBLE, 2) AS completeness FROM {_SCORED})"
_BASE = "CASE WHEN completeness >= 90 THEN 0 WHEN completeness >= 80 THEN 1 WHEN completeness >= 70 THEN 2 WHEN completeness >= 60 THEN 3 ELSE 5 END"
_DROP = "CASE WHEN n_errors > 5 THEN 2 WHEN n_errors > 2 THEN 1 ELSE 0 END"
_GRADE = f"substring('ABCDEF', least(least({_BASE} + {_DROP}, 5) + CASE WHEN n_warnings > 10 THEN 1 ELSE 0 END, 5) + 1, 1) || CASE WHEN completeness >= 95 AND n_errors = 0 AND n_warnings <= 2 THEN '+' WHEN completeness < 65 OR n_errors > 3 OR n_warnings > 8 THEN '-' ELSE '' END"
_GRADED = f"(SELECT *, {_GRADE} AS grade FROM {_SCORED})"
_STATUS = "CASE " + " ".join(f"WHEN starts_with(grade, {q(a)}) THEN {q(b)}" for a, b in quality.STATUS[:-1]) + f" ELSE {q(quality.STATUS[-1][1])} END"


@query(f"SELECT record_id, split_part(m, '|', 1) AS channel, substring(m, strpos(m, '|') + 1) AS message FROM (SELECT record_id, unnest(msgs) AS m FROM {_MSG})")
def validation_messages(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "structured")
    return s.select("record_id", F.explode(quality.messages(s, AS_OF_YEAR)).alias("m")).select("record_id", "m.*")


@query(f"SELECT record_id, critical_present, important_present, optional_present, completeness FROM {_SCORED}")
def completeness(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "structured")
    c = quality.completeness(s)
    return s.select("record_id", *[c[k].alias(k) for k in ("critical_present", "important_present", "optional_present", "completeness")])


@query(f"SELECT record_id, completeness, n_errors, n_warnings, grade, {_STATUS} AS quality_status FROM {_GRADED}")
def quality_grades(spark: SparkSession, sf: str) -> DataFrame:
    return _reports(spark, sf).select("record_id", "completeness", "n_errors", "n_warnings", "grade", "quality_status")


@query()
def quality_reports(spark: SparkSession, sf: str) -> DataFrame:
    return _reports(spark, sf)


_ADVICE = [
    ("a < 70", "'Batch has low average completeness - review document quality and extraction pipeline'"),
    ("e > 2", "printf('High error rate (%.1f errors/doc) - investigate extraction issues', e)"),
    ("w > 5", "printf('High warning rate (%.1f warnings/doc) - consider preprocessing improvements', w)"),
    ("a >= 85 AND e < 1", "'Batch quality is good - suitable for production use'"),
]


@query(
    "SELECT total_documents, round(a, 2) AS average_completeness, total_errors, total_warnings, concat_ws(' | ', " + ", ".join(f"CASE WHEN {c} THEN {m} END" for c, m in _ADVICE) + ") AS batch_recommendations "
    "FROM (SELECT *, total_errors / total_documents AS e, total_warnings / total_documents AS w FROM "
    f"(SELECT count(*) AS total_documents, avg(completeness) AS a, CAST(sum(n_errors) AS BIGINT) AS total_errors, CAST(sum(n_warnings) AS BIGINT) AS total_warnings FROM {_GRADED}))"
)
def batch_summary(spark: SparkSession, sf: str) -> DataFrame:
    return quality.batch_summary(_reports(spark, sf))


@query(f"SELECT substring(grade, 1, 1) AS grade_letter, count(*) AS n FROM {_GRADED} GROUP BY 1")
def grade_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return quality.grade_distribution(_reports(spark, sf))


@query(f"SELECT CAST(row_number() OVER (ORDER BY record_id) - 1 AS BIGINT) AS document_index, record_id, grade, completeness, n_errors AS errors, n_warnings AS warnings FROM {_GRADED}")
def individual_results(spark: SparkSession, sf: str) -> DataFrame:
    return quality.individual_results(_reports(spark, sf), "record_id")


# --- whole producers and the rest of the small operators ------------------------------------------------------------------------


@query("SELECT * FROM (VALUES " + ", ".join(f"(CAST({i} AS BIGINT), {q(name)})" for i, name in enumerate(rules.CLASSIFIER_LABELS)) + ") t(id, label)")
def classifier_labels(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(rules.CLASSIFIER_LABELS)), "id bigint, label string")


@query()
def lawyers_on_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Names of two words or more on the rest of a 'For Petitioner' or 'For Respondent' line."""
    return finding.named_on_lines(table(spark, sf, "documents"), "doc_id", "text")


@query()
def party_lines_header(spark: SparkSession, sf: str) -> DataFrame:
    return finding.party_lines(table(spark, sf, "documents"), "doc_id", "text", rules.PARTY_LINES_A)


@query()
def entities_of_segments(spark: SparkSession, sf: str) -> DataFrame:
    """The first producer over header and body: distinct values of a label in code-point order."""
    return assembly.segment_entities(table(spark, sf, "segments"), "segment_id")


@query()
def entities_of_documents(spark: SparkSession, sf: str) -> DataFrame:
    """The second producer over whole texts, distinct values in order of appearance."""
    d = table(spark, sf, "documents").select("doc_id", F.posexplode(F.array_distinct(assembly.text_values(F.col("text")))).alias("pos", "m"))
    return d.select("doc_id", (F.col("pos") + 1).cast("bigint").alias("pos"), "m.label", "m.value")


@query()
def gazetteer_entities(spark: SparkSession, sf: str) -> DataFrame:
    return assembly.gazetteer_entities(table(spark, sf, "documents"), "doc_id", "text", table(spark, sf, "gazetteer"), "label", "canonical_name")


@query()
def requested_fields(spark: SparkSession, sf: str) -> DataFrame:
    """What each request gets from the first record of its document, or the error row."""
    s = table(spark, sf, "structured")
    first = s.groupBy("doc_id").agg(F.min("record_id").alias("record_id"))
    return projecting.requested_records(s.join(first, ["doc_id", "record_id"]).drop("record_id"), table(spark, sf, "field_requests"), "doc_id", "wanted_fields")


@query()
def filtered_report_lines(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "structured")
    first = s.groupBy("doc_id").agg(F.min("record_id").alias("record_id"))
    return projecting.filtered_report_lines(s.join(first, ["doc_id", "record_id"]).drop("record_id"), table(spark, sf, "field_requests"), "doc_id", "wanted_fields")


_ENTITY_ORG = text.sql("entity_text", text.ORGANIZATION)


@query(
    f"SELECT doc_id, seq, label, CASE WHEN lower(label) = 'organization' THEN {_ENTITY_ORG} WHEN lower(label) = 'statute' THEN CASE WHEN contains(entity_text, 'CrPC') THEN 'Code of Criminal Procedure, 1973' WHEN contains(entity_text, 'NI Act') OR contains(entity_text, 'Negotiable Instrument') THEN 'Negotiable Instruments Act, 1881' ELSE entity_text END ELSE entity_text END AS value FROM entities"
)
def entities_normalized(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "entities").select("doc_id", "seq", "label", text.normalize_entity(F.col("label"), F.col("entity_text")).alias("value"))


_PRED = "regexp_replace(coalesce(entity_text, ''), '^[\\W_]+|\\s+$', '', 'g')"


@query(f"SELECT doc_id, seq, label, CASE WHEN label IN ('JUDGE', 'PRECEDENT', 'PETITIONER', 'RESPONDENT') THEN upper(substring(v, 1, 1)) || substring(v, 2) ELSE v END AS value FROM (SELECT doc_id, seq, label, {_PRED} AS v FROM entities) WHERE length(v) >= 3")
def predictions_cleaned(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "entities").select("doc_id", "seq", "label", text.clean_prediction(F.col("label"), F.col("entity_text")).alias("value"))
    return e.where("value IS NOT NULL")


@query(
    "SELECT record_id, trim(s[1]) AS petitioner, trim(s[2]) AS respondent FROM (SELECT record_id, string_split_regex(case_name, '(?i)\\s+v\\.?s?\\.?\\s+') AS s FROM structured) WHERE len(s) = 2"
)
def parties_of_case_names(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "structured").select("record_id", merging.parties_from_case_name(F.col("case_name")).alias("p"))
    return s.where("p IS NOT NULL").select("record_id", "p.petitioner", "p.respondent")


@query()
def dates_parsed(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "structured").where("date_of_judgment IS NOT NULL").select("record_id", selecting.parse_date(F.col("date_of_judgment")).alias("day"))
    return s.where("day IS NOT NULL")


@query("SELECT 'ok' AS status, true AS rules_loaded")
def health(spark: SparkSession, sf: str) -> DataFrame:
    return spark.range(1).select(F.lit("ok").alias("status"), F.lit(bool(rules.PRODUCER_A and rules.PRODUCER_B)).alias("rules_loaded"))
