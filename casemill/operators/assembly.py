"""Whole texts to records: two producers of entities, their merge, and the fields that extractors find in the segments.

Entities travel as small rows of their own, so that the texts don't move: the first producer reads header and body, the second
the whole text; both are merged by document and key, and joined with what the extractors made of the same document.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemill.functions import rules, text
from casemill.operators import extracting, finding, merging, selecting
from casemill.operators.extracting import fixed, staged
from casemill.operators.segmenting import split_segments
from casemill.session import written

MOST_PATTERNS = 100_000  # patterns that are sent to the executors at once; more are searched for in several passes


def gazetteer_entities(df: DataFrame, id_col: str, text_col: str, gazetteer: DataFrame, label: str, name: str) -> DataFrame:
    """(id_col, seq, label, value): names of the gazetteer that stand in a text as whole words, as written.

    Of names that overlap the longest counts, of equally long ones the first. Patterns are searched for all at once; a gazetteer
    of more than ``MOST_PATTERNS`` names is searched for in parts, and overlaps between the parts are resolved afterwards. Null
    texts and names give nothing.
    """
    names = gazetteer.where(F.col(name).isNotNull() & (F.length(F.btrim(name)) > 0)).select(F.col(label).alias("label"), F.btrim(name).alias("value")).distinct()
    lean = df.where(F.col(text_col).isNotNull()).select(id_col, F.col(text_col).alias("_text"))
    parts = max(1, -(-names.count() // MOST_PATTERNS))
    found = None
    for part in range(parts):
        rows = names.where(F.pmod(F.xxhash64("value"), F.lit(parts)) == part).orderBy("value", "label").collect()
        hits = _hits(lean, id_col, [(r["label"], r["value"]) for r in rows])
        found = hits if found is None else found.unionByName(hits)
    per = found.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct((F.col("start") - F.col("stop")).alias("minus"), "start", "stop", "label", "value"))).alias("all")) if parts > 1 else None
    if per is not None:
        free = F.aggregate("all", F.lit(None).cast(per.schema["all"].dataType), lambda acc, x: F.when(acc.isNull(), F.array(x)).when(F.exists(acc, lambda y: (y["start"] < x["stop"]) & (x["start"] < y["stop"])), acc).otherwise(F.concat(acc, F.array(x))))
        found = per.select(id_col, F.explode(free).alias("f")).select(id_col, "f.start", "f.stop", "f.label", "f.value")
    return found.select(id_col, F.col("start").cast("bigint").alias("seq"), "label", "value")


def _hits(lean: DataFrame, id_col: str, names: list[tuple[str, str]]) -> DataFrame:
    kind = lean.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        tree = ahocorasick.Automaton()
        for lab, value in reversed(names):
            tree.add_word(value, (lab, value))
        if names:
            tree.make_automaton()
        inside = lambda t, i: 0 < i < len(t) and (t[i - 1].isalnum() or t[i - 1] == "_") and (t[i].isalnum() or t[i] == "_")
        for b in batches:
            rows = []
            for k, t in enumerate(b.column(1).to_pylist() if names else []):
                met = [(e + 1 - len(v), e + 1, lab, v) for e, (lab, v) in tree.iter(t)]
                taken: list[tuple[int, int]] = []
                for a, z, lab, v in sorted((m for m in met if not inside(t, m[0]) and not inside(t, m[1])), key=lambda m: (m[0] - m[1], m[0])):
                    if all(z <= x or y <= a for x, y in taken):
                        taken.append((a, z))
                        rows.append((k, a, z, lab, v))
            c = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(c[0], pa.int64())), *(pa.array(x, pa.int32()) for x in c[1:3]), *(pa.array(x, pa.string()) for x in c[3:])], [id_col, "start", "stop", "label", "value"])

    return lean.mapInArrow(run, f"`{id_col}` {kind}, start int, stop int, label string, value string")


_pair = lambda label, a: F.transform(a, lambda v: F.struct(F.lit(label).alias("label"), v.alias("value")))
_pairs = lambda a: F.transform(a, lambda m: F.struct(m["label"].alias("label"), m["value"].alias("value")))


def predicted_values(t: Column, spans: Column | None = None) -> Column:
    """Array of (label, value): the first producer's rules over one segment, and the classifier's spans in it if there are any;
    white space flattened, names made whole, distinct, in code-point order of label and value."""
    found = F.concat(
        _pairs(F.filter(finding.matches(t, rules.PRODUCER_A), finding.kept_a)), _pair("LAWYER", finding.named_values(t)),
        _pair("GPE", F.transform(finding.place_values(t, rules.PLACES_A, anywhere=True), lambda p: p["value"])), _pairs(finding.party_values(t, rules.PARTY_LINES_A, classifier=True)),
        *([_pairs(F.coalesce(spans, F.array().cast("array<struct<label:string,value:string>>")))] if spans is not None else []),
    )
    flat = lambda v: F.regexp_replace(F.regexp_replace(v, r"\s+", " "), r"^[ ,.;:]+|[ ,.;:]+$", "")
    clean = F.transform(found, lambda m: F.struct(m["label"].alias("label"), text.normalize_entity(m["label"], flat(m["value"])).alias("value")))
    return F.array_sort(F.array_distinct(F.filter(clean, lambda m: m["value"] != "")))


def text_values(t: Column) -> Column:
    """Array of (label, value): the second producer's rules over a whole text, in emission order."""
    return F.concat(
        _pairs(finding.matches(t, [*rules.CASE_NUMBERS_B, *rules.DATES_B, *rules.COURTS_B])), _pair("JUDGE", finding.bench_names(t)), _pair("LAWYER", finding.anchored_lawyers(t)),
        _pairs(F.filter(finding.matches(t, rules.LAWYERS_B), finding.kept_b)), _pair("PRECEDENT", finding.precedents(t)), _pairs(finding.matches(t, [*rules.PROVISIONS_B, *rules.STATUTES_B])),
        _pairs(finding.party_values(t, rules.PARTY_LINES_B, classifier=False)), _pair("GPE", F.transform(finding.place_values(t, rules.PLACES_B, anywhere=False), lambda p: p["value"])),
    )


def segment_entities(segments: DataFrame, id_col: str, spans: DataFrame | None = None) -> DataFrame:
    """(id_col, provenance, label, pos, value) of ``predicted_values`` for header and body; pos counts in each label.

    ``spans``: (id_col, provenance, label, value), the classifier's spans, as from ``finding.token_spans``.
    """
    d = segments.select(id_col, "header", "body")
    if spans is not None:
        per = spans.groupBy(id_col).agg(*[F.collect_list(F.when(F.col("provenance") == p, F.struct("label", "value"))).alias(f"_{p}") for p in ("header", "body")])
        d = d.join(per, id_col, "left")
    each = [F.transform(predicted_values(F.col(p), F.col(f"_{p}") if spans is not None else None), lambda m: F.struct(F.lit(p).alias("provenance"), m["label"].alias("label"), m["value"].alias("value"))) for p in ("header", "body")]
    rows = d.select(id_col, F.explode(F.concat(*each)).alias("m")).select(id_col, "m.*")
    from pyspark.sql import Window

    return rows.select(id_col, "provenance", "label", F.row_number().over(Window.partitionBy(id_col, "provenance", "label").orderBy("value")).cast("bigint").alias("pos"), "value")


def merged_values(d: DataFrame, id_col: str, text_col: str, gazetteer: DataFrame | None = None) -> DataFrame:
    """The merge of both producers, one row a document (see ``merging.merged_map``); ``d`` has header, body and ``text_col``."""
    step = lambda a, p: F.transform(a, lambda m, i: F.struct(F.lit(p).alias("provenance"), (i + 1).cast("bigint").alias("seq"), m["label"].alias("label"), m["value"].alias("value")))
    every = F.concat(step(predicted_values(F.col("header")), "header"), step(predicted_values(F.col("body")), "body"), step(text_values(F.col(text_col)), "spacy"))
    rows = d.select(id_col, F.explode(every).alias("m")).select(id_col, "m.*")
    # within a rank, what the body holds comes before the whole text, and the gazetteer's names before the rules'
    rows = rows.withColumn("seq", F.col("seq") + F.when(F.col("provenance") == "spacy", F.lit(2_000_000_000)).otherwise(F.lit(0)))
    if gazetteer is not None:
        named = gazetteer_entities(d, id_col, text_col, gazetteer, "label", "canonical_name")
        rows = rows.unionByName(named.select(id_col, F.lit("spacy").alias("provenance"), (F.col("seq") - F.lit(1_000_000_000) + F.lit(2_000_000_000)).alias("seq"), F.upper("label").alias("label"), "value"))
    rows = written(rows, "entity-rows")  # both branches of the merge read the rows; the rules run once
    return merging.merged_map(merging.merge_entities(rows, id_col, "provenance", "seq", "label", "value", fuzzy=True), id_col)


_some = lambda a: F.when(F.size(a) > 0, a)
_told = lambda c: F.nullif(c, F.lit(""))


def structured_record(documents: DataFrame, id_col: str, text_col: str, as_of: Column, gazetteer: DataFrame | None = None) -> DataFrame:
    """Whole texts to one record each: id and the 14 fields, empty ones null. ``as_of`` is the latest date a judgment may have.

    ``id_col`` is unique. A null text gives a record whose fields are null, but for an order that is not found.
    """
    d = staged(documents.select(F.col(id_col), F.col(text_col).alias("_raw")), _t=text.preclean(F.col("_raw"))).drop("_raw")
    d = fixed(split_segments(d, "_t"), ["header", "body", "order_text"])
    merged = merged_values(d, id_col, "_t", gazetteer)
    own = extracting.with_parties(extracting.with_case_name(d, "header", "_caption"), "header")
    own = staged(own, _name=text.normalize_case_name(F.col("_caption")), _a=extracting.advocates(F.col("_t")), _b=extracting.background_facts(F.col("body")), _o=extracting.order_summary(F.col("order_text")))
    sides = F.split("_name", r"(?i)\s+v\.?\s+")
    split = F.col("_name").contains(" v. ") & (F.size(sides) == 2)
    own = staged(own, _l=F.when((F.size("appellants") == 0) & split, F.array(F.btrim(sides[0]))).otherwise(F.col("appellants")), _r=F.when((F.size("respondents") == 0) & split, F.array(F.btrim(sides[1]))).otherwise(F.col("respondents")))
    made = F.when((F.size("_l") > 0) & (F.size("_r") > 0), text.make_case_name(F.col("_l"), F.slice("_r", 1, 1)))
    lists = [_some(F.col(f"_a.{k}")).alias(k) for k in ("for_appellants", "for_respondent")]
    counsel = F.when(F.greatest(F.size("_a.for_appellants"), F.size("_a.for_respondent")) > 0, F.struct(*lists))
    order = F.struct(_told(F.col("_o.result")).alias("result"), _told(F.col("_o.decision")).alias("decision"), _some(F.col("_o.directions")).alias("directions"))
    own = own.select(id_col, F.coalesce("_name", made).alias("case_name"), _some(F.col("_l")).alias("appellants"), F.try_element_at("_r", F.lit(1)).alias("_respondent"), counsel.alias("advocates"), F.struct(_some(F.col("_b")).alias("background_facts"), order.alias("order_summary")).alias("content_info"))
    d = own.join(merged, id_col, "left")
    many = lambda c, to: _some(F.col(c)).alias(to)
    return d.select(
        id_col, "case_name", selecting.primary_case_number(F.col("case_number")).alias("appeal_number"), selecting.primary_court(F.col("court")).alias("court"), selecting.primary_date(F.col("date"), as_of).alias("date_of_judgment"),
        many("coram", "coram"), "appellants", F.col("_respondent").alias("respondent"), "advocates", many("precedent", "precedents"), many("provision", "provisions"), many("statute", "statutes"), many("extra_courts", "lower_courts"), many("extra_dates", "other_dates"), "content_info",
    )
