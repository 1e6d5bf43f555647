"""Queries p1, p3 to p6 and p8 to p10 over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casemill.llm import canonical, linking, mixing, packing, reading, reference, scans, splitting, tokens
from casemill.session import written


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


_PARTS = {"header": F.col, "body": F.col, "order_text": F.col}


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    parts = {k: f(k) for k, f in _PARTS.items()}
    found = scans.find_defects(_t(spark, sf, "segments"), "segment_id", parts, "header")
    return found.select(F.col("id").alias("segment_id"), "part_name", "line_no", "defect").distinct()


def p1_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    """The repaired text of all segments as paragraphs."""
    parts = {k: f(k) for k, f in _PARTS.items()}
    return scans.repair(_t(spark, sf, "segments"), "segment_id", parts, "header").withColumnRenamed("id", "segment_id")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    s = _t(spark, sf, "structured").select("record_id", "matter_no", "case_name", "coram")
    return canonical.same_looking_pairs(s, "record_id", "matter_no", {"case_name": F.col("case_name"), "coram": canonical.joined(F.col("coram"))})


def name_occurrences(spark: SparkSession, sf: str) -> DataFrame:
    s = _t(spark, sf, "structured").select("matter_no", "coram", "advocates", "appellants", "respondent")
    lists = {"coram": F.col("coram"), "for_appellants": F.col("advocates.for_appellants"), "for_respondent": F.col("advocates.for_respondent")}
    return linking.spellings_of(s, "matter_no", lists, {"appellants": F.col("appellants"), "respondent": F.array("respondent")})


def _linked(spark: SparkSession, sf: str) -> DataFrame:
    return linking.link_spellings(written(name_occurrences(spark, sf), "names"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return linking.spelling_pairs(_linked(spark, sf))


def p4_entities(spark: SparkSession, sf: str) -> DataFrame:
    """Every spelling with the entity that it names."""
    return linking.spelling_entities(_linked(spark, sf))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    s = _t(spark, sf, "structured").select("record_id", "court", "statutes")
    fields = {"court": ("COURT", F.array("court")), "statutes": ("STATUTE", F.col("statutes"))}
    found = reference.match_reference(s, "record_id", fields, _t(spark, sf, "gazetteer"))
    return found.select(F.col("id").alias("record_id"), "field_name", "pos", "entry_id")



def _limit(spark: SparkSession, sf: str, name: str) -> int:
    return int(_t(spark, sf, "size_limits").where(F.col("limit_name") == name).select("amount").collect()[0][0])


def p6_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """All pieces of all segment bodies."""
    s = _t(spark, sf, "segments").select("segment_id", "body")
    return splitting.split_texts(s, "segment_id", "body", _limit(spark, sf, "body_max"), _limit(spark, sf, "body_overlap")).withColumnRenamed("id", "segment_id")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return p6_pieces(spark, sf).where("piece_no = 1 AND n_pieces > 1").select("segment_id")


def p8_containers(spark: SparkSession, sf: str) -> DataFrame:
    """Which container holds which part of which document."""
    n = written(tokens.count_tokens(_t(spark, sf, "documents"), "doc_id", "text", []), "lengths")
    return packing.fill_containers(n, _limit(spark, sf, "pack_capacity")).withColumnRenamed("id", "doc_id")


def p8_fill(spark: SparkSession, sf: str) -> DataFrame:
    return packing.fill_report(p8_containers(spark, sf), _limit(spark, sf, "pack_capacity"))


def p8_buckets(spark: SparkSession, sf: str) -> DataFrame:
    return packing.bucket_report(p8_containers(spark, sf))


def _mix(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    targets = [(r["source_name"], r["target_share"], r["max_repeats"]) for r in _t(spark, sf, "mix_targets").orderBy("source_name").collect()]
    return mixing.mixture(tokens.count_tokens(_t(spark, sf, "documents"), "doc_id", "text", ["source"]), targets)


def p9_mixture(spark: SparkSession, sf: str) -> DataFrame:
    """The slots of the mixture with the document pieces that fill them."""
    return _mix(spark, sf)[0].withColumnRenamed("id", "doc_id")


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    return _mix(spark, sf)[1]


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return reading.reading_levels(_t(spark, sf, "documents"), _t(spark, sf, "level_labels"), "doc_id", "text").withColumnRenamed("id", "doc_id")


QUERIES = {
    "p1_found": p1_found, "p1_paragraphs": p1_paragraphs, "p3_found": p3_found, "p4_found": p4_found, "p4_entities": p4_entities, "p5_found": p5_found, "p6_found": p6_found, "p6_pieces": p6_pieces,
    "p8_containers": p8_containers, "p8_fill": p8_fill, "p8_buckets": p8_buckets, "p9_mixture": p9_mixture, "p9_shares": p9_shares, "p10_found": p10_found,
}
_STORED = "SELECT record_id, matter_no, 'case_name' AS field_name, case_name AS stored FROM structured WHERE case_name IS NOT NULL UNION ALL SELECT record_id, matter_no, 'coram', array_to_string(list_transform(coram, lambda x: coalesce(x, chr(2))), chr(1)) FROM structured WHERE coram IS NOT NULL"
_PLAIN = f"SELECT *, {canonical.canonical_sql('stored')} AS plain FROM ({_STORED}) WHERE matter_no IS NOT NULL"
SQL: dict[str, str] = {
    "p5_found": f"WITH p AS ({_PLAIN}) SELECT DISTINCT a.field_name, a.record_id AS record_a, b.record_id AS record_b FROM p a JOIN p b ON a.matter_no = b.matter_no AND a.field_name = b.field_name AND a.plain = b.plain AND a.record_id < b.record_id AND a.stored <> b.stored",
    "p6_found": "SELECT segment_id FROM segments WHERE length(body) > (SELECT amount FROM size_limits WHERE limit_name = 'body_max')",
}
