"""Merge entities of several producers: one key for each label, clean values, provenance order, ordered distinct."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casemill.functions import rules, text

FUZZY_RATIO, FUZZY_MOST, FUZZY_SHORTEST = 0.85, 15, 10


def label_key(label: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in rules.LABEL_KEYS.items() for x in kv])
    return F.coalesce(F.try_element_at(known, F.upper(F.btrim(label))), F.lower(F.btrim(label)))


def provenance_rank(p: Column) -> Column:
    """Header first, then the classifier's own, then everything else; within a rank the order of arrival counts."""
    return F.when(F.lower(p).contains("header"), 0).when(F.lower(F.coalesce(p, F.lit(""))) == "bert", 1).otherwise(2)


def is_probable_lawyer(name: Column) -> Column:
    return (F.size(F.split(F.btrim(name), r"\s+")) >= 2) & ~name.rlike(rules.NOT_A_LAWYER) & (F.length(name) >= 4)


def with_clean_values(e: DataFrame, key: str, raw: str, predicted: str | None = None) -> DataFrame:
    """Add ``value``, cleaned by the rules of its key; rows to be left out are gone. ``predicted`` names a boolean column: is the
    row the classifier's?

    Each step is a column of its own, and rows are dropped by exploding an array without nulls: a filter would be pushed below
    the steps and repeat them.
    """
    words = lambda c: F.size(F.split(F.btrim(c), r"\s+"))
    k = F.col(key)
    judged = (k == "coram") & (F.col(predicted) if predicted else F.lit(False))
    e = e.withColumn("_w", text.clean_whitespace(F.col(raw)))
    e = e.withColumn("_w", F.when(k == "statute", text.normalize_statute(F.col("_w"))).when(judged, text.apply(F.col("_w"), text.JUDGE_PREDICTED)).otherwise(F.col("_w")))
    e = e.withColumn("_v", F.regexp_replace(F.btrim("_w"), r"^[.,;:]+|[.,;:]+$", ""))
    v = F.col("_v")
    lawyer = F.btrim(F.regexp_replace(v, r"(?i)\b(?:Sr\.?\s*Adv|Advocate|Adv\.|A\.S\.G\.?|A\.A\.G\.?|AOR)(?=$|\W)", ""))
    e = e.withColumn("_c", F.when(k.isin("petitioner", "respondent"), text.clean_party_name(v)).when(k == "lawyer", lawyer).when(k == "coram", text.apply(v, text.JUDGE_PREFIX)).otherwise(v))
    c = F.col("_c")
    single = (words(v) == 1) & ~v.rlike("(?i)justice") & ~v.contains(".") & (F.upper(v) != v)
    keep = (
        F.when(k == "coram", ~(v.rlike(r"(?i)^(?:and|&|-)$") | single | (v == "")))
        .when(c == "", False)
        .when(k.isin("petitioner", "respondent"), words(c) >= 2)
        .when(k == "organization", ~(c.rlike(r"^[A-Z\s]{3,200}$") & (words(c) > 2)))
        .when(k == "lawyer", is_probable_lawyer(c))
        .when(k == "statute", F.length(c) >= 6)
        .when(k == "precedent", F.length(c) >= 15)
        .otherwise(True)
    )
    return e.withColumn("value", F.explode(F.array_compact(F.array(F.when(keep & (c != ""), c))))).drop("_w", "_v", "_c")


def merge_entities(entities: DataFrame, id_col: str, provenance: str, seq: str, label: str, value: str, fuzzy: bool = False) -> DataFrame:
    """(id_col, key, pos, value): distinct values (in lower case) of each key in provenance order; pos counts from 1.

    Provenance ``regex`` or ``spacy`` is the second producer's; everything else is the classifier's. ``fuzzy`` first drops
    precedents that are near a longer one; their order is then by length.
    """
    p = F.lower(F.coalesce(F.col(provenance), F.lit("")))
    e = entities.where(F.col(value).isNotNull()).select(id_col, label_key(F.col(label)).alias("key"), provenance_rank(F.col(provenance)).alias("rank"), (~p.isin("regex", "spacy")).alias("predicted"), F.col(seq).cast("bigint").alias("seq"), F.col(value).alias("raw"))
    if fuzzy:
        near = e.where("key = 'precedent'").select(id_col, text.clean_whitespace(F.col("raw")).alias("raw")).where("raw <> ''")
        near = fuzzy_distinct(near, id_col, "raw").select(id_col, F.lit("precedent").alias("key"), F.lit(0).alias("rank"), F.lit(False).alias("predicted"), F.col("pos").alias("seq"), F.col("value").alias("raw"))
        e = e.where("key <> 'precedent'").unionByName(near)
    e = with_clean_values(e, "key", "raw", "predicted")
    order = F.struct("rank", "seq", "raw")
    first = e.groupBy(id_col, "key", F.lower("value").alias("lower")).agg(F.min_by(F.struct("value", "rank", "seq", "raw"), order).alias("f"))
    w = Window.partitionBy(id_col, "key").orderBy("f.rank", "f.seq", "f.raw")
    return first.select(id_col, "key", F.row_number().over(w).cast("bigint").alias("pos"), "f.value")


def merged_map(merged: DataFrame, id_col: str) -> DataFrame:
    """One row a document: an ordered array for each of the 12 keys, and the tails of case numbers, courts and dates."""
    keys = [*rules.MERGED_KEYS, "case_name"]
    per = merged.groupBy(id_col).pivot("key", keys).agg(F.array_sort(F.collect_list(F.struct("pos", "value"))))
    out = per.select(id_col, *[F.coalesce(F.transform(F.col(k), lambda x: x["value"]), F.array().cast("array<string>")).alias(k) for k in keys])
    tail = lambda k: F.slice(F.col(k), 2, F.greatest(F.size(k), F.lit(1)))
    # parties of a case name stand in where neither side was found
    sides = parties_from_case_name(F.try_element_at("case_name", F.lit(1))) if "case_name" in out.columns else None
    if sides is not None:
        none = (F.size("petitioner") == 0) & (F.size("respondent") == 0) & sides.isNotNull()
        out = out.withColumns({k: F.when(none & (sides[k] != ""), F.array(sides[k])).otherwise(F.col(k)) for k in ("petitioner", "respondent")}).drop("case_name")
    return out.withColumns({"extra_case_numbers": tail("case_number"), "extra_courts": tail("court"), "extra_dates": tail("date")})


def parties_from_case_name(name: Column) -> Column:
    """(petitioner, respondent) if the name splits in exactly two at v., vs. or v.s., else null."""
    sides = F.split(name, r"(?i)\s+v\.?s?\.?\s+")
    return F.when(F.size(sides) == 2, F.struct(F.btrim(sides[0]).alias("petitioner"), F.btrim(sides[1]).alias("respondent")))


def fuzzy_distinct(df: DataFrame, id_col: str, key_col: str) -> DataFrame:
    """(id_col, pos, value): values of each id that are not near an earlier kept one, longest first, 15 at most.

    Near means a matching-blocks ratio above 0.85 of the values without their citations. Each id's values are one small array,
    whose length the record's own limits bound; ties in length are broken by the value.
    """
    base = lambda c: F.lower(F.btrim(F.regexp_replace(F.btrim(F.regexp_replace(c, r"(?s)\s*\(\d{4}\).*$", "")), r"(?is)\s+(?:SCC|SCR|AIR).*$", "")))
    lists = df.where(F.col(key_col).isNotNull()).groupBy(id_col).agg(F.collect_set(F.struct((-F.length(key_col)).alias("minus"), F.col(key_col).alias("value"), base(F.col(key_col)).alias("base"))).alias("all"))
    lists = lists.select(id_col, F.array_sort("all").alias("all")).select(id_col, F.transform("all", lambda x: x["value"]).alias("v"), F.transform("all", lambda x: x["base"]).alias("b"))
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from difflib import SequenceMatcher

        for b in batches:
            rows: list[tuple[int, int, str]] = []
            for k, (values, bases) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
                kept: list[str] = []
                for v, x in zip(values, bases):
                    if len(x) >= FUZZY_SHORTEST and not any(SequenceMatcher(None, x, y).ratio() > FUZZY_RATIO for y in kept):
                        kept.append(x)
                        if len(kept) <= FUZZY_MOST:
                            rows.append((k, len(kept), v))
            c = list(zip(*rows)) or [()] * 3
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(c[0], pa.int64())), pa.array(c[1], pa.int64()), pa.array(c[2], pa.string())], [id_col, "pos", "value"])

    return lists.mapInArrow(run, f"`{id_col}` {kind}, pos bigint, value string")
