"""Regex table-valued functions: every match of a list of rules as rows, in emission order; and spans of token predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casemill.functions import rules
from casemill.functions.rules import Rule


def matches(text: Column, found: Sequence[Rule]) -> Column:
    """Array of (label, rule_no, match_no, value) over all rules; values are trimmed. Null text gives an empty array."""
    each = [_one(text, r, k) for k, r in enumerate(found, 1)]
    return F.flatten(F.array(*each))


def _one(text: Column, rule: Rule, no: int) -> Column:
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rule.pattern), F.lit(rule.group))
    return F.transform(found, lambda v, i: F.struct(F.lit(rule.label).alias("label"), F.lit(no).cast("bigint").alias("rule_no"), (i + 1).cast("bigint").alias("match_no"), F.regexp_replace(v, r"^\s+|\s+$", "").alias("value")))


def find(df: DataFrame, id_col: str, text: str, found: Sequence[Rule]) -> DataFrame:
    """(id_col, label, rule_no, match_no, value), one row for each match."""
    return df.select(id_col, F.explode(matches(F.col(text), found)).alias("m")).select(id_col, "m.*")


def place_values(text: Column, names: Sequence[str], anywhere: bool) -> Column:
    """Array of (pos, value): which of ``names`` occur; ``anywhere``: as a substring in any case, else as a word as written."""
    t = F.coalesce(text, F.lit(""))
    test = (lambda p: F.lower(t).contains(p.lower())) if anywhere else (lambda p: t.rlike(rf"\b{p}\b"))
    return F.array_compact(F.array(*[F.when(test(p), F.struct(F.lit(i).cast("bigint").alias("pos"), F.lit(p).alias("value"))) for i, p in enumerate(names, 1)]))


def places(df: DataFrame, id_col: str, text: str, names: Sequence[str], anywhere: bool) -> DataFrame:
    """(id_col, pos, value) of ``place_values``."""
    return df.select(id_col, F.explode(place_values(F.col(text), names, anywhere)).alias("h")).select(id_col, "h.*")


def named_values(text: Column) -> Column:
    """Array of the names of two words or more on lines for a petitioner or respondent."""
    blocks = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?i)(?:For\s+(?:Petitioner|Respondent)[^:]*:\s*)([^\n]+)"), F.lit(1))
    names = F.flatten(F.transform(blocks, lambda b: F.regexp_extract_all(b, F.lit(r"[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+|[A-Z]\.\s?[A-Z][a-z]+"), F.lit(0))))
    return F.filter(names, lambda v: (F.size(F.split(v, r"\s+")) >= 2) & (F.lower(v) != "information technology"))


def kept_a(m: Column) -> Column:
    """Does a match of the classifier's rules count? Statutes have more than two words and fewer than 100 characters."""
    v = m["value"]
    return (m["label"] != "STATUTE") | ((F.size(F.split(v, r"\s+")) > 2) & (F.length(v) < 100) & (F.lower(v) != "supreme court reports"))


def kept_b(m: Column) -> Column:
    """Does a match of the second producer count? Lawyers are no public bodies."""
    return (m["label"] != "LAWYER") | ~m["value"].rlike(rules.NOT_A_NAMED_LAWYER)


def bench_names(text: Column) -> Column:
    """Judges in the first bracket of the first 1,200 characters; else on Coram lines."""
    head = F.substring(F.coalesce(text, F.lit("")), 1, 1200)
    block = F.nullif(F.regexp_extract(head, r"\[([^\]]{2,400})\]", 1), F.lit(""))
    line = F.regexp_extract_all(head, F.lit(r"(?im)^\s*Coram[:\s\-]?\s*(.+)$"), F.lit(1))
    names = lambda b: F.transform(F.split(F.regexp_replace(b, r"(?i)\bJJ?\.?(?=$|\W)", ""), r",|\band\b|&"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    keep = F.filter(names(block), lambda x: (x != "") & ~((F.size(F.split(x, r"\s+")) == 1) & ~x.rlike(r"\b[A-Z][a-z]+")))
    lines = F.filter(F.flatten(F.transform(line, names)), lambda x: x != "")
    return F.when(block.isNotNull(), keep).otherwise(lines)


def anchored_lawyers(text: Column, limit: int = 800) -> Column:
    """Names on the rest of the line after each anchor: with an honorific, or two capitalised words; no public bodies."""
    t = F.coalesce(text, F.lit(""))
    out = []
    for a in rules.LAWYER_ANCHORS:
        block = F.substring(F.regexp_extract(t, rf"(?i)\Q{a}\E\s*[:\-]?\s*(.+)", 1), 1, limit)
        parts = F.transform(F.split(block, r",\s*|\s+and\s+|;|\n"), lambda x: F.regexp_replace(x, r"^[\s.]+|[\s.]+$", ""))
        named = F.filter(parts, lambda x: x.rlike(r"^(?i:Mr|Ms|Mrs|Shri|Smt|Dr|Adv)\.?") | x.rlike(r"^[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+"))
        bare = F.transform(named, lambda x: F.btrim(F.regexp_replace(x, r"(?i)\b(?:Sr\.?\s*Advocate|Sr\.?\s*Adv|Sr Advs|Adv\.?)(?=$|\W)", "")))
        out.append(F.filter(bare, lambda x: (x != "") & ~x.rlike(r"(?i)\b(?:State of|Union of|Government)\b")))
    return F.flatten(F.array(*out))


def party_values(text: Column, found: Sequence[Rule], classifier: bool) -> Column:
    """Array of (label, rule_no, match_no, pos, value): the parties named on labelled lines.

    The classifier's rules split at commas, and, &, and drop role words; the others split at semicolons too and drop banners.
    """
    cut = r",\s*|\s+and\s+|\s*&\s*" + ("" if classifier else "|;")

    def clean(x: Column) -> Column:
        x = F.regexp_replace(x, r"^\s+|\s+$", "")
        x = F.regexp_replace(x, r"^[:\-;.,]+|[:\-;.,]+$", "") if classifier else F.regexp_replace(x, r"^[\s:\-.,]+|[\s:\-.,]+$", "")
        return F.regexp_replace(F.regexp_replace(x, rules.ROLE_WORDS, ""), r"^\s+|\s+$", "") if classifier else x

    def kept(v: Column) -> Column:
        long = F.length(v) >= 3
        return long if classifier else long & ~(v.rlike(r"^[A-Z\s]{3,200}$") & (F.size(F.split(v, r"\s+")) > 2))

    lines = F.transform(matches(text, found), lambda m: F.transform(F.split(m["value"], cut), lambda x, i: F.struct(m["label"].alias("label"), m["rule_no"].alias("rule_no"), m["match_no"].alias("match_no"), (i + 1).cast("bigint").alias("pos"), clean(x).alias("value"))))
    return F.filter(F.flatten(lines), lambda r: kept(r["value"]))


def party_lines(df: DataFrame, id_col: str, text: str, found: Sequence[Rule]) -> DataFrame:
    """(id_col, label, rule_no, match_no, pos, value) of ``party_values``."""
    return df.select(id_col, F.explode(party_values(F.col(text), found, found is rules.PARTY_LINES_A)).alias("p")).select(id_col, "p.*")


def precedents(text: Column) -> Column:
    """'L v. R (yyyy)' for each validated pair of sides: each side has two words or more."""
    t = F.coalesce(text, F.lit(""))
    take = lambda g: F.regexp_extract_all(t, F.lit(rules.PRECEDENT_SIDES_B), F.lit(g))
    zipped = F.arrays_zip(take(1).alias("l"), take(2).alias("r"), take(3).alias("y"))
    trim = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    two = lambda c: F.size(F.split(trim(c), r"\s+")) >= 2
    kept = F.filter(zipped, lambda z: two(z["l"]) & two(z["r"]))
    return F.transform(kept, lambda z: F.concat(trim(z["l"]), F.lit(" v. "), trim(z["r"]), F.when(z["y"] != "", F.concat(F.lit(" ("), z["y"], F.lit(")"))).otherwise(F.lit(""))))


def footnotes(text: Column, limit: int = 500) -> Column:
    """Array of (number, content): text after superscript figures; the number is the match's ordinal, short notes are skipped."""
    parts = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?s)[¹²³⁴⁵⁶⁷⁸⁹⁰]+\s*(.+?)(?=[¹²³⁴⁵⁶⁷⁸⁹⁰]|\n\n|\z)"), F.lit(1))
    rows = F.transform(parts, lambda v, i: F.struct((i + 1).cast("string").alias("number"), F.substring(F.regexp_replace(v, r"^\s+|\s+$", ""), 1, limit).alias("content")))
    return F.filter(rows, lambda r: F.length(r["content"]) > 10)


def token_spans(tokens: DataFrame, texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Merge consecutive predictions of one class into spans: (keys, island, label, value).

    ``tokens``: keys, seq, entity, start, end (0-based, half open). A prediction of class O, or of another class, ends a span;
    values of one character are dropped. The text joins after the spans are formed, so only spans carry it.
    """
    w = Window.partitionBy(*keys).orderBy("seq")
    t = tokens.withColumn("label", F.regexp_extract("entity", r"([^-]*)$", 1))
    t = t.withColumn("island", F.sum(F.when(F.col("label").eqNullSafe(F.lag("label").over(w)), 0).otherwise(1)).over(w)).where("label <> 'O'")
    spans = t.groupBy(*keys, "island", "label").agg(F.min_by("start", "seq").alias("start"), F.max_by("end", "seq").alias("end"))
    value = F.regexp_replace(F.regexp_replace(F.expr(f"substring({text}, start + 1, end - start)"), r"\s+", " "), r"^[ ,.;:]+|[ ,.;:]+$", "")
    return spans.join(texts, keys).withColumn("value", value).where("length(value) > 1").select(*keys, "island", "label", "value")


def named_on_lines(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id_col, match_no, pos, value): names of two words or more on lines for a petitioner or respondent."""
    blocks = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"(?i)(?:For\s+(?:Petitioner|Respondent)[^:]*:\s*)([^\n]+)"), F.lit(1))
    names = F.regexp_extract_all("block", F.lit(r"[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+|[A-Z]\.\s?[A-Z][a-z]+"), F.lit(0))
    rows = df.select(id_col, F.posexplode(blocks).alias("m", "block")).select(id_col, "m", F.posexplode(names).alias("p", "value"))
    rows = rows.where((F.size(F.split("value", r"\s+")) >= 2) & (F.lower("value") != "information technology"))
    return rows.select(id_col, (F.col("m") + 1).cast("bigint").alias("match_no"), (F.col("p") + 1).cast("bigint").alias("pos"), "value")


def distinct_values(df: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct trimmed values of each key with their place in code-point order: (keys, pos, value)."""
    v = F.regexp_replace(F.regexp_replace("value", r"\s+", " "), r"^[ ,.;:]+|[ ,.;:]+$", "")
    d = df.select(*keys, v.alias("value")).where("value <> ''").distinct()
    return d.select(*keys, F.row_number().over(Window.partitionBy(*keys).orderBy("value")).cast("bigint").alias("pos"), "value")


def first_values(df: DataFrame, id_col: str) -> DataFrame:
    """(id_col, pos, label, value): matches in emission order, later ones that differ in case only left out."""
    order = F.struct("rule_no", "match_no")
    first = df.groupBy(id_col, "label", F.lower("value").alias("lower")).agg(F.min_by(F.struct("rule_no", "match_no", "value"), order).alias("f"))
    w = Window.partitionBy(id_col).orderBy("f.rule_no", "f.match_no", "label")
    return first.select(id_col, F.row_number().over(w).cast("bigint").alias("pos"), "label", "f.value")
