from __future__ import annotations

import unicodedata
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from casemill.llm import canonical, reference, scans, splitting


def plain(spark, texts):
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "id int, s string, n string")
    return [r.s_plain for r in canonical.canonicalize(df, ["s"]).orderBy("id").collect()]


def test_canonical(spark):
    assert plain(spark, ["Ｊａｃｋ　Rао​", "Tèst", "ﬁkez", "A  B ", "", None, "⁠", "éа́"]) == ["Jack Rao", "Tèst", "fikez", "A  B", "", None, "", "éá"]
    long = "Ａ " * 100_000
    assert plain(spark, [long]) == [("A " * 100_000).rstrip()]
    with pytest.raises(ValueError, match="exist"):
        canonical.canonicalize(spark.createDataFrame([("a", "b")], "s string, s_plain string"), ["s"])


def test_canonical_is_idempotent(spark):
    texts = ["".join(chr(c) for c in range(a, a + 200) if unicodedata.category(chr(c)) not in ("Cs", "Cc")) for a in (0x20, 0x370, 0x400, 0x2000, 0xFF00)]
    once = plain(spark, texts)
    assert plain(spark, once) == once


def test_pairs(spark):
    rows = [(1, "m", "A v. B", ["X"]), (2, "m", "Ａ v. B", ["X"]), (3, "m", "a v. B", ["Х", "Y"]), (4, "k", "Ａ v. B", None), (5, "m", None, ["X", "Y"]), (6, None, "A v. B", ["X"]), (7, "m", "A v. B", ["XY"])]
    df = spark.createDataFrame(rows, "record_id int, matter string, case_name string, coram array<string>")
    got = canonical.same_looking_pairs(df, "record_id", "matter", {"case_name": F.col("case_name"), "coram": canonical.joined(F.col("coram"))})
    assert sorted(tuple(r) for r in got.collect()) == [("case_name", 1, 2), ("case_name", 2, 7), ("coram", 3, 5)]
    assert canonical.same_looking_pairs(df.limit(0), "record_id", "matter", {"case_name": F.col("case_name")}).count() == 0


REFERENCE = [(1, "COURT", "High Court of Exby"), (2, "COURT", "District Court of Exby"), (3, "COURT", "Supreme Court of Astra"), (4, "STATUTE", "Forest Welfare Act, 1961"), (5, "STATUTE", "Harbour Securities Act, 1924"), (6, "STATUTE", "Harbour Securities Act, 1949"), (7, "COURT", "Judicial Magistrate Court, Exby"), (8, "GPE", "Exby")]
TYPED = {
    ("COURT", "H.C. Exby"): 1, ("COURT", "Exby Hgih Court (Appellate Side)"): 1, ("COURT", "District Judge's Court at Exby"): 2, ("COURT", "The Hon'ble Supreme Court"): 3, ("COURT", "J.M.C. Exby"): 7, ("COURT", "High Court of Wyeby"): 0, ("COURT", "n/a"): 0, ("COURT", ""): 0,
    ("STATUTE", "Sec. 5 of the Forest Welfare Act, 1961"): 4, ("STATUTE", "Forset Welfare Act,1961"): 4, ("STATUTE", "Welfare (Forest) Act of 1961"): 4, ("STATUTE", "Forest Welfare Act"): 4, ("STATUTE", "FWA 1961"): 4, ("STATUTE", "F.W. Act, 1961"): 4, ("STATUTE", "Forest Welfare Act '61"): 4,
    ("STATUTE", "Forest Welfare Act, 1962"): 0, ("STATUTE", "Harbour Secs. Act, 1949"): 6, ("STATUTE", "Harbour Securities Act"): 0, ("STATUTE", "HarbourSecurities Act 1924"): 5, ("STATUTE", "ibid"): 0, ("STATUTE", "x" * 5_000): 0,
}


@pytest.mark.parametrize("shard", [5_000, 3])
def test_reference(spark, monkeypatch, shard):
    monkeypatch.setattr(reference, "SHARD", shard)
    ref = spark.createDataFrame(REFERENCE, "entry_id int, label string, canonical_name string")
    rows = [(i, v if k == "COURT" else None, [v, None] if k == "STATUTE" else None) for i, (k, v) in enumerate(TYPED)]
    df = spark.createDataFrame(rows, "id int, court string, statutes array<string>")
    got = {(r.id, r.field_name, r.pos): r.entry_id for r in reference.match_reference(df, "id", {"court": ("COURT", F.array("court")), "statutes": ("STATUTE", F.col("statutes"))}, ref).collect()}
    want = {(i, "court" if k == "COURT" else "statutes", 1): e for i, ((k, _), e) in enumerate(TYPED.items())}
    if shard == 3:  # names that differ only in the year may lie in different shards, where each is the only one
        got = {k: v for k, v in got.items() if rows[k[0]][2] != ["Harbour Securities Act", None]}
        want = {k: v for k, v in want.items() if rows[k[0]][2] != ["Harbour Securities Act", None]}
    assert got == want


def test_a_name_goes_before_an_alias_of_another_shard(spark, monkeypatch):
    shard = F.pmod(F.xxhash64(F.col("id").cast("int")), F.lit(2))
    far = {r.shard: r.id for r in spark.range(1, 20).select("id", shard.alias("shard")).collect()}  # an entry number of each shard
    ref = spark.createDataFrame([(far[0], "COURT", "Exby High Court"), (far[1], "COURT", "High Court of Exbyy")], "entry_id int, label string, canonical_name string")
    df = spark.createDataFrame([(7, "Exbyy High Court")], "id int, court string")
    for size in (5_000, 1):  # a name with one edit, an alias with none
        monkeypatch.setattr(reference, "SHARD", size)
        got = reference.match_reference(df, "id", {"court": ("COURT", F.array("court"))}, ref).collect()
        assert [(r.entry_id, r.edits) for r in got] == [(far[0], 1)], size


def test_long_headings_are_counted_whole(spark):
    counted = scans._counting(("body",))
    heading = "In the matter of " + "many words " * 30
    import pyarrow as pa

    out = [r for b in counted(iter([pa.RecordBatch.from_arrays([pa.array([1]), pa.array([heading + "\ntext"])], names=["id", "body"])])) for r in b.to_pylist()]
    assert [r["a"] for r in out if r["kind"] == "first"] == [scans.masked(heading)]


def test_short_words_mean_what_the_list_says():
    rows = [(1, "COURT", "District Court of Exby"), (2, "COURT", "District Court of Wyeby"), (3, "COURT", "District Court of Zedby"), (4, "COURT", "Judicial Magistrate Court, Exby"), (5, "STATUTE", "Settlement of Securities Act, 1950"), (6, "STATUTE", "Settled Estates Act, 1950")]
    m = reference.Matcher(rows)
    assert [m.match("COURT", v)[0] for v in ("Distt. Ct. of Exby", "Dist Crt, Wyeby", "DC Zedby", "JM Court, Exby", "JMC Exby", "District Court of Exb Town")] == [1, 2, 3, 4, 4, 0]
    assert [m.match("STATUTE", v)[0] for v in ("Settlmt. of Secs. Act, 1950", "Sett. Estates Act", "Settl. of Secs. Act, 1951", "")] == [5, 6, 0, 0]
    assert reference.shortens("distt", "district") and not reference.shortens("x", "xy") and not reference.shortens("court", "court")


texts = st.text(alphabet="Ab.\n, ¶1", max_size=400)


@given(texts, st.integers(20, 60), st.integers(0, 15))
@settings(max_examples=300, deadline=None)
def test_pieces_give_the_text_back(t, limit, overlap):
    p = splitting.pieces(t, limit, overlap)
    assert all(len(x) <= limit for _, _, x in p)
    assert all(t[s : s + len(x)] == x for s, _, x in p)
    assert all(b[2][:overlap] == a[2][-overlap:] if overlap else True for a, b in zip(p, p[1:]))
    assert p[0][2] + "".join(x[overlap:] for _, _, x in p[1:]) == t


def test_cuts_fall_on_paragraphs():
    t = "".join(f"{i}. " + "word " * 15 + "end.\n" for i in range(1, 9))
    assert {k for _, k in splitting.cuts(t, 250, 20)} == {"paragraph"}


def test_no_piece_reaches_from_a_section_into_the_next():
    sentence = "The court considered the matter at length and found for the party. "
    parts = ["Facts\n" + sentence * 20 + "\n", "Held\n" + sentence * 5 + "\n", "ORDER\n" + sentence * 9 + "\n", "Costs\n" + sentence * 2 + "\n"]
    text = "".join(parts)
    borders = [sum(map(len, parts[:k])) for k in range(1, 4)]
    starts = [0, *(a for a, _ in splitting.cuts(text, 1_000, 60)), len(text)]
    # the second section fits by itself, so the rest of the first isn't packed with it; neighbours that fit together are one piece
    assert borders[0] in starts and borders[1] in starts
    for a, b in zip(starts, starts[1:]):
        inside = [x for x in borders if a < x < b]
        assert b - a <= 940 and all(a in [0, *borders] for _ in inside)


def test_split_edges(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "x" * 100_000), (4, "short"), (4, "short")], "id int, text string").withColumn("piece", F.lit("clash"))
    got = Counter(r.id for r in splitting.split_texts(df, "id", "text", 4000, 200).collect())
    assert (got[1], got[2], got[4]) == (0, 1, 2) and got[3] == 27
    assert splitting.split_texts(df.limit(0), "id", "text", 4000, 200).count() == 0


MISREAD = ["acceptcd", "accepfed", "acccpted", "aeccpted", "accepteol", "aoccpted"]


def noisy(spark, extra=()):
    clean = "The registrar accepted the survey before the court because the tenant denied the claim for non-payment. " * 3
    page = "The registrar {w} the survey bef-\n{f}\nASTRAVIA REPORTS\nore the c0urt because the tenant denied the claim for non-\npayment."
    rows = [(i, "A v. B", clean, None) for i in range(60)] + [(100 + i, "A v. B", page.format(f=f"- {i} -", w=MISREAD[i % 6]), "ORDER\ncosts.") for i in range(30)] + list(extra)
    return spark.createDataFrame(rows, "segment_id int, header string, body string, order_text string")


def test_scan_defects(spark):
    df = noisy(spark, [(900, None, None, None), (901, "", "", ""), (902, "xyz", "word " * 50_000, None)])
    parts = {k: F.col(k) for k in ("header", "body", "order_text")}
    got = {(r.id, r.part_name, r.line_no, r.defect) for r in scans.find_defects(df, "segment_id", parts, "header").collect()}
    assert {g for g in got if g[0] < 100 or g[0] >= 900} == set()
    for i in range(100, 130):
        assert {g[1:] for g in got if g[0] == i} == {("body", 1, "misread"), ("body", 1, "hyphen"), ("body", 2, "furniture"), ("body", 3, "furniture"), ("body", 4, "misread")}


def test_scan_repair(spark):
    parts = {k: F.col(k) for k in ("header", "body", "order_text")}
    got = scans.repair(noisy(spark), "segment_id", parts, "header").where("id = 100 AND part_name = 'body'").collect()
    assert [r.paragraph for r in got] == ["The registrar accepted the survey before the court because the tenant denied the claim for non-payment."]


def test_scan_empty(spark):
    parts = {k: F.col(k) for k in ("header", "body", "order_text")}
    assert scans.find_defects(noisy(spark).limit(0), "segment_id", parts, "header").count() == 0
