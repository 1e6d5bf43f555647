from __future__ import annotations

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from casemill.operators.packed import parse_packed, split_packed


def entries(s):
    return [e for e, _ in parse_packed(s)]


def test_delimiters_roles_and_numbers():
    assert entries("A. B. Rao, J.\nDevika Moor") == ["A. B. Rao, J.", "Devika Moor"]
    assert entries("1) Olga Kay\n2) Phil I. Deen") == ["Olga Kay", "Phil I. Deen"]
    assert entries("(1) Olga Kay (2) Phil Deen") == ["Olga Kay", "Phil Deen"]
    assert entries("Rao, Meera N.; K. Sen, Sr. Adv. / Tom Bey") == ["Rao, Meera N.", "K. Sen, Sr. Adv.", "Tom Bey"]
    assert entries("Olga Kay,, Phil Deen;") == ["Olga Kay", "Phil Deen"]


def test_bench_quotes_and_firms():
    assert entries("[Olga Kay and Phil Deen, JJ.]") == ["Olga Kay", "Phil Deen"]
    assert entries("Olga Kay and Phil Deen JJ.") == ["Olga Kay", "Phil Deen"]
    assert entries('"Margaret ""Peggy"" Lee" | Rao and Sen Associates') == ['Margaret "Peggy" Lee', "Rao and Sen Associates"]
    assert entries("Rao & Sen Associates") == ["Rao & Sen Associates"]
    assert entries('Matthew "Matt" Yi') == ['Matthew "Matt" Yi']
    assert entries("Rao, T.S.") == ["Rao, T.S."]


def test_malformed_quote_backtracks():
    assert parse_packed('"Olga Kay; Phil Deen') == [('"Olga Kay', "malformed_quote"), ("Phil Deen", "ok")]
    assert parse_packed("[Olga Kay, Phil Deen") == [("Olga Kay", "unclosed_bracket"), ("Phil Deen", "unclosed_bracket")]


@given(st.text(alphabet='Ab ,;|/&"[]()\n1.）', max_size=60))
@settings(max_examples=300, deadline=None)
def test_never_fails_and_entries_are_in_the_text(s):
    for e, _ in parse_packed(s):
        assert e and e.replace('"', "") in s.replace('"', "")


def test_very_long_list():
    assert len(entries("; ".join(["Olga Kay"] * 20_000))) == 20_000


def test_split_packed_edges(spark):
    rows = [(1, ["A Bee; C Dee", None, ""]), (2, None), (3, []), (4, ["Solo Name"]), (1, ["A Bee; C Dee", None, ""])]
    df = spark.createDataFrame(rows, "record_id bigint, coram array<string>").withColumn("pos", F.lit("clash"))
    got = split_packed(df, "record_id", {"coram": F.col("coram")})
    assert sorted((r.id, r.pos, r.entry, r.is_packed) for r in got.collect()) == [(1, 1, "A Bee", True), (1, 1, "A Bee", True), (1, 2, "C Dee", True), (1, 2, "C Dee", True), (4, 1, "Solo Name", False)]
    assert {r.id for r in split_packed(df, "record_id", {"coram": F.col("coram")}, only_packed=True).collect()} == {1}
    assert split_packed(df.limit(0), "record_id", {"coram": F.col("coram")}).count() == 0


def test_lists_between_typographic_spaces_reach_the_grammar(spark):
    rows = [(1, ["Olga Kay\u00a0and\u2009Phil Deen"]), (2, ["Olga Kay\u00a02)\u00a0Phil Deen"]), (3, ["1.\u00a0Olga Kay"])]
    df = spark.createDataFrame(rows, "id int, coram array<string>")
    got = {(r.id, r.pos, r.entry) for r in split_packed(df, "id", {"coram": F.col("coram")}).collect()}
    assert got == {(i, p, e) for i, (x,) in rows for p, e in enumerate(entries(x), 1)}
    packed = split_packed(df, "id", {"coram": F.col("coram")}, only_packed=True)
    assert {r.id for r in packed.collect()} == {1, 2}
