from __future__ import annotations

from casemill.plans import cleaning


def test_columns_and_distinct_rows(spark, sf):
    want = {"p2_found": "record_id bigint, field_name string, pos int, normal_form string", "p7_found": "record_id bigint, field_name string, pos int, entry string"}
    for name, columns in want.items():
        df = cleaning.QUERIES[name](spark, sf)
        assert ", ".join(f"{c} {t}" for c, t in df.dtypes) == columns
        rows = df.collect()
        assert rows and len(set(rows)) == len(rows)


def test_every_registry_has_its_declared_zone(spark, sf):
    assert all(r.is_declared for r in cleaning.p2_zones(spark, sf).collect())


def test_llm_is_optional():
    import subprocess
    import sys
    from pathlib import Path

    code = "import sys; sys.modules['casemill.llm'] = None; sys.modules['casemill.llm.queries'] = None; import __spark_entry__ as e; print(len(e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parent.parent, capture_output=True, text=True)
    assert out.returncode == 0 and int(out.stdout.split()[-1]) > 60
    for p in (Path(__file__).parent.parent / "casemill").rglob("*.py"):
        if "llm" not in p.parts:
            assert "casemill.llm" not in p.read_text()
