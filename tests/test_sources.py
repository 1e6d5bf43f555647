from __future__ import annotations

from casemill.operators.finding import find
from casemill.functions import rules
from casemill.sources import files
from casemill.streaming.documents import run_batches, stream_parquet


def test_binary_pages_and_errors(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"Page 1 of 2\nfirst\x0csecond")
    (tmp_path / "b.pdf").write_bytes(b"broken")
    (tmp_path / "c.PDF").write_bytes(b"other case")

    def reader(content: bytes) -> list[str]:
        if content == b"broken":
            raise ValueError("no pages")
        return content.decode().split("\x0c")

    pages = files.pdf_pages(files.read_binary(spark, str(tmp_path)), reader=reader)
    assert sorted((files.base_name(r.path), r.page_no, r.error) for r in pages.collect()) == [("a.pdf", 1, None), ("a.pdf", 2, None), ("b.pdf", 0, "ValueError: no pages")]
    docs = files.documents_of_pages(pages.where("error IS NULL"), "path").collect()
    assert [r.text for r in docs] == ["first\nsecond"]


def test_gazetteer_and_records(spark, tmp_path):
    assert files.read_gazetteer(spark, str(tmp_path / "none.jsonl")).count() == 0
    (tmp_path / "g.jsonl").write_text('{"label": "COURT", "pattern": "High Court"}\n')
    assert files.read_gazetteer(spark, str(tmp_path / "g.jsonl")).collect()[0].pattern == "High Court"
    df = spark.createDataFrame([(1, '{"case_name": "A v. B", "coram": ["X"]}'), (2, "not json")], "id int, j string")
    got = {r.id: (r.case_name, r.coram, r.content_info) for r in files.parse_records(df, "j").collect()}
    assert got == {1: ("A v. B", ["X"], None), 2: (None, None, None)}


def test_classifier_windows(spark):
    df = spark.createDataFrame([(1, "abcdef"), (2, None)], "id int, t string")
    got = files.predict_tokens(df, "id", "body", "t", lambda: lambda s: [{"entity": "DATE", "start": 0, "end": len(s)}], window=4)
    assert [(r.seq, r.start, r.end) for r in got.orderBy("seq").collect()] == [(0, 0, 4), (1, 4, 6)]


def test_stream_writes_each_batch_once(spark, sf, tmp_path):
    src = tmp_path / "in"
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    d.repartition(3).write.parquet(str(src))
    stream = stream_parquet(spark, str(src), files.DOCUMENTS, files_per_batch=1)
    for _ in range(2):  # the second run finds nothing new
        run_batches(stream, lambda b: find(b, "doc_id", "text", rules.PROVISIONS_B), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == find(d, "doc_id", "text", rules.PROVISIONS_B).count()
