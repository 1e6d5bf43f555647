"""Sources and sinks. Schemas are explicit; nothing is inferred from the data."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from pathlib import PurePosixPath

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casemill.functions import text

_STRINGS = T.ArrayType(T.StringType())
ADVOCATES = T.StructType([T.StructField("for_appellants", _STRINGS), T.StructField("for_respondent", _STRINGS)])
ORDER = T.StructType([T.StructField("result", T.StringType()), T.StructField("decision", T.StringType()), T.StructField("directions", _STRINGS)])
CONTENT = T.StructType([T.StructField("background_facts", _STRINGS), T.StructField("order_summary", ORDER)])
RECORD = T.StructType(
    [
        *(T.StructField(f, T.StringType()) for f in ("case_name", "appeal_number", "court", "date_of_judgment")),
        *(T.StructField(f, _STRINGS) for f in ("coram", "appellants")),
        T.StructField("respondent", T.StringType()),
        T.StructField("advocates", ADVOCATES),
        *(T.StructField(f, _STRINGS) for f in ("precedents", "provisions", "statutes", "lower_courts", "other_dates")),
        T.StructField("content_info", CONTENT),
    ]
)
DOCUMENTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
GAZETTEER = T.StructType([T.StructField("label", T.StringType()), T.StructField("pattern", T.StringType())])


def read_binary(spark: SparkSession, path: str, suffix: str = "pdf") -> DataFrame:
    """(path, modificationTime, length, content) of the files with the suffix, in exactly that case."""
    return spark.read.format("binaryFile").option("pathGlobFilter", f"*.{suffix}").option("recursiveFileLookup", "true").load(path)


def pdf_pages(files: DataFrame, max_pages: int | None = None, reader: Callable[[bytes], list[str]] | None = None) -> DataFrame:
    """(path, page_no, raw, error): one row for each page. ``reader`` gives the pages of a file; without one a PDF library is needed.

    A file that can't be read gives one row with its error; the job goes on.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = reader or _pdf_reader()
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"]):
                try:
                    rows += [(path, n, page, None) for n, page in enumerate(read(bytes(content))[:max_pages], 1)]
                except Exception as e:  # noqa: BLE001
                    rows.append((path, 0, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "page_no", "raw", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, page_no int, raw string, error string")


def _pdf_reader() -> Callable[[bytes], list[str]]:
    try:
        import pypdf
    except ImportError as e:
        raise RuntimeError("reading PDF files needs the optional library pypdf; pass reader=, or read text tables") from e
    import io

    return lambda content: [p.extract_text() or "" for p in pypdf.PdfReader(io.BytesIO(content)).pages]


def documents_of_pages(pages: DataFrame, key: str, page_no: str = "page_no", raw: str = "raw") -> DataFrame:
    """(key, text): pages cleaned one by one, empty ones dropped, joined by line feeds in order."""
    cleaned = pages.select(key, page_no, text.preclean(F.col(raw)).alias("c"))
    parts = F.array_sort(F.collect_list(F.when(F.col("c") != "", F.struct(page_no, "c"))))
    return cleaned.groupBy(key).agg(F.array_join(F.transform(parts, lambda x: x["c"]), "\n").alias("text"))


def read_gazetteer(spark: SparkSession, path: str) -> DataFrame:
    """(label, pattern) from JSON lines; a missing file is an empty table."""
    try:
        return spark.read.schema(GAZETTEER).json(path)
    except AnalysisException:
        return spark.createDataFrame([], GAZETTEER)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RECORD).json(path)


def parse_records(df: DataFrame, column: str) -> DataFrame:
    """Add the fields of a record held as JSON text; text that isn't JSON gives nulls."""
    return df.withColumn("_r", F.from_json(column, RECORD)).select(*df.columns, "_r.*")


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "errorifexists") -> None:
    w = df.write.mode(mode)
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines; null fields are left out."""
    df.write.mode(mode).option("ignoreNullFields", "true").json(path)


def predict_tokens(df: DataFrame, id_col: str, segment: str, text_col: str, load: Callable[[], Callable[[str], list[dict]]], window: int = 2_000) -> DataFrame:
    """(id, segment, seq, entity, start, end): predictions of a token classifier that ``load`` makes once for each worker.

    Texts longer than ``window`` characters are classified in windows; offsets are those of the whole text.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for b in batches:
            rows = []
            for i, t in zip(b.iloc[:, 0], b.iloc[:, 1]):
                seq = 0
                for at in range(0, len(t or ""), window):
                    for p in model(t[at : at + window]):
                        rows.append((i, segment, seq, p.get("entity", "O"), p["start"] + at, p["end"] + at))
                        seq += 1
            yield pd.DataFrame(rows, columns=["id", "segment", "seq", "entity", "start", "end"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInPandas(run, f"id {kind}, segment string, seq int, entity string, start int, end int")


def base_name(path: str) -> str:
    return PurePosixPath(path).name
