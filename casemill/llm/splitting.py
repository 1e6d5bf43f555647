"""Split oversized texts at natural boundaries: structure-tree packing.

A text is read as a tree: sections (headings), paragraphs (blank lines or numbered starts), lines that end a sentence, sentences,
clauses, words. Only nodes that are too large by themselves are entered. From the bottom up, neighbouring children of one node are
merged as long as they fit into a piece; a child that had to be entered keeps its pieces to itself, so no piece reaches from inside
a section into the next one. A piece with less new text than the overlap joins a neighbour that has room for it. Every piece after
the first begins with exactly the last ``overlap`` code points of the piece before, and no piece is longer than ``limit``.

Defined results: null gives no piece, an empty text one empty piece; a text without any boundary is cut at the limit; pieces
without their overlaps give the text again; extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Boundaries from the highest to the lowest; each pattern matches the place where a new node starts. A heading is a short line
# of its own: in capitals, or after the end of a sentence, with a capital first, without a stop, before a new beginning.
LEVELS = (
    ("section", re.compile(r"(?<=\n)(?=[A-Z][A-Z .'&-]{3,60}\n)|(?:(?<=[.!?:;\n]\n)|(?<=[.!?:;] \n))(?=[A-Z][A-Za-z'&,/ -]{2,60}\n+[A-Z0-9(\[¶])")),
    ("paragraph", re.compile(r"(?<=\n)(?=(?:\d{1,3}\.|¶ ?\d*|\(\d{1,3}\)|\[\d{1,3}\])\s)|(?<=\n\n)(?=\S)")),
    ("line", re.compile(r"(?<=[.!?:;]\n)(?=\S)")),
    ("sentence", re.compile(r"(?<=[.!?])\s+(?=[A-Z\"“¿¡])")),
    ("clause", re.compile(r"(?<=[,;:])\s+")),
    ("word", re.compile(r"\s+")),
)

Unit = tuple[int, int, str]  # from, to, kind of the boundary at which it starts


def _packed(text: str, node: Unit, level: int, room: int) -> list[Unit]:
    """The units of a node, each within ``room``: children that fit are merged with their neighbours, others are entered."""
    a, b, kind = node
    if b - a <= room:
        return [node]
    if level == len(LEVELS):  # no boundary left: cut at the limit
        return [(x, min(x + room, b), kind if x == a else "none") for x in range(a, b, room)]
    name, pattern = LEVELS[level]
    at = [a, *(m.end() for m in pattern.finditer(text, a, b) if a < m.end() < b), b]
    if len(at) == 2:
        return _packed(text, node, level + 1, room)
    out: list[Unit] = []
    is_open = False
    for x, y in zip(at, at[1:]):
        child = (x, y, kind if x == a else name)
        if y - x > room:
            out += _packed(text, child, level + 1, room)
            is_open = False
        elif is_open and y - out[-1][0] <= room:
            out[-1] = (out[-1][0], y, out[-1][2])
        else:
            out.append(child)
            is_open = True
    return out


def cuts(text: str, limit: int, overlap: int) -> list[tuple[int, str]]:
    """Places where a new piece starts (without its overlap), each with the kind of boundary it falls on."""
    if overlap < 0 or limit <= overlap:
        raise ValueError("the limit must be larger than the overlap")
    if len(text) <= limit:
        return []
    room = limit - overlap  # new text in a piece; only the first can hold more
    out: list[Unit] = []
    for unit in _packed(text, (0, len(text), "text"), 0, room):
        small = out and (min(unit[1] - unit[0], out[-1][1] - out[-1][0]) < overlap or out[-1][1] < overlap)
        if small and unit[1] - out[-1][0] <= (limit if len(out) == 1 else room):
            out[-1] = (out[-1][0], unit[1], out[-1][2])
        else:
            out.append(unit)
    return [(a, kind) for a, _, kind in out[1:]]


def pieces(text: str | None, limit: int, overlap: int) -> list[tuple[int, str, str]]:
    """(offset of the piece's first code point, boundary it starts at, piece)."""
    if text is None:
        return []
    at = [(0, "text"), *cuts(text, limit, overlap)]
    ends = [x for x, _ in at[1:]] + [len(text)]
    return [(max(0, a - overlap) if k else 0, kind, text[max(0, a - overlap) if k else 0 : e]) for k, ((a, kind), e) in enumerate(zip(at, ends))]


def split_texts(df: DataFrame, id_col: str, text_col: str, limit: int, overlap: int) -> DataFrame:
    """(id, piece_no, n_pieces, char_start, boundary, piece). Texts within the limit stay in the JVM."""
    kind = df.schema[id_col].dataType.simpleString()
    lean = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    whole = lean.where(F.length("text") <= limit).select("id", F.lit(1).alias("piece_no"), F.lit(1).alias("n_pieces"), F.lit(0).alias("char_start"), F.lit("text").alias("boundary"), F.col("text").alias("piece"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, k, len(p), s, kind_, t) for i, text in enumerate(b.column(1).to_pylist()) for p in [pieces(text, limit, overlap)] for k, (s, kind_, t) in enumerate(p, 1)]
            c = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(c[0], pa.int64())), *(pa.array(x, pa.int32()) for x in c[1:4]), *(pa.array(x, pa.string()) for x in c[4:])],
                ["id", "piece_no", "n_pieces", "char_start", "boundary", "piece"],
            )

    cut = lean.where(F.length("text") > limit).mapInArrow(run, f"id {kind}, piece_no int, n_pieces int, char_start int, boundary string, piece string")
    return whole.unionByName(cut)
