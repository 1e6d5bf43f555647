"""Repair text that was read from scanned pages: running headers and page numbers, words broken at line ends, misread letters.

Three passes over the segments. The first counts words and neighbouring words, and collects the lines around page numbers with
their digits masked. Spark groups the words by confusable-glyph skeleton and keeps as accepted the forms that are not dwarfed by
another form of their skeleton; masked lines that recur at page breaks of many segments are running headers. The second pass
marks each line of each text with its defects, choosing for a word that is not accepted the frequent form of its skeleton that
its neighbours support. ``repair`` then drops furniture, mends words and reflows lines into paragraphs with SQL windows.

What is sent to the executors is bounded: words and word pairs that make up at least ``SHARE`` of the corpus (at most 1/SHARE of
each), and masked lines that make up at least ``HEADER_SHARE`` of the lines beside page numbers.

Defined results: null and empty texts have no lines to report; a line of white space is blank and has no defect; texts of any
length are read whole; repeated rows repeat with their ids; empty tables give empty results.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARE = 1e-6  # of all words: what counts as frequent
HEADER_SHARE = 1e-3  # of all lines beside page numbers
LONGEST = 30  # letters of a word that is looked up; longer runs are codes
DWARFED = 20  # a form this many times rarer than the first of its skeleton is not accepted

# Glyphs that scanners take for each other, spelled out in common strokes.
_STROKES = {"o": "o", "c": "o", "e": "o", "0": "o", "l": "l", "i": "l", "1": "l", "|": "l", "!": "l", "s": "s", "5": "s", "$": "s", "a": "a", "@": "a", "g": "g", "q": "g", "9": "g", "t": "t", "f": "t", "n": "rl", "u": "ll", "h": "ll", "b": "ll", "d": "ol", "m": "rrl", "w": "vv", "v": "v", "y": "v", "8": "ll", "6": "ll", "z": "z", "2": "z"}
_TABLE = str.maketrans(_STROKES)
_BREAKS = "-­¬‐"
_CORE = re.compile(r"^[^\w@]+|[^\w@]+$")
_ROMAN = r"(?=[ivxlc])(?:x[cl]|l?x{0,3})(?:i[xv]|v?i{0,3})"
_PAGE = re.compile(rf"\s*(?:p[a@]g[eco]\.?\s+\S{{1,5}}(?:\s+[o0c]f\s+\S{{1,5}})?|pg\.?\s*\d+|[-–—]\s*\d+\s*[-–—]|\d+\s*\|\s*p\s?a\s?g\s?[ec]|\[\s+\d+\s+\]|\.\.\.\s?\d+\s?/-|\d{{1,3}}|{_ROMAN})\s*", re.I)
_MIXED = re.compile(r"[^\W\d_][015@]+[^\W\d_]|^[015@][^\W\d_]{2,}$|^[^\W\d_]{3,}[015@]$|@[^\W\d_]|[^\W\d_]@", re.I)
_ORDINAL = re.compile(r"\d+(?:st|nd|rd|th)$", re.I)


@lru_cache(200_000)
def skeleton(word: str) -> str:
    """The strokes of a lower-case word; words that scanners confuse have the same."""
    return word.translate(_TABLE)


def core(token: str) -> str:
    return _CORE.sub("", token)


def masked(line: str) -> str:
    """A line without digits and differences between confusable glyphs."""
    x = re.sub(r"(?<![^\W\d_])\d+(?![^\W\d_])", "#", line.strip().casefold())
    return skeleton(re.sub(r"\s+", " ", re.sub(r"^#|#$", "", x)).strip())


def _caption(header: str | None) -> list[str]:
    """Masked lines of the header that may run through the pages: the caption and the citation."""
    return [m for line in (header or "").split("\n") if len(m := masked(line)) > 4]


def page_lines(lines: list[str]) -> set[int]:
    return {i for i, x in enumerate(lines) if x.strip() and _PAGE.fullmatch(x)}


def _beside(lines: list[str], pages: set[int]) -> list[int]:
    """The first written line after each page number, and the one before it."""
    out = set()
    for i in pages:
        for step in (1, -1):
            j = i + step
            while 0 <= j < len(lines) and not lines[j].strip():
                j += step
            if 0 <= j < len(lines) and j not in pages:
                out.add(j)
    return sorted(out)


def _counting(parts: tuple[str, ...]):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter[str] = Counter()
        pairs: Counter[tuple[str, str]] = Counter()
        lines: Counter[tuple[str, str]] = Counter()

        def flush() -> pa.RecordBatch:
            cores = {t: t if t.isalpha() else core(t) for t in words}
            by_core: Counter[str] = Counter()
            for t, k in words.items():
                by_core[cores[t]] += k
            beside: Counter[tuple[str, str]] = Counter()
            for (x, y), k in pairs.items():
                beside[cores.get(x) or core(x), cores.get(y) or core(y)] += k
            n = [*by_core.values(), *beside.values(), *lines.values()]
            a = [*by_core, *(x for x, _ in beside), *(x for _, x in lines)]
            b = [*[None] * len(by_core), *(y for _, y in beside), *[None] * len(lines)]
            k = [*["word"] * len(by_core), *["pair"] * len(beside), *(k for k, _ in lines)]
            words.clear()
            pairs.clear()
            lines.clear()
            return pa.RecordBatch.from_arrays([pa.array(k, pa.string()), pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(n, pa.int64())], ["kind", "a", "b", "n"])

        for batch in batches:
            for texts in zip(*(batch.column(i).to_pylist() for i in range(1, len(parts) + 1))):
                seen = set()
                for text in texts:
                    if not text:
                        continue
                    split = text.split("\n")
                    pages = page_lines(split)
                    seen.update(("line", masked(split[j])) for j in _beside(split, pages))
                    if first := next((x for x in split if x.strip()), None):
                        seen.add(("first", masked(first)))
                    tokens = text.lower().split()
                    words.update(tokens)
                    pairs.update(zip(tokens, tokens[1:]))
                lines.update(seen)
                if len(pairs) > 400_000:
                    yield flush()
        yield flush()

    return run


class _Known(dict):
    """Tokens in lower case that need no second look, found out once each."""

    def __init__(self, lex: Lexicon) -> None:
        self.lex = lex

    def __missing__(self, token: str) -> bool:
        if len(self) > 500_000:
            self.clear()
        w = core(token)
        self[token] = known = not w or w in self.lex.accepted or not any(map(str.isalpha, w))
        return known


class Lexicon:
    """Accepted words by skeleton, frequent neighbours and running headers, as gathered from the corpus."""

    def __init__(self, words: list[tuple[str, int]], pairs: list[tuple[str, str, int]], headers: list[str]) -> None:
        self.count = dict(words)
        self.pairs = {(a, b): n for a, b, n in pairs}
        self.headers = set(headers)
        groups: dict[str, list[str]] = defaultdict(list)
        for w, _ in sorted(words, key=lambda x: (-x[1], x[0])):
            groups[skeleton(w)].append(w)
        self.known = _Known(self)
        self.accepted: set[str] = set()
        self.forms: dict[str, list[str]] = {}
        for k, ws in groups.items():
            top = self.count[ws[0]]
            real = [w for w in ws if self.count[w] * DWARFED >= top and not _MIXED.search(w)]
            if real:
                self.forms[k] = real
                self.accepted.update(real)

    def better(self, word: str, before: str, after: str) -> str | None:
        """The frequent form that a lower-case word was misread from, if its neighbours support one."""
        if word in self.accepted or not 1 < len(word) <= LONGEST or word.upper() == word or _ORDINAL.fullmatch(word):
            return None  # known, a code, or without letters
        best, most = None, 0
        own = max(self.pairs.get((before, word), 0), self.pairs.get((word, after), 0))
        for form in self.forms.get(skeleton(word), ()):
            n = max(self.pairs.get((before, form), 0), self.pairs.get((form, after), 0))
            if form != word and n > most and n > 3 * own:
                best, most = form, n
        if best is None and len(word) > 4:  # a long word has few doubles; its neighbours may be broken or misread as well
            forms = [f for f in self.forms.get(skeleton(word), ()) if f != word]
            if len(forms) == 1 and self.count.get(word, 0) * DWARFED < self.count[forms[0]]:
                best = forms[0]
        if best is None and _MIXED.search(word):
            return word.translate(str.maketrans("015@", "olsa"))
        return best


def gather(segments: DataFrame, id_col: str, parts: dict[str, Column]) -> tuple[list, list, list]:
    """Frequent words, word pairs and masked lines of the corpus (bounded, see SHARE)."""
    from casemill.session import written

    text = segments.select(F.col(id_col).alias("id"), *[c.alias(k) for k, c in parts.items()])
    counts = text.mapInArrow(_counting(tuple(parts)), "kind string, a string, b string, n bigint").groupBy("kind", "a", "b").agg(F.sum("n").alias("n"))
    counts = written(counts.where("n > 1"), "scan-counts")
    total = {r["kind"]: r["n"] for r in counts.groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    least = max(2, int(SHARE * total.get("word", 0)))
    common = counts.where((F.col("kind").isin("word", "pair") & (F.col("n") >= least)) | (F.col("kind").isin("line", "first") & (F.col("n") >= max(5, int(HEADER_SHARE * total.get("line", 0)))))).collect()
    of = lambda k: [r for r in common if r["kind"] == k]
    headings = {r["a"]: r["n"] for r in of("first")}  # a line that opens more texts than it stands at page breaks is a heading
    headers = [r["a"] for r in of("line") if r["n"] > headings.get(r["a"], 0)]
    return [(r["a"], r["n"]) for r in of("word")], [(r["a"], r["b"], r["n"]) for r in of("pair")], headers


def furniture(lines: list[str], pages: set[int], beside: dict[int, str], captions: list[str], headers: set[str], repeated: Counter[str]) -> set[int]:
    """Numbers of the lines that are page numbers or running headers; ``beside``: the masked lines next to page numbers."""
    found = set(pages)
    for j, m in beside.items():
        if len(m) > 4 and (m in headers or (repeated[m] > 1 and len(m) > 12) or any(c in m and len(m) < 2 * len(c) + 40 for c in captions)) and not re.search(r"[.;,:]$", lines[j].strip()) and not lines[j].strip()[0].islower():
            found.add(j)
    return found


def defects(parts: list[str | None], header: str | None, lex: Lexicon) -> list[tuple[int, int, str, str | None, str | None]]:
    """(part, line, defect, word as read, word meant) of one row's texts; parts and lines count from 0."""
    captions, out = _caption(header), []
    split = [(t or "").split("\n") for t in parts]
    repeated: Counter[str] = Counter()
    pages = [page_lines(lines) for lines in split]
    beside = [{j: masked(lines[j]) for j in _beside(lines, own)} if own else {} for lines, own in zip(split, pages)]
    for of in beside:
        repeated.update(of.values())
    for p, lines in enumerate(split):
        if not parts[p]:
            continue
        gone = furniture(lines, pages[p], beside[p], captions, lex.headers, repeated)
        out += [(p, i, "furniture", None, None) for i in sorted(gone)]
        own = [(i, lines[i].split(), lines[i].lower().split()) for i in range(len(lines)) if i not in gone and lines[i].strip()]
        skip = 0  # the first word of a line may belong to the line before
        for at, (i, read, lower) in enumerate(own):
            last = len(read)
            follows = own[at + 1] if at + 1 < len(own) else None
            t = read[-1]
            if follows and last > skip and len(t) > 1 and t[-1] in _BREAKS and t[-2].isalpha() and follows[1][0][0].isalpha():
                left, right = core(lower[-1]), core(follows[2][0])
                before = core(lower[-2]) if last > 1 else core(own[at - 1][2][-1]) if at else ""
                after = core(follows[2][1]) if len(follows[2]) > 1 else ""
                joined, kept = left + right, f"{left}-{right}"
                meant = None if joined in lex.accepted else lex.better(joined, before, after)
                broken = max(lex.count.get(joined, 0), lex.count.get(meant or "", 0))
                hyphen = lex.count.get(kept, 0)
                if broken or hyphen:
                    mend = broken >= hyphen
                else:  # unknown either way: two words that stand alone are a compound
                    mend = t[-1] != "-" or not (lex.count.get(left, 0) > 20 and lex.count.get(right, 0) > 20)
                if mend:
                    last -= 1
                    out.append((p, i, "hyphen", t + " " + follows[1][0], None))
                    if meant and not meant.endswith(right):
                        out.append((p, follows[0], "misread", follows[1][0], meant))
                    if meant and not meant.startswith(left):
                        out.append((p, i, "misread", t, meant))
            for k in range(skip, last):
                if lex.known[lower[k]]:
                    continue
                w = core(lower[k])
                if core(read[k]).isupper() and not _MIXED.search(w):
                    continue
                before = lower[k - 1] if k else own[at - 1][2][-1] if at else ""
                after = lower[k + 1] if k + 1 < len(lower) else follows[2][0] if follows else ""
                if meant := lex.better(w, core(before), core(after)):
                    out.append((p, i, "misread", read[k], meant))
            skip = int(last < len(read))
    return out


def find_defects(segments: DataFrame, id_col: str, parts: dict[str, Column], header: str) -> DataFrame:
    """(id, part_name, line_no, defect, word, meant): one row for each defect found; ``header`` is the part with the caption."""
    names = tuple(parts)
    lexicon = segments.sparkSession.sparkContext.broadcast(gather(segments, id_col, parts))
    text = segments.select(F.col(id_col).alias("id"), *[c.alias(k) for k, c in parts.items()])
    kind = segments.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = Lexicon(*lexicon.value)
        at = names.index(header)
        for b in batches:
            rows = []
            for n, texts in enumerate(zip(*(b.column(i).to_pylist() for i in range(1, len(names) + 1)))):
                rows += [(n, names[p], i + 1, d, w, m) for p, i, d, w, m in defects(list(texts), texts[at], lex)]
            cols = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int32()), *(pa.array(c, pa.string()) for c in cols[3:])],
                ["id", "part_name", "line_no", "defect", "word", "meant"],
            )

    return text.mapInArrow(run, f"id {kind}, part_name string, line_no int, defect string, word string, meant string")


def repair(segments: DataFrame, id_col: str, parts: dict[str, Column], header: str) -> DataFrame:
    """(id, part_name, par_no, paragraph): continuous readable paragraphs, reflowed with SQL windows over the lines."""
    found = find_defects(segments, id_col, parts, header)
    fixes = found.groupBy("id", "part_name", "line_no").agg(
        F.max((F.col("defect") == "furniture").cast("int")).alias("is_furniture"),
        F.max((F.col("defect") == "hyphen").cast("int")).alias("is_hyphen"),
        F.array_sort(F.collect_set(F.when(F.col("defect") == "misread", F.struct("word", "meant")))).alias("words"),
    )
    lines = segments.select(F.col(id_col).alias("id"), F.explode(F.array(*[F.struct(F.lit(k).alias("part_name"), c.alias("text")) for k, c in parts.items()])).alias("s"))
    lines = lines.where("s.text IS NOT NULL").select("id", "s.part_name", F.posexplode(F.split("s.text", "\n")).alias("pos", "line")).withColumn("line_no", F.col("pos") + 1)
    lines = lines.join(fixes, ["id", "part_name", "line_no"], "left").where("coalesce(is_furniture, 0) = 0")
    mended = F.aggregate(F.coalesce("words", F.array().cast("array<struct<word:string,meant:string>>")), F.col("line"), lambda s, x: F.replace(s, x["word"], x["meant"]))
    lines = lines.withColumn("line", F.btrim(mended))
    w = Window.partitionBy("id", "part_name").orderBy("line_no")
    starts = (F.col("line") == "") | (F.lag("line").over(w) == "") | F.col("line").rlike(r"^(?:\d+\.|¶|\(\d+\)|\[\d+\])\s") | F.lag("line").over(w).isNull()
    lines = lines.withColumn("starts", starts.cast("int")).withColumn("par_no", F.sum("starts").over(w)).where("line <> ''")
    glued = F.when(F.coalesce("is_hyphen", F.lit(0)) == 1, F.regexp_replace("line", f"[{_BREAKS}]\\s*$", "")).when(F.col("line").rlike(r"\p{L}-$"), F.col("line")).otherwise(F.concat("line", F.lit(" ")))  # a hyphen of the word's own stays
    pieces = F.array_sort(F.collect_list(F.struct("line_no", glued.alias("g"))))
    return lines.groupBy("id", "part_name", "par_no").agg(F.btrim(F.array_join(F.transform(pieces, lambda x: x["g"]), "")).alias("paragraph"))


