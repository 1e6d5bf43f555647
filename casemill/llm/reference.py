"""Map freely typed courts and statutes to the entries of a reference list, or report them as unmatched.

Each entry is stored under its own normalised name; further written forms (other word order, short words, initials) are stored as
aliases. BK-trees over the names return every entry within the threshold of a query; two edits count as a match, where a swap of
neighbours is one edit and letters are also compared as they sound. A statute's year has to agree: trees are kept for each year.
A query that fits several entries equally well (the same name with several years and none typed) is unmatched.

Defined results: a null value gives no row, an empty one entry 0; very long values are compared whole; repeated rows repeat.
The reference list is split into shards of ``SHARD`` entries; a list of one shard is sent to the executors as it is, of more
shards each is searched on its own and the nearest entries of the shards are merged.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import product

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemill.llm.bktree import BKTree
from casemill.llm.names import fold, shortens, sound
from casemill.llm.trie import edits

SHARD = 5_000
THRESHOLD = 2  # edits

# Fixed value: a name of the highest court that none of its letters give.
SYNONYMS = {"apex": "supreme"}
_COURT_NOISE = {"the", "honble", "of", "at", "judicature", "judges", "judge", "in", "for", "appellate", "side", "original"}
_KINDS = ("act", "code", "rules", "regulations", "ordinance", "order", "bill", "statute", "constitution")
_SECTION = re.compile(r"^\s*(?:sec(?:tion)?s?|s|ss|art(?:icle)?|rule|r|cl(?:ause)?)\b\.?\s*\d+[a-z]?(?:\s*\([^)]*\))*\s*(?:of|,)\s*", re.I)
_YEAR = re.compile(r"(?:,|\bof\b)?\s*(?:(\b(?:1[6-9]|20)\d\d)|['’](\d\d))\s*\)?\s*$", re.I)


class Words:
    """The words of the reference names, which tell what a short word may stand for."""

    def __init__(self, rows: Iterable[tuple[int, str, str]]) -> None:
        courts: Counter[str] = Counter()
        self.initials: dict[str, set[str]] = defaultdict(set)
        self.statutes: set[str] = set()
        for _, label, name in rows:
            if label == "COURT":
                courts.update(set(_letters(fold(name))))
                kind = [w for w in _letters(fold(name).partition(" of ")[0].partition(",")[0]) if w not in _COURT_NOISE]
                if len(kind) > 1:
                    self.initials["".join(w[0] for w in kind)].add("".join(kind))
                    if kind[-1] == "court" and len(kind) > 2:
                        self.initials["".join(w[0] for w in kind[:-1])].add("".join(kind[:-1]))
            elif label == "STATUTE":
                self.statutes.update(_letters(fold(name)))
        #: words of many courts; places are not shortened, as a short place may be another one
        self.courts = {w for w, n in courts.items() if n > 2 and w not in _COURT_NOISE}
        self.known = set(courts)

    @lru_cache(50_000)  # noqa: B019 - one object lives as long as its worker
    def meant(self, short: str, label: str) -> tuple[str, ...]:
        words = self.courts if label == "COURT" else self.statutes
        found = [w for w in words if shortens(short, w) or (short.endswith("s") and shortens(short[:-1], w))]
        begun = [w for w in found if w.startswith(short)]
        return tuple(sorted(begun or found)) or (short,)


def _letters(f: str) -> list[str]:
    return re.findall(r"[a-z]+", f)


def _spelled(choices: list[tuple[str, ...]]) -> list[str]:
    """All texts that take one of the choices at each place; at most a few words of a name are shortened."""
    return ["".join(x) for x in product(*choices)]


def court_keys(value: str, words: Words | None = None) -> list[str]:
    """A court's words in order without noise; with ``words``, every way of writing its short words out."""
    f = re.sub(r"\(\s*appellate side\s*\)|\(\s*original side\s*\)", " ", fold(value))
    f = re.sub(r"(?<=\b[a-z])\.\s?(?=[a-z]\b)", "", f)  # h.c. -> hc
    out: list[tuple[str, ...]] = []
    for x in _letters(re.sub(r"['’]", "", f)):
        if x in _COURT_NOISE:
            continue
        x = SYNONYMS.get(x, x)
        if words is None or x in words.known:
            out.append((x,))
        else:
            out.append((*sorted(words.initials.get(x, ())), *words.meant(x, "COURT")))
    return _spelled(out)


def court_aliases(name: str) -> list[str]:
    """Other orders of a court's name: the place first, or the kind in another order."""
    f = fold(name)
    kind, _, place = f.partition(" of ") if " of " in f else f.partition(",")
    kind, place = re.sub(r"[^a-z ]", "", kind).split(), re.sub(r"[^a-z]", "", place)
    if not place:
        return []
    k = "".join(kind)
    out = [k + place, place + k, "".join(reversed(kind)) + place]
    if "magistrate" in kind:
        out += [place + "magistratecourt", "magistratecourt" + place, "courtjudicialmagistrate" + place, "judicialmagistrate" + place, "judicialcourt" + place, place + "judicialmagistrate"]
    return out


def statute_keys(value: str, words: Words | None = None) -> tuple[list[str], str]:
    """(letters of the name, year: four digits, two digits or ''); words that end with a point are written out in every way."""
    f = _SECTION.sub("", fold(value).strip())
    f = re.sub(r"^\s*the\s+", "", f)
    year = ""
    if m := _YEAR.search(f):
        year, f = m[1] or m[2], f[: m.start()]
    if m := re.match(r"^\s*([a-z.-]+)\s*\(([a-z .-]+)\)\s*([a-z]+)\s*$", f):
        f = f"{m[2]} {m[1]} {m[3]}"
    found = re.findall(r"[a-z]+\.?", f.replace("co-op", "coop").replace("'", ""))
    if len(found) > 2 and all(len(w.strip(".")) == 1 for w in found[:-1]):
        return ["".join(w.strip(".") for w in found[:-1]) + "|" + found[-1]], year
    return _spelled([(w,) if not w.endswith(".") else words.meant(w[:-1], "STATUTE") if words else (w[:-1],) for w in found]), year


class Matcher:
    """BK-trees over one shard of the reference list."""

    def __init__(self, rows: list[tuple[int, str, str]], words: Words | None = None) -> None:
        self.names: dict[tuple[str, str], dict[str, set[int]]] = defaultdict(lambda: defaultdict(set))  # (label, year) -> key -> entries
        self.exact: dict[tuple[str, str, str], set[int]] = defaultdict(set)
        aliases: dict[str, set[int]] = defaultdict(set)
        self.words = words or Words(rows)
        for entry, label, name in rows:
            if label == "COURT":
                self.names[label, ""][court_keys(name)[0]].add(entry)
                for a in court_aliases(name):
                    aliases[a].add(entry)
                kind = court_keys(name.partition(" of ")[0].partition(",")[0])[0]
                self.exact[label, "", kind].add(entry)
            elif label == "STATUTE":
                (key,), year = statute_keys(name)
                letters = [w[0] for w in fold(name).split() if w[0].isalpha()]
                kind = re.findall(r"[a-z]+", fold(name))[-1]
                for y in {year, year[-2:], ""}:
                    self.names[label, y][key].add(entry)
                    self.exact[label, y, "".join(letters[:-1]) + "|" + kind].add(entry)
                    if y:
                        self.exact[label, y, "".join(letters)].add(entry)
        self.aliases = {"COURT": aliases, "STATUTE": {}}
        self.trees = {k: BKTree(v) for k, v in self.names.items()}
        self.alias_trees = {k: BKTree(v) for k, v in self.aliases.items()}
        self.sounds = {k: {x: sound(x) for x in v} for k, v in self.names.items()}

    def match(self, label: str, value: str) -> tuple[int, int]:
        """(entry, edits); (0, 99) if there is none, (-1, edits) if several fit equally well."""
        return self.ranked(label, value)[:2]

    def ranked(self, label: str, value: str) -> tuple[int, int, int]:
        """As match, with what was met: 0 a name, 1 initials, 2 an alias, 9 nothing. A lower one goes before fewer edits."""
        keys, year = (court_keys(value, self.words), "") if label == "COURT" else statute_keys(value, self.words)
        if not keys[0]:
            return 0, 99, 9

        def nearest(names: dict[str, set[int]], tree: BKTree | None) -> dict[int, int]:
            out: dict[int, int] = {}
            for key in [k for k in keys if k in names] or keys:  # a way of writing that is a name needs no search
                for e, d in self._search(key, names, tree).items():
                    out[e] = min(d, out.get(e, 9))
            return out

        rank, got = 0, nearest(self.names.get((label, year), {}), self.trees.get((label, year)))
        if not got and (hit := set().union(*(self.exact.get((label, year, key), ()) for key in keys))):
            rank, got = 1, {e: 0 for e in hit}
        if not got and label == "COURT":
            rank, got = 2, nearest(self.aliases[label], self.alias_trees[label])
        if not got:
            return 0, 99, 9
        least = min(got.values())
        best = sorted(e for e, d in got.items() if d == least)
        return (best[0] if len(best) == 1 else -1), least, rank

    def _search(self, key: str, names: dict[str, set[int]], tree: BKTree | None) -> dict[int, int]:
        if tree is None:
            return {}
        if key in names:
            return dict.fromkeys(names[key], 0)
        heard, out = sound(key), {}
        # a swap costs two in the metric, a vowel written as it sounds two or three
        for found, _ in tree.within(key, 2 * THRESHOLD + 1):
            d = min(edits(key, found), edits(heard, sound(found)))
            if d <= THRESHOLD:
                for e in names[found]:
                    out[e] = min(d, out.get(e, 9))
        return out


def match_reference(df: DataFrame, id_col: str, fields: dict[str, tuple[str, Column]], reference: DataFrame) -> DataFrame:
    """(id, field_name, pos, entry_id, edits) for each value of the given array columns; entry_id 0 means unmatched.

    ``fields``: field name -> (label in the reference, array of values). ``reference``: (entry_id INT, label, canonical_name).
    """
    rows = df.select(
        F.col(id_col).alias("id"),
        F.explode(F.array(*[F.struct(F.lit(k).alias("field_name"), F.lit(label).alias("label"), c.cast("array<string>").alias("values")) for k, (label, c) in fields.items()])).alias("f"),
    ).select("id", "f.field_name", "f.label", F.posexplode("f.values").alias("pos", "value")).where("value IS NOT NULL")
    rows = rows.select("id", "field_name", (F.col("pos") + 1).cast("int").alias("pos"), "label", "value")
    n = reference.count()
    shards = max(1, -(-n // SHARD))
    ref = reference.where(F.col("label").isin(*{label for label, _ in fields.values()})).select("entry_id", "label", "canonical_name")
    kind = df.schema[id_col].dataType.simpleString()
    part = lambda k: [tuple(r) for r in (ref if shards == 1 else ref.where(F.pmod(F.xxhash64("entry_id"), F.lit(shards)) == k)).collect()]
    words = Words(row for k in range(shards) for row in part(k))  # of all shards, so that short words mean the same in each
    found = None
    for k in range(shards):  # each shard has at most about SHARD rows
        matcher = df.sparkSession.sparkContext.broadcast((part(k), words))
        one = rows.mapInArrow(_matching(matcher), f"id {kind}, field_name string, pos int, entry_id int, edits int, rank int")
        found = one if found is None else found.unionByName(one)
    if shards == 1:
        return found.withColumn("entry_id", F.greatest("entry_id", F.lit(0))).drop("rank")
    best = found.groupBy("id", "field_name", "pos").agg(F.min(F.struct("rank", "edits")).alias("least"), F.collect_set(F.when(F.col("entry_id") != 0, F.struct("rank", "edits", "entry_id"))).alias("all"))
    near = F.filter("all", lambda x: (x["rank"] == F.col("least.rank")) & (x["edits"] == F.col("least.edits")))
    return best.select("id", "field_name", "pos", F.when(F.size(near) == 1, F.greatest(F.element_at(near, 1)["entry_id"], F.lit(0))).otherwise(0).cast("int").alias("entry_id"), "least.edits")


def _matching(rows):  # noqa: ANN001, ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = lru_cache(200_000)(Matcher(*rows.value).ranked)
        for b in batches:
            got = [match(label, v) for label, v in zip(b.column(3).to_pylist(), b.column(4).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), *(pa.array([g[i] for g in got], pa.int32()) for i in range(3))],
                ["id", "field_name", "pos", "entry_id", "edits", "rank"],
            )

    return run
