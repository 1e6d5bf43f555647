"""Link the spellings of one person or organisation.

Every distinct spelling is read once. Where either word may be the surname, the order is taken whose words stand oftener in these
roles in spellings that leave no choice. Spellings of one reading form a class. The distinct cores of all classes (initial and
surname, or an organisation's name without its legal form) are joined with one another by tries: they are sharded by the letters of
the name (``trie.shards``), every core walks its shards' tries with the edit automaton, and all neighbours within two edits come
out, wherever they occur. Orders, given names, initials, middle names and legal forms decide which neighbours fit.

What links: classes of one core that allow one person only (``core_links``); neighbours that fit and stand together in a matter and
field; what is ambiguous by itself (initials that fit several persons, a short given name of several names, a bare surname, a firm
without its legal form), spelling by spelling, with the person it stands together with most often; and neighbours that never stand
together if they differ by a slip of the hand only (``slip``) and no second entity is as near (``_wide_links``). Components are
found in the cluster.

All joins are between distinct spellings, classes and cores. A shard with more than ``HOT`` names is cut further by what the other
ends of its names have in common, which loses no pair.

Defined results: null and blank names are ignored; a name without letters links to nothing; repeated rows change nothing.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from casemill.llm import names, trie
from casemill.llm.canonical import plain_forms
from casemill.llm.graph import components
from casemill.llm.names import Name, sound
from casemill.llm.trie import edits
from casemill.operators.packed import parse_packed
from casemill.session import written

HOT = 50_000  # names that a shard may hold before it is cut further
SMALL = 20_000  # rows of numbers that a broadcast may have; larger tables are joined by exchanges
_BATCH = 30_000  # rows whose tries are walked at once


def _given_edits(a: Name, b: Name, most: int) -> int | None:
    """Edits between given names, 0 if one is an initial that fits, None if they differ."""
    if a.given and b.given:
        if a.given == b.given:
            return 0
        if min(len(a.given), len(b.given)) < 4:
            return None
        d = min(edits(a.given, b.given), edits(sound(a.given), sound(b.given)))
        return d if d <= most else None
    return 0 if a.initial == b.initial else None


def _middle_fits(a: Name, b: Name) -> bool:
    if not a.middle or not b.middle:
        return True
    if len(a.middle) > 1 and len(b.middle) > 1:
        return a.middle == b.middle or edits(a.middle, b.middle) <= 2
    return a.middle[0] == b.middle[0]


def fits(a: Name, b: Name, d: int) -> bool:
    """May two readings, with ``d`` edits between their cores, be one entity?"""
    if a.kind != b.kind:
        return False
    if a.kind == "org":
        return not (a.legal and b.legal and a.legal != b.legal) and (d == 0 or _trade_fits(a, b))
    if not _middle_fits(a, b):
        return False
    if not a.initial or not b.initial:  # a bare surname
        return a.surname == b.surname
    if d and a.initial != b.initial:
        d = edits(a.surname, b.surname)
    if d > 2:
        return False
    g = _given_edits(a, b, 2 - d)
    return g is not None and d + g <= 2


def _trade_fits(a: Name, b: Name) -> bool:
    """Organisations with the same first word differ if another word is a different word, not a typo of it."""
    wa, wb = a.core.split(), b.core.split()
    return len(wa) != len(wb) or all(x == y or (edits(x, y) <= 2 and min(len(x), len(y)) > 3) for x, y in zip(wa, wb))


# Neighbours on the keyboard, and letters written for one another.
_ROWS = ("qwertyuiop", "asdfghjkl", "zxcvbnm")
_SLIP = {(r[i], r[i + 1]) for r in _ROWS for i in range(len(r) - 1)} | {(a[i], b[j]) for a, b in zip(_ROWS, _ROWS[1:]) for i in range(len(a)) for j in (i - 1, i) if 0 <= j < len(b)} | {("e", "i"), ("o", "u"), ("c", "k"), ("v", "w")}
_SLIP |= {(b, a) for a, b in _SLIP}


@lru_cache(100_000)
def slips(a: str, b: str) -> int:
    """The least cost of the slips that make one word of the other: 1 for a swap, 3 for a letter more or less, 4 for a neighbour
    on the keyboard or a letter that sounds alike, 9 for any other letter."""
    a, b = trie.differing(a, b)
    prev2: list[int] = []
    prev = list(range(0, 3 * len(b) + 1, 3))
    for i, ca in enumerate(a, 1):
        row = [3 * i]
        for j, cb in enumerate(b, 1):
            d = min(prev[j] + 3, row[j - 1] + 3, prev[j - 1] + (0 if ca == cb else 4 if (ca, cb) in _SLIP else 9))
            if i > 1 and j > 1 and ca == b[j - 2] and a[i - 2] == cb:
                d = min(d, prev2[j - 2] + 1)
            row.append(d)
        prev2, prev = prev, row
    return prev[-1]


def slip(a: Name, b: Name) -> bool:
    """Given that two readings with different cores fit: may they be one entity although no matter and field holds both?

    One letter swapped, left out or added, or two slips of which one is a swap, is a slip of the hand. A replaced letter alone,
    or two letters more, make another name as readily as a slip, and need a matter in common.
    """
    if a.kind == "org":
        pairs = [(a.core, b.core)]
    elif a.initial and b.initial and min(len(a.surname), len(b.surname)) > 4:
        pairs = [(a.surname, b.surname)] + ([(a.given, b.given)] if a.given and b.given else [])
    else:
        return False
    d = sum(edits(x, y) for x, y in pairs)
    return d <= 2 and sum(slips(x, y) for x, y in pairs if x != y) <= (5 if d == 2 else 3)


# ---- spellings


def number(text: str) -> int:
    """64 bits that stand for a text."""
    n = xxh3_64_intdigest(text)
    return n - (1 << 64) if n >> 63 else n


def spellings_of(df: DataFrame, group_col: str, lists: dict[str, Column], singles: dict[str, Column]) -> DataFrame:
    """(g, s, spelling): numbers of a place (group and field) and of a spelling that stands there, in one Arrow pass.

    Packed lists are split, every spelling is brought to its plain form. ``spelling`` is given where a task meets a number first,
    else null. Rows without a group have a null place: their spellings stand together with nothing. Rows may repeat.
    """
    names_ = [*lists, *singles]
    lean = df.select(F.col(group_col).cast("string").alias("grp"), *[c.cast("array<string>").alias(f"c{i}") for i, c in enumerate([*lists.values(), *singles.values()])])
    n_lists = len(lists)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        met: set[int] = set()
        stood: set[tuple[int, int]] = set()
        with plain_forms() as plain:
            for b in batches:
                groups = b.column(0).dictionary_encode()
                code = groups.indices.fill_null(-1).to_numpy()
                parts, forms = [], []
                for i, name in enumerate(names_):
                    flat = b.column(i + 1).flatten()
                    enc = flat.dictionary_encode()
                    texts = enc.dictionary.to_pylist()
                    if not texts:
                        continue
                    parent = b.column(i + 1).value_parent_indices().to_numpy()
                    at = enc.indices.fill_null(-1).to_numpy()
                    entries = [split(x) if i < n_lists else (x,) for x in texts]
                    sizes = np.array([len(es) for es in entries])
                    pairs = np.unique((code[parent[at >= 0]].astype(np.int64) + 1) * len(texts) + at[at >= 0])
                    g, k = pairs // len(texts), pairs % len(texts)
                    begin = len(forms) + np.cumsum(sizes) - sizes
                    forms += [e for es in entries for e in es]
                    sizes, begin = sizes[k], begin[k]
                    place = np.repeat(begin - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
                    g = np.array([0, *(number(f"{name}\x00{x}") for x in groups.dictionary.to_pylist())], np.int64)[np.repeat(g, sizes)]
                    parts.append((g, place))
                if not parts:
                    continue
                forms = plain(forms)
                numbers = [number(x) if x else 0 for x in forms]
                fresh = {n: x for n, x in zip(numbers, forms) if x and n not in met}
                met.update(fresh)
                g, s = np.concatenate([g for g, _ in parts]), np.array(numbers, np.int64)[np.concatenate([p for _, p in parts])]
                new = set(zip(g[s != 0].tolist(), s[s != 0].tolist())) - stood
                stood |= new
                if len(stood) > 500_000:  # repeats are harmless, they only cost
                    met.clear()
                    stood.clear()
                g, s = zip(*new) if new else ((), ())
                g = np.array(g, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(g, mask=g == 0), pa.array(s, pa.int64()), pa.nulls(len(g), pa.string())], ["g", "s", "spelling"])
                if fresh:
                    yield pa.RecordBatch.from_arrays([pa.nulls(len(fresh), pa.int64()), pa.array(list(fresh), pa.int64()), pa.array(list(fresh.values()), pa.string())], ["g", "s", "spelling"])

    return lean.mapInArrow(run, "g bigint, s bigint, spelling string")


@lru_cache(200_000)
def split(element: str) -> tuple[str, ...]:
    """The entries of one element of a list."""
    return tuple(e for e, _ in parse_packed(element))


_CUT = "\x1f"


def packed(n: Name) -> str:
    """A reading as one string, which moves more cheaply than its fields."""
    return _CUT.join((n.kind, n.core, n.given, n.initial, n.middle, n.legal))


def unpacked(x: str) -> Name:
    kind, core, given, initial, middle, legal = x.split(_CUT)
    return Name(kind, core, core[len(initial) :] if kind == "person" else core.split(" ")[0], given, initial, middle, legal)


def _core_number(n: Name) -> int:
    return number(n.kind + n.core)


def small(df: DataFrame, name: str) -> DataFrame:
    """``df``, written; sent to the executors in joins if it has no more than ``SMALL`` rows of a few numbers each."""
    df = written(df, name)
    return F.broadcast(df) if df.count() <= SMALL else df


def read_spellings(spellings: DataFrame) -> DataFrame:
    """(s, spelling, cls, options, is_first, name, c, surname, is_bare, raw, raw_c): the reading of each spelling as ``packed``, as it sounds;
    ``raw`` as written, where that differs; c, raw_c and surname number the cores and the
    surname, ``cls`` the class.

    ``options`` rows, of which one ``is_first``, if a short given name leaves several. ``spellings``: (s, spelling).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, s in enumerate(b.column(1).to_pylist()):
                ways = names.orders(names.parse(s))
                for k, way in enumerate(ways):
                    for n in way:
                        same = names.sounded(n)
                        words = n.kind == "person" and n.given and n.surname
                        rows.append((i, k if len(ways) > 1 else -1, len(way), n is way[0], number(n.given) if words else None, number(n.surname) if words else None, packed(same), _core_number(same), number(same.surname) if same.kind == "person" else None, n.kind == "person" and not n.initial, *((packed(n), _core_number(n)) if n != same else (None, None))))
            got = list(zip(*rows)) or [()] * 12
            types = (pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([*b.take(pa.array(got[0], pa.int64())).columns, *map(pa.array, got[1:], types)], names=["s", "spelling", "way", "options", "is_first", "first_word", "last_word", "name", "c", "surname", "is_bare", "raw", "raw_c"])

    all_ = written(spellings.mapInArrow(run, "s bigint, spelling string, way int, options int, is_first boolean, first_word bigint, last_word bigint, name string, c bigint, surname bigint, is_bare boolean, raw string, raw_c bigint"), "readings")
    both = lambda df, *more: df.select(*more, F.explode(F.array(F.struct(F.col("first_word").alias("word"), F.lit(1).alias("g"), F.lit(0).alias("l")), F.struct(F.col("last_word").alias("word"), F.lit(0).alias("g"), F.lit(1).alias("l")))).alias("w")).select(*more, "w.*")
    words = both(all_.where("way < 0 AND options = 1 AND first_word IS NOT NULL")).groupBy("word").agg((F.log(F.sum("g") + F.lit(0.1)) - F.log(F.sum("l") + F.lit(0.1))).alias("odds"))
    # what the words say for the natural order of a spelling; if they say nothing, it's meant
    asked = both(all_.where("way = 0"), "s").select("s", "word", (F.col("g") - F.col("l")).alias("sign"))
    turned = small(asked.join(words, "word").groupBy("s").agg(F.sum(F.col("sign") * F.col("odds")).alias("score")).where("score < 0").select("s", F.lit(1).alias("best")), "turned")
    lean = ("s", "spelling", "way", "options", "is_first", "name", "c", "surname", "is_bare", "raw", "raw_c")
    chosen = all_.where("way >= 0").select(*lean).join(turned, "s", "left").where("way = coalesce(best, 0)").drop("best")
    one = all_.where("way < 0").select(*lean).unionByName(chosen).drop("way")
    # spellings with several options are classes by themselves: each is read by its own company
    return one.withColumn("cls", F.when(F.col("options") > 1, F.xxhash64("s", F.lit("?"))).otherwise(F.xxhash64("name")))


# ---- classes of one core


def grouped(df: DataFrame, keys: list[str], fn: Callable[[list[tuple]], Iterator[tuple]], schema: str) -> DataFrame:
    """Call a function with the rows (tuples) of each group of adjacent equal keys; df's first columns are ``keys``.

    Groups are adjacent because the partition is sorted; tens of thousands of small groups cost no more than their rows.
    """
    n = len(keys)
    out = df.repartition(*keys).sortWithinPartitions(*keys)
    from pyspark.sql.types import _parse_datatype_string

    to_arrow = pa.schema([(f.name, {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}[f.dataType.simpleString()]) for f in _parse_datatype_string(schema).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buf: list[tuple] = []
        key, rows = None, []
        emit = lambda b: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*b), to_arrow.types)], schema=to_arrow)
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:n] != key:
                    if rows:
                        buf.extend(fn(rows))
                        if len(buf) > 20_000:
                            yield emit(buf)
                            buf = []
                    key, rows = row[:n], []
                rows.append(row)
        if rows:
            buf.extend(fn(rows))
        if buf:
            yield emit(buf)

    return out.mapInArrow(run, schema)


def _given_groups(count: dict[str, int]) -> dict[str, int]:
    """Given names of one core, the frequent ones first: a name within two edits of an earlier group's first name joins it."""
    heads: dict[str, int] = {}
    of: dict[str, int] = {}
    tree = trie.Trie()
    for g in sorted(count, key=lambda g: (-count[g], g)):
        near = min((heads[h] for x in {g, sound(g)} for h, _ in tree.near(x) if len(h) > 3), default=None) if len(g) > 3 else None
        if near is None:
            near = len(of)
            for x in (g, sound(g)):
                if heads.setdefault(x, near) == near:
                    tree.add(x)
        of[g] = near
    return of


def core_links(rows: list[tuple]) -> Iterator[tuple[int, int, int | None]]:
    """(class, representative, member) of the classes of one core, wherever they occur.

    member null: the class is that person or organisation. Otherwise the class is ambiguous, and ``member`` is a class of a
    person that it may be. ``rows``: (number of the core, packed reading, cls, options, n).
    """
    if len(rows) == 1:
        return
    rows = [(*unpacked(r[1]), *r[2:]) for r in rows]
    if rows[0][0] == "org":
        by_legal = {r[6]: r[7] for r in rows}
        if (plain := by_legal.pop("", None)) is not None:
            for c in by_legal.values():
                yield (plain, c, c) if len(by_legal) > 1 else (plain, c, None)
        return
    sure = [r for r in rows if r[8] == 1 and r[4]]
    count: dict[str, int] = defaultdict(int)
    for r in sure:
        if r[3]:
            count[r[3]] += r[9]
    of = _given_groups(count)
    middles: dict[int, set[str]] = defaultdict(set)
    for r in sure:
        if r[5]:
            middles[of.get(r[3], -1)].add(r[5][0])
    groups = sorted(set(of.values()))
    first: dict[tuple[int, str], int] = {}
    members: dict[tuple[int, str], list[int]] = defaultdict(list)
    loose = []  # (class, persons that it may be)

    def settle(r: tuple, i: int) -> None:
        m = middles[i]
        if len(m) > 1 and not r[5]:
            loose.append((r[7], [(i, x) for x in sorted(m)]))
        else:
            at = (i, r[5][:1] if len(m) > 1 else "")
            first.setdefault(at, r[7])
            members[at].append(r[7])

    sure.sort(key=lambda r: (not r[3], r[7]))
    for r in sure:
        if r[3]:
            settle(r, of[r[3]])
        elif not groups:
            middles[-1] = middles.get(-1, set())
            settle(r, -1)
        else:
            able = [i for i in groups if not r[5] or r[5][0] in middles[i] or not middles[i]]
            able = [i for i in able if r[5] and r[5][0] in middles[i]] or able
            if len(able) == 1:
                settle(r, able[0])
            elif able:
                loose.append((r[7], [(i, m) for i in able for m in ([r[5][0]] if r[5] and r[5][0] in middles[i] and len(middles[i]) > 1 else sorted(middles[i]) if len(middles[i]) > 1 else [""])]))
    for r in rows:
        if r[8] > 1 and r[3] in of:
            i = of[r[3]]
            loose.append((r[7], [(i, x) for x in (sorted(middles[i]) if len(middles[i]) > 1 else [""]) if not r[5] or not x or x == r[5][0]]))
    for at, cs in members.items():
        for c in cs[1:]:
            yield c, first[at], None
    for c, may in loose:
        for at in may:
            for member in members.get(at, ()):
                yield c, first[at], member


# ---- neighbours


def near_cores(cores: DataFrame) -> DataFrame:
    """(a, b, d): numbers of all distinct cores of one kind with 1 or 2 edits between them, a < b. ``cores``: (core, c), where a
    core follows its kind."""

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, number(kind + x), s, h1, h2) for i, (kind, core) in enumerate(x.split(_CUT) for x in b.column(0).to_pylist()) for x, s, h1, h2 in trie.shards(core)]
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), b.column(1).take(pa.array(cols[0], pa.int64())), *(pa.array(c, pa.int32()) for c in cols[3:])], names=["shard", "name", "c", "h1", "h2"])

    rows = written(cores.mapInArrow(placed, "shard bigint, name string, c bigint, h1 int, h2 int"), "shards")
    hot = rows.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("shard")
    if not hot.isEmpty():
        rows = rows.join(hot, "shard", "left_anti").unionByName(_cut(rows.join(hot, "shard")))

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        def found(t: pa.Table) -> pa.RecordBatch:
            col = lambda i: t.column(i).to_numpy()
            shard = np.cumsum(np.diff(col(0), prepend=col(0)[0]) != 0)
            texts = t.column(1).to_pylist()
            short = (np.bincount(shard, np.fromiter(map(len, texts), np.int64, len(texts)) > 29) == 0)[shard]
            got = []
            for at in (np.flatnonzero(short), np.flatnonzero(~short)):  # short names need half the bits
                i, j, d = trie.walk(shard[at], [texts[k] for k in at], col(3)[at], col(4)[at])
                got.append((at[i], at[j], d))
            i, j, d = (np.concatenate(x) for x in zip(*got))
            own = col(2)
            pairs = np.unique(np.stack([np.minimum(own[i], own[j]), np.maximum(own[i], own[j]), d]), axis=1) if len(i) else np.zeros((3, 0), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1]), pa.array(pairs[2].astype(np.int32))], names=["a", "b", "d"])

        held, n = [], 0
        for b in batches:
            held.append(b)
            n += len(b)
            if n >= _BATCH:  # all but the last shard, which may go on
                t = pa.Table.from_batches(held).combine_chunks()
                at = int(np.searchsorted(t.column(0).to_numpy(), t.column(0)[-1].as_py()))
                if at:
                    yield found(t.slice(0, at))
                held = t.slice(at).to_batches()
                n = len(t) - at
        if n:
            yield found(pa.Table.from_batches(held))

    return rows.repartition("shard").sortWithinPartitions("shard").mapInArrow(walked, "a bigint, b bigint, d int").where("a <> b").groupBy("a", "b").agg(F.min("d").alias("d"))


def _cut(rows: DataFrame) -> DataFrame:
    """Rows of hot shards in smaller ones: names within two edits share what remains of their last letters after two deletions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [(i, x) for i, s in enumerate(b.column(1).to_pylist()) for x in tails(s)]
            at, keys = zip(*got) if got else ((), ())
            t = b.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*t.columns, pa.array(keys, pa.string())], names=[*b.schema.names, "tail"])

    cut = rows.select("shard", "name", "c", "h1", "h2").mapInArrow(run, "shard bigint, name string, c bigint, h1 int, h2 int, tail string")
    return cut.withColumn("shard", F.xxhash64("shard", "tail")).drop("tail")


def tails(s: str) -> set[str]:
    """What is left of the last letters after up to two deletions; an edit further ahead is a deletion in both."""
    head = s[::-1][:7]
    one = {head[:i] + head[i + 1 :] for i in range(len(head))}
    return {head, *one, *(x[:i] + x[i + 1 :] for x in one for i in range(len(x)))}


def near_classes(near: DataFrame, forms: DataFrame) -> DataFrame:
    """(a, b, is_slip): classes whose cores are near and that fit. ``forms``: (c, cls, name)."""
    side = lambda x: forms.select(F.col("c").alias(x), F.col("cls").alias(f"cls_{x}"), F.col("name").alias(f"name_{x}"))
    pairs = side("a").join(near, "a").join(side("b"), "b").where("cls_a <> cls_b")
    pairs = pairs.select("cls_a", "cls_b", "d", "name_a", "name_b")

    def hopeless(a: Name, b: Name, d: int) -> bool:
        """Persons that differ too much in what costs nothing to compare."""
        if a.kind == "org" or not a.initial or not b.initial:
            return False
        if a.middle and b.middle and a.middle[0] != b.middle[0] and min(len(a.middle), len(b.middle)) == 1:
            return True
        if a.given == b.given:
            return False
        short = min(len(a.given), len(b.given))
        return (short > 0 and (short < 4 or abs(len(a.given) - len(b.given)) > 2)) if a.initial == b.initial else short < 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for ca, cb, d, na, nb in zip(*(c.to_pylist() for c in b.columns)):
                x, y = unpacked(na), unpacked(nb)
                if not hopeless(x, y, d) and fits(x, y, d):
                    out.append((min(ca, cb), max(ca, cb), slip(x, y)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 3, (pa.int64(), pa.int64(), pa.bool_()))], names=["a", "b", "is_slip"])

    return pairs.mapInArrow(run, "a bigint, b bigint, is_slip boolean").groupBy("a", "b").agg(F.max("is_slip").alias("is_slip"))


# ---- evidence and entities


def _wide_links(slips_: DataFrame, entities: DataFrame, classes: DataFrame, placed: DataFrame) -> DataFrame:
    """(sa, sb): links of entities that no matter and field holds together. ``entities``: (cls, entity); ``placed``: (g, cls).

    An entity stands with the core that most of its spellings have. Of the entities that fit an entity, those met as often or
    oftener are its candidates; it's linked to the one met most often if all its other candidates fit that one as well.
    """
    apart = slips_.join(entities.select(F.col("cls").alias("a"), F.col("entity").alias("na")), "a").join(entities.select(F.col("cls").alias("b"), F.col("entity").alias("nb")), "b").where("na <> nb")
    apart = written(apart, "apart")
    asked = apart.select(F.col("na").alias("entity")).union(apart.select("nb")).distinct()
    known = written(entities.join(asked, "entity", "left_semi").join(classes.select("cls", "c", "n_spellings"), "cls"), "known")
    weight = known.groupBy("entity", "c").agg(F.sum("n_spellings").alias("k"))
    places = placed.join(known.select("cls", "entity"), "cls").groupBy("entity").agg(F.count("*").alias("met"))
    met = weight.groupBy("entity").agg(F.max("k").alias("k")).join(places, "entity", "left").withColumn("met", F.coalesce("met", F.lit(0)))
    main = written(known.join(weight.join(met, ["entity", "k"]).select("entity", "c", "met"), ["entity", "c"]).select("cls", F.struct("met", "entity").alias("e")), "mains")
    fit = apart.join(main.select(F.col("cls").alias("a"), F.col("e").alias("ea")), "a").join(main.select(F.col("cls").alias("b"), F.col("e").alias("eb")), "b").select("ea", "eb").distinct()
    fit = written(fit, "fitting")
    both = written(fit.union(fit.select("eb", "ea")).distinct(), "fitting")
    ranked = both.where("eb.met >= ea.met")
    best = ranked.groupBy("ea").agg(F.max("eb").alias("best"), F.collect_set("eb").alias("all")).select("ea", "best", F.explode("all").alias("other"))
    bad = written(best.where("other <> best").join(both.select(F.col("ea").alias("other"), F.col("eb").alias("best")), ["other", "best"], "left_anti").select("ea").distinct(), "unclear")
    clear = best.where("other = best").join(bad, "ea", "left_anti")
    # nor is an entity merged into one that is met as often and is itself unclear
    clear = clear.join(bad.select(F.col("ea").alias("best"), F.lit(True).alias("is_bad")), "best", "left").where("is_bad IS NULL OR best.met > ea.met")
    return clear.select(F.col("ea.entity").alias("sa"), F.col("best.entity").alias("sb"))


def link_spellings(met_: DataFrame) -> DataFrame:
    """(spelling, entity): spellings with one entity (a number) are linked; every spelling with a reading has one.

    ``met_``: (g, s, spelling) as from ``spellings_of``.
    """
    spellings = met_.where("spelling IS NOT NULL").select("s", "spelling").distinct()
    read = written(read_spellings(spellings), "read")
    classes = written(read.groupBy("cls", "options", "name", "c", "surname", "is_bare").agg(F.count("*").cast("int").alias("n_spellings")), "classes")
    links = written(grouped(classes.select("c", "name", "cls", "options", "n_spellings"), ["c"], core_links, "cls bigint, rep bigint, member bigint"), "core-links")
    # a bare surname may be any person of that surname
    persons = classes.where("options = 1 AND surname IS NOT NULL").select("cls", "surname", "is_bare")
    bare = small(persons.where("is_bare").select(F.col("cls").alias("bare"), "surname"), "bare")
    bare = persons.where("NOT is_bare").select("cls", "surname").join(bare, "surname")
    base = links.where("member IS NULL").select("cls", "rep")
    loose = links.where("member IS NOT NULL").unionByName(bare.join(base, "cls", "left").select(F.col("bare").alias("cls"), F.coalesce("rep", "cls").alias("rep"), F.col("cls").alias("member")))
    loose = written(loose, "loose")
    # a typo may have changed a word before or after it is written as it sounds: either form may be near another
    raw = read.where("raw IS NOT NULL AND options = 1").select("cls", F.col("raw").alias("name"), F.col("raw_c").alias("c")).distinct()
    forms = classes.where("options = 1").select("cls", "name", "c").unionByName(raw)
    cores = forms.select(F.substring_index("name", _CUT, 2).alias("core"), "c").distinct()
    near = written(near_classes(near_cores(cores), forms), "near")

    # node of a class: its representative; of a spelling: that of its class, or the spelling itself where the class is ambiguous
    state = base.select("cls", "rep", F.lit(False).alias("is_loose")).unionByName(loose.select("cls", F.lit(None).cast("bigint").alias("rep"), F.lit(True).alias("is_loose")))
    state = state.groupBy("cls").agg(F.max("rep").alias("rep"), F.max("is_loose").alias("is_loose"))
    wanted = near.select(F.col("a").alias("cls"), F.col("b").alias("with"), F.lit(None).cast("bigint").alias("rep")).unionByName(loose.select("cls", F.col("member").alias("with"), "rep"))
    asked = wanted.select("cls").union(wanted.select("with")).distinct().select("cls", F.lit(True).alias("is_asked"))
    nodes = read.where("is_first").select("s", "cls").join(state, "cls", "left").join(asked, "cls", "left")
    nodes = written(nodes.select("s", "cls", F.when(F.col("is_loose"), F.col("s")).otherwise(F.coalesce("rep", "cls")).alias("node"), F.coalesce("is_loose", F.lit(False)).alias("is_loose"), F.col("is_asked").isNotNull().alias("is_asked")), "nodes")
    placed = met_.where("g IS NOT NULL").select("g", "s").join(nodes.where("is_asked").select("s", "cls", "node"), "s").select("g", "cls", "node").distinct()
    placed = written(placed, "placed")
    other = placed.select("g", F.col("cls").alias("with"), F.col("node").alias("other"))
    together = placed.join(wanted, "cls").join(other, ["g", "with"]).where("node <> other").groupBy("node", F.coalesce("rep", "other").alias("other"), F.col("rep").isNull().alias("is_near")).agg(F.countDistinct("g").alias("n"))
    together = written(together, "together")
    voted = together.where("NOT is_near").groupBy("node").agg(F.max(F.struct("n", "other"))["other"].alias("other"))
    linked = components(together.where("is_near").select("node", "other").unionByName(voted), "node", "other")
    entity = written(nodes.join(linked, "node", "left").select("s", "cls", "is_loose", F.coalesce("component", "node").alias("entity")), "entities")
    wide = written(_wide_links(near.where("is_slip").select("a", "b"), entity.where("NOT is_loose").select("cls", "entity").distinct(), classes, placed), "wide-links")
    merged = components(wide, "sa", "sb").select(F.col("node").alias("entity"), "component")
    final = entity.join(merged, "entity", "left").select("s", F.coalesce("component", "entity").alias("entity"))
    return final.join(read.where("is_first").select("s", "spelling"), "s").select("spelling", "entity")


def spelling_entities(linked: DataFrame) -> DataFrame:
    """(spelling, entity): the least spelling of each entity names it."""
    return linked.join(linked.groupBy("entity").agg(F.min("spelling").alias("name")), "entity").select("spelling", F.col("name").alias("entity"))


def spelling_pairs(linked: DataFrame) -> DataFrame:
    """All pairs of spellings of one entity: (spelling_a, spelling_b) in code-point order."""
    a = linked.select("entity", F.col("spelling").alias("spelling_a"))
    b = linked.select("entity", F.col("spelling").alias("spelling_b"))
    return a.join(b, "entity").where("spelling_a < spelling_b").select("spelling_a", "spelling_b")
