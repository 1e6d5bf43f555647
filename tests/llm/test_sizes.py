from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from casemill.llm import mixing, packing, reading, tokens


@given(st.dictionaries(st.integers(1, 12), st.integers(1, 5), min_size=1), st.integers(1, 4))
@settings(max_examples=100, deadline=None)
def test_boundaries_are_optimal(histogram, buckets):
    from itertools import combinations

    cost = lambda tops: sum(k * (min(t for t in tops if t >= n) - n) for n, k in histogram.items())
    best = min(cost([*c, 12]) for r in range(buckets) for c in combinations(range(1, 12), r))
    got = packing.boundaries(histogram, 12, buckets)
    assert got[-1] == 12 and len(got) <= buckets and cost(got) == best


@given(st.lists(st.integers(1, 100), max_size=200))
@settings(max_examples=100, deadline=None)
def test_shard_fits(sizes):
    where = packing.pack_shard(list(enumerate(sizes)), 100, [25, 50, 100])
    load = Counter()
    for c, n in zip(where, sizes):
        load[c] += n
    assert all(v <= 100 for v in load.values())
    assert len(load) <= 2 * sum(sizes) / 100 + 1  # no two containers that could be one


def test_other_boundaries_give_other_containers():
    rng = np.random.default_rng(4)
    items = list(enumerate(np.minimum(99, 1 + rng.exponential(18, 2_000)).astype(int).tolist()))
    loads = lambda where: sorted(Counter({c: sum(items[k][1] for k, x in enumerate(where) if x == c) for c in set(where)}).values())
    packed = [packing.pack_shard(items, 100, tops) for tops in ([100], [20, 100], packing.boundaries(Counter(n for _, n in items), 100, 8))]
    groups = [{frozenset(k for k, x in enumerate(w) if x == c) for c in set(w)} for w in packed]
    assert groups[0] != groups[1] and groups[1] != groups[2] and groups[0] != groups[2]
    for w in packed:
        assert max(loads(w)) <= 100 and sum(n for _, n in items) / (100 * len(set(w))) > 0.97


def test_draws_are_multinomial_and_meet_the_totals(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_SLOTS", 200)
    planned = {"a": 6_000, "b": 3_000, "none": 0, "c": 1_003}
    got = mixing.draw(spark, planned).collect()
    assert len({(r.shard, r.slot) for r in got}) == len(got) == 10_003
    for s, n in planned.items():
        assert sorted(r.q for r in got if r.source == s) == list(range(n))
    a = np.array([sum(r.source == "a" for r in got if r.shard == k) for k in range(50)])
    assert abs(a.mean() - 120) < 6 and 4 < a.std() < 10.5  # binomial: 6.9
    assert mixing.draw(spark, {"a": 0}).count() == 0


def test_fill_containers(spark):
    rows = [(i, n) for i, n in enumerate([0, 1, 2047, 2048, 2049, 5000, 700, 700, 648, 1])] + [(9, 1)]
    packed = packing.fill_containers(spark.createDataFrame(rows, "id int, n_tokens bigint").withColumn("shard", F.lit(1)), 2048)
    got, load = defaultdict(list), Counter()
    for r in packed.collect():
        got[r.id].append((r.token_from, r.n_tokens))
        load[r.container_id] += r.n_tokens
    assert max(load.values()) <= 2048 and sum(load.values()) == sum(n for _, n in rows)
    for i, n in rows[:-2]:
        assert sorted(got[i]) == [(a, min(2048, n - a)) for a in range(0, n, 2048)]
    assert packing.fill_report(packing.fill_containers(spark.createDataFrame([], "id int, n_tokens bigint"), 2048), 2048).collect()[0].n_containers == 0


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "The cat sat.", "a"), (2, None, "a"), (3, "", None), (4, "naïve <|endoftext|> " * 500, "b")], "id int, text string, source string")
    enc = tokens.encoding(tokens.DEFAULT_RANKS)
    for r in tokens.count_tokens(df, "id", "text", ["source"]).join(df.select("id", "text"), "id").collect():
        assert r.n_tokens == len(enc.encode_ordinary(r.text or "")) and enc.decode(enc.encode_ordinary(r.text or "")) == (r.text or "")


def test_mixture(spark):
    rows = [(i, "big" if i % 3 else "small", 30 + i % 50) for i in range(900)] + [(-1, None, 50), (-2, "other", 50), (-3, "big", 0)]
    counts = spark.createDataFrame(rows, "id int, source string, n_tokens bigint")
    targets = [("big", 0.4, 1), ("small", 0.6, 3)]
    mixed, shares = mixing.mixture(counts, targets, block=64)
    s = {r.source: r for r in shares.collect()}
    assert abs(s["small"].actual_share - 0.6) < 0.01 and s["small"].repetitions <= 3 and s["big"].repetitions == 1
    got = mixed.collect()
    for k in s:
        assert s[k].mixture_tokens == sum(r.token_to - r.token_from for r in got if r.source == k)
        used = {(r.id, t) for r in got if r.source == k for t in range(r.token_from, r.token_to)}
        assert s[k].unused_tokens == s[k].source_tokens - len(used)
    slots = defaultdict(int)
    for r in got:
        slots[r.shard, r.slot] += r.token_to - r.token_from
    assert set(slots.values()) == {64} and len(slots) == sum(x.blocks_drawn for x in s.values())
    uses = Counter((r.source, r.id, r.token_from, r.block_no, r.repetition) for r in got)
    assert max(uses.values()) == 1  # within a repetition a block is drawn once
    assert {r.id for r in got} <= set(range(900))


def test_plan_without_a_source():
    assert mixing.plan({"a": 640, "b": 640}, [("a", 0.5, 1), ("b", 0.25, 1), ("c", 0.25, 2)], 64) == {"a": (10, 10), "b": (10, 5), "c": (0, 0)}
    assert mixing.plan({}, [("a", 1.0, 1)], 64) == {"a": (0, 0)}


def test_offsets_against_running_sum(spark):
    counts = spark.createDataFrame([(i, "s", i % 7) for i in range(200)], "id int, source string, n_tokens bigint")
    rows = sorted(mixing.offsets(counts).where("n_tokens > 0").collect(), key=lambda r: r.token_at)
    at = 0
    for r in rows:
        assert r.token_at == at
        at += r.n_tokens


def test_isotonic_against_brute_force():
    rng = np.random.default_rng(0)
    x, y = rng.permutation(30).astype(float), rng.integers(1, 6, 30).astype(float)
    at, value = reading.isotonic(x, y)
    fit = value[np.searchsorted(at, np.sort(x), side="right") - 1]
    assert (np.diff(fit) >= 0).all()
    ys = y[np.argsort(x)]
    for i in range(30):  # max-min formula
        assert fit[i] == pytest.approx(max(min(ys[a : b + 1].mean() for b in range(i, 30)) for a in range(i + 1)))


def test_reading_levels_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    documents, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/level_labels.parquet")
    train, test = labels.where("doc_id % 4 <> 0"), labels.where("doc_id % 4 = 0").groupBy("doc_id").agg(F.avg("reading_band").alias("g"))
    got = reading.reading_levels(documents, train, "doc_id", "text").join(test, F.col("id") == F.col("doc_id")).collect()
    assert len(got) > 20 and sum(abs(r.reading_band - r.g) <= 0.5 for r in got) / len(got) > 0.75


def test_reading_edges(spark):
    labels = spark.createDataFrame([(1, 1), (2, 5)], "doc_id int, reading_band int")
    docs = spark.createDataFrame([(1, "The cat sat on the mat and the dog was by it. " * 5), (2, "The jurisdictional presumption of constitutionality and the interlocutory determination was to be circumscribed by considerations. " * 5), (3, None), (4, ""), (5, "El perro de la casa no está en el parque que los niños ven. " * 5)], "doc_id int, text string")
    got = {r.id: r.reading_band for r in reading.reading_levels(docs, labels, "doc_id", "text").collect()}
    assert set(got) == {1, 2}
    assert reading.reading_levels(docs, labels.limit(0), "doc_id", "text").count() == 0
    assert reading.reading_levels(docs.limit(0), labels, "doc_id", "text").count() == 0
