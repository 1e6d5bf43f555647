"""Mix sources to target shares of tokens.

Each source's documents, in a pseudorandom order, form one stream of tokens that is cut into blocks of fixed length. The mixture
is as large as the shares and repeat caps allow. Every slot of every output shard draws its source by the shares, so the counts of a
shard are multinomial. Over all shards such counts miss the planned totals by about their square root; the slots drawn beyond a
source's total are given to the sources that fell short, so the totals are met to a block. A slot's number among those of its source
maps through a pseudorandom permutation of the source's block numbers, a new one for every repetition, and blocks are joined by
number. The driver holds a few numbers for each source, whatever the number of shards.

Offsets come from two levels of sums (buckets of documents, then within a bucket), so a source with a third of all rows is never
in one task. Sources without a target, and documents without source or tokens, take no part. The last, short block of a stream
is left out of the mixture, as blocks have one length. The shares report counts what the mixture's rows hold, and the tokens of each
source that no row holds: blocks that weren't drawn, the short block, sources without a whole block.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLOCK = 512  # tokens
SHARD_SLOTS = 4_096
BUCKET_ROWS = 50_000  # documents in a bucket of the prefix sums
SEED = 20_240_229


def offsets(counts: DataFrame, seed: int = SEED) -> DataFrame:
    """Add ``token_at``, the place of each document's first token in its source's stream (id, source, n_tokens)."""
    n = counts.count()
    buckets = max(1, -(-n // BUCKET_ROWS))
    keyed = counts.withColumn("h", F.xxhash64(F.col("id"), F.lit(seed))).withColumn("bucket", F.pmod(F.shiftrightunsigned("h", 20), F.lit(buckets)))
    per = keyed.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("t"))
    base = per.select("source", "bucket", (F.sum("t").over(Window.partitionBy("source").orderBy("bucket")) - F.col("t")).alias("base"))
    within = F.sum("n_tokens").over(Window.partitionBy("source", "bucket").orderBy("h", "id").rowsBetween(Window.unboundedPreceding, -1))
    return keyed.withColumn("within", F.coalesce(within, F.lit(0))).join(base, ["source", "bucket"]).select("id", "source", "n_tokens", (F.col("base") + F.col("within")).alias("token_at"))


def plan(totals: dict[str, int], targets: list[tuple[str, float, int]], block: int = BLOCK) -> dict[str, tuple[int, int]]:
    """source -> (blocks it has, blocks drawn): the largest mixture within the repeat caps.

    A source without a whole block draws none; the others keep the proportions of their shares.
    """
    have = {s: totals.get(s, 0) // block for s, _, _ in targets}
    whole = sum(share for s, share, _ in targets if have[s])
    able = [have[s] * cap * whole / share for s, share, cap in targets if share > 0 and have[s]]
    most = math.floor(min(able)) if able else 0
    return {s: (have[s], min(have[s] * cap, round(most * share / whole)) if have[s] else 0) for s, share, cap in targets}


def _permutation(n: int, seed: int, epoch: int, source: str) -> tuple[int, int]:
    """(a, b) of x -> (a x + b) mod n, a permutation of 0 .. n - 1."""
    import numpy as np

    rng = np.random.default_rng([seed, epoch, *source.encode()])
    a = int(rng.integers(1, max(n, 2)))
    while math.gcd(a, n) != 1:
        a = a % n + 1
    return a, int(rng.integers(0, n))


def draw(spark: SparkSession, planned: dict[str, int], seed: int = SEED) -> DataFrame:
    """(shard, slot, source, q): the source of every slot and its number among the slots of that source, 0 .. planned - 1.

    Slots draw independently; the counts of shards are summed in two levels (shards, then groups of them) to number the slots.
    """
    slots = sum(planned.values())
    names = [s for s in planned if planned[s]]
    if not slots:
        return spark.createDataFrame([], "shard int, slot int, source string, q bigint")
    borders, at = [], 0
    for s in names:
        at += planned[s]
        borders.append((s, at))
    ids = spark.range(slots).select(F.floor(F.col("id") / SHARD_SLOTS).cast("int").alias("shard"), (F.col("id") % SHARD_SLOTS + 1).cast("int").alias("slot"), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(slots)).alias("u"))
    source = F.lit(names[-1])
    for s, end in reversed(borders[:-1]):
        source = F.when(F.col("u") < end, s).otherwise(source)
    ids = ids.select("shard", "slot", source.alias("source"))
    per = ids.groupBy("shard", "source").agg(F.count("*").alias("n")).withColumn("part", F.floor(F.col("shard") / 1_000))
    parts = per.groupBy("part", "source").agg(F.sum("n").alias("n"))
    got = {r["source"]: int(r["n"]) for r in parts.groupBy("source").agg(F.sum("n").alias("n")).collect()}  # a row for each source
    before = Window.orderBy("part").partitionBy("source").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", "source", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("source", "part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    per = per.join(parts, ["part", "source"]).select("shard", "source", (F.col("base") + F.coalesce(F.sum("n").over(within), F.lit(0))).alias("first"))
    ids = ids.join(per, ["shard", "source"]).withColumn("q", F.col("first") + F.row_number().over(Window.partitionBy("shard", "source").orderBy("slot")) - 1)
    # slots beyond a source's total, numbered through all sources, go to the sources that are short
    table = lambda pairs: F.create_map(*[F.lit(x) for s, n in pairs for x in (s, int(n))])
    extra = [max(0, got.get(s, 0) - planned[s]) for s in names]
    short = [max(0, planned[s] - got.get(s, 0)) for s in names]
    shift = table((s, planned[s] - sum(extra[:k])) for k, s in enumerate(names))
    gaps = F.array(*[F.struct(F.lit(sum(short[:k])).cast("bigint").alias("a"), F.lit(sum(short[: k + 1])).cast("bigint").alias("b"), F.lit(s).alias("source"), F.lit(got.get(s, 0)).cast("bigint").alias("n")) for k, s in enumerate(names)])
    ids = ids.withColumn("_r", F.when(F.col("q") >= table((s, planned[s]) for s in names)[F.col("source")], F.col("q") - shift[F.col("source")]))
    ids = ids.withColumn("_to", F.when(F.col("_r").isNotNull(), F.try_element_at(F.filter(gaps, lambda g: (g["a"] <= F.col("_r")) & (F.col("_r") < g["b"])), F.lit(1))))
    return ids.select("shard", "slot", F.coalesce("_to.source", "source").alias("source"), F.coalesce(F.col("_to.n") + F.col("_r") - F.col("_to.a"), "q").alias("q"))


def mixture(counts: DataFrame, targets: list[tuple[str, float, int]], block: int = BLOCK, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(mixture, shares).

    mixture: (shard, slot, source, block_no, repetition, id, token_from, token_to), one row for each document piece of a slot.
    shares: (source, target_share, actual_share, mixture_tokens, source_tokens, unused_tokens, n_blocks, blocks_drawn, repetitions),
    the shares and tokens summed over the mixture's rows. ``targets`` is a small fixed table.
    """
    from casemill.session import written

    spark = counts.sparkSession
    named = [s for s, _, _ in targets]
    counts = written(counts.where(F.col("source").isin(named) & (F.col("n_tokens") > 0)).select("id", "source", "n_tokens"), "mix-counts")
    totals = {r["source"]: int(r["t"]) for r in counts.groupBy("source").agg(F.sum("n_tokens").alias("t")).collect()}  # a row for each target
    drawn = plan(totals, targets, block)
    taken = draw(spark, {s: drawn[s][1] for s in named}, seed)
    repeats = {s: -(-d // max(1, b)) for s, (b, d) in drawn.items()}
    perms = [(s, e, *_permutation(drawn[s][0], seed, e, s)) for s in named if drawn[s][0] for e in range(repeats[s])]
    sizes = F.create_map(*[x for s in named for x in (F.lit(s), F.lit(drawn[s][0]).cast("bigint"))])
    key = lambda s, e: F.concat(s, F.lit("|"), e.cast("string"))
    ma = F.create_map(*[x for s, e, a, _ in perms for x in (F.lit(f"{s}|{e}"), F.lit(a).cast("decimal(38,0)"))]) if perms else F.lit(None)
    mb = F.create_map(*[x for s, e, _, b in perms for x in (F.lit(f"{s}|{e}"), F.lit(b).cast("decimal(38,0)"))]) if perms else F.lit(None)
    taken = taken.withColumn("size", sizes[F.col("source")]).withColumn("repetition", F.floor(F.col("q") / F.col("size")).cast("int")).withColumn("i", F.col("q") % F.col("size"))
    k = key(F.col("source"), F.col("repetition"))
    taken = taken.withColumn("block_no", ((ma[k] * F.col("i").cast("decimal(20,0)") + mb[k]) % F.col("size").cast("decimal(20,0)")).cast("bigint")) if perms else taken.withColumn("block_no", F.lit(None).cast("bigint"))
    at = offsets(counts, seed)
    first, last = F.floor(F.col("token_at") / block), F.floor((F.col("token_at") + F.col("n_tokens") - 1) / block)
    parts = at.select("id", "source", "n_tokens", "token_at", F.explode(F.sequence(first, last)).alias("block_no")).select(
        "id",
        "source",
        "block_no",
        F.greatest(F.lit(0), F.col("block_no") * block - F.col("token_at")).alias("token_from"),
        F.least(F.col("n_tokens"), (F.col("block_no") + 1) * block - F.col("token_at")).alias("token_to"),
    )
    mixed = taken.join(parts, ["source", "block_no"]).select("shard", "slot", "source", "block_no", "repetition", "id", "token_from", "token_to")
    has = mixed.groupBy("source").agg(F.sum(F.col("token_to") - F.col("token_from")).alias("tokens"))
    planned = spark.createDataFrame([(s, float(w), int(totals.get(s, 0)), drawn[s][0], drawn[s][1], int(repeats[s])) for s, w, _ in targets], "source string, target_share double, source_tokens bigint, n_blocks bigint, blocks_drawn bigint, repetitions int")
    every = mixed.agg(F.sum(F.col("token_to") - F.col("token_from")).alias("all_tokens"))
    shares = planned.join(has, "source", "left").join(F.broadcast(every), F.lit(True))
    tokens = F.coalesce("tokens", F.lit(0))
    # a repetition begins when all blocks of the one before are used, so distinct blocks are those drawn, up to all
    unused = F.col("source_tokens") - F.least("blocks_drawn", "n_blocks") * block
    return mixed, shares.select("source", "target_share", F.coalesce(tokens / F.col("all_tokens"), F.lit(0.0)).alias("actual_share"), tokens.alias("mixture_tokens"), "source_tokens", unused.alias("unused_tokens"), "n_blocks", "blocks_drawn", "repetitions")
