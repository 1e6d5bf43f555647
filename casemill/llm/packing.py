"""Fill containers of fixed capacity: optimal length buckets.

Dynamic programming over the global length histogram chooses bucket boundaries that minimise padding. Items longer than the
capacity are cut into full containers and a rest; nothing else is split. Shards of items (by hash, so that each has the whole mix
of lengths) are packed independently, from the bucket of the longest items down. The items of a bucket first use up what the
batches of longer buckets left free; the rest of them forms token-budget batches of its own, each item in the fullest batch of the
bucket that has room for it. A bucket's last, unfinished batches are thus completed by shorter buckets. The boundaries decide which
batches an item may join: with other boundaries other containers come out.

Only (id, length) pairs move; a shard holds about ``SHARD`` items, so no task grows with the data. Items without tokens are left
out; repeated rows are items of their own; an empty table gives no containers.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARD = 50_000  # items packed together
BUCKETS = 48


def boundaries(histogram: dict[int, int], capacity: int, buckets: int = BUCKETS) -> list[int]:
    """Upper bucket boundaries that minimise the sum of (boundary - length), the last being the capacity."""
    import numpy as np

    n = np.zeros(capacity + 1)
    for length, k in histogram.items():
        n[min(length, capacity)] += k
    count, total = np.cumsum(n), np.cumsum(n * np.arange(capacity + 1))
    best = np.arange(capacity + 1) * count - total  # one bucket (0, j]
    back = np.full((buckets, capacity + 1), -1)  # -1: this many buckets are no better than one less
    for b in range(1, buckets):
        new = best.copy()
        for j in range(1, capacity + 1):
            cost = best[:j] + j * (count[j] - count[:j]) - (total[j] - total[:j])
            i = int(np.argmin(cost))
            if cost[i] < new[j]:
                new[j], back[b, j] = cost[i], i
        best = new
    out, j = [], capacity
    for b in range(buckets - 1, -1, -1):
        if b and back[b, j] < 0:
            continue
        out.append(j)
        j = int(back[b, j]) if b else 0
        if not j:
            break
    return sorted(out)


class _Open:
    """Open containers by free tokens; the tightest that an item fits is taken."""

    def __init__(self, capacity: int) -> None:
        self.room: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.free: list[int] = []  # sorted free sizes that have containers

    def take(self, n: int) -> tuple[int, int] | None:
        """(container, its free tokens) with the least room for ``n``; it's open no more."""
        i = bisect.bisect_left(self.free, n)
        if i == len(self.free):
            return None
        f = self.free[i]
        c = self.room[f].pop()
        if not self.room[f]:
            self.free.pop(i)
        return c, f

    def put(self, c: int, free: int) -> None:
        if free:
            if not self.room[free]:
                bisect.insort(self.free, free)
            self.room[free].append(c)


def pack_shard(items: list[tuple[int, int]], capacity: int, tops: list[int]) -> list[int]:
    """Container number of each (order key, length) item; lengths are at most the capacity."""
    by_bucket: dict[int, list[int]] = {}
    for k, (_, n) in enumerate(items):
        by_bucket.setdefault(bisect.bisect_left(tops, n), []).append(k)
    where = [0] * len(items)
    left = _Open(capacity)  # what longer buckets left free
    made = 0
    for b in sorted(by_bucket, reverse=True):
        own = _Open(capacity)
        for k in sorted(by_bucket[b], key=lambda k: (-items[k][1], items[k][0])):
            n = items[k][1]
            for batches in (left, own):
                if got := batches.take(n):
                    where[k] = got[0]
                    batches.put(got[0], got[1] - n)
                    break
            else:
                where[k] = made
                own.put(made, capacity - n)
                made += 1
        for f in own.free:
            for c in own.room[f]:
                left.put(c, f)
    return where


def fill_containers(lengths: DataFrame, capacity: int, buckets: int = BUCKETS) -> DataFrame:
    """(container_id, id, part_no, token_from, n_tokens, bucket_top) for (id, n_tokens) rows.

    ``container_id`` is shard-container; part_no counts the parts of an item, from 1.
    """
    kind = lengths.schema["id"].dataType.simpleString()
    lengths = lengths.where("n_tokens > 0")
    # the histogram has at most ``capacity`` rows: whole containers cut from long items need no packing
    rows = lengths.groupBy((F.col("n_tokens") % capacity).alias("rest")).agg(F.count("*").alias("n")).collect()
    tops = boundaries({int(r["rest"]): int(r["n"]) for r in rows if r["rest"]}, capacity, buckets)
    shards = max(1, -(-sum(int(r["n"]) for r in rows) // SHARD))
    cut = lengths.select(
        "id",
        F.explode(F.transform(F.sequence(F.lit(0), F.floor((F.col("n_tokens") - 1) / capacity)), lambda p: F.struct((p + 1).cast("int").alias("part_no"), (p * capacity).alias("token_from"), F.least(F.lit(capacity), F.col("n_tokens") - p * capacity).alias("n_tokens")))).alias("p"),
    ).select("id", "p.part_no", "p.token_from", "p.n_tokens")
    full = cut.where(F.col("n_tokens") == capacity).select(F.concat(F.lit("f-"), F.col("id").cast("string"), F.lit("-"), F.col("part_no").cast("string")).alias("container_id"), "id", "part_no", "token_from", "n_tokens", F.lit(capacity).alias("bucket_top"))
    rest = cut.where(F.col("n_tokens") < capacity).withColumn("shard", F.pmod(F.xxhash64("id", "part_no"), F.lit(shards)))
    rest = rest.repartition(shards, "shard").sortWithinPartitions("shard", "id", "part_no")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def done() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            ids, part, frm, n = (pa.concat_arrays([h.column(i) for h in held]) for i in range(4))
            sizes = n.to_pylist()
            where = pack_shard(list(enumerate(sizes)), capacity, tops)
            yield pa.RecordBatch.from_arrays(
                [pa.array([f"{now}-{c}" for c in where]), ids, part, frm, n, pa.array([tops[bisect.bisect_left(tops, s)] for s in sizes], pa.int32())],
                ["container_id", "id", "part_no", "token_from", "n_tokens", "bucket_top"],
            )

        for b in batches:
            shard = b.column(4).to_pylist()
            at = 0
            while at < len(shard):
                if shard[at] != now:
                    yield from done()
                    now, held = shard[at], []
                to = bisect.bisect_right(shard, now, at)
                held.append(b.slice(at, to - at))
                at = to
        yield from done()

    packed = rest.mapInArrow(run, f"container_id string, id {kind}, part_no int, token_from bigint, n_tokens bigint, bucket_top int")
    return full.unionByName(packed)


def fill_report(packed: DataFrame, capacity: int) -> DataFrame:
    """One row: containers, tokens and the share of the capacity that is used."""
    return packed.agg(F.countDistinct("container_id").alias("n_containers"), F.count("*").alias("n_parts"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n_tokens")).withColumn("fill", F.col("n_tokens") / F.nullif(F.col("n_containers") * capacity, F.lit(0)))


def bucket_report(packed: DataFrame) -> DataFrame:
    """(bucket_top, n_parts, n_tokens, padding, padding_share) of each bucket: what padding every item to its top would add."""
    per = packed.groupBy("bucket_top").agg(F.count("*").alias("n_parts"), F.sum("n_tokens").alias("n_tokens"), F.sum(F.col("bucket_top") - F.col("n_tokens")).alias("padding"))
    return per.withColumn("padding_share", F.col("padding") / (F.col("n_tokens") + F.col("padding")))
