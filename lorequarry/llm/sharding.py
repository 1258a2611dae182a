"""Sharding by a two-pass external shuffle.

Pass one scatters records uniformly into buckets of a size that fits a task's memory,
by a seeded hash. Pass two puts each bucket into a canonical order and shuffles it by
Fisher-Yates with a generator seeded by (seed, bucket). The buckets one after another
are a random permutation of the table; shards are equal slices of it, so their row
counts differ by at most one (law ``rows``).

A bucket's place in the permutation is the number of rows in the buckets before it.
Buckets are counted by aggregation and summed up in two levels, GROUP buckets at a time,
and each place travels to its bucket as the first row of it.

Defined results: the permutation depends only on the seed and the rows, not on how
the input was partitioned; null doc_ids and null texts are hashed like values; doc_id
may have any type; equal rows stay separate and take neighbouring turns; an empty table
gives no shard. Extra columns of any names travel along; the names bucket, shard and
slot are replaced. One bucket is held at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

SEED = 20_240_229
BUCKET_BYTES = 4 << 20
#: Buckets that one task takes, at most about.
BUCKETS_PER_TASK = 32
GROUP = 4096


def fisher_yates(n: int, seed: int, bucket: int) -> np.ndarray:
    """A permutation of range(n): swap each place, from the last on, with a random place up to it."""
    rng = np.random.Generator(np.random.Philox(key=np.array([seed, bucket], np.uint64)))
    picks = (rng.random(max(n - 1, 0)) * np.arange(n, 1, -1)).astype(np.int64).tolist()
    order = list(range(n))
    for k, j in zip(range(n - 1, 0, -1), picks):
        order[k], order[j] = order[j], order[k]
    return np.array(order, np.int64)


def _shuffle_batches(batches, seed, total, shards):
    """Rows come bucket by bucket in canonical order; the first of each has its place in _offset."""
    held: list[pa.RecordBatch] = []
    current = None

    def finish():
        table = pa.Table.from_batches(held)
        first, table = table.column("_offset")[0].as_py(), table.slice(1)
        n = table.num_rows
        place = first + np.arange(n, dtype=np.int64)
        # slices whose sizes differ by at most one: the first ``more`` have one row more
        size, more = divmod(total, shards)
        cut = more * (size + 1)
        shard = np.where(place < cut, place // (size + 1), more + (place - cut) // max(size, 1))
        begin = np.where(shard < more, shard * (size + 1), cut + (shard - more) * size)
        out = table.select([common.KEEP]).take(pa.array(fisher_yates(n, seed, current)))
        out = out.append_column("bucket", pa.array(np.full(n, current), pa.int64())).append_column("shard", pa.array(shard, pa.int32())).append_column("slot", pa.array(place - begin, pa.int64()))
        yield from out.to_batches(max_chunksize=common.BATCH_ROWS)

    for batch in batches:
        while batch.num_rows:
            buckets = batch.column("_bucket").to_numpy(zero_copy_only=False)
            if held and buckets[0] != current:
                yield from finish()
                held = []
            current = int(buckets[0])
            n = int(np.searchsorted(buckets, current, side="right"))
            held.append(batch.slice(0, n))
            batch = batch.slice(n)
    if held:
        yield from finish()


def _offsets(counts: DataFrame) -> DataFrame:
    """(_bucket, _offset) from (_bucket, n): rows in all buckets before."""
    counts = counts.withColumn("_group", F.floor(F.col("_bucket") / GROUP))
    groups = counts.groupBy("_group").agg(F.sum("n").alias("n"))
    before = F.sum("n").over(Window.orderBy("_group").rowsBetween(Window.unboundedPreceding, -1))  # a row for GROUP buckets
    groups = groups.select("_group", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.sum("n").over(Window.partitionBy("_group").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    return counts.withColumn("_inside", F.coalesce(inside, F.lit(0))).join(groups, "_group").select("_bucket", (F.col("_before") + F.col("_inside")).alias("_offset"))


def shuffle(docs: DataFrame, shards: int, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Every row with its ``bucket``, ``shard`` and ``slot``, a row's place in its shard from 0."""
    spark = docs.sparkSession
    kept, names = common.packed(docs, docs.columns, ("bucket", "shard", "slot"))
    columns = [F.coalesce(docs[common.quoted(c)].cast("string"), F.lit("\x00")) for c in names]
    turns = [F.xxhash64(F.lit(seed + k), *columns).alias(f"_turn{k}") for k in (0, 2)]
    totals = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64).alias("bytes"), F.count("*").alias("rows")).first()
    buckets = max(1, -(-int(totals["bytes"] or 0) // bucket_bytes))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-buckets // BUCKETS_PER_TASK))
    bucket = F.pmod(F.xxhash64("_turn0", F.lit(seed + 1)), F.lit(buckets).cast("bigint"))
    dealt = docs.select(kept, *turns).withColumn("_bucket", bucket).withColumn("_offset", F.lit(None).cast("bigint"))
    heads = _offsets(dealt.groupBy("_bucket").agg(F.count("*").alias("n")))
    rows = dealt.unionByName(heads, allowMissingColumns=True).repartition(tasks, "_bucket").sortWithinPartitions("_bucket", F.col("_offset").asc_nulls_last(), "_turn0", "_turn2")
    rows = rows.select(common.KEEP, "_bucket", "_offset")
    out = common.arrow_map(rows, f"{__name__}:_shuffle_batches", common.schema_of(rows, [common.KEEP], "bucket bigint, shard int, slot bigint"), seed=seed, total=totals["rows"], shards=shards)
    return common.unpacked(out, names, "bucket", "shard", "slot")


def write_shards(docs: DataFrame, shards: int, folder: str, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Write the shuffled rows as Parquet, a folder a shard, and return the written table.

    Within a shard the order is ``slot``; every file holds whole buckets or slices of them.
    """
    spark = docs.sparkSession
    out = shuffle(docs, shards, seed, bucket_bytes)
    out.write.partitionBy("shard").parquet(folder)
    return spark.read.schema(out.schema).parquet(folder)
