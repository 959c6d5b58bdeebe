"""Two-pass external shuffle, in DataFrame functions only.

Pass one scatters whole records uniformly into memory-sized buckets by a seeded hash; pass two puts each bucket into a fixed
order, Fisher-Yates shuffles it (Spark's seeded `shuffle`) and writes it.  Buckets follow each other, so record p of all n
goes to shard k with k * n / S <= p < (k + 1) * n / S, and row counts differ by one at most (law `rows`).

Texts move once, from their place to their bucket.  A bucket holds about `bucket_bytes` whatever keys and texts there
are: its number comes from a hash of the whole record and of the record's copy number, so equal texts, and equal records too,
spread.  Copy numbers are given out from the table of digests; only records that do occur again are joined with it.
A task takes up to TASK_BUCKETS buckets in a row.  Bucket, order within it, partition and seed depend on the rows and settings
only; a lost executor's buckets come out the same.

Defined cases: nulls are values like any other; repeated rows keep their number; an empty table gives an empty result; where the
records have a column of the same name, shard, slot and position get underscores behind theirs (`free_name`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

from gridspark.llm.common import as_struct, materialize, parts_for, running, scratch

BUCKET_BYTES, TASK_BUCKETS, SEED = 4_000_000, 32, 20240607


def free_name(name: str, taken: list[str]) -> str:
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name


def _digest(records: DataFrame) -> list[Column]:
    """Two 64-bit hashes of all columns; columns that can't be hashed go by their JSON."""
    cols = [F.col(f"`{f.name}`") if "map<" not in f.dataType.simpleString() else F.to_json(F.struct(f"`{f.name}`")) for f in records.schema]
    nulls = [F.col(f"`{c}`").isNull() for c in records.columns]  # a null counts by its place
    return [F.xxhash64(F.lit(i), *cols, *nulls).alias(h) for i, h in enumerate(("h1", "h2"))]


def _bytes(records: DataFrame) -> Column:
    out = F.lit(0).cast("long")
    for f in records.schema:
        c = F.col(f"`{f.name}`")
        size = F.octet_length(c) if isinstance(f.dataType, StringType | BinaryType) else F.lit(8) if "<" not in f.dataType.simpleString() else F.octet_length(F.to_json(F.struct(c)))
        out = out + F.coalesce(size, F.lit(0)) + 8
    return out


def placed(records: DataFrame, bucket_bytes: int = BUCKET_BYTES, seed: int = SEED) -> tuple[DataFrame, int]:
    """((doc, position), n): every record as a struct, and its place in a random permutation of 0 .. n-1."""
    digests = materialize(records.select(*_digest(records), _bytes(records).alias("bytes")), "digests")
    n, total = digests.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    buckets = max(1, -(-total // bucket_bytes))
    each = max(1, min(TASK_BUCKETS, -(-buckets // parts_for(records.sparkSession))))
    again = materialize(digests.groupBy("h1", "h2").agg(F.count("*").alias("copies")).where("copies > 1"), "again")
    copies = F.sequence(F.lit(1).cast("long"), F.col("copies"))

    def numbered(rows: DataFrame, *names: str) -> DataFrame:
        """rows with their copy numbers: 0 for what occurs once, 1, 2 .. else."""
        once = rows.join(again, ["h1", "h2"], "left_anti").select(*names, "h1", "h2", F.lit(0).cast("long").alias("copy"))
        more = rows.join(again, ["h1", "h2"]).dropDuplicates(["h1", "h2"]).select(*names, "h1", "h2", F.explode(copies).alias("copy"))
        bucket = F.pmod(F.xxhash64(F.lit(seed), "h1", "h2", "copy"), F.lit(buckets)).cast("long").alias("bucket")
        return once.unionByName(more).select("*", bucket)

    sizes = numbered(digests).groupBy("bucket").agg(F.count("*").alias("rows"))
    firsts = running(sizes, [], "bucket", "rows", "first").select("bucket", "first")
    h1, h2 = _digest(records)
    rows = numbered(as_struct(records, h1=h1, h2=h2), "doc").select("bucket", F.struct("h1", "h2", "copy", "doc").alias("row"))
    both = rows.unionByName(firsts, allowMissingColumns=True).withColumn("task", F.expr(f"cast(bucket div {each} as int)"))
    order = lambda x, y: F.when(x < y, -1).when(x > y, 1)
    fixed = lambda l: F.array_sort(l, lambda x, y: F.coalesce(order(x["h1"], y["h1"]), order(x["h2"], y["h2"]), order(x["copy"], y["copy"]), F.lit(0)))
    gathered = both.repartitionById(-(-buckets // each), "task").groupBy("task", "bucket").agg(F.max("first").alias("first"), F.collect_list("row").alias("rows"))
    shuffled = gathered.sortWithinPartitions("bucket").select("first", F.shuffle(fixed(F.col("rows")), F.lit(seed)).alias("rows"))
    out = shuffled.select("first", F.posexplode("rows").alias("at", "row")).select(F.col("row.doc").alias("doc"), (F.col("first") + F.col("at")).alias("position"))
    return out, int(n)


def shuffled(records: DataFrame, bucket_bytes: int = BUCKET_BYTES, seed: int = SEED) -> DataFrame:
    """records with `position`, a random permutation of 0 .. n-1."""
    out, _ = placed(records, bucket_bytes, seed)
    return out.select("doc.*", F.col("position").alias(free_name("position", records.columns)))


def sharded(records: DataFrame, shards: int, bucket_bytes: int = BUCKET_BYTES, seed: int = SEED) -> DataFrame:
    """records with shard (0 .. shards-1) and slot (gapless from 0 in each shard)."""
    out, n = placed(records, bucket_bytes, seed)
    shard = F.expr(f"cast(((position + 1) * {shards} - 1) div {max(1, n)} as int)")
    slot = F.col("position") - F.expr(f"(cast(_shard as bigint) * {n}) div {shards}")
    return out.withColumn("_shard", shard).select("doc.*", F.col("_shard").alias(free_name("shard", records.columns)), slot.alias(free_name("slot", records.columns)))


def write_shards(rows: DataFrame, path: str, shard: str = "shard", slot: str = "slot") -> None:
    """Write rows under shard=k/, in slot order within a file; a file holds one task's buckets."""
    rows.sortWithinPartitions(shard, slot).write.partitionBy(shard).option("compression", "zstd").parquet(path)


def stored_shards(rows: DataFrame, shard: str = "shard", slot: str = "slot") -> DataFrame:
    """rows, written as shards into the shared folder and read back."""
    path = scratch(rows.sparkSession, "shards")
    write_shards(rows, path, shard, slot)
    return rows.sparkSession.read.schema(rows.schema).parquet(path).select(*(f"`{c}`" for c in rows.columns))
