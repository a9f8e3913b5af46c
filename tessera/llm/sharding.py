"""Global shuffle into shards: a two-pass external shuffle, in DataFrame operations alone.

Pass one scatters whole records uniformly into buckets that fit in memory, by a seeded hash of the record and, where a record
is repeated, of the copy's number. Pass two takes each bucket as one array, puts it in order of that hash and permutes
it with Fisher-Yates (Spark's ``shuffle``). A record's place in the whole order is its bucket's offset (a running sum
of bucket counts) plus its place in the bucket; shards take places in turn, so their row counts differ by one at most
(law ``rows``) and slots have no gaps.

A seed names one order of the same rows, however they come partitioned: a bucket is a partition, and ``shuffle`` draws by
seed and partition. Equal records (found by digests) are counted before they move, and dealt again in blocks of copies, so neither an
id nor a record that a third of all rows share is one key. Buckets are sized by bytes, from the records' mean.

The permuted buckets are written to the shared folder before anything is derived from them: a lost executor's task
is redone as a whole, and no reader sees two different permutations.

Nulls, in any column, are values like others. Repeated rows keep their number. An empty table gives no rows. Texts travel
whole, however long. Ties of the hash are broken by the record itself. Column names may be any, repeated ones excepted.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import stash

SEED = 20_240_601
BUCKET_BYTES = 32_000_000
COPY_BLOCK = 4096
BROADCAST_ROWS = 1_000_000


def _bytes_of(records: DataFrame):
    """About how many bytes a record takes."""
    wide = [f.name for f in records.schema.fields if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    sizes = [F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0)).cast("long") for c in wide]
    return sum(sizes, F.lit(16 * len(records.columns)).cast("long"))


def _small(table: DataFrame, rows: int) -> DataFrame:
    """A side of a join, broadcast where its counted rows (of two or three numbers) are few, else merged."""
    return F.broadcast(table) if rows <= BROADCAST_ROWS else table.hint("merge")


def shuffle_buckets(records: DataFrame, bucket_bytes: int = BUCKET_BYTES, seed: int = SEED) -> DataFrame:
    """``(bucket, place, record)``: every row of ``records`` as a struct, permuted within its bucket. Written once."""
    total = records.agg(F.sum(_bytes_of(records))).first()[0] or 0
    buckets = max(1, math.ceil(total / bucket_bytes))
    record = F.struct(*[F.col(f"`{c}`") for c in records.columns]).alias("record")
    marked = records.select(record).select("record", F.xxhash64("record", F.lit(1)).alias("d1"), F.xxhash64("record", F.lit(2)).alias("d2"))
    # Only records whose digest is repeated are gathered and counted; the others move once, to their bucket.
    repeated = stash(marked.groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("d1", "d2"), "repeated")
    side = _small(repeated, repeated.count())
    counted = marked.join(side, ["d1", "d2"], "left_semi").groupBy("record").agg(F.count(F.lit(1)).alias("copies"))
    # blocks of copies first, then copies: no task makes more than some thousands out of one row
    blocks = counted.select("record", "copies", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / F.lit(COPY_BLOCK)))).alias("block"))
    first = F.col("block") * F.lit(COPY_BLOCK)
    copies = blocks.select("record", F.explode(F.sequence(first, F.least(first + F.lit(COPY_BLOCK), F.col("copies")) - 1)).alias("copy"))
    copies = marked.join(side, ["d1", "d2"], "left_anti").select("record", F.lit(0).cast("long").alias("copy")).unionByName(copies)
    keyed = copies.select(F.xxhash64("record", "copy", F.lit(seed)).alias("key"), "copy", "record")
    scattered = keyed.select(F.pmod("key", F.lit(buckets)).cast("int").alias("bucket"), "key", "copy", "record").repartitionById(buckets, "bucket")
    whole = scattered.groupBy("bucket").agg(F.array_sort(F.collect_list(F.struct("key", "copy", "record"))).alias("rows"))
    permuted = whole.select("bucket", F.shuffle(F.transform("rows", lambda r: r["record"]), F.lit(seed)).alias("records"))
    return stash(permuted.select("bucket", F.posexplode("records").alias("place", "record")), "shuffled")


def shuffle_into_shards(records: DataFrame, shards: int = 8, bucket_bytes: int = BUCKET_BYTES, seed: int = SEED) -> DataFrame:
    """Every row of ``records`` with ``record`` (its columns as a struct), ``shard`` and a gapless ``slot``."""
    placed = shuffle_buckets(records, bucket_bytes, seed)
    counts = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row a bucket
    offsets = stash(counts.select(F.col("bucket").alias("b"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")), "offsets")
    at = F.col("offset") + F.col("place")
    joined = placed.join(_small(offsets, offsets.count()), F.col("bucket") == F.col("b"))
    return joined.select("record", F.pmod(at, F.lit(shards)).cast("int").alias("shard"), F.floor(at / F.lit(shards)).cast("long").alias("slot"))


def write_shards(records: DataFrame, path: str, shards: int = 8, bucket_bytes: int = BUCKET_BYTES, seed: int = SEED, file_rows: int = 100_000) -> None:
    """Write whole records in shuffled order, one folder a shard (``shard=N``), sorted by slot within a file."""
    sharded = shuffle_into_shards(records, shards, bucket_bytes, seed)
    sharded.repartition("shard", F.floor(F.col("slot") / F.lit(file_rows))).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def query(spark, sf_dir: str) -> DataFrame:
    """All documents dealt, texts and all, into shards 0 to 7 under the law ``rows``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = shuffle_into_shards(docs.select("doc_id", "text"))
    text = F.coalesce(F.col("record.text"), F.lit(""))
    return out.select("record.doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
