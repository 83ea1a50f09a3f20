"""Operator 1: sharding by extendible hashing, with DataFrame operations only.

A row's key hashes to 60 bits. The directory is indexed by the leading bits; a bucket of more than the byte limit
splits on one more bit, and only that bucket, so a row's shard is the shortest prefix of its hash whose bucket fits.
All the depths of a round come from one pre-aggregated histogram of `bits` bits: rows are read once, and the shuffle
has at most one row for each task and prefix. Buckets that are still too large after a round go on with the next bits,
no more of them than the largest needs.

Defined cases: a null text has 0 bytes; a null key hashes like the empty text; a row that alone exceeds the limit
is a shard of its own. Rows with one and the same hash (a key that holds many rows) can't be told apart by more bits;
then they are split by a hash of the whole row, and exact copies of a row are dealt out by number, so
every shard fits whatever the keys are. An empty table gives no rows. Columns beside key and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowage.llm.common import cut, drop

HASH_BITS = 60


def hash60(text: Column) -> Column:
    """The first 15 hexadecimal digits of MD5, as a number."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def _round(cells: DataFrame, low: int, bits: int, limit: int) -> DataFrame:
    """(root, cell, s) with s = (depth, prefix, shard_bytes, shard_rows) for cells that a bucket of depth low..low +
    bits takes; others are left out.

    cells: root (the bucket that is being split), cell (the next `bits` bits), b, n.
    """
    by_depth = cells.withColumn(
        "up", F.explode(F.sequence(F.lit(0), F.lit(bits)))
    ).withColumn("prefix", F.expr("shiftright(cell, up)"))
    buckets = cut(
        by_depth.groupBy("root", "up", "prefix").agg(F.sum("b").alias("b"), F.sum("n").alias("n")), "shard-buckets"
    )
    fits = buckets.filter((F.col("b") <= limit) | (F.col("n") == 1))
    parents = fits.select(
        "root",
        (F.col("up") - 1).alias("up"),
        F.explode(F.array(F.col("prefix") * 2, F.col("prefix") * 2 + 1)).alias("prefix"),
    )
    shards = cut(
        fits.join(parents, ["root", "up", "prefix"], "left_anti").select(
            "root",
            "up",
            "prefix",
            F.struct(
                (F.lit(low + bits) - F.col("up")).alias("depth"),
                "prefix",
                F.col("b").alias("shard_bytes"),
                F.col("n").alias("shard_rows"),
            ).alias("s"),
        ),
        "shards",
    )
    # no depth above the shallowest shard is asked for: its few prefixes would bring all cells together
    highest = shards.agg(F.coalesce(F.max("up"), F.lit(-1))).first()[0]
    return by_depth.filter(F.col("up") <= highest).select("root", "up", "prefix", "cell").join(
        shards, ["root", "up", "prefix"]
    ).select("root", "cell", "s")


def assign_shards(df: DataFrame, key: str, text: str, limit: int, bits: int = 20) -> DataFrame:
    """key, n_bytes, shard_depth, shard_prefix, shard_bytes, shard_rows, shard_part for each row of df.

    shard_part is 0 but where copies of one and the same row had to be dealt out by number.
    """
    if limit < 1 or not 1 <= bits <= 24:
        raise ValueError("limit must be positive and bits between 1 and 24")
    name = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    base = df.select(
        F.col(key).alias("id"),
        F.octet_length(name(F.col(text))).cast("long").alias("n_bytes"),
        hash60(name(F.col(key))).alias("h"),
        F.xxhash64(F.col(key), F.col(text)).alias("whole"),
    )
    rows, done = cut(base.withColumn("root", F.lit("")), "shard-rows"), None
    low, rehashed, wish = 0, False, bits
    while True:
        step = min(wish, HASH_BITS - low)
        shift = HASH_BITS - low - step
        cell = F.shiftright("h", shift)
        cells = cut(
            rows.groupBy("root", cell.alias("cell")).agg(
                F.sum("n_bytes").alias("b"), F.count(F.lit(1)).alias("n"), (F.min("h") == F.max("h")).alias("one_hash")
            ),
            "shard-cells",
        )
        found = cut(_round(cells, low, step, limit), "shard-directory")
        joined = rows.withColumn("cell", cell).join(found, ["root", "cell"], "left")
        put = joined.filter(F.col("s").isNotNull()).select(
            "id",
            "n_bytes",
            F.col("s.depth").alias("shard_depth"),
            F.concat(
                "root", F.lpad(F.conv(F.col("s.prefix").cast("string"), 10, 2), F.col("s.depth"), F.lit("0"))
            ).alias("shard_prefix"),
            F.col("s.shard_bytes").alias("shard_bytes"),
            F.col("s.shard_rows").alias("shard_rows"),
            F.lit(0).cast("long").alias("shard_part"),
        )
        done = put if done is None else done.unionByName(put)
        if found.count() == cells.count():
            return _named(done, key)
        left = joined.filter(F.col("s").isNull()).select("id", "n_bytes", "h", "whole", "root")
        low += step
        # the next round asks for the bits that its largest bucket needs, as its rows would soon be cells of their own;
        # where all that is left are buckets of one hash, more bits don't help
        rest = cells.join(found.select("root", "cell"), ["root", "cell"], "left_anti")
        most, one_hash = rest.agg(F.max("b"), F.bool_and("one_hash")).first()
        wish = min(bits, (most // limit).bit_length() + 2)
        if one_hash:
            low = HASH_BITS
        if low == HASH_BITS:
            if rehashed:
                return _named(done.unionByName(_numbered(cut(left, "shard-copies"), limit)), key)
            # one hash, too many bytes: go on with the bits of the whole row
            left = left.withColumn(
                "root", F.concat("root", F.lpad(F.conv(F.col("h").cast("string"), 10, 2), HASH_BITS, "0"), F.lit("/"))
            ).withColumn("h", hash60(F.col("whole").cast("string")))
            low, rehashed = 0, True
        drop(cells)
        rows = cut(left, "shard-rows")


def _named(done: DataFrame, key: str) -> DataFrame:
    return done.withColumnRenamed("id", key)


def _numbered(rows: DataFrame, limit: int) -> DataFrame:
    """Deals copies of the same row out by number: the copies are counted first and then made anew, run by run."""
    kinds = rows.groupBy("id", "n_bytes", "root", "h", "whole").agg(F.count(F.lit(1)).alias("n"))
    each = F.greatest(
        F.lit(1).cast("long"), F.floor(F.lit(limit) / F.greatest(F.col("n_bytes"), F.lit(1))).cast("long")
    )
    runs = kinds.withColumn("each", each).withColumn(
        "shard_part", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(n - 1) div each")))
    )
    runs = runs.withColumn(
        "shard_rows", F.least(F.col("each"), F.col("n") - F.col("shard_part") * F.col("each"))
    ).repartition("whole", "shard_part")
    made = runs.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("shard_rows"))))
    return made.select(
        "id",
        "n_bytes",
        F.lit(HASH_BITS).alias("shard_depth"),
        F.concat("root", F.lpad(F.conv(F.col("h").cast("string"), 10, 2), HASH_BITS, "0")).alias("shard_prefix"),
        (F.col("n_bytes") * F.col("shard_rows")).alias("shard_bytes"),
        "shard_rows",
        "shard_part",
    )


def directory(assigned: DataFrame) -> DataFrame:
    """One row for each shard: depth, prefix, part, bytes, rows."""
    return assigned.groupBy("shard_depth", "shard_prefix", "shard_part").agg(
        F.max("shard_bytes").alias("shard_bytes"), F.max("shard_rows").alias("shard_rows")
    )
