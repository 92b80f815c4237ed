"""What the operators share: which columns they take, and how rows are named inside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Inside an operator a null id counts as this one, so it sorts last; results show null again.
NULL_ID = 2**63 - 1
#: ASCII white space, the separators of words, and a run of anything else.
WHITE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: A key is hot if it has this fraction of the rows, or more.
HOT = 1000


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(k, text): the only columns that operators on texts read, under names that clash with none."""
    return docs.select(F.coalesce(docs[id_col].cast("bigint"), F.lit(NULL_ID)).alias("k"), docs[text_col].cast("string").alias("text"))


def shown(k: Column | str = "k") -> Column:
    """The id as the caller gave it."""
    k = F.col(k) if isinstance(k, str) else k
    return F.when(k != NULL_ID, k)


def spread(rows: DataFrame, found: DataFrame, key: str, by: str) -> DataFrame:
    """``rows`` joined to ``found``, which has one row a ``key``, without bringing all rows of a key to one task.

    Rows are dealt by the key and a part of the hash of ``by``. Only the distinct pairs of key and part meet ``found``, so a key that a third
    of all rows have is as many rows there as there are parts.
    """
    parted = rows.withColumn("__part", F.pmod(F.xxhash64(by), F.lit(partitions(rows))).cast("int"))
    pairs = parted.select(key, "__part").distinct().join(found, key)
    return parted.join(pairs, [key, "__part"]).drop("__part")


def sifted(rows: DataFrame, found: DataFrame, key: str, bits: int) -> DataFrame:
    """``rows`` without most of those whose ``key`` is not in ``found``, and with all of those whose key is.

    The keys' hashes are a bitmap of ``bits`` bits, whatever the tables' size, in rows of 32,768 that are broadcast; so what is dropped is never shuffled.
    """
    spot = F.pmod(F.xxhash64(key), F.lit(bits)) + 1
    maps = found.select(spot.alias("spot")).groupBy(F.bitmap_bucket_number("spot").alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("spot")).alias("__bits"))
    at = F.bitmap_bit_position(spot).cast("int")
    byte = F.conv(F.hex(F.substring("__bits", F.shiftright(at, 3) + 1, 1)), 16, 10).cast("int")
    met = rows.withColumn("__bucket", F.bitmap_bucket_number(spot)).join(F.broadcast(maps), "__bucket")
    return met.where(byte.bitwiseAND(F.pow(F.lit(2), at % 8).cast("int")) != 0).drop("__bucket", "__bits")


def dealt(rows: DataFrame, found: DataFrame, key: str, by: Column | str, count: str) -> DataFrame:
    """Like ``spread`` where ``found`` knows in ``count`` how many rows have a key: ``rows`` is read once.

    Keys of at least one row in ``HOT`` of all that have a key here, of which there can be no more than that, are broadcast and their rows
    dealt by the hash of ``by``; all others meet by the key.
    """
    parts, total = partitions(rows), found.agg(F.sum(count)).first()[0] or 0
    hot = F.col(count) * HOT >= total
    parted = rows.join(F.broadcast(found.where(hot).select(key, F.lit(True).alias("__hot"))), key, "left")
    parted = parted.withColumn("__part", F.when(F.col("__hot"), F.pmod(F.xxhash64(by), F.lit(parts))).otherwise(0).cast("int")).drop("__hot")
    pairs = found.withColumn("__part", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0))))).drop(count)
    return parted.join(pairs.hint("merge"), [key, "__part"]).drop("__part")


def partitions(df: DataFrame) -> int:
    """Partitions that shuffles get in this session."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
