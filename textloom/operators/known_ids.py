"""Known ids by source as bitmaps: built in parts, merged over snapshots, asked for membership.

Whole numbers up to 2^31 are bits, 32,768 to a row; other ids stay texts.  A bitmap row takes
4 KB whatever it holds, and bitmaps of many snapshots merge by OR in one grouping.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _number(value: Column, hexadecimal: Column | None = None) -> Column:
    """The number of an id in its one spelling, null for other ids."""
    plain = F.when(value.rlike("^(?:0|[1-9][0-9]{0,8})$"), value.cast("long"))
    if hexadecimal is None:
        return plain
    return F.when(hexadecimal, F.when(value.rlike("^[0-9A-F]{2,7}$"), F.conv(value, 16, 10).cast("long"))).otherwise(plain)


def known_ids(docs: DataFrame, by: tuple[str, ...] = ("source",), value: str = "id") -> DataFrame:
    """by, bucket, bits and text: a row for each bucket of numbers, and one for each other id (as text, without bucket)."""
    ids = docs.filter(F.col(value).isNotNull()).select(*by, F.col(value).cast("string").alias("_id"))
    ids = ids.withColumn("_number", _number(F.col("_id")))
    numbers = ids.filter("_number is not null")
    bits = numbers.groupBy(*by, F.bitmap_bucket_number("_number").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_number")).alias("bits"))
    others = ids.filter("_number is null").select(*by, "_id").distinct()
    return bits.withColumn("text", F.lit(None).cast("string")).unionByName(others.select(*by, F.lit(None).cast("long").alias("bucket"), F.lit(None).cast("binary").alias("bits"), F.col("_id").alias("text")))


def merged(known: DataFrame, by: tuple[str, ...] = ("source",)) -> DataFrame:
    """Known ids over all other columns, such as snapshots: bitmaps by OR."""
    bits = known.filter("bucket is not null").groupBy(*by, "bucket").agg(F.bitmap_or_agg("bits").alias("bits")).withColumn("text", F.lit(None).cast("string"))
    others = known.filter("bucket is null").select(*by, "text").distinct()
    return bits.unionByName(others.select(*by, F.lit(None).cast("long").alias("bucket"), F.lit(None).cast("binary").alias("bits"), "text"))


def counts(known: DataFrame, by: tuple[str, ...] = ("source",)) -> DataFrame:
    """by and the number of known ids."""
    return known.groupBy(*by).agg((F.sum(F.coalesce(F.bitmap_count("bits"), F.lit(0))) + F.count("text")).alias("ids"))


def _has_bit(bits: Column, position: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, (F.floor(position / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.call_function("getbit", byte, (position % 8).cast("int")) == 1


def only_known(rows: DataFrame, known: DataFrame, source: str = "source", value: str = "id", wanted: bool = True) -> DataFrame:
    """Rows whose source knows their id; or, if not wanted, those that it does not.

    One bitmap row answers for all ids of its bucket, so a source with most ids is joined by bucket, not as one key.
    """
    full = rows.withColumn("_number", _number(F.col(value).cast("string")))
    full = full.withColumns({"_bucket": F.when(F.col("_number").isNotNull(), F.bitmap_bucket_number("_number")), "_text": F.when(F.col("_number").isNull(), F.col(value).cast("string"))})
    bits = known.filter("bucket is not null").select(F.col("source").alias("_s"), F.col("bucket").alias("_b"), F.col("bits").alias("_bits"))
    texts = known.filter("bucket is null").select(F.col("source").alias("_s"), F.col("text").alias("_t"))
    full = full.join(bits, (F.col(source) == F.col("_s")) & (F.col("_bucket") == F.col("_b")), "left").drop("_s")
    full = full.join(texts, (F.col(source) == F.col("_s")) & (F.col("_text") == F.col("_t")), "left")
    found = F.coalesce(_has_bit(F.col("_bits"), F.bitmap_bit_position("_number")), F.lit(False)) | F.col("_t").isNotNull()
    return full.filter(found if wanted else ~found).select(*rows.columns)
