"""A bit filter of fixed size that keeps rows without a partner out of a shuffle."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 24


def likely_among(rows: DataFrame, key: Column, keys: DataFrame) -> DataFrame:
    """The rows with ``likely``: false only if the 64-bit ``key`` is surely not among ``keys`` (column key).

    The filter has 2 ** BITS bits as at most 512 rows of 4 KiB and is broadcast; its size is bound by its
    shape. With very many keys it fills up and more rows are likely. A null key is not likely.
    """
    cell = F.pmod("key", F.lit(1 << BITS))
    bits = keys.select(cell.alias("cell")).groupBy(F.shiftright("cell", 15).alias("__row")).agg(
        F.expr("bitmap_construct_agg(cell & 32767)").alias("__bits")
    )
    marked = rows.withColumn("__cell", F.pmod(key, F.lit(1 << BITS))).withColumn("__row", F.shiftright("__cell", 15))
    byte = F.conv(F.hex(F.expr("substring(__bits, cast((__cell & 32767) >> 3 AS int) + 1, 1)")), 16, 10).cast("int")
    bit = F.getbit(byte, F.col("__cell").bitwiseAND(F.lit(7)).cast("int"))
    return marked.join(F.broadcast(bits), "__row", "left").withColumn(
        "likely", F.coalesce(bit == 1, F.lit(False))
    ).drop("__row", "__cell", "__bits")
