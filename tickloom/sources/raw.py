"""Readers for captured market data: JSON lines and date-partitioned files."""

from __future__ import annotations

import re
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.operators.book import depth_features, top_of_book

_LEVELS = T.ArrayType(T.ArrayType(T.StringType()))

BOOK_SCHEMA = T.StructType(
    [
        T.StructField("timestamp", T.LongType()),
        T.StructField("event_time", T.LongType()),
        T.StructField("symbol", T.StringType()),
        T.StructField("first_update_id", T.LongType()),
        T.StructField("final_update_id", T.LongType()),
        T.StructField("bids", _LEVELS),
        T.StructField("asks", _LEVELS),
    ]
)

TRADE_SCHEMA = T.StructType(
    [
        T.StructField("timestamp", T.LongType()),
        T.StructField("event_time", T.LongType()),
        T.StructField("symbol", T.StringType()),
        T.StructField("trade_id", T.LongType()),
        T.StructField("price", T.StringType()),
        T.StructField("quantity", T.StringType()),
        T.StructField("buyer_order_id", T.LongType()),
        T.StructField("seller_order_id", T.LongType()),
        T.StructField("trade_time", T.LongType()),
        T.StructField("is_buyer_maker", T.BooleanType()),
    ]
)

AGG_TRADE_SCHEMA = T.StructType(
    [
        T.StructField("timestamp", T.LongType()),
        T.StructField("event_time", T.LongType()),
        T.StructField("symbol", T.StringType()),
        T.StructField("agg_trade_id", T.LongType()),
        T.StructField("price", T.StringType()),
        T.StructField("quantity", T.StringType()),
        T.StructField("first_trade_id", T.LongType()),
        T.StructField("last_trade_id", T.LongType()),
        T.StructField("trade_time", T.LongType()),
        T.StructField("is_buyer_maker", T.BooleanType()),
    ]
)

_CORRUPT = "_corrupt_record"


def parse_lines(lines: DataFrame, schema: T.StructType, column: str = "value") -> DataFrame:
    """Parse one JSON object per row; a bad line keeps its text in _corrupt_record."""
    wide = T.StructType([*schema.fields, T.StructField(_CORRUPT, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}
    return lines.select(F.from_json(F.trim(column), wide, options).alias("_r")).select("_r.*")


def read_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Read JSON-lines files with an explicit schema."""
    wide = T.StructType([*schema.fields, T.StructField(_CORRUPT, T.StringType())])
    return spark.read.schema(wide).option("mode", "PERMISSIVE").json(path)


def _levels(raw: str) -> Column:
    return F.transform(
        raw,
        lambda pair: F.struct(
            F.get(pair, F.lit(0)).try_cast("double").alias("price"),
            F.get(pair, F.lit(1)).try_cast("double").alias("qty"),
        ),
    )


def _usable(raw: str, n: int) -> Column:
    """The texts that are read, the first price and n quantities, are numbers."""

    def number(pair: Column, part: int) -> Column:
        return F.get(pair, F.lit(part)).try_cast("double").isNotNull()

    return number(F.get(raw, F.lit(0)), 0) & F.forall(F.slice(raw, 1, n), lambda pair: number(pair, 1))


def _once(df: DataFrame) -> DataFrame:
    """The same rows; what leads to their columns is computed once a row, as no filter is moved below a generator."""
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def book_rows(parsed: DataFrame) -> DataFrame:
    """Usable book rows with quote and depth features.

    Dropped are bad lines, rows with an empty side, and rows without a time or
    with text that is no number among the first 10 levels.
    """
    sided = _once(parsed).filter(
        (F.size("bids") > 0)
        & (F.size("asks") > 0)
        & F.col("timestamp").isNotNull()
        & F.col("event_time").isNotNull()
        & F.col(_CORRUPT).isNull()
        & _usable("bids", 10)
        & _usable("asks", 10)
    )
    typed = sided.withColumns({"bids": _levels("bids"), "asks": _levels("asks")})
    return depth_features(top_of_book(typed)).withColumn("ts", F.timestamp_millis("timestamp"))


def trade_rows(parsed: DataFrame) -> DataFrame:
    """Usable trades: every field present and numeric text in price and quantity."""
    typed = _once(parsed).withColumns(
        {
            "price": F.col("price").try_cast("double"),
            "quantity": F.col("quantity").try_cast("double"),
            "ts": F.timestamp_millis("timestamp"),
        }
    )
    needed = ["timestamp", "event_time", "trade_id", "price", "quantity", "is_buyer_maker"]
    good = F.col(_CORRUPT).isNull()
    for c in needed:
        good = good & F.col(c).isNotNull()
    return typed.filter(good).drop(_CORRUPT)


def rejects(parsed: DataFrame, kept: DataFrame) -> DataFrame:
    """Counts of lines read, kept and dropped."""
    marked = parsed.select(F.lit(0).alias("own")).unionByName(kept.select(F.lit(1).alias("own")))
    counted = marked.agg(F.count_if(F.col("own") == 0).alias("lines"), F.count_if(F.col("own") == 1).alias("kept"))
    return counted.withColumn("dropped", F.col("lines") - F.col("kept"))


# File names end in _YYYYmmdd_HHMMSS and hold the kind of data.
_DATED = r"(\d{4})(\d{2})(\d{2})_\d{6}"


def path_columns(path: Column) -> dict[str, Column]:
    """year, month, day and kind from a raw file name."""
    name = F.element_at(F.split(path, "/"), -1)
    kind = (
        F.when(F.contains(name, F.lit("orderbook")), "orderbook")
        .when(F.contains(name, F.lit("trade")), "trades")
        .otherwise("other")
    )

    def part(i: int) -> Column:
        return F.nullif(F.regexp_extract(name, _DATED, i), F.lit("")).cast("int")

    return {"year": part(1), "month": part(2), "day": part(3), "kind": kind}


# Folders of a day below the root. Where {kind} is in the layout it names the folder
# of a kind of data, else a file has it in its name.
LAYOUT = "%Y/%m/%d"


def day_folders(spark: SparkSession, root: str, first: str, last: str, layout: str = LAYOUT) -> dict[str, str]:
    """date -> folder for the dates of an inclusive range that have one; no other folder is looked at."""
    jvm = spark.sparkContext._jvm
    files = jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    day, end, found = date.fromisoformat(first), date.fromisoformat(last), {}
    while day <= end:
        folder = f"{root.rstrip('/')}/{day.strftime(layout)}"
        if files.exists(jvm.org.apache.hadoop.fs.Path(folder)):
            found[day.isoformat()] = folder
        day += timedelta(days=1)
    return found


def folder_day(path: Column, layout: str) -> Column:
    """The date in the path of a file, from the last place where the layout matches."""
    order = re.findall("%([Ymd])", layout)
    pattern = "".join(r"(\d{4})" if p == "%Y" else r"(\d{2})" if p in ("%m", "%d") else re.escape(p) for p in re.split("(%[Ymd])", layout))
    year, month, day = (F.regexp_extract(path, f".*{pattern}/", order.index(c) + 1) for c in "Ymd")
    return F.try_to_timestamp(F.concat(year, month, day), F.lit("yyyyMMdd")).cast("date")


def read_raw(
    spark: SparkSession,
    root: str,
    kind: str,
    first: str,
    last: str,
    schema: T.StructType,
    layout: str = LAYOUT,
    day: str | None = None,
) -> DataFrame:
    """JSON lines of one kind below root/YYYY/MM/DD for an inclusive range of dates.

    Only the folders of these dates are listed; a range without files gives no rows.
    `day` names a column for the date of the folder.
    """
    wide = T.StructType([*schema.fields, T.StructField(_CORRUPT, T.StringType())])
    named = layout.replace("{kind}", kind)
    folders = list(day_folders(spark, root, first, last, named).values())
    if not folders:
        empty = spark.createDataFrame([], wide)
        return empty.withColumn(day, F.lit(None).cast("date")) if day else empty
    reader = spark.read.schema(wide).option("recursiveFileLookup", True)
    if "{kind}" not in layout:
        reader = reader.option("pathGlobFilter", f"*{kind}*")
    rows = reader.json(folders)
    return rows.withColumn(day, folder_day(F.col("_metadata.file_path"), named)) if day else rows
