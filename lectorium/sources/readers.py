"""Readers of raw files. Schemas are always given; malformed rows are left out where the source is dirty."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectorium.functions.text import clean, int_like, weekday_timestamp

BOOKS = "book_id string, work_id string, title string, title_without_series string, authors array<struct<author_id:string, role:string>>, language_code string, average_rating string, ratings_count string, text_reviews_count string, publication_year string, publisher string, num_pages string, isbn string, isbn13 string, image_url string, url string, popular_shelves array<struct<name:string, count:string>>"
AUTHORS = "author_id string, name string, average_rating string, ratings_count string, text_reviews_count string"
INTERACTIONS = "user_id long, book_id long, is_read int, rating int, is_reviewed int"
DETAILED = "user_id string, book_id string, rating int, date_added string, date_updated string, read_at string, started_at string"
#: Shelves that say what a reader did, not what a work is.
STATUS = (
    "to-read", "currently-reading", "read", "owned", "books-i-own", "owned-books", "library", "my-library", "kindle", "ebook", "ebooks", "audiobook", "audiobooks",
    "audio", "default", "favorites", "favourites", "re-read", "reread", "dnf", "abandoned", "did-not-finish", "tbr", "wish-list", "wishlist",
)


def json_lines(spark: SparkSession, path: str, schema: str, partitions: int | None = None) -> DataFrame:
    """JSON lines, gzipped or not; lines that are no JSON are dropped. One gzip file is one task, so its rows
    can be dealt anew right after."""
    df = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return df.repartition(partitions) if partitions else df


def books(spark: SparkSession, path: str, **kw) -> DataFrame:
    """Editions with trimmed ids, typed numbers and the first author."""
    b = json_lines(spark, path, BOOKS, **kw)
    number = lambda c: int_like(F.col(c)).alias(c)
    return b.select(
        clean(F.col("book_id")).alias("book_id"), clean(F.col("work_id")).alias("work_id"), "title", "title_without_series", clean(F.get(F.col("authors"), F.lit(0))["author_id"]).alias("author_id"), clean(F.col("language_code")).alias("language_code"),
        F.col("average_rating").try_cast("double").alias("average_rating"), number("ratings_count"), number("text_reviews_count"), number("publication_year"), clean(F.col("publisher")).alias("publisher"), number("num_pages"), clean(F.col("isbn")).alias("isbn"), clean(F.col("isbn13")).alias("isbn13"),
        "image_url", F.coalesce(clean(F.col("url")), F.concat(F.lit("/book/show/"), F.trim("book_id"))).alias("url"),
    ).filter("book_id IS NOT NULL")


def shelves(spark: SparkSession, path: str, **kw) -> DataFrame:
    """One row per edition and shelf."""
    b = json_lines(spark, path, BOOKS, **kw).select("book_id", F.explode("popular_shelves").alias("s"))
    return b.select("book_id", F.lower(F.trim(F.col("s.name"))).alias("shelf"), F.coalesce(int_like(F.col("s.count")), F.lit(0)).alias("count")).filter("shelf <> ''").withColumn("is_status", F.col("shelf").isin(*STATUS))


def interactions(spark: SparkSession, path: str, id_map: str) -> DataFrame:
    """Ratings with the ids of the book table; rows that rate nothing are left out before the join."""
    rows = spark.read.schema(INTERACTIONS).option("header", True).csv(path).filter("rating > 0").withColumnRenamed("book_id", "book_id_csv")
    ids = spark.read.schema("book_id_csv long, book_id string").option("header", True).csv(id_map)
    return rows.join(ids, "book_id_csv").select("user_id", "book_id", "rating", (F.col("is_read") == 1).alias("is_read"), (F.col("is_reviewed") == 1).alias("is_reviewed"))


def timed_interactions(spark: SparkSession, path: str, user_map: str, low: int = 0, high: int = 1 << 40, **kw) -> DataFrame:
    """Rated events with epoch seconds, within a band of time, and integer reader ids."""
    rows = json_lines(spark, path, DETAILED, **kw).filter("rating > 0")
    rows = rows.withColumns({"added_at": weekday_timestamp(F.col("date_added")), "updated_at": weekday_timestamp(F.col("date_updated")), "finished_at": weekday_timestamp(F.col("read_at"))})
    ids = spark.read.schema("user_id_csv int, user_id string").option("header", True).csv(user_map)
    return rows.filter(F.col("added_at").between(low, high)).join(ids, "user_id").select(F.col("user_id_csv").alias("user_id"), "book_id", "rating", "added_at", "updated_at", "finished_at")


def dirty_csv(spark: SparkSession, path: str, columns: list[str], longest: int = 100 << 20) -> DataFrame:
    """A CSV with quoted line breaks and very long fields, all columns as strings."""
    return spark.read.schema(", ".join(f"`{c}` string" for c in columns)).option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("maxCharsPerColumn", longest).option("mode", "DROPMALFORMED").csv(path)


def ranked_lists(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """A folder of ranked lists: list (the file's name), rank, book, authors, year."""
    rows = spark.read.schema("rank string, book string, authors string, year string, country string, language string").option("header", True).option("sep", sep).csv(path)
    name = F.regexp_extract(F.input_file_name(), "([^/]+)\\.[^.]+$", 1)
    return rows.select(name.alias("list"), int_like(F.regexp_replace("rank", "﻿", "")).alias("rank"), clean(F.col("book")).alias("book"), clean(F.col("authors")).alias("authors"), int_like(F.col("year")).alias("year")).filter("rank IS NOT NULL AND book IS NOT NULL")


def poll_lines(spark: SparkSession, path: str) -> DataFrame:
    """`Title - Author` lines by their place: split at the last dash, of any length."""
    whole = spark.read.text(path, wholetext=True)
    lines = whole.select(F.posexplode(F.split("value", "\\r?\\n")).alias("at", "line")).filter(F.trim("line") != "")
    cut = "^(.*)\\s+[-–—]\\s+(.*)$"
    return lines.select((F.col("at") + 1).alias("rank"), F.trim(F.regexp_extract("line", cut, 1)).alias("title"), F.trim(F.regexp_extract("line", cut, 2)).alias("author")).filter("title <> ''")


def _hadoop(spark: SparkSession, *paths: str):
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    found = [jvm.org.apache.hadoop.fs.Path(p) for p in paths]
    return found[0].getFileSystem(conf), *found


def write_swapped(df: DataFrame, path: str, row_group_bytes: int | None = None) -> None:
    """Write beside the target and put it in its place only when whole: the old table is moved aside, the new
    one moved in, then the old one deleted. A table that a crash has left aside is put back first, so at any
    time either the old or the new one can be had by recovered_table or the next write."""
    spark = df.sparkSession
    recovered_table(spark, path)
    fs, target, staging, old = _hadoop(spark, path, f"{path}.staging", f"{path}.old")
    writer = df.write.mode("overwrite").option("compression", "zstd")
    if row_group_bytes:
        writer = writer.option("parquet.block.size", row_group_bytes)
    writer.parquet(staging.toString())
    if fs.exists(target) and not fs.rename(target, old):
        raise OSError(f"can't move {path} aside")
    if not fs.rename(staging, target):
        fs.rename(old, target)
        raise OSError(f"can't rename {staging} to {path}")
    fs.delete(old, True)


def recovered_table(spark: SparkSession, path: str) -> str:
    """The path, after a swap that was broken off is undone or done with."""
    fs, target, old = _hadoop(spark, path, f"{path}.old")
    if fs.exists(old):
        if fs.exists(target):
            fs.delete(old, True)
        elif not fs.rename(old, target):
            raise OSError(f"can't put {path} back")
    return path


def attach(spark: SparkSession, folder: str, prefix: str = "") -> list[str]:
    """A second database, read-only: every Parquet table of a folder as a view prefix + name. Gives the names."""
    fs, root = _hadoop(spark, folder)
    names = []
    for status in fs.listStatus(root):
        name = status.getPath().getName()
        if name.endswith(".parquet"):
            view = prefix + name.removesuffix(".parquet")
            spark.read.parquet(status.getPath().toString()).createOrReplaceTempView(view)
            names.append(view)
    return sorted(names)


def insert_rows(spark: SparkSession, path: str, rows: list[tuple], schema: str) -> None:
    """Add rows from the driver (curated lists) to a Parquet table with this schema, which is made if need be."""
    spark.createDataFrame(rows, schema).write.mode("append").option("compression", "zstd").parquet(path)


def first_rows(df: DataFrame, limit: int | None) -> DataFrame:
    """The quick mode of extracts: limit rows at most; all for None."""
    return df if limit is None else df.limit(limit)


def larger_of(spark: SparkSession, slice_path: str, full_path: str, least_bytes: int) -> str:
    """The slice of a genre if it is there and at least so large, else the full table."""
    fs, part = _hadoop(spark, slice_path)
    return slice_path if fs.exists(part) and fs.getContentSummary(part).getLength() >= least_bytes else full_path


def save_checkpoint(df: DataFrame, path: str, key: str) -> None:
    """A state of a long run, with the key of what it was made for."""
    write_swapped(df.withColumn("_key", F.lit(key)), path)


def load_checkpoint(spark: SparkSession, path: str, key: str) -> DataFrame | None:
    """The state saved under path if it was made for the key; None if there is none or it is another's."""
    fs, target = _hadoop(spark, recovered_table(spark, path))
    if not fs.exists(target):
        return None
    df = spark.read.parquet(path)
    return None if df.filter(F.col("_key") != key).limit(1).count() else df.drop("_key")


def query_tsv(spark: SparkSession, sql: str):
    """Lines of a query's result, tab-separated with a header, nulls empty; streamed row by row."""
    df = spark.sql(sql)
    yield "\t".join(df.columns)
    for row in df.toLocalIterator():
        yield "\t".join("" if v is None else str(v) for v in row)
