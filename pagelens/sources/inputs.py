"""Inputs beside the page table: url lists, profiles and answers as JSON, the selector cache, and JSON that may be text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CACHE = "cache_key string, selector string"


def url_list(spark: SparkSession, *paths: str) -> DataFrame:
    """The urls of text files, one a line: trimmed, without blank lines and those that start with #, the first of each, with its place.

    The place is the line's order within its file, files in the order of their names.
    """
    lines = spark.read.text(list(paths)).select("value", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("line"))
    urls = lines.select(F.trim("value").alias("url"), "file", "line").filter("url <> '' and url not like '#%'")
    return urls.groupBy("url").agg(F.min(F.struct("file", "line")).alias("place"))


def json_map(text: Column) -> Column:
    """A JSON object as a map of texts, for profiles and answers; NULL where it is none."""
    return F.from_json(text, "map<string,string>")


def answers(rows: DataFrame, *, json_col: str = "answers") -> DataFrame:
    """page_id, question, answer from a JSON object per page."""
    return rows.select("page_id", F.explode(json_map(F.col(json_col))).alias("question", "answer"))


def json_or_text(text: Column) -> Column:
    """A script's result as a VARIANT: parsed where it looks like a JSON object or array and is one, else the text itself."""
    looks = F.trim(text).rlike(r"^[\[{]")
    quoted = F.regexp_extract(F.to_json(F.struct(text.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
    return F.coalesce(F.when(looks, F.try_parse_json(text)), F.try_parse_json(quoted))


def _folder(spark: SparkSession, path: str):
    """(file system, path) as the session sees them."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()), there


def load_cache(spark: SparkSession, path: str) -> DataFrame:
    """The selector cache of a Parquet folder; an empty one where there is none yet. Other errors are raised."""
    files, there = _folder(spark, path)
    return spark.read.schema(CACHE).parquet(path) if files.exists(there) else spark.createDataFrame([], CACHE)


def save_cache(cache: DataFrame, path: str) -> None:
    """The whole cache in place of the one at `path`, which it may be read from: it is written beside that, and then takes its place."""
    spark = cache.sparkSession
    beside, before = f"{path.rstrip('/')}.next", f"{path.rstrip('/')}.before"
    cache.select("cache_key", "selector").write.mode("overwrite").parquet(beside)
    files, there = _folder(spark, path)
    old, new = _folder(spark, before)[1], _folder(spark, beside)[1]
    files.delete(old, True)
    if files.exists(there):
        files.rename(there, old)
    if not files.rename(new, there):
        files.rename(old, there)
        raise OSError(f"the cache could not be moved to {path}")
    files.delete(old, True)


def once_per_url(captures: DataFrame, *, url_col: str = "url", order: str = "at") -> DataFrame:
    """The first capture of every run of captures of one url, in order: what is prepared once per url. captures has session, url and the order."""
    from pyspark.sql import Window

    before = F.lag(url_col).over(Window.partitionBy("session").orderBy(order))
    return captures.withColumn("__before", before).filter(~F.col(url_col).eqNullSafe(F.col("__before")) | F.col("__before").isNull()).drop("__before")


def by_content(pages: DataFrame, *, html_col: str = "html") -> tuple[DataFrame, DataFrame]:
    """(contents, places): each distinct page text once, keyed by its hash as page_id, and which page has which; what is built from
    contents (blocks, quality) is joined back to pages by `content_id`, so pages of equal text are built once."""
    keyed = pages.withColumn("content_id", F.sha2(F.col(html_col).cast("string"), 256))
    contents = keyed.filter(F.col(html_col).isNotNull()).groupBy(F.col("content_id").alias("page_id")).agg(F.first(html_col).alias(html_col))
    return contents, keyed.select("page_id", "content_id")


def binding_path_json(path: Column) -> Column:
    """A binding's path (an array) as compact JSON; [] for NULL."""
    return F.coalesce(F.to_json(path), F.lit("[]"))
