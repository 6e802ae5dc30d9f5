"""Sources and sinks: JSON lines, JSON, CSV and TSV, Parquet, versioned results, caches."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import validation as V
from tidemark.sources.paths import exists, head

REVIEW = T.StructType(
    [
        T.StructField("text", T.StringType()), T.StructField("rating", T.DoubleType()), T.StructField("user_id", T.StringType()), T.StructField("parent_asin", T.StringType()),
        T.StructField("timestamp", T.LongType()), T.StructField("verified_purchase", T.BooleanType()),
    ]
)


def read_reviews(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """JSON lines with the review schema; lines that are no JSON are dropped."""
    rows = spark.read.schema(REVIEW).option("mode", "DROPMALFORMED").json(path)
    return rows if limit is None else rows.limit(limit)


def read_json_rows(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """JSON lines as rows, and apart from them the lines that don't fit, with their file."""
    lines = spark.read.text(path).where(F.trim("value") != "").withColumn("file", F.input_file_name())
    wide = T.StructType([*schema.fields, T.StructField("__bad", T.StringType())])
    parsed = lines.withColumn("j", F.from_json("value", wide, {"columnNameOfCorruptRecord": "__bad"}))
    good = parsed.where("j.__bad is null").select(*[F.col(f"j.{f.name}").alias(f.name) for f in schema.fields])
    return good, parsed.where("j.__bad is not null").select("file", "value")


def numbered_lines(lines: DataFrame) -> DataFrame:
    """``file, line, value`` and the other columns of a text source, with lines counted from 1 in each file, empty ones too.

    Files are read in splits as any others, large ones by many tasks.  A split's lines
    are numbered where they are; what comes before it is the sum of the counts of the
    file's splits before it, of which there is a row a split.
    """
    known = lines.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("__from"), F.monotonically_increasing_id().alias("__id"))
    splits = known.groupBy("file", "__from").agg(F.min("__id").alias("__first"), F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("file").orderBy("__from").rowsBetween(Window.unboundedPreceding, -1))
    splits = splits.select("file", "__from", "__first", F.coalesce(before, F.lit(0)).alias("__before"))
    return known.join(splits, ["file", "__from"]).withColumn("line", F.col("__before") + F.col("__id") - F.col("__first") + 1).drop("__from", "__id", "__first", "__before")


def _judged(lines: DataFrame, schema: T.StructType) -> DataFrame:
    """Lines that hold something, with ``j``: their fields, and ``__bad`` if they are no such object."""
    wide = T.StructType([*schema.fields, T.StructField("__bad", T.StringType())])
    return lines.where(F.trim("value") != "").withColumn("j", F.from_json("value", wide, {"columnNameOfCorruptRecord": "__bad"}))


def numbered_json_rows(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """As ``read_json_rows``, with ``file`` and ``line``, counted from 1, of each row and each line that doesn't fit."""
    parsed = _judged(numbered_lines(spark.read.text(path)), schema)
    rest = [c for c in parsed.columns if c not in ("value", "j", "file", "line")]  # columns of folders
    good = parsed.where("j.__bad is null").select("file", "line", *rest, *[F.col(f"j.{f.name}").alias(f.name) for f in schema.fields])
    return good, parsed.where("j.__bad is not null").select("file", "line", *rest, "value")


def stream_json_rows(spark: SparkSession, path: str, schema: T.StructType, good: str, bad: str, progress: str, files_a_batch: int = 1000) -> None:
    """JSON lines as they arrive as files under ``path``: rows to the table ``good``, the others with file and line to ``bad``.

    A batch has whole files, so that lines can be numbered in it.  Ends when all files
    there are have been read; begun again, with the same ``progress``, it goes on with
    what is new.  Tables are Parquet, a folder a batch, which is written anew if a batch
    is repeated.
    """

    def take(batch: DataFrame, number: int) -> None:
        parsed = _judged(numbered_lines(batch), schema).persist()
        rows = parsed.where("j.__bad is null").select("file", "line", *[F.col(f"j.{f.name}").alias(f.name) for f in schema.fields])
        rows.write.mode("overwrite").parquet(f"{good}/batch={number}")
        parsed.where("j.__bad is not null").select("file", "line", "value").write.mode("overwrite").parquet(f"{bad}/batch={number}")
        parsed.unpersist()

    lines = spark.readStream.option("maxFilesPerTrigger", files_a_batch).text(path)
    lines = lines.select("value", "_metadata")
    lines.writeStream.foreachBatch(take).option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()


def require_json_rows(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of JSON lines; a line that doesn't fit is an error that names file and line."""
    good, bad = numbered_json_rows(spark, path, schema)
    first = bad.orderBy("file", "line").first()
    if first is not None:
        raise ValueError(f"{first['file']}, line {first['line']}: no object of the expected form")
    return good.drop("file", "line")


def read_json_array(spark: SparkSession, path: str, required: bool = True, non_empty: bool = False, schema: T.StructType | str | None = None) -> DataFrame | None:
    """A JSON object or array of objects, over any number of lines.

    Without a file: an error if it is ``required``, else none.  ``non_empty`` makes a table
    without rows an error.
    """
    if not exists(spark, path):
        if required:
            raise FileNotFoundError(path)
        return None
    reader = spark.read.option("multiLine", True)
    rows = (reader.schema(schema) if schema is not None else reader).json(path)
    if non_empty and rows.limit(1).count() == 0:
        raise ValueError(f"{path} holds nothing")
    return rows


def delimiter(path: str, sample: str = "") -> str:
    """S3: by suffix, else whichever of tab and comma is more frequent in a sample of the file, else tab."""
    name = path.lower()
    if name.endswith((".csv", ".csv.gz")):
        return ","
    if name.endswith((".tsv", ".tsv.gz")):
        return "\t"
    return "," if sample.count(",") > sample.count("\t") else "\t"


def read_table(spark: SparkSession, path: str, columns: dict[str, list[str]] | None = None) -> DataFrame:
    """Parquet, JSON, CSV or TSV by suffix; ``columns`` names, for each column wanted, the ones that may hold it.

    Only columns that are used are read.  A column of which no candidate is there is null.
    """
    name = path.lower().rstrip("/")
    if ".parquet" in name:
        df = spark.read.parquet(path)
    elif name.endswith((".json", ".jsonl", ".json.gz", ".jsonl.gz")):
        df = spark.read.json(path)
    else:
        df = spark.read.option("header", True).option("sep", delimiter(path, head(spark, path))).csv(path)
    if columns is None:
        return df
    there = {c.lower(): c for c in df.columns}
    picked = {want: next((there[c.lower()] for c in names if c.lower() in there), None) for want, names in columns.items()}
    return df.select(*[(F.col(c) if c else F.lit(None).cast("string")).alias(want) for want, c in picked.items()])


def flag(column: str) -> F.Column:
    """a flag from a boolean, a number or a word."""
    t = F.lower(F.trim(F.col(column).cast("string")))
    return F.coalesce(t.isin("true", "1", "1.0", "yes", "y"), F.lit(False))


def write_json_lines(df: DataFrame, path: str) -> None:
    """JSON lines with keys in order; nulls are written."""
    ordered = df.select(*sorted(df.columns))
    ordered.select(F.to_json(F.struct(*ordered.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def write_versioned(df: DataFrame, root: str, name: str) -> str:
    """A new version of a result, and a pointer to it that readers follow.

    The version is complete before the pointer names it; the pointer is a table of its
    own, so that no file is changed in place.
    """
    path = f"{root.rstrip('/')}/{name}/version={uuid.uuid4().hex}"
    df.write.parquet(path)
    df.sparkSession.range(1).select(F.lit(path).alias("path"), F.current_timestamp().alias("at")).write.mode("append").parquet(f"{root.rstrip('/')}/{name}_latest")
    return path


def read_latest(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The version that was pointed to last."""
    path = spark.read.parquet(f"{root.rstrip('/')}/{name}_latest").orderBy(F.desc("at")).first()["path"]
    return spark.read.parquet(path)


def upsert_points(existing: DataFrame | None, new: DataFrame, key: str = "id") -> DataFrame:
    """New points replace existing ones of the same id; repeated ids count once."""
    new = new.dropDuplicates([key])
    return new if existing is None else existing.join(new.select(key), key, "left_anti").unionByName(new)


def write_collection(points: DataFrame, path: str, files: int = 64, key: str = "product_id") -> None:
    """A collection range-partitioned and sorted by what is filtered on, so that row-group statistics prune."""
    points.repartitionByRange(files, key).sortWithinPartitions(key).write.mode("overwrite").parquet(path)


def write_splits(rows: DataFrame, path: str, split: str = "split") -> None:
    """A folder a split; a read of one split touches no other."""
    rows.write.mode("overwrite").partitionBy(split).parquet(path)


def reuse_vectors(texts: DataFrame, cache: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Texts with the vector that a cache (``fingerprint, vector``) has, and those still to be embedded."""
    keyed = texts.withColumn("fingerprint", F.sha2(F.col(text), 256))
    joined = keyed.join(cache, "fingerprint", "left")
    return joined.where("vector is not null"), joined.where("vector is null").drop("vector")


def assert_unique(rows: DataFrame, key: str) -> DataFrame:
    """The rows, or an error when one of several with the same key is read."""
    from pyspark.sql import Window

    n = F.count("*").over(Window.partitionBy(key))
    checked = rows.withColumn("__n", n).withColumn("__ok", F.when(F.col("__n") > 1, F.raise_error(F.concat(F.lit("duplicate id: "), F.col(key).cast("string")))).otherwise(F.lit(True)))
    return checked.where("__ok").drop("__n", "__ok")


def bank_checks() -> dict[str, F.Column]:
    """What each row of a query bank must have."""
    tags = F.col("subset_tags")
    return {"query_id": V.non_empty(F.col("query_id")), "text": V.non_empty(F.col("text")), "source_type": V.non_empty(F.col("source_type")), "subset_tags": F.when(F.exists(tags, lambda t: t.isNull() | (F.trim(t) == "")), "empty tag")}


def load_bank(bank: DataFrame, active_only: bool = True) -> DataFrame:
    """Rows of a bank, each with what it must have and an id of its own; active ones, if that is asked for."""
    rows = assert_unique(V.required(bank, bank_checks()), "query_id")
    return rows.where(F.coalesce("active", F.lit(True))) if active_only and "active" in bank.columns else rows


def active_subset(bank: DataFrame, tag: str, need_items: bool = False, non_empty: bool = False) -> DataFrame:
    """Active rows with a tag, with relevant items if that is asked for; none at all is an error with ``non_empty``."""
    rows = bank.where(F.coalesce("active", F.lit(True)) & F.array_contains("subset_tags", tag))
    rows = rows.where(F.size(F.map_keys("relevant_items")) > 0) if need_items else rows
    if non_empty and rows.limit(1).count() == 0:
        raise ValueError(f"no row of the bank has the tag {tag}")
    return rows


def write_json_table(rows: DataFrame, path: str) -> None:
    """Cases, bundles or outcomes as JSON lines that keep nulls."""
    write_json_lines(rows, path)


def read_json_table(spark: SparkSession, path: str, schema: T.StructType, limit: int | None = None, order: str | None = None) -> DataFrame:
    """What ``write_json_table`` wrote, in the type that is given; the first ``limit`` in order, if that is asked for."""
    rows = spark.read.schema(schema).json(path)
    return rows if limit is None else rows.orderBy(order or schema.fields[0].name).limit(limit)


def write_dataset(queries: DataFrame, observations: DataFrame, path: str) -> None:
    """A calibration dataset, as two tables under one path."""
    queries.write.mode("overwrite").parquet(f"{path}/queries")
    observations.write.mode("overwrite").parquet(f"{path}/observations")


def read_dataset(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Queries and observations of a calibration dataset."""
    return spark.read.parquet(f"{path}/queries"), spark.read.parquet(f"{path}/observations")


def cached(spark: SparkSession, path: str, make, refresh: bool = False) -> DataFrame:
    """The table at ``path``; made by ``make()`` and written there if it isn't, or with ``refresh``."""
    if refresh or not exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def prepared_path(root: str, subset_size: int | None) -> str:
    """Where the prepared data of a subset's size are kept."""
    return f"{root.rstrip('/')}/prepared-{'all' if subset_size is None else int(subset_size)}"


def product_ids(spark: SparkSession, path: str, rows: DataFrame, product: str = "product_id", refresh: bool = False) -> DataFrame:
    """The distinct product ids of prepared data, kept at ``path``."""
    return cached(spark, path, lambda: rows.select(F.trim(F.col(product).cast("string")).alias("product_id")).where("product_id <> ''").distinct(), refresh)


def scroll(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A whole collection, the columns that are wanted; what was a cursor over pages is one scan."""
    return spark.read.parquet(path).select(*columns)
