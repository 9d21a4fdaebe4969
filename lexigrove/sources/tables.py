"""Tables, checked columns, files and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrove.functions.text import detect_format, strip, text_of

CHUNK_LINES = (
    "page_content string, metadata struct<chunk_id string, source string, format string, page int, chunk_index int, strategy string, configured_chunk_size int,"
    " configured_overlap int, actual_characters int, actual_words int, title string, description string, document_date string, topic string>"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def scan_folder(spark: SparkSession, path: str, extensions: tuple[str, ...], excluded: tuple[str, ...] = (), recursive: bool = True) -> DataFrame:
    """(path, extension, size, checksum, content) of files with an allowed extension and no excluded folder above them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    ext = F.when(name.contains("."), F.concat(F.lit("."), F.element_at(F.split(name, r"\."), -1))).otherwise("")
    folders = F.transform(F.split("path", "/"), lambda p: F.lower(p))
    kept = files.withColumn("extension", ext).where(F.col("extension").isin(*[_extension(e) for e in extensions]))
    if excluded:
        kept = kept.where(~F.arrays_overlap(F.slice(folders, F.lit(1), F.greatest(F.size(folders) - 1, F.lit(0))), F.array(*[F.lit(e.lower()) for e in excluded])))
    return kept.select("path", "extension", F.col("length").alias("size"), F.sha2("content", 256).alias("checksum"), "content")


def _extension(e: str) -> str:
    e = e.strip().lower()
    return e if e.startswith(".") else f".{e}"


def extension_counts(files: DataFrame) -> DataFrame:
    return files.groupBy(F.when(F.col("extension") == "", "[none]").otherwise(F.col("extension")).alias("extension")).agg(F.count("*").alias("files"), F.sum("size").alias("bytes")).orderBy("extension")


def read_chunk_lines(spark: SparkSession, path: str, expected: int | None = None) -> DataFrame:
    """Chunks from JSON lines; blank lines are passed over, a broken line fails the read, a blank content fails the check,
    and so does another number of chunks than expected."""
    chunks = spark.read.schema(CHUNK_LINES).option("mode", "FAILFAST").json(path)
    chunks = chunks.withColumn("page_content", F.when(strip(text_of("page_content")) != "", F.col("page_content")).otherwise(F.raise_error(F.lit("blank chunk"))))
    if expected is not None and (found := chunks.agg(F.count("page_content")).first()[0]) != expected:
        raise ValueError(f"{path} has {found} chunks, not {expected}")
    return chunks


def chunk_rows(chunks: DataFrame) -> DataFrame:
    """chunks(position, page_content, metadata map of strings, and chunk_id and source where metadata has none) to the
    rows of an index: position, chunk_id, content, source, document_format, page_number, metadata as JSON.

    An id that is nowhere is made from the position, a blank one fails. Paths take slashes, formats lower case, and come
    from the source's ending where they are not given; a page that is no number is null. See `repeated` for ids.
    """
    told = lambda *keys: F.coalesce(*[F.try_element_at("metadata", F.lit(k)) for k in keys])
    name = strip(F.coalesce(told("chunk_id"), "chunk_id", F.concat(F.lit("chunk_"), F.col("position").cast("string"))))
    source = F.replace(F.coalesce(told("source"), "source", F.lit("unknown")), F.lit("\\"), F.lit("/"))
    meta = F.map_concat(F.map_filter(F.coalesce("metadata", F.create_map().cast("map<string,string>")), lambda k, v: k != "chunk_position"), F.create_map(F.lit("chunk_position"), F.col("position").cast("string")))
    return chunks.select(
        "position", F.when(name != "", name).otherwise(F.raise_error(F.lit("a chunk's id is blank"))).alias("chunk_id"), strip(text_of("page_content")).alias("content"), source.alias("source"),
        F.lower(F.coalesce(told("format", "document_format"), detect_format(source))).alias("document_format"), safe_integer(told("page", "page_number")).alias("page_number"), F.to_json(meta).alias("metadata"),
    )


def repeated(df: DataFrame, key: str) -> DataFrame:
    """The keys that more than one row has, and how many have them."""
    return df.groupBy(key).agg(F.count("*").alias("rows")).where("rows > 1")


def page_sections(docs: DataFrame, id_col: str, pages_col: str = "pages") -> DataFrame:
    """Pages of text to a section each: heading, section_id, page, text. Empty pages go, the others keep their number."""
    out = docs.select(id_col, F.posexplode(pages_col).alias("at", "text")).where(strip(text_of("text")) != "")
    page = (F.col("at") + 1).cast("string")
    return out.select(id_col, F.concat(F.col(id_col).cast("string"), F.lit(":page-"), page).alias("section_id"), F.concat(F.lit("Page "), page).alias("heading"), (F.col("at") + 1).cast("long").alias("page"), strip(F.col("text")).alias("text"))


def read_csv(spark: SparkSession, path: str, *required: str) -> DataFrame:
    """Rows of a CSV file with a header, with or without a byte-order mark; names and values are stripped, an empty value is
    null. A required column that is not there fails."""
    df = spark.read.option("header", True).option("multiLine", True).option("encoding", "UTF-8").csv(path)
    named = df.toDF(*[c.strip("\ufeff \t") for c in df.columns])
    return require_columns(named, *required).select(*[F.nullif(strip(F.col(f"`{c}`")), F.lit("")).alias(c) for c in named.columns])


def write_rows(df: DataFrame, path: str, kind: str = "json") -> None:
    """JSON lines or CSV with a header, in the partitions that df has."""
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if kind == "csv" else writer.json(path)


def write_buckets(df: DataFrame, name: str, key: str, buckets: int = 64) -> None:
    """A table bucketed and sorted by key, so that later joins on it need no shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(name)


def safe_integer(c: Column) -> Column:
    """Null where the text is no integer."""
    return c.try_cast("int")


def vector_checks(vectors: DataFrame, col: str = "embedding") -> DataFrame:
    """One row: rows, dimensions, and vectors with non-finite or no components."""
    v = F.col(col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return vectors.agg(F.count("*").alias("vectors"), F.count_distinct(F.size(v)).alias("dimensions"), F.max(F.size(v)).cast("long").alias("width"), F.count_if(F.coalesce(bad, F.lit(True))).alias("unusable"))
