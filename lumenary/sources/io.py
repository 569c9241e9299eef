"""Readers with declared schemas and writers that never overwrite."""

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

CHUNK = "id string, unit_id string, unit_key string, kind string, body_start int, body_end int, text string, token_count int, overlap_tokens int, overlap_chars int, prefix_chars int, text_sha256 string, pdf_pages array<int>, printed_pages array<string>, review_ids array<string>, status string"
ATTEMPT = "key string, round int, question_id string, condition string, question string, status string, retrieval struct<items:array<struct<rank:int,score:double,id:string,text:string>>>, evaluation_answer string, citation_ids array<string>, unprovided_citations array<string>, output_truncated boolean, input_tokens_counted int, timing_ms struct<total:double,retrieval:double,generation:double>, timing_anomalies array<string>"
METRIC = "attempt_key string, question_id string, condition string, type string, metric string, value double, status string"
CORRECTION = "id string, record_id string, pdf_page int, start int, end int, before string, after string, reason string"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_jsonl(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """One object a line, blank lines ignored; a malformed line is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_json(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """Whole-file JSON."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_json_folder(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """A file a record, with its name: order comes from the name, never from listing. A broken file is an error."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path).select("*", F.col("_metadata.file_name").alias("file_name"))


def read_csv(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    """path, modified, length, content, sha256 of files, for inventories."""
    return spark.read.format("binaryFile").load(path).withColumn("sha256", F.sha2("content", 256))


def write_new(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write once; an existing target is an error. The commit protocol makes the result appear whole."""
    df.write.mode("errorifexists").format(fmt).save(path)


def write_text(records: DataFrame, path: str, header: str, body: str) -> None:
    """A header line and the text of each record."""
    records.select(F.concat(F.col(header), F.lit("\n"), F.col(body)).alias("value")).write.mode("errorifexists").text(path)


def manifest(df: DataFrame, part: str, columns: list[str]) -> DataFrame:
    """part, rows, digest: for each part its rows and the digest of these columns, whatever the order of rows. Repeated rows count in
    pairs in an exclusive or, so sums of hashes go into it too."""
    row = F.sha2(F.to_json(F.struct(*columns)), 256)
    word = lambda i: F.conv(F.substring(row, 1 + 15 * i, 15), 16, 10).cast("long")
    parts = [F.bit_xor(word(i)).cast("string") for i in range(2)] + [F.sum(word(i).cast("decimal(38,0)")).cast("string") for i in (2, 3)]
    return df.groupBy(part).agg(F.count("*").alias("rows"), F.sha2(F.concat_ws("|", *parts), 256).alias("digest"))


def against_manifest(df: DataFrame, frozen: DataFrame, part: str, columns: list[str]) -> DataFrame:
    """part, state: SAME, CHANGED, MISSING or UNEXPECTED against a manifest."""
    now = manifest(df, part, columns).withColumnsRenamed({part: "__part", "rows": "__rows", "digest": "__digest"})
    both = frozen.join(now, F.col(part).eqNullSafe(F.col("__part")), "full_outer")
    same = (F.col("rows") == F.col("__rows")) & (F.col("digest") == F.col("__digest"))
    state = F.when(F.col("__rows").isNull(), "MISSING").when(F.col("rows").isNull(), "UNEXPECTED").when(same, "SAME").otherwise("CHANGED")
    return both.select(F.coalesce(part, "__part").alias(part), state.alias("state"))


def extend(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old rows as they are, and the new rows whose key is not there yet."""
    return old.unionByName(new.join(old.select(key), key, "left_anti"))


def markdown(df: DataFrame, columns: list[str]) -> DataFrame:
    """Table lines, a dash for null."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("—")) for c in columns]
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("value"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``. Only a local master may leave it unset
    and gets a temporary one, as in tests; on a cluster that is an error."""
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not where:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="lumenary-")
        sc.setCheckpointDir(where)
    return where


def scratch(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder; what is written there goes with the application."""
    path = f"{shared_dir(spark).rstrip('/')}/lumenary-{name}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(at)  # only what exists is marked
    files.deleteOnExit(at)
    return f"{path}/{name}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """The same rows, written as Parquet into the shared folder and read back; the files go with the application."""
    path = scratch(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """An HTML table, a row a line, cells escaped; an existing target is an error."""
    cells = [F.concat(F.lit("<td>"), F.replace(F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("—")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit("</td>")) for c in df.columns]
    df.select(F.concat(F.lit("<tr>"), *cells, F.lit("</tr>")).alias("value")).write.mode("errorifexists").text(path)


def replayed(captured: DataFrame, current: DataFrame, key: str, mark: str) -> DataFrame:
    """Captured rows whose source is unchanged; a key that is missing or has another mark is an error when the rows are read."""
    now = current.select(key, F.col(mark).alias("__now"))
    same = F.when(F.col("__now").eqNullSafe(F.col(mark)), True).otherwise(F.raise_error(F.concat(F.lit("the source has changed: "), F.col(key).cast("string"))).cast("boolean"))
    return captured.join(now, key, "left").where(same).drop("__now")


def freeze(captured: DataFrame, keep: Column, path: str) -> None:
    """A verified capture's kept rows, with a fingerprint of each, written once."""
    rows = captured.where(keep)
    write_new(rows.withColumn("row_sha256", F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(rows.columns)])), 256)), path)
