"""Source adapters: each gives records and provenance; one that fails doesn't stop the others."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions import text as X

#: File types by extension.
EXTENSIONS = {"py": "python", "js": "javascript", "md": "markdown", "txt": "text", "json": "json", "html": "html"}
JSONL = T.StructType([T.StructField("record_id", T.StringType()), T.StructField("text", T.StringType()), T.StructField("split", T.StringType()), T.StructField("_corrupt_record", T.StringType())])


@dataclass
class Spec:
    """What an adapter is told: its kind, path, license, language and the source's name."""

    kind: str
    path: str
    name: str
    license: str | None = None
    options: dict = field(default_factory=dict)


def read_source(spark: SparkSession, spec: Spec) -> DataFrame:
    """The raw rows (path, text) of a source: a dataset snapshot, a repository, documentation, a corpus."""
    if spec.kind == "dataset":
        form = spec.options.get("format", "parquet")
        return spark.read.format(form).load(spec.path).select(F.lit(spec.path).alias("path"), F.col(spec.options.get("text", "text")).cast("string").alias("text"))
    if spec.kind == "repository":
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(spec.path)
        known = files.where(F.regexp_extract("path", r"\.([a-z]+)$", 1).isin(*EXTENSIONS) & F.is_valid_utf8(F.col("content")))
        return known.select("path", F.decode("content", "UTF-8").alias("text"))
    if spec.kind in ("documentation", "public_domain"):
        return spark.read.text(spec.path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    if spec.kind == "synthetic":
        return spark.range(spec.options.get("n", 100)).select(F.concat(F.lit("synthetic:"), "id").alias("path"), F.concat(F.lit("sample "), F.col("id") * 7 % 101).alias("text"))
    raise ValueError(f"no adapter for {spec.kind}")


def run_adapter(spark: SparkSession, spec: Spec, permitted: set[str]) -> tuple[DataFrame, DataFrame]:
    """(records, provenance): license, retrieval, normalisation, filter, exact dedup, standard record, in this order."""
    state = spec.license if spec.license is not None else "LICENSE_UNCLEAR"
    raw = read_source(spark, spec).where(F.lit(state in permitted))
    clean = raw.withColumn("text", X.norm_code(F.col("text"))).where(F.length(F.trim("text")) > 0)
    first = clean.groupBy(F.sha2("text", 256).alias("record_id")).agg(F.min("path").alias("path"), F.first("text").alias("text"))
    records = first.select("record_id", "path", "text", F.lit(spec.kind).alias("source_type"), F.lit(spec.name).alias("source"), F.lit(state).alias("license"))
    provenance = records.groupBy("source", "source_type", "license").agg(F.count("*").alias("n_records"), F.min("path").alias("first_path"))
    return records, provenance


def union_sources(spark: SparkSession, specs: list[Spec], permitted: set[str]) -> tuple[DataFrame, DataFrame]:
    """(records, failures): all adapters' records; an adapter that can't be read is a row of failures.

    Reading is tried while the plan is made, where missing paths show.
    """
    records, failures = None, []
    for spec in specs:
        try:
            own, _ = run_adapter(spark, spec, permitted)
        except Exception as e:  # an adapter may fail in any way; it is recorded
            failures.append((spec.name, spec.kind, type(e).__name__))
            continue
        records = own if records is None else records.unionByName(own, allowMissingColumns=True)
    failed = spark.createDataFrame(failures, "source string, source_type string, error string")
    if records is None:
        records = spark.createDataFrame([], "record_id string, path string, text string, source_type string, source string, license string")
    return records, failed


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType = JSONL) -> DataFrame:
    """JSON lines under an explicit schema; lines that don't parse are kept in _corrupt_record."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def extract_documents(df: DataFrame, kind: str = "kind", content: str = "content") -> DataFrame:
    """df with text and status by kind of document; kinds whose reader isn't installed are BLOCKED, never guessed."""
    text = F.when(F.col(kind) == "txt", F.col(content)).when(F.col(kind) == "html", X.html_struct(F.col(content))["text"]).when(F.col(kind) == "md", F.regexp_replace(content, "[#*`_]", ""))
    return df.withColumn("text", text).withColumn("status", F.when(F.col(kind).isin("txt", "html", "md"), "EXECUTED").otherwise("BLOCKED"))


#: The seven categories of search.
CATEGORIES = ["web", "news", "image", "academic", "code", "docs", "package"]


def provider_status(spark: SparkSession, configured: dict[str, str]) -> DataFrame:
    """(category, provider, available): a category without configured endpoint is reported as absent."""
    rows = [(c, configured.get(c, "none"), c in configured) for c in CATEGORIES]
    return spark.createDataFrame(rows, "category string, provider string, available boolean")
