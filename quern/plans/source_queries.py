"""Queries of sources, sinks and continual ingest; those that write use the session's shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.plans.registry import query
from quern.plans.text_queries import FILES
from quern.sources import adapters, sinks
from quern.sources.adapters import Spec
from quern.sources.workspace import workspace
from quern.streaming.ingest import ingest, windowed_counts

PERMITTED = {"MIT", "CC-BY-4.0"}


def _files(t, label):
    """A small repository of text files, written by Spark."""
    path = workspace(t.spark, label)
    t.values(FILES).where("path LIKE '%.py' OR path LIKE '%.md'").select("content").repartition(3).write.text(path)
    return path


@query("src_hf_dataset", "SELECT count(DISTINCT text)::BIGINT AS n_records, 'dataset' AS source_type FROM documents WHERE trim(text) <> ''")
def _(t):
    records, _ = adapters.run_adapter(t.spark, Spec("dataset", f"{t.folder}/documents.parquet", "documents", "MIT"), PERMITTED)
    return records.groupBy("source_type").agg(F.count("*").alias("n_records"))


@query("src_github_repo")
def _(t):
    return adapters.read_source(t.spark, Spec("repository", _files(t, "repository"), "repo", "MIT")).select("text")


@query("src_documentation")
def _(t):
    return adapters.read_source(t.spark, Spec("documentation", _files(t, "docs"), "docs", "MIT")).select("text")


@query("src_public_domain")
def _(t):
    return adapters.run_adapter(t.spark, Spec("public_domain", _files(t, "public"), "public", "MIT"), PERMITTED)[0].select("text", "source_type")


@query("adapter_contract", "SELECT 'made' AS source, 'synthetic' AS source_type, 'MIT' AS license, count(DISTINCT i * 7 % 101)::BIGINT AS n_records FROM range(300) AS r(i)")
def _(t):
    return adapters.run_adapter(t.spark, Spec("synthetic", "", "made", "MIT", {"n": 300}), PERMITTED)[1].select("source", "source_type", "license", "n_records")


@query("source_fault_isolation", "SELECT * FROM (VALUES ('made', 'read', 50::BIGINT), ('gone', 'failed', 0)) AS v(source, state, n)")
def _(t):
    specs = [Spec("synthetic", "", "made", "MIT", {"n": 50}), Spec("dataset", f"{t.folder}/no_such_table.parquet", "gone", "MIT"), Spec("synthetic", "", "unlicensed", None)]
    records, failures = adapters.union_sources(t.spark, specs, PERMITTED)
    read = records.groupBy("source").agg(F.count("*").alias("n")).select("source", F.lit("read").alias("state"), "n")
    return read.unionByName(failures.select("source", F.lit("failed").alias("state"), F.lit(0).cast("long").alias("n")))


@query("read_jsonl_split", "SELECT doc_id::VARCHAR AS record_id, text, 'train' AS split FROM documents")
def _(t):
    path = workspace(t.spark, "jsonl")
    t.documents.select(F.col("doc_id").cast("string").alias("record_id"), "text", F.lit("train").alias("split")).write.json(path)
    return adapters.read_jsonl(t.spark, path).where("_corrupt_record IS NULL").select("record_id", "text", "split")


DOCS = "(VALUES (1, 'txt', 'plain'), (2, 'html', '<p>a &amp; b</p>'), (3, 'pdf', '%PDF'), (4, 'md', '# Title *x*')) AS d(id, kind, content)"


@query("document_extract", "SELECT * FROM (VALUES (1, 'plain', 'EXECUTED'), (2, 'a & b', 'EXECUTED'), (3, NULL, 'BLOCKED'), (4, ' Title x', 'EXECUTED')) AS v(id, text, status)")
def _(t):
    return adapters.extract_documents(t.values(DOCS)).select("id", "text", "status")


@query("pdf_extract", "SELECT 3 AS id, 'BLOCKED' AS status")
def _(t):
    return adapters.extract_documents(t.values(DOCS)).where("kind = 'pdf'").select("id", "status")


@query("provider_http", "SELECT category, 'none' AS provider, false AS available FROM (VALUES ('web'), ('news'), ('image'), ('academic'), ('code'), ('docs'), ('package')) AS c(category)")
def _(t):
    return adapters.provider_status(t.spark, {})


@query("provider_registry", "SELECT category, CASE WHEN category IN ('docs', 'code') THEN 'local' ELSE 'none' END AS provider, category IN ('docs', 'code') AS available FROM (VALUES ('web'), ('news'), ('image'), ('academic'), ('code'), ('docs'), ('package')) AS c(category)")
def _(t):
    return adapters.provider_status(t.spark, {"docs": "local", "code": "local"})


@query("write_shards", "SELECT count(*)::BIGINT AS n, sum(n_chars)::BIGINT AS n_chars FROM documents")
def _(t):
    path = workspace(t.spark, "shards")
    sinks.write_shards(t.documents, path, "doc_id", 4)
    return t.spark.read.parquet(path).agg(F.count("*").alias("n"), F.sum("n_chars").alias("n_chars"))


@query("write_manifest", "SELECT count(*)::BIGINT AS rows FROM documents")
def _(t):
    path = workspace(t.spark, "manifest")
    sinks.write_shards(t.documents, path, "doc_id", 4)
    return sinks.manifest(t.spark, path).agg(F.sum("rows").alias("rows"))


@query("write_checksums")
def _(t):
    return sinks.checksums(t.spark, _files(t, "checksums")).select("sha256", "bytes")


@query("artifact_size")
def _(t):
    return sinks.artifact_size(t.spark, _files(t, "artifact"))


@query("dataset_versioning", "SELECT count(*)::BIGINT AS n, 'v1' AS version FROM documents")
def _(t):
    root = workspace(t.spark, "versions")
    sinks.commit_version(t.documents, root, "v1")
    sinks.commit_version(t.documents.withColumn("text", F.upper("text")), root, "v2")
    sinks.set_version(t.spark, root, "v1")
    return sinks.read_version(t.spark, root).groupBy("version").agg(F.count("*").alias("n"))


@query("write_experiment_log", "SELECT * FROM (VALUES ('e1', 0.5::DOUBLE), ('e2', 0.25)) AS v(experiment, loss)")
def _(t):
    path = workspace(t.spark, "log")
    for e, loss in (("e1", 0.5), ("e2", 0.25)):
        sinks.append_log(t.spark, path, {"experiment": e, "loss": loss})
    return t.spark.read.json(path).select("experiment", "loss")


@query("compute_python")
def _(t):
    """Code is never run here; only the record of what a sandbox reported."""
    return t.values("(VALUES (1, 'not run: outside the engine', 'BLOCKED')) AS v(id, detail, status)")


@query("continual_gate", "SELECT count(DISTINCT text)::BIGINT AS n FROM documents WHERE length(text) > 0")
def _(t):
    root = workspace(t.spark, "ingest")
    rows = t.documents.select("doc_id", "text", F.lit("MIT").alias("license"))
    rows.repartition(3, "doc_id").write.parquet(f"{root}/incoming")
    ingest(t.spark, f"{root}/incoming", f"{root}/store", f"{root}/state", rows.schema, ["MIT"], tolerance=1.0)
    poor = t.spark.range(20).select((F.col("id") + 10**9).alias("doc_id"), F.concat(F.lit("x"), "id").alias("text"), F.lit("MIT").alias("license"))
    poor.coalesce(1).write.mode("append").parquet(f"{root}/incoming")  # a later batch of far shorter texts, which the gate refuses
    store = ingest(t.spark, f"{root}/incoming", f"{root}/store", f"{root}/state", rows.schema, ["MIT"], tolerance=0.5)
    return store.agg(F.count("*").alias("n"))


# --- optional: events have no counterpart among the prescribed operators ----


@query("ext_event_windows", "SELECT date_trunc('hour', ts) AS start, event_type, count(*)::BIGINT AS n FROM events GROUP BY ALL")
def _(t):
    return windowed_counts(t.events).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("ext_event_sessions", "SELECT user_id, session, count(*)::BIGINT AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS session FROM (SELECT *, (coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 6 HOUR, true))::INT AS new FROM events)) GROUP BY ALL")
def _(t):
    from pyspark.sql.window import Window as W

    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.col("ts") - F.lag("ts").over(w) > F.expr("INTERVAL 6 HOURS")
    new = t.events.withColumn("new", F.coalesce(gap, F.lit(True)).cast("int"))
    return new.withColumn("session", F.sum("new").over(w)).groupBy("user_id", "session").agg(F.count("*").alias("n"))


@query("ext_pricing_rollup", "SELECT l_returnflag, l_linestatus, count(*)::BIGINT AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem WHERE l_shipdate <= '1998-09-02' GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def _(t):
    d = t.lineitem.where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return d.rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))
