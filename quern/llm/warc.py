"""WARC archives and an external merge of their capture index.

Records are written by Spark's text writer: a record ends with two CRLFs, which
is its line separator, so archives land on whatever file system the session
writes to.  They are not compressed, so a capture's position and length are those
of its record in the file, and they are cut by bytes.  Reading them back gives
each archive's captures, sorted by URL key, time and page: a run.  Runs are
stored in this order and never sorted again: ranges of the key receive a piece of
every run, hold the pieces as Arrow batches, and a loser tree merges them as
streams of a few decoded rows each.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import re

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import broadcast_if, load, materialise, remove, shared_path

#: Bytes of an archive, about; and of one whose records are all as long as the longest, if that is longer than this.
ARCHIVE_BYTES, MOST_BYTES = 32 << 20, 512 << 20
CAPTURES_PER_RANGE = 100_000
#: Rows that a run's stream holds decoded.
DECODED = 500
BROADCAST_COPIES = 100_000
#: Captures carry no time; a page's is this plus its id in seconds.
EPOCH = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)
CAPTURE = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url_key string, captured_at string, archive string, position long, length long"


def base32_sha1(payload: Column) -> Column:
    """The base32 form of a payload's SHA-1, without UDF: 40 bits, eight digits, at a time."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_payload: int = 0) -> DataFrame:
    """(record) text of one WARC record per page.

    Of pages with equal payloads of min_payload bytes or more the one with the
    smallest id is a response and the others revisit it.  Null html is an empty
    payload; null urls are an empty target; rows that repeat the smallest id
    are responses; null ids revisit the smallest id, if there is one.
    """
    p = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    p = p.withColumn("digest", base32_sha1(F.col("html"))).withColumn("n", F.octet_length("html").cast("long"))
    copies = p.where(F.col("n") >= min_payload).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("rows")).where("rows > 1 AND first IS NOT NULL")
    copies = materialise(copies.select("digest", "first"), "copies")
    p = p.join(broadcast_if(copies, copies.count(), BROADCAST_COPIES), "digest", "left")
    revisit = F.coalesce((F.col("first") < F.col("id")) | (F.col("first").isNotNull() & F.col("id").isNull()), F.lit(False)) & (F.col("n") >= min_payload)
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit("\r\n\r\n"))
    block = F.concat(http, F.when(revisit, "").otherwise(F.col("html")))
    target = F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("")), "\r", "%0D"), "\n", "%0A")
    moment = F.date_format(F.timestamp_seconds(F.lit(int(EPOCH.timestamp())) + F.coalesce("id", F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), urn(F.col("id")), F.lit("\r\nWARC-Date: "), moment,
        F.lit("\r\nWARC-Target-URI: "), target, F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), urn(F.col("first")))).otherwise(""),
        F.lit("\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"),
    )
    return p.select(F.concat(head, block).alias("record"))


def records_per_archive(pages: DataFrame, html_col: str = "html", archive_bytes: int = ARCHIVE_BYTES, most_bytes: int = MOST_BYTES) -> int:
    """So many records that an archive has about archive_bytes, and most_bytes if all were as long as the longest."""
    n = F.coalesce(F.octet_length(F.col(html_col).cast("string")), F.lit(0)) + 1024
    r = pages.agg(F.avg(n).alias("mean"), F.max(n).alias("most")).first()
    return max(1, min(int(archive_bytes // r["mean"]), most_bytes // r["most"])) if r["most"] else 1


def write_archives(recs: DataFrame, path: str, per_archive: int) -> None:
    recs.write.option("lineSep", "\r\n\r\n").option("compression", "none").option("maxRecordsPerFile", per_archive).text(path)


def url_key(url: str) -> str:
    """The host's labels from the top down, then path and query, in lower case, without scheme, www, port and fragment."""
    m = re.match(r"(?:[a-z][a-z0-9+.-]*:)?//([^/?#]*)([^#]*)", url.strip().lower())
    if not m:
        return url.strip().lower().split("#")[0]
    host = re.sub(r"^(?:[^@]*@)?(?:www\d*\.)?|:\d*$", "", m[1])
    return ",".join(reversed(host.split("."))) + ")" + (m[2].rstrip("/") or "/")


def parse_archive(data: bytes) -> list[dict]:
    """The records of an archive: headers, payload, position and length; lengths are trusted, not separators."""
    out, at = [], 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        heads = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
        start, n = end + 4, int(heads["content-length"])
        block = data[start : start + n]
        if not lines[0].startswith("WARC/") or data[start + n : start + n + 4] != b"\r\n\r\n":
            raise ValueError(f"no WARC record at {at}")
        http, _, payload = block.partition(b"\r\n\r\n")
        out.append({"heads": heads, "http": http, "payload": payload, "position": at, "length": start + n + 4 - at})
        at = start + n + 4
    return out


def _capture(r: dict, archive: str) -> tuple:
    h, number = r["heads"], lambda s: int(m[1]) if (m := re.search(r":page:(-?\d+)>", s)) else None
    digest, kind = h["warc-payload-digest"].removeprefix("sha1:"), h["warc-type"]
    n = int(re.search(rb"Content-Length: (\d+)", r["http"])[1])
    if kind == "response" and (n != len(r["payload"]) or base64.b32encode(hashlib.sha1(r["payload"]).digest()).decode() != digest):
        raise ValueError(f"the payload of {h['warc-record-id']} is not what its headers say")
    return (number(h["warc-record-id"]), n, digest, kind, number(h.get("warc-refers-to", "")), url_key(h["warc-target-uri"] if h["warc-target-uri"] else ""), h["warc-date"], archive, r["position"], r["length"])


def _order(c: tuple) -> tuple:
    return c[5], c[6], c[0] is not None, c[0] or 0


def _names() -> list[str]:
    return [x.split()[0] for x in CAPTURE.split(", ")]


def _types() -> list:
    return [pa.int64() if x.endswith("long") else pa.string() for x in CAPTURE.split(", ")]


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Captures of all archives under path; those of an archive are a run in local order."""
    def run(batches):
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                got = sorted((_capture(r, name.rsplit("/", 1)[-1]) for r in parse_archive(content.as_py())), key=_order)
                cols = list(zip(*got, strict=True)) or [[]] * len(_names())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _types(), strict=True)], names=_names())

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, CAPTURE)


def loser_tree_merge(runs: list):
    """The tuples of sorted runs in global order; an inner node keeps the loser of its match, so a step replays one path."""
    runs = [iter(r) for r in runs]
    k = len(runs)
    if not k:
        return
    heads = [next(r, None) for r in runs]
    keys = [None if h is None else _order(h) for h in heads]

    def beats(a: int, b: int) -> bool:
        return keys[b] is None or (keys[a] is not None and (keys[a], a) <= (keys[b], b))

    losers = [-1] * k
    for leaf in range(k):
        winner, node = leaf, (leaf + k) // 2
        while node > 0:
            if losers[node] < 0:
                losers[node] = winner
                winner = -1
                break
            if beats(losers[node], winner):
                losers[node], winner = winner, losers[node]
            node //= 2
        if winner >= 0:
            losers[0] = winner
    winner = losers[0]
    while keys[winner] is not None:
        yield heads[winner]
        heads[winner] = next(runs[winner], None)
        keys[winner] = None if heads[winner] is None else _order(heads[winner])
        node = (winner + k) // 2
        while node > 0:
            if beats(losers[node], winner):
                losers[node], winner = winner, losers[node]
            node //= 2


def natural_runs(batches) -> list[list[pa.RecordBatch]]:
    """The rows of batches cut wherever their order falls: each run is a list of slices."""
    out: list[list[pa.RecordBatch]] = []
    last = None
    for b in batches:
        keys = [(u, t, i is not None, i or 0) for u, t, i in zip(*(b.column(_names().index(c)).to_pylist() for c in ("url_key", "captured_at", "page_id")), strict=True)]
        cuts = [0, *(k for k in range(1, len(keys)) if keys[k] < keys[k - 1]), len(keys)] if keys else []
        for i, j in zip(cuts, cuts[1:], strict=False):
            if last is None or i or keys[0] < last:
                out.append([])
            out[-1].append(b.slice(i, j - i))
        last = keys[-1] if keys else last
    return out


def stream(run: list[pa.RecordBatch]):
    """The rows of a run as tuples, a few of them decoded at a time."""
    for b in run:
        for at in range(0, b.num_rows, DECODED):
            yield from zip(*(c.to_pylist() for c in b.slice(at, DECODED).columns), strict=True)


def merge_index(captures: DataFrame, per_range: int = CAPTURES_PER_RANGE) -> DataFrame:
    """captures with index_part and index_place: their order is that of (URL key, time, page id).

    captures must be stored, as its rows are counted and sampled first.  Ranges
    are cut by URL key, time and page, so a single host or URL spreads over many.
    """
    n = max(1, -(-captures.count() // per_range))
    width = len(_names())

    def run(batches):
        part, held, place = TaskContext.get().partitionId(), [], 0
        for r in loser_tree_merge([stream(x) for x in natural_runs(batches)]):
            held.append((*r, part, place))
            place += 1
            if len(held) == 5_000:
                yield _batch(held)
                held = []
        if held:
            yield _batch(held)

    def _batch(held):
        types = [*_types(), pa.int32(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], types[i]) for i in range(width + 2)], names=[*_names(), "index_part", "index_place"])

    ranged = captures.repartitionByRange(n, "url_key", "captured_at", F.col("page_id").asc_nulls_first())
    return ranged.mapInArrow(run, f"{CAPTURE}, index_part int, index_place long")


def captures_of(pages: DataFrame) -> DataFrame:
    """Write pages as archives, read them back and store the archives' runs of captures; the archives go then."""
    spark, path = pages.sparkSession, shared_path(pages.sparkSession, "warc")
    write_archives(records(pages), path, records_per_archive(pages))
    runs = materialise(read_archives(spark, path), "captures")
    remove(spark, path)
    return runs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = merge_index(captures_of(load(spark, sf_dir, "pages")))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "captured_at")


#: SQL for the digests' base 32: five hex digits give four of its digits.
ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, h, min(page_id) OVER (PARTITION BY h) AS first,
        array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
          ((('0x' || substr(h, (5 * (i // 4) + 1)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::BIGINT) & 31)::INT + 1, 1)), '') AS payload_digest FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first < page_id THEN first END AS refers_to, strftime(TIMESTAMP '2024-01-01' + to_seconds(page_id), '%Y-%m-%dT%H:%M:%SZ') AS captured_at FROM d
"""
