"""WARC archives: writing captures, reading records, assembling transactions.

A capture is three records: request, response (or revisit) and metadata, the first and the last naming the
second in WARC-Concurrent-To. Archives are written by Spark's text writer, whose line separator is the end
of a record, and read by Spark's text reader, so any store that Spark reads will do. Files are gzip streams,
which a reader never splits; a record is framed by its Content-Length alone, so a payload may hold any bytes.

Of records with equal payloads of at least REVISIT_BYTES the one with the smallest page_id (then url) is the
response and the others revisit it; smaller ones are all responses.

Defined cases: a null payload is empty; a null page_id makes a record without the page-id field and sorts
last; a null url is written as about:blank and read back as null; repeated rows (alike in
page_id, url and payload) each get records of their own and are alike: all responses, or all revisits of the
first; an empty table gives an archive without
records; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmine.llm.common import fresh_path, mapped

REVISIT_BYTES = 100
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EOL = "\r\n"


def _lines(*parts) -> F.Column:
    """Header lines, a null part leaving out its line."""
    return F.concat(*[F.coalesce(F.concat(p, F.lit(EOL)), F.lit("")) for p in parts])


def _record(kind, uid, head: list, block) -> F.Column:
    return F.concat(
        _lines(
            F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), uid), F.lit(f"WARC-Date: {DATE}"), *head,
            F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
        ),
        F.lit(EOL), block,
    )


def records(pages: DataFrame) -> DataFrame:
    """One column value: the text of a record, three rows a page."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload")
    )
    rows = rows.withColumn("digest", F.sha2(F.col("payload").cast("binary"), 256)).withColumn("bytes", F.octet_length("payload"))
    rank = F.struct(F.col("page_id").isNull().alias("z"), "page_id", F.col("url").isNull().alias("y"), "url")
    # Only digests that occur twice are looked up; their table is much smaller than the payloads, which move once.
    firsts = rows.where(F.col("bytes") >= REVISIT_BYTES).groupBy("digest").agg(F.min(rank).alias("first"), F.count("*").alias("n")).where("n > 1")
    first = F.col("first")
    rows = rows.join(firsts.hint("shuffle_hash"), "digest", "left").withColumn("uid", F.expr("uuid()"))
    same = F.col("page_id").eqNullSafe(first["page_id"]) & F.col("url").eqNullSafe(first["url"])
    rows = rows.withColumn("revisit", first.isNotNull() & ~same)
    uid = lambda what: F.concat(F.lit(f"<urn:capture:{what}:"), F.coalesce(F.col("page_id").cast("string"), F.lit("-")), F.lit(":"), F.col("uid"), F.lit(">"))
    page = F.concat(F.lit("X-Page-ID: "), F.col("page_id").cast("string"))
    target = F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", r"[\r\n]", "%0A"))
    digest = F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest"))
    ok = F.concat(F.lit(f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}Content-Length: "), F.col("bytes").cast("string"), F.lit(EOL + EOL))
    main = uid("response")
    concurrent = F.concat(F.lit("WARC-Concurrent-To: "), main)
    refers = F.when(F.col("revisit"), F.concat(F.lit("X-Refers-To-Page: "), first["page_id"].cast("string")))
    response = _record(
        F.when(F.col("revisit"), "revisit").otherwise("response"), main,
        [target, page, digest, F.lit("Content-Type: application/http; msgtype=response"), F.when(F.col("revisit"), F.lit(f"WARC-Profile: {PROFILE}")), refers,
         F.when(F.col("revisit"), F.concat(F.lit("WARC-Refers-To-Target-URI: "), F.regexp_replace(first["url"], r"[\r\n]", "%0A")))],
        F.when(F.col("revisit"), ok).otherwise(F.concat(ok, F.col("payload"))),
    )
    request = _record(F.lit("request"), uid("request"), [target, page, concurrent, F.lit("Content-Type: application/http; msgtype=request")], F.concat(F.lit("GET "), F.coalesce(F.regexp_replace("url", r"\s", "%20"), F.lit("about:blank")), F.lit(f" HTTP/1.1{EOL}{EOL}")))
    metadata = _record(F.lit("metadata"), uid("metadata"), [target, page, concurrent, F.lit("Content-Type: application/warc-fields")], _lines(F.concat(F.lit("payload-bytes: "), F.col("bytes").cast("string"))))
    return rows.select(F.explode(F.array(request, response, metadata)).alias("value"))


def write(pages: DataFrame, path: str) -> None:
    """Writes the pages' captures as gzipped archives into a folder."""
    records(pages).write.option("lineSep", EOL + EOL).option("compression", "gzip").text(path)


_FIELDS = "type string, record_id string, concurrent_to string, target_uri string, page_id long, refers_to long, payload_digest string, headers map<string,string>, http string, block binary"


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of whole archives, line by line; a record is held until its Content-Length is reached."""
    schema = pa.schema([(n, pa.string()) for n in ("type", "record_id", "concurrent_to", "target_uri")] + [("page_id", pa.int64()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("headers", pa.map_(pa.string(), pa.string())), ("http", pa.string()), ("block", pa.binary())])
    head: dict[str, str] | None = None
    body: list[bytes] = []
    need = got = 0
    in_block = False
    out: list[dict] = []
    held = 0

    def done(block: bytes) -> None:
        h = head or {}
        number = lambda k: int(h[k]) if k in h else None
        http = None
        if h.get("Content-Type", "").startswith("application/http"):
            top, _, block = block.partition(b"\r\n\r\n")
            http = top.decode("utf-8", "replace")
        out.append({"type": h.get("WARC-Type"), "record_id": h.get("WARC-Record-ID"), "concurrent_to": h.get("WARC-Concurrent-To"), "target_uri": h.get("WARC-Target-URI"), "page_id": number("X-Page-ID"), "refers_to": number("X-Refers-To-Page"), "payload_digest": h.get("WARC-Payload-Digest", "").removeprefix("sha256:") or None, "headers": list(h.items()), "http": http, "block": block})

    for batch in batches:
        for value in batch.column(0):
            line = value.as_py()
            if in_block:
                body.append(line)
                got += len(line) + 2
                # The block ends in a line, or with one: the separator that follows it isn't part of it.
                if got - 2 >= need:
                    done(b"\r\n".join(body)[:need])
                    held += need
                    head, body, in_block = None, [], False
            elif head is None:
                if line.startswith(b"WARC/"):
                    head = {}
            elif line:
                key, _, text = line.decode("utf-8", "replace").partition(": ")
                head[key] = text
            else:
                need, got, in_block = int(head.get("Content-Length", 0)), 0, True
            if len(out) >= 256 or held > 8 << 20:
                yield pa.RecordBatch.from_pylist(out, schema)
                out, held = [], 0
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of a folder of archives: type, ids, target, digest, all headers, and the block.

    Of HTTP records, http is the head (found on bytes) and block what follows it.
    """
    lines = spark.read.option("lineSep", EOL).text(path).select(F.col("value").cast("binary").alias("value"))
    return mapped(lines, _parsed, _FIELDS)


def transactions(found: DataFrame, payload: bool = True) -> DataFrame:
    """One nested row per capture: its response or revisit with the request and metadata records concurrent to it.

    The response holds the HTTP head, and length, SHA-256 and bytes of the payload that was read (without the
    bytes if payload is false, so that they don't move). A capture without a request or metadata record has
    null there; several are all kept, in the order of their ids.
    """
    main = found.where(F.col("type").isin("response", "revisit")).withColumnRenamed("block", "payload")
    read_back = [F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256")]
    main = main.select(
        F.col("record_id").alias("capture_id"), "page_id", "target_uri",
        F.struct("type", "record_id", "payload_digest", "refers_to", "http", *read_back, *(["payload"] if payload else [])).alias("response"),
    )
    side = found.where(F.col("type").isin("request", "metadata") & F.col("concurrent_to").isNotNull()).select(
        F.col("concurrent_to").alias("capture_id"), "type", F.struct("record_id", "http", F.col("block").cast("string").alias("block")).alias("r")
    )
    pick = lambda kind: F.array_sort(F.collect_list(F.when(F.col("type") == kind, F.col("r")))).alias(kind)
    return main.join(side.groupBy("capture_id").agg(pick("request"), pick("metadata")), "capture_id", "left")


def captures(pages: DataFrame, payload: bool = True) -> DataFrame:
    """Writes the pages to archives in the shared folder, reads these back and assembles the captures."""
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    write(pages, path)
    return transactions(read(spark, path), payload)


def digest_rows(found: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, requests, metadata_records of assembled captures.

    A response's length and digest are those of the payload read; a revisit has no payload, so its length is
    the one that its metadata record states and its digest that of its header. A response whose metadata
    record states another length than was read has a null length.
    """
    r = F.col("response")
    full = r["type"] == "response"
    stated = F.regexp_extract(F.col("metadata")[0]["block"], r"payload-bytes: (\d+)", 1).cast("long")
    return found.select(
        "page_id",
        F.when(~full | (stated == r["payload_bytes"]), stated).alias("payload_bytes"),
        F.when(full, r["payload_sha256"]).otherwise(r["payload_digest"]).alias("payload_digest"),
        r["type"].alias("record_type"), r["refers_to"].alias("refers_to"),
        F.greatest(F.size("request"), F.lit(0)).alias("requests"), F.greatest(F.size("metadata"), F.lit(0)).alias("metadata_records"),
    )


#: DuckDB SQL for the query op8_warc.
SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes,
         sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to, 1 AS requests, 1 AS metadata_records
FROM f
"""
