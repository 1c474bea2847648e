"""WARC revisit resolution and deduplicated archives.

Captures are rows (record_id, url, payload, digest); a capture without a payload is a revisit record that names the digest
of what it saw. Their headers alone, never the payloads, are shuffled by payload digest: among the captures with a
payload the first by record id, then url, is the original; every other capture of the digest, with a payload of its own
or without, becomes a revisit that refers to it. The verdicts return to the captures by one join on the record's key, and
each record is written to an archive with fresh headers: the original with its payload, a revisit without. What captures hold
is the body of a page without the headers of its transfer, so an original is a `resource` record, not a `response`.

write_archives() makes gzip members, one per record, in files named after their content's partition, in any folder that
Arrow's file systems reach; a file appears under its name only when it is whole, so a task that is run again leaves the
same file; it takes the place of one that is there. Folders without a file system are on Hadoop's default one. Its result is
the index of what was written, and one built under spark.checkpoint.dir goes when the driver ends.

Edge cases: a null payload without a digest, or a revisit whose digest has no original, stays a revisit that refers to
nothing (`unresolved`); an empty payload is a payload; a null url is written as an empty target; control characters in a
url, digest or date, line breaks above all, are left out of headers; a null date is written as DATE; of records that agree in
id, url and digest one is written, with its payload if any of them has one; a null id sorts first; of equal ids the url
decides; an empty table gives an empty index and no file; only the named columns are read, so further columns of any
name do no harm.
"""

from __future__ import annotations

import gzip
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attrweave.llm.common import at_exit, qualified, shared_dir, whole

#: Of records that carry no date of their own.
DATE = "2024-01-01T00:00:00Z"
#: Of the later crawl in the query.
LATER = "2024-02-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_KEY = ["record_id", "url", "digest"]


def digest_of(payload: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(payload.cast("binary"), 256))


def captures(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", digest: str | None = None, date: str | None = None) -> DataFrame:
    """Columns record_id, url, payload (binary), digest, date of a table of captures.

    digest: the column with the digest of captures without payload, if there are any. date: the one with their dates (W3C).
    """
    body = F.col(payload).cast("binary")
    known = F.col(digest).cast("string") if digest else F.lit(None).cast("string")
    return pages.select(whole(pages, key).alias("record_id"), F.col(url).cast("string").alias("url"), body.alias("payload"), F.when(body.isNotNull(), digest_of(body)).otherwise(known).alias("digest"), (F.col(date).cast("string") if date else F.lit(None).cast("string")).alias("date"))


def resolve(records: DataFrame) -> DataFrame:
    """Columns record_id, url, digest, date, warc_type, refers_to, refers_url, refers_date, unresolved: a row for each different record."""
    headers = records.select(*_KEY, "date", F.col("payload").isNotNull().cast("int").alias("has")).groupBy(*_KEY).agg(F.max("has").alias("has"), F.min("date").alias("date"))
    # An original is elected with partial aggregation, so a digest seen a million times is one row a partition.
    first = headers.filter("has = 1").groupBy("digest").agg(F.min(F.struct("record_id", "url", "date")).alias("original"))
    joined = headers.join(first, "digest", "left")
    own = F.col("record_id").eqNullSafe(F.col("original.record_id")) & F.col("url").eqNullSafe(F.col("original.url"))
    response = (F.col("has") == 1) & F.col("original").isNotNull() & own
    return joined.select(
        *_KEY,
        "date",
        F.when(response, F.lit("resource")).otherwise(F.lit("revisit")).alias("warc_type"),
        F.when(~response, F.col("original.record_id")).alias("refers_to"),
        F.when(~response, F.col("original.url")).alias("refers_url"),
        F.when(~response, F.col("original.date")).alias("refers_date"),
        (~response & F.col("original").isNull()).alias("unresolved"),
    )


def _name(record: Column, url: Column, digest: Column) -> Column:
    """A record id that depends on the record alone."""
    h = F.md5(F.concat_ws("|", F.coalesce(record.cast("string"), F.lit("")), F.coalesce(url, F.lit("")), F.coalesce(digest, F.lit(""))))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def with_headers(records: DataFrame, date: str = DATE) -> DataFrame:
    """The verdicts of resolve(), with header (the fresh WARC header block) and payload (null for a revisit)."""
    # The record's key as one column without nulls, so that the join and the removal of repeats share one exchange.
    rid = F.unhex(F.md5(F.to_json(F.struct(*_KEY))))
    verdicts = resolve(records).withColumn("rid", rid)
    one = records.filter("payload is not null").select(rid.alias("rid"), "payload")
    joined = verdicts.join(one, "rid", "left").dropDuplicates(["rid"]).drop("rid")
    joined = joined.withColumn("payload", F.when(F.col("warc_type") == "resource", F.col("payload")))
    clean = lambda value: F.regexp_replace(value, r"[\x00-\x1F\x7F]", "")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), clean(value), F.lit("\r\n"))
    length = F.coalesce(F.octet_length("payload"), F.lit(0))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.col("warc_type")),
        line("WARC-Record-ID", _name(F.col("record_id"), F.col("url"), F.col("digest"))),
        line("WARC-Date", F.coalesce("date", F.lit(date))),
        line("WARC-Target-URI", F.coalesce(F.col("url"), F.lit(""))),
        F.coalesce(line("WARC-Payload-Digest", F.col("digest")), F.lit("")),
        F.when(F.col("warc_type") == "revisit", line("WARC-Profile", F.lit(PROFILE))).otherwise(F.lit("")),
        F.when((F.col("warc_type") == "revisit") & ~F.col("unresolved"), F.concat(line("WARC-Refers-To", _name(F.col("refers_to"), F.col("refers_url"), F.col("digest"))), line("WARC-Refers-To-Target-URI", F.coalesce(F.col("refers_url"), F.lit(""))), line("WARC-Refers-To-Date", F.coalesce("refers_date", F.lit(date))))).otherwise(F.lit("")),
        line("Content-Type", F.when(F.col("warc_type") == "resource", F.lit("text/html")).otherwise(F.lit("message/http"))),
        line("Content-Length", length.cast("string")),
        F.lit("\r\n"),
    )
    return joined.withColumn("content_length", length.cast("long")).withColumn("header", head)


def write_archives(records: DataFrame, folder: str | None = None, date: str = DATE, level: int = 6) -> DataFrame:
    """Writes the deduplicated archives when it is run; the index of the records: what with_headers() has but the payload,
    and file, offset and length of the record's gzip member."""
    spark = records.sparkSession
    base = qualified(spark, folder or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}")
    if folder is None:
        spark._jvm.org.apache.hadoop.fs.Path(base).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(spark._jvm.org.apache.hadoop.fs.Path(base))
        at_exit(spark, base)
    # Arrow's names of file systems.
    base = base.replace("s3a://", "s3://", 1) if base.startswith("s3a://") else base.replace("file:/", "file:///", 1) if base.startswith("file:/") and not base.startswith("file://") else base
    rows = with_headers(records, date)
    names = [c for c in rows.columns if c != "payload"]
    at, head = rows.columns.index("payload"), rows.columns.index("header")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(base)
        system.create_dir(root, recursive=True)
        part = TaskContext.get().partitionId()
        name, draft = f"{root}/part-{part:06d}.warc.gz", f"{root}/.part-{part:06d}.{uuid.uuid4().hex}"
        out, place = None, 0
        for batch in batches:
            offsets, lengths = [], []
            for header, payload in zip(batch.column(head), batch.column(at)):
                if out is None:
                    out = system.open_output_stream(draft, compression=None)
                raw = payload.as_py() or b""
                member = gzip.compress(header.as_py().encode() + raw + b"\r\n\r\n", level, mtime=0)
                out.write(member)
                offsets.append(place)
                lengths.append(len(member))
                place += len(member)
            rest = [c for k, c in enumerate(batch.columns) if k != at]
            yield pa.RecordBatch.from_arrays([*rest, pa.array([f"part-{part:06d}.warc.gz"] * batch.num_rows, pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())], names=[*names, "file", "offset", "length"])
        if out is not None:
            out.close()
            if system.get_file_info(name).type != fs.FileType.NotFound:  # of an earlier run of this task or action
                system.delete_file(name)
            system.move(draft, name)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "payload")
    return rows.mapInArrow(run, f"{schema}, file string, offset long, length long")


#: DuckDB's restatement of op4_warc: each page is a response and, recrawled, a revisit by its digest under the next ids.
SQL = f"""
WITH m AS (SELECT max(page_id) + 1 AS shift FROM pages),
c AS (
  SELECT page_id AS record_id, url, 'sha256:' || sha256(html) AS digest, octet_length(encode(html)) AS n, 1 AS has FROM pages
  UNION ALL
  SELECT page_id + shift, url, 'sha256:' || sha256(html), 0, 0 FROM pages CROSS JOIN m
), o AS (
  SELECT digest, record_id AS refers_to, url AS refers_url
  FROM (SELECT *, row_number() OVER (PARTITION BY digest ORDER BY record_id, url) AS k FROM c WHERE has = 1) WHERE k = 1
), v AS (
  SELECT c.record_id, c.url, c.digest, c.has = 1 AS first_crawl, c.has = 1 AND c.record_id = o.refers_to AND c.url IS NOT DISTINCT FROM o.refers_url AS response, n, o.refers_to, o.refers_url
  FROM c JOIN o ON c.digest = o.digest
), i AS (
  SELECT *, md5(concat_ws('|', CAST(record_id AS VARCHAR), coalesce(url, ''), digest)) AS h, md5(concat_ws('|', CAST(refers_to AS VARCHAR), coalesce(refers_url, ''), digest)) AS g FROM v
)
SELECT record_id, url, digest, CASE WHEN first_crawl THEN NULL ELSE '{LATER}' END AS date, CASE WHEN response THEN 'resource' ELSE 'revisit' END AS warc_type,
       CASE WHEN NOT response THEN refers_to END AS refers_to, CASE WHEN NOT response THEN refers_url END AS refers_url, CAST(NULL AS VARCHAR) AS refers_date, false AS unresolved,
       CASE WHEN response THEN n ELSE 0 END AS content_length,
       'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: ' || CASE WHEN response THEN 'resource' ELSE 'revisit' END || chr(13) || chr(10)
       || 'WARC-Record-ID: <urn:uuid:' || substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) || '>' || chr(13) || chr(10)
       || 'WARC-Date: ' || CASE WHEN first_crawl THEN '{DATE}' ELSE '{LATER}' END || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(regexp_replace(url, '[[:cntrl:]]', '', 'g'), '') || chr(13) || chr(10)
       || 'WARC-Payload-Digest: ' || digest || chr(13) || chr(10)
       || CASE WHEN response THEN '' ELSE 'WARC-Profile: {PROFILE}' || chr(13) || chr(10)
          || 'WARC-Refers-To: <urn:uuid:' || substr(g, 1, 8) || '-' || substr(g, 9, 4) || '-' || substr(g, 13, 4) || '-' || substr(g, 17, 4) || '-' || substr(g, 21, 12) || '>' || chr(13) || chr(10)
          || 'WARC-Refers-To-Target-URI: ' || coalesce(regexp_replace(refers_url, '[[:cntrl:]]', '', 'g'), '') || chr(13) || chr(10)
          || 'WARC-Refers-To-Date: {DATE}' || chr(13) || chr(10) END
       || 'Content-Type: ' || CASE WHEN response THEN 'text/html' ELSE 'message/http' END || chr(13) || chr(10)
       || 'Content-Length: ' || CAST(CASE WHEN response THEN n ELSE 0 END AS VARCHAR) || chr(13) || chr(10) || chr(13) || chr(10) AS header
FROM i
"""
