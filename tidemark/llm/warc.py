"""WARC archives: writing captures, reading archives, and assembling transactions.

A capture is three records: the request, the response (or a revisit of an earlier
response with the same payload) and metadata.  Request and metadata name the response
by ``WARC-Concurrent-To``; assembly joins the three by it and gives one nested row a
capture.

Archives are written by Spark's own text writer, one record a row with the records'
closing line breaks as line separator, so that they go through Spark's committers to
any store it can reach.  They are read as a stream, by Spark's text reader with the same
separator, whose pieces are put together again and cut by ``Content-Length``, never at
line breaks, so that payloads may hold anything and no archive is held whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.storage import materialize, new_path

RECORD_END = "\r\n\r\n"
NL = "\r\n"
#: Bytes of records, before compression, that an archive holds at least while there are fewer archives than tasks of a shuffle, and at most.
SMALL_BYTES, FILE_BYTES = 16 << 20, 1 << 30
CUT = 1 << 20

RECORD_SCHEMA = "record_id string, type string, target_uri string, date string, concurrent_to string, refers_to string, content_type string, header map<string,string>, http_header string, payload binary"


def _uuid(*parts) -> F.Column:
    """A record id that is the same in every run: a hash in the form of a UUID."""
    h = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("\\N")) for p in parts]))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", h.substr(1, 8), h.substr(9, 4), h.substr(13, 4), h.substr(17, 4), h.substr(21, 12)), F.lit(">"))


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 100) -> DataFrame:
    """``id, url, payload, bytes, digest, kind, refers_id``: which captures are responses, which revisits.

    Rows come dealt by id and digest over as many partitions as archives are to be written,
    so that an archive is of bounded size whatever the number of pages.

    Of captures with equal payloads of at least ``least_bytes`` bytes, those with the
    smallest id are responses (rows that repeat that id all are), the others revisit
    it.  A null payload is empty.  A capture with a null id is always a response.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumns({"digest": F.sha2("payload", 256), "bytes": F.octet_length("payload").cast("long")})
    # ids, sizes and digests are worked out once for all that payloads are not needed for
    narrow = materialize(rows.select("id", "bytes", "digest"), "digests")
    # combined map-side, so a payload that a third of the pages share is no hot spot
    shared = narrow.where(F.col("bytes") >= least_bytes).groupBy("digest").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id")).where("first_id < last_id")
    revisits = narrow.where("id is not null").select("id", "digest").distinct().join(shared.select("digest", "first_id"), "digest").where("id > first_id")
    revisits = materialize(revisits.select(F.concat_ws("|", F.col("id").cast("string"), "digest").alias("__key"), F.col("first_id").alias("refers_id")), "revisits")
    # payloads are dealt once, over as many files as their bytes need, and stay there for the join and for the archives
    total = narrow.agg(F.sum(F.col("bytes") + 1000)).first()[0] or 0
    few = min(int(total // SMALL_BYTES), 2 * int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    files = max(int(total // FILE_BYTES), few) + 1
    dealt = rows.withColumn("__key", F.concat_ws("|", F.coalesce(F.col("id").cast("string"), F.lit("-")), "digest")).repartition(files, "__key")
    joined = dealt.join(revisits.repartition(files, "__key"), "__key", "left").drop("__key")
    kind = F.when(F.col("refers_id").isNotNull(), "revisit").otherwise("response")
    return joined.select("id", "url", "payload", "bytes", "digest", kind.alias("kind"), "refers_id")


def write_archives(captures: DataFrame, path: str, date: str = "2020-01-01T00:00:00Z") -> None:
    """Write ``plan_records`` rows as gzipped WARC files, one a partition: request, response or revisit, and metadata of each.

    A file is one gzip member, as Spark's text writer makes it.
    """
    rid = _uuid(F.lit("response"), F.col("id"), F.col("digest"))
    uri = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20\x7f]", "%20")
    digest = F.concat(F.lit("sha256:"), F.col("digest"))

    def record(*fields, body) -> F.Column:
        head = [F.lit("WARC/1.1")] + [F.concat(F.lit(f"{name}: "), value) for name, value in fields]  # a null value leaves its field out
        return F.concat(F.concat_ws(NL, *head, F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string"))), F.lit(NL + NL), body)

    when = F.lit(date)
    host = F.regexp_extract(uri, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1)
    request_body = F.concat(F.lit("GET "), uri, F.lit(f" HTTP/1.1{NL}Host: "), host, F.lit(NL + NL))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{NL}Content-Type: text/html; charset=utf-8{NL}Content-Length: "), F.octet_length("payload").cast("string"), F.lit(NL + NL))
    is_response = F.col("kind") == "response"
    request = record(
        ("WARC-Type", F.lit("request")), ("WARC-Record-ID", _uuid(F.lit("request"), F.col("id"), F.col("digest"))), ("WARC-Date", when), ("WARC-Target-URI", uri), ("WARC-Concurrent-To", rid),
        ("Content-Type", F.lit("application/http; msgtype=request")), body=request_body,
    )
    response = record(
        ("WARC-Type", F.col("kind")), ("WARC-Record-ID", rid), ("WARC-Date", when), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", digest),
        ("WARC-Refers-To", F.when(~is_response, _uuid(F.lit("response"), F.col("refers_id"), F.col("digest")))), ("WARC-Profile", F.when(~is_response, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        ("Content-Type", F.lit("application/http; msgtype=response")), body=F.when(is_response, F.concat(http, F.col("payload"))).otherwise(http),
    )
    metadata = record(
        ("WARC-Type", F.lit("metadata")), ("WARC-Record-ID", _uuid(F.lit("metadata"), F.col("id"), F.col("digest"))), ("WARC-Date", when), ("WARC-Target-URI", uri), ("WARC-Concurrent-To", rid),
        ("Content-Type", F.lit("application/warc-fields")), body=F.concat(F.lit("captureId: "), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(NL)),
    )
    rows = captures.select(F.explode(F.array(request, response, metadata)).alias("value"))
    rows.write.option("compression", "gzip").option("lineSep", RECORD_END).text(path)


def parse_records(data: bytes, damage: list[str] | None = None) -> Iterator[tuple]:
    """The records of one archive (gzipped or not, of one member or many), as ``parse_stream`` gives them."""
    damage = [] if damage is None else damage
    return parse_stream(_inflate(data, damage), damage)


def parse_stream(feed: Iterator[bytes], damage: list[str] | None = None) -> Iterator[tuple]:
    """The records of one archive that comes in pieces, as rows of ``RECORD_SCHEMA``; a record at a time is held.

    A damaged or cut-off record ends the archive: what stands before it is returned, and
    what is wrong is added to ``damage``.
    """
    damage = [] if damage is None else damage
    buffer = bytearray()
    at = 0

    def more() -> bool:
        piece = next(feed, None)
        if piece is None:
            return False
        buffer.extend(piece)
        return True

    while True:
        while (end := buffer.find(b"\r\n\r\n", at)) < 0 and more():
            pass
        if end < 0 or not buffer[at : at + 5] == b"WARC/":
            if buffer[at:].strip():
                damage.append("no record header")
            return
        fields: dict[str, str] = {}
        for line in buffer[at:end].split(b"\r\n")[1:]:
            name, _, value = line.partition(b":")
            fields[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
        if not fields.get("content-length", "").isdigit():
            damage.append("no content length")
            return
        start, length = end + 4, int(fields["content-length"])
        while len(buffer) < start + length and more():
            pass
        if len(buffer) < start + length:
            damage.append("record cut off")
            return
        block = bytes(buffer[start : start + length])
        http, payload = None, block
        if fields.get("content-type", "").startswith("application/http"):
            head, gap, payload = block.partition(b"\r\n\r\n")
            http = head.decode("utf-8", "replace")
        keep = {k: v for k, v in fields.items() if k.startswith("warc-")}
        yield (fields.get("warc-record-id"), fields.get("warc-type"), fields.get("warc-target-uri"), fields.get("warc-date"), fields.get("warc-concurrent-to"), fields.get("warc-refers-to"), fields.get("content-type"), keep, http, payload)
        at = start + length
        while len(buffer) < at + 4 and more():
            pass
        while buffer[at : at + 2] == b"\r\n":
            at += 2
        if at > CUT:
            del buffer[:at]
            at = 0


def _inflate(data: bytes, damage: list[str]) -> Iterator[bytes]:
    if data[:2] != b"\x1f\x8b":
        for at in range(0, len(data), CUT):
            yield data[at : at + CUT]
        return
    while data[:2] == b"\x1f\x8b":
        z = zlib.decompressobj(31)
        rest = data
        try:
            while not z.eof and (piece := z.decompress(rest, CUT)):
                yield piece
                rest = z.unconsumed_tail
        except zlib.error as e:
            damage.append(str(e))
            return
        if not z.eof:
            damage.append("gzip member cut off")
        data = z.unused_data


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives under ``path``, read record by record.

    Gzipped archives (``.gz``) are streams, of any size; others, which Spark would cut
    anywhere, are read a file at a time.
    """
    names = [f.split(" ")[0] for f in RECORD_SCHEMA.split(", ")]

    def frames(records: Iterator[tuple]) -> Iterator[pd.DataFrame]:
        rows, size = [], 0
        for row in records:
            rows.append(row)
            size += len(row[-1])
            if size > 4 * CUT:
                yield pd.DataFrame(rows, columns=names)
                rows, size = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=names)

    def streams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = (row for batch in batches for row in zip(batch["file"], batch["piece"], strict=True))
        for _, own in groupby(pieces, key=lambda row: row[0]):
            yield from frames(parse_stream(piece + RECORD_END.encode() for _, piece in own))

    def files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                yield from frames(parse_records(content))

    zipped = spark.read.option("lineSep", RECORD_END).option("ignoreCorruptFiles", True).option("pathGlobFilter", "*.gz").text(path)
    zipped = zipped.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("piece")).mapInPandas(streams, RECORD_SCHEMA)
    return zipped.unionByName(spark.read.format("binaryFile").option("pathGlobFilter", "*[!z]").load(path).select("content").mapInPandas(files, RECORD_SCHEMA))


def damaged_archives(spark: SparkSession, path: str) -> DataFrame:
    """``archive, records, damage``: archives that end early, the records before that, and what is wrong."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for archive, content in zip(batch["path"], batch["content"], strict=True):
                damage: list[str] = []
                n = sum(1 for _ in parse_records(content, damage))
                if damage:
                    rows.append((archive, n, "; ".join(damage)))
            yield pd.DataFrame(rows, columns=["archive", "records", "damage"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "archive string, records long, damage string")


def assemble_captures(records: DataFrame, keep_payload: bool = True) -> DataFrame:
    """One nested row a capture: ``record_id, url, request, response, metadata``.

    Requests and metadata join the response or revisit that they are concurrent to;
    either may be missing and is null then (of several, the least counts).  ``response``
    holds the payload's size and SHA-256, taken from the payload as read.  A revisit's
    come from the response that it refers to, with its record id in ``refers_to``; they
    are null if that isn't there.  A response that is there twice gives two rows.
    """
    known = records.where("record_id is not null").withColumns({"size": F.octet_length("payload").cast("long"), "sha256": F.sha2("payload", 256), "note": F.when(F.col("type") == "metadata", F.decode("payload", "utf-8"))})
    # the archives are read once; the payload goes along only where it is asked for
    known = materialize(known.select("record_id", "type", "target_uri", "date", "concurrent_to", "refers_to", "http_header", "size", "sha256", "note", *(["payload"] if keep_payload else [])), "records")
    main = known.where(F.col("type").isin("response", "revisit"))
    original = main.where("type = 'response'").groupBy(F.col("record_id").alias("refers_to")).agg(F.min(F.struct("size", "sha256")).alias("o"))
    # responses refer to nothing: without them, no task gets all the nulls
    alone = main.where(F.col("refers_to").isNull()).withColumn("o", F.lit(None).cast("struct<size: bigint, sha256: string>"))
    whole = main.where(F.col("refers_to").isNotNull()).join(original, "refers_to", "left").unionByName(alone)
    revisit = F.col("type") == "revisit"
    response = F.struct(
        "type", "date", "http_header", F.when(revisit, F.col("o.size")).otherwise(F.col("size")).alias("payload_bytes"),
        F.when(revisit, F.col("o.sha256")).otherwise(F.col("sha256")).alias("payload_digest"), "refers_to", *(["payload"] if keep_payload else []),
    )
    nested = whole.select("record_id", F.col("target_uri").alias("url"), response.alias("response"))

    def side(kind: str) -> DataFrame:
        own = F.struct("record_id", "date", "http_header", "note")
        return known.where((F.col("type") == kind) & F.col("concurrent_to").isNotNull()).select(F.col("concurrent_to").alias("record_id"), own.alias(kind)).groupBy("record_id").agg(F.min(kind).alias(kind))

    return nested.join(side("request"), "record_id", "left").join(side("metadata"), "record_id", "left").select("record_id", "url", "request", "response", "metadata")


def page_id_of(captures: DataFrame) -> DataFrame:
    """Captures with the ``page_id`` that their metadata records name, and ``refers_page``, that of the response a revisit refers to."""
    named = captures.withColumn("page_id", F.regexp_extract("metadata.note", r"captureId: (-?\d+)", 1).try_cast("long"))
    known = named.where("response.type = 'response'").groupBy(F.col("record_id").alias("__r")).agg(F.min("page_id").alias("refers_page"))
    found = named.where("response.refers_to is not null").withColumn("__r", F.col("response.refers_to")).join(known, "__r", "left").drop("__r")
    return found.unionByName(named.where("response.refers_to is null").withColumn("refers_page", F.lit(None).cast("long")))


def archive_round_trip(pages: DataFrame, path: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", keep_payload: bool = False) -> DataFrame:
    """Write ``pages`` as archives under ``path`` (a new folder in the shared one), read them back, assemble the captures.

    One row for each row of ``pages``: null urls are empty ones, null html is an empty
    payload, a null id comes back null, repeated rows are captures of their own.
    """
    path = path or new_path(pages.sparkSession, "warc")
    planned = plan_records(pages, id_col, url_col, html_col)
    write_archives(planned, path)
    return page_id_of(assemble_captures(read_archives(pages.sparkSession, path), keep_payload))
