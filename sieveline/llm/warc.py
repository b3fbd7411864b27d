"""Op 7: WARC archives with revisits and segments, written by Spark and reassembled.

`write` puts one logical record for each page into gzipped archive files: a response whose block is an HTTP message with
chunked transfer coding, or a revisit (of the page with the largest id among equal payloads of at least LEAST bytes).
Blocks of more than SEGMENT characters are cut: the first part carries segment number 1, the others are continuation
records with the origin's identifier, and the last one the total length. `read` takes archive files of at most
PER_FILE records, groups segments by origin identifier, orders them by number, verifies count and total length, decodes the
chunked framing and verifies the digest; a record that fails any of these has an `error` instead of a payload. A file
that breaks off, or holds no records, gives the records before that place and one row of error without identifier.

Null html is an empty payload. Repeated and null page ids are told apart by their rank in the order of (page_id, url,
html). Columns of other names are not read. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

LEAST, SEGMENT, CHUNK, PER_FILE = 1000, 16_384, 4_096, 1000
RECORD = "urn:sieveline:page:"
EOL = "\r\n"


def _cut(text: Column, size: int) -> Column:
    """The text in parts of `size` characters; one empty part for an empty text."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)), F.lit(size))
    return F.transform(starts, lambda s: F.substring(text, s, F.lit(size)))


def _bytes(text: Column) -> Column:
    return F.octet_length(text)


def message(html: Column) -> Column:
    """An HTTP response in chunked transfer coding."""
    parts = F.filter(_cut(html, CHUNK), lambda p: p != "")
    framed = F.transform(parts, lambda p: F.concat(F.lower(F.hex(_bytes(p).cast("long"))), F.lit(EOL), p, F.lit(EOL)))
    head = EOL.join(("HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", "Transfer-Encoding: chunked", "", ""))
    return F.concat(F.lit(head), F.concat_ws("", framed), F.lit(f"0{EOL}{EOL}"))


def records(pages: DataFrame) -> DataFrame:
    """One row `value` for each WARC record, without the two line ends that follow it."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.regexp_replace(F.coalesce(F.col("url").cast("string"), F.lit("")), r"[\r\n]+", " ").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = C.numbered(rows, "page_id", "url", "html")[0].withColumnRenamed("_row", "row").withColumn("digest", F.sha1(F.encode("html", "UTF-8"))).withColumn("n", _bytes(F.col("html")))
    copies = rows.where(F.col("n") >= LEAST).groupBy("digest", "n").agg(F.max(F.struct("page_id", "row")).alias("origin"), F.count(F.lit(1)).alias("k")).where("k > 1")
    rows = rows.join(copies.select("digest", "n", "origin"), ["digest", "n"], "left")

    def name(page: Column, row: Column) -> Column:
        return F.concat(F.lit(RECORD), F.coalesce(page.cast("string"), F.lit("")), F.lit(":"), row.cast("string"))

    rid, to = name(F.col("page_id"), F.col("row")), name(F.col("origin.page_id"), F.col("origin.row"))
    again = F.col("origin").isNotNull() & (F.col("origin.row") != F.col("row"))
    empty = F.lit(f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}{EOL}")
    rows = rows.select("url", "digest", rid.alias("rid"), F.when(again, to).alias("refers"), F.when(again, empty).otherwise(message(F.col("html"))).alias("block"))
    parts = rows.withColumn("total", _bytes(F.col("block"))).withColumn("last", F.ceil(F.length("block") / SEGMENT))
    parts = parts.select("url", "digest", "rid", "refers", "total", "last", F.posexplode(_cut(F.col("block"), SEGMENT)).alias("at", "part"))
    number = F.col("at") + 1
    first, cut = F.col("at") == 0, F.col("last") > 1

    def line(name: str, value: Column, when: Column | None = None) -> Column:
        text = F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(EOL))
        return text if when is None else F.when(when, text).otherwise(F.lit(""))

    def angle(x: Column) -> Column:
        return F.concat(F.lit("<"), x, F.lit(">"))

    value = F.concat(
        F.lit(f"WARC/1.1{EOL}"),
        line("WARC-Type", F.when(~first, "continuation").when(F.col("refers").isNotNull(), "revisit").otherwise("response")),
        line("WARC-Record-ID", angle(F.when(first, F.col("rid")).otherwise(F.concat("rid", F.lit(":"), number.cast("string"))))),
        line("WARC-Target-URI", F.col("url"), first),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest"), first),
        line("WARC-Refers-To", angle(F.col("refers")), first & F.col("refers").isNotNull()),
        line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), first & F.col("refers").isNotNull()),
        line("WARC-Segment-Number", number, cut),
        line("WARC-Segment-Origin-ID", angle(F.col("rid")), ~first),
        line("WARC-Segment-Total-Length", F.col("total"), cut & (number == F.col("last"))),
        line("Content-Type", F.lit("application/http; msgtype=response"), first),
        line("Content-Length", _bytes(F.col("part"))),
        F.lit(EOL),
        F.col("part"),
    )
    return parts.select(value.alias("value"))


def write(pages: DataFrame, path: str) -> None:
    with C.cleaned(pages.sparkSession):
        records(pages).write.option("lineSep", EOL * 2).option("maxRecordsPerFile", PER_FILE).option("compression", "gzip").text(path)


def unpacked(raw: bytes) -> bytes:
    """What can be read of a gzip file, of any number of members; other files as they are."""
    if raw[:2] != b"\x1f\x8b":
        return raw
    out = []
    while raw[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        try:
            out.append(member.decompress(raw))
        except zlib.error:
            break
        raw = member.unused_data
    return b"".join(out)


def parsed(data: bytes) -> Iterator[dict]:
    """Records of one archive, by their content lengths; a ValueError where it breaks off."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        version, *lines = data[at : max(end, at)].decode("utf-8", "replace").split(EOL)
        head = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = head.get("content-length", "")
        if end < 0 or not version.startswith("WARC/") or not size.isdecimal():
            raise ValueError(f"no record at byte {at}")
        n = int(size)
        block = data[end + 4 : end + 4 + n]
        if len(block) < n or data[end + 4 + n : end + 8 + n] != b"\r\n\r\n":
            raise ValueError(f"truncated record at byte {at}")
        at = end + 8 + n
        plain = lambda k: head[k].strip("<>") if k in head else None  # noqa: E731, B023
        whole = lambda k: int(head[k]) if head.get(k, "").isdecimal() else None  # noqa: E731, B023
        yield {"type": head.get("warc-type"), "rid": plain("warc-segment-origin-id") or plain("warc-record-id"), "digest": (head.get("warc-payload-digest") or "").removeprefix("sha1:"), "refers": plain("warc-refers-to"), "number": whole("warc-segment-number"), "total": whole("warc-segment-total-length"), "block": block}


SEGMENTS = pa.schema([("type", pa.string()), ("rid", pa.string()), ("digest", pa.string()), ("refers", pa.string()), ("number", pa.int64()), ("total", pa.int64()), ("block", pa.binary()), ("broken", pa.string())])


def _parse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data in batch.column(0):
            rows = []
            try:
                for r in parsed(unpacked(data.as_py())):
                    rows.append(r)
                    if len(rows) >= 500:
                        yield from pa.Table.from_pylist(rows, schema=SEGMENTS).to_batches()
                        rows = []
            except ValueError as e:
                rows.append({"broken": str(e)})
            yield from pa.Table.from_pylist(rows, schema=SEGMENTS).to_batches()


def dechunked(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("broken chunk")
        n = int(body[at:end].split(b";")[0], 16)
        if not n:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + n])
        if len(out[-1]) < n or body[end + 2 + n : end + 4 + n] != b"\r\n":
            raise ValueError("broken chunk")
        at = end + 4 + n


def payload(block: bytes) -> bytes:
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap:
        raise ValueError("no HTTP header")
    return dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body


WHOLE = pa.schema([("rid", pa.string()), ("type", pa.string()), ("refers", pa.string()), ("digest", pa.string()), ("payload", pa.binary()), ("error", pa.string())])


def _decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            row = {"rid": r["rid"], "type": r["type"], "refers": r["refers"], "digest": r["digest"], "payload": None, "error": r["broken"]}
            if r["broken"]:
                rows.append(row)
                continue
            parts = sorted(r["parts"], key=lambda p: p["number"])
            block = b"".join(p["block"] for p in parts)
            try:
                if [p["number"] for p in parts] != list(range(1, len(parts) + 1)) or r["type"] is None:
                    raise ValueError("missing or repeated segment")
                if (len(parts) > 1 or r["cut"]) and parts[-1]["total"] != len(block):
                    raise ValueError("total length differs")
                if r["type"] == "response":
                    row["payload"] = payload(block)
                    if r["digest"] and hashlib.sha1(row["payload"]).hexdigest() != r["digest"]:
                        raise ValueError("payload digest differs")
            except ValueError as e:
                row |= {"payload": None, "error": str(e)}
            rows.append(row)
        yield from pa.Table.from_pylist(rows, schema=WHOLE).to_batches()


def read(spark: SparkSession, path: str) -> DataFrame:
    """rid, type, refers, digest, payload (null for revisits), error of every logical record under `path`."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt*").load(path)
    segments = files.select("content").mapInArrow(_parse, "type string, rid string, digest string, refers string, number long, total long, block binary, broken string")
    part = F.struct(F.coalesce("number", F.lit(1)).cast("long").alias("number"), "total", "block")
    one = segments.where("number IS NULL").select("rid", "type", "refers", "digest", F.lit(False).alias("cut"), "broken", F.array(part).alias("parts"))
    first = F.col("type") != "continuation"
    many = segments.where("number IS NOT NULL").groupBy("rid").agg(*(F.max(F.when(first, F.col(c))).alias(c) for c in ("type", "refers", "digest")), F.lit(True).alias("cut"), F.lit(None).cast("string").alias("broken"), F.collect_list(part).alias("parts"))
    return one.unionByName(many).mapInArrow(_decode, "rid string, type string, refers string, digest string, payload binary, error string")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = C.new_path(spark, "archives")
    write(C.table(spark, sf_dir, "pages"), path)
    back = C.materialize(read(spark, path).select("rid", "type", "refers", "digest", "error", F.octet_length("payload").cast("long").alias("n"), F.sha1("payload").alias("sha1")), "records")

    def page(x: str) -> Column:
        return F.element_at(F.split(F.substring(F.col(x), len(RECORD) + 1, 100), ":"), 1).try_cast("long")

    wanted = back.where("type = 'revisit'").select(F.col("refers").alias("rid")).distinct()
    origin = back.join(wanted, "rid", "left_semi").select(F.col("rid").alias("to"), F.col("n").alias("n_to"), F.col("sha1").alias("sha1_to"))
    full = back.join(origin, back["refers"] == origin["to"], "left")
    return full.select(page("rid").alias("page_id"), F.coalesce("n", "n_to").alias("payload_bytes"), F.coalesce("sha1", "sha1_to").alias("payload_digest"), F.col("type").alias("record_type"), page("refers").alias("refers_to"), "error")


OP7_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS s FROM pages),
last AS (SELECT n, s, max(page_id) AS origin FROM p WHERE n >= 1000 GROUP BY n, s)
SELECT page_id, CAST(p.n AS BIGINT) AS payload_bytes, p.s AS payload_digest, CASE WHEN origin <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN origin <> page_id THEN origin END AS refers_to, CAST(NULL AS VARCHAR) AS error
FROM p LEFT JOIN last ON p.n = last.n AND p.s = last.s
"""
