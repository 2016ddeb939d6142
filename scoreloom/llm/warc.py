"""WARC archives: writing records, reading them back, and assembling captures."""

import base64
import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from scoreloom.llm.bitfilter import likely_among
from scoreloom.session import new_folder

VERSION = "WARC/1.1"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS_PER_FILE = 3000
HOT = 1000
DIGESTED = ST.StructType([ST.StructField("payload_bytes", ST.LongType()), ST.StructField("payload_digest", ST.StringType())])
RECORD = (
    "file string, place bigint, kind string, record_id string, concurrent_to array<string>, target_uri string, date string,"
    " refers_to string, payload_digest string, payload_bytes bigint, digest_ok boolean, payload binary, block binary"
)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


@F.arrow_udf(DIGESTED)
def digested(payloads: pa.Array) -> pa.Array:
    """Length and base-32 SHA-1 of each payload; null is empty."""
    rows = [(x.as_py() or "").encode() for x in payloads]
    return pa.StructArray.from_arrays(
        [pa.array([len(x) for x in rows], pa.int64()), pa.array([digest(x) for x in rows], pa.string())],
        DIGESTED.fieldNames(),
    )


def record_id(kind: str, page_id: Column, payload_digest: Column, name: Column) -> Column:
    """A urn that follows from the page, its payload and ``name``, so that repeated tasks write the same bytes."""
    known = F.coalesce(page_id.cast("string"), F.lit("null"))
    h = F.md5(F.concat_ws(":", F.lit(kind), known, payload_digest, name))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _staged(df: DataFrame, name: str) -> DataFrame:
    folder = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def looked_up(rows: DataFrame, found: DataFrame, key: str, how: str) -> DataFrame:
    """``rows`` joined with ``found``, which has one row per ``key``, in the way ``how`` (inner or left).

    Keys of at least a HOT-th of the rows, at most HOT of them, are broadcast, so that rows of a
    frequent key stay where they are; only the others are shuffled.
    """
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    hot = counts.where(F.col("n") * HOT >= counts.agg(F.sum("n")).scalar()).select(key)
    near = F.broadcast(found.join(F.broadcast(hot), key, "left_semi"))
    return rows.join(near, key).unionByName(rows.join(near.select(key), key, "left_anti").join(found, key, how))


def captures(pages: DataFrame, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
             every_row: bool = True) -> DataFrame:
    """Pages with payload digest and, for repeats of an equal payload, the page they refer to.

    Of rows with equal payloads of at least ``least_bytes`` the one with the smallest id is the response (null ids
    last; ties by url, then by row), the others refer to it. Rows that repeat id, url and payload are one page unless ``every_row``.
    Pages are read and hashed once, into a table that fixes their numbers; html is shuffled only for
    rows that may refer to another.
    Returns row, page_id, url, html (null where it refers), payload_bytes, payload_digest, name, refers_to, refers_name, revisit.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    known = _staged(rows.withColumn("d", digested("html")).select(*rows.columns, "d.*", F.monotonically_increasing_id().alias("row")), "pages")
    own = F.col("row").cast("string") if every_row else F.md5(F.coalesce(F.concat(F.lit("u"), "url"), F.lit("n")))
    known = known.withColumn("name", own)
    narrow = known.drop("html").where(F.col("payload_bytes") >= least_bytes)
    order = F.struct(F.col("page_id").isNull(), "page_id", F.col("url").isNull(), "url", "name")
    firsts = narrow.groupBy("payload_digest").agg(
        F.min_by(F.struct("page_id", "name"), order).alias("first"), F.count(F.lit(1)).alias("n")
    ).where("n > 1").select("payload_digest", "first")
    firsts = _staged(firsts, "firsts")
    again = likely_among(narrow, F.xxhash64("payload_digest"), firsts.select(F.xxhash64("payload_digest").alias("key"))).where("likely")
    revisits = _staged(
        looked_up(again.select("row", "page_id", "name", "payload_digest"), firsts, "payload_digest", "inner")
        .where(~(F.col("page_id").eqNullSafe(F.col("first.page_id")) & (F.col("name") == F.col("first.name"))))
        .select("row", F.col("first.page_id").alias("refers_to"), F.col("first.name").alias("refers_name"), F.lit(True).alias("revisit")),
        "revisits",
    )
    marked = likely_among(known, F.xxhash64("row"), revisits.select(F.xxhash64("row").alias("key")))
    columns = [c for c in known.columns if c != "html"]
    some = marked.where("likely").drop("likely").join(revisits, "row", "left").select(
        *columns, F.when(F.col("revisit").isNull(), F.col("html")).alias("html"),
        "refers_to", "refers_name", F.coalesce("revisit", F.lit(False)).alias("revisit"),
    )
    others = marked.where("NOT likely").select(
        *columns, "html", F.lit(None).cast(rows.schema["page_id"].dataType).alias("refers_to"),
        F.lit(None).cast("string").alias("refers_name"), F.lit(False).alias("revisit"),
    )
    return others.unionByName(some)


def _header(name: str, value: str) -> str:
    return f"{name}: {value}\r\n"


def _one_line(value) -> str:
    return "".join(" " if c in "\r\n" else c for c in value or "")


def _record(kind: str, identity: str, url: str, block: bytes, extra: list[tuple[str, str]], media: str) -> bytes:
    head = f"{VERSION}\r\n" + _header("WARC-Type", kind) + _header("WARC-Record-ID", identity) + _header("WARC-Date", DATE)
    head += _header("WARC-Target-URI", url) + "".join(_header(*x) for x in extra)
    head += _header("Content-Type", media) + _header("Content-Length", str(len(block))) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def _member(record: bytes) -> bytes:
    """The record as a gzip member without its last byte, which is 0 and serves as line separator.

    The last byte is the top byte of the length; a record of 16 MiB or more is followed by an empty member.
    """
    def packed(x: bytes) -> bytes:
        z = zlib.compressobj(6, zlib.DEFLATED, 31)
        return z.compress(x) + z.flush()

    member = packed(record)
    if member[-1]:
        member += packed(b"")
    return member[:-1]


def _page_records(batches):
    """Request, response or revisit, and metadata record of each page, as gzip members."""
    for batch in batches:
        out = []
        for p in batch.to_pylist():
            url, payload = _one_line(p["url"]), (p["html"] or "").encode()
            sums = [("WARC-Payload-Digest", f"sha1:{p['payload_digest']}")]
            http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {p['payload_bytes']}\r\n\r\n"
            if p["refers_id"]:
                extra = sums + [("WARC-Refers-To", p["refers_id"]), ("WARC-Profile", PROFILE)]
                main = _record("revisit", p["response_id"], url, http.encode(), extra, "application/http;msgtype=response")
            else:
                main = _record("response", p["response_id"], url, http.encode() + payload, sums, "application/http;msgtype=response")
            tie = [("WARC-Concurrent-To", p["response_id"])]
            request = _record("request", p["request_id"], url, f"GET {url} HTTP/1.1\r\n\r\n".encode(), tie, "application/http;msgtype=request")
            note = b"" if p["page_id"] is None else f"page_id: {p['page_id']}\r\n".encode()
            about = _record("metadata", p["metadata_id"], url, note, [("WARC-Concurrent-To", p["request_id"])], "application/warc-fields")
            out += [_member(x) for x in (request, main, about)]
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["member"])


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url",
                   html_col: str = "html", records_per_file: int = RECORDS_PER_FILE, every_row: bool = False) -> None:
    """Write three records per page as record-compressed archives below ``folder``.

    Spark's text writer stores the members and commits the files, so lost tasks are
    repeated whole. Null html is an empty payload; line breaks in a url become blanks; a null id
    gets metadata without an id. Rows with a null or repeated id have record ids of their own; rows that repeat
    id, url and html repeat the record ids too, unless ``every_row`` numbers them.
    """
    known = captures(pages, least_bytes, id_col, url_col, html_col, every_row)
    ids = {f"{k}_id": record_id(k, F.col("page_id"), F.col("payload_digest"), F.col("name")) for k in ("request", "response", "metadata")}
    rows = known.select(
        "page_id", "url", "html", "payload_bytes", "payload_digest", *[x.alias(name) for name, x in ids.items()],
        F.when(F.col("revisit"), record_id("response", F.col("refers_to"), F.col("payload_digest"), F.col("refers_name"))).alias("refers_id"),
    )
    members = rows.mapInArrow(_page_records, "member binary")
    members.select(F.col("member").cast("string")).write.option("lineSep", "\x00").option(
        "maxRecordsPerFile", records_per_file
    ).text(folder)


def _headers(raw: bytes) -> list[tuple[str, str]]:
    lines = raw.decode("utf-8", "replace").split("\r\n")[1:]
    return [(k.strip().lower(), v.strip()) for k, _, v in (x.partition(":") for x in lines if x)]


def _members(data: bytes):
    """Uncompressed bytes of each gzip member; a file without compression is one piece."""
    view, at = memoryview(data), 0
    while at < len(view):
        if view[at: at + 2] != b"\x1f\x8b":
            yield view[at:].tobytes()
            return
        z, parts, step = zlib.decompressobj(31), [], 2048
        while at < len(view) and not z.eof:  # in growing steps, as what follows the member is copied
            parts.append(z.decompress(view[at: at + step]))
            at = min(at + step, len(view))
            step *= 2
        at -= len(z.unused_data)
        yield b"".join(parts) + z.flush()


def parse_archive(data: bytes):
    """(headers, block) of each record of an archive."""
    for piece in _members(data):
        at = 0
        while (start := piece.find(b"WARC/", at)) >= 0:
            end = piece.find(b"\r\n\r\n", start)
            if end < 0:
                return
            headers = _headers(piece[start:end])
            size = int(dict(headers).get("content-length", "0"))
            yield headers, piece[end + 4: end + 4 + size]
            at = end + 4 + size


def _parsed(batches, keep_payload: bool):
    for batch in batches:
        for file, data in zip(batch["path"].to_pylist(), batch["content"]):
            rows = []
            for place, (headers, block) in enumerate(parse_archive(data.as_py())):
                h = dict(headers)
                kind = h.get("warc-type", "")
                payload = size = ok = None
                if kind in ("response", "revisit"):
                    head, _, payload = block.partition(b"\r\n\r\n")
                    size = len(payload)
                    if kind == "revisit":
                        size = int(dict(_headers(head)).get("content-length", "0"))
                    else:
                        ok = h.get("warc-payload-digest", "").removeprefix("sha1:") == digest(payload)
                rows.append({
                    "file": file, "place": place, "kind": kind, "record_id": h.get("warc-record-id"),
                    "concurrent_to": [v for k, v in headers if k == "warc-concurrent-to"],
                    "target_uri": h.get("warc-target-uri"), "date": h.get("warc-date"), "refers_to": h.get("warc-refers-to"),
                    "payload_digest": h["warc-payload-digest"].removeprefix("sha1:") if "warc-payload-digest" in h else None,
                    "payload_bytes": size, "digest_ok": ok,
                    "payload": payload if keep_payload and kind == "response" else None,
                    "block": block if kind not in ("response", "revisit") else None,
                })
                if len(rows) == 500:
                    yield pa.RecordBatch.from_pylist(rows, SCHEMA)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, SCHEMA)


SCHEMA = pa.schema([
    ("file", pa.string()), ("place", pa.int64()), ("kind", pa.string()), ("record_id", pa.string()),
    ("concurrent_to", pa.list_(pa.string())), ("target_uri", pa.string()), ("date", pa.string()), ("refers_to", pa.string()),
    ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("digest_ok", pa.bool_()), ("payload", pa.binary()),
    ("block", pa.binary()),
])


def read_archives(spark: SparkSession, folder: str, keep_payload: bool = True) -> DataFrame:
    """One row per record of the archives below a folder, gzip members or plain.

    Each file is read by one task and must fit in its memory; ``write_archives`` limits the
    records of a file. A record whose payload does not match its digest has digest_ok false.
    """
    files = spark.read.format("binaryFile").load(folder).select("path", "content")
    return files.mapInArrow(lambda it: _parsed(it, keep_payload), RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture, its records joined by concurrent-to identifiers.

    A capture is a response or revisit. Any other record belongs to the capture it names or
    that names it, or to that of a record tied to it in the same ways (two steps at most). Of several
    requests or metadata records of a capture the first by file and place is nested, and all are counted;
    a record id that repeats counts once, by its first copy. Records without a capture are left out; a capture without
    request or metadata has nulls there.
    Returns record_id, response, request, metadata (structs), requests, metadata_records.

    Archives are parsed once, into a table of first copies; ties and anchors are pairs of ids, and blocks and payloads
    join them once at the end.
    """
    known = records.where("record_id IS NOT NULL").withColumn("at", F.struct("file", "place"))
    copies = Window.partitionBy("record_id").orderBy("file", "place")
    unique = _staged(known.withColumn("copy", F.row_number().over(copies)).where("copy = 1").drop("copy"), "records")
    capture = F.col("kind").isin("response", "revisit")
    main, other = unique.where(capture), unique.where(~capture)
    anchors = main.select(F.col("record_id").alias("b"), F.lit(True).alias("main"))
    named = unique.select(F.col("record_id").alias("a"), capture.alias("from_main"), F.explode("concurrent_to").alias("b")).where("a != b")
    ties = named.join(anchors, "b", "left").select("a", "b", "from_main", F.coalesce("main", F.lit(False)).alias("to_main"))
    # a pair ties both ends; it is an anchor for the end that is no capture
    ends = ties.select(F.explode(F.array(
        F.struct("a", "b", F.col("from_main").alias("placed"), F.col("to_main").alias("anchored")),
        F.struct(F.col("b").alias("a"), F.col("a").alias("b"), F.col("to_main").alias("placed"), F.col("from_main").alias("anchored")),
    )).alias("e")).select("e.*").where("NOT placed")
    near = ends.where("anchored").groupBy("a").agg(F.min("b").alias("anchor"))
    far = ends.where("NOT anchored").select("a", "b").join(near.withColumnRenamed("a", "b"), "b").select("a", "anchor")
    owner = (
        near.withColumn("steps", F.lit(1)).unionByName(far.withColumn("steps", F.lit(2)))
        .groupBy(F.col("a").alias("record_id")).agg(F.min(F.struct("steps", "anchor"))["anchor"].alias("anchor"))
    )
    placed = other.join(owner, "record_id").select("anchor", "kind", F.struct("at", "record_id", "target_uri", "date", "block").alias("r"))
    parts = placed.groupBy(F.col("anchor").alias("record_id")).agg(
        *[F.min(F.when(F.col("kind") == k, F.col("r"))).alias(k) for k in ("request", "metadata")],
        F.count_if(F.col("kind") == "request").alias("requests"), F.count_if(F.col("kind") == "metadata").alias("metadata_records"),
    )
    nested = F.struct("kind", "target_uri", "date", "refers_to", "payload_digest", "payload_bytes", "digest_ok", "payload")
    return main.select("record_id", nested.alias("response")).join(parts, "record_id", "left").select(
        "record_id", "response", F.col("request").dropFields("at").alias("request"),
        F.col("metadata").dropFields("at").alias("metadata"), F.coalesce("requests", F.lit(0)).alias("requests"),
        F.coalesce("metadata_records", F.lit(0)).alias("metadata_records"),
    )


def page_ids(assembled: DataFrame) -> DataFrame:
    """Captures with the page_id that their metadata record notes, and as refers_page that of the capture they refer to."""
    note = F.regexp_extract(F.col("metadata.block").cast("string"), r"page_id: (-?\d+)", 1)
    known = assembled.withColumn("page_id", note.try_cast("bigint")).withColumn("origin", F.col("response.refers_to"))
    pages = known.where("response.kind = 'response'").select(F.col("record_id").alias("origin"), F.col("page_id").alias("refers_page"))
    single = known.where("origin IS NULL").withColumn("refers_page", F.lit(None).cast("bigint"))
    return single.unionByName(looked_up(known.where("origin IS NOT NULL"), pages, "origin", "left")).drop("origin")
