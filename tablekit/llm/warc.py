"""Web archives as a chunked record table.

Writing: a payload longer than ``chunk_bytes`` becomes WARC segments (a response and its
continuations), each a row (record id, chunk number) with the SHA-256 of the payload so far, so no
record is ever held whole beside its source cell. Reading: records are split at the mark between
them, segments stay rows, and payloads of many segments are digested by a streamed, sorted pass with
one running hash.

Files are written and read by Spark's text source, so any file system Spark knows will do. Records are
separated by a blank line and the next record's version line; the writer cuts a payload within any
such sequence it contains, so none stands inside a block, and the reader checks every length.

Null html is an empty payload. Every row is a record, repeated ones too. Of equal payloads of at least
``revisit_bytes`` the row with the smallest page_id is the response (null last; then the first in the
files), and the others revisit it. Null urls have no target line.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MARK = "WARC/1.1\r\n"
END = "\r\n\r\n"
BETWEEN = (END + MARK).encode()
ROWS = "record_id string, chunk_no long, last boolean, digest_so_far string, bytes_so_far long, data binary"


def _cuts(payload: memoryview, size: int) -> Iterator[tuple[int, int]]:
    """Chunks of at most ``size`` bytes, none of which makes the mark between records, be it within, with
    the blank line before it or with the one behind it."""
    raw, at, n = payload.obj, 0, len(payload)
    inside = len(END) + 2  # from the start of a mark to a place within it
    if not n:
        yield 0, 0
    while at < n:
        end = min(at + size, n)
        before = (END.encode() + raw[at : min(end, at + len(MARK))] + BETWEEN[-2:]).find(BETWEEN)
        if before >= 0:
            end = at + before - len(END) + inside
        elif (mark := raw.find(BETWEEN, at, end)) >= 0:
            end = mark + inside
        elif raw.endswith(BETWEEN[:-2], at, end):
            end += inside - len(BETWEEN[:-2])
        yield at, end
        at = end


def chunk_rows(pages: DataFrame, chunk_bytes: int = 1 << 16) -> DataFrame:
    """record_id, payload (binary) give a row per chunk; other columns are repeated on every chunk."""
    others = [f for f in pages.schema.fields if f.name not in ("record_id", "payload")]
    schema = ROWS + "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in others)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            ids, payloads = batch.column("record_id"), batch.column("payload")
            for i in range(batch.num_rows):
                raw = payloads[i].as_py() or b""
                view, h = memoryview(raw), hashlib.sha256()
                for no, (a, b) in enumerate(_cuts(view, chunk_bytes)):
                    h.update(view[a:b])
                    rows.append((i, ids[i].as_py(), no, b == len(raw), h.hexdigest(), b, bytes(view[a:b])))
                    held += b - a
                    if held > 8 << 20:
                        yield _batch(batch, rows, others)
                        rows, held = [], 0
            if rows:
                yield _batch(batch, rows, others)

    return pages.mapInArrow(run, schema)


def _batch(batch: pa.RecordBatch, rows: list[tuple], others: list) -> pa.RecordBatch:
    at, ids, no, last, digest, so_far, data = zip(*rows)
    columns = [pa.array(ids, pa.string()), pa.array(no, pa.int64()), pa.array(last), pa.array(digest), pa.array(so_far, pa.int64()), pa.array(data, pa.binary())]
    names = ["record_id", "chunk_no", "last", "digest_so_far", "bytes_so_far", "data"]
    take = pa.array(at)
    for f in others:
        columns.append(batch.column(f.name).take(take))
        names.append(f.name)
    return pa.RecordBatch.from_arrays(columns, names=names)


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing for null; line breaks in values become blanks."""
    clean = F.translate(value.cast("string"), "\r\n", "  ")
    return F.coalesce(F.concat(F.lit(f"{name}: "), clean, F.lit("\r\n")), F.lit(""))


def write_warc(
    pages: DataFrame, path: str, date: str = "2000-01-01T00:00:00Z", revisit_bytes: int = 100, chunk_bytes: int = 1 << 16
) -> None:
    """Columns page_id, url, html as compressed archive files in the folder ``path``."""
    # the same scan numbers its rows alike wherever it is read, which tells repeated rows apart
    p = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload")).withColumn(
        "uid", F.monotonically_increasing_id()
    )
    p = p.withColumns({"digest": F.sha2("payload", 256), "bytes": F.octet_length("payload")})
    first = F.min(F.struct(F.col("page_id").isNull(), "page_id", "uid"))
    leaders = (
        p.where(F.col("bytes") >= revisit_bytes)
        .groupBy("digest")
        .agg(first.alias("one"), F.count("*").alias("n"))
        .where("n > 1")
        .select(F.col("digest").alias("_digest"), F.col("one.page_id").alias("to_page"), F.col("one.uid").alias("to_uid"))
    )
    # only the digests of rows meet the leaders; payloads are joined by row, and one row has one leader
    again = p.select("uid", "digest", "bytes").where(F.col("bytes") >= revisit_bytes)
    again = again.join(leaders, again["digest"] == leaders["_digest"]).where("uid <> to_uid").select(F.col("uid").alias("_uid"), "to_page", "to_uid")
    p = p.join(again, p["uid"] == again["_uid"], "left")
    revisit = F.col("to_uid").isNotNull()

    def name(page: Column, uid: Column) -> Column:
        # an id that is no whole number goes by its bytes, so it may hold any characters
        text = page.cast("string")
        coded = F.concat(F.lit("x"), F.hex(text.cast("binary")))
        shown = F.when(F.rlike(text, F.lit("^-?[0-9]+$")), text).otherwise(F.coalesce(coded, F.lit("null")))
        return F.concat(F.lit("urn:record:"), shown, F.lit(":"), uid.cast("string"))

    records = p.select(
        name(F.col("page_id"), F.col("uid")).alias("record_id"),
        "page_id",
        "url",
        "digest",
        F.col("bytes").cast("long").alias("bytes"),
        F.when(revisit, name(F.col("to_page"), F.col("to_uid"))).alias("refers_to"),
        F.when(~revisit, F.col("payload")).alias("payload"),
    )
    rows = chunk_rows(records, chunk_bytes)
    first_one, is_revisit = F.col("chunk_no") == 0, F.col("refers_to").isNotNull()
    kind = F.when(is_revisit, "revisit").when(first_one, "response").otherwise("continuation")
    many = ~(first_one & F.col("last"))
    urn = F.concat(F.lit("<"), F.col("record_id"), F.when(first_one, "").otherwise(F.concat(F.lit("#"), F.col("chunk_no"))), F.lit(">"))
    head = F.concat(
        F.lit(MARK),
        _line("WARC-Type", kind),
        _line("WARC-Record-ID", urn),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", F.col("url")),
        F.when(is_revisit, _line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))).otherwise(""),
        F.when(is_revisit, _line("WARC-Refers-To", F.concat(F.lit("<"), F.col("refers_to"), F.lit(">")))).otherwise(""),
        F.when(first_one, _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest")))).otherwise(""),
        F.when(many, _line("WARC-Segment-Number", F.col("chunk_no") + 1)).otherwise(""),
        F.when(many & ~first_one, _line("WARC-Segment-Origin-ID", F.concat(F.lit("<"), F.col("record_id"), F.lit(">")))).otherwise(""),
        F.when(many & F.col("last"), _line("WARC-Segment-Total-Length", F.col("bytes"))).otherwise(""),
        _line("X-Payload-Length", F.when(first_one, F.col("bytes"))),
        _line("X-Payload-Digest-So-Far", F.when(~is_revisit, F.col("digest_so_far"))),
        _line("Content-Type", F.lit("text/html")),
        _line("Content-Length", F.octet_length("data")),
        F.lit("\r\n"),
    )
    line = F.concat(head.cast("binary"), F.col("data")).cast("string").alias("value")
    rows.select(line).write.option("lineSep", END).option("compression", "gzip").text(path)


def read_warc(spark: SparkSession, path: str, id_type: str = "long") -> DataFrame:
    """The chunk table of the archives in ``path``: record_id, chunk_no, last, record_type, page_id (of type
    ``id_type``, that of the ids that were written),
    url, payload_digest, payload_bytes (both as the record states), refers_to, digest_so_far, data.
    A record whose block is shorter than its header says raises."""
    pieces = spark.read.option("lineSep", BETWEEN.decode()).text(path).where("length(value) > 0")
    head = F.regexp_replace(F.substring_index("value", END, 1), "^WARC/1\\.1\r\n", "")
    start = F.octet_length(F.substring_index("value", END, 1)) + len(END) + 1
    lines = F.concat(F.lit("\r\n"), head, F.lit("\r\n"))

    def field(name: str) -> Column:
        at = f"\r\n{name}: "
        after = F.substring_index(F.col("lines"), at, -1)
        return F.when(F.contains(F.col("lines"), F.lit(at)), F.substring_index(after, "\r\n", 1))

    def urn(name: str) -> Column:
        return F.regexp_extract(field(name), "^<([^#>]*)", 1)

    p = pieces.select(lines.alias("lines"), start.alias("start"), F.col("value").cast("binary").alias("raw"))
    size = field("Content-Length").cast("int")
    body = F.expr("substring(raw, start, n)")
    number = field("WARC-Segment-Number").cast("long")
    total = field("WARC-Segment-Total-Length")
    p = p.withColumn("n", size).withColumn("data", body)
    ok = (F.octet_length("data") == F.col("n")) & (
        F.octet_length("raw") - F.col("start") + 1 - F.col("n") <= len(END)
    )

    def page(name: str) -> Column:
        shown = F.split(urn(name), ":")[2]
        coded = F.unhex(F.substring(shown, 2, 1 << 30)).cast("string")
        return F.when(shown.startswith("x"), coded).when(shown != "null", shown).try_cast(id_type)

    return p.select(
        urn("WARC-Record-ID").alias("record_id"),
        (F.coalesce(number, F.lit(1)) - 1).alias("chunk_no"),
        (number.isNull() | total.isNotNull()).alias("last"),
        field("WARC-Type").alias("record_type"),
        page("WARC-Record-ID").alias("page_id"),
        field("WARC-Target-URI").alias("url"),
        F.substring_index(field("WARC-Payload-Digest"), ":", -1).alias("payload_digest"),
        field("X-Payload-Length").cast("long").alias("payload_bytes"),
        page("WARC-Refers-To").alias("refers_to"),
        field("X-Payload-Digest-So-Far").alias("digest_so_far"),
        F.when(ok, F.col("data")).otherwise(F.raise_error(F.lit("block and Content-Length differ")).cast("binary")).alias("data"),
    )


def _digest_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks in order of record and number: a row per record, with one running hash."""
    now, state = None, None
    out: list[tuple] = []
    for batch in batches:
        ids, data = batch.column("record_id"), batch.column("data")
        for i in range(batch.num_rows):
            key = ids[i].as_py()
            if key != now:
                if state is not None:
                    out.append((now, state[0].hexdigest(), state[1]))
                now, state = key, [hashlib.sha256(), 0]
            chunk = data[i].as_buffer()
            state[0].update(chunk)
            state[1] += chunk.size
        if len(out) > 10_000:
            yield _summary(out)
            out = []
    if state is not None:
        out.append((now, state[0].hexdigest(), state[1]))
    yield _summary(out)


def _summary(rows: list[tuple]) -> pa.RecordBatch:
    a, b, c = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(c, pa.int64())], names=["record_id", "found_digest", "found_bytes"])


def records(chunks: DataFrame) -> DataFrame:
    """A row per record of a chunk table: page_id, payload_bytes, payload_digest, record_type,
    refers_to, and intact: whether the payload read has the stated digest and length. Records of one
    chunk are settled where they are read; only chunks of longer ones are brought together."""
    single = F.col("last") & (F.col("chunk_no") == 0)
    keep = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    is_revisit = F.col("record_type") == "revisit"
    short = chunks.where(single).select(
        *keep,
        (is_revisit | ((F.sha2("data", 256) == F.col("payload_digest")) & (F.octet_length("data") == F.col("payload_bytes")))).alias("intact"),
    )
    parts = chunks.where(~single)
    sums = (
        parts.select("record_id", "chunk_no", "data")
        .repartition("record_id")
        .sortWithinPartitions("record_id", "chunk_no")
        .drop("chunk_no")
        .mapInArrow(_digest_runs, "record_id string, found_digest string, found_bytes long")
    )
    heads = parts.where("chunk_no = 0").select("record_id", *keep)
    long = heads.join(sums, "record_id", "left").select(
        *keep,
        F.coalesce((F.col("found_digest") == F.col("payload_digest")) & (F.col("found_bytes") == F.col("payload_bytes")), F.lit(False)).alias("intact"),
    )
    return short.unionByName(long)


def verified(found: DataFrame) -> DataFrame:
    """The rows of ``records``; one whose payload has not the stated digest and length raises."""
    wrong = F.raise_error(F.concat(F.lit("payload differs from its header: page "), F.coalesce(F.col("page_id").cast("string"), F.lit("null"))))
    return found.withColumn("payload_digest", F.when(F.col("intact"), F.col("payload_digest")).otherwise(wrong.cast("string")))
