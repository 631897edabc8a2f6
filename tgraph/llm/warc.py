"""WARC archives: written with an index first, read back by coalesced byte ranges.

Each task writes whole archives of records compressed one by one, and returns the
index: file, offset, length, URL and digest of every record. Readers sort the
selected records of a file by offset, join ranges that lie close together, and
fetch each joined range at once. File names and bytes depend on the rows alone,
and a file appears under its name when it is complete, so a task that is repeated
after a lost executor puts the same file in the same place.

Executors reach the folder through ``pyarrow.fs``: local and shared paths, hdfs, s3 and gs.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tgraph.session import materialize, scratch_dir

ARCHIVE_BYTES = 64 << 20  # payload of an archive, on average
GAP = 64 << 10  # unselected bytes that are read to join two ranges
RANGE_BYTES = 8 << 20  # of a joined range at most; a longer record is one of its own
DATE = "2020-01-01T00:00:00Z"  # of capture, if no other is given

# The format's version and the profile of revisits with equal payloads.
VERSION = b"WARC/1.1\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = "file string, offset bigint, length bigint, url string, digest string, page_id bigint, record_type string"
RECORD = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", path))


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _headers(fields: dict[str, object]) -> bytes:
    """Header lines; control characters in values are percent-encoded."""
    clean = {k: re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", str(v)) for k, v in fields.items() if v is not None}
    return "".join(f"{k}: {v}\r\n" for k, v in clean.items()).encode("utf-8", "surrogatepass")


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None, date: str = DATE) -> bytes:
    """One compressed record: a response, or a revisit if ``refers_to`` is given."""
    http = b"HTTP/1.1 200 OK\r\n" + _headers({"Content-Type": "text/html; charset=utf-8", "Content-Length": size}) + b"\r\n"
    revisit = refers_to is not None
    block = http if revisit else http + payload
    fields = {
        "WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": _name(page_id), "WARC-Date": date, "WARC-Target-URI": url,
        "WARC-Payload-Digest": f"sha1:{digest}", "WARC-Block-Digest": f"sha1:{digest_of(block)}", "WARC-Profile": PROFILE if revisit else None,
        "WARC-Refers-To": _name(refers_to) if revisit else None, "Content-Type": "application/http; msgtype=response", "Content-Length": len(block),
    }
    return _zip(VERSION + _headers(fields) + b"\r\n" + block + b"\r\n\r\n")


def _zip(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)  # gzip, without a time
    return packer.compress(data) + packer.flush()


def parse(data: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Headers, HTTP headers and payload of a compressed record."""
    raw = zlib.decompress(data, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if lines[0].encode() + b"\r\n" != VERSION:
        raise ValueError(f"no record: {lines[0]!r}")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, http, payload


def _write(folder: str, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(folder)
        at, out, part, offset, rows = None, None, "", 0, []

        def finish() -> Iterator[pa.RecordBatch]:
            if out is not None:
                out.close()
                fs.move(part, f"{base}/{_file(at)}")
                yield pa.RecordBatch.from_pylist(rows, INDEX_ARROW)

        for batch in batches:
            ids, urls, refers = (batch.column(i).to_pylist() for i in (1, 2, 4))
            for i, archive in enumerate(batch.column(0).to_pylist()):
                if archive != at:
                    yield from finish()
                    at, rows = archive, []
                    part = f"{base}/.{_file(at)}.{uuid.uuid4().hex}"
                    out = fs.open_output_stream(part)
                    info = b"software: tgraph\r\nformat: WARC File Format 1.1\r\n"
                    fields = {"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:archive:{at}>", "WARC-Date": date, "Content-Type": "application/warc-fields", "Content-Length": len(info)}
                    first = _zip(VERSION + _headers(fields) + b"\r\n" + info + b"\r\n\r\n")
                    out.write(first)
                    offset = len(first)
                payload = batch.column(3)[i].as_py() or b""
                digest = digest_of(payload)
                data = record(ids[i], urls[i], payload, len(payload), digest, refers[i], date)
                out.write(data)
                rows.append({
                    "file": _file(at), "offset": offset, "length": len(data), "url": urls[i], "digest": digest, "page_id": ids[i],
                    "record_type": "response" if refers[i] is None else "revisit",
                })
                offset += len(data)
        yield from finish()

    return run


INDEX_ARROW = pa.schema([
    ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("url", pa.string()), ("digest", pa.string()),
    ("page_id", pa.int64()), ("record_type", pa.string()),
])


def _file(archive: int) -> str:
    return f"part-{archive:06d}.warc.gz"


def write(
    pages: DataFrame, folder: str, least_bytes: int = 0, date: str = DATE, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html"
) -> DataFrame:
    """Write one record per page to archives in ``folder``; return the written index.

    The payload is the text in UTF-8, null as empty. Of pages with equal payloads
    of at least ``least_bytes`` bytes the one with the largest id is a response and
    the others are revisits of it; smaller ones are all responses. Rows that repeat
    both id and payload share their type; a null id is smaller than any other. A null
    url is left out of the record. Other columns are ignored; an empty table writes
    no archive. A group of any size costs its rows: the largest ids are found by
    partial aggregation, and a task writes archives of about ``ARCHIVE_BYTES``.
    """
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    own = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    own = own.withColumn("sha", F.sha1("payload")).withColumn("size", F.octet_length("payload"))
    groups = own.where(F.col("size") >= least_bytes).groupBy("sha", "size")
    heads = groups.agg(F.max("page_id").alias("head"), F.count("*").alias("n")).where("n > 1").drop("n")
    heads = materialize(heads, "heads")
    total = own.agg(F.sum("size")).first()[0] or 0
    archive = F.pmod(F.xxhash64("page_id", "sha"), F.lit(total // ARCHIVE_BYTES + 1)).cast("bigint")
    told = own.join(heads, ["sha", "size"], "left")
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") < F.col("head")), F.col("head"))
    told = told.select(archive.alias("archive"), "page_id", "url", "payload", refers.alias("refers_to"))
    told = told.repartition("archive").sortWithinPartitions("archive", "page_id", "url")
    fs, base = _open(folder)
    fs.create_dir(base)
    return materialize(told.mapInArrow(_write(folder, date), INDEX), "index")


def ranges(rows: list[tuple[int, int]], gap: int = GAP, most: int = RANGE_BYTES) -> list[tuple[int, int, int, int]]:
    """(first row, last row + 1, begin, end) of joined ranges of rows (offset, length) sorted by offset."""
    out: list[tuple[int, int, int, int]] = []
    for i, (offset, length) in enumerate(rows):
        if out and offset - out[-1][3] <= gap and offset + length - out[-1][2] <= most:
            first, _, begin, end = out[-1]
            out[-1] = (first, i + 1, begin, max(end, offset + length))
        else:
            out.append((i, i + 1, offset, offset + length))
    return out


def _fetch(folder: str, payloads: bool):
    def unpack(data: bytes) -> dict:
        fields, http, payload = parse(data)
        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
        size = int(re.search(rb"Content-Length: (\d+)", http)[1])
        page = re.search(r"<urn:page:(-?\d+)>", fields["WARC-Record-ID"])
        refers = re.search(r"<urn:page:(-?\d+)>", fields.get("WARC-Refers-To", ""))
        if fields["WARC-Type"] == "response" and (digest_of(payload) != digest or len(payload) != size):
            raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
        row = {
            "page_id": int(page[1]) if page else None, "url": fields.get("WARC-Target-URI"), "payload_bytes": size, "payload_digest": digest,
            "record_type": fields["WARC-Type"], "refers_to": int(refers[1]) if refers else None,
        }
        return row | ({"payload": payload if row["record_type"] == "response" else None} if payloads else {})

    schema = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
    schema = pa.schema(schema + [("payload", pa.binary())] * payloads)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(folder)
        name, source = None, None
        for batch in batches:
            files = batch.column(0).to_pylist()
            wanted = list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()))
            cuts = [i for i in range(len(files)) if i == 0 or files[i] != files[i - 1]] + [len(files)]
            for a, z in zip(cuts, cuts[1:]):
                if files[a] != name:
                    name, source = files[a], fs.open_input_file(f"{base}/{files[a]}")
                for first, last, begin, end in ranges(wanted[a:z]):
                    source.seek(begin)
                    data = source.read(end - begin)
                    yield pa.RecordBatch.from_pylist([unpack(data[o - begin : o - begin + n]) for o, n in wanted[a + first : a + last]], schema)

    return run


def read(index: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """The records that ``index``, whole or filtered, lists, read from ``folder``.

    Responses are checked against their digests. ``payload_bytes`` and
    ``payload_digest`` are those of the full payload, for revisits too;
    ``payload`` (if asked for) is null for revisits.
    """
    chosen = index.select("file", "offset", "length").repartition("file").sortWithinPartitions("file", "offset")
    return chosen.mapInArrow(_fetch(folder, payloads), RECORD + (", payload binary" if payloads else ""))


def new_folder(spark) -> str:
    """A new folder for archives in the session's shared checkpoint folder."""
    return f"{scratch_dir(spark)}/tgraph/warc-{uuid.uuid4().hex}"
