"""WARC archives with an index written first.

Writing: equal payloads of at least MIN_BYTES bytes are found by their SHA-1; the page with the largest id is kept as a
response and the others become revisit records that refer to it. Each task appends its records to an archive of its
own in the shared folder and returns an index row (file, offset, length, url, digest) for each; the index is
written before anything reads the archives, and it alone says which files count, so what a lost or
repeated task left behind is never read.

Reading: index rows are selected first, dealt out by stretches of a file and sorted by offset; each task coalesces
neighbouring byte ranges into single reads.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.llm.store import scratch, small_batches

#: Payloads of at least so many bytes may become revisits.
MIN_BYTES = 1000
#: An archive is closed after so many bytes.
ARCHIVE_BYTES = 64 << 20
#: Ranges are read together over gaps of at most GAP bytes, up to READ bytes; a task reads stretches of STRETCH bytes.
GAP, READ, STRETCH = 64 << 10, 8 << 20, 16 << 20

#: Tasks that the copies of a page are dealt over.
SALTS = 8

ID = "urn:matchloom:page:"
DATE = "2000-01-01T00:00:00Z"  # records are a function of the page alone
INDEX = "page_id long, url string, digest string, record_type string, file string, offset long, length long"


def _url(url: str | None) -> str | None:
    return quote(url, safe="!#$%&'()*+,/:;=?@[]~") if url else None


def record(page_id: int | None, url: str | None, html: str | None, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record. A revisit has no payload; it carries the payload's digest and length and the response's id."""
    payload = (html or "").encode()
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{ID}{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if target := _url(url):
        head.append(f"WARC-Target-URI: {target}")
    head.append(f"WARC-Payload-Digest: sha1:{hashlib.sha1(payload).hexdigest()}")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if revisit:
        head += [f"WARC-Refers-To: <{ID}{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        block = http
    else:
        block = http + payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Headers and payload of one record; checks lengths and, for a response, the digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block, tail = rest[: int(fields["Content-Length"])], rest[int(fields["Content-Length"]) :]
    if tail != b"\r\n\r\n":
        raise ValueError("a record does not end where its length says")
    http, _, payload = block.partition(b"\r\n\r\n")
    n = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    name = lambda v: int(x) if (x := v.strip("<>").removeprefix(ID)) else None
    if fields["WARC-Type"] == "response":
        digest = hashlib.sha1(payload).hexdigest()
        if len(payload) != n or f"sha1:{digest}" != fields["WARC-Payload-Digest"]:
            raise ValueError("a payload differs from its record's length or digest")
    refers = fields.get("WARC-Refers-To")
    return {"page_id": name(fields["WARC-Record-ID"]), "payload_bytes": n, "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": name(refers) if refers else None, "html": payload.decode() if fields["WARC-Type"] == "response" else None}


#: Schemes of Hadoop's file systems under the names that Arrow has for them; DBFS is mounted as a folder.
SCHEMES = {"s3a": "s3://", "s3n": "s3://", "dbfs": "file:///dbfs/"}


def filesystem(root: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a folder that Spark names, and its path there."""
    scheme, colon, rest = root.partition(":")
    if colon and scheme in SCHEMES:
        root = SCHEMES[scheme] + rest.lstrip("/")
    return pa.fs.FileSystem.from_uri(root)


def _write(root: str):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(root)
        task = TaskContext.get()
        out, name, at, part = None, "", 0, 0
        try:
            for rb in it:
                rows = []
                for page_id, url, html, digest, keeper, revisit in zip(*[c.to_pylist() for c in rb.columns], strict=True):
                    if out is None or at >= ARCHIVE_BYTES:
                        if out is not None:
                            out.close()
                        name, at, part = f"{task.partitionId():06d}-{part:04d}-{uuid.uuid4().hex}.warc.gz", 0, part + 1
                        fs.create_dir(base, recursive=True)
                        out = fs.open_output_stream(f"{base}/{name}", compression=None)
                    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                    raw = packer.compress(record(page_id, url, html, keeper, revisit)) + packer.flush()
                    out.write(raw)
                    rows.append((page_id, url, digest, "revisit" if revisit else "response", name, at, len(raw)))
                    at += len(raw)
                columns = list(zip(*rows, strict=True)) or [()] * 7
                kinds = [pa.int64(), *[pa.string()] * 4, pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["page_id", "url", "digest", "record_type", "file", "offset", "length"])
        finally:
            if out is not None:
                out.close()

    return run


def write(pages: DataFrame, root: str, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Write archives for (page_id, url, html) rows and return the index, which is stored at root/index.

    A null html has an empty payload; a null url has no target. Of equal payloads of at least min_bytes bytes the rows
    with the largest page_id are responses (all of them, where rows repeat that id) and the others revisits of it;
    null ids come before all others, and a group of null ids only is all responses. An empty table gives an empty index.
    """
    small_batches(pages.sparkSession)
    body = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha1(body).alias("digest"), F.octet_length(body).alias("n"))
    # Only counts and ids are gathered by digest here; one row a group of two or more goes on.
    groups = keyed.where(F.col("n") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("k")).where("k > 1").select("digest", "keeper")
    revisit = F.coalesce(F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper")), F.lit(False))
    # All copies of a page share a digest: they are dealt over SALTS tasks, and the group's one row is sent to each.
    keyed = keyed.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    groups = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = keyed.join(groups, ["digest", "salt"], "left").select("page_id", "url", "html", "digest", "keeper", revisit.alias("revisit"))
    index = rows.mapInArrow(_write(f"{root}/archives"), INDEX)
    index.write.option("compression", "zstd").parquet(f"{root}/index")
    return pages.sparkSession.read.schema(index.schema).parquet(f"{root}/index")


def _read(root: str, with_html: bool):
    fields = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["html"] * with_html
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.string()] * with_html

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(root)
        open_name, handle = None, None

        def fetch(name: str, ranges: list[tuple[int, int]]) -> pa.RecordBatch:
            nonlocal open_name, handle
            if name != open_name:
                if handle is not None:
                    handle.close()
                open_name, handle = name, fs.open_input_file(f"{base}/{name}")
            first = ranges[0][0]
            raw = handle.read_at(ranges[-1][0] + ranges[-1][1] - first, first)
            found = [parse(zlib.decompress(raw[o - first : o - first + n], 31)) for o, n in ranges]
            return pa.RecordBatch.from_arrays([pa.array([x[f] for x in found], k) for f, k in zip(fields, kinds, strict=True)], fields)

        run_of, name = [], None
        for rb in it:
            for file, offset, length in zip(*[c.to_pylist() for c in rb.columns], strict=True):
                if run_of and (file != name or offset - sum(run_of[-1]) > GAP or offset + length - run_of[0][0] > READ):
                    yield fetch(name, run_of)
                    run_of = []
                name = file
                run_of.append((offset, length))
        if run_of:
            yield fetch(name, run_of)
        if handle is not None:
            handle.close()

    return run


def read(index: DataFrame, root: str, with_html: bool = True) -> DataFrame:
    """The selected records: (page_id, payload_bytes, payload_digest, record_type, refers_to[, html]); a revisit's html is null, its length and digest are those of the payload that it refers to."""
    n = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stretch = F.floor(F.col("offset") / STRETCH)
    ranges = index.select("file", "offset", "length").repartition(n, "file", stretch).sortWithinPartitions("file", "offset")
    return ranges.mapInArrow(_read(f"{root}/archives", with_html), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", html string" * with_html)


def round_trip(pages: DataFrame, root: str | None = None) -> DataFrame:
    """Write all pages, then read all records back through the index."""
    root = root or scratch(pages.sparkSession, "warc")
    return read(write(pages, root), root, with_html=False)
