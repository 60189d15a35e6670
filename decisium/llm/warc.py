"""WARC archives: writing them from pages and reading them back in sequence.

A record is one gzip member. ``read_records`` is the sequential reader: it
inflates a byte stream piece by piece, cuts records where members end, frames
the block by Content-Length and verifies block and payload digests where they are
given (sha1, sha256 or md5, hex or base32); it holds one record at a time and never
seeks. Records of every type come out. The payload is what follows the header of an
HTTP block, and all of any other block.

Pages with equal payloads of at least ``MIN_REVISIT_BYTES`` are stored once: the
smallest page_id is a response, the others are revisit records without payload
that name it. Which payloads occur twice is found by a native aggregate over
digests, so page bodies are shuffled only if the table of such digests is too
large to send to every task (``BROADCAST_ROWS`` rows of about 60 bytes, checked by
counting it), and then neither short pages nor those of very common payloads.

Archives are files of about ``ARCHIVE_BYTES`` in the folder that the cluster
shares, written by the tasks. A file's name holds its task attempt, and only files
named by the written manifest are read, so a retried task leaves nothing wrong.

Edge cases: a null html is an empty payload; empty and short payloads are always
responses. Null page ids are kept and never referred to. Repeated rows of the
referred page are responses too. Line ends in a URL are percent-encoded; a null
URL is empty. An empty table writes no archive and gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from decisium.llm.spread import spread_join
from decisium.runtime import materialise, shared_path

MIN_REVISIT_BYTES = 100
ARCHIVE_BYTES = 64 << 20
BROADCAST_ROWS = 2_000_000
READ_BYTES = 1 << 18
#: A record's date when the table has none.
DATE = "2024-01-01T00:00:00Z"
_SPACE = uuid.UUID("9be5e7a8-2f0c-5e0b-9d51-6d2f4d9c7a10")
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, str(page_id))}>"


def make_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, date: str = DATE, level: int = 3) -> bytes:
    """One gzip member; with ``refers_to`` a revisit, whose block ends with the HTTP header."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(page_id)),
        ("WARC-Date", date),
        ("WARC-Target-URI", (url or "").replace("\r", "%0D").replace("\n", "%0A")),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha256:{hashlib.sha256(payload).hexdigest()}"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        ("X-Page-ID", "" if page_id is None else str(page_id)),
    ]
    if refers_to is not None:
        fields += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", record_id(refers_to)), ("X-Refers-To-Page-ID", str(refers_to))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + f"Content-Length: {len(block)}\r\n\r\n"
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(head.encode()) + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


class BrokenArchive(ValueError):
    """The archive is cut off or doesn't hold what its headers say."""


def _members(chunks: Iterable[bytes]) -> Iterator[bytes]:
    """The inflated members of a stream, one after another."""
    z, out, begun = zlib.decompressobj(31), [], False
    for chunk in chunks:
        while chunk:
            begun = True
            out.append(z.decompress(chunk))
            if not z.eof:
                break
            chunk = z.unused_data
            yield b"".join(out)
            z, out, begun = zlib.decompressobj(31), [], False
    if begun:
        raise BrokenArchive("the last member is cut off")


def digest_holds(stated: str, data: bytes) -> bool:
    """Whether ``data`` has the digest ``algorithm:value``; one of an algorithm that isn't known says nothing."""
    algorithm, _, value = stated.partition(":")
    algorithm = algorithm.strip().lower().replace("-", "")
    if algorithm not in ("sha1", "sha256", "md5"):
        return True
    found = hashlib.new(algorithm, data, usedforsecurity=False).digest()
    return value.strip().lower() in (found.hex(), base64.b32encode(found).decode().rstrip("=").lower(), base64.b32encode(found).decode().lower())


def _headers(head: bytes) -> dict[str, str]:
    """The header lines after the first, names in lower case; a line that begins with white space goes on with the one before."""
    headers: dict[str, str] = {}
    name = ""
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            headers[name] += " " + line.strip()
        else:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            headers[name] = value.strip()
    return headers


def read_records(chunks: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, payload) of each record of a byte stream.

    A revisit's payload digest is that of the record it names, and one of a payload in
    transfer encoding that of the decoded payload; neither is verified here.
    """
    for member in _members(chunks):
        end = member.find(b"\r\n\r\n")
        if end < 0 or not member.startswith(b"WARC/1."):
            raise BrokenArchive("no WARC header")
        headers = _headers(member[:end])
        name = headers.get("warc-record-id")
        if not headers.get("content-length", "").isdigit():
            raise BrokenArchive(f"{name}: no length")
        first, stop = end + 4, end + 4 + int(headers["content-length"])
        block = memoryview(member)[first:stop]
        if len(member) < stop or member[stop:] != b"\r\n\r\n":
            raise BrokenArchive(f"{name}: the block isn't as long as stated")
        if not digest_holds(headers.get("warc-block-digest", ""), block):
            raise BrokenArchive(f"{name}: block digest")
        encoded = False
        if headers.get("content-type", "").lower().replace(" ", "").startswith("application/http"):
            http = member.find(b"\r\n\r\n", first, stop)
            encoded = http >= 0 and "transfer-encoding" in _headers(member[first:http])
            first = http + 4 if http >= 0 else stop
        payload = member[first:stop]
        own = headers.get("warc-type") != "revisit" and not encoded
        if own and not digest_holds(headers.get("warc-payload-digest", ""), payload):
            raise BrokenArchive(f"{name}: payload digest")
        yield headers, payload


def plan_revisits(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html) as page_id, url, html (never null) and refers_to."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    sized = F.octet_length("html") >= MIN_REVISIT_BYTES
    own = rows.withColumn("digest", F.when(sized, F.unhex(F.sha2(F.col("html").cast("binary"), 256))))
    some = own.filter(F.col("digest").isNotNull())
    twice = some.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1")
    twice = materialise(twice, "payloads")
    seen = twice.agg(F.count("*").alias("digests"), F.sum("n").alias("rows")).first()
    if not seen["digests"]:
        return rows.withColumn("refers_to", F.lit(None).cast("long"))
    if seen["digests"] <= BROADCAST_ROWS:
        found = own.join(F.broadcast(twice), "digest", "left")
    else:
        short = own.filter(F.col("digest").isNull()).withColumn("first_id", F.lit(None).cast("long"))
        found = spread_join(some, twice, "digest", "n", seen["rows"], "left").unionByName(short)
    refers = F.when(F.col("first_id") != F.coalesce(F.col("page_id"), F.lit(-1) - F.abs("first_id")), F.col("first_id"))
    return found.select("page_id", "url", "html", refers.alias("refers_to"))


def write_archives(pages: DataFrame, folder: str | None = None, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write ``pages`` with refers_to as archives into ``folder``; gives the manifest (path, records, bytes)."""
    spark = pages.sparkSession
    folder = folder or shared_path(spark, "warc")

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs
        from pyspark import TaskContext

        store, root = fs.FileSystem.from_uri(folder)
        context = TaskContext.get()
        sink, made, n, size, paths = None, [], 0, 0, 0
        for batch in batches:
            for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if sink is None:
                    store.create_dir(root, recursive=True)
                    path = f"part-{context.partitionId():05d}-{paths:04d}-{context.taskAttemptId()}.warc.gz"
                    sink, n, size, paths = store.open_output_stream(f"{root}/{path}", compression=None), 0, 0, paths + 1
                record = make_record(page_id, url, html.encode(), refers_to)
                sink.write(record)
                n, size = n + 1, size + len(record)
                if size >= archive_bytes:
                    sink.close()
                    sink = None
                    made.append((f"{folder}/{path}", n, size))
        if sink is not None:
            sink.close()
            made.append((f"{folder}/{path}", n, size))
        yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64()), pa.array([m[2] for m in made], pa.int64())], names=["path", "records", "bytes"])

    rows = pages.select("page_id", "url", "html", "refers_to").mapInArrow(run, "path string, records long, bytes long")
    return materialise(rows, "manifest")


def read_archives(manifest: DataFrame, parallel: int | None = None) -> DataFrame:
    """All records of the archives in ``manifest``: page_id, url, record_type, refers_to, payload_digest, payload.

    The digest is the payload's SHA-256 in hex, of a revisit that which it states. Records
    that others wrote have no page_id; the manifest needs only the column path.
    """

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs

        names = ["page_id", "url", "record_type", "refers_to", "payload_digest", "payload"]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, place = fs.FileSystem.from_uri(path)
                with store.open_input_stream(place, compression=None) as source:
                    rows, size = [], 0
                    for h, payload in read_records(iter(lambda s=source: s.read(READ_BYTES), b"")):
                        page, refers = h.get("x-page-id"), h.get("x-refers-to-page-id")
                        kind, stated = h.get("warc-type"), h.get("warc-payload-digest", "").removeprefix("sha256:")
                        digest = stated if kind == "revisit" else hashlib.sha256(payload).hexdigest()
                        rows.append((int(page) if page else None, h.get("warc-target-uri"), kind, int(refers) if refers else None, digest, payload))
                        size += len(payload)
                        if size > 8 << 20 or len(rows) >= 4096:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds, strict=True)], names=names)
                            rows, size = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds, strict=True)], names=names)

    spark = manifest.sparkSession
    parallel = parallel or max(spark.sparkContext.defaultParallelism, 1)
    paths = manifest.select("path").repartition(max(1, min(parallel * 4, manifest.count())), "path")
    return paths.mapInArrow(run, "page_id long, url string, record_type string, refers_to long, payload_digest string, payload binary")


def resolved(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to; a revisit's from the response it names.

    Fails if a revisit's digest isn't that of the response.
    """
    held = materialise(records.select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), "payload_digest", "record_type", "refers_to"), "records")
    key = ["refers_to", "payload_digest"]
    revisits = held.filter(F.col("record_type") == "revisit").select("page_id", "record_type", *key)
    responses = held.filter((F.col("record_type") == "response") & F.col("page_id").isNotNull())
    named = responses.groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.max("payload_bytes").alias("payload_bytes"))
    counts = materialise(revisits.groupBy(*key).agg(F.count("*").alias("n")), "named")
    total = counts.agg(F.sum("n")).first()[0] or 0
    found = spread_join(revisits, materialise(counts.join(named, key, "left"), "named"), key, "n", total)
    checked = F.when(F.col("payload_bytes").isNull(), F.raise_error(F.lit("a revisit names no response with its digest"))).otherwise(F.col("payload_bytes"))
    found = found.select("page_id", checked.cast("long").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
    return held.filter(F.col("record_type") == "response").unionByName(found)
