"""WARC: a monolithic gzip normaliser with a sidecar offset index, and the writer and reader around it.

Three jobs, each a Spark stage whose tasks own whole archives:

* write_crawl: every scan partition streams its pages into archives that are one gzip stream each.
* normalise: inflates each such stream once, rewrites every record as a gzip member of its own and writes
  `<archive>.idx` beside it, a line of JSON a record with its offset and length. Records whose payload
  another record holds become revisits on the way.
* read_back: takes the sidecar's offsets and inflates single members.

Page bodies are never shuffled: only digests and record numbers are. Archives roll over at ARCHIVE_BYTES,
which bounds a task's work; bodies are streamed. Files are written under a name of the attempt and then
moved, so a task that runs again replaces what a lost executor left. Paths are opened with pyarrow's file
systems, which reach the shared folder by its URI.

Edge cases: null html is an empty payload; a null url becomes the record's own id; a null page_id is kept
and ranks below all others; of repeated rows with the largest page_id the last record written is the
response and the others revisit it; empty tables give no archives; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercadia.llm._common import new_path, stored

#: Inflated bytes after which an archive is closed.
ARCHIVE_BYTES = 256 << 20
#: Equal payloads of at least so many bytes become revisits.
LEAST_REVISIT = 1000
DATE = "2024-01-01T00:00:00Z"
CHUNK = 1 << 20


def _folder(uri: str):
    fs, path = pafs.FileSystem.from_uri(uri)
    fs.create_dir(path, recursive=True)
    return fs, path


def _sha1(payload: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields)
    return b"WARC/1.1\r\n" + head.encode() + b"Content-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"


def _response(name: str, url: str, payload: bytes, digest: str) -> bytes:
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    fields = [("WARC-Type", "response"), ("WARC-Record-ID", f"<{name}>"), ("WARC-Date", DATE), ("WARC-Target-URI", url), ("WARC-Payload-Digest", digest), ("Content-Type", "application/http; msgtype=response")]
    return _record(fields, block)


def _line(value: str) -> str:
    """One header line's worth of a URL: blanks and controls are percent-encoded."""
    return "".join(c if c > " " else f"%{ord(c):02X}" for c in value)


def page_of(record_id: str) -> int | None:
    """The page_id at the end of a record's id."""
    last = record_id.rsplit(":", 1)[1]
    return None if last == "null" else int(last)


class _Archive:
    """A file that takes its name only when it is complete."""

    def __init__(self, fs, path: str):
        self.fs, self.path, self.draft = fs, path, f"{path}.{TaskContext.get().taskAttemptId()}"
        self.out, self.at = fs.open_output_stream(self.draft), 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.draft, self.path)


_MANIFEST = "archive string, no long, record_id string, page_id long, payload_digest string, payload_bytes long"


def write_crawl(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes pages (page_id, url, html) as monolithic archives; returns a row for each record."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _folder(folder)
        part, n, no, size, archive, squeeze, name = TaskContext.get().partitionId(), 0, 0, 0, None, None, ""
        for batch in batches:
            rows = []
            for page_id, url, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary())):
                if archive is None:
                    name, no, size, n = f"crawl-{part:05d}-{n:04d}.warc.gz", 0, 0, n + 1
                    archive, squeeze = _Archive(fs, f"{root}/{name}"), zlib.compressobj(1, zlib.DEFLATED, 31)
                payload = html.as_py() or b""
                digest, record_id = _sha1(payload), f"urn:x-page:{part}:{n}:{no}:{'null' if page_id is None else page_id}"
                record = _response(record_id, record_id if url is None else _line(url), payload, digest)
                archive.write(squeeze.compress(record))
                rows.append((name, no, record_id, page_id, digest, len(payload)))
                no, size = no + 1, size + len(record)
                if size >= archive_bytes:
                    archive.write(squeeze.flush())
                    archive.close()
                    archive = None
            cols = list(zip(*rows)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()))], names=["archive", "no", "record_id", "page_id", "payload_digest", "payload_bytes"])
        if archive is not None:
            archive.write(squeeze.flush())
            archive.close()

    return stored(pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(task, _MANIFEST), "manifest")


def records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Splits an inflated stream into (header fields, block)."""
    held = bytearray()

    def need(n: int) -> bool:
        while len(held) < n:
            more = next(chunks, None)
            if more is None:
                return False
            held.extend(more)
        return True

    while need(1):
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not need(len(held) + 1):
                raise ValueError("the stream ends within a record's header")
        lines = bytes(held[:end]).decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        start, size = end + 4, int(fields["Content-Length"])
        if not need(start + size + 4):
            raise ValueError("the stream ends within a record's block")
        yield fields, bytes(held[start : start + size])
        del held[: start + size + 4]


def inflated(stream, size: int = CHUNK) -> Iterator[bytes]:
    """The bytes of a gzip stream, whatever its number of members."""
    z = zlib.decompressobj(31)
    while data := stream.read(size):
        while data:
            if out := z.decompress(data):
                yield out
            data = z.unused_data
            if z.eof:
                z = zlib.decompressobj(31)


def normalise(revisits: DataFrame, folder: str, out_folder: str) -> DataFrame:
    """Rewrites each monolithic archive in folder record by record into out_folder, with its sidecar index.

    revisits: (archive, no, refers_to_id) with a row for each record of each archive; where refers_to_id is
    set, the record becomes a revisit of that one. Returns (archive, records, bytes).
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        name = pdf["archive"].iloc[0]
        turned = {int(n): r for n, r in zip(pdf["no"], pdf["refers_to_id"]) if isinstance(r, str)}
        fs, root = _folder(folder)
        out_fs, out_root = _folder(out_folder)
        out, index = _Archive(out_fs, f"{out_root}/{name}"), _Archive(out_fs, f"{out_root}/{name}.idx")
        with fs.open_input_stream(f"{root}/{name}", compression=None) as stream:
            for no, (fields, block) in enumerate(records(inflated(stream))):
                if no in turned:
                    fields |= {"WARC-Type": "revisit"}
                    more = [("WARC-Refers-To", f"<{turned[no]}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
                    block = block[: block.index(b"\r\n\r\n") + 4]
                else:
                    more = []
                z = zlib.compressobj(6, zlib.DEFLATED, 31)
                member = z.compress(_record([x for x in fields.items() if x[0] != "Content-Length"] + more, block)) + z.flush()
                line = {"offset": out.at, "length": len(member), "id": fields["WARC-Record-ID"][1:-1], "type": fields["WARC-Type"], "digest": fields["WARC-Payload-Digest"]}
                index.write(json.dumps(line).encode() + b"\n")
                out.write(member)
        out.close()
        index.close()
        return pd.DataFrame({"archive": [name], "records": [no + 1], "bytes": [out.at]})

    # a fixed number of partitions: by their bytes these few rows would be merged into one task
    archives = max(1, revisits.select("archive").distinct().count())
    return stored(revisits.select("archive", "no", "refers_to_id").repartition(archives, "archive").groupBy("archive").applyInPandas(one, "archive string, records long, bytes long"), "archives")


def read_back(archives: DataFrame, folder: str) -> DataFrame:
    """Reads the members that the sidecars of archives list: one row per record.

    payload_bytes and payload_digest are those of the full payload; a response's are taken from its bytes
    and must equal its header, a revisit's come from its headers.
    """

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = _folder(folder)
        for name in (n for pdf in frames for n in pdf["archive"]):
            with fs.open_input_stream(f"{root}/{name}.idx") as f:
                entries = [json.loads(x) for x in f.read().splitlines()]
            rows = []
            with fs.open_input_file(f"{root}/{name}") as f:
                for e in entries:
                    f.seek(e["offset"])
                    ((fields, block),) = records(iter([zlib.decompress(f.read(e["length"]), 31)]))
                    head, _, payload = block.partition(b"\r\n\r\n")
                    size = int(head.rsplit(b"Content-Length: ", 1)[1])
                    digest = fields["WARC-Payload-Digest"]
                    if fields["WARC-Type"] == "response" and (len(payload) != size or _sha1(payload) != digest):
                        raise ValueError(f"{name}: the record at {e['offset']} is damaged")
                    refers = fields.get("WARC-Refers-To")
                    rows.append((page_of(fields["WARC-Record-ID"][1:-1]), size, base64.b32decode(digest[5:]).hex(), fields["WARC-Type"], page_of(refers[1:-1]) if refers else None, name, e["offset"], e["length"]))
            yield pd.DataFrame(rows, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "archive", "offset", "length"]).astype({"page_id": "Int64", "refers_to": "Int64"})

    n = max(1, archives.count())
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long, length long"
    return archives.select("archive").repartition(n, "archive").mapInPandas(task, schema)


def archive_pages(pages: DataFrame, folder: str | None = None, least: int = LEAST_REVISIT, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes pages as normalised archives under folder and returns what reading them back gives."""
    folder = folder or new_path(pages.sparkSession, "warc")
    manifest = write_crawl(pages, f"{folder}/crawl", archive_bytes)
    # of equal payloads the record with the largest page_id stays a response; only groups of several matter
    kept = (
        manifest.where(F.col("payload_bytes") >= least)
        .groupBy("payload_digest", "payload_bytes")
        .agg(F.max(F.struct("page_id", "archive", "no", "record_id")).alias("last"), F.count(F.lit(1)).alias("copies"))
        .where("copies > 1")
        .select("payload_digest", "payload_bytes", F.col("last.record_id").alias("refers_to_id"))
    )
    revisits = manifest.join(kept, ["payload_digest", "payload_bytes"], "left").select("archive", "no", F.when(F.col("record_id") != F.col("refers_to_id"), F.col("refers_to_id")).alias("refers_to_id"))
    return read_back(normalise(revisits, f"{folder}/crawl", f"{folder}/normalised"), f"{folder}/normalised")
