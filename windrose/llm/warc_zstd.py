"""WARC archives compressed with Zstandard, one frame per record, with a dictionary (operator 6).

An archive starts with a skippable frame (magic number 0x184D2A5D) that holds the dictionary, plain or itself compressed
with Zstandard; each record follows as a frame of its own. The writer trains each archive's dictionary on a bounded
sample of its own records. The reader loads the dictionary, decodes frame by frame, and validates record headers,
lengths and digests. Tasks write archives to the shared folder under names of their own and list them in a manifest;
only files that the manifest lists are read, so repeated or lost tasks leave nothing behind that counts.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import filesystem
from . import common

DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: An archive is closed after this many bytes of records, so a task holds that much at most, or one record.
ARCHIVE_BYTES = 8 << 20
#: What a reading task holds at most before it gives rows out, but for a single larger record.
BATCH_ROWS, BATCH_BYTES = 512, 8 << 20
#: The dictionary's size, and the bytes of records that it is trained on.
DICTIONARY_BYTES, SAMPLE_BYTES = 16 << 10, 512 << 10
LEVEL = 3
_READ = 64 << 10

RECORD = "page_id long, record_type string, target_uri string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    kind = "response" if refers_to is None else "revisit"
    name = f"<urn:uuid:{uuid.uuid4()}>" if page_id is None else f"<urn:page:{page_id}>"
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: {name}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="!#$%&'()*+,/:;=?@[]~-._"))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += [f"WARC-Payload-Digest: sha1:{sha1(payload)}", f"WARC-Block-Digest: sha1:{sha1(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return b"WARC/1.1\r\n" + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary_of(records: list[bytes]):
    """A dictionary trained on the first SAMPLE_BYTES of records; of records too few to train on, their own start."""
    import zstandard

    sample, size = [], 0
    for r in records:
        sample.append(r[: SAMPLE_BYTES - size])
        size += len(sample[-1])
        if size >= SAMPLE_BYTES:
            break
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, sample, k=256, d=8, level=LEVEL)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict((b"".join(sample) + bytes(8))[:DICTIONARY_BYTES], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def archive_bytes(records: list[bytes]) -> bytes:
    import zstandard

    trained = dictionary_of(records)
    packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=trained, write_checksum=True)
    shared = trained.as_bytes()
    return b"".join([struct.pack("<II", DICTIONARY_MAGIC, len(shared)), shared, *map(packer.compress, records)])


def frames(stream) -> Iterator[bytes]:
    """The records of an archive, frame by frame. ValueError where it is not such an archive or breaks off."""
    import zstandard

    head = stream.read(8)
    if not head:
        return
    magic, size = struct.unpack("<II", head) if len(head) == 8 else (0, 0)
    if magic != DICTIONARY_MAGIC:
        raise ValueError("an archive must start with its dictionary frame")
    shared = stream.read(size)
    if len(shared) != size:
        raise ValueError("the dictionary frame breaks off")
    if shared[:4] == FRAME_MAGIC:
        shared = zstandard.ZstdDecompressor().decompressobj().decompress(shared)
    opener = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(shared))
    left = stream.read(_READ)
    while left:
        frame, parts = opener.decompressobj(), []
        while True:
            try:
                parts.append(frame.decompress(left))
            except zstandard.ZstdError as x:
                raise ValueError(f"a frame can't be decoded: {x}") from x
            if frame.eof:
                left = frame.unused_data or stream.read(_READ)
                break
            if not (left := stream.read(_READ)):
                raise ValueError("the last frame breaks off")
        yield b"".join(parts)


_HEADER = re.compile(rb"([!#$%&'*+.^_`|~0-9A-Za-z-]+):[ \t]*([^\r\n]*?)[ \t]*\r\n")


def _headers(text: bytes) -> dict[str, str]:
    found, at = {}, 0
    while at < len(text):
        if not (m := _HEADER.match(text, at)):
            raise ValueError("a record's header line is malformed")
        found[m[1].decode().lower()] = m[2].decode("utf-8", "replace")
        at = m.end()
    return found


def parse(record: bytes) -> dict:
    """A record's fields, after its version, headers, lengths and digests are found to agree; else ValueError."""
    head, gap, rest = record.partition(b"\r\n\r\n")
    version, _, lines = (head + b"\r\n").partition(b"\r\n")
    if not gap or version not in (b"WARC/1.0", b"WARC/1.1"):
        raise ValueError("a record has no WARC version or no end of its headers")
    h = _headers(lines)
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in h:
            raise ValueError(f"a record lacks {name}")
    if not h["content-length"].isdigit() or len(rest) != int(h["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise ValueError("a record's length differs from its Content-Length")
    block = rest[:-4]
    if "warc-block-digest" in h and h["warc-block-digest"] != f"sha1:{sha1(block)}":
        raise ValueError("a record's block differs from its digest")
    status, _, rest = block.partition(b"\r\n")
    fields, _, payload = rest.partition(b"\r\n\r\n")
    if not status.startswith(b"HTTP/"):
        raise ValueError("a record's block is not an HTTP message")
    http = _headers(fields + b"\r\n")
    size, digest = int(http.get("content-length", len(payload))), h.get("warc-payload-digest", "").removeprefix("sha1:")
    if h["warc-type"] == "response" and (len(payload) != size or sha1(payload) != digest):
        raise ValueError("a response's payload differs from its length or digest")
    page = lambda x: int(x.removeprefix("<urn:page:").removesuffix(">")) if x and not x.startswith("<urn:uuid:") else None
    return {
        "page_id": page(h["warc-record-id"]),
        "record_type": h["warc-type"],
        "target_uri": h.get("warc-target-uri"),
        "payload_bytes": size,
        "payload_digest": digest,
        "refers_to": page(h.get("warc-refers-to")),
        "payload": payload if h["warc-type"] == "response" else None,
    }


def _writer(folder: str, date: str):
    def run(batches):
        system, root = filesystem(folder)
        kept: list[bytes] = []
        size = 0

        def close():
            name = f"{root}/{uuid.uuid4().hex}.warc.zst"
            with system.open_output_stream(name, compression=None) as out:
                out.write(archive_bytes(kept))
            return pa.RecordBatch.from_pydict({"name": [name.rsplit("/", 1)[1]], "records": [len(kept)], "record_bytes": [size]})

        for batch in batches:
            for page_id, url, html, refers_to in zip(*(batch.column(i) for i in range(4)), strict=True):
                kept.append(_record(page_id.as_py(), url.as_py(), (html.as_py() or "").encode(), refers_to.as_py(), date))
                size += len(kept[-1])
                if size >= ARCHIVE_BYTES:
                    yield close()
                    kept, size = [], 0
        if kept:
            yield close()

    return run


def write_archives(pages: DataFrame, folder: str, *, page_id: str = "page_id", url: str = "url", html: str = "html", revisit_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes a record for each row of ``pages`` into archives in ``folder``; returns their manifest (name, records, record_bytes).

    Of rows with equal payloads of at least ``revisit_bytes`` bytes, those with the largest id are responses and the
    others revisits of it; all other rows are responses. A null html is an empty payload, a null url has no target URI.
    Ids are integers. A row with a null id is a response without a page number, which is read as null, and no revisit
    refers to it. Rows that repeat an id each get a record. Payloads of any length are written whole, one frame each. Other
    columns are ignored; an empty table writes no archive.
    """
    spark = pages.sparkSession
    common.ship(spark)
    fs, there = common.hadoop(spark, folder)
    fs.mkdirs(there)
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"), F.sha1(F.coalesce(F.col(html), F.lit("")).cast("binary")).alias("digest"))
    ids, path = common.saved(rows.where(F.octet_length(F.coalesce("html", F.lit(""))) >= revisit_bytes).select("page_id", "digest"), "warc-ids")
    firsts = ids.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").select("digest", "refers_to")
    revisits, revisits_path = common.saved(ids.join(firsts, "digest").where("page_id < refers_to").select("page_id", "digest", "refers_to").distinct(), "warc-revisits")
    marked = rows.join(common.maybe_broadcast(revisits, revisits.count(), 100), ["page_id", "digest"], "left").select("page_id", "url", "html", "refers_to")
    manifest, _ = common.saved(marked.mapInArrow(_writer(folder, date), "name string, records long, record_bytes long"), "warc-manifest")
    common.remove(spark, path, revisits_path)
    return manifest


def _reader(folder: str, payloads: bool):
    names = [x.split()[0] for x in RECORD.split(", ")][: 7 if payloads else 6]

    def run(batches):
        system, root = filesystem(folder)
        for batch in batches:
            for name, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held, count, size = [], 0, 0
                with system.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for record in frames(stream):
                        found = parse(record)
                        held.append({n: found[n] for n in names})
                        count += 1
                        size += len(record) if payloads else 0
                        if len(held) == BATCH_ROWS or size >= BATCH_BYTES:
                            yield _batch(held, names)
                            held, size = [], 0
                if held:
                    yield _batch(held, names)
                if count != wanted:
                    raise ValueError(f"{name} has {count} records, not {wanted}")

    return run


_ARROW = {"page_id": pa.int64(), "record_type": pa.string(), "target_uri": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "refers_to": pa.int64(), "payload": pa.binary()}


def _batch(records: list[dict], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in records], _ARROW[n]) for n in names], names=names)


def read_archives(spark: SparkSession, folder: str, manifest: DataFrame, *, payloads: bool = True) -> DataFrame:
    """The records of the archives that the manifest lists: page_id, record_type, target_uri, payload_bytes,
    payload_digest, refers_to and, if wanted, payload (null for revisits). A task fails on an archive that is not sound.
    """
    common.ship(spark)
    n = max(1, manifest.count())
    schema = ", ".join(RECORD.split(", ")[: 7 if payloads else 6])
    return manifest.select("name", "records").repartition(n).mapInArrow(_reader(folder, payloads), schema)
