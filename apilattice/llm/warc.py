"""WARC archives in Zstandard frames: a writer, and a reader that checks what it reads.

An archive starts with a skippable frame that holds a dictionary (raw, or itself a Zstandard
frame); then each record is a frame of its own, compressed with that dictionary.  The reader
loads the dictionary, finds each frame's end from its block headers, decodes one frame at a
time, and checks the version line, the header fields, the lengths and the payload digest.

Archives are rows (archive, content), as ``binaryFile`` also gives them, so they live in any
store that Spark reads.  Records with equal payloads of at least ``revisit_from`` bytes are
written once: that of the largest page id is the response, the others are revisits that
refer to it and keep its HTTP head.

Null html is an empty payload, null urls are ``about:blank``.  Rows that repeat the largest
id are responses too.  Null ids are written without a number; if a group has no other id its
rows are responses.  An empty table gives no archives.  A record that fails a check comes
back with its ``error``; after a broken frame the rest of its archive is lost and said so.
:func:`sound` gives the rows on only if none has an error.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apilattice.llm.staging import small_batches, table

SKIPPABLE = 0x184D2A5D
FRAME = 0xFD2FB528
ARCHIVE_BYTES = 8 << 20
#: The dictionary is fitted on the first so many pages that come, each up to so many characters.
SAMPLE, SAMPLE_CHARS = 256, 4096
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MOST_BROADCAST = 32 << 20


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary, or none if there is too little to train on."""
    try:
        return zstd.train_dictionary(16 << 10, samples).as_bytes()
    except (zstd.ZstdError, ValueError):
        return b""


def record(page: int | None, url: str, payload: bytes, refers: int | None) -> bytes:
    name = "none" if page is None else page
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers is not None else head + payload
    url = "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url) or "about:blank"
    fields = [("WARC-Type", "response" if refers is None else "revisit"), ("WARC-Record-ID", f"<urn:page:{name}>"), ("WARC-Date", DATE), ("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha1:{digest(payload)}")]
    if refers is not None:
        fields += [("WARC-Refers-To", f"<urn:page:{refers}>"), ("WARC-Profile", PROFILE)]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def skippable(content: bytes) -> bytes:
    return struct.pack("<II", SKIPPABLE, len(content)) + content


def frame_end(data: memoryview, at: int) -> int:
    """Where the frame that starts at ``at`` ends, from its header and block headers."""
    if len(data) - at < 6 or struct.unpack_from("<I", data, at)[0] != FRAME:
        raise ValueError("no Zstandard frame")
    what = data[at + 4]
    single, size = what >> 5 & 1, what >> 6
    at += 5 + (not single) + (0, 1, 2, 4)[what & 3] + (single, 2, 4, 8)[size]
    last = 0
    while not last:
        if at + 3 > len(data):
            raise ValueError("truncated frame")
        block = int.from_bytes(data[at : at + 3], "little")
        last, kind = block & 1, block >> 1 & 3
        at += 3 + (1 if kind == 1 else block >> 3)
    at += 4 * (what >> 2 & 1)
    if at > len(data):
        raise ValueError("truncated frame")
    return at


def parse(raw: bytes) -> dict:
    """A record's fields, checked."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not found or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError("no WARC version line")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            raise ValueError("a header line without a colon")
        fields[name.strip().lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise ValueError(f"no {name}")
    if not fields["content-length"].isdigit() or len(rest) != int(fields["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise ValueError("the block's length is not Content-Length")
    block = rest[:-4]
    http, found, payload = block.partition(b"\r\n\r\n")
    told = [line.split(b":", 1)[1].strip() for line in http.split(b"\r\n")[1:] if line.lower().startswith(b"content-length:")]
    if not found or not told or not told[0].isdigit():
        raise ValueError("no HTTP length")
    kind, want = fields["warc-type"], fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "response" and (len(payload) != int(told[0]) or digest(payload) != want):
        raise ValueError("the payload is not what its head says")
    if kind == "revisit" and ("warc-refers-to" not in fields or len(want) != 32 or payload):
        raise ValueError("an incomplete revisit")
    page = lambda k: int(x) if (x := fields.get(k, "").removeprefix("<urn:page:").removesuffix(">")).lstrip("-").isdigit() else None
    return {"page_id": page("warc-record-id"), "url": fields.get("warc-target-uri"), "record_type": kind, "refers_to": page("warc-refers-to"), "payload_bytes": int(told[0]), "payload_digest": want, "payload": payload if kind == "response" else None}


def records(content: bytes) -> Iterator[dict]:
    """The records of one archive, each with its error or None."""
    data, at, dict_ = memoryview(content), 0, None
    try:
        if len(data) >= 8 and struct.unpack_from("<I", data)[0] == SKIPPABLE:
            at = 8 + struct.unpack_from("<I", data, 4)[0]
            if at > len(data):
                raise ValueError("truncated dictionary")
            raw = bytes(data[8:at])
            if raw[:4] == struct.pack("<I", FRAME):
                raw = zstd.ZstdDecompressor().decompressobj().decompress(raw)
            dict_ = zstd.ZstdCompressionDict(raw) if raw else None
        reader = zstd.ZstdDecompressor(dict_data=dict_) if dict_ else zstd.ZstdDecompressor()
        while at < len(data):
            end = frame_end(data, at)
            raw = reader.decompressobj().decompress(bytes(data[at:end]))
            at = end
            try:
                yield parse(raw) | {"error": None}
            except ValueError as e:
                yield {"error": str(e)}
    except (ValueError, zstd.ZstdError) as e:
        yield {"error": f"at byte {at}: {e}"}


def write(pages: DataFrame, revisit_from: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(archive, content): archives of a record for each row, about ARCHIVE_BYTES each."""
    small_batches(pages.sparkSession)
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), payload.alias("html"), F.sha1(F.encode(payload, "UTF-8")).alias("sha"), F.octet_length(payload).alias("bytes"))
    same = rows.where(F.col("bytes") >= revisit_from).groupBy("sha").agg(F.count("*").alias("many"), F.max("page_id").alias("first")).where("many > 1").select("sha", "first")
    same = table(same, "warc-payloads")
    if same.count() * 64 <= MOST_BROADCAST:
        same = F.broadcast(same)
    refers = F.when((F.col("bytes") >= revisit_from) & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    samples = [row[0].encode() for row in rows.select(F.substring("html", 1, SAMPLE_CHARS)).limit(SAMPLE).collect()]
    shared = pages.sparkSession.sparkContext.broadcast(dictionary(samples))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        raw = shared.value
        dict_ = zstd.ZstdCompressionDict(raw) if raw else None
        writer = zstd.ZstdCompressor(level=3, dict_data=dict_) if dict_ else zstd.ZstdCompressor(level=3)
        held, size = [], 0
        out = lambda: pa.RecordBatch.from_arrays([pa.array([f"{uuid.uuid4().hex}.warc.zst"]), pa.array([b"".join([skippable(raw), *held])], pa.binary())], ["archive", "content"])
        for batch in batches:
            for page, url, html, first in zip(*(batch.column(k) for k in range(4))):
                held.append(writer.compress(record(page.as_py(), url.as_py(), html.as_py().encode(), first.as_py())))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    rows = rows.join(same, "sha", "left").select("page_id", "url", "html", refers.alias("refers"))
    return rows.mapInArrow(pack, "archive string, content binary")


FIELDS = "archive string, page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, error string"


def read(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """A row for each record of archives(archive, content): its fields, its error, and its payload if wanted."""
    names = [x.split()[0] for x in FIELDS.split(", ")][1:] + ["payload"] * payloads
    kinds = {"page_id": pa.int64(), "refers_to": pa.int64(), "payload_bytes": pa.int64(), "payload": pa.binary()}

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows: list[dict] = []

                def made() -> pa.RecordBatch:
                    return pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.string()), *(pa.array([r.get(k) for r in rows], kinds.get(k, pa.string())) for k in names)], ["archive", *names])

                for row in records(content.as_buffer().to_pybytes()):
                    rows.append(row)
                    if len(rows) == 512:
                        yield made()
                        rows = []
                yield made()

    return archives.select("archive", "content").mapInArrow(unpack, FIELDS + ", payload binary" * payloads)


def sound(found: DataFrame) -> DataFrame:
    """The rows of :func:`read` without their error column; a row with an error stops the query, naming archive and error."""
    message = F.concat_ws(": ", F.lit("a broken record"), "archive", "error")
    return found.where(F.when(F.col("error").isNull(), F.lit(True)).otherwise(F.raise_error(message))).drop("error")
