"""WARC records in ZIP-packaged archives: a writer, and a reader by ranges without extraction."""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zlib
from array import array
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, fresh_path, materialise, ship, text_or_empty

#: Fixed values of the ZIP format: signatures, and the marker of a field kept in ZIP64 form.
LOCAL, CENTRAL, END = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06"
END64, LOCATOR64 = b"PK\x06\x06", b"PK\x06\x07"
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF

#: Where the writer puts records and their index; the reader takes any member in these folders.
RECORDS, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
TIMESTAMP = "19700101000000"
#: Bytes of records after which a writing task starts another archive.
ARCHIVE_BYTES = 1 << 30
RANGE_BYTES = 4 << 20


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# ---------------------------------------------------------------- ZIP


class ZipWriter:
    """Stored members written one after the other to a stream that cannot seek."""

    def __init__(self, out, force64: bool = False):
        self.out, self.at, self.members, self.force64 = out, 0, [], force64

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def begin(self, name: str) -> None:
        raw = name.encode()
        # sizes follow in a data descriptor (flag 8, UTF-8 names flag 0x800); ZIP64 extra: 8-byte descriptor
        self.members.append([raw, self.at, 0, 0])
        extra = struct.pack("<HHQQ", 1, 16, 0, 0)
        self._write(struct.pack("<4sHHHHHLLLHH", LOCAL, 45, 0x808, 0, 0, 0x21, 0, FULL32, FULL32, len(raw), len(extra)) + raw + extra)

    def data(self, block: bytes) -> int:
        """Add to the open member; returns where in the member it starts."""
        m = self.members[-1]
        at = m[3]
        m[2], m[3] = zlib.crc32(block, m[2]), at + len(block)
        self._write(block)
        return at

    def end(self) -> None:
        _, _, crc, size = self.members[-1]
        self._write(b"PK\x07\x08" + struct.pack("<LQQ", crc, size, size))

    def close(self) -> None:
        start = self.at
        for raw, at, crc, size in self.members:
            wide = [v for v in (size, size, at) if self.force64 or v >= FULL32]
            extra = struct.pack(f"<HH{len(wide)}Q", 1, 8 * len(wide), *wide) if wide else b""
            small = lambda v: FULL32 if self.force64 or v >= FULL32 else v
            self._write(struct.pack("<4sHHHHHHLLLHHHHHLL", CENTRAL, 45, 45, 0x808, 0, 0, 0x21, crc, small(size), small(size), len(raw), len(extra), 0, 0, 0, 0, small(at)) + raw + extra)
        size, n = self.at - start, len(self.members)
        if self.force64 or n >= FULL16 or size >= FULL32 or start >= FULL32:
            end64 = self.at
            self._write(struct.pack("<4sQHHLLQQQQ", END64, 44, 45, 45, 0, 0, n, n, size, start))
            self._write(struct.pack("<4sLQL", LOCATOR64, 0, end64, 1))
            n, size, start = FULL16, FULL32, FULL32
        self._write(struct.pack("<4sHHHHLLH", END, 0, 0, n, n, size, start, 0))


def _at(f, offset: int, size: int) -> bytes:
    f.seek(offset)
    return f.read(size)


def zip_members(f, length: int, wanted=lambda name: True) -> dict[str, tuple[int, int]]:
    """Stored members of an archive: name -> (first byte, size), from its directories alone.

    ``f`` is any file with seek and read; members whose name is not ``wanted`` are passed over. The end record is searched from the back past a
    comment; ZIP64 records and extra fields replace fields that are full. Raises ValueError for
    what is no ZIP file and for members that are compressed or encrypted.
    """
    tail = _at(f, max(0, length - 22 - FULL16), min(length, 22 + FULL16))
    at = tail.rfind(END)
    while at >= 0 and (at + 22 > len(tail) or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
        at = tail.rfind(END, 0, at)
    if at < 0:
        raise ValueError("no end of central directory")
    n, size, start = struct.unpack_from("<HLL", tail, at + 10)
    if FULL16 == n or FULL32 in (size, start):
        place = length - len(tail) + at - 20
        if place < 0:
            raise ValueError("no ZIP64 locator")
        sign, _, where, _ = struct.unpack("<4sLQL", _at(f, place, 20))
        if sign == LOCATOR64:
            sign, *_, n, size, start = struct.unpack("<4sQHHLLQQQQ", _at(f, where, 56))
            if sign != END64:
                raise ValueError("ZIP64 end record is damaged")
    directory, out, at = _at(f, start, size), {}, 0
    for _ in range(n):
        if directory[at : at + 4] != CENTRAL:
            raise ValueError("central directory is damaged")
        flags, method = struct.unpack_from("<HH", directory, at + 8)
        packed, full, n_name, n_extra, n_note = struct.unpack_from("<LLHHH", directory, at + 20)
        offset = struct.unpack_from("<L", directory, at + 42)[0]
        name = directory[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra = directory[at + 46 + n_name : at + 46 + n_name + n_extra]
        while len(extra) >= 4:
            kind, k = struct.unpack_from("<HH", extra)
            if kind == 1:
                values = iter(struct.unpack_from(f"<{k // 8}Q", extra, 4))
                full = next(values) if full == FULL32 else full
                packed = next(values) if packed == FULL32 else packed
                offset = next(values) if offset == FULL32 else offset
            extra = extra[4 + k :]
        at += 46 + n_name + n_extra + n_note
        if not wanted(name):
            continue
        if method or flags & 1:
            raise ValueError(f"{name}: not a stored member")
        head = _at(f, offset, 30)
        if head[:4] != LOCAL:
            raise ValueError(f"{name}: local header is damaged")
        a, b = struct.unpack_from("<HH", head, 26)
        out[name] = (offset + 30 + a + b, packed)
    return out


# ---------------------------------------------------------------- WARC


def escaped(url: str) -> str:
    """White space and control characters would break a header or an index line."""
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)


def warc_record(kind: str, uri: str, record_id: str, digest: str, payload: bytes, extra: dict[str, str]) -> bytes:
    """One gzip member holding one record; a revisit has its headers only."""
    block = payload if kind == "response" else b""
    fields = {
        "WARC-Type": kind,
        "WARC-Record-ID": f"<urn:uuid:{record_id}>",
        "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Target-URI": uri,
        "WARC-Payload-Digest": f"sha1:{digest}",
        **extra,
        "Content-Type": "text/html; charset=utf-8",
        "Content-Length": str(len(block)),
    }
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n"
    return gzip.compress(head.encode() + block + b"\r\n\r\n", 1, mtime=0)


def _head(raw: bytes) -> dict[str, str]:
    first, *lines = raw.decode("utf-8").split("\r\n")
    if not first.startswith("WARC/1."):
        raise ValueError("not a WARC record")
    return {k.strip().title(): v.strip() for k, _, v in (line.partition(":") for line in lines)}


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in title case) and block of one record, a gzip member or plain."""
    raw = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
    head, sep, rest = raw.partition(b"\r\n\r\n")
    fields = _head(head)
    n = int(fields["Content-Length"])
    if not sep or rest[n:] != b"\r\n\r\n":
        raise ValueError("record is cut short")
    return fields, rest[:n]


def payload_of(fields: dict[str, str], block: bytes) -> bytes:
    """What a record is about: the body where the block is an HTTP message, else the block."""
    return block.partition(b"\r\n\r\n")[2] if fields.get("Content-Type", "").startswith("application/http") else block


def scan_records(f, at: int, size: int):
    """Records of a member that no index covers, one after the other, by ranges."""
    end, buffer, inflate = at + size, bytearray(), None
    if _at(f, at, min(2, size)) == b"\x1f\x8b":
        inflate = zlib.decompressobj(31)
    while at < end:
        block = _at(f, at, min(RANGE_BYTES, end - at))
        at += len(block)
        if not block:
            break
        while block:
            if inflate is None:
                buffer += block
                block = b""
            else:  # gzip members follow each other
                buffer += inflate.decompress(block)
                block = inflate.unused_data
                if inflate.eof:
                    inflate = zlib.decompressobj(31)
            while (head := buffer.find(b"\r\n\r\n")) >= 0:
                n = head + 8 + int(_head(bytes(buffer[:head]))["Content-Length"])
                if len(buffer) < n:
                    break
                yield parse_record(bytes(buffer[:n]))
                del buffer[:n]
    if at < end or buffer:
        raise ValueError("record is cut short")


def index_places(f, at: int, size: int, packed: bool) -> dict[str, tuple[array, array]]:
    """Offsets and lengths of records by file name, from the lines ``key timestamp {json}`` of an index."""
    places: dict[str, tuple[array, array]] = {}
    inflate, rest, end = zlib.decompressobj(31) if packed else None, b"", at + size
    while at < end:
        block = _at(f, at, min(RANGE_BYTES, end - at))
        at += len(block)
        if not block:
            raise ValueError("index is cut short")
        plain = b"" if packed else block
        while packed and block:
            plain += inflate.decompress(block)
            block = inflate.unused_data
            if inflate.eof:
                inflate = zlib.decompressobj(31)
        *lines, rest = (rest + plain).split(b"\n")
        for line in lines + ([rest] if at >= end else []):
            if (brace := line.find(b"{")) >= 0 and not line.startswith(b"!"):
                e = json.loads(line[brace:])
                offsets, lengths = places.setdefault(e.get("filename", ""), (array("Q"), array("Q")))
                offsets.append(int(e["offset"]))
                lengths.append(int(e["length"]))
    return places


def surt(url: str) -> str:
    """The sort-friendly form of an address in an index: host parts turned round, then the path."""
    try:
        u = urlsplit(url)
        host = (u.hostname or "").removeprefix("www.")
    except ValueError:
        host = ""
    if not host:
        return url or "-"
    return ",".join(reversed(host.split("."))) + ")" + (u.path or "/").lower() + (f"?{u.query.lower()}" if u.query else "")


def _open_fs(path: str):
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:/") else f"file://{path}")


def write_archives(pages: DataFrame, *, id_col="page_id", url_col="url", html_col="html", dedup_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a WARC record for each page into ZIP archives in the shared folder.

    Every task streams its records, a gzip member each, into a stored member of an archive of
    its own and adds an index of their places. Among equal payloads of at least ``dedup_bytes``
    the record with the smallest id is the response, others revisit it; a tie of ids (a
    repeated row) gives a response each; rows with a null id come last, and are responses where
    they have no other. Null html counts as empty, null urls as "". Returns (path, n_records); a
    task that runs again writes another archive, and only those of finished tasks are listed.
    """
    spark = pages.sparkSession
    ship(spark)
    bounded_batches(spark)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), text_or_empty(url_col).alias("url"), text_or_empty(html_col).alias("html"))
    payload = F.encode("html", "UTF-8")
    keyed = rows.select("page_id", F.octet_length("html").alias("n"), F.unhex(F.sha1(payload)).alias("sha"))
    first = keyed.where(F.col("n") >= dedup_bytes).groupBy("sha").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    # only groups of copies go on; a payload of its own is no revisit
    revisits = keyed.where(F.col("n") >= dedup_bytes).join(first.where("copies > 1"), "sha")
    revisits = revisits.where("first is not null and (page_id is null or page_id <> first)")
    revisits = revisits.select("page_id", "first", "sha").distinct()
    rows = rows.withColumn("sha", F.unhex(F.sha1(payload)))
    marked = rows.join(revisits.withColumnRenamed("page_id", "id").withColumnRenamed("sha", "s"), F.col("page_id").eqNullSafe(F.col("id")) & (F.col("sha") == F.col("s")), "left")
    marked = marked.select("page_id", "url", "html", "first")
    folder = fresh_path(spark, "warc")

    def run(batches):
        fs, root = _open_fs(folder)
        fs.create_dir(root, recursive=True)
        state: dict = {}

        def finish():
            z, stream, path, lines = state["z"], state["out"], state["path"], state["lines"]
            z.end()
            z.begin(INDEX)
            lines.sort()
            for i in range(0, len(lines), 10_000):
                z.data("".join(lines[i : i + 10_000]).encode())
            z.end()
            z.close()
            stream.close()
            state.clear()
            return pa.RecordBatch.from_pydict({"path": [path], "n_records": [len(lines)]})

        for batch in batches:
            for r in batch.to_pylist():
                if not state:
                    path = f"{root}/{uuid.uuid4().hex}.zip"
                    out = fs.open_output_stream(path)
                    state |= {"z": ZipWriter(out), "out": out, "path": folder + path[len(root) :], "lines": []}
                    state["z"].begin(RECORDS)
                body = r["html"].encode("utf-8")
                kind = "response" if r["first"] is None else "revisit"
                extra = {"WARC-Page-ID": "" if r["page_id"] is None else str(r["page_id"]), "WARC-Payload-Length": str(len(body))}
                if kind == "revisit":
                    extra["WARC-Refers-To-Page-ID"] = str(r["first"])
                    extra["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
                name = str(uuid.uuid5(uuid.NAMESPACE_URL, f"{r['page_id']} {r['url']}"))
                target, digest = escaped(r["url"]), sha1_base32(body)
                data = warc_record(kind, target, name, digest, body, extra)
                at = state["z"].data(data)
                place = {"url": target, "digest": f"sha1:{digest}", "offset": at, "length": len(data), "filename": RECORDS.split("/")[1]}
                state["lines"].append(f"{surt(target)} {TIMESTAMP} {json.dumps(place)}\n")
                if state["z"].at >= archive_bytes:
                    yield finish()
        if state:
            yield finish()

    return materialise(marked.mapInArrow(run, "path string, n_records long"), "warc-list")


def read_archives(archives: DataFrame, *, with_payload: bool = True) -> DataFrame:
    """Read every record of the ZIP archives in ``path`` by ranges, nothing extracted.

    Records are the members ``archive/*.warc`` and ``archive/*.warc.gz``, whatever their names, found
    through the directories. Lines of ``indexes/*.cdxj``, ``*.cdx`` (JSON lines) and their ``.gz`` forms give the
    places; a member that no line names is read from front to back. A member of these folders that is compressed
    raises ValueError, other members are passed over.

    Returns page_id, url, record_type, payload_digest, payload_bytes, refers_to and, if asked, payload
    (null for revisits). page_id and refers_to are null where an archive was not written here. Digest and length of a
    record with a payload are computed from its block (from the body of an HTTP message) and must equal its headers,
    bodies with a transfer encoding aside; a difference raises ValueError. A revisit has those of its headers, which
    ``check_revisits`` compares with the response. A repeated path is read again, an empty table gives no rows.
    """
    ship(archives.sparkSession)
    ddl = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long" + ", payload binary" * with_payload
    names = [c.split()[0] for c in ddl.split(", ")]
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()][: len(names)]
    schema = pa.schema(list(zip(names, types, strict=True)))

    def kept(name: str) -> bool:
        plain = name.removesuffix(".gz")
        return (name.startswith("archive/") and plain.endswith(".warc")) or (name.startswith("indexes/") and plain.endswith((".cdxj", ".cdx")))

    def rows_of(path: str):
        fs, at = _open_fs(path)
        with fs.open_input_file(at) as f:
            members = zip_members(f, f.size(), kept)
            files = {name.removeprefix("archive/"): place for name, place in members.items() if name.startswith("archive/")}
            places: dict[str, list] = {}
            for name, (start, size) in members.items():
                if name.startswith("indexes/"):
                    for file, found in index_places(f, start, size, name.endswith(".gz")).items():
                        file = next(iter(files)) if not file and len(files) == 1 else file
                        places.setdefault(file, []).append(found)
            if missing := places.keys() - files.keys():
                raise ValueError(f"{path}: its index names {sorted(missing)[0]!r}, which it has not")
            for file, (base, size) in files.items():
                if file not in places:
                    yield from scan_records(f, base, size)
                    continue
                offset, length = (np.concatenate([np.asarray(x[i], np.uint64) for x in places[file]]).astype(np.int64) for i in (0, 1))
                offset, first = np.unique(offset, return_index=True)  # an address may be listed in two indexes
                length = length[first]
                stop, i = offset + length, 0
                if (stop > size).any():
                    raise ValueError(f"{path}: its index points past the end of {file}")
                while i < len(offset):  # records of near places in one read
                    j = max(i + 1, int(np.searchsorted(stop, offset[i] + RANGE_BYTES, "right")))
                    low = int(offset[i])
                    data = _at(f, base + low, int(stop[i:j].max()) - low)
                    for a, b in zip((offset[i:j] - low).tolist(), (stop[i:j] - low).tolist(), strict=True):
                        yield parse_record(data[a:b])
                    i = j

    def number(text: str | None) -> int | None:
        return int(text) if text else None

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                out, total = [], 0
                for h, block in rows_of(path):
                    kind, digest, n = h["Warc-Type"], h.get("Warc-Payload-Digest"), number(h.get("Warc-Payload-Length"))
                    sha1 = digest.split(":", 1)[1] if digest and digest.lower().startswith("sha1:") else None
                    payload = payload_of(h, block)
                    if kind != "revisit":
                        own = sha1_base32(payload)
                        whole = payload is block or b"transfer-encoding:" not in block[: len(block) - len(payload)].lower()
                        if whole and "Warc-Truncated" not in h and (sha1 not in (None, own) or n not in (None, len(payload))):
                            raise ValueError(f"{path}: payload differs from its digest")
                        sha1, n = own, len(payload)
                    row = [number(h.get("Warc-Page-Id")), h.get("Warc-Target-Uri"), kind, sha1, n, number(h.get("Warc-Refers-To-Page-Id"))]
                    out.append(row + [payload if kind != "revisit" else None] * with_payload)
                    total += len(payload) * with_payload + 200
                    if total > RANGE_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], schema=schema)
                        out, total = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], schema=schema)

    paths = archives.select("path")
    return paths.repartition(max(1, archives.count())).mapInArrow(run, ddl)


def check_revisits(records: DataFrame) -> DataFrame:
    """``records`` of ``read_archives``, written and reread, after comparing revisits with their responses.

    Every revisit that names a page must find a response of that page with its digest and length among the
    records, else ValueError is raised. Revisits are reduced to one row for each response before they meet.
    """
    records = materialise(records, "warc-records")
    revisits = records.where("record_type = 'revisit' and refers_to is not null")
    revisits = revisits.select(F.col("refers_to").alias("page_id"), "payload_digest", "payload_bytes").distinct()
    lost = revisits.join(records.where("record_type = 'response'"), ["page_id", "payload_digest", "payload_bytes"], "left_anti")
    if wrong := lost.limit(1).collect():
        raise ValueError(f"revisits of page {wrong[0].page_id} differ from its response")
    return records
