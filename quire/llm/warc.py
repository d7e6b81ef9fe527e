"""WARC archives and their chunked record table.

Pages are written as WARC/1.1 response and revisit records, one gzip member a record, by the tasks that
hold them: each task streams to a file of its own name and renames it when it is whole, so a repeated
task leaves the same file. Reading streams every archive: a record becomes rows of (record_id, chunk_no),
each with a slice of its payload and the SHA-256 of the payload up to its end, so that the last row carries
the payload's digest and no record is ever held whole.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from quire.plans.materialize import fresh_path, written

CHUNK_BYTES = 1 << 20
MIN_SHARED = 100
LEVEL = 1
_DATE = "2024-01-01T00:00:00Z"
CHUNKS = "page_id long, record_id string, record_type string, url string, refers_to long, declared_digest string, declared_bytes long, chunk_no int, is_last boolean, payload binary, payload_upto long, digest_upto string"


def record_id(page: object) -> str:
    """An id that is a function of the page's."""
    h = hashlib.sha256(f"page {page}".encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:32]}>"


def classified(pages: DataFrame, page_id: str = "page_id", html: str = "html", least: int = MIN_SHARED) -> DataFrame:
    """(page_id, digest, size, refers_to): of equal payloads of at least `least` bytes the least page_id is kept, others refer to it.

    Null payloads are empty. A page without id refers to the least id of its payload, if there is one. Only ids and digests are
    moved; equal digests meet as partial minima, which are a table when they are joined, so that a frequent one can be split.
    """
    payload = F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary")
    marks = pages.select(F.col(page_id).cast("long").alias("page_id"), F.sha2(payload, 256).alias("digest"), F.octet_length(payload).cast("long").alias("size"))
    first = marks.where(F.col("size") >= least).groupBy("digest").agg(F.min("page_id").alias("kept"), F.count("*").alias("n")).where("n > 1 and kept is not null").select("digest", "kept")
    return marks.join(written(first, "first"), "digest", "left").select("page_id", "digest", "size", F.when(~F.col("page_id").eqNullSafe(F.col("kept")), F.col("kept")).alias("refers_to"))


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _record(out, page: int | None, name: str, url: str | None, payload: bytes, refers: int | None, digest: str, size: int) -> None:
    """One gzip member, the payload fed in chunks; a revisit declares its payload and holds none of it."""
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers is None else 'revisit'}", f"WARC-Record-ID: {name}", f"WARC-Date: {_DATE}", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {size}", "Content-Type: application/http; msgtype=response"]
    if page is not None:
        head.append(f"X-Page-ID: {page}")
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    if refers is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers)}", f"X-Refers-To-Page-ID: {refers}"]
        payload = b""
    head.append(f"Content-Length: {len(http) + len(payload)}")
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    out.write(z.compress(("\r\n".join(head) + "\r\n\r\n").encode() + http))
    for at in range(0, len(payload), CHUNK_BYTES):
        out.write(z.compress(payload[at : at + CHUNK_BYTES]))
    out.write(z.compress(b"\r\n\r\n") + z.flush())


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """records(page_id, url, html, digest, size, refers_to) -> (path, n_records): an archive for each partition that has rows, in `folder`, a URI that all executors reach."""

    def put(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import uuid

        from pyspark import TaskContext

        store, base = _open(folder)
        store.create_dir(base, recursive=True)
        task = TaskContext.get().partitionId()
        name = f"{base}/part-{task:06d}.warc.gz"
        own = f"{name}.{uuid.uuid4().hex}"
        n, out = 0, None
        for p in parts:
            for page, url, html, digest, size, refers in zip(p["page_id"], p["url"], p["html"], p["digest"], p["size"], p["refers_to"], strict=True):
                out = out or store.open_output_stream(own, compression=None)
                page = None if pd.isna(page) else int(page)
                _record(out, page, record_id(f"without id: {task}, {n}" if page is None else page), url if isinstance(url, str) else None, html.encode() if isinstance(html, str) else b"", None if pd.isna(refers) else int(refers), digest, int(size))
                n += 1
        if out:
            out.close()
            store.move(own, name)
            yield pd.DataFrame({"path": [f"{folder}/{name.rsplit('/', 1)[1]}"], "n_records": [n]})

    return records.select("page_id", "url", "html", "digest", "size", "refers_to").mapInPandas(put, "path string, n_records long")


class _Stream:
    """Bytes of a gzip file of many members, by line or count, with a bounded buffer."""

    def __init__(self, file):
        self.file, self.z, self.buf, self.rest, self.ended = file, zlib.decompressobj(31), b"", b"", False

    def _more(self) -> bool:
        while not self.ended:
            if self.z.eof:
                self.rest, self.z = self.z.unused_data, zlib.decompressobj(31)
            raw = self.z.unconsumed_tail or self.rest or self.file.read(CHUNK_BYTES)
            self.rest = b""
            if not raw:
                self.ended = True
                return False
            got = self.z.decompress(raw, CHUNK_BYTES)
            if got:
                self.buf += got
                return True
        return False

    def line(self) -> bytes | None:
        while (at := self.buf.find(b"\r\n")) < 0:
            if not self._more():
                return None
        out, self.buf = self.buf[:at], self.buf[at + 2 :]
        return out

    def take(self, n: int) -> bytes:
        """Up to n bytes, at least one unless the file ends."""
        if not self.buf:
            self._more()
        out, self.buf = self.buf[:n], self.buf[n:]
        return out


def records_of(file, chunk: int = CHUNK_BYTES) -> Iterator[tuple]:
    """Rows of CHUNKS for an open archive; a payload without bytes gives one row. A truncated file raises EOFError."""
    s = _Stream(file)
    while (line := s.line()) is not None:
        if line != b"WARC/1.1":
            if line == b"":
                continue
            raise ValueError("not a WARC record")
        head = {}
        while line := s.line():
            k, _, v = line.decode("utf-8", "replace").partition(": ")
            head[k.lower()] = v
        left = int(head["content-length"])
        while (line := s.line()) is not None:  # the HTTP head
            left -= len(line) + 2
            if not line:
                break
        refers = head.get("x-refers-to-page-id")
        page = head.get("x-page-id")
        fixed = (int(page) if page else None, head["warc-record-id"], head["warc-type"], head.get("warc-target-uri"), int(refers) if refers else None, head["warc-payload-digest"].partition(":")[2], int(head["x-payload-length"]))
        digest, upto, no, held = hashlib.sha256(), 0, 0, b""
        while left:
            got = s.take(min(left, chunk - len(held)))
            if not got:
                raise EOFError("the archive ends inside a record")
            left -= len(got)
            held += got
            if len(held) == chunk or not left:
                digest.update(held)
                upto += len(held)
                yield (*fixed, no, not left, held, upto, digest.hexdigest())
                no, held = no + 1, b""
        if not no:
            yield (*fixed, 0, True, b"", 0, digest.hexdigest())


def read_archives(paths: DataFrame, payload: bool = True, chunk: int = CHUNK_BYTES) -> DataFrame:
    """paths(path) -> the chunked record table; with payload=False its rows carry digests and lengths alone."""
    names = CHUNKS.replace(" long", "").replace(" string", "").replace(" int", "").replace(" boolean", "").replace(" binary", "").split(", ")

    def get(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def frame(rows: list) -> pd.DataFrame:
            out = pd.DataFrame(rows, columns=names)
            return out.astype({"page_id": "Int64", "refers_to": "Int64"})

        for p in parts:
            for path in p["path"]:
                store, at = _open(path)
                with store.open_input_stream(at, compression=None) as file:
                    rows, held = [], 0
                    for r in records_of(file, chunk):
                        rows.append(r if payload else (*r[:9], None, *r[10:]))
                        held += len(r[9]) if payload else 300
                        if held >= 4 * CHUNK_BYTES:
                            yield frame(rows)
                            rows, held = [], 0
                    if rows:
                        yield frame(rows)

    return paths.select("path").mapInPandas(get, CHUNKS)


def archive(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", folder: str | None = None) -> DataFrame:
    """pages -> (path, n_records) of the archives written in `folder` (a new one in the shared folder if not given).

    Every row becomes a record, rows that repeat a page_id and rows without one among them; the latter's records have ids of
    their own and no page id. Null URLs give records without a target; null pages have empty payloads; an empty table gives no archive.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    kinds = classified(rows).distinct()
    same = F.col("page_id").eqNullSafe(F.col("_p")) & (F.col("_d") == F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256))
    joined = rows.join(kinds.withColumnsRenamed({"page_id": "_p", "digest": "_d"}), same).drop("_p").withColumnRenamed("_d", "digest")
    return written(write_archives(joined, folder or fresh_path(spark, "warc")), "archives")


def round_trip(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes pages to archives and reads them back: one row a record, from its last chunk; revisits report what they declare.

    A response whose payload does not have the declared digest and length raises an error in the job.
    """
    paths = archive(pages, page_id, url, html)
    tasks = max(1, min(4096, paths.count()))
    last = read_archives(paths.repartition(tasks, F.xxhash64("path")), payload=False).where("is_last")
    revisit = F.col("record_type") == "revisit"
    sound: Column = revisit | ((F.col("digest_upto") == F.col("declared_digest")) & (F.col("payload_upto") == F.col("declared_bytes")))
    checked = F.when(sound, F.col("declared_digest")).otherwise(F.raise_error(F.concat(F.lit("payload differs from its digest: "), "record_id")).cast("string"))
    return last.select("page_id", F.when(revisit, F.col("declared_bytes")).otherwise(F.col("payload_upto")).alias("payload_bytes"), checked.alias("payload_digest"), "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
k AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS kept FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN kept = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN kept <> page_id THEN kept END AS refers_to FROM k
"""
