"""``df.write.format("warc")``: WARC/1.0 files, one gzip member per record.

Each task writes its own files, so nothing is shared or locked: Arrow batches of
records stream to files whose final names no other attempt has, and a new file is
begun when the last one has grown past ``maxBytes``.  Nothing is renamed: a job's
manifest, one small file that the driver writes in the end, is what makes its
files part of the archive (:func:`committed_files`).  Files of failed or duplicate
attempts are in no manifest, nor are those of a job that was killed before.

Options: ``path`` (a folder; local, or any file system pyarrow can open),
``maxBytes`` (0 or absent: 100 MB) and ``jobId``: a job whose id has a manifest
already writes nothing, so a rerun doubles nothing.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

DEFAULT_MAX_BYTES = 100 * 1024 * 1024

# Formats of the archive standard.  Fixed values.
VERSION_LINE = "WARC/1.0\r\n"
DATE_FORMAT = "%Y-%m-%dT%H:%M:%SZ"
MANIFESTS = "_manifests"
RECORD_END = b"\r\n\r\n"
#: gzip headers: deflate, no time, best compression, unknown system; in the first a name follows
GZIP_NAMED, GZIP_NAMELESS = (b"\x1f\x8b\x08" + flag + b"\0\0\0\0\x02\xff" for flag in (b"\x08", b"\0"))
WARCINFO_TYPE = "application/warc-fields"
WARCINFO = (
    "Software: linkloom/1.0\r\n"
    "Format: WARC File Format 1.0\r\n"
    "Conformsto: http://bibnum.bnf.fr/WARC/WARC_ISO_28500_version1_latestdraft.pdf\r\n"
).encode()

SCHEMA = (
    "record_id string, warc_type string, target_uri string, date timestamp, warcinfo_id string, "
    "content_type string, content_length bigint, payload binary"
)


@dataclass
class FilesWritten(WriterCommitMessage):
    """Name, bytes and records of the files one task attempt produced."""

    files: list[tuple[str, int, int]]


def _filesystem(path: str):
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def _gzip_start(name: str | None) -> bytes:
    """A member's header: the last part of ``name``, or none if it has none that the format can hold."""
    try:
        named = (name or "").rpartition("/")[2].encode("latin-1").removesuffix(b".gz")
    except UnicodeEncodeError:
        named = b""
    return GZIP_NAMED + named + b"\0" if named else GZIP_NAMELESS


def gzip_member(name: str, headers: list[tuple[str, str]], payload: bytes) -> bytes:
    """One compressed record; the gzip header names the record."""
    head = VERSION_LINE + "".join(f"{k}: {v}\r\n" for k, v in headers) + "\r\n"
    content = b"".join((head.encode("utf-8"), payload, RECORD_END))
    deflate = zlib.compressobj(9, zlib.DEFLATED, -zlib.MAX_WBITS)
    tail = struct.pack("<II", zlib.crc32(content), len(content) & 0xFFFFFFFF)
    return b"".join((_gzip_start(name), deflate.compress(content), deflate.flush(), tail))


class _RotatingFiles:
    """The files of one task attempt, one open at a time."""

    def __init__(self, filesystem, folder: str, stem: str, max_bytes: int):
        self.fs, self.folder, self.stem, self.max_bytes = filesystem, folder, stem, max_bytes
        self.done: list[tuple[str, int, int]] = []
        self.stream = None
        self.name = self.info_id = ""
        self.size = self.records = 0

    def _open(self) -> None:
        self.name = f"{self.stem}-{len(self.done):016x}.warc.gz"
        self.stream = self.fs.open_output_stream(f"{self.folder}/{self.name}", compression=None)
        self.size = self.records = 0
        digest = hashlib.md5(self.name.encode()).hexdigest()
        self.info_id = f"<urn:uuid:{uuid.UUID(digest)}>"

    def add(self, date: str, make) -> None:
        if self.stream is None or self.size > self.max_bytes:
            self.close()
            self._open()
            self._put(
                gzip_member(
                    self.info_id,
                    [
                        ("WARC-Type", "warcinfo"),
                        ("WARC-Record-ID", self.info_id),
                        ("WARC-Date", date),
                        ("WARC-Warcinfo-ID", self.info_id),
                        ("Content-Type", WARCINFO_TYPE),
                        ("Content-Length", str(len(WARCINFO))),
                    ],
                    WARCINFO,
                )
            )
        self._put(make(self.info_id))
        self.records += 1

    def _put(self, member: bytes) -> None:
        self.stream.write(member)
        self.size += len(member)

    def close(self) -> None:
        if self.stream is not None:
            self.stream.close()
            self.stream = None
            self.done.append((self.name, self.size, self.records))


def _members(batch: pa.RecordBatch):
    """``date, make`` of every record of a batch; ``make(info_id)`` is its gzip member."""
    seconds = pc.floor_temporal(batch.column("date"), unit="second").cast(pa.timestamp("s"))
    columns = [pc.strftime(seconds, format=DATE_FORMAT).to_pylist()]
    names = ("warc_type", "record_id", "target_uri", "warcinfo_id", "content_type", "payload")
    for stamp, kind, record, uri, info, content, payload in zip(*columns, *(batch.column(c).to_pylist() for c in names)):

        def make(info_id, stamp=stamp, kind=kind, record=record, uri=uri, info=info, content=content, payload=payload) -> bytes:
            headers = [
                ("WARC-Type", kind),
                ("WARC-Record-ID", record),
                ("WARC-Date", stamp),
                ("WARC-Target-URI", uri),
                ("WARC-Warcinfo-ID", info or info_id),
                ("Content-Type", content),
                ("Content-Length", str(len(payload))),
            ]
            return gzip_member(record, [(k, v) for k, v in headers if v is not None], payload)

        yield stamp, make


@dataclass
class Manifest:
    """What one job added to an archive, and the manifests it replaced."""

    job: str
    files: list[tuple[str, int, int]]
    replaces: list[str]

    def text(self) -> str:
        head = {"job": self.job, "replaces": self.replaces, "files": len(self.files)}
        return "".join(json.dumps(line) + "\n" for line in [head, *self.files, "end"])

    @staticmethod
    def parse(text: str) -> Manifest | None:
        """None for a manifest that was not written to its end."""
        lines = text.split("\n")
        if lines[-2:] != [json.dumps("end"), ""]:
            return None
        head, *files = map(json.loads, lines[:-2])
        return Manifest(head["job"], [tuple(f) for f in files], head["replaces"]) if len(files) == head["files"] else None


def _manifest_name(job: str) -> str:
    readable = re.sub(r"[^A-Za-z0-9.-]+", "_", job)[:40]
    return f"{readable}-{hashlib.md5(job.encode()).hexdigest()[:16]}.json"


def manifests(path: str) -> dict[str, Manifest]:
    """The complete manifests of an archive by name, without those that others replace."""
    from pyarrow import fs

    filesystem, folder = _filesystem(path)
    listing = filesystem.get_file_info(fs.FileSelector(f"{folder}/{MANIFESTS}", allow_not_found=True))
    found: dict[str, Manifest] = {}
    for info in listing:
        with filesystem.open_input_stream(info.path) as stream:
            manifest = Manifest.parse(stream.read().decode())
        if manifest is not None:
            found[info.base_name] = manifest
    gone = {name for m in found.values() for name in m.replaces}
    return {name: m for name, m in found.items() if name not in gone}


def committed_files(path: str) -> list[str]:
    """The archive's files: those that a complete manifest names."""
    return sorted(f"{path.rstrip('/')}/{name}" for m in manifests(path).values() for name, _, _ in m.files)


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, max_bytes: int, overwrite: bool, job: str | None = None):
        self.path, self.max_bytes, self.overwrite = path, max_bytes, overwrite
        #: no other run has this name, whatever its job is called
        self.run = uuid.uuid4().hex[:12]
        self.job = job or self.run
        filesystem, folder = _filesystem(path)
        filesystem.create_dir(folder, recursive=True)
        self.done = job is not None and _manifest_name(job) in manifests(path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        if self.done:
            return FilesWritten([])
        task = TaskContext.get()
        filesystem, folder = _filesystem(self.path)
        stem = f"part-{task.partitionId():05d}-{self.run}-{task.taskAttemptId():x}"
        files = _RotatingFiles(filesystem, folder, stem, self.max_bytes)
        try:
            for batch in iterator:
                for stamp, make in _members(batch):
                    files.add(stamp, make)
        finally:
            files.close()
        return FilesWritten(files.done)

    def _sweep(self, filesystem, folder: str, doomed) -> None:
        from pyarrow import fs

        listing = [f for f in filesystem.get_file_info(fs.FileSelector(folder)) if doomed(f.base_name)]
        with ThreadPoolExecutor(16) as pool:
            list(pool.map(lambda f: filesystem.delete_file(f.path), listing))

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        """Write the manifest, the only moment that counts, and clear away what it does not name."""
        filesystem, folder = _filesystem(self.path)
        earlier = manifests(self.path)
        name = _manifest_name(self.job)
        files = [f for m in messages if m is not None for f in m.files]
        if self.done or (name in earlier and not self.overwrite):  # another run of the job was first
            self._sweep(filesystem, folder, lambda n: self.run in n)
            return
        replaced = [n for n in earlier if n != name] if self.overwrite else []
        filesystem.create_dir(f"{folder}/{MANIFESTS}", recursive=True)
        with filesystem.open_output_stream(f"{folder}/{MANIFESTS}/{name}", compression=None) as stream:
            stream.write(Manifest(self.job, files, replaced).text().encode())
        kept = {f[0] for f in files}
        stale = lambda n: n.endswith(".warc.gz") and n not in kept and (self.overwrite or self.run in n)
        self._sweep(filesystem, folder, stale)
        for other in replaced:
            filesystem.delete_file(f"{folder}/{MANIFESTS}/{other}")
        with filesystem.open_output_stream(f"{folder}/_SUCCESS"):
            pass

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        filesystem, folder = _filesystem(self.path)
        self._sweep(filesystem, folder, lambda n: self.run in n)


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        path = self.options.get("path")
        if not path:
            raise ValueError("the warc format needs a path")
        max_bytes = int(self.options.get("maxBytes", 0)) or DEFAULT_MAX_BYTES
        return WarcWriter(path, max_bytes, overwrite, self.options.get("jobId"))


def register(spark: SparkSession) -> None:
    """Make ``format("warc")`` known to a session."""
    spark.dataSource.register(WarcDataSource)
