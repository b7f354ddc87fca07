"""Members of zip containers: archives, books, office files.

Where tasks can open files by range, a container's directory becomes rows, and
these are dealt out by stretches of the file, so that a large container is read
by many tasks, each member once and by its own bytes. Where only Spark's readers
reach the store, a container is one row of bytes.
"""

from __future__ import annotations

import bz2
import io
import posixpath
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import batches, rows_of

ARCHIVE_CAP, MEMBER_CAP, OFFICE_CAP, MEMBERS = 80 << 20, 4 << 20, 25 << 20, 400
STRETCH = 16 << 20  # bytes of a container that one task reads in a row
#: Extensions of archive members that are text.
TEXT_EXTS = (
    "txt", "log", "csv", "md", "rtf", "html", "htm", "xml", "json", "jsonl", "yml", "yaml", "ini", "cfg", "conf", "tsv", "py", "js", "ts", "css", "sql", "bat", "ps1", "sh", "tex", "bib",
)


@dataclass(frozen=True)
class Rule:
    """Which members of a kind of container are read: names by a pattern, at most `most`, none above `cap` bytes, of containers up to `container_cap` bytes; None for no limit."""

    pattern: str
    most: int | None = None
    cap: int | None = None
    container_cap: int | None = ARCHIVE_CAP


#: Members by the container's extension; a copy with other limits, or more kinds, may be given to the readers.
RULES = {
    "zip": Rule(rf"\.(?:{'|'.join(TEXT_EXTS)})$", MEMBERS, MEMBER_CAP),
    "epub": Rule(r"\.(?:opf|ncx|xhtml|html|htm)$", None, MEMBER_CAP),
    "docx": Rule(r"^word/(?:document\.xml|_rels/document\.xml\.rels)$", None, OFFICE_CAP),
    "odt": Rule(r"^content\.xml$", None, OFFICE_CAP),
    "xlsx": Rule(r"^xl/(?:workbook\.xml|sharedStrings\.xml|worksheets/sheet[^/]*)$", None, OFFICE_CAP),
}
MEMBER = "path string, kind string, member string, pos int, raw binary"
ENTRY = "path string, kind string, member string, pos int, offset long, packed long, size long, method int, crc long"


def unlimited(rules: dict[str, Rule]) -> dict[str, Rule]:
    """The rules without any limit of number or size."""
    return {kind: replace(rule, most=None, cap=None, container_cap=None) for kind, rule in rules.items()}


def kind_of_path(path: str) -> str:
    return posixpath.splitext(path)[1][1:].lower()


def _wanted(archive: zipfile.ZipFile, rule: Rule) -> Iterator[tuple[int, str, zipfile.ZipInfo]]:
    """Number, name and entry of the members that a rule wants, in the order of the directory."""
    taken = 0
    for info in archive.infolist():
        name = info.filename.replace("\\", "/")
        base = posixpath.basename(name)
        if info.is_dir() or not base or base.startswith(".") or rule.cap is not None and info.file_size > rule.cap or not re.search(rule.pattern, name, re.I):
            continue
        taken += 1
        if rule.most is not None and taken > rule.most:
            return
        yield taken, name, info


MEMBER_SCHEMA = pa.schema({"path": pa.string(), "kind": pa.string(), "member": pa.string(), "pos": pa.int32(), "raw": pa.binary()})
BAD = (zipfile.BadZipFile, RuntimeError, NotImplementedError, OSError, ValueError, zlib.error, struct.error, EOFError)


def _unpack(rules: dict[str, Rule]):
    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for path, content in rows_of(parts):
            kind = kind_of_path(path)
            try:
                archive = zipfile.ZipFile(io.BytesIO(content))
            except BAD:
                continue
            for pos, name, info in _wanted(archive, rules[kind]):
                try:
                    yield path, kind, name, pos, archive.read(info)
                except BAD:
                    continue

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches(rows(parts), MEMBER_SCHEMA)

    return run


def _held(files: DataFrame, rules: dict[str, Rule], size) -> DataFrame:
    """Files of the kinds of the rules, up to their size."""
    ext = F.lower(F.regexp_extract("path", r"\.([^./\\]*)$", 1))
    keep = F.lit(False)
    for kind, rule in rules.items():
        keep = keep | (ext == kind) & (F.lit(True) if rule.container_cap is None else size <= rule.container_cap)
    return files.where(keep & (size > 0))


def members_of(files: DataFrame, rules: dict[str, Rule] | None = None) -> DataFrame:
    """path, kind, member, pos, raw of containers (path, content), a container in a row. What is no container has no members; members that cannot be unpacked are left out."""
    rules = RULES if rules is None else rules
    return _held(files, rules, F.length("content")).select("path", "content").mapInArrow(_unpack(rules), MEMBER)


def _opened(path: str):
    """A file to be read by range: a local path, or a store that Arrow knows."""
    if re.match(r"file:|/", path):
        return open("/" + re.sub(r"^file:", "", path).lstrip("/"), "rb")
    import pyarrow.fs

    store, at = pyarrow.fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
    return store.open_input_file(at)


def by_range(paths: list[str]) -> bool:
    """Whether tasks can open files of these roots by range, by their schemes."""
    return all(re.match(r"(file:|/|s3a?://|gs://|gcs://|abfss?://)", p) for p in paths)


def _listed(rules: dict[str, Rule]):
    schema = pa.schema({"path": pa.string(), "kind": pa.string(), "member": pa.string(), "pos": pa.int32(), "offset": pa.int64(), "packed": pa.int64(), "size": pa.int64(), "method": pa.int32(), "crc": pa.int64()})

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for path in batch.column(0).to_pylist():
                kind = kind_of_path(path)
                try:
                    with _opened(path) as file, zipfile.ZipFile(file) as archive:
                        found = [(path, kind, name, pos, x.header_offset, x.compress_size, x.file_size, x.compress_type, x.CRC) for pos, name, x in _wanted(archive, rules[kind]) if not x.flag_bits & 1]
                except BAD:
                    continue
                for k in range(0, len(found), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found[k : k + 10_000], strict=True), schema, strict=True)], schema=schema)

    return run


def directory(spark: SparkSession, paths: list[str], rules: dict[str, Rule] | None = None) -> DataFrame:
    """path, kind, member, pos, offset, packed, size, method, crc of the wanted members of all containers below the roots; of a container its directory is read and no more."""
    rules = RULES if rules is None else rules
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths).select("path", "length")
    return _held(files, rules, F.col("length")).select("path").mapInArrow(_listed(rules), ENTRY)


def unpacked(data: bytes, method: int) -> bytes | None:
    """A member's bytes as they were before packing; None for a method that has no plain form."""
    if method == zipfile.ZIP_STORED:
        return data
    if method == zipfile.ZIP_DEFLATED:
        return zlib.decompress(data, -15)
    return bz2.decompress(data) if method == zipfile.ZIP_BZIP2 else None


def _read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        at, file = None, None
        try:
            for batch in parts:
                for path, kind, member, pos, offset, packed, _, method, crc in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if path != at:
                        if file is not None:
                            file.close()
                        at, file = path, _opened(path)
                    try:
                        file.seek(offset)
                        head = file.read(30)
                        name, extra = struct.unpack("<2H", head[26:30])
                        file.seek(offset + 30 + name + extra)
                        raw = unpacked(file.read(packed), method)
                        if raw is None:
                            with zipfile.ZipFile(file) as archive:
                                raw = archive.read(next(x for x in archive.infolist() if x.header_offset == offset))
                            at = None
                        if zlib.crc32(raw) != crc:
                            continue
                    except BAD:
                        continue
                    yield path, kind, member, pos, raw
        finally:
            if file is not None:
                file.close()

    yield from batches(rows(), MEMBER_SCHEMA)


def read_members(spark: SparkSession, paths: list[str], rules: dict[str, Rule] | None = None, stretch: int = STRETCH) -> DataFrame:
    """path, kind, member, pos, raw of the wanted members of all containers below the roots. A container's stretches of `stretch` bytes are tasks' work of their own where files can be opened by range; a member is one row, so it must fit in memory."""
    rules = RULES if rules is None else rules
    if not by_range(paths):
        return members_of(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths), rules)
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = directory(spark, paths, rules).repartition(width, "path", F.floor(F.col("offset") / stretch)).sortWithinPartitions("path", "offset")
    return dealt.mapInArrow(_read, MEMBER)
