"""A splittable FASTQ source on Spark's Python data source API.

Files are addressed through ``pyarrow.fs``, so the same paths work on local disks and
on the object stores and HDFS that Arrow supports. Spark schedules the byte ranges.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RANGE_BYTES = 64 * 1024 * 1024
#: Compressed files are read whole, by suffix.
CODECS = {".gz": "gzip", ".bz2": "bz2", ".zst": "zstd"}


class _Range(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        super().__init__((path, start, end))
        self.path, self.start, self.end = path, start, end


def parse_records(lines: Iterator[str]) -> Iterator[tuple[str, str, str, str]]:
    """Records of a wrapped or four-line FASTQ; malformed input raises."""
    header, sequence, quality, state = "", "", "", "header"
    for raw in lines:
        line = raw.rstrip("\r\n")
        if state == "header":
            if not line.strip():
                continue
            if not line.startswith("@"):
                raise ValueError(f"A FASTQ record has to start with '@', found {line[:20]!r}.")
            header, sequence, quality, state = line[1:].strip(), "", "", "sequence"
        elif state == "sequence":
            if line.startswith("+"):
                if not sequence:
                    raise ValueError(f"No bases in FASTQ record {header!r}.")
                state = "quality"
            else:
                sequence += "".join(line.split())
        else:
            quality += line
            if len(quality) > len(sequence):
                raise ValueError(f"More qualities than bases in FASTQ record {header!r}.")
            if len(quality) == len(sequence):
                name, _, description = header.partition(" ")
                yield name, description, sequence, quality
                state = "header"
    if state == "sequence":
        raise ValueError(f"FASTQ record {header!r} has no '+' line.")
    if state == "quality":
        raise ValueError(f"FASTQ record {header!r} has fewer qualities than bases.")


def record_start(handle, start: int) -> int:
    """Offset of the first four-line record at or after ``start``.

    A line opening with ``@`` is a header only if the line two below opens with ``+`` and
    the lines between and after have one length; a quality line fails that test.
    """
    if start == 0:
        return 0
    handle.seek(start - 1)
    handle.readline()
    window: list[tuple[int, bytes]] = []
    while True:
        offset = handle.tell()
        line = handle.readline()
        if not line:
            return offset
        window.append((offset, line.rstrip(b"\r\n")))
        if len(window) < 4:
            continue
        (at, head), (_, seq), (_, plus), (_, qual) = window[-4:]
        if head.startswith(b"@") and plus.startswith(b"+") and len(seq) == len(qual) and not seq.startswith(b"@"):
            return at


class FastqReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.layout = options.get("layout", "four-line")
        self.range_bytes = int(options.get("rangebytes", options.get("rangeBytes", RANGE_BYTES)))

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        info = system.get_file_info(root)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        if info.type == fs.FileType.Directory:
            files = [f for f in system.get_file_info(fs.FileSelector(root, recursive=True)) if f.type == fs.FileType.File]
        else:
            files = [info]
        prefix = self.path.split("://")[0] + "://" if "://" in self.path else ""
        out: list[InputPartition] = []
        for f in sorted(files, key=lambda f: f.path):
            whole = f.path.endswith(tuple(CODECS)) or self.layout == "wrapped"
            step = max(f.size, 1) if whole else self.range_bytes
            out += [_Range(prefix + f.path, at, min(at + step, f.size)) for at in range(0, max(f.size, 1), step)]
        return out

    def read(self, partition: _Range):
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(partition.path) if "://" in partition.path else (fs.LocalFileSystem(), partition.path)
        codec = next((c for suffix, c in CODECS.items() if path.endswith(suffix)), None)
        if codec:
            with system.open_input_stream(path, compression=codec) as stream, io.TextIOWrapper(stream, "ascii") as lines:
                yield from parse_records(iter(lines))
            return
        with system.open_input_file(path) as handle:
            buffered = io.BufferedReader(handle, 1 << 20)
            at = record_start(buffered, partition.start)
            if at >= partition.end:
                return
            buffered.seek(at)
            # a range owns the records that begin inside it
            if self.layout == "wrapped":
                yield from parse_records(line.decode("ascii") for line in buffered)
                return

            def owned() -> Iterator[str]:
                offset = at
                while offset < partition.end:
                    lines = [buffered.readline() for _ in range(4)]
                    if not lines[0]:
                        return
                    offset += sum(map(len, lines))
                    yield from (x.decode("ascii") for x in lines if x)

            yield from parse_records(owned())


class FastqDataSource(DataSource):
    """``spark.read.format("fastq_reads").load(path)``."""

    @classmethod
    def name(cls) -> str:
        return "fastq_reads"

    def schema(self) -> str:
        return "id string, description string, sequence string, quality string"

    def reader(self, schema) -> FastqReader:
        return FastqReader(self.options)
