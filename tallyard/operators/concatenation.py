"""Real small files into fewer ones by joining their bytes: newline-delimited text, or complete zstandard frames.

Nothing is parsed or decompressed. Text files get the line break they lack at their end and
lose a byte-order mark; of zstandard files the headers of frames and blocks are walked to see
that every frame is complete, and joined frames are a valid file again. Files are dealt to
containers by running size in the order of their paths. A container is written under
another name and then renamed, so that a repeated task leaves no half of one; its length
and checksum are compared with the sum of its parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyard.durable import materialise
from tallyard.operators.ordering import numbered

_BOM = b"\xef\xbb\xbf"
#: Fixed values of the zstandard format: the magic number of a frame, and the least of the sixteen of skippable ones.
FRAME, SKIPPABLE = 0xFD2FB528, 0x184D2A50
CHUNK = 4 << 20


def frames_end(data: bytes) -> int:
    """Where the last complete frame of ``data`` ends; its length where all are complete."""
    at, n = 0, len(data)
    while at + 4 <= n:
        magic, start = int.from_bytes(data[at : at + 4], "little"), at
        at += 4
        if SKIPPABLE <= magic < SKIPPABLE + 16:
            if at + 4 > n:
                return start
            at += 4 + int.from_bytes(data[at : at + 4], "little")
        elif magic == FRAME and at < n:
            head = data[at]
            single, dictionary = head >> 5 & 1, (0, 1, 2, 4)[head & 3]
            size = (single, 2, 4, 8)[head >> 6]
            at += 1 + (1 - single) + dictionary + size
            last = 0
            while not last:
                if at + 3 > n:
                    return start
                block = int.from_bytes(data[at : at + 3], "little")
                last, kind = block & 1, block >> 1 & 3
                at += 3 + (1 if kind == 1 else block >> 3)
            at += 4 * (head >> 2 & 1)
        else:
            return start
        if at > n:
            return start
    return at


def concatenate(spark: SparkSession, source: str, target: str, kind: str = "lines", target_bytes: int = 128 << 20, pattern: str = "*") -> DataFrame:
    """Join the files below ``source`` into containers below ``target``; returns (path, container, first_byte, n_bytes) of every file.

    ``kind``: 'lines' or 'zstd'. Empty files have no bytes and no row. Raises
    where a zstandard file ends inside a frame, or a container differs from its parts. Both
    folders are addresses that all executors see.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(source).select("path", "length")
    ranked = numbered(files, ["path"], "upto", weight="length")
    groups = ranked.select("path", F.floor(F.greatest(F.col("upto") - F.col("length"), F.lit(0)) / target_bytes).alias("grp"))

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from uuid import uuid4

        from pyarrow import fs

        sink, root = fs.FileSystem.from_uri(target)
        sink.create_dir(root, recursive=True)
        current, out, rows, at, total = None, None, [], 0, 0
        temporary = ""

        def close() -> Iterator[pd.DataFrame]:
            nonlocal rows
            if out is not None:
                out.close()
                name = f"{root}/part-{current:06d}"
                sink.move(temporary, name)
                with sink.open_input_stream(name, compression=None) as back:
                    seen = size = 0
                    while piece := back.read(CHUNK):
                        seen, size = crc32(piece, seen), size + len(piece)
                if (seen, size) != (total, at):
                    raise ValueError(f"container {name} differs from its parts")
            if rows:
                yield pd.DataFrame(rows, columns=["path", "container", "first_byte", "n_bytes"])
                rows = []

        for pdf in batches:
            for path, grp in zip(pdf["path"], pdf["grp"]):
                if grp != current:
                    yield from close()
                    current, at, total, temporary = grp, 0, 0, f"{root}/.{uuid4().hex}"
                    out = sink.open_output_stream(temporary, compression=None)
                origin, inner = fs.FileSystem.from_uri(path)
                with origin.open_input_stream(inner, compression=None) as h:
                    data = h.read()
                if kind == "zstd" and frames_end(data) != len(data):
                    raise ValueError(f"{path} ends inside a frame")
                if kind == "lines":
                    data = data.removeprefix(_BOM)
                    data += b"" if not data or data.endswith(b"\n") else b"\n"
                out.write(data)
                rows.append((path, f"part-{grp:06d}", at, len(data)))
                at, total = at + len(data), crc32(data, total)
        yield from close()

    ordered = groups.repartition("grp").sortWithinPartitions("grp", "path")
    return materialise(ordered.mapInPandas(join, "path string, container string, first_byte bigint, n_bytes bigint"), "joined")
