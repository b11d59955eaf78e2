"""How many partitions a folder of compressed files deserves, from its bytes.

A gzip file cannot be split, so a table that comes as a few large ones would be read by a few tasks, and everything up to the
first exchange would stay with them. The number of partitions follows the uncompressed size: the files' bytes times a ratio
measured on the first stretch of the largest file.
"""

from __future__ import annotations

import math
import zlib

from pyspark.sql import SparkSession

PARTITION_BYTES = 128 << 20
SAMPLED_BYTES = 1 << 20


def _gzip_files(spark: SparkSession, path: str):
    """The file system, and (size, path) of every gzip file at or below the path."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found, listed = [], files.listFiles(root, True)
    while listed.hasNext():
        status = listed.next()
        if status.getPath().getName().endswith(".gz"):
            found.append((status.getLen(), status.getPath()))
    return files, found


def expansion(start: bytes) -> float:
    """Bytes a gzip stream unpacks to, for each byte of its first stretch."""
    unpacked, left = zlib.decompressobj(wbits=31), len(start)
    grown = len(unpacked.decompress(start))
    left = len(unpacked.unused_data)  # a small file may end inside the stretch
    return grown / max(len(start) - left, 1)


def partitions_of(spark: SparkSession, path: str, partition_bytes: int = PARTITION_BYTES) -> int | None:
    """Partitions to deal the rows to; None where the files as they are give enough."""
    files, found = _gzip_files(spark, path)
    if not found:
        return None
    stream = files.open(max(found, key=lambda f: f[0])[1])
    try:
        ratio = expansion(bytes(stream.readNBytes(SAMPLED_BYTES)))
    finally:
        stream.close()
    wanted = math.ceil(sum(size for size, _ in found) * ratio / partition_bytes)
    return wanted if wanted > len(found) else None
