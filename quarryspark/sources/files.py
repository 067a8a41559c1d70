"""File scans and file sinks."""

from __future__ import annotations

import contextlib
import hashlib
import os
import shutil
import stat

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryspark.operators.schemas import EngineError


def scan(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, content, seq of whole files; seq is their place in ``paths``."""
    order = F.create_map(*[F.lit(x) for i, p in enumerate(paths) for x in (os.path.abspath(p), i)])
    files = spark.read.format("binaryFile").load(paths).select(F.url_decode(F.regexp_replace("path", "^file:(//)?", "")).alias("path"), "content")
    return files.withColumn("seq", F.element_at(order, F.col("path")).cast("long"))


def file_sha256(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def write_atomic(path: str, data: bytes) -> None:
    """Sibling file, then rename; nothing is left behind on failure."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    tmp = f"{path}.tmp"
    try:
        with open(tmp, "wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        os.replace(tmp, path)
    finally:
        with contextlib.suppress(FileNotFoundError):
            os.remove(tmp)


def retain(path: str, sha256: str, target: str) -> bool:
    """Copy a source to its place, read-only; an equal copy is kept, a missing one made again, a different one refused."""
    if file_sha256(path) != sha256:
        raise EngineError("state_error", "source bytes do not match their recorded hash")
    if os.path.exists(target):
        if file_sha256(target) != sha256:
            raise EngineError("state_error", "a retained copy has other bytes")
        return False
    os.makedirs(os.path.dirname(target), exist_ok=True)
    tmp = f"{target}.tmp"
    try:
        shutil.copyfile(path, tmp)
        if file_sha256(tmp) != sha256:
            raise EngineError("filesystem_error", "copy verification failed")
        os.replace(tmp, target)
    finally:
        with contextlib.suppress(FileNotFoundError):
            os.remove(tmp)
    os.chmod(target, stat.S_IREAD | stat.S_IRGRP | stat.S_IROTH)
    return True


def is_within(root: str, path: str) -> bool:
    """Containment after links are resolved."""
    root, path = os.path.realpath(root), os.path.realpath(path)
    return path == root or path.startswith(root.rstrip("/") + "/")
