"""Prefixed ULIDs: 48 bits of milliseconds and 80 of chance, or of a hash where a run must repeat itself."""

from __future__ import annotations

import hashlib
import secrets
import time

from pyspark.sql import Column
from pyspark.sql import functions as F

ALPHABET = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def encode(ms: int, tail: int) -> str:
    n = (ms & (1 << 48) - 1) << 80 | tail & (1 << 80) - 1
    return "".join(ALPHABET[n >> 5 * (25 - i) & 31] for i in range(26))


def new(prefix: str) -> str:
    return prefix + encode(time.time_ns() // 1_000_000, secrets.randbits(80))


def derived(prefix: str, key: Column, seed: str = "") -> Column:
    """An id of the same shape from a key's SHA-256, so that a retried task makes the same one."""
    bits = F.sha2(F.concat(F.lit(f"{seed}:{prefix}:"), key), 256)
    digit = lambda i: F.substring(F.lit(ALPHABET), (F.conv(F.substring(bits, i + 1, 2), 16, 10).cast("int") % (8 if i == 0 else 32)) + 1, F.lit(1))
    return F.concat(F.lit(prefix), *(digit(i) for i in range(26)))


def derived_py(prefix: str, key: str, seed: str = "") -> str:
    bits = hashlib.sha256(f"{seed}:{prefix}:{key}".encode()).hexdigest()
    return prefix + "".join(ALPHABET[int(bits[i : i + 2], 16) % (8 if i == 0 else 32)] for i in range(26))
