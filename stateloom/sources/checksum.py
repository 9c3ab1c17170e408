"""CRC32C, the checksum of manifests."""

from __future__ import annotations

from functools import lru_cache

#: The polynomial, bits reversed; a fixed value.
_POLYNOMIAL = 0x82F63B78


@lru_cache(maxsize=1)
def _table() -> list[int]:
    out = []
    for value in range(256):
        for _ in range(8):
            value = value >> 1 ^ (_POLYNOMIAL if value & 1 else 0)
        out.append(value)
    return out


def crc32c(data: bytes) -> int:
    table, crc = _table(), 0xFFFFFFFF
    for byte in data:
        crc = crc >> 8 ^ table[(crc ^ byte) & 0xFF]
    return crc ^ 0xFFFFFFFF
