"""Pieces of DuckDB SQL that oracle queries share."""

from __future__ import annotations

#: the polynomial of CRC-32, reflected
_POLYNOMIAL = 0xEDB88320


def crc32_of(integer: str) -> str:
    """The unsigned CRC-32 of an integer's decimal digits, bit by bit; null for null."""
    bit = f"CASE WHEN c & 1 = 1 THEN xor(c >> 1, {_POLYNOMIAL}) ELSE c >> 1 END"
    byte = f"list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda c, _: {bit}, xor(acc, d::BIGINT))"
    digits = f"list_transform(string_split(({integer})::VARCHAR, ''), lambda x: ascii(x)::BIGINT)"
    return f"xor(list_reduce({digits}, lambda acc, d: {byte}, 4294967295::BIGINT), 4294967295::BIGINT)"
