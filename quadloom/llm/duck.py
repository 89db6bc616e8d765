"""What the operators' DuckDB equivalents share."""

from __future__ import annotations

import re

#: CTE `tab`: the table of the CRC-32 polynomial.
CRC_TABLE = "tab AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc)"


def crc32(text: str) -> str:
    """The unsigned CRC-32 of a text's UTF-8 bytes, where `tab` is joined."""
    bytes_ = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: CAST('0x' || h AS BIGINT))"
    return f"CAST(xor(4294967295, list_reduce(list_prepend(4294967295, {bytes_}), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1]))) AS BIGINT)"


def on(sql: str, table: str, relation: str) -> str:
    """A query over another relation than its table."""
    return re.sub(rf"\b{table}\b", relation, sql)
