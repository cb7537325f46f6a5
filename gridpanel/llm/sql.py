"""Pieces of oracle SQL that DuckDB lacks as functions."""

from __future__ import annotations

LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

# one row: the table of the reflected CRC-32 (polynomial 0xEDB88320)
CRC_TABLE = """crc_table AS MATERIALIZED (
  SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], [0, 0, 0, 0, 0, 0, 0, 0]),
    lambda c, z: xor(c >> 1, 3988292384 * (c & 1)))) AS t)"""


def crc(codes: str) -> str:
    """Unsigned crc32 of a list of byte values, where ``t`` of ``crc_table`` is in scope."""
    step = "xor(c >> 8, t[(xor(c, b) & 255) + 1])"
    return f"xor(list_reduce(list_concat([4294967295], {codes}), lambda c, b: {step}), 4294967295)"


def ascii_codes(text: str) -> str:
    return f"list_transform(string_split({text}, ''), lambda x: CAST(ascii(x) AS BIGINT))"
