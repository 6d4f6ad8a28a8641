"""SQL for what the checking database lacks, spliced into the operators' SQL."""

from __future__ import annotations

#: ``crc_table.crc``: the 256 remainders of the reversed polynomial 0xEDB88320, by their rule.
CRC_TABLE = """
    crc_table as (
        select list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
            lambda c, k: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end)) as crc
    )
"""


def crc32(text: str) -> str:
    """Unsigned crc32 of a text's UTF-8 bytes; the query must have ``crc_table`` among its tables."""
    byte = f"('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::bigint"
    bytes_of = f"list_transform(range(strlen({text})), lambda i: {byte})"
    step = "lambda c, b: xor(c // 256, crc[(xor(c, b) % 256 + 1)::bigint])"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {bytes_of}), {step}), 4294967295)"
