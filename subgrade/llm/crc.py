"""CRC-32 of an ASCII expression in DuckDB's SQL, which has no function of that name; Spark has F.crc32."""

#: The reversed CRC-32 polynomial, a fixed value of the standard.
POLYNOMIAL = 0xEDB88320


def crc32_sql(text: str) -> str:
    """SQL for the unsigned CRC-32 of the ASCII string expression `text`."""
    step = f"lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, {POLYNOMIAL}) ELSE x >> 1 END)"
    codes = f"list_transform(range(length({text})), lambda i: ascii(substr({text}, i::BIGINT + 1, 1))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), {step}), 4294967295::BIGINT)"
