"""SQL that several oracles share: the unsigned CRC-32 of a string, byte by byte with the table of its polynomial."""

CRC_TABLE = (
    "crc AS (SELECT list_transform(range(256), lambda n: list_reduce([n::UBIGINT, 0, 0, 0, 0, 0, 0, 0, 0], "
    "lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END)) AS t)"
)
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: The UTF-8 bytes of a string of code points below 2048.
_BYTES = "flatten(list_transform(string_split({}, ''), lambda y: CASE WHEN ord(y) < 128 THEN [ord(y)::UBIGINT] ELSE [(192 + (ord(y) >> 6))::UBIGINT, (128 + (ord(y) & 63))::UBIGINT] END))"


def crc32(text: str) -> str:
    """Where crc (CRC_TABLE) is among the tables."""
    return f"xor(list_reduce(list_concat([4294967295::UBIGINT], {_BYTES.format(text)}), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255)::INT + 1])), 4294967295::UBIGINT)"
