"""Key hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The second letters of the pairs, by the byte's place in the alphabet.
LETTERS = "abcdefghijklmnopqrstuvwxyz"
SECOND = "acegikmoqs"


def url_key(text: str | Column) -> Column:
    """SHA-1 of the UTF-8 text in hex: the key of a URL or text."""
    return F.sha1((F.col(text) if isinstance(text, str) else text).cast("binary"))


def letter_key(text: str | Column) -> Column:
    """SHA-1 as 40 lower-case letters, a pair per byte: place i gives LETTERS[i % 26] and SECOND[i / 26].

    The place of byte 0 is 255, of bytes from 128 one less than the byte, so 127 and 128 share a pair.
    """
    digest = url_key(text)

    def pair(i: Column) -> Column:
        byte = F.conv(F.substring(digest, 2 * i + 1, F.lit(2)), 16, 10).cast("int")
        place = F.when(byte == 0, 255).when(byte > 127, byte - 1).otherwise(byte)
        return F.concat(F.substring(F.lit(LETTERS), place % 26 + 1, F.lit(1)), F.substring(F.lit(SECOND), F.floor(place / 26).cast("int") + 1, F.lit(1)))

    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(19)), pair), "")


def base64_text(text: str | Column) -> Column:
    """Base64 of the UTF-8 text in one line: Spark breaks it after 76 characters."""
    return F.translate(F.base64((F.col(text) if isinstance(text, str) else text).cast("binary")), "\r\n", "")
