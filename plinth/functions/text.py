"""Text normalisation and tokens as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accented Latin letters and the letters they fold to.
ACCENTED = "áàâäãåéèêëíìîïóòôöõúùûüñçýÿ"
FOLDED = "aaaaaaeeeeiiiiooooouuuuncyy"
#: Byte by byte of Latin-1, which has all accented letters: what normalized() makes of a character.
_BYTES = bytes(ord(c) if c in "0123456789abcdefghijklmnopqrstuvwxyz" else 32 for c in map(chr, range(256)))
_BYTES = bytes(ord(FOLDED[ACCENTED.index(chr(i))]) if chr(i) in ACCENTED else b for i, b in enumerate(_BYTES))


def normalized(text: Column) -> Column:
    """Lower case, accents folded, anything but ASCII letters and digits as single spaces."""
    return F.trim(F.regexp_replace(F.translate(F.lower(text), ACCENTED, FOLDED), "[^0-9a-z]+", " "))


def terms(text: Column) -> Column:
    """The normalised words, none for a null or empty text."""
    return F.filter(F.split(F.coalesce(normalized(text), F.lit("")), " "), lambda t: t != "")


def words(text: bytes) -> list[bytes]:
    """terms() of a UTF-8 text, in Python."""
    return text.decode("utf-8", "replace").lower().encode("latin-1", "replace").translate(_BYTES).split()


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def stem(path: Column) -> Column:
    """A path's last part without its last extension."""
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def extension(path: Column) -> Column:
    """The last extension in lower case with its dot, else an empty string."""
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))
