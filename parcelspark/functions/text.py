"""Text column expressions (X1-X5, X12, X14). All built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import PREVIEW_CHARS

# Fixed value: the characters Python's str.split()/re \s treat as whitespace.
# Spelled out because Java's and RE2's \s classes each miss some of them; the
# same class works in both engines.
WS_CLASS = (r"[\t\n\x{0B}\f\r \x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
            r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")
_WS = WS_CLASS + "+"
#: The same characters one by one.
WS_CHARS = "\t\n\x0b\f\r \x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def normalise_ws(text: Column) -> Column:
    """Collapse whitespace runs (Unicode-aware) to one space and strip."""
    return F.trim(F.regexp_replace(text, _WS, " "))


def strip_ws(text: Column) -> Column:
    """Strip leading/trailing whitespace of any kind (Python ``str.strip``)."""
    return F.regexp_replace(text, f"^{_WS}|{_WS}$", "")


def trim_ws(text: Column) -> Column:
    """``strip_ws`` without a pattern: looks at both ends only."""
    return F.btrim(text, F.lit(WS_CHARS))


def casefold(text: Column) -> Column:
    """Lower case plus the one common full case fold (sharp s)."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def char_length(text: Column) -> Column:
    """Length in code points."""
    return F.char_length(text)


def basename(path: Column) -> Column:
    """Last path component."""
    return F.element_at(F.split(path, "/"), -1)


def file_stem(path: Column) -> Column:
    """Basename without its last suffix (a leading dot is not a suffix)."""
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def pdf_chunk_id(source: Column, page: Column, chunk: Column) -> Column:
    """``{stem}-p{page}-c{chunk}``."""
    return F.concat(file_stem(source), F.lit("-p"), page.cast("string"),
                    F.lit("-c"), chunk.cast("string"))


def markdown_chunk_id(rel_path: Column, chunk: Column) -> Column:
    """Relative path without ``.md``, ``/`` -> ``__``, then ``-c{chunk}``."""
    base = F.replace(F.regexp_replace(rel_path, r"\.md$", ""), F.lit("/"), F.lit("__"))
    return F.concat(base, F.lit("-c"), chunk.cast("string"))


def preview(text: Column, n: int = PREVIEW_CHARS) -> Column:
    """First n characters, newlines as spaces."""
    return F.translate(F.substring(text, 1, n), "\n", " ")
