"""Column expressions (E1-E7).  All are built-in functions, so they stay
inside whole-stage codegen; none is a Python UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def location_key(datacenter: str | Column, sep: str = "-") -> Column:
    """First token of ``datacenter``; null unless it has exactly two parts."""
    dc = _c(datacenter)
    n_parts = F.size(F.split(dc, _regex_literal(sep)))
    return F.when(n_parts == 2, F.split_part(dc, F.lit(sep), F.lit(1)))


def name_suffix(name: str | Column, marker: str = "-node-") -> Column:
    """The part after the first ``marker``, up to the next one; null when
    ``marker`` is absent (the reference raises there)."""
    n = _c(name)
    return F.when(F.instr(n, marker) > 0, F.split_part(n, F.lit(marker), F.lit(2)))


def label_int(labels: str | Column, key: str, strict: bool = False) -> Column:
    """Integer read of a string label.  Strict casts raise on bad text
    (ANSI), lenient ones give null.  Surrounding blanks are accepted, as
    Python's ``int`` does."""
    value = F.element_at(_c(labels), F.lit(key)) if strict else F.try_element_at(_c(labels), F.lit(key))
    return value.cast("int") if strict else value.try_cast("int")


def zero_pad(value: str | Column, width: int) -> Column:
    """``f"{i:0{width}d}"``.  ``format_string`` widens instead of
    truncating, like Python (``lpad`` would cut)."""
    return F.format_string(f"%0{width}d", _c(value))


def node_name(prefix: str | Column, suffix: str | Column) -> Column:
    """``{prefix}-node-{suffix}``."""
    return F.concat(_c(prefix), F.lit("-node-"), _c(suffix))


def dashboard_url(ip: str | Column, port: str | Column) -> Column:
    """``http://{ip}:{port}/``."""
    return F.format_string("http://%s:%d/", _c(ip), _c(port))


def normalize_path(path: str | Column) -> Column:
    """E5: double backslashes, then single ones, become ``/``."""
    return F.replace(F.replace(_c(path), F.lit("\\\\"), F.lit("/")), F.lit("\\"), F.lit("/"))


def path_kind(path: str | Column) -> Column:
    """``local`` without a colon, ``remote`` with one, ``invalid`` with more."""
    n = F.size(F.split(_c(path), ":"))
    return F.when(n == 1, "local").when(n == 2, "remote").otherwise("invalid")


def path_host(path: str | Column) -> Column:
    """Host part of ``host:path``; null for local or invalid paths."""
    return F.when(path_kind(path) == "remote", F.split_part(_c(path), F.lit(":"), F.lit(1)))


def path_rest(path: str | Column) -> Column:
    """Path part; the whole path when local, null when invalid."""
    kind = path_kind(path)
    return (F.when(kind == "local", _c(path))
            .when(kind == "remote", F.split_part(_c(path), F.lit(":"), F.lit(2))))


def decode_safe(data: str | Column) -> Column:
    """Bytes to text.  Null becomes ``''``; valid UTF-8 is decoded; any
    other bytes become ``0x`` + hex (the reference prints Python's repr)."""
    b = _c(data)
    as_text = b.cast("string")
    return (F.when(b.isNull(), F.lit(""))
            .when(F.is_valid_utf8(as_text), as_text)
            .otherwise(F.concat(F.lit("0x"), F.hex(b))))


def _regex_literal(text: str) -> str:
    """Quote ``text`` for Java regex functions such as ``split``."""
    return "\\Q" + text + "\\E"
