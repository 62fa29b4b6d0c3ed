"""Text as an embedding model should see it: no markup, one form of each character, plain spaces, plain numbers."""

from __future__ import annotations

import html
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspark.functions.slices import in_slices

_HIDDEN = re.compile(r"<(?P<tag>style|script).*?</(?P=tag)>", re.I | re.S)
_TAG = re.compile("<[^>]+>")
_CELL_END, _CELL = re.compile(r"</t[hd]>\s*", re.I), re.compile(r"<t[hd][^>]*>\s*", re.I)
_ROW_END, _ROW = re.compile(r"</tr>\s*", re.I), re.compile(r"<tr[^>]*>\s*", re.I)
_BLANKS, _SPACE, _LINES, _GAP = re.compile("[\t ]+"), re.compile(r"\s+"), re.compile(r"\n\s*\n+"), re.compile("\n{3,}")
_GROUPED = {mark: re.compile(rf"(?P<one>\d){re.escape(mark)}(?P<three>\d\d\d)(?=\Z|[\s,.)\]}}])") for mark in ",."}


def normalize(text: str | None) -> str | None:
    """Markup goes (cells of tables are kept apart), entities and compatibility forms are resolved, separators of thousands removed."""
    if not text:
        return text
    table = "<table" in text.lower()
    text = _HIDDEN.sub("", text)
    if table:
        for pattern, to in ((_CELL_END, "\t"), (_ROW_END, "\n"), (_ROW, ""), (_CELL, "")):
            text = pattern.sub(to, text)
    text = html.unescape(_TAG.sub("", text))
    text = _LINES.sub("\n\n", _BLANKS.sub(" ", text)) if table else _SPACE.sub(" ", text)
    text = unicodedata.normalize("NFKD", text).replace("\r\n", "\n").replace("\r", "\n")
    text = _GAP.sub("\n\n", _BLANKS.sub(" ", text))
    for mark in ",.":
        for _ in range(5):
            text = _GROUPED[mark].sub(r"\g<one>\g<three>", text)
    return text.strip()


@F.arrow_udf(T.StringType())
def normalize_text(text: pa.Array) -> pa.Array:
    return in_slices(normalize, pa.string(), text)


def strip_html(text: Column | str) -> Column:
    """Markup removed with built-in functions only (scripts and styles with what they hold)."""
    return F.regexp_replace(F.regexp_replace(text, r"(?is)<(script|style).*?</\1>", ""), "<[^>]+>", "")


def squeeze(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(text, "[ \t\n\r\f]+", " "))


def join_thousands(text: Column | str) -> Column:
    out = text if isinstance(text, Column) else F.col(text)
    for mark in (",", r"\."):
        for _ in range(5):
            out = F.regexp_replace(out, rf"([0-9]){mark}([0-9]{{3}})(?=[,. \t\n\r\f)\]}}]|$)", "$1$2")
    return out
