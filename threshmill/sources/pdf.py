"""Text and metadata of PDF files, in Arrow batches. Operator P14.

Objects are found by their marks, deflated streams are inflated, and the texts
that content streams show are joined. Fonts with encodings of their own,
encrypted files and other filters give no text; a damaged file gives empty
values and never an error.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STREAM = re.compile(rb"<<((?:[^<>]|<[^<]|>[^>]|<<[^<>]*>>)*)>>\s*stream\r?\n(.*?)\r?\n?endstream", re.S)
SHOWN = re.compile(rb"\[((?:\((?:\\.|[^\\()])*\)|[^\]])*)\]\s*TJ|(\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>)\s*(?:Tj|'|\")|(T\*|(?:Td|TD|ET)\b)", re.S)
LITERAL = re.compile(rb"\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>", re.S)
ESCAPE = re.compile(rb"\\([0-7]{1,3}|\r\n|.)", re.S)
#: Fixed values of the format: letters after a backslash.
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
#: How a version stands in a subject or keywords.
VERSION = re.compile(r"(?:version|edition|rev\.|v\.?)\s*[:#]?\s*([\w.\-/ ]{1,40})", re.I)


def literal(raw: bytes) -> str:
    """The text of a string in brackets."""
    if raw[:1] == b"<":
        digits = re.sub(rb"\s", b"", raw[1:-1])
        data = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    else:
        data = ESCAPE.sub(lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else b"" if m[1] in (b"\n", b"\r", b"\r\n") else ESCAPES.get(m[1], m[1]), raw[1:-1])
    return data[2:].decode("utf-16-be", "replace") if data[:2] == b"\xfe\xff" else data.decode("latin-1")


def text(data: bytes) -> str:
    """What the content streams show, with tidy spaces."""
    out: list[str] = []
    for head, body in STREAM.findall(data):
        if b"/FlateDecode" in head:
            try:
                body = zlib.decompressobj().decompress(body)
            except zlib.error:
                continue
        elif b"/Filter" in head:
            continue
        if not re.search(rb"\bBT\b", body):
            continue
        for array, one, move in SHOWN.findall(body):
            if array:
                out.append("".join(map(literal, LITERAL.findall(array))))
            elif one:
                out.append(literal(one))
            elif move:
                out.append(" ")
    return re.sub(r"\s+", " ", "".join(out)).strip()


def field(data: bytes, name: str) -> str:
    """A text of the document's information."""
    m = re.search(rb"/" + name.encode() + rb"\s*(\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>)", data, re.S)
    return literal(m[1]).strip() if m else ""


def date(data: bytes) -> str:
    """YYYY-MM-DD of D:YYYYMMDD, or a leading year, of the creation, else of the change; else empty."""
    for name in ("CreationDate", "ModDate"):
        raw = field(data, name)
        day = re.match(r"D:(\d{4})(\d{2})(\d{2})", raw)
        if day:
            return "-".join(day.groups())
        year = re.match(r"\d{4}", raw)
        if year:
            return year[0]
    return ""


def version(data: bytes) -> str:
    for name in ("Subject", "Keywords"):
        m = VERSION.search(field(data, name))
        if m:
            return m[1].strip()[:64]
    return ""


def read_pdf(files: DataFrame, key: str, content: str) -> DataFrame:
    """Text, title, publication_date and version of PDF files (bytes); a null file has empty ones."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            data = [bytes(x) if x is not None else b"" for x in batch["__f"]]
            yield pd.DataFrame({key: batch[key], "text": map(text, data), "title": [field(x, "Title")[:200] for x in data], "publication_date": map(date, data), "version": map(version, data)})

    source = files.select(key, F.col(content).alias("__f"))
    return source.mapInPandas(run, f"`{key}` {source.schema[key].dataType.simpleString()}, text string, title string, publication_date string, version string")
