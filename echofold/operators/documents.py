"""Markdown documents as rows: headings' paths with paragraphs, list items, formulas and table rows."""

from __future__ import annotations

import hashlib
import re
import struct
import unicodedata
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def normalised(text: str) -> str:
    """NFC, with white space collapsed."""
    return " ".join(unicodedata.normalize("NFC", text).split())


def canonical(headings: list[str], kind: str, parts: list[str]) -> bytes:
    """All parts, each behind its length, so no two units share a payload."""
    return b"".join(struct.pack("<I", len(b)) + b for b in (x.encode() for x in (*headings, kind, *parts)))


def units(text: str | None) -> Iterator[tuple[str, str, str, str]]:
    """(heading path, kind, text, id) in document order; the id is 16 hex digits of a SHA-256 of the whole unit."""
    headings: list[tuple[int, str]] = []
    lines = (text or "").splitlines()
    i = 0

    def unit(kind: str, parts: list[str]):
        path = [h for _, h in headings]
        parts = [normalised(p) for p in parts]
        return " > ".join(path), kind, " | ".join(parts), hashlib.sha256(canonical(path, kind, parts)).hexdigest()[:16]

    starts = re.compile(r"\s*(?:#{1,6}\s|[-*+]\s|\d+[.)]\s|\||\$\$|```)")
    while i < len(lines):
        line = lines[i]
        if not line.strip():
            i += 1
        elif m := re.match(r"\s{0,3}(#{1,6})\s+(.*?)\s*#*\s*$", line):
            level = len(m[1])
            while headings and headings[-1][0] >= level:
                headings.pop()
            headings.append((level, normalised(m[2])))
            i += 1
        elif re.match(r"\s*(\$\$|```)", line):
            fence, body = re.match(r"\s*(\$\$|```)", line)[1], [line.split("$$", 1)[1]] if "$$" in line else []
            i += 1
            if not (fence == "$$" and body and "$$" in body[0]):
                while i < len(lines) and fence not in lines[i]:
                    body.append(lines[i])
                    i += 1
                i += 1
            yield unit("formula" if fence == "$$" else "code", [" ".join(body).replace("$$", "")])
        elif line.lstrip().startswith("|"):
            cells = [c.strip() for c in line.strip().strip("|").split("|")]
            if not all(re.fullmatch(r":?-+:?", c) for c in cells):
                yield unit("table_row", cells)
            i += 1
        elif m := re.match(r"\s*(?:[-*+]|\d+[.)])\s+(.*)", line):
            body = [m[1]]
            i += 1
            while i < len(lines) and lines[i].strip() and not starts.match(lines[i]):
                body.append(lines[i])
                i += 1
            yield unit("list_item", [" ".join(body)])
        else:
            body = [line]
            i += 1
            while i < len(lines) and lines[i].strip() and not starts.match(lines[i]):
                body.append(lines[i])
                i += 1
            yield unit("paragraph", [" ".join(body)])


def document_units(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, unit_no, heading, kind, text, unit_id) of each document, by a table function."""

    @F.udtf(returnType="unit_no: int, heading: string, kind: string, text: string, unit_id: string")
    class Units:
        def eval(self, text: str):
            for n, u in enumerate(units(text)):
                yield (n, *u)

    spark = docs.sparkSession
    spark.udtf.register("document_units", Units)
    docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("doc_text")).createOrReplaceTempView("echofold_documents")
    return spark.sql("SELECT d.doc, u.* FROM echofold_documents d, LATERAL document_units(d.doc_text) u")
