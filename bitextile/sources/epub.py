"""EPUB packages as tables: one row a spine document, then chapters of paragraphs with their place in the source."""

from __future__ import annotations

import io
import posixpath
import re
import xml.etree.ElementTree as ET
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import prepare

SPINE = "path string, book_title string, language string, identifier string, spine_ordinal int, href string, body string, error string"
#: Fixed value: media type of chapters.
XHTML = "application/xhtml+xml"


def _local(e) -> str:
    return e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""


def _first(root, name: str) -> str | None:
    return next((e.text.strip() for e in root.iter() if _local(e) == name and e.text and e.text.strip()), None)


def package(data: bytes) -> tuple[dict, list[tuple[int, str, str]]]:
    """Metadata and the spine's XHTML documents (place from 1, href, source). Raises ValueError without a package."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        container = ET.fromstring(z.read("META-INF/container.xml"))
        opf = next((e.get("full-path") for e in container.iter() if _local(e) == "rootfile" and e.get("full-path")), None)
        if not opf:
            raise ValueError("the container names no package")
        root = ET.fromstring(z.read(opf))
        items = {e.get("id"): e for e in root.iter() if _local(e) == "item"}
        meta = {"title": _first(root, "title"), "language": _first(root, "language") or "und", "identifier": _first(root, "identifier")}
        out = []
        for ref in (e for e in root.iter() if _local(e) == "itemref"):
            item = items.get(ref.get("idref"))
            if item is None or item.get("media-type") != XHTML:
                continue
            href = item.get("href")
            name = posixpath.basename(href).lower()
            if "title" in name or "about" in name or name in ("nav", "nav.xhtml", "nav.html"):
                continue
            out.append((len(out) + 1, href, z.read(posixpath.normpath(posixpath.join(posixpath.dirname(opf), href))).decode("utf-8", "replace")))
        return meta, out


def read(spark: SparkSession, path: str) -> DataFrame:
    """All EPUB files under a path; a broken file is one row with its error."""
    prepare(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.epub").option("recursiveFileLookup", "true").load(path)

    def run(batches):
        for pdf in batches:
            rows = []
            for where, data in zip(pdf["path"], pdf["content"]):
                stem = posixpath.splitext(posixpath.basename(where))[0]
                try:
                    meta, spine = package(data)
                except (ValueError, KeyError, zipfile.BadZipFile, ET.ParseError) as e:
                    rows.append((where, stem, None, None, None, None, None, str(e)))
                    continue
                rows += [(where, meta["title"] or stem, meta["language"], meta["identifier"], k, href, body, None) for k, href, body in spine]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SPINE.split(", ")])

    return files.select("path", "content").mapInPandas(run, SPINE)


def paragraphs(source: str) -> list[tuple[str, int]]:
    """Texts of the paragraphs outside tables, cut at direct line breaks, with their place from 0."""
    body = re.search(r"<body\b[^>]*>(.*)</body\s*>", source, re.S | re.I)
    inner = re.sub(r"<table\b.*?</table\s*>", " ", body[1] if body else source, flags=re.S | re.I)
    import html

    out = []
    for p in re.findall(r"<p\b[^>]*>(.*?)(?=</p\s*>|<p\b|\Z)", inner, re.S | re.I):
        for part in re.split(r"<br\s*/?>", p, flags=re.I):
            text = " ".join(html.unescape(re.sub(r"<[^>]*>", "", part)).split())
            if text:
                out.append((text, len(out)))
    return out


def chapters(spine: DataFrame) -> DataFrame:
    """path, chapter_index (from 1, without empty documents), href, paragraph_index, text, ordinal, sentences."""
    from pyspark.sql import Window

    @F.pandas_udf("array<struct<text:string,ordinal:int>>")
    def found(bodies: pd.Series) -> pd.Series:
        return bodies.map(lambda b: [{"text": t, "ordinal": k} for t, k in paragraphs(b)])

    rows = spine.where("error is null").withColumn("p", found("body")).where(F.size("p") > 0)
    rows = rows.withColumn("chapter_index", F.row_number().over(Window.partitionBy("path").orderBy("spine_ordinal")))
    rows = rows.select("path", "chapter_index", "href", F.posexplode("p").alias("k", "p"))
    return rows.select("path", "chapter_index", "href", (F.col("k") + 1).alias("paragraph_index"), "p.text", "p.ordinal", T.split_sentences(F.col("p.text")).alias("sentences"))
