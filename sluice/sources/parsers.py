"""Parsers of source payloads: JSON, OAI-PMH and article XML, HTML; malformed payloads are set aside."""

from __future__ import annotations

import json
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluice.session import cut


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _all(root: ET.Element, name: str) -> list[ET.Element]:
    return [e for e in root.iter() if _local(e.tag) == name]


def _text(element: ET.Element | None) -> str | None:
    return None if element is None else " ".join("".join(element.itertext()).split()) or None


def parse_oai(payload: str) -> dict:
    """Records of an OAI-PMH page and its resumption token."""
    root = ET.fromstring(payload)
    records = []
    for r in _all(root, "record"):
        header = next(iter(_all(r, "header")), None)
        if header is None:
            continue
        get = lambda n, h=header: _text(next(iter(_all(h, n)), None))
        metadata = next(iter(_all(r, "metadata")), None)
        records.append({"identifier": get("identifier"), "datestamp": get("datestamp"), "deleted": header.get("status") == "deleted", "sets": [_text(s) for s in _all(header, "setSpec")], "metadata_xml": None if metadata is None else "".join(ET.tostring(c, encoding="unicode") for c in metadata)})
    return {"records": records, "resumption_token": _text(next(iter(_all(root, "resumptionToken")), None))}


def parse_jats(payload: str) -> dict:
    """Title, abstract, licences, references and sub-articles of a JATS article."""
    root = ET.fromstring(payload)
    front = next(iter(_all(root, "front")), root)
    references = []
    for r in _all(root, "ref"):
        ids = {e.get("pub-id-type"): _text(e) for e in _all(r, "pub-id")}
        references.append({"id": r.get("id"), "text": _text(r), "doi": ids.get("doi")})
    subs = [{"id": s.get("id"), "type": s.get("article-type"), "title": _text(next(iter(_all(s, "article-title")), None))} for s in _all(root, "sub-article")]
    return {"title": _text(next(iter(_all(front, "article-title")), None)), "abstract": _text(next(iter(_all(front, "abstract")), None)), "licences": [next((v for k, v in e.attrib.items() if _local(k) == "href"), _text(e)) for e in _all(root, "license")], "references": references, "sub_articles": subs}


class _Page(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.title, self.text, self.meta, self.ld = [], [], {}, []
        self._in: list[str] = []
        self._kind = ""

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = dict(attrs)
        if tag == "meta":
            if (name := a.get("name") or a.get("property")) and a.get("content") is not None:
                self.meta.setdefault(name, a["content"])
        elif tag in ("title", "script", "style", "noscript"):
            self._in.append(tag)
            self._kind = a.get("type") or ""

    def handle_endtag(self, tag: str) -> None:
        if self._in and self._in[-1] == tag:
            self._in.pop()

    def handle_data(self, data: str) -> None:
        if not self._in:
            self.text.append(data)
        elif self._in[-1] == "title":
            self.title.append(data)
        elif self._in[-1] == "script" and self._kind == "application/ld+json":
            self.ld.append(data)


def parse_html(payload: str) -> dict:
    """Title, meta map, JSON-LD blocks and visible text of a page."""
    page = _Page()
    page.feed(payload)
    page.close()
    join = lambda parts: " ".join("".join(parts).split()) or None
    return {"title": join(page.title), "meta": page.meta, "json_ld": [x.strip() for x in page.ld], "text": " ".join(" ".join(page.text).split()) or None}


def parse_tei(payload: str) -> dict:
    """Title, abstract and paragraphs of a TEI document."""
    root = ET.fromstring(payload)
    return {"title": _text(next(iter(_all(root, "title")), None)), "abstract": _text(next(iter(_all(root, "abstract")), None)), "paragraphs": [t for e in _all(root, "p") if (t := _text(e))]}


def parse_json(payload: str) -> dict:
    return json.loads(payload)


def parse_jsonl(payload: str) -> dict:
    return {"rows": [json.loads(line) for line in payload.splitlines() if line.strip()]}


PARSERS: dict[str, Callable[[str], dict]] = {"oai": parse_oai, "jats": parse_jats, "html": parse_html, "tei": parse_tei, "json": parse_json, "jsonl": parse_jsonl}


def safe_parse(df: DataFrame, parser: str, key: str, payload: str) -> tuple[DataFrame, DataFrame]:
    """(key, parsed as canonical JSON) of the good payloads, and (key, error, sha256) of those to be set aside."""
    fn = PARSERS[parser]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            parsed, errors = [], []
            for p in rows["p"]:
                try:
                    parsed.append(json.dumps(fn(p), sort_keys=True, ensure_ascii=False))
                    errors.append(None)
                except (ET.ParseError, ValueError, TypeError, AttributeError) as e:
                    parsed.append(None)
                    errors.append(f"{type(e).__name__}: {e}"[:500])
            yield pd.DataFrame({"k": rows["k"], "parsed": parsed, "error": errors, "sha256": rows["h"]})

    base = df.select(F.col(key).cast("string").alias("k"), F.col(payload).alias("p"), F.sha2(F.coalesce(payload, F.lit("")), 256).alias("h"))
    # Parsed once for both outputs.
    out = cut(base.mapInPandas(run, "k string, parsed string, error string, sha256 string").withColumnRenamed("k", key))
    return out.where(F.col("error").isNull()).select(key, "parsed"), out.where(F.col("error").isNotNull()).select(key, "error", "sha256")


def dump_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, at, value): the lines of dump files with their place; files are split as Spark splits any text, so no task holds a whole dump."""
    lines = spark.read.text(path)
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    return lines.select(F.col("_metadata.file_path").alias("file"), place.alias("at"), "value")


def copy_rows(lines: DataFrame) -> DataFrame:
    """(file, table, columns, value) of the lines inside COPY blocks of PostgreSQL dumps, given as (file, at, value).

    Only marker lines (a few a table) are put in order; each line then falls between a block's
    first and last marker of its file.
    """
    head = r"^COPY (\S+) \((.*)\) FROM stdin;\s*$"
    marks = lines.where(F.col("value").rlike(r"^COPY .* FROM stdin;\s*$") | (F.col("value") == "\\."))
    order = Window.partitionBy("file").orderBy("at")
    opened = F.col("value").startswith("COPY ")
    # A line inside a block that looks like a marker's beginning is data: a block ends at the next end mark.
    before = F.coalesce(F.lag(opened).over(order), F.lit(False))
    blocks = marks.withColumn("_open", opened).withColumn("_inside", before & opened)
    blocks = blocks.where(~F.col("_inside")).withColumn("_end", F.lead("at").over(order)).where("_open")
    blocks = cut(blocks.select("file", F.col("at").alias("_from"), F.col("_end").alias("_to"), F.regexp_extract("value", head, 1).alias("table"), F.regexp_extract("value", head, 2).alias("columns")))
    side = F.broadcast(blocks) if blocks.count() <= 100_000 else blocks
    inside = (F.col("at") > F.col("_from")) & (F.col("_to").isNull() | (F.col("at") < F.col("_to")))
    return lines.join(side, "file").where(inside).select("file", "table", "columns", "value")


def copy_blocks(lines: DataFrame) -> DataFrame:
    """(table, columns, rows) of the COPY blocks of dumps, given as (file, at, value); blocks without rows are left out."""
    return copy_rows(lines).groupBy("file", "table", "columns").agg(F.count(F.lit(1)).alias("rows")).select("table", "columns", "rows")
