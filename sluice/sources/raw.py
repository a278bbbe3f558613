"""Raw objects by content: storing, checking and packing payloads; workbooks, archives of texts, full texts and releases."""

from __future__ import annotations

import io
import re
import tarfile
import xml.etree.ElementTree as ET
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions.identifiers import canonical_doi
from sluice.session import cut
from sluice.sources import parsers

#: Bytes of a pack aimed at.
PACK = 64 << 20


def put(objects: DataFrame, path: str) -> None:
    """Add payloads (native_id, payload binary) to a store: one row a content, kept in folders by the first two digits of its SHA-256."""
    rows = objects.withColumn("sha256", F.sha2("payload", 256)).withColumn("size", F.octet_length("payload"))
    once = rows.groupBy("sha256").agg(F.min("native_id").alias("native_id"), F.first("payload").alias("payload"), F.first("size").alias("size"))
    spark = objects.sparkSession
    try:
        known = spark.read.parquet(path).select("sha256")
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    else:
        once = cut(once.join(known, "sha256", "left_anti"))
    once.withColumn("prefix", F.substring("sha256", 1, 2)).write.mode("append").partitionBy("prefix").parquet(path)


def get(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """(sha256, payload) of wanted digests (sha256); only their folders are read."""
    asked = wanted.select("sha256").distinct().withColumn("prefix", F.substring("sha256", 1, 2))
    return spark.read.parquet(path).withColumn("prefix", F.col("prefix").cast("string")).join(asked, ["prefix", "sha256"]).select("sha256", "payload")


def verify(objects: DataFrame) -> DataFrame:
    """(sha256, found) of stored payloads whose digest is not their name."""
    return objects.select("sha256", F.sha2("payload", 256).alias("found")).where(F.col("sha256") != F.col("found"))


def receipts_integrity(receipts: DataFrame, objects: DataFrame) -> DataFrame:
    """One row of counts: distinct receipts' digests that are checked, that are missing or corrupt among objects (sha256, payload), and receipts that repeat a digest."""
    asked = receipts.groupBy("sha256").agg(F.count(F.lit(1)).alias("n"))
    found = objects.select("sha256", F.sha2("payload", 256).alias("found"))
    both = asked.join(found, "sha256", "left")
    return both.agg(
        F.count_if(F.col("found") == F.col("sha256")).alias("checked"), F.count_if(F.col("found").isNull()).alias("missing"), F.count_if(F.col("found") != F.col("sha256")).alias("corrupt"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_receipts_skipped")
    )


def pack(objects: DataFrame, size: int = PACK) -> tuple[DataFrame, DataFrame]:
    """(pack, body) of payloads (sha256, payload) end to end, and the index (sha256, pack, start, length) that finds each again."""
    total = objects.agg(F.coalesce(F.sum(F.octet_length("payload")), F.lit(0)).alias("n")).first()["n"]
    packs = max(1, -(-total // size))
    rows = objects.select("sha256", "payload", F.pmod(F.xxhash64("sha256"), F.lit(packs)).alias("pack"))

    def join(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("sha256")
        lengths = part["payload"].map(len)
        starts = lengths.cumsum() - lengths
        return pd.DataFrame({"pack": key[0], "body": [b"".join(part["payload"])], "names": [part["sha256"].tolist()], "starts": [starts.tolist()], "lengths": [lengths.tolist()]})

    made = cut(rows.groupBy("pack").applyInPandas(join, "pack long, body binary, names array<string>, starts array<long>, lengths array<long>"))
    index = made.select("pack", F.explode(F.arrays_zip("names", "starts", "lengths")).alias("i")).select(F.col("i.names").alias("sha256"), "pack", F.col("i.starts").alias("start"), F.col("i.lengths").alias("length"))
    return made.select("pack", "body"), index


def unpack(packs: DataFrame, index: DataFrame, wanted: DataFrame) -> DataFrame:
    """(sha256, payload) of wanted digests out of their packs."""
    asked = index.join(wanted.select("sha256").distinct(), "sha256", "left_semi")
    return packs.join(asked, "pack").select("sha256", F.substring("body", F.col("start").cast("int") + 1, F.col("length").cast("int")).alias("payload"))


def snapshot_works(lines: DataFrame, ids: DataFrame | None = None, dois: DataFrame | None = None) -> DataFrame:
    """The lines (value: JSON) of a snapshot of works with a wanted id or DOI; all where none are wanted."""
    rows = lines.where(F.trim("value") != "").select("value", F.upper(F.substring_index(F.get_json_object("value", "$.id"), "/", -1)).alias("_id"), canonical_doi(F.get_json_object("value", "$.doi")).alias("_doi"))
    if ids is None and dois is None:
        return rows.select("value")
    hit = F.lit(False)
    for column, side, norm in (("_id", ids, lambda c: F.upper(F.substring_index(c, "/", -1))), ("_doi", dois, canonical_doi)):
        if side is not None:
            wanted = side.select(norm(F.col(side.columns[0])).alias(column)).where(F.col(column).isNotNull()).distinct().withColumn(f"{column}_hit", F.lit(True))
            rows = rows.join(wanted, column, "left")
            hit = hit | F.coalesce(f"{column}_hit", F.lit(False))
    return rows.where(hit).select("value")


def newest_pages(bundles: DataFrame, key: str = "source_object_id", at: str = "retrieved_at") -> DataFrame:
    """The bundles of the newest snapshot of each object only."""
    return bundles.groupBy(key).agg(F.max_by(F.struct(*bundles.columns), at).alias("r")).select("r.*")


def _cell(reference: str) -> str:
    return re.match(r"[A-Z]+", reference).group()


def workbook_rows(data: bytes) -> list[tuple[str, int, dict[str, str | None]]]:
    """(sheet, row number, cells by column letter) of a workbook in either form of Office Open XML."""
    local = parsers._local
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter() if local(t.tag) == "t") for si in ET.fromstring(z.read("xl/sharedStrings.xml")) if local(si.tag) == "si"]
        targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out = []
        for sheet in (e for e in ET.fromstring(z.read("xl/workbook.xml")).iter() if local(e.tag) == "sheet"):
            link = next(v for k, v in sheet.attrib.items() if local(k) == "id")
            target = targets[link].lstrip("/")
            root = ET.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}"))
            for number, row in enumerate((r for r in root.iter() if local(r.tag) == "row"), 1):
                cells = {}
                for c in (c for c in row if local(c.tag) == "c"):
                    value = next((v.text for v in c.iter() if local(v.tag) in ("v", "t")), None)
                    cells[_cell(c.get("r"))] = shared[int(value)] if c.get("t") == "s" and value is not None else value
                out.append((sheet.get("name"), int(row.get("r") or number), cells))
    return out


def workbooks(files: DataFrame) -> DataFrame:
    """(path, sheet, row, cells) of workbooks given as (path, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for path, content in zip(part["path"], part["content"], strict=True):
                rows = workbook_rows(content)
                yield pd.DataFrame({"path": path, "sheet": [r[0] for r in rows], "row": [r[1] for r in rows], "cells": [r[2] for r in rows]})

    return files.select("path", "content").mapInPandas(run, "path string, sheet string, row int, cells map<string,string>")


#: Marks of annotations in a text, and the tags inside of one. The text before a mark is what it annotates.
ANNOTATION, TAG = re.compile(r"\[\[(.*?)\]\]", re.S), re.compile(r"[A-Z]{3}")


def annotated_spans(files: DataFrame, folder: str = "/Annotated/", annotation: re.Pattern = ANNOTATION, tag: re.Pattern = TAG) -> DataFrame:
    """(path, member, start, text, tags) of the annotated stretches in the texts of ZIP archives given as (path, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            out = []
            for path, content in zip(part["path"], part["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in sorted(z.namelist()):
                        if folder not in name or not name.endswith(".txt") or name.startswith("__MACOSX"):
                            continue
                        body, done = z.read(name).decode("utf-8", "replace"), 0
                        for m in annotation.finditer(body):
                            text, tags = body[done : m.start()].strip(), sorted(set(tag.findall(m.group(1))))
                            done = m.end()
                            if text and tags:
                                out.append((path, name, m.start(), text, tags))
            yield pd.DataFrame(out, columns=["path", "member", "start", "text", "tags"])

    return files.select("path", "content").mapInPandas(run, "path string, member string, start int, text string, tags array<string>")


_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\nendstream", re.S)
_SHOWN = re.compile(rb"\((?:[^()\\]|\\.)*\)")
_BLOCK = re.compile(rb"BT(.*?)ET", re.S)


def pdf_text(data: bytes) -> dict:
    """The text that a PDF's page contents show in plain strings, and whether there is so little (under 50 characters a page) that it must be read by eye."""
    pages = max(1, len(re.findall(rb"/Type\s*/Page[^s]", data)))
    shown = []
    for m in _STREAM.finditer(data):
        body = m.group(1)
        try:
            body = zlib.decompress(body)
        except zlib.error:
            pass
        for block in _BLOCK.findall(body):
            shown.append(" ".join(re.sub(rb"\\([()\\])", rb"\1", s[1:-1]).decode("latin-1") for s in _SHOWN.findall(block)))
    text = " ".join(" ".join(shown).split())
    return {"text": text, "pages": pages, "ocr_likely_required": len(text) < 50 * pages}


def patent_xml(payload: str) -> dict:
    """Title, abstract and claims (number and text) of a patent office's XML."""
    root = ET.fromstring(payload)
    claims = [{"number": c.get("num") or str(i), "text": parsers._text(c)} for i, c in enumerate(parsers._all(root, "claim"), 1)]
    return {"title": parsers._text(next(iter(parsers._all(root, "invention-title")), None)), "abstract": parsers._text(next(iter(parsers._all(root, "abstract")), None)), "claims": claims}


#: Parsers by media type. Fixed values.
ROUTES = {"application/xml": "jats", "application/jats+xml": "jats", "application/tei+xml": "tei", "text/html": "html", "application/pdf": "born_digital_pdf"}


def _full_text(media_type: str, data: bytes) -> tuple[str, str, int]:
    route = ROUTES.get(media_type)
    if route is None:
        raise ValueError(f"unsupported media type: {media_type}")
    if route == "born_digital_pdf":
        got = pdf_text(data)
        if got["ocr_likely_required"]:
            raise ValueError("ocr required but object licence/policy does not permit OCR")
        return route, got["text"], 0
    parsed = parsers.PARSERS[route](data.decode("utf-8", "replace"))
    if route == "html":
        return route, parsed.get("text") or "", 0
    parts = [parsed.get("title"), parsed.get("abstract"), *parsed.get("paragraphs", [])]
    return route, "\n".join(p for p in parts if p), len(parsed.get("references") or [])


def full_texts(jobs: DataFrame, done: DataFrame | None = None, shard: int | None = None, shards: int = 1) -> DataFrame:
    """(native_id, route, ok, text_hash, characters, reference_count, reference_recall, error) of jobs (native_id, media_type, payload, expected_references).

    Each goes to the parser of its media type; what fails is a row with its error. With shards, only
    jobs of one remainder of the id's hash; jobs that are done are left out.
    """
    if shard is not None:
        jobs = jobs.where(F.pmod(F.xxhash64("native_id"), F.lit(shards)) == shard)
    if done is not None:
        jobs = jobs.join(done.where("ok").select("native_id"), "native_id", "left_anti")
    import hashlib

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            out = []
            for native, kind, payload, expected in zip(part["native_id"], part["media_type"], part["payload"], part["expected_references"], strict=True):
                try:
                    route, text, references = _full_text(kind, payload)
                    normal = " ".join(text.split())
                    recall = min(references / expected, 1.0) if expected and expected > 0 else None
                    out.append((native, route, True, hashlib.sha256(normal.encode()).hexdigest(), len(normal), references, recall, None))
                except Exception as e:  # noqa: BLE001
                    out.append((native, ROUTES.get(kind, "unknown"), False, None, 0, 0, None, f"{type(e).__name__}: {e}"[:500]))
            yield pd.DataFrame(out, columns=["native_id", "route", "ok", "text_hash", "characters", "reference_count", "reference_recall", "error"])

    schema = "native_id string, route string, ok boolean, text_hash string, characters long, reference_count long, reference_recall double, error string"
    return jobs.select("native_id", "media_type", "payload", F.col("expected_references").cast("double").alias("expected_references")).mapInPandas(run, schema)


#: Columns that every released row carries, in this order. Fixed values.
RELEASE_COLUMNS = ("release_version", "schema_version", "code_version", "snapshot_date", "build_id", "release_tier")


def release(tables: dict[str, DataFrame], path: str, version: dict[str, str]) -> DataFrame:
    """Write each table with the release's columns, and return its manifest: table, rows, columns and schema digest."""
    rows = []
    spark = next(iter(tables.values())).sparkSession
    for name, df in sorted(tables.items()):
        out = df.select("*", *[F.lit(version[c]).alias(c) for c in RELEASE_COLUMNS])
        out.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{name}")
        kinds = ",".join(f"{c}:{t}" for c, t in out.dtypes)
        rows.append((name, spark.read.parquet(f"{path}/{name}").count(), len(out.columns), kinds))
    made = spark.createDataFrame(rows, "table string, rows long, columns int, kinds string")
    return made.select("table", "rows", "columns", F.sha2("kinds", 256).alias("schema_sha256"))


def tar_bundle(members: dict[str, bytes]) -> bytes:
    """A tar archive that depends on its members alone: names in order, no times, no owners."""
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=tarfile.USTAR_FORMAT) as tar:
        for name in sorted(members):
            info = tarfile.TarInfo(name)
            info.size, info.mtime, info.mode, info.uid, info.gid = len(members[name]), 0, 0o644, 0, 0
            tar.addfile(info, io.BytesIO(members[name]))
    return out.getvalue()


def csv_rows(df: DataFrame, value: str, columns: str) -> DataFrame:
    """Lines of CSV as the given columns; a line that does not fit is kept whole in _corrupt_record."""
    parsed = F.from_csv(F.col(value), f"{columns}, _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record", "mode": "PERMISSIVE"})
    return df.select(parsed.alias("r")).select("r.*")


def malformed(column: Column) -> Column:
    """Whether a line of CSV was set aside."""
    return column.isNotNull()
