"""Readers of tables, office files and nested graphs, chunkers by extension, and the chunks' ids and paths.

Office files are zip archives of XML and are read with the standard library, file
by file in Arrow batches; a file must fit in a worker's memory.
"""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import normalize as N

CHUNK = "path string, chunk long, title string, section_path string, content string"


def table_rows(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Rows of delimited files with a header, all text; lines that do not fit the header are skipped.  _line is the line's place within its file."""
    rows = spark.read.option("header", True).option("mode", "DROPMALFORMED").option("sep", sep).option("multiLine", True).csv(path)
    return rows.withColumns({"_file": F.col("_metadata.file_path"), "_at": F.monotonically_increasing_id()}).withColumn("_line", F.row_number().over(W.partitionBy("_file").orderBy("_at")) - 1).drop("_at")


def row_chunks(rows: DataFrame, columns: list[str], by: str, place: str, size: int = 50) -> DataFrame:
    """(by, chunk, content, row_start, row_end): runs of `size` rows as lines "column: value", empty values left out, under the names of the columns."""
    line = F.concat_ws(" | ", *[F.when(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")).isNotNull(), F.concat(F.lit(f"{c}: "), F.col(c).cast("string"))) for c in columns])
    x = rows.select(by, F.col(place).alias("_k"), F.floor(F.col(place) / size).alias("chunk"), line.alias("_t"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", "_t"))), lambda r: r["_t"]), "\n")
    return x.groupBy(by, "chunk").agg(F.concat(F.lit(f"Columns: {', '.join(columns)}\n"), body).alias("content"), F.min("_k").alias("row_start"), F.max("_k").alias("row_end"))


def xml_part(archive: zipfile.ZipFile, name: str) -> ET.Element | None:
    return ET.fromstring(archive.read(name)) if name in archive.namelist() else None


def local(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


def sheets(data: bytes) -> Iterator[tuple[str, list[list[str]]]]:
    """(name, rows) of the sheets of a workbook; shared and inline texts are resolved, empty cells are "". """
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = xml_part(z, "xl/sharedStrings.xml")
        texts = ["".join(t.text or "" for t in si.iter() if local(t) == "t") for si in shared] if shared is not None else []
        book, links = xml_part(z, "xl/workbook.xml"), xml_part(z, "xl/_rels/workbook.xml.rels")
        at = {r.get("Id"): r.get("Target") for r in links} if links is not None else {}
        names = [(s.get("name"), next((v for k, v in s.attrib.items() if k.endswith("}id")), None)) for s in book.iter() if local(s) == "sheet"]
        for k, (name, link) in enumerate(names):
            root = xml_part(z, "xl/" + at.get(link, f"worksheets/sheet{k + 1}.xml").removeprefix("/xl/"))
            rows = []
            for row in (r for r in root.iter() if local(r) == "row"):
                cells: dict[int, str] = {}
                for c in (c for c in row if local(c) == "c"):
                    col = 0
                    for x in re.match("[A-Z]*", c.get("r", ""))[0]:
                        col = col * 26 + ord(x) - 64
                    value = "".join(v.text or "" for v in c.iter() if local(v) in ("v", "t"))
                    cells[col or len(cells) + 1] = texts[int(value)] if c.get("t") == "s" and value else value
                rows.append([cells.get(i, "") for i in range(1, max(cells, default=0) + 1)])
            yield name, rows


def sheet_chunks(path: str, data: bytes, size: int = 50) -> list[tuple]:
    """A chunk for each run of `size` rows of a sheet, labelled by row numbers as the sheet shows them; sheets without rows are left out."""
    out = []
    for name, rows in sheets(data):
        head, body = (rows[0], rows[1:]) if rows else ([], [])
        for a in range(0, len(body), size):
            part = [(a + k + 2, r) for k, r in enumerate(body[a : a + size])]
            lines = [f"Row {n}: " + " | ".join(f"{h}: {v}" for h, v in zip(head, r, strict=False) if v.strip()) for n, r in part if any(v.strip() for v in r)]
            if lines:
                out.append((path, len(out), f"{name} rows {part[0][0]}-{part[-1][0]}", name, f"Columns: {', '.join(head)}\n" + "\n".join(lines)))
    return out


def document_chunks(path: str, data: bytes, least: int = 0) -> list[tuple]:
    """Sections of a word-processor file by its heading styles, tables as lines of cells; sections of fewer than `least` characters join the one before."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = xml_part(z, "word/document.xml")
    body = next(e for e in root.iter() if local(e) == "body")
    text = lambda e: "".join(t.text or "" for t in e.iter() if local(t) == "t")
    made: list[list] = []
    stack: list[tuple[int, str]] = []
    for e in body:
        if local(e) == "tbl":
            lines = [" | ".join(text(c).strip() for c in r if local(c) == "tc") for r in e if local(r) == "tr"]
        elif local(e) == "p":
            style = next((v for s in e.iter() if local(s) == "pStyle" for k, v in s.attrib.items() if k.endswith("val")), "")
            level = re.fullmatch(r"Heading\s?([1-9])", style)
            if level and text(e).strip():
                stack = [x for x in stack if x[0] < int(level[1])] + [(int(level[1]), text(e).strip())]
                made.append([text(e).strip(), " > ".join(t for _, t in stack), []])
                continue
            lines = [text(e)]
        else:
            continue
        if not made:
            made.append(["", "", []])
        made[-1][2] += [x for x in lines if x.strip()]
    out: list[list] = []
    for title, section, lines in made:
        content = "\n".join(lines)
        if out and len(content) < least:
            out[-1][2] += f"\n{title}\n{content}".rstrip()
        elif content or title:
            out.append([title, section, content])
    return [(path, k, *x) for k, x in enumerate(out)]


def text_chunks(path: str, data: bytes) -> list[tuple]:
    """The whole text as one chunk."""
    return [(path, 0, path.rpartition("/")[2], "", data.decode("utf-8", "replace"))]


#: Chunkers by extension, asked in order; the last takes every text.
CHUNKERS: list[tuple[tuple[str, ...], Callable[[str, bytes], list[tuple]]]] = [(("xlsx",), sheet_chunks), (("docx",), document_chunks), (("txt", "md", "markdown"), text_chunks)]


def chunker_of(path: str) -> Callable[[str, bytes], list[tuple]] | None:
    """The first chunker that can handle a file."""
    kind = path.rpartition(".")[2].lower()
    return next((f for kinds, f in CHUNKERS if kind in kinds), None)


def chunks(spark: SparkSession, root: str) -> DataFrame:
    """Chunks of every file below root that has a chunker; hidden and underscored folders are skipped."""
    known = "|".join(k for kinds, _ in CHUNKERS for k in kinds)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "content")
    below = F.replace("path", F.lit(root.rstrip("/")), F.lit(""))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [c for p, d in zip(b["path"], b["content"], strict=True) for c in chunker_of(p)(p, bytes(d))]
            yield pd.DataFrame(rows, columns=["path", "chunk", "title", "section_path", "content"])

    return files.where(F.lower("path").rlike(rf"\.({known})$")).where(~below.rlike(r"/[._]")).mapInPandas(run, CHUNK)


def nested_rules(graphs: DataFrame, rule: str) -> DataFrame:
    """(bucket_kind, bucket, pos, rule): rules under entity_types.*.business_rules and relationships.*.business_rules of graphs (graph as JSON)."""
    out = None
    for kind in ("entity_types", "relationships"):
        held = F.from_json(F.get_json_object("graph", f"$.{kind}"), f"map<string,struct<business_rules:array<{rule}>>>")
        x = graphs.select(F.explode(held).alias("bucket", "v")).select(F.lit(kind).alias("bucket_kind"), "bucket", F.posexplode("v.business_rules").alias("pos", "rule"))
        out = x if out is None else out.unionByName(x)
    return out


def marked_sections(text: Column, markers: Column) -> Column:
    """array<struct<title, content>>: a text cut at markers array<struct<title, start, end>> that a resolver proposed; one whose start is not in the text is left out, one whose end is not runs to the end."""

    def cut(m: Column) -> Column:
        a = F.position(m["start"], text)
        b = F.position(m["end"], text, a + F.length(m["start"]))
        n = F.when((F.coalesce(F.length(m["end"]), F.lit(0)) > 0) & (b > 0), b + F.length(m["end"]) - a).otherwise(F.length(text))
        return F.when((F.coalesce(F.length(m["start"]), F.lit(0)) > 0) & (a > 0), F.struct(m["title"].alias("title"), F.substring(text, a, n).alias("content")))

    return F.filter(F.transform(markers, cut), lambda x: x.isNotNull())


def sub_chunks(chunks_: DataFrame, parts: Column) -> DataFrame:
    """chunks (chunk_id, title, content) as parts (array of texts): ids with _sub_nnn, "(part k/n)" in the title, the parent and its words; a chunk of one part stays as it is."""
    x = chunks_.withColumn("_p", parts).select("chunk_id", "title", "content", F.size("_p").alias("parts"), F.posexplode_outer("_p").alias("_k", "_t"))
    k, n = F.col("_k") + 1, F.col("parts")
    many = n > 1
    return x.select(
        F.when(many, F.concat("chunk_id", F.lit("_sub_"), F.lpad(k.cast("string"), 3, "0"))).otherwise(F.col("chunk_id")).alias("chunk_id"),
        F.when(many, F.concat("title", F.lit(" (part "), k.cast("string"), F.lit("/"), n.cast("string"), F.lit(")"))).otherwise(F.col("title")).alias("title"), F.when(many, F.trim("_t")).otherwise(F.col("content")).alias("content"),
        F.when(many, F.col("chunk_id")).alias("parent_chunk_id"), F.when(many, F.size(F.filter(F.split("content", r"\s+"), lambda w: w != ""))).alias("parent_words"),
    )


def chunk_paths(chunks_: DataFrame) -> DataFrame:
    """chunks (chunk_id, section_path array, title) with path: folders of the sections and the title; a path that is taken gets the chunk's id, and a number if that is taken too."""
    parts = F.transform(F.coalesce("section_path", F.array().cast("array<string>")), lambda p: N.folder(p))
    base = F.array_join(F.concat(parts, F.array(N.folder(F.col("title")))), "/")
    x = chunks_.withColumn("_b", base).withColumn("_n", F.row_number().over(W.partitionBy("_b").orderBy("chunk_id")))
    x = x.withColumn("_q", F.when(F.col("_n") == 1, F.col("_b")).otherwise(F.concat("_b", F.lit("_"), N.folder(F.col("chunk_id")))))
    x = x.withColumn("_m", F.row_number().over(W.partitionBy("_q").orderBy("_n", "chunk_id")))
    return x.withColumn("path", F.concat("_q", F.when(F.col("_m") > 1, F.concat(F.lit("_"), F.col("_m").cast("string"))).otherwise(""), F.lit(".txt"))).drop("_b", "_n", "_q", "_m")
