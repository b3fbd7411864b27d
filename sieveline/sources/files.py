"""Files as tables: listings, WAV headers and chunks, ratings, sidecars, manifests and databases of one file.

All read through Spark's binaryFile source, so that any store Spark reads will do; a file is parsed by the task
that holds its bytes. A file that can't be read says nothing: its row stays, with nulls and `readable` false. Spark's
source leaves out files of no bytes, so these are never listed.
"""

from __future__ import annotations

import codecs
import csv
import io
import json
import sqlite3
import struct
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def listed(spark: SparkSession, folder: str, extensions: tuple[str, ...] = ()) -> DataFrame:
    """(path, rel_path, size, modified) of a folder's files, recursively, of some extensions (case aside); no content is read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    root = F.regexp_replace(F.lit(folder.rstrip("/")), "^[a-z]+:/*", "/")
    plain = F.regexp_replace("path", "^[a-z]+:/*", "/")
    out = rows.select("path", F.substring(plain, F.length(root) + 2, F.length(plain)).alias("rel_path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    return out.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*(e.lower().lstrip(".") for e in extensions))) if extensions else out


def classified(known: DataFrame, seen: DataFrame) -> DataFrame:
    """(rel_path, state): new, gone, changed (size or time differ) or known, of two listings."""
    a = known.select(F.col("rel_path").alias("_a"), F.struct("size", "modified").alias("_was"))
    b = seen.select(F.col("rel_path").alias("_b"), F.struct("size", "modified").alias("_is"))
    both = a.join(b, F.col("_a") == F.col("_b"), "full")
    state = F.when(F.col("_a").isNull(), "new").when(F.col("_b").isNull(), "gone").when(F.col("_was").eqNullSafe(F.col("_is")), "known").otherwise("changed")
    return both.select(F.coalesce("_a", "_b").alias("rel_path"), state.alias("state"))


def contents(spark: SparkSession, folder: str, glob: str) -> DataFrame:
    """(path, content) of the files that match a glob, recursively."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder).select("path", "content")


def parsed(files: DataFrame, parse: Callable[[bytes], list[tuple]], schema: str) -> DataFrame:
    """(path, *schema): the rows a parser finds in each content, a few files of a batch at a time."""
    names = [c.strip().split(" ")[0] for c in schema.split(", ")]

    def work(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(p, *r) for p, c in zip(batch["path"], batch["content"], strict=True) for r in parse(bytes(c or b""))]
            yield pd.DataFrame(rows, columns=["path", *names], dtype=object)

    return files.select("path", "content").mapInPandas(work, f"path string, {schema}")


# --- WAV -----------------------------------------------------------------------------------------------------------

WAV = "readable boolean, duration_s double, sample_rate int, channels int, bit_depth int, bpm double, beats int, root_note int"
#: Sane stated tempos (fixed values).
TEMPO_MIN, TEMPO_MAX = 40.0, 300.0


def chunks(data: bytes) -> Iterator[tuple[bytes, memoryview]]:
    """(id, body) of every chunk of a RIFF or RF64 WAVE; the last body may be cut short."""
    if data[:4] not in (b"RIFF", b"RF64") or data[8:12] != b"WAVE":
        return
    view, at, size = memoryview(data), 12, 0
    while at + 8 <= len(data) and size != 0xFFFFFFFF:  # that size says: up to the end
        size = int.from_bytes(view[at + 4 : at + 8], "little")
        yield bytes(view[at : at + 4]), view[at + 8 : at + 8 + size]
        at += 8 + size + size % 2


def wav(data: bytes) -> dict:
    """What header, acid and smpl chunks state, and the samples as float64 (frames x channels) for PCM and float files."""
    out: dict = {"readable": False}
    smpl = None
    for name, body in chunks(data):
        if name == b"fmt " and len(body) >= 16:
            kind, out["channels"], out["sample_rate"], _, _, out["bit_depth"] = struct.unpack("<HHIIHH", body[:16])
            out["kind"] = int.from_bytes(body[24:26], "little") if kind == 0xFFFE and len(body) >= 26 else kind
        elif name == b"data" and out.get("channels") and out.get("sample_rate"):
            wide = out["channels"] * out["bit_depth"] // 8
            frames = len(body) // wide if wide else 0
            out.update(readable=frames > 0, duration_s=frames / out["sample_rate"], body=body[: frames * wide])
        elif name == b"acid" and len(body) >= 24:
            flags, root, _, _, beats, _, _, tempo = struct.unpack("<IHHfIHHf", body[:24])
            if not flags & 1 and TEMPO_MIN <= tempo <= TEMPO_MAX:
                out["bpm"] = round(tempo, 3)
            if not flags & 1 and beats:
                out["beats"] = beats
            if flags & 2 and root <= 127:
                out["root_note"] = root
        elif name == b"smpl" and len(body) >= 36:
            smpl = int.from_bytes(body[12:16], "little")
    if smpl is not None and smpl <= 127:
        out.setdefault("root_note", smpl)
    return out


def samples(found: dict) -> np.ndarray | None:
    """Frames x channels in [-1, 1]; None for encodings other than 8 to 32 bit PCM and floats."""
    if not found["readable"]:
        return None
    body, bits, n = found["body"], found["bit_depth"], found["channels"]
    if found["kind"] == 3 and bits in (32, 64):
        x = np.frombuffer(body, f"<f{bits // 8}").astype(float)
    elif found["kind"] != 1:
        return None
    elif bits == 8:
        x = (np.frombuffer(body, np.uint8).astype(float) - 128) / 128
    elif bits == 24:
        b = np.frombuffer(body, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8) / float(1 << 23)
    elif bits in (16, 32):
        x = np.frombuffer(body, f"<i{bits // 8}") / float(1 << (bits - 1))
    else:
        return None
    return x.reshape(-1, n)


def wav_facts(files: DataFrame) -> DataFrame:
    """(path, readable, duration_s, sample_rate, channels, bit_depth, bpm, beats, root_note) of (path, content)."""
    names = [c.split(" ")[0] for c in WAV.split(", ")]

    def parse(data: bytes) -> list[tuple]:
        found = wav(data)
        return [tuple(found.get(n) for n in names)]

    return parsed(files, parse, WAV)


# --- text files ----------------------------------------------------------------------------------------------------


#: Byte order marks and what they announce; files without one are tried as UTF-8, then as what old spreadsheets write.
MARKS = {codecs.BOM_UTF8: "utf-8-sig", codecs.BOM_UTF16_LE: "utf-16", codecs.BOM_UTF16_BE: "utf-16"}
UNMARKED = ("utf-8", "cp1252", "latin-1")


def decoded(data: bytes) -> str:
    """Text by its byte order mark, or in the first of the unmarked encodings that can be read to the end."""

    def fits(name: str) -> bool:
        try:
            data.decode(name)
        except UnicodeDecodeError:
            return False
        return True

    announced = [name for mark, name in MARKS.items() if data.startswith(mark)]
    return data.decode(next(filter(fits, (*announced, *UNMARKED))))


def csv_cells(data: bytes) -> list[tuple]:
    """(line, cells by lower-case column name) of the rows of a CSV with a header; line 1 holds the header's own names."""
    rows = csv.reader(io.StringIO(decoded(data), newline=""))
    head = [c.strip().lower() for c in next(rows, [])]
    return [(1, {c: None for c in head}), *((rows.line_num, {c: v.strip() for c, v in zip(head, r, strict=False)}) for r in rows)]


VERDICTS, SCOPES = ("keep", "drop", "misfiled"), ("file", "set")


def ratings(files: DataFrame) -> DataFrame:
    """(path, line, target, verdict, category, scope, problem) of ratings in CSV files; `problem` says why a line counts for nothing.

    A file without the columns it needs gives one row, its first line. Lines that name neither an item nor a verdict are left out.
    """
    cells = parsed(files, csv_cells, "line int, cells map<string,string>")
    cell = lambda name: F.nullif(F.element_at("cells", name), F.lit(""))
    rows = cells.select(
        "path",
        "line",
        F.coalesce(cell("path"), cell("name")).alias("target"),
        F.lower(cell("rating")).alias("verdict"),
        cell("category").alias("category"),
        F.coalesce(F.lower(cell("scope")), F.lit(SCOPES[0])).alias("scope"),
        F.map_keys("cells").alias("columns"),
    )
    usable = F.array_contains("columns", "rating") & F.arrays_overlap("columns", F.array(F.lit("path"), F.lit("name")))
    wrong = {
        "no column for the item or for its rating": ~usable,
        "not a rating": F.col("verdict").isNull() | ~F.col("verdict").isin(*VERDICTS),
        "only what is misfiled has another category": F.col("category").isNotNull() & (F.col("verdict") != "misfiled"),
        "neither of a file nor of a set": ~F.col("scope").isin(*SCOPES),
        "only files are kept": (F.col("scope") == "set") & (F.col("verdict") == "keep"),
    }
    problem = F.coalesce(*(F.when(shut, text) for text, shut in wrong.items()))
    header = F.col("line") == 1
    said = (header & ~usable) | (~header & usable & (F.col("target").isNotNull() | F.col("verdict").isNotNull()))
    return rows.where(said).withColumn("problem", problem).drop("columns")


def agreed(rows: DataFrame) -> DataFrame:
    """(target, verdict, category, scope, clash): one row a target; rows that say different things clash and rate nothing."""
    good = rows.where("problem IS NULL").select("target", F.struct("verdict", "category", "scope").alias("s"))
    one = good.groupBy("target").agg(F.min("s").alias("s"), F.max("s").alias("_x"))
    clash = ~F.col("s").eqNullSafe(F.col("_x"))
    return one.select("target", *(F.when(~clash, F.col(f"s.{c}")).alias(c) for c in ("verdict", "category", "scope")), clash.alias("clash"))


def sidecar_rows(data: bytes) -> list[tuple]:
    """(file, keywords, colors) of an XMP sidecar, by the local names of its elements; nothing where it doesn't parse."""
    local = lambda e: e.tag.rsplit("}", 1)[-1]
    try:
        root = ET.fromstring(data)
    except ET.ParseError:
        return []
    out: dict[str, tuple[list, list]] = {}
    for item in (e for e in root.iter() if local(e) == "li"):
        parts = {local(c): c for c in item}
        if "filePath" not in parts or not parts["filePath"].text:
            continue
        lists = out.setdefault(parts["filePath"].text, ([], []))
        for into, name in zip(lists, ("keywords", "colors"), strict=True):
            if name in parts:
                into.extend(e.text for e in parts[name].iter() if local(e) == "li" and e.text)
    return [(k, a, b) for k, (a, b) in out.items()]


def sidecars(files: DataFrame) -> DataFrame:
    return parsed(files, sidecar_rows, "file string, keywords array<string>, colors array<string>")


def manifest_rows(data: bytes) -> list[tuple]:
    """(section, category, entry, src) of a build manifest, sources made absolute by its roots."""
    try:
        doc = json.loads(data)
    except ValueError:
        return []
    if not isinstance(doc, dict):
        return []
    roots, out = doc.get("src_roots") or [], []
    for section, groups in doc.items():
        for name, group in groups.items() if isinstance(groups, dict) else ():
            entries = group.get("entries") if isinstance(group, dict) else None
            for e in entries if isinstance(entries, list) else ():
                if not isinstance(e, dict):
                    continue
                src, at = e.get("src"), e.get("src_root", 0)
                if isinstance(src, str) and src and not src.startswith("/") and 0 <= at < len(roots):
                    src = f"{roots[at].rstrip('/')}/{src}"
                out.append((section, name, json.dumps(e, sort_keys=True), src if isinstance(src, str) else None))
    return out


def manifests(files: DataFrame) -> DataFrame:
    return parsed(files, manifest_rows, "section string, category string, entry string, src string")


def sqlite_table(files: DataFrame, sql: str, schema: str) -> DataFrame:
    """The rows of a query over SQLite files, each opened from its bytes in memory; (path, *schema)."""

    def read(data: bytes) -> list[tuple]:
        if not data:
            return []
        with sqlite3.connect(":memory:") as con:
            con.deserialize(data)
            return con.execute(sql).fetchall()

    return parsed(files, read, schema)
