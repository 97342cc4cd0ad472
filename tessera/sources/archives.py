"""ZIP archives, incremental JSON arrays, and the readers behind one entry point."""

from __future__ import annotations

import io
import json
import os
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed as V
from . import files as files_
from . import json_exports, notes


def interesting(name: str) -> bool:
    base = name.rsplit("/", 1)[-1].lower()
    return base == "memories.json" or (base.startswith("conversations") and base.endswith(".json")) or base.endswith(".jsonl")


def _read_entries(z: zipfile.ZipFile, archive: str, entry_limit: int) -> list[tuple[str, str, str, int]]:
    rows = []
    for i, info in enumerate(z.infolist()):
        if interesting(info.filename) and info.compress_type in (0, 8):
            with z.open(info) as entry:  # the size that the header states is not trusted
                data = entry.read(entry_limit + 1)
            if len(data) <= entry_limit:
                rows.append((f"{archive}!{info.filename}", os.path.basename(info.filename), data.decode("utf-8", "replace"), i))
    return rows


def zip_entries(spark: SparkSession, path: str, entry_limit: int = V.IMPORT_BYTES) -> DataFrame:
    """path (archive!entry), name, text, ord of the entries worth reading, under their own names.

    Stored and deflated entries only; damaged archives, those in the 64-bit form, and entries over the limit give no row.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for archive, content in zip(batch["path"], batch["content"], strict=True):
                if not content.startswith(b"PK") or b"PK\x06\x06" in content[-65_600:]:
                    continue
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        rows += _read_entries(z, archive, entry_limit)
                except (zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError, RuntimeError):
                    continue  # a damaged or encrypted archive is refused as a whole
            yield pd.DataFrame(rows, columns=["path", "name", "text", "ord"])

    found = spark.read.format("binaryFile").load(path).select(F.regexp_replace("path", "^file:/+", "/").alias("path"), "content")
    return found.mapInPandas(run, "path string, name string, text string, ord bigint")


def json_array(stream: io.TextIOBase, max_bytes: int = V.IMPORT_BYTES, max_element: int = V.ELEMENT_BYTES_GENERIC, block: int = 65_536) -> Iterator[object]:
    """Elements of a JSON array, or of the array under a wrapper key, one at a time in bounded memory; stops at the first error."""
    decoder, held, read, inside = json.JSONDecoder(), "", 0, False
    while True:
        piece = stream.read(block)
        read += len(piece)
        held += piece
        if not inside:
            start = _array_start(held)
            if start is None:
                if not piece or read > max_bytes:
                    return
                continue
            held, inside = held[start:], True
        while True:
            held = held.lstrip(" \t\r\n,")
            if held.startswith("]"):
                return
            try:
                value, end = decoder.raw_decode(held)
            except ValueError:
                break
            if end == len(held) and piece and not isinstance(value, (dict, list, str)):
                break  # a number may go on in the next block
            yield value
            held = held[end:]
        if not piece or read > max_bytes or len(held) > max_element:
            return


def _array_start(text: str) -> int | None:
    """Where the elements begin: after the first bracket of a bare array, or of the array under a wrapper key at the top level."""
    depth, i, key, quoted = 0, 0, None, None
    while i < len(text):
        c = text[i]
        if c == '"':
            j = i + 1
            while j < len(text) and text[j] != '"':
                j += 2 if text[j] == "\\" else 1
            if j >= len(text):
                return None
            quoted = text[i + 1 : j]
            i = j
        elif c == ":" and depth == 1:
            key = quoted
        elif c == "[" and (depth == 0 or (depth == 1 and key in (*V.WRAPPER_KEYS, "conversations"))):
            return i + 1
        elif c in "[{":
            depth += 1
        elif c in "]}":
            depth -= 1
        elif c == "," and depth == 1:
            key = None
        i += 1
    return None


def scan(spark: SparkSession, path: str, limits: files_.Limits | None = None) -> tuple[str | None, DataFrame | None]:
    """(reader, items) of whatever lies at a path; (None, None) if no reader fits."""
    limits = limits or files_.Limits()
    path = os.path.expanduser(path)
    kind = files_.detect(path)
    if kind is None:
        return None, None
    if kind == "zip":
        rows = zip_entries(spark, path)
        heads = {r["name"]: r["head"] for r in rows.select("name", F.substring("text", 1, V.SNIFF_BYTES).alias("head")).limit(limits.max_files).collect()}
        kinds = {"claude-code" if n.endswith(".jsonl") else files_._json_kind(h) for n, h in heads.items()}
        kind = next(iter(sorted(k for k in kinds if k)), None)
        return (kind, READERS[kind](rows)) if kind else (None, None)
    folder = os.path.isdir(path)
    globs = {"chatgpt": "conversations*.json", "claude-web": "conversations*.json", "claude-memories": "memories.json", "claude-code": "*.jsonl", "zcode": "*.md", "workbuddy": "*.md", "generic": "*.{md,txt,markdown}"}
    deep = kind in ("claude-code", "zcode", "workbuddy", "claude-memories")
    rows = files_.whole_files(spark, path, limits, globs[kind] if folder else None, recursive=folder and deep)
    if kind == "workbuddy" and folder:
        rows = notes.plan_store(rows)
    if kind == "generic" and not folder:
        name = path.lower()
        reader = json_exports.json_lines if name.endswith((".jsonl", ".ndjson")) else json_exports.json_items if name.endswith(".json") else notes.markdown
        return kind, reader(rows)
    return kind, READERS[kind](rows)


READERS = {
    "chatgpt": json_exports.chatgpt,
    "claude-web": json_exports.claude_web,
    "claude-memories": json_exports.claude_memories,
    "claude-code": json_exports.transcripts,
    "zcode": notes.project_notes,
    "workbuddy": notes.memory_files,
    "generic": notes.markdown,
}
PLATFORM = {"chatgpt": "chatgpt", "claude-web": "claude", "claude-memories": "claude", "claude-code": "claude", "zcode": "zcode", "workbuddy": "workbuddy", "generic": None}
