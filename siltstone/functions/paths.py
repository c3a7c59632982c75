"""Path expressions, glob patterns and file classification."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions.text import col


def normal(c: Column | str) -> Column:
    return F.replace(col(c), F.lit("\\"), F.lit("/"))


def leaf(c: Column | str) -> Column:
    return F.substring_index(normal(c), "/", -1)


def folder(c: Column | str) -> Column:
    return F.regexp_extract(normal(c), r"^(.*)/[^/]*$", 1)


def extension(c: Column | str) -> Column:
    return F.lower(F.regexp_extract(leaf(c), r".(\.[^.]+)$", 1))


def stem(c: Column | str) -> Column:
    return F.regexp_replace(leaf(c), r"(?<=.)\.[^.]+$", "")


def is_under(path: Column | str, root: Column | str) -> Column:
    p, r = F.lower(normal(path)), F.regexp_replace(F.lower(normal(root)), "/+$", "")
    return (p == r) | p.startswith(F.concat(r, F.lit("/")))


def glob_regex(pattern: str) -> str:
    """fnmatch semantics, anchored: ``*`` crosses ``/``, case counts."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[":
            end = pattern.find("]", i + 2)
            if end < 0:
                out.append(r"\[")
            else:
                body = pattern[i + 1 : end]
                out.append(f"[{'^' + body[1:] if body[0] == '!' else body}]".replace("\\", "\\\\"))
                i = end
        else:
            out.append(re.escape(c))
        i += 1
    return f"(?s)^{''.join(out)}$"


def glob_match(c: Column, pattern: str) -> Column:
    """A directory pattern (``x/`` or ``x/**``) matches what lies below; others match the path or its leaf."""
    pattern = pattern.replace("\\", "/")
    if pattern.endswith("/**") or pattern.endswith("/"):
        base = pattern.rstrip("*").rstrip("/")
        if base.startswith("**/"):
            base = base[3:]
            return F.concat(F.lit("/"), c).contains(f"/{base}/")
        return (c == base) | c.startswith(f"{base}/")
    rx = glob_regex(pattern)
    return c.rlike(rx) | F.substring_index(c, "/", -1).rlike(rx)


def included(path: Column | str, include: Sequence[str], exclude: Sequence[str]) -> Column:
    """Order-sensitive: any include pattern admits, then each exclude pattern rejects and each ``!`` pattern admits again; the last match wins."""
    p = normal(path)
    state = F.lit(not include)
    for pattern in include:
        state = F.when(glob_match(p, pattern), True).otherwise(state)
    for pattern in exclude:
        negated = pattern.startswith("!")
        state = F.when(glob_match(p, pattern.removeprefix("!")), negated).otherwise(state)
    return state


def effective_globs(mode: str, own: Sequence[str], common: Sequence[str]) -> list[str]:
    """The patterns of a root: inherited, overridden, or common ones extended by its own, first seen first."""
    chosen = {"inherit": [*common], "override": [*own]}.get(mode, [*common, *own])
    return list(dict.fromkeys(chosen))


#: Version marks that do not tell documents of one family apart.
VERSION_MARKS = (
    r"\b(?:v|ver|version|rev|revision)\s*[._-]?\s*\d+[a-z]?\b|\b(?:draft|final|latest|current|copy)\b|\(\s*\d+\s*\)"
    r"|\b\d{4}[._-]\d{1,2}[._-]\d{1,2}\b|\b\d{1,2}[._-]\d{1,2}[._-]\d{2,4}\b"
)


def family_key(title: Column | str) -> Column:
    """What remains of a title without version marks, in lower case; the title itself where nothing remains."""
    low = F.lower(col(title))
    bare = F.trim(F.regexp_replace(F.regexp_replace(low, VERSION_MARKS, " "), "[^a-z0-9]+", " "))
    return F.when(bare == "", low).otherwise(bare)


#: Extensions by kind, in the order in which kinds are tried.
KINDS = {
    "sensitive_metadata": ".age .cer .crt .gpg .jks .kdbx .key .kstore .p12 .pem .pfx .pgp",
    "subtitle": ".ass .dfxp .sbv .srt .ssa .ttml .vtt",
    "mail": ".eml .mbox .msg",
    "calendar": ".ics .ical .ifb",
    "contact": ".vcf .vcard",
    "structured_data": ".csv .tsv .psv .ssv .jsonl .jsonld .ndjson",
    "report": ".burp .cyclonedx .har .lcov .nessus .nmap .sarif .spdx .tap .trx .zap",
    "database": ".accdb .db .dbf .duckdb .fdb .mdb .sqlite .sqlite3",
    "geospatial": ".geojson .gpx .gpkg .kml .kmz .mbtiles .shp .topojson",
    "cad": ".dae .dgn .dwg .dxf .fbx .gltf .glb .ifc .ifczip .obj .rfa .rvt .skp .stl .stp .step .usd .usda .usdc .usdz",
    "scientific": ".fits .h5 .hdf5 .mat .nc .netcdf .npy .npz",
    "diagram": ".drawio .vsdx .mmd .puml",
    "code": ".py .js .ts .tsx .jsx .cs .go .rs .java .sql .ps1 .sh .c .h .cpp .css .html .json .yaml .yml .toml",
    "text": ".md .txt .rst .log .ini .cfg",
    "document": ".docx .doc .pdf .pptx .xlsx .odt .rtf .epub",
    "image": ".png .jpg .jpeg .gif .bmp .tif .tiff .webp .svg",
    "audio": ".mp3 .wav .flac .ogg .m4a",
    "video": ".mp4 .mkv .mov .avi .webm",
    "container": ".zip .jar .whl",
    "archive": ".tar .gz .tgz .7z .rar .bz2 .xz",
}
DEFERRED = ("document", "image", "audio", "video", "container", "archive", "diagram", "database")
INLINE_BYTES, HEAVY_BYTES = 256 << 10, 10 << 20


def file_kind(path: Column | str) -> Column:
    ext = extension(path)
    kind = None
    for name, extensions in KINDS.items():
        test = ext.isin(extensions.split())
        kind = F.when(test, name) if kind is None else kind.when(test, name)
    return kind.otherwise("binary")


def tier(kind: Column, size: Column) -> Column:
    """inline, deferred or metadata_only, by kind and size."""
    return F.when(kind.isin(*DEFERRED) | (size > HEAVY_BYTES), "deferred").when(kind.isin("text", "code") & (size <= INLINE_BYTES), "inline").otherwise("metadata_only")


def signature_kind(content: Column | str) -> Column:
    """Classification by the first bytes, before any name is looked at."""
    head = F.hex(F.substring(col(content), 1, 12))
    marks = {"25504446": "pdf", "504B0304": "zip", "1F8B": "gzip", "89504E470D0A1A0A": "png", "FFD8FF": "jpeg", "47494638": "gif", "52494646": "riff", "494433": "id3", "4F676753": "ogg", "1A45DFA3": "matroska"}
    kind = None
    for mark, name in marks.items():
        test = head.startswith(mark)
        kind = F.when(test, name) if kind is None else kind.when(test, name)
    text = col(content).cast("string")
    return kind.when(F.octet_length(col(content)) == 0, "empty").when(~F.is_valid_utf8(text) | text.rlike(r"[\x00-\x08\x0e-\x1a]"), "unknown").otherwise("utf8_text")
