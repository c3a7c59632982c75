"""Scans of file trees and readers for the formats a knowledge base collects.

A scan lists files without their content. Readers turn bytes into documents by a UDTF-like
``mapInPandas`` over (path, content): status, title, text and a JSON of counts. Broken input
gives a status, never an error. Keys and certificates are never decoded. Readers give all they
find unless an argument bounds it; tables and workbooks are sampled, with their counts exact.
"""

from __future__ import annotations

import csv
import email
import email.policy
import html
import io
import json
import re
import sqlite3
import tarfile
import xml.etree.ElementTree as ET
import zipfile
import zlib
from collections.abc import Callable, Iterator, Sequence
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import hashing as H
from siltstone.functions import paths as P

SAMPLE = 10
DOCUMENT = "path string, status string, title string, text string, counts string"


def scan(spark: SparkSession, root: str, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> DataFrame:
    """path (below the root), kind, tier, size, mtime_ns and quick_hash of every wanted file; contents are not read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).drop("content")
    base = re.sub(r"/+$", "", root)
    relative = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), f"^{re.escape(base)}/", "")
    files = listed.select(relative.alias("path"), F.col("length").alias("size"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"))
    kept = files.where(P.included("path", include, exclude))
    kind = P.file_kind("path")
    return kept.select("path", kind.alias("kind"), P.tier(kind, F.col("size")).alias("tier"), "size", "mtime_ns", H.quick_hash(P.leaf("path"), "size", "mtime_ns").alias("quick_hash"))


def contents(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "content")


def unchanged(scanned: DataFrame, manifest: DataFrame) -> DataFrame:
    """The scan with ``skip``: true where size, time and quick hash equal the manifest and its content hash is known."""
    m = manifest.select("path", F.col("size").alias("_s"), F.col("mtime_ns").alias("_t"), F.col("quick_hash").alias("_q"), F.col("content_hash").alias("_c"))
    same = (F.col("_s") == F.col("size")) & (F.col("_t") == F.col("mtime_ns")) & (F.col("_q") == F.col("quick_hash")) & (F.coalesce("_c", F.lit("")) != "")
    return scanned.join(m, "path", "left").withColumn("skip", F.coalesce(same, F.lit(False))).drop("_s", "_t", "_q", "_c")


# ------------------------------------------------------------------ readers of one file


def decode(data: bytes) -> str:
    for mark, name in ((b"\xff\xfe\x00\x00", "utf-32"), (b"\x00\x00\xfe\xff", "utf-32"), (b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if data.startswith(mark):
            return data.decode(name, "replace").replace("\r\n", "\n").replace("\r", "\n")
    return data.decode("utf-8", "replace").replace("\r\n", "\n").replace("\r", "\n")


def result(status: str, title: str = "", text: str = "", **counts) -> tuple[str, str, str, str]:
    return status, title, text.replace("\x00", ""), json.dumps(counts, sort_keys=True, default=str)


def read_delimited(data: bytes, delimiter: str = ",") -> tuple:
    rows = csv.reader(io.StringIO(decode(data)), delimiter=delimiter)
    header, sample, total = next(rows, None), [], 0
    if header is None:
        return result("empty")
    for row in rows:
        total += 1
        if len(sample) < SAMPLE:
            sample.append(row)
    lines = ["Columns: " + ", ".join(header), *(" | ".join(r) for r in sample)]
    return result("sampled", text="\n".join(lines), rows=total, columns=len(header), truncated=total > SAMPLE)


def read_json_lines(data: bytes) -> tuple:
    columns: dict[str, None] = {}
    sample, total, bad = [], 0, 0
    for line in decode(data).split("\n"):
        if not line.strip():
            continue
        total += 1
        try:
            value = json.loads(line)
        except ValueError:
            bad += 1
            continue
        if isinstance(value, dict):
            columns.update(dict.fromkeys(value))
            if len(sample) < SAMPLE:
                sample.append(json.dumps(value, ensure_ascii=False, sort_keys=True))
    text = "\n".join(["Columns: " + ", ".join(columns), *sample])
    return result("sampled_with_errors" if bad else "sampled", text=text, rows=total, errors=bad, columns=len(columns))


def read_json(data: bytes) -> tuple:
    """An array, the first list under a key, or one object."""
    try:
        value = json.loads(decode(data))
    except ValueError as problem:
        return result("invalid", error=str(problem))
    rows = value if isinstance(value, list) else next((v for v in value.values() if isinstance(v, list)), [value]) if isinstance(value, dict) else [value]
    columns = dict.fromkeys(k for r in rows if isinstance(r, dict) for k in r)
    text = "\n".join(["Columns: " + ", ".join(columns), *(json.dumps(r, ensure_ascii=False, sort_keys=True) for r in rows[:SAMPLE])])
    return result("sampled", text=text, rows=len(rows), columns=len(columns))


_CUE = re.compile(r"\d+$|.*-->.*|WEBVTT.*|(?:STYLE|REGION)$")


def read_subtitle(data: bytes) -> tuple:
    """Spoken lines of VTT, SRT or ASS: numbers, times and notes are left out, cues counted."""
    lines, note, cues = [], False, 0
    for line in decode(data).split("\n"):
        line = line.strip()
        cues += "-->" in line or line.startswith("Dialogue:")
        if not line:
            note = False
        elif line.startswith("NOTE"):
            note = True
        elif line.startswith("Dialogue:"):
            lines.append(re.sub(r"\{[^}]*\}", "", line.split(",", 9)[-1]).replace("\\N", " "))
        elif not note and not _CUE.match(line) and not re.match(r"\[.*\]$|(?:Format|Style|Title|ScriptType)\s*:", line):
            lines.append(re.sub(r"<[^>]+>", "", line))
    return result("extracted", text="\n".join(lines), cues=cues)


def mail_bodies(message: email.message.Message) -> tuple[str | None, str | None]:
    """The plain and the HTML body of a message, parts of a kind one below the other, attachments aside."""
    found: dict[str, list[str]] = {"text/plain": [], "text/html": []}
    for part in message.walk():
        if part.get_content_type() in found and part.get_content_disposition() != "attachment":
            raw = part.get_payload(decode=True) or b""
            try:
                found[part.get_content_type()].append(raw.decode(part.get_content_charset() or "utf-8", "replace"))
            except LookupError:
                found[part.get_content_type()].append(raw.decode("utf-8", "replace"))
    plain, html_ = ("\n".join(x).replace("\r\n", "\n") if x else None for x in found.values())
    return plain, html_


def _mail_text(message: email.message.Message) -> str:
    plain, html_ = mail_bodies(message)
    return (plain if plain is not None else readable_html(html_ or "")[1]).strip()


def messages(data: bytes) -> Iterator[email.message.Message]:
    """The messages of an eml or mbox file, one after the other."""
    if not data.startswith(b"From "):
        pieces: Iterator[bytes] = iter([data])
    else:
        starts = [m.end() for m in re.finditer(rb"(?m)^From .*\r?\n(?=[\w-]+:)", data)]
        ends = [m.start() for m in re.finditer(rb"(?m)^From .*\r?\n(?=[\w-]+:)", data)][1:] + [len(data)]
        pieces = (data[a:b] for a, b in zip(starts, ends, strict=True))
    for piece in pieces:
        if piece.strip():
            yield email.message_from_bytes(piece, policy=email.policy.compat32)


def header(message: email.message.Message, name: str) -> str:
    return str(email.header.make_header(email.header.decode_header(message.get(name) or "")))


def read_mail(data: bytes) -> tuple:
    """Subject and body of all messages of an eml or mbox file."""
    parts, attachments, subjects = [], 0, []
    for message in messages(data):
        subjects.append(header(message, "Subject"))
        attachments += sum(p.get_content_disposition() == "attachment" for p in message.walk())
        parts.append(f"Subject: {subjects[-1]}\n{_mail_text(message)}")
    return result("extracted" if parts else "empty", title=subjects[0] if subjects else "", text="\n\n".join(parts), messages=len(parts), attachments=attachments)


def read_calendar(data: bytes) -> tuple:
    """Events and contacts: unfolded properties of VEVENT, VTODO and VCARD blocks, under readable labels."""
    labels = {"SUMMARY": "Summary", "DTSTART": "Start", "DTEND": "End", "LOCATION": "Location", "DESCRIPTION": "Description", "ORGANIZER": "Organizer", "FN": "Name", "EMAIL": "Email", "TEL": "Phone", "ORG": "Organisation", "TITLE": "Title"}
    text = re.sub(r"\n[ \t]", "", decode(data))
    blocks = re.findall(r"(?ms)^BEGIN:(VEVENT|VTODO|VCARD)\n(.*?)^END:\1", text)
    out = []
    for _, block in blocks:
        lines = []
        for line in block.split("\n"):
            name, colon, value = line.partition(":")
            label = labels.get(name.partition(";")[0].upper())
            if colon and label:
                lines.append(f"{label}: " + re.sub(r"\\([,;\\])", r"\1", value.replace("\\n", " ").replace("\\N", " ")).strip())
        out.append("\n".join(lines))
    return result("extracted" if out else "empty", text="\n\n".join(out), blocks=len(blocks))


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def read_report(data: bytes) -> tuple:
    """Counts and bounded lines of SARIF, CycloneDX, SPDX, HAR, JUnit, TRX, TAP, Cobertura and LCOV reports."""
    text = decode(data).strip()
    if text.startswith("{"):
        try:
            value = json.loads(text)
        except ValueError as problem:
            return result("invalid", error=str(problem))
        if isinstance(value.get("runs"), list):
            found = [r for run in value["runs"] for r in run.get("results", [])]
            lines = [f"{r.get('level', 'warning')} {r.get('ruleId', '')}: {(r.get('message') or {}).get('text', '')}" for r in found]
            return result("extracted", "SARIF report", "\n".join(lines), format="sarif", results=len(found))
        if "bomFormat" in value:
            parts = value.get("components", [])
            return result("extracted", "CycloneDX", "\n".join(f"{c.get('name')} {c.get('version', '')}".strip() for c in parts), format="cyclonedx", components=len(parts))
        if "spdxVersion" in value:
            parts = value.get("packages", [])
            return result("extracted", "SPDX", "\n".join(f"{c.get('name')} {c.get('versionInfo', '')}".strip() for c in parts), format="spdx", packages=len(parts))
        if isinstance(value.get("log"), dict):
            entries = value["log"].get("entries", [])
            lines = [f"{e.get('request', {}).get('method', '')} {e.get('request', {}).get('url', '').partition('?')[0]} {e.get('response', {}).get('status', '')}" for e in entries]
            return result("extracted", "HAR", "\n".join(lines), format="har", entries=len(entries))
        return result("unsupported")
    if text.startswith("<"):
        try:
            root = ET.fromstring(text)
        except ET.ParseError as problem:
            return result("invalid", error=str(problem))
        nodes = list(root.iter())
        cases = [n for n in nodes if _local(n.tag) == "testcase"]
        if cases or _local(root.tag) in ("testsuite", "testsuites"):
            failed = [n for n in cases if any(_local(c.tag) in ("failure", "error") for c in n)]
            return result("extracted", "JUnit", "\n".join(f"failed {n.get('classname', '')}.{n.get('name', '')}" for n in failed), format="junit", tests=len(cases), failures=len(failed))
        if _local(root.tag) == "TestRun":
            tests = [n for n in nodes if _local(n.tag) == "UnitTestResult"]
            failed = [n for n in tests if n.get("outcome") == "Failed"]
            return result("extracted", "TRX", "\n".join(f"failed {n.get('testName', '')}" for n in failed), format="trx", tests=len(tests), failures=len(failed))
        if _local(root.tag) == "coverage":
            return result("extracted", "Coverage", f"line-rate {root.get('line-rate')}", format="coverage", line_rate=root.get("line-rate"), classes=sum(_local(n.tag) == "class" for n in nodes))
        return result("unsupported")
    if re.search(r"(?m)^(?:ok|not ok) \d+", text):
        failed = re.findall(r"(?m)^not ok \d+.*", text)
        return result("extracted", "TAP", "\n".join(failed), format="tap", tests=len(re.findall(r"(?m)^(?:not )?ok \d+", text)), failures=len(failed))
    if re.search(r"(?m)^(?:SF|DA):", text):
        total, hit = sum(map(int, re.findall(r"(?m)^LF:(\d+)", text))), sum(map(int, re.findall(r"(?m)^LH:(\d+)", text)))
        return result("extracted", "LCOV", f"{hit} of {total} lines", format="lcov", lines=total, hit=hit)
    return result("unsupported")


def read_database(data: bytes) -> tuple:
    """Tables and columns of a SQLite file; no rows are read."""
    if not data.startswith(b"SQLite format 3\x00"):
        return result("invalid")
    connection = sqlite3.connect(":memory:")
    try:
        connection.deserialize(data)
        names = [r[0] for r in connection.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite_%' ORDER BY name")]
        quoted = lambda n: '"' + n.replace('"', '""') + '"'
        lines = [f"{n}: " + ", ".join(r[1] for r in connection.execute(f"PRAGMA table_info({quoted(n)})")) for n in names]
    except sqlite3.Error as problem:
        return result("invalid", error=str(problem))
    finally:
        connection.close()
    return result("extracted", text="\n".join(lines), tables=len(names))


class _Events(HTMLParser):
    """The markup as a flat list of (what, name or text, attributes); both functions below fold over it."""

    def __init__(self, markup: str) -> None:
        super().__init__(convert_charrefs=True)
        self.seen: list[tuple[str, str, list]] = []
        self.feed(markup)
        self.close()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.seen.append(("open", tag, attrs))

    def handle_endtag(self, tag: str) -> None:
        self.seen.append(("close", tag, []))

    def handle_data(self, data: str) -> None:
        self.seen.append(("text", data, []))


#: Elements without an end, elements that begin a line of their own, and elements whose content is not read.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body br dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table td th tr ul".split())
UNREAD = frozenset("script style noscript template svg iframe object".split())
SAFE = frozenset("p br div span b i em strong ul ol li a blockquote pre code table tr td th h1 h2 h3 h4".split())


def leave(within: list[str], tag: str) -> None:
    """Closes ``tag`` and what was left open inside it; an end without a start changes nothing."""
    if tag in within:
        del within[len(within) - 1 - within[::-1].index(tag) :]


def readable_html(markup: str) -> tuple[str, str]:
    """Title and text of a page; every block element is a line, white space within lines is one blank."""
    within: list[str] = []
    title, lines = "", [""]
    for what, value, _ in _Events(markup).seen:
        if what == "text":
            if "title" in within and "svg" not in within:
                title += value
            elif not UNREAD.intersection(within):
                lines[-1] += value
            continue
        if value in BLOCKS:
            lines.append("")
        if what == "close":
            leave(within, value)
        elif value not in VOID:
            within.append(value)
    filled = (" ".join(line.split()) for line in lines)
    return " ".join(title.split()), "\n".join(line for line in filled if line)


def read_html(data: bytes) -> tuple:
    title, text = readable_html(decode(data))
    return result("extracted" if text else "empty", title, text)


def sanitised_html(markup: str) -> str:
    """Markup without scripts, styles, attributes and unsafe links."""
    within: list[str] = []
    out: list[str] = []
    for what, value, attrs in _Events(markup).seen:
        if what == "text":
            if not UNREAD.intersection(within):
                out.append(html.escape(value, quote=False))
            continue
        if what == "close":
            leave(within, value)
        elif value not in VOID:
            within.append(value)
        if value not in SAFE or UNREAD.intersection(within):
            continue
        if what == "close":
            out.append(f"</{value}>")
            continue
        link = dict(attrs).get("href") if value == "a" else None
        safe = link is not None and re.match(r"\s*(?:https?|mailto):", link, re.I)
        out.append(f'<a href="{html.escape(link)}" rel="noopener">' if safe else f"<{value}>")
    return "".join(out)


# ------------------------------------------------------------------ office, publications, diagrams


def _entries(data: bytes) -> zipfile.ZipFile:
    return zipfile.ZipFile(io.BytesIO(data))


def _numbered(names: Sequence[str], pattern: str) -> list[str]:
    """The entries whose name matches, in the order of their number."""
    found = [(int(m[1]), n) for n in names if (m := re.fullmatch(pattern, n))]
    return [n for _, n in sorted(found)]


def _paragraphs(root: ET.Element, blocks: Sequence[str], texts: Sequence[str]) -> list[str]:
    """The text of each outermost element named in ``blocks``: of its elements in ``texts``, or of all where none are named."""
    out: list[str] = []

    def text_of(node: ET.Element) -> str:
        if texts:
            return "".join("\t" if _local(x.tag) == "tab" else "\n" if _local(x.tag) in ("br", "line-break") else x.text or "" for x in node.iter() if _local(x.tag) in (*texts, "tab", "br", "line-break"))
        return "".join(node.itertext())

    stack = [root]
    while stack:
        node = stack.pop()
        if _local(node.tag) in blocks:
            if (found := text_of(node).strip()) != "":
                out.append(found)
        else:
            stack += reversed(node)
    return out


def _package_title(package: zipfile.ZipFile) -> str:
    for name in ("docProps/core.xml", "meta.xml"):
        if name in package.namelist():
            found = [x.text for x in ET.fromstring(package.read(name)).iter() if _local(x.tag) == "title" and x.text]
            return found[0].strip() if found else ""
    return ""


def read_word(data: bytes) -> tuple:
    """Paragraphs of a word-processing package, tables included, with the title of its properties."""
    package = _entries(data)
    lines = _paragraphs(ET.fromstring(package.read("word/document.xml")), ("p",), ("t",))
    return result("extracted" if lines else "empty", _package_title(package), "\n".join(lines), paragraphs=len(lines))


def read_slides(data: bytes) -> tuple:
    """The text of each slide in order, under its number."""
    package = _entries(data)
    names = _numbered(package.namelist(), r"ppt/slides/slide(\d+)\.xml")
    slides = ["\n".join([f"Slide {i}", *_paragraphs(ET.fromstring(package.read(n)), ("p",), ("t",))]) for i, n in enumerate(names, 1)]
    return result("extracted" if slides else "empty", _package_title(package), "\n\n".join(slides), slides=len(slides))


def _column(reference: str) -> int:
    """0 for A, 26 for AA."""
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def _sampled_sheets(sheets: list[tuple[str, Iterator[list[str]]]]) -> tuple:
    """Columns, first rows and exact counts: the first filled row of a sheet names its columns, empty rows count nowhere."""
    columns: list[str] = []
    sample, total = [], 0
    for name, rows in sheets:
        head: list[str] | None = None
        for row in rows:
            if not any(row):
                continue
            if head is None:
                head = [v or f"column_{i + 1}" for i, v in enumerate(row)]
                columns = columns or head
                continue
            total += 1
            if len(sample) < SAMPLE:
                sample.append(f"{name}: " + " | ".join(f"{h}={v}" for h, v in zip(head, row, strict=False) if v))
    lines = ["Columns: " + ", ".join(columns), *sample]
    return result("sampled" if columns else "empty", text="\n".join(lines), rows=total, columns=len(columns), sheets=[n for n, _ in sheets], truncated=total > len(sample))


def read_workbook(data: bytes) -> tuple:
    """Columns, sample and row count of a spreadsheet package; formulas show their stored value."""
    package = _entries(data)
    known = package.namelist()
    shared = ["".join(x.text or "" for x in item.iter() if _local(x.tag) == "t") for item in ET.fromstring(package.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in known else []
    titles = [x.get("name") or "" for x in ET.fromstring(package.read("xl/workbook.xml")).iter() if _local(x.tag) == "sheet"] if "xl/workbook.xml" in known else []

    def rows(entry: str) -> Iterator[list[str]]:
        for _, node in ET.iterparse(package.open(entry)):
            if _local(node.tag) != "row":
                continue
            values: list[str] = []
            for cell in node:
                at = _column(cell.get("r") or "") if cell.get("r") else len(values)
                raw = "".join(x.text or "" for x in cell.iter() if _local(x.tag) in ("v", "t"))
                values += [""] * (at + 1 - len(values))
                values[at] = shared[int(raw)] if cell.get("t") == "s" and raw.isdigit() and int(raw) < len(shared) else raw
            yield values
            node.clear()

    entries = _numbered(known, r"xl/worksheets/sheet(\d+)\.xml")
    return _sampled_sheets([(titles[i] if i < len(titles) else f"sheet{i + 1}", rows(n)) for i, n in enumerate(entries)])


def read_open_document(data: bytes) -> tuple:
    """Text, slides or sheets of an open-document package."""
    package = _entries(data)
    root = ET.fromstring(package.read("content.xml"))
    tables = [x for x in root.iter() if _local(x.tag) == "table"]
    if any(_local(x.tag) == "spreadsheet" for x in root.iter()):

        def rows(sheet: ET.Element) -> Iterator[list[str]]:
            for row in (x for x in sheet.iter() if _local(x.tag) == "table-row"):
                yield ["\n".join("".join(p.itertext()) for p in cell if _local(p.tag) == "p") for cell in row if _local(cell.tag) == "table-cell"]

        name = lambda x: next((v for k, v in x.attrib.items() if _local(k) == "name"), "")
        return _sampled_sheets([(name(x), rows(x)) for x in tables])
    lines = _paragraphs(root, ("p", "h"), ())
    return result("extracted" if lines else "empty", _package_title(package), "\n".join(lines), paragraphs=len(lines))


def read_epub(data: bytes) -> tuple:
    """The chapters of a publication in the order of its spine."""
    package = _entries(data)
    place = next(x.get("full-path") for x in ET.fromstring(package.read("META-INF/container.xml")).iter() if _local(x.tag) == "rootfile")
    root = ET.fromstring(package.read(place))
    base = place.rpartition("/")[0]
    hrefs = {x.get("id"): x.get("href") for x in root.iter() if _local(x.tag) == "item"}
    order = [hrefs.get(x.get("idref")) for x in root.iter() if _local(x.tag) == "itemref"]
    titles = [x.text for x in root.iter() if _local(x.tag) == "title" and x.text]
    chapters = [readable_html(decode(package.read(f"{base}/{h}" if base else h)))[1] for h in order if h and (f"{base}/{h}" if base else h) in package.namelist()]
    return result("extracted" if any(chapters) else "empty", titles[0].strip() if titles else "", "\n\n".join(c for c in chapters if c), chapters=len(chapters))


def read_fiction_book(data: bytes) -> tuple:
    root = ET.fromstring(data)
    titles = [x.text for x in root.iter() if _local(x.tag) == "book-title" and x.text]
    bodies = [x for x in root if _local(x.tag) == "body"]
    lines = [line for b in bodies for line in _paragraphs(b, ("p", "v"), ())]
    return result("extracted" if lines else "empty", titles[0].strip() if titles else "", "\n".join(lines), paragraphs=len(lines))


_RTF = re.compile(r"\\'([0-9a-fA-F]{2})|\\u(-?\d+) ?\??|\\([a-zA-Z]+)(-?\d+)? ?|\\([^a-zA-Z])|([{}])|([^\\{}\r\n]+)")
#: Groups that hold no text of the document.
_RTF_ASIDE = frozenset("fonttbl colortbl stylesheet info pict header footer generator themedata listtable rsidtbl".split())


def read_rich_text(data: bytes) -> tuple:
    """The text of an RTF file without its tables of fonts, colours and styles."""
    if not data.startswith(b"{\\rtf"):
        return result("invalid")
    out: list[str] = []
    aside = [False]
    for m in _RTF.finditer(data.decode("latin-1")):
        byte, code, word, _, sign, brace, plain = m.groups()
        if brace == "{":
            aside.append(aside[-1])
        elif brace == "}":
            if len(aside) > 1:
                aside.pop()
        elif sign == "*" or word in _RTF_ASIDE:
            aside[-1] = True
        elif not aside[-1]:
            if byte:
                out.append(bytes([int(byte, 16)]).decode("cp1252", "replace"))
            elif code:
                out.append(chr(int(code) % 65536))
            elif word in ("par", "line"):
                out.append("\n")
            elif word == "tab":
                out.append("\t")
            elif sign in ("{", "}", "\\", "~"):
                out.append(" " if sign == "~" else sign)
            elif plain:
                out.append(plain)
    text = "\n".join(" ".join(line.split()) for line in "".join(out).split("\n")).strip()
    return result("extracted" if text else "empty", text=text)


_PDF_STREAM = re.compile(rb"<<(?P<head>(?:[^<>]|<[^<>]*>|<<(?:[^<>]|<[^<>]*>|<<[^<>]*>>)*>>)*)>>\s*stream\r?\n(?P<body>.*?)\r?\nendstream", re.S)
_PDF_SHOWN = re.compile(rb"\((?P<text>(?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*)\)|(?P<gap>-?\d+(?:\.\d+)?)(?=[\s(\]<])|(?P<line>T\*|Td|TD|Tm|ET|'|\")(?![\w*])", re.S)
_PDF_ESCAPES = {b"n": b"\n", b"r": b"\n", b"t": b"\t", b"b": b"", b"f": b""}


def _pdf_string(raw: bytes) -> str:
    plain = re.sub(rb"\\([0-7]{1,3}|\r?\n|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1] in b"01234567" else b"" if m[1][-1:] == b"\n" else _PDF_ESCAPES.get(m[1], m[1]), raw, flags=re.S)
    return plain.decode("utf-16" if plain.startswith((b"\xfe\xff", b"\xff\xfe")) else "cp1252", "replace")


def read_pdf(data: bytes) -> tuple:
    """Text that pages show through simple fonts, from plain or deflated streams.

    Pages whose fonts number their glyphs freely, and encrypted files, show nothing readable;
    they give metadata_only with the number of pages rather than wrong characters.
    """
    if not data.startswith(b"%PDF"):
        return result("invalid")
    pages = len(re.findall(rb"/Type\s*/Page\b", data))
    lines: list[str] = []
    for m in _PDF_STREAM.finditer(data) if b"/Encrypt" not in data else ():
        body = m["body"]
        if b"/Subtype" in m["head"] and b"/Image" in m["head"]:
            continue
        if b"FlateDecode" in m["head"]:
            try:
                body = zlib.decompressobj().decompress(body)
            except zlib.error:
                continue
        elif b"/Filter" in m["head"]:
            continue
        for block in re.findall(rb"(?<!\w)BT(?!\w)(.*?(?<!\w)ET)(?!\w)", body, re.S):
            line = ""
            for shown in _PDF_SHOWN.finditer(block):
                if shown["text"] is not None:
                    line += _pdf_string(shown["text"])
                elif shown["gap"] is not None:
                    line += " " if float(shown["gap"]) < -200 and line and not line.endswith(" ") else ""
                elif line.strip():
                    lines.append(" ".join(line.split()))
                    line = ""
    text = "\n".join(lines)
    legible = sum(c.isprintable() or c == "\n" for c in text) >= 0.9 * len(text)
    return result("extracted", text=text, pages=pages) if text and legible else result("metadata_only", pages=pages)


def read_diagram(data: bytes) -> tuple:
    """Labels of a drawing: texts and titles of SVG, values of draw.io cells."""
    root = ET.fromstring(data)
    lines = [" ".join("".join(x.itertext()).split()) for x in root.iter() if _local(x.tag) in ("text", "title", "desc")]
    lines += [readable_html(x.get("value") or x.get("label"))[1] for x in root.iter() if x.get("value") or x.get("label")]
    lines = [x for x in lines if x]
    return result("extracted" if lines else "metadata_only", text="\n".join(lines), labels=len(lines))


def safe_member(name: str) -> bool:
    parts = name.replace("\\", "/").split("/")
    return bool(name) and not name.startswith(("/", "\\")) and ".." not in parts and not re.match(r"[A-Za-z]:", name)


def members(data: bytes, most: int | None = None, most_bytes: int | None = None, most_total: int | None = None) -> Iterator[tuple[str, str, bytes | None]]:
    """Name, status and content of the members of a zip or tar file, one level deep.

    A bound on their number, size or total size is an argument; what lies beyond it gives a
    status row.
    """
    total = 0
    try:
        if zipfile.is_zipfile(io.BytesIO(data)):
            archive = zipfile.ZipFile(io.BytesIO(data))
            entries = [(i.filename, i.file_size, lambda i=i: archive.read(i)) for i in archive.infolist() if not i.is_dir()]
        else:
            packed = tarfile.open(fileobj=io.BytesIO(data))
            entries = [(m.name, m.size, lambda m=m: packed.extractfile(m).read()) for m in packed if m.isfile()]
    except (tarfile.TarError, zipfile.BadZipFile, EOFError, OSError) as problem:
        yield "", f"invalid: {type(problem).__name__}", None
        return
    for number, (name, size, read) in enumerate(entries):
        if most is not None and number >= most:
            yield name, "over_member_cap", None
        elif not safe_member(name):
            yield name, "unsafe_name", None
        elif most_bytes is not None and size > most_bytes or most_total is not None and total + size > most_total:
            yield name, "over_size_cap", None
        else:
            try:
                content = read()
            except (RuntimeError, zipfile.BadZipFile, tarfile.TarError, EOFError, OSError) as problem:
                yield name, f"invalid: {type(problem).__name__}", None
                continue
            total += size
            yield name, "extracted", content


READERS: dict[str, Callable[[bytes], tuple]] = {
    ".csv": read_delimited, ".tsv": lambda b: read_delimited(b, "\t"), ".psv": lambda b: read_delimited(b, "|"), ".ssv": lambda b: read_delimited(b, ";"),
    ".jsonl": read_json_lines, ".ndjson": read_json_lines, ".json": read_json, ".srt": read_subtitle, ".vtt": read_subtitle, ".ass": read_subtitle,
    ".eml": read_mail, ".mbox": read_mail, ".ics": read_calendar, ".vcf": read_calendar, ".sarif": read_report, ".har": read_report, ".trx": read_report, ".tap": read_report, ".lcov": read_report, ".xml": read_report,
    ".sqlite": read_database, ".sqlite3": read_database, ".db": read_database, ".html": read_html, ".htm": read_html,
    **dict.fromkeys((".docx", ".docm", ".dotx"), read_word), **dict.fromkeys((".pptx", ".pptm", ".ppsx", ".potx"), read_slides), **dict.fromkeys((".xlsx", ".xlsm", ".xltx"), read_workbook),
    **dict.fromkeys((".odt", ".odp", ".ods", ".ott", ".otp", ".ots"), read_open_document), ".epub": read_epub, ".fb2": read_fiction_book, ".rtf": read_rich_text, ".pdf": read_pdf, ".svg": read_diagram, ".drawio": read_diagram,
}


#: How keys and certificates begin.
PRIVATE = re.compile(rb"\s*(?:-----BEGIN [A-Z0-9 ]*(?:KEY|CERTIFICATE|MESSAGE)[A-Z ]*-----|PuTTY-User-Key-File|age-encryption\.org/|AGE-SECRET-KEY-)")


def extract(files: DataFrame, readers: dict[str, Callable[[bytes], tuple]] | None = None) -> DataFrame:
    """Documents from (path, content). Unknown types that are valid text are read as text, others get the status metadata_only.

    Keys, certificates and password stores are never decoded, whatever ``readers`` says, and
    neither is any file that begins like one of them.
    """
    chosen = READERS if readers is None else readers
    sensitive = frozenset(P.KINDS["sensitive_metadata"].split())
    listed = frozenset(" ".join(P.KINDS[k] for k in ("geospatial", "cad", "scientific")).split())

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                data = bytes(content) if content is not None else b""
                ending = "." + path.rpartition(".")[2].lower()
                reader = chosen.get(ending)
                try:
                    if ending in sensitive or PRIVATE.match(data):
                        found = result("metadata_only", kind="sensitive_metadata")
                    elif reader is None and ending in listed:
                        found = result("metadata_only")
                    elif reader is not None:
                        found = reader(data)
                    elif b"\x00" in data[:4096] and not data.startswith((b"\xff\xfe", b"\xfe\xff")):
                        found = result("metadata_only")
                    else:
                        found = result("extracted" if data else "empty", text=decode(data))
                except Exception as problem:  # noqa: BLE001 - one broken file must not end the job
                    found = result("failed", error=type(problem).__name__)
                rows.append((path, *found))
            yield pd.DataFrame(rows, columns=["path", "status", "title", "text", "counts"])

    return files.select("path", "content").mapInPandas(read, DOCUMENT)


def mail_messages(files: DataFrame) -> DataFrame:
    """path, number (from 1), subject, sender, text and attachments (their number) of every message of mail files."""
    columns = ["path", "number", "subject", "sender", "text", "attachments"]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                rows = []
                for number, message in enumerate(messages(bytes(content) if content is not None else b""), 1):
                    attached = sum(p.get_content_disposition() == "attachment" for p in message.walk())
                    rows.append((path, number, header(message, "Subject"), header(message, "From"), _mail_text(message).replace("\x00", ""), attached))
                    if len(rows) >= 1000:
                        yield pd.DataFrame(rows, columns=columns)
                        rows = []
                yield pd.DataFrame(rows, columns=columns)

    return files.select("path", "content").mapInPandas(read, "path string, number int, subject string, sender string, text string, attachments int")


def settled(before: DataFrame, after: DataFrame) -> DataFrame:
    """The files of the later of two scans that did not change between them; files still being written wait for the next scan."""
    seen = before.select("path", F.col("size").alias("_s"), F.col("mtime_ns").alias("_t"))
    return after.join(seen, "path").where((F.col("_s") == F.col("size")) & (F.col("_t") == F.col("mtime_ns"))).drop("_s", "_t")


def expand(files: DataFrame, most: int | None = None, most_bytes: int | None = None, most_total: int | None = None) -> DataFrame:
    """path, member, status and content of the members of container files, all of them unless an argument bounds them."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                for name, status, data in members(bytes(content) if content is not None else b"", most, most_bytes, most_total):
                    yield pd.DataFrame([(path, name, status, data)], columns=["path", "member", "status", "content"])

    return files.select("path", "content").mapInPandas(unpack, "path string, member string, status string, content binary")
