"""Keyword-stuffed pages and link lists (problem 9).

Every line (and every sentence of a longer line) is reduced to a shape: how many words, how
they are written, which separators and links stand between them. Shapes that no sentence has
(link with caption, list of short items, product tag, keyword fragment) are grouped within the
page, and a page is flagged when such shapes make up more than half of its length. What
looks like a sentence is taken apart by repetition: keywords that come back within a few words
count as stuffing too. Sentences that merely share a subject are statements.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from siltstone.tables import schema_with, table

SHARE = 0.5
#: The same phrase within so many words is stuffing, not style.
NEAR = 8
WORDS_PER_LINK = 8

URL = re.compile(r"(?:https?://|www\.)[^\s<>\"'|)\]]+", re.I)
WORD = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")
SENTENCE_END = re.compile(r"(?<=[.!?])[\"')\]]*\s+|(?<=[。！？])")
ENDS = re.compile(r"[.!?。！？:][\"')\]]*\s*$")
ITEMS = re.compile(r"\s*[;,|·•/>»\t]\s*|\s+(?=#)|\s+[-–—*]\s+")
#: What stands between items; fewer than four of them make no list of five.
SEPARATORS = (*";,|·•/>»\t#", " - ", " – ", " — ", " * ")
LABELLED = re.compile(r"\s*[^\W\d_]+\s*:")
PRICE = re.compile(r"(?<![\d.])\d{1,5}[.,]\d{2}(?![\d.,])|[$€£¥]\s?\d|\d\s?[$€£]")
TAG = re.compile(r"\bsku\b|\bin stock\b|\bsale\b|\bbundle\b|\boffer\b|\bprice\b|\bauf lager\b|\bangebot\b|\bpromo\b|\boferta\b|\bdiscount\b|[$€£¥]", re.I)
WIDE = re.compile(r"\s{2,}")
LOG = re.compile(r"^\s*(?:\d{4}-\d\d-\d\d|\|\s|\{|\[\d|<\d|```|#{1,6} )")


def segments(text: str) -> list[str]:
    """Lines, and the sentences of lines that hold several."""
    found = []
    for line in text.splitlines():
        line = WIDE.sub(" ", line.strip())
        if line:
            found += [s for s in SENTENCE_END.split(line) if s and s.strip()]
    return found


def shape(segment: str, words: list[str] | None = None) -> tuple[str, str] | None:
    """Kind and shape of a segment that is no sentence, else None; ``words`` are the segment's own if it has no link."""
    if "://" in segment or "www." in segment.lower():
        links = len(URL.findall(segment))
        if links:
            count = len(WORD.findall(URL.sub(" ", segment)))
            return ("link", f"{min(links, 3)}:{min(count, 6)}") if count <= WORDS_PER_LINK * links else None
    if LOG.match(segment):
        return None
    words = WORD.findall(segment) if words is None else words
    count = len(words)
    if count <= 12 and PRICE.search(segment) and TAG.search(segment):
        return "offer", f"{min(count, 12)}{written(words)}"
    if count >= 4 and segment.count("#") >= 3 and segment.count("#") >= count / 2:
        return "list", "#"
    if sum(map(segment.count, SEPARATORS)) < 4:
        return None
    body = segment.partition(":")[2] if LABELLED.match(segment) else segment
    items = [i for i in ITEMS.split(body.strip(" .;,")) if i]
    if len(items) >= 5 and not any(c.isdigit() for c in segment):
        sizes = sorted(len(i.split()) for i in items)
        if sizes[len(sizes) // 2] <= 3 and sizes[-1] <= 5:
            return "list", f"{min(len(items), 20) // 5}{written(words)}"
    return None


def written(words: list[str]) -> str:
    return "C" if sum(w[0].isupper() for w in words) > len(words) / 2 else "l"


def repeated(words: list[str], near: int = NEAR) -> list[bool]:
    """Marks the words of phrases (two words, or one of five letters) that come back within ``near`` words."""
    marked = [False] * len(words)
    last: dict[tuple[str, str], int] = {}
    times = Counter(words)
    for i in range(len(words) - 1):
        pair = (words[i], words[i + 1])
        before = last.get(pair)
        if before is not None and i - before <= near:
            for j in (before, before + 1, i, i + 1):
                marked[j] = True
        last[pair] = i
    seen: dict[str, int] = {}
    for i, w in enumerate(words):
        if len(w) >= 5 and times[w] >= 4:
            before = seen.get(w)
            if before is not None and i - before <= near // 2 + 1:
                marked[before] = marked[i] = True
            seen[w] = i
    return marked


def spam_share(text: str) -> float:
    """The share of a page's length that is links, lists, tags or repeated keywords; 0 for a blank page."""
    parts = segments(text)
    total = sum(map(len, parts))
    if not total:
        return 0.0
    shapes: Counter = Counter()
    prose: list[str] = []
    lowered: list[list[str]] = []
    for part in parts:
        words = WORD.findall(part)
        found = shape(part, words)
        if found is not None:
            shapes[found] += len(part)
        elif not LOG.match(part):
            prose.append(part)
            lowered.append([w.lower() for w in words])
    if prose:
        stuffed = [0.0] * len(prose)
        # keyword fragments: short segments that share their words with most of the others
        short = [i for i, w in enumerate(lowered) if 1 < len(w) <= 6]
        if len(short) >= 5:
            pairs = Counter(p for i in short for p in {*zip(lowered[i], lowered[i][1:], strict=False)})
            singles = Counter(w for i in short for w in set(lowered[i]) if len(w) >= 4)
            common = {p for p, n in pairs.items() if n >= max(4, len(short) * 0.3)}
            single = {w for w, n in singles.items() if n >= max(5, len(short) * 0.5)}
            for i in short:
                if single & set(lowered[i]) or common & {*zip(lowered[i], lowered[i][1:], strict=False)}:
                    stuffed[i] = 1.0
        # keywords between the words of a text, and bare runs of keywords
        flat = [w for words in lowered for w in words]
        marked = repeated(flat)
        pairs = Counter(zip(flat, flat[1:], strict=False))
        at = 0
        for i, words in enumerate(lowered):
            size = len(words)
            if size and stuffed[i] < 1:
                letters = sum(map(len, words))
                share = sum(len(w) for w, m in zip(words, marked[at : at + size], strict=True) if m) / letters
                if size >= 8 and not ENDS.search(prose[i]) and not any(c in prose[i] for c in ",;()=|{}<>") and not any(w.isdigit() for w in words):
                    again = sum(pairs[p] >= 2 for p in zip(words, words[1:], strict=False)) / (size - 1)
                    share = max(share, 1.0 if again >= 0.5 else 0.0)
                stuffed[i] = max(stuffed[i], share if share >= 0.2 else 0.0)
            at += size
        for i, s in enumerate(stuffed):
            if s:
                shapes["stuffed", f"{min(len(lowered[i]), 12) // 4}"] += s * len(prose[i])
    return sum(shapes.values()) / total


def spam_pages(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and share of every text.

    Null, empty and blank texts have share 0. Each row is judged by its own text alone, so
    repeated rows repeat, ties cannot arise and no row is shuffled; other columns are not read.
    """
    schema = schema_with(texts, key, "share double")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shares = [spam_share(t) if t else 0.0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shares, pa.float64())], names=[key, "share"])

    return texts.select(key, text).mapInArrow(judge, schema)


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    judged = spam_pages(table(spark, folder, "documents"))
    return judged.where(judged.share > SHARE).select("doc_id").distinct()


QUERIES = {"p9_found": p9_found}
SQL: dict[str, str] = {}
