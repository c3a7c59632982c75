"""Repair of text extracted from scanned pages (problem 1).

Misread words are corrected by a noisy channel. Word and bigram counts of the whole scanned
corpus give the language model; a table of character confusions, whose probabilities are
estimated from the corpus as well, gives the channel; the words of a line with their candidates
form a lattice that Viterbi decodes. Broken words are told from compounds by the same counts.
Running headers are lines at page edges whose skeleton (without page number, confusable
characters folded) comes back on other pages of the asset.

Nothing that grows with the corpus is sent to the workers: a Bloom filter of fixed size picks
the lines that hold a suspicious word, and counts are brought to them by joins.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm import bloom
from siltstone.session import cut_lineage
from siltstone.tables import table

SYMBOLS = "|€†¢§@!$£"
TOKEN = re.compile(rf"[\w|€†¢](?:[\w{re.escape(SYMBOLS)}]*[\w|€†¢])?")
COMPOUND = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)+")
HYPHENS = "-‐¬\xad"
BREAK = re.compile(rf"([^\W_]+)([{HYPHENS}])[ \t]*$")
FIRST_WORD = re.compile(r"\f?[ \t]*((?:[^\W_]|[|€†¢ſ§@!])+)")

#: What is read (left) for what was printed (right).
CONFUSIONS = {
    "|": ("l", "i"), "1": ("l", "i"), "!": ("i", "l"), "l": ("i", "t"), "i": ("l", "t"), "0": ("o",), "o": ("c", "a"), "5": ("s",), "$": ("s",), "§": ("s",), "ſ": ("s", "f"),
    "€": ("e",), "c": ("e", "o"), "e": ("c",), "@": ("a",), "a": ("o",), "6": ("b",), "8": ("b",), "9": ("g",), "q": ("g",), "g": ("q",), "†": ("t",), "7": ("t",), "¢": ("c",), "£": ("e",),
    "4": ("a",), "2": ("z",), "3": ("e",), "f": ("t",), "t": ("f", "l"), "h": ("b", "li"), "b": ("h",), "v": ("y",), "y": ("v",),
    "rn": ("m",), "m": ("rn", "in"), "nn": ("m",), "in": ("m",), "li": ("h",), "cl": ("d",), "d": ("cl",), "ri": ("n",), "n": ("ri",), "ii": ("u",), "u": ("ii",), "vv": ("w",), "w": ("vv",), "fi": ("h",), "tl": ("d",),
}
#: Characters that cannot stand in a word and must be explained by the channel.
FOREIGN = frozenset("|€†¢§@!$£0123456789ſ")
MAX_EDITS = 2
MAX_FOREIGN = 8
#: A word is suspicious when a word one confusion away is this many times as frequent.
RATIO = 20
#: Share of words that are read wrongly, before the corpus says how it is spread over the confusions.
ERROR_RATE = 0.02
KAPPA = 0.5
UNSEEN = 0.05
#: Up to so many times the count that the channel predicts, a word is taken for misreadings of its candidates.
EXPLAINED = 10.0
IMPOSSIBLE = -20.0
FLUSH = 200_000

ROMAN = r"[ivxlc]{1,7}"
NUMBER = rf"(?:\d{{1,4}}|{ROMAN})"
PAGE_SURE = re.compile(
    rf"(?:[-–—]\s?{NUMBER}\s?[-–—]|\[{NUMBER}\]|\({NUMBER}\)|\d{{1,4}}\s?/\s?\d{{1,4}}|(?:p\.|pp\.|pg\.?|page|seite|s\.|página|pág\.|blatt)\s?{NUMBER}(?:\s?(?:of|von|de|sur|/)\s?\d{{1,4}})?|{NUMBER}\s(?:of|von|de|sur)\s\d{{1,4}})", re.I
)
PAGE_BARE = re.compile(rf"(?:\d{{1,4}}|{ROMAN})")
PAGE_SIDE = rf"(?:(?:p\.|page|seite|s\.)\s?)?(?:{NUMBER}|[-–—]\s?{NUMBER}\s?[-–—]|\d{{1,4}}\s?/\s?\d{{1,4}})"
SIDE = re.compile(rf"(?:(?P<left>{PAGE_SIDE})\s{{2,}}(?P<a>\S.*\S))|(?:(?P<b>\S.*?\S)\s{{2,}}(?P<right>{PAGE_SIDE}))", re.I)
LABEL = re.compile(r"[^\W\d_]+:?")
LONGEST_NUMBER = 24
FULL = 0.88  # of the widest line: a line of running text
EDGE = 2  # so many non-blank lines from the start and the end of a page can be headers or footers


# ---------------------------------------------------------------- one chunk


@dataclass
class Page:
    """The lines of a chunk and what its layout shows."""

    lines: list[str]
    page_lines: set[int]  # lines that are a page number
    sides: set[int]  # lines with a page number beside a title
    titles: dict[int, str]  # candidates for headers: line -> skeleton
    breaks: dict[int, tuple[str, str, int, str]]  # line -> left part, hyphen, line and word that go on (-1 and "" at the end)


def fold(text: str) -> str:
    """The skeleton of a line: lower case, confusable characters folded, page number and blanks left out."""
    text = text.strip().lower()
    if (m := SIDE.fullmatch(text)) is not None:
        text = m["a"] or m["b"]
    return re.sub(r"[\W_]+", "", text.translate(FOLDED))


#: Each character as the strokes it may be taken apart into, so that every way of misreading folds alike.
FOLDED = str.maketrans({c: to for to, chars in {"i": "|1!l", "o": "0", "s": "5$§ſ", "c": "€e£¢", "a": "@4", "b": "68", "g": "9q", "t": "†7f", "rri": "m", "ri": "n", "ci": "d", "ii": "hu", "vv": "w"}.items() for c in chars})


def layout(body: str) -> Page:
    lines = [x.rstrip("\r") for x in body.split("\n")]
    filled = [i for i, x in enumerate(lines) if x.strip()]
    place = {i: n for n, i in enumerate(filled)}
    starts = {0, *(place[i] for i in filled if "\f" in lines[i])}  # the places where a page begins
    page_lines: set[int] = set()
    for n, i in enumerate(filled):
        text = lines[i].strip()
        if len(text) > LONGEST_NUMBER:
            continue
        if PAGE_SURE.fullmatch(text):
            page_lines.add(i)
        elif PAGE_BARE.fullmatch(text):
            before = lines[filled[n - 1]].strip() if n and n not in starts else ""
            if n and i and filled[n - 1] == i - 1 and LABEL.fullmatch(before):
                continue  # a cell of a table
            page_lines.add(i)
    edge: set[int] = set()
    borders = sorted(starts) + [len(filled)]
    for a, b in zip(borders, borders[1:], strict=False):
        edge |= set(range(a, min(a + EDGE + 1, b))) | set(range(max(a, b - EDGE - 1), b))
    for n, i in enumerate(filled):
        if i in page_lines:
            edge |= {n - 2, n - 1, n + 1, n + 2}
    sides: set[int] = set()
    titles: dict[int, str] = {}
    width = max((len(lines[i].strip()) for i in filled), default=0)
    for n, i in enumerate(filled):
        text = lines[i].strip()
        if i in page_lines:
            continue
        side = SIDE.fullmatch(text) if "  " in text else None
        core = (side["a"] or side["b"]) if side else text
        words = core.split()
        if len(words) < 2 or core[-1] in ".;:,?!" and core[-1] != "!" or core[-1] in HYPHENS:
            continue
        if not (core[0].isupper() or core[0].isdigit() or core[0] in SYMBOLS):
            continue
        alone = (i == 0 or not lines[i - 1].strip() or "\f" in lines[i]) and (i + 1 == len(lines) or not lines[i + 1].strip())
        if not side and not alone and len(core) > FULL * width and n + 1 < len(filled) and lines[filled[n + 1]].strip()[0].islower():
            continue  # a full line that runs on
        if side or alone or n in edge:
            titles[i] = fold(text)
            if side:
                sides.add(i)
    breaks: dict[int, tuple[str, str, int, str]] = {}
    for n, i in enumerate(filled):
        m = BREAK.search(lines[i]) if lines[i].rstrip()[-1] in HYPHENS else None
        if m is None or any(c.isdigit() for c in m[1]):
            continue
        goes_on, word = -1, ""
        for j in filled[n + 1 : n + 6]:
            if j in page_lines:
                continue
            head = FIRST_WORD.match(lines[j])
            if head and (head[1][0].islower() or head[1].isupper() and m[1].isupper() and j not in titles or head[1][0] in "|€†ſ"):
                goes_on, word = j, head[1]
                break
            if j not in titles:
                break
        if goes_on < 0 and m[2] == "-" and n + 1 < len(filled) and not any(j in titles or j in page_lines for j in filled[n + 1 : n + 2]):
            continue  # a line that ends with a dash and is followed by a new sentence
        breaks[i] = (m[1], m[2], goes_on, word)
    return Page(lines, page_lines, sides, titles, breaks)


def is_word(token: str) -> bool:
    return not token.isdigit() and (len(token) > 1 or token.isalpha())


def tokens_of(page: Page) -> dict[int, list[tuple[int, int, str]]]:
    """Words of each line as (start, end, word); a broken word is one word of the line in which it begins."""
    out: dict[int, list[tuple[int, int, str]]] = {}
    taken = {b[2] for b in page.breaks.values() if b[2] >= 0}
    for i, line in enumerate(page.lines):
        if i in page.page_lines or not line:
            continue
        found = [(m.start(), m.end(), m[0]) for m in TOKEN.finditer(line) if is_word(m[0])]
        if i in taken and found:
            found = found[1:]
        if i in page.breaks and found:
            left, _, j, word = page.breaks[i]
            if j >= 0:
                found[-1] = (found[-1][0], len(line), left + word)
            else:
                found.pop()
        out[i] = found
    return out


def words_of(page: Page) -> dict[int, list[str]]:
    """The words of ``tokens_of`` in lower case, without their places."""
    out: dict[int, list[str]] = {}
    taken = {b[2] for b in page.breaks.values() if b[2] >= 0}
    for i, line in enumerate(page.lines):
        if i in page.page_lines or not line:
            continue
        found = [w for w in TOKEN.findall(line.lower()) if not w.isdigit() and (len(w) > 1 or w.isalpha())]
        if found:
            if i in taken:
                del found[0]
            if i in page.breaks and found:
                left, _, j, word = page.breaks[i]
                if j >= 0:
                    found[-1] = (left + word).lower()
                else:
                    found.pop()
        out[i] = found
    return out


def correctable(word: str) -> bool:
    """Long enough and not a number, a hash or an identifier."""
    digits = sum(c.isdigit() for c in word)
    return 3 <= len(word) <= 40 and digits * 3 <= len(word) and sum(c.isalpha() for c in word) >= 2


def candidates(word: str) -> dict[str, tuple[str, ...]]:
    """What may have been printed where ``word`` was read, with the confusions that explain it."""
    foreign = sum(c in FOREIGN for c in word)
    if foreign > MAX_FOREIGN:
        return {}
    found: dict[str, tuple[str, ...]] = {}

    def go(i: int, made: str, used: tuple[str, ...], free: int) -> None:
        if i == len(word):
            if used and (made not in found or len(used) < len(found[made])):
                found[made] = used
            return
        c = word[i]
        if c not in FOREIGN:
            go(i + 1, made + c, used, free)
        for seen in (c, word[i : i + 2]):
            if len(seen) == 2 and i + 1 >= len(word) or seen == c and len(seen) != 1:
                continue
            cost = 0 if seen in FOREIGN else 1
            if cost <= free:
                for true in CONFUSIONS.get(seen, ()):
                    go(i + len(seen), made + true, (*used, f"{seen}>{true}"), free - cost)

    go(0, "", (), 1 if foreign else MAX_EDITS if len(word) >= 8 else 1)
    return found


# ---------------------------------------------------------------- corpus


def scanned(spark: SparkSession, folder: str) -> DataFrame:
    """chunk_id, version, asset_id and body of the chunks of scanned pages, each as often as delivered."""
    chunks = table(spark, folder, "asset_chunks")
    wanted = (F.col("modality") == "ocr") | F.col("locator").startswith("page:")
    return chunks.where(wanted & F.col("id").isNotNull() & F.col("body").isNotNull()).select(F.col("id").alias("chunk_id"), F.col("updated_at").alias("version"), "asset_id", "body")


def ngram_counts(pages: DataFrame) -> DataFrame:
    """a, b and n: counts of words (b is empty) and of pairs of neighbours, over all lines of the distinct bodies; a copied page counts once."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        single: Counter = Counter()
        double: Counter = Counter()

        def rows() -> pd.DataFrame:
            out = pd.DataFrame([*((a, "", n) for a, n in single.items()), *((a, b, n) for (a, b), n in double.items())], columns=["a", "b", "n"])
            single.clear()
            double.clear()
            return out

        for batch in batches:
            for body in batch["body"]:
                page = layout(body)
                stream = []
                for i, words in words_of(page).items():
                    cut = page.breaks.get(i)
                    if words and cut is not None and cut[1] == "-" and cut[2] >= 0:
                        words.pop()  # whether it is one word is what the counts shall tell
                    stream += words
                    if "-" in page.lines[i]:
                        for word in COMPOUND.findall(page.lines[i].lower()):
                            single[word] += 1
                            single[word.partition("-")[0] + "-"] += 1
                single.update(stream)
                double.update(zip(stream, stream[1:], strict=False))
                if len(double) > FLUSH or len(single) > FLUSH:
                    yield rows()
        yield rows()

    once = pages.groupBy(F.sha2("body", 256).alias("h")).agg(F.first("body").alias("body"))
    counted = once.select("body").mapInPandas(count, "a string, b string, n long")
    return counted.groupBy("a", "b").agg(F.sum("n").alias("n"))


def suspicious(words: DataFrame) -> DataFrame:
    """word, n, and its candidates (cand, m, how) that are far more frequent; all of them for a word with a foreign character, whose frequency proves nothing."""

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(w, n, c, "\t".join(how)) for w, n in zip(batch["word"], batch["n"], strict=True) if correctable(w) for c, how in candidates(w).items()]
            yield pd.DataFrame(rows, columns=["word", "n", "cand", "how"])

    made = words.mapInPandas(expand, "word string, n long, cand string, how string")
    known = words.select(F.col("word").alias("cand"), F.col("n").alias("m"))
    foreign = F.col("word").rlike(f"[{re.escape(''.join(sorted(FOREIGN)))}]")
    return made.join(known, "cand").where(foreign | (F.col("m") >= RATIO * F.col("n")))


def channel(pairs: DataFrame) -> dict[str, float]:
    """Log probability of each confusion, estimated from the words that have one explanation with one confusion; as many entries as the table of confusions."""
    single = pairs.where(~F.col("how").contains("\t") & (F.col("m") >= RATIO * F.col("n")))
    sure = single.groupBy("word").agg(F.count(F.lit(1)).alias("k"), F.max("n").alias("n"), F.max("how").alias("how")).where("k = 1")
    seen = {r["how"]: r["n"] for r in sure.groupBy("how").agg(F.sum("n").alias("n")).collect()}
    total = sum(seen.values())
    kinds = [f"{s}>{t}" for s, ts in CONFUSIONS.items() for t in ts]
    return {k: math.log(ERROR_RATE * (seen.get(k, 0) + 1) / (total + len(kinds))) for k in kinds}


FOUND = """chunk_id string, version timestamp_ntz, asset_id string, page_no boolean, cut boolean,
dashes array<struct<joined:string,compound:string>>, titles array<struct<line:int,skeleton:string>>, lines array<struct<line:int,words:array<string>,flags:array<boolean>>>"""


def inspect(pages: DataFrame, flags: bytes) -> DataFrame:
    """One row per delivery: what the layout shows and the lines that hold suspicious words."""
    shared = pages.sparkSession.sparkContext.broadcast(flags)
    fields = ["chunk_id", "version", "asset_id", "page_no", "cut", "dashes", "titles", "lines"]

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        member = bloom.Member(shared.value)
        for batch in batches:
            rows = []
            for name, version, asset, body in zip(batch["chunk_id"], batch["version"], batch["asset_id"], batch["body"], strict=True):
                page = layout(body)
                cut = False
                dashes, lines = [], []
                for left, hyphen, j, word in page.breaks.values():
                    if hyphen != "-":
                        cut = True
                    elif j >= 0:
                        dashes.append({"joined": (left + word).lower(), "compound": f"{left}-{word}".lower()})
                    else:
                        dashes.append({"joined": "", "compound": f"{left}-".lower()})
                streams = [(i, words) for i, words in words_of(page).items() if words]
                for n, (i, words) in enumerate(streams):
                    hits = [member(w) and correctable(w) for w in words]
                    if any(hits):  # with the last word of the line before and the first of the next as context
                        before = streams[n - 1][1][-1] if n else ""
                        after = [streams[n + 1][1][0]] if n + 1 < len(streams) else []
                        lines.append({"line": i, "words": [before, *words, *after], "flags": [False, *hits, *[False for _ in after]]})
                titles = [{"line": i, "skeleton": s} for i, s in page.titles.items()]
                rows.append((name, version, asset, bool(page.page_lines or page.sides), cut, dashes, titles, lines))
            yield pd.DataFrame(rows, columns=fields)

    looked = pages.mapInPandas(look, FOUND)
    rest = [f for f in fields if f not in ("chunk_id", "version")]
    return looked.groupBy("chunk_id").agg(F.max(F.struct("version", *rest)).alias("l")).select("chunk_id", *[f"l.{f}" for f in rest])


def headers(found: DataFrame) -> DataFrame:
    """chunk_id and line of each header: its skeleton stands on at least two pages of the asset."""
    titles = found.select("chunk_id", "asset_id", F.explode("titles").alias("t")).select("chunk_id", "asset_id", "t.line", "t.skeleton").where(F.length("skeleton") > 4)
    often = titles.groupBy("asset_id", "skeleton").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("asset_id", "skeleton")
    return titles.join(often, ["asset_id", "skeleton"], "left_semi").select("chunk_id", "line", "skeleton")


# ---------------------------------------------------------------- decoding


def viterbi(words: list[str], options: dict[int, list[tuple[str, float, float]]], pairs: dict[tuple[str, str], int], total: float) -> list[str]:
    """The likeliest words of a line. options: by position (candidate, log channel, count); other words are certain."""
    best: list[tuple[float, list[str]]] = [(0.0, [])]
    before: list[tuple[str, float]] = [("", 1.0)]
    for i, word in enumerate(words):
        states = options.get(i) or [(word, 0.0, 0.0)]
        made = []
        for cand, emit, count in states:
            prior = math.log((count + UNSEEN) / total) if i in options else 0.0
            scores = []
            for (score, path), (left, left_count) in zip(best, before, strict=True):
                seen = pairs.get((left, cand), 0) if left else 0
                scores.append((score + (math.log((seen + KAPPA) / (left_count + 1000 * KAPPA)) if left else 0.0), path))
            score, path = max(scores, key=lambda s: s[0])
            made.append((score + emit + prior, [*path, cand]))
        best = made
        before = [(cand, count if i in options else 1.0) for cand, _, count in states]
    return max(best, key=lambda s: s[0])[1]


OPTION = "struct<at:int,cand:string,emit:double,count:double>"
CHANGES = T.ArrayType(T.StructType([T.StructField("at", T.IntegerType()), T.StructField("word", T.StringType()), T.StructField("cand", T.StringType())]))
PAIRS = T.ArrayType(T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.StringType())]))


@F.pandas_udf(PAIRS)
def lattice_pairs(words: pd.Series, options: pd.Series) -> pd.Series:
    """The neighbouring pairs of a line's lattice that touch an uncertain position."""
    out = []
    for line, found in zip(words, options, strict=True):
        at: dict[int, set[str]] = {}
        for o in found:
            at.setdefault(o["at"], {line[o["at"]]}).add(o["cand"])
        pairs = set()
        for i in range(len(line) - 1):
            if i in at or i + 1 in at:
                pairs |= {(a, b) for a in at.get(i, {line[i]}) for b in at.get(i + 1, {line[i + 1]})}
        out.append([{"a": a, "b": b} for a, b in pairs])
    return pd.Series(out)


def decoder(total: float):
    """A function of lines, options and pair counts that gives the changed words."""

    @F.pandas_udf(CHANGES)
    def decode(words: pd.Series, options: pd.Series, pairs: pd.Series) -> pd.Series:
        out = []
        for line, found, seen in zip(words, options, pairs, strict=True):
            line = list(line)
            states: dict[int, list[tuple[str, float, float]]] = {}
            for o in found:
                states.setdefault(o["at"], []).append((o["cand"], o["emit"], o["count"]))
            counts = {(p["a"], p["b"]): p["n"] for p in (seen if seen is not None else []) if p["n"]}
            best = viterbi(line, states, counts, total)
            out.append([{"at": i - 1, "word": a, "cand": b} for i, (a, b) in enumerate(zip(line, best, strict=True)) if a != b])
        return pd.Series(out)

    return decode


def corrections(found: DataFrame, pairs: DataFrame, counts: DataFrame, words: DataFrame) -> DataFrame:
    """chunk_id, line and the changed words (position among the line's words, as read, as corrected)."""
    chance = channel(pairs)
    total = float(words.agg(F.sum("n")).first()[0] or 1)
    weights = F.create_map(*[x for k, v in chance.items() for x in (F.lit(k), F.lit(v))])
    emit = F.aggregate(F.split("how", "\t"), F.lit(0.0), lambda acc, h: acc + F.element_at(weights, h))
    option = F.struct(F.col("cand").alias("cand"), emit.alias("emit"), F.col("m").cast("double").alias("count"))
    table_ = pairs.groupBy("word").agg(F.max("n").alias("n"), F.collect_list(option).alias("cands"))
    key = ["chunk_id", "line"]
    lines = found.select("chunk_id", F.explode("lines").alias("l")).select("chunk_id", "l.line", "l.words", "l.flags")
    at = lines.select(*key, F.posexplode("words").alias("at", "word"), "flags").where(F.col("flags")[F.col("at")]).select(*key, "at", "word")
    known = at.join(table_, "word")
    # as a word of its own a suspicious word counts by what the channel does not explain
    explained = F.aggregate("cands", F.lit(0.0), lambda acc, c: acc + c["count"] * F.exp(c["emit"]))
    alone = F.greatest(F.col("n") - 1 - EXPLAINED * explained, F.lit(0.0))
    kept = F.when(F.col("word").rlike(f"[{re.escape(SYMBOLS)}ſ]"), IMPOSSIBLE).otherwise(math.log(1 - ERROR_RATE))
    itself = F.array(F.struct(F.col("word").alias("cand"), kept.alias("emit"), alone.alias("count")))
    options = known.select(*key, "at", F.explode(F.concat(itself, "cands")).alias("o")).groupBy(*key).agg(F.collect_list(F.struct("at", "o.cand", "o.emit", "o.count")).alias("options"))
    lattice = cut_lineage(lines.select(*key, "words").join(options, key))
    wanted = lattice.select(*key, F.explode(lattice_pairs("words", "options")).alias("p")).select(*key, "p.a", "p.b")
    bigrams = counts.where("b <> ''")
    seen = wanted.join(bigrams, ["a", "b"]).groupBy(*key).agg(F.collect_list(F.struct("a", "b", "n")).alias("pairs"))
    decoded = lattice.join(seen, key, "left").select(*key, decoder(total)("words", "options", "pairs").alias("changes"))
    return decoded.where(F.size("changes") > 0)


@dataclass
class Repair:
    """Everything known about the scanned pages of a folder."""

    found: DataFrame
    headers: DataFrame
    changes: DataFrame
    words: DataFrame


def analyse(pages: DataFrame) -> Repair:
    counts = cut_lineage(ngram_counts(pages))
    words = counts.where("b = ''").select(F.col("a").alias("word"), "n")
    pairs = cut_lineage(suspicious(words))
    flags = bloom.build(pairs.select("word").distinct(), "word")
    found = cut_lineage(inspect(pages, flags))
    return Repair(found, headers(found), corrections(found, pairs, counts, words), words)


def broken(found: DataFrame, words: DataFrame) -> DataFrame:
    """chunk_id of the chunks with a word cut in two: other hyphens are sure, a dash is weighed against the compound."""
    dashes = found.select("chunk_id", F.explode("dashes").alias("d")).select("chunk_id", F.col("d.joined").alias("joined"), F.col("d.compound").alias("compound"))
    forms = dashes.select(F.explode(F.array("joined", "compound")).alias("word")).distinct()
    known = forms.join(words, "word")
    one = known.select(F.col("word").alias("joined"), F.col("n").alias("n_joined"))
    two = known.select(F.col("word").alias("compound"), F.col("n").alias("n_compound"))
    weighed = dashes.join(one, "joined", "left").join(two, "compound", "left")
    cut = F.coalesce("n_joined", F.lit(0)) >= F.coalesce("n_compound", F.lit(0))
    return found.where("cut").select("chunk_id").unionByName(weighed.where(cut).select("chunk_id")).distinct()


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Null bodies and chunks of other kinds have no rows; a repeated delivery counts as delivered last."""
    all_ = analyse(scanned(spark, folder))
    kinds = [
        broken(all_.found, all_.words).withColumn("kind", F.lit("hyphen")),
        all_.changes.select("chunk_id").distinct().withColumn("kind", F.lit("misread")),
        all_.headers.select("chunk_id").distinct().withColumn("kind", F.lit("header")),
        all_.found.where("page_no").select("chunk_id").distinct().withColumn("kind", F.lit("page_no")),
    ]
    found = kinds[0]
    for more in kinds[1:]:
        found = found.unionByName(more)
    return found.distinct()


# ---------------------------------------------------------------- repaired text


def as_written(word: str, like: str) -> str:
    letters = [c for c in like if c.isalpha()]
    if len(letters) > 1 and all(c.isupper() for c in letters):
        return word.upper()
    return word[:1].upper() + word[1:] if like[:1].isupper() else word


def repaired(body: str, drop: set[int], changes: dict[tuple[int, int], str], compounds: set[str]) -> str:
    """The body without headers and page numbers, words joined and corrected, lines joined into paragraphs."""
    page = layout(body)
    words = tokens_of(page)
    heads: dict[int, int] = {}
    text: dict[int, str] = {}
    for i, line in enumerate(page.lines):
        out, last = [], 0
        for n, (start, end, word) in enumerate(words.get(i, [])):
            fixed = changes.get((i, n))
            fixed = None if fixed is None else as_written(fixed, word)
            cut = page.breaks.get(i)
            if end == len(line) and cut is not None and cut[2] >= 0 and n == len(words[i]) - 1:
                whole = fixed or (f"{cut[0]}-{cut[3]}" if cut[1] == "-" and f"{cut[0]}-{cut[3]}".lower() in compounds else word)
                out += [line[last:start], whole]
                head = FIRST_WORD.match(page.lines[cut[2]])
                heads[cut[2]] = head.end()
                last = len(line)
            elif fixed is not None:
                out += [line[last:start], fixed]
                last = end
        text[i] = "".join([*out, line[last:]])
        if i in heads and out == []:
            text[i] = line[heads[i] :]
        elif i in heads:
            gone = len(line[: heads[i]])
            text[i] = text[i][gone:] if text[i].startswith(line[:gone]) else text[i]
    paragraphs: list[str] = []
    fresh = True
    for i in range(len(page.lines)):
        if i in drop or i in page.page_lines:
            continue
        line = text[i].replace("\f", " ").replace("\xad", "").strip()
        if not line:
            fresh = fresh or not page.lines[i].strip()
            continue
        goes_on = paragraphs and not re.search(r"[.!?:;。！？][\"')\]]*$", paragraphs[-1]) and (line[0].islower() or line[0] in ",.;:)")
        if paragraphs and (not fresh or goes_on):
            glue = "" if line[0] in ",.;:)?!" else " "
            paragraphs[-1] += glue + line
        else:
            paragraphs.append(line)
        fresh = False
    return "\n\n".join(re.sub(r"[ \t]{2,}", " ", p) for p in paragraphs)


@F.pandas_udf(T.StringType())
def repair(body: pd.Series, drop: pd.Series, changes: pd.Series, compounds: pd.Series) -> pd.Series:
    out = []
    for b, d, c, k in zip(body, drop, changes, compounds, strict=True):
        fixed = {(x["line"], x["at"]): x["cand"] for x in (c if c is not None else [])}
        out.append(repaired(b, set(d if d is not None else []), fixed, set(k if k is not None else [])))
    return pd.Series(out)


def p1_text(spark: SparkSession, folder: str) -> DataFrame:
    """chunk_id and the body of each chunk of scanned pages as continuous, readable paragraphs."""
    pages = scanned(spark, folder)
    all_ = analyse(pages)
    last = pages.groupBy("chunk_id").agg(F.max(F.struct("version", "body")).alias("l")).select("chunk_id", F.col("l.body").alias("body"))
    drop = all_.headers.groupBy("chunk_id").agg(F.collect_set("line").alias("drop"))
    changes = all_.changes.select("chunk_id", "line", F.explode("changes").alias("c")).groupBy("chunk_id").agg(F.collect_list(F.struct("line", "c.at", "c.cand")).alias("changes"))
    compounds = all_.found.select("chunk_id", F.explode("dashes").alias("d")).select("chunk_id", F.col("d.compound").alias("word")).join(all_.words, "word", "left_semi").groupBy("chunk_id").agg(F.collect_set("word").alias("compounds"))
    whole = last.join(drop, "chunk_id", "left").join(changes, "chunk_id", "left").join(compounds, "chunk_id", "left")
    return whole.select("chunk_id", repair("body", "drop", "changes", "compounds").alias("body"))


QUERIES = {"p1_found": p1_found, "p1_text": p1_text}
SQL: dict[str, str] = {}
