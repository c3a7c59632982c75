"""Personal information in free text, replaced by typed placeholders (problem 4).

E-mail addresses, phone numbers, identity numbers and street addresses are told by their form
and label. Persons' names have no form of their own, in any case or order; they are found by
what the corpus gives away. The parts of mail addresses and of the display names before them
are protected terms. For each of them the corpus tells how many bits it discloses,

    bits(t) = log2( P(t | part of a protected identity) / P(t | word of the texts) ),

over texts that each count once, however often they were delivered or copied. A role mailbox
such as records.desk always pairs the same two words and holds the word of a role. Terms above
the threshold that are no part of a role mailbox form the lexicon of given and family names; the texts are then searched for sequences of them.

What is found protects little where other words give the same entity away. A term therefore is
disclosing when the texts that hold it nearly always hold one and the same protected entity near
it: P(entity | term) and the bits log2(P(entity | term) / P(entity)) are estimated from
co-occurrence over distinct texts. ``p4_disclosing`` lists such terms, and ``p4_sanitised``
generalises them besides the mentions; ``p4_text`` replaces the mentions only.

Lexicon and disclosing terms may grow with the corpus, so they are never sent around: workers
get a Bloom filter of bounded size, and what passes it is checked by a join with the terms.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm import bloom
from siltstone.session import cut_lineage
from siltstone.tables import table

MIN_BITS = 2.0
#: A name with so many partners is no role mailbox, whatever its words.
MIN_PARTNERS = 2
#: A term counts as standing with an entity within so many words of its mention.
NEAR = 8
#: A term discloses an entity that stands near it in this share of its texts, in so many texts at least, with so many bits.
DISCLOSED, DISCLOSED_TEXTS, DISCLOSED_BITS = 0.8, 3, 4.0
#: Words of role mailboxes.
ROLES = frozenset("abuse accounts admin administrator alerts archive billing board bot booking careers compliance contact customer data deploy desk dev finance front help helpdesk hostmaster hr info inquiries it jobs legal list mail mailbox marketing news newsletter noreply notifications office operations ops orders postmaster press privacy project records registry release reply reports reservations sales security service services support system team tech training updates webmaster".split())
#: Counters and caches of a worker are emptied at this size; their partial counts are added up later.
FLUSH = 200_000

LETTER = r"[^\W\d_]"
#: Between the words of a mention: blanks, one line end, and the marks that quoted lines begin with.
GAP = r"(?:[ \t\xa0]+|[ \t\xa0]*\r?\n[ \t>|#/*\xa0-]*)"
WORD = re.compile(rf"{LETTER}+(?:[-‐¬\xad][ ]?\n{LETTER}+)?")

_DOT = r"(?:\.|\s?[\[({]\s?dot\s?[\])}]\s?)"
_LOCAL = rf"[A-Za-z0-9_%+-]+(?:{_DOT}[A-Za-z0-9_%+-]+)*"
AT = re.compile(r"[@\[({<](?:(?<=@)(?!\s)|(?<!@)\s?(?:at|@)\s?[\])}>]\s?)", re.I)
LOCAL_END = re.compile(rf"(?<![\w%+.@/-])({_LOCAL})$", re.I)
DOMAIN = re.compile(rf"[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)*?{_DOT}[A-Za-z]{{2,24}}(?![\w@-])", re.I)

# Each pattern below begins with the characters a match can begin with and looks behind
# afterwards, so that the search can skip ahead.
PHONE = re.compile(
    r"[+(\d](?<![\w+.,/-].)(?<!\d:.)(?:"
    r"(?<=\+)\d{1,3}[ .-]?(?:\(0\))?(?:[ .-]?\(?\d{1,5}\)?)(?:[ .\-/]?\d{2,8}){1,5}"
    r"|(?<=\()\d{2,5}\)[ .-]?\d{3,4}[ .-]?\d{3,5}"
    r"|(?<=[2-9])\d{2}([-.])\d{3}\1\d{4}"
    r"|(?<=0)\d(?:([ .])\d\d)(?:\2\d\d){3}"
    r"|(?<=0)\d{2,4}[ /-]\d{3,6}[ -]\d{2,5}"
    r"|(?<=0)\d{2,4}/\d{4,8}"
    r")(?![\w]|[.,:/-]\d)"
)

#: Labels of personal numbers given by a state (short ones in capitals only), and the forms of the numbers.
ID_WORDS = "security insurance steuer tax sozialversicherung fiscal sécurité passport reisepass passeport pasaporte card personalausweis identité licence license führerschein permis pesel".split()
ID_SHORT = "SSN NINO NI PESEL DNI NIE NIF CPF BSN AHV TIN".split()
ID_LABELS = (
    r"(?:SSN|ssn|NINO|NI (?:number|no\.?)|DNI|NIE|NIF|CPF|BSN|AHV(?:-Nr\.?)?|I?TIN)|(?i:pesel|social security(?: (?:number|no\.?|nr\.?|#))?|national insurance(?: (?:number|no\.?))?"
    r"|steuer-?\s?id(?:entifikationsnummer)?|steuernummer|tax (?:id|number|no\.?)|sozialversicherungsnummer|numéro fiscal|(?:numéro|n°) de sécurité sociale"
    r"|passport|reisepass|passeport|pasaporte|id card|identity card|personalausweis|carte d'identité|driving licen[cs]e|driver'?s? licen[cs]e|führerschein|permis de conduire|permiso de conducir)"
).replace(" ", r"[\s>|]+")
ID_FORMS = (
    r"\d{3}[- ]\d{2}[- ]\d{4}|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]|\d{2} \d{3} \d{3} \d{3}|\d{8}-?[A-Z]|[XYZ]-?\d{7}-?[A-Z]"
    r"|[A-Z]{1,3}-\d{3,5}-\d{4,6}|[A-Z]{1,3}\d{3} \d{4}|[A-Z]{1,3}\d{5,9}|\d{9,11}|[A-Z]{5}\d{6}[A-Z0-9]{5}|[A-Z0-9]{9,10}(?<=\d)"
)
ID = re.compile(rf"\b(?:{ID_LABELS})(?:{GAP}(?i:no\.?|number|nr\.?|n°|num\.?|is|card))*\s?[:#=]?(?:{GAP})?({ID_FORMS})(?![\w]|-\w)")
ID_BARE = re.compile(r"[Q\d](?<![\w-].)(?:(?<=Q)Q ?\d{2} ?\d{2} ?\d{2} ?[A-D]|\d\d-\d{2}-\d{4})(?![\w-])")

#: Words of street names.
STREETS_EN = r"(?i:street|avenue|road|lane|drive|court|close|square|terrace|crescent|gardens?|boulevard|highway|parkway|walk|row|hill|place|way|mews|grove|rise)|(?:St|Ave|Rd|Ln|Dr|Ct|Cl|Sq|Blvd|Hwy|Pkwy|Pl)\b\.?|(?:ST|AVE|RD|LN|DR|CT|SQ|BLVD)\b\.?"
STREETS_FR = r"(?i:rue|avenue|boulevard|impasse|place|chemin|quai|allée|cours|route|passage)"
STREETS_ES = frozenset("Calle C/ Avenida Avda Avda. Plaza Paseo Camino Ronda Travesía Carrera".split())
STREETS_DE = tuple("straße strasse str. weg gasse allee platz ring ufer damm steig pfad chaussee".split())
AREAS_DE = frozenset("Am Im Zum Zur An Auf Unter Hinter".split())
BOXES = frozenset("box postfach apartado correos postale".split())
HOUSE = re.compile(r"\d(?<![\w/.,:#-]\d)\d{0,3}(?!\d|[.,:/]\d|-)")
AFTER = re.compile(
    rf"[a-zA-Z]?(?:{GAP}(?:bis|ter))?,?{GAP}(?:(?:[A-Z][\w'’-]*{GAP}){{1,3}}(?:{STREETS_EN})(?!\w)"
    rf"|{STREETS_FR}{GAP}(?:(?:de la|du|des|de){GAP}|de{GAP}l'|d'|l')?[A-ZÀ-Ý][\w'’-]*(?:{GAP}[A-ZÀ-Ý][\w'’-]*)?)"
)
UNIT = re.compile(r" ?[a-z](?!\w)|")
POSTCODE = re.compile(rf" ?[a-z]?,?{GAP}(?:[A-Z]{{1,2}}-)?\d{{4,5}}{GAP}[A-ZÄÖÜ]")
BEFORE_BOX = re.compile(rf"(?<!\w)(?:[Pp]\.?\s?[Oo]\.?\s?(?i:box)|(?i:post office box|postfach|apartado(?: de correos)?|boîte postale)){GAP}$")
BEFORE_ES = re.compile(rf"(?<!\w)(?:Calle|C/|Avenida|Avda\.?|Plaza|Paseo|Camino|Ronda|Travesía|Carrera){GAP}(?:(?:de la|de los|de las|del|de){GAP})?(?:[A-ZÀ-Ý][\w'’-]*{GAP}){{0,3}}[A-ZÀ-Ý][\w'’-]*,?{GAP}(?:n\.?º\s?)?$")
BEFORE_DE = re.compile(rf"(?<!\w)(?:(?:Alte[rns]?|Neue[rns]?|Große[rns]?|Kleine[rns]?|Obere[rns]?|Untere[rns]?|Lange[rns]?){GAP})?[A-ZÄÖÜ][\wäöüß-]*(?:straße|strasse|str\.|weg|gasse|allee|platz|ring|ufer|damm|steig|pfad|chaussee){GAP}$")
BEFORE_AREA = re.compile(rf"(?<!\w)(?:Am|An der|An den|Auf dem|Auf der|Im|In der|Zum|Zur|Unter den|Hinter der){GAP}[A-ZÄÖÜ][\wäöüß-]+{GAP}$")
STREET_SPAN = 200

TITLES = r"(?:Mrs|Mr|Ms|Miss|Mx|Dr|Prof|Herrn|Herr|Frau|Mme|Mlle|Monsieur|Madame|Sra|Sr|Señora|Señor|Don|Doña|Sir|Lady)\.?"
PARTICLES = r"(?:von der|von dem|von|van der|van den|van|ten|ter|vom|zu|zum|zur|de la|de los|del|de|da|dos|di|du|la|le|al|bin|ben|el)"
GIVEN, FAMILY, BOTH = "\ue000", "\ue001", "\ue002"  # private-use characters that stand for confirmed terms
_G = f"[{GIVEN}{BOTH}]+(?:-[{GIVEN}{BOTH}]+)?"
_F = f"[{FAMILY}{BOTH}]+(?:-[{FAMILY}{BOTH}]+)?"
_I = r"(?<![^\s(\"'<>;:,=\[])[^\W\d_]\."
_FIRST = f"(?:{_G}|{_I})"
_T = rf"(?<!{LETTER})(?<!\d )(?<!\d)(?i:{TITLES})"
PERSON = re.compile(
    rf"(?:{_T}{GAP})?{_FIRST}(?:{GAP}?{_FIRST}){{0,2}}(?:{GAP}(?i:{PARTICLES}))?{GAP}{_F}"
    rf"|{_T}{GAP}(?:(?i:{PARTICLES}){GAP})?{_F}"
    rf"|{_F}(?:,{GAP}?|{GAP}){_FIRST}(?:{GAP}{_I})?"
)
ANGLE = re.compile(r"<[^<>\s]{1,200}@")
DISPLAY = re.compile(rf"(?:(?<!{LETTER})({LETTER}{{2,}}), ({LETTER}{{2,}})\"?,? |(?<!{LETTER})({LETTER}{{2,}}) ({LETTER}{{2,}})\"? )$")
NAME_SPAN = 200
SNIPPET = 24
JOIN = 40
#: The standard allows a local part 64 octets and a path 254; no more can belong to an address.
LOCAL_SPAN = 254


def addresses(text: str) -> Iterator[tuple[int, int, str]]:
    """Span and local part of each mail address, plain or disguised."""
    for at in AT.finditer(text):
        stop = at.start()
        if text[stop] != "@" and stop and text[stop - 1] in " \n\t\xa0":
            stop -= 1
        local = LOCAL_END.search(text, max(0, stop - LOCAL_SPAN), stop)
        domain = local and DOMAIN.match(text, at.end())
        if domain:
            yield local.start(1), domain.end(), local[1]


def streets(text: str) -> Iterator[tuple[int, int]]:
    """Spans of street addresses and boxes: whatever surrounds a house number."""
    for number in HOUSE.finditer(text):
        start, end = number.span()
        if (after := AFTER.match(text, end)) is not None:
            yield start, after.end()
            continue
        words = text[max(0, start - 60) : start].rsplit(None, 5)[-5:]  # a cheap look before the search
        if not words or text[start - 1] not in " \n\xa0\t":
            continue
        last = words[-1]
        begin = max(0, start - STREET_SPAN)
        if last.lower() in BOXES:
            before = BEFORE_BOX.search(text, begin, start)
        elif last.lower().endswith(STREETS_DE):
            before = BEFORE_DE.search(text, begin, start)
        elif STREETS_ES.intersection(words[-5:]):
            before = BEFORE_ES.search(text, begin, start)
        elif last[0].isupper() and AREAS_DE.intersection(words[-3:-1]) and POSTCODE.match(text, end):
            before = BEFORE_AREA.search(text, begin, start)
        else:
            continue
        if before is not None:
            yield before.start(), UNIT.match(text, end).end()


def labelled(text: str) -> bool:
    """Whether any word of the labels of identity numbers occurs; a cheap test before the search."""
    low = text.lower()
    return any(w in low for w in ID_WORDS)


def typed_mentions(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of everything that shows by its form; of overlapping ones the first kind wins."""
    found: list[tuple[str, int, int]] = []
    taken: list[tuple[int, int]] = []

    def add(kind: str, start: int, end: int) -> None:
        if all(end <= a or start >= b for a, b in taken):
            taken.append((start, end))
            found.append((kind, start, end))

    for start, end, _ in addresses(text):
        add("email", start, end)
    if any(w in text for w in ID_SHORT) or labelled(text):
        for m in ID.finditer(text):
            add("id_number", m.start(1), m.end(1))
    for m in ID_BARE.finditer(text):
        add("id_number", m.start(), m.end())
    for start, end in streets(text):
        add("address", start, end)
    for m in PHONE.finditer(text):
        if 7 <= sum(c.isdigit() for c in m[0]) <= 15:
            add("phone", m.start(), m.end())
    return found


def persons(snippet: str, base: int, terms: list[tuple[int, int, bool, bool]]) -> list[tuple[int, int]]:
    """Spans of persons in a snippet; terms are the spans (from the text's start) that the lexicon confirmed."""
    chars = list(snippet)
    for start, end, given, family in terms:
        mark = BOTH if given and family else GIVEN if given else FAMILY
        for i in range(start - base, end - base):
            if 0 <= i < len(chars):
                chars[i] = mark
    return [(base + m.start(), base + m.end()) for m in PERSON.finditer("".join(chars))]


def all_texts(spark: SparkSession, folder: str) -> DataFrame:
    """source_table, record_id, version and text of the three columns, each record as often as it was delivered."""
    episodes = table(spark, folder, "episodes").select(F.lit("episodes").alias("source_table"), F.col("id").alias("record_id"), F.col("updated_at").cast("string").alias("version"), F.col("summary").alias("text"))
    chunks = table(spark, folder, "asset_chunks").select(F.lit("asset_chunks").alias("source_table"), F.col("id").alias("record_id"), F.col("updated_at").cast("string").alias("version"), F.col("body").alias("text"))
    mails = table(spark, folder, "parsed_email").select(F.lit("parsed_email").alias("source_table"), F.col("export_id").alias("record_id"), F.lpad(F.col("exported_at_epoch").cast("string"), 20, "0").alias("version"), F.col("text_body").alias("text"))
    return episodes.unionByName(chunks).unionByName(mails).where(F.col("record_id").isNotNull())


def once(texts: DataFrame) -> DataFrame:
    """Each text once; the same text beside another ``of`` (a sender beside another mail) counts again."""
    return texts.where(F.col("text").isNotNull()).groupBy(F.sha2("text", 256).alias("h"), F.sha2(F.coalesce("of", F.lit("")), 256).alias("o")).agg(F.first("text").alias("text")).select("text")


def term_counts(texts: DataFrame) -> DataFrame:
    """Corpus counts: role ``w`` (a word of the texts) or ``p`` (given and family part of a protected identity)."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words: Counter = Counter()
        pairs: Counter = Counter()

        def rows() -> pd.DataFrame:
            out = [("w", w, "", n) for w, n in words.items()] + [("p", g, f, n) for (g, f), n in pairs.items()]
            words.clear()
            pairs.clear()
            return pd.DataFrame(out, columns=["role", "term", "partner", "n"])

        single = re.compile(rf"{LETTER}{{2,}}").findall
        for batch in batches:
            for text in batch["text"]:
                if not text:
                    continue
                words.update(single(text.lower()))
                if "@" in text:
                    for _, _, full in addresses(text):
                        parts = full.lower().partition("+")[0].split(".")
                        if len(parts) == 2 and all(p.isalpha() and len(p) > 1 for p in parts):
                            pairs[parts[0], parts[1]] += 1
                            words.subtract(parts)
                    for angle in ANGLE.finditer(text):
                        m = DISPLAY.search(text, max(0, angle.start() - NAME_SPAN), angle.start())
                        if m is None:
                            continue
                        given, family = (m[2], m[1]) if m[1] else (m[3], m[4])
                        if len(given) > 1 and len(family) > 1:
                            pairs[given.lower(), family.lower()] += 1
                if len(words) > FLUSH:
                    yield rows()
        yield rows()

    counted = texts.where(F.col("text").isNotNull()).select("text").mapInPandas(count, "role string, term string, partner string, n long")
    return counted.groupBy("role", "term", "partner").agg(F.sum("n").alias("n"))


def lexicon(counts: DataFrame, min_bits: float = MIN_BITS, min_partners: int = MIN_PARTNERS) -> DataFrame:
    """term, given, family and bits of the terms that disclose a person."""
    totals = {r["role"]: r["total"] for r in counts.groupBy("role").agg(F.sum("n").alias("total")).collect()}
    total_words, total_pairs = max(1, totals.get("w") or 0), max(1, totals.get("p") or 0)
    pairs = counts.where("role = 'p'")
    role = F.col("term").isin(*ROLES) | F.col("partner").isin(*ROLES)
    given = pairs.groupBy("term").agg(F.sum("n").alias("e"), F.count(F.lit(1)).alias("partners"), F.max(role).alias("mailbox")).withColumn("role", F.lit("given"))
    family = pairs.groupBy(F.col("partner").alias("term")).agg(F.sum("n").alias("e"), F.count(F.lit(1)).alias("partners"), F.max(role).alias("mailbox")).withColumn("role", F.lit("family"))
    words = counts.where("role = 'w'").select("term", F.col("n").alias("seen"))
    bits = F.log2(((F.col("e") + 0.5) / total_pairs) / ((F.greatest(F.coalesce("seen", F.lit(0)), F.lit(0)) + 0.5) / total_words))
    scored = given.unionByName(family).join(words, "term", "left").withColumn("bits", bits)
    kept = scored.where((F.col("bits") >= min_bits) & ((F.col("partners") >= min_partners) | ~F.col("mailbox")))
    return kept.groupBy("term").agg(F.max(F.col("role") == "given").alias("given"), F.max(F.col("role") == "family").alias("family"), F.max("bits").alias("bits"))


FOUND = "source_table string, record_id string, version string, typed array<struct<kind:string,start_at:int,end_at:int>>, clusters array<struct<base:int,snippet:string,terms:array<struct<start_at:int,end_at:int,term:string>>>>"


def search(texts: DataFrame, bits: bytes) -> DataFrame:
    """One row per delivery: mentions told by their form, and snippets around possible names."""
    shared = texts.sparkSession.sparkContext.broadcast(bits)

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        member = bloom.Member(shared.value)

        def possible(word: str) -> bool:
            return len(word) > 1 and member(word.lower())

        def clusters(text: str, typed: list[tuple[str, int, int]]) -> list[dict]:
            hits: list[tuple[int, int, str]] = []
            for m in WORD.finditer(text):
                word = m[0]
                if possible(word):
                    hits.append((m.start(), m.end(), word.lower()))
                elif "\n" in word:
                    joined = re.sub(r"[-‐¬\xad] ?\n", "", word)
                    if possible(joined):
                        hits.append((m.start(), m.end(), joined.lower()))
                    else:
                        for part in re.finditer(rf"{LETTER}+", word):
                            if possible(part[0]):
                                hits.append((m.start() + part.start(), m.start() + part.end(), part[0].lower()))
            if hits and typed:
                spans = [(a, b) for kind, a, b in typed if kind == "email"]
                hits = [h for h in hits if not any(a <= h[0] < b for a, b in spans)]
            out: list[list] = []
            for h in hits:
                if out and h[0] - out[-1][-1][1] <= JOIN:
                    out[-1].append(h)
                else:
                    out.append([h])
            made = []
            for group in out:
                base = max(0, group[0][0] - SNIPPET)
                made.append({"base": base, "snippet": text[base : group[-1][1] + SNIPPET], "terms": [{"start_at": a, "end_at": b, "term": t} for a, b, t in group]})
            return made

        for batch in batches:
            typed = [typed_mentions(t) if t else [] for t in batch["text"]]
            yield pd.DataFrame(
                {
                    "source_table": batch["source_table"],
                    "record_id": batch["record_id"],
                    "version": batch["version"],
                    "typed": [[{"kind": k, "start_at": a, "end_at": b} for k, a, b in x] for x in typed],
                    "clusters": [clusters(t, x) if t else [] for t, x in zip(batch["text"], typed, strict=True)],
                }
            )

    return texts.mapInPandas(find, FOUND)


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("start_at", T.IntegerType()), T.StructField("end_at", T.IntegerType())])))
def person_spans(base: pd.Series, snippet: pd.Series, terms: pd.Series) -> pd.Series:
    out = []
    for b, s, t in zip(base, snippet, terms, strict=True):
        out.append([{"start_at": x, "end_at": y} for x, y in persons(s, b, [(r["start_at"], r["end_at"], r["given"], r["family"]) for r in t])])
    return pd.Series(out)


def mentions(texts: DataFrame, names: DataFrame) -> DataFrame:
    """source_table, record_id, kind, start_at and end_at of every mention in each record as delivered last.

    Null and empty texts mention nothing. Repeated deliveries count once; of deliveries equal in
    time the one greatest in its findings is kept. Mentions never overlap those found by form.
    """
    found = search(texts, bloom.build(names))
    last = found.groupBy("source_table", "record_id").agg(F.max(F.struct("version", "typed", "clusters")).alias("l")).select("source_table", "record_id", "l.typed", "l.clusters")
    last = cut_lineage(last)  # both branches below read it
    keys = ["source_table", "record_id"]
    typed = last.select(*keys, F.explode("typed").alias("m")).select(*keys, "m.kind", "m.start_at", "m.end_at")
    snippets = last.select(*keys, F.explode("clusters").alias("c")).select(*keys, "c.base", "c.snippet", "c.terms")
    tokens = snippets.select(*keys, "base", "snippet", F.explode("terms").alias("t")).select(*keys, "base", "snippet", "t.start_at", "t.end_at", "t.term")
    sure = tokens.join(names.select("term", "given", "family"), "term")
    grouped = sure.groupBy(*keys, "base", "snippet").agg(F.collect_list(F.struct("start_at", "end_at", "given", "family")).alias("terms"))
    people = grouped.select(*keys, F.explode(person_spans("base", "snippet", "terms")).alias("m")).select(*keys, F.lit("person").alias("kind"), "m.start_at", "m.end_at")
    return typed.unionByName(people).distinct()


def personal_mentions(spark: SparkSession, folder: str) -> DataFrame:
    texts = all_texts(spark, folder)
    senders = table(spark, folder, "parsed_email").select(F.col("sender").alias("text"), F.col("text_body").alias("of"))
    counts = cut_lineage(term_counts(once(texts.select("text", F.lit("").alias("of")).unionByName(senders))))
    return mentions(texts, cut_lineage(lexicon(counts)))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return personal_mentions(spark, folder).select("source_table", "record_id", "kind", "start_at").distinct()


@F.pandas_udf(T.StringType())
def masked(text: pd.Series, spans: pd.Series) -> pd.Series:
    out = []
    for t, s in zip(text, spans, strict=True):
        if t is None or s is None or not len(s):
            out.append(t)
            continue
        pieces, at = [], 0
        for m in sorted(s, key=lambda m: (m["start_at"], -m["end_at"])):
            if m["start_at"] >= at:
                pieces += [t[at : m["start_at"]], f"[{m['kind'].upper()}]"]
                at = m["end_at"]
        out.append("".join([*pieces, t[at:]]))
    return pd.Series(out)


def p4_text(spark: SparkSession, folder: str) -> DataFrame:
    """The three texts with each mention replaced by ``[KIND]``, everything else kept."""
    found = personal_mentions(spark, folder).groupBy("source_table", "record_id").agg(F.collect_list(F.struct("kind", "start_at", "end_at")).alias("spans"))
    texts = all_texts(spark, folder)
    last = texts.groupBy("source_table", "record_id").agg(F.max(F.struct("version", "text")).alias("l")).select("source_table", "record_id", F.col("l.text").alias("text"))
    return last.join(found, ["source_table", "record_id"], "left").select("source_table", "record_id", masked("text", "spans").alias("text"))


def last_with_spans(spark: SparkSession, folder: str) -> DataFrame:
    """source_table, record_id, text and spans (null without any) of every record as delivered last."""
    found = personal_mentions(spark, folder).groupBy("source_table", "record_id").agg(F.collect_list(F.struct("kind", "start_at", "end_at")).alias("spans"))
    last = all_texts(spark, folder).groupBy("source_table", "record_id").agg(F.max(F.struct("version", "text")).alias("l")).select("source_table", "record_id", F.col("l.text").alias("text"))
    return cut_lineage(last.join(found, ["source_table", "record_id"], "left"))


def free_words(text: str, spans: list) -> list[tuple[int, int, str]]:
    """(start, end, word in lower case) of the words outside the spans."""
    ordered = sorted((m["start_at"], m["end_at"]) for m in spans)
    out, at = [], 0
    for m in re.finditer(rf"{LETTER}{{3,}}", text):
        while at < len(ordered) and ordered[at][1] <= m.start():
            at += 1
        if at == len(ordered) or m.end() <= ordered[at][0]:
            out.append((m.start(), m.end(), m[0].lower()))
    return out


def disclosing_terms(records: DataFrame, share: float = DISCLOSED, texts: int = DISCLOSED_TEXTS, least_bits: float = DISCLOSED_BITS) -> DataFrame:
    """term, kind (of the entity it gives away), seen (texts with the term), together (texts with both near) and bits.

    ``records`` needs text and spans; equal texts count once. Null and empty texts and texts
    without mentions count as texts without entities. Of several entities that a term gives away
    alike, the one of the greatest name is kept.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()

        def rows() -> pd.DataFrame:
            out = pd.DataFrame([(*k, n) for k, n in seen.items()], columns=["term", "entity", "n"])
            seen.clear()
            return out

        for batch in batches:
            for text, spans in zip(batch["text"], batch["spans"], strict=True):
                if not text:
                    continue
                spans = list(spans) if spans is not None else []
                words = free_words(text, spans)
                starts = [w[0] for w in words]
                pairs = {(w, "") for _, _, w in words}
                for m in spans:
                    entity = f"{m['kind']}:{' '.join(text[m['start_at'] : m['end_at']].lower().split())}"
                    at = bisect_left(starts, m["start_at"])
                    pairs.add(("", entity))
                    pairs |= {(w, entity) for _, _, w in words[max(0, at - NEAR) : at + NEAR]}
                seen.update(pairs)
                seen["", ""] += 1
                if len(seen) > FLUSH:
                    yield rows()
        yield rows()

    once_ = records.where(F.col("text").isNotNull()).groupBy(F.sha2("text", 256).alias("h")).agg(F.first("text").alias("text"), F.first("spans").alias("spans"))
    counts = cut_lineage(once_.select("text", "spans").mapInPandas(count, "term string, entity string, n long").groupBy("term", "entity").agg(F.sum("n").alias("n")))
    total = counts.where("term = '' and entity = ''").agg(F.coalesce(F.max("n"), F.lit(1))).first()[0]
    both = counts.where((F.col("term") != "") & (F.col("entity") != "") & (F.col("n") >= texts))
    best = both.groupBy("term").agg(F.max(F.struct("n", "entity")).alias("b")).select("term", F.col("b.n").alias("together"), F.col("b.entity").alias("entity"))
    alone = counts.where("entity = ''").select("term", F.col("n").alias("seen"))
    entity = counts.where("term = ''").select("entity", F.col("n").alias("texts"))
    bits = F.log2((F.col("together") / F.col("seen")) / (F.col("texts") / total))
    scored = best.join(alone, "term").where(F.col("together") >= share * F.col("seen")).join(entity, "entity").withColumn("bits", bits)
    return scored.where(F.col("bits") >= least_bits).select("term", F.substring_index("entity", ":", 1).alias("kind"), "seen", "together", "bits")


def sanitised(records: DataFrame, terms: DataFrame) -> DataFrame:
    """source_table, record_id and text with the mentions replaced by ``[KIND]`` and disclosing terms by ``[TERM]``."""
    keys = ["source_table", "record_id"]
    shared = records.sparkSession.sparkContext.broadcast(bloom.build(terms))

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        member = bloom.Member(shared.value)
        for batch in batches:
            rows = []
            for source, record, text, spans in zip(*(batch[c] for c in (*keys, "text", "spans")), strict=True):
                rows += [(source, record, a, b, w) for a, b, w in free_words(text or "", list(spans) if spans is not None else []) if member(w)]
            yield pd.DataFrame(rows, columns=[*keys, "start_at", "end_at", "term"])

    hits = records.mapInPandas(find, "source_table string, record_id string, start_at int, end_at int, term string").join(terms.select("term"), "term", "left_semi")
    more = hits.groupBy(*keys).agg(F.collect_list(F.struct(F.lit("term").alias("kind"), "start_at", "end_at")).alias("more"))
    empty = F.expr("cast(array() as array<struct<kind:string,start_at:int,end_at:int>>)")
    whole = records.join(more, keys, "left").withColumn("spans", F.concat(F.coalesce("spans", empty), F.coalesce("more", empty)))
    return whole.select(*keys, masked("text", "spans").alias("text"))


def p4_disclosing(spark: SparkSession, folder: str) -> DataFrame:
    return disclosing_terms(last_with_spans(spark, folder))


def p4_sanitised(spark: SparkSession, folder: str) -> DataFrame:
    records = last_with_spans(spark, folder)
    return sanitised(records, cut_lineage(disclosing_terms(records)))


QUERIES = {"p4_found": p4_found, "p4_text": p4_text, "p4_disclosing": p4_disclosing, "p4_sanitised": p4_sanitised}
SQL: dict[str, str] = {}
