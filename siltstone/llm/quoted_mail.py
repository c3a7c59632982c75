"""Reduces mails to the text their sender wrote anew (problem 2).

A layout grammar is applied by recursive descent. A mail is a sequence of blocks; a block is
authored text, a banner, a disclaimer, a signature, a reply (attribution line and quoted lines,
themselves a mail one level down) or a forward (separator and header lines, then a mail). The
result is a tree; serialising the authored nodes of its top level gives the new text.

    mail      := block*
    block     := banner | disclaimer | signature | reply | forward | authored
    reply     := [attribution] quoted+         quoted lines carry one more mark or indentation
    forward   := [separator] header{2,} mail   holds everything that follows
    signature := closing line* | (name | separator name | device) line*
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.tables import schema_with, table

MARK = re.compile(r"[ \t]{0,3}[>|] ?")
INDENT = re.compile(r"(?: {4}|\t|[ \xa0]{4})")
PROMPT = re.compile(r">>> ?[\w.]+\s?[(\[=]")

#: Words that mail programs and senders use, by role.
CLOSINGS = """
regards|kind regards|best regards|warm regards|with kind regards|with best regards|best|best wishes|all the best|thanks|many thanks|thank you|thanks and regards
thanks in advance|thanks again|many thanks and best wishes|many thanks and best regards|cheers|sincerely|yours sincerely|yours faithfully|yours truly|yours|kindly|respectfully|take care
mit freundlichen grüßen|mit freundlichen grüssen|mit freundlichem gruß|freundliche grüße|viele grüße|viele grüsse|beste grüße|liebe grüße|herzliche grüße|schöne grüße|gruß|grüße|mfg|lg|vg|danke|vielen dank
bien à vous|cordialement|bien cordialement|très cordialement|sincèrement|salutations|meilleures salutations|amicalement|merci|bonne journée
saludos|un saludo|saludos cordiales|un cordial saludo|cordialmente|atentamente|muchas gracias|gracias|un abrazo
""".strip().replace("\n", "|")
CLOSING = re.compile(rf"(?:{CLOSINGS})\s*[,.!:–—-]?\s*", re.I)
KEYS_FIRST = "from|von|de|expéditeur|remitente"
KEYS = f"{KEYS_FIRST}|sent|gesendet|envoyé|enviado(?: el)?|date|datum|fecha|to|an|à|para|cc|bcc|subject|betreff|objet|asunto|reply-to|antwort an"
HEADER_FIRST = re.compile(rf"\*?(?:{KEYS_FIRST})\s?:\*?\s*\S", re.I)
HEADER = re.compile(rf"\*?(?:{KEYS})\s?:\*?(?:\s|$)", re.I)
FORWARD = re.compile(
    r"begin forwarded message:?|[-_=*\s]*(?:original message|original appointment|forwarded (?:message|by .*)|ursprüngliche nachricht|weitergeleitete nachricht|originalnachricht"
    r"|message d'origine|message original|message transféré|message initial|mensaje original|mensaje reenviado)[-_=*:\s]*",
    re.I,
)
ATTRIBUTION = re.compile(
    r"(?:on\b.{4,}\bwrote\s?:|am\b.{4,}\bschrieb\b.*:|le\b.{4,}\ba écrit\s?:|el\b.{4,}\bescribió\s?:|.{3,60}\b(?:writes|wrote|schrieb|schreibt|a écrit|écrit|escribió|escribe)\s?:"
    r"|\d{4}[-/.]\d\d?[-/.]\d\d?,? (?:at )?\d\d?:\d\d(?::\d\d)? .*<[^<>\s]+@[^<>\s]+>\s?:)\s*",
    re.I,
)
ATTRIBUTION_HEAD = re.compile(r"(?:(?:on|am|le|el)\b.*\d.*|\d{4}[-/.]\d\d?[-/.]\d\d?.*)", re.I)
STAMPED = re.compile(r"\d{1,4}[-/.]\d|\d{1,2}[:h]\d\d|<[^<>\s]+@[^<>\s]+>")
DEVICE = re.compile(
    r"(?:sent (?:from|via|with) |get (?:the )?[\w ]{2,30}\bfor\b|envoyé (?:de|depuis|à partir) |von meine[mr] .*gesendet|gesendet (?:von|mit) (?:meine|der|dem)|enviado desde |diese nachricht wurde von meinem).{0,60}",
    re.I,
)
BANNER = re.compile(
    r"[\[*!\s(-]*(?:external\b|externe nachricht|externe e-?mail|extern\b|caution\s?:|warning\s?:|achtung\s?:|vorsicht\s?:|attention\s?:|atención\s?:|message externe|mensaje externo|correo externo|e-?mail externe"
    r"|this (?:e-?mail|message) (?:came|comes|originated|was sent) from (?:outside|an external))",
    re.I,
)
BANNER_SURE = re.compile(r"attachments|links|outside|organi[sz]ation|anhänge|sender|absender|pièces|adjuntos|enlaces|liens|expéditeur|remitente|\*\*\*|\[external\]|\[extern\]", re.I)
DISCLAIMER = re.compile(
    r"(?:this (?:e-?mail|message|communication)\b.{0,60}\b(?:confidential|privileged|intended)|confidentiality notice|disclaimer\s?:|notice\s?:.{0,40}confidential|the (?:information|content)s? (?:contained )?(?:in|of) this (?:e-?mail|message)"
    r"|ce (?:message|courriel|mail)\b.{0,60}\b(?:confidentiel|destiné|réservé)|diese (?:e-?mail|nachricht)\b.{0,60}\b(?:vertraulich|bestimmt)|der inhalt dieser (?:e-?mail|nachricht)"
    r"|este (?:correo|mensaje)\b.{0,60}\b(?:reservad|confidencial|privilegiad|dirigid)|la información contenida|.{0,80}\bregistered (?:under|in|at|office)\b.{0,200}\bviews expressed|.{0,80}\bregistered under no\b"
    r"|the views expressed|please consider the environment|any copying or disclosure|if you (?:have )?received (?:it|this) (?:e-?mail |message )?in error|falls sie nicht der richtige empfänger|toute diffusion non autorisée)",
    re.I,
)
RULE = re.compile(r"(?:-{2,}|_{2,}|—+|–+|={3,}|~{3,}|\*(?: ?\*){2,}|#{3,}|-- ?)\s*")
SENTENCE = re.compile(r"\b[^\W\d_]+\b(?:\s+\S+){5,}.*[.!?]\s*$")
CONTACT = re.compile(
    r"^(?:(?:t|m|e|f|p|tel|phone|mobile|mob|cell|fax|mail|e-?mail|web|telefon|tél|teléfono|móvil|handy)\s?[.:]|phone |mobile |tel |m [+(\d]|t [+(\d]|[+(]?\d[\d\s().\-/+]{6,}$|www\.|https?://|[\w.+-]+@[\w-]+\.[\w.-]+$)", re.I
)


SENTENCE_DONE = re.compile(r"[.!?*\])]\s*$")


@dataclass
class Node:
    kind: str
    lines: list[int] = field(default_factory=list)
    parts: list[Node] = field(default_factory=list)


@dataclass
class Line:
    number: int  # among the non-blank lines, from 1; 0 for a blank one
    text: str
    depth: int = 0  # of quotation that the markup itself shows


class _Visible(HTMLParser):
    """Visible lines of a body with the depth of blockquotes around them."""

    BREAKS = frozenset("p div li blockquote td pre".split())
    HIDDEN = frozenset("head style script title template".split())

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int]] = []
        self.text: list[str] = []
        self.depth = self.hidden = 0
        self.stack: list[str] = []

    def flush(self, always: bool = False) -> None:
        """Ends a line; between two blocks there is none where nothing stands."""
        text = "".join(self.text)
        self.text = []
        if always or text.strip(" \t"):
            self.lines.append((text, self.depth))

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in self.HIDDEN:
            self.hidden += 1
        elif tag == "body":
            self.hidden = 0
        if tag == "br" or tag in self.BREAKS:
            self.flush(tag == "br")
        if tag == "blockquote":
            self.depth += 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag == "br" or tag in self.BREAKS:
            self.flush(tag == "br")

    def handle_endtag(self, tag: str) -> None:
        if tag in self.HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        if tag in self.BREAKS:
            self.flush()
        if tag == "blockquote":
            self.depth = max(0, self.depth - 1)

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.text.append(data.replace("\r", " ").replace("\n", " "))


def lines_of(text_body: str | None, html_body: str | None) -> list[Line]:
    """Numbered lines of the body that counts: text_body, or html_body where that is null or blank."""
    if text_body is not None and text_body.strip():
        raw = [(line, 0) for line in re.split(r"\r\n|\n", text_body)]
    elif html_body is not None and html_body.strip():
        parser = _Visible()
        parser.feed(html_body)
        parser.close()
        parser.flush()
        raw = parser.lines
    else:
        return []
    found, number = [], 0
    for text, depth in raw:
        blank = not text.strip()
        number += not blank
        found.append(Line(0 if blank else number, text.replace("\xa0", " "), depth))
    return found


def names_of(sender: str | None) -> set[str]:
    """Lower-case forms in which the sender may sign."""
    if not sender:
        return set()
    shown, _, address = sender.partition("<")
    if not address:
        shown, address = ("", sender) if "@" in sender else (sender, "")
    shown = shown.strip().strip("\"' ")
    if "," in shown:
        family, _, given = shown.partition(",")
        shown = f"{given.strip()} {family.strip()}"
    names: set[str] = set()
    words = shown.lower().split()
    local = address.partition("@")[0].lower().partition("+")[0]
    if not words and "." in local:
        words = [w for w in local.split(".") if w]
    if words:
        names |= {" ".join(words), words[0]}
        if len(words) > 1:
            names |= {" ".join(words[1:]), f"{words[0][0]}. {words[-1]}", f"{words[-1]}, {' '.join(words[:-1])}", f"{words[0]} {words[-1]}"}
    return names


class Parser:
    """Descent over the lines of one level of quotation; what lies a level down waits in ``pending``."""

    def __init__(self, lines: list[Line], names: set[str], local: str = ""):
        self.lines = lines
        self.filled = [i for i, line in enumerate(lines) if line.number]
        self.names = names
        self.local = local
        self.at = 0
        self.pending: list[tuple[Node, list[Line]]] = []

    def next_at(self, at: int, skip: int = 1) -> int:
        """The place of the ``skip``-th non-blank line after ``at``, -1 where there is none."""
        n = bisect_right(self.filled, at) + skip - 1
        return self.filled[n] if n < len(self.filled) else -1

    def following(self, at: int, skip: int = 1) -> Line | None:
        place = self.next_at(at, skip)
        return self.lines[place] if place >= 0 else None

    def before(self, at: int) -> Line | None:
        n = bisect_left(self.filled, at)
        return self.lines[self.filled[n - 1]] if n else None

    def notice(self, at: int, rule: re.Pattern) -> list[Line]:
        """The lines of a banner or disclaimer that begins here: up to the end of its last sentence."""
        first = self.lines[at]
        follower = self.following(at)
        ahead = f" {follower.text.strip()}" if follower is not None and follower.depth == first.depth else ""
        whole = first.text.strip() + ahead
        if not rule.match(whole) or rule is BANNER and not BANNER_SURE.search(whole):
            return []
        found = [first]
        for i in range(at + 1, len(self.lines)):
            line = self.lines[i]
            text = line.text.strip()
            if not line.number or line.depth != first.depth or MARK.match(line.text) or RULE.fullmatch(text):
                break
            if SENTENCE_DONE.search(found[-1].text) and not rule.match(text):
                break
            found.append(line)
        return found

    def signs(self, text: str) -> bool:
        """Whether a line is the sender's name."""
        name = re.sub(r"\s+", " ", text.strip().strip("*_").strip()).lower()
        if name in self.names:
            return True
        words = name.split()
        if 2 <= len(words) <= 4 and self.local and all(w.replace("-", "").replace(".", "").isalpha() for w in words):
            return len(words[-1]) > 3 and words[-1] in self.local and (words[0][0] in self.local)
        return False

    def quoted(self, at: int) -> bool:
        line = self.lines[at]
        if line.depth:
            return True
        if not MARK.match(line.text):
            return False
        if PROMPT.match(line.text):
            before = self.before(at)
            marked = before is not None and (before.depth or MARK.match(before.text)) and not PROMPT.match(before.text)
            return bool(marked)
        return True

    def attribution(self, at: int) -> int:
        """Number of lines (blank ones included) of an attribution that starts here, else 0."""
        line = self.lines[at].text.strip()
        if ATTRIBUTION.fullmatch(line):
            follower = self.following(at)
            answered = follower is not None and (follower.depth or MARK.match(follower.text) or INDENT.match(follower.text))
            return 1 if STAMPED.search(line) or answered else 0
        if ATTRIBUTION_HEAD.fullmatch(line) and at + 1 < len(self.lines) and self.lines[at + 1].number:
            for more in (1, 2):
                if at + more < len(self.lines) and not MARK.match(self.lines[at + more].text):
                    line = f"{line} {self.lines[at + more].text.strip()}"
                    if ATTRIBUTION.fullmatch(line) and STAMPED.search(line) and re.match(r"(?:on|am|le|el)\b|\d{4}-", line, re.I):
                        return more + 1
        return 0

    def forward(self, at: int) -> bool:
        """Whether a forwarded or original message with its header starts here."""
        line = self.lines[at].text.strip()
        if FORWARD.fullmatch(line) and (line[0] in "-_=*" or line.lower().startswith("begin")):
            return True
        if HEADER_FIRST.match(line):
            more = [self.following(at, i) for i in (1, 2)]
            return sum(1 for m in more if m is not None and HEADER.match(m.text.strip())) >= 2
        if RULE.fullmatch(line):
            follower = self.following(at)
            if follower is not None:
                return FORWARD.fullmatch(follower.text.strip()) is not None or bool(HEADER_FIRST.match(follower.text.strip())) and self.forward(self.next_at(at))
        return False

    def signature(self, at: int) -> bool:
        line = self.lines[at].text.strip()
        if CLOSING.fullmatch(line):
            return self.before(at) is not None or self.following(at) is None
        if DEVICE.fullmatch(line) or self.signs(line):
            return True
        if RULE.fullmatch(line):
            follower = self.following(at)
            if follower is None:
                return True
            text = follower.text.strip()
            return self.signs(text) or bool(DEVICE.fullmatch(text)) or bool(CLOSING.fullmatch(text)) or line == "--" and not SENTENCE.search(text)
        return False

    def parse(self) -> Node:
        mail = Node("mail")
        authored: Node | None = None
        while self.at < len(self.lines):
            line = self.lines[self.at]
            if not line.number:
                self.at += 1
                continue
            block = self.block(line)
            if block is None:
                if authored is None or mail.parts[-1] is not authored:
                    authored = Node("authored")
                    mail.parts.append(authored)
                authored.lines.append(line.number)
                self.at += 1
            else:
                mail.parts.append(block)
        return mail

    def block(self, line: Line) -> Node | None:
        at = self.at
        if self.quoted(at):
            return self.reply(Node("reply"), False)
        if size := self.attribution(at):
            node = Node("reply", [x.number for x in self.lines[at : at + size] if x.number])
            self.at += size
            return self.reply(node, True)
        if self.forward(at):
            return self.forwarded()
        if lines := self.notice(at, BANNER):
            return self.take("banner", lines)
        if lines := self.notice(at, DISCLAIMER):
            return self.take("disclaimer", lines)
        if self.signature(at):
            return self.sign()
        return None

    def take(self, kind: str, lines: list[Line]) -> Node:
        self.at += len(lines)
        return Node(kind, [x.number for x in lines])

    def reply(self, node: Node, attributed: bool) -> Node:
        """Quoted lines: marked ones, or after an attribution indented ones; their content is parsed one level down."""
        inner: list[Line] = []
        indented = False
        while self.at < len(self.lines):
            line = self.lines[self.at]
            if not line.number:
                ahead = self.following(self.at)
                if ahead is None or not (self.quoted(self.next_at(self.at)) or (attributed or indented) and INDENT.match(ahead.text)):
                    break
                if not (ahead.depth or INDENT.match(ahead.text)) and inner and not indented and MARK.match(ahead.text) is None:
                    break
                inner.append(line)
            elif self.quoted(self.at):
                mark = MARK.match(line.text)
                stripped = line.text if line.depth else line.text[mark.end() :]
                inner.append(Line(line.number, stripped, max(0, line.depth - 1)))
                attributed = attributed and bool(INDENT.match(line.text))
            elif (attributed or indented) and INDENT.match(line.text):
                indented = True
                inner.append(Line(line.number, line.text[INDENT.match(line.text).end() :]))
            else:
                break
            self.at += 1
        self.pending.append((node, inner))
        return node

    def forwarded(self) -> Node:
        """A header and all that follows it."""
        node = Node("forward")
        head = True
        rest: list[Line] = []
        for line in self.lines[self.at :]:
            text = line.text.strip()
            if head and (not line.number or RULE.fullmatch(text) or FORWARD.fullmatch(text) or HEADER.match(text)):
                if line.number:
                    node.lines.append(line.number)
                continue
            head = False
            rest.append(line)
        self.at = len(self.lines)
        self.pending.append((node, rest))
        return node

    def sign(self) -> Node:
        """From the closing or name to the next quotation, forward, banner or disclaimer."""
        node = Node("signature")
        while self.at < len(self.lines):
            line = self.lines[self.at]
            if line.number:
                if node.lines and (self.quoted(self.at) or self.attribution(self.at) or self.forward(self.at)):
                    break
                if node.lines and (self.notice(self.at, DISCLAIMER) or self.notice(self.at, BANNER)):
                    break
                node.lines.append(line.number)
            self.at += 1
        return node


def layout(text_body: str | None, html_body: str | None, sender: str | None = None) -> tuple[list[Line], Node]:
    lines = lines_of(text_body, html_body)
    address = re.search(r"([\w.+-]+)@", sender or "")
    parser = Parser(lines, names_of(sender), address[1].lower() if address else "")
    mail, pending = parser.parse(), parser.pending
    while pending:
        node, inner = pending.pop()
        below = Parser(inner, set())
        node.parts.append(below.parse())
        pending += below.pending
    return lines, mail


def new_lines(text_body: str | None, html_body: str | None, sender: str | None = None) -> list[tuple[int, str]]:
    """Number and text of each line newly written by the sender."""
    lines, mail = layout(text_body, html_body, sender)
    fresh = {n for part in mail.parts if part.kind == "authored" for n in part.lines}
    return [(x.number, x.text.strip() if x.depth else x.text.rstrip()) for x in lines if x.number in fresh]


def authored(mails: DataFrame, key: str = "export_id") -> DataFrame:
    """``key`` and new_lines (array of line_no and line) of each mail, as delivered last.

    Needs text_body, html_body, sender and exported_at_epoch. A mail without any body, or with
    blank ones, has an empty array. Bodies are not shuffled: each row is parsed where it lies,
    and only its new lines travel to the choice of the last delivery; rows equal in time are
    settled by their lines. Rows without a key are left out.
    """
    known = mails.where(F.col(key).isNotNull())
    schema = schema_with(known, [key, "exported_at_epoch"], "new_lines array<struct<line_no:int,line:string>>")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [
                [{"line_no": n, "line": t} for n, t in new_lines(text, html, sender)]
                for text, html, sender in zip(batch["text_body"], batch["html_body"], batch["sender"], strict=True)
            ]
            yield pd.DataFrame({key: batch[key], "exported_at_epoch": batch["exported_at_epoch"], "new_lines": found})

    parsed = known.select(key, "exported_at_epoch", "text_body", "html_body", "sender").mapInPandas(parse, schema)
    last = parsed.groupBy(key).agg(F.max(F.struct("exported_at_epoch", "new_lines")).alias("last"))
    return last.select(key, F.col("last.new_lines").alias("new_lines"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    found = authored(table(spark, folder, "parsed_email"))
    return found.select("export_id", F.explode("new_lines").alias("l")).select("export_id", "l.line_no")


def p2_text(spark: SparkSession, folder: str) -> DataFrame:
    """Each mail reduced to its new text; empty where nothing is new."""
    found = authored(table(spark, folder, "parsed_email"))
    return found.select("export_id", F.array_join(F.transform("new_lines", lambda x: x["line"]), "\n").alias("new_text"))


QUERIES = {"p2_found": p2_found, "p2_text": p2_text}
SQL: dict[str, str] = {}
