"""Text expressions: Column in, Column out, all inside generated code.

Null in gives null out unless said otherwise. White space is Unicode white space, as the
pattern flag ``(?U)`` defines it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"(?U)\s+"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def collapse_space(c: Column | str) -> Column:
    return strip(F.regexp_replace(col(c), SPACE, " "))


def words(c: Column | str) -> Column:
    return F.filter(F.split(col(c), SPACE), lambda w: w != "")


def token_estimate(c: Column | str) -> Column:
    """Number of white-space separated words, at least 1; a null text counts as empty."""
    return F.greatest(F.lit(1), F.size(words(F.coalesce(col(c), F.lit("")))))


def newline_normalise(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"\r\n?", "\n")


def strip_nul(c: Column | str) -> Column:
    return F.replace(col(c), F.lit("\u0000"), F.lit(""))


def clean_controls(c: Column | str) -> Column:
    """Control characters other than tab, line feed and carriage return become blanks."""
    return F.regexp_replace(col(c), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", " ")


def bound(c: Column | str, size: int) -> Column:
    return F.substring(col(c), 1, size)


def decode_text(content: Column | str) -> Column:
    """Bytes as text: byte order marks of UTF-8, UTF-16 and UTF-32 decide, invalid bytes are replaced, line ends become LF."""
    b = col(content)
    head = F.hex(F.substring(b, 1, 4))
    text = (
        F.when(head.startswith("0000FEFF"), F.expr("decode(content, 'UTF-32')") if isinstance(content, str) and content == "content" else F.decode(b, "UTF-32"))
        .when(head.startswith("FFFE0000"), F.decode(b, "UTF-32"))
        .when(head.startswith("FFFE"), F.decode(b, "UTF-16"))
        .when(head.startswith("FEFF"), F.decode(b, "UTF-16"))
        .when(head.startswith("EFBBBF"), F.expr("make_valid_utf8(cast(substring({0}, 4) as string))".format(content)) if isinstance(content, str) else F.make_valid_utf8(F.substring(b, 4, 2**31 - 1).cast("string")))
        .otherwise(F.make_valid_utf8(b.cast("string")))
    )
    return newline_normalise(text)


def query_terms(c: Column | str) -> Column:
    """Distinct search terms in order of appearance: ASCII words with inner ``_.-``, two characters or more."""
    found = F.regexp_extract_all(F.lower(col(c)), F.lit(r"[a-z0-9][a-z0-9_.-]*"), F.lit(0))
    trimmed = F.transform(found, lambda t: F.regexp_replace(t, r"^[._-]+|[._-]+$", ""))
    return F.array_distinct(F.filter(trimmed, lambda t: F.length(t) >= 2))


def ascii_tokens(c: Column | str) -> Column:
    return F.array_remove(F.split(F.lower(col(c)), "[^a-z0-9]+"), "")


def chunk_starts(c: Column | str, size: int) -> Column:
    """Start offsets of fixed windows; none for an empty text."""
    n = F.length(col(c))
    return F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(size))).otherwise(F.array().cast("array<int>"))


def snippet(clean: Column | str, lower: Column | str, terms: Column, width: int = 240) -> Column:
    """A window of ``width`` characters from a quarter before the first matching term, with ellipses where it is cut.

    Takes the text with its white space collapsed and the same in lower case, as columns of an
    earlier step, so that neither is computed once per term.
    """
    clean, lower = col(clean), col(lower)
    places = F.filter(F.transform(terms, lambda t: F.instr(lower, t)), lambda p: p > 0)
    first = F.coalesce(F.array_min(places), F.lit(1)) - 1
    n = F.length(clean)
    start = F.greatest(F.lit(0), F.least(first - width // 4, n - width))
    piece = strip(F.substring(clean, start + 1, F.lit(width)))
    return F.when(n <= width, clean).otherwise(F.concat(F.when(start > 0, "...").otherwise(""), piece, F.when(start + width < n, "...").otherwise("")))


def short_snippet(clean: Column | str, width: int = 280) -> Column:
    """The first ``width`` characters of a text whose white space is collapsed."""
    clean = col(clean)
    return F.when(F.length(clean) <= width, clean).otherwise(F.concat(F.substring(clean, 1, width), F.lit("…")))


#: The forms of secrets.
API_KEY = r"\bsk-[A-Za-z0-9_-]{20,}\b"
PASSWORD = r"""(?i)\b(password|passwd|pwd)(\s*[:=]\s*)([^\s;,'"]+)"""


def redact_secrets(c: Column | str) -> Column:
    """API keys and the values of password assignments become markers; applying it twice changes nothing more."""
    keys = F.regexp_replace(col(c), API_KEY, "[REDACTED:openai_api_key]")
    return F.regexp_replace(keys, PASSWORD, "$1$2[REDACTED:password_assignment]")


def redact_emails(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[REDACTED:email]")


def redact_assignments(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"(?i)\b(password|secret|token|api_key|authorization|credential)(\s*[:=]\s*)(\S+)", "$1$2***")


def generated_marker(c: Column | str, lines: int = 20) -> Column:
    """Whether one of the first lines says that a tool wrote the file."""
    head = F.array_join(F.slice(F.split(col(c), "\n"), 1, lines), "\n")
    return head.rlike(r"(?i)@generated|auto-?generated|code generated by|do not edit|generated by .* do not modify")


def slug(c: Column | str, size: int = 72, empty: str = "memory") -> Column:
    made = F.regexp_replace(F.substring(F.regexp_replace(F.regexp_replace(F.lower(col(c)), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, size), "-+$", "")
    return F.when(F.coalesce(made, F.lit("")) == "", empty).otherwise(made)


def trigrams(c: Column | str) -> Column:
    """Distinct trigrams of the lower-case words, each padded with two blanks before and one after."""
    per_word = F.transform(ascii_tokens(c), lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(per_word, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))))


def html_text(c: Column | str) -> Column:
    """Readable text of an HTML page by pattern: script, style, noscript and svg are dropped, entities of markup decoded."""
    body = F.regexp_replace(col(c), r"(?is)<(script|style|noscript|svg|head)\b.*?</\1\s*>", " ")
    bare = F.regexp_replace(body, r"(?s)<!--.*?-->|<[^>]+>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(char))
    return collapse_space(bare)
