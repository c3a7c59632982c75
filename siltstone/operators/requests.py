"""Search requests: validation and normalised filters, before any plan is built."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

KINDS = ("episode", "file", "mail")
SCOPES = ("local_first", "local_only", "global")
MOST_RESULTS = 50


@dataclass(frozen=True)
class Request:
    query: str
    limit: int = 10
    scope: str = "local_first"
    kinds: tuple[str, ...] = ()
    file_kinds: tuple[str, ...] = ()
    include_generated: bool | None = None


def values(raw: Sequence[str] | str | None) -> tuple[str, ...]:
    """Distinct values, lower case, ``-`` as ``_``, sorted."""
    given = [raw] if isinstance(raw, str) else list(raw or ())
    return tuple(sorted({str(v).strip().lower().replace("-", "_") for v in given if str(v).strip()}))


def request(raw: Mapping) -> Request:
    """A valid request; what cannot be served is refused rather than widened."""
    query = str(raw.get("query") or "").strip()
    if not query:
        raise ValueError("query must not be blank")
    limit = int(raw.get("limit") or 10)
    if not 1 <= limit <= MOST_RESULTS:
        raise ValueError(f"limit must lie between 1 and {MOST_RESULTS}")
    scope = str(raw.get("scope") or "local_first").strip().lower()
    if scope not in SCOPES:
        raise ValueError(f"scope must be one of {', '.join(SCOPES)}")
    kinds, file_kinds = values(raw.get("kinds")), values(raw.get("file_kinds"))
    if unknown := set(kinds) - set(KINDS):
        raise ValueError(f"unknown kinds: {', '.join(sorted(unknown))}")
    if "code" in file_kinds and len(file_kinds) > 1:
        raise ValueError("code cannot be combined with other file kinds")
    return Request(query, limit, scope, kinds, file_kinds, raw.get("include_generated"))


def predicate(wanted: Request, file_kind: str = "file_kind", generated: str | None = None) -> Column:
    """The filter of a request: code is left out unless it is asked for."""
    test = F.coalesce(F.col(file_kind).isin(*wanted.file_kinds), F.lit(False)) if wanted.file_kinds else F.coalesce(F.col(file_kind) != "code", F.lit(True))
    if generated is not None and wanted.include_generated is False:
        test = test & ~F.coalesce(F.col(generated), F.lit(False))
    return test


def chosen(raw: Sequence[str] | str | None) -> list[str]:
    """Distinct values as given, sorted; a text may name several, separated by commas."""
    given = raw.split(",") if isinstance(raw, str) else list(raw or ())
    return sorted({str(v).strip() for v in given if str(v).strip()})


def matches(filters: dict) -> Column:
    """Whether a row has one of the values of every field; a field without values does not filter. Nulls match no value."""
    kept = F.lit(True)
    for name, given in filters.items():
        if wanted := chosen(given):
            kept = kept & F.coalesce(F.col(name).isin(wanted), F.lit(False))
    return kept


def fingerprint(filters: dict) -> str:
    """SHA-256 of the filters in canonical form: the order of fields and values does not matter."""
    canonical = json.dumps({k: chosen(v) for k, v in filters.items()}, sort_keys=True)
    return hashlib.sha256(canonical.encode()).hexdigest()


def cursor(at: str, key: int, filters: dict) -> str:
    return f"{at}|{key}|{fingerprint(filters)}"


def position(cursor_: str, filters: dict) -> tuple[str, int]:
    """Time and key of a cursor; one made for other filters, or a broken one, is an error."""
    at, _, rest = cursor_.partition("|")
    key, _, print_ = rest.partition("|")
    if print_ != fingerprint(filters) or not key.lstrip("-").isdigit():
        raise ValueError("the cursor belongs to another filter")
    return at, int(key)
