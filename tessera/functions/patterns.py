"""The fixed patterns in the dialects of Spark (java.util.regex) and DuckDB (RE2)."""

from __future__ import annotations

import re
from dataclasses import dataclass

from . import fixed as V

_BOUNDARY = "(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


def _end(pattern: str) -> str:
    """``$`` outside of a character class becomes the absolute end."""
    out, inside, skip = [], False, False
    for c in pattern:
        if skip:
            skip = False
        elif c == "\\":
            skip = True
        elif c in "[]":
            inside = c == "["
        elif c == "$" and not inside:
            out.append(r"\z")
            continue
        out.append(c)
    return "".join(out)


def _bounded(pattern: str) -> str:
    """ASCII word boundaries: a look-behind before a word, a look-ahead after one, both where the side is open."""
    pattern = re.sub(r"\\b(?=\(\?:[A-Za-z0-9]|[A-Za-z0-9])", "(?<![A-Za-z0-9_])", pattern)
    pattern = re.sub(r"(?<=[A-Za-z0-9)?])\\b", "(?![A-Za-z0-9_])", pattern)
    return pattern.replace(r"\b", _BOUNDARY)


def java(pattern: str, fold_case: bool = False) -> str:
    """Unicode white space for ``\\s``, ASCII word boundaries, absolute ends."""
    flags = ("iu" if fold_case else "") + ("U" if r"\s" in pattern else "")
    return (f"(?{flags})" if flags else "") + _bounded(_end(pattern))


def re2(pattern: str, fold_case: bool = False) -> str:
    return ("(?i)" if fold_case else "") + _end(pattern)


def any_of(*parts: str) -> str:
    """Alternatives; a boundary that all start with is tested once."""
    lead = r"\b" if all(p.startswith(r"\b") for p in parts) else ""
    return f"{lead}(?:{'|'.join(p.removeprefix(lead) for p in parts)})"


@dataclass(frozen=True)
class CuePattern:
    """``group`` 0: from the match to the clause's end; 1: what follows the marker."""

    kind: str
    pattern: str
    fold_case: bool
    group: int


def _whole(kind: str, parts: tuple[str, ...], fold_case: bool) -> CuePattern:
    return CuePattern(kind, any_of(*parts) + ".*$", fold_case, 0)


#: In order; the first that matches a clause and leaves a body wins.
CUES = (
    _whole("correction", V.ZH_CORRECTION, False),
    _whole("correction", V.EN_CORRECTION, True),
    _whole("prohibition", V.ZH_PROHIBITION, False),
    _whole("prohibition", V.EN_PROHIBITION, True),
    _whole("identity", V.ZH_IDENTITY, False),
    _whole("identity", V.EN_IDENTITY, True),
    CuePattern("preference", f"(?:{any_of(*V.ZH_REMEMBER)}|{any_of(*V.ZH_PREFERENCE)})(.*)$", False, 1),
    CuePattern("preference", f"(?:{any_of(*V.EN_REMEMBER)}|{any_of(*V.EN_PREFERENCE)})(.*)$", True, 1),
    CuePattern("preference", any_of(*V.ZH_DIRECTIVE), False, 1),
    _whole("preference", V.EN_DIRECTIVE, True),
    _whole("agreement", V.ZH_AGREEMENT, False),
    _whole("agreement", V.EN_AGREEMENT, True),
    CuePattern("fact", any_of(*V.ZH_FACT_CAPTURE), False, 1),
    _whole("fact", V.ZH_FACT, False),
    _whole("fact", V.EN_FACT, True),
)

SESSION_RECALL = ((any_of(*V.ZH_SESSION_RECALL), False), (any_of(*V.EN_SESSION_RECALL), True))
SESSION_SCOPED = tuple((p, True) for p in V.SESSION_SCOPED)
VAGUE = ((V.VAGUE[0], False), (V.VAGUE[1], False), (V.VAGUE[2], True))
HEDGES = ((V.HEDGES[0], False), (V.HEDGES[1], True))
QUESTIONS = ((V.QUESTIONS[0], False), (V.QUESTIONS[1], False), (V.QUESTIONS[2], False), (V.QUESTIONS[3], True))
EXPLICIT = ((V.EXPLICIT_MARKERS[0], False), (V.EXPLICIT_MARKERS[1], True))
