"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, address schemes, plus signs, digits, words that announce an identifier, in
any case, and the openings of well-known keys.  Around each anchor a local parser, which looks at nothing but the characters next to
it, finds the boundaries of an email, address, number, account or secret and validates it: card numbers by Luhn's sum, bank accounts by
the remainder by 97, routing and social security numbers by the rules of their issuers.
"""

from __future__ import annotations

import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._batches import append_columns

#: Kinds of spans in the order in which spans of equal start are listed; the first four are the base.
KINDS = ("email", "ip", "card", "phone", "url", "account", "secret")
BASE = KINDS[:4]

#: Schemes that open an address.
SCHEMES = ("http://", "https://", "ftp://", "ssh://", "mailto:")
#: Words that announce an account or identity number, and the rule by which it is checked.
ACCOUNT_CUES = {
    "iban": "iban", "ssn": "ssn", "social security": "ssn", "routing": "aba", "aba": "aba", "account": "number", "acct": "number",
    "passport": "number", "tax id": "number", "customer id": "number", "member id": "number",
}
#: Words that announce a credential.
SECRET_CUES = ("token", "api_key", "api key", "apikey", "api-key", "secret", "password", "passwd", "bearer")
# How keys of well-known services open, and what follows.
KEY_FORMS = {
    "AKIA": r"[A-Z0-9]{16}", "ASIA": r"[A-Z0-9]{16}", "ghp_": r"[A-Za-z0-9]{36,}", "gho_": r"[A-Za-z0-9]{36,}", "github_pat_": r"[A-Za-z0-9_]{40,}",
    "glpat-": r"[A-Za-z0-9_-]{20,}", "xoxb-": r"[A-Za-z0-9-]{10,}", "xoxp-": r"[A-Za-z0-9-]{10,}", "AIza": r"[A-Za-z0-9_-]{35}", "sk_live_": r"[A-Za-z0-9]{16,}",
    "eyJ": r"[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_QUAD = re.compile(r"[0-9]+\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_URL = re.compile(r"[A-Za-z0-9._~%!$&*+,;=:@/?#\[\]-]+")
#: What may stand between a cue and what it announces: a few words like "no." and a separator.
_ACCOUNT = re.compile(r"(?i:[\x20]?(?:no\.?|number|nr\.?|#))?[\x20]{0,3}[:=#]?[\x20]{0,3}((?=[A-Z0-9\x20-]*[0-9]{2})[A-Z0-9](?:[\x20-]?[A-Z0-9]){5,33})(?![A-Za-z0-9])")
_SECRET = re.compile(r"[\x20]{0,3}[:=][\x20]{0,3}[\"']?([A-Za-z0-9_+/=.-]{12,})")
_BEARER = re.compile(r"[\x20]{1,3}([A-Za-z0-9_+/=.-]{16,})")
_KEYS = {start: re.compile(rest + r"(?![A-Za-z0-9])") for start, rest in KEY_FORMS.items()}
_DATE = re.compile(r"(?:[0-9]{4}[\x20-][0-9]{2}[\x20-][0-9]{2}|[0-9]{2}[\x20-][0-9]{2}[\x20-][0-9]{4})(?![0-9])")
#: Capital ASCII letters as small ones; every character keeps its place.
_SMALL = {c: c + 32 for c in range(65, 91)}


def _luhn(digits: str) -> bool:
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def _ends_of(found: str) -> list[int]:
    """Where the whole groups of a run end, from the longest part to the shortest, as a word in capitals may follow a number."""
    return [len(found), *(k for k in range(len(found) - 1, 5, -1) if found[k] in " -")]


def account_end(found: str, rule: str) -> int:
    """How much of `found` is a number that passes its rule; 0 if nothing does.  But for bank accounts each of its groups has a digit."""
    if rule != "iban":
        found = re.match("(?:[\x20-]?[A-Z]*[0-9][A-Z0-9]*)*", found)[0]
    for end in _ends_of(found):
        plain = re.sub("[\x20-]", "", found[:end]).upper()
        digits = plain if plain.isdecimal() else ""
        if rule == "iban":
            right = 15 <= len(plain) <= 34 and plain[:2].isalpha() and plain[2:4].isdecimal() and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1
        elif rule == "ssn":
            right = len(digits) == 9 and digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000"
        elif rule == "aba":
            right = len(digits) == 9 and int(digits) > 0 and sum(int(d) * (3, 7, 1)[k % 3] for k, d in enumerate(digits)) % 10 == 0
        else:
            right = sum(c.isdecimal() for c in plain) >= 6 and not _DATE.match(found)
        if right:
            return end
    return 0


def automaton() -> ahocorasick.Automaton:
    """The anchors of all kinds, in small letters."""
    found = ahocorasick.Automaton()
    for d in "0123456789":
        found.add_word(d, (0, 1, ""))
    found.add_word("@", (1, 1, ""))
    found.add_word("+", (2, 1, ""))
    for code, cues in ((3, SCHEMES), (4, ACCOUNT_CUES), (5, SECRET_CUES), (6, KEY_FORMS)):
        for cue in cues:
            found.add_word(cue.lower(), (code, len(cue), cue))
    found.make_automaton()
    return found


def find_spans(text: str, anchors: ahocorasick.Automaton) -> list[tuple[int, int, int]]:
    """(start, kind's index, end) of all spans in order; code points, end exclusive.

    Spans of one kind never overlap.  Spans of a kind that fail their check (a part over 255, Luhn, the number of digits)
    are passed over whole and not tried again from a later start.
    """
    spans: list[tuple[int, int, int]] = []
    ends = [0] * len(KINDS)
    small = text.lower()
    for last, (code, size, cue) in anchors.iter(small if len(small) == len(text) else text.translate(_SMALL)):
        if code == 0:
            if last >= ends[2]:
                # A digit outside all runs so far starts the next maximal run of digits with single separators.
                m = _DIGITS.match(text, last)
                ends[2] = m.end() if m else last + 1
                if m:
                    digits = re.sub("[^0-9]", "", m[0])
                    if 12 <= len(digits) <= 19 and _luhn(digits):
                        spans.append((last, 2, m.end()))
            if last >= ends[1]:
                m = _QUAD.match(text, last)
                if m:
                    ends[1] = m.end()
                    if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
                        spans.append((last, 1, m.end()))
                else:
                    # No later digit of this run can start a quad either, nor an earlier part of it.
                    ends[1] = last + 1
                    while ends[1] < len(text) and "0" <= text[ends[1]] <= "9":
                        ends[1] += 1
        elif code == 1:
            start = last
            while start > ends[0] and text[start - 1] in _LOCAL:
                start -= 1
            m = _DOMAIN.match(text, last + 1) if start < last else None
            if m:
                ends[0] = m.end()
                spans.append((start, 0, m.end()))
        elif code == 2:
            if last >= ends[3] and (m := _PHONE.match(text, last)):
                ends[3] = m.end()
                if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                    spans.append((last, 3, m.end()))
        elif code == 3:
            start = last + 1 - size
            if start >= ends[4] and (m := _URL.match(text, last + 1)):
                end = last + 1 + len(m[0].rstrip(".,;:!?]"))
                if end > last + 1:
                    ends[4] = end
                    spans.append((start, 4, end))
        elif code == 6:
            start = last + 1 - size
            if start >= ends[6] and text[start : last + 1] == cue and not (start and text[start - 1].isalnum()) and (m := _KEYS[cue].match(text, last + 1)):
                ends[6] = m.end()
                spans.append((start, 6, m.end()))
        else:
            start = last + 1 - size
            if start and text[start - 1].isalnum():
                continue
            kind, parser = (5, _ACCOUNT) if code == 4 else (6, _SECRET)
            m = parser.match(text, last + 1) or (_BEARER.match(text, last + 1) if cue == "bearer" else None)
            if m and m.start(1) >= ends[kind]:
                end = m.end(1) if code == 5 else m.start(1) + (account_end(m[1], ACCOUNT_CUES[cue]) or -m.start(1))
                if end > 0:
                    ends[kind] = end
                    spans.append((m.start(1), kind, end))
    spans.sort()
    return spans


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each group of overlapping spans replaced by its first one's kind in brackets."""
    parts, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            parts += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join(parts) + text[at:] if parts else text


SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])


def _spans_array(found: list[list[tuple[int, int, int]]]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, found)])
    flat = [s for spans in found for s in spans]
    parts = [pa.array([KINDS[k] for _, k, _ in flat], pa.string()), pa.array([s for s, _, _ in flat], pa.int64()), pa.array([e for _, _, e in flat], pa.int64())]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(parts, names=["kind", "start", "end"]))


def detect(df: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """`df` with all spans of each whole text in column `out`, an array of (kind, start, end) by start, then kind.

    Positions are code points, the end exclusive.  A null or empty text has no spans.  Rows keep their number and other
    columns; an input column named `out` is replaced; an empty table gives an empty one.
    """

    def make():
        anchors = automaton()
        return lambda part: [_spans_array([find_spans(t, anchors) if t else [] for t in part.column(part.schema.get_field_index(text)).to_pylist()])]

    return append_columns(df, text, [T.StructField(out, T.ArrayType(SPAN))], make)


def mask(df: DataFrame, text: str = "text") -> DataFrame:
    """`df` with each text redacted in place; all other columns as they are.  A null text stays null."""

    def make():
        anchors = automaton()

        def one(t: str | None) -> str | None:
            return redact(t, find_spans(t, anchors)) if t else t

        return lambda part: [pa.array(list(map(one, part.column(part.schema.get_field_index(text)).to_pylist())), pa.string())]

    return append_columns(df, text, [T.StructField(text, T.StringType())], make, replace=(text,))


def digest(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def mask_documents(docs: DataFrame, text: str = "text", length: str = "n_chars") -> DataFrame:
    """mask(), and the column `length`, if there is one, set to the masked text's number of code points."""
    masked = mask(docs, text)
    if length not in masked.columns:
        return masked
    return masked.withColumn(length, F.char_length(F.col(f"`{text}`")).cast(masked.schema[length].dataType))
