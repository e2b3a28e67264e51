"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

Patterns for e-mail addresses, IP addresses, card numbers and international phone numbers form
the base: leftmost, non-overlapping for each kind, dropped without a retry where the check fails
(octets, Luhn, number of digits). Further kinds start with a score below the threshold unless a
checksum or a published shape confirms them (IBAN: mod-97; access keys that providers mark by a
prefix) and reach it with context words nearby: access tokens of any length, national identity numbers, phone
numbers without a country code. Passwords are what is assigned to a word for one. They never
replace a base span; of those that overlap the higher score stays, then the earlier one.

An IBAN may be followed by further capitals or digits (a bank's code, say): the longest run that
ends a word and passes the checksum counts; shorter ones than the whole run only in groups of four
or in one piece.

Defined results: a null text has no spans (and stays null when masked), an empty one none. A text of
any length is searched whole, in time linear but for sorting. Of equal spans of two kinds the first kind
in the order of ``KINDS`` comes first. Rows are judged one by one, so repeated rows give repeated
results; an empty table gives no rows. Other columns pass through; the added column takes underscores
if its name is taken.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keysnap.llm.common import map_text, unused

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "token", "national_id", "local_phone", "key", "password")
THRESHOLD = 0.6
NEAR = 40  # characters on either side in which context words count

SPAN = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("start", T.LongType()),
        T.StructField("end", T.LongType()),
        T.StructField("score", T.DoubleType()),
    ]
)

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile(r"[0-9]")
# A match cannot begin inside a run of digits whose start fails, so only starts are tried.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_PRINTED = re.compile(r"(?:[A-Z0-9]{4} )*[A-Z0-9]{1,4}|[A-Z0-9]{15,34}")
_TOKEN = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{24,}+")
# Published prefixes and lengths of access keys, signed web tokens, and PEM blocks.
_KEY = re.compile(
    r"(?<![A-Za-z0-9_-])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|AIza[A-Za-z0-9_-]{35}|gh[oprsu]_[A-Za-z0-9]{36,}+"
    r"|xox[abprs]-[A-Za-z0-9-]{10,}+|[rs]k_live_[A-Za-z0-9]{16,}+"
    r"|eyJ[A-Za-z0-9_-]{10,}+\.eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+)(?![A-Za-z0-9_-])"
    r"|-----BEGIN (?:[A-Z]{2,9} ){0,2}PRIVATE KEY-----[A-Za-z0-9+/=\s]*+(?:-----END (?:[A-Z]{2,9} ){0,2}PRIVATE KEY-----)?"
)
_PASSWORD = re.compile(r"(?i)\b(?:password|passwd|passphrase|pwd)[ \t]{0,8}[:=][ \t]{0,8}[\"']?([^\s\"'<>]{6,})")
_NATIONAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])")
CONTEXT = {
    "iban": re.compile(r"(?i)\b(?:iban|account|konto|compte|cuenta)\b"),
    "token": re.compile(r"(?i)(?:token|secret|api[_ -]?key|passw|bearer|credential)"),
    "national_id": re.compile(r"(?i)\b(?:ssn|social security|national id|tax id)\b"),
    "local_phone": re.compile(r"(?i)\b(?:phone|tel|call|fax|mobile|telefon|tel[eé]fono)\b"),
}
START_SCORE = {"iban": 0.9, "token": 0.3, "national_id": 0.3, "local_phone": 0.3, "key": 0.95, "password": 0.7}
CONTEXT_SCORE = 0.5


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    plain = iban.replace(" ", "")
    turned = plain[4:] + plain[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _emails(text: str) -> list[tuple[int, int]]:
    """As the pattern finds them, but from each ``@`` outwards: linear in any text."""
    found, done = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return found


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _near(kind: str, text: str, start: int, end: int) -> float:
    if kind not in CONTEXT:
        return 0.0
    hit = CONTEXT[kind].search(text[max(0, start - NEAR) : start]) or CONTEXT[kind].search(
        text[end : end + NEAR]
    )
    return CONTEXT_SCORE if hit else 0.0


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """Longest runs that pass, from each place where one may begin outside of an earlier one."""
    m = _IBAN.search(text)
    while m:
        start, whole = m.span()
        ends = [whole]
        ends += [e for e in range(whole - 1, start + 14, -1) if text[e] == " " and _PRINTED.fullmatch(text, start, e)]
        end = next((e for e in ends if mod97(text[start:e])), None)
        if end:
            yield start, end
        m = _IBAN.search(text, end or start + 4)


def _odd(word: str) -> bool:
    """Has a digit, and something else than digits."""
    return any("0" <= c <= "9" for c in word) and not word.isdigit()


def _joined(spans: Iterator[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, overlapping ones as one."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def find_spans(text: str | None) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by start and kind; ends are exclusive, in code points."""
    if not text:
        return []
    found = [("email", s, e, 1.0) for s, e in _emails(text)] if "@" in text else []
    first = _DIGIT.search(text)
    if first is None:
        return found
    for m in _IP.finditer(text, first.start()):
        if all(map(_small, m.group().split("."))):
            found.append(("ip", m.start(), m.end(), 1.0))
    for m in _CARD.finditer(text, first.start()):
        if m.end() - m.start() >= 12:
            digits = _digits(m.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", m.start(), m.end(), 1.0))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m.group())) <= 15:
                found.append(("phone", m.start(), m.end(), 1.0))
    more = [("iban", s, e) for s, e in _ibans(text)]
    for m in _TOKEN.finditer(text):
        if any("0" <= c <= "9" for c in m.group()):
            more.append(("token", m.start(), m.end()))
    more += [("national_id", m.start(), m.end()) for m in _NATIONAL.finditer(text)]
    more += [("local_phone", m.start(), m.end()) for m in _LOCAL_PHONE.finditer(text)]
    more += [("key", m.start(), m.end()) for m in _KEY.finditer(text)]
    more += [("password", *m.span(1)) for m in _PASSWORD.finditer(text) if _odd(m.group(1))]
    if more:
        scored = [(k, s, e, START_SCORE[k] + _near(k, text, s, e)) for k, s, e in more]
        scored = [x for x in scored if x[3] >= THRESHOLD]
        taken = _joined((s, e) for _, s, e, _ in found)
        for k, s, e, score in sorted(scored, key=lambda x: (-x[3], x[1], KINDS.index(x[0]))):
            at = bisect_left(taken, (e,))  # the spans before it begin ahead of the end
            if not at or taken[at - 1][1] <= s:
                found.append((k, s, e, min(score, 1.0)))
                insort(taken, (s, e))
    found.sort(key=lambda x: (x[1], KINDS.index(x[0])))
    return found


def mask_text(text: str | None) -> str | None:
    """The text with each span, or run of overlapping spans, replaced by its first kind."""
    spans = find_spans(text)
    if not spans:
        return text
    out, done, kind_end = [], 0, -1
    for kind, start, end, _ in spans:
        if start < kind_end:  # overlaps what is already masked
            kind_end = done = max(kind_end, end)
            continue
        out += [text[done:start], f"[{kind.upper()}]"]
        kind_end = done = end
    return "".join([*out, text[done:]])


def find_pii(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default: all but the text) and an array of spans."""
    keep = [c for c in df.columns if c != text] if keep is None else keep
    name = unused(df, "spans")
    fields = T.StructType([T.StructField(name, T.ArrayType(SPAN))])

    def each():
        return lambda t: ([dict(zip(("kind", "start", "end", "score"), s)) for s in find_spans(t)],)

    return map_text(df, text, fields, each, keep)


def mask_pii(df: DataFrame, text: str = "text", n_chars: str | None = None) -> DataFrame:
    """``df`` with spans masked; ``n_chars``, if named, becomes the new length in code points."""
    fields = T.StructType([T.StructField(unused(df, "masked"), T.StringType())])
    masked = map_text(df, text, fields, lambda: lambda t: (mask_text(t),), df.columns)
    new = F.col(fields.names[0])
    out = masked.withColumn(text, new)
    if n_chars:
        out = out.withColumn(n_chars, F.char_length(new).cast(df.schema[n_chars].dataType))
    return out.select(df.columns)


def pii_digest(found: DataFrame, doc_id: str = "doc_id", spans: str = "spans") -> DataFrame:
    """Counts and digests of found spans, one row per document."""
    def joined(which):
        return F.array_join(
            F.transform(which, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
        )

    every = F.col(spans)
    base = F.filter(every, lambda s: s["kind"].isin(*BASE))

    def count(kind):  # one argument for the lambda: a second one would be the position
        return F.size(F.filter(every, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in BASE]
    return found.select(
        doc_id,
        *counts,
        F.sha2(F.encode(joined(base), "utf-8"), 256).alias("base_sha256"),
        joined(every).alias("spans"),
    )
