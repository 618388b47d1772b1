"""Secret scanning: keyword automaton, anchored expressions, checksums.

One Aho-Corasick pass over the ASCII-lowered text finds keyword hits; an
expression is tried only at a hit (or at the place it implies), and a match of
a checksummed kind counts only if the embedded check is right.  Bare hex runs
have no keyword; a single character-class scan finds them.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchline.session import bounded_batches

#: Kinds in listing order; the first three are the base kinds.
KINDS = ("assign", "access", "hex", "github", "npm", "jwt", "private_key", "google", "slack", "stripe", "gitlab", "pypi", "card")
BASE_KINDS = KINDS[:3]
SPANS = "spans array<struct<kind:string,start:int,end:int>>"

# Keywords (ASCII lower case) and the kind each announces.
KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign",
    "akia": "access",
    "ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github",
    "npm_": "npm",
    "eyj": "jwt",
    "-----begin ": "private_key",
    "aiza": "google",
    "xoxa-": "slack", "xoxb-": "slack", "xoxp-": "slack", "xoxr-": "slack", "xoxs-": "slack",
    "sk_live_": "stripe", "rk_live_": "stripe",
    "glpat-": "gitlab",
    "pypi-ageichlwas5vcmc": "pypi",
    "card number": "card", "card no": "card", "cardnumber": "card", "card_number": "card",
}

ANCHORED = {
    "assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "github": re.compile(r"gh[pousr]_[0-9A-Za-z]{36}(?![0-9A-Za-z])"),
    "npm": re.compile(r"npm_[0-9A-Za-z]{36}(?![0-9A-Za-z])"),
    "jwt": re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{4,}\.[A-Za-z0-9_-]*"),
    "private_key": re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----[A-Za-z0-9+/=\s]*-----END \1-----"),
    "google": re.compile(r"AIza[0-9A-Za-z_-]{35}(?![0-9A-Za-z_-])"),
    "slack": re.compile(r"xox[abprs]-[0-9]{6,}(?:-[0-9A-Za-z]{6,})+"),
    "stripe": re.compile(r"[sr]k_live_[0-9A-Za-z]{24,}"),
    "gitlab": re.compile(r"glpat-[0-9A-Za-z_-]{20,}"),
    "pypi": re.compile(r"pypi-AgEIcHlwaS5vcmc[0-9A-Za-z_-]{50,}"),
    "card": re.compile(r"card[_ ]?n(?:umber|o)\.?[\"']?\x20*[:=]?\x20*[\"']?([0-9](?:[ -]?[0-9]){12,18})(?![0-9])", re.IGNORECASE | re.ASCII),
}
#: A jwt's first part; where it ends does not depend on where in it a match is tried.
JWT_RUN = re.compile(r"[A-Za-z0-9_-]*")
HEX_RUN = re.compile(r"[0-9a-f]{24,}")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def base62_crc(body: str) -> str:
    """CRC-32 of ``body`` in six base-62 digits, as token formats embed it."""
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, r = divmod(n, 62)
        out = BASE62[r] + out
    return out


def _jwt_header(token: str) -> bool:
    head = token.split(".", 1)[0]
    try:
        return "alg" in json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
    except (ValueError, binascii.Error, TypeError):
        return False


def luhn(digits: str) -> bool:
    """Whether the last digit is the check digit of the rest."""
    values = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(v - 9 if v > 9 else v for v in values) % 10 == 0


def _valid(kind: str, m: re.Match) -> bool:
    """What a match must hold to count; a failing match still uses up its text."""
    if kind == "assign":
        return m.end(2) - m.start(2) >= 6
    if kind == "access":
        return m.end() - m.start() >= 20
    if kind in ("github", "npm"):
        body = m.group().split("_", 1)[1]
        return base62_crc(body[:30]) == body[30:]
    if kind == "jwt":
        return _jwt_header(m.group())
    if kind == "card":
        return luhn(re.sub("[^0-9]", "", m.group(1)))
    return True


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        a.add_word(word, (kind, len(word)))
    a.make_automaton()
    return a


def find(text: str, automaton: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) in code points, by start, then kind as listed.

    Matches of a kind are leftmost and do not overlap: a hit inside the
    previous match of its kind is passed over, whether or not that one counted.
    """
    if text.isascii():
        low = text.lower()
    else:
        low = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # A-Z only, same length
    hits = sorted((at - n + 1, kind) for at, (kind, n) in automaton.iter(low))
    found, past = [], dict.fromkeys(KINDS, 0)
    for start, kind in hits:
        if start < past[kind]:
            continue
        if m := ANCHORED[kind].match(text, start):
            past[kind] = m.end()
            if _valid(kind, m):
                found.append((kind, start, m.end()))
        elif kind == "jwt" and text.startswith("eyJ", start):
            past[kind] = JWT_RUN.match(text, start).end()  # the rest of the run fails for the same reason
    found += [("hex", m.start(), m.end()) for m in HEX_RUN.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, spans)`` for each row; a null or clean text has no spans."""
    bounded_batches(docs.sparkSession)

    @F.pandas_udf(SPANS.removeprefix("spans "))
    def spans(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        a = _automaton()
        for texts in batches:
            yield pd.Series([[dict(zip(("kind", "start", "end"), s)) for s in find(t, a)] for t in texts], dtype=object)

    # ids stay in the JVM: a null among them would make them floating point
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), spans(F.coalesce(F.col(text_col), F.lit(""))).alias("spans"))


def mask(text: str, spans: list[tuple[str, int, int]]) -> str:
    """``text`` with each maximal run of overlapping spans replaced by its first kind."""
    out, at, i = [], 0, 0
    while i < len(spans):
        kind, start, end = spans[i]
        while i < len(spans) and spans[i][1] < end:
            end = max(end, spans[i][2])
            i += 1
        out += [text[at:start], f"<{kind.upper()}>"]
        at = end
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the secrets in ``text_col`` replaced; all other columns as they are.

    Only texts leave the JVM, so that other columns keep their values whatever
    their types.  A null text stays null; a column ``n_chars``, if there is
    one, is counted anew.
    """
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("string")
    def masked(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        a = _automaton()
        for texts in batches:
            yield pd.Series([mask(t, s) if t and (s := find(t, a)) else t for t in texts], dtype=object)

    out = docs.withColumn(text_col, masked(text_col))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(text_col).isNull(), F.col("n_chars")).otherwise(F.length(text_col)).cast(docs.schema["n_chars"].dataType))
    return out
