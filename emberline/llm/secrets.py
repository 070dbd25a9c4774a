"""Secrets in texts: fixed patterns, and windows of high Shannon entropy.

A window of constant length slides over every candidate string of a character class. Its entropy is kept by counts: one character comes in, one
goes out, and only their two terms of the sum change, so a candidate costs one step per character whatever the window. Windows at
or above the class's threshold that also mix digits and letters are joined into spans, also where a fixed pattern has one. An allow-list drops
what is known to be harmless: digests that say they are one, and segments of a candidate that hold a UUID, a sequence, a placeholder, or
what the caller adds. The host and the plain path of an address are cut out
of candidates; its user part, its query and fragment, and all that stands before and after it are scanned.

Defined results: a null or empty text has no spans; repeated rows are scanned each for itself; texts are scanned whole, in one pass each, at
any length; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from emberline.llm.common import importable, map_batches

# Patterns of the fixed kinds (fixed values); a match counts with this many characters in the group.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
# An address from its marker to the first blank, quote, comma, bracket or angle sign, or where its query or fragment begins.
ADDRESS = re.compile(r"""(?:://|(?<![A-Za-z0-9.])www\.)(\[[0-9A-Fa-f:.]*\])?[^\s"'`“”‘’,()\[\]{}<>|\\^?#&;]*""")
# What in the part up to the first slash says that a user part comes first: its end, or a colon without a port.
USER = re.compile(r"@|:(?!\d{0,5}(?:/|$))")
SEGMENT = re.compile(r"[^/=]+")
# So much of the token before a candidate is looked at.
BEFORE = 256
KINDS = ("assign", "access", "hex", "entropy")


@dataclass(frozen=True)
class CharacterClass:
    """A candidate is a whole run of the class's characters, ``window`` long at least."""

    name: str
    characters: str
    window: int
    bits: float


@dataclass(frozen=True)
class Settings:
    classes: tuple[CharacterClass, ...] = (
        CharacterClass("hexadecimal", "0-9a-fA-F", 20, 3.0),
        CharacterClass("base64", "A-Za-z0-9+/_=-", 20, 3.75),
    )
    # A window holds this many digits and letters at least: words of a language have no digits, numbers no letters.
    digits_least: int = 2
    letters_least: int = 2
    # A candidate after one of these, in the same blank-free token or within 16 characters, is no secret: named digests.
    allowed_before: tuple[str, ...] = (r"(?i:sha-?\d*|md5|digest|checksum|etag|commit|integrity)\W{0,3}$",)
    # Segments of a candidate (``/`` and ``=`` part them) that match one of these are no part of it, nor are those that a longer match touches.
    allowed: tuple[str, ...] = (
        r"^(?:[A-Za-z][\w-]*=)?[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
        r"(?i:example|placeholder|changeme|dummy|xxxxxx)",
        r"0123456789|abcdefghij|ABCDEFGHIJ",
    )
    extra_allowed: tuple[str, ...] = field(default=())


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the fixed kinds, leftmost and without overlap within a kind."""
    spans: list[tuple[int, str, int]] = []
    low = text.lower()
    if any(word in low for word in ASSIGN_WORDS):
        spans += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        spans += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    spans += [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    return spans


def plain_addresses(text: str) -> list[tuple[int, int]]:
    """(start, end) of the hosts and plain paths of addresses."""
    found = []
    for m in ADDRESS.finditer(text):
        start, end = m.span()
        if text[start] == ":" and not m.group(1):
            slash = text.find("/", start + 3, end)
            if USER.search(text[start + 3 : slash if slash >= 0 else end]):
                # A password may hold a slash. Without a sign for the end of the user part nothing says where the host is.
                at = text.rfind("@", start + 3, end)
                found.append((start, start + 3))
                start = at + 1 if at >= 0 else end
        # A value with a name is none of the path.
        while (named := text.find("=", start, end)) >= 0:
            found.append((start, max(start, text.rfind("/", start, named) + 1)))
            slash = text.find("/", named, end)
            start = slash if slash >= 0 else end
        found.append((start, end))
    return found


def without_parts(start: int, end: int, parts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What of a span is in none of the sorted ``parts``."""
    out = []
    at = max(0, bisect_right(parts, (start, 1 << 62)) - 1)
    while at < len(parts) and parts[at][0] < end:
        s, e = parts[at]
        if s > start:
            out.append((start, s))
        start, at = max(start, e), at + 1
    return [*out, (start, end)] if start < end else out


def high_windows(run: str, window: int, bits: float, digits_least: int, letters_least: int) -> list[tuple[int, int]]:
    """Joined spans of the windows of ``run`` whose entropy reaches ``bits``.

    With counts c over a window of w characters the entropy is log2(w) - sum(c log2 c) / w; only the two counts that change are
    taken out of the sum and put back.
    """
    if len(run) < window:
        return []
    terms = [0.0, 0.0, *(c * math.log2(c) for c in range(2, window + 1))]
    most = window * (math.log2(window) - bits) + 1e-9
    counts: dict[str, int] = {}
    total, digits, letters = 0.0, 0, 0
    found: list[tuple[int, int]] = []
    for at, incoming in enumerate(run):
        if at >= window:
            outgoing = run[at - window]
            c = counts[outgoing]
            total += terms[c - 1] - terms[c]
            counts[outgoing] = c - 1
            digits -= outgoing.isdigit()
            letters -= outgoing.isalpha()
        c = counts.get(incoming, 0)
        total += terms[c + 1] - terms[c]
        counts[incoming] = c + 1
        digits += incoming.isdigit()
        letters += incoming.isalpha()
        begins = at - window + 1
        if begins >= 0 and total <= most and digits >= digits_least and letters >= letters_least:
            if found and begins <= found[-1][1]:
                found[-1] = (found[-1][0], at + 1)
            else:
                found.append((begins, at + 1))
    return found


class Scanner:
    def __init__(self, settings: Settings = Settings()):
        self.settings = settings
        # A run is met once, at its start; possessive, so that a short run is not tried again from each of its characters.
        self.runs = [
            (c, re.compile(rf"(?<![{c.characters}])[{c.characters}]{{{c.window},}}+")) for c in settings.classes
        ]
        self.before = [re.compile(p) for p in settings.allowed_before]
        self.allowed = [re.compile(p) for p in (*settings.allowed, *settings.extra_allowed)]
        self.digit = re.compile(r"[0-9]")

    def follows_allowed(self, text: str, start: int) -> bool:
        """Up to three characters of the candidate count, as ``//`` of an address belongs to it."""
        before = text[max(0, start - BEFORE) : start]
        token = re.split(r"\s", before)[-1]
        seen = (token if len(token) > 16 else before[-16:]) + text[start : start + 3]
        return any(p.search(seen) or p.search(before[-16:]) for p in self.before)

    def allowed_parts(self, run: str) -> list[tuple[int, int]]:
        """The segments that an allowed pattern matches, alone or with what stands about them, in whole."""
        segments = [m.span() for m in SEGMENT.finditer(run)]
        starts = [s for s, _ in segments]
        found = [(s, e) for s, e in segments if any(p.search(run[s:e]) for p in self.allowed)]
        for p in self.allowed:
            for m in p.finditer(run):
                first, last = bisect_right(starts, m.start()) - 1, bisect_right(starts, max(m.start(), m.end() - 1)) - 1
                if first >= 0:
                    found.append((segments[first][0], max(segments[last][1], m.end())))
        return joined(found)

    def high(self, run: str, c: CharacterClass) -> list[tuple[int, int]]:
        return high_windows(run, c.window, c.bits, self.settings.digits_least, self.settings.letters_least)

    def spans(self, text: str) -> list[tuple[int, str, int]]:
        base = base_spans(text)
        found: list[tuple[int, int]] = []
        if self.digit.search(text):
            plain = joined(plain_addresses(text))
            for c, runs in self.runs:
                for at, end in (x for m in runs.finditer(text) for x in without_parts(*m.span(), plain)):
                    run = text[at:end]
                    if len(run) < c.window or self.follows_allowed(text, at):
                        continue
                    for s, e in without_parts(0, len(run), self.allowed_parts(run)) if self.high(run, c) else ():
                        found += [(at + s + x, at + s + y) for x, y in self.high(run[s:e], c)]
        base += [(s, "entropy", e) for s, e in joined(found)]
        return sorted(base, key=lambda x: (x[0], KINDS.index(x[1])))


def joined(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """doc_id and spans (kind, start, end), in code points, end exclusive, by start and kind."""

    def scan(columns: dict[str, list]) -> dict[str, list]:
        scanner = Scanner(settings)
        spans = [
            [{"kind": k, "start": s, "end": e} for s, k, e in scanner.spans(t)] if t else [] for t in columns["text"]
        ]
        return {"doc_id": columns["doc_id"], "spans": spans}

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(rows, scan, "doc_id long, spans array<struct<kind:string,start:int,end:int>>")


def redact(docs: DataFrame, text_col: str = "text", marker: str = "[SECRET]", settings: Settings = Settings()) -> DataFrame:
    """All columns of ``docs``; in the text every span, joined where spans meet, is replaced by ``marker``."""

    def clean(texts: pd.Series) -> pd.Series:
        scanner = Scanner(settings)

        def one(text):
            if not text:
                return text
            out, at = [], 0
            for s, e in joined((s, e) for s, _, e in scanner.spans(text)):
                out += [text[at:s], marker]
                at = e
            return "".join([*out, text[at:]]) if out else text

        return texts.map(one)

    return importable(docs).withColumn(text_col, F.pandas_udf(clean, "string")(F.col(text_col)))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op1_entropy_windows(spark, sf_dir: str) -> DataFrame:
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] != "entropy")
    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in KINDS[:3]],
        F.sha2(_listed(base), 256).alias("base_sha256"),
        _listed(F.col("spans")).alias("spans"),
        count("entropy").alias("n_entropy"),
    )
