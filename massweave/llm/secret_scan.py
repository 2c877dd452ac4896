"""Secret scans: fixed patterns, and strings whose bytes zstandard can't find in their surroundings.

The patterns give the base spans. The method measures every candidate in a sensitive context, inside base spans too: the
bytes that it adds when compressed against a dictionary of common identifiers and the code around it. What hardly compresses
and doesn't read like words is reported as ``novel``. A long run is measured in pieces, as entropy coding alone makes a long random string shorter.

Sensitive contexts: a run of 16 or more key characters with a sensitive word among the last NEAR characters before it that aren't blank
(at most LOOK characters back); such a run inside the armour of a private key, however far from its first line; the password of
an address ``scheme://user:password@host``, of 8 characters or more. A candidate reads like words if, cut where case, letters and
digits change, most of it is pieces of three letters or more and many of their pairs of letters are common in words.

Defined results: a null or empty text has no spans (the digest of no spans is that of the empty
string); rows keep their ``doc_id``, repeated or null; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from massweave.llm.arrow import by_bytes, table
from massweave.llm.common import small_batches

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
#: Words without which ASSIGN can't match.
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: A run is taken whole, so a least length leaves the same matches as dropping the short ones.
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_LEAST = 12

SENSITIVE = ("password", "passwd", "pwd", "secret", "token", "key", "auth", "credential", "bearer", "private", "signature")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}", re.ASCII)
ARMOUR = re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----(.*?)(?:-----END|\Z)", re.DOTALL)
ADDRESS = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*://[^\s/:@]*:([^\s/@]{8,})@", re.ASCII)
#: Characters before a candidate, blanks not counted, in which a sensitive word must stand; how far back they may be; those around it that prime the dictionary.
NEAR, LOOK, AROUND = 40, 400, 600
#: Added bytes for each character from which a candidate is novel.
NOVEL = 0.85
#: Characters of a piece; so few aren't worth an entropy code.
PIECE = 32
#: Identifiers that code is full of.
IDENTIFIERS = (
    "username user_id client_id client_secret access_token refresh_token session_id authorization content_type application_json "
    "configuration connection_string database_url endpoint hostname localhost example.com return import export function public static "
    "private_key public_key certificate request response headers timeout default production development environment variable parameter "
    "getUser setUser Account Settings Database Connection Service Manager Controller Factory Handler Provider Repository Instance Context Session "
    "Message Response Request Resource Element Property Attribute Template Component Interface Implementation Exception Validation Authentication "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 0000000000000000 xxxxxxxxxxxxxxxx your_api_key_here changeme placeholder"
)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans (start, end, kind) of the patterns, in code points."""
    found = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(*m.span(), "access") for m in ACCESS.finditer(text)]
    found += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return found


def compressor(around: str):
    """zstandard primed with identifiers and what stands around."""
    import zstandard

    prime = zstandard.ZstdCompressionDict((IDENTIFIERS + " " + around).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=19, dict_data=prime, write_content_size=False, write_checksum=False, write_dict_id=False)


def added_bytes(candidate: str, around: str) -> int:
    """Bytes that the candidate adds when compressed against identifiers and what stands around it."""
    press = compressor(around)
    return len(press.compress(candidate.encode())) - len(press.compress(b""))


def is_novel(candidate: str, around: str) -> bool:
    """Whether the candidate hardly compresses: as a whole, or in pieces where it doesn't repeat itself (as a whole near its alphabet's bound)."""
    n, whole = len(candidate), added_bytes(candidate, around)
    if whole >= NOVEL * n:
        return True
    if n <= PIECE or whole < NOVEL * n * math.log2(len(set(candidate))) / 8:
        return False
    press, parts = compressor(around), -(-n // PIECE)
    none = len(press.compress(b""))
    cuts = [n * k // parts for k in range(parts + 1)]
    return sum(len(press.compress(candidate[a:b].encode())) - none for a, b in zip(cuts, cuts[1:])) >= NOVEL * n


#: Parts of a candidate: a capitalised or lower-case word, capitals, or anything else of one kind.
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+|[^A-Za-z0-9]+|[A-Z]")
#: The most common pairs of letters in English words.
PAIRS = frozenset(
    "th he in er an re nd at on nt ha es st en ed to it ou ea hi is or ti as te et ng of al de se le sa si ar ve ra ld ur ic io ne me co li ri ro ch ll be ma "
    "om ca us ce ta la el ho ns em di ec pr tr su ac ke ss tu un id pe ct rs so ge wh ut ot no po pa mo ig vi ey ay ry ty ly da".split()
)
#: The part of a candidate that must be pieces of three letters or more, and of their pairs of letters that must be common ones.
READS, COMMON = 0.7, 0.4


def reads_like_words(candidate: str) -> bool:
    words = [p.lower() for p in PARTS.findall(candidate) if len(p) >= 3 and p.isalpha()]
    pairs = [w[i : i + 2] for w in words for i in range(len(w) - 1)]
    return sum(map(len, words)) >= READS * len(candidate) and sum(p in PAIRS for p in pairs) >= COMMON * len(pairs)


def candidates(text: str) -> list[tuple[int, int]]:
    """Strings in a sensitive context, in order."""
    low = text.lower()
    found = {m.span(1) for m in ADDRESS.finditer(text)} if "://" in text else set()
    if any(w in low for w in SENSITIVE):
        armoured = [m.span(1) for m in ARMOUR.finditer(text)] if "-----BEGIN" in text else []
        k = 0
        for m in CANDIDATE.finditer(text):
            a, b = m.span()
            while k < len(armoured) and armoured[k][1] <= a:
                k += 1
            inside = k < len(armoured) and armoured[k][0] <= a
            if inside or any(w in "".join(low[max(0, a - LOOK) : a].split())[-NEAR:] for w in SENSITIVE):
                found.add((a, b))
    return sorted(found)


def novel_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans of the candidates that are novel where they stand."""
    return [(a, b, "novel") for a, b in candidates(text) if not reads_like_words(text[a:b]) and is_novel(text[a:b], text[max(0, a - AROUND) : a] + text[b : b + AROUND])]


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]))))


def secret_spans(docs: DataFrame) -> DataFrame:
    """``doc_id, found`` for each row; ``found``: spans (kind, first, last, secret) with the text they cover."""

    def scan(batches):
        schema = None
        for batch, texts in by_bytes(batches):
            span = pa.struct([("kind", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("secret", pa.string())])
            schema = schema or pa.schema([batch.schema.field("doc_id"), ("found", pa.list_(span))])
            out = []
            for text in texts:
                base = base_spans(text)
                every = sorted(base + novel_spans(text), key=lambda s: (s[0], KINDS.index(s[2])))
                out.append([{"kind": k, "first": a, "last": b, "secret": text[a:b]} for a, b, k in every])
            yield table(schema, doc_id=batch.column("doc_id"), found=out)

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return small_batches(rows).mapInArrow(scan, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, found array<struct<kind:string,first:bigint,last:bigint,secret:string>>")


def secret_digest(docs: DataFrame) -> DataFrame:
    """Counts by kind, the digest of the base spans and all spans, for each row."""
    named = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["first"], s["last"])), ",")
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("bigint")
    return secret_spans(docs).select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in KINDS if k != "novel"],
        F.sha2(named(F.filter("found", lambda s: s["kind"] != "novel")), 256).alias("base_sha256"),
        named(F.col("found")).alias("spans"),
        count("novel").alias("n_novel"),
    )
