"""Secrets in texts: fixed patterns, and strings in sensitive places that a primed compressor finds new.

A candidate is a token-like string shortly after, or around, a word such as ``token`` or ``password``.  Its novelty is measured by
zstandard: the compressor is primed with a dictionary of identifiers, and the text around the candidate is compressed with
and without it.  The difference is what the candidate costs beside its surroundings, in bytes; a name or a word
made of known parts costs little, a random key about a byte a character or more.  Candidates that cost at least ``NOVEL`` bytes a
byte are reported.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statuta.llm.text import as_bytes, id_and_text, slices

#: Fixed patterns: the kinds in their order, and the fewest characters of what counts (the value of an assignment, else the whole match).
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{16,}")
LEAST_VALUE, LEAST_ACCESS = 12, 18
KINDS = ("assign", "access", "hex", "novel")
ASSIGN_STEMS = (b"passw", b"secret", b"token", b"api")

#: Words (in lower case) that make a place sensitive, how many bytes behind them it reaches, and what a candidate looks like.
SENSITIVE = re.compile(rb"passw(?:or)?d|passphrase|pwd|secret|token|credential|bearer|oauth|authorization|signature|akia|(?:api|access|account|private|signing|encryption|shared|client)[ _-]?key")
REACH = 64
CANDIDATE = re.compile(rb"[A-Za-z0-9][A-Za-z0-9+/_.-]{15,}={0,2}")
LEAST_CANDIDATE = 16

#: Bytes of text on either side that a candidate is compared with, bytes of a piece, zstandard's level, and the bytes a byte that make it new.
AROUND, PIECE, LEVEL, NOVEL = 512, 64, 9, 0.8
IDENTIFIERS = """
    password passwd secret token api_key apikey access_key client_secret client_id private_key public_key credential credentials authorization
    authentication bearer username user_name connection_string database_url session_id refresh_token access_token signature certificate
    request response function const return static public private protected class import export default config configuration settings
    environment localhost example placeholder changeme your_api_key_here production development test undefined null true false string
    number boolean integer object array length value index name type data result error message status user account email address http https www
    com org net json xml html yaml java python javascript main src lib get set create update delete service manager handler factory
    client server session validate abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 01234567890123456789 xxxxxxxxxxxxxxxx
"""


class Novelty:
    """Marginal compressed bytes against surroundings and a dictionary of identifiers."""

    def __init__(self, identifiers: str = IDENTIFIERS, around: int = AROUND, level: int = LEVEL):
        self.around = around
        primed = zstandard.ZstdCompressionDict(" ".join(identifiers.split()).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.compressor = zstandard.ZstdCompressor(level=level, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False)

    def cost(self, text: bytes, start: int, end: int) -> int:
        """What the bytes of ``text`` from ``start`` to ``end`` cost; the same string nearby doesn't make it known."""
        it, size = text[start:end], lambda x: len(self.compressor.compress(x))
        before, after = (x.replace(it, b"") for x in (text[max(0, start - self.around) : start], text[end : end + self.around]))
        step = -(-len(it) // -(-len(it) // PIECE))
        pieces = [it[i : i + step] for i in range(0, len(it), step)]
        return sum(size(before + p + after) for p in pieces) - len(pieces) * size(before + after)


def base_spans(text: bytes) -> list[tuple[int, int, str]]:
    """The places of the fixed patterns, in bytes."""
    found, lower = [], text.lower()
    if any(stem in lower for stem in ASSIGN_STEMS):
        found += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m.group(2)) >= LEAST_VALUE]
    if b"AKIA" in text:
        found += [(*m.span(), "access") for m in ACCESS.finditer(text) if len(m.group()) >= LEAST_ACCESS]
    return found + [(*m.span(), "hex") for m in HEX.finditer(text)]


def candidates(text: bytes) -> list[tuple[int, int]]:
    """Token-like strings that begin at most ``REACH`` bytes behind a sensitive word, or hold one."""
    words = [m.span() for m in SENSITIVE.finditer(text.lower())]
    if not words:
        return []
    starts, ends, out = np.array([a for a, _ in words]), np.array([b for _, b in words]), []
    for m in CANDIDATE.finditer(text):
        start, end = m.start(), m.start() + len(m.group().rstrip(b"._-"))
        last = int(np.searchsorted(starts, end)) - 1
        if end - start >= LEAST_CANDIDATE and last >= 0 and ends[last] >= start - REACH:
            out.append((start, end))
    return out


def spans(text: bytes, novelty: Novelty, novel: float = NOVEL) -> list[tuple[str, int, int, int | None]]:
    """(kind, start, end, cost) by start, then kind; places in code points, cost in bytes and only where it was measured."""
    found = [(a, KINDS.index(kind), b, None) for a, b, kind in base_spans(text)]
    for a, b in candidates(text):
        cost = novelty.cost(text, a, b)
        if cost >= novel * (b - a):
            found.append((a, KINDS.index("novel"), b, cost))
    if not found:
        return []
    if not text.isascii():
        points = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
        found = [(int(points[a]), k, int(points[b]), cost) for a, k, b, cost in found]
    return [(KINDS[k], a, b, cost) for a, k, b, cost in sorted(found, key=lambda x: x[:3])]


def find_secrets(docs: DataFrame, novel: float = NOVEL, identifiers: str = IDENTIFIERS, around: int = AROUND, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, found (array of kind, start, end, cost).

    Kinds are ``assign`` (a sensitive name with a value of 12 characters or more), ``access`` (an access key id), ``hex`` (16 hexadecimal digits or more) and
    ``novel`` (a string in a sensitive place that costs the primed compressor ``novel`` bytes a byte or more).  Places are code points, the end
    exclusive, of the whole match; each kind is found by itself, so one secret may have spans of several kinds.  ``cost`` is in bytes, null for fixed patterns.

    Null and empty texts have no spans, a null id is kept, texts of any length are read whole, repeated rows each give their row, other columns are not
    read, and no rows give no rows.  One scan without shuffle; the dictionary has a fixed size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(identifiers, around)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("cost", pa.int64())]))
        for batch in slices(batches):
            found = [[dict(zip(("kind", "start", "end", "cost"), s, strict=True)) for s in spans(t or b"", novelty, novel)] for t in as_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, kind)], ["doc_id", "found"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, found array<struct<kind: string, start: long, end: long, cost: long>>")


def digest(found: DataFrame) -> DataFrame:
    """Per row of ``find_secrets``: doc_id, n_assign, n_access, n_hex, n_novel, base_sha256, spans."""
    of = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    joined = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("found", lambda s: s["kind"] != "novel")
    return found.select("doc_id", *[of(k).alias(f"n_{k}") for k in KINDS], F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))
