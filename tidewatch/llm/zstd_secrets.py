"""Secret scan by compression novelty.

Patterns find the usual shapes (key assignments, access keys, long hex strings).  On top of
that, every token of 12 or more characters near a sensitive word, before or after it, is a candidate; its novelty is the
number of bytes that zstandard needs more for the surrounding text with the token than without, given a
dictionary of identifiers.  A token that the context and the dictionary do not explain costs most of
its entropy, and is reported.  Letters alone or digits alone may be a word or a number, and a token that comes again nearby
a name (its copies are left out of the text then), so they have to cost more.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept_schema, kept_struct, prepare

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{12,}")
SENSITIVE = re.compile(r"passw|secret|token|api_?key|credential|private|bearer|auth|pwd|login|signature", re.I | re.A)
HINTS = ("pass", "secret", "token", "key", "credential", "private", "bearer", "auth", "pwd", "login", "signature")
BEFORE, AFTER = 400, 200  # characters of context that the compressor sees
NEAR = 60  # characters on either side of a candidate in which a sensitive word is looked for
NOVEL = 0.45  # bytes per character from which a candidate of letters and digits is reported
PLAIN_NOVEL = 0.8  # and one without letters or without digits: long words in prose cost 0.5 to 0.75, random strings 0.75 to 1.3

# Words that code and configuration use as identifiers, the priming dictionary.
IDENTIFIERS = (
    "access account address admin api apikey app application argument array assert async auth authorization aws await base64 "
    "bearer begin boolean branch bucket build cache callback certificate class client cloud cluster code column commit config "
    "connection const container content context cookie credential credentials data database date debug default define delete "
    "digest docker domain email encoding encrypt endpoint environment error event example exception export expression false file "
    "float folder for from function github google hash header host http https identifier image import index input insert instance "
    "integer interface internal json key kubernetes label length list local localhost location login main message method model "
    "module name namespace native network node null number object option order package parameter password path payload "
    "permission platform port primary private process production project property protected provider proxy public query read "
    "record region release remote repository request reset resource response result return role root route schema secret "
    "secret_key section select sequence server service session setting sha256 signature source ssh stack static status storage "
    "stream string struct style system table target template test text thread time timeout timestamp title token trace true type "
    "uint8 undefined update upload url user user_id username uuid value variable vector version void while window write "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 00000000 xxxxxxxx your_api_key_here changeme example.com")


@lru_cache(maxsize=1)
def _compressor() -> zstandard.ZstdCompressor:
    primed = zstandard.ZstdCompressionDict(IDENTIFIERS.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=3, dict_data=primed, write_content_size=False, write_checksum=False)


def novelty(text: str, start: int, end: int, alone: bool = False) -> float:
    """Marginal compressed bytes per character of text[start:end] in its surroundings; ``alone`` leaves its copies there out."""
    c = _compressor()
    before, after = text[max(0, start - BEFORE):start], text[end:end + AFTER]
    if alone:
        before, after = before.replace(text[start:end], ""), after.replace(text[start:end], "")
    whole = len(c.compress((before + text[start:end] + after).encode()))
    return (whole - len(c.compress((before + after).encode()))) / max(end - start, 1)


def base_spans(text: str, low: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the patterns, leftmost and non-overlapping per kind."""
    out = []
    if any(h in low for h in HINTS[:4]):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def _mixed(token: str) -> bool:
    return any(x.isdigit() for x in token) and any(x.isalpha() for x in token)


def find_secrets(text: str) -> list[tuple[int, int, int, float]]:
    """(start, kind number, end, novelty) of all spans, by start and kind."""
    low = text.lower()
    base = base_spans(text, low)
    out = [(s, k, e, novelty(text, s, e)) for s, k, e in base]
    if any(h in low for h in HINTS):
        taken = 0
        spans = sorted((s, e) for s, _, e in base)
        for m in CANDIDATE.finditer(text):
            s, e = m.span()
            while taken < len(spans) and spans[taken][1] <= s:
                taken += 1
            if taken < len(spans) and spans[taken][0] < e:
                continue  # a pattern has it already
            if SENSITIVE.search(text, max(0, s - NEAR), s) or SENSITIVE.search(text, e, e + NEAR):
                copies = text.count(m[0], max(0, s - BEFORE), e + AFTER) > 1
                v = novelty(text, s, e, copies)
                if v >= (NOVEL if _mixed(m[0]) and not copies else PLAIN_NOVEL):
                    out.append((s, 3, e, v))
    return sorted(out)


def redact(text: str, spans: list, mark: str = "[SECRET]") -> str:
    out, at = [], 0
    for s, _, e, _ in spans:
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]])


def scan_secrets(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_redacted: bool = False,
                 keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: id, n_assign, n_access, n_hex, base_sha256 (of the pattern spans), spans (all spans as
    kind:start:end by start and kind, comma-joined), novelty (array, one value per span), with ``with_redacted``
    the text with every span replaced, and with ``keep`` a struct kept of the columns it names.

    Offsets are code points, ends exclusive.  A null text counts as empty and stays null when redacted.  Repeated rows
    give the same row each; other columns are ignored.  Rows are independent: nothing is shuffled.
    """
    prepare(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), *kept_struct(docs, keep))

    def scan(batches):
        for pdf in batches:
            out = []
            for text in pdf["text"]:
                spans = find_secrets(text) if text else []
                count = [sum(1 for x in spans if x[1] == k) for k in range(3)]
                said = [f"{KINDS[k]}:{s}:{e}" for s, k, e, _ in spans]
                base = ",".join(x for x, y in zip(said, spans) if y[1] < 3)
                out.append((*count, hashlib.sha256(base.encode()).hexdigest(), ",".join(said), [x[3] for x in spans],
                            redact(text, spans) if with_redacted and text is not None else None))
            found = pd.DataFrame(out, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans", "novelty", "redacted"])
            yield pd.concat([pdf.drop(columns=["text"]).reset_index(drop=True), found], axis=1)

    out = rows.mapInPandas(scan, ", ".join([f"id {kind}", *kept_schema(docs, keep), "n_assign long, n_access long, n_hex long, base_sha256 string, "
                                            "spans string, novelty array<double>, redacted string"]))
    names = ["n_assign", "n_access", "n_hex", "base_sha256", "spans", "novelty", *(["redacted"] if with_redacted else [])]
    return out.select(F.col("id").alias(id_col), *names, *(["kept"] if keep else []))
