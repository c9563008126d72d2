"""Personal data by anchor expansion.

An Aho-Corasick automaton finds at-signs, plus signs, digits, schemes and identifier cues. Local parsers grow each
anchor to the bounds of an e-mail address, network address, card, phone or account number and validate it. Text
without anchors is never parsed.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import tables

#: Kinds of the base definition, in their order, then those that this method adds.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "account", "url")
CUES = ("IBAN", "iban", "Iban", "account", "Account", "ACCOUNT", "acct", "Acct", "ACCT")
SCHEMES = ("http://", "https://", "ftp://")

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_CLUSTER = re.compile(r"[0-9().+\x20-]*")
_IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_URL = re.compile(r"[^\s<>\"']+")
_ACCOUNT = re.compile(r"(?:\x20(?:number|no\.?|id))?\x20?[:#=]?\x20?((?=[A-Z0-9-]*[0-9]{6})[A-Z0-9][A-Z0-9-]{6,33})")
_AUTOMATON: list = []


def _automaton():
    if not _AUTOMATON:
        import ahocorasick

        out = ahocorasick.Automaton()
        for word in ("@", "+", *"0123456789", *SCHEMES, *CUES):
            out.add_word(word, word)
        out.make_automaton()
        _AUTOMATON.append(out)
    return _AUTOMATON[0]


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def find_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all personal data of a text, in code points, by start and then kind.

    Base kinds are leftmost and don't overlap within their kind; candidates that fail validation are dropped.
    """
    out: list[tuple[str, int, int]] = []
    if not text:
        return out
    email_end = cluster_end = url_end = account_end = 0
    for last, word in _automaton().iter(text):
        at = last - len(word) + 1
        if word == "@":
            start = at
            while start > email_end and _LOCAL.match(text, start - 1):
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                out.append(("email", start, m.end()))
                email_end = m.end()
        elif len(word) == 1:
            if at < cluster_end:
                continue
            cluster_end = _CLUSTER.match(text, at).end()
            for m in _IP.finditer(text, at, cluster_end):
                if all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in m[0].split(".")):
                    out.append(("ip", *m.span()))
            for m in _CARD.finditer(text, at, cluster_end):
                if 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                    out.append(("card", *m.span()))
            for m in _PHONE.finditer(text, at, cluster_end):
                if 9 <= len(_digits(m[0])) <= 15:
                    out.append(("phone", *m.span()))
        elif word in SCHEMES:
            if at >= url_end and (m := _URL.match(text, last + 1)):
                out.append(("url", at, m.end()))
                url_end = m.end()
        elif at >= account_end and (m := _ACCOUNT.match(text, last + 1)):
            out.append(("account", *m.span(1)))
            account_end = m.end()
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def join_spans(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def redact_text(text: str | None) -> str | None:
    """Replace personal data, URLs apart, by the name of its kind in angle brackets; overlaps take the first kind."""
    spans = [x for x in find_spans(text) if x[0] != "url"]
    if not spans:
        return text
    merged: list[list] = []
    for kind, start, end in spans:
        if merged and start < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], end)
        else:
            merged.append([kind, start, end])
    out, at = [], 0
    for kind, start, end in merged:
        out += [text[at:start], f"<{kind.upper()}>"]
        at = end
    return "".join(out) + text[at:]


def scan_pii(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Personal data of each whole text: id_col, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    A row for each input row; a null or empty text has no spans. Repeated rows are scanned each, null ids stay null,
    other columns aren't read. A narrow stage of one pass.
    """

    tables.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [find_spans(x.as_py()) for x in batch.column(1)]
            counts = [[sum(s[0] == k for s in spans) if spans else 0 for spans in found] for k in BASE_KINDS]
            base = [join_spans([s for s in spans if s[0] in BASE_KINDS]) for spans in found]
            sums = [hashlib.sha256(x.encode()).hexdigest() for x in base]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(sums, pa.string()), pa.array([join_spans(s) for s in found], pa.string())], [id_col, *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col)).mapInArrow(run, f"{id_col} {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The same rows and columns with personal data in text_col replaced; null texts stay null."""
    schema, at = docs.schema, docs.columns.index(text_col)

    tables.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at)
            yield batch.set_column(at, batch.schema.field(at), pa.array([redact_text(x.as_py()) for x in texts], texts.type))

    return docs.mapInArrow(run, schema)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
