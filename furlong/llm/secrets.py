"""Secret scans: fixed patterns, and strings that zstandard finds novel in context."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furlong.scale.storage import lay_down

# The base patterns and the least length of what they match.
ASSIGN = re.compile(
    r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # the maximal runs that are long enough
MIN_ASSIGN, MIN_ACCESS = 8, 16
KINDS = ("assign", "access", "hex", "novel")

# Words that make what follows them sensitive, and how far they reach.
SENSITIVE = re.compile(
    r"(?ai)auth|bearer|cert|cipher|client|cookie|credential|jwt|key|login|oauth|passphrase|passw|pin|"
    r"private|pwd|salt|secret|session|sign|token|webhook"
)
REACH = 64
CANDIDATE = re.compile(r"(?a)[A-Za-z0-9+/_.=-]{16,}")
# Names with '=' before a value that is long enough: the first, and as many as there are.
# (A candidate never holds ':'.)
_NAME, _LONG = r"[A-Za-z0-9_.-]+=+", r"(?=[A-Za-z0-9+/_.-][A-Za-z0-9+/_.=-]{15})"
NAMED = (re.compile(f"(?a)(?:{_NAME})+{_LONG}"), re.compile(f"(?a){_NAME}{_LONG}"))
# Code on either side that primes the compressor.
AROUND = 256
# A candidate is incompressible from this many marginal bytes a byte on.
NOVELTY = 0.7
# The identifier dictionary: its size, and identifiers asked for to fill it.
DICTIONARY_BYTES = 65_536
DICTIONARY_WORDS = 8_192

_CANDIDATES = "array<struct<start:int,stop:int,value:string,before:string,after:string>>"
_SPANS = "array<struct<kind:int,start:int,stop:int>>"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) in code points by start, then kind."""
    spans = [(0, m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGN]
    spans += [(1, m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    spans += [(2, m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[1], s[0]))


def candidates(text: str, spans: list[tuple[int, int, int]]) -> list[dict]:
    """Long strings in a sensitive context that no base span touches.

    Of NAME=value the value comes before the whole; the name belongs to its context.
    """
    found, at, reach = [], 0, 0
    for m in CANDIDATE.finditer(text):
        first, stop = m.span()
        # reach: the last end of all spans that begin before this string ends
        while at < len(spans) and spans[at][1] < stop:
            reach, at = max(reach, spans[at][2]), at + 1
        named = [n.end() for n in (p.match(text, first, stop) for p in NAMED) if n]
        for start in dict.fromkeys([*named, first]):
            if start < reach:
                continue
            if SENSITIVE.search(text, max(0, first - REACH), start) is None:
                continue
            before, after = text[max(0, start - AROUND) : start], text[stop : stop + AROUND]
            found.append({"start": start, "stop": stop, "value": text[start:stop], "before": before, "after": after})
    return found


class Novelty:
    """Marginal compressed bytes of a string, given code around it and a dictionary."""

    def __init__(self, identifiers: bytes):
        self._dictionary = None
        if len(identifiers) >= 8:
            self._dictionary = zstandard.ZstdCompressionDict(
                identifiers, dict_type=zstandard.DICT_TYPE_RAWCONTENT
            )
            self._dictionary.precompute_compress(level=9)

    def _size(self, data: bytes) -> int:
        kw = {"dict_data": self._dictionary} if self._dictionary else {"level": 9}
        return len(zstandard.ZstdCompressor(write_checksum=False, write_content_size=False, **kw).compress(data))

    def ratio(self, value: str, before: str, after: str) -> float:
        context = f"{before}\n{after}\n".encode("utf-8", "replace")
        secret = value.encode()
        return (self._size(context + secret) - self._size(context)) / len(secret)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans, found = [], []
        for text in batch.column(1).to_pylist():
            base = base_spans(text or "")
            spans.append([{"kind": k, "start": s, "stop": e} for k, s, e in base])
            found.append(candidates(text or "", base))
        span = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("stop", pa.int32())])
        near = pa.struct(
            [("start", pa.int32()), ("stop", pa.int32())]
            + [(n, pa.string()) for n in ("value", "before", "after")]
        )
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(spans, pa.list_(span)), pa.array(found, pa.list_(near))],
            ["_id", "_spans", "_near"],
        )


def identifier_dictionary(scanned: DataFrame, words: int = DICTIONARY_WORDS, size: int = DICTIONARY_BYTES) -> bytes:
    """The identifiers most used around candidates in all documents, most used last.

    zstandard reaches the end of a dictionary most cheaply. ``words`` and
    ``size`` bound what reaches the driver; the counts cover every candidate.
    """
    code = scanned.select(F.explode("_near").alias("c")).select(F.concat_ws("\n", "c.before", "c.after").alias("code"))
    names = code.select(F.explode(F.regexp_extract_all("code", F.lit("[A-Za-z_]{4,40}"), F.lit(0))).alias("name"))
    top = names.groupBy("name").count().orderBy(F.desc("count"), "name").limit(words).collect()
    text = " ".join(r["name"] for r in reversed(top)).encode()
    return text[-size:]


def _text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def scan_secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", novelty: float = NOVELTY
) -> DataFrame:
    """One row per document: id_col, n_assign, n_access, n_hex, n_novel, base_sha256, spans.

    Spans are ``kind:start:end`` in code points, by start and kind. Base kinds
    come from fixed patterns over the whole text; ``novel`` marks other long
    strings behind a sensitive word whose marginal compressed bytes reach
    ``novelty`` a byte; of NAME=value the value, and the name may hold the word. Null and empty texts have none. Null ids and repeated
    rows are kept as they are; an empty table gives an empty result. Other
    columns are ignored, whatever their names. A text's spans are walked once, so
    time grows in line with its length.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    scanned = lay_down(rows.mapInArrow(_scan, f"_id {id_type}, _spans {_SPANS}, _near {_CANDIDATES}"), "secret-spans")
    dictionary = identifier_dictionary(scanned)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = Novelty(dictionary)
        for batch in batches:
            counts: list[list[int]] = [[], [], [], []]
            shas, texts = [], []
            for spans, near in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                base = [(s["kind"], s["start"], s["stop"]) for s in spans]
                new: list[tuple[int, int, int]] = []
                for c in near:
                    told = new and new[-1][2] == c["stop"]  # its value is a span already
                    if not told and measure.ratio(c["value"], c["before"], c["after"]) >= novelty:
                        new.append((3, c["start"], c["stop"]))
                for k in range(4):
                    counts[k].append(sum(s[0] == k for s in base + new))
                shas.append(hashlib.sha256(_text(base).encode()).hexdigest())
                texts.append(_text(sorted(base + new, key=lambda s: (s[1], s[0]))))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(shas, pa.string()), pa.array(texts, pa.string())],
                ["_id", "n_assign", "n_access", "n_hex", "n_novel", "base_sha256", "spans"],
            )

    schema = f"_id {id_type}, n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string"
    return scanned.mapInArrow(judge, schema).withColumnRenamed("_id", id_col)
