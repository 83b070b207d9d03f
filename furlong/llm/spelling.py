"""Spelling variants: words one edit apart, found by Bloom-guided neighbourhoods.

Every word's deletions and replacements are generated as hashes and probed against
blocked Bloom filters, one shard a word length, which tasks hold. Only what a filter
passes becomes a row; an exact join to the vocabulary removes false positives.
Insertions need no probing, each is another word's deletion. The filters of a pass
have a fixed most size; a larger vocabulary takes more passes, with the same result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furlong.llm.wordhash import scramble
from furlong.scale.storage import lay_down

LEAST_LETTERS = 5
LEAST_COUNT = 3
# One of so many (document, run) pairs loses a code point.
GARBLED = 97
# A word's form is so many times as frequent as the word.
FORM_FACTOR = 2
# Bits of a filter for each word, bits a word sets, and the most 64-bit blocks of a pass (32 MB).
BITS_A_WORD = 16
BITS_SET = 5
PASS_BLOCKS = 1 << 22
# Words up to this length are their own join key; longer ones have a digest.
_KEY_LETTERS = 64

_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_BREAK = re.compile("[^A-Za-zÀ-ÿ]")
_PIECE = 1 << 20  # characters of a text taken apart at once
_HELD = 1 << 19  # words counted before they are emitted
_SLAB = 1 << 13  # (word, position) pairs whose edits are generated at once
_CHUNK = 13  # filter blocks are gathered by two to this power
_LOWER = {c: c + 32 for c in range(65, 91)}

_BASE = 0x9E3779B97F4A7C15
_BACK = np.uint64(pow(_BASE, -1, 1 << 64))
_LETTER = np.random.Generator(np.random.PCG64(13)).integers(1, 1 << 63, 256, np.uint64)


# -- counting --------------------------------------------------------------


def garbled(run: str, prefix: int) -> str:
    """``run``, without one code point if its hash behind the document's says so."""
    h = zlib.crc32(run.encode(), prefix)
    if h % GARBLED:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1 :]


def _pieces(text: str) -> Iterator[str]:
    a = 0
    while a < len(text):
        b = len(text)
        if b - a > _PIECE:
            cut = _BREAK.search(text, a + _PIECE)
            b = cut.start() if cut else b
        yield text[a:b]
        a = b


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of (id, text) rows, summed within stretches of a task."""
    held: dict[str, int] = {}

    def emit() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays(
            [pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"]
        )
        held.clear()
        return out

    for batch in batches:
        for doc, raw in zip(batch.column(0), batch.column(1), strict=True):
            prefix = zlib.crc32(f"{doc.as_py() or ''}:".encode())
            for piece in _pieces((raw.as_py() or b"").decode("utf-8", "replace")):
                for run, n in Counter(_RUN.findall(piece)).items():
                    word = garbled(run.lower() if run.isascii() else run.translate(_LOWER), prefix)
                    if len(word) >= LEAST_LETTERS:
                        held[word] = held.get(word, 0) + n
                if len(held) > _HELD:
                    yield emit()
    yield emit()


def key_of(word: str) -> str:
    """The word, or a digest that is no word."""
    return word if len(word) <= _KEY_LETTERS else "#" + sha256(word.encode()).hexdigest()


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = batch.column(0).to_pylist()
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(map(len, words), pa.int32()), pa.array(map(key_of, words), pa.string())],
            ["word", "n", "size", "key"],
        )


def vocabulary(docs: DataFrame, id_col: str, text_col: str, least: int = LEAST_COUNT) -> DataFrame:
    """(word, n, size, key), stored: every word of at least ``least`` occurrences."""
    rows = docs.select(
        F.col(f"`{id_col}`").cast("string").alias("_id"), F.col(f"`{text_col}`").cast("binary").alias("_text")
    ).where(F.col("_text").isNotNull())
    counted = rows.mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    kept = counted.where(F.col("n") >= least).mapInArrow(_keyed, "word string, n long, size int, key string")
    return lay_down(kept, "spelling-words")


# -- filters ---------------------------------------------------------------


@dataclass(frozen=True)
class Shard:
    """Blocks of the words of one length, or of one part of their hashes."""

    size: int
    part: int
    parts: int
    first: int  # block
    blocks: int

    def mine(self, h: np.ndarray) -> np.ndarray:
        return scramble(h) % np.uint64(self.parts) == self.part

    def place(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(block, bits) of word hashes."""
        with np.errstate(over="ignore"):
            x = scramble(h + np.uint64(self.size))
        block = (x >> np.uint64(32)) * np.uint64(self.blocks) >> np.uint64(32)
        bits = np.zeros(len(x), np.uint64)
        for i in range(BITS_SET):
            bits |= np.uint64(1) << (x >> np.uint64(6 * i) & np.uint64(63))
        return block.astype(np.int64) + self.first, bits


def shards(counts: dict[int, int], most: int = PASS_BLOCKS) -> list[list[Shard]]:
    """Passes of shards that together have at most ``most`` blocks, for words counted by length."""
    out: list[list[Shard]] = [[]]
    used = 0
    for size, n in sorted(counts.items()):
        blocks = -(-n * BITS_A_WORD // 64)
        parts = -(-blocks // most)
        for part in range(parts):
            own = -(-blocks // parts)
            if used + own > most:
                out.append([])
                used = 0
            out[-1].append(Shard(size, part, parts, used, own))
            used += own
    return out


def _hashes(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, what each letter adds to it) of a word x letter matrix of bytes."""
    powers = np.ones(words.shape[1], np.uint64)
    with np.errstate(over="ignore"):
        np.multiply.accumulate(np.full(words.shape[1] - 1, _BASE, np.uint64), out=powers[1:])
        terms = _LETTER[words] * powers
        return terms.sum(axis=1, dtype=np.uint64), terms


def _by_length(words: list[str], most: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in ``words``, word x letter matrix) of words of one length, some letters at a time."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        step = max(1, most // int(size))
        for a in range(0, len(at), step):
            part = at[a : a + step]
            raw = "".join([words[i] for i in part]).encode("latin-1")
            yield part, np.frombuffer(raw, np.uint8).reshape(len(part), int(size))


def _fill(pass_: Sequence[Shard]):
    """Task code: (block, bits) that words set, in the shards of one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks, bits = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
            for _, letters in _by_length(batch.column(0).to_pylist()):
                h, _ = _hashes(letters)
                for s in pass_:
                    if s.size == letters.shape[1]:
                        block, set_ = s.place(h[s.mine(h)])
                        blocks.append(block)
                        bits.append(set_)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(blocks)), pa.array(np.concatenate(bits).view(np.int64))], ["block", "bits"]
            )

    return run


def _chunk(found: pa.Table) -> pa.Table:
    at = found.column("block").to_numpy()
    out = np.zeros(1 << _CHUNK, np.int64)
    np.bitwise_or.at(out, at & ((1 << _CHUNK) - 1), found.column("bits").to_numpy())
    return pa.table({"chunk": [int(at[0]) >> _CHUNK], "bits": [out.tobytes()]})


def build(words: DataFrame, pass_: Sequence[Shard]) -> np.ndarray:
    """The blocks of one pass, at most ``PASS_BLOCKS`` of 64 bits, gathered in chunks."""
    sizes = [s.size for s in pass_]
    own = words.where(F.col("size").between(min(sizes), max(sizes))).select("word")
    set_ = own.mapInArrow(_fill(pass_), "block long, bits long").groupBy("block").agg(F.bit_or("bits").alias("bits"))
    chunks = set_.groupBy(F.shiftright("block", _CHUNK).alias("c")).applyInArrow(
        lambda t: _chunk(t), "chunk long, bits binary"
    )
    out = np.zeros(-(-sum(s.blocks for s in pass_) // (1 << _CHUNK)) << _CHUNK, np.uint64)
    for r in chunks.collect():
        a = r["chunk"] << _CHUNK
        out[a : a + (1 << _CHUNK)] = np.frombuffer(r["bits"], np.uint64)
    return out


def _probe(filled: Broadcast, pass_: Sequence[Shard], alphabet: bytes):
    """Task code: (word, n, target): edits of the words that the filters pass."""
    by_size: dict[int, list[Shard]] = {}
    for s in pass_:
        by_size.setdefault(s.size, []).append(s)
    letters = np.frombuffer(alphabet, np.uint8)
    values = _LETTER[letters]

    def passed(h: np.ndarray, size: int) -> np.ndarray:
        """Places of the hashes that may be words of this length."""
        out = np.zeros(len(h), bool)
        for s in by_size.get(size, ()):
            at = np.flatnonzero(s.mine(h)) if s.parts > 1 else np.arange(len(h))
            block, bits = s.place(h[at])
            out[at] = filled.value[block] & bits == bits
        return np.flatnonzero(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0).to_pylist()
            rows: list[int] = []
            targets: list[str] = []
            for part, x in _by_length(words):
                size = x.shape[1]
                if size not in by_size and size - 1 not in by_size:
                    continue
                h, terms = _hashes(x)
                with np.errstate(over="ignore"):
                    before = np.cumsum(terms, axis=1, dtype=np.uint64) - terms
                    without = h[:, None] - terms
                    shorter = (before + (without - before) * _BACK).ravel()
                    power = _power(size)
                if size - 1 in by_size:
                    # of equal letters in a row, only the first is deleted
                    fresh = np.ones(x.shape, bool)
                    fresh[:, 1:] = x[:, 1:] != x[:, :-1]
                    at = np.flatnonzero(fresh.ravel())
                    for p in at[passed(shorter[at], size - 1)]:
                        w, i = words[part[p // size]], int(p % size)
                        rows.append(int(part[p // size]))
                        targets.append(key_of(w[:i] + w[i + 1 :]))
                if size in by_size:
                    flat, base = x.ravel(), without.ravel()
                    for a in range(0, len(flat), _SLAB):
                        # the later letter only: the other word has the earlier one
                        later = flat[a : a + _SLAB, None] < letters
                        with np.errstate(over="ignore"):
                            edits = values * power[np.arange(a, min(a + _SLAB, len(flat))) % size, None]
                            edits += base[a : a + _SLAB, None]
                        at = np.flatnonzero(later)
                        for p in at[passed(edits.ravel()[at], size)]:
                            q, c = a + int(p) // len(letters), chr(letters[int(p) % len(letters)])
                            w, i = words[part[q // size]], q % size
                            rows.append(int(part[q // size]))
                            targets.append(key_of(w[:i] + c + w[i + 1 :]))
            found = batch.select(["word", "n"]).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*found.columns, pa.array(targets, pa.string())], ["word", "n", "target"])

    return run


def _power(size: int) -> np.ndarray:
    out = np.ones(size, np.uint64)
    with np.errstate(over="ignore"):
        np.multiply.accumulate(np.full(size - 1, _BASE, np.uint64), out=out[1:])
    return out


# -- links and forms -------------------------------------------------------


def near_words(words: DataFrame, most: int = PASS_BLOCKS) -> DataFrame:
    """(word, n, near, near_n): pairs of vocabulary words one edit apart, each pair once."""
    counts = {r["size"]: r["count"] for r in words.groupBy("size").count().collect()}
    if not counts:
        return words.select("word", "n", F.col("word").alias("near"), F.col("n").alias("near_n")).where(F.lit(False))
    used = words.select(F.explode(F.split("word", "")).alias("c")).distinct().collect()
    alphabet = bytes(sorted(ord(r["c"]) for r in used if r["c"]))
    targets = words.select(F.col("key").alias("target"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    out = None
    for pass_ in shards(counts, most):
        filled = words.sparkSession.sparkContext.broadcast(build(words, pass_))
        passed = words.select("word", "n").mapInArrow(
            _probe(filled, pass_, alphabet), "word string, n long, target string"
        )
        links = lay_down(passed.join(targets, "target").drop("target"), "spelling-links")
        filled.unpersist()
        out = links if out is None else out.unionByName(links)
    return out


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form) rows: pointers are doubled until they stand still.

    Counts at least double along a chain, so a few rounds do.
    """
    hops = lay_down(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = hops.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = hops.join(further, "root", "left")
        hops = lay_down(
            moved.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")),
            "spelling-roots",
        )
        if not hops.where("moved").limit(1).count():
            return hops.select("word", "root")


def variants(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least: int = LEAST_COUNT,
    factor: int = FORM_FACTOR,
    most: int = PASS_BLOCKS,
) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of the texts of ``docs``.

    Words are runs of Latin letters in whole texts, A-Z in lower case, of at least
    five code points and ``least`` occurrences; one in 97 (document, run) pairs, told
    by a hash, is spelt without one code point. Near words differ by one inserted,
    deleted or replaced code point. A word's form is its most frequent near word (ties:
    the smallest in code-point order), if that has ``factor`` times its count; its root
    is where following forms ends. Null and empty texts have no words; a null id counts
    as an empty one; repeated rows count each time; words of any length take part. An
    empty table gives an empty result. Other columns are ignored.
    """
    words = vocabulary(docs, id_col, text_col, least)
    links = near_words(words, most)
    back = links.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    own = words.select("word", "n", F.lit(None).cast("string").alias("near"), F.lit(None).cast("long").alias("near_n"))
    grouped = own.unionByName(links).unionByName(back).groupBy("word").agg(
        F.max("n").alias("n"),
        F.count("near").alias("n_near"),
        F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("less"), "near"))).alias("best"),
    )
    has = -F.col("best.less") >= factor * F.col("n")
    formed = lay_down(
        grouped.select(
            "word", "n", "n_near", F.when(has, F.col("best.near")).alias("form"), F.when(has, -F.col("best.less")).alias("form_n")
        ),
        "spelling-forms",
    )
    roots = _roots(formed.where("form IS NOT NULL"))
    return formed.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
