"""Language identification by interpolated Kneser-Ney character models.

Each language has a model of the letters of its words: raw counts at the longest
order, continuation counts (how many different characters stand before) below,
one absolute discount an order, every order interpolated with the next. The model
is a stored table of log-probabilities and backoff weights. Tasks hold its most
counted rows as sorted hash arrays, one set a language; words that need other rows
are joined to the table. A text gets the language of the lowest cross-entropy a
character; a logistic curve turns margin and excess into the probability that
this is right, and texts that no model fits are rejected.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furlong.llm.toxicity import fit_curve
from furlong.llm.wordhash import scramble
from furlong.scale.storage import lay_down

FOLDS = 4
HELD_OUT = 2
ORDER = 5
# Model rows that tasks hold, a matter of speed only: words that need others are joined.
HEAD_ROWS = 1 << 20
# Of the teaching ids one in so many may calibrate, at most this many, those of the
# smallest hash; all others are counted.
CALIBRATION_SHARE = 20
CALIBRATION_TEXTS = 5_000
# Below this probability of being right a prediction counts as rejected.
REJECT = 0.5
UNDETERMINED = "und"

_PAD, _END = " ", "\n"
# A longer run of letters is several words.
_WORDS = re.compile(r"[^\W\d_]{1,65536}")
_BREAK = re.compile(r"[\W\d_]")
_PIECE = 1 << 20  # characters taken apart at once
_COUNTED = 1 << 24  # characters between two emissions of counts
_KNOWN_VALUES = 1 << 20  # word scores a task remembers
_SLAB = 1 << 16  # characters scored at once
_LEVELS = 64  # steps of a count's logarithm, by which the most counted rows are told
_SALTS = 8
_BASE = np.uint64(0x9E3779B97F4A7C15)
_CUTS = ((0, 3), (3, 15))  # pieces of calibration texts, in words: short texts


def held_out(id_col: Column) -> Column:
    """crc32 of the id as text, modulo 4, is 2; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))


def words_of(raw: bytes | None) -> Iterator[list[str]]:
    """Lower-cased runs of letters, a list for each piece of a long text."""
    text = (raw or b"").decode("utf-8", "replace").lower()
    a = 0
    while a < len(text):
        b = len(text)
        if b - a > _PIECE:
            cut = _BREAK.search(text, a + _PIECE)
            b = cut.end() if cut else b
        yield _WORDS.findall(text[a:b])
        a = b


def _has_letter(words: list[str]) -> bool:
    """Runs may hold numerals that are no letters."""
    return any(c.isalpha() for w in words for c in w)


# -- character windows -----------------------------------------------------


def windows(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of each character's window, the word it is from): a row for each letter and word end."""
    joined = "".join([_PAD * (ORDER - 1) + w + _END for w in words])
    codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    rows = np.fromiter(map(len, words), np.int64, len(words)) + 1
    owner = np.repeat(np.arange(len(words)), rows)
    at = np.arange(len(owner)) + owner * (ORDER - 1)
    return np.lib.stride_tricks.sliding_window_view(codes, ORDER)[at] if len(words) else np.zeros((0, ORDER), np.uint32), owner


def gram_hash(codes: np.ndarray, context: bool) -> np.ndarray:
    """64-bit hashes of rows of code points; those of contexts are another family."""
    h = np.full(len(codes), 2 * codes.shape[1] + context + 1, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(codes.shape[1]):
            h = h * _BASE + codes[:, j].astype(np.uint64)
        return scramble(h)


def _strings(codes: np.ndarray) -> list[str]:
    width = codes.shape[1]
    text = np.ascontiguousarray(codes).tobytes().decode("utf-32-le")
    return [text[i : i + width] for i in range(0, len(text), width)]


# -- counting --------------------------------------------------------------


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n) of the longest order from (lang, text) rows, summed within a task's stretches."""
    counted: dict[str, Counter] = {}

    def emit() -> Iterator[pa.RecordBatch]:
        for lang, words in counted.items():
            listed, often = list(words), np.fromiter(words.values(), np.int64, len(words))
            for a in range(0, len(listed), _SLAB):
                codes, owner = windows(listed[a : a + _SLAB])
                _, first, back = np.unique(gram_hash(codes, False), return_index=True, return_inverse=True)
                n = np.bincount(back, often[a : a + _SLAB][owner]).astype(np.int64)
                yield pa.RecordBatch.from_pydict(
                    {"lang": pa.array([lang] * len(n), pa.string()), "gram": _strings(codes[first]), "n": n}
                )
        counted.clear()

    seen = 0
    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1), strict=True):
            mine, raw = counted.setdefault(lang.as_py(), Counter()), text.as_py()
            for words in words_of(raw):
                mine.update(words)
            seen += len(raw or b"")
            if seen > _COUNTED:
                seen = 0
                yield from emit()
    yield from emit()


@dataclass
class Head:
    """The model rows that tasks hold: for each language ascending hashes and their values."""

    langs: list[str]
    grams: list[tuple[np.ndarray, np.ndarray]]  # log p of the last character of a gram
    contexts: list[tuple[np.ndarray, np.ndarray]]  # log weight of the next shorter order behind a context
    unseen: np.ndarray  # by language: log p of a character that no text has
    whole: bool  # whether these are all rows

    def score(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(word x language log-likelihoods, whether each word needs rows that are not here).

        The latter score as if every character were unseen.
        """
        out = np.zeros((len(words), len(self.langs)))
        open_ = np.zeros(len(words), bool)
        sizes = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        a = 0
        while a < len(words):
            b = max(a + 1, int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + _SLAB, "right")))
            out[a:b], open_[a:b] = self._score(words[a:b])
            a = b
        if not self.whole and open_.any():
            n = np.fromiter(map(len, words), np.int64, len(words)) + 1
            out[open_] = n[open_, None] * self.unseen
        return out, open_ & (not self.whole)

    def _score(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        codes, owner = windows(words)
        grams = [gram_hash(codes[:, ORDER - k :], False) for k in range(1, ORDER + 1)]
        contexts = [gram_hash(codes[:, ORDER - k : ORDER - 1], True) for k in range(1, ORDER + 1)]
        out = np.empty((len(words), len(self.langs)))
        open_ = np.zeros(len(words), bool)
        for i in range(len(self.langs)):
            value, left = np.zeros(len(codes)), np.arange(len(codes))
            for k in range(ORDER, 0, -1):
                at, here = _find(self.grams[i][0], grams[k - 1][left])
                value[left[here]] += self.grams[i][1][at[here]]
                left = left[~here]
                open_[owner[left]] = True
                if k > 1 and len(left):
                    at, here = _find(self.contexts[i][0], contexts[k - 1][left])
                    value[left[here]] += self.contexts[i][1][at[here]]
            value[left] += self.unseen[i]
            out[:, i] = np.bincount(owner, value, len(words))
        return out, open_


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in an ascending table, whether it is there) of each key."""
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


@dataclass
class Models:
    head: Broadcast  # of a Head
    table: DataFrame | None  # (lang, kind, gram, value): every row, where the head holds only some
    symbols: int  # different characters, and one for all others


def _levels(counted: DataFrame) -> DataFrame:
    """(lang, gram, raw, n) of every order: ``n`` is the Kneser-Ney count.

    Grams that begin at a word's start have no character before them and keep raw counts.
    """
    suffix = lambda k: F.substring("gram", ORDER - k + 1, k)
    steps = F.explode(
        F.array(*[F.struct(suffix(k).alias("gram"), suffix(k + 1).alias("longer")) for k in range(1, ORDER)])
    )
    distinct = (
        counted.select("lang", steps.alias("s"), "raw")
        .groupBy("lang", F.col("s.gram").alias("gram"), F.col("s.longer").alias("longer"))
        .agg(F.sum("raw").alias("raw"))
    )
    shorter = distinct.groupBy("lang", "gram").agg(F.sum("raw").alias("raw"), F.count(F.lit(1)).alias("n"))
    shorter = shorter.withColumn("n", F.when(F.col("gram").startswith(_PAD), F.col("raw")).otherwise(F.col("n")))
    return counted.select("lang", "gram", "raw", F.col("raw").alias("n")).unionByName(shorter)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, kind, hashes, values), packed, of (lang, kind, gram, value) rows."""
    for batch in batches:
        rows: dict[str, list] = {"lang": [], "kind": [], "hashes": [], "values": []}
        frame = batch.to_pandas()
        for (lang, kind), part in frame.groupby(["lang", "kind"]):
            hashes, values = [], []
            for k, alike in part.groupby(part["gram"].str.len()):
                codes = np.frombuffer("".join(alike["gram"]).encode("utf-32-le"), np.uint32)
                hashes.append(gram_hash(codes.reshape(len(alike), int(k)), bool(kind)).tobytes())
                values.append(alike["value"].to_numpy(np.float64).tobytes())
            for column, x in zip(rows, (lang, int(kind), b"".join(hashes), b"".join(values)), strict=True):
                rows[column].append(x)
        kinds = (pa.string(), pa.int32(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays(
            [pa.array(x, kind) for x, kind in zip(rows.values(), kinds, strict=True)], list(rows)
        )


def train(taught: DataFrame, head_rows: int = HEAD_ROWS) -> Models:
    """Models of (_lang string, _text binary) rows; at most ``head_rows`` rows reach the driver."""
    spark = taught.sparkSession
    counted = taught.select("_lang", "_text").mapInArrow(_grams, "lang string, gram string, n long")
    counted = lay_down(counted.groupBy("lang", "gram").agg(F.sum("n").alias("raw")), "language-grams")
    levels = lay_down(_levels(counted), "language-levels").withColumn("k", F.length("gram"))
    levels = levels.withColumn("context", F.expr("substring(gram, 1, k - 1)"))
    seen = levels.where("k = 1").select("gram").distinct().count()
    symbols = seen + 1

    once, twice = (F.count(F.when(F.col("n") == i, 1)) for i in (1, 2))
    share = F.coalesce(F.try_divide(once, once + 2 * twice), F.lit(0.5))
    discounts = levels.groupBy("lang", "k").agg(F.greatest(F.least(share, F.lit(0.95)), F.lit(0.1)).alias("d"))
    sums = levels.groupBy("lang", "k", "context").agg(
        F.sum("n").alias("total"), F.sum("raw").alias("raw"), F.count(F.lit(1)).alias("types")
    )
    contexts = lay_down(
        sums.join(discounts, ["lang", "k"]).withColumn("back", F.col("d") * F.col("types") / F.col("total")),
        "language-contexts",
    )
    terms = lay_down(
        levels.join(contexts.select("lang", "k", "context", "total", "d", "back"), ["lang", "k", "context"]).select(
            "lang", "k", "gram", "raw", "back", (F.greatest(F.col("n") - F.col("d"), F.lit(0.0)) / F.col("total")).alias("own")
        ),
        "language-terms",
    )
    # p of an order = own share + weight * p of the next shorter one, from the uniform one upwards
    shorter = None
    table = contexts.select(
        "lang", F.lit(1).alias("kind"), F.col("context").alias("gram"), F.log("back").alias("value"), "raw"
    )
    for k in range(1, ORDER + 1):
        of_order = terms.where(F.col("k") == k).withColumn("suffix", F.expr("substring(gram, 2)"))
        if shorter is None:
            of_order = of_order.withColumn("below", F.lit(1.0 / symbols))
        else:
            of_order = of_order.join(
                shorter.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("below")), ["lang", "suffix"]
            )
        p = (F.col("own") + F.col("back") * F.col("below")).alias("p")
        shorter = lay_down(of_order.select("lang", "gram", "raw", p), "language-order")
        table = table.unionByName(
            shorter.select("lang", F.lit(0).alias("kind"), "gram", F.log("p").alias("value"), "raw")
        )

    unseen = {
        r["lang"]: r["value"] - float(np.log(symbols))
        for r in table.where("kind = 1 AND gram = ''").select("lang", "value").collect()
    }
    langs = sorted(unseen)
    level = F.floor(F.log("raw") * _LEVELS)
    room, lowest, whole = head_rows, None, True  # whole levels, the most counted first
    for r in table.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():
        if not whole or r["count"] > room:
            whole = False
        else:
            room, lowest = room - r["count"], r["level"]
    held = table.where(F.lit(False) if lowest is None else level >= lowest).select("lang", "kind", "gram", "value")
    packed = held.mapInArrow(_hashed, "lang string, kind int, hashes binary, values binary").collect()
    sets: list[list[tuple[np.ndarray, np.ndarray]]] = [[], []]
    for kind, lang in ((kind, lang) for kind in (0, 1) for lang in langs):
        mine = [r for r in packed if r["lang"] == lang and r["kind"] == kind]
        h = np.frombuffer(b"".join(r["hashes"] for r in mine), np.uint64)
        order = np.argsort(h)
        sets[kind].append((h[order], np.frombuffer(b"".join(r["values"] for r in mine), np.float64)[order]))
    head = Head(langs, sets[0], sets[1], np.array([unseen[x] for x in langs]), whole)
    return Models(spark.sparkContext.broadcast(head), None if whole else table, symbols)


# -- scoring ---------------------------------------------------------------


class _Known:
    """Scores of the words a task has met, as many as fit."""

    def __init__(self, head: Head):
        self.head = head
        self.most = max(1024, _KNOWN_VALUES // max(1, len(head.langs)))
        self.place: dict[str, int] = {}
        self.scores = np.empty((self.most, len(head.langs)))
        self.open = np.empty(self.most, bool)

    def of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(word x language log-likelihoods, whether each word needs rows the head has not)."""
        new = set(words) - self.place.keys()
        if len(self.place) + len(new) > self.most:
            self.place.clear()
            new = set(words)
            if len(new) > self.most:
                return self.head.score(words)
        if new:
            listed, a = sorted(new), len(self.place)
            b = a + len(listed)
            self.scores[a:b], self.open[a:b] = self.head.score(listed)
            self.place.update(zip(listed, range(a, b), strict=True))
        at = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
        return self.scores[at], self.open[at]


def _runs(texts: Sequence[pa.BinaryScalar]) -> Iterator[tuple[list[str], np.ndarray]]:
    """(words, the text each is from) of consecutive texts, some ``_PIECE`` characters at a time."""
    words: list[str] = []
    owner: list[int] = []
    size = 0
    for i, raw in enumerate(texts):
        for found in words_of(raw.as_py()):
            words += found
            owner += [i] * len(found)
            size += sum(map(len, found))
            if size > _PIECE:
                yield words, np.array(owner)
                words, owner, size = [], [], 0
    if words:
        yield words, np.array(owner)


def _measure(head: Broadcast):
    """Task code: other columns beside log-likelihoods, characters, letters or not, and digest of the first column's texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known(head.value)
        for batch in batches:
            texts = batch.column(0)
            sums = np.zeros((len(texts), len(head.value.langs)))
            n, letters = np.zeros(len(texts), np.int64), np.zeros(len(texts), bool)
            for words, owner in _runs(texts):
                first = np.flatnonzero(np.diff(owner, prepend=-1))
                scores = np.add.reduceat(known.of(words)[0], first)
                lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
                rows = owner[first]
                sums[rows] += scores
                n[rows] += np.add.reduceat(lengths, first)
                for row, a, b in zip(rows, first, np.append(first, len(words))[1:], strict=True):
                    letters[row] = letters[row] or _has_letter(words[a:b])
            digests = [None if head.value.whole else xxhash.xxh3_128_digest(t.as_py() or b"") for t in texts]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(sums.tolist(), pa.list_(pa.float64())), pa.array(n),
                 pa.array(letters), pa.array(digests, pa.binary())],
                [*batch.schema.names[1:], "_sums", "_n", "_letters", "_digest"],
            )

    return run


def _open_words(head: Broadcast):
    """Task code: (digest, word, often) of words that need more rows than the head has, once a text of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known(head.value)
        for batch in batches:
            texts = batch.column(0).unique()

            def rows(found: Counter, texts: pa.Array = texts) -> pa.RecordBatch:
                digests = pa.array([xxhash.xxh3_128_digest(texts[i].as_py() or b"") for i, _ in found], pa.binary())
                words, often = pa.array([w for _, w in found], pa.string()), pa.array(list(found.values()), pa.int64())
                return pa.RecordBatch.from_arrays([digests, words, often], ["_digest", "word", "_often"])

            often: Counter = Counter()
            for words, owner in _runs(texts):
                open_ = np.flatnonzero(known.of(words)[1])
                often.update(zip(owner[open_].tolist(), [words[i] for i in open_], strict=True))
                last = Counter({x: n for x, n in often.items() if x[0] == owner[-1]})  # it may go on
                yield rows(often - last)
                often = last
            yield rows(often)

    return run


def _joined_scores(rows: DataFrame, models: Models) -> DataFrame:
    """(_digest, _more array): what the words that the head lacks rows for add to a text's log-likelihoods."""
    head = models.head.value
    met = rows.select("_text").mapInArrow(_open_words(models.head), "_digest binary, word string, _often long")
    met = lay_down(met.dropDuplicates(["_digest", "word"]), "language-open")
    padded = F.concat(F.lit(_PAD * (ORDER - 1)), F.col("word"), F.lit(_END))
    places = met.select("word").distinct().select(
        "word", padded.alias("s"), F.explode(F.expr("sequence(1, length(word) + 1)")).alias("i")
    )
    # the grams that end at each place, and the contexts before it
    parts = [
        F.struct(F.lit(k).alias("k"), F.lit(kind).alias("kind"),
                 F.expr(f"substring(s, i + {ORDER - k}, {k - kind})").alias("gram"))
        for k in range(1, ORDER + 1) for kind in (0, 1) if k > kind
    ]
    asked = places.select("word", "i", F.explode(F.array(*parts)).alias("x")).select("word", "i", "x.*")
    found = asked.join(models.table.select("lang", "kind", "gram", "value"), ["kind", "gram"])
    at = found.groupBy("word", "i", "lang").agg(F.collect_list(F.struct("k", "kind", "value")).alias("m"))
    longest = F.expr("coalesce(array_max(transform(filter(m, x -> x.kind = 0), x -> x.k)), 0)")
    at = at.withColumn("longest", longest)
    unseen = F.create_map(*[F.lit(x) for pair in zip(head.langs, head.unseen.tolist(), strict=True) for x in pair])
    value = F.expr(
        "aggregate(filter(m, x -> (x.kind = 0 and x.k = longest) or (x.kind = 1 and x.k > longest)),"
        " cast(0 as double), (a, x) -> a + x.value)"
    )
    # every character counts as unseen so far; one that no order has stays so, behind its contexts
    more = F.when(F.col("longest") > 0, value - unseen[F.col("lang")]).otherwise(value)
    by_word = at.groupBy("word", "lang").agg(F.sum(more).alias("more"))
    vector = F.array(*[F.coalesce(F.max(F.when(F.col("lang") == x, F.col("more"))), F.lit(0.0)) for x in head.langs])
    by_word = by_word.groupBy("word").agg(vector.alias("more"))
    salted = F.explode(F.array(*map(F.lit, range(_SALTS)))).alias("_salt")
    met = met.withColumn("_salt", F.pmod(F.xxhash64("_digest"), F.lit(_SALTS)).cast("int"))
    added = met.join(by_word.select("*", salted), ["word", "_salt"])
    sums = [F.sum(F.col("_often") * F.col("more")[i]) for i in range(len(head.langs))]
    return added.groupBy("_digest").agg(F.array(*sums).alias("_more"))


def measure(rows: DataFrame, models: Models) -> DataFrame:
    """Columns of ``rows`` but the first, ``_text``, with log-likelihoods by language, characters, letters or not."""
    kept = rows.columns[1:]
    schema = T.StructType(list(rows.schema.fields[1:])).add("_sums", T.ArrayType(T.DoubleType())).add("_n", "long")
    out = rows.mapInArrow(_measure(models.head), schema.add("_letters", "boolean").add("_digest", "binary"))
    if models.table is not None:
        salted = F.explode(F.array(*map(F.lit, range(_SALTS)))).alias("_salt")  # repeated texts meet in as many places
        out = out.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(_SALTS)).cast("int"))
        out = out.join(_joined_scores(rows, models).select("*", salted), ["_digest", "_salt"], "left")
        sums = F.zip_with("_sums", "_more", lambda a, b: a + b)
        out = out.withColumn("_sums", F.when(F.col("_more").isNull(), F.col("_sums")).otherwise(sums))
    return out.select(*kept, "_sums", "_n", "_letters")


def features(entropies: np.ndarray, n: np.ndarray, typical: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(what the curve sees, best language) of text x language cross-entropies; infinite ones do not compete."""
    best = entropies.argmin(axis=1)
    ordered = np.sort(entropies, axis=1)
    second = ordered[:, 1] if entropies.shape[1] > 1 else ordered[:, 0]
    margin = np.where(np.isfinite(second), second - ordered[:, 0], 0.0)
    excess = ordered[:, 0] - typical[best]
    return np.column_stack([np.ones(len(n)), margin, margin * np.sqrt(n), excess]), best


@dataclass
class Curve:
    weights: np.ndarray
    typical: np.ndarray  # by language: usual cross-entropy of its texts


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts, and short pieces of them beside."""
    for batch in batches:
        texts, langs = [], []
        for text, lang in zip(batch.column(0), batch.column(1), strict=True):
            raw = text.as_py() or b""
            words = next(words_of(raw), [])
            for t in (raw, *(" ".join(words[a:b]).encode() for a, b in _CUTS)):
                texts.append(t)
                langs.append(lang.as_py())
        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()), pa.array(langs, pa.string())], ["_text", "_lang"])


def calibrate(sample: DataFrame, models: Models) -> Curve:
    """The curve of a bounded sample (_text, _lang), brought to the driver as one short row a text.

    Each text is judged by all models, and again without its own language's:
    there no answer is right, which is what rejection has to know.
    """
    langs = models.head.value.langs
    rows = measure(sample.mapInArrow(_pieces, "_text binary, _lang string"), models)
    got = rows.where(F.col("_letters") & F.col("_lang").isin(langs)).toPandas()
    typical = np.zeros(len(langs))
    if not len(got):
        return Curve(np.zeros(4), typical)
    n = got["_n"].to_numpy(float)
    entropies = -np.stack(got["_sums"].to_numpy()) / n[:, None]
    own = got["_lang"].map({x: i for i, x in enumerate(langs)}).to_numpy()
    mine = entropies[np.arange(len(own)), own]
    for i in range(len(langs)):
        typical[i] = np.average(mine[own == i], weights=n[own == i]) if (own == i).any() else np.average(mine, weights=n)
    x, best = features(entropies, n, typical)
    y = (best == own).astype(float)
    if len(langs) > 1:
        others = entropies.copy()
        others[np.arange(len(own)), own] = np.inf
        x = np.concatenate([x, features(others, n, typical)[0]])
        y = np.concatenate([y, np.zeros(len(own))])
    order = np.lexsort((*x.T, y))  # sums do not depend on the order rows arrive in
    return Curve(fit_curve(x[order], y[order]), typical)


def identify(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    reject: float = REJECT,
    head_rows: int = HEAD_ROWS,
) -> DataFrame:
    """(id_col, held_out, lang_pred, score, rejected, cross_entropy) for every row of ``docs``.

    Only rows with a language outside the held-out fold teach; null ids are judged
    and teach nothing. ``score`` is the probability that ``lang_pred`` is right,
    ``rejected`` whether it is below ``reject``, ``cross_entropy`` that of the best
    language in nats a character. Texts that are null, empty or without a letter are
    ``und`` with score 0, rejected, without cross-entropy, as is every text where
    nothing teaches. Ties go to the language first in code-point order. Repeated
    rows are judged alike; an empty table gives an empty result; very long texts are
    taken apart in pieces and judged whole. Other columns are ignored. As many
    models are held as ``lang_col`` has values among teaching rows.
    """
    rows = docs.select(
        F.col(f"`{text_col}`").cast("binary").alias("_text"),
        F.col(f"`{id_col}`").alias("_id"),
        F.col(f"`{lang_col}`").cast("string").alias("_lang"),
    )
    teaches = F.col("_id").isNotNull() & F.col("_lang").isNotNull() & ~held_out(F.col("_id"))
    place = F.xxhash64(F.col("_id"), F.lit("calibration"))
    may = F.pmod(F.xxhash64(F.col("_id"), F.lit("share")), F.lit(CALIBRATION_SHARE)) == 0
    places = rows.where(teaches & may).select(place.alias("p")).distinct()
    last = places.orderBy("p").limit(CALIBRATION_TEXTS).agg(F.max("p")).first()[0]
    calibrates = may & F.coalesce(place <= F.lit(last).cast("long"), F.lit(False))
    models = train(rows.where(teaches & ~calibrates).select("_lang", "_text"), head_rows)
    langs = models.head.value.langs
    judged = rows.select("_text", "_id")
    head = [F.col("_id").alias(id_col), held_out(F.col("_id")).alias("held_out")]
    if not langs:
        return judged.select(
            *head, F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"),
            F.lit(True).alias("rejected"), F.lit(None).cast("double").alias("cross_entropy"),
        )
    curve = calibrate(rows.where(teaches & calibrates).select("_text", "_lang"), models)
    measured = measure(judged, models).withColumn("_ce", F.transform("_sums", lambda x: -x / F.greatest("_n", F.lit(1))))
    ordered = measured.withColumns({"_best": F.array_min("_ce"), "_sorted": F.array_sort("_ce")})
    at = F.array_position("_ce", F.col("_best")).cast("int")
    margin = (F.col("_sorted")[min(1, len(langs) - 1)] - F.col("_best")) if len(langs) > 1 else F.lit(0.0)
    typical = F.array(*map(F.lit, curve.typical.tolist()))
    terms = [F.lit(1.0), margin, margin * F.sqrt("_n"), F.col("_best") - F.element_at(typical, at)]
    logit = sum((t * F.lit(float(w)) for t, w in zip(terms, curve.weights, strict=True)), F.lit(0.0))
    chance = 1 / (1 + F.exp(-F.greatest(F.least(logit, F.lit(30.0)), F.lit(-30.0))))
    known = F.col("_letters")
    scored = ordered.select(
        *head,
        F.when(known, F.element_at(F.array(*map(F.lit, langs)), at)).otherwise(UNDETERMINED).alias("lang_pred"),
        F.when(known, chance).otherwise(0.0).alias("score"),
        F.when(known, F.col("_best")).alias("cross_entropy"),
    )
    return scored.select(id_col, "held_out", "lang_pred", "score", (F.col("score") < reject).alias("rejected"), "cross_entropy")
