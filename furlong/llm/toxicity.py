"""Toxicity by class-conditional Kneser-Ney word models.

Each class has absolutely discounted word counts; what the discount takes backs
off to one distribution that both classes share, the continuation counts: how
many different histories a word follows in either class. A text's evidence is
the difference of its length-normalised log-likelihoods, which a logistic curve
fitted on other labelled texts turns into a probability.

The history of a word is the word before it. Counts cover all teaching texts but
those that fit the curve, at most ``CURVE_TEXTS`` ids. Every counted word is kept,
in a stored table. Tasks hold its most counted words; what a text has of the others
is joined to the table, once for each distinct text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furlong.llm import keyfilter
from furlong.llm.labels import held_out, learnable
from furlong.scale.storage import lay_down

THRESHOLD = 0.7
# Words that tasks hold in memory, a matter of speed only: the others are joined.
HEAD_WORDS = 1 << 20
SALT_BITS = 3  # a frequent word's bigrams meet in this many places (as a power)
RANGE_BITS = 6  # and words in this many
# Absolute discount of the class of fewer words. The other class discounts as
# large a share of its words, so that what is rare backs off alike in both and
# speaks for neither.
DISCOUNT = 0.9
# Log-ratios up to here say no more than which languages a class is made of.
DEAD_ZONE = 2.0
# One of so many teaching texts may fit the curve; it takes at most this many ids,
# those of the smallest hash, and what it does not take is counted.
CURVE_SHARE = 5
CURVE_TEXTS = 50_000
_KNOWN_WORDS = 400_000
_EDGES = b".,;:!?\"'()[]{}<>|*#%&$-_"
_PACKED = "_packed"  # a column of compressed texts
Task = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
# Steps of a word count's logarithm, by which the most counted words are told.
_LEVELS = 64
# Bytes of texts taken out of compression at once. Counting takes some eight times that, and reused workers keep it.
_UNPACKED = 1 << 23


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _KNOWN_WORDS:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word.strip(_EDGES))
        return found


def word_hashes(text: bytes | None, known: dict) -> np.ndarray:
    """64-bit hashes of the words, A-Z in lower case, outer punctuation left off."""
    words = (text or b"").lower().split()
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words)).view(np.int64)


def bigrams(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, 64-bit hash of history and word) of each distinct bigram; the first word has history 0.

    Once a text, in counts as in scores, so that what a text repeats is not frequent.
    """
    after = words.view(np.uint64)
    before = np.concatenate([np.zeros(1, np.uint64), after[:-1]])[: len(words)]
    with np.errstate(over="ignore"):
        x = (before ^ (before >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15) + after
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
    pairs, at = np.unique(x, return_index=True)
    return words[at], pairs.view(np.int64)


@dataclass
class Head:
    """The most counted words with their log p(word | toxic) - log p(word | ordinary)."""

    words: np.ndarray  # ascending
    ratios: np.ndarray
    unseen: float  # the same of a word that no text has

    def ratio(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log-ratio, whether it is here) of each word; one that is not here has that of an unseen word."""
        if not len(self.words):
            return np.full(len(words), self.unseen), np.zeros(len(words), bool)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        here = self.words[at] == words
        return np.where(here, self.ratios[at], self.unseen), here


@dataclass
class Model:
    head: Broadcast  # of a Head
    tail: DataFrame | None  # (word, _more, _stronger) of all other words: what they add to an unseen one's terms


def _strong(ratio: np.ndarray) -> np.ndarray:
    """What exceeds ``DEAD_ZONE`` on either side."""
    return np.sign(ratio) * np.maximum(np.abs(ratio) - DEAD_ZONE, 0)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bigrams of the texts and the texts of either label with them by word, packed by word range and history salt."""
    known = _WordHash()
    names = ("words", "follows", "toxic", "ordinary", "pairs")
    schema = pa.schema([("bucket", pa.int64()), *((n, pa.binary()) for n in names)])
    for batch in batches:
        rows: dict[str, list] = {name: [] for name in schema.names}
        found = [bigrams(word_hashes(text.as_py(), known)) for text in batch.column(0)]
        label = np.repeat(np.array(batch.column(1).to_pylist(), float), [len(f[0]) for f in found])
        none = np.empty(0, np.int64)
        pairs, first, back = np.unique(
            np.concatenate([*(f[1] for f in found), none]), return_index=True, return_inverse=True
        )
        words = np.concatenate([*(f[0] for f in found), none])[first]
        toxic = np.bincount(back, label, len(pairs))
        every = np.bincount(back, minlength=len(pairs))
        bucket = (words.view(np.uint64) >> np.uint64(64 - RANGE_BITS)).astype(np.int64) << SALT_BITS
        bucket |= pairs & ((1 << SALT_BITS) - 1)
        order = np.lexsort((words, bucket))
        bucket, words, pairs, toxic, every = (x[order] for x in (bucket, words, pairs, toxic, every))
        starts = np.flatnonzero(np.diff(bucket, prepend=-1))
        for a, b in zip(starts, np.append(starts, len(bucket))[1:], strict=True):
            w, at = np.unique(words[a:b], return_index=True)
            t, n = np.add.reduceat(toxic[a:b], at), np.add.reduceat(every[a:b], at)
            follows = np.diff(np.append(at, b - a))
            rows["bucket"].append(int(bucket[a]))
            rows["words"].append(w.tobytes())
            rows["pairs"].append(pairs[a:b].tobytes())
            for name, x in (("follows", follows), ("toxic", t), ("ordinary", n - t)):
                rows[name].append(x.astype(np.uint32).tobytes())
        yield pa.RecordBatch.from_pydict(rows, schema=schema)


def _merge_bigrams(found: pa.Table) -> pa.Table:
    """One bucket: its words with texts of either label, and the histories they follow there."""
    read = lambda name, kind: np.frombuffer(b"".join(found.column(name).to_pylist()), kind)
    each, n = read("words", np.int64), read("follows", np.uint32)
    words, back = np.unique(each, return_inverse=True)
    _, first = np.unique(read("pairs", np.int64), return_index=True)
    follows = np.bincount(np.repeat(back, n)[first], minlength=len(words))
    toxic, ordinary = (np.bincount(back, read(c, np.uint32), len(words)) for c in ("toxic", "ordinary"))
    return pa.table({"word": words, "toxic": toxic, "ordinary": ordinary, "follows": follows.astype(float)})


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose first column is compressed, with it as it was, ``_UNPACKED`` bytes or one text at a time."""
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        texts: list[bytes] = []
        size = first = 0
        for i, t in enumerate(batch.column(0)):
            texts.append(unpack(t.as_py()))
            size += len(texts[-1])
            if size > _UNPACKED or i + 1 == batch.num_rows:
                part = [pa.array(texts, pa.binary()), *batch.slice(first, len(texts)).columns[1:]]
                yield pa.RecordBatch.from_arrays(part, batch.schema.names)
                texts, size, first = [], 0, i + 1


def _plain(rows: DataFrame, work: Task) -> Task:
    """``work`` on rows whose texts may be compressed; their column is then ``_packed``."""
    return (lambda batches: work(_unpack(batches))) if rows.columns[0] == _PACKED else work


def count_words(taught: DataFrame) -> DataFrame:
    """(word, toxic, ordinary, follows): every word of (text binary, label) rows, stored.

    ``follows`` is the number of different words it follows in either class.
    """
    packed = taught.mapInArrow(
        _plain(taught, _count), "bucket long, words binary, follows binary, toxic binary, ordinary binary, pairs binary"
    )
    merged = packed.groupBy("bucket").applyInArrow(
        _merge_bigrams, "word long, toxic double, ordinary double, follows double"
    )
    sums = [F.sum(c).alias(c) for c in ("toxic", "ordinary", "follows")]
    return lay_down(merged.groupBy("word").agg(*sums), "toxic-words")


def train(taught: DataFrame) -> Model:
    """The model of (text binary, label) rows. What reaches the driver has a fixed size."""
    counted = count_words(taught)
    sums = [F.coalesce(F.sum(c), F.lit(0.0)) for c in ("toxic", "ordinary", "follows")]
    *texts, follows, n = counted.agg(*sums, F.count(F.lit(1))).first()
    total = np.maximum(texts, 1.0)
    own = [
        F.greatest(F.col(c) - F.lit(float(DISCOUNT * t / total.min())), F.lit(0.0)) / F.lit(float(t))
        for c, t in zip(("toxic", "ordinary"), total, strict=True)
    ]
    left = [1 - x for x in counted.agg(*[F.coalesce(F.sum(x), F.lit(0.0)) for x in own]).first()]
    shared = (F.col("follows") + 0.5) / F.lit(follows + 0.5 * n + 1)
    p = [x + shared * F.lit(y) for x, y in zip(own, left, strict=True)]
    level = F.floor(F.log(F.col("toxic") + F.col("ordinary")) * _LEVELS)
    words = counted.select("word", F.log(p[0] / p[1]).alias("ratio"), level.alias("level"))
    unseen = float(np.log(left[0] / left[1]))

    room, lowest, rest = HEAD_WORDS, None, 0  # whole levels, the most counted first
    for r in words.groupBy("level").count().orderBy(F.desc("level")).collect():
        if rest or r["count"] > room:
            rest += r["count"]
        else:
            room, lowest = room - r["count"], r["level"]
    here = F.lit(False) if lowest is None else F.col("level") >= lowest
    top = words.where(here).select("word", "ratio").toArrow()
    top_words, ratios = top.column("word").to_numpy(), top.column("ratio").to_numpy()
    order = np.argsort(top_words)
    head = taught.sparkSession.sparkContext.broadcast(Head(top_words[order], ratios[order], unseen))
    if not rest:
        return Model(head, None)
    strong = F.signum("ratio") * F.greatest(F.abs("ratio") - DEAD_ZONE, F.lit(0.0))
    tail = words.where(~here).select(
        "word",
        (F.col("ratio") - unseen).alias("_more"),
        (strong - F.lit(float(_strong(np.float64(unseen))))).alias("_stronger"),
    )
    return Model(head, lay_down(tail, "toxic-tail"))


def curve_features(evidence: np.ndarray, n: np.ndarray) -> np.ndarray:
    """What the curve sees: both means, and the strong one weighed by how many words bear it."""
    return np.column_stack([np.ones(len(n)), evidence, evidence[:, 1] * np.sqrt(n)])


def fit_curve(features: np.ndarray, label: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Logistic weights by Newton's method; even odds without texts."""
    w = np.zeros(features.shape[1])
    for _ in range(50 if len(features) else 0):
        p = 1 / (1 + np.exp(-np.clip(features @ w, -30, 30)))
        h = (features * (p * (1 - p))[:, None]).T @ features + ridge * np.eye(len(w))
        step = np.linalg.solve(h, features.T @ (label - p) - ridge * w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def _terms(head: Broadcast):
    """Task code: other columns beside bigrams, sums of both log-ratios, words and digest of the first column's texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordHash()
        for batch in batches:
            sums, counts, digests = [], [], []
            for text in batch.column(0):
                text = text.as_py()
                words = word_hashes(text, known)
                ratio, _ = head.value.ratio(bigrams(words)[0])
                sums.append((ratio.sum(), _strong(ratio).sum()))
                counts.append((len(ratio), len(words)))
                digests.append(xxhash.xxh3_128_digest(text or b""))
            found, n = np.array(sums).reshape(-1, 2), np.array(counts, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], *map(pa.array, (n[:, 0], found[:, 0], found[:, 1], n[:, 1])), pa.array(digests, pa.binary())],
                [*batch.schema.names[1:], "_bigrams", "_sum", "_strong_sum", "_n", "_digest"],
            )

    return run


def _others(head: Broadcast):
    """Task code: (digest, word, bigrams) of words that are not in the head, once for each distinct text of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordHash()
        for batch in batches:
            rows: tuple[list, list, list] = [], [], []
            for text in {t.as_py() or b"" for t in batch.column(0)}:
                words, _ = bigrams(word_hashes(text, known))
                words, n = np.unique(words[~head.value.ratio(words)[1]], return_counts=True)
                rows[0].extend([xxhash.xxh3_128_digest(text)] * len(words))
                rows[1].append(words)
                rows[2].append(n)
            none = [np.empty(0, np.int64)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows[0], pa.binary()), *(pa.array(np.concatenate(x + none)) for x in rows[1:])],
                ["_digest", "word", "_often"],
            )

    return run


def _evidence(rows: DataFrame, model: Model) -> DataFrame:
    """Columns of ``rows`` but the first, ``_text``, beside evidence and words (_mean, _strong, _n).

    Evidence is the mean log p(word | toxic) - log p(word | ordinary) and the mean
    of what exceeds ``DEAD_ZONE`` on either side; zeros without words.
    """
    kept = rows.columns[1:]
    schema = T.StructType(list(rows.schema.fields[1:]))
    schema = schema.add("_bigrams", "long").add("_sum", "double").add("_strong_sum", "double").add("_n", "long")
    found = rows.mapInArrow(_plain(rows, _terms(model.head)), schema.add("_digest", "binary"))
    if model.tail is not None:
        salts = 1 << SALT_BITS  # frequent words and texts meet in this many places
        salted = F.explode(F.array(*map(F.lit, range(salts)))).alias("_salt")
        others = rows.select(rows.columns[0]).mapInArrow(_plain(rows, _others(model.head)), "_digest binary, word long, _often long")
        others = others.dropDuplicates(["_digest", "word"])
        others = others.withColumn("_salt", F.pmod(F.xxhash64("_digest"), F.lit(salts)).cast("int"))
        added = (
            others.join(model.tail.select("*", salted), ["word", "_salt"])
            .groupBy("_digest")
            .agg(
                F.sum(F.col("_often") * F.col("_more")).alias("_more"),
                F.sum(F.col("_often") * F.col("_stronger")).alias("_stronger"),
            )
        )
        found = found.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
        found = found.join(added.select("*", salted), ["_digest", "_salt"], "left").withColumns(
            {
                "_sum": F.col("_sum") + F.coalesce("_more", F.lit(0.0)),
                "_strong_sum": F.col("_strong_sum") + F.coalesce("_stronger", F.lit(0.0)),
            }
        )
    mean = lambda c: F.when(F.col("_bigrams") > 0, F.col(c) / F.col("_bigrams")).otherwise(0.0)
    return found.select(*kept, mean("_sum").alias("_mean"), mean("_strong_sum").alias("_strong"), "_n")


def _learn(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str):
    """(model, weights of the curve)."""
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(text_col).cast("binary").alias("_text"), F.col(id_col).alias("_id"))
    taught_ids = lay_down(learnable(labels, label_col, id_col), "toxic-labels")
    # texts are moved to their labels, compressed; the filter keeps others where they are
    at = keyfilter.slot(F.xxhash64(F.col("_id")))
    wanted = spark.sparkContext.broadcast(
        keyfilter.build(taught_ids.select(keyfilter.slot(F.xxhash64(F.col("_label_id"))).alias("at")))
    )

    def may_teach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask, pack = wanted.value, zstandard.ZstdCompressor().compress
        for batch in batches:
            few = batch.filter(pa.array(keyfilter.passes(mask, batch.column(2).to_numpy())))
            packed = pa.array([pack(t.as_py() or b"") for t in few.column(0)], pa.binary())
            yield pa.RecordBatch.from_arrays([packed, *few.columns[1:]], [_PACKED, *few.schema.names[1:]])

    few = rows.withColumn("_at", at).mapInArrow(may_teach, f"{_PACKED} binary, _id {id_type}, _at long")
    digest = F.pmod(F.xxhash64(F.col("_label_id"), F.lit("curve")), F.lit(CURVE_SHARE))
    packed = lay_down(
        few.join(taught_ids, F.col("_id") == F.col("_label_id")).select(
            _PACKED,
            "_label",
            "_label_id",
            F.when(digest == 0, F.xxhash64(F.col("_label_id"), F.lit("sample"))).alias("_place"),
        ),
        "toxic-taught",
    )
    # the curve takes whole ids, up to the largest hash it has room for; all others are counted
    places = packed.where("_place IS NOT NULL").select("_place").distinct()
    last = places.orderBy("_place").limit(CURVE_TEXTS).agg(F.max("_place")).first()[0]
    curve = F.coalesce(F.col("_place") <= F.lit(last).cast("long"), F.lit(False))
    model = train(packed.where(~curve).select(_PACKED, "_label"))
    sample = packed.where(curve).select(_PACKED, "_label", "_place")
    measured = _evidence(sample, model)
    # repeated rows of an id are one text to the curve
    known = measured.groupBy("_place", "_label").agg(*[F.avg(c).alias(c) for c in ("_mean", "_strong", "_n")])
    known = known.toPandas().sort_values("_place")
    weights = fit_curve(
        curve_features(known[["_mean", "_strong"]].to_numpy(), known["_n"].to_numpy()), known["_label"].to_numpy()
    )
    return model, weights


def _scored(rows: DataFrame, model: Model, weights: np.ndarray) -> DataFrame:
    """(_kept, score) of rows (_text, _kept)."""
    measured = _evidence(rows, model)
    terms = [F.col("_mean"), F.col("_strong"), F.col("_strong") * F.sqrt("_n")]
    logit = F.lit(float(weights[0]))
    for term, w in zip(terms, weights[1:], strict=True):
        logit = logit + term * F.lit(float(w))
    score = 1 / (1 + F.exp(-F.greatest(F.least(logit, F.lit(30.0)), F.lit(-30.0))))
    return measured.select("_kept", score.alias("score"))


def toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """(id_col, held_out, score, predicted) for every row of ``docs``.

    ``score`` is the probability of label 1. Only ids outside the held-out fold
    teach; null ids are scored and teach nothing. Null and empty texts have no
    evidence and the score that goes with it. Repeated rows are scored alike; an
    empty table gives an empty result; without labels each score is 0.5. Other
    columns are ignored.
    """
    learned = _learn(docs, labels, id_col, text_col, label_col)
    rows = docs.select(F.col(text_col).cast("binary").alias("_text"), F.col(id_col).alias("_kept"))
    return _scored(rows, *learned).select(
        F.col("_kept").alias(id_col),
        held_out(F.col("_kept")).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def drop_toxic(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """The rows of ``docs`` that ``toxicity`` scores below ``threshold``, all columns as they are."""
    learned = _learn(docs, labels, id_col, text_col, label_col)
    columns = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(F.col(text_col).cast("binary").alias("_text"), columns.alias("_kept"))
    return _scored(rows, *learned).where(F.col("score") < threshold).select("_kept.*")
