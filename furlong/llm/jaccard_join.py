"""Similarity join of word n-gram sets by prefixes and vertical fragments.

All n-grams have one global order: the common ones last, else by hash. Sets that
are similar enough share an n-gram of their prefixes in that order. Candidate
pairs are then counted exactly: the order is cut into fragments, each fragment
counts the overlap of its part of both sets, and the parts are summed per pair.
Pairs of small sets are one fragment.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furlong.llm import keyfilter
from furlong.llm.components import connected
from furlong.llm.wordhash import hashed_words, scramble
from furlong.scale.storage import lay_down

WORDS = 5
# Similarity in hundredths.
LEAST = 75
FRAGMENTS = 8
# A pair is cut where one of its sets has more n-grams than this.
UNCUT = 512
# N-grams in the prefixes of this many sets are common and go last. The number
# doubles until at most MOST_COMMON are, as those are broadcast.
COMMON = 8
MOST_COMMON = 1 << 20
# One of so many sets is counted whole, to know what is common behind the prefixes.
WHOLE_SHARE = 64
# Hubs that the sets of a large group meet, one after another, before the rest is
# compared; each joins components, which saves comparisons and changes no result.
ROUNDS = 3
# Least words of a set's parity sketch, 64 bits each; sets of more than SKETCH * DENSE n-grams have longer ones.
SKETCH = 8
# Most n-grams to a word of a sketch.
DENSE = 32
# A pair must share one n-gram in its prefixes, and one more for each so many of the overlap it needs.
STEP = 32
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(hashes: np.ndarray, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``words``-grams of a text's word hashes.

    A text of fewer words is one n-gram, one without words an empty set.
    """
    if not len(hashes):
        return np.empty(0, np.uint64)
    n = max(1, len(hashes) - words + 1)
    with np.errstate(over="ignore"):
        mixed = hashes[:n]
        for i in range(1, min(words, len(hashes))):
            mixed = mixed * _MIX + hashes[i : i + n]
        return np.unique(scramble(mixed + np.uint64(min(words, len(hashes)))))


def set_key(grams: np.ndarray) -> int:
    """One signed 64-bit name for a set; equal sets share it."""
    return xxhash.xxh3_64_intdigest(grams.tobytes(), seed=len(grams) & 0xFFFFFFFF) - (1 << 63)


def parity_sketch(grams: np.ndarray) -> np.ndarray:
    """A bit for each class of the n-grams' last bits, set where their number is odd.

    An n-gram that one of two sets lacks changes one bit at most. The classes
    grow with the set, a power of two of words; halves put together by XOR are
    the sketch of half the length.
    """
    words = SKETCH
    while words * DENSE < len(grams):
        words *= 2
    odd = np.bincount((grams & np.uint64(64 * words - 1)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def prefix_size(n: int, least: int = LEAST) -> int:
    """How many first n-grams two similar sets cannot both lack: n - ceil(n * least / 100) + 1."""
    return n - -(-n * least // 100) + 1


def _prefix(grams: np.ndarray, common: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The prefix in the global order, as its rare and its common part."""
    size = prefix_size(len(grams), least)
    if not len(common):
        return grams[:size], grams[:0]
    short = grams >> np.uint64(16)
    at = np.minimum(np.searchsorted(common, short), len(common) - 1)
    is_common = common[at] == short
    rare = grams[~is_common][:size]
    return rare, grams[is_common][: size - len(rare)]


def _sets(batch: pa.RecordBatch, words: int) -> Iterator[np.ndarray]:
    for hashes in hashed_words(batch.column(0)):
        yield shingle_set(hashes, words)


def _in_buckets(hashes: np.ndarray, bits: int) -> Iterator[tuple[int, slice]]:
    """Slices of sorted hashes by their first bits."""
    bucket = (hashes >> np.uint64(64 - bits)).astype(np.int64)
    starts = np.flatnonzero(np.diff(bucket, prepend=-1))
    for a, b in zip(starts, np.append(starts, len(hashes))[1:], strict=True):
        yield int(bucket[a]), slice(int(a), int(b))


def _packed(buckets: Iterator[tuple[int, slice]], **arrays: np.ndarray) -> pa.RecordBatch:
    """A row per bucket with its slice of each array as bytes."""
    rows = [(b, *(v[s].tobytes() for v in arrays.values())) for b, s in buckets]
    columns = list(map(list, zip(*rows, strict=True))) if rows else [[]] * (1 + len(arrays))
    schema = pa.schema([("bucket", pa.int64())] + [(n, pa.binary()) for n in arrays])
    return pa.RecordBatch.from_pydict(dict(zip(schema.names, columns, strict=True)), schema=schema)


def _unpacked(found: pa.Table, column: str, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(found.column(column).to_pylist()), kind)


def _starts(sorted_values: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.append(True, sorted_values[1:] != sorted_values[:-1])[: len(sorted_values)])


_TAG = np.uint64(0xFFFF)


def _common_ngrams(texts: DataFrame, words: int, least: int, bits: int, common: int, most: int) -> np.ndarray:
    """Sorted first 48 bits of the n-grams that at least ``common`` prefixes hold.

    Each task ships these bits with a 16-bit tag of the set, packed by hash
    range; copies share their tag and count once. Of an n-gram that is common in
    the task itself it ships no more tags than that takes. What goes last makes
    room for n-grams behind the prefix, so one of ``WHOLE_SHARE`` sets ships all
    of its own; no bucket gathers a group much larger than ``common * WHOLE_SHARE``. A wrong count moves an n-gram in the order, the same way in all
    sets, and changes no result.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: tuple[list, list] = ([], [])
            for grams in _sets(batch, words):
                key = set_key(grams)
                tagged = grams & ~_TAG | np.uint64(key & 0xFFFF)
                seen[0].append(tagged[: prefix_size(len(grams), least)])
                if (key >> 16) % WHOLE_SHARE == 0:
                    seen[1].append(tagged)
            for whole, parts in enumerate(seen):
                entries = np.unique(np.concatenate([*parts, np.empty(0, np.uint64)]))
                starts = _starts(entries >> np.uint64(16))
                place = np.arange(len(entries)) - np.repeat(starts, np.diff(np.append(starts, len(entries))))
                entries = entries[place < common]
                out = _packed(_in_buckets(entries, bits), entries=entries)
                yield out.append_column("whole", pa.array([bool(whole)] * out.num_rows, pa.bool_()))

    def merge(found: pa.Table) -> pa.Table:
        counted = []
        for whole in (False, True):
            entries = np.unique(_unpacked(found.filter(pc.equal(found["whole"], whole)), "entries", np.uint64))
            grams = entries >> np.uint64(16)
            starts = _starts(grams)
            n = np.diff(np.append(starts, len(entries)))
            counted.append((grams[starts[n >= common]], n[n >= common] * (WHOLE_SHARE if whole else 1)))
        grams = np.concatenate([c[0] for c in counted]).astype(np.int64)
        return pa.table({"gram": grams, "n": np.concatenate([c[1] for c in counted]).astype(np.int64)})

    packed = texts.mapInArrow(count, "bucket long, entries binary, whole boolean")
    heavy = packed.groupBy("bucket").applyInArrow(merge, "gram long, n long")
    heavy = lay_down(heavy.groupBy("gram").agg(F.max("n").alias("n")), "common-ngrams")
    at_least = common
    while heavy.where(F.col("n") >= at_least).count() > most:
        at_least *= 2
    grams = heavy.where(F.col("n") >= at_least).select("gram").toArrow().column("gram").to_numpy()
    return np.sort(grams.astype(np.uint64))


def _named(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """Stored (_id, k, n, sketch) of every row: the set's name, size and parity sketch."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, sketches = [], [], []
            for grams in _sets(batch, words):
                keys.append(set_key(grams))
                sizes.append(len(grams))
                sketches.append(parity_sketch(grams))
            flat = pa.array(np.concatenate([*sketches, np.empty(0, np.int64)]))
            at = pa.array(np.cumsum([0, *map(len, sketches)], dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(at, flat)],
                ["_id", "k", "n", "sketch"],
            )

    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(text_col).cast("binary").alias("_text"), F.col(id_col).alias("_id"))
    return lay_down(rows.mapInArrow(name, f"_id {id_type}, k long, n long, sketch array<long>"), "named-sets")


def _counted(sizes: np.ndarray) -> np.ndarray:
    """0 to size - 1 for each of ``sizes``, one after another."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _groups(texts: DataFrame, common, words: int, least: int, bits: int, large: int) -> DataFrame:
    """Stored (grp, usual, k, n, rest, w): sets whose prefixes share an n-gram, two at least.

    ``rest`` counts the set's n-grams from this one on in the global order.
    Rare n-grams are gathered in packed buckets, and those with the same sets
    are one group of weight ``w``, placed where its first is. Common n-grams stay
    rows, one group each; they and the rare groups of ``large`` sets or more are
    ``usual``.
    """
    packed_type = [("bucket", pa.int64()), ("hashes", pa.binary()), ("keys", pa.binary()), ("places", pa.binary())]
    schema = pa.schema([*packed_type, ("gram", pa.int64()), ("k", pa.int64()), ("n", pa.int64()), ("rest", pa.int64())])
    of_size, low = np.uint64(32), np.uint64((1 << 32) - 1)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = common.value
        for batch in batches:
            rares, usuals, keys, sizes = [], [], [], []
            done = set()
            for grams in _sets(batch, words):
                key = set_key(grams)
                if not len(grams) or key in done:
                    continue
                done.add(key)
                rare, usual = _prefix(grams, last, least)
                rares.append(rare)
                usuals.append(usual)
                keys.append(key)
                sizes.append(len(grams))
            names, n = np.array(keys, np.int64), np.array(sizes, np.int64)
            n_rare = np.array([len(r) for r in rares], np.int64)
            n_usual = np.array([len(u) for u in usuals], np.int64)
            h = np.concatenate([*rares, np.empty(0, np.uint64)])
            k = np.repeat(names, n_rare)
            rest = np.repeat(n, n_rare) - _counted(n_rare)
            places = np.repeat(n, n_rare).astype(np.uint64) << of_size | rest.astype(np.uint64)
            order = np.argsort(h)
            h, k, places = h[order], k[order], places[order]
            packed = _packed(_in_buckets(h, bits), hashes=h, keys=k, places=places)
            blank = [pa.nulls(packed.num_rows, pa.int64())] * 4
            yield pa.RecordBatch.from_arrays([*packed.columns, *blank], schema=schema)
            gram = np.concatenate([*usuals, np.empty(0, np.uint64)]).view(np.int64)
            if len(gram):
                rest = np.repeat(n - n_rare, n_usual) - _counted(n_usual)
                blank = [pa.nulls(len(gram), t) for _, t in packed_type]
                row = (gram, np.repeat(names, n_usual), np.repeat(n, n_usual), rest)
                yield pa.RecordBatch.from_arrays([*blank, *map(pa.array, row)], schema=schema)

    def gather(found: pa.Table) -> pa.Table:
        h, k = _unpacked(found, "hashes", np.uint64), _unpacked(found, "keys", np.int64)
        at = _unpacked(found, "places", np.uint64)
        order = np.argsort(h)
        h, k, at = h[order], k[order], at[order]
        starts = _starts(h)
        shared = np.repeat(np.diff(np.append(starts, len(h))) > 1, np.diff(np.append(starts, len(h))))
        h, k, at = h[shared], k[shared], at[shared]
        order = np.lexsort((k, h))
        h, k, at = h[order], k[order], at[order]
        fresh = np.append(True, (h[1:] != h[:-1]) | (k[1:] != k[:-1]))[: len(h)]
        h, k, at = h[fresh], k[fresh], at[fresh]
        starts = _starts(h)
        sizes = np.diff(np.append(starts, len(h)))
        with np.errstate(over="ignore"):
            mixed = scramble(k.view(np.uint64))
            sums = np.add.reduceat(mixed, starts) if len(starts) else np.empty(0, np.uint64)
            groups = scramble(sums + sizes.astype(np.uint64)).view(np.int64)
        groups = np.where(sizes > 1, groups, 0)
        unique, first, weight = np.unique(groups, return_index=True, return_counts=True)
        real = sizes[first] > 1
        unique, first, weight = unique[real], first[real], weight[real]
        take = np.concatenate([np.arange(starts[i], starts[i] + sizes[i]) for i in first] or [np.empty(0, int)]).astype(int)
        return pa.table(
            {
                "grp": np.repeat(unique, sizes[first]),
                "k": k[take],
                "n": (at[take] >> of_size).astype(np.int64),
                "rest": (at[take] & low).astype(np.int64),
                "w": np.repeat(weight, sizes[first]).astype(np.int64),
                "usual": np.repeat(sizes[first] >= large, sizes[first]),
            }
        )

    emitted = texts.mapInArrow(emit, "bucket long, hashes binary, keys binary, places binary, gram long, k long, n long, rest long")
    rare = (
        emitted.where("bucket IS NOT NULL")
        .select("bucket", "hashes", "keys", "places")
        .groupBy("bucket")
        .applyInArrow(gather, "grp long, k long, n long, rest long, w long, usual boolean")
        .groupBy("grp", "k", "n")
        .agg(F.max("usual").alias("usual"), F.max("rest").alias("rest"), F.sum("w").alias("w"))
        .select("grp", "usual", "k", "n", "rest", "w")
    )
    if len(common.value):
        usual = emitted.where("bucket IS NULL").select(F.col("gram").alias("grp"), "k", "n", "rest").distinct()
        rare = rare.unionByName(usual.withColumns({"usual": F.lit(True), "w": F.lit(1).cast("bigint")}))
    return lay_down(rare, "prefix-groups")


def _fragments(texts: DataFrame, keys: DataFrame, words: int, fragments: int, uncut: int, least: int) -> DataFrame:
    """Stored (k, part, grams): the sets named in ``keys`` (k), cut by n-gram order; perhaps others.

    Part -1 is the whole set. Sets of up to ``uncut`` n-grams have it; those of which
    a similar set can have more, and larger ones, are cut.
    """
    spark = texts.sparkSession
    wanted = spark.sparkContext.broadcast(keyfilter.build(keys.select(keyfilter.slot(F.col("k")).alias("at"))))
    cut_bits = (fragments - 1).bit_length()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = wanted.value
        for batch in batches:
            done, keys, parts, blobs = set(), [], [], []
            for grams in _sets(batch, words):
                key = set_key(grams)
                if key in done or not keyfilter.passes(mask, key % (1 << keyfilter.BITS)):
                    continue
                done.add(key)
                cuts = [(-1, slice(None))] if len(grams) <= uncut else []
                if len(grams) * 100 > uncut * least:
                    cuts += _in_buckets(grams, cut_bits) if cut_bits else [(0, slice(None))]
                for part, s in cuts:
                    keys.append(key)
                    parts.append(part)
                    blobs.append(grams[s].tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(parts, pa.int32()), pa.array(blobs, pa.binary())],
                ["k", "part", "grams"],
            )

    parts = texts.mapInArrow(cut, "k long, part int, grams binary")
    return lay_down(parts.groupBy("k", "part").agg(F.first("grams").alias("grams")), "fragments")


def _overlaps(parts: DataFrame, pairs: DataFrame, least: int, uncut: int) -> DataFrame:
    """The (u, v) of ``pairs`` (u, v, n_u, n_v) whose sets are similar enough."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shared = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(c.as_buffer(), np.uint64) for c in (a, b))
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                shared.append(int((y[at] == x).sum()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(shared, pa.int64())], ["u", "v", "shared"]
            )

    left = parts.select(F.col("k").alias("u"), (F.col("part") < 0).alias("whole"), "part", F.col("grams").alias("x"))
    right = parts.select(F.col("k").alias("v"), F.col("part").alias("part_v"), F.col("grams").alias("y"))
    light = pairs.select("u", "v", (F.greatest("n_u", "n_v") <= uncut).alias("whole"))
    both = light.join(left, ["u", "whole"]).join(
        right, (light["v"] == right["v"]) & (F.col("part") == F.col("part_v"))
    )
    counted = both.select("u", light["v"], "x", "y").mapInArrow(meet, "u long, v long, shared long")
    overlap = counted.groupBy("u", "v").agg(F.sum("shared").alias("shared"))
    enough = (100 + least) * F.col("shared") >= least * (F.col("n_u") + F.col("n_v"))
    return overlap.join(pairs, ["u", "v"]).where(enough).select("u", "v")


def _needed(n_a: Column, n_b: Column, least: int) -> tuple[Column, Column]:
    """The overlap that similar sets of these sizes have, and how much of it their prefixes hold.

    Each set's first n - overlap + shared n-grams, in the global order, hold
    ``shared`` common ones at least: of the set whose prefix ends first, overlap -
    shared n-grams are behind it. No such prefix is longer than the one of the set alone.
    """
    overlap = _hundredths((n_a + n_b) * least, 100 + least)
    alone = _hundredths(F.greatest(n_a, n_b) * least, 100)
    return overlap, F.least(F.lit(1) + F.floor(overlap / STEP), overlap - alone + 1)


def _hundredths(x: Column, by: int) -> Column:
    """x / by of whole numbers, rounded up."""
    return F.ceil(x / F.lit(by))


def _near(a: str, b: str, least: int) -> Column:
    """Whether sizes allow the similarity and a shared n-gram is in both prefixes of the pair."""
    n_a, n_b = F.col(f"n_{a}"), F.col(f"n_{b}")
    overlap, shared = _needed(n_a, n_b, least)
    alike = F.least(n_a, n_b) * 100 >= F.greatest(n_a, n_b) * least
    return alike & (F.least(f"rest_{a}", f"rest_{b}") > overlap - shared)


def _ordered(a: str, b: str, n_a: str, n_b: str) -> list[Column]:
    """(u, v, n_u, n_v) of a pair, the smaller name first."""
    first = F.col(a) < F.col(b)
    ends = [(a, b, "u"), (b, a, "v"), (n_a, n_b, "n_u"), (n_b, n_a, "n_v")]
    return [F.when(first, F.col(x)).otherwise(F.col(y)).alias(name) for x, y, name in ends]


def _brief(sketch: str) -> Column:
    """The sketch put together to its least length, whatever the set."""
    word = lambda w: F.aggregate(
        F.sequence(F.lit(w), F.size(sketch) - 1, F.lit(SKETCH)),
        F.lit(0).cast("bigint"),
        lambda so_far, i: so_far.bitwiseXOR(F.get(sketch, i)),
    )
    return F.array(*[word(w) for w in range(SKETCH)])


def _left_over(n_a: str, n_b: str, apart: Column, least: int) -> Column:
    """Whether sets that lack ``apart`` n-grams of each other can have the overlap they need."""
    both = F.col(n_a) + F.col(n_b)
    return (100 + least) * (both - apart) >= 2 * least * both


def _alike(a: str, b: str, least: int) -> Column:
    """Whether the brief sketches of a pair allow the similarity; tested where groups meet."""
    differing = [F.bit_count(F.col(f"b_{a}")[i].bitwiseXOR(F.col(f"b_{b}")[i])) for i in range(SKETCH)]
    return _left_over(f"n_{a}", f"n_{b}", sum(differing[1:], differing[0]), least)


def _possible(pairs: DataFrame, sets: DataFrame, least: int) -> DataFrame:
    """The (u, v, n_u, n_v) of such pairs, of sizes that allow the similarity, that sketches do not rule out.

    Sets that near in size have sketches of one length, or one twice the other's.
    """
    side = lambda end: sets.select(F.col("k").alias(end), F.col("sketch").alias(f"b_{end}"))
    drawn = pairs.join(side("u"), "u").join(side("v"), "v")
    length = F.least(F.size("b_u"), F.size("b_v"))
    word = lambda b, i: F.when(F.size(b) == length, F.get(b, i)).otherwise(
        F.get(b, i).bitwiseXOR(F.get(b, i + length))
    )
    apart = F.aggregate(
        F.sequence(F.lit(0), length - 1),
        F.lit(0),
        lambda so_far, i: so_far + F.bit_count(word("b_u", i).bitwiseXOR(word("b_v", i))),
    )
    return drawn.where(_left_over("n_u", "n_v", apart, least)).select("u", "v", "n_u", "n_v")


def similar_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = WORDS,
    least: int = LEAST,
    fragments: int = FRAGMENTS,
    common: int = COMMON,
    most_common: int = MOST_COMMON,
    uncut: int = UNCUT,
) -> DataFrame:
    """(id_col, n_shingles, component_id) for every row of ``docs``.

    Documents link when the Jaccard similarity of their n-gram sets is ``least``
    hundredths or more; component_id is the smallest id reachable by links.
    Components only: pairs inside one already are not compared, so links are not listed.

    Equal sets are one node, whatever their number. Sets that share a common
    n-gram, or any large group, meet some hubs of the group first; then, in every group, the sets
    outside the hub's component meet those of other components, and the n-grams that the
    prefixes of the two share are counted. So each link is either found or
    inside a component already, and a large group of near copies costs its size,
    not its square.

    Null and empty texts have an empty set and link with nothing: component_id is
    their own id. Null ids never are the smallest unless a component has no
    other; repeated rows share a component. Other columns are ignored; an empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(text_col).cast("binary").alias("_text"))
    bits = min(16, max(6, (8 * texts.rdd.getNumPartitions()).bit_length()))
    last = spark.sparkContext.broadcast(_common_ngrams(texts, words, least, bits, common, most_common))
    named = _named(docs, id_col, text_col, words)
    full = named.where("n > 0")
    sets = lay_down(
        full.groupBy("k").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.min("_id").alias("_least")), "sets"
    )
    groups = _groups(texts, last, words, least, bits, common)

    label = lambda col: F.coalesce(F.col("root"), F.col(col))
    large = lay_down(groups.where("usual").select("grp", "k", "n", "rest"), "large-groups")
    parts = _fragments(texts, large, words, fragments, uncut, least)
    no_pairs = sets.where("false").select(F.col("k").alias("u"), F.col("k").alias("v"))
    met, links, roots = no_pairs, no_pairs, no_pairs.toDF("node", "root")
    for turn in range(ROUNDS):
        placed = large.join(roots, F.col("k") == F.col("node"), "left").select("grp", "k", "n", "rest", label("k").alias("c"))
        hub = placed.groupBy(F.col("grp").alias("_grp")).agg(
            F.min(F.struct(F.xxhash64("k", F.lit(turn)).alias("turn"), "k", "c", "n", "rest")).alias("hub")
        )
        hub = hub.select("_grp", *(F.col(f"hub.{x}").alias(f"{x}_h") for x in ("k", "c", "n", "rest")))
        star = placed.toDF("grp", "k", "n_k", "rest_k", "c").join(hub, F.col("grp") == F.col("_grp"))
        star = star.where(F.col("c") != F.col("c_h")).where(_near("k", "h", least))
        star = star.select(*_ordered("k_h", "k", "n_h", "n_k")).distinct()
        star = lay_down(_possible(star.join(met, ["u", "v"], "left_anti"), sets, least), "hub-pairs")
        found = lay_down(_overlaps(parts, star, least, uncut), "hub-links")
        if not found.limit(1).count():
            break
        met, links = met.unionByName(star.select("u", "v")), links.unionByName(found)
        roots = connected(links)

    hubs = lay_down(groups.groupBy(F.col("grp").alias("_grp")).agg(F.min("k").alias("hub")), "hubs")
    marked = groups.join(sets.select("k", _brief("sketch").alias("b")), "k").join(roots, F.col("k") == F.col("node"), "left")
    marked = marked.select("grp", "k", "n", "rest", "w", "b", label("k").alias("c"))
    marked = lay_down(marked, "marked-groups")
    hub_c = hubs.join(roots, F.col("hub") == F.col("node"), "left").select("_grp", label("hub").alias("hub_c"))
    outside = lay_down(
        marked.join(hub_c, F.col("grp") == F.col("_grp"))
        .where("c <> hub_c")
        .select(
            F.col("grp").alias("_grp"), F.col("k").alias("a"), F.col("n").alias("n_a"), F.col("rest").alias("rest_a"),
            F.col("b").alias("b_a"), F.col("c").alias("c_a"), F.lit(True).alias("_out"),
        ),
        "outside-hubs",
    )
    # both ends outside: the smaller one asks; one end outside: that one asks
    both = marked.join(
        outside.select("_grp", F.col("a").alias("_a"), "_out"), (F.col("grp") == F.col("_grp")) & (F.col("k") == F.col("_a")), "left"
    )
    both = both.select(
        "grp", "k", F.col("n").alias("n_k"), F.col("rest").alias("rest_k"), F.col("b").alias("b_k"), "w", "c",
        F.col("_out").isNotNull().alias("out"),
    )
    cross = both.join(outside, (F.col("grp") == F.col("_grp")) & (F.col("c") != F.col("c_a")))
    cross = cross.where("NOT out OR a < k").where(_near("a", "k", least)).where(_alike("a", "k", least))
    cross = cross.groupBy(*_ordered("a", "k", "n_a", "n_k")).agg(F.sum("w").alias("s"))
    second = _possible(cross.where(F.col("s") >= _needed(F.col("n_u"), F.col("n_v"), least)[1]), sets, least)
    second = lay_down(second.join(met, ["u", "v"], "left_anti"), "cross-pairs")
    ends = second.select(F.explode(F.array("u", "v")).alias("k"))
    parts = _fragments(texts, ends, words, fragments, uncut, least)
    more = lay_down(_overlaps(parts, second, least, uncut), "cross-links")
    if more.limit(1).count():
        roots = connected(links.unionByName(more))

    rooted = sets.join(roots, F.col("k") == F.col("node"), "left").select("k", "_least", label("k").alias("c"))
    smallest = rooted.groupBy(F.col("c").alias("_c")).agg(F.min("_least").alias("component_id"))
    found = lay_down(
        rooted.join(smallest, F.col("c") == F.col("_c")).select(F.col("k").alias("_k"), "component_id"), "components"
    )
    linked = full.join(found, F.col("k") == F.col("_k")).select("_id", "n", "component_id")
    alone = named.where("n = 0").select("_id", "n", F.col("_id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with the smallest id of their component; those without words all stay."""
    found = similar_components(docs, id_col, text_col)
    stay = found.where(F.col(id_col).eqNullSafe(F.col("component_id"))).select(F.col(id_col).alias("_stay")).distinct()
    # the caller's columns travel as one, so that none can clash with names used here
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col(id_col).alias("_id"))
    kept = rows.join(lay_down(stay, "one-of-each"), F.col("_id").eqNullSafe(F.col("_stay")), "left_semi")
    return kept.select("_doc.*")
