"""SentencePiece encoding and decoding, giant texts by a max-plus parallel scan.

A BPE segmentation is the one path of vocabulary pieces in which each two
neighbours are what the encoder makes of their concatenation. So a text cut
anywhere is a chain of max-plus transfer matrices: from the piece that reaches
over one cut to the piece that reaches over the next, 0 where a path of fitting
neighbours leads, minus infinity elsewhere. Matrices are combined associatively,
blocks of chunks first; the pieces at all cuts follow from the products, and
then each chunk traces its own path back.

No piece goes on after a space, so words never interact: only the words that a
cut goes through are searched for paths, those inside a chunk are looked up.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furlong.scale.storage import lay_down

SPACE = "▁"
# Code points of a chunk; longer texts are giant.
CHUNK = 16_384
# Chunks whose matrices are multiplied in one task.
BLOCK = 64
# Words, pieces and pairs of pieces that a task's tables keep before they begin anew.
_KNOWN_WORDS = 100_000
# Code points that are encoded at once; and chunks that are searched at once.
_SLICE = 1 << 18
_CHUNKS = 16
_NO = float("-inf")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """A BPE model with byte fallback: its pieces, and the encoder for single words."""

    def __init__(self, model: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        spec = proto.ModelProto()
        spec.ParseFromString(model)
        norm = spec.normalizer_spec
        if spec.trainer_spec.model_type != 2 or not spec.trainer_spec.byte_fallback:
            raise ValueError("the model is not BPE with byte fallback")
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix:
            raise ValueError("the model changes texts before it encodes them")
        normal = {p.piece: i for i, p in enumerate(spec.pieces) if p.type == 1}
        if any(SPACE in p.lstrip(SPACE) for p in normal):
            raise ValueError("a piece of the model goes on after a space")
        self.ids = normal
        self.longest = max(map(len, normal))
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(spec.pieces) if p.type == 6}
        raw = {i: bytes([b]) for b, i in self.bytes.items()}
        self.raw = [raw.get(i, b"" if p.type in (2, 3) else p.piece.encode()) for i, p in enumerate(spec.pieces)]
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        norm.add_dummy_prefix = False
        self.plain = sentencepiece.SentencePieceProcessor(model_proto=spec.SerializeToString())
        self._single: dict[str, tuple[int, ...] | None] = {}
        self._fits: dict[tuple[str, str], bool] = {}

    def single(self, piece: str) -> tuple[int, ...] | None:
        """The ids of a piece, or of the bytes of one unknown character; None for other strings."""
        if piece not in self._single:
            if len(self._single) > _KNOWN_WORDS:
                self._single.clear()
            own = self.ids.get(piece)
            found = (own,) if own is not None else None
            if own is None and len(piece) == 1:
                found = tuple(self.bytes[b] for b in piece.encode("utf-8", "replace"))
            if found is not None and tuple(self.plain.encode(piece)) != found:
                found = None  # the encoder never makes this piece
            self._single[piece] = found
        return self._single[piece]

    def fits(self, left: str, right: str) -> bool:
        key = (left, right)
        if key not in self._fits:
            if len(self._fits) > _KNOWN_WORDS:
                self._fits.clear()
            self._fits[key] = tuple(self.plain.encode(left + right)) == self.single(left) + self.single(right)
        return self._fits[key]

    def decode(self, ids) -> str:
        """The normalised text of ids: spaces as ``SPACE``, the leading one included."""
        return b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")


def words_of(text: str) -> list[str]:
    """What follows the first ``SPACE`` of each word of a normalised text; a run of spaces opens one word."""
    parts = text.replace(SPACE, " ").split(" ")
    if "" not in parts:
        return parts
    out, spaces = [], 0
    for part in parts:
        if part:
            out.append(" " * spaces + part)
            spaces = 0
        else:
            spaces += 1
    if spaces:
        out.append(" " * (spaces - 1))
    return out


class WordEncoder:
    """Ids of many words by table: each distinct word is encoded once while it is known."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self._reset()

    def _reset(self) -> None:
        self.index: dict[str, int] = {}
        self.starts, self.sizes = np.empty(0, np.int64), np.empty(0, np.int64)
        self.flat = np.empty(0, np.int32)

    def encode(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in order, ids in each text)."""
        if len(self.index) > _KNOWN_WORDS:
            self._reset()
        index, fresh = self.index, []
        at = []
        for words in texts:
            for w in words:
                i = index.get(w)
                if i is None:
                    index[w] = i = len(index)
                    fresh.append(w)
                at.append(i)
        if fresh:
            space = [self.pieces.ids[SPACE]]
            found = [ids if w else space for w, ids in zip(fresh, self.pieces.processor.encode(fresh), strict=True)]
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            flat = np.fromiter((i for ids in found for i in ids), np.int32, int(sizes.sum()))
            self.starts = np.append(self.starts, len(self.flat) + np.cumsum(sizes) - sizes)
            self.sizes, self.flat = np.append(self.sizes, sizes), np.append(self.flat, flat)
        at = np.array(at, np.int64)
        sizes = self.sizes[at]
        before = np.cumsum(sizes) - sizes
        ids = self.flat[np.repeat(self.starts[at] - before, sizes) + np.arange(int(sizes.sum()))]
        words = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.append(0, np.cumsum(sizes))[np.cumsum(words)]
        return ids, np.diff(np.append(0, ends))


# -- the scan ---------------------------------------------------------------


@dataclass(frozen=True)
class Window:
    """A chunk of a normalised text with what its border pieces may need beside it."""

    text: str
    a: int  # the chunk is text[a:b]
    b: int
    first: bool
    last: bool


def _tokens_over(p: Pieces, text: str, cut: int, last: bool) -> list[tuple[int, int]]:
    """Pieces [s, e) with s < cut <= e, in order; at the end of a text those that end there."""
    out = []
    for s in range(max(0, cut - p.longest), cut):
        for e in range(cut, min(len(text), cut if last else s + p.longest) + 1):
            if p.single(text[s:e]) is not None:
                out.append((s, e))
    return out


def _paths(p: Pieces, text: str, starts: list[tuple[int, int]], goals, free: int | None):
    """Best predecessors of all pieces reachable from ``starts``, for one start at a time.

    ``goals`` are pieces or, as an int, a word border to reach exactly. ``free``
    is a border at which a path may begin without a neighbour.
    """
    begin = [free] if free is not None else []
    reach: dict[int, list[tuple[int, int]]] = {}
    back: dict[tuple[int, int], tuple[int, int] | None] = {}
    for t in starts:
        back[t] = None
        reach.setdefault(t[1], []).append(t)
    stop = goals if isinstance(goals, int) else max((g[0] for g in goals), default=-1)
    at = min([*reach, *begin], default=stop + 1)
    far = goals if isinstance(goals, int) else max((g[1] for g in goals), default=-1)
    while at <= stop and (not isinstance(goals, int) or at < goals):
        lefts = reach.get(at, [])
        if lefts or at in begin:
            for e in range(at + 1, min(far, at + p.longest) + 1):
                piece = text[at:e]
                if p.single(piece) is None or (at, e) in back:
                    continue
                if at in begin:
                    back[(at, e)] = None
                    reach.setdefault(e, []).append((at, e))
                    continue
                for s, m in lefts:
                    if p.fits(text[s:m], piece):
                        back[(at, e)] = (s, m)
                        reach.setdefault(e, []).append((at, e))
                        break
        at += 1
    return back, reach


def _walk(back: dict, token: tuple[int, int]) -> list[tuple[int, int]]:
    path = []
    while token is not None:
        path.append(token)
        token = back[token]
    return path[::-1]


def _borders(w: Window) -> tuple[int, int] | None:
    """The first and the last word border of a chunk, strictly before its end."""
    is_border = lambda i: w.text[i] == SPACE and (i == 0 or w.text[i - 1] != SPACE)
    lo = w.a
    while lo < w.b and not is_border(lo):
        lo += 1
    if lo >= w.b:
        return None
    hi = w.b - 1
    while not is_border(hi):
        hi -= 1
    return lo, hi


def _entries(p: Pieces, w: Window) -> list[tuple[int, int] | None]:
    return [None] if w.first else _tokens_over(p, w.text, w.a, False)


def transfer(p: Pieces, w: Window) -> np.ndarray:
    """Max-plus matrix from the pieces over the chunk's start to those over its end."""
    entries, exits = _entries(p, w), _tokens_over(p, w.text, w.b, w.last)
    out = np.full((len(entries), len(exits)), _NO)
    borders = _borders(w)
    if borders is None:
        for i, t in enumerate(entries):
            back, _ = _paths(p, w.text, [t] if t else [], exits, w.a if t is None else None)
            for j, g in enumerate(exits):
                if g in back:
                    out[i, j] = 0.0
        return out
    lo, hi = borders
    head = np.full(len(entries), _NO)
    for i, t in enumerate(entries):
        if t is None or t[1] == lo:
            head[i] = 0.0
        elif t[1] < lo:
            _, reach = _paths(p, w.text, [t], lo, None)
            head[i] = 0.0 if lo in reach else _NO
    back, _ = _paths(p, w.text, [], exits, hi)
    tail = np.array([0.0 if g in back else _NO for g in exits])
    return head[:, None] + tail


def trace(p: Pieces, words: WordEncoder, w: Window, i: int, j: int) -> tuple[np.ndarray, bool]:
    """Ids of the pieces that start in the chunk, from entry ``i`` to exit ``j``; and that they decode to it."""
    entry, goal = _entries(p, w)[i], _tokens_over(p, w.text, w.b, w.last)[j]
    ids = lambda path: [x for s, e in path for x in p.single(w.text[s:e])]
    begin = w.a if entry is None else entry[1]
    borders = _borders(w)
    if borders is None:
        back, _ = _paths(p, w.text, [entry] if entry else [], [goal], w.a if entry is None else None)
        path = _walk(back, goal)
        found = np.array(ids(path[1:] if entry else path), np.int32)
    else:
        lo, hi = borders
        head: list[int] = []
        if entry is not None and entry[1] < lo:
            back, reach = _paths(p, w.text, [entry], lo, None)
            head = ids(_walk(back, reach[lo][0])[1:])
        middle = np.empty(0, np.int32)
        if hi > lo:
            middle, _ = words.encode([words_of(w.text[lo + 1 : hi])])
        back, _ = _paths(p, w.text, [], [goal], hi)
        found = np.concatenate([np.array(head, np.int32), middle, np.array(ids(_walk(back, goal)), np.int32)])
    return found, p.decode(found.tolist()) == w.text[begin : goal[1]]


def multiply(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return (left[:, :, None] + right[None, :, :]).max(axis=1)


def product(matrices: list[np.ndarray]) -> list[list[np.ndarray]]:
    """Levels of pairwise products, the matrices first and the whole product last."""
    levels = [matrices]
    while len(levels[-1]) > 1:
        row = levels[-1]
        pairs = [multiply(row[k], row[k + 1]) for k in range(0, len(row) - 1, 2)]
        levels.append(pairs + row[2 * len(pairs) :])
    return levels


def states_between(matrices: list[np.ndarray], i: int, j: int) -> list[tuple[int, int]]:
    """(entry, exit) of each matrix on the best path from ``i`` to ``j``, down the levels of products."""
    levels = product(matrices)
    ends = [(i, j)]
    for row in levels[-2::-1]:
        finer = []
        for k, (a, b) in enumerate(ends):
            if 2 * k + 1 < len(row):
                m = int(np.argmax(row[2 * k][a] + row[2 * k + 1][:, b]))
                finer += [(a, m), (m, b)]
            else:
                finer.append((a, b))
        ends = finer
    return ends


# -- Spark ------------------------------------------------------------------

def _few(batches: Iterator[pa.RecordBatch], rows: int = _CHUNKS) -> Iterator[pa.RecordBatch]:
    """The same rows, few at a time: as Python objects they take several times the batch's bytes."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        batch = None  # else it stays while the next one is read


_WINDOW = "sha string, chunk int, block int, text string, a int, b int, first boolean, last boolean"


def _windows(longest: int, chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sha, text in zip(batch.column(0), batch.column(1), strict=True):
                sha = sha.as_py()
                whole = SPACE + text.as_py().replace(" ", SPACE)
                rows = []
                for k, at in enumerate(range(0, len(whole), chunk)):
                    lo, hi = max(0, at - longest - 1), min(len(whole), at + chunk + longest)
                    end = min(at + chunk, len(whole))
                    rows.append((sha, k, k // BLOCK, whole[lo:hi], at - lo, end - lo, at == 0, end == len(whole)))
                names = [c.split()[0] for c in _WINDOW.split(", ")]
                kinds = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_()]
                yield pa.RecordBatch.from_pydict(
                    dict(zip(names, map(list, zip(*rows, strict=True)), strict=True)),
                    schema=pa.schema(list(zip(names, kinds, strict=True))),
                )

    return run


def _window(row: dict) -> Window:
    return Window(row["text"], row["a"], row["b"], row["first"], row["last"])


def _matrices(found: pa.Table) -> tuple[pa.Table, list[np.ndarray]]:
    found = found.sort_by([(("chunk" if "chunk" in found.column_names else "block"), "ascending")])
    shapes = zip(found["n"].to_pylist(), found["m"].to_pylist(), found["data"].to_pylist(), strict=True)
    return found, [np.frombuffer(d, np.float64).reshape(n, m) for n, m, d in shapes]


def encode_giants(texts: DataFrame, model, chunk: int) -> DataFrame:
    """(sha, ids, round_trip) of distinct (sha, text) rows longer than a chunk."""
    longest = Pieces(model.value).longest
    windows = lay_down(texts.mapInArrow(_windows(longest, chunk), _WINDOW), "pieces-chunks")

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Pieces(model.value)
        for batch in _few(batches):
            found = [transfer(p, _window(r)) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array([m.shape[0] for m in found], pa.int32()),
                 pa.array([m.shape[1] for m in found], pa.int32()), pa.array([m.tobytes() for m in found], pa.binary())],
                ["sha", "chunk", "block", "n", "m", "data"],
            )

    kind = "sha string, chunk int, block int, n int, m int, data binary"
    mats = lay_down(windows.mapInArrow(matrices, kind), "pieces-matrices")

    def multiply_block(found: pa.Table) -> pa.Table:
        found, m = _matrices(found)
        whole = product(m)[-1][0]
        return pa.table(
            {"sha": [found["sha"][0].as_py()], "block": pa.array([found["block"][0].as_py()], pa.int32()),
             "n": pa.array([whole.shape[0]], pa.int32()), "m": pa.array([whole.shape[1]], pa.int32()), "data": [whole.tobytes()]}
        )

    def choose(found: pa.Table) -> pa.Table:
        found, m = _matrices(found)
        ends = states_between(m, 0, int(np.argmax(product(m)[-1][0][0])))
        return pa.table(
            {"sha": found["sha"], "block": found["block"], "i": pa.array([e[0] for e in ends], pa.int32()),
             "j": pa.array([e[1] for e in ends], pa.int32())}
        )

    def refine(found: pa.Table, ends: pa.Table) -> pa.Table:
        found, m = _matrices(found)
        states = states_between(m, ends["i"][0].as_py(), ends["j"][0].as_py())
        return pa.table(
            {"sha": found["sha"], "chunk": found["chunk"], "i": pa.array([e[0] for e in states], pa.int32()),
             "j": pa.array([e[1] for e in states], pa.int32())}
        )

    blocks = mats.groupBy("sha", "block").applyInArrow(multiply_block, "sha string, block int, n int, m int, data binary")
    ends = blocks.groupBy("sha").applyInArrow(choose, "sha string, block int, i int, j int")
    states = (
        mats.groupBy("sha", "block")
        .cogroup(ends.groupBy("sha", "block"))
        .applyInArrow(refine, "sha string, chunk int, i int, j int")
    )

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Pieces(model.value)
        words = WordEncoder(p)
        for batch in _few(batches):
            found = [trace(p, words, _window(r), r["i"], r["j"]) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("sha"), batch.column("chunk"), pa.array([f[0] for f in found], pa.list_(pa.int32())),
                 pa.array([f[1] for f in found], pa.bool_())],
                ["sha", "chunk", "ids", "ok"],
            )

    placed = windows.join(states, ["sha", "chunk"]).mapInArrow(paths, "sha string, chunk int, ids array<int>, ok boolean")
    parts = F.array_sort(F.collect_list(F.struct("chunk", "ids")))
    return placed.groupBy("sha").agg(
        F.flatten(F.transform(parts, lambda x: x["ids"])).alias("ids"), F.min("ok").alias("round_trip")
    )


def encode(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    model_path: str | None = None,
    chunk: int = CHUNK,
) -> DataFrame:
    """(id_col, n_tokens, ids, round_trip) of every row, in the model's own ids.

    ``ids`` are those of the SentencePiece encoder of the same model;
    ``round_trip`` says that they decode to the text (a ``SPACE`` sign in it
    counts as the space it is encoded as). Null and empty texts have no ids.
    Texts longer than ``chunk`` code points take the scan, equal ones once.
    Null ids and repeated rows are kept; an empty table gives an empty result.
    Other columns are ignored. The model file is read by the driver.
    """
    spark = docs.sparkSession
    with open(model_path or default_model(), "rb") as f:
        model = spark.sparkContext.broadcast(f.read())
    Pieces(model.value)  # refuses other kinds of model before any task does
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    is_giant = F.length("_text") > chunk

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Pieces(model.value)
        encoder = WordEncoder(p)
        for batch in batches:
            row = 0
            while row < batch.num_rows:
                texts, size, first = [], 0, row
                while row < batch.num_rows and size < _SLICE:
                    texts.append(batch.column(1)[row].as_py())
                    size += len(texts[-1])
                    row += 1
                ids, counts = encoder.encode([words_of(t) if t else [] for t in texts])
                offsets = np.append(0, np.cumsum(counts)).astype(np.int32)
                listed = ids.tolist()
                ok = [
                    p.decode(listed[a:b]) == (SPACE + t.replace(" ", SPACE) if t else "")
                    for t, a, b in zip(texts, offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)
                ]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(texts)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids)), pa.array(ok, pa.bool_())],
                    ["_id", "ids", "round_trip"],
                )
            batch = None  # else it stays while the next one is read

    kind = f"_id {id_type}, ids array<int>, round_trip boolean"
    out = rows.where(~is_giant).mapInArrow(small, kind)
    giants = rows.where(is_giant).withColumn("sha", F.sha2("_text", 256))
    found = encode_giants(giants.select("sha", "_text").dropDuplicates(["sha"]), model, chunk)
    joined = giants.select("_id", F.col("sha").alias("_sha")).join(found, F.col("_sha") == F.col("sha"))
    out = out.unionByName(joined.select("_id", "ids", "round_trip"))
    return out.select(F.col("_id").alias(id_col), F.size("ids").cast("bigint").alias("n_tokens"), "ids", "round_trip")


def decode(encoded: DataFrame, ids_col: str = "ids", into: str = "text", model_path: str | None = None) -> DataFrame:
    """``encoded`` with the text of its ids (a column named ``into`` is replaced); null ids give null."""
    with open(model_path or default_model(), "rb") as f:
        model = encoded.sparkSession.sparkContext.broadcast(f.read())

    @F.pandas_udf("string")
    def text_of(ids: pd.Series) -> pd.Series:
        p = Pieces(model.value)
        plain = lambda x: p.decode(x).replace(SPACE, " ").removeprefix(" ")
        return pd.Series([None if x is None else plain(list(x)) for x in ids], dtype=object)

    return encoded.withColumn(into, text_of(F.col(ids_col)))
