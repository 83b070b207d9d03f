"""Spelling variants beside brute force."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from llm_support import LOWER, SMALL, awkward, no_documents  # noqa: F401
from furlong.llm import spelling
from furlong.llm.queries import QUERIES


def variants_by_force(docs, least=3):
    """{word: (form, root, n, n_near, form_n)}; near pairs meet at their deletions and are compared."""
    counts = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if h % 97 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            counts[word] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= least}
    at = defaultdict(set)
    for w in words:
        for d in {w} | {w[:i] + w[i + 1 :] for i in range(len(w))}:
            at[d].add(w)

    def one_apart(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    near = defaultdict(set)
    for group in at.values():
        for a in group:
            near[a] |= {b for b in group if b != a and b not in near[a] and one_apart(a, b)}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items()}


def found(df):
    rows = df.collect()
    out = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(out) == len(rows)
    return out


def test_query_equals_brute_force(spark):
    docs = [(r[0], r[1]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    want = variants_by_force(docs)
    assert sum(v[0] is not None for v in want.values()) > 50
    assert found(QUERIES["op13_spelling"](spark, SMALL)) == want


@pytest.mark.parametrize("most", [spelling.PASS_BLOCKS, 3])
def test_edits_ties_and_chains(spark, most):
    """In one pass and in many, with words longer than a join key."""
    long = "x" * 40 + "yz" * 30
    words = {
        "colour": 40, "color": 8, "colouur": 3, "colon": 20, "house": 10, "horse": 10, "hose": 5, "hoarse": 4,
        "aaaaa": 7, "aaaaaa": 30, "béton": 9, "beton": 4, "BÉTON": 3, "abcd": 50, "abcde": 3,
        long: 12, long[:-1]: 4, long[:50] + "q" + long[51:]: 3, "rareÿ": 2,
    }
    text = " ".join((w + " ") * n for w, n in words.items())
    docs = [(1, text), (2, "Colour-COLOUR house"), (None, None), (3, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = found(spelling.variants(df, most=most))
    assert got == variants_by_force(docs)
    assert long in got and got[long[:-1]][:2] == (long, long)


def test_many_passes_hold_every_word():
    counts = {5: 100, 6: 9, 7: 1}
    passes = spelling.shards(counts, most=10)
    assert all(sum(s.blocks for s in p) <= 10 and p[0].first == 0 for p in passes)
    parts = [s for p in passes for s in p if s.size == 5]
    assert len(parts) == parts[0].parts == 3
    h = np.random.default_rng(0).integers(0, 1 << 63, 1000).astype(np.uint64)
    assert sum(s.mine(h).astype(int) for s in parts).tolist() == [1] * 1000


def test_awkward_rows(spark, awkward, no_documents):
    docs = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    assert found(spelling.variants(awkward)) == variants_by_force(docs)
    assert spelling.variants(no_documents).count() == 0


def test_long_texts_are_cut_between_runs():
    text = "ab-cd " * 400_000 + "e" * 2_000_000 + " end"
    pieces = list(spelling._pieces(text))
    assert "".join(pieces) == text and len(pieces) > 1
    assert [w for p in pieces for w in spelling._RUN.findall(p)] == spelling._RUN.findall(text)
