"""Awkward tables, and brute-force versions of operators that SQL cannot express."""

import re

import pytest

SMALL = "/root/testdata/sf0.001"
# Names that operators use inside, as columns of the caller.
INNER = (
    "_sha _text_sha _stay _keep _ties _digest _norm _word _bits _doc _source _mix_source _serial _floor _up _order "
    "_size _target _taken _copies _copy _block _lines _spans _near keep_id kept group_size text_sha256 component_id"
).split()
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, _id string, _text string, k long, n long, "
    "ids string, " + ", ".join(f"{c} string" for c in INNER)
)
LONG = "na und so weiter " * 3000 + "x" * 30_000 + " Ende"


def document(i, text, source="src0"):
    return (i, text, "en", source, len(text or ""), "clash", "clash", 7, 7, "clash", *INNER)


@pytest.fixture(scope="session")
def awkward(spark):
    """Null ids, texts and sources, empty, blank and very long texts, repeated rows, clashing columns."""
    rows = [
        document(1, "the cat sat on the mat and slept all day long"),
        document(2, "The  cat sat on the mat and slept all day long"),
        document(3, "the cat sat on the mat and slept all day long here"),
        document(3, "the cat sat on the mat and slept all day long here"),
        document(None, "the cat sat on the mat and slept all day long", None),
        document(4, None, None),
        document(5, ""),
        document(6, " \t\n "),
        document(7, LONG, "src1"),
        document(7, LONG, "src1"),
        document(8, "one two"),
        document(9, "two one", None),
        document(None, None),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def label_table(spark):
    rows = [(i, i % 2, (i + 1) % 2) for i in (1, 2, 3, 3, 7, 8, 9)] + [(None, 1, 1), (4, None, None)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")



LOWER = {c: c + 32 for c in range(65, 91)}


def components_by_force(docs, words=5, least=75):
    """(id, set size, smallest id reachable) of (id, text) rows."""
    sets = []
    for _, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        sets.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    parent = list(range(len(docs)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(docs)):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= least * (len(sets[a]) + len(sets[b]) - shared):
                parent[find(a)] = find(b)
    roots = {}
    for a, (i, _) in enumerate(docs):
        if i is not None:
            r = find(a)
            roots[r] = min(roots.get(r, i), i)
    return [(i, len(sets[a]), roots.get(find(a)) if sets[a] else i) for a, (i, _) in enumerate(docs)]


def secrets_by_force(text):
    """(kind, start, end) by start and kind: literal patterns, failing matches consumed."""
    kinds = ("assign", "access", "hex")
    low = "".join(chr(LOWER.get(ord(c), ord(c))) for c in text)
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""")
    spans = [("assign", m.start(), m.end()) for m in assign.finditer(low) if len(m.group(2)) >= 8]
    spans += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 16]
    spans += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 32]
    return sorted(spans, key=lambda s: (s[1], kinds.index(s[0])))


def targets_by_force(sizes, weights=(1, 2, 3), cap=3):
    """Targets by resharing what is above until nothing is."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, left, open_ = dict.fromkeys(order, 0.0), float(sum(sizes.values())), set(order)
    while left > 1e-9 and open_:
        total = sum(weight[s] for s in open_)
        for s in open_:
            target[s] += left * weight[s] / total
        left = 0.0
        for s in sorted(open_, key=str):
            if target[s] >= cap * sizes[s]:
                left += target[s] - cap * sizes[s]
                target[s] = float(cap * sizes[s])
                open_ = open_ - {s}
    return target
