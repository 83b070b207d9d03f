"""Character models beside a Kneser-Ney written out by its formulas, and held-out accuracy."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from llm_support import SMALL, awkward, no_documents  # noqa: F401
from furlong.llm import language
from furlong.llm.queries import QUERIES

N = language.ORDER


def model_by_force(texts, symbols):
    """log p(character | context) of interpolated Kneser-Ney over padded words."""
    counts = [Counter() for _ in range(N + 1)]
    for t in texts:
        for w in language._WORDS.findall(t.lower()):
            s = " " * (N - 1) + w + "\n"
            for i in range(N - 1, len(s)):
                counts[N][s[i - N + 1 : i + 1]] += 1
    raw = [Counter() for _ in range(N + 1)]
    raw[N] = counts[N]
    for k in range(N - 1, 0, -1):
        for g, n in raw[k + 1].items():
            raw[k][g[1:]] += n
        before = Counter(g[1:] for g in raw[k + 1])
        counts[k] = Counter({g: raw[k][g] if g[0] == " " else before[g] for g in raw[k]})
    back, own = {}, {}
    for k in range(1, N + 1):
        ones, twos = (sum(n == i for n in counts[k].values()) for i in (1, 2))
        d = min(0.95, max(0.1, ones / (ones + 2 * twos) if ones + 2 * twos else 0.5))
        total, kinds = defaultdict(int), Counter()
        for g, n in counts[k].items():
            total[g[:-1]] += n
            kinds[g[:-1]] += 1
        for g, n in counts[k].items():
            own[g] = max(n - d, 0) / total[g[:-1]]
        for h in kinds:
            back[k, h] = d * kinds[h] / total[h]

    def p(gram):
        if not gram:
            return 1 / symbols
        return own.get(gram, 0.0) + back.get((len(gram), gram[:-1]), 1.0) * p(gram[1:])

    return p


def entropies_by_force(texts, by_lang):
    symbols = 1 + len({c for ts in by_lang.values() for t in ts for w in language._WORDS.findall(t.lower()) for c in w + "\n"})
    models = {x: model_by_force(ts, symbols) for x, ts in by_lang.items()}
    out = []
    for t in texts:
        padded = [" " * (N - 1) + w + "\n" for w in language._WORDS.findall(t.lower())]
        ends = [s[i - N + 1 : i + 1] for s in padded for i in range(N - 1, len(s))]
        out.append([-sum(math.log(models[x](g)) for g in ends) / len(ends) for x in sorted(models)])
    return np.array(out)


TAUGHT = {
    "en": ["the cat sat on the mat", "the dog and the cat slept", "A Storm at the station"],
    "de": ["die Katze saß auf der Matte", "der Hund und die Katze schliefen", "Über den Wolken"],
}
JUDGED = ["the matte", "ein Hund saß", "zzz", "ΑΒΓ δ", "x" * 50, "the the the die"]


@pytest.mark.parametrize("head_rows", [1 << 20, 40, 0])
def test_cross_entropies_equal_the_formulas(spark, head_rows):
    """Whether tasks hold the whole model, a part of it, or none."""
    rows = [(x, t.encode()) for x, ts in TAUGHT.items() for t in ts]
    models = language.train(spark.createDataFrame(rows, "_lang string, _text binary"), head_rows)
    assert (models.table is None) == (head_rows == 1 << 20)
    df = spark.createDataFrame([(t.encode(), i) for i, t in enumerate(JUDGED * 2)], "_text binary, _id int")
    got = language.measure(df, models).toPandas().sort_values("_id")
    found = -np.stack(got["_sums"].to_numpy()) / got["_n"].to_numpy()[:, None]
    want = entropies_by_force(JUDGED * 2, TAUGHT)
    assert models.head.value.langs == ["de", "en"]
    assert found == pytest.approx(want, rel=1e-9)


def test_held_out_accuracy(spark):
    got = QUERIES["op11_language_id"](spark, SMALL).toPandas()
    lang = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang").toPandas()
    both = got.merge(lang, on="doc_id")
    assert len(got) == len(lang) and got["score"].between(0, 1).all()
    unseen = both[both["held_out"]]
    assert len(unseen) > 20 and (unseen["lang_pred"] == unseen["lang"]).mean() >= 0.98


def test_other_writing_is_rejected(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang")
    odd = [(10_000, "Это совсем другой язык, которого здесь нет", None), (10_001, "qxz wvk jjq xxq zkw vvx qqk", None)]
    got = language.identify(docs.unionByName(spark.createDataFrame(odd, docs.schema))).toPandas().set_index("doc_id")
    assert got.loc[10_000, "rejected"] and got.loc[10_001, "rejected"]
    assert got["rejected"].drop([10_000, 10_001]).mean() < 0.05


def test_awkward_rows(spark, awkward, no_documents):
    got = language.identify(awkward).collect()
    assert len(got) == awkward.count()
    for r in got:
        if r["doc_id"] in (4, 5, 6):
            assert (r["lang_pred"], r["score"], r["rejected"], r["cross_entropy"]) == ("und", 0.0, True, None)
    assert {r["lang_pred"] for r in got} == {"en", "und"}
    assert language.identify(no_documents).count() == 0
    untaught = awkward.selectExpr("doc_id", "text", "cast(null as string) AS lang", "_id", "_text", "k", "n")
    assert {(r["lang_pred"], r["score"]) for r in language.identify(untaught).collect()} == {("und", 0.0)}


def test_held_out_rows_teach_nothing(spark):
    docs = spark.range(400).selectExpr("id AS doc_id", "'some words of a text' AS text")
    fold = docs.withColumn("out", language.held_out(docs["doc_id"]))
    labelled = fold.selectExpr("doc_id", "text", "CASE WHEN out THEN 'xx' ELSE 'yy' END AS lang")
    assert {r["lang_pred"] for r in language.identify(labelled).select("lang_pred").collect()} == {"yy"}


def test_long_texts_are_taken_apart_and_judged_whole():
    text = "ab cd " * 400_000 + "e" * 200_000
    found = [w for part in language.words_of(text.encode()) for w in part]
    assert found == language._WORDS.findall(text)
    assert max(map(len, found)) == 65_536
