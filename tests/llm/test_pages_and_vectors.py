"""URL rules, site lines and neighbours, beside SQL and brute force."""

import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import oracle_check
from llm_support import SMALL
from furlong.llm import line_dedup, neighbours, url_filter
from furlong.llm.oracle import ORACLE
from furlong.llm.queries import QUERIES, RULES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    got = QUERIES[name](spark, SMALL).toPandas()
    want = oracle_check.connect(SMALL).execute(ORACLE[name]).df()
    assert len(want) and oracle_check.difference(got, want) is None


URLS = {
    "https://A.Example.ORG/es/1": ("a.example.org", "/es/1", "example.org/es/", "block"),
    "http://example.org/en/12?x=/es/": ("example.org", "/en/12", "example.org/en/1", "block"),
    "http://notexample.org/es/": ("notexample.org", "/es/", "org/", "allow"),
    "http://example.org": ("example.org", "", None, "allow"),
    "http://x.com/de/": ("x.com", "/de/", "com/de/", "block"),
    "http://x.com/DE/": ("x.com", "/DE/", None, "allow"),
    "http://x.net/casino/a": ("x.net", "/casino/a", None, "block"),
    "http://x.net/CASINO/a": ("x.net", "/CASINO/a", None, "block"),
    "http://x.net/casinos/a": ("x.net", "/casinos/a", None, "allow"),
    "http://www.spam-farm.net": ("www.spam-farm.net", "", None, "block"),
    "no scheme": ("", "", None, "allow"),
    "": ("", "", None, "allow"),
    None: ("", "", None, "allow"),
    "x://h#f/es/": ("h", "", None, "allow"),
}


def test_rules_on_single_urls(spark):
    inner = ("_url", "_subject", "_token", "_regex", "_best", "_page", "_page_url", "_rule")
    rows = [(i, u, "clash", *inner) for i, u in enumerate(URLS)] + [(None, "http://x.com/de/", "", *inner)] * 2
    df = spark.createDataFrame(rows, "page_id long, url string, rule string, " + ", ".join(f"{c} string" for c in inner))
    got = url_filter.filter_urls(df, RULES).collect()
    assert all(r[c] == c for r in got for c in inner)
    assert len(got) == len(rows)
    for r in got:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == URLS[r["url"]], r["url"]
    assert url_filter.filter_urls(df.limit(0), RULES).count() == 0


def test_rules_without_whole_tokens_are_tried(spark):
    df = spark.createDataFrame([(1, "http://a.b/xyzzy")], "page_id long, url string")
    rule = url_filter.Rule("*yzz*", "block")
    assert rule.tokens() == []
    assert url_filter.filter_urls(df, [rule]).first()["verdict"] == "block"


def test_lines_by_share_of_the_site(spark):
    page = "<p>menu</p><p>text {0}</p><p>menu</p><!-- <p>no</p> --><script>x</script>"
    rows = [(i, "http://a.org/", page.format(i)) for i in range(9)] + [(i, "http://b.org/", "<p>menu</p><p>one</p>") for i in (20, 20)]
    rows += [(30, None, None), (None, "http://c.org/", ""), (31, "http://b.org/", "<p>\tother <b>bold</b> </p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = line_dedup.site_line_dedup(df, ratio=0.5, min_pages=3).collect()
    assert len(got) == len(rows)
    by = {r["page_id"]: r for r in got}
    assert by[3]["text"] == "text 3" and by[3]["n_dropped"] == 2 and by[3]["n_lines"] == 3
    assert by[20]["text"] == "menu\none" and by[30]["text"] == "" and by[None]["n_lines"] == 0
    assert by[31]["text"].strip() == "other bold"
    assert line_dedup.site_line_dedup(df.limit(0)).count() == 0


def lines_by_force(html):
    text = re.sub(line_dedup._TAGS, "", re.sub(line_dedup._BLOCKS, "\n", re.sub(line_dedup._UNSEEN, " ", html)))
    return [x for x in re.split(r"[\x20\x09]*[\r\n]+[\x20\x09\r\n]*", text) if x.strip(" ")]


def test_lines_of_pages_that_close_nothing(spark):
    rng = random.Random(3)
    parts = ["<script", "<script>", "</script >", "<!--", "-->", "<!-->", "<style x>", "</style>", "<p", "<p>", "</div", ">", "<", "a", " ", "\t", "\n", "<b>"]
    pages = ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(3000)]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, html string")
    got = df.select("html", line_dedup.html_lines(F.col("html")).alias("lines")).collect()
    assert [r["lines"] for r in got] == [lines_by_force(r["html"]) for r in got]


HOSTILE = ["<script ", "<!-- ", "<style>", "<", "<p ", "</p ", " ", "\t", "<script></script ", "<!-->", "<p>menu</p>"]


def test_hostile_pages_take_seconds(spark):
    """A million characters of each; three pages, so that the lines of the last are dropped."""
    rows = [(i, "http://a.org/", part * (1_000_000 // len(part))) for i, part in enumerate(HOSTILE)]
    rows += [(100 + i, "http://b.org/", "".join(f"<p>line {j}</p>" for j in range(60_000))) for i in range(3)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(8)
    began = time.time()
    got = {r["page_id"]: r for r in line_dedup.site_line_dedup(df).collect()}
    assert time.time() - began < 60
    assert all(got[100 + i]["n_dropped"] == got[100 + i]["n_lines"] == 60_000 for i in range(3))
    assert got[HOSTILE.index("<p>menu</p>")]["n_dropped"] == 0


def test_recall_and_scores(spark):
    got = QUERIES["op7_neighbours"](spark, SMALL).toPandas()
    table = spark.read.parquet(f"{SMALL}/embeddings.parquet").toPandas()
    x = np.stack(table["embedding"].to_numpy()).astype(float)
    ids, hits, total = table["vec_id"].to_numpy(), 0, 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        d[ids == q] = np.inf
        mine = got[got["query_id"] == q].sort_values("rank")
        assert list(mine["rank"]) == list(range(1, 11))
        assert np.allclose(mine["score"], [d[ids == v][0] for v in mine["vec_id"]], rtol=0, atol=1e-12)
        hits, total = hits + len(set(mine["vec_id"]) & set(ids[np.lexsort((ids, d))[:10]])), total + 10
    assert hits / total >= 0.9


def test_forest_opens_part_of_the_vectors_only():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((4000, 8))
    forest = neighbours.grow(x, 4, 64, 1)
    leaves = forest.leaves_of(x)
    opened = forest.search(x[0], 0.2)
    seen = np.isin(leaves, opened).any(axis=1)
    assert seen[0] and seen.mean() < 0.3
    assert len(set(opened)) == len(opened)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(100, [1.0, 0.0], "c")] + [(i, [1.0, 0.0], "c") for i in range(1, 30)] + [(200, [1.0, 0.0], "c")]
    rows += [(300, [0.0, 0.0], "c"), (400, None, "c"), (50, [nan, 1.0], "c"), (51, [inf, 1.0], "c"), (52, [None, 1.0], "c")]
    rows += [(None, [1.0, 0.0], "c"), (60, [2.0, 0.0], "c"), (61, [1.0], "c"), (500, [2.0, 0.0], "c"), (500, [2.0, 0.0], "c")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, leaf string")
    got = {}
    for r in neighbours.nearest(df).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(got) == [100, 200, 500]
    assert sorted(got[100]) == [(i, i, 0.0) for i in range(1, 11)]
    assert sorted(got[500])[:2] == [(1, 60, 0.0), (2, 1, 1.0)] and len(got[500]) == 10
    few = neighbours.nearest(df.where("vec_id IN (100, 60, 61)")).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in few] == [(100, 1, 60, 1.0)]
    assert neighbours.nearest(df.limit(0)).count() == 0
