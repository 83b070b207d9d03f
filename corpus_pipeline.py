"""From raw documents to token ids, in five stored stages.

Every stage takes what its predecessor kept, as the harness or ``run`` reread it
from Parquet. A stage's own intermediate tables go when a later stage begins.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from furlong.llm import exact_dedup, jaccard_join, mixing, pieces, toxicity
from furlong.llm.common import table
from furlong.scale import storage

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

_left: list[tuple[int, tuple[str, ...]]] = []


def _stage(place: int, work: Stage) -> Stage:
    """``work``, after the tables of earlier stages are dropped; their results are stored by then."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for earlier in [x for x in _left if x[0] < place]:
            storage.drop(spark, earlier[1])
            _left.remove(earlier)
        before = set(storage.made())
        out = work(spark, docs, sf_dir)
        _left.append((place, tuple(p for p in storage.made() if p not in before)))
        return out

    return run_stage


def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def _exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each text, white space aside."""
    return exact_dedup.drop_copies(docs)


def _near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each group linked by five-word Jaccard of 0.75 or more."""
    return jaccard_join.one_of_each(docs)


def _mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.take_copies(docs)


def _encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each taken document, a copy of it for each time it is taken."""
    return pieces.encode(docs)


STAGES: list[tuple[str, Stage]] = [
    (name, _stage(place, work))
    for place, (name, work) in enumerate(
        [
            ("toxicity", _toxicity),
            ("exact dedup", _exact_dedup),
            ("n-gram Jaccard join", _near_dedup),
            ("mixing sources to target weights", _mix),
            ("SentencePiece encoding", _encode),
        ]
    )
]

# Fitted models, hashes and tokenizers have no SQL; the tests run every stage beside brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, round_trip) of the corpus, a row for each taken copy."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = storage.lay_down(stage(spark, docs, sf_dir), "corpus-" + name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
