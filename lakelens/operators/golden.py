"""Golden questions: sources by name, drafts by signature, checks of records, the benchmark's export, fingerprints of runs."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakelens.functions import text as T
from lakelens.operators import evals as E


@dataclass(frozen=True)
class Source:
    """What can be asked and sampled: tables of an index, the facet that makes strata, quotas by type."""

    index: Callable[[], DataFrame]
    stratum: str
    quotas: dict[str, int] = field(default_factory=dict)
    per_doc: int = 1
    excluded: frozenset[str] = frozenset()


@dataclass
class Sources:
    """Sources by name; an unknown name is refused with those there are."""

    known: dict[str, Source] = field(default_factory=dict)

    def get(self, name: str) -> Source:
        if name not in self.known:
            raise KeyError(f"no source {name!r}, there are {sorted(self.known)}")
        return self.known[name]


def fingerprint(settings: dict, digits: int = 12) -> str:
    """The same settings in any order have the same name."""
    return hashlib.sha256(json.dumps(settings, sort_keys=True).encode()).hexdigest()[:digits]


def reusable(drafts: DataFrame, signature: str) -> DataFrame:
    """Drafts of a signature, the last of each id (columns id, signature, at)."""
    turn = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("at")))
    return drafts.filter(F.col("signature") == signature).withColumn("_turn", turn).filter("_turn = 1").drop("_turn")


def checked(records: DataFrame, most_words: int = 40, least_words: int = 5) -> DataFrame:
    """Records with the checks that need no model: spans stand in the texts, the question shares no rare term (or, for an
    exact match, holds its anchor), and is neither short nor long.

    records: type, question, spans, texts, rare_terms (arrays), anchor.
    """
    words = F.size(F.regexp_extract_all("question", F.lit(r"([^ \t\n\x0B\f\r]+)")))
    shares = F.size(F.array_intersect(T.words(F.col("question")), F.col("rare_terms"))) > 0
    exact = F.coalesce(F.contains(F.lower("question"), F.lower("anchor")), F.lit(False))
    rule = F.when(F.col("type") == "exact_match", exact).otherwise(~shares)
    return records.withColumns({"span_verbatim": T.spans_verbatim(F.col("spans"), F.col("texts")), "lexical_rule": rule, "question_length": words.between(least_words, most_words)})


def board(ranked: DataFrame, expected: DataFrame, k: int, paper: Column, draws: int = 4000) -> dict[str, DataFrame]:
    """What is published: means with intervals, means by type, ranks and grades of each question. A question without a ranking raises."""
    lost = expected.select("question").distinct().join(ranked.select("question"), "question", "left_anti").limit(1).collect()
    if lost:
        raise ValueError(f"no ranking of question {lost[0]['question']!r}")
    each = E.scores(ranked, expected, k, paper)
    means = E.means(each)
    overall = means.filter("type = 'all'").join(E.bootstrap(each, "recall", draws).drop("mean"), "config")
    return {"board": overall, "by_type": means.filter("type <> 'all'"), "ranks": E.rank_of(ranked, expected), "grades": E.grades(ranked, expected, paper)}
