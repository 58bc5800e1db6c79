"""Text quality: which documents are no natural prose, by a learned rule list applied as a native CASE expression."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeflow.llm import labelled, rules
from gaugeflow.llm.textstats import SHARES, SIZES, blocks, common_words, statistics, text_statistics, word_hashes

ORDER, DEFAULT = ("table", "list", "junk"), "prose"
#: Size of the labelled sample the rules are fitted on.
SAMPLE = 8_000


def training_matrix(common: DataFrame, n: int = SAMPLE, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """(statistics, kinds) of the labelled documents; the statistics come from the same function as the corpus's."""
    words, dense = common_words(common)
    rows = common.where(F.col("word").isNotNull()).select("lang", "word").orderBy("lang", "word").collect()
    by_lang: dict[str, list[str]] = {}
    for r in rows:
        by_lang.setdefault(r["lang"], []).append(r["word"])
    docs = labelled.labelled_documents(n, seed, by_lang)
    texts = [t for _, t, _ in docs]
    spaced = word_hashes(words)
    x = np.concatenate([statistics(texts[a:b], spaced, dense) for a, b in blocks(texts)])
    return x[:, len(SIZES) :], np.array([k for _, _, k in docs], dtype=object)


@lru_cache(maxsize=8)
def _learned(key: tuple, seed: int) -> tuple[rules.Rule, ...]:
    x, y = np.frombuffer(key[0]).reshape(key[2]), np.array(key[1], dtype=object)
    return tuple(rules.induce_best(x, y, ORDER, DEFAULT, seed))


def learn_rules(common: DataFrame, n: int = SAMPLE, seed: int = 7) -> list[rules.Rule]:
    """The rule list, fitted on the bounded labelled sample; kept per process."""
    x, y = training_matrix(common, n)
    return list(_learned((np.ascontiguousarray(x).tobytes(), tuple(y), x.shape), seed))


def classify(stats: DataFrame, learned: list[rules.Rule]) -> DataFrame:
    """Add ``kind`` by the CASE expression of the rule list."""
    return stats.withColumn("kind", F.expr(rules.to_case(learned, SHARES, DEFAULT)))


def document_kinds(docs: DataFrame, common: DataFrame, n: int = SAMPLE) -> DataFrame:
    """The statistics of each document with its kind: 'prose', 'list', 'table' or 'junk'.

    Defined cases: NULL, empty and blank texts count as 'prose' (they are no case of anything).
    """
    learned = learn_rules(common, n)
    stats = text_statistics(docs, common)
    blank = F.col("n_lines") == 0
    return classify(stats, learned).withColumn("kind", F.when(blank, F.lit(DEFAULT)).otherwise(F.col("kind")))


def no_prose(kinds: DataFrame) -> DataFrame:
    """(doc_id, kind) of the documents that are no natural prose."""
    return kinds.where(F.col("kind") != DEFAULT).select("doc_id", "kind")
