"""Scorers: models that add score columns to a table.

A scorer takes an iterator of text series and gives data frames; it is built once per
worker process.  The trained default needs no download.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..session import bound_batches

Model = Callable[[pd.Series], pd.DataFrame]


def score_with(df: DataFrame, text: str, build: Callable[[], Model], schema: str, gate=None) -> DataFrame:
    """Adds struct ``score``.  ``build`` loads the model; rows outside ``gate`` are not scored."""
    bound_batches(df.sparkSession)

    @F.pandas_udf(schema)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = build()
        for texts in batches:
            wanted = texts.dropna()
            scored = model(wanted) if len(wanted) else None
            yield (pd.DataFrame(index=texts.index, columns=[f.split()[0] for f in schema.split(", ")])
                   if scored is None else scored.set_axis(wanted.index).reindex(texts.index))

    target = F.col(text) if gate is None else F.when(gate, F.col(text))
    return df.withColumn("score", run(target))


def _features(text: str, dimensions: int) -> list:
    return [
        RegexTokenizer(inputCol=text, outputCol="_words", pattern=r"\s+"),
        HashingTF(inputCol="_words", outputCol="_tf", numFeatures=dimensions),
        Normalizer(inputCol="_tf", outputCol="_features", p=2.0),
    ]


#: Length of a text vector; vectors of different versions are not comparable.
DIMENSIONS = 256
#: Words whose place a task remembers: some 20 MB.
_WORDS_KNOWN = 100_000


def _signed_slot(word: bytes, dimensions: int) -> int:
    """Place of a word in the vector, from 1 on, below zero for a word that counts negative."""
    digest = hashlib.md5(word, usedforsecurity=False).hexdigest()
    place = int(digest[:4], 16) % dimensions + 1
    return place if digest[4] < "8" else -place


def embed(df: DataFrame, text: str, dimensions: int = DIMENSIONS) -> DataFrame:
    """Adds ``embedding`` and ``embedding_version``: every distinct word of a text adds 1 or -1 at one place.

    Signed feature hashing needs no model and no pass over the corpus, so a text has the same
    vector wherever it is stored.  A null text has no vector, a text without words the zero vector.
    """
    bound_batches(df.sparkSession)

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        slots: dict[bytes, int] = {}
        for texts in batches:
            out: list[np.ndarray | None] = []
            for t in texts:
                if t is None:
                    out.append(None)
                    continue
                words = set(t.encode("utf-8", "surrogatepass").split())
                slots |= {w: _signed_slot(w, dimensions) for w in words if w not in slots}
                found = np.array([slots[w] for w in words], np.int64)
                out.append(np.bincount(np.abs(found), np.sign(found), dimensions + 1)[1:].astype(np.float32))
            if len(slots) > _WORDS_KNOWN:
                slots.clear()
            yield pd.Series(out, dtype=object)

    return df.withColumns({"embedding": run(F.col(text)), "embedding_version": F.lit(f"signed-md5-{dimensions}")})


def train(labelled: DataFrame, text: str = "prompt", label: str = "is_malicious",
          dimensions: int = 1 << 14) -> PipelineModel:
    stages = [*_features(text, dimensions),
              LogisticRegression(featuresCol="_features", labelCol=label, maxIter=20, regParam=0.01)]
    return Pipeline(stages=stages).fit(labelled)


def apply(model: PipelineModel, prompts: DataFrame) -> DataFrame:
    """Adds ``clf_label`` and ``clf_score`` (the probability of that label)."""
    p = vector_to_array("probability")[1]
    out = model.transform(prompts).withColumn("_p", p)
    return out.withColumns({
        "clf_label": F.when(F.col("_p") > 0.5, fixed.CLASSIFIER_LABEL).otherwise("SAFE"),
        "clf_score": F.greatest("_p", 1 - F.col("_p")),
    }).drop("_words", "_tf", "_features", "rawPrediction", "probability", "prediction", "_p")
