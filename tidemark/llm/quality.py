"""Quality scores from compression with two dictionaries.

One zstandard dictionary is trained on text labelled good, one on text labelled bad.
Text compresses better with the dictionary of its own kind, so the difference of the
two compressed sizes, divided by the text's size, tells which kind it is like; a
logistic curve fitted on other labelled texts turns it into a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.sampling import bounded_sample, held_out, learnable

BLOCK = 2048
LEVEL = 3


def blocks_of(text: str | None) -> list[bytes]:
    """The whole text in UTF-8, in pieces of ``BLOCK`` bytes."""
    data = text.encode("utf-8", "surrogatepass") if text else b""
    return [data[at : at + BLOCK] for at in range(0, len(data), BLOCK)]


@dataclass
class QualityModel:
    """Two dictionaries and the weights of ``1, difference, share of the better size``."""

    good: bytes
    bad: bytes
    weights: tuple[float, ...]

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    """The model with its dictionaries loaded; lives in one process."""

    def __init__(self, model: QualityModel):
        self.weights = np.array(model.weights)
        self.pair = [zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d), level=LEVEL, write_content_size=False, write_dict_id=False) if d else None for d in (model.good, model.bad)]

    def features(self, blocks: list[bytes]) -> np.ndarray:
        size = sum(map(len, blocks))
        if not size or None in self.pair:
            return np.array([1.0, 0.0, 0.0])
        good, bad = (sum(len(c.compress(b)) for b in blocks) for c in self.pair)
        return np.array([1.0, 10 * (bad - good) / size, min(good, bad) / size])

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.features(blocks_of(text)) @ self.weights, -30, 30))))


def _logistic(x: np.ndarray, y: np.ndarray, prior: float, ridge: float = 1e-3) -> np.ndarray:
    """Weights of a logistic regression by Newton's method; classes weigh as in the corpus."""
    weigh = np.where(y > 0, prior / max(y.mean(), 1e-9), (1 - prior) / max(1 - y.mean(), 1e-9))
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weigh * (p - y)) + ridge * w
        hess = (x.T * (weigh * p * (1 - p))) @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = 1500, blocks_a_text: int = 12, dictionary_bytes: int = 1 << 16) -> QualityModel:
    """Learn from ``per_class`` labelled documents of each class at most, ``blocks_a_text`` pieces of each.

    Documents are chosen by a hash of their id, pieces evenly over the whole text; what
    reaches the driver is bounded by those two numbers.  Three fifths of the documents
    make the dictionaries, the others the calibration.  Only documents with an id that
    is not held out are used, one text of each (the least, where rows repeat an id).  Several labels of a document are averaged (0.5 counts as
    good); null labels are ignored.  If a class is missing, every text gets the share
    of good labels (0.5 without labels).
    """
    known = labels.where(learnable(id_col) & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.avg(label_col).alias("q")).select("id", (F.col("q") >= 0.5).alias("good"))
    tally = known.agg(F.avg(F.col("good").cast("double"))).first()[0]
    prior = 0.5 if tally is None else float(tally)
    chosen = bounded_sample(known, "good", "id", per_class, 2)
    # bounded by per_class, so it may be broadcast
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null and text <> ''").join(F.broadcast(chosen), "id").groupBy("id", "good").agg(F.min("text").alias("text"))

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cut = []
            for text in batch["text"]:
                b = blocks_of(text)
                cut.append([b[i] for i in np.unique(np.linspace(0, len(b) - 1, min(len(b), blocks_a_text)).astype(int))])
            yield pd.DataFrame({"id": batch["id"], "good": batch["good"], "blocks": cut})

    got = rows.mapInPandas(pieces, "id long, good boolean, blocks array<binary>").collect()
    got = sorted((r["id"], r["good"], [bytes(b) for b in r["blocks"]]) for r in got)
    sides = {kind: [r for r in got if r[1] == kind] for kind in (True, False)}
    if min(map(len, sides.values())) < 5:
        return QualityModel(b"", b"", (float(np.log((prior + 1e-3) / (1 - prior + 1e-3))), 0.0, 0.0))
    made, rest = {}, []
    for kind, side in sides.items():
        used = [r for i, r in enumerate(side) if i % 5 < 3]
        rest += [r for i, r in enumerate(side) if i % 5 >= 3]
        made[kind] = _dictionary([b for r in used for b in r[2]], dictionary_bytes)
    scorer = Scorer(QualityModel(made[True], made[False], (0.0, 0.0, 0.0)))
    x, y = np.stack([scorer.features(r[2]) for r in rest]), np.array([float(r[1]) for r in rest])
    return QualityModel(made[True], made[False], tuple(map(float, _logistic(x, y, prior))))


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary; of very little text, the text itself."""
    try:
        return zstandard.train_dictionary(min(size, max(1024, sum(map(len, samples)) // 4)), samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


def score_quality(docs: DataFrame, model: QualityModel, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with a score between 0 and 1 under ``name`` (replaces a column of that name).

    Only the text is looked at, the whole of it.  Null and empty texts have no
    difference and get the score of the curve there.  Equal texts get equal scores.
    """

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = model.scorer()
        for texts in batches:
            yield pd.Series([scorer.score(t) for t in texts], dtype="float64")

    return docs.withColumn(name, score(F.col(text_col).cast("string")))


def quality_report(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", threshold: float = 0.3, per_class: int = 1500) -> DataFrame:
    """``id_col, held_out, score, predicted`` for every row of ``docs``."""
    model = fit_quality(docs, labels, id_col=id_col, per_class=per_class)
    found = score_quality(docs.select(F.col(id_col), F.col("text")), model)
    return found.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
