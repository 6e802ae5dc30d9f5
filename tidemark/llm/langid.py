"""Language identification by hierarchical discrimination.

A first set of linear support vector machines, one for each pair of language
families, picks the family; a second set, one for each pair of languages of that
family, tells closely related languages apart.  Features are the text's character
n-grams of one to three letters, hashed into a fixed number of dimensions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.hashing import pieces
from tidemark.llm.sampling import bounded_sample, held_out, learnable
from tidemark.llm.storage import spare

UNKNOWN = "und"
DIMENSIONS = 1 << 13
CHUNK = 1 << 18

# Languages of each family (ISO 639-1).  A language that is in no list
# is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz",
    "semitic": "ar he mt am",
    "indic": "hi bn mr ne pa gu ur",
    "celtic": "ga gd cy br",
}


def family_of(lang: str) -> str:
    return next((name for name, langs in FAMILIES.items() if lang in langs.split()), lang)


def ngram_features(text: str | None, dimensions: int = DIMENSIONS) -> np.ndarray | None:
    """Unit vector of the text's letter n-grams, the whole text's; none without a letter.

    The text is lower-cased; every run of other characters is one space, which
    counts as a letter within n-grams of two and three.
    """
    if not text:
        return None
    counts = np.zeros(dimensions)
    seen = False
    mask = np.uint64(dimensions - 1)
    before = " "  # the end of what was read; n-grams go on over it
    for piece in pieces(text, CHUNK):
        piece = piece.lower()
        words = "".join(c if c.isalpha() else " " for c in piece) if not piece.isascii() else piece.translate(_ASCII)
        words = " ".join(words.split())
        if not words:
            continue
        seen = True
        codes = np.frombuffer(f"{before}{words} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        new = len(before)
        before = f"{before}{words} "[-2:]
        one, two, three = codes[new:], codes[new - 1 : -1] * np.uint64(0x10001) + codes[new:], codes[:-2] * np.uint64(0x1000193) + codes[1:-1] * np.uint64(0x10001) + codes[2:]
        for size, grams in enumerate((one[one != 32], two, three)):
            h = (grams + np.uint64(size + 1)) * np.uint64(0x9E3779B97F4A7C15)
            counts += np.bincount(((h >> np.uint64(40)) & mask).astype(np.int64), minlength=dimensions)
    if not seen:
        return None
    counts = np.sqrt(counts)
    return counts / np.sqrt(counts @ counts)


_ASCII = {i: (chr(i) if chr(i).isalpha() else " ") for i in range(128)}


def train_svm(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, dimensions: int = DIMENSIONS, cost: float = 1.0, epochs: int = 20) -> np.ndarray:
    """Weights and bias of a linear SVM (hinge loss) by dual coordinate descent (Hsieh et al. 2008).

    A row is the places of its features that are not 0, and their values; nothing of
    the size of rows times dimensions is ever made.
    """
    norms, alpha, w = np.array([v @ v + 1 for _, v in rows]), np.zeros(len(rows)), np.zeros(dimensions + 1)
    order = np.random.default_rng(1)
    # classes of unlike size weigh alike
    upper = np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum()))) * cost * 10
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(rows)):
            at, values = rows[i]
            old = alpha[i]
            alpha[i] = min(max(old - (y[i] * (w[at] @ values + w[-1]) - 1) / norms[i], 0.0), upper[i])
            if alpha[i] != old:
                w[at] += (alpha[i] - old) * y[i] * values
                w[-1] += (alpha[i] - old) * y[i]
                moved = max(moved, abs(alpha[i] - old))
        if moved < 1e-3:
            break
    return w


@dataclass
class LanguageModel:
    """Pairwise machines between families, and between the languages of each."""

    families: dict[str, list[str]]
    machines: dict[tuple[str, str], np.ndarray]
    sharpness: float = 3.0

    def _choose(self, x: np.ndarray, names: list[str]) -> tuple[str, float]:
        """The name with most pairwise wins (ties: the larger margins, then the first name), and its confidence."""
        if len(names) == 1:
            return names[0], 1.0
        wins, sums, sure = dict.fromkeys(names, 0), dict.fromkeys(names, 0.0), {n: 1.0 for n in names}
        for a, b in combinations(names, 2):
            w = self.machines[a, b]
            m = float(w[:-1] @ x + w[-1])
            p = 1 / (1 + np.exp(-self.sharpness * m))
            wins[a if m >= 0 else b] += 1
            sums[a] += m
            sums[b] -= m
            sure[a], sure[b] = min(sure[a], p), min(sure[b], 1 - p)
        best = min(names, key=lambda n: (-wins[n], -sums[n], n))
        return best, sure[best]

    def predict(self, text: str | None) -> tuple[str, float]:
        x = ngram_features(text) if self.families else None
        if x is None:
            return UNKNOWN, 0.0
        family, p = self._choose(x, sorted(self.families))
        lang, q = self._choose(x, self.families[family])
        return lang, float(min(max(p * q, 0.0), 1.0))


def fit_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", per_language: int = 400, max_languages: int = 100) -> LanguageModel:
    """Learn from ``per_language`` documents of each language at most, chosen by a hash.

    Uses documents with an id that is not held out, a label other than ``und`` and a
    letter in the text; rows that repeat an id and label count once, the least text.  Features are computed on the executors; what reaches the
    driver is bounded by ``per_language`` and the number of languages.  More languages
    than ``max_languages`` are a ``ValueError``: a pair of them is a machine.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(label_col).cast("string").alias("label"))
    rows = rows.where(learnable("id") & F.col("label").isNotNull() & (F.col("label") != UNKNOWN) & F.col("text").isNotNull())

    def featurize(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            vectors = [ngram_features(t) for t in batch["text"]]
            keep = [i for i, v in enumerate(vectors) if v is not None]
            places = [np.flatnonzero(vectors[i]) for i in keep]
            yield pd.DataFrame({"label": [batch["label"].iloc[i] for i in keep], "at": [p.astype(np.int32).tobytes() for p in places], "x": [vectors[i][p].astype(np.float32).tobytes() for i, p in zip(keep, places, strict=True)]})

    got = bounded_sample(rows, "label", "id", per_language, max_languages).mapInPandas(featurize, "label string, at binary, x binary").collect()
    if not got:
        return LanguageModel({}, {})
    got = sorted((r["label"], bytes(r["at"]), bytes(r["x"])) for r in got)
    labels = np.array([g[0] for g in got])
    x = [(np.frombuffer(at, np.int32), np.frombuffer(v, np.float32).astype(np.float64)) for _, at, v in got]
    families: dict[str, list[str]] = {}
    for lang in sorted(set(labels.tolist())):
        families.setdefault(family_of(lang), []).append(lang)
    of = np.array([family_of(v) for v in labels])
    machines = {(a, b): _pair(x, of, a, b) for a, b in combinations(sorted(families), 2)}
    for langs in families.values():
        machines |= {(a, b): _pair(x, labels, a, b) for a, b in combinations(langs, 2)}
    return LanguageModel(families, machines)


def _pair(x: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, a: str, b: str) -> np.ndarray:
    rows = np.flatnonzero((labels == a) | (labels == b))
    return train_svm([x[i] for i in rows], np.where(labels[rows] == a, 1.0, -1.0))


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with the language and score of each text under ``names``; columns that have these names are replaced.

    Only the text is looked at.  A null text, or one without a letter, is ``und`` with
    score 0, as is every text if nothing could be learned.  Equal texts get equal
    results.  Whole texts count, however long.
    """

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([model.predict(t) for t in texts], columns=["lang_pred", "score"])

    (found,) = spare([*docs.columns, *names], "__found")
    given = docs.withColumn(found, predict(F.col(text_col).cast("string")))
    return given.withColumns({names[0]: F.col(f"{found}.lang_pred"), names[1]: F.col(f"{found}.score")}).drop(found)


def language_report(docs: DataFrame, id_col: str = "doc_id", per_language: int = 400) -> DataFrame:
    """``id_col, held_out, lang_pred, score`` for every row; learned from rows that aren't held out."""
    model = fit_languages(docs, id_col=id_col, per_language=per_language)
    found = identify(docs.select(F.col(id_col), F.col("text")), model)
    return found.select(id_col, held_out(id_col).alias("held_out"), "lang_pred", "score")
