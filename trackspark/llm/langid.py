"""Language identification of operator notes.

The record is a verdict: `event_id` and the operator's `notes`. The project records no language, so the label
column `lang` of the training rows is the caller's.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash60, short_batches, sparing

#: n-grams are hashed to so many bits of a feature.
FEATURE_BITS = 16
FEATURES = 1 << FEATURE_BITS
ORDERS = (1, 2, 3)
#: The classifier is fitted on at most twice so many labelled rows, shared evenly by the languages.
SAMPLE_ROWS = 6000
UNDETERMINED = "und"


@functools.lru_cache(maxsize=1)
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def grams(text: str) -> np.ndarray | None:
    """Features of all 1- to 3-grams of the lower-cased text, where each run of other characters is one blank; None without a letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32)
    letter = _is_letter()[codes]
    if not letter.any():
        return None
    codes = np.where(letter, codes, 32)
    keep = np.ones(len(codes), bool)
    keep[1:] = letter[1:] | letter[:-1]
    codes = np.concatenate(([32], codes[keep], [32])).astype(np.uint64)
    mixed, out = np.zeros(len(codes), np.uint64), []
    for n in ORDERS:
        # A running mix of n characters; its upper bits are the feature.
        mixed = (mixed[: len(codes) - n + 1] + codes[n - 1 :] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        out.append((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - FEATURE_BITS))
    return np.concatenate(out).astype(np.int64)


def counted(features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features and how often each occurs."""
    if len(features) < FEATURES // 8:
        return np.unique(features, return_counts=True)
    counts = np.bincount(features, minlength=FEATURES)
    index = np.flatnonzero(counts)
    return index, counts[index]


def tf_idf(features: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    index, counts = counted(features)
    values = (1 + np.log(counts)) * idf[index]
    return index, values / max(np.sqrt((values**2).sum()), 1e-12)


@dataclass
class LanguageModel:
    """Languages in order, weights (language x feature), biases, inverse document frequencies, and the temperature."""

    languages: list[str]
    weights: np.ndarray
    biases: np.ndarray
    idf: np.ndarray
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        features = grams(text) if text and self.languages else None
        if features is None:
            return UNDETERMINED, 0.0
        index, values = tf_idf(features, self.idf)
        p = softmax((self.weights[:, index] @ values + self.biases) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def follow_the_leader(rows: list[tuple[int, np.ndarray, np.ndarray]], n_languages: int, alpha=0.5, beta=1.0, l1=0.05, l2=0.1, epochs=3) -> tuple[np.ndarray, np.ndarray]:
    """Multinomial logistic regression by follow-the-regularised-leader with elastic-net penalties.

    rows: (class, feature indexes, values). A weight is zero while its accumulated gradient is within `l1`, and
    shrunk by `l2` otherwise. The bias has index FEATURES and no penalty of its own.
    """
    z, n = np.zeros((n_languages, FEATURES + 1)), np.zeros((n_languages, FEATURES + 1))

    def weights(zi, ni, penalty):
        shrunk = np.sign(zi) * np.maximum(np.abs(zi) - penalty, 0)
        return -shrunk / ((beta + np.sqrt(ni)) / alpha + l2)

    for _ in range(epochs):
        for label, index, values in rows:
            index, values = np.append(index, FEATURES), np.append(values, 1.0)
            zi, ni = z[:, index], n[:, index]
            w = weights(zi, ni, l1 * (index < FEATURES))
            g = softmax(w @ values)
            g[label] -= 1
            g = g[:, None] * values
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha
            z[:, index] = zi + g - sigma * w
            n[:, index] = ni + g * g
    w = weights(z, n, l1 * (np.arange(FEATURES + 1) < FEATURES))
    return w[:, :-1], w[:, -1]


def calibrated(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss, by golden-section search over its logarithm.

    As in Platt's scaling, a label counts as right by (n + 1) / (n + 2) only, so that n rows without an error do not ask for
    certainty.
    """
    if not len(labels) or logits.shape[1] < 2:
        return 1.0
    doubt = 1 / (len(labels) + 2)

    def loss(t: float) -> float:
        p = np.log(np.maximum(softmax(logits / np.exp(t)), 1e-300))
        right = p[np.arange(len(labels)), labels]
        return -((1 - doubt) * right + doubt * (p.sum(axis=1) - right) / (p.shape[1] - 1)).mean()

    low, high, ratio = -3.0, 3.0, (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def document_frequencies(verdicts: DataFrame) -> tuple[np.ndarray, int]:
    """In how many notes each feature occurs, over all rows, and the number of rows with a letter.

    Each task adds up its rows; the result has a fixed number of features.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, rows = np.zeros(FEATURES, np.int64), 0
        for batch in batches:
            for text in batch["notes"].dropna():
                features = grams(text)
                if features is not None:
                    seen[counted(features)[0]] += 1
                    rows += 1
        index = np.flatnonzero(seen)
        yield pd.DataFrame({"feature": np.append(index, -1), "n": np.append(seen[index], rows)})

    found = verdicts.select("notes").mapInPandas(sparing(run), "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(FEATURES, np.int64)
    real = found[found["feature"] >= 0]
    out[real["feature"]] = real["n"]
    return out, int(found.loc[found["feature"] < 0, "n"].sum())


def train(verdicts: DataFrame, sample_rows: int = SAMPLE_ROWS) -> LanguageModel:
    """Learn languages from labelled notes.

    Input: event_id (any type), notes (text), lang (text); rows with a null lang or notes teach nothing. Document frequencies
    cover all labelled rows. The weights are fitted on a sample of about `sample_rows` rows (never more than twice that):
    by the hash of the row, as many of each language as there are, up to an even share. A fifth of the sample, not fitted
    on, sets the temperature. No labelled row gives a model without languages, which predicts `und`.
    """
    short_batches(verdicts.sparkSession)
    rows = verdicts.select("event_id", F.col("notes").cast("string").alias("notes"), F.col("lang").cast("string").alias("lang")).filter("lang IS NOT NULL AND notes IS NOT NULL")
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    sizes = {r["lang"]: r["n"] for r in counts.collect()}
    languages = sorted(sizes)
    if not languages:
        return LanguageModel([], np.zeros((0, FEATURES)), np.zeros(0), np.ones(FEATURES), 1.0)
    seen, total = document_frequencies(rows)
    idf = np.log((1 + total) / (1 + seen)) + 1
    share = max(20, sample_rows // len(languages))
    order = hash60(F.concat_ws("\0", F.col("event_id").cast("string"), "notes"))
    chance = F.create_map(*[x for lang in languages for x in (F.lit(lang), F.lit(int(min(1.0, share / sizes[lang]) * (1 << 60))))])
    sample = rows.withColumn("h", order).filter(F.col("h") < chance[F.col("lang")]).orderBy("h").limit(2 * max(sample_rows, share * len(languages)))
    place = {lang: i for i, lang in enumerate(languages)}

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(h, place[lang], *tf_idf(f, idf)) for h, lang, text in batch[["h", "lang", "notes"]].itertuples(index=False, name=None) if (f := grams(text)) is not None]
            yield pd.DataFrame(out, columns=["h", "label", "index", "weight"])

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "label"])
        # By position, not by hash: a sample of one row is fitted on.
        apart = np.arange(len(pdf)) % 5 == 4
        data = [(label, np.asarray(i), np.asarray(v)) for label, i, v in pdf[["label", "index", "weight"]].itertuples(index=False, name=None)]
        weights, biases = follow_the_leader([r for r, a in zip(data, apart) if not a], len(languages))
        held = [r for r, a in zip(data, apart) if a]
        logits = np.array([weights[:, i] @ v + biases for _, i, v in held]).reshape(-1, len(languages))
        temperature = calibrated(logits, np.array([r[0] for r in held], dtype=int))
        at = np.nonzero(weights)
        first = pd.DataFrame({"label": [-1], "feature": [0], "weight": [temperature]})
        return pd.concat([first, pd.DataFrame({"label": np.arange(len(languages)), "feature": FEATURES, "weight": biases}), pd.DataFrame({"label": at[0], "feature": at[1], "weight": weights[at]})])

    model = sample.mapInPandas(sparing(features), "h long, label long, index array<long>, weight array<double>").groupBy().applyInPandas(fit, "label long, feature long, weight double").toPandas()
    weights = np.zeros((len(languages), FEATURES + 1))
    real = model[model["label"] >= 0]
    weights[real["label"], real["feature"]] = real["weight"]
    temperature = model.loc[model["label"] < 0, "weight"]
    return LanguageModel(languages, weights[:, :-1].astype(np.float32), weights[:, -1], idf, float(temperature.iloc[0]) if len(temperature) else 1.0)


def predict_languages(verdicts: DataFrame, model: LanguageModel) -> DataFrame:
    """All columns of `verdicts`, of which only `notes` is used, and lang_pred, score, which replace columns of these names.

    lang_pred is a learned language, or `und` with score 0 where notes are null or have no letter. score is the calibrated
    probability. The model (languages x 65,536 weights) goes to the tasks; rows are independent, and every whole text is read.
    """
    @F.pandas_udf("lang_pred string, score double")
    def guess(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([model.predict(t) for t in texts], columns=["lang_pred", "score"])

    kept = [F.col(f"`{c}`") for c in verdicts.columns if c not in ("lang_pred", "score")]
    rows = verdicts.select(*kept, guess(F.col("notes").cast("string")).alias("_guessed_language"))
    return rows.select("*", "_guessed_language.lang_pred", "_guessed_language.score").drop("_guessed_language")


def fold(event_id: Column) -> Column:
    """CRC-32 of the id as text, modulo 4; null for a null id."""
    return F.crc32(event_id.cast("string").cast("binary")) % 4
