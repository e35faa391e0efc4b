"""Generated domain names: a transparent logistic score, and an n-gram network for those who train one."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oneway.functions.lexical import heuristic_label, label_features, model_label, ngram_buckets

# Weights of the logistic score.
WEIGHTS = {
    "bias": -2.6,
    "entropy": 1.4,
    "non_englishness": 3.8,
    "digit_ratio": 3.0,
    "cons_run": 0.4,
    "length": 0.2,
    "low_vowel": 1.0,
    "dict_words": 1.4,
}

#: Names that the n-gram network is trained on, at most: those of smallest hash, which the driver holds.
TRAINING_ROWS = 3000

PARTS = ["entropy", "non_englishness", "digit_ratio", "cons_run", "length", "low_vowel", "dict_words"]


def _driven(names: DataFrame) -> DataFrame:
    """Rows with label, features, and what each part adds to the score (c_...).

    Features are a generated row of one: a condition on the score would else be moved before them and hold a copy of each for each use of it."""
    rows = names.withColumn("label", heuristic_label(F.col("qname")))
    features = F.array(F.struct(*(v.alias(k) for k, v in label_features(F.col("label")).items())))
    rows = rows.withColumn("__features", features).select("*", F.inline_outer("__features")).drop("__features")
    gate = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("label_length") - 8) / 4.0))
    above = lambda x: F.greatest(F.lit(0.0), x)
    parts = [
        WEIGHTS["entropy"] * above(F.col("entropy") - 3.1), WEIGHTS["non_englishness"] * (1 - F.col("englishness")) * gate, WEIGHTS["digit_ratio"] * F.col("digit_ratio"),
        WEIGHTS["cons_run"] * above(F.col("max_cons_run") - 5.0) * gate, WEIGHTS["length"] * above(F.col("label_length") - 11.0), WEIGHTS["low_vowel"] * above(0.30 - F.col("vowel_ratio")) * gate,
        WEIGHTS["dict_words"] * F.when(F.col("dict_word_hits") >= 3, 1.0).otherwise(0.0),
    ]
    return rows.withColumns({f"c_{k}": v for k, v in zip(PARTS, parts)})


def contribution_rows(names: DataFrame, keep: list[str]) -> DataFrame:
    """One row per name and part that adds to its score: feature and share of the total."""
    rows = _driven(names).where("label_length >= 5").select(*keep, *(f"c_{k}" for k in PARTS))
    total = sum((F.col(f"c_{k}") for k in PARTS), F.lit(0.0))
    pairs = ", ".join(f"'{k}', c_{k}" for k in PARTS)
    rows = rows.withColumn("total", total).select(*keep, "total", F.expr(f"stack({len(PARTS)}, {pairs}) as (feature, part)"))
    return rows.where("part > 0").select(*keep, "feature", F.round(F.col("part") / F.col("total"), 3).alias("share"))


def score_names(names: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Rows with qname get label, features, prob, is_dga, family and the shares of what drives the score."""
    rows, parts = _driven(names), PARTS
    z = sum((F.col(f"c_{k}") for k in parts), F.lit(WEIGHTS["bias"]))  # from the bias on, as the definition adds: a score may lie right on the threshold
    prob = F.when(F.col("label_length") < 5, 0.0).otherwise(1 / (1 + F.exp(-z)))
    rows = rows.withColumn("raw", prob).withColumns({"prob": F.round("raw", 4), "is_dga": F.col("raw") >= threshold})
    language = (F.col("label_length") >= 5) & (F.col("dict_word_hits") >= 3) & (F.col("englishness") > 0.4)
    family = F.when(language, "dictionary").when(F.col("is_dga"), "arithmetic/hash").otherwise("benign")
    pairs = F.filter(F.array(*(F.struct((-F.col(f"c_{k}")).alias("w"), F.lit(k).alias("k")) for k in parts)), lambda p: p["w"] < 0)
    total = F.aggregate(pairs, F.lit(0.0), lambda s, p: s - p["w"])
    shares = F.map_from_entries(F.transform(F.array_sort(pairs), lambda p: F.struct(p["k"], F.round(-p["w"] / total, 3))))
    shares = F.when(F.col("label_length") >= 5, shares).otherwise(F.create_map().cast("map<string,double>"))
    return rows.withColumns({"family": family, "contributions": shares}).drop("raw", *(f"c_{k}" for k in parts))


@dataclass
class NgramNet:
    """One hidden layer over hashed n-grams and six label statistics."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    threshold: float
    dim: int = 16384

    def save(self, path: str) -> None:
        np.savez_compressed(path, w1=self.w1.astype(np.float16), b1=self.b1, w2=self.w2, b2=self.b2, threshold=self.threshold, dim=self.dim)

    @staticmethod
    def load(path: str) -> NgramNet | None:
        """The model, or None if there is none."""
        try:
            with np.load(path) as z:
                return NgramNet(z["w1"].astype(np.float32), z["b1"], z["w2"], float(z["b2"]), float(z["threshold"]), int(z["dim"]))
        except OSError:
            return None

    def hidden(self, buckets: list[np.ndarray], stats: np.ndarray) -> np.ndarray:
        """Repeated n-grams count as often as they occur."""
        size = np.array([len(b) for b in buckets])
        flat = np.concatenate([np.asarray(b, np.int64) for b in buckets]) if size.sum() else np.empty(0, np.int64)
        out = np.zeros((len(buckets), self.w1.shape[1]))
        np.add.at(out, np.repeat(np.arange(len(buckets)), size), self.w1[flat])
        return np.maximum(out + stats @ self.w1[self.dim :] + self.b1, 0)

    def prob(self, buckets: list[np.ndarray], stats: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.hidden(buckets, stats) @ self.w2 + self.b2, -60, 60)))


STATS = ["label_length", "entropy", "digit_ratio", "vowel_ratio", "max_cons_run", "englishness"]
_SCALE = np.array([1 / 32, 1 / 5, 1.0, 1.0, 1 / 10, 1.0])


def model_inputs(names: DataFrame, dim: int = 16384) -> DataFrame:
    """qname with its leftmost label, n-gram buckets and statistics, all by built-ins."""
    rows = names.withColumn("label", model_label(F.col("qname")))
    return rows.withColumns(label_features(F.col("label"))).withColumn("buckets", ngram_buckets(F.col("label"), dim))


def score_with_net(names: DataFrame, net: NgramNet) -> DataFrame:
    """Adds prob and is_dga; labels under 4 characters score 0.  The weights are broadcast once."""
    rows = model_inputs(names, net.dim)
    sent = names.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        net = sent.value
        for frame in batches:
            p = net.prob(list(frame["buckets"]), frame[STATS].to_numpy(float) * _SCALE) if len(frame) else np.empty(0)
            p = np.where(frame["label_length"] < 4, 0.0, p)
            yield pd.DataFrame({"qname": frame["qname"], "label": frame["label"], "prob": p, "is_dga": p >= net.threshold})

    return rows.select("qname", "label", "buckets", *STATS).mapInPandas(run, "qname string, label string, prob double, is_dga boolean")


def train_net(frame: pd.DataFrame, hidden: int = 16, epochs: int = 4, dim: int = 16384, rate: float = 0.5, seed: int = 7) -> NgramNet:
    """Mini-batch training on a bounded sample: a frame of buckets, STATS and y (0/1).  Inputs are presence."""
    rng = np.random.default_rng(seed)
    w1, b1 = rng.normal(0, 0.1, (dim + len(STATS), hidden)), np.zeros(hidden)
    w2, b2 = rng.normal(0, 0.1, hidden), 0.0
    buckets = [np.unique(np.asarray(b, np.int64)) for b in frame["buckets"]]
    stats, y = frame[STATS].to_numpy(float) * _SCALE, frame["y"].to_numpy(float)
    net = NgramNet(w1, b1, w2, b2, 0.5, dim)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), 512):
            pick = order[at : at + 512]
            rows = [buckets[i] for i in pick]
            h = net.hidden(rows, stats[pick])
            p = 1 / (1 + np.exp(-np.clip(h @ net.w2 + net.b2, -60, 60)))
            g = (p - y[pick]) / len(pick)
            gh = np.outer(g, net.w2) * (h > 0)
            net.w2 -= rate * (h.T @ g)
            net.b2 -= rate * g.sum()
            net.b1 -= rate * gh.sum(axis=0)
            net.w1[dim:] -= rate * (stats[pick].T @ gh)
            np.add.at(net.w1, np.concatenate(rows), -rate * np.repeat(gh, [len(r) for r in rows], axis=0))
    return net
