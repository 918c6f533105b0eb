"""Text quality by pairwise ranking: a Bradley-Terry model on what a text looks like, in any language."""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamstage.llm.common import chunks, cut, fresh, schema_of, texts

#: Labelled rows that a model is fitted on, at most: those with the lowest hash of their id.
SAMPLE = 20_000
#: Preference pairs for each labelled row of the rarer class.
PAIRS = 32
#: Score from which a text counts as good.
THRESHOLD = 0.7

FEATURES = [
    "symbols", "hashes", "pipes", "exclaims", "upper", "digits", "non_ascii", "spaces", "word_length", "short_words", "long_words", "glued_words",
    "lines", "sentence_ends", "repeated_lines", "distinct_words", "commas", "log_length",
]
_GLUED = re.compile(rb"[a-zA-Z\x80-\xff][.,;:]?[^\w\s\x80-\xff.,;:!?'\")\]-]{2,}")

_CLASS = np.zeros(256, np.uint8)  # 1 upper, 2 lower, 3 digit, 4 space, 5 line end, 6 other high byte, 7 mark
_CLASS[33:127] = 7
_CLASS[[*range(65, 91)]] = 1
_CLASS[[*range(97, 123)]] = 2
_CLASS[[*range(48, 58)]] = 3
_CLASS[[9, 32]] = 4
_CLASS[[10, 13]] = 5
_CLASS[128:] = 6


def features(text: str) -> list[float]:
    """FEATURES of one text, each within a few units of 0; all 0 for a text without words."""
    raw = text.encode("utf-8")
    words = raw.split()
    if not words:
        return [0.0] * len(FEATURES)
    n, w = len(raw), len(words)
    count = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=8)
    size = np.fromiter(map(len, words), np.int64, w)
    lines = [x for x in raw.split(b"\n") if x]
    letters = int(count[1] + count[2] + count[6])
    some = lambda chars: sum(raw.count(c) for c in chars) / n
    ends = some([b". ", b".\n"]) + raw.endswith(b".") / n
    return [
        10 * some([b"$", b"%", b"&", b"*", b"#", b"^", b"~", b"@"]),
        10 * some([b"#", b"<", b">", b"{", b"}"]),
        10 * some([b"|"]),
        10 * some([b"!"]),
        int(count[1]) / max(letters, 1),
        10 * int(count[3]) / n,
        int(count[6]) / n,
        5 * int(count[4] + count[5]) / n,
        math.log1p(float(size.mean())),
        float((size <= 3).mean()),
        float((size >= 9).mean()),
        len(_GLUED.findall(raw)) / w,
        10 * len(lines) / w,
        20 * ends,
        1 - len(set(lines)) / max(len(lines), 1),
        len(set(words)) / w,
        20 * some([b", "]),
        math.log(w) / 10,
    ]


class Model:
    """A linear score on the features, moved so that ``THRESHOLD`` stands at ``cut``, the ``quantile`` of training scores."""

    def __init__(self, weights: np.ndarray, cut: float, quantile: float):
        self.weights, self.cut, self.quantile = weights, cut, quantile

    def score(self, rows: list[list[float]]) -> np.ndarray:
        """0 to 1 for each row of features; added feature by feature, so that no row's score depends on others."""
        x = np.array(rows, np.float64).reshape(-1, len(FEATURES))
        raw = np.zeros(len(x))
        for i, w in enumerate(self.weights):
            raw += w * x[:, i]
        z = np.clip(raw - self.cut + math.log(THRESHOLD / (1 - THRESHOLD)), -30, 30)
        return 1 / (1 + np.exp(-z))


def preference_pairs(good: int, bad: int, per_row: int = PAIRS) -> tuple[np.ndarray, np.ndarray]:
    """Positions of (preferred, other) rows: each row of the rarer class meets ``per_row`` of the other, each row of
    the commoner class at least one; spread evenly, without chance."""
    total = max(good, bad, per_row * min(good, bad))
    i = np.arange(total)
    return i % good, (i // good * 7919 + i) % bad


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> Model:
    """Bradley-Terry: a pair's preferred text wins with probability sigmoid(score difference); Newton's method on the
    logistic loss of feature differences. The cut is a quantile of the training scores: that which parts the classes with
    the fewest mistakes (the middle one of equally good ones). With one class only, every text gets that class."""
    if not len(y) or y.min() == y.max():
        label = float(y[0]) if len(y) else 1.0
        return Model(np.zeros(x.shape[1] if x.ndim == 2 and len(x) else len(FEATURES)), -1.0 if label else 1.0, 1.0 - label)
    good, bad = x[y == 1], x[y == 0]
    a, b = preference_pairs(len(good), len(bad))
    d = good[a] - bad[b]
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        grad = d.T @ (1 - p) / len(d) - ridge * w
        hess = (d * (p * (1 - p))[:, None]).T @ d / len(d) + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    s = x @ w
    order = np.argsort(s, kind="stable")
    ranked, label = s[order], y[order]
    # Mistakes if the k lowest are taken as bad: good ones among them, bad ones above.
    mistakes = np.concatenate([[0], np.cumsum(label == 1)]) + (label == 0).sum() - np.concatenate([[0], np.cumsum(label == 0)])
    edges = np.concatenate([[True], ranked[1:] > ranked[:-1], [True]])
    best = np.where(edges, mistakes, len(y) + 1)
    ks = np.flatnonzero(best == best.min())
    k = int(ks[len(ks) // 2])
    low, high = ranked[max(k - 1, 0)], ranked[min(k, len(s) - 1)]
    quantile_cut = (low + high) / 2 if 0 < k < len(s) else (low - 1e-9 if k == 0 else high + 1e-9)
    return Model(w, float(quantile_cut), k / len(s))


def crc_remainder(id_col: str) -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model:
    """Fit on labelled rows of the training folds: ``sample`` rows at most, of the lowest hashes of their ids.

    A bound on the hash, by the number of rows, leaves about a tenth more than ``sample`` before they are ordered, so that
    what tasks send to the driver doesn't grow with their number. The ``sample`` labels left are sent to all tasks; only
    their texts are looked at, and no text is shuffled.
    """
    i, label, h = (fresh(docs, x) for x in ("__i", "__label", "__h"))
    known = labels.where(F.col(label_col).isin(0, 1) & (crc_remainder(id_col) != 2)).select(F.col(id_col).cast("long").alias(i), F.col(label_col).cast("int").alias(label), F.pmod(F.xxhash64(id_col), F.lit(1 << 40)).alias(h))
    n = known.count()
    low = known.where(F.col(h) < int(min(1.0, 1.1 * sample / max(n, 1)) * (1 << 40))).orderBy(h, i, label).limit(sample)
    rows = docs.join(F.broadcast(cut(low)), F.col(id_col).cast("long") == F.col(i)).select(F.struct(h, i, label).alias("k"), F.col(text_col).cast("string").alias("t"))

    def compute(batches):
        for batch in chunks(batches, "t"):
            yield pa.RecordBatch.from_arrays([*batch.column(0).flatten(), pa.array([features(x) for x in texts(batch, "t")], pa.list_(pa.float64()))], schema=schema_of("h long, i long, label int, features array<double>"))

    found = rows.mapInArrow(compute, "h long, i long, label int, features array<double>").orderBy("h", "i", "label", "features").limit(sample).collect()
    return fit(np.array([r["features"] for r in found]).reshape(-1, len(FEATURES)), np.array([r["label"] for r in found]))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id, held_out, score, predicted. Labels are read from the training folds only (rows of which
    the crc32 of the id as text leaves not 2 by 4); a null id is not held out. Null texts count as empty and get a score
    like any other; without labels every text is taken as good. Rows that repeat get the same; nothing is shuffled."""
    model = train(docs, labels, id_col=id_col, text_col=text_col)

    def compute(batches):
        for batch in chunks(batches, "__text"):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score([features(x) for x in texts(batch, "__text")]))], schema=schema_of("id long, score double"))

    rows = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("string").alias("__text"))
    scored = rows.mapInArrow(compute, "id long, score double").withColumnRenamed("id", id_col)
    return scored.select(id_col, F.coalesce(crc_remainder(id_col) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that count as good, all columns as they were. Each row's own text decides, whatever other
    rows share its id; only texts go to Python and only the decisions come back, and nothing is joined."""
    model = train(docs, labels, id_col=id_col, text_col=text_col)

    @F.arrow_udf("boolean")
    def good(column: pa.Array) -> pa.Array:
        found = [pa.array(model.score([features(x) for x in texts(part, "t")]) >= THRESHOLD) for part in chunks([pa.RecordBatch.from_arrays([column], names=["t"])], "t")]
        return pa.concat_arrays(found) if found else pa.array([], pa.bool_())

    return docs.where(good(F.col(text_col).cast("string")))
