"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics come from the text alone. Features are cut into quantile bins;
each tree is grown level by level from per-bin gradient sums and kept as a
complete binary tree in flat arrays, so that scoring a batch is a few numpy
gathers for each level. The labelled sample is the only bounded thing here
(``sample_rows``, drawn by a hash of the id); every document is scored whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from threadlake.llm.common import lean, uniform

CLASSES = [b"0123456789", bytes(range(65, 91)), bytes(range(97, 123)), b" ", b"\n", b".", b",", b"!?", b";:", b"'\"()-", b"#$%&*", b"@/\\_", b"<>{}[]|=+^~`", b"\t\r"]
KIND = np.full(256, len(CLASSES), "uint8")  # the last kind: bytes of characters beyond ASCII
for _k, _c in enumerate(CLASSES):
    KIND[list(_c)] = _k
NAMES = [
    *[f"share_{k}" for k in range(len(CLASSES) + 1)], "log_bytes", "log_words", "mean_word", "std_word", "unique_words", "top_word", "top5_words",
    "short_words", "long_words", "symbol_words", "words_a_stop", "lines", "unique_lines", "mean_line", "top_line", "capital_words", "single_use",
]
SYMBOL = frozenset(b"#$%&*@<>{}[]|=+^~`_\\")


def statistics(text: str | None) -> list[float]:
    """The features of one text; null and empty texts give the same."""
    raw = (text or "").encode("utf-8", "replace")
    n = max(1, len(raw))
    kinds = np.bincount(KIND[np.frombuffer(raw, "uint8")], minlength=len(CLASSES) + 1) / n
    words = raw.split()
    count = len(words)
    m = max(1, count)
    sizes = np.fromiter(map(len, words), "int32", count) if count else np.zeros(1, "int32")
    seen = Counter(words)
    top = sorted(seen.values())[:-6:-1] or [0]
    lines = [x for x in raw.split(b"\n") if x.strip()]
    rows = max(1, len(lines))
    marked = sum(c for w, c in seen.items() if w[-1] in SYMBOL or w[0] in SYMBOL)
    capital = sum(c for w, c in seen.items() if w[:1].isupper())
    return [
        *kinds, np.log1p(len(raw)), np.log1p(count), float(sizes.mean()), float(sizes.std()), len(seen) / m, top[0] / m, sum(top) / m,
        float((sizes <= 2).sum()) / m, float((sizes >= 13).sum()) / m, marked / m, m / (1 + raw.count(b".") + raw.count(b"!") + raw.count(b"?")),
        np.log1p(len(lines)), len(set(lines)) / rows, np.log1p(len(raw) / rows), max(Counter(lines).values(), default=0) / rows, capital / m,
        sum(1 for c in seen.values() if c == 1) / m,
    ]


class Trees:
    """A boosted ensemble: ``feature``, ``cut`` of the inner nodes and ``leaf``, each (trees, nodes)."""

    def __init__(self, base: float, feature: np.ndarray, cut: np.ndarray, leaf: np.ndarray):
        self.base, self.feature, self.cut, self.leaf = base, feature, cut, leaf

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1 for the rows of ``x``."""
        raw, rows = np.full(len(x), self.base), np.arange(len(x))
        inner = self.feature.shape[1] if len(self.feature) else 0
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            at = np.zeros(len(x), "int64")
            while len(x) and at[0] < inner:
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            raw += leaf[at - inner]
        return 1 / (1 + np.exp(-raw))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.1, bins: int = 64, ridge: float = 2.0, least: int = 10) -> Trees:
    """Boosted trees for the logistic loss. Without rows, or with one class, a constant."""
    share = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(share / (1 - share)))
    inner = 2**depth - 1
    none = Trees(base, np.zeros((0, inner), "int64"), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    if len(y) < 2 * least or y.min() == y.max():
        return none
    width = x.shape[1]
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    code = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)
    raw, out = np.full(len(y), base), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, p * (1 - p)
        feature, cut = np.zeros(inner, "int64"), np.full(inner, np.inf)
        at = np.zeros(len(y), "int64")
        for level in range(depth):
            first, nodes = 2**level - 1, 2**level
            key = at - first
            best, gain = np.zeros(nodes, "int64"), np.full(nodes, 1e-6)
            where = np.full(nodes, np.inf)
            for j in range(width):
                if not len(edges[j]):
                    continue
                slot = key * bins + code[:, j]
                sg, sh, sn = (np.bincount(slot, w, nodes * bins).reshape(nodes, bins).cumsum(1) for w in (g, h, None))
                tg, th, tn = sg[:, -1:], sh[:, -1:], sn[:, -1:]
                won = sg**2 / (sh + ridge) + (tg - sg) ** 2 / (th - sh + ridge) - tg**2 / (th + ridge)
                won[(sn < least) | (tn - sn < least)] = 0
                won = won[:, : len(edges[j])]
                k = won.argmax(1)
                top = won[np.arange(nodes), k]
                better = top > gain
                gain[better], best[better], where[better] = top[better], j, edges[j][k[better]]
            feature[first : first + nodes], cut[first : first + nodes] = best, where
            at = 2 * at + 1 + (x[np.arange(len(y)), best[key]] > where[key])
        slot = at - inner
        leaf = rate * np.bincount(slot, g, inner + 1) / (np.bincount(slot, h, inner + 1) + ridge)
        raw += leaf[slot]
        out.append((feature, cut, leaf))
    return Trees(base, *(np.stack(a) for a in zip(*out)))


def held_out(doc_id) -> F.Column:
    """Whether a document's label is never learned from: crc32 of the id as text, modulo 5, is 0."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = 20_000) -> Trees:
    """Fit on at most ``sample_rows`` labelled documents that are not held out.

    The sample is the labels with the smallest hash of the id. Null labels are
    left out; an id with several labels counts as 1 if any is, and one with
    several texts is one example, that of the least statistics.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).where(~held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("double").alias("y"))
    sample = known.orderBy(uniform("id", seed=3), "id").limit(sample_rows)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pa.array([statistics(t) for t in batch.column("text").to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("y"), rows], names=["id", "y", "x"])

    kind = dict(texts.dtypes)["id"]
    rows = texts.mapInArrow(lean(features), f"id {kind}, y double, x array<double>").groupBy("id", "y").agg(F.min("x").alias("x")).orderBy("id").collect()
    x = np.array([r.x for r in rows]).reshape(len(rows), len(NAMES))
    return fit(x, np.array([r.y for r in rows]))


def with_score(docs: DataFrame, model: Trees, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with the model's score of each whole text (an existing column of that name is replaced)."""
    kept = docs.drop(score_col)
    place = kept.columns.index(text_col)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [np.zeros((0, len(NAMES)))]
            for at in range(0, batch.num_rows, 256):  # so that few texts are Python objects at once
                parts.append(np.array([statistics(t) for t in batch.column(place).slice(at, 256).to_pylist()]))
            x = np.concatenate(parts)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(x))], names=[*batch.schema.names, score_col])

    return kept.mapInArrow(lean(scored), StructType([*kept.schema.fields, StructField(score_col, DoubleType())]))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """``id, held_out, score, predicted`` for every document, repeated rows included.

    Null and empty texts get the score of an empty text; an empty table gives an
    empty one. Only the id and the text are read, so other columns cannot clash,
    and labels, language, source and id never enter a score.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = with_score(rows, train(docs, labels, id_col, text_col))
    return out.select("id", held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
