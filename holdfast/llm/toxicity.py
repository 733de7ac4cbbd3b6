"""Toxicity by weak supervision.

Voters come from a lexicon mined over all labelled training rows (words and word beginnings that toxic texts
hold and others don't), from a fixed seed lexicon and from patterns. A generative label model estimates how often
each voter fires on toxic and on other texts, discounts voters that repeat each other beyond what the label
explains, and gives every training text a posterior. A linear classifier on term features is trained on the
posteriors; it alone scores.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import Scratch, broadcast_if_small, forget, give_back, slices, small_batches

FIT_ROWS = 20_000  #: labelled rows the label model and the classifier are fitted on, about; mining reads all
BROADCAST_LABELS = 2_000_000  #: label rows (12 bytes each) that may be broadcast
FAMILIES = 40
PREFIX = 5
MAX_TERMS = 1_500
MIN_TOXIC = 4  #: toxic training texts that hold a term at least
MIN_PRECISION = 0.6
FLUSH = 200_000

#: Fixed seed lexicon, general insults.
SEED_WORDS = ["clown", "disgusting", "dumb", "fool", "garbage", "idiot", "jerk", "loser", "moron", "pathetic", "scum", "stupid", "trash", "worthless"]

_WORD = re.compile(r"[^\W\d_]+")


def terms_of(text: str) -> dict[str, int]:
    """Words of the whole text and, marked ``^``, beginnings of the longer ones, with their counts."""
    counts: dict[str, int] = defaultdict(int)
    for w in _WORD.findall(text.lower()):
        counts[w] += 1
    for w in [w for w in counts if len(w) > PREFIX]:
        counts["^" + w[:PREFIX]] += counts[w]
    return counts


def _mined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forget()
    held: dict[str, list[int]] = {}

    def flush():
        rows = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), *(pa.array([v[i] for v in held.values()], pa.int64()) for i in (0, 1))], names=["term", "neg", "pos"])
        held.clear()
        return rows

    for batch in batches:
        for part in slices(batch, batch.column(0)):
            for text, toxic in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                for t in terms_of(text or ""):
                    held.setdefault(t, [0, 0])[toxic] += 1
                if len(held) > FLUSH:
                    yield flush()
    yield flush()
    give_back()


@dataclass
class Model:
    weights: dict[str, float]
    bias: float
    families: list[str] = field(default_factory=list)
    accuracies: np.ndarray | None = None  #: of each voter: P(fires | other), P(fires | toxic)
    correlations: np.ndarray | None = None  #: of voters given the label
    discounts: np.ndarray | None = None

    def score(self, text: str | None) -> float:
        counts = terms_of(text or "")
        z = self.bias + sum(self.weights[t] * min(counts[t], 3) for t in counts.keys() & self.weights.keys())
        return float(1 / (1 + np.exp(-min(max(z, -30.0), 30.0))))


def votes(text: str, lexicon: set[str], families: list[str]) -> tuple[list[int], dict[str, int]]:
    """What each voter says of a text (1: fires), and its lexicon terms with counts."""
    counts = terms_of(text)
    held = {t: counts[t] for t in counts.keys() & lexicon}
    begun = {t.lstrip("^")[:4] for t in held}
    words = [t for t in held if t[0] != "^"]
    letters = sum(c.isalpha() for c in text) or 1
    patterns = [
        any(w in counts for w in SEED_WORDS),
        len(words) >= 2,
        sum(held[w] for w in words) >= 3,
        sum(held[w] for w in words) * 50 >= sum(counts.values()),
        not held,
        text.count("!") * 10 >= letters // 5 and sum(c.isupper() for c in text) * 2 > letters,
    ]
    return [int(f in begun) for f in families] + [int(p) for p in patterns], held


def label_model(fired: np.ndarray, start: np.ndarray, rounds: int = 25):
    """fired: texts x voters (0/1); start: a first guess of P(toxic). Returns posteriors and what was estimated.

    Expectation maximisation of a two-class model. After each round, the voters' residuals given the posterior are
    correlated; a voter counts 1 / (1 + the sum of its positive correlations with others), so that voters that
    repeat one another share one say.
    """
    p = start.astype(float)
    for _ in range(rounds):
        n1, n0 = p.sum(), (1 - p).sum()
        on = (fired.T @ p + 0.1) / (n1 + 1)
        off = (fired.T @ (1 - p) + 0.01) / (n0 + 1)
        rest = fired - (p[:, None] * on + (1 - p)[:, None] * off)
        size = np.sqrt((rest * rest).sum(0)) + 1e-9
        together = (rest.T @ rest) / np.outer(size, size)
        discount = 1 / (1 + np.maximum(together - np.eye(len(together)), 0).sum(0))
        prior = np.clip(n1 / len(p), 1e-3, 1 - 1e-3)
        on, off = np.clip(on, 1e-4, 1 - 1e-4), np.clip(off, 1e-4, 1 - 1e-4)
        z = np.log(prior / (1 - prior)) + fired @ (discount * np.log(on / off)) + (1 - fired) @ (discount * np.log((1 - on) / (1 - off)))
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    return p, np.stack((off, on)), together, discount


def _fit_linear(rows: list[dict[str, int]], target: np.ndarray, names: list[str], steps: int = 400) -> tuple[dict[str, float], float]:
    at = {t: i for i, t in enumerate(names)}
    owner = np.concatenate([np.full(len(r), i) for i, r in enumerate(rows)] or [np.zeros(0)]).astype(int)
    column = np.array([at[t] for r in rows for t in r], int)
    value = np.array([min(c, 3) for r in rows for c in r.values()], float)
    w, b, n = np.zeros(len(names)), -3.0, max(len(rows), 1)
    m, v = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    for t in range(1, steps + 1):
        z = b + np.bincount(owner, value * w[column], minlength=len(rows)) if len(rows) else np.zeros(0)
        d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) / n
        g = np.append(np.bincount(column, value * d[owner], minlength=len(names)) + 1e-6 * w, d.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-10)
        w, b = w - step[:-1], b - step[-1]
    return {t: float(w[i]) for t, i in at.items() if w[i] > 0}, float(b)


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """docs: doc_id, text; labels: doc_id, toxic (0/1; null is no label; of two the higher counts).

    The lexicon is mined over all labelled rows; the fit reads about FIT_ROWS of them, chosen by a hash. Without
    labelled rows the model knows only the seed lexicon.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "toxicity")
    known = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    known = scratch.save(known, "labels")
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(broadcast_if_small(known, BROADCAST_LABELS), "doc_id")

    mined = texts.select("text", "toxic").mapInArrow(_mined, "term string, neg long, pos long")
    mined = mined.groupBy("term").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))
    sure = F.col("pos") / (F.col("pos") + F.col("neg"))
    mined = mined.filter((F.col("pos") >= MIN_TOXIC) & (sure >= MIN_PRECISION)).withColumn("sure", sure)
    with small_batches(spark):
        top = mined.orderBy(F.desc(F.col("pos") * (sure - 0.5)), "term").limit(MAX_TERMS).collect()  # MAX_TERMS rows at most
    lexicon = {r["term"] for r in top} | set(SEED_WORDS)
    strength: dict[str, float] = defaultdict(float)
    for r in top:
        strength[r["term"].lstrip("^")[:4]] += r["pos"] * (r["sure"] - 0.5)
    families = sorted(strength, key=lambda f: (-strength[f], f))[:FAMILIES]

    share = min(1.0, FIT_ROWS / max(known.count(), 1))
    chosen = texts.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < int(1_000_003 * share) + 1)

    def read_votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, whole.column(0))):
            said = [votes(t or "", lexicon, families) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([v for v, _ in said], pa.list_(pa.int8())), pa.array([list(h) for _, h in said], pa.list_(pa.string())), pa.array([list(h.values()) for _, h in said], pa.list_(pa.int32())), batch.column(1)], names=["votes", "terms", "counts", "toxic"])

    voted = chosen.select("text", "toxic").mapInArrow(read_votes, "votes array<tinyint>, terms array<string>, counts array<int>, toxic int")
    with small_batches(spark):
        rows = voted.collect()
    if not rows:
        return Model({w: 4.0 for w in SEED_WORDS}, -3.0)
    fired = np.array([r["votes"] for r in rows], float)
    held = [dict(zip(r["terms"], r["counts"], strict=True)) for r in rows]
    # the labels give the first guess only: the share of mined evidence they lend each vote
    labelled = np.array([r["toxic"] for r in rows], float)
    posterior, accuracies, together, discount = label_model(fired, 0.1 + 0.8 * labelled)
    weights, bias = _fit_linear(held, posterior, sorted(lexicon))
    return Model(weights, bias, families, accuracies, together, discount)


def scored(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """row (a struct of the columns named in keep) and score; reads text besides. Null and empty texts get the score of
    a text without any term."""
    text = F.col("text").cast("string")
    held = [text.alias(c) if c == "text" else F.col(f"`{c}`") for c in keep]
    source = docs.select(F.struct(*held).alias("row"), *([] if "text" in keep else [text.alias("text")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        texts = lambda batch: batch.column(0).field(keep.index("text")) if "text" in keep else batch.column(1)
        for batch in batches:
            for part in slices(batch, texts(batch)):
                score = pa.array([model.score(t) for t in texts(part).to_pylist()], pa.float64())
                yield pa.RecordBatch.from_arrays([part.column(0), score], names=["row", "score"])
        give_back()

    return source.mapInArrow(run, StructType([source.schema["row"], StructField("score", DoubleType())]))


def held_out(doc_id) -> F.Column:
    return F.crc32(F.col(doc_id).cast("string")) % 5 == 0


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    Labels of held-out rows are never read. Only the text is an input of the score; other columns are ignored.
    Null and empty texts score like a text without any lexicon term. A row without doc_id is held out (held_out
    null counts as true). Repeated rows score alike; an empty table gives no rows.
    """
    model = train(docs.filter(~held_out("doc_id")), labels)
    out = scored(docs, model, ["doc_id"]).select("row.doc_id", "score")
    return out.select(
        "doc_id",
        F.coalesce(held_out("doc_id"), F.lit(True)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
