"""Toxic passages by maximum-scoring segments.

Fit (on at most FIT_ROWS labelled texts, each distinct text once): log-odds of each stem between toxic and other texts
under an informative Dirichlet prior, whose pseudo-counts follow the stems' overall frequencies (Monroe et al., 2008).
Stems are words and their beginnings of STEM bytes or more, so that inflected and compound forms never seen before are
known by their stem; a text counts a stem once. Stems with a z-score of MIN_Z or more form the lexicon; a word takes
the weight of its longest one. A toxic passage is taken to hold DENSITY of such words, which makes every word's weight
a log-likelihood ratio: positive in the lexicon, slightly negative elsewhere.

Score: all maximal segments of the word weights in linear time (Ruzzo and Tompa, 1999). The best segment of a clean
text of n words follows an extreme-value law, P(best > s) = 1 - exp(-K n exp(-lambda s)) (Karlin and Altschul, 1990);
K and lambda are fitted to the clean texts. A segment is significant if its E-value K n exp(-lambda s) is at most
MAX_E. The segments' bits over chance are added up and turned into a probability by a logistic fit.

Null and empty texts have no words and get the score of a text without a toxic passage. Texts are taken whole. Without
labels of both kinds every text scores 0. Repeated rows score alike; ties do not matter; a null id has no label and is
held out; an empty table gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafgrove.llm._shared import fold, lookup, materialize, read, slices

#: The classifier is fitted on a sample of about so many labelled rows at most.
FIT_ROWS = 20_000
#: Weight of the Dirichlet prior in stems, at most, and as a share of all; z-score, log-odds and texts that a stem of the lexicon needs; bytes of a stem.
PRIOR, PRIOR_SHARE, MIN_Z, MIN_ODDS, MIN_TEXTS, STEM = 10_000.0, 0.05, 3.5, 1.5, 3, 4
#: Words whose weights a Python worker remembers.
MEMORY = 150_000
DENSITY, MAX_E = 0.05, 0.05

_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    """Runs of letters (and of any characters outside ASCII), A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_LETTERS).split()


def stems(own: Iterable[bytes]) -> set[bytes]:
    return {w[:k] for w in set(own) for k in range(min(STEM, len(w)), len(w) + 1)}


class Weights(dict):
    """Weight of a word, that of its longest stem in the lexicon; 0 without one. Filled as words come up."""

    def __init__(self, lexicon: dict[bytes, float]):
        super().__init__()
        self.lexicon = lexicon
        self.longest = max(map(len, lexicon), default=0)

    def __missing__(self, word: bytes) -> float:
        if len(self) >= MEMORY:
            self.clear()
        found = next((self.lexicon[word[:k]] for k in range(min(len(word), self.longest), 0, -1) if word[:k] in self.lexicon), 0.0)
        self[word] = found
        return found

    def __reduce__(self):
        return Weights, (self.lexicon,)


def segments(hits: list[tuple[int, float]], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first word, last word, score) of a sequence with weight drift (negative) but at hits.

    A run of drift is one element, so the time is linear in the hits. Each kept segment knows the sum before it, the sum
    at its end, and the last segment whose sum before it is lower: a search goes from link to link and never looks at a
    segment twice. A new segment swallows those back to the one it finds, as long as its own end lies higher.
    """
    kept: list[tuple[int, int, float, float, int]] = []  # first, last, sum before, sum at the end, link
    total, at = 0.0, 0
    for place, weight in hits:
        total += drift * (place - at)
        at = place + 1
        if weight <= 0:
            total += weight
            continue
        first, before, total = place, total, total + weight
        k = len(kept) - 1
        while k >= 0:
            if kept[k][2] >= before:
                k = kept[k][4]
            elif kept[k][3] >= total:
                break
            else:
                first, before = kept[k][0], kept[k][2]
                link = kept[k][4]
                del kept[k:]
                k = link
        kept.append((first, place, before, total, k))
    return [(a, b, end - start) for a, b, start, end, _ in kept]


@dataclass(frozen=True)
class Model:
    weights: Weights
    drift: float
    k: float
    rate: float
    bias: float
    slopes: tuple[float, float]

    def found(self, text: str | None) -> tuple[int, list[tuple[int, int, float]]]:
        """Number of words, and all maximal segments."""
        own = words(text)
        return len(own), segments([(i, x) for i, x in enumerate(map(self.weights.__getitem__, own)) if x], self.drift)

    def features(self, n: int, found: list[tuple[int, int, float]]) -> tuple[float, float]:
        """Bits over chance of the best segment, and of all significant ones together."""
        chance = math.log(max(self.k * n, 1e-12))
        over = [self.rate * s - chance for _, _, s in found]
        best = max(over, default=-3.0)
        return max(-3.0, min(best, 30.0)), math.log1p(sum(x for x in over if x >= -math.log(MAX_E)))

    def score(self, features: tuple[float, float]) -> float:
        return 1 / (1 + math.exp(-max(-35.0, min(35.0, self.bias + sum(a * b for a, b in zip(self.slopes, features, strict=True))))))


def lexicon(stem: list[bytes], toxic: np.ndarray, texts: np.ndarray, all_toxic: int, all_texts: int) -> tuple[dict[bytes, float], float]:
    """Weights of toxic stems, and the weight of any other word.

    toxic, texts: toxic texts and all texts that hold each stem; all_toxic, all_texts: their sums over all stems.
    """
    y, x = toxic.astype(float), (texts - toxic).astype(float)
    weight = min(PRIOR, PRIOR_SHARE * all_texts)
    n_y, n_x = all_toxic + weight, all_texts - all_toxic + weight
    prior = weight * texts / max(all_texts, 1)
    odds = np.log((y + prior) / (n_y - y - prior)) - np.log((x + prior) / (n_x - x - prior))
    z = odds / np.sqrt(1 / (y + prior) + 1 / (x + prior))
    chosen = {stem[i]: i for i in np.flatnonzero((z >= MIN_Z) & (odds >= MIN_ODDS) & (texts >= MIN_TEXTS))}
    top = [i for s, i in chosen.items() if not any(s[:k] in chosen for k in range(1, len(s)))]
    if not top:
        return {}, -0.05
    passage, clean = DENSITY * (y + prior) / (y + prior)[top].sum(), (x + prior) / n_x
    weight = np.log(passage / clean)
    drift = math.log((1 - DENSITY) / max(1 - min(DENSITY / 2, clean[top].sum()), 1e-9))
    return {s: float(weight[i]) for s, i in chosen.items() if weight[i] > 0}, drift


def extreme_value(best: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """K and lambda of clean texts' best segments, by maximum likelihood; K alone where lambda can't be told."""
    some = (best > 0) & (n > 0)
    if some.sum() < 20:
        return 1e-4, 1.0
    # Texts without any segment count as searched words, too: as ones whose best is at most 0.
    rest = float(n[best <= 0].sum())
    best, n = best[some], n[some].astype(float)
    low, high = 0.05, 5.0
    slope = lambda r: 1 / r - best.mean() + (n * best * np.exp(-r * best)).sum() / ((n * np.exp(-r * best)).sum() + rest)
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if slope(middle) > 0 else (low, middle)
    return float(len(best) / ((n * np.exp(-low * best)).sum() + rest)), float(low)


def logistic(features: np.ndarray, labels: np.ndarray, ridge: float = 0.5) -> tuple[float, tuple[float, float]]:
    """Bias and slopes, by Newton steps that are halved until the penalised loss falls."""
    x = np.column_stack([np.ones(len(features)), features])
    penalty = ridge * np.array([0.01, 1.0, 1.0])
    loss = lambda w: np.logaddexp(0, x @ w).sum() - labels @ (x @ w) + (penalty * w * w).sum() / 2
    w = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (p - labels) + penalty * w)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
    return float(w[0]), (float(w[1]), float(w[2]))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """labels: (id, label 0/1); rows with a null label count for nothing. Of several labels of an id the greatest counts."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).cast("int").alias("_y"))
    known = materialize(known, "labels")
    n = known.count()
    part = -(-n // FIT_ROWS) if n else 1
    known = known.where(F.pmod(F.xxhash64(id_col), F.lit(part)) == 0)
    own = lookup(docs.select(F.col(id_col), F.col(text_col).alias("_text")), known, [id_col], "inner", hot=False).where("_text is not null")
    # Copies of a text are one example: of equal texts the first stays.
    own = materialize(own, "labelled")
    own = own.groupBy(F.xxhash64("_text").alias("_h"), F.length("_text").alias("_n")).agg(F.min(F.struct(id_col, "_y", "_text")).alias("r")).select("r.*")
    own = materialize(own, "examples")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            toxic, texts = Counter(), Counter()
            for text, label in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                found = stems(words(text.as_py()))
                texts.update(found)
                if label == 1:
                    toxic.update(found)
            names = list(texts)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array([toxic[w] for w in names], pa.int64()), pa.array([texts[w] for w in names], pa.int64())], ["stem", "toxic", "texts"])

    counts = materialize(own.select("_text", "_y").mapInArrow(count, "stem binary, toxic long, texts long").groupBy("stem").agg(F.sum("toxic").alias("toxic"), F.sum("texts").alias("texts")), "stems")
    all_toxic, all_texts = counts.agg(F.sum("toxic"), F.sum("texts")).first()
    if not all_toxic or all_toxic == all_texts:
        return Model(Weights({}), -0.05, 1e-4, 1.0, -35.0, (0.0, 0.0))
    # Only stems that toxic texts have more often can enter the lexicon; the sample bounds how many there are.
    table = counts.where((F.col("toxic") * (all_texts - all_toxic) > (F.col("texts") - F.col("toxic")) * all_toxic) & (F.col("texts") >= MIN_TEXTS)).toArrow()
    known, drift = lexicon(table["stem"].to_pylist(), table["toxic"].to_numpy(), table["texts"].to_numpy(), all_toxic, all_texts)
    weights = Weights(known)
    rough = Model(weights, drift, 1.0, 1.0, 0.0, (0.0, 0.0))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [rough.found(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([n for n, _ in found], pa.int64()), pa.array([max((s for _, _, s in f), default=0.0) for _, f in found], pa.float64())], ["y", "n", "best"])

    seen = own.select("_text", "_y").mapInArrow(best, "y int, n long, best double").toArrow()
    clean = seen["y"].to_numpy() == 0
    k, rate = extreme_value(seen["best"].to_numpy()[clean], seen["n"].to_numpy()[clean])
    model = Model(weights, drift, k, rate, 0.0, (0.0, 0.0))

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [model.features(*model.found(t.as_py())) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([batch.column(1), *(pa.array([x[j] for x in own], pa.float64()) for j in (0, 1))], ["y", "best", "sum"])

    seen = own.select("_text", "_y").mapInArrow(described, "y int, best double, sum double").toArrow()
    return Model(weights, drift, k, rate, *logistic(np.column_stack([seen["best"].to_numpy(), seen["sum"].to_numpy()]), (seen["y"].to_numpy() == 1).astype(float)))


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score, and the significant passages (first and last word, counted from 0, and E-value) of each row."""
    kind = df.schema[id_col].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(model)
    passage = pa.list_(pa.struct([("first_word", pa.int64()), ("last_word", pa.int64()), ("e_value", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in slices(batches):
            scores, passages = [], []
            for text in batch.column(1):
                n, found = model.found(text.as_py())
                scores.append(model.score(model.features(n, found)))
                e = [(a, b, model.k * n * math.exp(-model.rate * s)) for a, b, s in found]
                passages.append([{"first_word": a, "last_word": b, "e_value": x} for a, b, x in e if x <= MAX_E])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(passages, passage)], [id_col, "score", "passages"])

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, score double, passages array<struct<first_word: long, last_word: long, e_value: double>>")


def keep_clean(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of df whose text scores below 0.5, with their columns."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            yield batch.filter(pa.array([model.score(model.features(*model.found(t.as_py()))) < 0.5 for t in batch.column(at)], pa.bool_()))

    return df.mapInArrow(run, df.schema)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = fit(docs, labels.where(fold("doc_id", 5) != 0))
    return score(docs, model).select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(True)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))
