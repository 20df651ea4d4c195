"""Toxicity by cumulative-link ordinal regression on sparse word features.

P(grade > k) = s(w.x - t_k) with one weight vector w for all ordered thresholds t_0 < t_1 < ...; a text's severity is the expected
grade. Features are words and beginnings of words, as abuse is inflected, whose presence depends on the label beyond chance, each valued
1 + log(occurrences).

The labels only say toxic or not. Grade 0 is not toxic; toxic examples are graded 1, 2, ... by equal shares of the number of telling words in them, so
that severity rises with the amount of abuse. Which words are telling for that is found in the other half of the sample, so that an example has no part in
what it is graded by.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.llm.common import ARRAY_BYTES, as_bytes, blocks, bounded, column, free, texts_of, written
from pointloom.llm.words import Words, word_hash

#: Labelled documents that the model is fitted on at most, chosen by a hash of doc_id; features it may hold, and those that are tested,
#: the most frequent among toxic examples.
SAMPLE, FEATURES, TESTED = 20_000, 4096, 1 << 16
#: Lengths of the beginnings of words, in characters, and the toxic examples that a feature occurs in at least.
BEGINNINGS, LEAST = range(3, 9), 5
GRADES = 4

_LETTERS = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))
_TABLE = np.frombuffer(bytes(range(256)).lower().translate(_LETTERS), np.uint8)


def tokens(raw: bytes) -> list[bytes]:
    """Lower-case runs of ASCII letters and digits and of bytes above 127."""
    return raw.lower().translate(_LETTERS).split()


def features(word: bytes) -> list[str]:
    """The word itself, as =word, and its beginnings, as ^begin."""
    text = word.decode("utf-8", "replace")
    return [f"={text}", *(f"^{text[:n]}" for n in BEGINNINGS if n <= len(text))]


class Reader:
    """Finds the known features in a block of texts at once, by hashes of words and of their beginnings."""

    def __init__(self, index: dict[str, int]):
        self.known = []
        for n in (0, *BEGINNINGS):
            own = [(word_hash(f[1:].encode()), j) for f, j in index.items() if (f[0] == "=") == (n == 0) and (n == 0 or len(f) == n + 1)]
            keys, numbers = np.array([h for h, _ in own], np.uint64), np.array([j for _, j in own], np.int64)
            by = np.argsort(keys)
            self.known.append((n, keys[by], numbers[by]))

    def block(self, texts: pa.Array | list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, feature, occurrences), ascending, and of each text the number of words that have any feature."""
        w = Words(texts, table=_TABLE)
        _, first, place = np.unique(w.hashes, return_index=True, return_inverse=True)
        begin, end = w.begin[first], w.end[first]
        starts = np.flatnonzero(w.raw & 0xC0 != 0x80)
        char = np.searchsorted(starts, begin)
        starts = np.append(starts, np.full(max(BEGINNINGS) + 1, len(w.raw)))
        word, feature = [], []
        for n, keys, numbers in self.known:
            if not len(keys):
                continue
            to = starts[char + n] if n else end
            some = np.flatnonzero(to <= end)
            h = w.hashed(begin[some], to[some]) if n else w.hashes[first]
            i = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            same = keys[i] == h
            word.append(some[same])
            feature.append(numbers[i[same]])
        word, feature = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (word, feature))
        by = np.argsort(word, kind="stable")
        word, feature = word[by], feature[by]
        n = np.bincount(word, minlength=len(first))
        text = np.repeat(np.arange(len(w.counts)), w.counts)
        telling = np.flatnonzero(n[place])
        amount = np.bincount(text[telling], minlength=len(w.counts))
        own = place[telling]
        start = (np.cumsum(n) - n)[own]
        times = n[own]
        j = feature[np.repeat(start - np.cumsum(times) + times, times) + np.arange(int(times.sum()))]
        both, c = np.unique(np.repeat(text[telling], times) << 32 | j, return_counts=True)
        return both >> 32, both & 0xFFFFFFFF, c, amount

    def read(self, raw: bytes) -> tuple[list[tuple[int, int]], int]:
        """(feature, occurrences) of one text, ascending, and the number of words that have any."""
        _, j, c, amount = self.block([raw])
        return list(zip(j.tolist(), c.tolist())), int(amount[0])


@dataclass(frozen=True)
class Model:
    """Broadcast to the workers: at most FEATURES weights, and the thresholds."""

    index: dict[str, int]
    weights: tuple[float, ...]
    thresholds: tuple[float, ...]
    #: The p_toxic from which a text counts as toxic.
    cut: float = 0.5

    def score(self, hits: list[tuple[int, int]]) -> np.ndarray:
        """P(grade > k) for each threshold."""
        j, c = (np.array([x[i] for x in hits], np.int64) for i in (0, 1))
        return self.scores(np.zeros(len(j), np.int64), j, c, 1)[0]

    def scores(self, text: np.ndarray, j: np.ndarray, c: np.ndarray, n: int) -> np.ndarray:
        """P(grade > k) of each of ``n`` texts, a column for each threshold."""
        x = np.bincount(text, np.array(self.weights)[j] * (1.0 + np.log(c)), n) if len(j) else np.zeros(n)
        return 1.0 / (1.0 + np.exp(np.array(self.thresholds) - x[:, None]))


def fit(rows: list[list[tuple[int, float]]], grade: np.ndarray, n_features: int, grades: int = GRADES, penalty: float = 0.001, steps: int = 1500) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of the penalised likelihood, by Adam on the full sample. rows: (feature, value) pairs."""
    n = len(rows)
    at = np.repeat(np.arange(n), [len(r) for r in rows])
    col = np.array([j for r in rows for j, _ in r], np.int64)
    val = np.array([v for r in rows for _, v in r])
    # thresholds: t_0, then positive steps, kept positive by softplus
    par = np.concatenate([np.zeros(n_features), [1.0], np.ones(grades - 2)])
    m, v = np.zeros_like(par), np.zeros_like(par)
    above = grade[:, None] > np.arange(grades - 1)
    for step in range(1, steps + 1):
        w, raw = par[:n_features], par[n_features:]
        gaps = np.log1p(np.exp(raw[1:]))
        t = raw[0] + np.concatenate([[0.0], np.cumsum(gaps)])
        x = np.bincount(at, val * w[col], n)
        s = 1.0 / (1.0 + np.exp(np.clip(t - x[:, None], -30, 30)))  # P(grade > k)
        edge = np.concatenate([np.ones((n, 1)), s, np.zeros((n, 1))], axis=1)
        p = np.maximum(edge[np.arange(n), grade] - edge[np.arange(n), grade + 1], 1e-12)
        d = s * (1 - s) / p[:, None]  # d log p / d(x - t_k), up to sign
        sign = np.zeros_like(d)
        k = np.arange(grades - 1)
        sign[(k == grade[:, None] - 1)] = 1.0
        sign[(k == grade[:, None])] -= 1.0
        g = d * sign
        back = g.sum(axis=0)
        gw = np.bincount(col, val * g.sum(axis=1)[at], n_features) / n - penalty * w / max(1, above[:, 0].sum())
        gt = -np.array([back.sum(), *(back[i:].sum() for i in range(1, grades - 1))]) / n
        gt[1:] *= 1.0 / (1.0 + np.exp(-raw[1:]))
        grad = np.concatenate([gw, gt])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        par = par + 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    raw = par[n_features:]
    return par[:n_features], raw[0] + np.concatenate([[0.0], np.cumsum(np.log1p(np.exp(raw[1:])))])


def best_cut(p: np.ndarray, y: np.ndarray) -> float:
    """The middle of the gap with the fewest errors on the sample, the one nearest to a half among equals."""
    order = np.argsort(p, kind="stable")
    p, y = p[order], y[order]
    errors = np.concatenate([[0], np.cumsum(y)]) + (len(y) - y.sum()) - np.concatenate([[0], np.cumsum(1 - y)])
    edge = np.concatenate([[0.0], p, [1.0]])
    middle = (edge[1:] + edge[:-1]) / 2
    real = edge[1:] > edge[:-1]
    return float(min(zip(errors[real], np.abs(middle[real] - 0.5), middle[real]))[2])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most: int = FEATURES, grades: int = GRADES, alpha: float = 0.01) -> Model:
    """A model from at most ``sample`` labelled documents (the smallest hashes of doc_id).

    Features are kept if a likelihood-ratio test of presence against label stays significant at ``alpha`` after correction for the
    number tested, the most significant first. Labels other than 0 and 1 and null ids are left out; of a document labelled twice the
    higher label counts. Without toxic examples or significant features the model calls nothing toxic.
    """
    spark = docs.sparkSession
    chosen = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int").alias("half")
    given = written(texts_of(docs).join(F.broadcast(chosen.withColumnRenamed("doc_id", "id")), F.col("doc_id") == F.col("id")).select("doc_id", "text", "toxic", half))
    size = {(r["half"], r["toxic"]): r["count"] for r in given.groupBy("half", "toxic").count().collect()}

    def presence(known):
        def work(batches):
            for batch in blocks(batches):
                seen: tuple[Counter, Counter] = (Counter(), Counter())
                for raw, own in zip(as_bytes(batch.column("text")), batch.column("half").to_pylist()):
                    present = {f for w in set(tokens(raw)) for f in features(w)}
                    seen[own].update(present if known is None else present & known.value)
                names = list(seen[0].keys() | seen[1].keys())
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([x[f] for f in names], pa.int64()) for x in seen)], names=["feature", "n", "m"])

        return work

    def counted(label, known=None):
        return given.where(F.col("toxic") == label).mapInArrow(presence(known), "feature string, n bigint, m bigint").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))

    tested = {r["feature"]: (r["n"], r["m"]) for r in counted(1).where(F.col("n") + F.col("m") >= LEAST).orderBy(F.desc(F.col("n") + F.col("m")), "feature").limit(TESTED).collect()}
    clean = {r["feature"]: (r["n"], r["m"]) for r in counted(0, spark.sparkContext.broadcast(frozenset(tested))).collect()}
    names = sorted(tested)
    toxic_in, clean_in = (np.array([x.get(f, (0, 0)) for f in names], np.float64).reshape(-1, 2) for x in (tested, clean))

    def part(seen, expected):
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1) / np.maximum(expected, 1e-300)), 0.0)

    def told_by(halves: tuple[int, ...]) -> dict[str, int]:
        """The telling features by the examples of these halves, numbered by name."""
        n0, n1 = (sum(size.get((h, label), 0) for h in halves) for label in (0, 1))
        share = n1 / max(1, n0 + n1)
        a, b = (x[:, list(halves)].sum(axis=1) for x in (clean_in, toxic_in))
        ratio = 2 * (part(a, (a + b) * (1 - share)) + part(b, (a + b) * share) + part(n0 - a, (n0 + n1 - a - b) * (1 - share)) + part(n1 - b, (n0 + n1 - a - b) * share))
        # the upper tail of chi-square with one degree of freedom is below exp(-x / 2)
        telling = np.flatnonzero((ratio > 2 * np.log(max(1, len(names)) / alpha)) & (b > (a + b) * share))
        telling = telling[np.lexsort((telling, -ratio[telling]))][:most]
        return {names[i]: j for j, i in enumerate(sorted(telling.tolist()))}

    index = told_by((0, 1))
    if not index:
        return Model({}, (), tuple([30.0] * (grades - 1)))
    known = spark.sparkContext.broadcast((index, told_by((1,)), told_by((0,))))

    def hits(batches):
        reader, *other = map(Reader, known.value)
        for batch in blocks(batches, limit=ARRAY_BYTES):
            text, j, c, _ = reader.block(batch.column("text"))
            amounts = np.stack([x.block(batch.column("text"))[3] for x in other])
            amount = amounts[batch.column("half").to_numpy(zero_copy_only=False), np.arange(batch.num_rows)]
            cuts = np.searchsorted(text, np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(amount), *(pa.ListArray.from_arrays(pa.array(cuts), pa.array(x.astype(np.int32))) for x in (j, c))], names=["doc_id", "toxic", "amount", "j", "c"])

    rows = given.mapInArrow(hits, f"{column('doc_id', given)}, toxic int, amount bigint, j array<int>, c array<int>").orderBy("doc_id", "j").collect()
    y = np.array([r["toxic"] for r in rows])
    amount = np.array([r["amount"] for r in rows], np.float64)
    cuts = np.quantile(amount[y == 1], np.arange(1, grades - 1) / (grades - 1))
    grade = np.where(y == 1, 1 + (amount[:, None] > cuts).sum(axis=1), 0)
    w, t = fit([[(j, 1.0 + float(np.log(c))) for j, c in zip(r["j"], r["c"])] for r in rows], grade, len(index), grades)
    model = Model(index, tuple(map(float, w)), tuple(map(float, t)))
    return replace(model, cut=best_cut(np.array([model.score(list(zip(r["j"], r["c"])))[0] for r in rows]), y))


def scores(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The kept columns of every row with severity (expected grade), p_toxic (that the grade is above 0), grade and toxic (p_toxic of the model's cut or more).

    A name that ``docs`` has already gets an underscore. ``grade`` is the smallest whose cumulative probability reaches a half. A null or empty text is scored as having no words. Null ids,
    repeated rows and empty tables pass row by row; equal texts get equal scores; texts are scored whole.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [*keep, *(free(n, docs) for n in ("severity", "p_toxic", "grade", "toxic"))]
    text_name = free("text_read", docs)

    def work(batches):
        model = shared.value
        reader = Reader(model.index)
        for batch in blocks(batches, text_name, ARRAY_BYTES):
            text, j, c, _ = reader.block(batch.column(text_name))
            p = model.scores(text, j, c, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(p.sum(axis=1)), pa.array(p[:, 0]), pa.array((p >= 0.5).sum(axis=1).astype(np.int32)), pa.array(p[:, 0] >= model.cut)], names=names)

    fields = [f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep]
    return bounded(docs).select(*keep, F.coalesce(F.col(text), F.lit("")).alias(text_name)).mapInArrow(work, ", ".join([*fields, *(f"{n} {t}" for n, t in zip(names[len(keep) :], ("double", "double", "int", "boolean")))]))
