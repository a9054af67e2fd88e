"""Model fitting on pyspark.ml: linear classifiers, calibration, projection, clustering."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import tokens
from tidemark.session import staged


SIZE = 1 << 17  # hashed features, of words and word pairs


def term_slots(df: DataFrame, text: str, size: int = SIZE, category: str | None = None) -> DataFrame:
    """``df`` with ``slots``: the hashed words and word pairs of a text, and the category where one is given (a null one adds none)."""

    def grams(words):
        pairs = F.greatest(F.size(words) - 1, F.lit(0))
        return F.concat(words, F.zip_with(F.slice(words, F.lit(1), pairs), F.slice(words, F.lit(2), pairs), lambda a, b: F.concat(a, F.lit(" "), b)))

    # As a lambda's variable the words are made once a text; as an expression they would be made again for every pair.
    terms = F.get(F.transform(F.array(tokens(F.coalesce(F.col(text), F.lit("")))), grams), 0)
    if category:
        terms = F.concat(terms, F.when(F.col(category).isNull(), F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("\x00"), F.col(category)))))
    return df.withColumn("slots", F.transform(terms, lambda t: F.pmod(F.xxhash64(t), F.lit(size).cast("long")).cast("int")))


def mixed_rows(fit: DataFrame, label: str, part_rows: int = 32_768) -> DataFrame:
    """(slots, ``label``, part) of ``fit``, staged in parts of at least ``part_rows`` rows, in an order that only depends on the slots.

    Whatever makes the slots runs once here; all passes of fitting read the staged rows.
    """
    parts = max(1, fit.count() // part_rows)
    rows = fit.select("slots", label).repartition(parts, F.xxhash64("slots"))
    return staged(rows.sortWithinPartitions(F.xxhash64("slots", F.lit(3))).withColumn("part", F.spark_partition_id()))


def _counted(slots: pa.Array, size: int, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group * size + slot, row in the group, times), in this order, of the lists' slots; a group is ``rows`` successive lists."""
    n = slots.value_lengths().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(n)), n)
    key, times = np.unique((row // rows * size + slots.flatten().to_numpy()) * rows + row % rows, return_counts=True)
    return key // rows, key % rows, times


def slot_weights(fit: DataFrame, size: int = SIZE) -> np.ndarray:
    """Smoothed inverse document frequency per slot; at most ``size`` counts come to the driver."""

    def counted(batches):
        n, rows = np.zeros(size, np.int64), 0
        for b in batches:
            n += np.bincount(_counted(b.column("slots"), size, 1)[0] % size, minlength=size)
            rows += b.num_rows
        at = np.flatnonzero(n)
        yield pa.record_batch([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(n[at], rows), pa.int64())], names=["slot", "n"])

    df = fit.select("slots").mapInArrow(counted, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    n, df = df.n[df.slot < 0].sum(), df[df.slot >= 0]
    out = np.zeros(size, np.float32)
    out[df.slot] = np.log((1 + n) / (1 + df.n)) + 1
    return out


STEP = 16  # rows a step


def _steps(slots: pa.Array, idf: np.ndarray):
    """Per ``STEP`` successive lists: their different slots, the places of the weights in a matrix of (lists, slots), the weights, the number of lists."""
    size = len(idf)
    key, row, times = _counted(slots, size, STEP)
    x = times * idf[key % size]
    where = key // size * STEP + row
    norm = np.sqrt(np.bincount(where, x * x, len(slots)))
    x = (x / np.where(norm > 0, norm, 1)[where]).astype(np.float32)
    ends = np.searchsorted(key, np.arange(-(-len(slots) // STEP) + 1) * size)
    for i, (a, b) in enumerate(zip(ends[:-1], ends[1:])):
        new = np.diff(key[a:b], prepend=-1) > 0
        at = (key[a:b][new] % size).astype(np.int32)
        yield at, (row[a:b] * len(at) + np.cumsum(new) - 1).astype(np.int32), x[a:b], min(STEP, len(slots) - i * STEP)


def _matrix(at: np.ndarray, place: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((n, len(at)), np.float32)
    out.ravel()[place] = x
    return out


class LinearModel:
    """One linear classifier per class against the rest on weighted slots: logistic loss, L2, averaged stochastic gradient.

    ``fit`` are ``mixed_rows``. Every part's rows are gone through ``epochs`` times from the common weights, ``STEP`` rows a
    step, and the parts' averaged weights are averaged by their rows, chunk by chunk, for the next round. Rows that are alike
    add up in a step, so its rate is held under what the largest eigenvalue of their products allows.
    """

    def __init__(self, fit: DataFrame, label: str, idf: np.ndarray, penalty: float = 1e-5, epochs: int = 4, rounds: int = 3):
        rows = fit.where(F.col(label).isNotNull())
        self.labels = [r[0] for r in rows.select(label).distinct().orderBy(label).collect()]  # classes
        self.idf, k, size = idf, len(self.labels), len(idf)
        self.w = np.zeros((size + 1, k), np.float32)  # the constants last
        if not k:
            return
        names = F.array(*[F.lit(c) for c in self.labels])
        rows = rows.select("slots", (F.array_position(names, F.col(label)) - 1).cast("int").alias("y"), "part")
        chunk = 1 << 14

        def fitted(start: np.ndarray, done: int, slots: pa.Array, y: np.ndarray) -> np.ndarray:
            order = np.random.default_rng(0).permutation(len(y))
            y, data = y[order], []
            for a in range(0, len(y), 256 * STEP):
                data += _steps(slots.take(pa.array(order[a : a + 256 * STEP])), idf)
            wu, w0 = np.concatenate([start[:-1], np.zeros((size, k), np.float32)], 1), start[-1].copy()  # weights but for the scale; what their average lacks
            scale, total, seen, t = 1.0, 0.0, 0, done * len(y)
            for _ in range(epochs):
                begun = 0
                for at, place, x, n in data:
                    m, g = _matrix(at, place, x, n), wu.take(at, axis=0)
                    t += n
                    rate = min(1.0 / (penalty * (t + 1 / penalty)), 4 / max(float((m @ m.sum(0)).max(initial=0)), 1e-9))
                    p = 1 / (1 + np.exp(-np.clip(np.float32(scale) * (m @ g[:, :k]) + w0, -30, 30)))
                    p[np.arange(n), y[begun : begun + n]] -= 1
                    scale *= (1 - rate * penalty) ** n
                    d = m.T @ (p * np.float32(-rate / scale))
                    g[:, :k] += d
                    d *= np.float32(total)
                    g[:, k:] += d
                    wu[at] = g
                    w0 -= np.float32(0.1 * rate) * p.sum(0)
                    begun, seen, total = begun + n, seen + n, total + n * scale
            return np.concatenate([(np.float32(total) * wu[:, :k] - wu[:, k:]) / np.float32(seen), w0[None]])

        def trained(start: np.ndarray, done: int):
            def one(part: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
                table = pa.Table.from_batches(held).combine_chunks()
                slots, y = table.column("slots").chunk(0), table.column("y").to_numpy()
                flat = fitted(start, done, slots, y).ravel()
                cut = [flat[a : a + chunk].tobytes() for a in range(0, len(flat), chunk)]
                return pa.record_batch([pa.array(range(len(cut)), pa.int32()), pa.array([part] * len(cut), pa.int32()), pa.array([len(y)] * len(cut), pa.int64()), pa.array(cut, pa.binary())], names=["chunk", "part", "n", "w"])

            def run(batches):
                part, held = None, []
                for b in batches:
                    of = b.column("part").to_numpy()
                    ends = [0, *np.flatnonzero(np.diff(of)) + 1, len(of)]
                    for a, e in zip(ends[:-1], ends[1:]):
                        if e > a:
                            if held and of[a] != part:
                                yield one(part, held)
                                held = []
                            part = int(of[a])
                            held.append(b.slice(a, e - a))
                if held:
                    yield one(part, held)

            return run

        def mixed(table: pa.Table) -> pa.Table:
            table = table.sort_by([("part", "ascending"), ("n", "ascending")])
            n = table.column("n").to_numpy()
            w = np.stack([np.frombuffer(x, np.float32) for x in table.column("w").to_pylist()])
            return pa.table({"chunk": table.column("chunk")[:1], "w": pa.array([(n @ w / n.sum()).astype(np.float32).tobytes()], pa.binary())})

        for r in range(rounds):
            got = rows.mapInArrow(trained(self.w, r * epochs), "chunk int, part int, n long, w binary").groupBy("chunk").applyInArrow(mixed, "chunk int, w binary").toArrow()
            order = np.argsort(got.column("chunk").to_numpy())
            parts = got.column("w").to_pylist()
            self.w = np.frombuffer(b"".join(parts[i] for i in order), np.float32).reshape(size + 1, k)

    def scored(self, df: DataFrame) -> DataFrame:
        """``df`` (with slots) and ``scores``, one per class; they come to nothing but zeros where no class is known."""
        w, idf = self.w, self.idf

        def run(batches):
            for b in batches:
                out = [_matrix(at, *rest) @ w.take(at, axis=0) + w[-1] for at, *rest in _steps(b.column("slots"), idf)]
                flat = np.concatenate(out).astype(np.float64).ravel() if out else np.zeros(0)
                scores = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * w.shape[1], pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([*b.columns, scores], names=[*b.schema.names, "scores"])

        kinds = ", ".join(f"`{c}` {t}" for c, t in df.dtypes)
        return df.mapInArrow(run, f"{kinds}, scores array<double>")


def linear_classes(fit: DataFrame, df: DataFrame, label: str, penalty: float = 1e-5, size: int = SIZE) -> DataFrame:
    """``df`` (with slots) and ``predicted``, the class of the highest score (the first by name on ties); null without classes."""
    fit = mixed_rows(fit, label)
    model = LinearModel(fit, label, slot_weights(fit, size), penalty)
    if not model.labels:
        return df.withColumn("predicted", F.lit(None).cast("string"))
    names = F.array(*[F.lit(x) for x in model.labels])
    return model.scored(df).withColumn("predicted", F.get(names, (F.array_position("scores", F.array_max("scores")) - 1).cast("int"))).drop("scores")


def calibrated(fit: DataFrame, calibration: DataFrame, df: DataFrame, truth: str, penalty: float = 1e-5, size: int = SIZE) -> DataFrame:
    """``df`` and ``probability_true``: a linear score fitted on ``fit``, its sigmoid on ``calibration``."""
    fit = mixed_rows(fit.where(F.col(truth).isNotNull()), truth)
    model = LinearModel(fit, truth, slot_weights(fit, size), penalty)
    true = model.labels.index(True)
    margin = lambda d: model.scored(d).withColumn("_m", array_to_vector(F.array(F.col("scores")[true]))).drop("scores")
    known = calibration.where(F.col(truth).isNotNull()).select("slots", F.col(truth).cast("double").alias("_y"))
    # The sigmoid's fit goes through its rows several times: their scores are written once.
    known = staged(model.scored(known).select("_y", F.col("scores")[true].alias("_m"))).withColumn("_m", array_to_vector(F.array("_m")))
    sigmoid = LogisticRegression(featuresCol="_m", labelCol="_y", probabilityCol="_pr", rawPredictionCol="_raw", predictionCol="_p").fit(known)
    return sigmoid.transform(margin(df)).withColumn("probability_true", vector_to_array("_pr")[1]).drop("_m", "_raw", "_pr", "_p")


def projected(fit: DataFrame, df: DataFrame, vec: str, k: int) -> tuple[DataFrame, list[float]]:
    """``df`` with ``projected`` (array), centred with the fit rows' mean, and the share of variance per component."""
    ready = lambda d: d.where(F.col(vec).isNotNull()).withColumn("_v", array_to_vector(F.col(vec).cast("array<double>")))
    centre = StandardScaler(inputCol="_v", outputCol="_c", withMean=True, withStd=False).fit(ready(fit))
    model = PCA(k=k, inputCol="_c", outputCol="_q").fit(centre.transform(ready(fit)))
    return model.transform(centre.transform(ready(df))).withColumn("projected", vector_to_array("_q")).drop("_v", "_c", "_q"), [float(x) for x in model.explainedVariance]


def partitioned(df: DataFrame, vec: str, k: int, seed: int = 7) -> DataFrame:
    """``df`` with ``part`` by k-means; an empty cluster is an error."""
    ready = df.where(F.col(vec).isNotNull()).withColumn("_v", array_to_vector(F.col(vec).cast("array<double>")))
    model = KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="part", initMode="k-means||").fit(ready)
    if min(model.summary.clusterSizes) == 0:
        raise ValueError("empty cluster")
    return model.transform(ready).drop("_v")


def mixture(df: DataFrame, vec: str, k: int, seed: int = 7) -> DataFrame:
    """``df`` with ``part`` and ``confidence`` by a Gaussian mixture over a short vector."""
    ready = df.where(F.col(vec).isNotNull()).withColumn("_v", array_to_vector(F.col(vec).cast("array<double>")))
    model = GaussianMixture(k=k, seed=seed, featuresCol="_v", predictionCol="part", probabilityCol="_pr", maxIter=20).fit(ready)
    return model.transform(ready).withColumn("confidence", F.array_max(vector_to_array("_pr"))).drop("_v", "_pr")
