"""Splits, scaling, logistic and boosted models, calibration."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinmatch.functions import text as T
from kinmatch.operators import compare, similarity
from kinmatch.operators.pairs import linear_score


def largest_remainders(n: int, capacity: dict[tuple, int]) -> dict[tuple, int]:
    """n dealt to strata in proportion to what they hold; what is left by rounding down goes to the largest remainders."""
    whole = sum(capacity.values())
    if n < 0 or n > whole:
        raise ValueError(f"{n} of {whole} records cannot be taken")
    exact = {k: n * v / whole for k, v in capacity.items()} if whole else {}
    out = {k: int(x) for k, x in exact.items()}
    for k in sorted(capacity, key=lambda k: (out[k] - exact[k], str(k)))[: n - sum(out.values())]:
        out[k] += 1
    return out


def hash_order(records: DataFrame, strata: list[str], key: Column, key_id: str) -> DataFrame:
    """records with place, from 1, in their stratum by key (a hash, bigint) and id.

    No task sees a whole stratum: rows are numbered inside slices of the hash, and slices by their sizes.
    """
    sliced = records.withColumn("key", key).withColumn("slice", F.shiftright("key", 50))
    sizes = sliced.groupBy(*strata, "slice").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy(*strata).orderBy("slice")) - F.col("n")
    inside = F.row_number().over(Window.partitionBy(*strata, "slice").orderBy("key", key_id))
    return sliced.withColumn("inside", inside).join(sizes.withColumn("before", before).drop("n"), [*strata, "slice"]).withColumn("place", F.col("before") + F.col("inside")).drop("key", "slice", "inside", "before")


def stratified_split(records: DataFrame, dev: int, confirm: int, seed: int = 42, key: Column | None = None) -> DataFrame:
    """(country, singleton, id, part): two disjoint samples with the strata's shares, the first ones by a seeded hash.

    The second sample is dealt over what the first leaves. Repeated ids and samples larger than the records are errors.
    key: another hash of the id than BLAKE2b.
    """
    strata = ["country", "singleton"]
    sizes = {(r.country, r.singleton): r.n for r in records.groupBy(*strata).agg(F.count("*").alias("n")).collect()}
    if dev < 0 or confirm < 0 or dev + confirm > sum(sizes.values()):
        raise ValueError(f"{dev} and {confirm} of {sum(sizes.values())} records cannot be taken")
    if records.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        raise ValueError("an id is there more than once")
    first = largest_remainders(dev, sizes)
    second = largest_remainders(confirm, {k: n - first[k] for k, n in sizes.items()})
    quotas = records.sparkSession.createDataFrame([(*k, first[k], second[k]) for k in sizes], "country string, singleton boolean, dev_n bigint, confirm_n bigint")
    placed = hash_order(records.select(*strata, "id"), strata, T.seeded_hash(F.col("id").cast("string"), F.lit(str(seed))) if key is None else key, "id").join(quotas, strata)
    part = F.when(F.col("place") <= F.col("dev_n"), "dev").when(F.col("place") <= F.col("dev_n") + F.col("confirm_n"), "confirm")
    return placed.withColumn("part", part).where("part is not null").select(*strata, "id", "part")


def hash_sample(rows: DataFrame, part: str, key: str, n: int, seed: str = "42") -> DataFrame:
    """At most n rows of each part, those with the smallest hashes: what a reservoir keeps, but the same in every run."""
    return rows.withColumn("r", F.row_number().over(Window.partitionBy(part).orderBy(F.md5(F.concat_ws(":", F.lit(seed), key)), key))).where(f"r <= {n}").drop("r")


@dataclass
class LinearModel:
    mean: dict[str, float]
    scale: dict[str, float]
    coefficient: dict[str, float]
    intercept: float

    def column(self):
        return linear_score(self.mean, self.scale, self.coefficient, self.intercept)


def fit_linear(rows: DataFrame, features: list[str], label: str = "label") -> LinearModel:
    """Balanced, ridge-penalised logistic regression on features scaled by population deviations."""
    told = rows.agg(F.count("*").alias("n"), F.sum(label).alias("pos"), *[F.avg(x).alias(f"m_{x}") for x in features], *[F.stddev_pop(x).alias(f"s_{x}") for x in features]).first()
    mean, scale = {x: told[f"m_{x}"] for x in features}, {x: told[f"s_{x}"] or 1.0 for x in features}
    n, pos = told["n"], told["pos"]
    weight = F.when(F.col(label) == 1, n / (2.0 * max(pos, 1))).otherwise(n / (2.0 * max(n - pos, 1)))
    scaled = rows.select(F.col(label).cast("double").alias("label"), weight.alias("weight"), *[((F.col(x) - mean[x]) / scale[x]).alias(x) for x in features])
    model = LogisticRegression(weightCol="weight", standardization=False, regParam=1.0 / max(n, 1), elasticNetParam=0.0, maxIter=200).fit(VectorAssembler(inputCols=features, outputCol="features").transform(scaled))
    return LinearModel(mean, scale, dict(zip(features, map(float, model.coefficients))), float(model.intercept))


@dataclass
class CalibratedModel:
    features: list[str]
    trees: object
    isotonic: object

    def transform(self, rows: DataFrame) -> DataFrame:
        """rows with p, between 0 and 1; the features must be those of the fit."""
        missing = [x for x in self.features if x not in rows.columns]
        if missing:
            raise ValueError(f"the model's features {missing} are not in the data")
        raw = self.trees.transform(VectorAssembler(inputCols=self.features, outputCol="features").transform(rows)).withColumn("raw", vector_to_array("probability")[1])
        out = self.isotonic.transform(raw.drop("features", "rawPrediction", "probability", "prediction"))
        return out.withColumn("p", F.least(F.greatest("prediction", F.lit(0.0)), F.lit(1.0))).drop("prediction", "raw")


def fit_calibrated(fit: DataFrame, calibrate: DataFrame, features: list[str], label: str = "label", trees: int = 30, depth: int = 4) -> CalibratedModel:
    """Gradient-boosted trees, then isotonic calibration on rows of their own."""
    assemble = VectorAssembler(inputCols=features, outputCol="features")
    model = GBTClassifier(labelCol="label", featuresCol="features", maxIter=trees, maxDepth=depth, stepSize=0.1, subsamplingRate=0.9, seed=42).fit(assemble.transform(fit.withColumn("label", F.col(label).cast("double"))))
    raw = model.transform(assemble.transform(calibrate)).select(F.col(label).cast("double").alias("label"), vector_to_array("probability")[1].alias("raw"))
    return CalibratedModel(features, model, IsotonicRegression(labelCol="label", featuresCol="raw").fit(raw))


def _summed(packed: DataFrame, columns: list[str], of: Callable[[np.ndarray, np.ndarray], np.ndarray], n: int) -> np.ndarray:
    """The sum of of(features, label) (n numbers) over steps of packed rows; the label is the last of columns, more than 0 or not."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n)
        for batch in batches:
            for data in batch["rows"]:
                rows = compare.unpacked(data.as_buffer(), columns)
                for i in range(0, len(rows), 1 << 16):
                    x = np.column_stack([rows[c].slice(i, 1 << 16).to_numpy() for c in columns])
                    total += of(x[:, :-1], x[:, -1] > 0)
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["x"])

    told = packed.select("rows").mapInArrow(part, "x array<double>")
    return np.array([x or 0.0 for x in told.agg(*[F.sum(F.col("x")[k]) for k in range(n)]).first()])


def fit_linear_packed(packed: DataFrame, features: list[str], label: str) -> LinearModel:
    """The model of fit_linear() from all packed rows (compare.py) with label > 0, by Newton's method: a few sums for each step."""
    columns, k = [*features, label], len(features) + 1
    told = _summed(packed, columns, lambda x, y: np.array([len(y), y.sum(), *x.sum(axis=0)]), k + 1)
    n, pos = told[:2]
    mean = told[2:] / max(n, 1)
    scale = np.sqrt(_summed(packed, columns, lambda x, y: ((x - mean) ** 2).sum(axis=0), k - 1) / max(n, 1))
    scale[scale == 0] = 1.0
    names = lambda x: dict(zip(features, map(float, x)))
    if pos in (0, n):
        return LinearModel(names(mean), names(scale), names(np.zeros(k - 1)), float("inf") if pos else float("-inf"))
    of_class = n / (2.0 * pos), n / (2.0 * (n - pos))
    ridge = np.array([*np.ones(k - 1), 0.0])  # a penalty of 1 / n on the mean loss

    def told_at(b: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        def of(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            x = np.column_stack([(x - mean) / scale, np.ones(len(x))])
            z, w = x @ b, np.where(y, *of_class)
            p = 0.5 * (1 + np.tanh(0.5 * z))
            return np.concatenate([[w @ np.logaddexp(0, np.where(y, -z, z))], x.T @ (w * (p - y)), (x.T @ (x * (w * p * (1 - p))[:, None])).ravel()])

        out = _summed(packed, columns, of, 1 + k + k * k)
        return out[0] + 0.5 * ridge @ b**2, out[1 : k + 1] + ridge * b, out[k + 1 :].reshape(k, k) + np.diag(ridge)

    at = np.zeros(k)
    loss, slope, curve = told_at(at)
    for _ in range(200):
        step = np.linalg.solve(curve + 1e-12 * n * np.eye(k), slope)
        if np.abs(step).max() <= 1e-7 * max(1.0, np.abs(at).max()):
            break
        then = told_at(at - step)
        while then[0] > loss + 1e-9 * abs(loss) and np.abs(step).max() > 1e-12:
            step /= 2
            then = told_at(at - step)
        at, (loss, slope, curve) = at - step, then
    return LinearModel(names(mean), names(scale), names(at[:-1]), float(at[-1]))


def best_of_packed(packed: DataFrame, model: LinearModel, most: int, kinds: tuple[str, str]) -> DataFrame:
    """(country, q, c, score): of the pairs of each chunk those that are among a query's best so many; kinds: the types of q and c."""
    features = list(model.coefficient)
    weights = [model.coefficient[x] / model.scale[x] for x in features]
    shift = model.intercept - sum(model.mean[x] / model.scale[x] * model.coefficient[x] for x in features)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for country, data in zip(batch["country"], batch["rows"]):
                rows = compare.unpacked(data.as_buffer(), ["q", "c", *features])
                score = np.full(len(rows), shift)
                for x, w in zip(features, weights):
                    score = score + w * rows[x].to_numpy()
                q, c = (similarity._ordered(rows[x].combine_chunks())[1] for x in "qc")
                order = np.lexsort((c, -score, q))
                first = np.flatnonzero(np.diff(q[order], prepend=-1))
                kept = order[np.arange(len(order)) - np.repeat(first, np.diff(first, append=len(order))) < most]
                yield from pa.table({"country": pa.array([country.as_py()] * len(kept), pa.string()), "q": rows["q"].take(pa.array(kept)), "c": rows["c"].take(pa.array(kept)), "score": score[kept]}).combine_chunks().to_batches()

    return packed.select("country", "rows").mapInArrow(best, f"country string, q {kinds[0]}, c {kinds[1]}, score double")
