"""Quality rules: base rules on each text, then robust outliers of what passes, for each language and source.

Statistics of whole texts are transformed (logarithm of the mean word length, root of the symbol share, share of
repeated lines, share of repeated words). For each group a regularised minimum-covariance-determinant estimate is
fitted over all rows that pass the base rules: from several starts (medians with quartiles, means with the whole
scatter), concentration steps, each of which keeps the
share `support` of rows nearest by Mahalanobis distance and re-estimates from them, until no group's determinant falls
any more; the estimate of least determinant stands. A row is rejected if its squared distance exceeds the chi-square
quantile `cutoff`.

A concentration step is one aggregation: rows are binned by distance, counts and moments are summed by group and bin
before they are shuffled, and the nearest bins are added up until they hold the share. No group is gathered, whatever
its size. Every group of any size has its own estimate, which is shrunk toward that of its parent (the language, and
then all rows) by the weight PRIOR_ROWS / (rows + PRIOR_ROWS): a group of few rows leans on its parent, a large one
stands alone, and there is no size at which one turns into the other. FLOOR is the resolution of each statistic: the
scatter never falls below it, so a group of constant values rejects nothing near them.

Defined cases: a null or empty text has no words and fails the base rules; null group columns are a group of their
own; repeated rows are judged each; an empty table gives an empty table; the statistics are held in one struct column
named apart from the table's own, so further columns of any name pass through.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared

FIELDS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
SPACE, SYMBOLS = " \t\n\v\f\r", "#*$%&|<>"
DIM = 4
FLOOR = (0.12, 0.05, 0.2, 0.15)
#: The 0.9999 quantile of chi-square with four degrees of freedom.
CUTOFF = 23.5127
BINS_PER_DOUBLING, LEAST = 8, 1e-6
PRIOR_ROWS = 20


def text_statistics(text: str | None) -> tuple[int, ...]:
    """FIELDS of a text. Words are runs of characters other than space and \\t to \\r."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    windows = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(set(windows)) < len(windows):
        seen, end = Counter(windows), 0
        for i, w in enumerate(windows):
            if seen[w] > 1:
                repeated += i + 3 - max(i, end)
                end = i + 3
    chars = len(text) - sum(map(text.count, SPACE))
    return len(words), chars, sum(map(text.count, SYMBOLS)), len(lines), len(lines) - len(set(lines)), repeated


def measure(docs: DataFrame, text_col: str = "text", drop_text: bool = False, name: str | None = None) -> DataFrame:
    """docs with a struct of the statistics as the last column, by a name that docs has not; without the text if drop_text."""
    name = name or shared.free_name(docs, "__stats")
    keep = [c for c in docs.columns if not (drop_text and c == text_col)]
    kind = T.StructType([T.StructField(f, T.LongType()) for f in FIELDS])
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(name, kind)])
    at = docs.columns.index(text_col)
    places = [docs.columns.index(c) for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                found = list(zip(*map(text_statistics, part.column(at).to_pylist()), strict=True)) or [[]] * len(FIELDS)
                stats = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in found], list(FIELDS))
                yield pa.RecordBatch.from_arrays([*(part.column(p) for p in places), stats], [*keep, name])

    return shared.map_rows(docs, run, schema)


def base_failed(s: Column) -> Column:
    return (s.n_words < 50) | (100 * s.n_repeat_words > 50 * s.n_words)


def transformed(s: Column) -> list[Column]:
    words = F.greatest(s.n_words, F.lit(1)).cast("double")
    return [F.log(F.greatest(s.word_chars, F.lit(1)) / words), F.sqrt(s.n_symbols / F.greatest(s.word_chars, F.lit(1))), s.n_dup_lines / F.greatest(s.n_lines, F.lit(1)), s.n_repeat_words / words]


def squared_distance(x: Sequence[Column], center: Column, precision: Column) -> Column:
    d = [x[i] - center[i] for i in range(DIM)]
    return sum((d[i] * d[j] * precision[i * DIM + j] for i in range(DIM) for j in range(DIM)), F.lit(0.0))


def chi2_below(x: float, dof: int) -> float:
    """Distribution function of chi-square for even degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(dof // 2))


def consistency(share: float) -> float:
    """What makes the scatter of the nearest share of normal rows that of all of them."""
    low, high = 0.0, 100.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_below(mid, DIM) < share else (low, mid)
    return share / max(chi2_below(low, DIM + 2), 1e-9) if share < 1 else 1.0


UPPER = [(i, j) for i in range(DIM) for j in range(i, DIM)]
STARTS = ("medians", "means")
ESTIMATE = "grp string, start string, n long, center array<double>, scatter array<double>, precision array<double>, logdet double"


def estimate(n: float, total: float, sums: np.ndarray, products: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Center and regularised scatter from the moments of the n nearest of total rows."""
    center = sums / n
    scatter = np.zeros((DIM, DIM))
    for (i, j), p in zip(UPPER, products, strict=True):
        scatter[i, j] = scatter[j, i] = p / n - center[i] * center[j]
    return center, consistency(n / total) * scatter + np.diag(np.square(FLOOR))


def told(grp: str, start: str, n: int, center: np.ndarray, scatter: np.ndarray, logdet: float | None = None) -> dict:
    logdet = float(np.linalg.slogdet(scatter)[1]) if logdet is None else logdet
    return {"grp": grp, "start": start, "n": n, "center": center.tolist(), "scatter": scatter.ravel().tolist(), "precision": np.linalg.inv(scatter).ravel().tolist(), "logdet": logdet}


def concentrate(bins: pd.DataFrame, support: float) -> dict:
    """One group's bins of distance, with their moments, to the next estimate."""
    bins = bins.sort_values("bin")
    counts = bins["n"].to_numpy(float)
    total = counts.sum()
    k = int(np.searchsorted(np.cumsum(counts), support * total - 1e-9)) + 1
    take = bins.iloc[:k]
    center, scatter = estimate(take["n"].sum(), total, np.array([take[f"s{i}"].sum() for i in range(DIM)]), np.array([take[f"p{i}{j}"].sum() for i, j in UPPER]))
    return told(bins["grp"].iloc[0], bins["start"].iloc[0], int(total), center, scatter)


def begin(rows: pd.DataFrame) -> Iterator[dict]:
    """The starts of each group: of moments and quartiles. They have no determinant to compare, so any step is better."""
    for r in rows.itertuples():
        quartiles = np.array([r.q0, r.q1, r.q2, r.q3])
        spread = np.square((quartiles[:, 2] - quartiles[:, 0]) / 1.349) + np.square(FLOOR)
        yield told(r.grp, "medians", r.n, quartiles[:, 1], np.diag(spread), 1e9)
        center, scatter = estimate(r.n, r.n, np.array([getattr(r, f"s{i}") for i in range(DIM)]), np.array([getattr(r, f"p{i}{j}") for i, j in UPPER]))
        yield told(r.grp, "means", r.n, center, scatter, 1e9)


def fit(rows: DataFrame, support: float = 0.6, steps: int = 12, falls: float = 0.01) -> DataFrame:
    """rows: grp, x0 to x3. One estimate for each group, of least determinant over all starts and concentration steps.

    Steps go on while the logarithm of some group's determinant falls by more than `falls`, at most `steps` times.
    """
    x = [F.col(f"x{i}") for i in range(DIM)]
    moments = [F.count("*").alias("n"), *(F.sum(c).alias(f"s{i}") for i, c in enumerate(x)), *(F.sum(x[i] * x[j]).alias(f"p{i}{j}") for i, j in UPPER)]
    known = rows.groupBy("grp").agg(*moments, *(F.percentile_approx(c, [0.25, 0.5, 0.75], 1000).alias(f"q{i}") for i, c in enumerate(x)))

    def first(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame(list(begin(part)), columns=[c.split()[0] for c in ESTIMATE.split(", ")])

    def step(bins: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([concentrate(bins, support)])

    made = [shared.stage(known.mapInPandas(first, ESTIMATE), "mcd")]
    for _ in range(steps):
        near = rows.join(shared.maybe_broadcast(made[-1].select("grp", "start", "center", "precision"), 400), "grp")
        far = F.log2(F.least(squared_distance(x, F.col("center"), F.col("precision")), F.lit(1e12)) + LEAST)
        binned = near.select("grp", "start", F.floor(far * BINS_PER_DOUBLING).alias("bin"), *x).groupBy("grp", "start", "bin").agg(*moments)
        made.append(shared.stage(binned.groupBy("grp", "start").applyInPandas(step, ESTIMATE), "mcd"))
        old = made[-2].select("grp", "start", F.col("logdet").alias("old"))
        if not made[-1].join(old, ["grp", "start"]).where(F.col("old") - F.col("logdet") > falls).limit(1).count():
            break
    every = reduce(DataFrame.unionByName, made[1:])
    return every.groupBy("grp").agg(F.min_by(F.struct("n", "center", "scatter"), F.struct("logdet", "start")).alias("e")).select("grp", "e.*")


def shrunk(levels: list) -> tuple[list[float], list[float]]:
    """Center and precision of a group from the estimates of its levels, its own first and that of all rows last."""
    center, scatter = np.array(levels[-1]["center"]), np.array(levels[-1]["scatter"])
    for level in levels[-2::-1]:
        weight = level["n"] / (level["n"] + PRIOR_ROWS)
        center = weight * np.array(level["center"]) + (1 - weight) * center
        scatter = weight * np.array(level["scatter"]) + (1 - weight) * scatter
    return center.tolist(), np.linalg.inv(scatter.reshape(DIM, DIM)).ravel().tolist()


def judge(measured: DataFrame, group_cols: Sequence[str] = ("lang", "source"), name: str | None = None, support: float = 0.6, cutoff: float = CUTOFF, out: str | None = None) -> DataFrame:
    """measured with a struct as the last column: base_failed, distance2 (null if base_failed) and kept.

    name is the column of the statistics, the last one unless told; out that of the struct, else one that is free.
    """
    name, out = name or measured.columns[-1], out or shared.free_name(measured, "__verdict")
    s = F.col(f"`{name}`")
    failed = base_failed(s)
    parts = [F.coalesce(F.concat(F.lit("="), F.col(f"`{c}`").cast("string")), F.lit("")) for c in group_cols]
    levels = [F.concat_ws("\x00", F.lit(str(k)), *parts[:k]) for k in range(len(parts), -1, -1)]
    x = transformed(s)
    rows = measured.where(~failed).select(F.array(*levels).alias("grps"), *(c.alias(f"x{i}") for i, c in enumerate(x)))
    best = fit(rows.select(F.explode("grps").alias("grp"), *(f"x{i}" for i in range(DIM))), support)
    groups = rows.select("grps").distinct().select("grps", F.posexplode("grps").alias("level", "grp"))
    fits = groups.join(best, "grp").groupBy(F.col("grps")[0].alias("grp")).agg(F.array_sort(F.collect_list(F.struct("level", "n", "center", "scatter"))).alias("levels"))

    def lean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            found = [shrunk(list(x)) for x in part["levels"]]
            yield pd.DataFrame({"grp": part["grp"], "center": [f[0] for f in found], "precision": [f[1] for f in found]})

    chosen = fits.mapInPandas(lean, "grp string, center array<double>, precision array<double>")
    known = shared.maybe_broadcast(shared.stage(chosen, "mcd-chosen"), 300)
    group, best_fit = shared.free_name(measured, "__grp"), shared.free_name(measured, "__fit")
    joined = measured.withColumn(group, levels[0]).join(known.select(F.col("grp").alias(group), F.struct("center", "precision").alias(best_fit)), group, "left")
    d2 = squared_distance(x, F.col(f"{best_fit}.center"), F.col(f"{best_fit}.precision"))
    verdict = F.struct(failed.alias("base_failed"), F.when(~failed, d2).alias("distance2"), (~failed & (d2 <= cutoff)).alias("kept"))
    return joined.withColumn(out, verdict).drop(group, best_fit)


def keep_good(docs: DataFrame, text_col: str = "text", group_cols: Sequence[str] = ("lang", "source")) -> DataFrame:
    """The rows of docs that pass, with the columns of docs."""
    stats, verdict = shared.free_name(docs, "__stats"), shared.free_name(docs, "__verdict")
    measured = shared.stage(measure(docs, text_col, name=stats), "measured")
    return judge(measured, group_cols, stats, out=verdict).where(F.col(f"{verdict}.kept")).select(*(F.col(f"`{c}`") for c in docs.columns))
