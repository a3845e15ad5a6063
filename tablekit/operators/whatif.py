"""What-if scenarios: linear driver impact, row-level change, bootstrap uncertainty."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablekit.functions.columns import TWO_32, col, hash32, is_numeric, require_columns, row_hash, small_table, uniform
from tablekit.functions.order_stats import exact_quantiles
from tablekit.functions.storage import checkpoint

MODES = ("percent", "fixed", "uniform_percent", "normal_percent")
AGGREGATES = ("sum", "mean", "median")
MIN_ROWS = 5

# Poisson(1): a 32-bit hash gives as many copies of a row as it reaches thresholds.
POISSON_CUTS = [
    math.floor(TWO_32 * sum(math.exp(-1) / math.factorial(j) for j in range(k + 1))) for k in range(12)
]
#: copies by the upper half of the hash; OPEN where the lower half decides
OPEN = 255
COPIES = np.searchsorted(np.array(POISSON_CUTS), np.arange(1 << 16) << 16, side="right").astype(np.uint8)
COPIES[np.array(POISSON_CUTS) >> 16] = OPEN
#: draws that a task works on at once
HELD = 1 << 18


def _complete(df: DataFrame, driver: str, outcome: str, key: Sequence[str] = ()) -> DataFrame:
    require_columns(df, driver, outcome, *key)
    for c in (driver, outcome):
        if not is_numeric(df, c):
            raise ValueError(f"{c} is not numeric")
    x, y = col(driver).cast("double"), col(outcome).cast("double")
    rows = df.filter(x.isNotNull() & y.isNotNull())
    return rows.select(x.alias("x"), y.alias("y"), *[col(k).alias(f"k{i}") for i, k in enumerate(key)])


def _slope(rows: DataFrame, same: bool) -> tuple[int, float]:
    row = rows.agg(F.count(F.lit(1)).alias("n"), F.regr_slope("y", "x").alias("b"), F.var_pop("x").alias("v")).first()
    if row["n"] < MIN_ROWS:
        raise ValueError(f"at least {MIN_ROWS} complete rows are needed")
    if same:
        return row["n"], 1.0
    return row["n"], float(row["b"]) if row["v"] and row["v"] > 0 else 0.0


def driver_slope(df: DataFrame, driver: str, outcome: str) -> DataFrame:
    """Least-squares slope of the outcome on the driver over complete rows."""
    n, beta = _slope(_complete(df, driver, outcome), driver == outcome)
    return small_table(df.sparkSession, [(n, beta)], "rows_used long, beta double")


def _aggregate(rows: DataFrame, names: Sequence[str], how: str) -> dict[str, float]:
    if how not in AGGREGATES:
        raise ValueError(f"unknown aggregate {how}")
    if how == "median":
        found = exact_quantiles(rows, {c: [0.5] for c in names})
        return {c: found[c][0.5] for c in names}
    fn = F.sum if how == "sum" else F.avg
    row = rows.agg(*[fn(c).alias(c) for c in names]).first()
    return {c: row[c] for c in names}


def _result(df: DataFrame, n: int, beta: float, base: float, scen: float) -> DataFrame:
    delta = scen - base
    return small_table(
        df.sparkSession,
        [(n, beta, base, scen, delta, delta / base * 100 if base else None)],
        "rows_used long, beta double, baseline double, scenario double, delta double, pct_delta double",
    )


def scenario(
    df: DataFrame, driver: str, outcome: str, mode: str = "percent", amount: float = 10.0, aggregate: str = "sum"
) -> DataFrame:
    """Outcome before and after changing the driver by a percentage or a fixed amount."""
    if mode not in ("percent", "fixed"):
        raise ValueError(f"unknown mode {mode}")
    rows = _complete(df, driver, outcome)
    n, beta = _slope(rows, driver == outcome)
    dx = F.col("x") * F.lit(amount / 100.0) if mode == "percent" else F.lit(float(amount))
    values = _aggregate(rows.withColumn("s", F.col("y") + F.lit(beta) * dx), ["y", "s"], aggregate)
    return _result(df, n, beta, values["y"], values["s"])


def _spread(mode: str, amount: float, low: float, high: float) -> tuple[float, float]:
    """(low, high) of the uniform, or (mean, std) of the normal percentage."""
    if mode == "uniform_percent":
        return min(low, high), max(low, high)
    return amount, abs(high) if high else 5.0


def scenario_random(
    df: DataFrame,
    driver: str,
    outcome: str,
    key: Sequence[str],
    mode: str = "uniform_percent",
    amount: float = 10.0,
    low: float = -10.0,
    high: float = 10.0,
    aggregate: str = "sum",
    seed: int = 42,
) -> DataFrame:
    """As scenario, with a random percentage per row drawn from the row's key."""
    if mode not in ("uniform_percent", "normal_percent"):
        raise ValueError(f"unknown mode {mode}")
    rows = _complete(df, driver, outcome, key)
    n, beta = _slope(rows, driver == outcome)
    h = row_hash([f"k{i}" for i in range(len(key))], seed)
    a, b = _spread(mode, amount, low, high)
    if mode == "uniform_percent":
        pct = F.lit(a) + F.lit(b - a) * F.col("u1")
    else:
        # Box-Muller; 1 - u keeps the logarithm finite
        pct = F.lit(a) + F.lit(b) * F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - F.col("u1"))) * F.cos(
            F.lit(2 * math.pi) * F.col("u2")
        )
    work = rows.withColumn("h", h).withColumns({"u1": uniform(F.col("h")), "u2": uniform(F.col("h"), 9)})
    work = work.withColumn("s", F.col("y") + F.lit(beta) * F.col("x") * pct / F.lit(100.0))
    values = _aggregate(work, ["y", "s"], aggregate)
    return _result(df, n, beta, values["y"], values["s"])


# ---- bootstrap ---------------------------------------------------------------------------


def _seeded(rows: DataFrame, keys: int, seed: int) -> DataFrame:
    """Two pairs of 32-bit numbers per row; trial t uses (a + t b) mod 2^32. The stride is odd,
    so a row runs through the whole range over the trials."""
    h = row_hash([f"k{i}" for i in range(keys)], seed)
    return rows.withColumn("h", h).select(
        "x",
        "y",
        hash32(F.col("h")).alias("a"),
        hash32(F.col("h"), 9).bitwiseOR(F.lit(1)).alias("b"),
        hash32(F.col("h"), 17).alias("c"),
        hash32(F.col("h"), 25).bitwiseOR(F.lit(1)).alias("d"),
    )


def _draws(start: np.ndarray, stride: np.ndarray, trials: np.ndarray) -> np.ndarray:
    return (start[:, None] + trials[None, :] * stride[:, None]) & (TWO_32 - 1)


def _percent(mode: str, c: np.ndarray, d: np.ndarray, trials: np.ndarray, a: float, b: float) -> np.ndarray:
    u = _draws(c, d, trials) / TWO_32
    if mode == "uniform_percent":
        return a + (b - a) * u
    v = _draws(d, c | 1, trials) / TWO_32
    return a + b * np.sqrt(-2.0 * np.log(1.0 - u)) * np.cos(2 * np.pi * v)


def _scenario_matrix(b: pd.DataFrame, mode: str, beta: float, p: tuple, amount: float, trials: np.ndarray) -> np.ndarray:
    x, y = b["x"].to_numpy(), b["y"].to_numpy()
    if mode == "percent":
        return np.repeat((y + beta * x * (amount / 100.0))[:, None], len(trials), axis=1)
    if mode == "fixed":
        return np.repeat((y + beta * amount)[:, None], len(trials), axis=1)
    pct = _percent(mode, b["c"].to_numpy(), b["d"].to_numpy(), trials, *p)
    return y[:, None] + beta * x[:, None] * pct / 100.0


def _steps(b: pd.DataFrame, width: int) -> Iterator[pd.DataFrame]:
    step = max(1, HELD // width)
    for i in range(0, len(b), step):
        yield b.iloc[i : i + step]


def _copies(b: pd.DataFrame, trials: np.ndarray) -> np.ndarray:
    """Copies of every row in every trial. The upper half of a draw tells them, but for the few halves that hold a cut."""
    start, stride = (b[c].to_numpy().astype(np.uint32)[:, None] for c in "ab")
    h = start + trials.astype(np.uint32) * stride  # modulo 2^32
    out = COPIES[h >> np.uint32(16)]
    open_ = out == OPEN
    out[open_] = np.searchsorted(np.array(POISSON_CUTS), h[open_].astype(np.int64), side="right")
    return out


def _bootstrap_sums(rows: DataFrame, trials: int, mode: str, beta: float, p: tuple, amount: float) -> DataFrame:
    """Weighted sums per trial. Each task adds up its rows for all trials at once and emits one
    row per trial: rows are never multiplied by the trials."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ts = np.arange(trials, dtype=np.int64)
        w, wy, ws = np.zeros(trials), np.zeros(trials), np.zeros(trials)
        for batch in batches:
            for b in _steps(batch, trials):
                m = _copies(b, ts).astype(float)
                w += m.sum(axis=0)
                wy += b["y"].to_numpy() @ m
                if mode in ("percent", "fixed"):
                    ws += _scenario_matrix(b, mode, beta, p, amount, ts[:1])[:, 0] @ m
                else:
                    ws += (_scenario_matrix(b, mode, beta, p, amount, ts) * m).sum(axis=0)
        yield pd.DataFrame({"trial": ts, "w": w, "wy": wy, "ws": ws})

    parts = rows.mapInPandas(run, "trial long, w double, wy double, ws double")
    return parts.groupBy("trial").agg(F.sum("w").alias("w"), F.sum("wy").alias("wy"), F.sum("ws").alias("ws"))


def _bootstrap_medians(rows: DataFrame, trials: int, n: int, mode: str, beta: float, p: tuple, amount: float) -> DataFrame:
    """``trial, y, s``: weighted medians per trial of the outcome and of the scenario, from the same copies.

    Trial medians lie close to the median of the table. Tasks count the copies below a
    bracket around it and pass on only the values inside; if a trial falls outside a
    bracket, it is widened and the pass repeated for that column.
    """
    base = {"y": F.col("y")}
    if mode == "percent":
        base["s"] = F.col("y") + F.lit(beta * amount / 100.0) * F.col("x")
    elif mode == "fixed":
        base["s"] = F.col("y") + F.lit(beta * amount)
    else:
        # spread of the first trial, as a proposal only
        pct = F.lit(p[0]) + F.lit(p[1] - p[0]) * F.col("c") / F.lit(float(TWO_32))
        if mode == "normal_percent":
            pct = F.lit(p[0])
        base["s"] = F.col("y") + F.lit(beta) * F.col("x") * pct / F.lit(100.0)
    reach = 6 / math.sqrt(n)
    first = F.floor((F.col("total") - 1) / 2)
    last = F.ceil((F.col("total") - 1) / 2)
    found: dict[str, DataFrame] = {}
    while len(found) < 2:
        todo = [c for c in base if c not in found]
        lo_p, hi_p = 0.5 - reach, 0.5 + reach
        lo, hi = (dict.fromkeys(todo, v) for v in (-math.inf, math.inf))
        if lo_p > 0:
            q = exact_quantiles(rows.select(*[base[c].alias(c) for c in todo]), {c: [lo_p, hi_p] for c in todo})
            lo, hi = ({c: q[c][v] for c in todo} for v in (lo_p, hi_p))
        # a value of the row, the same in all trials
        plain = [c for c in todo if c == "y" or mode in ("percent", "fixed")]

        def run(batches: Iterator[pd.DataFrame], todo=todo, plain=plain, lo=lo, hi=hi) -> Iterator[pd.DataFrame]:
            ts = np.arange(trials, dtype=np.int64)
            below, total = {c: np.zeros(trials, dtype=np.int64) for c in todo}, np.zeros(trials, dtype=np.int64)

            def cells(c: str, v: np.ndarray, m: np.ndarray) -> Iterator[pd.DataFrame]:
                at, t = np.nonzero((v >= lo[c]) & (v <= hi[c]) & (m > 0))
                if len(at):
                    v = np.broadcast_to(v, m.shape)
                    yield pd.DataFrame({"c": c, "trial": t, "v": v[at, t], "w": m[at, t].astype(np.int64), "below": 0, "total": 0})

            for batch in batches:
                fixed = {c: batch["y"].to_numpy() if c == "y" else _scenario_matrix(batch, mode, beta, p, amount, ts[:1])[:, 0] for c in plain}
                done = 0
                for b in _steps(batch, trials):
                    m = _copies(b, ts)
                    part = slice(done, done + len(b))
                    done += len(b)
                    # copies of all rows, and of those below: whole numbers small enough for single precision
                    flags = np.stack([np.ones(len(b), bool), *[fixed[c][part] < lo[c] for c in plain]])
                    sums = flags.astype(np.float32) @ m.astype(np.float32)
                    total += sums[0].astype(np.int64)
                    for c, some in zip(plain, sums[1:]):
                        below[c] += some.astype(np.int64)
                    for c in todo:
                        if c not in plain:
                            v = _scenario_matrix(b, mode, beta, p, amount, ts)
                            below[c] += np.where(v < lo[c], m, 0).sum(axis=0, dtype=np.int64)
                            yield from cells(c, v, m)
                for c in plain:
                    inside = np.flatnonzero((fixed[c] >= lo[c]) & (fixed[c] <= hi[c]))
                    done = 0
                    for b in _steps(batch.iloc[inside], trials):
                        yield from cells(c, fixed[c][inside[done : done + len(b)]][:, None], _copies(b, ts))
                        done += len(b)
            for c in todo:
                yield pd.DataFrame({"c": c, "trial": ts, "v": [None] * trials, "w": 0, "below": below[c], "total": total})

        parts = checkpoint(
            rows.mapInPandas(run, "c string, trial long, v double, w long, below long, total long")
            .groupBy("c", "trial", "v")
            .agg(F.sum("w").alias("w"), F.sum("below").alias("below"), F.sum("total").alias("total"))
        )
        heads = parts.filter(F.col("v").isNull()).select("c", "trial", "below", "total")
        inner = parts.filter(F.col("v").isNotNull()).select("c", "trial", "v", "w")
        inside = inner.groupBy("c", "trial").agg(F.sum("w").alias("inside"))
        missed = heads.join(inside, ["c", "trial"], "left").filter(
            (F.col("total") > 0)
            & ((F.col("below") > first) | (last >= F.col("below") + F.coalesce("inside", F.lit(0))))
        )
        wide = {r["c"] for r in missed.select("c").distinct().collect()} if lo_p > 0 else set()  # y, s
        for c in todo:
            if c not in wide:
                found[c] = _weighted_medians(inner.filter(F.col("c") == c), heads.filter(F.col("c") == c), first, last, c)
        reach *= 4
    return found["s"].join(found["y"], "trial")


def _weighted_medians(cells: DataFrame, heads: DataFrame, first: Column, last: Column, name: str) -> DataFrame:
    """``trial, name`` from the copies ``w`` of the values of a bracket, and the number of those below it."""
    run_w = Window.partitionBy("trial").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    heads = heads.select("trial", "below", "total")
    ranked = cells.withColumn("upto", F.sum("w").over(run_w)).join(F.broadcast(heads), "trial")  # a row per trial
    ranked = ranked.withColumn("upto", F.col("upto") + F.col("below"))
    from_ = F.col("upto") - F.col("w")
    lower = F.max(F.when((from_ <= first) & (first < F.col("upto")), F.col("v")))
    upper = F.max(F.when((from_ <= last) & (last < F.col("upto")), F.col("v")))
    return ranked.groupBy("trial").agg(((lower + upper) / 2).alias(name))


def bootstrap(
    df: DataFrame,
    driver: str,
    outcome: str,
    key: Sequence[str],
    mode: str = "percent",
    amount: float = 10.0,
    low: float = -10.0,
    high: float = 10.0,
    aggregate: str = "sum",
    trials: int = 1000,
    seed: int = 42,
) -> DataFrame:
    """``trial, result, delta``: the scenario aggregate over Poisson-resampled rows, and its
    difference to the same resample without the change. Sums are taken to the table's row count.
    """
    if mode not in MODES or aggregate not in AGGREGATES:
        raise ValueError(f"unknown mode {mode} or aggregate {aggregate}")
    if not 100 <= trials <= 10_000:
        raise ValueError("trials must be between 100 and 10000")
    rows = _complete(df, driver, outcome, key)
    n, beta = _slope(rows, driver == outcome)
    p = _spread(mode, amount, low, high)
    rows = _seeded(rows, len(key), seed)
    if aggregate == "median":
        both = _bootstrap_medians(rows, trials, n, mode, beta, p, amount)
        return both.select("trial", F.col("s").alias("result"), (F.col("s") - F.col("y")).alias("delta"))
    sums = _bootstrap_sums(rows, trials, mode, beta, p, amount).filter(F.col("w") > 0)
    scale: Column = F.lit(float(n)) if aggregate == "sum" else F.lit(1.0)
    return sums.select(
        "trial",
        (F.col("ws") / F.col("w") * scale).alias("result"),
        ((F.col("ws") - F.col("wy")) / F.col("w") * scale).alias("delta"),
    )


def bootstrap_summary(trials: DataFrame) -> DataFrame:
    """Mean, median, 5 % and 95 % of result and delta."""
    trials = checkpoint(trials)
    row = trials.agg(F.count(F.lit(1)).alias("n"), F.avg("result").alias("m"), F.avg("delta").alias("d")).first()
    q = exact_quantiles(trials, {c: [0.05, 0.5, 0.95] for c in ("result", "delta")})
    r, d = q["result"], q["delta"]
    return small_table(
        trials.sparkSession,
        [(row["n"], row["m"], r[0.5], r[0.05], r[0.95], row["d"], d[0.5], d[0.05], d[0.95])],
        "trials long, mean double, median double, p05 double, p95 double, "
        "delta double, delta_median double, delta_p05 double, delta_p95 double",
    )


def bootstrap_histogram(trials: DataFrame, bins: int = 20) -> DataFrame:
    """Equal-width bars of the results, closed on the right; one bar when all are equal."""
    trials = checkpoint(trials)
    row = trials.agg(F.min("result").alias("lo"), F.max("result").alias("hi")).first()
    lo, hi = row["lo"], row["hi"]
    nb = 1 if lo == hi else bins
    width = (hi - lo) / nb if hi != lo else 1.0
    index = F.greatest(F.ceil((F.col("result") - F.lit(lo)) / F.lit(width)) - 1, F.lit(0))
    counts = trials.groupBy(F.least(index, F.lit(nb - 1)).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = small_table(
        trials.sparkSession,
        [(b, lo + b * width, lo + (b + 1) * width if hi != lo else hi) for b in range(nb)],
        "bin long, lo double, hi double",
    )
    return grid.join(counts, "bin", "left").select(
        "bin", "lo", "hi", F.coalesce("n", F.lit(0)).cast("long").alias("count")
    )
