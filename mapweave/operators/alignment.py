"""Similarity alignment: correspondences, moments, robust fit."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mapweave.functions.vectors import finite, minus, norm, rotate
from mapweave.operators.medians import exact_median
from mapweave.sources.tables import Tables

AXES = ("sx", "sy", "sz", "tx", "ty", "tz")


def match_points(local: DataFrame, stored: DataFrame, least: float = 0.5, geometric: float = 0.5) -> DataFrame:
    """Points of the same frame and pixel index in both tables, confident on both sides; weights sum to one a batch."""
    a = local.select("batch", "frame_no", "pt", *(F.col(c).alias(f"s{c}") for c in "xyz"), F.col("conf").alias("cs"))
    b = stored.select("frame_no", "pt", *(F.col(c).alias(f"t{c}") for c in "xyz"), F.col("conf").alias("ct"))
    d = a.join(b, ["frame_no", "pt"])
    d = d.where(finite(*(F.col(c) for c in ("sx", "sy", "sz", "cs", "tx", "ty", "tz", "ct"))))
    d = d.where((F.col("cs") >= least) & (F.col("ct") >= least)).withColumn("raw", F.sqrt(F.col("cs") * F.col("ct"))).where(F.col("raw") >= geometric)
    total = d.groupBy("batch").agg(F.sum("raw").alias("total"))
    return d.join(total, "batch").withColumn("w", F.col("raw") / F.col("total"))


def moments(d: DataFrame, *more: Column) -> DataFrame:
    """The 18 weighted sums that determine a similarity fit, one row a batch, summed before the shuffle; and
    ``more`` sums."""
    w = F.col("w")
    s, t = ("sx", "sy", "sz"), ("tx", "ty", "tz")
    sums = [F.sum(w).alias("m_w"), *(F.sum(w * F.col(c)).alias(f"m_{c}") for c in s + t)]
    sums += [F.sum(w * sum((F.col(c) ** 2 for c in side), F.lit(0.0))).alias(name) for side, name in ((s, "m_ss"), (t, "m_tt"))]
    sums += [F.sum(w * F.col(a) * F.col(b)).alias(f"m_{a}{b}") for a in t for b in s]
    return d.groupBy("batch").agg(*sums, *more)


def solve(source: np.ndarray, target: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Weighted similarity from source to target: the scale is the ratio of the spreads."""
    w = w / w.sum()
    ms, mt = w @ source, w @ target
    a, b = source - ms, target - mt
    u, _, vt = np.linalg.svd((b * w[:, None]).T @ a)
    r = u @ np.diag([1, 1, np.sign(np.linalg.det(u @ vt)) or 1]) @ vt
    scale = float(np.sqrt((w @ (b * b).sum(1)) / max(w @ (a * a).sum(1), 1e-24)))
    return scale, r, mt - scale * r @ ms


def _solve_rows(batches):
    """Fits from sums of coordinates about a batch's offsets, a row a batch."""
    s, t = ("sx", "sy", "sz"), ("tx", "ty", "tz")
    for g in batches:
        out = []
        for r in g.to_dict("records"):
            w = r["m_w"]
            ms, mt = np.array([r[f"m_{c}"] for c in s]) / w, np.array([r[f"m_{c}"] for c in t]) / w
            cov = np.array([[r[f"m_{a}{b}"] for b in s] for a in t]) / w - np.outer(mt, ms)
            u, _, vt = np.linalg.svd(cov)
            rot = u @ np.diag([1, 1, np.sign(np.linalg.det(u @ vt)) or 1]) @ vt
            scale = float(np.sqrt(max(r["m_tt"] / w - mt @ mt, 0.0) / max(r["m_ss"] / w - ms @ ms, 1e-24)))
            out.append((r["batch"], scale, rot.ravel(), mt - scale * rot @ ms, r["m_loss"]))
        yield pd.DataFrame(out, columns=["batch", "scale", "rotation", "translation", "loss"])


def _sums_fit(p: np.ndarray, w: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(scales, rotations, translations) of groups of rows that begin at ``starts``: the fit of ``_solve_rows``."""
    total = lambda x: np.add.reduceat(x, starts, axis=0)
    m = total(w)
    mean = total(w[:, None] * p) / m[:, None]
    s, t = p[:, :3], p[:, 3:]
    ms, mt = mean[:, :3], mean[:, 3:]
    cov = np.stack([total((w * t[:, i])[:, None] * s) for i in range(3)], 1) / m[:, None, None] - mt[:, :, None] * ms[:, None, :]
    u, _, vt = np.linalg.svd(cov)
    sign = np.sign(np.linalg.det(u @ vt))
    u[:, :, 2] *= np.where(sign == 0, 1, sign)[:, None]
    rot = u @ vt
    ss, tt = (total(w * (x * x).sum(1)) / m - (mx * mx).sum(1) for x, mx in ((s, ms), (t, mt)))
    scale = np.sqrt(np.maximum(tt, 0) / np.maximum(ss, 1e-24))
    return scale, rot, mt - scale[:, None] * np.einsum("nij,nj->ni", rot, ms)


def _fit_together(rounds: int, delta: float, tolerance: float):
    """``robust_fit`` of the whole batches in a table, side by side."""

    def of(g: pd.DataFrame) -> pd.DataFrame:
        names, code = np.unique(g.batch.to_numpy(), return_inverse=True)
        order = np.argsort(code, kind="stable")
        code, given = code[order], g.w.to_numpy(float)[order]
        p, w = g[list(AXES)].to_numpy(float)[order], np.maximum(given, 0.0) + 1e-300
        n = np.bincount(code)
        starts = np.cumsum(n) - n
        origin = np.add.reduceat(p, starts, axis=0) / n[:, None]
        p = p - origin[code]
        fit, last, open_ = list(_sums_fit(p, w, starts)), np.full(len(n), np.nan), np.arange(len(n))
        off = lambda p, at, f: np.linalg.norm(f[0][at, None] * np.einsum("nij,nj->ni", f[1][at], p[:, :3]) + f[2][at] - p[:, 3:], axis=1)
        for _ in range(rounds):
            if not len(open_):
                break
            some = np.isin(code, open_)
            x, v, at = p[some], w[some], np.searchsorted(open_, code[some])
            begin = np.cumsum(n[open_]) - n[open_]
            r = off(x, at, [f[open_] for f in fit])
            loss = np.add.reduceat(v * np.where(r <= delta, r * r / 2, delta * (r - delta / 2)), begin)
            new = _sums_fit(x, v * np.where(r <= delta, 1.0, delta / np.maximum(r, 1e-12)) + 1e-300, begin)
            go = ~(np.abs(last[open_] - loss) < tolerance * np.maximum(1.0, loss))
            open_ = open_[go]
            last[open_] = loss[go]
            for f, y in zip(fit, new, strict=True):
                f[open_] = y[go]
        r = off(p, code, fit)
        ranked = r[np.lexsort((r, code))]
        median = ranked[starts + (n - 1) // 2] / 2 + ranked[starts + n // 2] / 2
        scale, rot, move = fit
        move = move + origin[:, 3:] - scale[:, None] * np.einsum("nij,nj->ni", rot, origin[:, :3])
        mean = lambda x: np.add.reduceat(x, starts) / n
        return pd.DataFrame({
            "batch": names, "scale": scale, "rotation": list(rot.reshape(-1, 9)), "translation": list(move), "n": n, "mean_weight": mean(given),
            "mean_residual": mean(r), "median_residual": median, "max_residual": np.maximum.reduceat(r, starts),
        })

    return of


def robust_fit(d: DataFrame, rounds: int = 20, delta: float = 0.1, tolerance: float = 1e-9, few: int = 100_000, together: int = 100_000) -> DataFrame:
    """Huber-reweighted similarity of each batch, for batches of any size; on convergence the fit before the last one is returned.
    Rows of weight 0 or less count only in the residuals. Beside the fit: the number of correspondences, their mean weight, and
    the residuals' mean, exact median and maximum.

    Batches of up to ``together`` finite correspondences are dealt over tasks, each of which makes all rounds of its batches: the rows
    are shuffled once. The others, and those with missing or infinite values, are summed and solved round by round over the cluster."""
    tables = Tables(d.sparkSession)
    ok = finite(*(F.col(c).cast("double") for c in (*AXES, "w")))
    counts = tables.write(d.where("batch is not null").groupBy("batch").agg(F.count("*").alias("n"), F.min(ok).alias("ok")), "counts")
    large = counts.where((F.col("n") > together) | ~F.col("ok")).select("batch")
    total, others = counts.agg(F.sum("n")).first()[0] or 0, large.count()
    parts = max(1, -(-total // 200_000), min(32, -(-total // 5_000)))
    beside = F.broadcast(large) if others <= few else large
    small = d.where("batch is not null").select("batch", *(F.col(c).cast("double").alias(c) for c in (*AXES, "w")))
    small = (small.join(beside, "batch", "left_anti") if others else small).withColumn("_part", F.pmod(F.xxhash64("batch"), F.lit(parts))).repartition(parts, "_part")
    schema = f"batch {d.schema['batch'].dataType.simpleString()}, scale double, rotation array<double>, translation array<double>, n long, mean_weight double, mean_residual double, median_residual double, max_residual double"
    out = small.groupBy("_part").applyInPandas(_fit_together(rounds, delta, tolerance), schema)
    return out.unionByName(_fit_large(d.join(beside, "batch", "left_semi"), rounds, delta, tolerance, few)) if others else out


def _fit_large(d: DataFrame, rounds: int, delta: float, tolerance: float, few: int) -> DataFrame:
    """``robust_fit`` of any batches: each round sums weighted moments, before the shuffle, with the weights that the batch's fit gives,
    and solves a 3 x 3 problem a batch; batches settle one by one."""
    tables = Tables(d.sparkSession)
    axes = AXES
    w0 = F.greatest(F.col("w").cast("double"), F.lit(0.0)) + 1e-300
    means = d.groupBy("batch").agg(*(F.avg(c).alias(f"o_{c}") for c in axes), F.count("*").alias("n"), F.avg("w").alias("mean_weight"))
    means = tables.write(means, "means")
    small = means.count() <= few
    beside = lambda t: F.broadcast(t) if small else t  # noqa: E731  (a row a batch, counted)
    near = d.join(beside(means.select("batch", *(f"o_{c}" for c in axes))), "batch").select("batch", w0.alias("w"), *((F.col(c) - F.col(f"o_{c}")).alias(c) for c in axes))
    near = tables.write(near, "near")  # every round reads it
    fit_schema = "batch {0}, scale double, rotation array<double>, translation array<double>, loss double".format(d.schema["batch"].dataType.simpleString())
    fits = moments(near, F.lit(0.0).alias("m_loss")).mapInPandas(_solve_rows, fit_schema).drop("loss")
    state = tables.write(fits.select("*", F.lit(None).cast("double").alias("last"), F.lit(False).alias("done")), "fits")

    def _off() -> Column:
        moved = F.zip_with(rotate(F.col("rotation"), F.array("sx", "sy", "sz")), "translation", lambda a, b: F.col("scale") * a + b)
        return minus(moved, F.array("tx", "ty", "tz"))

    for _ in range(rounds):
        open_ = state.where("not done")
        if open_.isEmpty():
            break
        at = near.join(beside(open_.select("batch", "scale", "rotation", "translation")), "batch").select("batch", "w", *axes, norm(_off()).alias("r"))
        loss = F.when(F.col("r") <= delta, F.col("r") * F.col("r") / 2).otherwise(delta * (F.col("r") - delta / 2))
        weighted = at.withColumn("loss", F.col("w") * loss).withColumn("w", F.col("w") * F.when(F.col("r") <= delta, 1.0).otherwise(delta / F.greatest("r", F.lit(1e-12))) + 1e-300)
        new = moments(weighted, F.sum("loss").alias("m_loss")).mapInPandas(_solve_rows, fit_schema)
        s = state.join(new.select("batch", *(F.col(c).alias(f"n_{c}") for c in ("scale", "rotation", "translation", "loss"))), "batch", "left")
        settled = F.col("done") | F.coalesce(F.abs(F.col("last") - F.col("n_loss")) < tolerance * F.greatest(F.lit(1.0), F.col("n_loss")), F.lit(False))
        pick = lambda c: F.when(settled, F.col(c)).otherwise(F.col(f"n_{c}")).alias(c)
        s = s.select("batch", *map(pick, ("scale", "rotation", "translation")), F.when(settled, F.col("last")).otherwise(F.col("n_loss")).alias("last"), settled.alias("done"))
        state = tables.write(s, "fits")
    last = near.join(beside(state), "batch").select("batch", norm(_off()).alias("r"))
    stats = last.groupBy("batch").agg(F.avg("r").alias("mean_residual"), F.max("r").alias("max_residual"))
    stats = stats.join(exact_median(last, "r", ("batch",)).select("batch", F.col("median").alias("median_residual")), "batch", "left")
    # Back from offsets to the coordinates given: t = scale R (s - os) + shift + ot.
    at = lambda side: F.array(*(F.col(f"o_{side}{c}") for c in "xyz"))
    out = state.join(means, "batch").join(stats, "batch")
    turned = F.zip_with(rotate(F.col("rotation"), at("s")), at("t"), lambda a, b: b - F.col("scale") * a)
    shift = F.zip_with("translation", turned, lambda a, b: a + b)
    return out.select("batch", "scale", "rotation", shift.alias("translation"), "n", "mean_weight", "mean_residual", "median_residual", "max_residual")


def gate(d: DataFrame, checks: list[tuple[str, str, float]]) -> DataFrame:
    """``checks``: (name, column, limit), in order. Adds failed_checks, reason (the first) and passed; a value that is not
    finite fails."""
    failed = F.array_compact(F.array(*(F.when(~finite(F.col(c)) | (F.col(c) > limit), F.lit(name)) for name, c, limit in checks)))
    return d.withColumn("failed_checks", failed).withColumn("reason", F.get("failed_checks", F.lit(0))).withColumn("passed", F.size("failed_checks") == 0)
