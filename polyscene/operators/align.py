"""Alignment of motion traces by lagged correlation, from per-index rows.

Lags are generated on the target's side and joined on the shifted index; the lag range
comes from a modality's prior, so rows grow by a constant factor. For native frame
rates `frame_lags` gives the same rows from packed traces, one a recording, by FFT.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import dims
from ..sources.store import shipped

FLAT = 1e-6


def motion_energy(frames: DataFrame, key: list[str]) -> DataFrame:
    """key, idx, value: mean absolute difference to the frame before. frames: key, idx, value."""
    w = Window.partitionBy(*key).orderBy("idx")
    return frames.withColumn("value", F.abs(F.col("value") - F.lag("value").over(w))).filter("value is not null")


def standardized(trace: DataFrame, key: list[str]) -> DataFrame:
    """Values clipped to p5 and p95, centred on the median and scaled by the median deviation, else by deviation, else 0."""
    bounds = trace.groupBy(*key).agg(F.percentile("value", F.array(F.lit(0.05), F.lit(0.95))).alias("_p"))
    rows = trace.join(bounds, key).withColumn("_c", F.least(F.greatest("value", F.col("_p")[0]), F.col("_p")[1]))
    middle = rows.groupBy(*key).agg(F.percentile("_c", 0.5).alias("_m"), F.avg("_c").alias("_avg"), F.stddev_pop("_c").alias("_sd"))
    rows = rows.join(middle, key)
    mad = rows.groupBy(*key).agg(F.percentile(F.abs(F.col("_c") - F.col("_m")), 0.5).alias("_mad"))
    rows = rows.join(mad, key)
    z = F.when(F.col("_mad") > FLAT, (F.col("_c") - F.col("_m")) / (F.col("_mad") * 1.4826)).when(F.col("_sd") > FLAT, (F.col("_c") - F.col("_avg")) / F.col("_sd")).otherwise(0.0)
    return rows.select(*[c for c in trace.columns if c != "value"], z.alias("value"))


def smoothing_window(fps: float, n: int | None = None, seconds: float = 0.35) -> int:
    """Odd width of the moving average; 1 if a trace of n values is too short for one."""
    w = max(3, int(round(seconds * fps)))
    w += w % 2 == 0
    return w if n is None else max(1, min(w, n if n % 2 else n - 1)) if n >= 3 else 1


def smoothed(trace: DataFrame, key: list[str], width: int) -> DataFrame:
    """Moving sum over width, divided by width at the edges too."""
    h = width // 2
    w = Window.partitionBy(*key).orderBy("idx").rowsBetween(-h, h)
    return trace.withColumn("value", F.sum("value").over(w) / width)


def lag_correlations(reference: DataFrame, targets: DataFrame, key: list[str], lags: int) -> DataFrame:
    """key, lag, n, correlation of target.idx = reference.idx + lag; null with under 3 values or a flat side.

    reference holds one trace a sample: it has idx, value and those columns of the key that tell samples and sides apart,
    and a target meets the reference of its own sample alone.
    """
    own = [k for k in key if k in reference.columns]
    moved = targets.withColumn("lag", F.explode(F.sequence(F.lit(-lags), F.lit(lags)))).withColumn("at", F.col("idx") - F.col("lag"))
    ref = reference.select(*own, F.col("idx").alias("at"), F.col("value").alias("ref"))
    both = moved.join(ref, [*own, "at"])
    flat = (F.count("*") < 3) | (F.stddev_pop("ref") < FLAT) | (F.stddev_pop("value") < FLAT)
    return both.groupBy(*key, "lag").agg(F.count("*").alias("n"), F.when(~flat, F.corr("ref", "value")).alias("correlation")).filter("correlation is not null")


def scored_lags(table: DataFrame, fps: float, shorter: Column, modality: Column | None = None, priors: dict | None = None) -> DataFrame:
    """table with offset_seconds, overlap_ratio and score: correlation, a little for overlap, less for distance from the expected offset.

    shorter: the length of the shorter of the two traces. Each modality has its own prior; lags beyond its most
    seconds go. Without a modality column, or for one without a prior, only correlation and overlap count.
    """
    known = dims.PRIORS if priors is None else priors
    pick = lambda i, default: dims.choose(modality, {m: p[i] for m, p in known.items()}, default) if modality is not None else F.lit(default)
    most, expected, scale, weight = pick(0, 1e9), pick(1, 0.0), pick(2, 5.0), pick(3, 0.0)
    offset, ratio = F.col("lag") / F.lit(fps), F.col("n") / F.greatest(shorter, F.lit(1))
    far = F.least(F.lit(1.0), F.abs(offset - expected) / scale)
    out = table.withColumn("offset_seconds", offset).withColumn("overlap_ratio", ratio).withColumn("score", F.col("correlation") + 0.12 * ratio - weight * far)
    return out.filter(F.abs("offset_seconds") <= most)


def confidence(correlation: Column, margin: Column) -> Column:
    return F.when((correlation >= 0.80) | ((correlation >= 0.55) & (margin >= 0.02)), F.lit("high")).when(correlation >= 0.30, F.lit("medium")).otherwise("low")


def selected_offsets(scored: DataFrame, key: list[str], digits: int = 6) -> DataFrame:
    """The lag with the best score of each key, its margin over the second-best correlation, and its label."""
    s, c = F.round("score", digits), F.round("correlation", digits)
    by_score = Window.partitionBy(*key).orderBy(s.desc(), "lag")
    by_corr = Window.partitionBy(*key).orderBy(c.desc(), "lag")
    rows = scored.withColumn("_s", F.row_number().over(by_score)).withColumn("_c", F.row_number().over(by_corr))
    best, second = F.max(F.when(F.col("_c") == 1, F.col("lag"))), F.max(F.when(F.col("_c") == 2, c))
    picked = rows.groupBy(*key).agg(F.max(F.when(F.col("_s") == 1, F.col("lag"))).alias("lag"), F.max(F.when(F.col("_s") == 1, c)).alias("correlation"), F.max(F.when(F.col("_s") == 1, F.col("offset_seconds"))).alias("offset_seconds"), best.alias("raw_best_lag"), second.alias("_second"))
    same = F.col("lag") == F.col("raw_best_lag")
    margin = F.when(same & F.col("_second").isNotNull(), F.round(F.col("correlation") - F.col("_second"), digits)).otherwise(0.0)
    out = picked.withColumn("peak_margin", margin).withColumn("selected_by", F.when(same, F.lit("best_correlation")).otherwise("modality_prior"))
    return out.withColumn("confidence_label", confidence(F.col("correlation"), F.col("peak_margin"))).drop("_second")


def top_candidates(scored: DataFrame, key: list[str], most: int = 8) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(F.round("score", 6).desc(), "lag")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)


def overlap(reference: Column, target: Column, offset: Column) -> list[Column]:
    """reference_start, reference_end, target_start, target_end of a shift."""
    r, t = F.greatest(F.lit(0.0), -offset), F.greatest(F.lit(0.0), offset)
    long = F.greatest(F.lit(0.0), F.least(reference - r, target - t))
    return [F.round(x, 6).alias(n) for x, n in ((r, "reference_start"), (r + long, "reference_end"), (t, "target_start"), (t + long, "target_end"))]


def shared_window(samples: DataFrame, targets: DataFrame, key: list[str]) -> DataFrame:
    """key, window_start, window_end of the reference that all targets cover. samples: key, duration; targets: key, offset_seconds, duration."""
    reach = targets.groupBy(*key).agg(F.max(-F.col("offset_seconds")).alias("_from"), F.min(F.col("duration") - F.col("offset_seconds")).alias("_to"))
    rows = samples.join(reach, key, "left")
    start, end = F.greatest(F.lit(0.0), "_from"), F.least("duration", "_to")
    return rows.select(*key, F.round(start, 6).alias("window_start"), F.round(F.greatest(start, end), 6).alias("window_end"))


def plotted(trace: DataFrame, key: list[str]) -> DataFrame:
    """Values between p1 and p99 as 0 to 1, clipped; between the least and the largest if those are equal; else 0."""
    bounds = trace.groupBy(*key).agg(F.percentile("value", F.array(F.lit(0.01), F.lit(0.99))).alias("_p"), F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    rows = trace.join(bounds, key)
    wide = F.col("_p")[1] > F.col("_p")[0]
    low, high = F.when(wide, F.col("_p")[0]).otherwise(F.col("_lo")), F.when(wide, F.col("_p")[1]).otherwise(F.col("_hi"))
    scaled = F.when(high > low, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("value") - low) / (high - low)))).otherwise(0.0)
    return rows.select(*trace.columns[: trace.columns.index("value")], scaled.alias("value"), *trace.columns[trace.columns.index("value") + 1 :])


# Messages about traces that cannot be aligned, or were aligned with doubt.
FLAT_TRACE = "Motion energy trace is too short or too flat for reliable alignment."
NO_FPS = "Could not determine FPS for one or both videos."
NO_OVERLAP = "No valid cross-correlation overlap was available."
BY_PRIOR = "Selected offset uses modality prior because the raw highest-correlation lag was less plausible."


def alignment(videos: DataFrame, picked: DataFrame, key: list[str], modalities: list[str]) -> DataFrame:
    """A row for every sample and target modality: offset, label, windows, how it was selected, and warnings.

    videos: key, modality, file, opened, fps, duration, flat (the reference's modality is rgb); picked: as from
    selected_offsets, by key and modality. Absent, unopened, rateless and flat videos have no offset.
    """
    ref = videos.filter("modality = 'rgb'").select(*key, F.col("opened").alias("r_opened"), F.col("fps").alias("r_fps"), F.col("duration").alias("r_duration"), F.col("flat").alias("r_flat"))
    grid = videos.select(*key).distinct().withColumn("modality", F.explode(F.array(*map(F.lit, modalities))))
    rows = grid.join(videos, [*key, "modality"], "left").join(ref, key, "left").join(picked, [*key, "modality"], "left")
    fps_off = F.abs(F.col("fps") - F.col("r_fps")) > 0.01
    state = (
        F.when(F.col("file").isNull(), "missing")
        .when(F.col("r_fps").isNull() | ~F.coalesce("r_opened", F.lit(False)), "no_reference")
        .when(~F.coalesce("opened", F.lit(False)), "unopened")
        .when(~F.coalesce((F.col("fps") > 0) & (F.col("r_fps") > 0), F.lit(False)), "no_fps")
        .when(F.coalesce("flat", F.lit(True)) | F.coalesce("r_flat", F.lit(True)), "flat")
        .when(F.col("lag").isNull(), "no_overlap")
        .otherwise("aligned")
    )
    rows = rows.withColumn("state", state)
    done = F.col("state") == "aligned"
    offset = F.when(done, F.col("offset_seconds"))
    beyond = (F.col("selected_by") == "modality_prior") & (F.abs(F.col("lag") - F.col("raw_best_lag")) / F.least("fps", "r_fps") > 0.5)
    # The messages here.
    warnings = F.array_compact(F.array(
        F.when(F.col("state") == "missing", F.concat(F.lit("No "), F.upper("modality"), F.lit(" video for this sample."))),
        F.when(F.col("state") == "no_reference", F.lit("No usable RGB reference video for this sample.")),
        F.when(F.col("state") == "unopened", F.concat(F.lit("Could not open "), F.col("modality"), F.lit(" video: "), F.col("file"))),
        F.when(F.col("state") == "no_fps", F.lit(NO_FPS)),
        F.when(F.col("state").isin("aligned", "flat", "no_overlap") & fps_off, F.format_string("FPS differs between videos: RGB=%.3f, %s=%.3f. Offset is estimated using the lower FPS as the lag unit.", "r_fps", "modality", "fps")),
        F.when(F.col("state") == "flat", F.lit(FLAT_TRACE)),
        F.when(F.col("state") == "no_overlap", F.lit(NO_OVERLAP)),
        F.when(done & beyond, F.lit(BY_PRIOR)),
    ))
    windows = [F.when(done, c).alias(n) for c, n in zip(overlap(F.col("r_duration"), F.col("duration"), F.col("offset_seconds")), ("reference_start", "reference_end", "target_start", "target_end"), strict=True)]
    return rows.select(
        *key, "modality", "file", "duration", offset.alias("offset_seconds"), F.when(done, F.col("correlation")).alias("correlation"),
        F.when(done, F.col("confidence_label")).otherwise("low").alias("confidence_label"),
        F.when(done, F.col("selected_by")).when(F.col("state") == "missing", F.lit("missing")).otherwise("unavailable").alias("selected_by"), *windows, warnings.alias("warnings"),
    )


def exports(samples: DataFrame, aligned: DataFrame, key: list[str], needed: tuple[str, ...] = ("event", "depth", "ir")) -> DataFrame:
    """key, status (exported or skipped), reason, start, length: the window that reference and all needed targets share.

    samples: key, file, duration, exists of the reference; aligned: key, modality, offset_seconds, duration, file, exists.
    """
    short = aligned.filter(F.col("modality").isin(*needed))
    fields = F.struct("offset_seconds", "duration", "file", "exists")
    rows = samples.join(short.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("modality", fields))).alias("t")), key, "left")
    get = lambda m: F.try_element_at("t", F.lit(m))
    # The messages here.
    problems = [
        F.when(~F.coalesce("exists", F.lit(False)), F.concat(F.lit("RGB reference file does not exist: "), F.coalesce("file", F.lit("")))),
        F.when(~F.coalesce(F.col("duration") > 0, F.lit(False)), F.lit("RGB reference_duration_seconds must be positive.")),
    ]
    for m in needed:
        x, name = get(m), m.upper()
        problems += [
            F.when(x.isNull(), F.lit(f"Missing {name} alignment.")),
            F.when(x["offset_seconds"].isNull() | x["duration"].isNull(), F.lit(f"{name} alignment must include offset_seconds and duration_seconds.")),
            F.when(~F.coalesce(x["exists"], F.lit(False)), F.concat(F.lit(f"{name} file does not exist: "), F.coalesce(x["file"], F.lit("")))),
        ]
    start = F.greatest(F.lit(0.0), *[-get(m)["offset_seconds"] for m in needed])
    end = F.least(F.col("duration"), *[get(m)["duration"] - get(m)["offset_seconds"] for m in needed])
    problems.append(F.when(~F.coalesce(end - start > 0, F.lit(False)), F.lit("No positive RGB/EVENT/DEPTH/IR overlap window is available.")))
    reason = F.coalesce(*problems)
    fine = reason.isNull()
    return rows.select(*key, F.when(fine, "exported").otherwise("skipped").alias("status"), reason.alias("reason"), F.when(fine, F.round(start, 6)).alias("start"), F.when(fine, F.round(end - start, 6)).alias("length"))


def consensus(rows: DataFrame, key: list[str], candidates: DataFrame) -> DataFrame:
    """Offsets far from the infrared anchor with low confidence give way to the best near candidate, or to the anchor.

    rows: key, modality, offset_seconds, correlation, confidence_label; candidates: key, modality, offset_seconds, score.
    """
    ir = F.max(F.when((F.col("modality") == "ir") & F.col("confidence_label").isin("high", "medium") & (F.abs("offset_seconds") <= 1.0), F.col("offset_seconds")))
    anchored = rows.join(rows.groupBy(*key).agg(F.coalesce(ir, F.lit(0.0)).alias("anchor")), key)
    reach = F.when(F.col("modality") == "depth", 3.0).when(F.col("modality") == "event", 5.0)
    floor = F.when(F.col("modality") == "depth", 0.55).otherwise(0.30)
    odd = reach.isNotNull() & F.col("offset_seconds").isNotNull() & (F.abs(F.col("offset_seconds") - F.col("anchor")) > reach) & ((F.col("confidence_label") == "low") | F.col("correlation").isNull() | (F.col("correlation") < floor))
    flagged = anchored.withColumn("reach", reach).withColumn("rejected", F.coalesce(odd, F.lit(False)))
    near = flagged.filter("rejected").select(*key, "modality", "anchor", "reach").join(candidates.withColumnRenamed("offset_seconds", "near"), [*key, "modality"]).filter("abs(near - anchor) <= reach")
    best = near.groupBy(*key, "modality").agg(F.max_by("near", F.struct(F.col("score"), -F.col("near"))).alias("near"))
    out = flagged.join(best, [*key, "modality"], "left")
    offset = F.when(F.col("rejected"), F.coalesce("near", "anchor")).otherwise(F.col("offset_seconds"))
    label = F.when(~F.col("rejected"), F.col("confidence_label")).when(F.col("near").isNotNull(), F.lit("medium")).otherwise("low")
    return out.select(*key, "modality", offset.alias("offset_seconds"), label.alias("confidence_label"), F.when(F.col("rejected"), F.col("offset_seconds")).alias("rejected_offset_seconds"))


#: Overlaps below so many frames, or variances below so much, are computed frame by frame.
SHORT, STILL = 64, 1e-8


def dense(idx: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values less their mean from the first to the last index, 0 where there is none; and where there is one."""
    out, there = np.zeros(int(idx[-1] - idx[0]) + 1), np.zeros(int(idx[-1] - idx[0]) + 1, bool)
    out[idx - idx[0]], there[idx - idx[0]] = value - value.mean(), True
    return out, there


def crossed(a: np.ndarray, b: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """The sum of a[i] * b[i + s] for each shift s, by FFT."""
    size = 1 << int(len(a) + len(b)).bit_length()
    whole = np.fft.irfft(np.conj(np.fft.rfft(a, size)) * np.fft.rfft(b, size), size)
    return whole[shifts % size]


def windowed(x: np.ndarray, from_: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Sums of x between places, from its prefix sums in extended precision."""
    prefix = np.concatenate([[0], np.cumsum(x, dtype=np.longdouble)])
    return prefix[to] - prefix[from_]


def correlated(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], lags: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """lag, n, correlation for index and value of reference and target, for the lags at which both vary.

    All lags at once: products by FFT; means and deviations by prefix sums, or, where frames are missing, by FFT of
    what is there. a and b: by index, each index once.
    """
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    if not len(a[0]) or not len(b[0]):
        return none
    (x, here), (y, there) = dense(*a), dense(*b)
    apart = int(b[0][0] - a[0][0])
    shifts = np.arange(max(-lags - apart, 1 - len(x)), min(lags - apart, len(y) - 1) + 1)
    if not len(shifts):
        return none
    if here.all() and there.all():
        from_, to = np.maximum(0, -shifts), np.minimum(len(x), len(y) - shifts)
        n = to - from_
        sums = [windowed(x, from_, to), windowed(x * x, from_, to), windowed(y, from_ + shifts, to + shifts), windowed(y * y, from_ + shifts, to + shifts)]
    else:
        n = np.rint(crossed(here.astype(float), there.astype(float), shifts)).astype(np.int64)
        sums = [crossed(x, there.astype(float), shifts), crossed(x * x, there.astype(float), shifts), crossed(here.astype(float), y, shifts), crossed(here.astype(float), y * y, shifts)]
    many = np.maximum(n, 1)
    mx, my = sums[0] / many, sums[2] / many
    vx, vy = np.maximum(sums[1] / many - mx * mx, 0), np.maximum(sums[3] / many - my * my, 0)
    cov = crossed(x, y, shifts) / many - mx * my
    with np.errstate(divide="ignore", invalid="ignore"):
        out = np.asarray(cov / np.sqrt(vx * vy), float)
    fine = (n >= 3) & (np.sqrt(vx) >= FLAT) & (np.sqrt(vy) >= FLAT)
    for k in np.flatnonzero((n >= 3) & ((n < SHORT) | (vx < STILL) | (vy < STILL))):
        s = int(shifts[k])
        lo, hi = max(0, -s), min(len(x), len(y) - s)
        both = here[lo:hi] & there[lo + s : hi + s]
        u, v = x[lo:hi][both], y[lo + s : hi + s][both]
        fine[k] = u.std() >= FLAT and v.std() >= FLAT
        out[k] = ((u - u.mean()) * (v - v.mean())).mean() / (u.std() * v.std()) if fine[k] else 0.0
    return shifts[fine] + apart, n[fine], out[fine]


def lag_table(traces: DataFrame, lags: int) -> DataFrame:
    """key, lag, n, correlation for packed traces (key, reference and target arrays without gaps)."""

    def run(frames):
        for f in frames:
            for key, a, b in zip(f["key"], f["reference"], f["target"], strict=True):
                lag, n, c = correlated(*[(np.arange(len(x)), np.asarray(x, float)) for x in (a, b)], lags)
                yield pd.DataFrame({"key": [key] * len(lag), "lag": lag, "n": n, "correlation": c})

    shipped(traces.sparkSession)
    return traces.select("key", "reference", "target").mapInPandas(run, "key string, lag int, n bigint, correlation double")


def frame_lags(reference: DataFrame, targets: DataFrame, key: list[str], lags: int) -> DataFrame:
    """lag_correlations at frame rates: the same rows, from one packed trace a recording instead of a row a frame and lag.

    A recording's frames are in memory at once, some 16 bytes each; frames may be missing, each is there once, and null
    values are not there.
    """
    shipped(targets.sparkSession)
    own = [k for k in key if k in reference.columns]
    packed = lambda df, by, name: df.filter("idx is not null and value is not null").groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col("idx").cast("long").alias("idx"), F.col("value").cast("double").alias("value")))).alias(name))
    left, right = packed(targets, key, "_target"), packed(reference.withColumn("_one", F.lit(1)), own or ["_one"], "_reference")
    rows = left.join(right.drop("_one"), own) if own else left.withColumn("_one", F.lit(1)).join(right, "_one").drop("_one")
    rows = rows.select(*key, *[F.col(f"{c}.{x}").alias(f"{c}_{x}") for c in ("_target", "_reference") for x in ("idx", "value")])
    schema = T.StructType([*(rows.schema[k] for k in key), T.StructField("lag", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("correlation", T.DoubleType())])
    width = len(key)

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                ti, tv, ri, rv = (b.column(width + c)[i].values.to_numpy(zero_copy_only=False) for c in range(4))
                lag, n, c = correlated((ri, rv), (ti, tv), lags)
                of = pa.array([i] * len(lag), pa.int64())
                yield pa.RecordBatch.from_arrays([*(b.column(k).take(of) for k in range(width)), pa.array(lag, pa.int32()), pa.array(n, pa.int64()), pa.array(c, pa.float64())], schema.names)

    return rows.mapInArrow(run, schema)


def priors() -> dict[str, tuple[float, float, float, float]]:
    return dims.PRIORS
