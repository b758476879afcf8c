"""Sound, frames and boxes as rows: what of the media work is arithmetic on columns or arrays."""

from __future__ import annotations

import io
import wave

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WAV = "path string, rate int, channels int, seconds double, peak double, error string"


def wav_info(files: DataFrame) -> DataFrame:
    """Rate, channels, length and peak of PCM files (path, content); a reason for those that aren't."""

    def run(frames):
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    with wave.open(io.BytesIO(bytes(content or b""))) as w:
                        pcm = np.frombuffer(w.readframes(w.getnframes()), "<i2") if w.getsampwidth() == 2 else np.zeros(0, np.int16)
                        rows.append((path, w.getframerate(), w.getnchannels(), w.getnframes() / w.getframerate(), float(np.abs(pcm.astype(np.int32)).max(initial=0)), None))
                except (wave.Error, EOFError, ZeroDivisionError) as e:
                    rows.append((path, None, None, None, None, str(e) or type(e).__name__))
            yield pd.DataFrame(rows, columns=["path", "rate", "channels", "seconds", "peak", "error"])

    return files.select("path", "content").mapInPandas(run, WAV)


def caption_ready(rate: Column, channels: Column, seconds: Column) -> Column:
    """16 kHz, one channel, 30 s at most."""
    return (rate == 16000) & (channels == 1) & (seconds <= 30.0)


def element_stats(rows: DataFrame, key: str, values: str) -> DataFrame:
    """(key, pos, mean, std, median) of each element over the arrays of a key: frames of one clip. Elements
    are summed as rows, so neither a long stack nor a large frame has to fit a task."""
    x = rows.select(key, F.posexplode(values).alias("pos", "x"))
    return x.groupBy(key, "pos").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.median("x").alias("median"))


def frame_percentiles(rows: DataFrame, key: str, values: str, shares=(0.01, 0.55, 0.58, 0.99, 0.992, 0.997)) -> DataFrame:
    """Percentiles of the values of one frame, in its row."""
    ordered = F.array_sort(F.transform(values, lambda x: x.cast("double")))

    def at(s: float) -> Column:
        place = (F.size("ordered") - 1) * F.lit(float(s))
        low = F.floor(place).cast("int")
        a, b = F.get("ordered", low), F.get("ordered", F.least(low + 1, F.size("ordered") - 1))
        return a + (b - a) * (place - low)

    return rows.withColumn("ordered", ordered).select(key, *[at(s).alias(f"p{str(s).replace('.', '_')}") for s in shares])


def scaled_box(x: Column, y: Column, w: Column, h: Column, from_size: tuple[int, int], to_size: tuple[int, int]) -> Column:
    """M5: a box on another resolution, cut at its edges."""
    fx, fy = to_size[0] / from_size[0], to_size[1] / from_size[1]
    left, top = F.greatest(F.lit(0.0), x * fx), F.greatest(F.lit(0.0), y * fy)
    return F.struct(left.alias("x"), top.alias("y"), F.least(w * fx, F.lit(float(to_size[0])) - left).alias("w"), F.least(h * fy, F.lit(float(to_size[1])) - top).alias("h"))


def wide_range(transfer: Column, pixels: Column) -> Column:
    """Is the picture HDR or of ten bits?"""
    return F.coalesce(F.lower(transfer).isin("smpte2084", "arib-std-b67"), F.lit(False)) | F.coalesce(F.lower(pixels).rlike("10(le|be)?$"), F.lit(False))


def sample_rate(frames: Column, seconds: Column) -> Column:
    """D5."""
    return F.coalesce(F.try_divide(frames.cast("double"), seconds), F.lit(0.0))


def milliseconds(t: Column) -> Column:
    """Seconds rounded to three digits by their product with 1000, as SQL engines do; F.round(t, 3) goes by the
    decimal digits and makes 258.1 of 258.0995, whose product is 258099.49999999997."""
    return F.round(t * 1000.0) / 1000.0


def segment_rows(windows: DataFrame, has_frames: Column, n_frames: int) -> DataFrame:
    """Modality and evenly spread frame times of window rows (start_sec, end_sec). The end is rounded last, as
    a column of its own step: frame times follow from the end as given."""
    start, end = F.col("start_sec"), F.col("end_sec")
    step = (end - start) / max(1, n_frames)
    times = F.transform(F.sequence(F.lit(0), F.lit(n_frames - 1)), lambda i: milliseconds(start + step * i))
    out = windows.withColumn("frame_times", F.when(has_frames, times)).withColumn("modality", F.when(has_frames, "frames").otherwise("audio"))
    return out.withColumn("end_sec", milliseconds(end))


# Frames and pixels of each rung of the budget ladder.
BUDGETS = {"full": (80, 256000), "focus": (80, 320000), "ocr": (50, 600000), "embedding": (64, 224000)}


def budgets(spark) -> DataFrame:
    return spark.createDataFrame([(stage, 0, *b) for stage, b in BUDGETS.items()] + [("full", 1, 64, 224000)], "stage string, rung int, frames int, pixels int")


def budget_for(rows: DataFrame, ladder: DataFrame, cap: float = 8.0) -> DataFrame:
    """The rung of (stage, rung, measured): one further down where the measured use is above the cap; rows
    whose ladder has no such rung come back with nulls and `exhausted`."""
    wanted = rows.withColumn("rung", F.when(F.col("measured") > cap, F.col("rung") + 1).otherwise(F.col("rung")))
    return wanted.join(ladder, ["stage", "rung"], "left").withColumn("exhausted", F.col("frames").isNull())
