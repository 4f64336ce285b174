"""Sliding forecast samples and their layouts (WIN1-WIN6)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from chronoloom.functions import arrays
from chronoloom.functions.calendar import from_micros, micros


def sliding_windows(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    values: Sequence[str],
    in_len: int,
    out_len: int,
    chunk: int = 1024,
) -> DataFrame:
    """WIN1: every stride-1 sample of a dense series, one row per (series, sample).

    ``sample_id`` is the position of the first input step.  The first value
    column gives ``inputs`` and ``target``; further columns give
    ``<name>_inputs`` and ``<name>_target``.

    A sample exists for every position between the first and the last row of a
    series; positions without a row are NULL in it.  Two rows of a series at one
    position are an error; rows without a position are left out.

    Each series is cut into chunks of ``chunk`` steps plus a halo of
    ``in_len + out_len - 1`` steps copied from the next chunk, so a long series
    spreads over many tasks and a task never holds more than one chunk.
    Samples stay arrays; nothing is exploded to single steps.  The input is read
    twice: stage it if it is costly.
    """
    width = in_len + out_len
    size = max(chunk, width)
    df = df.where(F.col(pos).isNotNull())
    first = F.floor(F.greatest(F.col(pos) - F.lit(width - 1), F.lit(0)) / size).cast("long")
    last = F.floor(F.col(pos) / size).cast("long")
    rows = df.select(*keys, F.col(pos).alias("_pos"), *values, F.explode(F.sequence(first, last)).alias("_chunk"))
    buffers = rows.groupBy(*keys, "_chunk").agg(F.sort_array(F.collect_list(F.struct("_pos", *values))).alias("_rows"))
    # every chunk between the ends of a series, also one that no row falls into
    ends = df.groupBy(*keys).agg(F.min(pos).alias("_lo"), F.max(pos).alias("_hi")).where(F.col("_hi") - F.col("_lo") + 1 >= width)
    chunks = ends.withColumn("_chunk", F.explode(F.sequence(
        F.floor(F.col("_lo") / size).cast("long"), F.floor((F.col("_hi") - (width - 1)) / size).cast("long"))))
    same = [chunks[k].eqNullSafe(buffers[k]) for k in keys]  # NULL is a series like any other
    parts = chunks.join(buffers, [*same, chunks["_chunk"] == buffers["_chunk"]], "left").select(
        *[chunks[k] for k in keys], chunks["_chunk"], "_lo", "_hi", "_rows")
    begin = F.greatest(F.col("_chunk") * size, F.col("_lo"))
    end = F.least(F.col("_chunk") * size + (size + width - 2), F.col("_hi"))
    types = dict(df.dtypes)

    def lane(v: str):
        none = F.lit(None).cast(types[v])
        gap = lambda n: F.array_repeat(none, n.cast("int"))
        step = F.transform("_rows", lambda r, i: F.concat(F.array(r[v]), gap(
            F.coalesce(F.get("_rows", i + 1)["_pos"], r["_pos"] + 1) - r["_pos"] - 1)))
        whole = F.col("_end") - F.col("_start") + 1 == F.size("_rows")
        placed = F.concat(gap(F.element_at("_rows", 1)["_pos"] - F.col("_start")), F.flatten(step),
                          gap(F.col("_end") - F.element_at("_rows", -1)["_pos"]))
        return F.when(F.col("_rows").isNull(), gap(F.col("_end") - F.col("_start") + 1)).when(whole, F.col(f"_rows.{v}")).otherwise(placed)

    twice = F.size(F.array_distinct(F.transform("_rows", lambda r: r["_pos"]))) < F.size("_rows")
    parts = parts.select(*keys, begin.alias("_start"), end.alias("_end"), F.when(
        twice, F.raise_error(F.lit("two rows of a series have the same position"))).otherwise(F.col("_rows")).alias("_rows"))
    buffers = parts.select(*keys, "_start", (F.col("_end") - F.col("_start") + 1).alias("_size"), *[lane(v).alias(f"_lane_{v}") for v in values])

    def sample(i):
        fields = [(F.col("_start") + i).cast("long").alias("sample_id")]
        for n, v in enumerate(values):
            lane = F.col(f"_lane_{v}")
            prefix = "" if n == 0 else f"{v}_"
            fields.append(F.slice(lane, i + 1, F.lit(in_len)).alias(f"{prefix}inputs"))
            fields.append(F.slice(lane, i + F.lit(in_len + 1), F.lit(out_len)).alias(f"{prefix}target"))
        return F.struct(*fields)

    count = F.least(F.lit(size), F.col("_size") - width + 1)
    samples = F.transform(F.sequence(F.lit(0), (count - 1).cast("int")), sample)
    return buffers.where(count > 0).select(*keys, F.inline(samples))


def explode_samples(samples: DataFrame, keys: Sequence[str], column: str = "target", name: str = "target") -> DataFrame:
    """One row per step of a window array, 1-based ``step``."""
    return samples.select(*keys, F.posexplode(column).alias("_p", name)).withColumn(
        "step", F.col("_p") + 1).drop("_p")


def last_window(
    df: DataFrame, keys: Sequence[str], pos: str, ts: str, value: str, in_len: int, out_len: int, step_us: int,
    last_pos: int | None = None,
) -> DataFrame:
    """WIN2: the last ``in_len`` steps of each series and its blank future stamps.

    A series ends at its last value, or all end at ``last_pos``, which is then a
    filter that prunes the scan.  Steps stand at their place, absent ones are
    NULL.  A task keeps ``in_len`` rows of a series before anything is shuffled.
    """
    if last_pos is not None:
        tail = df.where((F.col(pos) > last_pos - in_len) & (F.col(pos) <= last_pos)).withColumn("_end", F.lit(last_pos).cast("long"))
    else:
        newest = Window.partitionBy(*keys).orderBy(F.col(pos).desc())
        tail = df.where(F.col(value).isNotNull()).withColumn("_back", F.row_number().over(newest)).where(F.col("_back") <= in_len)
        tail = tail.withColumn("_end", F.max(pos).over(Window.partitionBy(*keys))).where(F.col(pos) > F.col("_end") - in_len)
    slot = (F.col(pos) - F.col("_end") + in_len - 1).cast("int")
    rows = tail.groupBy(*keys).agg(
        *[F.max(F.when(slot == k, F.col(value))).alias(f"_v{k}") for k in range(in_len)],
        F.max(micros(ts) + (F.col("_end") - F.col(pos)) * F.lit(step_us)).alias("_last"))
    return rows.select(
        *keys,
        F.array(*[F.col(f"_v{k}") for k in range(in_len)]).alias("inputs"),
        F.transform(
            F.sequence(F.lit(1), F.lit(out_len)),
            lambda k: from_micros(F.col("_last") + k * F.lit(step_us))).alias("future_ts"),
    )


def with_patches(samples: DataFrame, column: str, length: int, size: int, step: int, name: str = "patches") -> DataFrame:
    """WIN3."""
    return samples.withColumn(name, arrays.patches(column, length, size, step))


def decoder_layout(samples: DataFrame, in_len: int, out_len: int, start_len: int, marks: Sequence[str] = ()) -> DataFrame:
    """WIN4: encoder input, decoder input and the shifted time features of both."""
    out = samples.withColumn("x_enc", F.col("inputs")).withColumn(
        "x_dec", arrays.decoder_values("inputs", in_len, out_len, start_len))
    for m in marks:
        out = out.withColumn(f"{m}_mark_enc", F.transform(F.col(f"{m}_inputs"), lambda x: x - 0.5))
        out = out.withColumn(
            f"{m}_mark_dec", arrays.decoder_marks(f"{m}_inputs", f"{m}_target", in_len, start_len))
    return out


def random_samples(samples: DataFrame, keys: Sequence[str], n: int, seed: int = 0) -> DataFrame:
    """WIN5: ``n`` samples, the same ones on every run, any partitioning and in any engine that knows MD5."""
    order = F.md5(F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys], F.lit(str(seed))).cast("binary"))
    return samples.orderBy(order, *keys).limit(n)


def flatten_windows(samples: DataFrame, column: str = "inputs") -> DataFrame:
    """WIN6: one univariate window per row, channels side by side no more."""
    return samples.select("sample_id", "node", F.col(column).alias("window"))
