"""Fixed settings: sensor indicators, cleaning strategies, prepared datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# Physical range and rounding of each sensor indicator.
# (original name, indicator, unit, decimals, min, max, interpolation)
INDICATORS = [
    ("水温", "water_temp", "°C", 1, 0.0, 50.0, "cubic"),
    ("pH", "ph", "", 2, 0.0, 14.0, "linear"),
    ("溶解氧", "dissolved_oxygen", "mg/L", 2, 0.0, 20.0, "cubic"),
    ("高锰酸盐指数", "permanganate_index", "mg/L", 2, 0.0, 50.0, "cubic"),
    ("氨氮", "ammonia_nitrogen", "mg/L", 3, 0.0, 10.0, "cubic"),
    ("总磷", "total_phosphorus", "mg/L", 3, 0.0, 5.0, "cubic"),
    ("总氮", "total_nitrogen", "mg/L", 2, 0.0, 20.0, "cubic"),
    ("电导率", "conductivity", "μS/cm", 1, 0.0, 2000.0, "linear"),
    ("浊度", "turbidity", "NTU", 1, 0.0, 1000.0, "cubic"),
]
DEFAULT_DECIMALS = 4

# Shortest run of missing steps that is removed, z-score limit and
# smallest share of data (kept for completeness; no rule reads it).
STRATEGIES = [
    ("conservative", 50, 3.0, 0.3),
    ("aggressive", 30, 2.5, 0.5),
    ("segmented", 100, 3.5, 0.2),
]

# Encodings tried in this order, with the name Spark's reader knows.
ENCODINGS = [("utf-8", "UTF-8"), ("gbk", "GBK"), ("gb2312", "GB2312"), ("utf-8-sig", "UTF-8"), ("latin-1", "ISO-8859-1")]

# Windows, split, scaling and metrics of the prepared datasets.
_TRAFFIC = ["MAE", "RMSE", "MAPE"]
_LONG = ["MAE", "MSE"]
_NAN = float("nan")
# (datasets, input, output, ratio, norm each, rescale, metrics, null value, steps per day, features, index features)
DATASETS = [
    (["METR-LA", "PEMS-BAY"], 12, 12, [0.7, 0.1, 0.2], False, True, _TRAFFIC, 0.0, 288.0, ["tod", "dow"], []),
    (["PEMS03", "PEMS04", "PEMS07", "PEMS08"], 12, 12, [0.6, 0.2, 0.2], False, True, _TRAFFIC, 0.0, 288.0,
     ["tod", "dow"], ["tod", "dow"]),
    (["CA", "GBA", "GLA", "SD"], 12, 12, [0.6, 0.2, 0.2], False, True, _TRAFFIC, 0.0, 96.0, ["tod", "dow"], []),
    (["ETTh1", "ETTh2"], 336, 336, [0.6, 0.2, 0.2], True, False, _LONG, _NAN, 24.0, ["tod", "dow", "dom", "doy"], ["tod"]),
    (["ETTm1", "ETTm2"], 336, 336, [0.6, 0.2, 0.2], True, False, _LONG, _NAN, 96.0, ["tod", "dow", "dom", "doy"], ["tod"]),
    (["Electricity"], 336, 336, [0.7, 0.1, 0.2], True, False, _LONG, _NAN, 24.0, ["tod", "dow", "dom", "doy"], ["tod"]),
    (["Traffic"], 336, 336, [0.7, 0.1, 0.2], True, False, _LONG, _NAN, 24.0, ["tod", "dow", "dom", "doy"], []),
    (["Weather"], 336, 336, [0.7, 0.1, 0.2], True, False, _LONG, _NAN, 144.0, ["tod", "dow", "dom", "doy"], ["tod"]),
    (["ExchangeRate"], 336, 336, [0.7, 0.1, 0.2], True, False, _LONG, _NAN, 1.0, ["tod", "dow", "dom", "doy"], ["tod"]),
    (["Illness"], 96, 48, [0.7, 0.1, 0.2], True, False, _LONG, _NAN, 1.0 / 7.0, ["tod", "dow", "dom", "doy"], []),
    (["BeijingAirQuality"], 336, 336, [0.6, 0.2, 0.2], True, False, _LONG, _NAN, 24.0, ["tod", "dow"], ["tod", "dow"]),
    (["Gaussian", "Pulse"], 336, 336, [0.7, 0.1, 0.2], False, True, _TRAFFIC, _NAN, None, [], []),
]

SETTINGS_TYPE = (
    "struct<input_len: int, output_len: int, ratio: array<double>, norm_each_channel: boolean, rescale: boolean, "
    "metrics: array<string>, null_val: double>")


def indicator_config(spark: SparkSession) -> DataFrame:
    """One row per indicator."""
    return spark.createDataFrame(
        [r[1:] for r in INDICATORS],
        "indicator string, unit string, decimals int, min_val double, max_val double, interpolation string")


def indicator_names() -> dict[str, str]:
    """Original column name to indicator."""
    return {original: key for original, key, *_ in INDICATORS}


def strategies(spark: SparkSession) -> DataFrame:
    """PIPE1."""
    return spark.createDataFrame(
        STRATEGIES, "strategy string, max_gap int, z_limit double, min_data_ratio double")


def strategy(name: str) -> tuple[int, float]:
    for row in STRATEGIES:
        if row[0] == name:
            return row[1], row[2]
    raise ValueError(f"unknown strategy {name}")


def dataset_settings(spark: SparkSession) -> DataFrame:
    """DS1: one row per prepared dataset with nested settings."""
    rows = []
    for names, i, o, ratio, each, rescale, metrics, null_val, spd, features, by_index in DATASETS:
        for n in names:
            listed = [] if n == "Gaussian" else metrics
            rows.append((n, (i, o, ratio, each, rescale, listed, null_val), spd, features, by_index))
    schema = (f"name string, regular_settings {SETTINGS_TYPE}, steps_per_day double, features array<string>, "
              "index_features array<string>")
    return spark.createDataFrame(rows, schema)


def regular_settings(spark: SparkSession, name: str):
    """SRC3: the settings of one dataset; an unknown name is an error."""
    row = dataset_settings(spark).where(F.col("name") == name).select("regular_settings").first()
    if row is None:
        raise KeyError(f"no settings for dataset {name}")
    return row[0]
