import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[*]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.codegen.cache.maxEntries", "4000")
        .config(
            "spark.sql.streaming.stateStore.providerClass",
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        )
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def walk(spark):
    """Random-walk bars: one symbol with nearly all rows, two small ones."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(3)
    frames = []
    for sym, n in (("HOT", 2500), ("B", 120), ("C", 35)):
        close = 100 + np.cumsum(rng.normal(0, 1, n))
        open_ = np.concatenate([[100.0], close[:-1]])
        frames.append(
            pd.DataFrame(
                {
                    "symbol": sym,
                    "ts": pd.date_range("2020-01-01", periods=n, freq="h"),
                    "open": open_,
                    "high": np.maximum(open_, close) + rng.random(n),
                    "low": np.minimum(open_, close) - rng.random(n),
                    "close": close,
                    "volume": rng.integers(1, 100, n).astype(float),
                }
            )
        )
    return pd.concat(frames, ignore_index=True)


@pytest.fixture(scope="session")
def bars(spark, walk):
    return spark.createDataFrame(walk)
