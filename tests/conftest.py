import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


WORD = "job_id long, word_idx long, word string, start_ms long, end_ms long, confidence double, speaker string"


@pytest.fixture(scope="session")
def make_words(spark):
    """Words of one job from (word, start, end, confidence, speaker) or plain texts."""

    def make(items, job=1, step=200):
        rows = []
        for i, x in enumerate(items):
            word, start, end, conf, speaker = (x, i * step, (i + 1) * step, None, None) if isinstance(x, str) else (*x, *(None,) * (5 - len(x)))
            rows.append((job, i, word, start, end, conf, speaker))
        return spark.createDataFrame(rows, WORD)

    return make
