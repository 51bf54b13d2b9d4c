"""Windows over chunks of a series are those over the whole series."""

import numpy as np
import pytest

from axonframe import model
from axonframe.operators import conditioning as C
from axonframe.operators import spikes as G
from axonframe.operators import trials as D

CASES = {
    "boxcar": lambda df: C.boxcar(df, 6),
    "convolved": lambda df: C.convolved(df, [0.5, 0.25, -0.125]),
    "edges": lambda df: D.rising_edges(df, 0.3),
    "energy": lambda df: G.energy(df),
    "rolling": lambda df: G.rolling_thresholds(df, 3),
    "crossings": lambda df: G.crossings(df, df.groupBy("channel").agg({"y": "avg"}).toDF("channel", "threshold"), 3, 2),
}


@pytest.mark.parametrize("name", CASES)
def test_chunks_agree(spark, monkeypatch, name):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(c, i, i / 10, float(v)) for c, n in ((1, 100), (2, 33), (3, 1), (4, 10)) for i, v in enumerate(rng.normal(size=n), 1)], "channel long, i long, t double, y double")
    rows = lambda: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in CASES[name](df).collect())
    whole = rows()
    monkeypatch.setattr(model, "CHUNK", 10)
    assert rows() == whole and whole
