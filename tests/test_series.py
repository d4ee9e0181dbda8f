import re

import numpy as np
import pandas as pd
import pytest

from acuity import schemas
from acuity.operators import series
from acuity.schemas import STAY

RNG = np.random.default_rng(11)


def frame(stay, n, missing=0.0):
    pdf = pd.DataFrame({STAY: stay, "observationoffset": np.arange(n) * 5.0}, index=range(n))
    for c in schemas.VITAL_SIGNS:
        values = RNG.normal(80, 9, n).round(3)
        pdf[c] = np.where(RNG.random(n) < missing, np.nan, values)
    return pdf


def to_spark(spark, pdf):
    records = pdf.astype(object).where(pdf.notna(), None).values.tolist()
    return spark.createDataFrame(records, schemas.VITALS).repartition(5)


@pytest.fixture(scope="module")
def history():
    """Stays of many lengths, some with gaps, some too short to forecast."""
    sizes = {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 37, 7: 160, 8: 260}
    frames = [frame(s, n, 0.3 if s > 5 else 0.0) for s, n in sizes.items()]
    frames[6].loc[150:, "sao2"] = np.nan
    frames[5]["heartrate"] = np.nan
    return pd.concat(frames, ignore_index=True)


@pytest.fixture(scope="module")
def vitals(spark, history):
    return to_spark(spark, history)


@pytest.mark.parametrize("hot", [60, 10_000])
@pytest.mark.parametrize("n,want", [(200, 200), (201, 201), (399, 399), (400, 200), (599, 300), (600, 200)])
def test_downsample(spark, n, want, hot):
    df = to_spark(spark, pd.concat([frame(1, n), frame(2, 3)]))
    got = series.downsample(df, hot_rows=hot).toPandas()
    kept = sorted(got.loc[got[STAY] == 1, "observationoffset"])
    step = max(n // 200, 1)
    assert len(kept) == want and kept == [i * 5.0 for i in range(0, n, step)]
    assert (got[STAY] == 2).sum() == 3 and list(got.columns) == schemas.VITALS_COLUMNS


def test_downsample_rejects_nonsense(vitals):
    with pytest.raises(ValueError):
        series.downsample(vitals, 0)


def expected(history, stay, vital):
    s = history.loc[history[STAY] == stay, vital].dropna()
    last = s.tail(5).values
    return (
        s.ewm(span=5).mean().iloc[-1], s.tail(10).std(),
        (last[-1] - last[0]) / max(len(last) - 1, 1), len(s),
    )


@pytest.mark.parametrize("hot", [1, 7, 90, 10_000])
def test_tail_statistics(vitals, history, hot):
    got = {(r[STAY], r["vital"]): r for r in series.tail_statistics(vitals, hot_rows=hot).collect()}
    present = {
        (s, v) for s in history[STAY].unique() for v in schemas.FORECAST_VITALS
        if history.loc[history[STAY] == s, v].notna().any()
    }
    assert set(got) == present
    for (stay, vital), row in got.items():
        ewm, std, trend, n = expected(history, stay, vital)
        assert row["kept"] == n
        assert np.isclose(row["ewm"], ewm, rtol=1e-12) and np.isclose(row["trend"], trend)
        assert row["std10"] is None if n == 1 else np.isclose(row["std10"], std)


def test_forecast(vitals, history):
    out = series.forecast(vitals, steps=4).toPandas()
    for stay in history[STAY].unique():
        part = history[history[STAY] == stay]
        for vital in schemas.FORECAST_VITALS:
            got = out[(out[STAY] == stay) & (out["vital"] == vital)].sort_values("step")
            if part[vital].notna().sum() < 3:
                assert got.empty
                continue
            ewm, std, trend, _ = expected(history, stay, vital)
            want = [ewm + 0.3 * trend * k for k in range(1, 5)]
            assert np.allclose(got["value"], want, atol=0.00501)
            assert np.allclose(got["upper"] - got["value"], std)
            assert np.allclose(got["value"] - got["lower"], std)
            last = part["observationoffset"].max()
            assert list(got["observationoffset"]) == [last + 5 * k for k in range(1, 5)]


def test_forecast_does_not_depend_on_partitions(vitals, rows):
    one = rows(series.forecast(vitals, seed=3))
    two = rows(series.forecast(vitals.repartition(11), seed=3))
    assert [r[:4] for r in one] == [r[:4] for r in two]
    assert np.allclose([r[4] for r in one], [r[4] for r in two])


def test_noise(vitals):
    plain = series.forecast(vitals, steps=12).toPandas()
    noisy = series.forecast(vitals, steps=12, seed=1).toPandas()
    both = plain.merge(noisy, on=[STAY, "vital", "step"], suffixes=("", "_n"))
    assert len(both) == len(plain) == len(noisy)
    both["noise"] = both["value_n"] - both["value"]
    both = both.sort_values([STAY, "vital", "step"])
    jumps = both.groupby([STAY, "vital"])["noise"].diff().fillna(both["noise"])
    scale = (both["upper"] - both["value"]) * 0.2
    assert 0.8 < (jumps / scale).std() < 1.2
    other = series.forecast(vitals, steps=12, seed=2).toPandas()
    assert not np.allclose(sorted(other["value"]), sorted(noisy["value"]))


@pytest.mark.parametrize("steps", [0, -1])
def test_steps_must_be_positive(vitals, steps):
    with pytest.raises(ValueError):
        series.forecast(vitals, steps)
    with pytest.raises(ValueError):
        series.future_offsets(vitals, steps)


def test_future_offsets(vitals, rows):
    got = [r for r in rows(series.future_offsets(vitals, 2)) if r[0] in (1, 8)]
    assert got == [(1, 1, 5.0), (1, 2, 10.0), (8, 1, 1300.0), (8, 2, 1305.0)]


def test_history_keeps_missing_values(vitals, history):
    got = series.history(vitals).toPandas()
    for stay, part in history.groupby(STAY):
        tail = got[got[STAY] == stay].sort_values("place", ascending=False)
        want = part.tail(50)
        assert list(tail["observationoffset"]) == list(want["observationoffset"])
        assert np.allclose(tail["sao2"], want["sao2"], equal_nan=True)
        assert np.allclose(tail["time_h"], want["observationoffset"] / 60)


def test_forecast_line(vitals, history):
    out = series.forecast_line(vitals, steps=2).toPandas()
    line = out[(out[STAY] == 7) & (out["vital"] == "sao2")].sort_values("step")
    assert list(line["step"]) == [0, 1, 2] and pd.isna(line["value"].iloc[0])
    assert np.allclose(line["time_h"], [159 * 5 / 60, 160 * 5 / 60, 161 * 5 / 60])
    assert out[out[STAY] == 2].empty
    assert set(out.loc[out[STAY] == 6, "vital"]) == set(schemas.FORECAST_VITALS) - {"heartrate"}


def test_long_form(vitals, history):
    out = series.long_form(vitals)
    assert out.columns == [STAY, "observationoffset", "vital", "value", "time_h"]
    assert out.count() == history[schemas.VITAL_SIGNS].notna().sum().sum()


def test_forecast_arrays(vitals):
    predicted = series.forecast(vitals, steps=3)
    got = {r[STAY]: r["forecast"] for r in series.forecast_arrays(predicted).collect()}
    one = predicted.filter(f"{STAY} = 8 and vital = 'sao2'").orderBy("step").collect()
    assert got[8]["sao2"] == [r["value"] for r in one] and set(got) == {3, 4, 5, 6, 7, 8}


@pytest.mark.parametrize("hot", [70, 10_000])
def test_weighted_mean_keeps_old_extremes_and_places_of_infinite_values(spark, hot):
    old = frame(1, 3000)
    old["respiration"] = 16.0
    old.loc[3000 - 101, "respiration"] = 1e19
    old["systemicsystolic"] = 120.0 + np.arange(3000) % 7
    old.loc[2990, "systemicsystolic"] = np.inf
    got = {r["vital"]: r["ewm"] for r in series.tail_statistics(to_spark(spark, old), hot_rows=hot).collect()}
    for vital in ("respiration", "systemicsystolic"):
        want = old[vital].replace(np.inf, np.nan).ewm(span=5).mean().iloc[-1]
        assert got[vital] == pytest.approx(want, rel=1e-12)
    assert got["respiration"] > 17


def test_forecast_reads_the_readings_once_and_its_line_twice(spark, vitals, tmp_path):
    vitals.write.parquet(str(tmp_path / "v"))
    stored = spark.read.parquet(str(tmp_path / "v"))
    for make, scans in ((series.forecast, 1), (series.forecast_line, 2)):
        plan = make(stored)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") <= scans


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_readings_move_once_and_as_whole_rows(spark, vitals):
    """Whatever the session's settings, as no limit of Spark's is relied on."""
    plan = plan_of(series.forecast(vitals, seed=1))
    above, below = plan.split("Exchange hashpartitioning", 1)
    assert "hashpartitioning" not in below and "Generate" in above and "Generate" not in below
    assert spark.conf.get("spark.sql.optimizer.windowGroupLimitThreshold") == "1000"


def test_a_cut_stay_sends_one_row_per_chunk_and_sign(spark):
    long = to_spark(spark, pd.concat([frame(1, 3000), frame(2, 40)]))
    chunks = series.tail_chunks(long, hot_rows=300).collect()
    sizes = {}
    for r in chunks:
        sizes.setdefault((r[STAY], r["_vital"]), []).append(r["rows"])
        assert len(r["newest"]) == min(10, r["rows"])
    assert all(len(v) == 10 and sum(v) == 3000 and max(v) < 400 for k, v in sizes.items() if k[0] == 1)
    assert all(v == [40] for k, v in sizes.items() if k[0] == 2)
    plan = plan_of(series.tail_statistics(long, hot_rows=300))
    # the chunk rows, and below them the readings by stay and chunk
    assert len(re.findall(r"hashpartitioning\(patientunitstayid#\d+L, _chunk#\d+, ", plan)) == 1


def test_rows_of_one_time_share_a_chunk(spark):
    same = frame(1, 900)
    same["observationoffset"] = np.repeat([1.0, 2.0, 3.0], 300)
    whole, cut = (
        {r["vital"]: r for r in series.tail_statistics(to_spark(spark, same), hot_rows=h).collect()}
        for h in (10_000, 50)
    )
    for vital, row in whole.items():
        assert np.allclose(list(row)[2:], list(cut[vital])[2:], rtol=1e-12)


def test_history_is_cut_before_the_shuffle(vitals):
    assert plan_of(series.history(vitals)).count("WindowGroupLimit") == 4
