import numpy as np

from packetlens.llm import quantiles


def test_rank_error_days_and_merged(spark):
    rng = np.random.default_rng(0)
    rows = [(int(d), "g" if i % 3 else None, int(v)) for d in range(4) for i, v in enumerate(rng.lognormal(8, 3, 15_000))]
    rows += [(0, "empty", None), (1, "one", 7), (1, "ties", 5), (1, "ties", 5)]
    df = spark.createDataFrame(rows, "day int, g string, v long").repartition(7)
    ranks = (0.05, 0.5, 0.99)
    days = quantiles.sketch_columns(df, by=["g", "day"], values=["v"])
    whole = quantiles.merge_sketches(days, by=["g"], values=["v"])
    out = {r.g: r for r in quantiles.percentiles(whole, by=["g"], values=["v"], ranks=ranks).collect()}
    for g in ("g", None):
        v = np.sort([x for _, k, x in rows if k == g])
        assert out[g].n == len(v)
        for r in ranks:
            q = out[g][f"p{round(r * 100):02d}"]
            lo, hi = np.searchsorted(v, q, "left") / len(v), np.searchsorted(v, q, "right") / len(v)
            assert max(0, lo - r, r - hi) <= 0.005
    assert out["empty"].n == 0 and out["empty"].p50 is None and out["one"].p05 == 7 and out["ties"].p99 == 5
    per_day = quantiles.percentiles(days, by=["g", "day"], values=["v"], ranks=ranks)
    assert per_day.where("g = 'g' and n = 10000").count() == 4
    assert quantiles.percentiles(quantiles.sketch_columns(df.limit(0), by=["g"], values=["v"]), by=["g"], values=["v"], ranks=ranks).count() == 0
