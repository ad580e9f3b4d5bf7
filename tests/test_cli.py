import numpy as np
import pytest

from tickloom import __main__ as cli
from tickloom.operators import simulate as M


@pytest.fixture(scope="module")
def raw(tmp_path_factory):
    root = tmp_path_factory.mktemp("raw")
    for w in ("2026-07-30", "2026-07-31b"):
        folder = root / w
        folder.mkdir()
        names = [f"T{i}X" for i in range(12)]
        for i, s in enumerate(names):
            a, b = M.prices(200 if i else 20, 0.05, 0.3, 0.0005, 0.0, i)
            rows = "\n".join(f"{1785282060 + 60 * t},{x},{y}" for t, (x, y) in enumerate(zip(a, b, strict=True)))
            (folder / f"{s}.csv").write_text("ts,cex,dex\n" + rows + "\n")
        head = "symbol,cex_minutes,dex_minutes,window_minutes,paired_minutes,fill_rate,median_gap_min,max_gap_min,consecutive_share,first_ts,last_ts\n"
        (folder / "coverage.csv").write_text(head + "".join(f"{s},200,200,200,{200 if i else 20},1.0,1,1,1.0,0,0\n" for i, s in enumerate(names)))
        (folder / "universe.csv").write_text("symbol,cex_pair,cex_volume_24h,mint,pool,dex,dex_liquidity,dex_volume_24h\n" + "".join(f"{s},p,{1000 + i},m,q,d,{5 + i},{1 + i * i}\n" for i, s in enumerate(names)))
    return str(root)


@pytest.mark.parametrize("study", ["robustness", "vector", "lags", "grid", "sessions", "threshold", "alignment", "spacing", "dependence", "leadership", "relation"])
def test_studies_run_over_folders(spark, raw, study, monkeypatch):
    monkeypatch.setattr(cli.S, "DRAWS", 20)
    got, keys = cli.run(spark, study, raw, ["2026-07-30", "2026-07-31b"])
    rows = got.collect()
    assert rows and set(keys) <= set(got.columns)
    if study == "robustness":
        thin = [r for r in rows if r["symbol"] == "T0X"]
        assert len(rows) == 24 and {r["verdict"] for r in thin} == {"too few paired minutes"} and thin[0]["w_a"] is None
        assert np.mean([r["lead_share"] for r in rows if r["lead_share"] is not None]) > 0.5


def test_unknown_study_stops(spark, raw):
    with pytest.raises(SystemExit):
        cli.run(spark, "nothing", raw, ["2026-07-30"])
