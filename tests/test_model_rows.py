"""What the registered tree queries are fitted on."""

from saleslens.operators import models
from saleslens.plans import driver_panel as dp
from saleslens.plans import queries as plans


def test_folds_take_the_whole_panel_and_default_trees(spark, sf_dir, monkeypatch):
    seen = {}
    monkeypatch.setattr(models, "run_cv", lambda rows, folds, **more: seen.update(rows=rows, folds=folds, **more))
    plans._cv(spark, sf_dir)
    panel = dp.panel(spark, sf_dir)
    assert seen["rows"].count() == panel.count()
    dates = sorted(r.date for r in panel.select("date").distinct().collect())
    assert (dates[-1] - dates[0]).days > 2 * 365
    assert all(f.train(panel).agg({"date": "min"}).first()[0] == dates[0] for f in seen["folds"])
    assert seen.get("params") in (None, models.gbt_params())
