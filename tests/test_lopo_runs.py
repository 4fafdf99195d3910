"""Leave-one-out queries hold out every condition, by models at the reference's settings."""

import pytest

from foldloom import catalog
from foldloom.operators import models


def test_every_condition_is_held_out(spark, small):
    want = {r["condition"] for r in catalog.wide(spark, small).where("condition <> 'ctrl'").select("condition").distinct().collect()}
    assert len(want) > 3 and {r["condition"] for r in catalog.lopo_run(spark, small, models.MeanOfOthers()).collect()} == want


@pytest.mark.parametrize("name", ["ml6_lopo_convolution", "ml7_lopo_transformer", "ml8_ml9_lopo_attention"])
def test_models_train_at_full_settings(spark, small, monkeypatch, name):
    asked = []

    def seen(spark, d, estimator, *rest, folds=50):
        asked.append((estimator.hidden, estimator.epochs, folds))
        return spark.range(0)

    monkeypatch.setattr(catalog, "lopo_run", seen)
    catalog.QUERIES[name](spark, small)
    assert asked == [(128, 50, 50)]
