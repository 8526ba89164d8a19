"""The grid of param_grid_search."""

import pytest

from remitlens.catalog import models as catalog
from remitlens.plans import jobs


def test_grid_is_the_published_one(monkeypatch):
    asked = {}
    monkeypatch.setattr(catalog.jobs, "recipient_table", lambda *a: type("T", (), {"train": None}))

    def stop(train, grid, k, **more):
        asked.update(grid=grid, **more)
        raise KeyboardInterrupt

    monkeypatch.setattr(jobs, "cross_validate", stop)
    with pytest.raises(KeyboardInterrupt):
        catalog.param_grid_search(type("T", (), {"phys": None, "pay": None}))
    assert {(s.eta, s.depth) for s in asked["grid"]} == {
        (e, d) for e in (0.007, 0.009, 0.01, 0.011) for d in (4, 5, 6)
    }
    assert set(asked["rounds"]) == {1400, 1450, 1500} and asked["patience"] is None
    assert set(asked["thresholds"]) == {0.1, 0.15, 0.009}
