"""Embeddings give every train a row, however few are landmarks."""

import numpy as np
import pytest

from pulsegrid.operators import models as mo
from pulsegrid.plans import model_queries as mq


def test_landmarks_stay_and_others_come_between():
    t = np.linspace(0, 3, 60)
    curve = lambda t: np.c_[np.cos(t), np.sin(t), 0 * t]
    mid = (t[5:-6] + t[6:-5]) / 2
    for whole, model in ((mo.isomap(curve(t), 4, 2), mo.landmark_isomap(curve(t), 4, 2)), (mo.diffusion_map(curve(t)), mo.landmark_diffusion(curve(t)))):
        y = model(curve(t))
        assert np.abs(y[:, 0]) == pytest.approx(np.abs(whole[:, 0]), abs=1e-9)
        assert abs(np.corrcoef(model(curve(mid))[:, 0], (y[5:-6, 0] + y[6:-5, 0]) / 2)[0, 1]) > 0.999


@pytest.mark.parametrize("name", ["isomap_embedding", "diffusion_embedding"])
def test_a_row_for_each_train(spark, monkeypatch, name):
    monkeypatch.setattr(mq, "LANDMARKS", 6)
    d = "/root/testdata/sf0.001"
    want = {r.train for r in mq.trains(spark, d).where("valid").select("train").distinct().collect()}
    rows = getattr(mq, name)(spark, d).collect()
    assert len(want) > 6 and sorted(r.train for r in rows) == sorted(want)
    assert all(np.isfinite([r.x, r.y]).all() for r in rows)


def test_potential_of_many_landmarks_takes_memory_of_their_pairs_only():
    import tracemalloc

    x = np.random.default_rng(3).random((400, 4))
    tracemalloc.start()
    place = mo.landmark_potential(x)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 40 * 400**2 * 8  # 51 MB; all differences of the potentials are 512 MB
    assert np.isfinite(place(x[:5])).all()
