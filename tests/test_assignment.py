"""Rows whose bounds spare little meet all centres in single precision; their nearest ones stay those of comparing all."""

import numpy as np
import pytest

from vismatch.operators import balls


def _all(x, centres):
    squares = np.array([((centres - r) ** 2).sum(1) for r in x])
    return squares.argmin(1), np.sqrt(squares.min(1))


@pytest.mark.parametrize("scale", [1.0, 1e-25, 1e-12, 1e6, 1e30])
@pytest.mark.parametrize("shift", [0.0, 1e3])
def test_nearest_is_that_of_comparing_all(scale, shift):
    rng = np.random.default_rng(3)
    centres = (rng.normal(size=(300, 16)) + shift) * scale
    centres[7], centres[200] = centres[150], centres[150]  # the lowest of equals is taken
    x = np.concatenate([(rng.normal(size=(500, 16)) + shift) * scale, centres[100:200], (centres[:50] + centres[50:100]) / 2])
    cell, d = balls.Centres(centres).nearest(x)
    want, far = _all(x, centres)
    assert (cell == want).all() and (d == far).all()


def test_rows_without_structure_take_one_product(monkeypatch):
    rng = np.random.default_rng(4)
    own = balls.Centres(rng.normal(size=(400, 32)))
    calls = []
    monkeypatch.setattr(balls, "distances", lambda x, y, f=balls.distances: calls.append(len(y)) or f(x, y))
    own.nearest(rng.normal(size=(1_000, 32)))
    assert len(calls) < 30  # the middles and each row's first group; pairs of all groups would be twice as many
    near = balls.Centres(rng.normal(size=(20, 8))[rng.integers(0, 20, 400)] * 100 + rng.normal(size=(400, 8)))
    near.nearest(near.centres + 0.01)
    assert near.compared < 400 * 400 / 4  # groups far apart are still left out
