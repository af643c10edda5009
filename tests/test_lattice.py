"""Lattice graphs against distances of all pairs."""

import random

import pytest

from sparkfactors.operators import lattice


def points(kind, n=9, seed=1):
    """Jittered lattice points with holes: id, section, x, y and the true row and col."""
    r, out = random.Random(seed), []
    for section in range(2):
        for row in range(n):
            for col in range(n):
                if r.random() < 0.15:
                    continue
                c = 2 * col + row % 2 if kind == 6 else col
                x, y = (c / 2, row * 3**0.5 / 2) if kind == 6 else (col, row)
                out.append((len(out), section, 10 * (x + r.uniform(-0.2, 0.2)), 10 * (y + r.uniform(-0.2, 0.2)), row, c, x, y))
    return out


@pytest.mark.parametrize("kind", [4, 6, 8])
def test_neighbours_are_those_a_step_away(spark, kind):
    rows = points(kind)
    spots = spark.createDataFrame([r[:4] for r in rows], "spot_id long, section_id long, x double, y double")
    keyed = lattice.lattice_keys(spots, 10.0, kind)
    assert {(r["spot_id"], r["row"], r["col"]) for r in keyed.collect()} == {(r[0], r[4], r[5]) for r in rows}
    assert keyed.where("off > 0.3").count() == 0
    reach = {4: 1.01, 6: 1.01, 8: 1.5}[kind]
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] != b[0] and a[1] == b[1] and (a[6] - b[6]) ** 2 + (a[7] - b[7]) ** 2 < reach**2}
    assert {tuple(r) for r in lattice.spatial_graph(spots, kind, pitch=10.0).collect()} == want
    rings, known = {}, want
    frontier = {e: 1 for e in want}
    rings |= frontier
    for ring in (2, 3):
        new = {(a, d) for (a, b), k in rings.items() if k == ring - 1 for c, d in known if c == b and a != d} - set(rings)
        rings |= dict.fromkeys(new, ring)
    assert {(r["src"], r["dst"]): r["ring"] for r in lattice.lattice_graph(keyed, kind, 3).collect()} == rings


def test_what_a_grid_needs(spark):
    spots = spark.createDataFrame([(0, 0, 0.0, 0.0), (1, 0, 1.0, 0.0), (2, 0, 5.0, 0.0)], "spot_id long, section_id long, x double, y double")
    with pytest.raises(ValueError):
        lattice.spatial_graph(spots, 6)
    with pytest.raises(ValueError):
        lattice.lattice_keys(spots, 0.0)
    with pytest.raises(ValueError):
        lattice.spatial_graph(spots, 6, "other")
    assert sorted(map(tuple, lattice.spatial_graph(spots, 1, "generic").collect())) == [(0, 1), (1, 0), (2, 1)]
    assert sorted(map(tuple, lattice.spatial_graph(spots, 4, pitch=1.0).collect())) == [(0, 1), (1, 0)]
    assert lattice.spatial_graph(spots.limit(0), 6, pitch=1.0).count() == 0
