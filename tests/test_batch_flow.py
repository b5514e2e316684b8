"""Five statuses, and retries that fit anew, on planted batches."""

from __future__ import annotations

import numpy as np
import pytest

from mapweave.operators import batch_flow

POSE = "batch long, ref long, p_centre array<double>, p_rot array<double>, centre array<double>, rot array<double>"
POINT = "batch long, ref long, sx double, sy double, sz double, tx double, ty double, tz double, w double"


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """Batches: 1 good; 2 with a bad reference 0; 3 hopeless; 4 known already; 5 with two references; 6 without points; 7 hopeless
    until its references are inferred again without the least similar one."""
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("flow")))
    r, eye = np.random.default_rng(0), np.eye(3)
    rot, shift = np.array([[0.0, -1, 0], [1, 0, 0], [0, 0, 1]]), np.array([1.0, 2, 3])
    poses, points = [], []
    for b in (1, 2, 3, 4, 5, 6, 7):
        for ref in range(2 if b == 5 else 5):
            c = r.normal(size=3)
            off = np.array([30.0, 0, 0]) if (b, ref) == (2, 0) else np.zeros(3)
            noise = 40 * r.normal(size=3) if b in (3, 7) else np.zeros(3)
            to = lambda x, o=off, n=noise: 1.5 * rot @ x + shift + o + n
            poses.append((b, ref, c.tolist(), eye.ravel().tolist(), to(c).tolist(), rot.ravel().tolist()))
            points += [(b, ref, *map(float, s), *map(float, to(s)), 1.0) for s in r.normal(size=(12, 3)) if b != 6]
    requested = [(b, f"f{b}-{i}") for b in (1, 2, 3, 4, 5, 6, 7) for i in range(2)]
    known = [("f4-0",), ("f4-1",), ("f1-0",)]
    alike = [(b, ref, 0.9 - 0.01 * ref if ref != 3 else -0.5) for b in (2, 3, 7) for ref in range(5)]
    make = lambda rows, schema: spark.createDataFrame(rows, schema).persist()
    clean = [(7, ref, *x[2:]) for ref in range(5) for x in poses if x[0] == 1 and x[1] == ref], [(7, *x[1:]) for x in points if x[0] == 1]
    again = make(clean[0], POSE), make(clean[1], POINT)
    return make(requested, "batch long, frame_id string"), make(known, "frame_id string"), make(points, POINT), make(poses, POSE), make(alike, "batch long, ref long, similarity double"), again


def test_statuses_and_retries(planted):
    *tables, (poses, points) = planted
    asked = []

    def reinfer(kept):
        asked.extend((r.batch, r.ref) for r in kept.collect())
        only = lambda d: d.join(kept, ["batch", "ref"], "left_semi")
        return only(points), only(poses)

    decisions, fits = batch_flow.decide(*tables, reinfer=reinfer, rounds=4)
    got = {r.batch: (r.status, r.fresh, r.stage, r.dropped) for r in decisions.collect()}
    assert got[1] == ("added", 1, "none", []) and got[4] == ("skipped_existing", 0, None, None)
    assert got[2][0] == "added" and got[2][2] == "geometry" and 0 in got[2][3]
    assert got[3] == ("skipped_failed_validation", 2, None, None) and got[5][0] == "skipped_not_enough_neighbors" and got[6][0] == "skipped_alignment_failed"
    assert got[7] == ("added", 2, "similarity", [3]) and {x for x in asked if x[0] == 7} == {(7, i) for i in (0, 1, 2, 4)}
    f = {r.batch: r for r in fits.collect()}
    assert f.keys() == {1, 2, 7} and all(abs(r.scale - 1.5) < 1e-6 and np.allclose(r.translation, [1, 2, 3], atol=1e-6) for r in f.values())
