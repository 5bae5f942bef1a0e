import json
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import picking
from corpusloom.operators import buckets, moments, neighbors, raster, reduce, search
from corpusloom.streaming import journal


def entries(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(json.dumps({"id": i, "status": s, "detail": d, "at": f"2024-01-{day:02d}T00:{minute:02d}:00Z"}) + "\n" for i, s, d, day, minute in rows))


def test_a_killed_journal_goes_on(spark, tmp_path, monkeypatch):
    rng = random.Random(1)
    rows = [(rng.choice("abcde"), rng.choice(["ok", "error", "no_image"]), str(n), 1, n) for n in range(60)]
    source, sink, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "c")
    for k in range(6):
        entries(source, f"{k}.json", rows[k * 10 : k * 10 + 10])
    real, calls = journal.states, []

    def breaks(df, **options):
        found = real(df, **options)
        if len(calls) == 0:
            calls.append(1)
            return found.withColumn("detail", F.when(F.col("version") >= 3, F.raise_error(F.lit("killed"))).otherwise(F.col("detail")))
        return found

    monkeypatch.setattr(journal, "states", breaks)
    with pytest.raises(Exception, match="killed"):
        journal.run(spark, str(source), sink, checkpoint, files_per_batch=1)
    journal.run(spark, str(source), sink, checkpoint, files_per_batch=1)
    want = {i: (s, d, sum(r[0] == i and r[1] == "error" for r in rows)) for i, s, d, _, _ in rows}
    assert {r.id: (r.status, r.detail, r.tries) for r in journal.current(spark, sink).collect()} == want
    entries(source, "late.json", [("a", "ok", "new", 1, 59), ("b", "error", "old", 1, 0), (None, "ok", "x", 1, 1)])
    journal.run(spark, str(source), sink, checkpoint)
    got = {r.id: (r.status, r.detail, r.tries) for r in journal.current(spark, sink).collect()}
    assert got["a"][:2] == max(("ok", "new"), want["a"][:2] if rows[-1][0] == "a" else ("", "")) and got["b"] == (*want["b"][:2], want["b"][2] + 1)


def test_what_never_ends_becomes_an_error(spark, tmp_path):
    source, sink, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "c")
    for day, rows in ((1, [("a", "started", "", 1, 0), ("b", "started", "", 1, 0), ("b", "ok", "", 1, 5)]), (9, [("c", "ok", "", 9, 0)]), (10, [("c", "ok", "x", 10, 0)]), (11, [("a", "ok", "again", 11, 0)])):
        entries(source, f"{day:02d}.json", rows)
        journal.run(spark, str(source), sink, checkpoint, files_per_batch=1)
        state = {r.id: (r.status, r.detail, r.tries) for r in journal.current(spark, sink).collect()}
        if day == 10:
            assert state == {"a": ("error", "timed out", 1), "b": ("ok", "", 0), "c": ("ok", "x", 0)}
    assert state["a"] == ("ok", "again", 1)


def test_ids_of_one_group_have_their_own_entries_and_time_outs(spark, tmp_path):
    """Entries of busy ids neither end nor put off the time-out of another, and calls follow groups instead of ids."""
    source, sink, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "c")
    many = [(f"n{i}", "error" if i % 3 else "ok", str(i), 1, i % 60) for i in range(300)]
    for day, rows in ((1, [("a", "started", "", 1, 0), *many]), (9, [("c", "started", "", 9, 0)]), (10, [("c", "error", "x", 10, 0), *many[:9]])):
        entries(source, f"{day:02d}.json", rows)
    journal.run(spark, str(source), sink, checkpoint, files_per_batch=1, groups=1)
    state = {r.id: (r.status, r.detail, r.tries) for r in journal.current(spark, sink).collect()}
    assert state == {"a": ("error", "timed out", 1), "c": ("error", "x", 1)} | {i: (s, d, (1 + (k < 9)) * (s == "error")) for k, (i, s, d, _, _) in enumerate(many)}


def test_components_of_shards(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(700, 9)) * np.arange(1, 10) + 5
    df = spark.createDataFrame([(i, (i * i) % 7 if i % 50 else None, v.tolist()) for i, v in enumerate(x)] + [(700, 1, None)], "id long, shard int, v array<double>")
    state = moments.shard_moments(df.repartition(5), "v", "shard")
    rows = state.collect()
    assert sum(r.n for r in rows) == 700 and len(rows) == df.where("v IS NOT NULL").select("shard").distinct().count()
    whole = reduce.fit_pca(df.where("v IS NOT NULL"), "v", 4)
    later = state.where("shard = 1").unionByName(state.where("shard IS NULL OR shard <> 1"))
    for found in (moments.pca_of(state, 4), moments.pca_of(later, 4)):
        assert all(np.abs(getattr(found, f) - getattr(whole, f)).max() < 1e-9 for f in ("components", "mean", "explained"))
    many = spark.createDataFrame([(i % 40, rng.normal(size=3).tolist()) for i in range(400)], "s int, v array<double>")
    assert np.abs(moments.pca_of(moments.shard_moments(many, "v", "s"), 3).components - reduce.fit_pca(many, "v", 3).components).max() < 1e-9


def test_buckets_are_joined_as_they_lie(spark):
    rng = np.random.default_rng(3)
    e = spark.createDataFrame([(i, rng.normal(size=3).tolist(), f"l{i % 3}") for i in range(300)], "row_id long, v array<double>, label string")
    near = neighbors.knn(e, 5, "row_id", "v", metric="euclidean")
    points = e.select("row_id", "label", *[F.col("v")[k].alias(a) for k, a in enumerate("xyz")])
    edges, kept = buckets.keep(near, "edges_by_row", "row_id", 6), buckets.keep(points, "points_by_row", "row_id", 6)
    usual = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        assert buckets.purity(edges, kept).first()[0] == neighbors.label_purity(near, points.select("row_id", "label")).first()[0]
        for df, moved in ((buckets.purity(edges, kept), "neighbor_id"), (buckets.farthest(edges, kept), "neighbor_id")):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert plan.count("SortMergeJoin") == 2 and plan.count("hashpartitioning(neighbor_id") == 1
            assert sum(k in plan for k in ("hashpartitioning(row_id", "hashpartitioning(other")) <= (df.columns == ["row_id", "farthest"])
        want = {r.row_id: r.farthest for r in search.neighbor_verdict(near, points).collect()}
        got = {r.row_id: r.farthest for r in buckets.farthest(edges, kept).collect()}
        assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-12 for i in got)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)
        spark.sql("DROP TABLE edges_by_row")
        spark.sql("DROP TABLE points_by_row")


@pytest.mark.parametrize("eye, target", [([0.0, 0, 5], [0.0, 0, 0]), ([3.0, 2, 1], [0.0, 1, 0]), ([0.1, 0.1, 0.1], [-1.0, 0, 0])])
def test_hits_on_a_screen(spark, eye, target):
    x = np.random.default_rng(4).normal(size=(500, 3))
    x[:20] = x[20:40]
    matrix = picking.times(picking.perspective(50, 4 / 3, 0.1, 50), picking.look_at(eye, target))
    seen = picking.project(spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "row_id long, x double, y double, z double"), matrix, 800, 600)
    clip = np.c_[x, np.ones(500)] @ np.array(matrix).T
    front = clip[:, 3] > 0
    assert 0 < front.sum() and np.array_equal(front, (x - eye) @ (np.array(target) - eye) > 0)
    at = clip[:, :3] / np.where(front, clip[:, 3], 1)[:, None]
    inside = front & (np.abs(at).max(1) <= 1)
    px, py = (at[:, 0] + 1) * 400, (1 - at[:, 1]) * 300
    got = {r.row_id: (r.screen_x, r.screen_y) for r in seen.collect()}
    assert got.keys() == set(np.flatnonzero(inside)) and all(np.allclose(got[i], (px[i], py[i])) for i in got)
    cells = {}
    for i in np.flatnonzero(inside):
        cells.setdefault((int(px[i] // 40), int(py[i] // 40)), []).append((at[i, 2], i))
    hits = {(r.cell_x, r.cell_y): (r.id, r.n) for r in picking.grid_hits(seen, 40).collect()}
    assert hits == {c: (min((round(d, 12), i) for d, i in v)[1], len(v)) for c, v in cells.items()}
    d = np.where(inside, (px - 400) ** 2 + (py - 300) ** 2, np.inf)
    assert picking.nearest_to(seen, 400, 300, 200).first()[0] == (int(d.argmin()) if d.min() <= 200**2 else None)
    assert picking.nearest_to(seen, -900, -900, 5).first()[0] is None


def test_a_picture_is_a_png(spark, tmp_path):
    df = spark.createDataFrame([(0, 0.0, 0.0, "a"), (1, 1.0, 1.0, "b"), (2, 1.0, 1.0, "b"), (3, 1.0, 0.0, "a")], "row_id long, x double, y double, label string")
    raster.write_gate(tmp_path / "gate.png", df, df.withColumn("x", -F.col("x")), "label", 10)
    raw = (tmp_path / "gate.png").read_bytes()
    assert raw[:8] == b"\x89PNG\r\n\x1a\n"
    parts, at = {}, 8
    while at < len(raw):
        size, kind = struct.unpack(">I4s", raw[at : at + 8])
        parts[kind] = raw[at + 8 : at + 8 + size]
        assert struct.unpack(">I", raw[at + 8 + size : at + 12 + size])[0] == zlib.crc32(kind + parts[kind])
        at += 12 + size
    width, height = struct.unpack(">II", parts[b"IHDR"][:8])
    image = np.frombuffer(zlib.decompress(parts[b"IDAT"]), np.uint8).reshape(height, 1 + width * 3)[:, 1:].reshape(height, width, 3)
    assert (width, height) == (28, 10) and (image[:, 10:18] == 255).all()
    lit = {tuple(p) for p in np.argwhere(image[:, :10].any(axis=2)).tolist()}
    assert lit == {(9, 0), (0, 9), (9, 9)} and image[0, 9].sum() > 0 and {tuple(p) for p in np.argwhere(image[:, 18:].any(axis=2)).tolist()} == {(9, 9), (0, 0), (9, 0)}
    assert raster.picture(df.where("row_id = 0"), "label", 3, 3).any(axis=2).sum() == 1
