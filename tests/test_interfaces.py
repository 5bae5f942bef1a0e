"""Command line, service and links, where they meet files, hosts and models."""

import json
import threading
import urllib.error
import urllib.request

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom import cli, service
from corpusloom.functions import url_state
from corpusloom.operators import embedding, neighbors
from corpusloom.sources import artifacts, fetch, synthetic

CONFIG = """
schema_version = 1
[corpus]
id = "tiny"
label_field = "department"
facets = ["department", "culture"]
metadata_url = "http://127.0.0.1:9/none"
[model]
dim = 8
[projection]
l2_normalize = true
umap_n_components = 3
umap_metric = "euclidean"
umap_densmap = false
umap_n_neighbors = 5
umap_min_dist = 0.1
umap_n_epochs = 5
pca_components = 4
[validation]
k = 3
[artifacts]
[viewer]
"""


def small_set(spark, folder):
    e = synthetic.make_embeddings(spark, 60, 16, 3, seed=1).withColumn("name", synthetic.cluster_name(F.col("label"))).withColumn("title", F.lit("long title " * 20))
    e = e.withColumns({a: F.col("embedding")[k] for k, a in enumerate("xyz")})
    w = artifacts.ArtifactWriter(folder, 60)
    w.add_coords(e)
    w.add_labels(e, "name")
    w.add_neighbors(neighbors.knn(e, 3, "row_id", "embedding"), 3)
    w.add_metadata(e, ["name"], ["title"])
    w.finish(corpus={"id": "tiny"})


def test_service_describes_itself_and_serves_its_files(spark, tmp_path):
    small_set(spark, tmp_path / "runs" / "one")
    (tmp_path / "secret.txt").write_text("not yours")
    (tmp_path / "runs" / "link").symlink_to(tmp_path / "secret.txt")
    server = service.make_server(service.PromptService(tmp_path / "runs" / "one"), port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()

    def get(path, **headers):
        try:
            with urllib.request.urlopen(urllib.request.Request(f"http://127.0.0.1:{server.server_port}{path}", headers=headers)) as a:
                return a.status, a.read(), a.headers
        except urllib.error.HTTPError as x:
            return x.code, x.read(), x.headers

    assert json.loads(get("/")[1]) == {"status": "ok", "n": 60, "stub": True, "model": "stub", "dim": 3, "run": "one", "space": "coords", "corpus": "tiny"}
    status, raw, headers = get("/data/one/manifest.json?x=1")
    assert status == 200 and json.loads(raw)["n"] == 60 and headers["Content-Type"] == "application/json"
    status, raw, headers = get("/data/one/text.bin", **{"Accept-Encoding": "gzip"})
    assert headers["Content-Encoding"] == "gzip" and service.gzip.decompress(raw) == (tmp_path / "runs/one/text.bin").read_bytes()
    assert [get(p)[0] for p in ("/data/../secret.txt", "/data/%2e%2e/secret.txt", "/data/link", "/data/one/none", "/data/one", "/other")] == [403, 403, 403, 404, 404, 404]
    server.shutdown()


def test_coded_links():
    state = {"camera": [1.0, 2.5, -3.0], "target": [0.0, 0.12, 9.0], "selected": 7, "query": "a & b", "filters": {"lang": 2, "source": 0}}
    empty = {"camera": None, "selected": None, "query": "", "filters": {}}
    assert url_state.read("#" + url_state.write(state, url_state.CODED), url_state.CODED) == state
    assert url_state.write({"selected": -1, "filters": {"lang": -1}}, url_state.CODED) == "" and url_state.read("", url_state.CODED) == empty
    assert url_state.read("c=1,2,x,4,5,6&s=z&q=&f=lang:x,:3,a:1", url_state.CODED) == empty | {"filters": {"a": 1}}
    assert url_state.read("c=1%2C2%2C3%2C4%2C5%2C6&s=4&f=lang%3A2", url_state.CODED) == empty | {"camera": [1, 2, 3], "target": [4, 5, 6], "selected": 4, "filters": {"lang": 2}}


def test_centre_square():
    assert fetch.centre_square(300, 200) == (50, 0, 250, 200) and fetch.centre_square(3, 8) == (0, 2, 3, 5)


def test_probe():
    def refuse(code):
        def open_(request, timeout):
            assert request.get_method() == "HEAD"
            raise urllib.error.HTTPError(request.full_url, code, "no", None, None)

        return open_

    assert cli.probe("http://x.invalid", refuse(403)) == "HTTP 403" and cli.probe("http://127.0.0.1:9/").startswith("not reachable")


class Model:
    """An encoder of images or texts by their length."""

    def __init__(self, device=None):
        self.device = device

    def __call__(self, inputs):
        return np.array([[len(x), 1.0, *[0.5] * 6] for x in inputs])


def test_shards_are_taken_up_where_a_run_was_killed(spark, tmp_path):
    df = spark.createDataFrame([(i, f"text {i % 9}") for i in range(95)], "row_id long, text string")
    path, seen = str(tmp_path / "vectors"), []

    def encode(part, broken=False):
        seen.append(part.count())
        if broken and len(seen) == 3:
            raise RuntimeError("killed")
        return embedding.embed(part, Model, "row_id", "text", half=True)

    with pytest.raises(RuntimeError):
        embedding.embed_in_shards(df, lambda part: encode(part, True), path, shard_rows=10, shards_per_job=2)
    assert spark.read.parquet(path).count() == 40 and seen == [20, 20, 20]
    assert embedding.embed_in_shards(df, encode, path, shard_rows=10, shards_per_job=2) == 3 and seen[3:] == [20, 20, 15]
    assert embedding.embed_in_shards(df, encode, path, shard_rows=10, shards_per_job=2) == 0
    rows = spark.read.parquet(path).collect()
    assert sorted(r.row_id for r in rows) == [*range(95)] and all(r.shard == r.row_id // 10 and r.embedding[0] == 6 for r in rows)


def test_embed_and_project_from_the_command_line(spark, tmp_path, capsys):
    (tmp_path / "config.toml").write_text(CONFIG)
    out = tmp_path / "run"
    rows = [(i, f"o{i}", f"d{i % 2}", f"c{i % 3}", f"title {i}") for i in range(40)]
    spark.createDataFrame(rows, "row_id long, object_id string, department string, culture string, title string").selectExpr("*", "'' as artist", "'' as object_date", "'' as medium", "'' as classification", "'' as object_number").write.parquet(str(out / "corpus.parquet"))
    spark.createDataFrame([(f"o{i}", b"x" * i) for i in range(30)], "id string, content binary").write.parquet(str(out / "images.parquet"))
    base = ["--root", str(tmp_path)]
    assert cli.main([*base, "project", "--out", str(out)]) == 1
    assert cli.main([*base, "project", "--placeholder", "--unseeded", "--no-gate", "--keep-embeddings", "--out", str(out)]) == 0
    manifest = artifacts.read_manifest(out)
    assert manifest["n"] == 40 and manifest["projection"]["seed"] is None and manifest["embeddings"]["origin"] == "placeholder"
    assert cli.main([*base, "embed", "--encoder", "tests.test_interfaces:Model", "--device", "cpu", "--out", str(out)]) == 0
    got = {r.row_id: r for r in spark.read.parquet(str(out / "embeddings.parquet")).collect()}
    assert len(got) == 30 and got[7].embedding[0] == 7 and got[7].origin == "tests.test_interfaces:Model"
    assert cli.main([*base, "embed", "--encoder", "tests.none:Model", "--out", str(out)]) == 1
    capsys.readouterr()
    assert cli.main([*base, "doctor", "--network"]) == 0
    said = capsys.readouterr().out
    assert "corpus id=tiny" in said and "metadata_url not reachable" in said
    with pytest.raises(SystemExit) as end:
        cli.main(["--version"])
    assert end.value.code == 0 and "corpusloom 0." in capsys.readouterr().out
