import gzip
import hashlib
import json
import threading
import urllib.error
import urllib.request
import zlib

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from corpusloom import cli, service
from corpusloom.functions import url_state
from corpusloom.operators import embedding, neighbors, placement, search
from corpusloom.sources import artifacts, fetch, metadata, packed, settings, synthetic
from corpusloom.streaming import ingest

CONFIG = """schema_version = 1
[corpus]
label_field = "department"
[model]
dim = 8
[projection]
l2_normalize = true
umap_n_components = 3
umap_metric = "euclidean"
umap_densmap = false
[validation]
[artifacts]
[viewer]
"""


def test_csv(spark, tmp_path):
    names = [*list(metadata.COLUMNS)[::-1], "Other"]
    row = {n: "x" for n in names} | {"Title": 'two\nlines, "quoted"', "Culture": "NA", "Object ID": "7"}
    line = lambda r: ",".join('"' + r[n].replace('"', '""') + '"' for n in names)
    (tmp_path / "m.csv").write_text(",".join(names) + "\n" + line(row) + "\n" + line(row | {"Object ID": "8", "Culture": ""}) + "\n")
    got = metadata.read_metadata(spark, str(tmp_path / "m.csv")).orderBy("src_ord").collect()
    assert [(r.object_id, r.title, r.culture) for r in got] == [("7", 'two\nlines, "quoted"', None), ("8", 'two\nlines, "quoted"', None)]
    (tmp_path / "n.csv").write_text("Title\nx\n")
    with pytest.raises(metadata.SourceError):
        metadata.read_metadata(spark, str(tmp_path / "n.csv"))
    with pytest.raises(metadata.SourceError):
        metadata.read_corpus(spark, str(tmp_path / "none"))


def test_journal(spark, tmp_path):
    path = tmp_path / "j.jsonl"
    path.write_text('{"id":"a","status":"error","detail":"x"}\n{"id":"a","status":"ok","detail":""}\n{"id":"b","status":"error","detail":""}\nrubbish\n{"id":"c","status":"no_image","detail":""}\n{"id":"d","sta')
    journal = metadata.read_journal(spark, str(path))
    assert {(r.id, r.status) for r in journal.collect()} == {("a", "ok"), ("b", "error"), ("c", "no_image")}
    ids = spark.createDataFrame([(c,) for c in "abcde"], "id string")
    assert {r.id for r in metadata.pending(ids, journal).collect()} == {"b", "d", "e"}
    assert tuple(metadata.journal_stats(ids, journal).first()) == (5, 1, 1, 1)


def test_images(spark):
    class Get:
        def __call__(self, url):
            if url.endswith("/3"):
                raise OSError("gone")
            return json.dumps({"primaryImage": "pic"} if url.endswith("/1") else {}).encode() if url.startswith("api") else b"raw"

    got = fetch.fetch_images(spark.createDataFrame([("1",), ("2",), ("3",)], "id string"), Get(), "api", transform=lambda b: b + b"!").collect()
    assert {(r.id, r.status, r.content and bytes(r.content)) for r in got} == {("1", "ok", b"raw!"), ("2", "no_image", None), ("3", "error", None)}


def test_settings(tmp_path):
    (tmp_path / "config.toml").write_text(CONFIG)
    (tmp_path / "a").mkdir()
    assert settings.load(tmp_path / "a").root == tmp_path
    for old, new in (("schema_version = 1", "schema_version = 2"), ("[viewer]", ""), ("densmap = false", "densmap = true"), ('"euclidean"', '"cosine"'), ("components = 3", "components = 2"), ('"department"', '""')):
        (tmp_path / "config.toml").write_text(CONFIG.replace(old, new))
        with pytest.raises(settings.SettingsError):
            settings.load(tmp_path)


def write_set(spark, folder, n=200, text="ümläut 漢字 | ; \t x"):
    e = synthetic.make_embeddings(spark, n, 16, 4, seed=1, spread=0.2).withColumn("name", synthetic.cluster_name(F.col("label"))).withColumn("title", F.concat(F.lit(text), F.col("row_id").cast("string")))
    e = e.withColumns({a: F.col("embedding")[k] for k, a in enumerate("xyz")})
    w = artifacts.ArtifactWriter(folder, n)
    w.add_coords(e)
    w.add_labels(e, "name")
    w.add_neighbors(neighbors.knn(e, 5, "row_id", "embedding"), 5)
    w.add_metadata(e, ["name"], ["title", "name"])
    w.add_embeddings(e, "embedding", "synthetic")
    return e, w.finish(corpus={"id": "t"})


def test_artifacts_round_trip_and_verify(spark, tmp_path):
    e, manifest = write_set(spark, tmp_path)
    rows = e.orderBy("row_id").collect()
    assert artifacts.verify(spark, str(tmp_path)).collect() == []
    labels = artifacts.read_array(tmp_path, artifacts.LABELS, "<u2", (200,))
    assert [manifest["label_names"][c] for c in labels] == [r["name"] for r in rows]
    offsets = artifacts.read_array(tmp_path, artifacts.OFFSETS, "<u4", (201,))
    blob = (tmp_path / artifacts.TEXT).read_bytes()
    assert [blob[a:b].decode() for a, b in zip(offsets, offsets[1:], strict=False)] == [f"ümläut 漢字 | ; x{i}\x1f{r['name']}\x1e" for i, r in enumerate(rows)]
    assert np.allclose(np.load(tmp_path / artifacts.EMBEDDINGS), np.array([r["embedding"] for r in rows]), atol=1e-6)
    loaded = artifacts.load(spark, str(tmp_path))
    assert [(r.label, r.facet_name) for r in loaded["points"].orderBy("row_id").collect()] == [(r["name"], r["name"]) for r in rows]
    assert [r.title for r in loaded["records"].orderBy("row_id").collect()] == [f"ümläut 漢字 | ; x{i}" for i in range(200)]
    scale = manifest["coords"]["half"][0] / 32767
    flat = np.array([[r.x, r.y, r.z] for r in loaded["points"].orderBy("row_id").collect()])
    assert abs(flat).max() <= 50 + scale and abs(flat.mean(axis=0)).max() < 3 * scale
    assert loaded["neighbors"].count() == 1000
    near = artifacts.read_array(tmp_path, artifacts.NEIGHBORS, "<u4", (200, 5))
    assert (near != np.arange(200)[:, None]).all()
    with pytest.raises(artifacts.ArtifactError):
        artifacts.read_array(tmp_path, artifacts.LABELS, "<u2", (199,))
    raw = bytearray((tmp_path / artifacts.COORDS).read_bytes())
    raw[7] ^= 1
    (tmp_path / artifacts.COORDS).write_bytes(raw)
    (tmp_path / artifacts.LABELS).unlink()
    (tmp_path / artifacts.FACETS).write_bytes(b"x")
    assert {(r["name"], r["problem"]) for r in artifacts.verify(spark, str(tmp_path)).collect()} == {(artifacts.COORDS, "checksum"), (artifacts.LABELS, "missing or empty"), (artifacts.FACETS, "size")}


def test_compressed_twins_and_limits(spark, tmp_path):
    (tmp_path / "old.gz").write_bytes(b"stale")
    content = {"old": b"short", "zeros": bytes(70_000), "noise": np.random.default_rng(0).bytes(70_000)}
    for name, raw in content.items():
        (tmp_path / name).write_bytes(raw)
    found = {r["name"]: r for r in artifacts.examined(spark, str(tmp_path), [*content, "none"], True).collect()}
    assert [found[n]["gzip_bytes"] is not None for n in content] == [False, True, False] and "none" not in found and not (tmp_path / "old.gz").exists()
    assert all(found[n]["sha256"] == hashlib.sha256(raw).hexdigest() for n, raw in content.items())
    assert gzip.decompress((tmp_path / "zeros.gz").read_bytes()) == bytes(70_000)
    many = spark.range(300).select(F.col("id").alias("row_id"), F.col("id").cast("string").alias("f"))
    with pytest.raises(artifacts.ArtifactError):
        artifacts.ArtifactWriter(tmp_path / "b", 300).add_metadata(many, ["f"], ["f"])
    for ids in ([0, 1, 3], [0, 1, 1], [0, 1], [1, 2, 3]):  # gaps, repeats, too few, not from 0
        w = artifacts.ArtifactWriter(tmp_path / "c", 3)
        with pytest.raises(artifacts.ArtifactError):
            w._put("rows", spark.createDataFrame([(i, 5) for i in ids], "row_id long, v int").coalesce(1), ["v"], "<u2", ())
        assert not (tmp_path / "c" / "rows").exists()


def test_files_over_two_gigabytes(spark, tmp_path):
    """A sparse file: its pieces are read by many tasks, and its check sum by one that holds a piece at a time."""
    n, width = 2_300_000_000 // 4, 4
    for wrong in ([(8, b"abcd")], [(8, b"abcd"), (n * width - 3, b"wxyz")], [(-1, b"a")]):
        with pytest.raises(PySparkException):
            packed.write_pieces(spark.createDataFrame(wrong, packed.PIECES), str(tmp_path / "big"), n * width)
        assert [*tmp_path.iterdir()] == []
    with open(tmp_path / "big", "wb") as f:
        for at, raw in ((8, b"abcd"), (n * width - 4, b"wxyz")):
            f.seek(at)
            f.write(raw)
    found = packed.read_rows(spark, str(tmp_path / "big"), width, n)
    assert found.rdd.getNumPartitions() == -(-n * width // packed.PART)
    ends = found.where((F.col("first") == 0) | (F.col("first") + packed.CHUNK // width >= n)).select("first", F.substring("raw", 1, 12).alias("a"), F.substring("raw", -4, 4).alias("z")).orderBy("first").collect()
    assert bytes(ends[0]["a"])[8:] == b"abcd" and bytes(ends[-1]["z"]) == b"wxyz"
    row = artifacts.examined(spark, str(tmp_path), ["big"], False).first()
    with open(tmp_path / "big", "rb") as f:
        assert (row["bytes"], row["sha256"]) == (n * width, hashlib.file_digest(f, "sha256").hexdigest())


def test_service_agrees_with_the_batch_operator(spark, tmp_path):
    e, _ = write_set(spark, tmp_path)
    s = service.PromptService(tmp_path)
    server = service.make_server(s, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"

    def post(body, path="/prompt"):
        try:
            with urllib.request.urlopen(urllib.request.Request(url + path, data=body, method="POST")) as a:
                return a.status, json.loads(a.read())
        except urllib.error.HTTPError as x:
            return x.code, json.loads(x.read())

    with urllib.request.urlopen(url + "/health") as a:
        told = json.loads(a.read())
    assert told == {"status": "ok", "n": 200, "stub": True, "model": "stub", "dim": 16, "run": tmp_path.name, "space": "embeddings", "corpus": told["corpus"]}
    status, one = post(json.dumps({"prompt": " Hello "}).encode())
    assert status == 200 and one["stub"] and post(json.dumps({"prompt": "hello"}).encode())[1]["neighbors"] == one["neighbors"]
    status, same = post(json.dumps({"text": "Hello"}).encode(), "/prompt/")
    assert status == 200 and same["neighbors"] == one["neighbors"] and (same["text"], same["model"]) == ("Hello", "stub")
    assert [post(b)[0] for b in (b"no json", b"{}", b'{"prompt": " "}', b"[1]")] == [400] * 4 and post(b"{}", "/other")[0] == 404
    server.shutdown()
    coords = spark.createDataFrame([(i, *map(float, c)) for i, c in enumerate(s.coords)], "row_id long, x double, y double, z double")
    query = spark.createDataFrame([(1, [float(v) for v in synthetic.stub_vector("hello", 16)])], "query_id long, embedding array<double>")
    batch = placement.place(query, e.select("row_id", "embedding").join(coords, "row_id"), radius=s.radius).first()
    assert list(batch.neighbors) == one["neighbors"] and np.allclose([batch.x, batch.y, batch.z], one["position"], atol=1e-3)
    assert np.allclose(batch.weights, one["weights"], atol=1e-4) and batch.confident == one["confident"]
    (tmp_path / artifacts.EMBEDDINGS).unlink()
    assert service.PromptService(tmp_path).rows.shape == (200, 3)
    with pytest.raises(FileNotFoundError):
        service.PromptService(tmp_path, encoder=lambda t: np.zeros(16))


def test_url_state():
    state = {"camera": [1.0, 2.5, -3.0, 0.0, 0.12, 9.0], "selected": 7, "query": "a & b", "filters": {"lang": "en", "x": ""}}
    assert url_state.read("#" + url_state.write(state)) == state | {"filters": {"lang": "en"}}
    assert url_state.read("cam=1,2,x&sel=-1&f.a=") == {"camera": None, "selected": None, "query": "", "filters": {}}
    assert url_state.write({}) == "" and url_state.read("cam=1,2,3,4,5,nan")["camera"] is None


def test_weights():
    w = service.weights(np.array([0.90, 0.88, 0.85, 0.80]))
    assert np.allclose(w, service.weights(np.array([0.90, 0.88, 0.85, 0.80]) - 0.65)) and abs(w[0] / w[-1] - np.e) < 1e-9
    assert np.allclose(service.weights(np.ones(4)), 0.25)


def test_stream_takes_up_only_what_is_new(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    source, sink, check = (str(tmp_path / p) for p in ("in", "out", "check"))
    run = lambda: ingest.ingest(spark, source, events.schema, sink, check)
    events.where("event_id % 2 = 0").coalesce(1).write.parquet(source)
    run()
    run()
    half = spark.read.parquet(sink).count()
    events.where("event_id % 2 = 1").coalesce(1).write.mode("append").parquet(source)
    run()
    assert half == events.where("event_id % 2 = 0").count() and spark.read.parquet(sink).count() == events.count()
    texts = spark.createDataFrame([(1, "a"), (2, "b")], "row_id long, text string")
    texts.write.parquet(str(tmp_path / "texts"))
    for _ in range(2):
        ingest.embed_shards(spark, str(tmp_path / "texts"), texts.schema, str(tmp_path / "shards"), str(tmp_path / "c2"), synthetic.stub_encoder(4))
    assert spark.read.parquet(str(tmp_path / "shards")).count() == 2


def test_prompts_as_a_stream(spark, tmp_path):
    e = synthetic.make_embeddings(spark, 80, 16, 4, seed=1)
    layout = e.select("row_id", "embedding", *[F.col("embedding")[k].alias(a) for k, a in enumerate("xyz")])
    prompts = spark.createDataFrame([(1, "one"), (2, "two")], "query_id long, text string")
    prompts.write.parquet(str(tmp_path / "p"))
    for _ in range(2):
        ingest.place_prompts(spark, str(tmp_path / "p"), layout, synthetic.stub_encoder(16), str(tmp_path / "o"), str(tmp_path / "c"), k=5)
    got = spark.read.parquet(str(tmp_path / "o")).collect()
    assert sorted(r.query_id for r in got) == [1, 2] and all(len(r.neighbors) == 5 for r in got)


def test_embed_with_a_model(spark):
    def factory():
        return lambda texts: np.array([[len(t), 1.0] for t in texts])

    df = spark.createDataFrame([(1, "abc"), (2, None), (3, "")], "row_id long, text string")
    assert {r.row_id: r.embedding for r in embedding.embed(df, factory, "row_id", "text", batch_size=2).collect()} == {1: [3.0, 1.0], 2: None, 3: [0.0, 1.0]}
    assert embedding.embed(df.limit(0), factory, "row_id", "text").collect() == []


def test_nearest_hit(spark):
    pixels = spark.createDataFrame([(5, 5, -1), (5, 6, 900), (7, 5, 8), (5, 3, 4), (0, 0, 1)], "x int, y int, id int")
    assert search.nearest_hit(pixels, 5, 5, 100).first()[0] == 4 and search.nearest_hit(pixels, 5, 5, 0).first()[0] is None


def test_command_line(spark, tmp_path):
    assert cli.main(["synth", "--n", "60", "--clusters", "3", "--out", str(tmp_path / "s")]) == 0
    assert cli.main(["verify", str(tmp_path / "s")]) == 0
    (tmp_path / "s" / artifacts.COLORS).write_bytes(b"")
    assert cli.main(["verify", str(tmp_path / "s")]) == 1
    assert cli.main(["--root", str(tmp_path), "doctor"]) == 1


def test_twins_of_many_parts_are_one_stream(spark, tmp_path, monkeypatch):
    """Parts are compressed by themselves; joined they are a single member, as a browser takes no more than one."""
    monkeypatch.setattr(artifacts, "ZIPPED", 50_000)
    raw = " ".join(str(i * i % 977) for i in range(100_000)).encode()
    (tmp_path / "text").write_bytes(raw)
    row = artifacts.examined(spark, str(tmp_path), ["text"], True).first()
    twin = (tmp_path / "text.gz").read_bytes()
    one = zlib.decompressobj(31)
    assert one.decompress(twin) == raw and one.eof and one.unused_data == b"" and len(raw) > 4 * artifacts.ZIPPED
    assert (row["gzip_bytes"], row["gzip_sha256"]) == (len(twin), hashlib.sha256(twin).hexdigest()) and len(twin) < 1.05 * len(gzip.compress(raw, 6))


def test_offsets_of_texts_over_four_gigabytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(artifacts, "MAX_U32", 1000)
    write_set(spark, tmp_path)
    assert (tmp_path / artifacts.LONG_OFFSETS).stat().st_size == 201 * 8 and not (tmp_path / artifacts.OFFSETS).exists()
    assert artifacts.verify(spark, str(tmp_path)).collect() == []
    assert [r.title for r in artifacts.load(spark, str(tmp_path))["records"].orderBy("row_id").collect()] == [f"ümläut 漢字 | ; x{i}" for i in range(200)]
