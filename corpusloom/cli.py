"""Command line: doctor, fetch, images, embed, project, synth, serve, verify."""

from __future__ import annotations

import argparse
import functools
import importlib
import importlib.util
import json
import platform
import secrets
import shutil
import sys
import urllib.error
import urllib.request
from importlib.metadata import PackageNotFoundError, version
from pathlib import Path

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

import corpusloom
from corpusloom import service
from corpusloom.operators import curation, embedding, gate, neighbors, raster, reduce, rows
from corpusloom.session import session
from corpusloom.sources import artifacts, fetch, metadata, settings, synthetic

TEXT_FIELDS = ["title", "artist", "object_date", "medium", "classification", "object_number", "object_id"]
OK, FAILED, GATE_FAILED = 0, 1, 2


def probe(url: str, open_=urllib.request.urlopen) -> str:
    """How a host answers a HEAD request; an HTTP error is an answer too."""
    try:
        with open_(urllib.request.Request(url, method="HEAD"), timeout=15) as answer:
            return f"HTTP {answer.status}"
    except urllib.error.HTTPError as e:
        return f"HTTP {e.code}"
    except OSError as e:
        return f"not reachable: {e}"


def doctor(args) -> int:
    """Versions, settings, folders and, where asked for, hosts."""
    print("python", platform.python_version())
    for package in ("pyspark", "pyarrow", "pandas", "numpy", "pillow"):
        try:
            print(package, version(package))
        except PackageNotFoundError:
            print(package, "is not installed")
    conf = settings.load(args.root)
    print("settings", conf.root)
    for section, keys in (("corpus", ("id", "target_n", "label_field", "facets")), ("model", ("id", "revision", "dim")), ("projection", ("umap_n_neighbors", "umap_min_dist"))):
        print(section, *(f"{k}={conf[section][k]}" for k in keys if k in conf[section]))
    for folder in ("artifacts", "data/sample"):
        path = conf.root / folder
        print("folder", folder, f"{len(list(path.iterdir()))} entries" if path.is_dir() else "is not there yet")
    if args.network:
        for key in ("metadata_url", "object_api"):
            if url := conf["corpus"].get(key):
                print(key, probe(url))
    return OK


def encoder_of(args):
    """The factory that ``--encoder package.module:name`` names, with device and settings bound; None for the stub."""
    if args.stub or not args.encoder:
        return None
    module, _, name = args.encoder.partition(":")
    try:
        factory = getattr(importlib.import_module(module), name)
    except (ImportError, AttributeError, ValueError) as e:
        raise settings.SettingsError(f"no encoder {args.encoder}: {e}") from e
    return functools.partial(factory, device=args.device or None)


def do_fetch(args) -> int:
    """Metadata CSV to corpus table and counters."""
    conf = settings.load(args.root)["corpus"]
    spark, out = session(), Path(args.out)
    csv = args.csv or fetch.download(conf["metadata_url"], str(out / "metadata.csv"), force=args.force)
    spec = curation.CorpusSpec(args.n or conf["target_n"], conf["label_field"], args.seed, conf.get("min_class_size", 20), conf.get("max_label_classes", 8), conf.get("facet_cap", 16), tuple(conf["facets"]))
    metadata.write_corpus(curation.build_corpus(metadata.read_metadata(spark, csv), spec), str(out / "corpus.parquet"))
    (out / "corpus.json").write_text(json.dumps(spec.stats, indent=2, ensure_ascii=False))
    print(json.dumps(spec.stats, ensure_ascii=False))
    return OK


def do_images(args) -> int:
    """Fetches images of corpus rows without a good journal entry."""
    spark, out = session(), Path(args.out)
    ids = metadata.read_corpus(spark, str(out / "corpus.parquet")).select(F.col("object_id").alias("id"))
    journal = str(out / "images.jsonl")
    todo = metadata.pending(ids, metadata.read_journal(spark, journal)) if Path(journal).exists() else ids

    def get(url: str) -> bytes:
        with urllib.request.urlopen(url, timeout=30) as answer:
            return answer.read()

    if args.size and importlib.util.find_spec("PIL") is None:
        raise metadata.SourceError("Pillow is needed to crop images; --size 0 keeps them as they are")
    transform = functools.partial(fetch.prepare_image, size=args.size) if args.size else bytes
    found = rows.materialise(fetch.fetch_images(todo, get, settings.load(args.root)["corpus"]["object_api"], workers=args.workers, transform=transform), "images")
    found.where("content is not null").select("id", "content").write.mode("append").parquet(str(out / "images.parquet"))
    found.select("id", "status", "detail").write.mode("append").json(journal)
    return OK


def do_embed(args) -> int:
    """Vectors of the corpus rows, of their images where an encoder is given; else by the stub, named in the table."""
    spark, out = session(), Path(args.out)
    corpus = metadata.read_corpus(spark, str(out / "corpus.parquet"))
    if factory := encoder_of(args):
        images = spark.read.parquet(str(out / "images.parquet")).dropDuplicates(["id"])
        there = corpus.join(images.withColumnRenamed("id", "object_id"), "object_id").select("row_id", "content")
        path = out / "embeddings.parquet"
        if path.exists() and (args.force or spark.read.parquet(str(path)).where(F.col("origin") != args.encoder).limit(1).count()):
            shutil.rmtree(path)  # another model's vectors
        encode = lambda part: embedding.embed(part, factory, "row_id", "content", batch_size=args.batch_size, half=args.half).withColumn("origin", F.lit(args.encoder))
        embedding.embed_in_shards(there, encode, str(path), shard_rows=args.shard_rows)
        return OK
    text = F.concat_ws(" ", *[F.col(c) for c in TEXT_FIELDS if c in corpus.columns])
    corpus.select("row_id", synthetic.stub_encoder(args.dim)(text).alias("embedding"), F.lit("stub").alias("origin")).write.mode("overwrite").parquet(str(out / "embeddings.parquet"))
    return OK


def _export(args, table, coords, near, k: int, label: str, facets: list[str], fields: list[str], vectors=None, **parts) -> None:
    writer = artifacts.ArtifactWriter(args.out, table.count())
    writer.add_coords(coords)
    writer.add_labels(table, label)
    writer.add_neighbors(near, k)
    if facets:
        writer.add_metadata(table, facets, fields)
    if vectors is not None:
        writer.add_embeddings(vectors, "embedding", vectors.select("origin").first()[0] if "origin" in vectors.columns else "synthetic")
    writer.finish(**parts)


def do_project(args) -> int:
    """Layout, gate and artefacts of an embedded corpus."""
    conf, spark, out = settings.load(args.root), session(), Path(args.out)
    p, label = conf["projection"], conf["corpus"]["label_field"]
    corpus = metadata.read_corpus(spark, str(out / "corpus.parquet"))
    if args.placeholder and not (out / "embeddings.parquet").exists():
        # a space without meaning, and the table and the manifest say so
        made = synthetic.make_embeddings(spark, corpus.count(), conf["model"]["dim"], 8, seed=args.seed)
        vectors = made.select("row_id", "embedding", F.lit("placeholder").alias("origin"))
    else:
        vectors = metadata.read_corpus(spark, str(out / "embeddings.parquet"))
    e = corpus.join(vectors, "row_id").withColumnRenamed("row_id", "corpus_row")
    e = rows.materialise(rows.dense_ids(e, "corpus_row"), "embedded")
    seed = secrets.randbits(32) if args.unseeded else args.seed
    spec = reduce.UmapSpec(neighbors=p["umap_n_neighbors"], min_dist=p["umap_min_dist"], epochs=args.epochs or p["umap_n_epochs"], seed=seed)

    k = min(conf["validation"].get("k", 15), e.count() - 1)

    def laid(x):
        layout, state, graph = reduce.project_with_graph(x, "row_id", "embedding", p["pca_components"], spec, k)
        return rows.materialise(layout, "layout"), state, graph.where(F.col("rank") <= k)

    # one graph, of the reduced space, for layout, gate and artefacts
    coords, state, near = laid(e)
    state.save(spark, str(out / "pca.parquet"))
    verdict = {}
    if not args.no_gate:
        mixed = rows.materialise(neighbors.shuffle_columns(e, "row_id", "embedding", args.seed), "shuffled").join(e.select("row_id", label), "row_id")
        other = laid(mixed)
        layouts = (coords, other[0])
        both = [x.select("row_id", "embedding", F.col(label).alias("label")).join(c, "row_id").select("row_id", "embedding", "label", F.array("x", "y", "z").alias("coords")) for x, c in zip((e, mixed), layouts, strict=True)]
        verdict = gate.run_gate(both[0], both[1], gate.GateSpec(k=k), high=near, high_shuffled=other[2]).first().asDict(True)
        (out / "gate.json").write_text(json.dumps(verdict, indent=2))
        raster.write_gate(out / "gate.png", *[c.join(e.select("row_id", label), "row_id") for c in layouts], label)
    _export(args, e, coords, near, k, label, list(conf["corpus"]["facets"]), TEXT_FIELDS, e.select("row_id", "embedding", "origin") if args.keep_embeddings else None, validation=verdict, projection=p | {"umap_n_epochs": spec.epochs, "seed": None if args.unseeded else args.seed, "explained": float(state.explained.sum())})
    return OK if verdict.get("passed", True) else GATE_FAILED


def do_synth(args) -> int:
    """Artefacts of synthetic clusters, with real neighbours in either mode."""
    spark = session()
    if args.mode == "coords":
        e = rows.materialise(synthetic.make_coords(spark, args.n, args.clusters, seed=args.seed).withColumn("embedding", F.array("x", "y", "z")), "synth")
        coords = e.select("row_id", "x", "y", "z")
    else:
        e = rows.materialise(synthetic.make_embeddings(spark, args.n, args.dim, args.clusters, seed=args.seed), "synth")
        coords = rows.materialise(reduce.project(e, "row_id", "embedding", 50, reduce.UmapSpec(seed=args.seed))[0], "layout")
    e = e.withColumn("name", synthetic.cluster_name(F.col("label"))).withColumn("title", synthetic.make_title(F.col("name"), F.col("row_id")))
    k = min(args.k, args.n - 1)
    metric = "euclidean" if args.mode == "coords" else "cosine"
    _export(args, e, coords, neighbors.knn(e, k, "row_id", "embedding", metric=metric), k, "name", ["name"], ["title"], e if args.keep_embeddings else None, corpus={"id": "synthetic"})
    return OK


def do_serve(args) -> int:
    factory = encoder_of(args)
    model = factory and factory()
    encode = (lambda text: np.asarray(model([text]))[0]) if model else None
    server = service.make_server(service.PromptService(args.out, encoder=encode, k=args.k, model=args.encoder if model else "stub"), args.host, args.port)
    print(f"http://{args.host}:{server.server_port}")
    server.serve_forever()
    return OK


def do_verify(args) -> int:
    problems = artifacts.verify(session(), args.path).collect()
    for r in problems:
        print(r["name"], r["problem"])
    return FAILED if problems else OK


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="corpusloom")
    top.add_argument("--root", default=".")
    top.add_argument("--version", action="version", version=f"corpusloom {corpusloom.__version__}")
    sub = top.add_subparsers(required=True)

    def command(name, run, **options):
        one = sub.add_parser(name)
        one.set_defaults(run=run)
        for option, default in options.items():
            kind = {"action": "store_true"} if default is False else {"default": default, "type": type(default) if default is not None else None}
            one.add_argument(f"--{option.replace('_', '-')}", **kind)
        return one

    command("doctor", doctor, network=False)
    command("fetch", do_fetch, n=0, seed=0, force=False, csv="", out="artifacts/run")
    command("images", do_images, size=224, workers=8, out="artifacts/run")
    command("embed", do_embed, dim=768, encoder="", stub=False, device="", batch_size=256, shard_rows=8192, half=False, force=False, out="artifacts/run")
    command("project", do_project, seed=0, epochs=0, no_gate=False, unseeded=False, placeholder=False, keep_embeddings=False, out="artifacts/run")
    command("synth", do_synth, n=1000, clusters=8, seed=0, dim=64, k=15, mode="coords", keep_embeddings=False, out="artifacts/synth")
    command("serve", do_serve, host="127.0.0.1", port=8765, k=12, encoder="", stub=False, device="", out="artifacts/run")
    command("verify", do_verify).add_argument("path")
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    shared = SparkSession.getActiveSession()  # a caller's session may still need its tables
    try:
        code = args.run(args)
        if not shared and (own := SparkSession.getActiveSession()):
            rows.clean(own)
        return code
    except (settings.SettingsError, curation.CorpusError, metadata.SourceError, artifacts.ArtifactError, FileNotFoundError) as e:
        print(e, file=sys.stderr)
        return FAILED


if __name__ == "__main__":
    sys.exit(main())
