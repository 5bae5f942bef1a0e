import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.sources import csv_ranges


def sequential(spark, path):
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return [tuple(r) for r in rows.withColumn("src_ord", F.monotonically_increasing_id()).orderBy("src_ord").drop("src_ord").collect()]


def ranged(spark, path, size):
    found = csv_ranges.scan(spark, path, size)
    rows = sorted(map(tuple, found.collect()))
    assert [r[0] for r in rows] == list(range(len(rows)))
    return [r[1:] for r in rows]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_equals_the_sequential_scan_at_every_border(spark, tmp_path, end):
    rng = random.Random(4)
    value = lambda: rng.choice(["", "a", 'say ""x""', "two\nlines", 'a ""\n""', ",", "\n", '""', "x,y\n\nz", "plain", " é "])
    field = lambda: f'"{value()}"' if rng.random() < 0.7 else rng.choice(["u", "", '5" tall', "NA"])
    lines = [",".join(["k" + str(i), *[field() for _ in range(3)]]) for i in range(40)]
    lines[7:7] = [""]
    path = tmp_path / "one.csv"
    path.write_bytes(("id,b,c d,e`f" + end + end.join(lines) + rng.choice(["", end])).encode())
    want = sequential(spark, str(path))
    assert len(want) == 40
    size = path.stat().st_size
    for bytes_ in (17, 64, size):
        assert ranged(spark, str(path), bytes_) == want
    with_ranges = csv_ranges.records(spark, str(path), 64)
    assert with_ranges.count() == 41


def test_a_quote_at_each_place_of_a_range(spark, tmp_path):
    for shift in range(9):
        path = tmp_path / f"{shift}.csv"
        out = io.StringIO()
        writer = csv.writer(out, lineterminator="\n")
        writer.writerow(["a" * (shift + 1), "b"])
        rows = [[str(i), 'q"' * (i % 3) + "\n" * (i % 4) + "z"] for i in range(12)]
        writer.writerows(rows)
        path.write_text(out.getvalue())
        assert ranged(spark, str(path), 9) == [tuple(r) for r in rows]


def test_folders_and_files_without_records(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    for i, n in enumerate((3, 0, 2)):
        (folder / f"{i}.csv").write_text("a,b\n" + "".join(f'{i}{j},"x\n{j}"\n' for j in range(n)))
    assert ranged(spark, str(folder), 8) == [("00", "x\n0"), ("01", "x\n1"), ("02", "x\n2"), ("20", "x\n0"), ("21", "x\n1")]
    (tmp_path / "open.csv").write_text('a,b\n1,"never\nclosed\n')
    assert csv_ranges.records(spark, str(tmp_path / "open.csv"), 5).count() == 2
