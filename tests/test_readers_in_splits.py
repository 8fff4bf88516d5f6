"""Readers give the same rows however their files are cut into splits."""

import json
import random
import time

import pytest

from strataline.sources import readers


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300b")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield spark
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_log(small_splits, tmp_path):
    lines, expected, name = ["1\t1\tbefore any header"], [], None
    for i in range(60):
        name = f"N{i}"
        lines.append(f"@@\t{name}\tn{i}@x\t2024-01-{i % 28 + 1:02d}T00:00:00Z")
        for j in range(i % 11):
            lines.append(f"{j}\t-\tf{i}.{j}")
            expected.append((i + 1, name, f"n{i}@x", j, 0, f"f{i}.{j}"))
        lines.append("")
    (tmp_path / "log.txt").write_text("\n".join(lines))
    log = readers.numstat(small_splits, str(tmp_path / "log.txt"))
    assert small_splits.read.text(str(tmp_path / "log.txt")).rdd.getNumPartitions() > 5
    assert sorted(tuple(r)[1:] for r in log.collect()) == sorted(expected)
    late = readers.numstat(small_splits, str(tmp_path / "log.txt"), since="2024-01-20")
    assert sorted(r["path"] for r in late.collect()) == sorted(e[-1] for e in expected if (e[0] - 1) % 28 + 1 >= 20)


def test_clones(small_splits, tmp_path):
    one = "Clone found (go):\n - a{0}.go [{0}:1 - 2{0}:2] (10 lines)\n   b.go [5:1 - 15:2]\n\n"
    (tmp_path / "clones.txt").write_text("header\n" + "".join(one.format(i) for i in range(1, 80)) + "Found 79 clones.\n")
    found = readers.clone_pairs(small_splits, str(tmp_path / "clones.txt"))
    assert found.rdd.getNumPartitions() > 1
    assert sorted((r["a_from"], r["a_to"], r["span"]) for r in found.collect()) == [(i, int(f"2{i}"), int(f"2{i}") - i) for i in range(1, 80)]


def _objects(seed, n):
    r = random.Random(seed)

    def value(deep):
        kind = r.randrange(5)
        if kind == 0 and deep:
            return {r.choice(["a", "}", '{"', "\\", "é"]): value(deep - 1) for _ in range(r.randrange(3))}
        if kind == 1 and deep:
            return [value(deep - 1) for _ in range(r.randrange(3))]
        return "".join(r.choices(["}", "{", '"', "\\", "é", "x", "\n", " "], k=r.randrange(8)))

    return [{"k": i, "v": json.dumps(value(3)), "w": value(3)} for i in range(n)], r


@pytest.mark.parametrize("size", ["37b", "300b", "1g"])
def test_json_stream(small_splits, tmp_path, size):
    objects, r = _objects(4, 200)
    text = "".join(json.dumps(o, ensure_ascii=r.random() < 0.5) + r.choice(["", "\n", "  "]) for o in objects)
    (tmp_path / "a.json").write_text(text + '{"k":1000,"v":"cut off"')
    (tmp_path / "b.json").write_text(text + "\n \n")
    (tmp_path / "c.json").write_text("")
    (tmp_path / "d.json").write_text('{"k": 1, "v": "}" }{"k": "no number"} {"k":2,"v":null}{}')
    small_splits.conf.set("spark.sql.files.maxPartitionBytes", size)
    got = [tuple(x) for x in readers.json_stream(small_splits, str(tmp_path), "k long, v string").collect()]
    assert got[:400] == [(o["k"], o["v"]) for o in objects] * 2
    assert got[400:] == [(1, "}"), (None, None), (2, None), (None, None)]


def test_json_stream_is_linear(spark, tmp_path):
    # one file, quotes and braces in every string; the old way took the square of this
    n = 30_000
    (tmp_path / "a.json").write_text("".join(f'{{"k":{i},"v":"}}\\"{{{i}"}}' for i in range(n)))
    began = time.time()
    got = readers.json_stream(spark, str(tmp_path), "k long, v string").collect()
    assert [tuple(x) for x in got] == [(i, f'}}"{{{i}') for i in range(n)]
    assert time.time() - began < 60
