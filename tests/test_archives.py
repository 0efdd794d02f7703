"""Zip members and one JSON object against the standard library, on odd bytes and tiny ranges."""

import json
import random
import zipfile

import numpy as np
import pytest

from lakelens.sources import archives as A


def test_zip_members(spark, tmp_path):
    lines = {"a.json": [json.dumps({"id": str(i), "t": "é\\" * (i % 3)}) for i in range(5000)], "b.json": ["not json", "", json.dumps({"id": "7"}), json.dumps([1]), json.dumps({"id": 7})], "empty": []}
    for archive in ("x.zip", "y.zip"):
        with zipfile.ZipFile(tmp_path / archive, "w", zipfile.ZIP_DEFLATED) as z:
            z.mkdir("folder")
            for name, rows in lines.items():
                z.writestr(name, "\n".join(rows) + ("\n" if rows else ""))
    (tmp_path / "other.txt").write_text("no archive")
    rows = A.read_zip_lines(spark, str(tmp_path))
    got = sorted((r.archive, r.member, r.line, r.value) for r in rows.collect())
    assert got == sorted((a, m, i, x) for a in ("x.zip", "y.zip") for m, v in lines.items() for i, x in enumerate(v))
    assert rows.rdd.getNumPartitions() == 6
    one = rows.filter("member = 'b.json' and archive in ('x.zip', 'z.zip')")
    assert one.rdd.getNumPartitions() == 1 and [r.value for r in one.orderBy("line").collect()] == lines["b.json"]
    assert rows.filter("member = 'none'").count() == 0
    found = A.read_zip_lines(spark, str(tmp_path / "x.zip"), "id", ["7", "12", "nowhere"]).collect()
    assert sorted((r.member, r.line) for r in found) == [("a.json", 7), ("a.json", 12), ("b.json", 2)]


def entries(n, seed):
    rng = random.Random(seed)
    parts = ["a", "é", "\\", '"', "{", "}", "[", "]", ",", ":", "\n", "🙂", "\\\\", '\\"']

    def value(depth):
        kind = rng.random()
        if kind < 0.5 or depth > 2:
            return "".join(rng.choices(parts, k=rng.randint(0, 12)))
        if kind < 0.7:
            return [value(depth + 1) for _ in range(rng.randint(0, 3))]
        return {str(i): value(depth + 1) for i in range(rng.randint(0, 3))} if kind < 0.9 else rng.choice([None, True, 1.5, -3])

    return {"".join(rng.choices(parts, k=4)) + str(i): value(0) for i in range(n)}


@pytest.mark.parametrize(("size", "n"), [(37, 40), (1000, 300), (1 << 20, 5)])
def test_one_object_in_ranges(spark, tmp_path, size, n):
    want = entries(n, size)
    for indent in (None, 2):
        path = tmp_path / f"{size}-{indent}.json"
        path.write_text(json.dumps(want, ensure_ascii=False, indent=indent))
        df = A.read_json_object(spark, str(path), size)
        got = {r.key: json.loads(r.value) for r in df.collect()}
        assert got == want and df.count() == n
        assert df.rdd.getNumPartitions() == -(-path.stat().st_size // size)


def test_empty_broken_and_large_objects(spark, tmp_path):
    for name, text in (("e", "{}"), ("w", " {\n } \n")):
        (tmp_path / name).write_text(text)
        assert A.read_json_object(spark, str(tmp_path / name), 2).count() == 0
    (tmp_path / "cut").write_text('{"a": [1, 2')
    with pytest.raises(Exception, match="ends inside"):
        A.read_json_object(spark, str(tmp_path / "cut"), 4).collect()
    path = tmp_path / "large.json"
    path.write_text(json.dumps({f"{i:07d}": [f"{j:09d}" for j in range(i % 20)] for i in range(400_000)}))
    df = A.read_json_object(spark, str(path), 8 << 20)
    assert path.stat().st_size > 45e6 and df.rdd.getNumPartitions() >= 6
    one = df.selectExpr("count(*) AS n", "count(DISTINCT key) AS k", "sum(size(from_json(value, 'array<string>'))) AS x").first()
    assert (one.n, one.k, one.x) == (400_000, 400_000, sum(i % 20 for i in range(400_000)))


def test_quotes_after_backslashes():
    data = np.frombuffer(b'\\"a"\\\\"', np.uint8)
    assert A.quotes(data, 0).nonzero()[0].tolist() == [3, 6] and A.quotes(data, 1).nonzero()[0].tolist() == [1, 3, 6]
