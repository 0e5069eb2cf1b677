import csv
import io
import json
import random

import numpy as np
import pytest
from pyspark.sql import types as T

from screenspark.sources import keyed_json as kj
from screenspark.sources import ranges, tables

ODD = ['diz "oi"', "a\\", '\\"', "\\\\\"", "{[,]}", "x\ny\r\nz", "é日本", "", " ", '","', "\\u0041", '"', '""', "a\\\\\\"]


def random_value(pick, depth=0):
    kind = pick.randint(0, 5 if depth < 3 else 3)
    if kind <= 1:
        return "".join(pick.choices(ODD, k=pick.randint(0, 4)))
    if kind == 2:
        return pick.choice([None, True, 12, -1.5])
    if kind == 3:
        return pick.choice(ODD)
    if kind == 4:
        return [random_value(pick, depth + 1) for _ in range(pick.randint(0, 3))]
    return {pick.choice(ODD) + str(i): random_value(pick, depth + 1) for i in range(pick.randint(0, 3))}


def states_of(data, size, is_json):
    """The states of all ranges as sums over the ranges before them, without Spark."""
    quoted = depth = 0
    for start in range(0, len(data), size):
        end = min(start + size, len(data))
        yield start, end, quoted, depth
        odd, outside, inside = ranges.scan_range(io.BytesIO(data), start, end, is_json)
        depth += inside if quoted else outside
        quoted ^= odd
    assert quoted == 0 and (depth == 0 or not is_json)


def json_entries(data, size, whole=False):
    return [r for a, b, q, d in states_of(data, size, True) for r in ranges.json_records(io.BytesIO(data), a, b, len(data), q, d, whole)]


def csv_entries(data, size):
    return [r for a, b, q, _ in states_of(data, size, False) for r in ranges.csv_records(io.BytesIO(data), a, b, len(data), q)]


@pytest.mark.parametrize("block", [3, 64, 1 << 20])
def test_every_split_of_a_keyed_object_gives_its_records(monkeypatch, block):
    monkeypatch.setattr(ranges, "BLOCK", block)
    monkeypatch.setattr(ranges, "TAIL", block)
    for seed in range(25):
        pick = random.Random(seed)
        base = {pick.choice(ODD) + str(i): {"v": random_value(pick)} for i in range(pick.randint(0, 6))}
        text = json.dumps(base, ensure_ascii=seed % 2 == 0, indent=pick.choice([None, 2]))
        data = pick.choice([b"", ranges.BOM]) + pick.choice([b"", b" \n"]) + text.encode() + pick.choice([b"", b"\n"])
        for size in (1, 2, 3, 5, 7, 16, 33, 777, len(data)):
            got = json_entries(data, size)
            assert [json.loads(b"{" + r + b"}") for r in got] == [{k: v} for k, v in base.items()]
            assert [json.loads(r) for r in json_entries(data, size, whole=True)] == [base]


def test_every_split_of_a_list_gives_its_values():
    for seed in range(20):
        pick = random.Random(seed)
        base = [random_value(pick) for _ in range(pick.randint(0, 6))]
        data = json.dumps(base, indent=pick.choice([None, 1])).encode()
        for size in (1, 2, 4, 9, 50, len(data)):
            assert [json.loads(r) for r in json_entries(data, size)] == base


@pytest.mark.parametrize("text", [b"{} x", b"x {}", b'{"a": 1,}', b'{"a": 1,, "b": 2}', b"{,}"])
def test_text_beside_the_records_is_an_error(text):
    for size in (1, 2, 3, 100):
        with pytest.raises(ValueError, match="malformed"):
            json_entries(text, size)


@pytest.mark.parametrize("block", [1, 5, 1 << 20])
def test_every_split_of_a_csv_gives_its_records(monkeypatch, block):
    monkeypatch.setattr(ranges, "BLOCK", block)
    monkeypatch.setattr(ranges, "TAIL", block)
    for seed in range(25):
        pick = random.Random(seed)
        rows = [[pick.choice(ODD) + pick.choice(ODD) for _ in range(3)] for _ in range(pick.randint(1, 8))]
        out = io.StringIO()
        csv.writer(out, lineterminator=pick.choice(["\n", "\r\n"]), quoting=pick.choice([csv.QUOTE_ALL, csv.QUOTE_MINIMAL])).writerows(rows)
        data = out.getvalue().encode()[: -1 if pick.random() < 0.3 and out.getvalue().endswith('"\n') else None]
        for size in (1, 2, 3, 8, 40, 777, len(data)):
            got = [next(csv.reader(io.StringIO(r.decode(), newline=""))) for r in csv_entries(data, size)]
            assert got == rows


def test_quotes_after_backslashes():
    for text in (rb'\"', rb'\\"', rb'"\\\"x"', rb'\\', b"", rb'a\"b\\"c\\\"'):
        for escaped in (False, True):
            want, skip = [], escaped
            for i, c in enumerate(text):
                if skip:
                    skip = False
                elif c == ranges.BACKSLASH:
                    skip = True
                elif c == ranges.QUOTE:
                    want.append(i)
            got, after = ranges.quote_positions(np.frombuffer(text, np.uint8), True, escaped)
            assert (got.tolist(), after) == (want, skip)


RECORD = T.StructType([T.StructField("v", T.StringType()), T.StructField("n", T.StructType([T.StructField("x.y", T.LongType())]))])


def written_base(folder, n, files=2):
    pick = random.Random(n)
    base = {f"k{i}": {"v": pick.choice(ODD) * pick.randint(0, 60), "n": {"x.y": i}} for i in range(n)}
    keys = list(base)
    for f in range(files):
        (folder / f"{f}.json").write_text(json.dumps({k: base[k] for k in keys[f::files]}, ensure_ascii=False, indent=f or None))
    return base


@pytest.mark.parametrize("split", [777, 3000, None])
def test_one_large_keyed_file_is_read_by_many_tasks(spark, tmp_path, split):
    base = written_base(tmp_path, 120)
    docs = kj.read_documents(spark, str(tmp_path), split_bytes=split)
    if split:
        size = sum(f.stat().st_size for f in tmp_path.iterdir())
        assert docs.rdd.getNumPartitions() >= max(3, size // split)
    rows = kj.flatten_keyed_json(docs, RECORD, "id").collect()
    assert sorted(map(tuple, rows)) == sorted((k, v["v"], v["n"]["x.y"]) for k, v in base.items())
    assert set(kj.keyed_json_schema(docs).names) == {"v", "n"}


def test_broken_large_files_are_an_error(spark, tmp_path):
    for i, text in enumerate(['{"a": {"v": "x"}', '{"a": {"v": "x}}', '["a", "b"]', '{"a": {"v": x}, "b": {}}']):
        path = tmp_path / f"{i}.json"
        path.write_text(text)
        with pytest.raises(Exception, match="malformed|MALFORMED"):
            kj.flatten_keyed_json(kj.read_documents(spark, str(path), split_bytes=5), RECORD, "id").collect()


def test_compressed_files_are_refused_beside_large_ones(spark, tmp_path):
    (tmp_path / "a.json.gz").write_bytes(b"xxxxxxxxxxxxxxxxxxxx")
    (tmp_path / "b.json").write_text('{"k": {"v": "x"}}')
    with pytest.raises(Exception, match="cannot be split"):
        kj.read_documents(spark, str(tmp_path), split_bytes=5).collect()


def test_keyed_objects_are_written_one_per_task(spark, tmp_path):
    rows = spark.range(0, 50, 1, 3).selectExpr("id", "concat('v', id) AS v").filter("id > 20")
    docs = rows.select(kj.keyed_document(rows["id"], rows["v"]).alias("value"))
    kj.write_documents(docs, str(tmp_path / "out"))
    texts = [f.read_text() for f in (tmp_path / "out").glob("part-*")]
    assert len(texts) == 3 and {k: v for t in texts for k, v in json.loads(t).items()} == {str(i): f"v{i}" for i in range(21, 50)}


@pytest.mark.parametrize("split", [50, 777, None])
def test_csv_with_line_breaks_is_read_by_many_tasks(spark, tmp_path, split):
    pick = random.Random(4)
    rows = [(str(i), pick.choice(ODD[:9]) + "x" * pick.randint(1, 9), None if i % 5 else float(i)) for i in range(60)]
    schema = "id string, `c v` string, n double"
    tables.write_csv(spark.createDataFrame(rows, schema).repartition(2), str(tmp_path / "t"))
    got = tables.read_table(spark, str(tmp_path / "t"), schema, split_bytes=split)
    assert got.rdd.getNumPartitions() > 2 or split in (777, None)
    assert got.columns == ["id", "c v", "n"]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, tables.read_csv(spark, str(tmp_path / "t"), schema).collect()))
    assert sorted(r[:2] for r in got.collect()) == sorted(r[:2] for r in rows)


@pytest.mark.parametrize("text", ['[{"a": 1, "b": {"c": 2.5}},\n {"a": 2}]', '{"a": 3, "b": {"c": 1.5}}', "[]"])
def test_large_json_tables_equal_whole_ones(spark, tmp_path, text):
    (tmp_path / "t.json").write_text(text)
    whole = tables.read_json_table(spark, str(tmp_path / "t.json"))
    got = tables.read_json_table(spark, str(tmp_path / "t.json"), split_bytes=7 if len(text) > 7 else 1)
    assert got.dtypes == whole.dtypes
    if got.columns:
        assert sorted(map(str, got.collect())) == sorted(map(str, whole.collect()))


def test_many_ranges_share_few_tasks(spark):
    every = spark.range(5000).selectExpr("'/x' path", "5000L length", "id start", "id + 1 end")
    dealt = ranges._spread(every)
    assert dealt.rdd.getNumPartitions() == max(ranges.TASKS, 4 * spark.sparkContext.defaultParallelism)
    assert dealt.agg({"start": "sum"}).first()[0] == sum(range(5000))
    assert ranges._spread(every.limit(3)).rdd.getNumPartitions() == 3
