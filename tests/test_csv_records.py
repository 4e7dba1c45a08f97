"""CSV records that reach over lines, blocks and tasks."""

import random

import pytest

from quillgrid.sources import ingest, records


def write(folder, name, rows, end="\n", blank=False):
    cell = lambda c: '"' + c.replace('"', '""') + '"' if c is not None and set(c) & set('",\n\r') else c or ""
    text = (end + end if blank else end).join(",".join(map(cell, r)) for r in [("id", "body, long", "c"), *rows]) + end
    with open(f"{folder}/{name}", "w", newline="") as out:
        out.write(text)


def made_up(seed, n=400):
    r = random.Random(seed)
    parts = ["word", '"', "\n", ",", ' 5" ', '""', "\n\n", "é", "x" * 50, ' "q" ', "\n,\n", "a\r\nb"]
    return [(str(i), "".join(r.choices(parts, k=r.randrange(1, 9))) + "e", r.choice(["plain", "two\nlines", "z"])) for i in range(n)]


@pytest.fixture
def small_blocks(spark):
    held = [(k, spark.conf.get(k, None)) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "600")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in held:
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("seed,end", [(1, "\n"), (2, "\r\n"), (3, "\n")])
def test_every_record_is_found(spark, tmp_path, small_blocks, seed, end):
    one, two = made_up(seed), made_up(seed + 10, 150)
    write(tmp_path, "a.csv", one, end, blank=seed == 3)
    write(tmp_path, "b.csv", [("9" + i, *rest) for i, *rest in two], end)
    with open(f"{tmp_path}/c.csv", "w") as out:
        out.write('id,"body, long",c\n')
    df = ingest.csv_scan(spark, str(tmp_path))
    assert df.columns == ["id", "body, long", "c"] and dict(df.dtypes)["id"] == "bigint"
    got = sorted(map(tuple, df.collect()))
    assert got == sorted([(int(i), b, c) for i, b, c in one] + [(int("9" + i), b, c) for i, b, c in two])


def test_several_tasks_read_one_file(spark, tmp_path, small_blocks):
    write(tmp_path, "a.csv", made_up(5))
    lines = records._lines(spark, str(tmp_path))
    assert lines.rdd.getNumPartitions() > 20


def test_a_cell_of_many_blocks(spark, tmp_path, small_blocks):
    rows = [("1", "start\n" + "line, with comma\n" * 400 + "end", "x"), ("2", "b", "y"), ("3", '"\n' * 500, "z")]
    write(tmp_path, "a.csv", rows)
    assert sorted(map(tuple, ingest.csv_scan(spark, str(tmp_path)).collect())) == [(int(i), b, c) for i, b, c in rows]


def test_plain_files_are_read_as_ever(spark, tmp_path):
    write(tmp_path, "a.csv", [("1", "a, b", "x"), ("2", 'say "hi"', None)])
    assert records.quoted_records(spark, str(tmp_path)) is None
    assert sorted(map(tuple, ingest.csv_scan(spark, str(tmp_path)).collect())) == [(1, "a, b", "x"), (2, 'say "hi"', None)]


def test_states_of_lines():
    for line, outside, inside in [
        ("a,b", False, True), ('"a', True, False), ('a"b,c', False, False), ('"a""', True, False), ('"a""b",c', False, False),
        ('x,"', True, False), ('",x', True, False), ('","', False, True), ("", False, True),
    ]:
        assert records.ends_inside(line, False) == outside, line
        if '"' not in line:
            assert records.ends_inside(line, True) is inside
