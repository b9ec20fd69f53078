"""CSV files with quoted line breaks, cut into byte ranges."""

import csv
import random

import pytest
from frames import values

from gapspark.sources import csv_files, csv_ranges

MAX = "spark.sql.files.maxPartitionBytes"


def rows_of(seed, n=60):
    rng = random.Random(seed)
    parts = ["a", '"', "\n", ",", " ", "é🎉", "\n\n", '""', "word ", "\r\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(n)]
    return [(str(i), t, "x") for i, t in enumerate([*texts, "\n" * 500, "line, \n" * 300])]


def write(path, rows, end="\n"):
    with open(path, "w", newline="", encoding="utf-8") as file:
        out = csv.writer(file, lineterminator=end)
        out.writerow(("id", "text", "a b"))
        out.writerows(rows)


@pytest.fixture
def ranges(spark):
    before = spark.conf.get(MAX)
    yield lambda size: spark.conf.set(MAX, str(size))
    spark.conf.set(MAX, before)


@pytest.mark.parametrize("size", [40, 333, 4096, 10**8])
def test_equal_to_the_one_task_reader(spark, tmp_path, ranges, size):
    write(tmp_path / "a.csv", rows_of(1))
    write(tmp_path / "b.csv", rows_of(2))
    (tmp_path / "empty.csv").write_text("")
    want = csv_files.read_csv(spark, str(tmp_path), multiline=True)
    expected, columns = sorted(values(want), key=str), want.columns
    ranges(size)
    got = csv_ranges.read_csv_ranges(spark, str(tmp_path))
    assert got.columns == columns == ["id", "text", "a b"]
    assert sorted(values(got), key=str) == expected and len(expected) == 124
    if size == 40:
        assert csv_ranges.lines_of(spark, str(tmp_path)).select(*csv_ranges.RANGE).distinct().count() > 50


def test_a_record_over_many_ranges_and_line_ends_with_carriage_returns(spark, tmp_path, ranges):
    rows = [("1", "plain", "y"), ("2", "long \n" * 200, "z"), ("3", "", "")]
    write(tmp_path / "a.csv", rows, "\r\n")
    ranges(64)
    got = dict((r[0], r[1:]) for r in values(csv_ranges.read_csv_ranges(spark, str(tmp_path))))
    assert got == {"1": ("plain", "y"), "2": ("long \n" * 200, "z"), "3": (None, None)}


def test_a_header_alone_and_unpaired_quotes(spark, tmp_path):
    write(tmp_path / "a.csv", [])
    assert csv_ranges.read_csv_ranges(spark, str(tmp_path)).count() == 0
    (tmp_path / "b.csv").write_text('id,text,a b\n1,"open,x\n')
    with pytest.raises(Exception, match="do not pair up"):
        csv_ranges.read_csv_ranges(spark, str(tmp_path)).collect()
