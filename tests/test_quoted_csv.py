"""Files with quoted newlines read in byte ranges, against the csv module and
Spark's multi-line reader."""

import csv
import io as text_io
import random

import pytest
from pyspark.sql import functions as F

from kestrel.sources import io, quoted_csv


def field(rng, letters, sep):
    t = "".join(rng.choice(letters) for _ in range(rng.randrange(30)))
    plain = not any(c in t for c in '"\n\r' + sep)
    return t if plain and rng.random() < 0.7 else '"' + t.replace('"', '""') + '"'


def made(seed, rows, letters, sep="\t", end="\n", last=True):
    rng = random.Random(seed)
    text = end.join(sep.join([str(i), field(rng, letters, sep), field(rng, letters, sep)]) for i in range(rows))
    return text + (end if last else "")


def by_module(text, sep):
    return [tuple(r) for r in csv.reader(text_io.StringIO(text, newline=""), delimiter=sep) if r]


@pytest.mark.parametrize("range_bytes", [16, 61, 500, 1 << 20])
def test_same_records_for_any_ranges(spark, tmp_path, range_bytes):
    rows = 60 if range_bytes < 50 else 400
    text = made(range_bytes, rows, 'ab"\n\r\t,é ')
    (tmp_path / "p.tsv").write_bytes(text.encode())
    got = io.read_passages(spark, str(tmp_path / "p.tsv"), split=True, range_bytes=range_bytes).collect()
    assert sorted((r.pid, r.text, r.title) for r in got) == [(int(a), b, c) for a, b, c in by_module(text, "\t")]


def test_every_cut_of_a_small_file(spark, tmp_path):
    """Each range length from the shortest: a cut stands at every byte."""
    text = '1\t"a\n""\nb"\tx\n\n2\t"\n\n"\t""\n3\tp\t"q\n"\n'
    (tmp_path / "p.tsv").write_text(text)
    want = [(1, 'a\n"\nb', "x"), (2, "\n\n", ""), (3, "p", "q\n")]
    for n in range(2, len(text) + 2, 3):
        got = io.read_passages(spark, str(tmp_path / "p.tsv"), split=True, range_bytes=n).collect()
        assert sorted((r.pid, r.text, r.title) for r in got) == want, n


def test_equals_the_multi_line_reader(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"oe_d{k}.csv").write_text("id,x,y\n" + made(k, 150, 'ab"\n,é ', sep=",", last=k > 0))
    schema = "id long, x string, y string"
    for dropna, least in ((False, 450), (True, 1)):  # a bare empty field is null
        want = io.read_qa_dir(spark, str(tmp_path), schema, dropna=dropna, split=False)
        got = io.read_qa_dir(spark, str(tmp_path), schema, dropna=dropna, split=True, range_bytes=700)
        assert got.columns == want.columns and want.count() >= least
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_more_tasks_than_files_and_settings_come_back(spark, tmp_path):
    (tmp_path / "p.tsv").write_text(made(1, 500, 'ab"\n '))
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.minPartitionNum", "spark.sql.files.openCostInBytes"]
    before = [spark.conf.get(n, None) for n in names]
    r = quoted_csv.read_records(spark, str(tmp_path / "p.tsv"), "\t", range_bytes=1000)
    assert [spark.conf.get(n, None) for n in names] == before
    assert r.select("_offset").distinct().count() > 5 and r.count() == 500
    assert r.groupBy("_file", "_offset", "_mono").count().where("count > 1").count() == 0


def test_line_ends_marks_and_empty_files(spark, tmp_path):
    a, b, c = (tmp_path / n for n in "abc")
    a.write_bytes("﻿1\t\"x\r\ny\"\tz\r\n2\tp\tq".encode())
    b.write_bytes(b"")
    c.mkdir()
    got = io.read_passages(spark, str(a), fmt="tsv", split=True, range_bytes=9).collect()
    assert sorted((r.pid, r.text, r.title) for r in got) == [(1, "x\r\ny", "z"), (2, "p", "q")]
    assert io.read_passages(spark, str(b), fmt="tsv", split=True).count() == 0
    assert io.read_passages(spark, str(c), fmt="tsv", split=True).count() == 0


def test_a_carriage_return_in_the_first_field(spark, tmp_path):
    """Read whole, and written and read back."""
    (tmp_path / "p.tsv").write_bytes(b'1\t"x\ry"\tt\n2\tp\tq\n3\tr\ts\n')
    rows = sorted(tuple(r) for r in io.read_passages(spark, str(tmp_path / "p.tsv")).collect())
    assert rows == [(1, "t", "x\ry"), (2, "q", "p"), (3, "s", "r")]
    df = spark.createDataFrame([(i, f"t{i}", f"a\r{i}\r\n\"b\"") for i in range(20)], "pid long, title string, text string").coalesce(1)
    io.write_passages(df, str(tmp_path / "w.tsv"))
    back = io.read_passages(spark, str(tmp_path / "w.tsv"), range_bytes=64)
    assert sorted(back.collect()) == sorted(df.collect())


@pytest.mark.parametrize("text", ['1\ta"b\tc\n2\td"e\tf\n', '1\t"a"b\tc\n', '1\t"open\tc\n2\td\te\n'])
def test_loose_quotes_are_refused(spark, tmp_path, text):
    (tmp_path / "p.tsv").write_text(text)
    with pytest.raises(ValueError, match="quotes"):
        io.read_passages(spark, str(tmp_path / "p.tsv"), split=True)


def test_doubled_quotes_are_no_loose_ones(spark):
    cells = ['""', '""""', '""""""', '"a"""', '"""a"', '"a""b"', "", "x"]
    df = spark.createDataFrame([(f"{a}\t{b}\t{c}",) for a in cells for b in cells for c in cells], "r string")
    assert df.where(~quoted_csv._well_quoted("r", "\t")).count() == 0
    assert df.select(F.count("*")).first()[0] == len(cells) ** 3
