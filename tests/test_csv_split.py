"""CSV files with quoted line breaks, read by several tasks."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creatorlens.sources import csv_split
from creatorlens.sources.readers import POSITION, read_strings, read_typed, write_table

SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in "pqr"])


@pytest.fixture
def small_blocks(spark):
    """Blocks of a few hundred bytes, so that records cross them."""
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set(name, "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    yield
    spark.conf.set(name, before)
    spark.conf.set("spark.sql.files.openCostInBytes", cost)


def cell(rng):
    text = "".join(rng.choice(["a", "b", ",", "\n", "\n", '"', "é", " ", "x\ny"]) for _ in range(rng.choice([0, 3, 8, 40])))
    return '"' + text.replace('"', '""') + '"' if any(c in text for c in ',"\n') or rng.random() < 0.2 else text


def made(folder, ends="\n"):
    rng = random.Random(len(ends))
    folder.mkdir()
    for f, header in enumerate(("p,q,r", "r,q,p", "q,x,r,p", "p,q,r")):
        rows = [",".join(f"k{f}-{i}" if h == "p" else cell(rng) for h in header.split(",")) for i in range(200)]
        rows.insert(50, ",".join('"' + "long\n" * 400 + '"' if h == "q" else "k" for h in header.split(",")))  # over several blocks
        last = "" if f == 1 else ends
        (folder / f"f{f}.csv").write_bytes((("﻿" if f == 2 else "") + ends.join([header, *rows]) + last).encode())
    return str(folder)


@pytest.mark.parametrize("ends", ["\n", "\r\n"])
def test_split_files_give_the_rows_of_whole_files(spark, small_blocks, tmp_path, ends):
    path = made(tmp_path / "t", ends)
    got = read_strings(spark, path, SCHEMA, quoted_breaks=True)
    want = read_strings(spark, path, SCHEMA, with_position=False, multi_line=True)
    assert sorted(map(tuple, got.drop(POSITION).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    # in several tasks, and in the order of the file
    assert csv_split.records(spark, [f"{path}/f0.csv"]).rdd.getNumPartitions() > 5
    keys = [r.p for r in got.orderBy(POSITION).collect() if r.p and r.p.startswith("k0-")]
    assert keys == [f"k0-{i}" for i in range(200)]
    assert got.select(POSITION).distinct().count() == got.count() == 804


def test_states_unknown_to_the_tasks(spark, small_blocks, tmp_path):
    """Without the list of blocks that begin inside quotes both states are tried."""
    path = made(tmp_path / "t")
    files = [f"{path}/f{i}.csv" for i in range(4)]
    known, tried = (csv_split.records(spark, files, n).collect() for n in (10**6, 0))
    assert sorted(known) == sorted(tried) and len(known) == 808


def test_first_lines_come_from_tasks(spark, small_blocks, tmp_path):
    path = made(tmp_path / "t")
    (tmp_path / "t" / "empty.csv").write_text("")
    got = {f.rsplit("/", 1)[1]: h for f, h in csv_split.first_lines(spark, path)}
    assert got == {"f0.csv": "p,q,r", "f1.csv": "r,q,p", "f2.csv": "q,x,r,p", "f3.csv": "p,q,r"}


def test_quote_never_closed_and_malformed_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text('p,q,r\n1,2,3\n4,"5,6\n7,8,9\n')
    got = read_strings(spark, str(tmp_path / "a.csv"), SCHEMA, with_position=False, quoted_breaks=True, fail_on_malformed=False).collect()
    assert len(got) == 2 and got[0].r == "3"
    (tmp_path / "b.csv").write_text('p,q,r\n1,"2\n2"\n')
    with pytest.raises(Exception, match="too many or too few cells"):
        read_strings(spark, str(tmp_path / "b.csv"), SCHEMA, quoted_breaks=True).collect()


def test_round_trip_of_line_breaks(spark, small_blocks, tmp_path):
    df = spark.range(500).select(
        F.col("id").cast("int").alias("n"), F.concat(F.lit('say "'), F.repeat(F.lit("a\n"), (F.col("id") % 30).cast("int")), F.lit('",')).alias("t")
    )
    path = str(tmp_path / "t")
    write_table(df, path, "csv")
    got = read_typed(spark, path, df.schema, "csv", quoted_breaks=True)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, df.collect()))
