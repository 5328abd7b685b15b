"""SQL statements over registered tables."""

import datetime as dt

import pytest

from creatorlens import jobs
from creatorlens.plans import reports as R
from creatorlens.plans import sql_reports as Q
from creatorlens.sources import marts, schemas
from creatorlens.sources.readers import write_table
from creatorlens.sources.sql import run_sql
from creatorlens.specs import DEFAULT_SPEC


def frame(spark, rows):
    return spark.createDataFrame(rows, "id int, name string, day date")


ROWS = [(1, "a", dt.date(2024, 4, 1)), (2, "b'; DROP", None), (3, None, dt.date(2024, 5, 1))]


def test_parameters_are_values(spark):
    df = frame(spark, ROWS)
    ask = lambda text, **p: [tuple(r) for r in run_sql(spark, text, p, t=df).collect()]
    assert ask("SELECT id FROM t WHERE name = :name", name="b'; DROP") == [(2,)]
    assert ask("SELECT id FROM t WHERE array_contains(:ids, id) ORDER BY id", ids=[1, 3], unused=1) == [(1,), (3,)]
    assert ask("SELECT id FROM t WHERE day > :day", day=dt.date(2024, 4, 2)) == [(3,)]
    assert ask("SELECT count(*) FROM t WHERE name = :name", name=None) == [(0,)]
    with pytest.raises(Exception, match="UNBOUND_SQL_PARAMETER"):
        ask("SELECT :missing FROM t")
    with pytest.raises(Exception, match="TABLE_OR_VIEW_NOT_FOUND"):
        ask("SELECT 1 FROM nowhere")


def test_views_end_with_the_statement(spark):
    df = frame(spark, ROWS)
    df.limit(1).createOrReplaceTempView("t")
    got = run_sql(spark, "SELECT count(*) AS n FROM t", t=df)
    assert got.first().n == 3 and spark.table("t").count() == 1  # the older view is back
    spark.catalog.dropTempView("t")
    run_sql(spark, "SELECT 1", t=df)
    assert not spark.catalog.tableExists("t")
    with pytest.raises(Exception):
        run_sql(spark, "SELECT nothing FROM t", t=df)
    assert not spark.catalog.tableExists("t")


def test_statements_equal_the_reports_for_other_roles(spark, sf):
    seg, items = marts.stored(spark, sf, "segments"), marts.stored(spark, sf, "items")
    for spec in (marts.MART_SPEC, DEFAULT_SPEC):
        assert Q.gap_by_sub_tier(seg, spec).collect() == R.gap_by_sub_tier(seg, spec).collect()
        assert Q.video_buckets(items, spec).collect() == R.video_retention_buckets(items, spec).collect()


def test_sql_job(spark, sf, tmp_path, capsys, monkeypatch):
    seg, items = marts.stored(spark, sf, "segments"), marts.stored(spark, sf, "items")
    write_table(seg.select(*schemas.CREATORS_CLEAN.names), f"{tmp_path}/creators_clean")
    write_table(items.select(*schemas.VIDEOS_CLEAN.names), f"{tmp_path}/videos_clean")
    (tmp_path / "q.sql").write_text(
        "SELECT c.archetype, count(*) AS n FROM creators c JOIN videos v USING (creator_id) WHERE c.archetype <> :role GROUP BY 1 ORDER BY 1"
    )
    monkeypatch.setattr(jobs, "build_session", lambda *a: spark)
    monkeypatch.setattr(jobs, "drop_scratch", lambda *a: None)
    jobs.main(["sql", "--data", str(tmp_path), "--query", str(tmp_path / "q.sql"), "--param", "role=5-LOW"])
    assert "result: 4 rows" in capsys.readouterr().out
    assert spark.read.parquet(f"{tmp_path}/results/sql/result").count() == 4
    with pytest.raises(SystemExit):
        jobs.main(["sql", "--data", str(tmp_path)])
