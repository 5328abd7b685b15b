"""The jobs end to end on text exports, and the source and sink helpers."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creatorlens import fixed_values as fv
from creatorlens import jobs
from creatorlens.operators import segments as SG
from creatorlens.plans import cleaning as C
from creatorlens.plans import reports as R
from creatorlens.session import once
from creatorlens.sources import marts, schemas
from creatorlens.sources.readers import (
    MissingInputError,
    project_existing,
    read_strings,
    read_typed,
    register_views,
    with_column_if_absent,
    write_table,
)

ARCH = ["sub giants", "HR Niche Specialists", " viral chasers ", "CVB", "dabblers"]


def csv_line(cells):
    return ",".join('"' + str(c).replace('"', '""') + '"' if c is not None else "" for c in cells)


@pytest.fixture(scope="module")
def data(tmp_path_factory):
    """Text exports with the documented noise."""
    root = tmp_path_factory.mktemp("exports")
    rnd = random.Random(11)
    creators, videos = [], []
    for i in range(200):
        a = i % 5
        subs = rnd.randint(500, 900_000)
        views = rnd.randint(1_000, 500_000)
        rpm = round(rnd.uniform(1, 3) + (2 if a == 0 else 0), 2)
        creators.append([
            i, ARCH[a], rnd.choice(["fin", " Gaming ", "DIY/crafts", "Odd One", None]),
            f"{subs:,}" if i % 7 else "0", rnd.choice(["3 years", "18 months", "2.5 yrs", "4.1"]),
            round(rnd.uniform(20, 60) + (15 if a == 1 else 0), 2) if i % 9 else (150 if i % 2 else None),
            round(rnd.uniform(2, 8), 2), "6/month" if i % 2 else rnd.randint(1, 25),
            round(rnd.uniform(5, 25), 2), round(rnd.uniform(0, 8), 2), rpm if i % 8 else -1,
            views, f"${views * 3 * rpm / 1000:,.2f}",
        ])
    creators += [[i, "CVB", "late duplicate", *creators[i][3:]] for i in range(0, 40, 4)]
    for v in range(600):
        videos.append([
            v, v % 200, rnd.choice(["2024-04-15", "04/15/2024", "1711929600", "soon"]),
            rnd.choice(["14m 32s", "5m", "14.53", "32s"]), f"{rnd.randint(10, 9999)}.0",
            -5 if v % 50 == 0 else (None if v % 31 == 0 else round(rnd.uniform(1, 50), 2)),
            None if v % 6 == 0 else round(rnd.uniform(10, 70), 2),
            None if v % 10 == 0 else round(rnd.uniform(1, 9), 2), 2.5, ARCH[v % 5],
        ])
    videos += [list(videos[v]) for v in range(0, 100, 10)]
    for name, cols, rows in (
        ("creators_messy", schemas.CREATOR_MESSY_COLUMNS, creators),
        ("videos_messy", schemas.VIDEO_MESSY_COLUMNS, videos),
    ):
        (root / f"{name}.csv").write_text("\n".join([",".join(cols), *map(csv_line, rows)]) + "\n")
    return str(root)


def test_pipeline(spark, data):
    out = jobs.clean(spark, data, csv=True)
    summary = {r["table_name"]: r for r in out["summary"].collect()}
    zero = len([i for i in range(200) if i % 7 == 0])
    assert (summary["creators"]["n_before"], summary["creators"]["n_after"]) == (210, 200 - zero)
    assert (summary["videos"]["n_before"], summary["videos"]["n_after"]) == (610, 600 - 12)
    ledger = {(r["table_name"], r["step"]): r["n_rows"] for r in out["ledger"].collect()}
    assert ledger[("creators", "duplicates_dropped")] == 10
    assert ledger[("creators", "zero_subscribers_dropped")] == zero
    assert ledger[("videos", "chargebacks_dropped")] == 12
    creators, videos = jobs.load_clean(spark, data)
    assert creators.filter("niche_category = 'late duplicate'").count() == 0
    assert {r[0] for r in creators.select("archetype").distinct().collect()} == set(fv.ARCHETYPE_SYNONYMS)
    assert creators.filter(" or ".join(f"{c} is null" for c in fv.CREATOR_IMPUTE_COLUMNS)).count() == 0
    assert videos.filter("revenue < 0").count() == 0 and videos.filter("revenue is null").count() > 0
    again = read_typed(spark, f"{data}/creators_clean_csv", creators.schema, "csv")
    assert again.exceptAll(creators).count() == 0 == creators.exceptAll(again).count()

    prof = jobs.profile(spark, data)
    assert prof["tiers"].count() == 5
    assert prof["correlations"].filter("a = b and r <> 1").count() == 0

    seg = jobs.segment(spark, data, n_init=3, sweep=False)
    assert seg["clusters"].agg(F.sum("n")).first()[0] == creators.count()
    segments = jobs.load_segments(spark, data)
    assert segments.columns == list(fv.SEGMENT_EXPORT_COLUMNS)
    assert segments.filter("revenue_gap < 0").count() == 0

    gap = jobs.gap(spark, data)
    assert gap["headline"].count() == 1
    checks = jobs.validate(spark, data)["summary"].collect()
    assert len(checks) == 3
    assert all(r["all_passed"] == all(c["status"] == "PASS" for c in checks) for r in checks)


def test_results_are_stored_whole(spark, data):
    kept = jobs.store_results(jobs.profile(spark, data), data, "profile")
    assert kept["histograms"].count() == 200 and kept["correlations"].count() == 49
    assert spark.read.parquet(f"{data}/results/profile/histograms").count() == 200


def test_csv_position_follows_the_file(spark, data):
    df = read_strings(spark, f"{data}/creators_messy.csv", schemas.CREATORS_MESSY)
    ids = [r["creator_id"] for r in df.orderBy("_pos").limit(205).collect()]
    assert ids[:200] == [str(i) for i in range(200)] and ids[200:] == ["0", "4", "8", "12", "16"]


def test_missing_input_names_the_step(spark, tmp_path):
    with pytest.raises(MissingInputError, match="the clean job"):
        jobs.load_clean(spark, str(tmp_path))
    with pytest.raises(MissingInputError, match="the segment job"):
        jobs.load_segments(spark, str(tmp_path))


def test_csv_missing_texts_become_null(spark, tmp_path):
    df = spark.createDataFrame([(" a ", "n/a"), (None, "None"), ("x,\"y\"", "ok")], "p string, q string")
    write_table(df, str(tmp_path / "t"), "csv")
    got = read_strings(spark, str(tmp_path / "t"), schemas.all_strings(["p", "q"]), with_position=False)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(
        [(" a ", None), (None, None), ('x,"y"', "ok")], key=str)


CSV_SCHEMA = schemas.all_strings(["p", "q"])


def _csv(folder, **files):
    folder.mkdir()
    for name, text in files.items():
        (folder / f"{name}.csv").write_text(text)
    return str(folder)


def test_csv_columns_by_name(spark, tmp_path):
    path = _csv(tmp_path / "t", a="q,x,p\n1,9,a\n2,9,b\n", b="p,q\nc,3\n", c='p,"y,z",q\nd,8,4\n', d="")
    got = read_strings(spark, path, CSV_SCHEMA)
    assert sorted((r.p, r.q) for r in got.collect()) == [("a", "1"), ("b", "2"), ("c", "3"), ("d", "4")]
    assert got.where("_pos is null").count() == 0
    typed = read_typed(spark, path, T.StructType.fromDDL("q int, p string"), "csv")
    assert sorted(map(tuple, typed.collect())) == [(1, "a"), (2, "b"), (3, "c"), (4, "d")]


def test_csv_missing_and_repeated_columns(spark, tmp_path):
    with pytest.raises(ValueError, match="no column q"):
        read_strings(spark, _csv(tmp_path / "a", a="p,q\n1,2\n", b="p,r\n1,2\n"), CSV_SCHEMA)
    with pytest.raises(ValueError, match="occurs twice"):
        read_strings(spark, _csv(tmp_path / "b", a="p,q,p\n1,2,3\n"), CSV_SCHEMA)
    assert read_strings(spark, _csv(tmp_path / "c", a=""), CSV_SCHEMA).count() == 0


def test_csv_line_break_in_a_cell(spark, tmp_path):
    path = _csv(tmp_path / "t", a='q,p\n1,"two\nlines"\n2,x\n')
    got = read_strings(spark, path, CSV_SCHEMA, with_position=False, multi_line=True)
    assert sorted(map(tuple, got.collect())) == [("two\nlines", "1"), ("x", "2")]


@pytest.mark.parametrize("row", ["1", "1,2,3"])
def test_csv_malformed_row_fails_unless_allowed(spark, tmp_path, row):
    path = _csv(tmp_path / "t", a=f"p,q\na,b\n{row}\n")
    with pytest.raises(Exception, match="too many or too few cells"):
        read_strings(spark, path, CSV_SCHEMA, with_position=False).collect()
    assert read_strings(spark, path, CSV_SCHEMA, with_position=False, fail_on_malformed=False).count() == 2


def test_kept_results_follow_the_input(spark, tmp_path):
    made = []
    folder = str(tmp_path / "in")
    spark.range(3).write.parquet(f"{folder}/t.parquet")
    for _ in range(2):
        once(spark, ("rows",), folder, lambda: made.append(1) or len(made))
    assert len(made) == 1
    spark.range(5).write.mode("overwrite").parquet(f"{folder}/t.parquet")
    assert once(spark, ("rows",), folder, lambda: made.append(1) or len(made)) == 2


def test_helpers(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert project_existing(df, ["b", "zzz", "a"]).columns == ["b", "a"]
    assert with_column_if_absent(df, "a", F.lit(9)).first()["a"] == 1
    assert with_column_if_absent(df, "c", F.lit(9)).first()["c"] == 9


def test_export_derives_missing_columns(spark, sf):
    seg = marts.stored(spark, sf, "segments").drop("subscriber_tier", "len_consistency_score")
    out = SG.export_segments(seg, marts.MART_SPEC)
    assert out.columns == list(fv.SEGMENT_EXPORT_COLUMNS)


def test_registered_views_answer_sql(spark, sf):
    """The same headline as SQL over a registered view."""
    seg = marts.stored(spark, sf, "segments")
    register_views(creator_segments=seg)
    sql = spark.sql(
        """WITH parity AS (SELECT avg(rpm) AS rate FROM creator_segments WHERE archetype = '1-URGENT'),
           gaps AS (SELECT views_90d * (SELECT rate FROM parity) / 1000D - revenue_90d AS g
                    FROM creator_segments WHERE archetype = '5-LOW')
           SELECT count(*) AS n, count_if(g > 0) AS pos,
                  round(sum(CASE WHEN g > 0 THEN g WHEN g <= 0 THEN 0 END), 0) AS total FROM gaps"""
    ).first()
    want = R.gap_headline(seg, marts.MART_SPEC).first()
    assert tuple(sql) == (
        want["n_niche_creators"], want["creators_with_positive_gap"], want["total_gap_usd"])


def test_one_row_check_with_single_target(spark):
    """With one target row the cutoff row is 0, so nothing is retained."""
    rows = [(1, "Subscriber Giants", 10.0, 300, 1.0), (2, fv.SPECIALISTS, 1.0, 300, 1.0)]
    df = spark.createDataFrame(
        rows, "creator_id int, archetype string, rpm double, views_90d bigint, revenue_90d double")
    r = R.validation_one_row(df).first()
    assert (r["pct_creators_with_positive_gap"], r["pct_gap_after_trim"]) == (100.0, 0.0)
    assert r["outlier_trim_check"] == "FAIL"


def test_fewer_targets_than_tiles(spark):
    rows = [(i, fv.SPECIALISTS if i else "Subscriber Giants", 2.0, 100 * i, 0.0) for i in range(6)]
    df = spark.createDataFrame(
        rows, "creator_id int, archetype string, rpm double, views_90d int, revenue_90d double")
    got = {r["group_label"]: r["n_creators"] for r in R.trim_by_ntile(df).collect()}
    assert got == {"Retained (bottom 95%)": 5}


def test_bad_id_fails(spark):
    df = spark.createDataFrame([("x",)], "creator_id string")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|must be present"):
        C.require_ids(df, "creator_id").collect()


def test_no_python_and_no_cross_join_in_plans(spark, sf):
    """Reports stay on the JVM and join nothing by nested loops."""
    from creatorlens import catalog

    for name in ("q4_3_headline", "q2_1_tier_revenue", "q5_1_broad_base", "final_types", "histogram"):
        df = catalog.all_queries()[name](spark, sf)
        plan = df._jdf.queryExecution().executedPlan().toString()
        for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "ArrowEval"):
            assert bad not in plan, (name, bad)
