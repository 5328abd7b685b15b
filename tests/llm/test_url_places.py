"""URL filter with a list of places in numbers: exact by brute force, over several levels."""

import random

import pytest
from pyspark.sql import functions as F

from creatorlens.llm import common, url_cascade
from creatorlens.llm.catalog import TRACKED_LINK


@pytest.mark.parametrize("part_keys", [300, 1 << 20])
def test_listed_places_by_brute_force(spark, part_keys):
    rng = random.Random(7)
    urls = [f"https://h{rng.randrange(40)}.io/p/{rng.randrange(4000)}" + rng.choice(["", "#top", "?ref=x", "?a=1&utm_source=f"]) for _ in range(6000)]
    urls += [None, "no scheme?ref=x", "http://?ref=x", "http://long.io/" + "x" * 200000 + "?ref=x", "http://long.io/" + "x" * 200000]
    rows = list(enumerate(urls)) + [(0, urls[0]), (None, urls[1])]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in rows], "page_id long, url string, key string")
    place = lambda u: u.split("://", 1)[1].split("#")[0].split("?")[0] if u and "://" in u else ""
    tracked = {place(u) for _, u in rows if u and ("?ref=" in u or "utm_" in u)} - {""}
    keys = pages.where(F.col("url").rlike(TRACKED_LINK)).select(url_cascade.place_of(F.col("url")).alias("key")).where("key <> ''")
    none = spark.createDataFrame([], "key string")
    got = url_cascade.judged(pages, [("allow", "h1.io", "/p/")], none, part_keys, listed_places=keys).collect()
    assert len(got) == len(rows)
    want = dict(rows)
    for r in got:
        url = want[r.page_id] if r.page_id is not None else urls[1]
        assert r.place_listed == (place(url) in tracked) and not r.listed
        assert r.verdict == ("allow" if r.rule or not r.place_listed else "block")


def test_registered_list_needs_levels(spark):
    pages = common.table(spark, "/root/testdata/sf0.1", "pages")
    places = pages.select(url_cascade.place_of(F.col("url")).alias("key"), F.col("url").rlike(TRACKED_LINK).alias("tracked"))
    cascade = url_cascade.build(places.where("tracked").select("key"), places.select("key").distinct())
    sizes = [level.n_words * 64 for level in cascade.parts[0]]
    print("bits by level", sizes)
    assert len(sizes) >= 3 and sorted(sizes, reverse=True) == sizes
