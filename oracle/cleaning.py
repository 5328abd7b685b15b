"""Oracle SQL of sources, sinks, cleaning and its ledgers."""

from __future__ import annotations

from .base import CREATORS_MESSY, GAPS, ITEMS, LINE_ORDER, SEGMENTS, TARGET, VIDEOS_MESSY, floor0, rnd

CREATOR_COLS = (
    "creator_id", "archetype", "niche_category", "subscriber_count", "channel_age_years",
    "avg_retention_rate", "avg_ctr", "upload_freq_per_month", "avg_video_length_mins",
    "avg_video_len_std", "rpm", "monthly_views", "revenue_90d",
)
VIDEO_COLS = (
    "video_id", "creator_id", "publish_date", "video_length_mins", "views", "revenue",
    "retention_rate", "ctr", "rpm", "archetype",
)
MISSING = (
    "'', '#N/A', '#N/A N/A', '#NA', '-1.#IND', '-1.#QNAN', '-NaN', '-nan', '1.#IND', '1.#QNAN', "
    "'<NA>', 'N/A', 'NA', 'NULL', 'NaN', 'None', 'n/a', 'nan', 'null'"
)

# --- Fixed values: spelling -> canonical label ---
NICHES = {
    "Personal Finance": ("personal finance", "personal_finance", "fin", "personal fin."),
    "Tech Deep-Dive Reviews": (
        "tech reviews", "tech deep dive", "tech_reviews", "technology reviews"),
    "Health & Fitness Coaching": (
        "health and fitness", "health&fitness", "health/fitness", "fitness"),
    "Education / Test Prep": (
        "education", "edu / test prep", "education/testprep", "test prep"),
    "DIY & Craft Tutorials": ("diy", "crafts", "diy & crafts", "diy/crafts"),
    "Entertainment": ("entmt", "entertain."),
    "Gaming": ("games", "game content"),
    "Food & Cooking": ("food", "cooking", "food and cooking", "food/cook"),
    "Travel": ("travelling", "travel vlogs"),
    "Lifestyle": ("life style", "lifestyle"),
}
ARCHETYPES = {
    "Subscriber Giants": ("subscriber giants", "sub giants", "subscribergiants"),
    "High-Retention Niche Specialists": (
        "high retention niche specialists", "high-retention niche specialists",
        "hr niche specialists", "niche specialists"),
    "Viral Spike Chasers": (
        "viral spike chasers", "viral chasers", "viralspikechaser", "spike chasers"),
    "Consistent Volume Builders": (
        "consistent volume builders", "volume builders", "consistent builders", "cvb"),
    "Emerging Dabblers": ("emerging dabblers", "dabblers", "new dabblers"),
}


def stripped(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def canon(c: str, table) -> str:
    whens = " ".join(
        f"WHEN lower({c}) IN ({', '.join(repr(v) for v in vs)}) THEN '{label}'"
        for label, vs in table.items()
    )
    return f"(CASE {whens} ELSE {c} END)"


def num(c: str) -> str:
    return (
        rf"(CASE WHEN regexp_full_match({c}, '[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?') "
        f"THEN TRY_CAST({c} AS DOUBLE) END)"
    )


def whole(c: str) -> str:
    return f"(CASE WHEN floor({num(c)}) = {num(c)} THEN CAST({num(c)} AS BIGINT) END)"


def first_number(c: str) -> str:
    return rf"TRY_CAST(NULLIF(regexp_extract({c}, '[\d.]+'), '') AS DOUBLE)"


def count_text(c: str) -> str:
    return whole(f"replace({c}, ',', '')")


def currency(c: str) -> str:
    return num(f"regexp_replace({c}, '[$,]', '', 'g')")


def age(c: str) -> str:
    n = first_number(f"lower({c})")
    return rnd(f"(CASE WHEN lower({c}) LIKE '%month%' THEN {n} / 12 ELSE {n} END)", 2)


def duration(c: str) -> str:
    m = rf"TRY_CAST(NULLIF(regexp_extract({c}, '(\d+)m', 1), '') AS DOUBLE)"
    s = rf"coalesce(TRY_CAST(NULLIF(regexp_extract({c}, '(\d+)s', 1), '') AS DOUBLE), 0)"
    return rnd(f"(CASE WHEN {m} IS NOT NULL THEN {m} + {s} / 60 ELSE {num(c)} END)", 2)


def views(c: str) -> str:
    return f"CAST(round_even({num(c)}, 0) AS BIGINT)"


def date(c: str) -> str:
    return (
        rf"(CASE WHEN regexp_full_match({c}, '\d{{9,11}}') "
        f"THEN CAST(make_timestamp(TRY_CAST({c} AS BIGINT) * 1000000) AS DATE) "
        f"ELSE CAST(coalesce(try_strptime({c}, '%Y-%m-%d'), try_strptime({c}, '%m/%d/%Y')) AS DATE) END)"
    )


_cs = ", ".join(f"{stripped(c)} AS {c}" for c in CREATOR_COLS)
_vs = ", ".join(f"{stripped(c)} AS {c}" for c in VIDEO_COLS)
CREATORS_FIRST = CREATORS_MESSY + f""",
c_strip AS (SELECT {_cs}, pos_copy, pos_row FROM creators_messy),
c_first AS (SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY creator_id ORDER BY pos_copy, pos_row) AS rn
  FROM c_strip) WHERE rn = 1)"""
CREATORS_TYPED = CREATORS_FIRST + f""",
c_typed AS (SELECT creator_id, {canon("archetype", ARCHETYPES)} AS archetype,
  {canon("niche_category", NICHES)} AS niche_category,
  {count_text("subscriber_count")} AS subscriber_count, {age("channel_age_years")} AS channel_age_years,
  {num("avg_retention_rate")} AS ret0, {num("avg_ctr")} AS avg_ctr,
  {first_number("upload_freq_per_month")} AS upload_freq_per_month,
  {num("avg_video_length_mins")} AS avg_video_length_mins,
  {num("avg_video_len_std")} AS avg_video_len_std, {num("rpm")} AS rpm0,
  {whole("monthly_views")} AS monthly_views, {currency("revenue_90d")} AS revenue_90d FROM c_first),
c_valid AS (SELECT * EXCLUDE (ret0, rpm0), CASE WHEN ret0 <= 100 THEN ret0 END AS avg_retention_rate,
  CASE WHEN rpm0 >= 0 THEN rpm0 END AS rpm FROM c_typed),
c_kept AS (SELECT * FROM c_valid WHERE subscriber_count <> 0)"""


def medians(name: str, table: str, key: str, cols) -> str:
    """CTEs with the exact group and global medians, mean of the two middle values."""
    out = []
    for c in cols:
        for suffix, part, grp in (("g", f"PARTITION BY {key}", key), ("a", "", "'all'")):
            out.append(f""",
{name}_{c}_{suffix} AS (SELECT {grp} AS k, (min(v) + max(v)) / 2 AS m FROM (
  SELECT {key}, {c} AS v, row_number() OVER ({part} ORDER BY {c}) AS rn,
         count(*) OVER ({part}) AS n FROM {table} WHERE {c} IS NOT NULL)
  WHERE rn IN ((n + 1) // 2, n // 2 + 1) GROUP BY 1)""")
    return "".join(out)


def imputed(name: str, key: str, cols, all_cols) -> tuple[str, str]:
    """(select list, joins) that fill gaps in ``cols`` of table t."""
    sel = []
    for c in all_cols:
        if c in cols:
            fill = f"coalesce({name}_{c}_g.m, (SELECT m FROM {name}_{c}_a))"
            sel.append(f"coalesce(t.{c}, {rnd(fill, 2)}) AS {c}")
        else:
            sel.append(f"t.{c}")
    joins = " ".join(f"LEFT JOIN {name}_{c}_g ON t.{key} = {name}_{c}_g.k" for c in cols)
    return ", ".join(sel), joins


_IMPUTE_C = (
    "avg_retention_rate", "avg_ctr", "rpm", "avg_video_length_mins", "upload_freq_per_month",
)
_sel_c, _join_c = imputed("cm", "archetype", _IMPUTE_C, CREATOR_COLS)
CREATORS_CLEAN = CREATORS_TYPED + medians("cm", "c_kept", "archetype", _IMPUTE_C) + f""",
c_full AS (SELECT {_sel_c} FROM c_kept t {_join_c}),
c_clean AS (SELECT * REPLACE (CAST(creator_id AS BIGINT) AS creator_id),
  CASE WHEN avg_video_len_std IS NOT NULL THEN
    {rnd("least(100.0, greatest(0.0, 100.0 - avg_video_len_std / (SELECT max(avg_video_len_std) FROM c_kept) * 100.0))", 1)}
  END AS len_consistency_score,
  CASE WHEN subscriber_count <= 0 THEN NULL WHEN subscriber_count <= 1000 THEN 'Micro (<1K)'
       WHEN subscriber_count <= 10000 THEN 'Small (1K-10K)'
       WHEN subscriber_count <= 100000 THEN 'Mid (10K-100K)'
       WHEN subscriber_count <= 500000 THEN 'Large (100K-500K)'
       ELSE 'Mega (500K+)' END AS subscriber_tier
  FROM c_full)"""

VIDEOS_FIRST = VIDEOS_MESSY + f""",
v_strip AS (SELECT {_vs}, {LINE_ORDER} FROM videos_messy),
v_first AS (SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY {LINE_ORDER}) AS rn
  FROM v_strip) WHERE rn = 1)"""
VIDEOS_TYPED = VIDEOS_FIRST + f""",
v_typed AS (SELECT video_id, creator_id, {date("publish_date")} AS publish_date,
  {duration("video_length_mins")} AS video_length_mins, {views("views")} AS views,
  {num("revenue")} AS revenue, {num("retention_rate")} AS retention_rate, {num("ctr")} AS ctr,
  {num("rpm")} AS rpm, {canon("archetype", ARCHETYPES)} AS archetype FROM v_first),
v_kept AS (SELECT * FROM v_typed WHERE revenue IS NULL OR revenue >= 0)"""
_sel_v, _join_v = imputed("vm", "creator_id", ("retention_rate", "ctr"), VIDEO_COLS)
VIDEOS_CLEAN = VIDEOS_TYPED + medians("vm", "v_kept", "creator_id", ("retention_rate", "ctr")) + f""",
v_clean AS (SELECT * REPLACE (CAST(video_id AS BIGINT) AS video_id, CAST(creator_id AS BIGINT) AS creator_id)
  FROM (SELECT {_sel_v} FROM v_kept t {_join_v}))"""


def _count(table: str, cond: str) -> str:
    return f"(SELECT count(*) FROM {table} WHERE {cond})"


def _ledger() -> str:
    c_rows = [
        ("duplicates_dropped", "(SELECT count(*) FROM creators_messy) - (SELECT count(*) FROM c_first)"),
        ("retention_nulled", _count("c_typed", "ret0 > 100")),
        ("rpm_nulled", _count("c_typed", "rpm0 < 0")),
        ("zero_subscribers_dropped", _count("c_typed", "subscriber_count = 0")),
        ("unknown_subscribers_dropped", _count("c_typed", "subscriber_count IS NULL")),
        *[(f"imputed_{c}", _count("c_kept", f"{c} IS NULL")) for c in _IMPUTE_C],
    ]
    v_rows = [
        ("duplicates_dropped", "(SELECT count(*) FROM videos_messy) - (SELECT count(*) FROM v_first)"),
        ("dates_unparsable", _count("v_typed", "publish_date IS NULL")),
        ("chargebacks_dropped", _count("v_typed", "revenue < 0")),
        *[(f"imputed_{c}", _count("v_kept", f"{c} IS NULL")) for c in ("retention_rate", "ctr")],
    ]
    parts = [f"SELECT 'creators' AS table_name, '{s}' AS step, {e} AS n_rows" for s, e in c_rows]
    parts += [f"SELECT 'videos', '{s}', {e}" for s, e in v_rows]
    return " UNION ALL ".join(parts)


def _both(first: str, second: str) -> str:
    return f"WITH {first}, {second} "


def cleaning() -> dict[str, str]:
    cm, vm = f"WITH {CREATORS_MESSY} ", f"WITH {VIDEOS_MESSY} "
    cid, vid = f"{stripped('creator_id')} AS creator_id", f"{stripped('video_id')} AS video_id"

    def parsed(prefix, table, key, *cells):
        cols = ", ".join(
            f"{stripped(src)} AS raw_{name}, {fn(stripped(src))} AS {name}" for src, name, fn in cells
        )
        return f"{prefix} SELECT {key}, {cols} FROM {table}"

    c_in = ", ".join(CREATOR_COLS)
    missing = ", ".join(f"CASE WHEN {c} NOT IN ({MISSING}) THEN {c} END AS {c}" for c in CREATOR_COLS)

    def labels(col, table):
        s = stripped(col)
        return (
            f"{cm} SELECT {s} AS raw_label, {canon(s, table)} AS {col}, count(*) AS n_rows "
            "FROM creators_messy GROUP BY 1, 2"
        )

    def label_rows(col, table):
        s = stripped(col)
        return f"{cm} SELECT {stripped('creator_id')} AS creator_id, {s} AS raw_label, {canon(s, table)} AS {col} FROM creators_messy"

    dbl = ("avg_retention_rate", "avg_ctr", "avg_video_length_mins", "avg_video_len_std", "rpm")
    q = {
        "src_csv_strings": f"{cm} SELECT {missing} FROM creators_messy",
        "src_typed": f"WITH {ITEMS} SELECT {', '.join(VIDEO_COLS)} FROM items",
        "sink_roundtrip": f"""WITH {SEGMENTS} SELECT {c_in}, len_consistency_score,
            subscriber_tier FROM segments""",
        "export_segments": f"""WITH {GAPS} SELECT creator_id, archetype, subscriber_tier,
            niche_category, subscriber_count, channel_age_years, avg_retention_rate, avg_ctr,
            upload_freq_per_month, avg_video_length_mins, len_consistency_score, rpm,
            monthly_views, views_90d, revenue_90d,
            {_export_cols()} FROM segments""",
        "clean_strip": f"{cm} SELECT {_cs} FROM creators_messy",
        "dedup_keep_first": f"WITH {CREATORS_FIRST} SELECT {c_in} FROM c_first",
        "normalize_niche": labels("niche_category", NICHES),
        "normalize_archetype": labels("archetype", ARCHETYPES),
        "normalize_niche_rows": label_rows("niche_category", NICHES),
        "normalize_archetype_rows": label_rows("archetype", ARCHETYPES),
        "parse_count": parsed(cm, "creators_messy", cid, ("subscriber_count", "subscriber_count", count_text)),
        "parse_currency": parsed(cm, "creators_messy", cid, ("revenue_90d", "revenue_90d", currency)),
        "parse_age": parsed(cm, "creators_messy", cid, ("channel_age_years", "channel_age_years", age)),
        "parse_rate": parsed(
            cm, "creators_messy", cid, ("upload_freq_per_month", "upload_freq_per_month", first_number)
        ),
        "lenient_cast": parsed(
            cm, "creators_messy", cid, *[(c, c, num) for c in dbl], ("monthly_views", "monthly_views", whole)
        ),
        "null_invalid": f"""{cm} SELECT {cid},
            CASE WHEN {num(stripped("avg_retention_rate"))} <= 100
                 THEN {num(stripped("avg_retention_rate"))} END AS avg_retention_rate,
            CASE WHEN {num(stripped("rpm"))} >= 0 THEN {num(stripped("rpm"))} END AS rpm
            FROM creators_messy""",
        "drop_zero": f"""{cm} SELECT * FROM (SELECT {cid},
            {count_text(stripped("subscriber_count"))} AS subscriber_count FROM creators_messy)
            WHERE subscriber_count <> 0""",
        "impute_group_median": f"WITH {CREATORS_CLEAN} SELECT creator_id, archetype, {', '.join(_IMPUTE_C)} FROM c_clean",
        "len_consistency": f"WITH {CREATORS_CLEAN} SELECT creator_id, avg_video_len_std, len_consistency_score FROM c_clean",
        "tier_right_closed": f"WITH {CREATORS_CLEAN} SELECT creator_id, subscriber_count, subscriber_tier FROM c_clean",
        "final_types": f"WITH {CREATORS_CLEAN} SELECT * FROM c_clean",
        "dedup_videos": f"WITH {VIDEOS_FIRST} SELECT {', '.join(VIDEO_COLS)} FROM v_first",
        "parse_dates": parsed(vm, "videos_messy", vid, ("publish_date", "publish_date", date)),
        "parse_duration": parsed(vm, "videos_messy", vid, ("video_length_mins", "video_length_mins", duration)),
        "parse_views": parsed(vm, "videos_messy", vid, ("views", "views", views)),
        "drop_chargebacks": f"""WITH {VIDEOS_TYPED}
            SELECT 'kept' AS part, count(*) AS n_rows, count(revenue) AS n_revenue,
              round(sum(revenue), 2) AS revenue FROM v_kept
            UNION ALL SELECT 'chargebacks', count(*), count(revenue), round(sum(revenue), 2)
            FROM v_typed WHERE revenue < 0""",
        "chargeback_rows": f"""WITH {VIDEOS_TYPED} SELECT video_id, creator_id, publish_date, revenue,
            CASE WHEN revenue < 0 THEN 'chargebacks' ELSE 'kept' END AS part FROM v_typed""",
        "lenient_cast_videos": parsed(
            vm, "videos_messy", vid, ("video_id", "video_number", whole),
            ("creator_id", "creator_number", whole),
            *[(c, c, num) for c in ("retention_rate", "ctr", "rpm")],
        ),
        "impute_creator_median": f"WITH {VIDEOS_CLEAN} SELECT {', '.join(VIDEO_COLS)} FROM v_clean",
        "cleaning_ledger": _both(CREATORS_TYPED, VIDEOS_TYPED) + _ledger(),
        "cleaning_summary": _both(CREATORS_TYPED, VIDEOS_TYPED) + """
            SELECT *, n_before - n_after AS n_dropped FROM (
              SELECT 'creators' AS table_name, (SELECT count(*) FROM creators_messy) AS n_before,
                     (SELECT count(*) FROM c_kept) AS n_after
              UNION ALL SELECT 'videos', (SELECT count(*) FROM videos_messy),
                     (SELECT count(*) FROM v_kept))""",
        "distinct_before_after": f"""WITH {CREATORS_FIRST}
            SELECT 'niche_category' AS column_name, count(DISTINCT niche_category) AS n_before,
              count(DISTINCT {canon("niche_category", NICHES)}) AS n_after FROM c_first
            UNION ALL SELECT 'archetype', count(DISTINCT archetype),
              count(DISTINCT {canon("archetype", ARCHETYPES)}) FROM c_first""",
    }
    return q


def _export_cols() -> str:
    at = rnd("views_90d * (SELECT parity_rpm FROM parity) / 1000.0", 2)
    gap = rnd(floor0(f"({at} - revenue_90d)"), 2)
    return (
        f"CASE WHEN archetype = '{TARGET}' THEN {at} ELSE 0.0::DOUBLE END AS revenue_at_parity, "
        f"CASE WHEN archetype = '{TARGET}' THEN {gap} ELSE 0.0::DOUBLE END AS revenue_gap"
    )


def gap_export() -> str:
    return f"""WITH {GAPS} SELECT creator_id, archetype, views_90d, {_export_cols()} FROM segments"""
