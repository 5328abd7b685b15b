"""DuckDB SQL building blocks: the derived tables as common table expressions.

Written independently of the Spark code; the two meet only in their results.
"""

from __future__ import annotations

BENCH, TARGET = "1-URGENT", "5-LOW"
TIER_EDGES = (25000, 100000, 250000, 400000)
SUB_EDGES = (50000, 125000, 250000, 375000)


def rnd(x: str, digits: int) -> str:
    """Scale, round half to even, unscale: all in doubles."""
    s = f"1e{digits}"
    return f"(round_even(CAST({x} AS DOUBLE) * {s}, 0) / {s})"


def floor0(x: str) -> str:
    return f"(CASE WHEN {x} > 0 THEN {x} WHEN {x} <= 0 THEN 0.0 END)"


def pct(part: str, whole: str) -> str:
    return f"(CAST({part} AS DOUBLE) * 100.0 / NULLIF(CAST({whole} AS DOUBLE), 0))"


def big(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


ENTITIES = f"""
line_agg AS (
  SELECT l_orderkey, sum(l_quantity) AS qty,
         sum(l_extendedprice * (CAST(1 AS DOUBLE) - l_discount)) AS revenue,
         avg(l_discount) AS discount, avg(l_tax) AS tax, count(*) AS n_lines,
         avg(l_quantity) AS avg_qty, stddev_pop(l_quantity) AS std_qty
  FROM lineitem GROUP BY l_orderkey
),
entities0 AS (
  SELECT o_orderkey AS creator_id, o_orderpriority AS archetype, c_mktsegment AS niche_category,
         CAST(floor(o_totalprice) AS BIGINT) AS subscriber_count,
         {rnd("date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-12-31') / CAST(365.25 AS DOUBLE)", 2)} AS channel_age_years,
         {rnd("discount * 800", 4)} AS avg_retention_rate,
         {rnd("tax * 100", 4)} AS avg_ctr,
         CAST(coalesce(n_lines, 0) AS DOUBLE) AS upload_freq_per_month,
         {rnd("avg_qty", 4)} AS avg_video_length_mins,
         {rnd("std_qty", 4)} AS avg_video_len_std,
         CAST(qty * 100 AS BIGINT) AS monthly_views,
         {rnd(rnd("revenue", 4), 2)} AS revenue_90d
  FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN line_agg ON o_orderkey = l_orderkey
),
entities AS (
  SELECT *, monthly_views * 3 AS views_90d,
         {rnd("revenue_90d / (monthly_views * 3) * 1000", 4)} AS rpm
  FROM entities0
)"""

# stored tier (right-closed) and consistency score on the un-imputed entities
SEGMENTS = ENTITIES + f""",
segments AS (
  SELECT *,
    CASE WHEN subscriber_count IS NULL OR subscriber_count <= 0 THEN NULL
         WHEN subscriber_count <= 25000 THEN 'Micro (<25K)'
         WHEN subscriber_count <= 100000 THEN 'Small (25K-100K)'
         WHEN subscriber_count <= 250000 THEN 'Mid (100K-250K)'
         WHEN subscriber_count <= 400000 THEN 'Large (250K-400K)'
         ELSE 'Mega (400K+)' END AS subscriber_tier,
    {rnd("least(100.0, greatest(0.0, 100.0 - avg_video_len_std / (SELECT max(avg_video_len_std) FROM entities) * 100.0))", 1)}
      * (CASE WHEN avg_video_len_std IS NULL THEN NULL ELSE 1 END) AS len_consistency_score
  FROM entities
)"""

ITEMS = f"""
items0 AS (
  SELECT *, {rnd("l_extendedprice * (CAST(1 AS DOUBLE) - l_discount)", 4)} AS gross
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
),
items AS (
  SELECT l_orderkey * 10 + l_linenumber AS video_id, l_orderkey AS creator_id,
         CAST(l_shipdate AS DATE) AS publish_date, l_quantity AS video_length_mins,
         CAST(l_quantity * 100 AS BIGINT) AS views,
         CASE WHEN l_returnflag = 'R' THEN -gross ELSE gross END AS revenue,
         CASE WHEN l_linenumber <> 7 THEN {rnd("l_discount * 800", 4)} END AS retention_rate,
         {rnd("l_tax * 100", 4)} AS ctr,
         {rnd("gross / (l_quantity * 100) * 1000", 4)} AS rpm,
         o_orderpriority AS archetype,
         l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
         l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate
  FROM items0
)"""
LINE_ORDER = (
    "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, "
    "l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"
)

PARITY = f"""
parity AS (SELECT avg(rpm) AS parity_rpm FROM segments WHERE archetype = '{BENCH}'),
gaps AS (
  SELECT s.*, p.parity_rpm, s.views_90d * p.parity_rpm / 1000.0 AS revenue_at_parity,
         {floor0("(s.views_90d * p.parity_rpm / 1000.0 - s.revenue_90d)")} AS gap
  FROM segments s CROSS JOIN parity p WHERE s.archetype = '{TARGET}'
)"""
GAPS = SEGMENTS + "," + PARITY


def cases(col: str, edges, labels, otherwise: str) -> str:
    """Left-closed bins; null falls through to ``otherwise``."""
    whens = " ".join(f"WHEN {col} < {e} THEN '{lab}'" for e, lab in zip(edges, labels))
    top = f"WHEN {col} >= {edges[-1]} THEN '{labels[-1]}'"
    return f"(CASE {whens} {top} ELSE '{otherwise}' END)"


RANKED_TIERS = [
    "5. Micro (<25K)", "4. Small (25K–100K)", "3. Mid (100K–250K)",
    "2. Large (250K–400K)", "1. Mega (400K+)",
]
RANKED_TIER = cases("subscriber_count", TIER_EDGES, RANKED_TIERS, RANKED_TIERS[0])
SHORT_TIER = cases(
    "subscriber_count", TIER_EDGES, ["Micro", "Small", "Mid", "Large", "Mega"], "Micro"
)
SUB_TIERS = ["A. Under 50K", "B. 50K–125K", "C. 125K–250K", "D. 250K–375K", "E. 375K+"]
SUB_TIER = cases("subscriber_count", SUB_EDGES, SUB_TIERS, SUB_TIERS[-1])


# ── messy text exports ──────────────────────────────────────────────────────

ARCH_VARIANTS = {
    "1-URGENT": ("Subscriber Giants", "sub giants", "SubscriberGiants", "SUBSCRIBER GIANTS"),
    "2-HIGH": ("Viral Spike Chasers", "viral chasers", "spike chasers", "ViralSpikeChaser"),
    "3-MEDIUM": ("CVB", "volume builders", "Consistent Builders", "Consistent Volume Builders"),
    "4-NOT SPECIFIED": ("Emerging Dabblers", "dabblers", "New Dabblers", "emerging dabblers"),
    "5-LOW": ("High Retention Niche Specialists", "HR Niche Specialists",
              "niche specialists", "High-Retention Niche Specialists"),
}
NICHE_VARIANTS = {
    "AUTOMOBILE": ("Tech Reviews", "tech_reviews", "Technology Reviews", "gaming"),
    "BUILDING": ("DIY/crafts", "diy", "Crafts", "DIY & Craft Tutorials"),
    "FURNITURE": ("Life Style", "lifestyle", "Travel Vlogs", "Travel"),
    "HOUSEHOLD": ("food/cook", "Cooking", "Food and Cooking", "Food & Cooking"),
    "MACHINERY": ("fin", "Personal_Finance", "personal fin.", "Personal Finance"),
}


def variant(col: str, key: str, table) -> str:
    whens = []
    for name, texts in table.items():
        arr = ", ".join(f"'{t}'" for t in texts)
        whens.append(f"WHEN {col} = '{name}' THEN list_extract([{arr}], CAST({key} % 4 + 1 AS INT))")
    return f"(CASE {' '.join(whens)} END)"


def txt(x: str) -> str:
    return f"CAST({x} AS VARCHAR)"


def fixed(x: str, digits: int) -> str:
    scaled = f"CAST(round_even({x} * 1e{digits}, 0) AS BIGINT)"
    u = 10**digits
    return f"({scaled} // {u} || '.' || lpad({txt(f'{scaled} % {u}')}, {digits}, '0'))"


def thousands(n: str) -> str:
    return (
        f"(CASE WHEN {n} >= 1000 THEN ({n} // 1000) || ',' || lpad({txt(f'{n} % 1000')}, 3, '0') "
        f"ELSE {txt(n)} END)"
    )


_K = "creator_id"
_CENTS = fixed("revenue_90d", 2)
CREATORS_MESSY = ENTITIES + f""",
copies AS (
  SELECT *, 0 AS copy FROM entities
  UNION ALL SELECT *, 1 AS copy FROM entities WHERE creator_id % 50 = 0
),
creators_messy AS (
  SELECT
    CASE WHEN {_K} % 3 = 0 THEN '  ' || {_K} || chr(9) ELSE {txt(_K)} END AS creator_id,
    CASE WHEN {_K} % 23 = 0 THEN NULL WHEN {_K} % 29 = 0 THEN 'Mystery Type'
         ELSE {variant("archetype", _K, ARCH_VARIANTS)} END AS archetype,
    CASE WHEN {_K} % 17 = 0 THEN NULL WHEN {_K} % 19 = 0 THEN ' Unlisted Niche '
         WHEN {_K} % 5 = 0 THEN ' ' || chr(9) || {variant("niche_category", _K, NICHE_VARIANTS)} || ' '
         ELSE {variant("niche_category", _K, NICHE_VARIANTS)} END AS niche_category,
    CASE WHEN {_K} % 101 = 0 THEN '0' WHEN {_K} % 103 = 0 THEN NULL WHEN {_K} % 107 = 0 THEN 'n/a'
         ELSE {thousands("(subscriber_count + copy)")} END AS subscriber_count,
    CASE WHEN {_K} % 47 = 0 THEN 'n/a'
         WHEN {_K} % 3 = 0 THEN CAST(round_even(channel_age_years * 12e0, 0) AS BIGINT) || ' months'
         WHEN {_K} % 3 = 1 THEN {fixed("channel_age_years", 2)} || ' Yrs'
         ELSE CAST(floor(channel_age_years) AS BIGINT) || ' years' END AS channel_age_years,
    CASE WHEN {_K} % 31 = 0 THEN '154.20' WHEN {_K} % 13 = 0 THEN NULL
         ELSE {fixed("avg_retention_rate", 2)} END AS avg_retention_rate,
    CASE WHEN {_K} % 11 = 0 THEN '' ELSE {fixed("avg_ctr", 2)} END AS avg_ctr,
    CASE WHEN {_K} % 4 = 0 THEN CAST(upload_freq_per_month AS BIGINT) || '/month'
         WHEN {_K} % 41 = 0 THEN 'often'
         ELSE {txt("CAST(upload_freq_per_month AS BIGINT)")} END AS upload_freq_per_month,
    {fixed("avg_video_length_mins", 2)} AS avg_video_length_mins,
    {fixed("avg_video_len_std", 4)} AS avg_video_len_std,
    CASE WHEN {_K} % 37 = 0 THEN '-' || {fixed("rpm", 2)} ELSE {fixed("rpm", 2)} END AS rpm,
    CASE WHEN {_K} % 43 = 0 THEN '1.5d' WHEN {_K} % 7 = 0 THEN monthly_views || '.0'
         ELSE {txt("monthly_views")} END AS monthly_views,
    CASE WHEN {_K} % 59 = 0 THEN 'pending'
         ELSE '$' || {thousands(f"CAST(split_part({_CENTS}, '.', 1) AS BIGINT)")} || '.' || split_part({_CENTS}, '.', 2)
    END AS revenue_90d,
    copy AS pos_copy, {_K} AS pos_row
  FROM copies
)"""

_V = "video_id"
VIDEOS_MESSY = ITEMS + f""",
videos_messy AS (
  SELECT
    CASE WHEN {_V} % 997 = 0 THEN NULL WHEN {_V} % 4 = 0 THEN ' ' || {_V} || '  '
         ELSE {txt(_V)} END AS video_id,
    {txt("creator_id")} AS creator_id,
    CASE WHEN {_V} % 53 = 0 THEN 'soon'
         WHEN {_V} % 3 = 0 THEN strftime(publish_date, '%Y-%m-%d')
         WHEN {_V} % 3 = 1 THEN strftime(publish_date, '%m/%d/%Y')
         ELSE {txt("CAST(epoch(publish_date) AS BIGINT)")} END AS publish_date,
    CASE WHEN {_V} % 4 = 0 THEN CAST(video_length_mins AS BIGINT) || 'm ' || ({_V} % 60) || 's'
         WHEN {_V} % 4 = 1 THEN CAST(video_length_mins AS BIGINT) || 'm'
         WHEN {_V} % 4 = 2 THEN CAST(video_length_mins AS BIGINT) || '.25'
         WHEN {_V} % 28 = 3 THEN '32s'
         ELSE {txt("CAST(video_length_mins AS BIGINT)")} END AS video_length_mins,
    CASE WHEN {_V} % 5 = 0 THEN views || '.5' WHEN {_V} % 61 = 0 THEN 'many'
         ELSE views || '.0' END AS views,
    CASE WHEN {_V} % 67 = 0 THEN NULL WHEN revenue < 0 THEN '-' || {fixed("abs(revenue)", 2)}
         ELSE {fixed("abs(revenue)", 2)} END AS revenue,
    {fixed("retention_rate", 2)} AS retention_rate,
    CASE WHEN {_V} % 9 = 0 THEN NULL ELSE {fixed("ctr", 2)} END AS ctr,
    {fixed("rpm", 2)} AS rpm,
    {variant("archetype", _V, ARCH_VARIANTS)} AS archetype,
    {LINE_ORDER}
  FROM items
)"""
