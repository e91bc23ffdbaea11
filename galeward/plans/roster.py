"""Cross-method queries over a stand-in roster, whose scores SQL can make as well.

Density and reconstruction methods are stood for by plain figures of the windows (deviation, slope, distance from the
mean), and fits by such figures for each architecture and seed, so every relational step behind the models is
checked by SQL. full_roster_family_agreement of the catalogue runs over the models themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galeward.operators import agreement as A
from galeward.operators import crossmethod as X
from galeward.operators import detectors as D
from galeward.operators import reconstruction as R
from galeward.operators import coverage as V
from galeward.operators import grid
from galeward.plans import stand_in as S
from galeward.plans.catalog import LIMITS, SQL, TOO_HIGH, query, r6

LONG = 36
_SCORES = {
    "lof": "window_std", "isolation_forest": "abs(window_slope)", "autoencoder": "round(abs(value - window_mean), 6)",
    "lstm_ae": "round(abs(value - window_mean) + window_std, 6)", "gru_ae": "round(abs(value - window_mean) + abs(window_slope), 6)",
}
_LONG_SCORES = {"lof_6h": "window_std", "isolation_forest_6h": "abs(window_slope)"}
_LIMIT = 2


def _scored(features: DataFrame, scores: dict[str, str]) -> DataFrame:
    full = features.dropna(subset=list(D.FEATURES))
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.expr(e).alias("score")) for m, e in scores.items()])).alias("x")
    return full.select("station", "sensor", F.col("ts").alias("timestamp"), each).select("station", "sensor", "timestamp", "x.method", (F.col("x.score") > _LIMIT).alias("flagged"), "x.score")


def roster(spark, sf) -> DataFrame:
    return S.stored(spark, sf, "roster", lambda: S.found(spark, sf).unionByName(_scored(S.features(S.filled(spark, sf)), _SCORES)))


def roster_matched(spark, sf) -> DataFrame:
    return S.stored(spark, sf, "roster_matched", lambda: A.matched_budget(A.align(roster(spark, sf))))


def _scores_sql(scores: dict[str, str], table: str) -> str:
    return " UNION ALL ".join(f"SELECT station, sensor, ts AS \"timestamp\", '{m}' AS method, {e} > {_LIMIT} AS flagged, {e} AS score FROM {table}" for m, e in scores.items())


ROSTER = f"{S.FOUND}, {S.features_sql()}, roster AS (SELECT * FROM found UNION ALL {_scores_sql(_SCORES, 'full_')})"
MATCHED = f"{ROSTER}, {S.matched_sql('roster')}"
_FAMILY = "CASE WHEN {m} IN ('z_score', 'modified_z_score') THEN 'statistical' WHEN {m} IN ('lof', 'isolation_forest') THEN 'density' WHEN {m} IN ('autoencoder', 'lstm_ae', 'gru_ae') THEN 'reconstruction' END"
_JAC = "jac AS (SELECT sensor, method_a, method_b, count_if(fa AND fb)::DOUBLE / nullif(count_if(fa OR fb), 0) AS jaccard FROM pairs GROUP BY 1, 2, 3)"
_BOTH = "s AS (SELECT * FROM jac UNION ALL SELECT sensor, method_b, method_a, jaccard FROM jac)"
_PAIRS = f"{MATCHED}, {S.pairs_sql()}, {_JAC}"


@query(f"""WITH {_PAIRS}, f AS (SELECT *, {_FAMILY.format(m='method_a')} AS fa, {_FAMILY.format(m='method_b')} AS fb FROM jac)
SELECT sensor, round(avg(jaccard) FILTER (fa <> fb), 6) AS cross_family_mean, round(max(jaccard) FILTER (fa <> fb), 6) AS cross_family_max, round(avg(jaccard) FILTER (fa = 'statistical' AND fb = 'statistical'), 6) AS within_statistical,
round(avg(jaccard) FILTER (fa = 'density' AND fb = 'density'), 6) AS within_density, round(avg(jaccard) FILTER (fa = 'reconstruction' AND fb = 'reconstruction'), 6) AS within_reconstruction FROM f WHERE fa IS NOT NULL AND fb IS NOT NULL GROUP BY 1""")
def family_agreement(spark, sf):
    t = X.family_agreement(A.jaccard(A.pair_counts(roster_matched(spark, sf))))
    return r6(t, *[c for c in t.columns if c != "sensor"])


@query(f"""WITH {_PAIRS}, {_BOTH} SELECT method_a AS method, round(max(jaccard), 6) AS best_cross_family_jaccard, round(avg(jaccard), 6) AS mean_cross_family_jaccard
FROM s WHERE {_FAMILY.format(m='method_a')} <> {_FAMILY.format(m='method_b')} GROUP BY 1""")
def cross_family_by_method(spark, sf):
    t = X.cross_family_by_method(A.jaccard(A.pair_counts(roster_matched(spark, sf))))
    return r6(t, "best_cross_family_jaccard", "mean_cross_family_jaccard")


_EFFECT = """SELECT a.sensor, '{m}' AS density_method, a.method_b AS statistical_method, round(a.jaccard, 6) AS jaccard_short, round(b.jaccard, 6) AS jaccard_long, round(b.jaccard - a.jaccard, 6) AS change, round(o.jaccard, 6) AS self_agreement
FROM s a JOIN s b ON a.sensor = b.sensor AND a.method_b = b.method_b AND b.method_a = '{m}_6h' JOIN s o ON o.sensor = a.sensor AND o.method_a = '{m}' AND o.method_b = '{m}_6h'
WHERE a.method_a = '{m}' AND a.method_b IN ('z_score', 'modified_z_score')"""


@query(f"""WITH {ROSTER}, {S.features_sql(LONG, 'long')}, wider AS (SELECT * FROM roster UNION ALL {_scores_sql(_LONG_SCORES, 'full_long')}), {S.matched_sql('wider')}, {S.pairs_sql()}, {_JAC}, {_BOTH}
{_EFFECT.format(m='lof')} UNION ALL {_EFFECT.format(m='isolation_forest')}""")
def window_effect(spark, sf):
    wider = lambda: A.matched_budget(A.align(roster(spark, sf).unionByName(_scored(S.features(S.filled(spark, sf), LONG), _LONG_SCORES))))
    pairs = S.stored(spark, sf, "wider_pairs", lambda: A.jaccard(A.pair_counts(wider())))  # looked up six times
    t = A.window_effect(pairs, "lof", "lof_6h", ["z_score", "modified_z_score"]).unionByName(A.window_effect(pairs, "isolation_forest", "isolation_forest_6h", ["z_score", "modified_z_score"]))
    return r6(t, "jaccard_short", "jaccard_long", "change", "self_agreement")


def _pattern_sql(sensor: str, methods: list[str], name: str) -> str:
    listed = ", ".join(f"'{m}'" for m in methods)
    return f"SELECT station, sensor, \"timestamp\", '{name}' AS method, count_if(flagged AND method IN ({listed})) = {len(methods)} AND count_if(flagged) = {len(methods)} AS flagged FROM matched WHERE sensor = '{sensor}' GROUP BY 1, 2, 3"


_CASES = [("reconstruction_only_lux", "luminous_intensity", X.FAMILIES["reconstruction"], 3), ("lof_only_precipitation", "precipitation", ["lof"], 2), ("contextual_only_lux", "luminous_intensity", [X.CONTEXTUAL], 2)]


@query(f"""WITH {MATCHED}, marks AS (SELECT station, sensor, ts AS "timestamp", 'impossible_pressure' AS method, value > {TOO_HIGH} AS flagged FROM filled WHERE sensor = 'pressure'
UNION ALL {' UNION ALL '.join(_pattern_sql(sensor, methods, name) for name, sensor, methods, _ in _CASES)}), {S.runs_sql('marks')},
least_ AS (SELECT * FROM (VALUES ('impossible_pressure', 1), {', '.join(f"('{name}', {n})" for name, _, _, n in _CASES)}) t(method, n)),
c AS (SELECT * FROM (SELECT r.*, row_number() OVER (PARTITION BY r.method ORDER BY length DESC, station, "start") AS k FROM runs r JOIN least_ l ON l.method = r.method AND length >= l.n) WHERE k = 1),
who AS (SELECT c.method, string_agg(DISTINCT m.method, ', ' ORDER BY m.method) AS flagging_methods FROM c JOIN matched m ON m.station = c.station AND m.sensor = c.sensor AND m."timestamp" BETWEEN c."start" AND c."end" WHERE m.flagged GROUP BY 1),
rng AS (SELECT c.method, round(min(value), 2) AS value_min, round(max(value), 2) AS value_max FROM c JOIN filled f ON f.station = c.station AND f.sensor = c.sensor AND f.ts BETWEEN c."start" - INTERVAL 3 HOURS AND c."end" + INTERVAL 3 HOURS GROUP BY 1),
gap AS (SELECT c.method, count_if(value IS NULL) AS raw_missing_in_episode FROM c JOIN long f ON f.station = c.station AND f.sensor = c.sensor AND f.ts BETWEEN c."start" AND c."end" GROUP BY 1)
SELECT c.method AS "case", c.station, c.sensor, c."start", c."end", length AS length_bins, round(length * 600 / 3600, 1) AS duration_hours, flagging_methods, value_min, value_max, raw_missing_in_episode
FROM c LEFT JOIN who ON who.method = c.method LEFT JOIN rng ON rng.method = c.method LEFT JOIN gap ON gap.method = c.method""")
def case_studies(spark, sf):
    m, f = roster_matched(spark, sf), S.filled(spark, sf)
    odd = f.filter("sensor = 'pressure'").select("station", "sensor", F.col("ts").alias("timestamp"), F.lit("impossible_pressure").alias("method"), X.impossible(F.col("value"), float("-inf"), TOO_HIGH).alias("flagged"))
    found = X.longest_case(X.flag_runs(odd), "impossible_pressure", 1)
    for name, sensor, methods, least in _CASES:
        found = found.unionByName(X.longest_case(X.flag_runs(X.pattern(m, sensor, methods, name)), name, least))
    return X.case_studies(found, m, f, grid.to_long(S.wide(spark, sf)))


_SHARES = "SELECT sensor, method, count_if(length = 1) / sum(length) AS share_isolated, coalesce(sum(length) FILTER (length >= 6), 0) / sum(length) AS share_in_long_runs FROM runs GROUP BY 1, 2"


def _verdict_sql(kind: str, share: str, a: str, b: str, words: str) -> str:
    return f"""SELECT sensor, '{kind}' AS anomaly_type, CASE WHEN a IS NULL OR b IS NULL THEN '{X.UNDECIDED}' WHEN a > b THEN 'consistent' ELSE 'inconsistent' END AS verdict,
CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN printf('%.1f%% of {a} flags {words} against %.1f%% for {b}', a * 100, b * 100) END AS evidence
FROM (SELECT sensor, max({share}) FILTER (method = '{a}') AS a, max({share}) FILTER (method = '{b}') AS b FROM shares GROUP BY 1)"""


@query(f"""WITH {MATCHED}, {S.runs_sql()}, shares AS ({_SHARES}), {S.CONTEXT_TABLES},
e AS (SELECT *, coalesce(NOT (global_pct < 0.05 OR global_pct > 0.95) AND (hour_pct < 0.05 OR hour_pct > 0.95), false) AS o FROM context),
p AS (SELECT e.sensor, method, avg(o::INT) AS x FROM matched m JOIN e ON m.station = e.station AND m.sensor = e.sensor AND m."timestamp" = e."timestamp" WHERE flagged GROUP BY 1, 2),
q AS (SELECT s.sensor, max(x) FILTER (method = '{X.CONTEXTUAL}') AS a, coalesce(max(x) FILTER (method <> '{X.CONTEXTUAL}'), 0) AS b FROM (SELECT DISTINCT sensor FROM e) s LEFT JOIN p ON p.sensor = s.sensor GROUP BY 1)
{_verdict_sql('point', 'share_isolated', 'z_score', 'lstm_ae', 'are isolated single bins')} UNION ALL {_verdict_sql('collective', 'share_in_long_runs', 'lstm_ae', 'z_score', 'lie in runs of an hour or more')}
UNION ALL SELECT sensor, 'contextual', CASE WHEN a IS NULL THEN '{X.UNDECIDED}' WHEN a > b THEN 'consistent' ELSE 'inconsistent' END,
CASE WHEN a IS NULL THEN '{X.ONE_CHANNEL}' ELSE printf('%.1f%% of {X.CONTEXTUAL} flags are odd for their hour alone; no other method exceeds %.1f%%', a * 100, b * 100) END FROM q""")
def taxonomy_verdicts(spark, sf):
    m = roster_matched(spark, sf)
    runs = X.run_length_summary(X.flag_runs(m))
    profile = X.contextual_profile(m, X.percentile_context(m, S.round_value(S.filled(spark, sf))))
    return X.point_verdict(runs).unionByName(X.collective_verdict(runs)).unionByName(X.contextual_verdict(profile))


# --- stand-in fits --------------------------------------------------------------------------------

_ARCHS = {"dense": "abs(value - window_mean)", "lstm": "abs(value - window_mean) + window_std", "gru": "abs(value - window_mean) + abs(window_slope)"}
_SEEDED = "round(({e}) * (1 + 0.25 * seed) + seed * window_std, 6)"
FITS = f"""{S.FILLED}, {S.features_sql()}, split AS (SELECT *, epoch_us(ts) - min(epoch_us(ts)) OVER w <= (max(epoch_us(ts)) OVER w - min(epoch_us(ts)) OVER w) * 0.8 AS is_train FROM full_ WINDOW w AS (PARTITION BY station, sensor)),
runs_ AS (SELECT arch, seed FROM (VALUES ('dense'), ('lstm'), ('gru')) a(arch), (VALUES (0), (1), (2)) b(seed)),
raw_fits AS (SELECT station, sensor, arch, 36 AS "window", 8 AS bottleneck, seed, ts, is_train, CASE arch {' '.join(f"WHEN '{a}' THEN {_SEEDED.format(e=e)}" for a, e in _ARCHS.items())} END AS score FROM split, runs_),
fits AS (SELECT *, 100 + 200 * seed AS epochs, round(round(avg(score) FILTER (NOT is_train) OVER (PARTITION BY station, sensor, arch, seed), 9), 6) AS best_val_loss FROM raw_fits)"""
_FIT = "station, sensor, arch, \"window\", bottleneck, seed"


def fits(spark, sf) -> DataFrame:
    def made():
        full = D.time_split(S.features(S.filled(spark, sf)).dropna(subset=list(D.FEATURES)))
        runs = F.broadcast(R.plan(spark, list(_ARCHS), seeds=(0, 1, 2)))
        score = F.coalesce(*[F.when(F.col("arch") == a, F.expr(_SEEDED.format(e=e))) for a, e in _ARCHS.items()])
        rows = full.crossJoin(runs).withColumns({"score": score, "epochs": 100 + 200 * F.col("seed")})
        best = rows.filter("NOT is_train").groupBy("station", "sensor", *R.RUN_KEYS).agg(F.round(F.round(F.avg("score"), 9), 6).alias("best_val_loss"))
        return rows.join(best, ["station", "sensor", *R.RUN_KEYS], "left").select("station", "sensor", *R.RUN_KEYS, "ts", "score", "is_train", "epochs", "best_val_loss")

    return S.stored(spark, sf, "stand_in_fits", made)


@query(f"WITH {FITS} SELECT {_FIT}, count_if(is_train) AS n_train, count(*) AS n_scored, max(epochs) AS epochs, max(epochs) < 500 AS ended_early, round(max(best_val_loss), 6) AS best_val_loss, stddev_pop(score) > 0 AS scores_vary FROM fits GROUP BY ALL")
def stored_fit_health(spark, sf):
    return R.fit_health(fits(spark, sf)).withColumn("best_val_loss", F.round("best_val_loss", 6))


@query(f"""WITH {FITS}, q AS (SELECT {_FIT}, quantile_cont(score, [0.9, 0.95, 0.99]) FILTER (NOT is_train) AS c FROM fits GROUP BY ALL), each AS (SELECT {_FIT}, unnest([0.9, 0.95, 0.99]) AS percentile, unnest(c) AS cutoff FROM q)
SELECT e.*, r.rate_overall FROM (SELECT station, sensor, arch, "window", bottleneck, seed, percentile, round(cutoff, 5) AS cutoff FROM each) e JOIN
(SELECT f.station, f.sensor, f.arch, f.seed, percentile, round(avg(coalesce(score > cutoff, false)::INT), 6) AS rate_overall FROM fits f JOIN each e ON f.station = e.station AND f.sensor = e.sensor AND f.arch = e.arch AND f.seed = e.seed GROUP BY ALL) r
ON r.station = e.station AND r.sensor = e.sensor AND r.arch = e.arch AND r.seed = e.seed AND r.percentile = e.percentile""")
def stored_percentile_sensitivity(spark, sf):
    return R.percentile_sensitivity(fits(spark, sf)).withColumns({"cutoff": F.round("cutoff", 5), "rate_overall": F.round("rate_overall", 6), "percentile": F.col("percentile").cast("decimal(3,2)")})


_VARIANTS = f"""{FITS}, lim AS (SELECT station, sensor, arch, seed, quantile_cont(score, 0.99) FILTER (NOT is_train) AS t FROM fits GROUP BY ALL),
variants AS (SELECT f.station, f.sensor, ts AS "timestamp", f.arch || '_' || f.seed AS method, coalesce(score > t, false) AS flagged, score FROM fits f JOIN lim l ON f.station = l.station AND f.sensor = l.sensor AND f.arch = l.arch AND f.seed = l.seed),
recurrent AS (SELECT * FROM variants WHERE method NOT LIKE 'dense%'), primary_ AS (SELECT * REPLACE (CASE method WHEN 'dense_0' THEN 'autoencoder' WHEN 'lstm_0' THEN 'lstm_ae' ELSE 'gru_ae' END AS method) FROM variants WHERE method LIKE '%\\_0' ESCAPE '\\')"""
_KINDS = f"""{_VARIANTS}, {S.aligned_sql('recurrent')}, {S.pairs_sql('aligned')}, {_JAC},
kinds AS (SELECT *, CASE WHEN split_part(method_a, '_', 1) = split_part(method_b, '_', 1) THEN 'within ' || split_part(method_a, '_', 1) || '_ae' ELSE 'cross-architecture' END AS kind FROM jac)"""


def _variants(spark, sf) -> DataFrame:
    return R.reconstruction_detections(fits(spark, sf), name=F.concat_ws("_", F.col("arch"), F.col("seed").cast("string")))


def _kinds(spark, sf) -> DataFrame:
    return A.recurrence_kinds(A.jaccard(A.pair_counts(A.align(_variants(spark, sf).filter("method NOT LIKE 'dense%'")))))


def _primary(spark, sf) -> DataFrame:
    return R.reconstruction_detections(fits(spark, sf).filter("seed = 0"))


@query(f"WITH {_KINDS} SELECT sensor, kind, round(avg(jaccard), 6) AS mean, round(min(jaccard), 6) AS min, round(max(jaccard), 6) AS max, count(*) AS n_pairs FROM kinds GROUP BY 1, 2")
def lstm_vs_gru(spark, sf):
    return r6(A.kind_summary(_kinds(spark, sf)), "mean", "min", "max")


_VIEWS = """va AS (SELECT sensor, method_a, method_b, count_if(fa AND fb)::DOUBLE / nullif(count_if(fa OR fb), 0) AS jaccard, 'native' AS "view" FROM pairs_n GROUP BY 1, 2, 3),
vb AS (SELECT sensor, method_a, method_b, count_if(fa AND fb)::DOUBLE / nullif(count_if(fa OR fb), 0) AS jaccard, 'matched_budget' AS "view" FROM pairs_m GROUP BY 1, 2, 3), views AS (SELECT * FROM va UNION ALL SELECT * FROM vb)"""
_RECURRENCE = f"{S.matched_sql('primary_')}, {S.pairs_sql('aligned').replace('pairs AS', 'pairs_n AS')}, {S.pairs_sql().replace('pairs AS', 'pairs_m AS')}, {_VIEWS}"


@query(f'WITH {_VARIANTS}, {_RECURRENCE} SELECT sensor, method_a, method_b, round(jaccard, 6) AS jaccard, "view" FROM views')
def recurrence_comparison(spark, sf):
    return r6(A.both_views(_primary(spark, sf)), "jaccard")


_CHANGES = """ch AS (SELECT sensor, CASE kind WHEN 'cross-architecture' THEN 'swap LSTM for GRU' ELSE 'reseed the same architecture' END AS change, jaccard FROM kinds
UNION ALL SELECT sensor, 'add recurrence (dense vs recurrent)', jaccard FROM views WHERE "view" = 'matched_budget' AND method_a = 'autoencoder'),
cm AS (SELECT change, sensor, avg(jaccard) AS j FROM ch GROUP BY 1, 2)"""


@query(f"""WITH {_KINDS}, {_RECURRENCE.replace('need AS', 'need2 AS').replace('JOIN need ', 'JOIN need2 need ').replace('aligned AS', 'aligned2 AS').replace('FROM aligned', 'FROM aligned2').replace('JOIN aligned', 'JOIN aligned2')}, {_CHANGES}
SELECT change, round(max(j) FILTER (sensor = 'luminous_intensity'), 3) AS luminous_intensity, round(max(j) FILTER (sensor = 'precipitation'), 3) AS precipitation, round(max(j) FILTER (sensor = 'pressure'), 3) AS pressure, round(avg(j), 3) AS overall FROM cm GROUP BY 1""")
def displacement_hierarchy(spark, sf):
    """What moves a flagged set, the least mover first: seeds, architectures, recurrence."""
    kinds = _kinds(spark, sf).select("sensor", F.when(F.col("kind") == "cross-architecture", "swap LSTM for GRU").otherwise("reseed the same architecture").alias("change"), "jaccard")
    views = A.both_views(_primary(spark, sf)).filter("view = 'matched_budget' AND method_a = 'autoencoder'")
    return X.displacement(kinds.unionByName(views.select("sensor", F.lit("add recurrence (dense vs recurrent)").alias("change"), "jaccard")))


_DECISION = SQL["station_decision"]


@query(f"SELECT decision, count(*) AS n_stations FROM ({_DECISION}) GROUP BY 1")
def decision_counts(spark, sf):
    return V.decision_counts(V.recommend(S.readings(spark, sf), LIMITS))


@query(f"""WITH {MATCHED}, {S.pairs_sql()} SELECT station, sensor, method_a, method_b, round(count_if(fa AND fb)::DOUBLE / nullif(count_if(fa OR fb), 0), 6) AS jaccard FROM pairs GROUP BY 1, 2, 3, 4 HAVING count_if(fa OR fb) > 0""")
def pair_columns_round_trip(spark, sf):
    """Jaccards by station as a column for each pair, and back as rows."""
    wide = A.pair_columns(A.jaccard(A.pair_counts(roster_matched(spark, sf), ("station", "sensor"))))
    return r6(A.pair_rows(wide), "jaccard")


@query(f"""WITH {MATCHED}, k AS (SELECT station, sensor, method, share FROM ranked), v AS (SELECT station, sensor, "timestamp", {_FAMILY.format(m='method')} AS method, round(avg(share), 12) AS strength FROM ranked WHERE {_FAMILY.format(m='method')} IS NOT NULL GROUP BY 1, 2, 3, 4),
votes AS (SELECT *, (rank() OVER w + (count(*) OVER (PARTITION BY station, sensor, method, strength) - 1) / 2.0) / count(*) OVER (PARTITION BY station, sensor, method) <= 0.01 AS flagged FROM v WINDOW w AS (PARTITION BY station, sensor, method ORDER BY strength)),
{S.pairs_sql('votes')}, {_JAC} SELECT sensor, method_a, method_b, round(jaccard, 6) AS jaccard FROM jac""")
def family_vote_jaccard(spark, sf):
    """How far the three families' votes agree."""
    votes = X.family_votes(S.stored(spark, sf, "roster_aligned", lambda: A.align(roster(spark, sf))))
    return r6(A.jaccard(A.pair_counts(votes)).select("sensor", "method_a", "method_b", "jaccard"), "jaccard")
