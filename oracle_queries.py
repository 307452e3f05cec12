"""The same results as plain SQL for DuckDB, written from the definitions.

Kept apart from the package: only the fixture's SELECT and the queries' parameters are shared, so
the two only agree if both are right.
"""

from __future__ import annotations

from dugout.params import SEED
from dugout.plans.queries import MIN_PITCHES, PLAYERS, SEASONS, TARGET_BATTER
from dugout.sources.tables import pitches_sql

# Fixed values, written out here on purpose: a wrong list in the package must not pass on both sides.
MEASURES = (
    "total_pitches swing_prop chase_prop zone_swing_prop whiff_prop putaway_prop woba xwoba exit_velo exit_angle"
    " sweetspot_prop hardhit_prop barrel_prop sz_top sz_bot win_prob_added ks walks singles doubles triples homeruns total_bases"
).split()
CARD_METRICS = (
    "prop swing_prop chase_prop zone_swing_prop whiff_prop putaway_prop sweetspot_prop hardhit_prop barrel_prop"
    " woba xwoba exit_velo exit_angle win_prob_added"
).split()
REVERSED_METRICS = "chase_prop whiff_prop putaway_prop exit_velo exit_angle".split()
RANKED_METRICS = "exit_velo exit_angle".split()
GROUP_COLOURS = {"FB": "#d22d4a", "OS": "#1fbe3a", "BB": "#04d1ed", "All": "grey20"}
FLAGS = (
    "is_bip is_swing is_contact is_whiff is_zone_swing is_chase_swing is_putaway is_sweetspot is_hardhit is_barrel"
    " is_single is_double is_triple is_home_run is_walk is_strikeout delta_bat_win_exp"
).split()


def predictors() -> list[str]:
    """Years and all measures but the group's pitch count, which is the outcome."""
    own = [f"{m}_pitch" for m in MEASURES if m != "total_pitches"]
    return ["game_year", "pred_year", *(f"{m}_previous" for m in MEASURES), *own]


PREV, LAST, TARGET = SEASONS.prev_year, SEASONS.last_year, SEASONS.target_year
SWING = "('foul','hit_into_play','swinging_strike','swinging_strike_blocked','foul_tip')"
KS = "('strikeout','strikeout_double_play')"

FLAG_RULES = {
    "is_bip": "CASE WHEN type IS NULL THEN NULL WHEN type = 'X' THEN 1 ELSE 0 END",
    "is_swing": f"CASE WHEN description IN {SWING} THEN 1 ELSE 0 END",
    "is_contact": "CASE WHEN description IN ('foul','hit_into_play') THEN 1 ELSE 0 END",
    "is_whiff": "CASE WHEN is_swing = 1 AND is_contact = 0 THEN 1 WHEN is_swing = 1 AND is_contact = 1 THEN 0 END",
    "is_zone_swing": "CASE WHEN zone BETWEEN 1 AND 9 THEN is_swing END",
    "is_chase_swing": "CASE WHEN zone BETWEEN 11 AND 14 THEN is_swing END",
    "is_putaway": f"CASE WHEN strikes = 2 AND events IN {KS} THEN 1 "
    f"WHEN strikes = 2 AND (events IS NULL OR events NOT IN {KS}) THEN 0 END",
    "is_sweetspot": "CASE WHEN is_bip = 1 AND launch_angle >= 8 AND launch_angle <= 32 THEN 1 "
    "WHEN is_bip = 1 AND launch_angle < 8 OR launch_angle > 32 THEN 0 END",
    "is_hardhit": "CASE WHEN is_bip = 1 AND launch_speed >= 95 THEN 1 WHEN is_bip = 1 AND launch_speed < 95 THEN 0 END",
    "is_barrel": "CASE WHEN is_bip = 1 AND is_sweetspot = 1 AND is_hardhit = 1 THEN 1 "
    "WHEN is_bip = 1 AND is_sweetspot = 0 OR is_hardhit = 0 THEN 0 END",
    "is_single": "CASE WHEN events IS NULL THEN NULL WHEN events = 'single' THEN 1 ELSE 0 END",
    "is_double": "CASE WHEN events IS NULL THEN NULL WHEN events = 'double' THEN 1 ELSE 0 END",
    "is_triple": "CASE WHEN events IS NULL THEN NULL WHEN events = 'triple' THEN 1 ELSE 0 END",
    "is_home_run": "CASE WHEN events IS NULL THEN NULL WHEN events = 'home_run' THEN 1 ELSE 0 END",
    "is_walk": "CASE WHEN events IN ('walk','hit_by_pitch') THEN 1 ELSE 0 END",
    "is_strikeout": f"CASE WHEN events IN {KS} THEN 1 ELSE 0 END",
    "delta_bat_win_exp": "CASE inning_topbot WHEN 'Top' THEN -1 * delta_home_win_exp WHEN 'Bot' THEN delta_home_win_exp END",
}
FLAG_LIST = ", ".join(f"{rule} AS {name}" for name, rule in FLAG_RULES.items())

GROUP_RULE = """CASE
 WHEN pitch_name IN ('4-Seam Fastball','Four-Seam','FourSeamFastBall','TwoSeamFastBall','Cutter','Sinker') THEN 'FB'
 WHEN pitch_name IN ('Changeup','ChangeUp','Split-Finger','Forkball','Screwball') THEN 'OS'
 WHEN pitch_name IN ('Slider','Curveball','Knuckle Curve','Sweeper','Slurve','Slow Curve','Other','Knuckleball','Eephus') THEN 'BB'
 ELSE 'Other' END"""


def measures(rate: str = "", exit_where: str = "") -> str:
    def mean(src, name, scale="", where=""):
        return f"{scale}avg({src}){where} AS {name}"

    rates = {
        "swing_prop": "is_swing",
        "chase_prop": "is_chase_swing",
        "zone_swing_prop": "is_zone_swing",
        "whiff_prop": "is_whiff",
        "putaway_prop": "is_putaway",
        "sweetspot_prop": "is_sweetspot",
        "hardhit_prop": "is_hardhit",
        "barrel_prop": "is_barrel",
    }
    out = ["count(*) AS total_pitches"]
    out += [mean(src, name, rate) for name, src in rates.items()]
    out.append(mean("woba_value", "woba", where=" FILTER (WHERE woba_denom = 1)"))
    out.append(mean("estimated_woba_using_speedangle", "xwoba", where=" FILTER (WHERE woba_denom = 1)"))
    out.append(mean("launch_speed", "exit_velo", where=exit_where))
    out.append(mean("launch_angle", "exit_angle", where=exit_where))
    out += [mean("f.sz_top", "sz_top"), mean("f.sz_bot", "sz_bot")]
    out.append("coalesce(sum(delta_bat_win_exp), 0.0::DOUBLE) AS win_prob_added")
    for name, src in (
        ("ks", "is_strikeout"),
        ("walks", "is_walk"),
        ("singles", "is_single"),
        ("doubles", "is_double"),
        ("triples", "is_triple"),
        ("homeruns", "is_home_run"),
    ):
        out.append(f"CAST(coalesce(sum({src}), 0) AS BIGINT) AS {name}")
    return ", ".join(out)


BASES = "CAST((singles + walks) * 1 + doubles * 2 + triples * 3 + homeruns * 4 AS BIGINT) AS total_bases"
OVERALL_MEASURES = measures("100 * ", " FILTER (WHERE is_bip = 1)")
SEASON = "batter_id, player_name, game_year"


def same(a: str, b: str, *keys: str) -> str:
    return " AND ".join(f"{a}.{k} IS NOT DISTINCT FROM {b}.{k}" for k in keys)


def _cells() -> str:
    prev = ", ".join(f"y.{m} AS {m}_previous" for m in MEASURES)
    own = ", ".join(f"s.{m} AS {m}_pitch" for m in MEASURES)
    return f"""SELECT y.batter_id, y.player_name, y.game_year, y.pred_year, {prev}, s.pitch_group, {own}, s.prop,
 c.num_pitches
FROM yearly y
LEFT JOIN by_group s ON {same('y', 's', 'batter_id', 'player_name', 'game_year', 'pred_year')}
LEFT JOIN counts c ON {same('s', 'c', 'batter_id', 'player_name', 'game_year', 'pitch_group')}"""


STANDIN = "CAST({k} * num_pitches - total_pitches_previous AS DOUBLE)"


def _hash(seed: str) -> str:
    return f"md5(concat_ws('|', {seed}, batter_id, player_name, game_year, pitch_group))"


ORDER_KEYS = "batter_id, player_name, game_year, pitch_group"
IDS = ("batter_id", "player_name", "game_year", "pitch_group")

#: Every view the queries build on, in order; each query takes the ones it needs.
VIEWS: dict[str, str] = {
    "pitch": pitches_sql(),
    "grouped": f"SELECT *, {GROUP_RULE} AS pitch_group FROM pitch",
    "clean": "SELECT * FROM grouped WHERE pitch_group <> 'Other'",
    "flagged": f"SELECT *, {FLAG_LIST} FROM clean",
    "yearly": f"""SELECT *, {BASES}, CAST(game_year + 1 AS INT) AS pred_year
FROM (SELECT {SEASON}, {measures()} FROM flagged f GROUP BY {SEASON})""",
    "by_group": f"""SELECT *, {BASES}, CAST(game_year + 1 AS INT) AS pred_year,
 total_pitches / CAST(sum(total_pitches) OVER (PARTITION BY {SEASON}) AS DOUBLE) AS prop
FROM (SELECT {SEASON}, pitch_group, {measures()} FROM flagged f GROUP BY ALL)""",
    "counts": f"SELECT {SEASON}, pitch_group, count(*) AS num_pitches FROM clean GROUP BY ALL",
    "counts_share": f"""SELECT *, num_pitches / CAST(sum(num_pitches) OVER (PARTITION BY {SEASON}) AS DOUBLE) AS prop
FROM counts""",
    "overall": f"""SELECT *, {BASES},
 total_pitches / CAST(sum(total_pitches) OVER (PARTITION BY batter_id, player_name) AS DOUBLE) AS prop
FROM (SELECT batter_id, player_name, pitch_group, {OVERALL_MEASURES} FROM flagged f GROUP BY ALL)""",
    "cells": _cells(),
    "absent": f"""SELECT DISTINCT player_name FROM counts a WHERE game_year <> {LAST} AND NOT EXISTS
 (SELECT 1 FROM counts b WHERE b.game_year = {LAST} AND b.player_name IS NOT DISTINCT FROM a.player_name)""",
    "model": f"""SELECT * REPLACE (CAST(CASE WHEN game_year = {PREV} AND player_name IN (SELECT player_name FROM absent)
 THEN {TARGET} ELSE pred_year END AS INT) AS pred_year) FROM cells""",
    "traintest": f"SELECT * FROM model WHERE pred_year <> {TARGET}",
    "topredict": f"SELECT *, {STANDIN.format(k=3)} AS prediction FROM model WHERE pred_year = {TARGET}",
    "clamped": "SELECT * REPLACE (CASE WHEN prediction < 0 THEN 0 ELSE prediction END AS prediction) FROM topredict",
    "predshare": f"""SELECT batter_id, player_name, CAST({TARGET} AS INT) AS game_year, pitch_group,
 prediction AS num_pitches,
 prediction / nullif(sum(prediction) OVER (PARTITION BY batter_id, player_name), 0) AS prop FROM clamped""",
    "final": f"""SELECT batter_id AS "BATTER_ID", player_name AS "PLAYER_NAME", game_year AS "GAME_YEAR",
 max(prop) FILTER (WHERE pitch_group = 'FB') AS "PITCH_TYPE_FB",
 max(prop) FILTER (WHERE pitch_group = 'BB') AS "PITCH_TYPE_BB",
 max(prop) FILTER (WHERE pitch_group = 'OS') AS "PITCH_TYPE_OS"
FROM predshare GROUP BY batter_id, player_name, game_year""",
    "long": f"""SELECT *, CASE WHEN game_year <> {TARGET} THEN 'True' WHEN game_year = {TARGET} THEN 'Pred' END AS type
FROM (SELECT {SEASON}, pitch_group, CAST(num_pitches AS DOUBLE) AS num_pitches, prop FROM counts_share
 UNION ALL SELECT {SEASON}, pitch_group, num_pitches, prop FROM predshare)""",
    "wide": f"""SELECT {SEASON}, num_pitches,
 coalesce(max(prop) FILTER (WHERE pitch_group = 'FB'), 0.0::DOUBLE) AS "FB",
 coalesce(max(prop) FILTER (WHERE pitch_group = 'BB'), 0.0::DOUBLE) AS "BB",
 coalesce(max(prop) FILTER (WHERE pitch_group = 'OS'), 0.0::DOUBLE) AS "OS"
FROM (SELECT {SEASON}, pitch_group, prop,
  CAST(sum(num_pitches) OVER (PARTITION BY {SEASON}) AS DOUBLE) AS num_pitches FROM counts_share
 UNION ALL SELECT {SEASON}, pitch_group, prop,
  sum(num_pitches) OVER (PARTITION BY batter_id, player_name) AS num_pitches FROM predshare)
GROUP BY {SEASON}, num_pitches""",
    "card": """SELECT batter_id, player_name, pitch_group, metric, value FROM (
 SELECT batter_id, player_name, pitch_group, unnest(["""
    + ", ".join(f"'{m}'" for m in CARD_METRICS)
    + "]) AS metric, unnest(["
    + ", ".join("100 * prop" if m == "prop" else m for m in CARD_METRICS)
    + "]) AS value FROM overall)",
    "ranked": """SELECT *, avg_rank AS rank_asc, max(avg_rank) OVER (PARTITION BY player_name, metric) - avg_rank + 1 AS rank_desc
FROM (SELECT *, CASE WHEN value IS NOT NULL THEN
  rank() OVER (PARTITION BY player_name, metric ORDER BY value NULLS LAST)
  + (count(*) OVER (PARTITION BY player_name, metric, value) - 1) / 2.0::DOUBLE END AS avg_rank FROM card)""",
    "dist": f"""SELECT w.*, sqrt(pow(w."OS" - t."OS", 2) + pow(w."BB" - t."BB", 2) + pow(w."FB" - t."FB", 2)) AS distance
FROM wide w, (SELECT * FROM wide WHERE game_year = {TARGET} AND batter_id = {TARGET_BATTER}) t
WHERE w.game_year = {TARGET} AND w.num_pitches >= {MIN_PITCHES} AND w.batter_id <> {TARGET_BATTER}""",
    "splitted": f"""SELECT *, CASE WHEN row_no <= floor(n_rows * 0.8) THEN 1 ELSE 0 END AS is_train FROM (
 SELECT *, row_number() OVER (PARTITION BY pitch_group ORDER BY {_hash(str(SEED))}, {ORDER_KEYS}) AS row_no,
  count(*) OVER (PARTITION BY pitch_group) AS n_rows FROM traintest)""",
    "training": "SELECT * EXCLUDE (row_no, n_rows, is_train) FROM splitted WHERE is_train = 1",
}

DEPENDS = {
    "pitch": [],
    "grouped": ["pitch"],
    "clean": ["grouped"],
    "flagged": ["clean"],
    "yearly": ["flagged"],
    "by_group": ["flagged"],
    "counts": ["clean"],
    "counts_share": ["counts"],
    "overall": ["flagged"],
    "cells": ["yearly", "by_group", "counts"],
    "absent": ["counts"],
    "model": ["cells", "absent"],
    "traintest": ["model"],
    "topredict": ["model"],
    "clamped": ["topredict"],
    "predshare": ["clamped"],
    "final": ["predshare"],
    "long": ["counts_share", "predshare"],
    "wide": ["counts_share", "predshare"],
    "card": ["overall"],
    "ranked": ["card"],
    "dist": ["wide"],
    "splitted": ["traintest"],
    "training": ["splitted"],
}


def _needs(names) -> list[str]:
    found: set[str] = set()

    def visit(name):
        for dep in DEPENDS[name]:
            visit(dep)
        found.add(name)

    for name in names:
        visit(name)
    return [v for v in VIEWS if v in found]


def q(uses: str, body: str) -> str:
    """A statement over the named views and all they depend on."""
    ctes = ",\n".join(f"{name} AS (\n{VIEWS[name].strip()}\n)" for name in _needs(uses.split()))
    glue = "" if body.startswith(",") else "\n"
    return f"WITH {ctes}{glue}{body}"


def pairs_sql(source: str, names) -> str:
    """(col_a, col_b, r) of all pairs over the rows where both are known; NULL if one is constant.

    Rows are unpivoted and met with themselves: thousands of filtered aggregates in one
    SELECT take DuckDB minutes.
    """
    cols = ", ".join(f"'{n}'" for n in names)
    vals = ", ".join(f"CAST({n} AS DOUBLE)" for n in names)
    index = f"unnest(range({len(names)}))"
    found = """SELECT a.c AS col_a, b.c AS col_b,
 covar_samp(a.x, b.x) / nullif(stddev_samp(a.x) * stddev_samp(b.x), 0) AS r
FROM cellvalue a JOIN cellvalue b ON a.id = b.id AND a.k < b.k GROUP BY a.c, b.c"""
    every = f"""(SELECT unnest([{cols}]) AS c, {index} AS k)"""
    grid = f"SELECT a.c AS col_a, b.c AS col_b FROM {every} a JOIN {every} b ON a.k < b.k"
    return f"SELECT col_a, col_b, r FROM ({grid}) LEFT JOIN ({found}) USING (col_a, col_b)", f"""cellvalue AS (
 SELECT * FROM (SELECT id, unnest([{cols}]) AS c, {index} AS k, unnest([{vals}]) AS x
 FROM (SELECT *, row_number() OVER () AS id FROM {source})) WHERE x IS NOT NULL)"""


NUMERIC = [
    "batter_id",
    "game_year",
    "pred_year",
    *(f"{m}_previous" for m in MEASURES),
    *(f"{m}_pitch" for m in MEASURES),
    "prop",
    "num_pitches",
]


def _fixed(x: str, digits: int, comma: bool = False) -> str:
    spec = "{:," if comma else "{:"
    return f"format('{spec}.{digits}f}}', round_even({x}, {digits}))"


def _quoted(name: str) -> str:
    return f'"{name}"'


def _metrics(truth: str, guess: str) -> str:
    sd = f"stddev_samp({truth}) * stddev_samp({guess})"
    return (
        f"sqrt(avg(pow({truth} - {guess}, 2))) AS rmse, "
        f"pow(covar_samp({truth}, {guess}) / nullif({sd}, 0), 2) AS rsq, avg(abs({truth} - {guess})) AS mae"
    )


def statements() -> dict[str, str]:
    pitch_key = "l_orderkey, l_linenumber, batter_id"
    names = ", ".join(f"'{p}'" for p in PLAYERS)
    colours = ", ".join(f"('{g}', '{c}')" for g, c in GROUP_COLOURS.items())
    reversed_ = ", ".join(f"'{m}'" for m in REVERSED_METRICS)
    ranked_ = ", ".join(f"'{m}'" for m in RANKED_METRICS)
    preds = predictors()
    out = {
        "scan_csv": q("pitch", "SELECT * FROM pitch"),
        "sink_csv": q("final", "SELECT * FROM final"),
        "snapshot_write": q(
            "clean",
            "SELECT game_year, pitch_group, count(*) AS n, sum(launch_speed) AS speed FROM clean GROUP BY ALL",
        ),
        "snapshot_read": q(
            "yearly", f"SELECT {SEASON}, total_pitches, swing_prop FROM yearly WHERE game_year = {LAST}"
        ),
        "literal_lookup": q(
            "clean",
            f"""SELECT t.pitch_group, t.pitch_hex, CASE WHEN t.pitch_group = 'All' THEN (SELECT count(*) FROM clean)
 ELSE n END AS n FROM (VALUES {colours}) t(pitch_group, pitch_hex)
LEFT JOIN (SELECT pitch_group, count(*) AS n FROM clean GROUP BY pitch_group) c USING (pitch_group)""",
        ),
        "season_report": q(
            "wide",
            f"""SELECT game_year, {_fixed('num_pitches', 0, True)} AS num_pitches,
 {', '.join(f"{_fixed(f'100 * {_quoted(g)}', 0)} || '%' AS {_quoted(g)}" for g in ('OS', 'BB', 'FB'))}
FROM wide WHERE player_name IN ({names})""",
        ),
        "player_card": q(
            "overall",
            f"""SELECT * EXCLUDE (batter_id, player_name, sz_top, sz_bot, singles, doubles, triples, homeruns, ks, walks)
 REPLACE (100 * prop AS prop)
FROM overall LEFT JOIN (VALUES {colours}) t(pitch_group, pitch_hex) USING (pitch_group) WHERE player_name IN ({names})""",
        ),
        "clean_names": q(
            "pitch",
            """SELECT batter_id, player_name, game_year, pitch_name, zone AS zone_1_14, strikes AS number_strikes,
 home_team AS team, away_team AS team_2 FROM pitch""",
        ),
        "bucket_pitch_group": q("grouped", f"SELECT {pitch_key}, pitch_name, pitch_group FROM grouped"),
        "filter_known_group": q("clean", f"SELECT {pitch_key}, pitch_name, pitch_group FROM clean"),
        "distinct_values": q("clean", "SELECT DISTINCT events FROM clean"),
        "distinct_rows": q("clean", "SELECT DISTINCT player_name, game_year, home_team FROM clean"),
        "sorted_choices": q(
            "clean", "SELECT DISTINCT player_name FROM clean WHERE player_name IS NOT NULL ORDER BY player_name"
        ),
        "select_reorder": q("cells", "SELECT * FROM cells"),
        "select_cols": q("cells", f"SELECT {SEASON}, pitch_group, num_pitches, prop FROM cells"),
        "drop_cols": q(
            "overall",
            "SELECT * EXCLUDE (player_name, sz_top, sz_bot, singles, doubles, triples, homeruns, ks, walks) FROM overall",
        ),
        "select_numeric": q("cells", "SELECT * EXCLUDE (player_name, pitch_group) FROM cells"),
        "rename_cols": q(
            "by_group",
            f"""SELECT batter_id AS "BATTER_ID", player_name AS "PLAYER_NAME", game_year AS "GAME_YEAR",
 max(prop) FILTER (WHERE pitch_group = 'FB') AS "PITCH_TYPE_FB",
 max(prop) FILTER (WHERE pitch_group = 'BB') AS "PITCH_TYPE_BB",
 max(prop) FILTER (WHERE pitch_group = 'OS') AS "PITCH_TYPE_OS"
FROM by_group GROUP BY {SEASON}""",
        ),
        "const_cols": q(
            "clean",
            f"""SELECT DISTINCT batter_id, player_name, CAST({TARGET} AS INT) AS pred_year,
 CAST({LAST} AS INT) AS game_year FROM clean WHERE game_year = {LAST}""",
        ),
        "split_by_year": q(
            "traintest topredict",
            f"""SELECT {SEASON}, pitch_group, pred_year, num_pitches, 'train_test' AS part FROM traintest
UNION ALL SELECT {SEASON}, pitch_group, pred_year, num_pitches, 'predict' AS part FROM topredict""",
        ),
        "filter_by_player": q("overall", f"SELECT * FROM overall WHERE player_name IN ({names})"),
        "batting_team": q(
            "clean",
            f"""SELECT {pitch_key}, inning_topbot, CASE WHEN inning_topbot IS NULL THEN NULL
 WHEN inning_topbot = 'Top' THEN away_team ELSE home_team END AS batting_team FROM clean""",
        ),
        "player_info": q(
            "clean",
            f"""SELECT DISTINCT {SEASON}, CASE WHEN inning_topbot IS NULL THEN NULL
 WHEN inning_topbot = 'Top' THEN away_team ELSE home_team END AS batting_team FROM clean""",
        ),
        "tag_true_pred": q(
            "model",
            f"""SELECT batter_id, player_name, pred_year AS game_year, pitch_group,
 CASE WHEN pred_year <> {TARGET} THEN 'True' WHEN pred_year = {TARGET} THEN 'Pred' END AS type FROM model""",
        ),
        "reassign_pred_year": q("model", "SELECT * FROM model"),
        "percent_scale": q("overall", "SELECT batter_id, player_name, pitch_group, 100 * prop AS prop FROM overall"),
        "agg_count": q("clean", f"SELECT {SEASON}, count(*) AS total_pitches FROM clean GROUP BY {SEASON}"),
        "agg_mean_narm": q("yearly", f"""SELECT {SEASON}, swing_prop, chase_prop, zone_swing_prop, whiff_prop,
 putaway_prop, exit_velo, exit_angle, sweetspot_prop, hardhit_prop, barrel_prop, sz_top, sz_bot FROM yearly"""),
        "agg_mean_where": q(
            "overall", "SELECT batter_id, player_name, pitch_group, woba, xwoba, exit_velo, exit_angle FROM overall"
        ),
        "agg_sum_narm": q(
            "yearly",
            f"SELECT {SEASON}, win_prob_added, ks, walks, singles, doubles, triples, homeruns FROM yearly",
        ),
        "total_bases": q("yearly", f"SELECT {SEASON}, total_bases FROM yearly"),
        "pred_year": q("yearly", f"SELECT {SEASON}, pred_year FROM yearly"),
        "yearly_summary": q("yearly", "SELECT * FROM yearly"),
        "pitch_summary": q("by_group", "SELECT * FROM by_group"),
        "pitch_summary_overall": q("overall", "SELECT * FROM overall"),
        "pitch_counts": q("counts_share", "SELECT * FROM counts_share"),
        "count_team_group": q(
            "clean", "SELECT pitch_group, home_team, count(*) AS n FROM clean GROUP BY pitch_group, home_team"
        ),
        "corr_matrix": q(
            "cells",
            ", {1} SELECT col_a, col_b, round(r, 6) + 0.0 AS r FROM ({0})".format(*pairs_sql("cells", NUMERIC)),
        ),
        "multi_grain": q(
            "yearly by_group overall",
            """SELECT * EXCLUDE (pred_year), 'year' AS grain FROM yearly
UNION ALL BY NAME SELECT * EXCLUDE (pred_year, prop), 'cell' AS grain FROM by_group
UNION ALL BY NAME SELECT * EXCLUDE (prop), 'overall' AS grain FROM overall""",
        ),
        "share_by_year": q("counts_share", f"SELECT {SEASON}, pitch_group, prop FROM counts_share"),
        "share_overall": q("overall", "SELECT batter_id, player_name, pitch_group, prop FROM overall"),
        "clamp_and_share": q(
            "cells",
            f"""SELECT *, prediction / nullif(sum(prediction) OVER (PARTITION BY batter_id, player_name), 0) AS xprop
FROM (SELECT {SEASON}, pitch_group, CASE WHEN {STANDIN.format(k=3)} < 0 THEN 0 ELSE {STANDIN.format(k=3)} END
 AS prediction FROM cells)""",
        ),
        "partition_total": q(
            "counts",
            f"""SELECT *, CAST(sum(num_pitches) OVER (PARTITION BY {SEASON}) AS BIGINT) AS season_pitches,
 CAST(sum(num_pitches) OVER (PARTITION BY batter_id, player_name) AS BIGINT) AS career_pitches FROM counts""",
        ),
        "avg_rank": q(
            "ranked",
            """SELECT batter_id, player_name, pitch_group, value AS exit_velo, rank_asc, rank_desc
FROM ranked WHERE metric = 'exit_velo'""",
        ),
        "domain_range": q(
            "card",
            """SELECT *, min(value) OVER (PARTITION BY player_name, metric) AS lo,
 max(value) OVER (PARTITION BY player_name, metric) AS hi FROM card""",
        ),
        "scale_position": q(
            "ranked",
            f"""SELECT batter_id, player_name, pitch_group, metric, value,
 CASE WHEN metric IN ({reversed_}) THEN 1 - place ELSE place END AS position FROM (
 SELECT *, CASE WHEN placed IS NULL THEN NULL WHEN lo = hi THEN 0.5::DOUBLE ELSE (placed - lo) / (hi - lo) END AS place
 FROM (SELECT *, min(placed) OVER (PARTITION BY player_name, metric) AS lo,
   max(placed) OVER (PARTITION BY player_name, metric) AS hi
  FROM (SELECT *, CASE WHEN metric IN ({ranked_}) THEN rank_desc ELSE value END AS placed FROM ranked)))""",
        ),
        "join_left_suffix": q("cells", "SELECT * EXCLUDE (num_pitches) FROM cells"),
        "join_left_natural": q(
            "by_group counts",
            f"""SELECT s.batter_id, s.player_name, s.game_year, s.pitch_group, s.total_pitches, s.prop, c.num_pitches
FROM by_group s LEFT JOIN counts c ON {same('s', 'c', *IDS)}""",
        ),
        "join_left_noop": q("cells", "SELECT * FROM cells"),
        "join_anti": q("absent", "SELECT * FROM absent"),
        "join_semi_flag": q(
            "counts absent",
            """SELECT c.*, CASE WHEN EXISTS (SELECT 1 FROM absent a WHERE a.player_name IS NOT DISTINCT FROM c.player_name)
 THEN 1 ELSE 0 END AS is_absent FROM counts c""",
        ),
        "join_lookup": q(
            "overall",
            f"""SELECT o.batter_id, o.player_name, o.pitch_group, o.total_pitches, t.pitch_hex FROM overall o
LEFT JOIN (VALUES {colours}) t(pitch_group, pitch_hex) USING (pitch_group)""",
        ),
        "union_by_name": q(
            "counts predshare",
            f"""SELECT {SEASON}, pitch_group, CAST(num_pitches AS DOUBLE) AS num_pitches, CAST(NULL AS DOUBLE) AS prop
FROM counts UNION ALL SELECT {SEASON}, pitch_group, num_pitches, prop FROM predshare""",
        ),
        "pivot_shares": q(
            "by_group",
            f"""SELECT {SEASON}, max(prop) FILTER (WHERE pitch_group = 'FB') AS "FB",
 max(prop) FILTER (WHERE pitch_group = 'BB') AS "BB", max(prop) FILTER (WHERE pitch_group = 'OS') AS "OS"
FROM by_group GROUP BY {SEASON}""",
        ),
        "pivot_fill_zero": q(
            "counts_share",
            f"""SELECT {SEASON}, CAST(sum(num_pitches) AS BIGINT) AS num_pitches,
 coalesce(max(prop) FILTER (WHERE pitch_group = 'FB'), 0.0::DOUBLE) AS "FB",
 coalesce(max(prop) FILTER (WHERE pitch_group = 'BB'), 0.0::DOUBLE) AS "BB",
 coalesce(max(prop) FILTER (WHERE pitch_group = 'OS'), 0.0::DOUBLE) AS "OS"
FROM counts_share GROUP BY {SEASON}""",
        ),
        "final_prediction_table": q("final", 'SELECT * FROM final ORDER BY "BATTER_ID"'),
        "report_long": q("long", "SELECT * FROM long"),
        "report_wide": q("wide", "SELECT * FROM wide"),
        "sort_asc": q(
            "by_group",
            f"""SELECT {SEASON}, pitch_group, total_pitches, whiff_prop FROM by_group
ORDER BY game_year NULLS LAST, total_pitches NULLS LAST""",
        ),
        "sort_desc": q(
            "overall",
            """SELECT batter_id, player_name, pitch_group, total_pitches FROM overall
ORDER BY total_pitches DESC NULLS LAST""",
        ),
        "head_n": q(
            "overall",
            """SELECT batter_id, player_name, pitch_group, total_pitches FROM overall
ORDER BY total_pitches DESC NULLS LAST, batter_id, player_name, pitch_group LIMIT 10""",
        ),
        "topk_similar": q(
            "dist",
            """SELECT * REPLACE (round(distance, 6) AS distance) FROM dist
QUALIFY rank() OVER (ORDER BY dist.distance) <= 3""",
        ),
        "topk_dissimilar": q(
            "dist",
            """SELECT * REPLACE (round(distance, 6) AS distance) FROM dist
QUALIFY rank() OVER (ORDER BY dist.distance DESC) <= 3""",
        ),
        "similarity_table": q(
            "dist",
            " UNION ALL ".join(
                f"""SELECT '{label}' AS value, max(player_name) FILTER (WHERE k = 1) AS player_1,
 max(player_name) FILTER (WHERE k = 2) AS player_2, max(player_name) FILTER (WHERE k = 3) AS player_3
FROM (SELECT player_name, row_number() OVER (ORDER BY distance {way}, batter_id) AS k FROM dist
 WHERE distance IS NOT NULL)"""
                for label, way in (("Most Similar", "ASC"), ("Least Similar", "DESC"))
            ),
        ),
        "similarity_table_all": q(
            "wide",
            f""", season AS (SELECT * FROM wide WHERE game_year = {TARGET}), ranked AS (
 SELECT a.batter_id, a.player_name, b.player_name AS other, v.value, row_number() OVER (
  PARTITION BY a.batter_id, a.player_name, v.value ORDER BY v.sign * ((a."FB" - b."FB") * (a."FB" - b."FB")
  + (a."BB" - b."BB") * (a."BB" - b."BB") + (a."OS" - b."OS") * (a."OS" - b."OS")), b.batter_id, b.player_name) AS k
 FROM (VALUES ('Most Similar', 1.0::DOUBLE), ('Least Similar', -1.0::DOUBLE)) v(value, sign), season a
 LEFT JOIN season b ON b.num_pitches >= {MIN_PITCHES} AND (a.batter_id <> b.batter_id OR a.player_name <> b.player_name))
SELECT batter_id, player_name, value, max(other) FILTER (WHERE k = 1) AS player_1,
 max(other) FILTER (WHERE k = 2) AS player_2, max(other) FILTER (WHERE k = 3) AS player_3
FROM ranked GROUP BY batter_id, player_name, value""",
        ),
        "format_number_styles": q(
            "card",
            f"""SELECT batter_id, player_name, pitch_group, metric,
 {_fixed('value', 1)} || '  ' AS number, format('{{:.6f}}', value) AS number_default,
 {_fixed('1000 * value', 2, True)} AS comma, '$' || {_fixed('1000 * value', 0, True)} AS currency,
 {_fixed('100 * value', 1)} || '%' AS percent, {_fixed('value', 1)} || '%' AS percent_unscaled,
 CAST(CAST(round_even(value, 0) AS BIGINT) AS VARCHAR) AS plain FROM card""",
        ),
        "format_report_cells": q(
            "wide",
            f"""SELECT {SEASON}, {_fixed('num_pitches', 0, True)} AS num_pitches,
 {_fixed('100 * "FB"', 0)} || '%' AS "FB", {_fixed('100 * "BB"', 0)} || '%' AS "BB",
 {_fixed('100 * "OS"', 0)} || '%' AS "OS" FROM wide""",
        ),
        "stratified_split": q("splitted", f"SELECT {SEASON}, pitch_group, is_train FROM splitted"),
        "repeated_stratified_folds": q(
            "training",
            f"""SELECT {SEASON}, pitch_group, CAST(repeat AS INT) AS repeat, CAST((row_number() OVER (
 PARTITION BY pitch_group, repeat ORDER BY {_hash(f'{SEED} + repeat')}, {ORDER_KEYS}) - 1) % 5 AS INT) AS fold
FROM training, (VALUES (1), (2), (3), (4), (5)) r(repeat)""",
        ),
        "corr_filter": q("training", _corr_filter(preds)),
        "zero_variance_filter": q(
            "training",
            " UNION ALL ".join(
                f"""SELECT '{c}' AS "column", CAST(min({c}) AS DOUBLE) AS lo, CAST(max({c}) AS DOUBLE) AS hi,
 CASE WHEN count(DISTINCT {c}) < 2 THEN 1 ELSE 0 END AS zero_variance FROM training"""
                for c in [*preds, "prop"]
            ),
        ),
        "dummy_encode": q(
            "traintest",
            f"""SELECT {SEASON}, pitch_group, CASE WHEN pitch_group = 'FB' THEN 1 ELSE 0 END AS "pitch_group_FB",
 CASE WHEN pitch_group = 'OS' THEN 1 ELSE 0 END AS "pitch_group_OS" FROM traintest""",
        ),
        "normalize": q(
            "traintest training",
            f"SELECT {', '.join(f't.{c}' for c in IDS)}, "
            + ", ".join(f"round((t.{c} - l.{c}_m) / nullif(l.{c}_s, 0), 6) + 0.0 AS z_{c}" for c in preds)
            + " FROM traintest t, (SELECT "
            + ", ".join(f"avg({c}) AS {c}_m, stddev_samp({c}) AS {c}_s" for c in preds)
            + " FROM training) l",
        ),
        "cv_summary": q(
            "traintest",
            f""", fold AS (SELECT {SEASON}, pitch_group, num_pitches, total_pitches_previous, repeat,
 (row_number() OVER (PARTITION BY pitch_group, repeat ORDER BY {_hash(f'{SEED} + repeat')}, {ORDER_KEYS}) - 1) % 5 AS fold
 FROM traintest, (VALUES (1), (2), (3), (4), (5)) r(repeat)),
guess AS (SELECT fold.*, CAST(point AS INT) AS point, {STANDIN.format(k='point')} AS g
 FROM fold, (VALUES (1), (2), (3)) p(point)),
res AS (SELECT point, repeat, fold, {_metrics('num_pitches', 'g')} FROM guess GROUP BY ALL)
"""
            + " UNION ALL ".join(
                f"""SELECT point, '{m}' AS metric, round(avg({m}), 6) AS mean,
 round(stddev_samp({m}) / nullif(sqrt(count({m})), 0), 6) AS std_err, count({m}) AS n FROM res GROUP BY point"""
                for m in ("rmse", "rsq", "mae")
            ),
        ),
        "regression_metrics": q(
            "cells",
            f""", res AS (SELECT pitch_group, {_metrics('num_pitches', STANDIN.format(k=3))} FROM cells GROUP BY pitch_group)
"""
            + " UNION ALL ".join(
                f"SELECT pitch_group, '{m}' AS metric, round({m}, 6) AS estimate FROM res" for m in ("rmse", "rsq", "mae")
            ),
        ),
    }
    inputs = f"""{_kept(preds)}"""
    keys = f"{SEASON}, pitch_group"
    holdout = "holdout AS (SELECT * FROM splitted WHERE is_train = 0)"
    cells = ", ".join(f"('{c}', CAST({c} AS DOUBLE))" for c in preds)
    cells += "".join(f", ('pitch_group_{g}', CASE WHEN pitch_group = '{g}' THEN 1.0::DOUBLE ELSE 0.0 END)" for g in ("FB", "OS"))
    out |= {
        "recipe_bake": q(
            "splitted training",
            f"""{inputs}, {holdout}
SELECT {keys}, cell.c AS "column", round(coalesce((cell.x - k.mean) / k.sd, 0), 6) + 0.0 AS z
FROM holdout, LATERAL (VALUES {cells}) cell(c, x) JOIN kept k ON k.c = cell.c""",
        ),
        "variable_importance": q("training", f"{inputs} SELECT c AS variable, 1 AS on_scale FROM kept"),
        "rf_screen": q("topredict", f"SELECT {keys}, 1 AS in_range FROM topredict"),
        "gbt_fit": "SELECT unnest(['rmse', 'rsq', 'mae']) AS metric, 1 AS better_than_spread",
        "tune_grid": """SELECT min_n, mtry, trees, metric, CAST(25 AS BIGINT) AS n
FROM (VALUES (1), (12), (23), (34), (45), (56), (67), (78), (89), (100)) a(min_n),
     (VALUES (1), (6), (11), (17), (22), (28), (33), (39), (44), (50)) b(mtry),
     (VALUES (1), (12), (23), (34), (45), (56), (67), (78), (89), (100)) c(trees),
     (VALUES ('rmse'), ('rsq'), ('mae')) d(metric)""",
        "predict_batch": q("final", 'SELECT "BATTER_ID", "PLAYER_NAME", "GAME_YEAR", 1 AS whole FROM final'),
        "bind_columns": q("splitted", f"SELECT {keys}, num_pitches, 1 AS predicted FROM splitted WHERE is_train = 0"),
        "model_persist": q("splitted", f"SELECT {keys}, 1 AS same FROM splitted WHERE is_train = 0"),
    }
    for flag in FLAGS:
        key = f"flag_{flag}" if flag.startswith("is_") else flag
        out[key] = q("pitch", f"SELECT {pitch_key}, {flag} FROM (SELECT *, {FLAG_LIST} FROM pitch)")
    return out


def _kept(names) -> str:
    """CTEs up to kept(c, mean, sd): predictors that neither correlate nor are constant, and the two indicators."""
    found = _corr_filter(names).replace("SELECT col_a, col_b, round(r, 6) AS r, ", ", dropped AS (SELECT ") + ")"
    assert found.count(", dropped AS (SELECT CASE") == 1
    values = ", ".join(f"('{c}', CAST({c} AS DOUBLE))" for c in names)
    values += "".join(f", ('pitch_group_{g}', CASE WHEN pitch_group = '{g}' THEN 1.0::DOUBLE ELSE 0.0 END)" for g in ("FB", "OS"))
    return f"""{found}, kept AS (
 SELECT c, avg(x) AS mean, stddev_samp(x) AS sd FROM training, LATERAL (VALUES {values}) v(c, x)
 WHERE c NOT IN (SELECT dropped FROM dropped) GROUP BY c HAVING min(x) < max(x))"""


def _corr_filter(names) -> str:
    pairs, values = pairs_sql("training", names)
    return f""", {values}, pairs AS ({pairs}),
ends AS (SELECT col_a AS c, abs(coalesce(r, 0)) AS s FROM pairs UNION ALL SELECT col_b, abs(coalesce(r, 0)) FROM pairs),
means AS (SELECT c, round((sum(s) + 1) / {len(names)}, 9) AS m FROM ends GROUP BY c)
SELECT col_a, col_b, round(r, 6) AS r, CASE WHEN b.m > a.m THEN col_b ELSE col_a END AS dropped
FROM pairs JOIN means a ON a.c = col_a JOIN means b ON b.c = col_b WHERE abs(r) > 0.9"""
