"""One runnable query per operator, over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dugout.functions import formats, measures
from dugout.functions.flags import with_flags
from dugout.operators import columns, ingest, joins, ranking, reshape, shares, similar, split, topk
from dugout.operators import correlation as corr
from dugout.params import BATTER, BATTER_YEAR, CELL, CORR_CUTOFF, FIXTURE_SEASONS, GROUPS
from dugout.operators.knn import impute_knn as fill_from_neighbours
from dugout.plans import evaluation, features, filling, model_table, modelling, report, summaries, tuning
from dugout.plans.standin import standin, with_standin
from dugout.sources import files, lookup, scratch, tables
from dugout.sources.schema import PITCH_SCHEMA, PREDICTION_SCHEMA

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
#: What fitted models give, which no SQL can: tests/test_model_figures.py holds it against plain figures.
FIGURES: dict[str, Query] = {}
SEASONS = FIXTURE_SEASONS

#: Runtime parameters of the report queries.
PLAYERS = ("Customer#000000004", "Customer#000000011")
TARGET_BATTER = 4
MIN_PITCHES = 3

PITCH_KEY = ["l_orderkey", "l_linenumber"]


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def figures(fn: Query) -> Query:
    FIGURES[fn.__name__] = fn
    return fn


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.pitches(spark, sf_dir)


def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.clean(raw(spark, sf_dir))


def flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.flagged(raw(spark, sf_dir))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.player_cells(flagged(spark, sf_dir))


#: What seasons, reports and the stand-in prediction read of the cell table.
NARROW = (*CELL, "pred_year", "num_pitches", "prop", "total_pitches_previous")


def stored_cells(spark: SparkSession, sf_dir: str, columns=None) -> DataFrame:
    return model_table.stored_cells(flagged(spark, sf_dir), columns)


def model_rows(spark: SparkSession, sf_dir: str, columns=None) -> DataFrame:
    return model_table.carry_over(stored_cells(spark, sf_dir, columns), SEASONS)


def train_test(spark: SparkSession, sf_dir: str, columns=None) -> DataFrame:
    return model_table.train_test_rows(model_rows(spark, sf_dir, columns), SEASONS)


def to_predict(table: DataFrame) -> DataFrame:
    return model_table.predict_rows(model_table.carry_over(table, SEASONS), SEASONS)


def predicted(spark: SparkSession, sf_dir: str, columns=NARROW) -> DataFrame:
    """Rows to predict with the stand-in prediction."""
    return with_standin(to_predict(stored_cells(spark, sf_dir, columns)))


def report_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Played seasons and predictions, both from one stored cell table."""
    table = stored_cells(spark, sf_dir, NARROW)
    return report.actual_counts(table), with_standin(to_predict(table))


def overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.pitch_summary_overall(flagged(spark, sf_dir))


def stored_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The player card table; ranks and domains read it several times."""
    return scratch.materialize(overall(spark, sf_dir), "overall")


def split_rows(spark: SparkSession, sf_dir: str, columns=None) -> DataFrame:
    """Train and holdout rows, stored because the steps on them read them repeatedly.

    Trees hold a scan task's rows in memory many times as large as they are stored, hence the bounded files.
    """
    rows = split.stratified_split(train_test(spark, sf_dir, columns))
    return scratch.materialize(rows, "split", scratch.FITTED_FILE_ROWS)


def training(spark: SparkSession, sf_dir: str, columns=None) -> DataFrame:
    return split_rows(spark, sf_dir, columns).where("is_train").drop("is_train")


# --- sources and sinks ---------------------------------------------------------------


@query
def scan_csv(spark, sf_dir):
    path = scratch.scratch_dir(spark, "pitches-csv")
    files.sink_csv(raw(spark, sf_dir), path)
    return files.scan_csv(spark, path, PITCH_SCHEMA)


@query
def sink_csv(spark, sf_dir):
    path = scratch.scratch_dir(spark, "predictions-csv")
    files.sink_csv(report.final_predictions(predicted(spark, sf_dir), SEASONS), path, ["BATTER_ID", "PLAYER_NAME"])
    return files.scan_csv(spark, path, PREDICTION_SCHEMA)


@query
def snapshot_write(spark, sf_dir):
    path = scratch.scratch_dir(spark, "clean")
    df = clean(spark, sf_dir)
    files.write_snapshot(df, path)
    return files.read_snapshot(spark, path, df.schema).groupBy("game_year", "pitch_group").agg(
        F.count(F.lit(1)).alias("n"), F.sum("launch_speed").alias("speed")
    )


@query
def snapshot_read(spark, sf_dir):
    """Reads three columns of one partition of the yearly table."""
    path = scratch.scratch_dir(spark, "yearly")
    summary = summaries.yearly_summary(flagged(spark, sf_dir))
    files.write_snapshot(summary, path)
    yearly = files.read_snapshot(spark, path, summary.schema)
    return yearly.where(F.col("game_year") == SEASONS.last_year).select(*BATTER_YEAR, "total_pitches", "swing_prop")


@query
def literal_lookup(spark, sf_dir):
    """Report colours beside the pitch count of each group and of all groups."""
    counts = clean(spark, sf_dir).groupBy("pitch_group").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("n")).select(F.lit("All").alias("pitch_group"), "n")
    return lookup.group_colours(spark).join(counts.unionByName(total), "pitch_group", "left")


# --- projection, filter, rename, distinct --------------------------------------------


@query
def clean_names(spark, sf_dir):
    messy = raw(spark, sf_dir).select(
        F.col("batter_id").alias("BATTER_ID"),
        F.col("player_name").alias("Player Name"),
        F.col("game_year").alias("gameYear"),
        F.col("pitch_name").alias("PITCH-NAME"),
        F.col("zone").alias("Zone (1-14)"),
        F.col("strikes").alias("# strikes"),
        F.col("home_team").alias("team"),
        F.col("away_team").alias("Team"),
    )
    return ingest.clean_names(messy)


@query
def bucket_pitch_group(spark, sf_dir):
    df = ingest.bucket_pitch_group(raw(spark, sf_dir))
    return df.select(*PITCH_KEY, "batter_id", "pitch_name", "pitch_group")


@query
def filter_known_group(spark, sf_dir):
    return clean(spark, sf_dir).select(*PITCH_KEY, "batter_id", "pitch_name", "pitch_group")


@query
def distinct_values(spark, sf_dir):
    return clean(spark, sf_dir).select("events").distinct()


@query
def distinct_rows(spark, sf_dir):
    return clean(spark, sf_dir).select("player_name", "game_year", "home_team").dropDuplicates()


@query
def sorted_choices(spark, sf_dir):
    return columns.sorted_choices(summaries.player_info(clean(spark, sf_dir)), "player_name")


@query
def select_reorder(spark, sf_dir):
    return columns.first_columns(cells(spark, sf_dir), [*BATTER_YEAR, "pred_year"])


@query
def select_cols(spark, sf_dir):
    return cells(spark, sf_dir).select(*CELL, "num_pitches", "prop")


@query
def drop_cols(spark, sf_dir):
    return overall(spark, sf_dir).drop("player_name", "sz_top", "sz_bot", "singles", "doubles", "triples", "homeruns", "ks", "walks")


@query
def select_numeric(spark, sf_dir):
    df = cells(spark, sf_dir)
    return df.select(*columns.numeric_columns(df))


@query
def rename_cols(spark, sf_dir):
    wide = reshape.pivot_groups(summaries.pitch_summary(flagged(spark, sf_dir)), BATTER_YEAR, "prop")
    return wide.withColumnsRenamed(report.OUTPUT_NAMES)


@query
def const_cols(spark, sf_dir):
    return model_table.prediction_template(clean(spark, sf_dir), SEASONS)


@query
def split_by_year(spark, sf_dir):
    rows = model_rows(spark, sf_dir, [*CELL, "pred_year", "num_pitches"])
    rows = scratch.materialize(rows, "model-rows")
    parts = {
        "train_test": model_table.train_test_rows(rows, SEASONS),
        "predict": model_table.predict_rows(rows, SEASONS),
    }
    first, second = (df.withColumn("part", F.lit(name)) for name, df in parts.items())
    return first.unionByName(second)


@query
def filter_by_player(spark, sf_dir):
    return columns.for_players(overall(spark, sf_dir), PLAYERS)


@query
def batting_team(spark, sf_dir):
    df = ingest.batting_team(clean(spark, sf_dir))
    return df.select(*PITCH_KEY, "batter_id", "inning_topbot", "batting_team")


@query
def player_info(spark, sf_dir):
    return summaries.player_info(clean(spark, sf_dir))


@query
def tag_true_pred(spark, sf_dir):
    """The predicted season is the year after each row, so both tags occur."""
    rows = model_rows(spark, sf_dir, [*CELL, "pred_year"]).select(
        *BATTER, F.col("pred_year").alias("game_year"), "pitch_group"
    )
    return report.tag_type(rows, SEASONS)


@query
def reassign_pred_year(spark, sf_dir):
    return model_rows(spark, sf_dir)


@query
def season_report(spark, sf_dir):
    """Report request: a player's seasons, actual and predicted, as text cells."""
    wide = report.report_wide(*report_inputs(spark, sf_dir), SEASONS)
    return report.season_report(columns.for_players(wide, PLAYERS))


@query
def player_card(spark, sf_dir):
    """Report request: a player's pitch groups with their colours, most frequent first."""
    pitches = columns.for_players(flagged(spark, sf_dir), PLAYERS)
    return report.player_card(summaries.pitch_summary_overall(pitches), lookup.group_colours(spark))


@query
def percent_scale(spark, sf_dir):
    return overall(spark, sf_dir).select(*BATTER, "pitch_group", (100 * F.col("prop")).alias("prop"))


# --- row flags -----------------------------------------------------------------------

FLAGS = (
    "is_bip",
    "is_swing",
    "is_contact",
    "is_whiff",
    "is_zone_swing",
    "is_chase_swing",
    "is_putaway",
    "is_sweetspot",
    "is_hardhit",
    "is_barrel",
    "is_single",
    "is_double",
    "is_triple",
    "is_home_run",
    "is_walk",
    "is_strikeout",
    "delta_bat_win_exp",
)


def _flag_query(flag: str) -> Query:
    """Flag of every raw pitch, known group or not."""

    def run(spark, sf_dir):
        return with_flags(raw(spark, sf_dir)).select(*PITCH_KEY, "batter_id", flag)

    return run


for _flag in FLAGS:
    QUERIES[f"flag_{_flag}" if _flag.startswith("is_") else _flag] = _flag_query(_flag)


# --- aggregation ---------------------------------------------------------------------


@query
def agg_count(spark, sf_dir):
    return clean(spark, sf_dir).groupBy(*BATTER_YEAR).agg(F.count(F.lit(1)).alias("total_pitches"))


@query
def agg_mean_narm(spark, sf_dir):
    means = [m for m in measures.MEANS if m not in measures.WOBA_ONLY]
    return flagged(spark, sf_dir).groupBy(*BATTER_YEAR).agg(*(F.avg(measures.averaged(m)).alias(m) for m in means))


@query
def agg_mean_where(spark, sf_dir):
    means = {
        "woba": measures.averaged("woba"),
        "xwoba": measures.averaged("xwoba"),
        "exit_velo": measures.averaged("exit_velo", in_play=True),
        "exit_angle": measures.averaged("exit_angle", in_play=True),
    }
    return flagged(spark, sf_dir).groupBy(*BATTER, "pitch_group").agg(*(F.avg(c).alias(m) for m, c in means.items()))


@query
def agg_sum_narm(spark, sf_dir):
    return summaries.yearly_summary(flagged(spark, sf_dir)).select(*BATTER_YEAR, *measures.SUMS)


@query
def total_bases(spark, sf_dir):
    return summaries.yearly_summary(flagged(spark, sf_dir)).select(*BATTER_YEAR, "total_bases")


@query
def pred_year(spark, sf_dir):
    return summaries.yearly_summary(flagged(spark, sf_dir)).select(*BATTER_YEAR, "pred_year")


@query
def yearly_summary(spark, sf_dir):
    return summaries.yearly_summary(flagged(spark, sf_dir))


@query
def pitch_summary(spark, sf_dir):
    return summaries.pitch_summary(flagged(spark, sf_dir))


@query
def pitch_summary_overall(spark, sf_dir):
    return summaries.pitch_summary_overall(flagged(spark, sf_dir))


@query
def pitch_counts(spark, sf_dir):
    return shares.share_by_year(summaries.pitch_counts(clean(spark, sf_dir)), "num_pitches")


@query
def count_team_group(spark, sf_dir):
    return summaries.team_group_counts(clean(spark, sf_dir))


@query
def corr_matrix(spark, sf_dir):
    df = stored_cells(spark, sf_dir)
    pairs = corr.corr_matrix(df, columns.numeric_columns(df))
    return pairs.withColumn("r", F.round("r", 6))


@query
def multi_grain(spark, sf_dir):
    return summaries.multi_grain(flagged(spark, sf_dir))


# --- windows -------------------------------------------------------------------------


@query
def share_by_year(spark, sf_dir):
    counts = summaries.pitch_counts(clean(spark, sf_dir))
    return shares.share_by_year(counts, "num_pitches").select(*CELL, "prop")


@query
def share_overall(spark, sf_dir):
    counts = clean(spark, sf_dir).groupBy(*BATTER, "pitch_group").agg(F.count(F.lit(1)).alias("n"))
    return shares.share_overall(counts, "n").select(*BATTER, "pitch_group", "prop")


@query
def clamp_and_share(spark, sf_dir):
    """Shares over all seasons of a batter, as the year is not part of the key."""
    rows = with_standin(cells(spark, sf_dir)).select(*CELL, "prediction")
    return shares.clamp_and_share(rows, "prediction", "xprop")


@query
def partition_total(spark, sf_dir):
    counts = summaries.pitch_counts(clean(spark, sf_dir))
    by_year = shares.partition_total(counts, "num_pitches", BATTER_YEAR, "season_pitches")
    return shares.partition_total(by_year, "num_pitches", BATTER, "career_pitches")


@query
def avg_rank(spark, sf_dir):
    """Rank of a player's exit figures among that player's pitch groups, both directions."""
    values = stored_overall(spark, sf_dir).select(*BATTER, "pitch_group", "exit_velo")
    up = ranking.average_rank(values, "exit_velo", ["player_name"], "rank_asc")
    return ranking.average_rank(up, "exit_velo", ["player_name"], "rank_desc", descending=True)


@query
def domain_range(spark, sf_dir):
    long = report.card_metrics(stored_overall(spark, sf_dir))
    return ranking.with_domain(long, "value", ["player_name", "metric"])


@query
def scale_position(spark, sf_dir):
    return report.card_positions(stored_overall(spark, sf_dir))


# --- joins ---------------------------------------------------------------------------


def joined_summaries(spark, sf_dir) -> DataFrame:
    pitches = flagged(spark, sf_dir)
    yearly, by_group = summaries.yearly_summary(pitches), summaries.pitch_summary(pitches)
    return joins.left_join_suffixed(yearly, by_group, [*BATTER_YEAR, "pred_year"], ("_previous", "_pitch"))


@query
def join_left_suffix(spark, sf_dir):
    return joined_summaries(spark, sf_dir)


@query
def join_left_natural(spark, sf_dir):
    counts = summaries.pitch_counts(clean(spark, sf_dir))
    by_group = summaries.pitch_summary(flagged(spark, sf_dir))
    return joins.left_join_natural(by_group, counts).select(*CELL, "total_pitches", "prop", "num_pitches")


@query
def join_left_noop(spark, sf_dir):
    template = model_table.prediction_template(clean(spark, sf_dir), SEASONS)
    return model_table.join_template(cells(spark, sf_dir), template)


@query
def join_anti(spark, sf_dir):
    keys = summaries.pitch_counts(clean(spark, sf_dir))
    return model_table.absent_hitters(keys, SEASONS)


@query
def join_semi_flag(spark, sf_dir):
    counts = summaries.pitch_counts(clean(spark, sf_dir))
    absent = model_table.absent_hitters(counts, SEASONS)
    marked = joins.mark_members(counts, absent, "player_name", "is_absent")
    return marked.withColumn("is_absent", F.col("is_absent").cast("int"))


@query
def join_lookup(spark, sf_dir):
    totals = overall(spark, sf_dir).select(*BATTER, "pitch_group", "total_pitches")
    return totals.join(F.broadcast(lookup.group_colours(spark)), "pitch_group", "left")


# --- set operations and reshape ------------------------------------------------------


@query
def union_by_name(spark, sf_dir):
    counts = summaries.pitch_counts(clean(spark, sf_dir))
    shared = report.predicted_shares(predicted(spark, sf_dir), SEASONS)
    return reshape.stack_rows(counts, shared)


@query
def pivot_shares(spark, sf_dir):
    return reshape.pivot_groups(summaries.pitch_summary(flagged(spark, sf_dir)), BATTER_YEAR, "prop")


@query
def pivot_fill_zero(spark, sf_dir):
    rows = shares.share_by_year(summaries.pitch_counts(clean(spark, sf_dir)), "num_pitches")
    rows = shares.partition_total(rows, "num_pitches", BATTER_YEAR, "num_pitches")
    return reshape.pivot_groups(rows, [*BATTER_YEAR, "num_pitches"], "prop", fill=0.0)


@query
def final_prediction_table(spark, sf_dir):
    final = report.final_predictions(predicted(spark, sf_dir), SEASONS)
    return columns.sort_missing_last(final, "BATTER_ID", "PLAYER_NAME")


@query
def report_long(spark, sf_dir):
    return report.report_long(*report_inputs(spark, sf_dir), SEASONS)


@query
def report_wide(spark, sf_dir):
    return report.report_wide(*report_inputs(spark, sf_dir), SEASONS)


# --- sort, limit, top-k --------------------------------------------------------------


@query
def sort_asc(spark, sf_dir):
    by_group = summaries.pitch_summary(flagged(spark, sf_dir)).select(*CELL, "total_pitches", "whiff_prop")
    return columns.sort_missing_last(by_group, "game_year", "total_pitches", "batter_id", "player_name", "pitch_group")


@query
def sort_desc(spark, sf_dir):
    totals = overall(spark, sf_dir).select(*BATTER, "pitch_group", "total_pitches")
    return columns.sort_missing_last(
        totals, "total_pitches", "batter_id", "player_name", "pitch_group", descending=True
    )


@query
def head_n(spark, sf_dir):
    totals = overall(spark, sf_dir).select(*BATTER, "pitch_group", "total_pitches")
    order = [F.col("total_pitches").desc_nulls_last(), *(F.col(c).asc_nulls_last() for c in (*BATTER, "pitch_group"))]
    return topk.head(totals, 10, *order)


def distances(spark, sf_dir) -> DataFrame:
    wide = report.report_wide(*report_inputs(spark, sf_dir), SEASONS)
    wide = scratch.materialize(wide, "report-wide")
    return topk.share_distances(wide, TARGET_BATTER, SEASONS.target_year, MIN_PITCHES)


@query
def topk_similar(spark, sf_dir):
    return topk.with_ties(distances(spark, sf_dir), 3).withColumn("distance", F.round("distance", 6))


@query
def topk_dissimilar(spark, sf_dir):
    return topk.with_ties(distances(spark, sf_dir), 3, nearest=False).withColumn("distance", F.round("distance", 6))


@query
def similarity_table(spark, sf_dir):
    return topk.similarity_table(distances(spark, sf_dir))


@query
def similarity_table_all(spark, sf_dir):
    """Most and least similar hitters of every hitter of the season."""
    wide = scratch.materialize(report.report_wide(*report_inputs(spark, sf_dir), SEASONS), "report-wide")
    return similar.similarity_of_all(wide, SEASONS.target_year, MIN_PITCHES)


# --- formats -------------------------------------------------------------------------


@query
def format_number_styles(spark, sf_dir):
    """Every style on every cell of the player cards."""
    v = F.col("value")
    return report.card_metrics(overall(spark, sf_dir)).select(
        *BATTER,
        "pitch_group",
        "metric",
        formats.format_value(v, "number", 1, "  ").alias("number"),
        formats.format_value(v, "number").alias("number_default"),
        formats.format_value(1000 * v, "comma", 2).alias("comma"),
        formats.format_value(1000 * v, "currency", 0).alias("currency"),
        formats.format_value(v, "percent", 1).alias("percent"),
        formats.format_value(v, "percent", 1, scale_percent=False).alias("percent_unscaled"),
        formats.format_value(v, "plain", 0).alias("plain"),
    )


@query
def format_report_cells(spark, sf_dir):
    wide = report.report_wide(*report_inputs(spark, sf_dir), SEASONS)
    return wide.select(
        *BATTER_YEAR,
        formats.whole_number(F.col("num_pitches")).alias("num_pitches"),
        *(formats.whole_percent(F.col(g)).alias(g) for g in GROUPS),
    )


# --- splits, feature preparation, evaluation -----------------------------------------


@query
def stratified_split(spark, sf_dir):
    rows = split.stratified_split(train_test(spark, sf_dir, [*CELL, "pred_year"]).select(*CELL))
    return rows.withColumn("is_train", F.col("is_train").cast("int"))


@query
def repeated_stratified_folds(spark, sf_dir):
    return split.stratified_folds(training(spark, sf_dir, [*CELL, "pred_year"]))


@query
def corr_filter(spark, sf_dir):
    names = features.predictors()
    pairs = corr.correlations(corr.pair_moments(training(spark, sf_dir), names))
    found = corr.with_names(corr.redundant_pairs(pairs, len(names), CORR_CUTOFF), names)
    dropped = F.when(F.col("drop_j"), F.col("col_b")).otherwise(F.col("col_a"))
    return found.select("col_a", "col_b", F.round("r", 6).alias("r"), dropped.alias("dropped"))


@query
def zero_variance_filter(spark, sf_dir):
    return features.variance_report(training(spark, sf_dir), [*features.predictors(), "prop"])


@query
def dummy_encode(spark, sf_dir):
    encoded = features.with_dummies(train_test(spark, sf_dir, [*CELL, "pred_year"]))
    return encoded.select(*CELL, *features.DUMMIES)


@query
def normalize(spark, sf_dir):
    """Learned on the training part, applied to all rows."""
    rows = split_rows(spark, sf_dir)
    names = features.predictors()
    scaled = features.normalized(rows, rows.where("is_train"), names)
    return scaled.select(*CELL, *(F.round(f"z_{c}", 6).alias(f"z_{c}") for c in names))


@query
def cv_summary(spark, sf_dir):
    """Fold metrics of three stand-in predictors, summarised per predictor."""
    table = scratch.materialize(train_test(spark, sf_dir, NARROW), "train-test")
    folds = split.stratified_folds(table.select(*CELL))
    points = F.array(*(F.struct(F.lit(k).alias("point"), standin(k).alias("guess")) for k in (1, 2, 3)))
    guesses = table.select(*CELL, "num_pitches", points.alias("points"))
    # A cell's guesses meet its folds as one row; they are taken apart once nothing is shuffled any more.
    joined = joins.left_join_natural(folds, guesses)
    rows = joined.select("repeat", "fold", "num_pitches", F.explode_outer("points").alias("p")).select("*", "p.*")
    resamples = evaluation.regression_metrics(rows, "num_pitches", "guess", by=["point", "repeat", "fold"])
    summary = evaluation.cv_summary(resamples, ["point"])
    return summary.select(
        "point", "metric", F.round("mean", 6).alias("mean"), F.round("std_err", 6).alias("std_err"), "n"
    )


@query
def regression_metrics(spark, sf_dir):
    rows = with_standin(cells(spark, sf_dir))
    by_group = evaluation.regression_metrics(rows, "num_pitches", "prediction", by=["pitch_group"])
    return by_group.withColumn("estimate", F.round("estimate", 6))


# --- models --------------------------------------------------------------------------

#: Setting of the model queries that fit a stated point.
SMALL_FIT = modelling.Point(min_n=12, mtry=17, trees=(5,))
#: What is tuned: a thousand points, in a hundred fits per resample.
GRID = modelling.regular_grid()
#: Trees of the registered screening forest; the forest's own default is 500.
SCREENING_TREES = 200


def fitted(train: DataFrame):
    return modelling.fit(train, modelling.boosted_trees(SMALL_FIT))


def holdout(rows: DataFrame) -> DataFrame:
    return rows.where(~F.col("is_train"))


@query
def impute_knn(spark, sf_dir):
    """Training rows filled from all training rows; season and group are terms of the distance."""
    rows = training(spark, sf_dir)
    return fill_from_neighbours(rows, features.predictors(), block=())


@query
def recipe_bake(spark, sf_dir):
    """Learned on the training part, applied to the holdout; one row per cell of the table that comes out."""
    rows = split_rows(spark, sf_dir)
    recipe = features.fit_recipe(rows.where("is_train"))
    baked = [F.struct(F.lit(c).alias("column"), F.col(f"z_{c}").alias("z")) for c in recipe.inputs]
    cells = F.explode(F.array(*baked))
    scaled = recipe.stages()[0].transform(holdout(rows)).select(*CELL, cells.alias("cell"))
    return scaled.select(*CELL, "cell.column", F.round("cell.z", 6).alias("z"))


def screened(spark, sf_dir):
    """Filter on correlation first, fill what it leaves from neighbours, then scale and fit the screening forest.

    Returns the model, whose first stage fills new rows from the training rows. It is fitted once per session and
    data directory; the queries that read it share the stored model.
    """
    path, fresh = scratch.shared_dir(spark, "screened", sf_dir, filling.impute_knn)
    if fresh:
        train = training(spark, sf_dir)
        left = [c for c in features.fit_recipe(train).inputs if c not in features.DUMMIES]
        filler = filling.NeighbourFill.fit(train, left)
        # Trees are grown over and over on these rows: every core gets a part of them, however few they are.
        imputed = filler.transform(train).repartition(spark.sparkContext.defaultParallelism)
        imputed = scratch.materialize(imputed, "imputed")
        recipe = features.fit_recipe(imputed, numeric=left)
        model = modelling.fit(imputed, modelling.screening_forest(trees=SCREENING_TREES), recipe)
        modelling.save(PipelineModel([filler, *model.stages]), path)
    return modelling.load(path)


@figures
def rf_screen_predictions(spark, sf_dir):
    """Forest on the imputed training part, applied to the rows to predict, filled from training rows."""
    rows = predicted(spark, sf_dir, None).drop("prediction")
    return modelling.predict(screened(spark, sf_dir), rows).select(*CELL, "prediction")


@query
def rf_screen(spark, sf_dir):
    """Check of ``rf_screen_predictions``: is each within the range of the training outcomes?"""
    ends = training(spark, sf_dir).agg(F.min(features.OUTCOME).alias("lo"), F.max(features.OUTCOME).alias("hi")).first()
    fine = F.coalesce(F.col("prediction").between(ends.lo, ends.hi), F.lit(False)).cast("int")
    return rf_screen_predictions(spark, sf_dir).select(*CELL, fine.alias("in_range"))


@figures
def variable_importance_scores(spark, sf_dir):
    """The model's inputs with their importances, the largest at 100."""
    return modelling.variable_importance(spark, screened(spark, sf_dir))


@query
def variable_importance(spark, sf_dir):
    """Check of ``variable_importance_scores``: are importances on a scale from 0, with exactly one at 100?"""
    scores = variable_importance_scores(spark, sf_dir)
    tops = scores.where(F.abs(F.col("importance") - 100) < 1e-9).count()
    on_scale = F.col("importance").between(0.0, 100.0 + 1e-9) & F.lit(tops == 1)
    return scores.select("variable", on_scale.cast("int").alias("on_scale"))


def scored_holdout(rows: DataFrame, point: modelling.Point) -> DataFrame:
    """Holdout rows with the prediction of a model of that point, fitted on the training part."""
    model = modelling.fit(rows.where("is_train"), modelling.boosted_trees(point))
    return modelling.predict(model, holdout(rows))


def with_spread(scored: DataFrame) -> DataFrame:
    """Metrics of predictions beside the outcome's own spread, which a model that learned anything beats."""
    found = evaluation.regression_metrics(scored, features.OUTCOME, "prediction")
    return found.withColumn("spread", F.lit(scored.agg(F.stddev_samp(features.OUTCOME)).first()[0]))


@figures
def gbt_fit_metrics(spark, sf_dir):
    """Fitted on the training part: rmse, rsq and mae on the holdout."""
    return with_spread(scored_holdout(split_rows(spark, sf_dir), SMALL_FIT))


@query
def gbt_fit(spark, sf_dir):
    """Check of ``gbt_fit_metrics``: does the fit beat the outcome's own spread on the holdout?"""
    within = F.col("estimate").between(0.0, 1.0 + 1e-9)
    better = F.when(F.col("metric") == "rsq", within).otherwise(F.col("estimate") < F.col("spread"))
    return gbt_fit_metrics(spark, sf_dir).select("metric", better.cast("int").alias("better_than_spread"))


#: What tells one tuned setting from another.
TUNED = list(tuning.POINT)


def tuned(spark, sf_dir, rows: DataFrame | None = None) -> tuning.ResultStore:
    """The whole grid on all 25 resamples, in a store that the queries of a session share and go on filling.

    ``rows`` are the stored train and holdout rows, if the caller has them already.
    """
    path, fresh = scratch.shared_dir(spark, "tuning", sf_dir, modelling.tune_grid)
    store = tuning.ResultStore(spark, path)
    if fresh or not store.versions():
        train = training(spark, sf_dir) if rows is None else rows.where("is_train").drop("is_train")
        folds = scratch.materialize(split.stratified_folds(train), "folds")
        store.publish(modelling.tune_grid(train, folds, GRID, store=store))
    return store


@figures
def tune_grid_metrics(spark, sf_dir, rows=None):
    """Mean, standard error and number of resamples of each metric at each grid point, from the published results."""
    return evaluation.cv_summary(tuned(spark, sf_dir, rows).published(), TUNED).select(*TUNED, "metric", "mean", "std_err", "n")


@figures
def tune_grid_predictions(spark, sf_dir):
    """Kept predictions: each training row once per repeat and setting, predicted while it was held out."""
    store = tuned(spark, sf_dir)
    return store.predictions(modelling.tasks_of(GRID)).select(*CELL, features.OUTCOME, *TUNED, *tuning.RESAMPLE, "prediction")


@query
def tune_grid(spark, sf_dir):
    """Check of ``tune_grid_metrics``: is each metric of each grid point known on all resamples?"""
    return tune_grid_metrics(spark, sf_dir).select(*TUNED, "metric", "n")


@figures
def show_best(spark, sf_dir):
    """The five best grid points by each metric, best first."""
    summary = scratch.materialize(tune_grid_metrics(spark, sf_dir), "tuned")
    best = [evaluation.show_best(summary, metric, TUNED) for metric in evaluation.METRICS]
    return best[0].unionByName(best[1]).unionByName(best[2])


@figures
def select_best(spark, sf_dir):
    """The grid point with the highest mean rsq."""
    return evaluation.show_best(tune_grid_metrics(spark, sf_dir), "rsq", TUNED, 1).select(*TUNED)


@figures
def final_fit(spark, sf_dir):
    """The selected point, fitted on the whole training part: its metrics on the holdout."""
    rows = split_rows(spark, sf_dir)
    point = modelling.best_point(tune_grid_metrics(spark, sf_dir, rows))
    found = with_spread(scored_holdout(rows, point))
    return found.select(F.lit(point.min_n).alias("min_n"), F.lit(point.mtry).alias("mtry"), F.lit(point.trees[0]).alias("trees"), "*")


def selected_model(spark, sf_dir, rows: DataFrame):
    """The selected point, fitted on the training part once per session, data directory and point."""
    point = modelling.best_point(tune_grid_metrics(spark, sf_dir, rows))
    path, fresh = scratch.shared_dir(spark, "selected", sf_dir, point)
    if fresh:
        modelling.save(modelling.fit(rows.where("is_train"), modelling.boosted_trees(point)), path)
    return modelling.load(path)


@figures
def predict_batch_shares(spark, sf_dir):
    """The whole path with the selected model in place of the stand-in: the published table."""
    model = selected_model(spark, sf_dir, split_rows(spark, sf_dir))
    scored = modelling.predict(model, predicted(spark, sf_dir, None).drop("prediction"))
    return report.final_predictions(scored, SEASONS)


@query
def predict_batch(spark, sf_dir):
    """Check of ``predict_batch_shares``: is each published share a share, and do they make a whole?"""
    parts = [F.coalesce(F.col(f"PITCH_TYPE_{g}"), F.lit(0.0)) for g in GROUPS]
    whole = F.abs(sum(parts) - 1) < 1e-9
    for part in parts:
        whole = whole & part.between(0.0, 1.0)
    return predict_batch_shares(spark, sf_dir).select("BATTER_ID", "PLAYER_NAME", "GAME_YEAR", whole.cast("int").alias("whole"))


@figures
def bind_columns_predictions(spark, sf_dir):
    """Predictions of the selected model beside the holdout rows they belong to."""
    rows = split_rows(spark, sf_dir)
    scored = modelling.predict(selected_model(spark, sf_dir, rows), holdout(rows))
    return scored.select(*CELL, "num_pitches", "prediction")


@query
def bind_columns(spark, sf_dir):
    """Check of ``bind_columns_predictions``: has each holdout row its prediction?"""
    known = F.col("prediction").isNotNull().cast("int")
    return bind_columns_predictions(spark, sf_dir).select(*CELL, "num_pitches", known.alias("predicted"))


@query
def model_persist(spark, sf_dir):
    """Store the fitted pipeline, load it and apply both: do they agree?"""
    rows = split_rows(spark, sf_dir)
    path = scratch.scratch_dir(spark, "model")
    model = fitted(rows.where("is_train"))
    modelling.save(model, path)
    both = modelling.load(path).transform(
        modelling.predict(model, holdout(rows)).withColumnRenamed("prediction", "original")
    )
    return both.select(*CELL, F.col("prediction").eqNullSafe(F.col("original")).cast("int").alias("same"))
