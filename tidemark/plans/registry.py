"""The registered queries of the evaluation engine, over the test tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import availability, bootstrap, diagnostics, evidence, features, metrics, ordered, provenance, review, rolling, scan
from ..schemas import LABEL
from ..session import shared_path, written
from ..sources import panels, published, synthetic
from ..streaming import labels as streams
from ..validate import alignment_violations, duplicate_keys, label_violations, missing_from, outside, panel_violations

AS_OF = 15
LEDGER_ORIGIN, LEDGER_HORIZON, LEDGER_DELAY, LEDGER_WINDOW = 120, 5, 3, 80
#: The synthetic workload's, of 240 days; on a table the last origin is the last one with a whole target.
CONFIG = rolling.RollingConfig(horizon=5, delay=3, window=80, alpha=5.0, start=80, end=219)
FOLDS, BLOCKS, PAIRED_BLOCK, REPETITIONS, SEED = [41, 40], [4, 10], 20, 500, 42
#: Cells of brand_month made of fewer line items than this count as missing in the sentinel query.
FEW_ITEMS = 20

#: Digits at which means of 5 or 20 weekly values, sums of cents in millions, are exact: no ties to round.
EXACT = 10


def _rounded(df: DataFrame, digits: int = 6, exact: tuple[str, ...] = ()) -> DataFrame:
    """Doubles rounded, so that the order of a sum doesn't show, the ``exact`` ones at ``EXACT`` digits; negative zero becomes zero."""
    return df.select(*(F.round(F.col(c) + 0.0, EXACT if c in exact else digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.trailing_forecast(panels.brand_month(spark, sf_dir))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly brand revenue: the rank correlation, by date, of a trailing mean of released months."""
    return _rounded(metrics.daily_rank_correlation(_cells(spark, sf_dir)))


def label_valid_rows(spark, sf_dir):
    labels = panels.event_labels(spark, sf_dir)
    bad = label_violations(labels).select("instrument", "observed_day")
    return _rounded(labels.join(bad, ["instrument", "observed_day"], "left_anti"))


def _dirty_labels(spark, sf_dir):
    """Labels of which those at every seventh day are broken in turn."""
    d = F.col("observed_day")
    return panels.event_labels(spark, sf_dir).select(
        F.when(d % 7 == 1, " ").otherwise(F.col("instrument")).alias("instrument"),
        F.when(d % 7 == 2, F.lit(0)).otherwise(d).cast("long").alias("observed_day"),
        F.when(d % 7 == 3, d).otherwise(F.col("released_day")).alias("released_day"),
        F.when(d % 7 == 4, F.lit(None)).otherwise(F.col("value")).cast("double").alias("value"),
    )


def label_violation_rows(spark, sf_dir):
    return _rounded(label_violations(_dirty_labels(spark, sf_dir)))


def label_duplicate_keys(spark, sf_dir):
    return duplicate_keys(panels.event_rows(spark, sf_dir), ["instrument", "observed_day"])


def snapshot_available(spark, sf_dir):
    return _rounded(availability.available(panels.event_labels(spark, sf_dir), AS_OF))


def snapshot_counts_mean(spark, sf_dir):
    return _rounded(availability.counts(panels.event_labels(spark, sf_dir), AS_OF))


def snapshots_all_days(spark, sf_dir):
    return _rounded(availability.snapshots(panels.event_labels(spark, sf_dir), 1, 36))


def guarded_read(spark, sf_dir):
    return _rounded(availability.guarded(panels.event_labels(spark, sf_dir), "click_1", 3, 30))


def available_keys(spark, sf_dir):
    return availability.available_keys(panels.event_labels(spark, sf_dir), AS_OF)


def guarded_targets(spark, sf_dir):
    """Every released target of each series, read on the day of its release."""
    obs, config = _weeks(spark, sf_dir)
    targets = features.with_targets(obs, config.horizon)
    wanted = targets.where(F.col("t") % 3 == 0).select("series_id", F.col("t").alias("origin"), (F.col("t") + config.horizon + config.delay).alias("as_of"))
    return _rounded(availability.guarded_targets(targets, wanted, config.horizon, config.delay), EXACT)


def _ledger(spark, sf_dir):
    targets = features.with_targets(panels.segment_week(spark, sf_dir), LEDGER_HORIZON)
    return availability.ledger(targets, LEDGER_ORIGIN, LEDGER_HORIZON, LEDGER_DELAY, LEDGER_WINDOW)


def eligibility_ledger(spark, sf_dir):
    return _rounded(_ledger(spark, sf_dir), EXACT)


def boundary_topk(spark, sf_dir):
    return _rounded(availability.boundary(_ledger(spark, sf_dir)).select("series_id", "origin", "eligible", "label", F.col("place").cast("long").alias("place")), EXACT)


def eligible_ratio(spark, sf_dir):
    return _rounded(availability.eligible_share(_ledger(spark, sf_dir)))


def _sentinel_cells(spark, sf_dir):
    cells = _cells(spark, sf_dir)
    return cells.withColumn("truth", F.when(F.col("n_items") < FEW_ITEMS, scalars.SENTINEL).otherwise(F.col("truth")))


def sentinel_nullif(spark, sf_dir):
    rows = _sentinel_cells(spark, sf_dir).withColumn("observed", scalars.sentinel_to_null(F.col("truth")))
    return rows.groupBy("date_id").agg(F.count("*").alias("n_cells"), F.count("observed").alias("n_observed"))


def sentinel_rank_corr(spark, sf_dir):
    return _rounded(metrics.daily_rank_correlation(_sentinel_cells(spark, sf_dir)))


def sentinel_errors(spark, sf_dir):
    """Errors see the sentinel as a number."""
    cells = _sentinel_cells(spark, sf_dir).withColumn("e", F.col("prediction") - F.col("truth"))
    return _rounded(cells.agg(F.avg(F.abs("e")).alias("mae"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse")), 2)


def alignment_check(spark, sf_dir):
    cells = panels.brand_month(spark, sf_dir)
    held_back = cells.where(F.col("date_id") + F.col("target_pos") != 30)
    return alignment_violations(cells.select("date_id", "target", "target_pos", "value"), held_back.select("date_id", "target", "target_pos", "value"))


def average_rank(spark, sf_dir):
    """Ranks with ties: brands by month and item count."""
    rows = panels.brand_month(spark, sf_dir).select("date_id", "target", "n_items")
    return rows.withColumn("avg_rank", scalars.average_rank(F.col("n_items"), ["date_id"]))


#: Steps of a long series that a task takes at once in the queries; a series of a small table is then several blocks, too.
STEPS = 5_000
ITEM = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def _one_date(spark, sf_dir):
    """All line items as the cells of one date."""
    return panels.table(spark, sf_dir, "lineitem").select(*ITEM, F.lit(0).cast("long").alias("date_id"), "l_returnflag", "l_quantity", "l_extendedprice")


def long_date_ranks(spark, sf_dir):
    """Ranks within one date that holds every line item; quantities tie by thousands."""
    ranked = ordered.doubled_ranks(ordered.doubled_ranks(_one_date(spark, sf_dir), ["date_id"], "l_quantity", "q"), ["date_id"], "l_extendedprice", "p")
    return ranked.select(*ITEM, (F.col("q") / 2).alias("quantity_rank"), (F.col("p") / 2).alias("price_rank"))


def long_date_corr(spark, sf_dir):
    """Rank correlations of quantity and price over three dates of all line items of a return flag."""
    return _rounded(ordered.rank_correlations(_one_date(spark, sf_dir), ["l_returnflag"], "l_quantity", "l_extendedprice"), 9)


def long_series_labels(spark, sf_dir):
    """Features and targets of one series with a step for each line item."""
    items = ordered.positions(panels.table(spark, sf_dir, "lineitem").select(*ITEM, "l_quantity"), [], ITEM, "t")
    obs = items.select(F.lit("all").alias("series_id"), F.lit(0).alias("series_pos"), F.col("t").cast("long").alias("t"), F.col("l_quantity").alias("value"))
    return _rounded(features.long_label_rows(obs, CONFIG.horizon, CONFIG.delay, STEPS, at="t").drop("f5", "f6", "f7", "f8", "f9"), EXACT)


def latest_labels(spark, sf_dir):
    """For every event the label of its instrument that was released last by then."""
    rows = panels.event_rows(spark, sf_dir, ["event_id"]).select("event_id", F.col("instrument"), F.col("observed_day").alias("as_of"))
    found = ordered.latest(panels.event_labels(spark, sf_dir), rows, ["instrument"], "released_day", "as_of", ["observed_day"], ["observed_day", "released_day", "value"])
    return _rounded(found)


def corr_ratio_score(spark, sf_dir):
    return _rounded(metrics.correlation_ratio(metrics.daily_rank_correlation(_cells(spark, sf_dir))))


def evaluate_summary(spark, sf_dir):
    found = metrics.evaluate(_cells(spark, sf_dir))
    return _rounded(
        found.select("score", "mean_correlation", "correlation_deviation", "positive_fraction", "dates", F.get("date_ids", F.lit(0)).alias("first_date"), F.element_at("date_ids", -1).alias("last_date"), F.get("daily_correlations", F.lit(0)).alias("first_rho"), F.round("mae", 2).alias("mae"), F.round("rmse", 2).alias("rmse"))
    )


def checked_evaluation(spark, sf_dir):
    """Truth and forecast as two tables, matched and checked before they are scored; a row for each horizon beside the score."""
    cells = _cells(spark, sf_dir)
    side = lambda c: cells.select("date_id", "target", "target_pos", F.col(c).alias("value"))
    found = metrics.evaluated(side("truth"), side("prediction"), panels.horizons(spark, sf_dir))
    return _rounded(found.select("score", "positive_fraction", "dates", F.posexplode("horizons").alias("place", "h")).select("score", "positive_fraction", "dates", "place", "h.lag", F.col("h.score").alias("lag_score"), F.col("h.mean_correlation").alias("lag_mean"), F.col("h.eligible_dates").alias("eligible_dates")))


def horizon_metrics(spark, sf_dir):
    cells = _cells(spark, sf_dir).where(F.col("date_id") + F.col("target_pos") > 8)
    return _rounded(metrics.horizon_metrics(cells.drop("lag"), panels.horizons(spark, sf_dir)))


def trailing_features(spark, sf_dir):
    return _rounded(features.with_features(panels.segment_week(spark, sf_dir)), EXACT)


def forward_target(spark, sf_dir):
    found = features.with_targets(panels.segment_week(spark, sf_dir), CONFIG.horizon)
    return _rounded(found.withColumn("released_day", F.col("t") + CONFIG.horizon + CONFIG.delay), EXACT)


def _weeks(spark, sf_dir) -> tuple[DataFrame, rolling.RollingConfig]:
    """Weekly values, and origins up to the last week whose target the table holds."""
    obs = panels.segment_week(spark, sf_dir)
    return obs, replace(CONFIG, end=obs.agg(F.max("t")).first()[0] + 1 - CONFIG.horizon)


def _labelled(spark, sf_dir) -> tuple[DataFrame, rolling.RollingConfig]:
    """The label rows behind all fits of the weekly values."""
    obs, config = _weeks(spark, sf_dir)
    return rolling.labels_of(obs, config), config


def training_rows_range_join(spark, sf_dir):
    return _rounded(rolling.training_rows(*_weeks(spark, sf_dir)).groupBy("origin", "series_id").agg(F.count("*").alias("n_rows"), F.sum("t").alias("sum_t"), F.avg("y").alias("mean_y")))


def fit_feature_stats(spark, sf_dir):
    """Every fit's feature means, scales and coefficients."""
    found = rolling.fits(*_labelled(spark, sf_dir))
    each = found.select("origin", "intercept", F.posexplode(F.arrays_zip("feature_mean", "feature_scale", "coefficients")).alias("feature", "v"))
    return _rounded(each.select("origin", "intercept", "feature", F.col("v.feature_mean").alias("mean"), F.col("v.feature_scale").alias("scale"), F.col("v.coefficients").alias("coefficient")))


def fit_gram_moments(spark, sf_dir):
    return _rounded(rolling.normal_equations(*_labelled(spark, sf_dir)))


def fit_receipts(spark, sf_dir):
    return rolling.receipts(*_labelled(spark, sf_dir)).withColumn("released_in_time", F.col("max_release") <= F.col("origin"))


def baseline_mean_forecast(spark, sf_dir):
    return _rounded(rolling.baseline_means(*_labelled(spark, sf_dir)).select("origin", "series_id", F.col("mean").alias("mean_forecast")))


def ridge_single_feature(spark, sf_dir):
    rows, config = _labelled(spark, sf_dir)
    return _rounded(rolling.single_feature_ridge(rows, "f2", config))


def _forecasts(spark, sf_dir):
    """All forecasts as a table: scores and slices read it more than once."""
    return written(rolling.forecasts(*_weeks(spark, sf_dir)), "forecasts")


def ridge_forecast(spark, sf_dir):
    return _rounded(_forecasts(spark, sf_dir), exact=("actual",))


def model_scores(spark, sf_dir):
    return _rounded(rolling.scores(rolling.by_model(_forecasts(spark, sf_dir)), ["model"]))


def error_slices(spark, sf_dir):
    return _rounded(diagnostics.slices(rolling.by_model(_forecasts(spark, sf_dir))))


def slice_reconciliation(spark, sf_dir):
    return _rounded(diagnostics.reconciliation(diagnostics.slices(rolling.by_model(_forecasts(spark, sf_dir)))))


VARIANTS = {"year": 12, "half": 6, "recent": 3}


def _variants(spark, sf_dir):
    """Daily correlations of three forecasts of different windows, on the dates that all of them have, as a table."""
    base, months = panels.brand_month(spark, sf_dir), Window.partitionBy("target").orderBy("date_id")
    means = base.select("date_id", "target", F.col("value").alias("truth"), *(F.avg("value").over(months.rangeBetween(-n, -2)).alias(v) for v, n in VARIANTS.items()))
    cells = means.unpivot(["date_id", "target", "truth"], list(VARIANTS), "variant", "prediction").where("prediction is not null")
    daily = metrics.daily_rank_correlation(cells, ["variant"]).where(F.col("date_id") > 2)
    return written(bootstrap.positioned(daily), "variants")


def _starts(spark, blocks):
    return bootstrap.fold_starts(spark, FOLDS, blocks, REPETITIONS, SEED)


def bootstrap_indices(spark, sf_dir):
    return bootstrap.positions(_starts(spark, BLOCKS))


def bootstrap_draws(spark, sf_dir):
    return _rounded(bootstrap.draws(_variants(spark, sf_dir), bootstrap.positions(_starts(spark, BLOCKS))))


def paired_interval(spark, sf_dir):
    starts = bootstrap.single_starts(spark, sum(FOLDS), PAIRED_BLOCK, REPETITIONS, SEED)
    return _rounded(bootstrap.paired_interval(_variants(spark, sf_dir), starts, "year", "recent"))


def compare_variants(spark, sf_dir):
    return _rounded(bootstrap.compare(_variants(spark, sf_dir), _starts(spark, BLOCKS), [("year", "half"), ("year", "recent")]))


def synthetic_panel(spark, sf_dir):
    return _rounded(synthetic.observations(spark, scenario="shift"), 9)


def synthetic_panel_document(spark, sf_dir):
    doc = synthetic.panel(spark)
    return doc.join(panel_violations(doc).select("seed"), "seed", "left_anti").select("schema", "scope", "seed", "scenario", "days", F.to_json("series").alias("series_json"))


def release_check_count(spark, sf_dir):
    """How many fits trained only on labels released by their origin."""
    receipts = rolling.receipts(*_labelled(spark, sf_dir))
    return receipts.agg(F.count_if(F.col("max_release") <= F.col("origin")).alias("in_time"), F.count("*").alias("fits"))


def origin_lookup(spark, sf_dir):
    """The receipt of the origin nearest to a request outside the evaluated range."""
    rows, config = _labelled(spark, sf_dir)
    wanted = spark.range(1).select(scalars.clamp(F.lit(1000.4), config.start, config.end).alias("wanted"))
    return rolling.receipts(rows, config).join(F.broadcast(wanted), F.col("origin") == F.col("wanted")).drop("wanted")


def series_extent(spark, sf_dir):
    """Axis bounds: extremes of value and day by series."""
    obs = panels.segment_week(spark, sf_dir)
    return _rounded(obs.groupBy("series_id").agg(F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.min("value").alias("low"), F.max("value").alias("high")), EXACT)


def fold_offsets(spark, sf_dir):
    starts = _starts(spark, BLOCKS)
    return starts.groupBy("block", "fold", "length", "fold_offset").agg(F.count("*").alias("n_blocks"))


def manifest_diff(spark, sf_dir):
    """Digests of parts against those of a copy with a changed, a missing and an extra one."""
    parts = panels.table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("path"), "p_name")
    key = F.col("path").cast("long")
    copy = parts.where(key != 7).select("path", F.when(key == 5, "other").otherwise(F.col("p_name")).alias("p_name")).unionByName(spark.createDataFrame([("-1", "new")], "path string, p_name string"))
    return provenance.manifest_differences(provenance.row_fingerprint(parts, ["p_name"]), provenance.row_fingerprint(copy, ["p_name"]))


def markup_totals(spark, sf_dir):
    pages = panels.table(spark, sf_dir, "pages")
    return pages.agg(F.count("*").alias("n_files"), F.sum(F.octet_length("html")).cast("long").alias("total_bytes"), F.count_distinct("page_id").alias("n_distinct"))


def export_lines(spark, sf_dir):
    """The synthetic result as JSON lines, parsed again."""
    obs = synthetic.observations(spark)
    lines = provenance.export_lines(obs, rolling.forecasts(obs, CONFIG), {"horizon": CONFIG.horizon, "delay": CONFIG.delay}, {"model": "ridge", "forecast_origin": 120})
    kinds = "scope string, config struct<horizon double, delay double>, review struct<model string, forecast_origin double>, value double, actual double, ridge double, mean double, target_end double, released_day double"
    read = lines.select("part", "series_id", "place", F.from_json("line", kinds).alias("x"))
    return _rounded(read.select("part", "series_id", "place", "x.scope", "x.config.horizon", "x.config.delay", "x.review.model", "x.review.forecast_origin", "x.value", "x.actual", "x.ridge", "x.mean", "x.target_end", "x.released_day"))


def forecast_export(spark, sf_dir):
    """All forecasts of the weekly values as the lines of one document, written and read again by place."""
    path = shared_path(spark, "export")
    provenance.placed_lines(_forecasts(spark, sf_dir), ["origin", "series_id"]).write.parquet(path)
    kinds = "series_id string, origin int, actual double, ridge double, mean double, zero double, target_end int, released_day int"
    return _rounded(spark.read.parquet(path).select("place", F.from_json("line", kinds).alias("x")).select("place", "x.*"), exact=("actual",))


#: The day from which the second run of the prefix comparison sees other values.
CHANGED_FROM = 200


def prefix_compare(spark, sf_dir):
    """Two runs of all forecasts, of which the second has other values from a day on: which forecasts differ before and after it."""
    obs, config = _weeks(spark, sf_dir)
    once = written(rolling.forecasts(obs, config), "forecasts")
    later = obs.withColumn("value", F.col("value") + F.when(F.col("t") >= CHANGED_FROM, 5.0).otherwise(0.0))
    again = written(rolling.forecasts(later, config), "forecasts")
    fields = ["actual", "ridge", "mean"]
    found = provenance.tree_differences(once, again, ["series_id", "origin"], fields, leaves=256)
    period = F.when(F.col("origin") <= CHANGED_FROM, "before").otherwise("after").alias("period")
    differing = found.groupBy(period).agg(*(F.count_if(F.col("field") == f).alias(f"{f}_differs") for f in fields))
    compared = once.groupBy(period).agg(F.count("*").alias("compared"))
    return compared.join(differing, "period", "left").fillna(0)


def published_months(spark, sf_dir):
    """A file for each month of orders, published at once and read back."""
    path = shared_path(spark, "published")
    month = F.date_format("o_orderdate", "yyyy/MM")
    rows = panels.table(spark, sf_dir, "orders").groupBy(F.concat(month, F.lit(".txt")).alias("name")).agg(F.count("*").alias("n"), F.sum("o_custkey").alias("keys"))
    published.publish_files(rows.select("name", F.encode(F.concat_ws(" ", "n", "keys"), "UTF-8").alias("content")), path)
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.regexp_extract("path", r"([0-9]+/[0-9]+\.txt)$", 1)
    return provenance.file_digests(read.withColumn("path", name))


def order_elements(spark, sf_dir):
    """Orders as XML documents, of which some lack their end: elements, items inside the item list, depth, and what can't be read."""
    items = panels.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("items"))
    item = F.transform("items", lambda i: F.concat(F.lit("<i:item xmlns:i='urn:item' n='"), i["l_linenumber"].cast("string"), F.lit("'><part>"), i["l_partkey"].cast("string"), F.lit("</part></i:item>")))
    document = F.concat(F.lit("<order><!-- <item/> <script/> --><items>"), F.array_join(item, ""), F.lit("</items><end/>"), F.when(F.col("l_orderkey") % 50 == 3, "").otherwise("</order>"))
    found = written(scan.elements(items.select(F.col("l_orderkey").alias("key"), document.alias("document")), "key", "document"), "elements")
    inside = scan.within(found.where("name = 'item' and namespace = 'urn:item'"), found.where("name = 'items'"), "key").groupBy("key").agg(F.count("*").alias("n_inside"))
    counted = found.groupBy("key").agg(F.count("pre").alias("n_elements"), F.max("depth").alias("depth"), F.count("error").alias("n_errors"))
    return counted.join(inside, "key", "left").fillna(0, ["n_inside"])


def outcome_histogram(spark, sf_dir):
    return evidence.outcome_histogram(panels.table(spark, sf_dir, "orders"), "o_orderstatus")


def membership_check(spark, sf_dir):
    """Priorities outside an allowed set, and required ones that no order has."""
    orders = panels.table(spark, sf_dir, "orders").select("o_orderpriority")
    allowed = spark.createDataFrame([(x,) for x in ("1-URGENT", "2-HIGH", "3-MEDIUM")], "name string")
    required = spark.createDataFrame([(x,) for x in ("1-URGENT", "9-NEVER")], "name string")
    strange = outside(orders, "o_orderpriority", allowed, "name").groupBy(F.col("o_orderpriority").alias("name")).agg(F.count("*").alias("n"))
    absent = missing_from(required, "name", orders, "o_orderpriority").select("name", F.lit(0).cast("long").alias("n"))
    return strange.withColumn("reason", F.lit("not allowed")).unionByName(absent.withColumn("reason", F.lit("required")))


def evidence_checks(spark, sf_dir):
    """A comparison's recorded difference against the two scores it is of, and its bounds."""
    daily = _variants(spark, sf_dir)
    rows = bootstrap.compare(daily, _starts(spark, BLOCKS), [("year", "half"), ("year", "recent")])
    seen = lambda of, name: bootstrap.observed(daily).select(F.col("variant").alias(of), F.col("observed").alias(name))
    rows = rows.join(seen("variant", "candidate"), "variant").join(seen("reference", "control"), "reference")
    rows = rows.select("reference", "block_dates", "candidate", "control", "delta", F.col("conditional_low").alias("low"), F.col("conditional_high").alias("high"))
    return evidence.comparison_checks(rows, ["reference", "block_dates"])


def replay_diff(spark, sf_dir):
    """Two computations of the daily correlations, one of them changed on every tenth date and short of the last ones."""
    once = metrics.daily_rank_correlation(_cells(spark, sf_dir))
    again = once.where(F.col("date_id") <= 80).withColumn("rho", F.when(F.col("date_id") % 10 == 0, F.col("rho") + 1e-6).otherwise(F.col("rho") + 1e-13))
    return provenance.differences(once, again, ["date_id"], ["n_observed", "rho"])


def digest_tree_diff(spark, sf_dir):
    """All line items against a copy with some quantities changed beyond and within the tolerance, some rows gone and one added: only their buckets are joined."""
    items = panels.table(spark, sf_dir, "lineitem").select(*ITEM, "l_quantity", "l_extendedprice")
    key = F.col("l_orderkey")
    price = F.col("l_extendedprice")  # whole numbers have no tolerance
    copy = items.where(key != 33).withColumns({"l_quantity": F.when(key == 7, F.col("l_quantity") + 0.5).otherwise(F.col("l_quantity")), "l_extendedprice": F.when((key == 69) & (price != F.floor(price)), price + 1e-9).otherwise(price)})
    added = items.where(key == 1).withColumn("l_orderkey", -key)
    return provenance.tree_differences(items, copy.unionByName(added), ITEM, ["l_quantity", "l_extendedprice"])


def row_fingerprint(spark, sf_dir):
    parts = panels.table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    return provenance.row_fingerprint(parts, ["p_partkey", "p_name", "p_brand", "p_type", "p_size"]).select("p_partkey", "sha256")


def text_pattern_scan(spark, sf_dir):
    return scan.pattern_flags(panels.table(spark, sf_dir, "documents"), "doc_id", "text")


def html_asset_refs(spark, sf_dir):
    found = scan.reference_parts(scan.references(panels.table(spark, sf_dir, "pages"), "page_id", "html"))
    return found.groupBy("page_id", "kind", "reference", "scheme", "host", "path", "decoded_path", "fragment", "local").agg(F.count("*").alias("n"))


def html_attributes(spark, sf_dir):
    found = scan.attributes(panels.table(spark, sf_dir, "pages"), "page_id", "html")
    return found.groupBy("page_id", "tag", "attribute", "value").agg(F.count("*").alias("n"))


def quoted_urls(spark, sf_dir):
    """URLs percent-encoded and back, and inside the text of a link."""
    pages = panels.table(spark, sf_dir, "pages").where("url is not null")
    quoted = scalars.url_quote(F.col("url"))
    return pages.select("page_id", quoted.alias("quoted"), scalars.url_unquote(quoted).alias("back"), scalars.html_escape(F.concat(F.lit("<a title='"), "url", F.lit("'>"))).alias("escaped"))


def _commands(spark, sf_dir):
    """Nations as the commands of a review, their names as ids."""
    n = panels.table(spark, sf_dir, "nation")
    args = scalars.with_placeholders(F.array(F.lit("--out={folder}/{id}")), {"folder": F.lit("/out"), "id": F.col("n_name")})
    entry = F.concat(F.lit("run/"), F.col("n_regionkey").cast("string"), F.lit(".py"))
    return n.select(F.col("n_nationkey").cast("int").alias("place"), F.lower(F.replace("n_name", F.lit(" "), F.lit("-"))).alias("id"), F.lit("python").alias("runtime"), entry.alias("entry"), args.alias("args"))


def review_coverage(spark, sf_dir):
    """Receipts of all commands but one, of another one besides, and with some calls changed or failed."""
    place, ran = F.col("place"), _commands(spark, sf_dir).where("place <> 3")
    checks = ran.select(
        F.when(place == 4, 99).otherwise(place).alias("place"),
        "id",
        "entry",
        F.when(place % 7 == 6, F.array(F.lit("other"))).otherwise(F.col("args")).alias("args"),
        F.concat("id", F.lit(".log")).alias("log"),
        F.when(place % 11 == 5, "failed").otherwise("passed").alias("status"),
        F.lit(0).alias("returncode"),
    )
    return review.coverage_violations(_commands(spark, sf_dir), checks)


def review_project(spark, sf_dir):
    """The same commands, some malformed, with regions as cards, against the files of three entries."""
    place = F.col("place")
    commands = _commands(spark, sf_dir).select("place", F.when(place % 9 == 2, F.upper("id")).when(place == 8, F.lit("kenya")).otherwise(F.col("id")).alias("id"), F.when(place % 10 == 7, "perl").otherwise("python").alias("runtime"), "entry", "args")
    cards = panels.table(spark, sf_dir, "region").select(F.col("r_name").alias("audience"), F.lit("run/0.py").alias("implementation"), F.lit("run/1.py").alias("tests"), F.concat(F.lit("run/"), F.col("r_regionkey").cast("string"), F.lit(".py")).alias("evidence"))
    files = spark.createDataFrame([("run/0.py",), ("run/1.py",), ("run/2.py",)], "path string")
    return review.project_violations(commands, cards, files, ["python", "node"], ["AFRICA", "AMERICA", "ASIA"])


def synthetic_forecast(spark, sf_dir):
    """The default workload on generated series: 140 fits, 840 forecasts of three models."""
    return _rounded(rolling.evaluated(synthetic.observations(spark), CONFIG, 240))


def synthetic_scores(spark, sf_dir):
    rows = rolling.forecasts(synthetic.observations(spark), CONFIG)
    return _rounded(rolling.scores(rolling.by_model(rows), ["model"]))


def label_stream_replay(spark, sf_dir):
    """Labels replayed through a stream of micro-batches, then counted by release day."""
    base = shared_path(spark, "stream")
    panels.event_labels(spark, sf_dir).repartition(4, "released_day").write.parquet(f"{base}/labels")
    streams.replay_to_table(streams.label_stream(spark, f"{base}/labels", LABEL), f"{base}/out", f"{base}/state")
    return _rounded(spark.read.schema(LABEL).parquet(f"{base}/out").groupBy("released_day").agg(F.count("*").alias("n"), F.sum("value").alias("total")))


def released_by_stream(spark, sf_dir):
    """Labels held in a stream's state until their release, with a stop and a restart in the middle; those of every ninth day arrive after it."""
    base = shared_path(spark, "releases")
    d = F.col("observed_day")
    arrivals = panels.event_labels(spark, sf_dir).select("instrument", "observed_day", "released_day", "value", F.when(d % 9 == 0, d + 6).otherwise(d).alias("arrived_day"))
    end = spark.range(1).select(F.lit("").alias("instrument"), F.lit(None).cast("long").alias("observed_day"), F.lit(None).cast("long").alias("released_day"), F.lit(None).cast("double").alias("value"), F.lit(10_000).cast("long").alias("arrived_day"))
    rows = written(arrivals, "arrivals")
    days = rows.agg(F.percentile_approx("arrived_day", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))).first()[0] or []
    bounds = [-1, *days, 1_000_000]
    for i, (low, high) in enumerate(zip(bounds, bounds[1:], strict=False)):
        part = rows.where((F.col("arrived_day") > low) & (F.col("arrived_day") <= high))
        (part if high < 1_000_000 else part.unionByName(end)).coalesce(1).write.mode("append").parquet(f"{base}/in")
        if i in (1, len(bounds) - 2):  # the first two parts, then the others in a new query on the same checkpoint
            streams.write_stream(streams.releases(streams.label_stream(spark, f"{base}/in", rows.schema)), f"{base}/out", f"{base}/state")
    out = spark.read.parquet(f"{base}/out")
    return _rounded(out.groupBy("status", "released_day").agg(F.count("*").alias("n"), F.sum("value").alias("total")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        label_valid_rows, label_violation_rows, label_duplicate_keys, snapshot_available, snapshot_counts_mean, snapshots_all_days, guarded_read,
        eligibility_ledger, boundary_topk, eligible_ratio, sentinel_nullif, sentinel_rank_corr, sentinel_errors, alignment_check, average_rank,
        corr_ratio_score, evaluate_summary, checked_evaluation, horizon_metrics, trailing_features, forward_target, training_rows_range_join, fit_feature_stats,
        fit_gram_moments, fit_receipts, baseline_mean_forecast, ridge_single_feature, ridge_forecast, model_scores, error_slices, slice_reconciliation,
        bootstrap_indices, bootstrap_draws, paired_interval, compare_variants, synthetic_panel, synthetic_panel_document, synthetic_forecast, synthetic_scores,
        outcome_histogram, membership_check, evidence_checks, replay_diff, row_fingerprint, text_pattern_scan, html_asset_refs, html_attributes, quoted_urls, review_coverage, review_project, label_stream_replay,
        available_keys, release_check_count, origin_lookup, series_extent, fold_offsets, manifest_diff, markup_totals, export_lines, guarded_targets,
        long_date_ranks, long_date_corr, long_series_labels, latest_labels, digest_tree_diff, released_by_stream,
        forecast_export, prefix_compare, published_months, order_elements,
    ]
    return {"daily_rank_corr": flagship} | {f.__name__: f for f in found}
