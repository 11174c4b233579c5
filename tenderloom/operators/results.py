"""What is made of matches: lists, dashboards, digests, schedules, evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import half_up
from .matching import newest, status_filter


def match_list(matches: DataFrame, tenders: DataFrame, status: str, now: Column, min_score: int = 0, since: Column | None = None, until: Column | None = None) -> DataFrame:
    """Matches with their tenders. Order: score; archived ones by deadline first."""
    rows = matches.where(F.col("fit_score") >= min_score)
    if since is not None:
        rows = rows.where(F.col("created_at") >= since)
    if until is not None:
        rows = rows.where(F.col("created_at") <= until)
    rows = rows.join(tenders.where(status_filter(F.col("deadline_at"), status, now)), "tender_id")
    first = [F.desc("deadline_at")] if status == "archived" else []
    return rows.orderBy(*first, F.desc("fit_score"), "tenant_id", "tender_id")


def dashboard_stats(matches: DataFrame, tenders: DataFrame, schedules: DataFrame, now: Column, default_min: int = 30) -> DataFrame:
    """Per tenant: matches of today, mean score, high chances, archived ones; scores below the schedule's minimum do not count."""
    least = F.coalesce("min_fit_score", F.lit(default_min))
    rows = matches.join(schedules.select("tenant_id", "min_fit_score"), "tenant_id", "left").where(F.col("fit_score") >= least).join(tenders.select("tender_id", "deadline_at"), "tender_id")
    active = status_filter(F.col("deadline_at"), "active", now)
    return rows.groupBy("tenant_id").agg(
        F.count_if(active & (F.to_date("created_at") == F.to_date(now))).alias("today"),
        half_up(F.avg(F.when(active, F.col("fit_score")))).cast("long").alias("avg_fit"),
        F.count_if(active & (F.col("win_probability") == "high")).alias("high"),
        F.count_if(~active).alias("archived"),
    )


def score_distribution(matches: DataFrame, by: list[str]) -> DataFrame:
    return matches.groupBy(*by).agg(F.min("fit_score").alias("min_fit"), F.max("fit_score").alias("max_fit"), F.avg("fit_score").alias("avg_fit"), F.count("*").alias("n"))


def digest_matches(matches: DataFrame, tenders: DataFrame, schedules: DataFrame, now: Column, default_min: int = 60, top: int = 50) -> DataFrame:
    """(tenant_id, pos, ...): each tenant's best new open matches: since the last sending (else seven days), of its least score."""
    due = schedules.select("tenant_id", F.coalesce("min_fit_score", F.lit(default_min)).alias("least"), F.coalesce("last_sent_at", now - F.expr("interval 7 days")).alias("since"))
    rows = matches.where(F.col("fit_score").isNotNull()).join(due, "tenant_id").where("fit_score >= least and created_at >= since")
    rows = rows.join(tenders.where(status_filter(F.col("deadline_at"), "active", now)), "tender_id")
    order = Window.partitionBy("tenant_id").orderBy(F.desc("fit_score"), F.desc("created_at"), "tender_id")
    return rows.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= top)


#: What a digest says of a match, beside its place, tender, score and chance, where the rows have it.
_SHOWN = ("match_id", "title", "url", "buyer", "deadline_at", "rationale", "human_resources_estimate", "collaboration_suggestion")


def digest_payload(rows: DataFrame, names: DataFrame, now: Column | None = None) -> DataFrame:
    """(tenant_id, company_name, n, subject, matches, ...) of tenants with matches; matches in order, three reasons each at most.

    ``min_fit_score`` is the least score that counted, ``generated_at`` is ``now``; further columns of ``names``
    (recipients) stay.
    """
    shown = [F.slice(c, 1, 3).alias(c) if c == "rationale" else F.col(c) for c in _SHOWN if c in rows.columns]
    item = F.struct("pos", "tender_id", "fit_score", "win_probability", *shown)
    least = F.max("least") if "least" in rows.columns else F.lit(None).cast("int")
    out = rows.groupBy("tenant_id").agg(F.array_sort(F.collect_list(item), lambda a, b: a["pos"] - b["pos"]).alias("matches"), least.alias("min_fit_score")).join(names, "tenant_id")
    n = F.size("matches")
    subject = F.concat(n.cast("string"), F.lit(" new match"), F.when(n == 1, "").otherwise("es"), F.lit(" for "), F.col("company_name"))
    rest = [c for c in names.columns if c not in ("tenant_id", "company_name")]
    return out.select("tenant_id", "company_name", n.cast("long").alias("n"), subject.alias("subject"), "matches", "min_fit_score", (F.lit(None).cast("timestamp") if now is None else now).alias("generated_at"), *rest)


def due_digests(matches: DataFrame, tenders: DataFrame, schedules: DataFrame, zones: DataFrame, names: DataFrame, now: Column) -> DataFrame:
    """The payloads of all schedules that are due at ``now``."""
    return digest_payload(digest_matches(matches, tenders, is_due(schedules, zones, now), now), names, now)


def match_detail(matches: DataFrame, tenders: DataFrame, feedback: DataFrame, tenant_id: int | str, match_id: int | str) -> DataFrame:
    """One of a tenant's matches with its tender (a struct without vectors and search texts) and its newest feedback, if any."""
    one = matches.where((F.col("match_id") == match_id) & (F.col("tenant_id") == tenant_id))
    tender = F.struct(*[c for c in tenders.columns if not c.startswith("embedding") and c != "search"]).alias("tender")
    said = newest(feedback.where(F.col("match_id") == match_id), ["match_id"], [F.desc("created_at")], 1)
    said = said.select("match_id", F.struct(*[c for c in said.columns if c != "match_id"]).alias("feedback"))
    return one.join(tenders.select("tender_id", tender), "tender_id", "left").join(said, "match_id", "left")


def digest_deliveries(payloads: DataFrame, default: str | None) -> DataFrame:
    """One row per recipient; without recipients the default one, if there is any."""
    fallback = F.array(F.lit(default)) if default else F.array().cast("array<string>")
    to = F.when(F.size("recipients") > 0, F.col("recipients")).otherwise(fallback)
    return payloads.withColumn("recipient", F.explode(to)).drop("recipients")


def after_sending(schedules: DataFrame, payloads: DataFrame, now: Column) -> DataFrame:
    """Schedules with last_sent_at = now for the tenants that got a payload."""
    sent = payloads.select("tenant_id", F.lit(True).alias("_sent")).distinct()
    return schedules.join(sent, "tenant_id", "left").withColumn("last_sent_at", F.when(F.col("_sent"), now).otherwise(F.col("last_sent_at"))).drop("_sent")


#: Least time since the last sending, in minutes; every_n_days is reckoned from its days.
_WAIT = {"daily": 22 * 60, "weekdays": 22 * 60, "weekly": 6 * 1440, "monthly": 27 * 1440}


def is_due(schedules: DataFrame, zones: DataFrame, now: Column) -> DataFrame:
    """The schedules that are due at ``now``. zones: (timezone), the valid ones; unknown zones are never due, an empty one is UTC."""
    s = schedules.where("enabled").withColumn("_tz", F.coalesce(F.nullif("timezone", F.lit("")), F.lit("UTC")))
    # a zone's name is only read from the table of valid ones; joined by hash, so that no optimizer rule can put the
    # schedule's own name, which may be invalid and would raise, in its place
    valid = F.broadcast(zones.select(F.col("timezone").alias("_zone")).distinct())
    s = s.join(valid, F.xxhash64("_tz") == F.xxhash64("_zone")).drop("_tz").withColumnRenamed("_zone", "_tz")
    local, last = F.from_utc_timestamp(now, F.col("_tz")), F.from_utc_timestamp("last_sent_at", F.col("_tz"))
    kind, day = F.col("frequency"), F.dayofweek(local) - 1
    wait = F.lit(None).cast("int")
    for name, minutes in _WAIT.items():
        wait = F.when(kind == name, minutes).otherwise(wait)
    wait = F.when(kind == "every_n_days", F.greatest(F.lit(1), F.col("interval_days")) * 1440 - 30).otherwise(wait)
    rested = F.col("last_sent_at").isNull() | ((F.unix_timestamp(now) - F.unix_timestamp("last_sent_at") >= wait * 60) & (~kind.isin("daily", "weekdays") | (F.to_date(last) != F.to_date(local))))
    calendar = F.when(kind == "weekdays", day.between(1, 5)).when(kind == "weekly", F.col("day_of_week") == day).when(kind == "monthly", F.least("day_of_month", F.day(F.last_day(local))) == F.day(local)).otherwise(kind.isin("daily", "every_n_days"))
    # a missing day of the month is not due, though least() would skip it
    calendar = calendar & ((kind != "monthly") | F.col("day_of_month").isNotNull())
    return s.where(F.hour(local).between(F.col("hour_local"), F.col("hour_local_end")) & F.coalesce(calendar, F.lit(False)) & rested).drop("_tz")


def labeled_matches(matches: DataFrame, feedback: DataFrame, tenders: DataFrame, since: Column | None = None) -> DataFrame:
    """(predicted, label, group, model_version, created_at): matches with feedback, by the tender's source."""
    rows = matches if since is None else matches.where(F.col("created_at") >= since)
    rows = rows.join(newest(feedback, ["match_id"], [F.desc("created_at")], 1).select("match_id", "interested"), "match_id").join(tenders.select("tender_id", "source"), "tender_id", "left")
    return rows.select(F.col("fit_score").alias("predicted"), F.col("interested").alias("label"), F.coalesce("source", F.lit("(unknown)")).alias("group"), "model_version", "created_at")


def run_model(labeled: DataFrame) -> DataFrame:
    """The model version of an evaluation: that of its earliest labeled match; ``(unknown)`` without any."""
    return labeled.agg(F.coalesce(F.min_by("model_version", F.struct("created_at", "model_version")), F.lit("(unknown)")).alias("model_version"))


def confusion(samples: DataFrame, thresholds: tuple[int, ...] = (40, 60, 75)) -> DataFrame:
    """(threshold, group, tp, fp, fn, tn, total); group null: overall. A null group is ``(ungrouped)``.

    Samples are counted by (group, predicted, label) first; only those few rows meet the thresholds.
    """
    spark = samples.sparkSession
    counted = samples.groupBy(F.coalesce("group", F.lit("(ungrouped)")).alias("group"), "predicted", "label").agg(F.count("*").alias("n"))
    each = counted.withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in thresholds]))).withColumn("yes", F.col("predicted") >= F.col("threshold"))
    cell = lambda y, l: F.sum(F.when((F.col("yes") == y) & (F.col("label") == l), F.col("n")).otherwise(0))
    cells = {"tp": (True, True), "fp": (True, False), "fn": (False, True), "tn": (False, False)}
    sums = [cell(*v).alias(k) for k, v in cells.items()] + [F.sum("n").alias("total")]
    found = each.groupingSets([["threshold"], ["threshold", "group"]], "threshold", "group").agg(*sums)
    wanted = spark.range(1).select(F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("threshold"))
    none = wanted.join(found.where("group is null").select("threshold"), "threshold", "left_anti")
    zeros = none.select("threshold", F.lit(None).cast("string").alias("group"), *[F.lit(0).cast("long").alias(c) for c in (*cells, "total")])
    return found.unionByName(zeros)


def eval_metrics(counts: DataFrame) -> DataFrame:
    """``counts`` of confusion() with agreement, precision, recall, f1 and positive_rate; zero denominators give 0."""
    over = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    p, r = over(tp, tp + fp), over(tp, tp + fn)
    return counts.withColumns({"agreement": over(tp + tn, F.col("total")), "precision": p, "recall": r, "f1": over(2 * p * r, p + r), "positive_rate": over(tp + fn, F.col("total"))})
