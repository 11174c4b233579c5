"""Keeping tables: upsert, embeddings, validation, purge, tenants, ingest summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import schemas as C


def last_write_wins(batch: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key in the batch, every row with how often its key came."""
    return batch.groupBy(*key).agg(F.max_by(F.struct(*[c for c in batch.columns if c not in key]), F.struct(*order)).alias("_last"), F.count("*").alias("_times")).select(*key, "_last.*", "_times")


def upsert(current: DataFrame, batch: DataFrame, key: list[str], content: list[str], order: list[str], run_ts: Column) -> DataFrame:
    """``current`` after the batch: new keys come in as pending with ingested_at = run_ts; known ones take the batch's
    content and keep the rest. Adds ``change``: inserted, updated or kept.

    The batch is brought to one row a key by partial aggregation, so a key that fills the batch is no hot spot.
    """
    last = last_write_wins(batch.select(*key, *content, *[c for c in order if c not in content]), key, order).select(*key, F.struct(*content).alias("_new"))
    kept = [c for c in current.columns if c not in (*key, *content)]
    both = current.select(*key, *kept, F.struct(*content).alias("_old")).join(last, key, "full_outer")
    taken = both.withColumn("_c", F.coalesce("_new", "_old"))
    change = F.when(F.col("_old").isNull(), "inserted").when(F.col("_new").isNull(), "kept").otherwise("updated")
    fresh = {"embedding_status": F.lit("pending"), "ingested_at": run_ts}
    rest = [F.when(F.col("_old").isNull(), fresh[c]).otherwise(F.col(c)).alias(c) if c in fresh else F.col(c) for c in kept]
    return taken.select(*key, *[F.col(f"_c.{c}").alias(c) for c in content], *rest, change.alias("change"))


def write_embeddings(table: DataFrame, vectors: DataFrame, stamp: str, dim: int) -> DataFrame:
    """Status, vector, hash and model by id: ready where a vector of ``dim`` came, failed where it was null; another length is an error."""
    v = vectors.select("id", F.col("vector").alias("_v"), F.col("hash").alias("_h"), F.lit(True).alias("_came"))
    both = table.join(v, "id", "left")
    checked = F.when(F.size("_v") == dim, F.col("_v")).otherwise(F.raise_error(F.lit(f"a vector has not {dim} numbers")))
    ready = F.col("_came") & F.col("_v").isNotNull()
    return both.select(*[c for c in table.columns if not c.startswith("embedding")],
                       F.when(ready, checked).otherwise(F.col("embedding")).alias("embedding"),
                       F.when(ready, "ready").when(F.col("_came"), "failed").otherwise(F.col("embedding_status")).alias("embedding_status"),
                       F.when(ready, F.col("_h")).otherwise(F.col("embedding_hash")).alias("embedding_hash"),
                       F.when(ready, F.lit(stamp)).otherwise(F.col("embedding_model")).alias("embedding_model"))


def pending_embeddings(table: DataFrame, new_hash: Column, stamp: str) -> DataFrame:
    """Rows whose content, model or status calls for a new vector."""
    current = (F.col("embedding_status") == "ready") & (F.col("embedding_hash") == new_hash) & (F.col("embedding_model") == stamp)
    return table.where(~F.coalesce(current, F.lit(False)))


#: What a row must be. Nulls of fields with a default count as left out.
_URL = r"^[A-Za-z][A-Za-z0-9+.-]*://[^\s/?#]+"
_MAIL = r"^(?i)[a-z0-9_'+-]+(\.[a-z0-9_'+-]+)*@([a-z0-9][a-z0-9-]*\.)+[a-z]{2,}$"
_MONEY = C.whole(0)
TENDER = C.record(
    external_id=C.text(1), title=C.text(1), description=C.text(), source=C.text(), url=C.text(like=_URL), buyer=C.text(), country=C.text(2, 2).or_null(), sector=C.text().or_null(),
    cpv_codes=C.list_of(C.text()).optional(), budget_min_usd=_MONEY.or_null(), budget_max_usd=_MONEY.or_null(), currency=C.text().or_null(), published_at=C.time, deadline_at=C.time.or_null(), language=C.text(2, 5),
)
_NAMES = C.list_of(C.text()).optional()
PROFILE = C.record(
    company_name=C.text(1), one_liner=C.text(1, 280), industries=_NAMES, tech_stack=_NAMES, services=_NAMES, certifications=_NAMES, past_clients=_NAMES,
    past_projects=C.list_of(C.record(title=C.text(1), summary=C.text(1), sector=C.text().optional(), value_usd=C.number(0).optional())).optional(),
    geographies=C.list_of(C.text(2, 2)).optional(), team_size=_MONEY, budget_min_usd=_MONEY, budget_max_usd=_MONEY, languages=_NAMES, ignore_location=C.flag.optional(),
)
SCHEDULE = C.record(
    frequency=C.one_of("daily", "weekdays", "every_n_days", "weekly", "monthly"), interval_days=C.whole(1, 60).optional(), hour_local=C.whole(0, 23), hour_local_end=C.whole(0, 23), day_of_week=C.whole(0, 6).or_null(), day_of_month=C.whole(1, 31).or_null(),
    timezone=C.text().optional(), enabled=C.flag.optional(), min_fit_score=C.whole(0, 100).optional(), recipients=C.list_of(C.text(like=_MAIL), high=20).optional(),
)
FEEDBACK = C.record(match_id=C.Field("any"), interested=C.flag, note=C.text().optional())


def _checked(rows: DataFrame, schema: C.Field, more: dict[str, Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """(valid, rejects) of rows by a schema; columns that may be null or left out need not be there."""
    there = C.record(**{n: f for n, f in schema.fields if n in rows.columns or not (f.null or f.left_out)})
    return C.split(rows, C.problems(lambda n: C.Typed(F.col(n)), there, more))


def validate_tenders(rows: DataFrame, sources: list[str]) -> tuple[DataFrame, DataFrame]:
    """(valid, rejects); rejects carry the paths of the fields that are wrong in ``failed``."""
    known = C.record(**dict(TENDER.fields) | {"source": C.one_of(*sources)})
    return _checked(rows, known)


def validate_schedules(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    c = F.col
    return _checked(rows, SCHEDULE, {
        "hour_local_end": c("hour_local_end") >= c("hour_local"), "day_of_week": (c("frequency") != "weekly") | c("day_of_week").isNotNull(), "day_of_month": (c("frequency") != "monthly") | c("day_of_month").isNotNull(),
    })


def validate_profiles(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    return _checked(rows, PROFILE)


def validate_feedback(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Feedback says whether a match is of interest; a note is optional."""
    return _checked(rows, FEEDBACK)


def profile_defaults(rows: DataFrame) -> DataFrame:
    """Nulls as the reader of a profile takes them: empty lists, zeros, English, location counts."""
    lists = [n for n, t in rows.dtypes if t == "array<string>"]
    numbers = [n for n, t in rows.dtypes if t == "int"]
    empty = lambda n: F.array(F.lit("en")) if n == "languages" else F.array().cast("array<string>")
    out = {n: F.coalesce(n, empty(n)) for n in lists} | {n: F.coalesce(n, F.lit(0)) for n in numbers}
    return rows.withColumns(out | ({"ignore_location": F.coalesce("ignore_location", F.lit(False))} if "ignore_location" in rows.columns else {}))


def widen_window(schedules: DataFrame, default_end: int = 10) -> DataFrame:
    """Schedules that still end at the default hour: two hours after their start, within the day."""
    return schedules.withColumn("hour_local_end", F.when(F.col("hour_local_end") == default_end, F.least(F.lit(23), F.col("hour_local") + 2)).otherwise(F.col("hour_local_end")))


def purge(tenders: DataFrame, matches: DataFrame, gone: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tenders left, matches left, matches deleted): tenders where ``gone`` holds go, and the matches that point at them."""
    ids = tenders.where(gone).select("tender_id")
    return tenders.where(~F.coalesce(gone, F.lit(False))), matches.join(ids, "tender_id", "left_anti"), matches.join(ids, "tender_id", "left_semi")


def uncatalogued(rows: DataFrame, catalog: DataFrame, key: str = "source") -> DataFrame:
    return rows.select(key).where(F.col(key).isNotNull()).distinct().join(catalog.select(key), key, "left_anti")


def since_cutoff(catalog: DataFrame, tenders: DataFrame, now: Column, rewind_days: int = 45, first_days: int = 14) -> DataFrame:
    """(source, since): the last sight of a source, now at the latest, less the rewind; never seen: two weeks before."""
    seen = tenders.groupBy("source").agg(F.max("ingested_at").alias("last"))
    base = F.coalesce(F.least(F.col("last"), now), now - F.make_dt_interval(days=F.lit(first_days)))
    return catalog.select("source").join(seen, "source", "left").select("source", (base - F.make_dt_interval(days=F.lit(rewind_days))).alias("since"))


def ingest_summary(changes: DataFrame, by: str = "source", rejects: DataFrame | None = None) -> DataFrame:
    """fetched, inserted, updated, skipped and errors of each source; ``change`` says which, ``rejects`` (with ``failed``, the rules
    that each row broke) were skipped, and errors counts those rules."""
    is_ = lambda x: F.count_if(F.col("change") == x)
    kept = changes.where("change <> 'kept'").select(by, "change", F.lit(0).alias("errors"))
    if rejects is not None:
        kept = kept.unionByName(rejects.select(by, F.lit("skipped").alias("change"), F.size("failed").alias("errors")))
    return kept.groupBy(by).agg(F.count("*").alias("fetched"), is_("inserted").alias("inserted"), is_("updated").alias("updated"), is_("skipped").alias("skipped"), F.sum("errors").alias("errors"))


def select_sources(catalog: DataFrame, csv: str | None, filtered: bool = False) -> DataFrame:
    """The catalog's sources that a comma-separated list names. An empty list means all, or none where the list is a
    filter that is on."""
    names = list(dict.fromkeys(x.strip() for x in (csv or "").split(",") if x.strip()))
    return catalog.where(F.col("source").isin(names)) if names else catalog.where(F.lit(not filtered))


def enabled_sources(catalog: DataFrame) -> DataFrame:
    return catalog.where("unavailable_reason is null and availability = 'available'")


def tenants_with_profile(tenants: DataFrame, profiles: DataFrame) -> DataFrame:
    known = profiles.select("tenant_id", F.lit(True).alias("has_profile")).distinct()
    return tenants.join(known, "tenant_id", "left").withColumn("has_profile", F.coalesce("has_profile", F.lit(False)))


def owned_tenants(users: DataFrame, tenants: DataFrame, profiles: DataFrame, email: str) -> DataFrame:
    """The tenants of a user's address with whether they have a profile, oldest first."""
    mine = users.where(F.lower("email") == email.lower()).select("tenant_id").distinct()
    return tenants_with_profile(tenants.join(mine, "tenant_id"), profiles).orderBy("created_at", "tenant_id")


def embedding_summary(table: DataFrame) -> DataFrame:
    """Rows by embedding status and model."""
    return table.groupBy("embedding_status", "embedding_model").agg(F.count("*").alias("n"))


def embedding_run(pending: DataFrame, vectors: DataFrame) -> DataFrame:
    """embedded, failed and skipped rows of a run by model: with a vector, with a null one, and with none at all."""
    came = pending.join(vectors.select("id", F.lit(True).alias("_came"), F.col("vector").isNotNull().alias("_is")), "id", "left")
    return came.groupBy("embedding_model").agg(F.count_if("_is").alias("embedded"), F.count_if(~F.col("_is")).alias("failed"), F.count_if(F.col("_came").isNull()).alias("skipped"))


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The newest row of a key: feedback by match, profile by tenant. Reduced before the shuffle."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(order, F.xxhash64(*rest))).alias("_r")).select(key, "_r.*")


def save_profile(current: DataFrame, new: DataFrame) -> DataFrame:
    """Profiles with a tenant's new version in place of the old; a change asks for a new embedding."""
    changed = new.withColumn("embedding_status", F.lit("pending"))
    return current.join(new.select("tenant_id"), "tenant_id", "left_anti").unionByName(changed, allowMissingColumns=True)


def write_results(rows: DataFrame, path: str, by: list[str]) -> None:
    """Results as Parquet, partitioned; the partitions that come again are replaced."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
