"""Matching: candidates to pairs, win probability, model scores, results."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import schemas as C
from ..functions.values import half_up


def exclude_existing(candidates: DataFrame, matches: DataFrame) -> DataFrame:
    return candidates.join(matches.select("tenant_id", "tender_id"), ["tenant_id", "tender_id"], "left_anti")


def status_filter(deadline: Column, status: str, now: Column) -> Column:
    """active: no deadline, or one to come; archived: one that has passed; all."""
    return {"active": deadline.isNull() | (deadline > now), "archived": deadline <= now, "all": F.lit(True)}[status]


def attach_active(candidates: DataFrame, tenders: DataFrame, now: Column) -> DataFrame:
    return candidates.join(tenders.where(status_filter(F.col("deadline_at"), "active", now)), "tender_id")


def newest(rows: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def historical_wins(feedback: DataFrame, matches: DataFrame, tenders: DataFrame, n: int = 20) -> DataFrame:
    """(tenant_id, wins): of each tenant's ``n`` newest interested feedbacks the tenders' sector, country and buyer.

    The newest are taken first; those without sector, country and buyer are then left out.
    """
    liked = newest(feedback.where("interested"), ["tenant_id"], [F.desc("created_at"), F.col("tender_id")], n)
    rows = liked.select("tenant_id", "tender_id").join(matches.select("tenant_id", "tender_id"), ["tenant_id", "tender_id"]).join(tenders.select("tender_id", "sector", "country", "buyer"), "tender_id")
    rows = rows.where("sector is not null or country is not null or buyer is not null")
    wins = F.array_sort(F.collect_list(F.struct("tender_id", "sector", "country", "buyer")))
    return rows.groupBy("tenant_id").agg(wins.alias("wins"))


def _holds(a: Column, b: Column) -> Column:
    return F.contains(a, b) | F.contains(b, a)


def win_probability(p: dict[str, Column]) -> tuple[Column, Column, Column]:
    """(level, score, reason) of a pair. p: geographies, ignore_location, profile_min, profile_max, team_size, industries,
    project_sectors (arrays never null), country, sector, budget_min, budget_max, wins (array of sector, country; null: none)."""
    country, sector = F.upper(p["country"]), F.lower(F.trim(F.coalesce(p["sector"], F.lit(""))))
    geos = F.transform(p["geographies"], lambda x: F.upper(x))
    at_home = F.array_contains(geos, country)
    mid = F.coalesce((p["budget_min"] + p["budget_max"]) / F.lit(2.0), p["budget_max"].cast("double"), p["budget_min"].cast("double"))
    low, high, team = p["profile_min"], p["profile_max"], p["team_size"]
    industries = F.transform(p["industries"], lambda x: F.lower(F.trim(x)))
    projects = F.filter(F.transform(p["project_sectors"], lambda x: F.lower(F.trim(F.coalesce(x, F.lit(""))))), lambda x: x != "")
    wins = F.coalesce(p["wins"], F.array().cast("array<struct<sector:string,country:string>>"))
    won_country = ~p["ignore_location"] & F.coalesce(F.exists(wins, lambda w: F.upper(F.coalesce(w["country"], F.lit(""))) == country), F.lit(False)) & F.coalesce(country != "", F.lit(False))
    won_sector = (sector != "") & F.exists(wins, lambda w: F.contains(F.lower(F.coalesce(w["sector"], F.lit(""))), sector))
    ordered = F.array_distinct(geos)
    # fixed values: points and factor texts
    steps = [  # condition chains: the first that holds gives points and a factor
        [(p["ignore_location"], 0, F.lit("location disregarded per profile setting")), (F.size(geos) == 0, 1, F.lit("company operates globally")),
         (at_home & (country != ""), 2, F.concat(F.lit("geography match ("), country, F.lit(")"))), (country.isNotNull() & (country != ""), -2, F.concat(F.lit("geography mismatch (tender "), country, F.lit(" vs "), F.array_join(ordered, "/"), F.lit(")")))],
        [(mid.isNull(), 0, F.lit("tender budget unspecified")), ((low == 0) & (high == 0), 0, F.lit("company budget range unspecified")), (mid.between(low, high), 2, F.lit("tender budget within company range")),
         (mid < low, -1, F.lit("tender below company minimum")), (mid > high, -2, F.lit("tender exceeds company budget ceiling"))],
        [(team.between(1, 4) & (mid > 1_000_000), -3, F.lit("team < 5 vs tender > $1M (capacity risk)")), ((team >= 20) & (mid > 1_000_000), 1, F.lit("sufficient team size for large tender"))],
        [((sector != "") & F.exists(industries, lambda i: (i != "") & _holds(i, sector)), 2, F.concat(F.lit("sector overlap ("), p["sector"], F.lit(")"))), (sector != "", 0, F.concat(F.lit('no direct sector match for "'), p["sector"], F.lit('"')))],
        [((sector != "") & F.exists(projects, lambda s: _holds(s, sector)), 2, F.lit("relevant past project in same sector"))],
        [(won_country, 2, F.lit("prior win in same country"))],
        [(won_sector, 2, F.lit("prior win in same sector"))],
        [((F.size(wins) > 0) & ~won_country & ~won_sector, 0, F.concat(F.size(wins).cast("string"), F.lit(" historical wins, none directly comparable")))],
    ]
    score, factors = F.lit(0), []
    for chain in steps:
        points, factor = F.lit(0), F.lit(None).cast("string")
        for condition, n, text in reversed(chain):
            points, factor = F.when(condition, n).otherwise(points), F.when(condition, text).otherwise(factor)
        score = score + points
        factors.append(factor)
    level = F.when(score >= 5, "high").when(score >= 1, "medium").otherwise("low")
    reasons = F.array_join(F.array_compact(F.array(*factors)), "; ")
    reason = F.concat(F.upper(level), F.lit(" (score="), score.cast("string"), F.lit("): "), F.coalesce(F.nullif(reasons, F.lit("")), F.lit("insufficient signals")))
    return level, score, reason


def blend_score(model: Column, cosine: Column, weight: float) -> Column:
    """The model's score, mixed with the similarity in percent."""
    if weight == 0:
        return model
    near = half_up(F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine)) * 100)
    return F.when(cosine.isNull(), model).otherwise(half_up(near * F.lit(weight) + model * F.lit(1.0 - weight))).cast("int")


ROLE = "struct<role:string,count:int,seniority:string,rationale:string>"
ESTIMATE = f"struct<minimum_people:int,confidence:string,basis:string,roles:array<{ROLE}>,notes:string>"
#: What a model's answer must be, by the names of its JSON.
_LEVEL = C.one_of("low", "medium", "high")
ANSWER = C.record(
    rationale=C.list_of(C.text(1), 3, 3), gaps=C.list_of(C.record(requirement=C.text(1), severity=C.one_of("blocker", "major", "minor"))).optional(), winProbability=_LEVEL, winProbabilityReason=C.text(1),
    humanResourcesEstimate=C.record(
        minimumPeople=C.whole(0, 10_000), confidence=_LEVEL, basis=C.one_of("explicit", "inferred", "mixed"),
        roles=C.list_of(C.record(role=C.text(1), count=C.whole(1, 10_000), seniority=C.text(1).or_null(), rationale=C.text(1))).optional(), notes=C.text(1),
    ),
    fitScore=C.whole(0, 100),
    collaborationSuggestion=C.record(partnerProfile=C.text(20, 600), mustHaveCapabilities=C.list_of(C.text(1), 1, 6), geographyHint=C.text().or_null(), newWinProbabilityIfPartnered=_LEVEL).optional(),
)
_GAPS = "array<struct<requirement:string,severity:string>>"
_JSON = f"struct<rationale:array<string>,gaps:{_GAPS},winProbability:string,winProbabilityReason:string,humanResourcesEstimate:struct<minimumPeople:int,confidence:string,basis:string,roles:array<{ROLE}>,notes:string>,fitScore:int,collaborationSuggestion:struct<partnerProfile:string,mustHaveCapabilities:array<string>,geographyHint:string,newWinProbabilityIfPartnered:string>>"
ASSESSMENT = f"struct<rationale:array<string>,gaps:{_GAPS},win_probability:string,win_probability_reason:string,human_resources_estimate:{ESTIMATE},fit_score:int,collaboration_suggestion:struct<partner_profile:string,must_have_capabilities:array<string>,geography_hint:string,new_win_probability_if_partnered:string>>"


def normalize_hr(h: Column) -> Column:
    """The estimate with minimum_people equal to the roles' sum; a note says so where it changed a positive sum. None: an empty one."""
    total = F.aggregate(F.coalesce(h["roles"], F.array().cast(f"array<{ROLE}>")), F.lit(0), lambda s, r: s + r["count"])
    changed = (total != h["minimum_people"]) & (total != 0)
    notes = F.when(changed, F.concat(h["notes"], F.lit(" Minimum team size normalized to the sum of role counts."))).otherwise(h["notes"])
    fixed = F.struct(total.alias("minimum_people"), h["confidence"].alias("confidence"), h["basis"].alias("basis"), h["roles"].alias("roles"), notes.alias("notes"))
    none = F.struct(F.lit(0).alias("minimum_people"), F.lit("low").alias("confidence"), F.lit("").alias("basis"), F.array().cast(f"array<{ROLE}>").alias("roles"), F.lit("").alias("notes"))
    return F.when(h.isNull(), none).otherwise(fixed)


def gate_collaboration(score: Column, suggestion: Column, below: int = 70) -> Column:
    return F.when(score < below, suggestion)


def parse_assessment(rows: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """(valid, rejects): the model's JSON as ``assessment``; rejects name the paths of what is wrong in ``failed``, ``json`` where the
    text is no JSON object. Lists that may be left out are then empty; other fields are ignored."""
    v = F.col("_answer")
    parsed = rows.select("*", C.once(F.try_parse_json(F.col(column))).alias("_answer"))
    is_object = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    failed = F.when(~is_object, F.array(F.lit("json"))).otherwise(C.problems(lambda n: C.Parsed(F.try_variant_get(v, f"$.{n}", "variant")), ANSWER))
    valid, rejects = C.split(parsed, failed)
    a = F.try_variant_get(v, "$", _JSON).cast(ASSESSMENT)
    valid = valid.withColumn("assessment", a).drop("_answer")
    for path, kind in (("gaps", _GAPS), ("human_resources_estimate.roles", f"array<{ROLE}>")):
        valid = valid.withColumn("assessment", F.col("assessment").withField(path, F.coalesce(F.col(f"assessment.{path}"), F.array().cast(kind))))
    return valid, rejects.drop("_answer")


def rerank_cap(candidates: DataFrame, relevance: str | None, shown: int = 40, attempts: int = 20) -> DataFrame:
    """The best ``attempts`` of each tenant's ``shown`` candidates by a supplied relevance, else in fused order."""
    first = newest(candidates, ["tenant_id"], [F.col("pos")], shown)
    order = [F.desc(relevance), F.col("pos")] if relevance else [F.col("pos")]
    return newest(first, ["tenant_id"], order, attempts)


def new_pairs(fused: DataFrame, tenders: DataFrame, matches: DataFrame, now: Column, relevance: str | None = None, shown: int = 40, attempts: int = 20) -> DataFrame:
    """Incremental matching: of each tenant's fused candidates the open tenders that are not yet matched, reranked, the best
    ``attempts`` at most."""
    return rerank_cap(exclude_existing(attach_active(fused, tenders, now), matches), relevance, shown, attempts)


def pair_features(pairs: DataFrame, profiles: DataFrame, tenders: DataFrame, wins: DataFrame) -> DataFrame:
    """Pairs with all that the win probability is reckoned from: profile, tender and the tenant's wins (null: none)."""
    won = wins.select("tenant_id", F.transform("wins", lambda w: F.struct(w["sector"].alias("sector"), w["country"].alias("country"))).alias("wins"))
    return pairs.join(profiles, "tenant_id").join(tenders, "tender_id").join(won, "tenant_id", "left")


def score_pairs(pairs: DataFrame, score: Callable[[pd.DataFrame], pd.Series], output: str = "score") -> DataFrame:
    """``pairs`` with a user's batch scores and an ``error`` column; an error costs only the pair that causes it."""
    schema = pairs.select("*", F.lit(0.0).alias(output), F.lit("").alias("error")).schema
    for f in schema:
        f.nullable = True

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size = 1 << 30  # of the parts to try first: what held about one failing pair in the batch before
        for batch in batches:
            n, columns = len(batch), {output: np.full(len(batch), np.nan), "error": np.full(len(batch), None, object)}

            def fails(a: int, b: int, known: bool = False, batch=batch, columns=columns) -> bool:
                """Whether a pair from a to b has failed. A part that fails is halved until the pair that fails stands alone; one
                ``known`` to fail, since its other half did not, is halved untried."""
                if not known or b - a == 1:
                    part = batch.iloc[a:b]
                    try:
                        got = score(part).astype(float)
                        if isinstance(got, pd.Series) and not got.index.equals(part.index):
                            got = got.reindex(part.index)
                        if len(got) != b - a:
                            raise ValueError(f"{len(got)} scores for {b - a} pairs")
                        columns[output][a:b] = got
                        return False
                    except Exception as e:  # noqa: BLE001
                        if b - a == 1:
                            columns["error"][a] = str(e)
                            return True
                half = (a + b) // 2
                fails(half, b, not fails(a, half))
                return True

            for a in range(0, n, size):
                fails(a, min(a + size, n))
            failed = sum(e is not None for e in columns["error"])
            size = max(1, n // failed) if failed else 1 << 30
            yield batch.assign(**columns)

    return pairs.dropDuplicates(["tenant_id", "tender_id"]).mapInPandas(run, schema)
