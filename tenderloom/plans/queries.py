"""Registered queries over the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import profiles as P
from ..functions import text as T
from ..functions import values as V
from ..functions.chunks import chunk_text as chunks_of
from ..operators import matching as M
from ..operators import neighbours as N
from ..operators import results as R
from ..operators import retrieval as Q
from ..operators import tables as K
from ..operators.slugs import unique_slugs
from ..sources import feeds as S
from ..sources import html as H
from ..storage import new_path
from . import tables as B

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
_AT = f"TIMESTAMP '{B.NOW}'"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# ---- digests and lists

@query(f"""WITH {B.TENDERS_SQL}, {B.MATCHES_SQL}, r AS (
  SELECT m.*, row_number() OVER (PARTITION BY tenant_id ORDER BY fit_score DESC, created_at DESC, tender_id) AS pos
  FROM m JOIN t USING (tender_id) WHERE fit_score >= 60 AND created_at >= {_AT} - INTERVAL 7 DAY AND (deadline_at IS NULL OR deadline_at > {_AT})
), p AS (SELECT tenant_id, count(*) AS n, string_agg(tender_id || ':' || fit_score || ':' || win_probability, ',' ORDER BY pos) AS items FROM r WHERE pos <= 50 GROUP BY tenant_id)
SELECT tenant_id, s_name AS company_name, n, n || ' new match' || CASE WHEN n = 1 THEN '' ELSE 'es' END || ' for ' || s_name AS subject, items FROM p JOIN supplier ON tenant_id = s_suppkey""")
def digest_top50(spark: SparkSession, d: str) -> DataFrame:
    plan = B.table(spark, d, "supplier").select(F.col("s_suppkey").alias("tenant_id"), F.lit(None).cast("int").alias("min_fit_score"), F.lit(None).cast("timestamp").alias("last_sent_at"))
    rows = R.digest_matches(B.matches(spark, d), B.deadlines(spark, d), plan, B.now())
    names = B.table(spark, d, "supplier").select(F.col("s_suppkey").alias("tenant_id"), F.col("s_name").alias("company_name"))
    shown = F.array_join(F.transform("matches", lambda m: F.concat_ws(":", m["tender_id"].cast("string"), m["fit_score"].cast("string"), m["win_probability"])), ",")
    return R.digest_payload(rows, names).select("tenant_id", "company_name", "n", "subject", shown.alias("items"))


_LIST = f"""WITH {B.TENDERS_SQL}, {B.MATCHES_SQL} SELECT tenant_id, tender_id, CAST(fit_score AS INT) AS fit_score, win_probability, deadline_at FROM m JOIN t USING (tender_id) WHERE fit_score >= 90 AND """


def _list(spark: SparkSession, d: str, status: str) -> DataFrame:
    return R.match_list(B.matches(spark, d), B.deadlines(spark, d), status, B.now(), 90).select("tenant_id", "tender_id", "fit_score", "win_probability", "deadline_at")


@query(_LIST + f"(deadline_at IS NULL OR deadline_at > {_AT})")
def match_list_active(spark: SparkSession, d: str) -> DataFrame:
    return _list(spark, d, "active")


@query(_LIST + f"deadline_at <= {_AT}")
def match_list_archived(spark: SparkSession, d: str) -> DataFrame:
    return _list(spark, d, "archived")


@query(f"""WITH {B.TENDERS_SQL}, {B.MATCHES_SQL}, x AS (SELECT m.*, deadline_at IS NULL OR deadline_at > {_AT} AS active FROM m JOIN t USING (tender_id)
  WHERE fit_score >= CASE WHEN tenant_id % 2 = 0 THEN 50 ELSE 30 END)
SELECT tenant_id, count(*) FILTER (active AND CAST(created_at AS DATE) = DATE '1998-01-01') AS today, CAST(floor(avg(fit_score) FILTER (active) + 0.5) AS BIGINT) AS avg_fit,
  count(*) FILTER (active AND win_probability = 'high') AS high, count(*) FILTER (NOT active) AS archived FROM x GROUP BY tenant_id""")
def dashboard_stats(spark: SparkSession, d: str) -> DataFrame:
    plan = B.table(spark, d, "supplier").select(F.col("s_suppkey").alias("tenant_id"), F.when(F.col("s_suppkey") % 2 == 0, 50).alias("min_fit_score"))
    return R.dashboard_stats(B.matches(spark, d), B.deadlines(spark, d), plan, B.now())


@query(f"WITH {B.MATCHES_SQL} SELECT tenant_id, count(*) AS n FROM m WHERE fit_score >= 60 GROUP BY tenant_id")
def count_matches(spark: SparkSession, d: str) -> DataFrame:
    return B.matches(spark, d).where("fit_score >= 60").groupBy("tenant_id").agg(F.count("*").alias("n"))


@query(f"WITH {B.MATCHES_SQL} SELECT tenant_id, win_probability, CAST(min(fit_score) AS INT) AS min_fit, CAST(max(fit_score) AS INT) AS max_fit, round(avg(fit_score), 6) AS avg_fit, count(*) AS n FROM m GROUP BY 1, 2")
def score_distribution(spark: SparkSession, d: str) -> DataFrame:
    return R.score_distribution(B.matches(spark, d), ["tenant_id", "win_probability"]).withColumn("avg_fit", F.round("avg_fit", 6))


# ---- evaluation

@query("""WITH s AS (SELECT n_chars % 101 AS predicted, quality = 1 AS label, source AS grp FROM labels JOIN documents USING (doc_id)),
c AS (SELECT threshold, grp, count(*) FILTER (predicted >= threshold AND label) AS tp, count(*) FILTER (predicted >= threshold AND NOT label) AS fp,
  count(*) FILTER (predicted < threshold AND label) AS fn, count(*) FILTER (predicted < threshold AND NOT label) AS tn, count(*) AS total
  FROM s, (VALUES (40), (60), (75)) v(threshold) GROUP BY GROUPING SETS ((threshold), (threshold, grp))),
r AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp)::DOUBLE END AS p, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn)::DOUBLE END AS q FROM c)
SELECT threshold, coalesce(grp, '(all)') AS "group", tp, fp, fn, tn, total, round((tp + tn) / total::DOUBLE, 6) AS agreement, round(p, 6) AS precision, round(q, 6) AS recall,
  round(CASE WHEN p + q = 0 THEN 0 ELSE 2 * p * q / (p + q) END, 6) AS f1, round((tp + fn) / total::DOUBLE, 6) AS positive_rate FROM r""")
def eval_overall_and_groups(spark: SparkSession, d: str) -> DataFrame:
    docs = B.table(spark, d, "documents").select("doc_id", "n_chars", "source")
    rows = B.table(spark, d, "labels").join(docs, "doc_id").select((F.col("n_chars") % 101).alias("predicted"), (F.col("quality") == 1).alias("label"), F.col("source").alias("group"))
    out = R.eval_metrics(R.confusion(rows))
    rounded = {c: F.round(c, 6) for c in ("agreement", "precision", "recall", "f1", "positive_rate")}
    return out.withColumns(rounded | {"group": F.coalesce("group", F.lit("(all)"))}).orderBy("threshold", F.desc("total"), "group")


@query(f"""WITH {B.MATCHES_SQL}, {B.TENDERS_SQL} SELECT fit_score AS predicted, interested AS label, coalesce(source, '(unknown)') AS "group", count(*) AS n FROM m LEFT JOIN t USING (tender_id) WHERE tender_id % 2 = 0 GROUP BY 1, 2, 3""")
def labeled_matches(spark: SparkSession, d: str) -> DataFrame:
    m = B.matches(spark, d).withColumn("match_id", F.concat_ws("-", "tenant_id", "tender_id")).withColumn("model_version", F.lit("m1"))
    feedback = m.where("tender_id % 2 = 0").select("match_id", "created_at", "interested")
    return R.labeled_matches(m.drop("interested"), feedback, B.tenders(spark, d)).groupBy("predicted", "label", "group").agg(F.count("*").alias("n"))


# ---- retrieval

def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The query set of a search: every row whose id is divisible by 20, against all rows (a vector meets itself too)."""
    e = B.table(spark, d, "embeddings")
    return e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("tenant_id"), "embedding"), e.select(F.col("vec_id").alias("tender_id"), "embedding")


_DENSE = """d AS (SELECT p.vec_id AS tenant_id, t.vec_id AS tender_id, round(1 - list_cosine_similarity(p.embedding::DOUBLE[], t.embedding::DOUBLE[]), 12) AS distance,
  row_number() OVER (PARTITION BY p.vec_id ORDER BY round(1 - list_cosine_similarity(p.embedding::DOUBLE[], t.embedding::DOUBLE[]), 12), t.vec_id) AS pos
  FROM embeddings p, embeddings t WHERE p.vec_id % 20 = 0 QUALIFY pos <= 60)"""


@query(f"WITH {_DENSE} SELECT tenant_id, tender_id, round(distance, 6) AS distance, pos FROM d")
def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    return N.dense_topk(*_vectors(spark, d)).withColumn("distance", F.round("distance", 6)).withColumn("pos", F.col("pos").cast("long"))


_WORDS = "list_filter(regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
_ZONED = f"""z AS (SELECT doc_id AS tender_id, 1.0 AS w, {_WORDS.format("left(text, 80)")} AS ws FROM documents UNION ALL SELECT doc_id, 0.1, {_WORDS.format("text")} FROM documents),
q AS (SELECT item_id AS tenant_id, unnest({_WORDS.format("text")}) AS term FROM benchmark WHERE item_id % 20 = 0),
ph AS (SELECT DISTINCT item_id AS tenant_id, array_to_string(b[i : i + 2], ' ') AS term FROM (SELECT item_id, b, unnest(range(1, greatest(len(b) - 2, 1) + 1)) AS i FROM (SELECT item_id, {_WORDS.format("text")} AS b FROM benchmark WHERE item_id % 20 = 0)) WHERE len(b) > 0)"""


def _tender_texts(spark: SparkSession, d: str) -> DataFrame:
    published = F.lit(B.NOW).cast("timestamp") + F.make_dt_interval(hours=F.col("doc_id").cast("int"))
    return B.table(spark, d, "documents").select(F.col("doc_id").alias("tender_id"), F.substring("text", 1, 80).alias("title"), F.col("text").alias("description"), published.alias("published_at"))


def _item_words(spark: SparkSession, d: str) -> DataFrame:
    return B.table(spark, d, "benchmark").where("item_id % 20 = 0").select(F.col("item_id").alias("tenant_id"), T.word_splits(F.col("text")).alias("words"))


def _ranked(spark: SparkSession, d: str, terms: DataFrame) -> DataFrame:
    return Q.text_topk(terms, _tender_texts(spark, d), {"title": "A", "description": "D"})


def _terms(spark: SparkSession, d: str) -> DataFrame:
    return _item_words(spark, d).select("tenant_id", F.explode("words").alias("term"))


_TEXT = """x AS (SELECT tender_id, w, unnest(ws) AS term FROM z), dq AS (SELECT DISTINCT * FROM q),
s AS (SELECT tenant_id, tender_id, sum(w) AS s FROM x JOIN dq USING (term) GROUP BY 1, 2),
tx AS (SELECT tenant_id, tender_id, round(s / (s + 1), 9) AS rank, row_number() OVER (PARTITION BY tenant_id ORDER BY round(s / (s + 1), 9) DESC, tender_id DESC) AS pos FROM s QUALIFY pos <= 60)"""


@query(f"WITH {_ZONED}, {_TEXT} SELECT tenant_id, tender_id, round(rank, 6) AS rank, pos FROM tx")
def text_topk_terms(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(spark, d, _terms(spark, d)).withColumn("rank", F.round("rank", 6)).withColumn("pos", F.col("pos").cast("long"))


@query(f"""WITH {_ZONED}, g AS (SELECT tender_id, w, array_to_string(ws[i : i + 2], ' ') AS term FROM (SELECT *, unnest(range(1, len(ws) - 1)) AS i FROM z)),
s AS (SELECT tenant_id, tender_id, sum(w) AS s FROM g JOIN ph USING (term) GROUP BY 1, 2)
SELECT tenant_id, tender_id, round(s / (s + 1), 6) AS rank, row_number() OVER (PARTITION BY tenant_id ORDER BY round(s / (s + 1), 9) DESC, tender_id DESC) AS pos FROM s QUALIFY pos <= 60""")
def text_topk_phrase(spark: SparkSession, d: str) -> DataFrame:
    """Every run of three words of an item is a phrase; an item of fewer words is one."""
    at = F.sequence(F.lit(1), F.greatest(F.size("words") - 2, F.lit(1)))
    phrases = _item_words(spark, d).select("tenant_id", F.explode(F.transform(at, lambda i: F.array_join(F.slice("words", i, 3), " "))).alias("term"))
    return _ranked(spark, d, phrases).withColumn("rank", F.round("rank", 6)).withColumn("pos", F.col("pos").cast("long"))


@query(f"""WITH {_ZONED}, {_TEXT}, {_DENSE}, f AS (SELECT coalesce(d.tenant_id, tx.tenant_id) AS tenant_id, coalesce(d.tender_id, tx.tender_id) AS tender_id, d.pos AS dp, tx.pos AS tp, distance, rank,
  coalesce(1.0::DOUBLE / (60 + d.pos), 0) + coalesce(1.0::DOUBLE / (60 + tx.pos), 0) AS score FROM d FULL JOIN tx ON d.tenant_id = tx.tenant_id AND d.tender_id = tx.tender_id)
SELECT tenant_id, tender_id, round(score, 9) AS score, row_number() OVER (PARTITION BY tenant_id ORDER BY round(score, 12) DESC, coalesce(dp, tp), dp IS NULL, tender_id) AS pos,
  CASE WHEN distance IS NOT NULL THEN round(greatest(0, least(1, 1 - distance)), 6) END AS dense_similarity, round(rank, 6) AS text_rank, concat_ws('+', CASE WHEN dp IS NOT NULL THEN 'dense' END, CASE WHEN tp IS NOT NULL THEN 'text' END) AS sources FROM f QUALIFY pos <= 40""")
def rrf_fuse(spark: SparkSession, d: str) -> DataFrame:
    out = Q.rrf_fuse(N.dense_topk(*_vectors(spark, d)), _ranked(spark, d, _terms(spark, d)))
    return out.select("tenant_id", "tender_id", F.round("score", 9).alias("score"), F.col("pos").cast("long").alias("pos"), F.round("dense_similarity", 6).alias("dense_similarity"), F.round("text_rank", 6).alias("text_rank"), F.array_join("sources", "+").alias("sources"))


@query("""WITH w AS (SELECT label, vec_id % 7 AS w, embedding::DOUBLE[] AS e FROM embeddings), x AS (SELECT label, w, unnest(e) AS v, unnest(range(1, len(e) + 1)) AS i FROM w),
s AS (SELECT label, i, sum(v * w) / sum(w) AS v FROM x GROUP BY 1, 2) SELECT label, CAST(i AS INT) AS i, round(v, 6) + 0.0 AS v FROM s""")
def mean_pool(spark: SparkSession, d: str) -> DataFrame:
    e = B.table(spark, d, "embeddings").select("label", (F.col("vec_id") % 7).alias("w"), "embedding")
    rows = Q.mean_pool(e, "label", "embedding", "w").select("label", F.posexplode("embedding").alias("i", "v"))
    return rows.select("label", (F.col("i") + 1).alias("i"), (F.round("v", 6) + F.lit(0.0)).alias("v"))


# ---- matching

def _candidates(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as candidates for orders: of every line its supplier or the next one."""
    rows = B.table(spark, d, "lineitem").select("l_suppkey", F.col("l_orderkey").alias("tender_id"))
    return rows.select((F.col("l_suppkey") + F.col("tender_id") % 2).alias("tenant_id"), "tender_id").distinct()


_CANDIDATES = "c AS (SELECT DISTINCT l_suppkey + l_orderkey % 2 AS tenant_id, l_orderkey AS tender_id FROM lineitem)"


@query(f"WITH {_CANDIDATES}, {B.MATCHES_SQL} SELECT tenant_id, tender_id FROM c ANTI JOIN m USING (tenant_id, tender_id)")
def exclude_existing(spark: SparkSession, d: str) -> DataFrame:
    return M.exclude_existing(_candidates(spark, d), B.matches(spark, d))


@query(f"WITH {_CANDIDATES}, {B.TENDERS_SQL} SELECT tenant_id, tender_id, buyer, country, sector FROM c JOIN t USING (tender_id) WHERE deadline_at IS NULL OR deadline_at > {_AT}")
def attach_active(spark: SparkSession, d: str) -> DataFrame:
    return M.attach_active(_candidates(spark, d), B.tenders(spark, d), B.now()).select("tenant_id", "tender_id", "buyer", "country", "sector")


_WINS = """w AS (SELECT tenant_id, tender_id, t.sector, t.country, t.buyer FROM (SELECT tenant_id, tender_id, row_number() OVER (PARTITION BY tenant_id ORDER BY created_at DESC, tender_id) AS r FROM m WHERE interested) JOIN t USING (tender_id) WHERE r <= 20)"""


@query(f"WITH {B.TENDERS_SQL}, {B.MATCHES_SQL}, {_WINS} SELECT tenant_id, count(*) AS n, string_agg(tender_id || ':' || sector || ':' || country, ',' ORDER BY tender_id) AS wins FROM w GROUP BY tenant_id")
def historical_wins(spark: SparkSession, d: str) -> DataFrame:
    m = B.matches(spark, d)
    wins = M.historical_wins(m, m, B.tenders(spark, d))
    return wins.select("tenant_id", F.size("wins").cast("long").alias("n"), F.array_join(F.transform("wins", lambda w: F.concat_ws(":", w["tender_id"].cast("string"), w["sector"], w["country"])), ",").alias("wins"))


@query(f"""WITH {B.TENDERS_SQL}, {B.MATCHES_SQL}, {_CANDIDATES}, {_WINS}, wl AS (SELECT tenant_id, list(lower(sector)) AS ws, list(country) AS wc, count(*) AS n FROM w GROUP BY 1),
p AS (SELECT s_suppkey AS tenant_id, CASE WHEN s_suppkey % 11 = 0 THEN [] ELSE [upper(left(n_name, 2))] END AS geo, s_suppkey % 10 = 0 AS ign, greatest(0, CAST(floor(s_acctbal * 10) AS INT)) AS lo, s_suppkey % 40 AS team,
  CASE s_suppkey % 3 WHEN 0 THEN ['building and machinery'] WHEN 1 THEN ['auto', 'furniture'] ELSE [] END AS ind, CASE WHEN s_suppkey % 4 = 0 THEN 'household' ELSE 'it' END AS proj FROM supplier JOIN nation ON s_nationkey = n_nationkey),
x AS (SELECT c.tenant_id, c.tender_id, p.*, t.country, lower(t.sector) AS sec, t.sector AS sector, (budget_min + budget_max) / 2.0 AS mid, coalesce(wl.n, 0) AS wn, NOT ign AND coalesce(list_contains(wc, t.country), false) AS won_c, coalesce(len(list_filter(ws, lambda z: contains(z, lower(t.sector)))) > 0, false) AS won_s
  FROM c JOIN p ON c.tenant_id = p.tenant_id JOIN t ON c.tender_id = t.tender_id LEFT JOIN wl ON wl.tenant_id = c.tenant_id),
f AS (SELECT tenant_id, tender_id,
  CASE WHEN ign THEN 0 WHEN len(geo) = 0 THEN 1 WHEN list_contains(geo, country) THEN 2 ELSE -2 END + CASE WHEN mid BETWEEN lo AND lo + 200000 THEN 2 WHEN mid < lo THEN -1 ELSE -2 END
  + CASE WHEN team BETWEEN 1 AND 4 AND mid > 1000000 THEN -3 WHEN team >= 20 AND mid > 1000000 THEN 1 ELSE 0 END + CASE WHEN len(list_filter(ind, lambda i: contains(i, sec) OR contains(sec, i))) > 0 THEN 2 ELSE 0 END
  + CASE WHEN contains(proj, sec) OR contains(sec, proj) THEN 2 ELSE 0 END + CASE WHEN won_c THEN 2 ELSE 0 END + CASE WHEN won_s THEN 2 ELSE 0 END AS score,
  concat_ws('; ', CASE WHEN ign THEN 'location disregarded per profile setting' WHEN len(geo) = 0 THEN 'company operates globally' WHEN list_contains(geo, country) THEN 'geography match (' || country || ')' ELSE 'geography mismatch (tender ' || country || ' vs ' || geo[1] || ')' END,
  CASE WHEN mid BETWEEN lo AND lo + 200000 THEN 'tender budget within company range' WHEN mid < lo THEN 'tender below company minimum' ELSE 'tender exceeds company budget ceiling' END,
  CASE WHEN team BETWEEN 1 AND 4 AND mid > 1000000 THEN 'team < 5 vs tender > $1M (capacity risk)' WHEN team >= 20 AND mid > 1000000 THEN 'sufficient team size for large tender' END,
  CASE WHEN len(list_filter(ind, lambda i: contains(i, sec) OR contains(sec, i))) > 0 THEN 'sector overlap (' || sector || ')' ELSE 'no direct sector match for "' || sector || '"' END,
  CASE WHEN contains(proj, sec) OR contains(sec, proj) THEN 'relevant past project in same sector' END, CASE WHEN won_c THEN 'prior win in same country' END, CASE WHEN won_s THEN 'prior win in same sector' END,
  CASE WHEN wn > 0 AND NOT won_c AND NOT won_s THEN wn || ' historical wins, none directly comparable' END) AS factors FROM x)
SELECT tenant_id, tender_id, CAST(score AS INT) AS score, CASE WHEN score >= 5 THEN 'high' WHEN score >= 1 THEN 'medium' ELSE 'low' END AS level,
  CASE WHEN score >= 5 THEN 'HIGH' WHEN score >= 1 THEN 'MEDIUM' ELSE 'LOW' END || ' (score=' || score || '): ' || factors AS reason FROM f""")
def win_probability(spark: SparkSession, d: str) -> DataFrame:
    m, t = B.matches(spark, d), B.tenders(spark, d)
    pairs = M.pair_features(_candidates(spark, d), B.profiles(spark, d), t, M.historical_wins(m, m, t))
    names = ("geographies", "ignore_location", "profile_min", "profile_max", "team_size", "industries", "project_sectors", "country", "sector", "budget_min", "budget_max", "wins")
    level, score, reason = M.win_probability({c: F.col(c) for c in names})
    return pairs.select("tenant_id", "tender_id", score.cast("int").alias("score"), level.alias("level"), reason.alias("reason"))


@query("""SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, CAST(floor(floor(l_discount * 10 * 100 + 0.5) * 0.3 + CAST(l_quantity * 2 AS INT) * 0.7 + 0.5) AS INT) AS blended FROM lineitem""")
def blend_score(spark: SparkSession, d: str) -> DataFrame:
    rows = B.table(spark, d, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", M.blend_score((F.col("l_quantity") * 2).cast("int"), F.col("l_discount") * 10, 0.3).alias("blended"))


def _answers() -> list[tuple[str, str]]:
    """Answers of a model in JSON, each with what is wrong in it: as they should be, and one for every way to break a rule."""
    people = {"minimumPeople": "#people", "confidence": "low", "basis": "mixed", "notes": "note."}
    roles = [{"role": "lead", "count": 1, "seniority": None, "rationale": "r"}, {"role": "engineer", "count": "#count", "seniority": "senior", "rationale": "r"}]
    help_ = {"partnerProfile": "a partner with local offices", "mustHaveCapabilities": ["local office"], "geographyHint": "DE", "newWinProbabilityIfPartnered": "high"}
    good = {"rationale": ["a", "b", "c"], "gaps": [{"requirement": "iso", "severity": "minor"}], "winProbability": "medium", "winProbabilityReason": "near", "humanResourcesEstimate": people | {"roles": roles}, "fitScore": "#fit", "collaborationSuggestion": help_}
    left_out = object()

    def changed(path: str, value: object) -> str:
        answer = json.loads(json.dumps(good))
        *way, last = [int(x) if x.isdigit() else x for x in re.findall(r"\w+", path)]
        at = answer
        for x in way:
            at = at[x]
        if value is left_out:
            del at[last]
        else:
            at[last] = value
        return json.dumps(answer)

    wrong = {
        "rationale": [left_out, None, ["a", "b"], ["a", "b", "c", "d"], "a b c"], "rationale[1]": ["", 7, None], "gaps": ["none", None], "gaps[0].requirement": ["", left_out], "gaps[0].severity": ["huge", None, left_out], "winProbability": ["sure", left_out], "winProbabilityReason": ["", left_out, 5],
        "humanResourcesEstimate": [left_out, None, []], "humanResourcesEstimate.minimumPeople": [-1, 10001, 2.5, "3", left_out], "humanResourcesEstimate.confidence": ["none", left_out], "humanResourcesEstimate.basis": ["guess", left_out], "humanResourcesEstimate.roles": ["none", None], "humanResourcesEstimate.roles[0].role": ["", left_out],
        "humanResourcesEstimate.roles[1].count": [0, -5, 999999, 1.5, left_out], "humanResourcesEstimate.roles[1].seniority": ["", left_out], "humanResourcesEstimate.roles[0].rationale": ["", left_out], "humanResourcesEstimate.notes": ["", left_out], "fitScore": [101, -1, 50.5, "50", None, left_out],
        "collaborationSuggestion": [None, "a partner"], "collaborationSuggestion.partnerProfile": ["too short", "x" * 601, left_out], "collaborationSuggestion.mustHaveCapabilities": [[], list("abcdefg"), left_out], "collaborationSuggestion.mustHaveCapabilities[0]": ["", 4], "collaborationSuggestion.geographyHint": [left_out, 9], "collaborationSuggestion.newWinProbabilityIfPartnered": ["maybe", left_out],
    }
    fine = [json.dumps(good), changed("gaps", left_out), changed("collaborationSuggestion.geographyHint", None), changed("more", {"x": 1}), changed("humanResourcesEstimate.roles[1].seniority", None), changed("collaborationSuggestion.partnerProfile", "a partner with local offices")]
    return [(x, "") for x in fine] + [(changed(path, v), path) for path, values in wrong.items() for v in values] + [("not json", "json"), ("[1]", "json"), ("", "json"), (json.dumps({"fitScore": 50}), "rationale,winProbability,winProbabilityReason,humanResourcesEstimate")]


_ANSWERS = _answers()
_N_FINE = sum(not failed for _, failed in _ANSWERS)


def _assessments(spark: SparkSession, d: str) -> DataFrame:
    """One model answer in JSON per order, in turn as they should be and wrong."""
    k = F.col("o_orderkey")
    text = F.element_at(F.array(*[F.lit(x) for x, _ in _ANSWERS]), (k % len(_ANSWERS) + 1).cast("int"))
    for mark, value in (("fit", k % 101), ("people", k % 5), ("count", k % 4 + 1)):
        text = F.replace(text, F.lit(f'"#{mark}"'), value.cast("string"))
    return B.table(spark, d, "orders").select("o_orderkey", text.alias("answer"))


@query(f"SELECT o_orderkey, {[failed for _, failed in _ANSWERS]}[o_orderkey % {len(_ANSWERS)} + 1] AS failed FROM orders WHERE o_orderkey % {len(_ANSWERS)} >= {_N_FINE}")
def parse_assessment(spark: SparkSession, d: str) -> DataFrame:
    return M.parse_assessment(_assessments(spark, d), "answer")[1].select("o_orderkey", F.array_join("failed", ",").alias("failed"))


_VALID = f"o_orderkey % {len(_ANSWERS)} < {_N_FINE}"


@query(f"SELECT o_orderkey, CAST(2 + o_orderkey % 4 AS INT) AS people, 'note.' || CASE WHEN 2 + o_orderkey % 4 <> o_orderkey % 5 THEN ' Minimum team size normalized to the sum of role counts.' ELSE '' END AS notes FROM orders WHERE {_VALID}")
def normalize_hr(spark: SparkSession, d: str) -> DataFrame:
    rows = M.parse_assessment(_assessments(spark, d), "answer")[0]
    return rows.select("o_orderkey", M.normalize_hr(F.col("assessment.human_resources_estimate")).alias("h")).select("o_orderkey", F.col("h.minimum_people").alias("people"), F.col("h.notes").alias("notes"))


@query(f"SELECT o_orderkey, CASE WHEN o_orderkey % 101 < 70 THEN 'a partner with local offices' END AS suggestion, CASE WHEN o_orderkey % 101 < 70 AND o_orderkey % {len(_ANSWERS)} <> 2 THEN 'DE' END AS geography FROM orders WHERE {_VALID}")
def gate_collaboration(spark: SparkSession, d: str) -> DataFrame:
    rows = M.parse_assessment(_assessments(spark, d), "answer")[0]
    s = M.gate_collaboration(F.col("assessment.fit_score"), F.col("assessment.collaboration_suggestion"))
    return rows.select("o_orderkey", s.alias("s")).select("o_orderkey", F.col("s.partner_profile").alias("suggestion"), F.col("s.geography_hint").alias("geography"))


@query(f"""WITH {_CANDIDATES}, r AS (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY tender_id) AS pos FROM c), f AS (SELECT * FROM r WHERE pos <= 40)
SELECT tenant_id, tender_id FROM f QUALIFY row_number() OVER (PARTITION BY tenant_id ORDER BY (tender_id * 7919) % 1000 DESC, pos) <= 20""")
def rerank_cap(spark: SparkSession, d: str) -> DataFrame:
    c = _candidates(spark, d).withColumn("pos", F.row_number().over(Window.partitionBy("tenant_id").orderBy("tender_id")))
    return M.rerank_cap(c.withColumn("relevance", F.col("tender_id") * 7919 % 1000), "relevance").select("tenant_id", "tender_id")


@query(f"WITH {_CANDIDATES} SELECT tenant_id, tender_id, CASE WHEN tender_id % 101 <> 0 THEN CAST((tenant_id + tender_id) % 100 AS DOUBLE) END AS score, tender_id % 101 = 0 AS failed FROM c")
def score_pairs(spark: SparkSession, d: str) -> DataFrame:
    def score(pairs):
        if (pairs.tender_id % 101 == 0).any():
            raise ValueError("no score for this tender")
        return (pairs.tenant_id + pairs.tender_id) % 100

    out = M.score_pairs(_candidates(spark, d), score)
    return out.select("tenant_id", "tender_id", F.nanvl("score", F.lit(None).cast("double")).alias("score"), F.col("error").isNotNull().alias("failed"))


# ---- values and validation

@query("""SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN CAST(floor(o_totalprice + 0.5) AS INT) WHEN 1 THEN CAST(floor(o_totalprice * 1.08 + 0.5) AS INT) WHEN 2 THEN CAST(floor(o_totalprice * 0.0067 + 0.5) AS INT)
  WHEN 3 THEN NULL WHEN 4 THEN CAST(least(2147483647, floor(o_totalprice * 100000 * 1.27 + 0.5)) AS INT) ELSE CAST(floor(o_totalprice * 2.5 + 0.5) AS INT) END AS usd FROM orders""")
def to_usd(spark: SparkSession, d: str) -> DataFrame:
    k, x = F.col("o_orderkey"), F.col("o_totalprice")
    currency = F.element_at(F.array(*[F.lit(c) for c in ("USD", "eur", "JPY", "XXX", "GBP", "ABC")]), (k % 6 + 1).cast("int"))
    return B.table(spark, d, "orders").select("o_orderkey", V.to_usd(F.when(k % 6 == 4, x * 100000).otherwise(x), currency, F.when(k % 6 == 5, 2.5)).alias("usd"))


@query("""SELECT c_custkey, CASE lower(trim(n_name)) WHEN 'united kingdom' THEN 'GB' WHEN 'united states' THEN 'US' WHEN 'germany' THEN 'DE' WHEN 'france' THEN 'FR' WHEN 'ireland' THEN 'IE' END AS iso2, upper(left(trim(n_name), 2)) AS code
  FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def country_iso2(spark: SparkSession, d: str) -> DataFrame:
    c, n = B.table(spark, d, "customer"), B.table(spark, d, "nation")
    return c.join(F.broadcast(n), c["c_nationkey"] == n["n_nationkey"]).select("c_custkey", V.country_iso2(F.col("n_name")).alias("iso2"), V.country_from_code(F.col("n_name")).alias("code"))


def _raw_tenders(spark: SparkSession, d: str) -> DataFrame:
    """Documents as incoming rows, some of them wrong."""
    k = F.col("doc_id")
    unless = lambda n, r, bad, good: F.when(k % n == r, bad).otherwise(good)
    return B.table(spark, d, "documents").select(
        k, unless(21, 1, F.lit(""), k.cast("string")).alias("external_id"), unless(10, 3, "", F.col("text")).alias("title"), unless(23, 2, None, F.col("text")).alias("description"), "source", unless(15, 4, "no url", F.concat(F.lit("https://x.org/"), k.cast("string"))).alias("url"), unless(25, 5, None, F.lit("a buyer")).alias("buyer"),
        F.when(k % 12 == 5, "DEU").when(k % 12 == 6, F.lit(None)).otherwise("DE").alias("country"), F.lit(None).cast("string").alias("sector"), F.when(k % 22 == 6, F.array(F.lit("72000000"), F.lit(None))).when(k % 22 != 7, F.array(F.lit("72000000"))).alias("cpv_codes"),
        unless(14, 7, -1, F.col("n_chars")).cast("int").alias("budget_min_usd"), unless(16, 8, -5, F.lit(None)).cast("int").alias("budget_max_usd"), unless(20, 8, None, B.now()).alias("published_at"), unless(18, 9, "x", F.col("lang")).alias("language"),
    )


_FAILED = """v AS (SELECT doc_id, concat_ws(',', CASE WHEN doc_id % 21 = 1 THEN 'external_id' END, CASE WHEN doc_id % 10 = 3 OR text IS NULL OR text = '' THEN 'title' END, CASE WHEN doc_id % 23 = 2 OR text IS NULL THEN 'description' END,
  CASE WHEN source IS NULL OR source NOT IN ('src0', 'src1', 'src2', 'src3', 'src4', 'src5', 'src6', 'src7', 'src8', 'src9') THEN 'source' END, CASE WHEN doc_id % 15 = 4 THEN 'url' END, CASE WHEN doc_id % 25 = 5 THEN 'buyer' END, CASE WHEN doc_id % 12 = 5 THEN 'country' END, CASE WHEN doc_id % 22 = 6 THEN 'cpv_codes[1]' END,
  CASE WHEN doc_id % 14 = 7 THEN 'budget_min_usd' END, CASE WHEN doc_id % 16 = 8 THEN 'budget_max_usd' END, CASE WHEN doc_id % 20 = 8 THEN 'published_at' END, CASE WHEN doc_id % 18 = 9 OR lang IS NULL THEN 'language' END) AS failed FROM documents)"""
_SOURCES = [f"src{i}" for i in range(10)]


@query(f"WITH {_FAILED} SELECT doc_id FROM v WHERE failed = ''")
def validate_tenders(spark: SparkSession, d: str) -> DataFrame:
    return K.validate_tenders(_raw_tenders(spark, d), _SOURCES)[0].select("doc_id")


@query(f"WITH {_FAILED} SELECT doc_id, failed FROM v WHERE failed <> ''")
def validate_rejects(spark: SparkSession, d: str) -> DataFrame:
    return K.validate_tenders(_raw_tenders(spark, d), _SOURCES)[1].select("doc_id", F.array_join("failed", ",").alias("failed"))


_KINDS = ["Contract Award", "Invitation for Bids", "Specific Procurement Notice", "General Notice", "", "Request for Proposals", "Shortlist", "Invitation for Tenders"]
_KIND_SQL = "[" + ", ".join(f"'{k}'" for k in _KINDS) + "][o_orderkey % 8 + 1]"


def _with_kind(spark: SparkSession, d: str) -> DataFrame:
    return B.table(spark, d, "orders").withColumn("kind", F.element_at(F.array(*[F.lit(k) for k in _KINDS]), (F.col("o_orderkey") % 8 + 1).cast("int")))


@query(f"SELECT o_orderkey, {_KIND_SQL} IN ('Invitation for Bids', 'Specific Procurement Notice', '', 'Request for Proposals', 'Invitation for Tenders') AS is_open FROM orders")
def open_notice(spark: SparkSession, d: str) -> DataFrame:
    return _with_kind(spark, d).select("o_orderkey", S.is_open_notice(F.col("kind")).alias("is_open"))


@query(f"SELECT o_orderkey, {_KIND_SQL} IN ('Request for Proposals', 'Invitation for Tenders') AND o_orderstatus = 'O' AS biddable FROM orders")
def biddable(spark: SparkSession, d: str) -> DataFrame:
    state = F.when(F.col("o_orderstatus") == "O", "Open now").otherwise("Closed")
    return _with_kind(spark, d).select("o_orderkey", S.is_biddable(state, F.col("kind")).alias("biddable"))


@query("SELECT doc_id, contains(lower(coalesce(text, '')), 'winning bidder') OR doc_id % 9 = 0 AS awarded FROM documents")
def awarded_notice(spark: SparkSession, d: str) -> DataFrame:
    note = F.when(F.col("doc_id") % 9 == 0, "The Winning Bidder is known.")
    return B.table(spark, d, "documents").select("doc_id", S.looks_awarded(F.col("text"), note).alias("awarded"))


@query(f"WITH {B.TENDERS_SQL} SELECT tender_id, coalesce(deadline_at + INTERVAL 14 DAY < {_AT}, false) AS stale FROM t")
def stale_deadline(spark: SparkSession, d: str) -> DataFrame:
    return B.tenders(spark, d).select("tender_id", S.is_stale(F.col("deadline_at"), B.now()).alias("stale"))


# ---- keeping tables

_EVENT_KEY = ["event_type", "user_id"]


@query("SELECT event_type, user_id, arg_max(value, (ts, event_id)) AS value, max((ts, event_id)).event_id AS event_id, count(*) AS times FROM (SELECT event_type, user_id, value, {'ts': ts, 'event_id': event_id} AS o, ts, event_id FROM events) GROUP BY 1, 2".replace("arg_max(value, (ts, event_id))", "arg_max(value, o)").replace("max((ts, event_id)).event_id", "max(o).event_id"))
def last_write_wins(spark: SparkSession, d: str) -> DataFrame:
    e = B.table(spark, d, "events").select(*_EVENT_KEY, "value", "ts", "event_id")
    return K.last_write_wins(e, _EVENT_KEY, ["ts", "event_id"]).select(*_EVENT_KEY, "value", "event_id", F.col("_times").alias("times"))


def _event_states(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The table after the earlier half of all events, and the later half as a batch."""
    e = B.table(spark, d, "events").select(*_EVENT_KEY, "value", "ts", "event_id")
    old = K.last_write_wins(e.where("event_id % 2 = 0"), _EVENT_KEY, ["ts", "event_id"]).drop("_times")
    ready = old.withColumns({"embedding_status": F.lit("ready"), "ingested_at": F.lit("1997-01-01").cast("timestamp")})
    return ready, e.where("event_id % 2 = 1")


@query(f"""WITH o AS (SELECT event_type, user_id, arg_max(value, {{'ts': ts, 'event_id': event_id}}) AS value FROM events WHERE event_id % 2 = 0 GROUP BY 1, 2),
n AS (SELECT event_type, user_id, arg_max(value, {{'ts': ts, 'event_id': event_id}}) AS value FROM events WHERE event_id % 2 = 1 GROUP BY 1, 2)
SELECT coalesce(o.event_type, n.event_type) AS event_type, coalesce(o.user_id, n.user_id) AS user_id, CASE WHEN n.user_id IS NULL THEN o.value ELSE n.value END AS value, CASE WHEN o.user_id IS NULL THEN 'pending' ELSE 'ready' END AS embedding_status,
  CASE WHEN o.user_id IS NULL THEN {_AT} ELSE TIMESTAMP '1997-01-01' END AS ingested_at, CASE WHEN o.user_id IS NULL THEN 'inserted' WHEN n.user_id IS NULL THEN 'kept' ELSE 'updated' END AS change
FROM o FULL JOIN n ON o.event_type = n.event_type AND o.user_id = n.user_id""")
def upsert_tenders(spark: SparkSession, d: str) -> DataFrame:
    current, batch = _event_states(spark, d)
    return K.upsert(current, batch, _EVENT_KEY, ["value", "ts", "event_id"], ["ts", "event_id"], B.now()).drop("ts", "event_id")


@query("""WITH o AS (SELECT DISTINCT event_type, user_id FROM events WHERE event_id % 2 = 0), n AS (SELECT DISTINCT event_type, user_id FROM events WHERE event_id % 2 = 1 AND value >= 100),
x AS (SELECT n.event_type, o.user_id IS NULL AS is_new, 0 AS errors, false AS bad FROM n LEFT JOIN o ON o.event_type = n.event_type AND o.user_id = n.user_id UNION ALL SELECT event_type, NULL, 1 + (user_id % 2 = 0)::INT, true FROM events WHERE event_id % 2 = 1 AND NOT coalesce(value >= 100, false))
SELECT event_type, count(*) AS fetched, count(*) FILTER (is_new AND NOT bad) AS inserted, count(*) FILTER (NOT is_new AND NOT bad) AS updated, count(*) FILTER (bad) AS skipped, CAST(sum(errors) AS BIGINT) AS errors FROM x GROUP BY 1""")
def ingest_summary(spark: SparkSession, d: str) -> DataFrame:
    current, batch = _event_states(spark, d)
    fits = F.coalesce(F.col("value") >= 100, F.lit(False))
    rejects = batch.where(~fits).withColumn("failed", F.when(F.col("user_id") % 2 == 0, F.array(F.lit("value"), F.lit("user"))).otherwise(F.array(F.lit("value"))))
    changes = K.upsert(current, batch.where(fits), _EVENT_KEY, ["value", "ts", "event_id"], ["ts", "event_id"], B.now())
    return K.ingest_summary(changes, "event_type", rejects)


@query(f"""WITH c AS (SELECT DISTINCT 'src' || n_nationkey AS source FROM nation), s AS (SELECT 'src' || (user_id % 20) AS source, max(ts) AS last FROM events GROUP BY 1)
SELECT source, coalesce(least(last, TIMESTAMP '2024-01-10'), TIMESTAMP '2024-01-10' - INTERVAL 14 DAY) - INTERVAL 45 DAY AS since FROM c LEFT JOIN s USING (source)""")
def since_cutoff(spark: SparkSession, d: str) -> DataFrame:
    catalog = B.table(spark, d, "nation").select(F.concat(F.lit("src"), F.col("n_nationkey").cast("string")).alias("source"))
    seen = B.table(spark, d, "events").select(F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string")).alias("source"), F.col("ts").alias("ingested_at"))
    return K.since_cutoff(catalog, seen, F.lit("2024-01-10").cast("timestamp"))


@query(f"WITH {B.TENDERS_SQL}, {B.MATCHES_SQL} SELECT tenant_id, count(*) FILTER (country <> 'CH') AS n_left, count(*) FILTER (country = 'CH') AS deleted FROM m JOIN t USING (tender_id) GROUP BY 1")
def purge_awarded(spark: SparkSession, d: str) -> DataFrame:
    _, left, gone = K.purge(B.tenders(spark, d), B.matches(spark, d), F.col("country") == "CH")
    both = left.select("tenant_id", F.lit(1).alias("l"), F.lit(0).alias("g")).unionByName(gone.select("tenant_id", F.lit(0).alias("l"), F.lit(1).alias("g")))
    return both.groupBy("tenant_id").agg(F.sum("l").alias("n_left"), F.sum("g").alias("deleted"))


@query("SELECT DISTINCT source FROM documents WHERE source IS NOT NULL AND source NOT IN (SELECT 'src' || r_regionkey FROM region)")
def uncatalogued_sources(spark: SparkSession, d: str) -> DataFrame:
    catalog = B.table(spark, d, "region").select(F.concat(F.lit("src"), F.col("r_regionkey").cast("string")).alias("source"))
    return K.uncatalogued(B.table(spark, d, "documents"), catalog)


@query("""WITH e AS (SELECT vec_id AS id, sha256('m:1|' || label || '|' || vec_id % 3) AS new_hash, sha256('m:1|' || label || '|' || vec_id % 2) AS old_hash FROM embeddings) SELECT id FROM e WHERE id % 9 = 0 OR new_hash <> old_hash""")
def pending_embeddings(spark: SparkSession, d: str) -> DataFrame:
    k, label = F.col("vec_id"), F.col("label").cast("string")
    rows = B.table(spark, d, "embeddings").select(k.alias("id"), P.content_hash("m:1", label, (k % 3).cast("string")).alias("new_hash"), P.content_hash("m:1", label, (k % 2).cast("string")).alias("embedding_hash"), F.when(k % 9 == 0, "pending").otherwise("ready").alias("embedding_status"), F.lit("m:1").alias("embedding_model"))
    return K.pending_embeddings(rows, F.col("new_hash"), "m:1").select("id")


@query("SELECT label, CASE WHEN vec_id % 4 = 0 THEN 'ready' WHEN vec_id % 4 = 1 THEN 'failed' ELSE 'pending' END AS embedding_status, count(*) AS n FROM embeddings GROUP BY 1, 2")
def write_embeddings(spark: SparkSession, d: str) -> DataFrame:
    e, k = B.table(spark, d, "embeddings"), F.col("vec_id")
    rows = e.select(k.alias("id"), "label", F.lit(None).cast("array<float>").alias("embedding"), F.lit("pending").alias("embedding_status"), F.lit(None).cast("string").alias("embedding_hash"), F.lit(None).cast("string").alias("embedding_model"))
    vectors = e.where("vec_id % 4 < 2").select(k.alias("id"), F.when(k % 4 == 0, F.col("embedding")).alias("vector"), F.lit("h").alias("hash"))
    return K.write_embeddings(rows, vectors, "m:1", 64).groupBy("label", "embedding_status").agg(F.count("*").alias("n"))


# ---- texts and pages

@query("""WITH x AS (SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS x FROM pages)
SELECT page_id, sha256(replace(replace(replace(replace(replace(replace(replace(x, '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&apos;', chr(39)), '&nbsp;', ' ')) AS h FROM x""")
def strip_tags(spark: SparkSession, d: str) -> DataFrame:
    return B.table(spark, d, "pages").select("page_id", F.sha2(T.strip_tags(F.col("html")), 256).alias("h"))


@query("""WITH x AS (SELECT page_id, regexp_replace(regexp_replace(html, '</?(?:p|div|tr|li|h[1-6]|br)(?:[\\s/][^>]*)?>', chr(10), 'gi'), '<[^>]+>', '', 'g') AS x FROM pages),
y AS (SELECT page_id, replace(replace(replace(replace(replace(replace(replace(replace(x, '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&ndash;', '–'), '&mdash;', '—') AS x FROM x)
SELECT page_id, sha256(regexp_replace(regexp_replace(x, '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')) AS h FROM y""")
def html_to_text(spark: SparkSession, d: str) -> DataFrame:
    return B.table(spark, d, "pages").select("page_id", F.sha2(T.html_to_text(F.col("html")), 256).alias("h"))


@query("""WITH x AS (SELECT page_id, nullif(regexp_extract(html, 'href\\s*=\\s*["'']([^"'']+)["'']', 1, 'i'), '') AS u FROM pages)
SELECT page_id, CASE WHEN u LIKE 'http:%' OR u LIKE 'https:%' THEN u WHEN u LIKE '/%' THEN 'https://x.org' || u ELSE 'https://x.org/' || u END AS url FROM x""")
def first_link(spark: SparkSession, d: str) -> DataFrame:
    return B.table(spark, d, "pages").select("page_id", T.absolutize(T.first_link(F.col("html")), "https://x.org").alias("url"))


@query("""WITH p AS (SELECT page_id, regexp_split_to_array(html, '<p[^>]*>') AS b FROM pages) SELECT page_id, unnest(range(0, len(b) - 1)) AS block, unnest(list_transform(b[2:], lambda x: length(x))) AS size FROM p WHERE len(b) > 1""")
def split_blocks(spark: SparkSession, d: str) -> DataFrame:
    found = H.split_blocks(B.table(spark, d, "pages"), "<p([^>]*)>")
    return found.select("page_id", F.col("block").cast("long").alias("block"), F.length("body").cast("long").alias("size"))


_ANCHOR = """'<a\\b[^>]*href="([^"]*)"[^>]*>((?s:.)*?)</a>'"""


@query(f"""WITH a AS (SELECT page_id, regexp_extract_all(html, {_ANCHOR}, 1) AS h, regexp_extract_all(html, {_ANCHOR}, 2) AS t FROM pages), u AS (SELECT page_id, unnest(h) AS href, unnest(t) AS t, unnest(range(len(h))) AS pos FROM a),
x AS (SELECT page_id, href, pos, trim(regexp_replace(regexp_replace(t, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS x FROM u),
y AS (SELECT page_id, href, pos, replace(replace(replace(replace(replace(replace(replace(x, '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&apos;', chr(39)), '&nbsp;', ' ') AS title FROM x)
SELECT page_id, href, arg_min(title, pos) AS title FROM y WHERE title <> '' GROUP BY 1, 2""")
def anchor_blocks(spark: SparkSession, d: str) -> DataFrame:
    found = H.first_of_page(H.extract_anchor_blocks(B.table(spark, d, "pages"), before=600, after=2000), "href")
    return found.select("page_id", "href", "title")


@query("""SELECT c_custkey AS page_id, 0 AS "row", c_name || '|' || c_mktsegment || '|R & D' AS cells FROM customer UNION ALL SELECT c_custkey, 2, CAST(c_nationkey AS VARCHAR) FROM customer""")
def table_rows(spark: SparkSession, d: str) -> DataFrame:
    html = F.concat(F.lit("<table><TR class='x'><td>"), F.col("c_name"), F.lit("</td>\n<td> <b>"), F.col("c_mktsegment"), F.lit("</b></td><th>R &amp; D</th></TR><tr> </tr><tr><td>"), F.col("c_nationkey").cast("string"), F.lit("</td></tr></table>"))
    rows = H.extract_table_rows(B.table(spark, d, "customer").select(F.col("c_custkey").alias("page_id"), html.alias("html")))
    return rows.select("page_id", "row", F.array_join("cells", "|").alias("cells"))


@query()
def chunk_text(spark: SparkSession, d: str) -> DataFrame:
    """No SQL: recursive cuts; tests hold it against a restatement."""
    docs = B.table(spark, d, "documents").select("doc_id", "text", F.explode(chunks_of(F.col("text"))).alias("c"))
    return docs.select("doc_id", F.col("c.start").alias("start"), F.col("c.end").alias("end"), (F.substring(F.col("text"), F.col("c.start") + 1, F.col("c.end") - F.col("c.start")) == F.col("c.text")).alias("same"))


@query("""SELECT doc_id, sha256('p:m|Title: ' || left(text, 80) || chr(10) || 'Buyer: ' || source || chr(10) || 'Sector: (unspecified)' || chr(10) || 'Country: ' || upper(lang) || chr(10) || 'CPV: (none)|' || text) AS h,
  CAST(length(left('Title: ' || left(text, 80) || chr(10) || 'Buyer: ' || source || chr(10) || 'Sector: (unspecified)' || chr(10) || 'Country: ' || upper(lang) || chr(10) || 'CPV: (none)' || chr(10) || 'Description: ' || left(text, CAST(greatest(200, 5984 - length('Title: ' || left(text, 80) || chr(10) || 'Buyer: ' || source || chr(10) || 'Sector: (unspecified)' || chr(10) || 'Country: ' || upper(lang) || chr(10) || 'CPV: (none)')) AS BIGINT)), 6000)) AS INT) AS n
  FROM documents""")
def content_hash(spark: SparkSession, d: str) -> DataFrame:
    header = P.tender_header(F.substring("text", 1, 80), F.col("source"), F.lit(None).cast("string"), F.upper("lang"), F.array().cast("array<string>"))
    return B.table(spark, d, "documents").select("doc_id", P.content_hash("p:m", header, F.col("text")).alias("h"), F.length(P.flatten_tender(header, F.col("text"))).alias("n"))


@query("SELECT page_id, left(sha256('src:' || left(html, 40) || ':' || url), 24) AS id FROM pages")
def stable_id(spark: SparkSession, d: str) -> DataFrame:
    return B.table(spark, d, "pages").select("page_id", T.stable_id(F.lit("src"), F.substring("html", 1, 40), F.col("url")).alias("id"))


@query()
def unique_slug(spark: SparkSession, d: str) -> DataFrame:
    """No SQL: which slug is free depends on all rows before; tests hold it against the rule, row by row."""
    name = F.concat_ws(" & ", "c_mktsegment", F.when(F.col("c_nationkey") > 1, F.col("c_nationkey").cast("string")))
    taken = B.table(spark, d, "nation").select(F.concat(F.lit("building-"), F.col("n_nationkey").cast("string")).alias("slug")).where("slug like '%2'")
    return unique_slugs(B.table(spark, d, "customer").select("c_custkey", T.slugify(name).alias("slug")), "slug", ["c_custkey"], taken)


def _dates(portal: str, shown: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return B.table(spark, d, "orders").select("o_orderkey", V.parse_date(F.date_format("o_orderdate", shown), portal).alias("at"))

    run.__name__ = f"parse_date_{portal}"
    return run


for _portal, _shown, _hours in (("loose", "MMM d, yyyy h:mm a", 0.0), ("ppra", "MMMM d, yyyy h:mm a", 5.0), ("punjab", "dd/MM/yyyy", 5.0), ("austender", "d-MMM-yyyy h:mm a", 10.0), ("gem", "dd-MM-yyyy", None), ("gebiz", "dd MMM yyyy hh:mma", 8.0), ("ecepp", "dd/MM/yyyy HH:mm", 0.0), ("jica", "yyyy/MM/dd", 0.0), ("iadb", "MMM. d yyyy", 0.0), ("iso", "yyyy-MM-dd'T'HH:mm", 0.0)):
    if _hours is not None:
        query(f"SELECT o_orderkey, date_trunc('minute', o_orderdate) - INTERVAL {int(_hours * 60)} MINUTE AS at FROM orders".replace("date_trunc('minute', o_orderdate)", "date_trunc('minute', o_orderdate)" if "m" in _shown.replace("MMM", "") else "date_trunc('day', o_orderdate)"))(_dates(_portal, _shown))


# ---- feeds

def _releases(spark: SparkSession, d: str) -> DataFrame:
    """One release package per customer and its orders."""
    k = F.col("o_orderkey")
    cls = lambda id_: F.struct(F.lit("CPV").alias("scheme"), id_.alias("id"))
    value = F.struct(F.col("o_totalprice").alias("amount"), F.lit("GBP").alias("currency"))
    tender = F.struct(F.concat(F.lit(" Order "), k.cast("string")).alias("title"), F.col("o_orderpriority").alias("description"), value.alias("value"), cls(F.concat(F.lit("c"), (k % 9).cast("string"))).alias("classification"), F.array(cls(F.concat(F.lit("c"), (k % 5).cast("string"))), cls(F.lit("c3"))).alias("additionalClassifications"))
    party = F.struct(F.lit("Ministry").alias("name"), F.array(F.when(k % 2 == 0, "buyer").otherwise("supplier")).alias("roles"), F.struct(F.lit("Germany").alias("countryName")).alias("address"))
    release = F.struct(k.cast("string").alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date"), F.array(party).alias("parties"), F.when(k % 11 != 0, tender).alias("tender"))
    return B.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("page")).agg(F.to_json(F.struct(F.collect_list(release).alias("releases"))).alias("payload"))


def _columns(df: DataFrame) -> DataFrame:
    """All columns of common rows, codes as text, without the raw payload."""
    return df.withColumn("cpv_codes", F.array_join("cpv_codes", ",")).drop("raw")


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS external_id, 'uk_find_a_tender' AS source, 'Order ' || o_orderkey AS title, o_orderpriority AS description, 'https://x.org/notice/' || o_orderkey AS url, CASE WHEN o_orderkey % 2 = 0 THEN 'Ministry' ELSE 'UK Government' END AS buyer, CASE WHEN o_orderkey % 2 = 0 THEN 'DE' ELSE 'GB' END AS country, 'c' || o_orderkey % 9 AS sector,
  array_to_string(list_filter(['c' || o_orderkey % 9, CASE WHEN o_orderkey % 5 <> o_orderkey % 9 THEN 'c' || o_orderkey % 5 END, CASE WHEN o_orderkey % 5 <> 3 AND o_orderkey % 9 <> 3 THEN 'c3' END], lambda x: x IS NOT NULL), ',') AS cpv_codes,
  CAST(floor(o_totalprice * 1.27 + 0.5) AS INT) AS budget_min_usd, CAST(floor(o_totalprice * 1.27 + 0.5) AS INT) AS budget_max_usd, 'GBP' AS currency, date_trunc('second', o_orderdate) AS published_at, NULL::TIMESTAMP AS deadline_at, 'en' AS language FROM orders WHERE o_orderkey % 11 <> 0""")
def read_ocds(spark: SparkSession, d: str) -> DataFrame:
    return _columns(S.read_ocds(_releases(spark, d), "uk_find_a_tender", "https://x.org/notice/{id}", B.now()))


def _bank(spark: SparkSession, d: str) -> DataFrame:
    """World Bank pages by customer: lists and maps in turn."""
    k = F.col("o_orderkey")
    doc = F.struct(k.cast("string").alias("id"), F.when(k % 4 != 0, F.concat(F.lit("Project "), k.cast("string"))).alias("project_name"), F.when(k % 10 != 0, F.lit("Works")).alias("bid_description"), F.when(k % 3 == 0, F.lit("RFB")).alias("procurement_method"), F.when(k % 7 == 0, F.lit("https://x.org/1")).alias("url"), F.lit("x").alias("project_ctry_name"), F.when(k % 2 == 0, F.lit("2-Mar-1998")).alias("deadline_date"), F.lit("1-Jan-1990").alias("submission_date"), F.col("kind").alias("notice_type"), F.when(k % 21 == 0, "names the awarded bidder").when(k % 5 != 0, "text").alias("notice_text"), F.date_format("o_orderdate", "dd-MMM-yyyy").alias("notice_date"), F.lit("ke").alias("project_ctry_code"), F.col("o_totalprice").cast("string").alias("total_contract_amount"))
    pages = _with_kind(spark, d).groupBy(F.col("o_custkey").alias("page")).agg(F.collect_list(doc).alias("l"))
    as_map = F.map_from_entries(F.transform("l", lambda x: F.struct(x["id"], x)))
    return pages.select("page", F.when(F.col("page") % 2 == 0, F.to_json(F.struct(F.col("l").alias("procnotices")))).otherwise(F.to_json(F.struct(as_map.alias("procnotices")))).alias("payload"))


@query(f"""SELECT CAST(o_orderkey AS VARCHAR) AS external_id, 'world_bank' AS source, CASE WHEN o_orderkey % 4 <> 0 THEN 'Project ' || o_orderkey WHEN o_orderkey % 10 <> 0 THEN 'Works' ELSE 'World Bank Procurement Notice' END AS title, CASE WHEN o_orderkey % 5 <> 0 THEN 'text' WHEN o_orderkey % 10 <> 0 THEN 'Works' ELSE '' END AS description,
  CASE WHEN o_orderkey % 7 = 0 THEN 'https://x.org/1' ELSE 'https://projects.worldbank.org/en/projects-operations/procurement-detail/' || o_orderkey END AS url, CASE WHEN o_orderkey % 4 <> 0 THEN 'Project ' || o_orderkey ELSE 'World Bank' END AS buyer, 'KE' AS country, CASE WHEN o_orderkey % 3 = 0 THEN 'RFB' ELSE {_KIND_SQL} END AS sector, '' AS cpv_codes,
  CAST(floor(o_totalprice + 0.5) AS INT) AS budget_min_usd, CAST(floor(o_totalprice + 0.5) AS INT) AS budget_max_usd, 'USD' AS currency, date_trunc('day', o_orderdate) AS published_at, CASE WHEN o_orderkey % 2 = 0 THEN TIMESTAMP '1998-03-02' END AS deadline_at, 'en' AS language FROM orders
WHERE o_orderkey % 21 <> 0 AND {_KIND_SQL} IN ('Invitation for Bids', 'Specific Procurement Notice', '', 'Request for Proposals', 'Invitation for Tenders') AND date_trunc('day', o_orderdate) >= TIMESTAMP '1996-01-01'""")
def read_world_bank(spark: SparkSession, d: str) -> DataFrame:
    return _columns(S.read_world_bank(_bank(spark, d), B.now(), F.lit("1996-01-01").cast("timestamp")))


def _json_pages(rows: DataFrame, notice, name: str) -> DataFrame:
    return rows.groupBy(F.col("o_custkey").alias("page")).agg(F.to_json(F.struct(F.collect_list(notice).alias(name))).alias("payload"))


@query(f"""SELECT CAST(o_orderkey AS VARCHAR) AS external_id, 'sam_gov' AS source, 'Order ' || o_orderkey AS title, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderpriority END AS description, CASE WHEN o_orderkey % 2 = 0 THEN 'https://sam.gov/x' ELSE 'https://sam.gov/opp/' || o_orderkey || '/view' END AS url, CASE WHEN o_orderkey % 5 = 0 THEN 'US Federal Government' ELSE o_orderstatus END AS buyer, 'US' AS country,
  CASE WHEN o_orderkey % 4 = 0 THEN 'Z2' ELSE '5415' END AS sector, '' AS cpv_codes, CASE WHEN o_orderkey % 6 > 1 THEN CAST(floor(o_totalprice + 0.5) AS INT) WHEN o_orderkey % 6 = 1 THEN 12 END AS budget_min_usd, CASE WHEN o_orderkey % 6 > 1 THEN CAST(floor(o_totalprice + 0.5) AS INT) WHEN o_orderkey % 6 = 1 THEN 12 END AS budget_max_usd, 'USD' AS currency,
  CASE WHEN o_orderkey % 9 = 0 THEN {_AT} ELSE date_trunc('day', o_orderdate) END AS published_at, CASE WHEN o_orderkey % 2 = 0 THEN TIMESTAMP '1998-02-01 17:00:00' END AS deadline_at, 'en' AS language FROM orders""")
def read_sam(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    amount = F.when(k % 6 > 1, F.concat(F.col("o_totalprice").cast("string"), F.lit(" dollars"))).when(k % 6 == 1, "12,500").otherwise("none")
    notice = F.struct(k.cast("string").alias("noticeId"), F.concat(F.lit("Order "), k.cast("string")).alias("title"), F.when(k % 3 != 0, F.col("o_orderpriority")).alias("description"), F.when(k % 2 == 0, "https://sam.gov/x").alias("uiLink"), F.when(k % 5 != 0, F.col("o_orderstatus")).alias("fullParentPathName"), F.when(k % 4 != 0, "5415").alias("naicsCode"), F.lit("Z2").alias("classificationCode"), F.struct(amount.alias("amount")).alias("award"), F.when(k % 9 != 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("postedDate"), F.when(k % 2 == 0, "1998-02-01T12:00:00-05:00").alias("responseDeadLine"))
    return _columns(S.read_sam(_json_pages(B.table(spark, d, "orders"), notice, "opportunitiesData"), B.now()))


@query(f"""SELECT 'n/' || o_orderkey AS external_id, 'ted_eu' AS source, CASE o_orderkey % 3 WHEN 0 THEN 'T' ELSE 'E' END || o_orderkey AS title, '' AS description, CASE WHEN o_orderkey % 2 = 0 THEN 'https://t.eu/' || o_orderkey ELSE 'https://ted.europa.eu/en/notice/-/detail/n%2F' || o_orderkey END AS url, CASE WHEN o_orderkey % 5 = 0 THEN 'EU Buyer' ELSE o_orderpriority END AS buyer, 'BE' AS country,
  '72000000' AS sector, '72000000' || CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE ',72' || o_orderkey % 10 END AS cpv_codes, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(floor(o_totalprice * 1.08 + 0.5) AS INT) END AS budget_min_usd, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(floor(o_totalprice * 1.08 + 0.5) AS INT) END AS budget_max_usd, CASE WHEN o_orderkey % 7 <> 0 THEN 'EUR' END AS currency,
  date_trunc('day', o_orderdate) AS published_at, TIMESTAMP '1998-02-01' AS deadline_at, 'en' AS language FROM orders""")
def read_ted(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    as_json = lambda *fields: F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}"))
    said = lambda name, value: F.concat(F.lit(f'"{name}":'), value)
    quoted = lambda *parts: F.concat(F.lit('"'), *parts, F.lit('"'))
    number = k.cast("string")
    money = F.concat(F.lit('{"amount":'), F.col("o_totalprice").cast("string"), F.lit(',"currency":"EUR"}'))
    notice = as_json(
        said("publication-number", quoted(F.lit("n/"), number)), said("title", F.when(k % 3 == 0, quoted(F.lit("T"), number)).otherwise(F.concat(F.lit('{"fra":"f","eng":"E'), number, F.lit('"}')))), F.when(k % 5 != 0, said("buyer-name", F.concat(F.lit("["), quoted(F.col("o_orderpriority")), F.lit(',"z"]')))),
        said("buyer-country", F.lit('["BEL"]')), said("classification-cpv", F.when(k % 4 == 0, F.lit('"72000000"')).otherwise(F.concat(F.lit('["72000000","72'), (k % 10).cast("string"), F.lit('"]')))), F.when(k % 7 != 0, said("estimated-value-lot", F.when(k % 2 == 0, money).otherwise(F.concat(F.lit("["), money, F.lit("]"))))),
        said("publication-date", quoted(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("+01:00"))), said("deadline-receipt-tender-date-lot", F.lit('["1998-02-01"]')), F.when(k % 2 == 0, said("links", F.concat(F.lit('{"html":{"fra":"x","eng":"https://t.eu/'), number, F.lit('"}}')))),
    )
    pages = B.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("page")).agg(F.concat(F.lit('{"notices":['), F.array_join(F.collect_list(notice), ","), F.lit("]}")).alias("payload"))
    return _columns(S.read_ted(pages, B.now()))


@query(f"""SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'g' || o_orderkey ELSE 'https://u.org/' || o_orderkey END AS external_id, 'undp' AS source, 'Roads & ' || o_orderkey AS title, CASE WHEN o_orderkey % 3 = 0 THEN 'Roads & ' || o_orderkey ELSE 'about ' || o_orderpriority END AS description, 'https://u.org/' || o_orderkey AS url, 'UNDP' AS buyer, NULL::VARCHAR AS country, 'UNDP Procurement Notice' AS sector, '' AS cpv_codes,
  NULL::INT AS budget_min_usd, NULL::INT AS budget_max_usd, NULL::VARCHAR AS currency, pub AS published_at, NULL::TIMESTAMP AS deadline_at, 'en' AS language
FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r, CASE WHEN o_orderkey % 5 = 0 THEN {_AT} ELSE date_trunc('second', o_orderdate) - to_minutes(CASE o_orderkey % 7 WHEN 1 THEN 180 WHEN 2 THEN -300 WHEN 3 THEN -330 ELSE 0 END) END AS pub FROM orders) WHERE o_orderkey % 11 <> 0 AND r <= 100 AND pub >= TIMESTAMP '1996-01-01'""")
def read_undp(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    number = k.cast("string")
    tag = lambda name, *parts: F.concat(F.lit(f"<{name}>"), *parts, F.lit(f"</{name}>"))
    at = F.date_format("o_orderdate", "EEE, dd MMM yyyy HH:mm:ss")
    shown = F.when(k % 7 == 1, F.concat(at, F.lit(" +0300"))).when(k % 7 == 2, F.concat(at, F.lit(" EST"))).when(k % 7 == 3, F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("-05:30"))).otherwise(F.concat(at, F.lit(" GMT")))
    item = F.concat(F.lit("<item>"), F.when(k % 11 != 0, tag("title", F.lit("<![CDATA[Roads &amp; "), number, F.lit("]]>"))).otherwise(""), tag("link", F.lit("https://u.org/"), number), F.when(k % 3 != 0, tag("description", F.lit("&lt;b&gt;about&lt;/b&gt; "), F.col("o_orderpriority"))).otherwise(""),
                    F.when(k % 5 != 0, tag("pubDate", shown)).otherwise(""), F.when(k % 2 == 0, tag("guid", F.lit("g"), number)).otherwise(""), F.lit("</item>"))
    items = F.transform(F.array_sort(F.collect_list(F.struct(k.alias("k"), item.alias("x")))), lambda x: x["x"])
    pages = B.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("page")).agg(F.concat(F.lit("<rss><channel>"), F.array_join(items, ""), F.lit("</channel></rss>")).alias("payload"))
    return _columns(S.read_undp(pages, B.now(), F.lit("1996-01-01").cast("timestamp")))


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_name WHEN 1 THEN c_name WHEN 2 THEN 'E ' || c_name ELSE 'F ' || c_name END AS picked, CASE WHEN c_custkey % 4 = 1 THEN c_name || ',z' WHEN c_custkey % 4 = 0 THEN c_name END AS listed FROM customer""")
def pick_localized(spark: SparkSession, d: str) -> DataFrame:
    k, n = F.col("c_custkey") % 4, F.col("c_name")
    as_map = lambda *kv: F.to_json(F.create_map(*kv))
    value = F.when(k == 0, n).when(k == 1, F.to_json(F.array(n, F.lit("z")))).when(k == 2, as_map(F.lit("fra"), n, F.lit("eng"), F.concat(F.lit("E "), n))).otherwise(as_map(F.lit("fra"), F.concat(F.lit("F "), n), F.lit("deu"), n))
    return B.table(spark, d, "customer").select("c_custkey", V.pick_localized(value).alias("picked"), F.when(k < 2, F.array_join(V.to_string_array(value), ",")).alias("listed"))


# ---- profiles and schedules

@query("""WITH s AS (SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN ['cloud', 'ISO 27001', 'Cloud', repeat('x', 90)] ELSE [' erp ', ''] END AS t FROM supplier)
SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'cloud OR "ISO 27001" OR ' || s_name ELSE 'erp OR ' || s_name END AS q FROM supplier""")
def build_query(spark: SparkSession, d: str) -> DataFrame:
    terms = F.when(F.col("s_suppkey") % 2 == 0, F.array(F.lit("cloud"), F.lit("ISO 27001"), F.lit("Cloud"), F.lit("x" * 90))).otherwise(F.array(F.lit(" erp "), F.lit("")))
    words = P.distinct_terms(P.profile_keywords(terms, F.array("s_name")))
    return B.table(spark, d, "supplier").select("s_suppkey", P.build_query(words).alias("q"))


@query("""SELECT s_suppkey, 'Company: ' || s_name || chr(10) || 'One-liner: makes things' || chr(10) || 'Services: (none)' || chr(10) || 'Tech stack: a, b' || chr(10) || 'Industries: (none)' || chr(10) || 'Certifications: (none)' || chr(10) || 'Past clients: (none)' || chr(10)
  || 'Past projects:' || chr(10) || '- Bridge (steel): built' || chr(10) || CASE WHEN s_suppkey % 3 = 0 THEN '' WHEN s_suppkey % 3 = 1 THEN 'Geographies: global / unspecified' || chr(10) ELSE 'Geographies: DE' || chr(10) END
  || 'Team size: ' || (s_suppkey % 40) || chr(10) || 'Budget range USD: 0-5' || chr(10) || 'Languages: en' AS text FROM supplier""")
def flatten_profile(spark: SparkSession, d: str) -> DataFrame:
    k, none = F.col("s_suppkey"), F.array().cast("array<string>")
    project = F.struct(F.lit("Bridge").alias("title"), F.lit("built").alias("summary"), F.lit("steel").alias("sector"))
    p = {"company_name": F.col("s_name"), "one_liner": F.lit("makes things"), "services": none, "tech_stack": F.array(F.lit("a"), F.lit("b")), "industries": none, "certifications": none, "past_clients": none, "past_projects": F.array(project),
         "ignore_location": k % 3 == 0, "geographies": F.when(k % 3 == 2, F.array(F.lit("DE"))).otherwise(none), "team_size": k % 40, "budget_min_usd": F.lit(0), "budget_max_usd": F.lit(5), "languages": F.array(F.lit("en"))}
    return B.table(spark, d, "supplier").select("s_suppkey", P.flatten_profile(F.struct(*[v.alias(n) for n, v in p.items()])).alias("text"))


_DUE_AT = "1998-01-08 07:30:00"


@query("""WITH s AS (SELECT c_custkey AS k, ['daily', 'weekdays', 'every_n_days', 'weekly', 'monthly'][c_custkey % 5 + 1] AS f, c_custkey % 6 + 1 AS n, c_custkey % 12 AS h, c_custkey % 12 + 6 AS e, CASE WHEN c_custkey % 13 <> 0 THEN c_custkey % 7 END AS dow,
  CASE WHEN c_custkey % 17 <> 0 THEN c_custkey % 31 + 1 END AS dom, (c_custkey // 5) % 5 AS z, CASE WHEN c_custkey % 3 <> 0 THEN TIMESTAMP '1998-01-07 10:00:00' - to_hours(CAST(c_custkey % 900 AS INT)) END AS sent FROM customer WHERE c_custkey % 19 <> 0),
l AS (SELECT *, TIMESTAMP '1998-01-08 07:30:00' + CASE z WHEN 2 THEN INTERVAL 5 HOUR WHEN 3 THEN -INTERVAL 5 HOUR ELSE INTERVAL 0 HOUR END AS loc, sent + CASE z WHEN 2 THEN INTERVAL 5 HOUR WHEN 3 THEN -INTERVAL 5 HOUR ELSE INTERVAL 0 HOUR END AS sloc FROM s WHERE z <> 4)
SELECT k AS tenant_id, f AS frequency FROM l WHERE hour(loc) BETWEEN h AND e AND CASE f WHEN 'weekdays' THEN dayofweek(loc) BETWEEN 1 AND 5 WHEN 'weekly' THEN dow = dayofweek(loc) WHEN 'monthly' THEN least(dom, 31) = day(loc) ELSE true END
  AND (sent IS NULL OR (date_diff('second', sent, TIMESTAMP '1998-01-08 07:30:00') >= CASE f WHEN 'daily' THEN 79200 WHEN 'weekdays' THEN 79200 WHEN 'weekly' THEN 518400 WHEN 'monthly' THEN 2332800 ELSE n * 86400 - 1800 END AND (f NOT IN ('daily', 'weekdays') OR CAST(sloc AS DATE) <> CAST(loc AS DATE))))""")
def due_schedules(spark: SparkSession, d: str) -> DataFrame:
    zones = spark.createDataFrame([("UTC",), ("Asia/Karachi",), ("America/New_York",)], "timezone string")
    return R.is_due(B.schedules(spark, d), zones, F.lit(_DUE_AT).cast("timestamp")).select("tenant_id", "frequency")


@query("""SELECT s_suppkey, unnest(CASE WHEN s_suppkey % 3 = 0 THEN ['ops@x.org'] ELSE [s_name || '@a.org', 'b@b.org'][1 : s_suppkey % 3] END) AS recipient FROM supplier""")
def digest_deliveries(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    to = F.slice(F.array(F.concat(F.col("s_name"), F.lit("@a.org")), F.lit("b@b.org")), F.lit(1), (k % 3).cast("int"))
    return R.digest_deliveries(B.table(spark, d, "supplier").select("s_suppkey", to.alias("recipients")), "ops@x.org")


@query("SELECT c_custkey AS tenant_id, CASE WHEN c_custkey % 12 = 4 THEN least(23, c_custkey % 12 + 2) ELSE c_custkey % 12 + 6 END AS hour_local_end FROM customer")
def widen_window(spark: SparkSession, d: str) -> DataFrame:
    return K.widen_window(B.schedules(spark, d)).select("tenant_id", F.col("hour_local_end").cast("long").alias("hour_local_end"))


@query("SELECT s_suppkey AS tenant_id, s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 45) AS has_profile FROM supplier")
def tenants_with_profile(spark: SparkSession, d: str) -> DataFrame:
    known = B.table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_suppkey").alias("tenant_id"))
    return K.tenants_with_profile(B.table(spark, d, "supplier").select(F.col("s_suppkey").alias("tenant_id")), known)


# ---- streams, over files that landed

@query("SELECT event_type, count(*) AS n FROM (SELECT DISTINCT event_type, user_id FROM events) GROUP BY 1")
def stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    from ..streaming.ingest import dedup_notices

    stream = spark.readStream.schema(B.table(spark, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(d)
    stream = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    return _landed(dedup_notices(stream, "ts", _EVENT_KEY), "dedup").groupBy("event_type").agg(F.count("*").alias("n"))


def _landed(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over all that has landed, and read its table."""
    spark, folder = stream.sparkSession, new_path(stream.sparkSession, "stream")
    run = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/{name}").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/{name}")


def _arriving(spark: SparkSession, d: str, folder: str) -> DataFrame:
    """All events as files that arrive one after the other, a micro-batch each, in no order of time."""
    events = B.table(spark, d, "events").select(*_EVENT_KEY, "value", "ts", "event_id")
    events.repartition(4, "event_id").write.parquet(f"{folder}/landed")
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/landed")


_LAST = "SELECT event_type, user_id, arg_max(value, {'ts': ts, 'event_id': event_id}) AS value FROM events GROUP BY 1, 2"


@query(_LAST)
def stream_upsert(spark: SparkSession, d: str) -> DataFrame:
    from ..streaming.snapshots import SnapshotTable, upsert_stream

    folder = new_path(spark, "upsert")
    stream = _arriving(spark, d, folder)
    state = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in stream.schema)}, embedding_status string, ingested_at timestamp"
    table = SnapshotTable(spark, f"{folder}/table", state, _EVENT_KEY, 8)
    upsert_stream(stream, table, ["value", "ts", "event_id"], ["ts", "event_id"], B.now(), f"{folder}/state").awaitTermination()
    return table.read().select(*_EVENT_KEY, "value")


@query(_LAST)
def stream_changes(spark: SparkSession, d: str) -> DataFrame:
    """The last content that the keyed state lets through is each key's latest one, in whatever order files arrive."""
    from ..streaming.changes import changed_notices, keyed_state

    folder = new_path(spark, "changes")
    with keyed_state(spark):
        rows = _landed(changed_notices(_arriving(spark, d, folder), _EVENT_KEY, ["value"], "ts", "event_id"), "changes")
    return K.last_write_wins(rows, _EVENT_KEY, ["ts", "event_id"]).select(*_EVENT_KEY, "value")


# ---- listings, prompts, latest rows

def _listing(spark: SparkSession, d: str) -> DataFrame:
    """Customers as notices of a portal's listing."""
    k = F.col("c_custkey")
    return B.table(spark, d, "customer").select(F.concat(F.lit(" Works &amp; "), F.col("c_name")).alias("title"), F.concat(F.lit("/atm/show/"), k.cast("string")).alias("url"), F.when(k % 3 == 0, F.col("c_mktsegment")).alias("agency"), F.when(k % 2 == 0, F.lit("roads")).alias("category"), F.when(k % 5 != 0, F.lit("5-Jan-2026 2:00 pm")).alias("published"), F.lit("6-Feb-2026").alias("deadline"))


@query(f"""SELECT left(sha256('austender:Works & ' || c_name || ':https://x.gov.au/atm/show/' || c_custkey), 24) AS external_id, 'Works & ' || c_name AS title, 'https://x.gov.au/atm/show/' || c_custkey AS url,
  coalesce(nullif(concat_ws(chr(10) || chr(10), CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END, CASE WHEN c_custkey % 2 = 0 THEN 'roads' END), ''), 'Works & ' || c_name) AS description, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE 'Australian Government' END AS buyer,
  CASE WHEN c_custkey % 2 = 0 THEN 'roads' END AS sector, CASE WHEN c_custkey % 5 <> 0 THEN TIMESTAMP '2026-01-05 04:00:00' ELSE {_AT} END AS published_at, TIMESTAMP '2026-02-05 14:00:00' AS deadline_at FROM customer""")
def normalize_listing(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.portals import normalize_listing as run

    return run(_listing(spark, d), "austender", "https://x.gov.au/", B.now(), F.lit("2026-01-01").cast("timestamp")).select("external_id", "title", "url", "description", "buyer", "sector", "published_at", "deadline_at")


def _pages(spark: SparkSession, d: str, *parts: str) -> DataFrame:
    """One page per customer: texts, and columns of the customer by name in braces."""
    made = [F.col(x[1:-1]).cast("string") if x.startswith("{") else F.lit(x) for part in parts for x in re.split(r"(\{\w+\})", part) if x]
    # a page has a hundred times the bytes of its customer: dealt out first, as the customers' file is read by few tasks whatever their pages cost
    customers = B.table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "c_custkey")
    customers = customers.withColumn("number", F.lpad(F.col("c_custkey").cast("string"), 5, "0"))
    return customers.select(F.col("c_custkey").alias("page_id"), F.concat(*made).alias("html"))


def _listed(spark: SparkSession, d: str, pages: dict[str, tuple[str, ...]]) -> DataFrame:
    from ..sources.portals import read_listing, union_sources

    rows = union_sources([read_listing(_pages(spark, d, *parts), source, B.now()) for source, parts in pages.items()])
    return rows.select("source", "external_id", "title", "description", "url", "buyer", "country", "sector", "currency", "published_at", "deadline_at")


def _listed_sql(rows: list[tuple[str, ...]]) -> str:
    """source, external_id, title, description, url, buyer, country, sector, currency, published_at, deadline_at: SQL over customer."""
    names = ("source", "external_id", "title", "description", "url", "buyer", "country", "sector", "currency", "published_at", "deadline_at")
    kinds = {"published_at": "TIMESTAMP", "deadline_at": "TIMESTAMP"}
    return " UNION ALL ".join("SELECT " + ", ".join(f"CAST({x} AS {kinds.get(n, 'VARCHAR')}) AS {n}" for n, x in zip(names, r, strict=True)) + " FROM customer" for r in rows)


_N, _K, _S, _BR = "c_name", "c_custkey", "c_mktsegment", "chr(10)"
_TITLE = "'Works & ' || c_name"
_FIRST = '<a class="x" href="{}"> Works &amp; <b>{{c_name}}</b></a><a href="{}">Works again here</a>'
_LABEL = "<p>{}: <b>{}</b></p>"


def _anchored(href: str, *labels: tuple[str, str]) -> tuple[str, ...]:
    """A page with one notice, its link twice, a short link, and labels with their values."""
    return ('<a href="/home">Home</a>', _FIRST.format(href, href), *(_LABEL.format(*x) for x in labels))


@query(_listed_sql([
    ("'austender'", "'A' || c_custkey", _TITLE, f"{_S} || {_BR} || {_BR} || 'roads' || {_BR} || {_BR} || '72'", "'https://www.tenders.gov.au/atm/show/A' || c_custkey", _S, "'AU'", "'roads'", "NULL", "'2026-01-05 04:00:00'", "'2026-02-05 14:00:00'"),
    ("'canada_buys'", "'C' || c_custkey", _TITLE, f"{_S} || {_BR} || {_BR} || 'RFP'", "'https://canadabuys.canada.ca/en/tender-notice/C' || c_custkey", _S, "'CA'", "'RFP'", "'CAD'", "'2026-01-05'", "'2026-02-06'"),
    ("'gem_india'", "c_custkey", _TITLE, f"{_S} || {_BR} || {_BR} || 'Rail' || {_BR} || {_BR} || '100'", "'https://bidplus.gem.gov.in/showbidDocument/' || c_custkey", _S, "'IN'", "'Rail'", "'INR'", "'2026-01-04 18:30:00'", "'2026-02-05 18:30:00'"),
    ("'gebiz_sg'", "'G' || c_custkey", _TITLE, f"{_S} || {_BR} || {_BR} || 'Tender'", "'https://www.gebiz.gov.sg/d/BODetail.xhtml?itemId=G' || c_custkey", _S, "'SG'", "'Tender'", "'SGD'", "'2026-01-05 06:00:00'", "'2026-02-05 16:00:00'"),
    ("'gca_uk'", "'RM' || c_custkey", _TITLE, f"'A framework for ' || {_S} || ' and more' || {_BR} || {_BR} || 'PA2023'", "'https://www.gca.gov.uk/agreements/RM' || c_custkey", "'UK Government (GCA)'", "'GB'", "'PA2023'", "'GBP'", "'2026-01-05'", "'2026-02-06'"),
    ("'afdb'", "'https://www.afdb.org/en/documents/d' || c_custkey", _TITLE, f"'Kenya' || {_BR} || {_BR} || {_S} || {_BR} || {_BR} || 'GPN'", "'https://www.afdb.org/en/documents/d' || c_custkey", "'AfDB'", "NULL", _S, "NULL", "'2026-01-05'", "'2026-02-06'"),
    ("'ifc'", "c_custkey", _TITLE, f"'Kenya' || {_BR} || {_BR} || {_S} || {_BR} || {_BR} || 'Active'", "'https://disclosures.ifc.org/project-detail/' || c_custkey || '/x'", "'IFC'", "NULL", _S, "'USD'", "'2026-01-05'", "NULL"),
    ("'jica'", "'https://www.jica.go.jp/english/information/notice/2026/n' || c_custkey || '.html'", _TITLE, _S, "'https://www.jica.go.jp/english/information/notice/2026/n' || c_custkey || '.html'", "'JICA'", "'JP'", _S, "NULL", "'2026-01-05'", "NULL"),
]))
def listing_anchors(spark: SparkSession, d: str) -> DataFrame:
    dates = ("5-Jan-2026", "6-Feb-2026")
    return _listed(spark, d, {
        "austender": _anchored("/atm/show/A{c_custkey}", ("Agency", "{c_mktsegment}"), ("UNSPSC", "72"), ("Category", "roads"), ("Publish Date", "5-Jan-2026 2:00 pm"), ("Close Date", dates[1])),
        "canada_buys": _anchored("/en/tender-notice/C{c_custkey}", ("Buyer", "{c_mktsegment}"), ("Notice Type", "RFP"), ("Publication Date", "2026-01-05"), ("Closing Date", "2026-02-06")),
        "gem_india": _anchored("showbidDocument/{c_custkey}", ("Ministry", "{c_mktsegment}"), ("Department", "Rail"), ("Value", "100"), ("Start Date", dates[0]), ("End Date", dates[1])),
        "gebiz_sg": _anchored("d/BODetail.xhtml?itemId=G{c_custkey}", ("Agency", "{c_mktsegment}"), ("Type", "Tender"), ("Published", "05 Jan 2026 2:00 PM"), ("Closing Date", dates[1])),
        "gca_uk": _anchored("/agreements/RM{c_custkey}") + ("<p>A framework for {c_mktsegment} and more</p>",) + tuple(f"<div>{a}: <b>{b}</b></div>" for a, b in (("Start Date", "05/01/2026"), ("End Date", "06/02/2026"), ("Regulation", "PA2023"))),
        "afdb": _anchored("/en/documents/d{c_custkey}", ("Country", "Kenya"), ("Sector", "{c_mktsegment}"), ("Type", "GPN"), ("Published", dates[0]), ("Deadline", dates[1])),
        "ifc": _anchored("/project-detail/{c_custkey}/x", ("Country", "Kenya"), ("Sector", "{c_mktsegment}"), ("Status", "Active"), ("Disclosure Date", "2026-01-05")),
        "jica": ("<span>2026/01/05 [{c_mktsegment}]</span>", *_anchored("/english/information/notice/2026/n{c_custkey}.html")[1:]),
    })


def _table(*cells: str, head: str = "Title", last: str = "") -> tuple[str, ...]:
    return (f"<table><tr><td>{head}</td><td>{head}</td><td>{head}</td></tr><tr>", *(f"<td class='c'>{c}</td>" for c in cells), "</tr>", last, "</table>")


_WORKS = "Works &amp; {c_name}"


def _hash_id(source: str, url: str) -> str:
    return f"left(sha256('{source}:Works & ' || c_name || ':' || {url}), 24)"


@query(_listed_sql([
    ("'pda_pk'", "'P' || c_custkey", _TITLE, f"{_TITLE} || ' P' || c_custkey || ' Feb 6, 2026 Open'", "'https://www.pda.gov.pk/f/' || c_custkey", "'Pakistan Digital Authority'", "'PK'", "'IT / Digital'", "NULL", _AT[10:], "'2026-02-06'"),
    ("'nitb_pk'", _hash_id("nitb_pk", "'https://nitb.gov.pk/f/' || c_custkey"), _TITLE, f"{_TITLE} || ' Jan 5, 2026 Active'", "'https://nitb.gov.pk/f/' || c_custkey", "'National Information Technology Board'", "'PK'", "'IT / Digital'", "NULL", "'2026-01-05'", "NULL"),
    ("'pitb_pk'", _hash_id("pitb_pk", "'https://pitb.gov.pk/f/' || c_custkey"), _TITLE, f"{_TITLE} || ' Jan 5, 2026 Feb 6, 2026'", "'https://pitb.gov.pk/f/' || c_custkey", "'Punjab Information Technology Board'", "'PK'", "'IT / Digital'", "NULL", "'2026-01-05'", "'2026-02-06'"),
    ("'ignite_pk'", _hash_id("ignite_pk", "'https://ignite.org.pk/f/' || c_custkey"), _TITLE, f"{_TITLE} || ' Jan 5, 2026 Feb 6, 2026'", "'https://ignite.org.pk/f/' || c_custkey", "'Ignite National Technology Fund'", "'PK'", "'IT / Digital'", "NULL", "'2026-01-05'", "'2026-02-06'"),
    ("'sop_pk'", _hash_id("sop_pk", "'https://www.sop.gov.pk/f/' || c_custkey"), _TITLE, f"{_TITLE} || ' Jan 5, 2026 Feb 6, 2026'", "'https://www.sop.gov.pk/f/' || c_custkey", "'Survey of Pakistan'", "'PK'", "'Planning / Data'", "NULL", "'2026-01-05'", "'2026-02-06'"),
    ("'iadb'", "'KE-L' || lpad(c_custkey::VARCHAR, 5, '0')", _TITLE, f"'Kenya' || {_BR} || {_BR} || {_S} || {_BR} || {_BR} || 'Active'", "'https://www.iadb.org/p/' || c_custkey", "'IADB'", "NULL", _S, "'USD'", "'2026-01-05'", "NULL"),
    ("'ebrd'", "c_custkey", f"'Kenya: Works & ' || c_name", f"'Exercise' || {_BR} || {_BR} || 'Invitation for Tenders' || {_BR} || {_BR} || 'Project X, 123, Kenya, The Office of Works and ' || {_S} || ', Energy'", "'https://ecepp.ebrd.com/delta/viewNotice.html?displayNoticeId=' || c_custkey", f"'The Office of Works and ' || {_S}", "'KE'", "'Invitation for Tenders'", "NULL", "'2026-01-05 00:14:00'", "'2026-02-06'"),
    ("'ppra_pk'", "'TS' || c_custkey", _TITLE, f"{_TITLE} || {_BR} || 'a longer description of ' || {_S} || {_BR} || 'Goods' || {_BR} || 'Office of ' || {_S}", "'https://epms.ppra.gov.pk/public/tenders/tender-details/TS' || c_custkey", f"'Office of ' || {_S}", "'PK'", "'Goods'", "'PKR'", "'2026-01-04 19:00:00'", "'2026-02-06 09:00:00'"),
    ("'ppra_punjab'", "'PR/' || c_custkey", _TITLE, _TITLE, "'https://eproc.punjab.gov.pk/d/' || c_custkey", "'Roads Board'", "'PK'", "NULL", "'PKR'", "'2026-01-04 19:00:00'", "'2026-02-05 19:00:00'"),
]))
def listing_tables(spark: SparkSession, d: str) -> DataFrame:
    link, days = '<a href="/f/{c_custkey}">x</a>', ("Jan 5, 2026", "Feb 6, 2026")
    shut = "<tr><td>z</td><td>Old works</td><td>Jan 5, 2026</td><td>closed</td><td></td></tr>"
    return _listed(spark, d, {
        "pda_pk": _table("P{c_custkey}", _WORKS, days[1], "Open", link, head="Tender Description", last=shut), "nitb_pk": _table("1", _WORKS, days[0], "Active", link, head="Tender Title", last=shut),
        "pitb_pk": _table(_WORKS, link, *days), "ignite_pk": _table(_WORKS, *days, link, head="RFP Details"), "sop_pk": _table("1", _WORKS, *days, link),
        "iadb": ("<table><tr><td>Number</td><td>b</td><td>c</td><td>d</td><td>e</td></tr><tr>", "<td>KE-L", "{number}", "</td><td>o</td><td>Kenya</td><td>{c_mktsegment}</td>", '<td><a href="/p/{c_custkey}">' + _WORKS + "</a></td><td>5</td><td>Active</td><td>Jan. 5 2026</td></tr></table>"),
        "ebrd": ('<table><tr><td><a href="viewNotice.html?displayNoticeId={c_custkey}">Kenya: ' + _WORKS + "</a></td><td>Invitation for Tenders</td><td>Exercise</td><td>05/01/2026 00:14  UK Time</td><td>06/02/2026</td><td>Open</td>", "<td>Project X</td><td>123</td><td>Kenya</td><td>The Office of Works and {c_mktsegment}</td><td>Energy</td></tr>",
                 '<tr><td><a href="viewNotice.html?displayNoticeId=9{c_custkey}">Kenya: awarded</a></td><td>Contract Award Notice</td><td>N/A</td><td>05/01/2026</td><td>N/A</td><td>Open</td></tr></table>'),
        "ppra_pk": ('<tbody><tr> <td class="text-center align-middle"> 1 </td><td><strong>TS{c_custkey}</strong></td><td><strong>' + "'" + _WORKS + '</strong><small>short</small><small>a longer description of {c_mktsegment}</small><small class="badge x">Goods</small></td><td>Office of {c_mktsegment}</td><td>live</td><td>Jan 05, 2026</td>', "<td><strong>Feb 06, 2026</strong><small>02:00 PM</small></td></tr></tbody>"),
        "ppra_punjab": ('<table><tr><td>none</td></tr></table><table id="x_GridView1"><tr><td>PR/{c_custkey}</td><td>' + _WORKS + "</td><td>Roads Board</td><td>05/01/2026</td><td>06-Feb-2026</td>", '<td><a href="./d/{c_custkey}">View</a></td></tr><tr><td>few</td></tr></table>'),
    })


@query(_listed_sql([
    ("'ungm'", "c_custkey", _TITLE, f"{_TITLE} || {_BR} || 'RFQ' || {_BR} || {_S} || {_BR} || 'Kenya'", "'https://www.ungm.org/Public/Notice/' || c_custkey", _S, "'KE'", "'RFQ'", "NULL", "'2026-01-05'", "'2026-02-06 05:00:00'"),
    ("'kuwait_capt'", "'T' || c_custkey", _TITLE, f"{_TITLE} || ' ' || {_S} || ' T' || c_custkey || ' 2026-01-05 2026-02-06'", "'https://capt.gov.kw/en/tenders/opening-tenders/'", _S, "'KW'", "'Public Tender'", "'KWD'", "'2026-01-05'", "'2026-02-06'"),
    ("'urban_unit_pk'", _hash_id("urban_unit_pk", "'https://urbanunit.gov.pk/f/' || c_custkey"), _TITLE, f"{_TITLE} || ' Feb 6, 2026 noon'", "'https://urbanunit.gov.pk/f/' || c_custkey", "'The Urban Unit'", "'PK'", "'Planning / Data'", "NULL", _AT[10:], "'2026-02-06'"),
    ("'planning_commission_pk'", _hash_id("planning_commission_pk", "'https://pc.gov.pk/f/' || c_custkey"), _TITLE, f"{_TITLE} || ' 2026-01-05 Open'", "'https://pc.gov.pk/f/' || c_custkey", "'Ministry of Planning, Development & Special Initiatives'", "'PK'", "'Planning / Data'", "NULL", "'2026-01-05'", "NULL"),
]))
def listing_blocks(spark: SparkSession, d: str) -> DataFrame:
    cell, span = '<div role="cell" class="c">', "<span>{}</span></div>"
    return _listed(spark, d, {
        "ungm": ('<div role="row" class="r" data-noticeid="{c_custkey}">', cell, "</div>", cell, '<span class="ungm-title x">' + _WORKS + "</span></div>", *(cell + span.format(x) for x in ("06-Feb-2026 11:00 (GMT 6.00)", "05-Jan-2026", "{c_mktsegment}")), cell + "<label>RFQ</label></div>", cell + span.format("R1"), cell + span.format("Kenya"), '<div role="row" data-noticeid="7">none</div>'),
        "kuwait_capt": ("<h1>TENDERS</h1><div>TENDER INFO</div><p>Tender no. T{c_custkey}</p><p>Organisation {c_mktsegment}</p><p>Tender Subject " + _WORKS + "</p><p>Request date 2026-01-05</p><p>Last date 2026-02-06</p><p>Initial meeting date x</p>", "<div>Tender Info</div><p>Tender no. none</p>"),
        "urban_unit_pk": ("<h1>x</h1><h5 class='t'>" + _WORKS + "</h5><p>Submission Deadline: Feb 6, 2026 Opening Time: noon View Document</p>", '<a href="/f/{c_custkey}">View</a><h4>Annual Procurement Plan</h4>'),
        "planning_commission_pk": ('<table><tr><td><h4 class="classic-title1 x">' + _WORKS + '</h4></td><td>2026-01-05</td><td>Status: Open</td><td><a href="/f/{c_custkey}">x</a></td></tr>', '<tr><td><h4 class="classic-title1">Old</h4></td><td>Status: Closed</td></tr><tr><td>Resources</td></tr></table>'),
    })


@query(f"""WITH {B.TENDERS_SQL} SELECT tender_id, sha256('# Tender' || chr(10) || 'Title: T' || tender_id || chr(10) || 'Source: ' || source || chr(10) || 'Buyer: ' || buyer || chr(10) || CASE WHEN tender_id % 2 = 0 THEN '' ELSE 'Country: ' || country || chr(10) END || 'Sector: ' || sector || chr(10) || 'CPV codes: (none)' || chr(10)
  || 'Budget: ' || budget_min || ' - ' || budget_max || ' USD' || chr(10) || 'Currency: (unspecified)' || chr(10) || 'Language: en' || chr(10) || 'Published: ' || strftime(published_at, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' || chr(10) || 'Deadline: ' || coalesce(strftime(deadline_at, '%Y-%m-%dT%H:%M:%S.%g') || 'Z', '(none)') || chr(10) || 'URL: u' || chr(10) || chr(10) || 'Description:' || chr(10) || repeat('ab', 20)[1:30] || '… [truncated]') AS h FROM t""")
def render_tender(spark: SparkSession, d: str) -> DataFrame:
    t = B.tenders(spark, d)
    s = F.struct(F.concat(F.lit("T"), F.col("tender_id").cast("string")).alias("title"), "source", "buyer", "country", "sector", F.array().cast("array<string>").alias("cpv_codes"), F.col("budget_min").alias("budget_min_usd"), F.col("budget_max").alias("budget_max_usd"), F.lit(None).cast("string").alias("currency"), F.lit("en").alias("language"), "published_at", "deadline_at", F.lit("u").alias("url"), F.lit("ab" * 20).alias("description"))
    return t.withColumn("t", s).select("tender_id", F.sha2(P.render_tender(F.col("t"), F.col("tender_id") % 2 == 0, 30), 256).alias("h"))


@query("SELECT user_id, max({'ts': ts, 'event_id': event_id}).event_id AS event_id FROM events GROUP BY 1")
def latest_feedback(spark: SparkSession, d: str) -> DataFrame:
    e = B.table(spark, d, "events").select("user_id", F.struct("ts", "event_id").alias("at"), "event_id")
    return K.latest(e, "user_id", "at").select("user_id", "event_id")


@query("SELECT CASE WHEN vec_id % 5 = 0 THEN 'failed' ELSE 'ready' END AS embedding_status, 'm' || label AS embedding_model, count(*) AS n FROM embeddings GROUP BY 1, 2")
def embedding_summary(spark: SparkSession, d: str) -> DataFrame:
    e = B.table(spark, d, "embeddings")
    return K.embedding_summary(e.select(F.when(F.col("vec_id") % 5 == 0, "failed").otherwise("ready").alias("embedding_status"), F.concat(F.lit("m"), F.col("label").cast("string")).alias("embedding_model")))


# ---- incremental matching, digests that are due, texts of pairs

@query(f"""WITH {_CANDIDATES}, {B.TENDERS_SQL}, {B.MATCHES_SQL}, p AS (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY tender_id DESC) AS pos FROM c),
o AS (SELECT p.* FROM p JOIN t USING (tender_id) ANTI JOIN m ON m.tenant_id = p.tenant_id AND m.tender_id = p.tender_id WHERE deadline_at IS NULL OR deadline_at > {_AT}),
f AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY tenant_id ORDER BY pos) <= 40)
SELECT tenant_id, tender_id FROM f QUALIFY row_number() OVER (PARTITION BY tenant_id ORDER BY tender_id * 7919 % 1000 DESC, pos) <= 20""")
def match_new_pairs(spark: SparkSession, d: str) -> DataFrame:
    fused = _candidates(spark, d).withColumn("pos", F.row_number().over(Window.partitionBy("tenant_id").orderBy(F.desc("tender_id")))).withColumn("relevance", F.col("tender_id") * 7919 % 1000)
    return M.new_pairs(fused, B.tenders(spark, d), B.matches(spark, d), B.now(), "relevance").select("tenant_id", "tender_id")


@query(f"""WITH {B.TENDERS_SQL}, {B.MATCHES_SQL}, z AS (SELECT c_custkey AS tenant_id, c_name, CASE WHEN c_custkey % 2 = 0 THEN 70 ELSE 60 END AS least, c_custkey % 24 BETWEEN 0 AND 12 AS due FROM customer),
r AS (SELECT m.*, z.c_name, z.least, deadline_at, buyer, row_number() OVER (PARTITION BY m.tenant_id ORDER BY fit_score DESC, created_at DESC, m.tender_id) AS pos FROM m JOIN z ON z.tenant_id = m.tenant_id AND z.due JOIN t USING (tender_id)
  WHERE fit_score >= z.least AND created_at >= {_AT} - INTERVAL 7 DAY AND (deadline_at IS NULL OR deadline_at > {_AT}))
SELECT tenant_id, c_name AS company_name, count(*) AS n, CAST(least AS INT) AS min_fit_score, {_AT} AS generated_at, c_name || '@x.org' AS recipients, string_agg(tender_id || '|' || fit_score || '|' || buyer || '|' || coalesce(strftime(deadline_at, '%Y-%m-%d'), '-') || '|a,b,c', ';' ORDER BY pos) AS items FROM r WHERE pos <= 50 GROUP BY 1, 2, least""")
def due_digests(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    c = B.table(spark, d, "customer")
    plan = c.select(k.alias("tenant_id"), F.lit("daily").alias("frequency"), F.lit(1).alias("interval_days"), F.lit(0).alias("hour_local"), F.lit(23).alias("hour_local_end"), F.lit(None).cast("int").alias("day_of_week"), F.lit(None).cast("int").alias("day_of_month"), F.lit("UTC").alias("timezone"), (k % 24 <= 12).alias("enabled"), F.lit(None).cast("timestamp").alias("last_sent_at"), F.when(k % 2 == 0, 70).alias("min_fit_score"))
    names = c.select(k.alias("tenant_id"), F.col("c_name").alias("company_name"), F.array(F.concat("c_name", F.lit("@x.org"))).alias("recipients"))
    matches = B.matches(spark, d).withColumn("rationale", F.array(*[F.lit(x) for x in "abcd"]))
    zones = spark.createDataFrame([("UTC",)], "timezone string")
    out = R.due_digests(matches, B.tenders(spark, d).select("tender_id", "deadline_at", "buyer"), plan, zones, names, B.now())
    item = lambda m: F.concat_ws("|", m["tender_id"].cast("string"), m["fit_score"].cast("string"), m["buyer"], F.coalesce(F.date_format(m["deadline_at"], "yyyy-MM-dd"), F.lit("-")), F.array_join(m["rationale"], ","))
    return out.select("tenant_id", "company_name", "n", "min_fit_score", "generated_at", F.array_join("recipients", ",").alias("recipients"), F.array_join(F.transform("matches", item), ";").alias("items"))


_TEXTS = """w AS (SELECT s_suppkey, '# Company Profile' || chr(10) || 'Company: ' || s_name || chr(10) || 'One-liner: makes things' || chr(10) || 'Team size: ' || s_suppkey % 40 || chr(10) || 'Budget range (USD): 0 - 5' || chr(10) || 'Languages: ' || CASE WHEN s_suppkey % 2 = 0 THEN 'en, fr' ELSE '(unspecified)' END || chr(10) || chr(10)
  || 'Industries:' || chr(10) || '  (none)' || chr(10) || chr(10) || 'Services:' || chr(10) || '  - a' || chr(10) || '  - b' || chr(10) || chr(10) || 'Tech stack:' || chr(10) || '  (none)' || chr(10) || chr(10) || 'Certifications:' || chr(10) || '  (none)' || chr(10) || chr(10) || 'Past clients:' || chr(10) || '  (none)' || chr(10) || chr(10)
  || 'Past projects:' || chr(10) || '  - Bridge [sector=steel, valueUsd=7]: built' || chr(10) || '  - Road: paved' || chr(10) || chr(10)
  || CASE WHEN s_suppkey % 3 = 0 THEN 'Geography policy:' || chr(10) || '  This company has opted in to international collaboration / joint' || chr(10) || '  ventures. IGNORE country / geography mismatch when scoring fit,' || chr(10) || '  listing gaps, or assessing win probability. Do not flag "company' || chr(10) || '  not located in tender country" as a gap.'
     WHEN s_suppkey % 3 = 1 THEN 'Geographies:' || chr(10) || '  (global / unspecified)' ELSE 'Geographies:' || chr(10) || '  - DE' END AS p FROM supplier)"""


def _profile(k) -> dict:
    none, project = F.array().cast("array<string>"), "struct<title:string,summary:string,sector:string,value_usd:long>"
    projects = F.array(F.struct(F.lit("Bridge").alias("title"), F.lit("built").alias("summary"), F.lit("steel").alias("sector"), F.lit(7).alias("value_usd")), F.struct(F.lit("Road").alias("title"), F.lit("paved").alias("summary"), F.lit("").alias("sector"), F.lit(None).cast("int").alias("value_usd")))
    return {"company_name": F.col("s_name"), "one_liner": F.lit("makes things"), "services": F.array(F.lit("a"), F.lit("b")), "tech_stack": none, "industries": none, "certifications": none, "past_clients": none, "past_projects": projects.cast(f"array<{project}>"),
            "ignore_location": k % 3 == 0, "geographies": F.when(k % 3 == 2, F.array(F.lit("DE"))).otherwise(none), "team_size": k % 40, "budget_min_usd": F.lit(0), "budget_max_usd": F.lit(5), "languages": F.when(k % 2 == 0, F.array(F.lit("en"), F.lit("fr"))).otherwise(none)}


@query(f"""WITH {_TEXTS} SELECT s_suppkey, p AS text, sha256(p || chr(10) || chr(10) || 'the tender' || chr(10) || chr(10) || '# Cosine similarity hint' || chr(10) || '0.' || lpad(CAST(s_suppkey % 97 AS VARCHAR), 4, '0') || ' (range 0..1). The cosine similarity is one input — feel free to override it if the rationale demands a different score.' || chr(10) || chr(10)
  || '# Heuristic win-probability (deterministic, non-LLM)' || chr(10) || 'HIGH — why' || chr(10) || 'You may agree, raise, or lower this in your final winProbability. Be explicit in winProbabilityReason.' || chr(10) || chr(10) || 'Now submit your honest assessment as a single JSON object matching the schema.') AS prompt FROM w""")
def render_profile(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    text = P.render_profile(F.struct(*[v.alias(n) for n, v in _profile(k).items()]))
    prompt = P.pair_prompt(text, F.lit("the tender"), (k % 97) / 10000, F.lit("high"), F.lit("why"))
    return B.table(spark, d, "supplier").select("s_suppkey", text.alias("text"), F.sha2(prompt, 256).alias("prompt"))


@query("""SELECT doc_id, sha256('Title: ' || left(text, 40) || chr(10) || 'Buyer: ' || coalesce(source, '') || CASE WHEN doc_id % 2 = 0 THEN chr(10) || 'Sector: s' ELSE '' END || CASE WHEN doc_id % 3 <> 0 AND coalesce(lang, '') <> '' THEN chr(10) || 'Country: ' || lang ELSE '' END || CASE WHEN doc_id % 5 = 0 THEN chr(10) || 'CPV: 1, 2' ELSE '' END || CASE WHEN left(text, 1500) <> '' THEN chr(10) || left(text, 1500) ELSE '' END) AS h
  FROM (SELECT doc_id, coalesce(text, '') AS text, source, lang FROM documents)""")
def rerank_doc(spark: SparkSession, d: str) -> DataFrame:
    k, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    codes = F.when(k % 5 == 0, F.array(F.lit("1"), F.lit("2"))).otherwise(F.array().cast("array<string>"))
    return B.table(spark, d, "documents").select("doc_id", F.sha2(P.rerank_doc(F.substring(text, 1, 40), F.col("source"), F.when(k % 2 == 0, "s"), F.col("lang"), codes, text, k % 3 == 0), 256).alias("h"))


# ---- validation and summaries

_SCHEDULE_SQL = """SELECT c_custkey, concat_ws(',', CASE WHEN c_custkey % 23 = 1 THEN 'frequency' END, CASE WHEN c_custkey % 70 NOT BETWEEN 1 AND 60 THEN 'interval_days' END, CASE WHEN c_custkey % 29 > 23 OR c_custkey % 31 = 2 THEN 'hour_local' END, CASE WHEN c_custkey % 12 + 14 > 23 THEN 'hour_local_end' END,
  CASE WHEN c_custkey % 11 > 6 THEN 'day_of_week' END, CASE WHEN c_custkey % 37 NOT BETWEEN 1 AND 31 THEN 'day_of_month' END, CASE WHEN c_custkey % 19 = 4 THEN 'min_fit_score' END, CASE WHEN c_custkey % 4 = 0 THEN 'recipients[1]' WHEN c_custkey % 4 = 1 THEN 'recipients' END,
  CASE WHEN c_custkey % 12 + 14 <= 23 AND c_custkey % 12 + 14 < c_custkey % 29 AND c_custkey % 31 <> 2 THEN 'hour_local_end' END, CASE WHEN c_custkey % 11 = 3 AND c_custkey % 5 = 3 AND c_custkey % 23 <> 1 THEN 'day_of_week' END, CASE WHEN c_custkey % 37 = 9 AND c_custkey % 5 = 4 AND c_custkey % 23 <> 1 THEN 'day_of_month' END) AS failed FROM customer"""


@query(f"SELECT * FROM ({_SCHEDULE_SQL}) WHERE failed <> ''")
def schedule_rejects(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("tenant_id")
    mail = F.lit("a@b.org")
    rows = B.schedules(spark, d).withColumns({
        "frequency": F.when(k % 23 == 1, F.lit("hourly")).otherwise(F.col("frequency")), "interval_days": (k % 70).cast("int"), "hour_local": F.when(k % 31 != 2, (k % 29).cast("int")), "hour_local_end": (k % 12 + 14).cast("int"),
        "day_of_week": F.when(k % 11 != 3, (k % 11).cast("int")), "day_of_month": F.when(k % 37 != 9, (k % 37).cast("int")), "min_fit_score": F.when(k % 19 == 4, 101).when(k % 19 != 5, 60),
        "recipients": F.when(k % 4 == 0, F.array(mail, F.lit("no mail"))).when(k % 4 == 1, F.array_repeat(mail, 21)).when(k % 4 == 2, F.array_repeat(mail, 20)),
    })
    return K.validate_schedules(rows)[1].select(k.alias("c_custkey"), F.array_join("failed", ",").alias("failed"))


_PROFILE_SQL = """SELECT s_suppkey, concat_ws(',', CASE WHEN s_suppkey % 7 = 1 THEN 'company_name' END, CASE WHEN s_suppkey % 5 < 2 THEN 'one_liner' END, CASE WHEN s_suppkey % 6 = 2 THEN 'services[1]' END, CASE WHEN s_suppkey % 9 = 3 THEN 'past_projects[0].title' END, CASE WHEN s_suppkey % 10 = 4 THEN 'past_projects[1].summary' END, CASE WHEN s_suppkey % 8 = 5 THEN 'past_projects[1].value_usd' END,
  CASE WHEN s_suppkey % 4 = 0 THEN 'geographies[0]' END, CASE WHEN s_suppkey % 11 = 6 THEN 'team_size' END, CASE WHEN s_acctbal < 0 THEN 'budget_min_usd' END, CASE WHEN s_suppkey % 13 = 7 THEN 'budget_max_usd' END) AS failed FROM supplier"""


@query(f"SELECT * FROM ({_PROFILE_SQL}) WHERE failed <> ''")
def profile_rejects(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    project = lambda title, summary, value: F.struct(title.alias("title"), summary.alias("summary"), F.lit(None).cast("string").alias("sector"), value.cast("double").alias("value_usd"))
    projects = F.array(project(F.when(k % 9 == 3, "").otherwise("t"), F.lit("s"), F.lit(None)), project(F.lit("t"), F.when(k % 10 != 4, "s"), F.when(k % 8 == 5, -0.5).otherwise(0)))
    rows = B.table(spark, d, "supplier").select(
        "s_suppkey", F.when(k % 7 != 1, F.col("s_name")).alias("company_name"), F.when(k % 5 == 1, F.repeat(F.lit("x"), F.lit(281))).when(k % 5 != 0, F.repeat(F.lit("x"), F.lit(280))).alias("one_liner"), F.when(k % 6 == 2, F.array(F.lit("a"), F.lit(None))).when(k % 6 != 3, F.array(F.lit(""))).alias("services"), projects.alias("past_projects"),
        F.array(F.when(k % 4 == 0, "DEU").otherwise("DE")).alias("geographies"), F.when(k % 11 == 6, -1).otherwise(0).alias("team_size"), F.floor("s_acctbal").cast("int").alias("budget_min_usd"), F.when(k % 13 != 7, 5).alias("budget_max_usd"),
    )
    return K.validate_profiles(rows)[1].select("s_suppkey", F.array_join("failed", ",").alias("failed"))


@query("""SELECT event_id, concat_ws(',', CASE WHEN user_id % 3 = 0 THEN 'match_id' END, CASE WHEN event_type = 'error' THEN 'interested' END) AS failed FROM events WHERE user_id % 3 = 0 OR event_type = 'error'""")
def feedback_rejects(spark: SparkSession, d: str) -> DataFrame:
    e = B.table(spark, d, "events").select("event_id", F.when(F.col("user_id") % 3 != 0, F.col("user_id")).alias("match_id"), F.when(F.col("event_type") != "error", F.col("value") > 100).alias("interested"), F.col("props").alias("note"))
    return K.validate_feedback(e)[1].select("event_id", F.array_join("failed", ",").alias("failed"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'fr' ELSE 'en' END AS languages, CASE WHEN s_suppkey % 3 = 0 THEN 0 ELSE CAST(s_suppkey % 40 AS INT) END AS team_size, s_suppkey % 5 = 1 AS ignore_location FROM supplier")
def profile_defaults(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    rows = B.table(spark, d, "supplier").select("s_suppkey", F.when(k % 2 == 0, F.array(F.lit("fr"))).alias("languages"), F.when(k % 3 != 0, (k % 40).cast("int")).alias("team_size"), F.when(k % 5 < 2, k % 5 == 1).alias("ignore_location"))
    return K.profile_defaults(rows).withColumn("languages", F.array_join("languages", ","))


@query("SELECT 'm' || label AS embedding_model, count(*) FILTER (vec_id % 4 = 0) AS embedded, count(*) FILTER (vec_id % 4 = 1) AS failed, count(*) FILTER (vec_id % 4 > 1) AS skipped FROM embeddings GROUP BY 1")
def embedding_run(spark: SparkSession, d: str) -> DataFrame:
    e, k = B.table(spark, d, "embeddings"), F.col("vec_id")
    vectors = e.where("vec_id % 4 < 2").select(k.alias("id"), F.when(k % 4 == 0, F.col("embedding")).alias("vector"))
    return K.embedding_run(e.select(k.alias("id"), F.concat(F.lit("m"), F.col("label").cast("string")).alias("embedding_model")), vectors)


@query(f"WITH {B.MATCHES_SQL} SELECT arg_min('v' || tender_id % 3, {{'c': created_at, 'v': 'v' || tender_id % 3}}) AS model_version FROM m WHERE tender_id % 2 = 0")
def evaluation_model(spark: SparkSession, d: str) -> DataFrame:
    m = B.matches(spark, d).withColumn("match_id", F.concat_ws("-", "tenant_id", "tender_id")).withColumn("model_version", F.concat(F.lit("v"), (F.col("tender_id") % 3).cast("string")))
    feedback = m.where("tender_id % 2 = 0").select("match_id", "created_at", "interested")
    return R.run_model(R.labeled_matches(m.drop("interested"), feedback, B.tenders(spark, d)))


@query(f"""WITH {B.MATCHES_SQL} SELECT c_custkey AS tenant_id, CASE WHEN c_custkey IN (SELECT tenant_id FROM m WHERE fit_score >= 98) THEN {_AT} WHEN c_custkey % 3 <> 0 THEN TIMESTAMP '1998-01-07 10:00:00' - to_hours(CAST(c_custkey % 900 AS INT)) END AS last_sent_at FROM customer""")
def after_sending(spark: SparkSession, d: str) -> DataFrame:
    return R.after_sending(B.schedules(spark, d), B.matches(spark, d).where("fit_score >= 98"), B.now()).select("tenant_id", "last_sent_at")


@query(f"""WITH {B.TENDERS_SQL}, {B.MATCHES_SQL}, x AS (SELECT max(tenant_id) AS tenant_id FROM m), y AS (SELECT tenant_id, max(tender_id) AS tender_id FROM m JOIN x USING (tenant_id) GROUP BY 1)
SELECT m.tenant_id, m.tender_id, CAST(fit_score AS INT) AS fit_score, t.buyer, CASE WHEN m.tender_id % 2 = 0 THEN interested END AS interested FROM y JOIN m USING (tenant_id, tender_id) JOIN t ON t.tender_id = m.tender_id""")
def match_detail(spark: SparkSession, d: str) -> DataFrame:
    """The newest match of the last tenant: the ids come from the table."""
    m = B.matches(spark, d).withColumn("match_id", F.concat_ws("-", "tenant_id", "tender_id"))
    feedback = m.where("tender_id % 2 = 0").select("match_id", "created_at", "interested")
    last = m.agg(F.max(F.struct("tenant_id", "tender_id", "match_id")).alias("x")).select("x.*").first()
    found = R.match_detail(m.drop("interested"), B.tenders(spark, d), feedback, last["tenant_id"], last["match_id"])
    return found.select("tenant_id", "tender_id", "fit_score", F.col("tender.buyer").alias("buyer"), F.col("feedback.interested").alias("interested"))


@query("""WITH c AS (SELECT 'src' || n_nationkey AS source, CASE WHEN n_nationkey % 3 = 0 THEN 'planned' ELSE 'available' END AS availability, CASE WHEN n_nationkey % 5 = 0 THEN 'no key' END AS reason FROM nation)
SELECT source, availability = 'available' AND reason IS NULL AS enabled, source IN ('src1', 'src5', 'src7') AS selected FROM c""")
def enabled_sources(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey")
    catalog = B.table(spark, d, "nation").select(F.concat(F.lit("src"), k.cast("string")).alias("source"), F.when(k % 3 == 0, "planned").otherwise("available").alias("availability"), F.when(k % 5 == 0, "no key").alias("unavailable_reason"))
    on = K.enabled_sources(catalog).select("source", F.lit(True).alias("enabled"))
    some = K.select_sources(catalog, " src7, nobody,src1,src5,src1").select("source", F.lit(True).alias("selected"))
    both = catalog.select("source").join(on, "source", "left").join(some, "source", "left")
    return both.select("source", F.coalesce("enabled", F.lit(False)).alias("enabled"), F.coalesce("selected", F.lit(False)).alias("selected"))


@query("SELECT s_suppkey AS tenant_id, CASE WHEN s_suppkey % 4 = 0 THEN 'new ' || s_name ELSE s_name END AS one_liner, CASE WHEN s_suppkey % 4 = 0 THEN 'pending' ELSE 'ready' END AS embedding_status FROM supplier")
def save_profile(spark: SparkSession, d: str) -> DataFrame:
    s = B.table(spark, d, "supplier")
    current = s.select(F.col("s_suppkey").alias("tenant_id"), F.col("s_name").alias("one_liner"), F.lit("ready").alias("embedding_status"))
    return K.save_profile(current, s.where("s_suppkey % 4 = 0").select(F.col("s_suppkey").alias("tenant_id"), F.concat(F.lit("new "), "s_name").alias("one_liner")))


@query("SELECT s_suppkey, s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 45) AS has_profile FROM supplier WHERE s_nationkey % 2 = 0")
def owned_tenants(spark: SparkSession, d: str) -> DataFrame:
    """One user owns the suppliers of even nations."""
    s = B.table(spark, d, "supplier")
    users = s.select(F.when(F.col("s_nationkey") % 2 == 0, "Me@x.org").otherwise("b@x.org").alias("email"), F.col("s_suppkey").alias("tenant_id"))
    known = B.table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_suppkey").alias("tenant_id"))
    tenants = s.select(F.col("s_suppkey").alias("tenant_id"), F.col("s_acctbal").alias("created_at"))
    return K.owned_tenants(users, tenants, known, "me@x.org").select(F.col("tenant_id").alias("s_suppkey"), "has_profile")
