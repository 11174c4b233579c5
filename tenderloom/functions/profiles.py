"""Texts made of profiles and tenders: keywords, queries, what is embedded, hashes, prompts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EMBED_CAP = 6000
#: What the scorer is told where a profile's location does not count, and what surrounds a pair's hints.
GEOGRAPHY_POLICY = (
    "  This company has opted in to international collaboration / joint",
    "  ventures. IGNORE country / geography mismatch when scoring fit,",
    '  listing gaps, or assessing win probability. Do not flag "company',
    '  not located in tender country" as a gap.',
)
SIMILARITY_HINT = " (range 0..1). The cosine similarity is one input — feel free to override it if the rationale demands a different score."
CHANCE_HINT = "You may agree, raise, or lower this in your final winProbability. Be explicit in winProbabilityReason."
REQUEST = "Now submit your honest assessment as a single JSON object matching the schema."


def profile_keywords(*lists: Column) -> Column:
    """Trimmed terms of 1 to 79 characters, in order."""
    return F.filter(F.transform(F.concat(*lists), lambda x: F.trim(x)), lambda x: (F.length(x) > 0) & (F.length(x) < 80))


def distinct_terms(terms: Column) -> Column:
    """Case-insensitively distinct, the first spelling stays."""
    lowered = F.transform(terms, lambda x: F.lower(x))
    return F.filter(terms, lambda x, i: F.array_position(lowered, F.lower(x)) == i + 1)


def build_query(terms: Column) -> Column:
    """Terms without quotes, those with a blank in quotes, joined by OR; no terms, an empty query."""
    bare = F.filter(F.transform(terms, lambda x: F.replace(x, F.lit('"'), F.lit(""))), lambda x: F.trim(x) != "")
    return F.array_join(F.transform(bare, lambda x: F.when(F.contains(x, F.lit(" ")), F.concat(F.lit('"'), x, F.lit('"'))).otherwise(x)), " OR ")


def _list(label: str, items: Column) -> Column:
    return F.concat(F.lit(f"{label}: "), F.when(F.size(items) > 0, F.array_join(items, ", ")).otherwise("(none)"))


def flatten_profile(p: Column) -> Column:
    """The text of a profile struct that is embedded; without its countries when they are to be ignored."""
    project = lambda x: F.concat(F.lit("- "), x["title"], F.coalesce(F.concat(F.lit(" ("), F.nullif(x["sector"], F.lit("")), F.lit(")")), F.lit("")), F.lit(": "), x["summary"])
    projects = F.when(F.size(p["past_projects"]) > 0, F.concat(F.lit("Past projects:\n"), F.array_join(F.transform(p["past_projects"], project), "\n"))).otherwise("Past projects: (none)")
    places = F.when(~p["ignore_location"], F.when(F.size(p["geographies"]) > 0, F.concat(F.lit("Geographies: "), F.array_join(p["geographies"], ", "))).otherwise("Geographies: global / unspecified"))
    lines = [
        F.concat(F.lit("Company: "), p["company_name"]), F.concat(F.lit("One-liner: "), p["one_liner"]),
        _list("Services", p["services"]), _list("Tech stack", p["tech_stack"]), _list("Industries", p["industries"]), _list("Certifications", p["certifications"]), _list("Past clients", p["past_clients"]),
        projects, places, F.concat(F.lit("Team size: "), p["team_size"].cast("string")),
        F.concat(F.lit("Budget range USD: "), p["budget_min_usd"].cast("string"), F.lit("-"), p["budget_max_usd"].cast("string")), _list("Languages", p["languages"]),
    ]
    return F.concat_ws("\n", *lines)


def tender_header(title: Column, buyer: Column, sector: Column, country: Column, cpv: Column) -> Column:
    unknown = F.lit("(unspecified)")
    lines = [F.concat(F.lit("Title: "), title), F.concat(F.lit("Buyer: "), buyer), F.concat(F.lit("Sector: "), F.coalesce(sector, unknown)), F.concat(F.lit("Country: "), F.coalesce(country, unknown)), _list("CPV", cpv)]
    return F.concat_ws("\n", *lines)


def flatten_tender(header: Column, description: Column) -> Column:
    """Header and as much of the description as the cap leaves, 200 characters at least; capped as a whole."""
    room = F.greatest(F.lit(200), F.lit(EMBED_CAP - 16) - F.length(header))
    text = F.concat(header, F.lit("\nDescription: "), F.substring(F.coalesce(description, F.lit("")), F.lit(1), room))
    return F.substring(text, 1, EMBED_CAP)


def content_hash(stamp: str, *parts: Column) -> Column:
    """Changes with the model's stamp or any part."""
    return F.sha2(F.concat_ws("|", F.lit(stamp), *[F.coalesce(p, F.lit("")) for p in parts]), 256)


def rerank_doc(title: Column, buyer: Column, sector: Column, country: Column, cpv: Column, description: Column, ignore_location: Column, most: int = 1500) -> Column:
    """A tender's text for a reranker; what it lacks is left out, its country also where location is to be ignored."""
    said = lambda label, x: F.when(F.coalesce(x, F.lit("")) != "", F.concat(F.lit(f"{label}: "), x))
    always = lambda label, x: F.concat(F.lit(f"{label}: "), F.coalesce(x, F.lit("")))
    codes = F.when(F.size(cpv) > 0, F.concat(F.lit("CPV: "), F.array_join(cpv, ", ")))
    return F.concat_ws("\n", always("Title", title), always("Buyer", buyer), said("Sector", sector), F.when(~ignore_location, said("Country", country)), codes, F.nullif(F.substring(description, 1, most), F.lit("")))


def render_profile(p: Column) -> Column:
    """A profile struct as the scorer's text; where location is to be ignored, a policy stands for its countries."""
    none = "  (none)"
    bullets = lambda x, empty: F.when(F.size(x) > 0, F.array_join(F.transform(x, lambda i: F.concat(F.lit("  - "), i)), "\n")).otherwise(empty)
    about = lambda x: F.concat_ws(", ", F.concat(F.lit("sector="), F.nullif(x["sector"], F.lit(""))), F.concat(F.lit("valueUsd="), x["value_usd"].cast("string")))
    project = lambda x: F.concat(F.lit("  - "), x["title"], F.coalesce(F.concat(F.lit(" ["), F.nullif(about(x), F.lit("")), F.lit("]")), F.lit("")), F.lit(": "), x["summary"])
    listed = lambda label, x: [F.lit(""), F.lit(f"{label}:"), bullets(x, "  (none)")]
    lines = [
        F.lit("# Company Profile"), F.concat(F.lit("Company: "), p["company_name"]), F.concat(F.lit("One-liner: "), p["one_liner"]), F.concat(F.lit("Team size: "), p["team_size"].cast("string")),
        F.concat(F.lit("Budget range (USD): "), p["budget_min_usd"].cast("string"), F.lit(" - "), p["budget_max_usd"].cast("string")), F.concat(F.lit("Languages: "), F.coalesce(F.nullif(F.array_join(p["languages"], ", "), F.lit("")), F.lit("(unspecified)"))),
        *listed("Industries", p["industries"]), *listed("Services", p["services"]), *listed("Tech stack", p["tech_stack"]), *listed("Certifications", p["certifications"]), *listed("Past clients", p["past_clients"]),
        F.lit(""), F.lit("Past projects:"), F.when(F.size(p["past_projects"]) > 0, F.array_join(F.transform(p["past_projects"], project), "\n")).otherwise(none),
        F.lit(""), F.when(p["ignore_location"], F.lit("\n".join(("Geography policy:", *GEOGRAPHY_POLICY)))).otherwise(F.concat(F.lit("Geographies:\n"), bullets(p["geographies"], "  (global / unspecified)"))),
    ]
    return F.concat_ws("\n", *lines)


def truncated(text: Column, most: int) -> Column:
    """The text, cut with a mark where it is longer."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most), F.lit("… [truncated]")))


def render_tender(t: Column, ignore_location: Column, most: int = 6000) -> Column:
    """A tender struct as the scorer's text; its country is left out where location is to be ignored."""
    said = lambda label, value, none="(unspecified)": F.concat(F.lit(f"{label}: "), F.coalesce(value.cast("string"), F.lit(none)))
    amount = lambda c: F.coalesce(t[c].cast("string"), F.lit("?"))
    budget = F.when(t["budget_min_usd"].isNotNull() | t["budget_max_usd"].isNotNull(), F.concat(amount("budget_min_usd"), F.lit(" - "), amount("budget_max_usd"), F.lit(" USD")))
    moment = lambda c: F.date_format(t[c], "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    lines = [
        F.lit("# Tender"), said("Title", t["title"]), said("Source", t["source"]), said("Buyer", t["buyer"]), F.when(~ignore_location, said("Country", t["country"])), said("Sector", t["sector"]), _list("CPV codes", t["cpv_codes"]),
        said("Budget", budget), said("Currency", t["currency"]), said("Language", t["language"]), said("Published", moment("published_at")), said("Deadline", moment("deadline_at"), "(none)"), said("URL", t["url"]), F.lit(""), F.lit("Description:"), truncated(t["description"], most),
    ]
    return F.concat_ws("\n", *lines)


def pair_prompt(profile_text: Column, tender_text: Column, similarity: Column, level: Column, reason: Column) -> Column:
    """The scorer's text for a pair: both sides, the similarity to four places, and the rule-based estimate as a hint."""
    near = F.concat(F.lit("# Cosine similarity hint\n"), F.format_number(similarity, 4), F.lit(SIMILARITY_HINT))
    chance = F.concat(F.lit("# Heuristic win-probability (deterministic, non-LLM)\n"), F.upper(level), F.lit(" — "), reason, F.lit(f"\n{CHANCE_HINT}"))
    return F.concat_ws("\n\n", profile_text, tender_text, near, chance, F.lit(REQUEST))
