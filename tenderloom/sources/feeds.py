"""Landed payloads to common tender rows: OCDS, SAM, TED, World Bank, RSS / RDF / Atom.

Every reader takes a DataFrame with one payload per row (column ``payload``; ``page`` orders pages) and returns TENDER columns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V
from ..functions.schemas import once

TENDER = ("external_id", "source", "title", "description", "url", "buyer", "country", "sector", "cpv_codes", "budget_min_usd", "budget_max_usd", "currency", "published_at", "deadline_at", "language", "raw")
_CLASS = "struct<scheme:string,id:string,description:string>"
_MONEY = "struct<amount:double,currency:string>"
RELEASE = f"struct<id:string,ocid:string,date:string,language:string,buyer:struct<name:string>,parties:array<struct<name:string,roles:array<string>,address:struct<countryName:string>>>,tender:struct<title:string,description:string,value:{_MONEY},minValue:{_MONEY},classification:{_CLASS},additionalClassifications:array<{_CLASS}>,mainProcurementCategory:string,tenderPeriod:struct<endDate:string>,items:array<struct<classification:{_CLASS}>>>>"
NOTICE = "struct<noticeId:string,title:string,description:string,fullParentPathName:string,postedDate:string,responseDeadLine:string,uiLink:string,naicsCode:string,classificationCode:string,award:struct<amount:string>>"
DOC = "struct<id:string,project_name:string,notice_type:string,notice_text:string,bid_description:string,notice_date:string,deadline_date:string,project_ctry_name:string,project_ctry_code:string,procurement_method:string,total_contract_amount:string,notice_lang_name:string,url:string>"
_TEXTS = "array<string>"


#: Buyers, links and titles of notices that name none.
UNDP_FEED = "https://procurement-notices.undp.org/rss_feeds/rss.xml"


def rows(df: DataFrame, source: str, columns: dict[str, Column]) -> DataFrame:
    """A projection to the common row; what a feed does not have is null."""
    kinds = {"cpv_codes": _TEXTS, "budget_min_usd": "int", "budget_max_usd": "int", "published_at": "timestamp", "deadline_at": "timestamp"}
    columns = {"source": F.lit(source), "language": F.lit("en")} | columns
    return df.select(*[columns.get(c, F.lit(None)).cast(kinds.get(c, "string")).alias(c) for c in TENDER])


def collect_cpv(tender: Column) -> Column:
    """CPV codes of the main, the additional and the items' classifications, distinct, in order."""
    none = F.array().cast(f"array<{_CLASS}>")
    items = F.transform(F.coalesce(tender["items"], F.array().cast(f"array<struct<classification:{_CLASS}>>")), lambda i: i["classification"])
    every = F.concat(F.array(tender["classification"]), F.coalesce(tender["additionalClassifications"], none), items)
    return F.array_distinct(F.transform(F.filter(every, lambda c: (c["scheme"] == "CPV") & c["id"].isNotNull()), lambda c: c["id"]))


def buyer_party(parties: Column) -> Column:
    """The first party with the role of a buyer."""
    return F.get(F.filter(parties, lambda p: F.array_contains(p["roles"], "buyer")), F.lit(0))


def read_ocds(payloads: DataFrame, source: str, url: str, run_ts: Column) -> DataFrame:
    """Release packages. ``url`` holds ``{id}``. Releases without id, tender or title are dropped."""
    r = payloads.select(F.explode(F.from_json("payload", f"struct<releases:array<{RELEASE}>>")["releases"]).alias("r"))
    r = r.withColumn("id", F.coalesce("r.id", "r.ocid")).withColumn("t", F.col("r.tender")).withColumn("party", buyer_party(F.col("r.parties"))).withColumn("cpv", collect_cpv(F.col("t")))
    r = r.where(F.col("id").isNotNull() & F.col("t").isNotNull() & (F.trim(F.coalesce("t.title", F.lit(""))) != ""))
    c, currency = F.col, F.coalesce("t.value.currency", "t.minValue.currency")
    british = F.lit("GB" if source in ("uk_find_a_tender", "uk_contracts_finder") else None)
    head, _, tail = url.partition("{id}")
    published = F.when(c("r.date").isNull(), run_ts).otherwise(F.try_to_timestamp("r.date"))
    return rows(r, source, {
        "external_id": c("id"), "title": F.trim("t.title"), "description": F.trim(F.coalesce("t.description", F.lit(""))), "url": F.concat(F.lit(head), c("id"), F.lit(tail)),
        "buyer": F.coalesce("r.buyer.name", "party.name", F.lit("UK Government")), "country": F.coalesce(V.country_iso2(c("party.address.countryName")), british),
        "sector": F.coalesce(F.get("cpv", F.lit(0)), c("t.classification.description"), c("t.mainProcurementCategory")), "cpv_codes": c("cpv"),
        "budget_min_usd": V.to_usd(F.coalesce("t.minValue.amount", "t.value.amount"), currency), "budget_max_usd": V.to_usd(c("t.value.amount"), currency), "currency": currency,
        "published_at": published, "deadline_at": F.try_to_timestamp("t.tenderPeriod.endDate"), "language": F.coalesce("r.language", F.lit("en")), "raw": F.to_json("r"),
    })


def read_sam(payloads: DataFrame, run_ts: Column) -> DataFrame:
    n = payloads.select(F.explode(F.from_json("payload", f"struct<opportunitiesData:array<{NOTICE}>>")["opportunitiesData"]).alias("n")).select("n.*", F.to_json("n").alias("raw"))
    amount = V.to_usd(V.leading_number(F.col("award.amount")), F.lit("USD"))
    c = F.col
    return rows(n, "sam_gov", {
        "external_id": c("noticeId"), "title": c("title"), "description": F.coalesce("description", F.lit("")), "url": F.coalesce("uiLink", F.concat(F.lit("https://sam.gov/opp/"), c("noticeId"), F.lit("/view"))),
        "buyer": F.coalesce("fullParentPathName", F.lit("US Federal Government")), "country": F.lit("US"), "sector": F.coalesce("naicsCode", "classificationCode"), "cpv_codes": F.array(),
        "budget_min_usd": amount, "budget_max_usd": amount, "currency": F.lit("USD"), "published_at": F.coalesce(V.parse_date(c("postedDate"), "iso"), run_ts), "deadline_at": F.try_to_timestamp("responseDeadLine"), "raw": c("raw"),
    })


def read_ted(payloads: DataFrame, run_ts: Column) -> DataFrame:
    """Notices whose fields are strings, lists or maps by language: each is first kept as JSON text, then read as what it is."""
    n = payloads.select(F.explode(F.from_json("payload", "struct<notices:array<map<string,string>>>")["notices"]).alias("n"))
    f = lambda k: F.try_element_at("n", F.lit(k))
    n = n.withColumn("cpv", V.to_string_array(f("classification-cpv"))).withColumn("value", F.when(f("estimated-value-lot").rlike(r"^\s*\["), F.get(F.from_json(f("estimated-value-lot"), f"array<{_MONEY}>"), F.lit(0))).otherwise(F.from_json(f("estimated-value-lot"), _MONEY)))
    page = V.pick_localized(F.get_json_object(f("links"), "$.html"))
    usd, number = V.to_usd(F.col("value.amount"), F.col("value.currency")), V.pick_localized(f("publication-number"))
    return rows(n, "ted_eu", {
        "external_id": number, "title": V.pick_localized(f("title")), "description": F.coalesce(V.pick_localized(f("description")), F.lit("")), "url": F.coalesce(page, F.concat(F.lit("https://ted.europa.eu/en/notice/-/detail/"), F.url_encode(number))),
        "buyer": F.coalesce(V.pick_localized(f("buyer-name")), F.lit("EU Buyer")), "country": V.country_from_code(V.pick_localized(f("buyer-country"))), "sector": F.get("cpv", F.lit(0)), "cpv_codes": F.col("cpv"),
        "budget_min_usd": usd, "budget_max_usd": usd, "currency": F.col("value.currency"), "published_at": F.coalesce(V.parse_date(V.pick_localized(f("publication-date")), "iso"), run_ts),
        "deadline_at": V.parse_date(V.pick_localized(f("deadline-receipt-tender-date-lot")), "iso"), "raw": F.to_json("n"),
    })


def world_bank_docs(payloads: DataFrame) -> DataFrame:
    """One row per notice (its fields): ``procnotices`` is a list or a map by id. Payloads are parsed once; what is no JSON yields no notice
    (see broken_payloads), nor does an element that is no object."""
    parsed = payloads.select(once(F.try_parse_json("payload")).alias("v"))
    body = F.try_variant_get("v", "$.procnotices", "variant")
    each = F.coalesce(F.try_variant_get(body, "$", "array<variant>"), F.map_values(F.try_variant_get(body, "$", "map<string,variant>")))
    docs = parsed.select(F.explode(each).alias("d")).where(F.schema_of_variant("d").startswith("OBJECT"))
    return docs.select(once(F.try_variant_get("d", "$", DOC)).alias("d")).select("d.*", F.to_json("d").alias("raw"))


def broken_payloads(payloads: DataFrame) -> DataFrame:
    """The payloads that are no JSON, with ``failed`` as the rejects of validation have it. A null payload is broken too."""
    return payloads.where(F.try_parse_json("payload").isNull()).withColumn("failed", F.array(F.lit("json")))


#: Words of notice types that are closed and open, and phrases of awarded notices.
CLOSED = ("award", "cancellation", "cancelled", "withdrawn", "contract signed", "completion")
OPEN = ("request for", "invitation", "specific procurement", "general procurement", "expression of interest", "prequalification", "consulting services", "bid")
AWARDED = ("date notification of award", "notification of award issued", "awarded bidder", "awarded bidder(s)", "letter of acceptance", "contract award notice", "notice of contract award", "winning bidder")
#: EBRD notice types.
EBRD_ACCEPT = ("invitation for tenders", "invitation for prequalification", "invitation for expressions of interest", "request for proposals")
EBRD_REJECT = ("contract award", "award notice", "shortlist")


def has_any(text: Column, words: tuple[str, ...]) -> Column:
    """Whether the lower-cased text holds any of the words."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words])


def is_open_notice(kind: Column) -> Column:
    """No type: open; any closed word: not; else any open word."""
    blank = F.trim(F.coalesce(kind, F.lit(""))) == ""
    return blank | (~has_any(kind, CLOSED) & has_any(kind, OPEN))


def looks_awarded(*texts: Column) -> Column:
    return has_any(F.concat_ws(" ", *texts), AWARDED)


def is_biddable(state: Column, kind: Column) -> Column:
    return has_any(state, ("open",)) & ~has_any(kind, EBRD_REJECT) & has_any(kind, EBRD_ACCEPT)


def is_stale(deadline: Column, now: Column, days: int = 14) -> Column:
    return F.coalesce(deadline + F.make_dt_interval(days=F.lit(days)) < now, F.lit(False))


def read_world_bank(payloads: DataFrame, run_ts: Column, since: Column | None = None) -> DataFrame:
    d = world_bank_docs(payloads).where(is_open_notice(F.col("notice_type")) & ~looks_awarded(F.col("notice_text"), F.col("bid_description")))
    c = F.col
    dates = F.struct(F.coalesce(V.parse_date(c("notice_date"), "loose"), run_ts).alias("published"), V.parse_date(c("deadline_date"), "loose").alias("deadline"))
    d = d.select("*", once(dates).alias("_at")).select(*d.columns, "_at.*")
    d = d.where(~is_stale(c("deadline"), run_ts))
    if since is not None:
        d = d.where(c("published") >= since)
    usd = V.to_usd(V.leading_number(c("total_contract_amount")), F.lit("USD"))
    return rows(d, "world_bank", {
        "external_id": c("id"), "title": F.coalesce("project_name", "bid_description", F.lit("World Bank Procurement Notice")), "description": F.coalesce("notice_text", "bid_description", F.lit("")),
        "url": F.coalesce("url", F.concat(F.lit("https://projects.worldbank.org/en/projects-operations/procurement-detail/"), F.url_encode("id"))), "buyer": F.coalesce("project_name", F.lit("World Bank")),
        "country": V.country_from_code(c("project_ctry_code")), "sector": F.coalesce("procurement_method", "notice_type"), "cpv_codes": F.array(), "budget_min_usd": usd, "budget_max_usd": usd, "currency": F.lit("USD"),
        "published_at": c("published"), "deadline_at": c("deadline"), "raw": c("raw"),
    })


def read_feed_items(payloads: DataFrame, most: int = 100) -> DataFrame:
    """(page, pos, title, link, description, published, guid) of the first items of RSS, RDF and Atom feeds."""
    block = r"(?is)<(?:item|entry)\b[^>]*>.*?</(?:item|entry)>"
    items = payloads.select("page", F.posexplode(F.regexp_extract_all("payload", F.lit(block), F.lit(0))).alias("pos", "x")).where(F.col("pos") < most)

    def tag(*names: str) -> Column:
        found = [F.nullif(T.clean(F.regexp_replace(F.regexp_extract("x", rf"(?is)<{n}\b[^>]*>(.*?)</{n}>", 1), r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")), F.lit("")) for n in names]
        return F.coalesce(*found)

    href = F.nullif(F.regexp_extract("x", r"""(?is)<link\b[^>]*href=["']([^"']+)["']""", 1), F.lit(""))
    about = F.nullif(F.regexp_extract("x", r"""(?is)rdf:about=["']([^"']+)["']""", 1), F.lit(""))
    fields = F.struct(tag("title").alias("title"), F.coalesce(tag("link"), href, about).alias("link"), tag("description", "summary", "content").alias("description"), tag("pubDate", "published", "updated", "dc:date").alias("published"), F.coalesce(tag("guid", "id"), about).alias("guid"))
    return items.select("page", "pos", once(fields).alias("i")).select("page", "pos", "i.*")


_LINK = "array<struct<_VALUE:string,_href:string>>"
_ITEM = f"title string, link {_LINK}, description string, summary string, content string, pubDate string, published string, updated string, `dc:date` string, guid struct<_VALUE:string>, id string, `_rdf:about` string"


def read_feed_files(spark: SparkSession, path: str) -> DataFrame:
    """Items as of read_feed_items() from landed well-formed files, by Spark's XML source: page is the file's path, pos the place in it."""
    found = None
    for tag in ("item", "entry"):
        x = spark.read.format("xml").option("rowTag", tag).option("mode", "DROPMALFORMED").schema(_ITEM).load(path)
        x = x.select("*", F.col("_metadata.file_path").alias("page"), F.monotonically_increasing_id().alias("_n"))
        found = x if found is None else found.unionByName(x)
    text = lambda *c: F.coalesce(*[F.nullif(T.squeezed(T.decode_entities(F.col(n))), F.lit("")) for n in c])
    links = F.transform("link", lambda x: F.coalesce(F.nullif(F.trim(x["_VALUE"]), F.lit("")), x["_href"]))
    rows = found.select(
        "page", (F.row_number().over(Window.partitionBy("page").orderBy("_n")) - 1).alias("pos"), text("title").alias("title"), F.coalesce(F.get(F.filter(links, lambda x: x.isNotNull()), F.lit(0)), F.col("`_rdf:about`")).alias("link"),
        text("description", "summary", "content").alias("description"), text("pubDate", "published", "updated", "`dc:date`").alias("published"), F.coalesce(text("guid._VALUE", "id"), F.col("`_rdf:about`")).alias("guid"),
    )
    return rows


def read_undp(payloads: DataFrame, run_ts: Column, since: Column | None = None) -> DataFrame:
    """Notices of UNDP's feeds: items with a title and a link; an undated one takes ``run_ts``."""
    items = read_feed_items(payloads).where("title is not null and link is not null")
    at = F.when(F.col("published").isNull(), run_ts).otherwise(F.coalesce(V.feed_date(F.col("published")), V.parse_date(F.col("published"), "loose")))
    items = items.select("*", once(at).alias("published_at"))
    if since is not None:
        items = items.where(F.col("published_at") >= since)
    c = F.col
    return rows(items, "undp", {
        "external_id": F.coalesce("guid", "link"), "title": c("title"), "description": F.coalesce(F.nullif(T.strip_tags(c("description")), F.lit("")), c("title")), "url": c("link"), "buyer": F.lit("UNDP"),
        "sector": F.lit("UNDP Procurement Notice"), "cpv_codes": F.array(), "published_at": c("published_at"), "raw": F.to_json(F.struct(F.lit(UNDP_FEED).alias("sourceFeed"), "title", "link", "description", "published", "guid")),
    })
