"""Listing portals: pages to rows by a table of fixed values, and one projection to common rows for all of them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V
from . import html as H
from .feeds import rows


@dataclass(frozen=True)
class Portal:
    """base: where relative links lead. buyer, country, currency, sector: what all its notices have. dates: dialect of
    parse_date(). buyer_from: columns that name the buyer, first come first. details: columns that make up the description,
    joined by ``separator``. sector_from: the column with the sector. countries: ISO codes of its country names."""

    base: str
    buyer: str
    country: str | None = None
    currency: str | None = None
    dates: str = "loose"
    buyer_from: tuple[str, ...] = ()
    details: tuple[str, ...] = ()
    separator: str = "\n\n"
    sector: str | None = None
    sector_from: str | None = None
    deadlines: bool = True
    countries: dict[str, str] | None = None


#: Country names in the EBRD's and in the UN's notices.
EBRD_COUNTRIES = {
    "albania": "AL", "armenia": "AM", "azerbaijan": "AZ", "belarus": "BY", "benin": "BJ", "bosnia and herzegovina": "BA", "bulgaria": "BG", "croatia": "HR", "cyprus": "CY", "czechia": "CZ", "côte d'ivoire": "CI", "cote d'ivoire": "CI",
    "egypt": "EG", "estonia": "EE", "georgia": "GE", "greece": "GR", "hungary": "HU", "iraq": "IQ", "jordan": "JO", "kazakhstan": "KZ", "kenya": "KE", "kosovo": "XK", "kyrgyz republic": "KG", "latvia": "LV", "lebanon": "LB", "lithuania": "LT",
    "moldova": "MD", "mongolia": "MN", "montenegro": "ME", "morocco": "MA", "nigeria": "NG", "north macedonia": "MK", "poland": "PL", "romania": "RO", "russia": "RU", "serbia": "RS", "slovak republic": "SK", "slovenia": "SI", "tajikistan": "TJ",
    "tunisia": "TN", "turkmenistan": "TM", "türkiye": "TR", "turkey": "TR", "ukraine": "UA", "uzbekistan": "UZ", "west bank and gaza": "PS",
}
UNGM_COUNTRIES = {
    "bangladesh": "BD", "pakistan": "PK", "india": "IN", "afghanistan": "AF", "sri lanka": "LK", "nepal": "NP", "bhutan": "BT", "maldives": "MV", "saudi arabia": "SA", "united arab emirates": "AE", "qatar": "QA", "oman": "OM", "kuwait": "KW",
    "bahrain": "BH", "jordan": "JO", "lebanon": "LB", "syria": "SY", "iraq": "IQ", "iran": "IR", "yemen": "YE", "egypt": "EG", "libya": "LY", "tunisia": "TN", "morocco": "MA", "sudan": "SD", "south sudan": "SS", "somalia": "SO", "ethiopia": "ET",
    "kenya": "KE", "uganda": "UG", "tanzania": "TZ", "rwanda": "RW", "burundi": "BI", "nigeria": "NG", "ghana": "GH", "côte d'ivoire": "CI", "ivory coast": "CI", "senegal": "SN", "mali": "ML", "burkina faso": "BF", "niger": "NE", "chad": "TD",
    "cameroon": "CM", "central african republic": "CF", "congo": "CG", "democratic republic of the congo": "CD", "drc": "CD", "angola": "AO", "zambia": "ZM", "zimbabwe": "ZW", "malawi": "MW", "mozambique": "MZ", "madagascar": "MG",
    "south africa": "ZA", "brazil": "BR", "argentina": "AR", "chile": "CL", "peru": "PE", "colombia": "CO", "venezuela": "VE", "bolivia": "BO", "ecuador": "EC", "paraguay": "PY", "uruguay": "UY", "mexico": "MX", "guatemala": "GT",
    "honduras": "HN", "haiti": "HT", "dominican republic": "DO", "cuba": "CU", "ukraine": "UA", "russia": "RU", "russian federation": "RU", "belarus": "BY", "moldova": "MD", "georgia": "GE", "armenia": "AM", "azerbaijan": "AZ", "turkey": "TR",
    "türkiye": "TR", "kazakhstan": "KZ", "uzbekistan": "UZ", "tajikistan": "TJ", "kyrgyzstan": "KG", "turkmenistan": "TM", "mongolia": "MN", "myanmar": "MM", "cambodia": "KH", "lao people's democratic republic": "LA", "laos": "LA",
    "vietnam": "VN", "thailand": "TH", "indonesia": "ID", "malaysia": "MY", "philippines": "PH", "papua new guinea": "PG", "fiji": "FJ", "solomon islands": "SB",
}

_DIGITAL, _PLANNING, _LINES = "IT / Digital", "Planning / Data", "\n"
#: Fixed values by source.
PORTALS = {
    "austender": Portal("https://www.tenders.gov.au/", "Australian Government", "AU", None, "austender", ("agency",), ("agency", "category", "unspsc"), sector_from="category"),
    "canada_buys": Portal("https://canadabuys.canada.ca/", "Government of Canada", "CA", "CAD", "loose", ("buyer",), ("buyer", "type"), sector_from="type"),
    "gem_india": Portal("https://bidplus.gem.gov.in/", "Government of India", "IN", "INR", "gem", ("buyer", "agency"), ("buyer", "agency", "value"), sector_from="agency"),
    "gebiz_sg": Portal("https://www.gebiz.gov.sg/", "Singapore Government", "SG", "SGD", "gebiz", ("agency",), ("agency", "type"), sector_from="type"),
    "gca_uk": Portal("https://www.gca.gov.uk/", "UK Government (GCA)", "GB", "GBP", "gca", (), ("description", "type"), sector_from="type"),
    "afdb": Portal("https://www.afdb.org/", "AfDB", None, None, "afdb", (), ("place", "category", "type"), sector_from="category"),
    "ifc": Portal("https://disclosures.ifc.org/", "IFC", None, "USD", "loose", (), ("place", "category", "status"), sector_from="category", deadlines=False),
    "iadb": Portal("https://www.iadb.org/", "IADB", None, "USD", "iadb", (), ("place", "category", "type"), sector_from="category", deadlines=False),
    "jica": Portal("https://www.jica.go.jp/", "JICA", "JP", None, "jica", (), ("category",), sector_from="category", deadlines=False),
    "ungm": Portal("https://www.ungm.org/", "UN Agency", None, None, "ungm", ("agency",), ("title", "type", "agency", "place"), _LINES, sector_from="type", countries=UNGM_COUNTRIES),
    "ebrd": Portal("https://ecepp.ebrd.com/delta/", "EBRD", None, None, "ecepp", ("buyer",), ("description", "type", "metadata"), sector_from="type", countries=EBRD_COUNTRIES),
    "ppra_pk": Portal("https://epms.ppra.gov.pk/", "Government of Pakistan", "PK", "PKR", "ppra", ("agency",), ("title", "description", "category", "agency"), _LINES, sector_from="category"),
    "ppra_punjab": Portal("https://eproc.punjab.gov.pk/", "Government of Punjab", "PK", "PKR", "punjab", ("agency",)),
    "pda_pk": Portal("https://www.pda.gov.pk/procurement.php", "Pakistan Digital Authority", "PK", None, "loose", (), ("title", "external_id", "deadline", "status"), " ", _DIGITAL),
    "nitb_pk": Portal("https://nitb.gov.pk/tender.html", "National Information Technology Board", "PK", None, "loose", (), ("title", "published", "status"), " ", _DIGITAL),
    "planning_commission_pk": Portal("https://pc.gov.pk/web/tender", "Ministry of Planning, Development & Special Initiatives", "PK", None, "loose", (), ("title", "published", "status"), " ", _PLANNING),
    "pitb_pk": Portal("https://pitb.gov.pk/tendernotices", "Punjab Information Technology Board", "PK", None, "loose", (), ("title", "published", "deadline"), " ", _DIGITAL),
    "ignite_pk": Portal("https://ignite.org.pk/rfps/", "Ignite National Technology Fund", "PK", None, "loose", (), ("title", "published", "deadline"), " ", _DIGITAL),
    "sop_pk": Portal("https://www.sop.gov.pk/Tenders", "Survey of Pakistan", "PK", None, "loose", (), ("title", "published", "deadline"), " ", _PLANNING),
    "urban_unit_pk": Portal("https://urbanunit.gov.pk/procurement", "The Urban Unit", "PK", None, "loose", (), ("title", "deadline", "opening"), " ", _PLANNING),
    "kuwait_capt": Portal("https://capt.gov.kw/en/tenders/opening-tenders/", "Kuwait Central Agency for Public Tenders", "KW", "KWD", "loose", ("agency",), ("title", "agency", "external_id", "published", "deadline"), " ", "Public Tender"),
}


@dataclass(frozen=True)
class Anchors:
    """Notices that are links. href: pattern of the link. id: pattern of its own id in it (group 1), else the link is the id. least: characters of
    a title. skip: titles of navigation. before, after: characters around the link that belong to it. labels: columns by
    the labels whose value stands in the next element; found: columns by patterns of their own (group 1)."""

    href: str
    id: str | None = None
    least: int = 1
    skip: str | None = None
    before: int = 0
    after: int = 2000
    labels: dict[str, tuple[str, ...]] = field(default_factory=dict)
    found: dict[str, str] = field(default_factory=dict)


#: Links, title lengths, windows and labels of portals whose notices are links.
ANCHORS = {
    "austender": Anchors(r'[^"]*/atm/show/[^"]+', "/atm/show/([^/?#]+)", after=4000, labels={"agency": ("Agency",), "unspsc": ("UNSPSC", "UNO"), "category": ("Category",), "deadline": ("Close (?:Date|Time)", "Closing Date"), "published": ("Publish(?:ed)? Date",)}),
    "canada_buys": Anchors(r'[^"]*/tender-notice/[^"/?#]+[^"]*', "/tender-notice/([^\"/?#]+)", 5, labels={"buyer": ("(?:Buyer|Procurement entity|Entity)",), "type": ("Notice Type",), "published": ("(?:Publication|Published) Date",), "deadline": ("Closing(?: Date)?",)}),
    "gem_india": Anchors(r'[^"]*(?:bidlists|showbidDocument|showradardirectorate)[^"]*', r"(?:bidlists|showbidDocument|showradardirectorate)/([\w-]+)", 4, before=600, labels={"buyer": ("Ministry",), "agency": ("Department",), "value": ("Value", "Estimated Value"), "published": ("Start Date", "Bid Start"), "deadline": ("End Date", "Bid End")}),
    "gebiz_sg": Anchors(r'[^"]*(?:BODetail|OpportunityDetail|NoticeDetail|Detail|opportunity)[^"]*(?:\.xhtml|opportunityId=)[^"]*', r"(?:itemId|opportunityId|noticeId)=([\w-]+)", 4, before=500, after=1500, labels={"agency": ("Agency",), "type": ("Type", "Solicitation"), "published": ("Published",), "deadline": (r"Clos(?:ing|ed)\s+(?:Date|At)",)}),
    "gca_uk": Anchors(r'[^"]*/agreements/RM[\w.-]+(?:\?[^"]*)?', r"/agreements/(RM[\w.-]+)", 3, after=3000, labels={"published": ("Start Date",), "deadline": ("End Date",), "type": ("Regulation",)}, found={"description": r"<p[^>]*>([\s\S]{20,600}?)</p>"}),
    "afdb": Anchors(r'[^"]*/en/documents/[^"?#]+', None, 8, "^(?:Procurement|Notices|Operations|Projects)$", labels={"place": ("Country",), "category": ("Sector",), "type": ("Type", "Notice Type"), "published": ("Publi(?:cation|shed)", "Date"), "deadline": ("Deadline", "Closing")}),
    "ifc": Anchors(r'[^"]*/project-detail/\d+[^"]*', r"/project-detail/(\d+)", 4, labels={"place": ("Country",), "category": ("Sector", "Industry"), "status": ("Status",), "published": ("Disclosure Date", "Board Approval", "Date")}),
    "jica": Anchors(r'[^"]*/english/information/notice/\d{4}/[^"]+\.html?', None, 8, "^(?:Notices?|Announcements?|Procurement|Read more|Top)$", before=500, after=0, found={"published": r"(\d{4}[/.\-]\d{1,2}[/.\-]\d{1,2})", "category": r"\[([^\]]{2,40})\]"}),
}


@dataclass(frozen=True)
class Cells:
    """Notices that are table rows. columns: the number of each column's cell. link: the cell with the link. head: titles of head
    rows. status: pattern of a status, where there is one. needs: columns that must not be empty."""

    columns: dict[str, int]
    link: int
    head: str
    status: str | None = None
    needs: tuple[str, ...] = ("title",)


#: Cells of portals whose notices are table rows.
CELLS = {
    "pda_pk": Cells({"external_id": 0, "title": 1, "deadline": 2, "status": 3}, 4, "tender description", "open|active", ("external_id", "title")),
    "nitb_pk": Cells({"title": 1, "published": 2, "status": 3}, 4, "^tender title$", "active"),
    "pitb_pk": Cells({"title": 0, "published": 2, "deadline": 3}, 1, "^title$"),
    "ignite_pk": Cells({"title": 0, "published": 1, "deadline": 2}, 3, "rfp detail"),
    "sop_pk": Cells({"title": 1, "published": 2, "deadline": 3}, 4, "^title$"),
}


def _none(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def anchor_rows(pages: DataFrame, source: str) -> DataFrame:
    """Items of a portal whose notices are links: the first link to each id on a page."""
    a = ANCHORS[source]
    found = H.extract_anchor_blocks(pages, a.href, a.before, a.after)
    own = F.regexp_extract("href", f"(?i){a.id}", 1) if a.id else F.lit("")
    url = T.absolutize(F.col("href"), PORTALS[source].base)
    found = found.withColumns({"url": url, "external_id": F.coalesce(_none(own), url)}).where(F.length("title") >= a.least)
    if a.skip:
        found = found.where(~F.col("title").rlike(f"(?i){a.skip}"))
    columns = {c: T.pick_field(F.col("context"), [rf"(?i){x}[^<]*<[^>]*>\s*([^<]+)" for x in labels]) for c, labels in a.labels.items()}
    columns |= {c: _none(F.trim(T.strip_tags(F.regexp_extract("context", f"(?i){p}", 1)))) for c, p in a.found.items()}
    return H.first_of_page(found, "external_id").withColumns(columns).drop("context")


def cell_rows(pages: DataFrame, source: str) -> DataFrame:
    """Items of a portal whose notices are table rows."""
    t = CELLS[source]
    cell = lambda k: F.get("cells", F.lit(k))
    found = H.extract_table_rows(pages, raw=True).select("page_id", F.col("row").alias("pos"), "cells")
    found = found.select("page_id", "pos", *[_none(T.cell_text(cell(k))).alias(c) for c, k in t.columns.items()], T.decode_entities(F.nullif(T.first_link(cell(t.link)), F.lit(""))).alias("url"))
    found = H.settled(found.withColumn("url", _none("url"))).dropna(subset=list(t.needs)).where(~F.col("title").rlike(f"(?i){t.head}"))
    if t.status:
        found = found.where(F.col("status").isNull() | F.col("status").rlike(f"(?i){t.status}"))
    return found


def _table_cells(pages: DataFrame) -> DataFrame:
    """(page_id, pos, tr, cells): table rows with the HTML of their data cells, also of cells that hold tables' head cells."""
    body = F.posexplode(F.regexp_extract_all("html", F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))).alias("pos", "tr")
    return H.settled(pages.select("page_id", body).withColumn("cells", F.regexp_extract_all("tr", F.lit(r"(?is)<td\b[^>]*>(.*?)</td>"), F.lit(1))))


def iadb_rows(pages: DataFrame) -> DataFrame:
    """Projects by number; their table has the columns number, operation, country, sector, title, cost, status, approval."""
    c = lambda k: _none(T.cell_text(F.get("cells", F.lit(k))))
    found = _table_cells(pages).where("size(cells) >= 5").select("page_id", "pos", c(0).alias("external_id"), c(2).alias("place"), c(3).alias("category"), c(4).alias("title"), c(6).alias("type"), c(7).alias("published"), T.first_link(F.get("cells", F.lit(4))).alias("link"))
    found = H.settled(found).where(F.col("external_id").rlike(r"^[A-Z]{2}-[A-Z]\d{3,5}$"))
    missing = F.concat(F.lit("/en/project-description-title%2C1303.html?id="), F.col("external_id"))
    return H.first_of_page(found, "external_id").where("title is not null").withColumn("url", F.coalesce("link", missing)).drop("link")


def ebrd_rows(pages: DataFrame) -> DataFrame:
    """Open, biddable notices: links to a notice's number in a row of title, type, exercise, published, closing, state and more.

    A title is ``Country: subject``; the buyer is the longest of four or more further details that is neither the country nor one
    capitalised word.
    """
    from .feeds import is_biddable

    link = r'(?is)<a\b[^>]*href="([^"]*viewNotice\.html\?displayNoticeId=(\d+)[^"]*)"[^>]*>(.*?)</a>'
    c = lambda k: T.cell_text(F.get("cells", F.lit(k)))
    found = _table_cells(pages).where("size(cells) >= 6").select("page_id", "pos", _none(F.regexp_extract("tr", link, 2)).alias("external_id"), F.regexp_replace(F.regexp_extract("tr", link, 1), "^/+", "").alias("url"), _none(F.trim(T.strip_tags(F.regexp_extract("tr", link, 3)))).alias("title"),
                                                           c(1).alias("type"), c(2).alias("exercise"), c(3).alias("published"), c(4).alias("deadline"), c(5).alias("state"), T.assemble_list(F.transform(F.slice("cells", 7, 1000), T.cell_text), ", ").alias("metadata"))
    found = H.settled(found).dropna(subset=["external_id", "title"]).where(V.parse_date(F.col("published"), "ecepp").isNotNull() & is_biddable(F.col("state"), F.col("type")))
    country, _ = T.country_and_subject(F.col("title"))
    details = F.filter(F.transform(F.split("metadata", r",(?![^()]*\))"), lambda x: F.trim(x)), lambda x: x != "")
    fits = lambda x: (F.length(x) > 3) & (F.lower(x) != F.lower(country)) & ~x.rlike("^[A-Z][a-z]*$")
    return found.withColumns({
        "place": country, "buyer": F.when(F.size(details) >= 4, T.longest(details, fits)), "description": F.when(F.col("exercise") != "N/A", F.col("exercise")),
    })


def ppra_rows(pages: DataFrame) -> DataFrame:
    """Numbered rows of Pakistan's federal portal: number, details, organisation, status, advertised, closing."""
    strong, small = r"(?is)<strong[^>]*>([^<]+)</strong>", r"(?is)<small[^>]*>([^<]*?)</small>"
    body = F.coalesce(_none(F.regexp_extract("html", r"(?is)<tbody[^>]*>(.*?)</tbody>", 1)), F.col("html"))
    row = r'(?s)<tr>\s*<td class="text-center align-middle">\s*\d+\s*</td>(.*?)</tr>'
    found = pages.select("page_id", F.posexplode(F.regexp_extract_all(body, F.lit(row), F.lit(1))).alias("pos", "tr"))
    found = H.settled(found.withColumn("cells", F.regexp_extract_all("tr", F.lit(r"(?is)<td[^>]*>(.*?)</td>"), F.lit(1)))).where("size(cells) >= 6")
    cell = lambda k: F.get("cells", F.lit(k))
    first = lambda k, p: T.decode_entities(F.trim(F.regexp_extract(cell(k), p, 1)))
    texts = F.transform(F.regexp_extract_all(cell(1), F.lit(small), F.lit(1)), lambda x: T.decode_entities(F.trim(x)))
    found = found.select("page_id", "pos", _none(first(0, strong)).alias("external_id"), _none(T.decode_entities(F.regexp_replace(F.trim(F.regexp_extract(cell(1), strong, 1)), "^['\"]", ""))).alias("title"),
                         T.longest(texts, lambda x: F.length(x) > 10).alias("longest"), _none(first(1, r'(?is)<small[^>]*class="[^"]*badge[^"]*"[^>]*>([^<]+)</small>')).alias("category"), _none(T.strip_tags(cell(2))).alias("agency"),
                         T.strip_tags(cell(4)).alias("published"), F.concat_ws(" ", _none(first(5, strong)), _none(first(5, r"(?is)<small[^>]*>([^<]+)</small>"))).alias("deadline"))
    found = H.settled(found).dropna(subset=["external_id", "title"]).withColumn("description", F.coalesce("longest", "title")).drop("longest")
    return found.withColumn("url", F.concat(F.lit("/public/tenders/tender-details/"), F.url_encode("external_id")))


#: Words of bodies and marks of references in Punjab's notices.
PUNJAB_BODY = r"(?i)\b(?:department|authority|board|ministry|government|district|directorate|institute|university|hospital|company|corporation)\b"
PUNJAB_REF = r"(?i)\b((?:PR|TR|EOI|RFP)[/\-\s]?[A-Za-z0-9\-/]+)\b"


def punjab_rows(pages: DataFrame) -> DataFrame:
    """Rows of five cells and more, in any order: the longest text is the title, a body (else the longest other text) the buyer,
    the earliest and the latest date frame it, and a reference, if any, is the id."""
    grid = r'(?is)<table[^>]*\b%s[^>]*>(.*?)</table>'
    named = F.regexp_extract("html", grid % r'id="[^"]*(?:GridView|dgr|grdTenders|gvTenders|dgTenders)[^"]*"', 1)
    classed = F.regexp_extract("html", grid % r'class="[^"]*(?:tender|gridview|gv|dg)[^"]*"', 1)
    found = _table_cells(pages.select("page_id", F.coalesce(_none(named), _none(classed), F.col("html")).alias("html"))).where("size(cells) >= 5")
    found = H.settled(found.withColumn("texts", F.transform("cells", T.strip_tags))).withColumn("title", T.longest(F.col("texts"), lambda x: F.length(x) > 12)).where("title is not null")
    others = F.filter("texts", lambda x: x != F.col("title"))
    body = F.get(F.filter(others, lambda x: x.rlike(PUNJAB_BODY)), F.lit(0))
    first, last = V.min_max_dates(F.transform("texts", lambda x: V.parse_date(x, "punjab")))
    found = found.withColumns({"agency": F.coalesce(body, T.longest(others, lambda x: F.lit(True))), "published_at": first, "deadline_at": last})
    found = H.settled(found)
    ref = F.get(F.filter(F.transform("texts", lambda x: F.regexp_extract(x, PUNJAB_REF, 1)), lambda x: x != ""), F.lit(0))
    made = F.concat(F.lit("ppra-punjab-"), F.regexp_replace(F.substring("title", 1, 60), r"\s+", "-"), F.lit("-"), F.coalesce(F.date_format("deadline_at", "yyyy-MM-dd"), F.lit("nodeadline")))
    link = _none(F.regexp_replace(T.decode_entities(F.regexp_extract("tr", r'(?i)<a[^>]+href="([^"]+)"', 1)), r"^\.?/", ""))
    return found.select("page_id", "pos", "title", "agency", "published_at", "deadline_at", F.coalesce(F.regexp_replace(ref, r"\s+", ""), made).alias("external_id"), F.coalesce(link, F.lit("ActiveTenders.aspx")).alias("url"))


def ungm_rows(pages: DataFrame) -> DataFrame:
    """Blocks by notice id, their cells between markers: 1 title, 2 deadline, 3 published, 4 agency, 5 type, 6 reference, 7 country."""
    blocks = H.split_blocks(pages, r'<div role="row"[^>]*data-noticeid="(\d+)"[^>]*>').withColumn("cells", F.slice(F.split("body", r'<div role="cell"[^>]*>', -1), 2, 100))
    blocks = H.settled(blocks).where("size(cells) >= 8")
    inner = lambda k, p: _none(F.trim(T.strip_tags(F.regexp_extract(F.get("cells", F.lit(k)), p, 1))))
    span = r"(?is)<span[^>]*>(.*?)</span>"
    found = blocks.select("page_id", F.col("block").alias("pos"), F.col("capture").alias("external_id"), inner(1, r'(?is)<span class="ungm-title[^"]*">(.*?)</span>').alias("title"), inner(2, span).alias("deadline"), inner(3, span).alias("published"), inner(4, span).alias("agency"),
                          F.coalesce(inner(5, r"(?is)<label[^>]*>(.*?)</label>"), inner(5, span)).alias("type"), inner(6, span).alias("reference"), inner(7, span).alias("place"), F.concat(F.lit("/Public/Notice/"), F.col("capture")).alias("url"))
    return H.settled(found).where("title is not null")


def kuwait_rows(pages: DataFrame) -> DataFrame:
    """Texts between labels, one notice after each mark."""
    blocks = pages.select("page_id", F.posexplode(F.slice(F.split("html", "(?i)TENDER INFO", -1), 2, 100_000)).alias("pos", "block")).withColumn("x", T.clean(T.strip_tags(F.col("block"))))
    blocks = H.settled(blocks)
    between = lambda a, b: _none(F.trim(F.regexp_extract("x", rf"(?i){a}\s+(.+?)\s+{b}", 1)))
    found = blocks.select("page_id", "pos", between(r"Tender no\.", "Organisation").alias("external_id"), between("Organisation", "Tender Subject").alias("agency"), between("Tender Subject", "Request date").alias("title"), between("Request date", "Last date").alias("published"), between("Last date", "Initial meeting date").alias("deadline"), F.lit(None).cast("string").alias("url"))
    return H.settled(found).dropna(subset=["title", "external_id"])


def urban_unit_rows(pages: DataFrame) -> DataFrame:
    """Headings, each followed by a deadline, an opening time and a link."""
    heads = pages.select("page_id", F.posexplode(F.slice(F.split("html", "(?i)<h5[^>]*>|<h4[^>]*>|#####", -1), 2, 100_000)).alias("pos", "x"))
    said = lambda p: _none(T.clean(T.strip_tags(F.regexp_extract("x", p, 1))))
    found = heads.select("page_id", "pos", _none(T.clean(T.strip_tags(F.get(F.split("x", "(?i)</h5>|</h4>|\n"), F.lit(0))))).alias("title"), said(r"(?is)Submission\s+Deadline\s*:?\s*(.*?)(?:Opening\s+Time|View\s+Document|</)").alias("deadline"), said(r"(?is)Opening\s+Time\s*:?\s*(.*?)(?:View\s+Document|</)").alias("opening"), T.first_link(F.col("x")).alias("url"))
    return H.settled(found).where(F.col("title").isNotNull() & ~F.col("title").rlike("(?i)annual procurement plan"))


def planning_rows(pages: DataFrame) -> DataFrame:
    """Rows with a heading of a known class, the first date in their text, and a status, where there is one."""
    found = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))).alias("pos", "tr")).withColumn("x", T.clean(T.strip_tags(F.col("tr"))))
    found = H.settled(found)
    title = _none(T.clean(T.strip_tags(F.regexp_extract("tr", r"""(?is)<h4[^>]*class=["'][^"']*classic-title1[^"']*["'][^>]*>(.*?)</h4>""", 1))))
    found = found.select("page_id", "pos", title.alias("title"), _none(F.regexp_extract("x", r"(\d{4}-\d{2}-\d{2}|\d{1,2}[-/]\d{1,2}[-/]\d{4})", 1)).alias("published"), _none(F.regexp_extract("x", r"(?i)Status:\s*(Open|Closed|Archive)", 1)).alias("status"), T.first_link(F.col("tr")).alias("url"))
    return H.settled(found).where(F.col("title").isNotNull() & F.coalesce(F.lower("status") == "open", F.lit(True)))


_ROWS = {"iadb": iadb_rows, "ebrd": ebrd_rows, "ppra_pk": ppra_rows, "ppra_punjab": punjab_rows, "ungm": ungm_rows, "kuwait_capt": kuwait_rows, "urban_unit_pk": urban_unit_rows, "planning_commission_pk": planning_rows}


def listing_items(pages: DataFrame, source: str) -> DataFrame:
    """The notices on a portal's pages (page_id, html) as texts: page_id, pos, title, url and what its pages have."""
    if source in ANCHORS:
        return anchor_rows(pages, source)
    return cell_rows(pages, source) if source in CELLS else _ROWS[source](pages)


def read_listing(pages: DataFrame, source: str, run_ts: Column, since: Column | None = None) -> DataFrame:
    """Common tender rows of a portal's pages."""
    return normalize_listing(listing_items(pages, source), source, PORTALS[source].base, run_ts, since)


def normalize_listing(items: DataFrame, source: str, base_url: str, run_ts: Column, since: Column | None = None) -> DataFrame:
    """Common tender rows of a portal's listing. items: title, url and, where the page has them, external_id, description,
    buyer, agency, category, type, status, value, place, published, deadline and more (texts), published_at, deadline_at (times).

    A buyer that the page lacks is the portal's; a row without a published date takes ``run_ts`` and
    passes ``since``; an id that the page lacks is made of source, title and url.
    """
    p, have = PORTALS[source], set(items.columns)
    cleaned = {c: _none(T.clean(F.col(c))).alias(c) for c in ("external_id", "place", "published", "deadline", *p.details, *p.buyer_from, p.sector_from) if c in have}
    known = {"title": T.clean(F.col("title")), "url": T.absolutize(F.coalesce("url", F.lit(base_url)), base_url), "raw": F.to_json(F.struct(*[F.col(c) for c in items.columns]))}
    times = {f"{c}_at": F.col(f"{c}_at") for c in ("published", "deadline") if f"{c}_at" in have}
    found = H.settled(H.settled(items).select(F.struct(*[x.alias(c) for c, x in (known | times).items()]).alias("known"), F.struct(F.lit(0).alias("_"), *cleaned.values()).alias("text")))
    text = lambda c: F.col(f"text.{c}") if c in cleaned else F.lit(None).cast("string")
    when = lambda c: F.col(f"known.{c}_at") if f"{c}_at" in have else V.parse_date(text(c), p.dates)
    title, url = F.col("known.title"), F.col("known.url")
    published = when("published")
    found = found if since is None else found.where(published.isNull() | (published >= since))
    country = V.country_iso2(text("place"), p.countries) if p.countries else F.lit(p.country)
    return rows(found, source, {
        "external_id": F.coalesce(text("external_id"), T.stable_id(F.lit(source), title, url)), "title": title, "url": url,
        "description": F.coalesce(_none(T.assemble([text(c) for c in p.details], p.separator)), title), "buyer": F.coalesce(*[text(c) for c in p.buyer_from], F.lit(p.buyer)), "country": country,
        "sector": text(p.sector_from) if p.sector_from else F.lit(p.sector), "cpv_codes": F.array(), "currency": F.lit(p.currency), "published_at": F.coalesce(published, run_ts),
        "deadline_at": when("deadline") if p.deadlines else F.lit(None), "raw": F.col("known.raw"),
    })


def union_sources(parts: list[DataFrame]) -> DataFrame:
    """All sources' rows as one table."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
