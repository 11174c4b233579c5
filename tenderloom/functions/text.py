"""Text columns: HTML clean-up, links, identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Named entities, in the order in which they are decoded (after numeric ones).
ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "))
#: Tags that end a line of a description, and the entities of descriptions in their order.
BLOCKS = "p|div|tr|li|h[1-6]|br"
PAGE_ENTITIES = (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&ndash;", "\u2013"), ("&mdash;", "\u2014"))


def let(value: Column, f) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _numeric(text: Column, hexadecimal: bool) -> Column:
    """Numeric entities of one form, decoded: what stands between them and their characters, woven together."""
    return let(text, lambda t: F.when(F.contains(t, F.lit("&#")), _woven(t, hexadecimal)).otherwise(t))


def _woven(text: Column, hexadecimal: bool) -> Column:
    pattern = "&#x([0-9a-fA-F]+);" if hexadecimal else "&#([0-9]+);"
    codes = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    between = F.split(text, pattern, -1)
    # code units of 16 bits, as in the text's own encoding; pairs of surrogates are left out
    unit = (lambda c: F.right(c, F.lit(4))) if hexadecimal else (lambda c: F.hex((c.try_cast("decimal(38,0)") % 65536).cast("long")))
    shown = F.transform(codes, lambda c: F.decode(F.unhex(F.lpad(unit(c), 4, "0")), "UTF-16BE"))
    return F.array_join(F.flatten(F.zip_with(between, shown, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")


def decode_entities(text: Column) -> Column:
    """Decimal, then hexadecimal, then named entities, one pass each: ``&amp;lt;`` becomes ``<``. Null is empty."""

    def decoded(out: Column) -> Column:
        out = _numeric(_numeric(out, False), True)
        for name, shown in ENTITIES:
            out = F.replace(out, F.lit(name), F.lit(shown))
        return out

    return let(F.coalesce(text, F.lit("")), lambda t: F.when(F.contains(t, F.lit("&")), decoded(t)).otherwise(t))


def squeezed(text: Column) -> Column:
    """Runs of Unicode white space as one blank, none at the ends."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), "^ | $", "")


def strip_tags(html: Column) -> Column:
    """Tags as blanks, squeezed, then decoded."""
    return decode_entities(squeezed(F.regexp_replace(F.coalesce(html, F.lit("")), "<[^>]+>", " ")))


def clean(text: Column) -> Column:
    return squeezed(decode_entities(text))


def html_to_text(html: Column) -> Column:
    """Block tags as line ends, no other tags, entities decoded, two line ends at most in a row, trimmed."""
    lines = F.regexp_replace(F.coalesce(html, F.lit("")), rf"(?i)</?(?:{BLOCKS})(?:[\s/][^>]*)?>", "\n")
    out = F.regexp_replace(lines, "<[^>]+>", "")
    for name, shown in PAGE_ENTITIES:
        out = F.regexp_replace(out, f"(?i){name}", shown)
    out = _numeric(out, False)
    return F.regexp_replace(F.regexp_replace(out, "\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def cell_text(html: Column) -> Column:
    """The text of a table cell."""
    return clean(strip_tags(html))


def first_link(html: Column) -> Column:
    """The first href, or null."""
    return F.nullif(F.regexp_extract(html, r"""(?i)href\s*=\s*["']([^"']+)["']""", 1), F.lit(""))


def absolutize(url: Column, base: str) -> Column:
    """A link as seen from ``base``: with a scheme as it is, else below the scheme, the host or the folder of ``base``."""
    scheme, _, rest = base.partition("://")
    host = f"{scheme}://{rest.split('/')[0]}"
    page = base.split("?")[0].split("#")[0]
    folder = page[: page.rindex("/") + 1] if "/" in rest else f"{host}/"
    return let(url, lambda u: _below(u, scheme, host, page, folder))


def _below(url: Column, scheme: str, host: str, page: str, folder: str) -> Column:
    below = F.when(url.startswith("//"), F.concat(F.lit(f"{scheme}:"), url)).when(url.startswith("/"), F.concat(F.lit(host), url)).when(url.startswith("?") | url.startswith("#"), F.concat(F.lit(page), url))
    return F.when(url.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), url).otherwise(below.otherwise(F.concat(F.lit(folder), F.regexp_replace(url, r"^(?:\./)+", ""))))


def pick_field(text: Column, patterns: list[str]) -> Column:
    """Group 1 of the first pattern whose cleaned match is not empty."""
    return F.coalesce(*[F.nullif(clean(strip_tags(F.regexp_extract(text, p, 1))), F.lit("")) for p in patterns])


def stable_id(source: Column, title: Column, url: Column) -> Column:
    return F.left(F.sha2(F.concat_ws(":", source, title, url), 256), F.lit(24))


def slugify(name: Column, most: int = 64, default: str = "tenant") -> Column:
    words = F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9]+", "-")
    return F.coalesce(F.nullif(F.substring(F.regexp_replace(words, "^-+|-+$", ""), 1, most), F.lit("")), F.lit(default))


def country_and_subject(title: Column) -> tuple[Column, Column]:
    """A title ``Country: subject``, cut at its first colon; without one, no country."""
    at = F.instr(title, ":")
    return F.when(at > 1, F.trim(F.substring(title, F.lit(1), at - 1))).otherwise(""), F.when(at > 1, F.trim(F.substring(title, at + 1, F.length(title)))).otherwise(title)


def longest(candidates: Column, fits) -> Column:
    """The longest element that fits, the first of equals; null if none does."""
    numbered = F.transform(F.filter(candidates, fits), lambda x, i: F.struct(F.length(x).alias("n"), (-i).alias("i"), x.alias("x")))
    return F.array_max(numbered)["x"]


def assemble(parts: list[Column], separator: str = "\n") -> Column:
    """The parts that are neither null nor empty, joined."""
    return F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull() & (x != "")), separator)


def assemble_list(parts: Column, separator: str) -> Column:
    """The array's elements that are not empty, joined."""
    return F.array_join(F.filter(parts, lambda x: x != ""), separator)


def word_splits(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")
