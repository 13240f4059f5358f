"""Markup as rows of elements and attributes, their policies, and rebuilding of cleaned documents."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import lookups
from ..functions.checks import ascii_lower

TAG = r"<([A-Za-z][A-Za-z0-9_.:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>"
ATTRIBUTE = r"([A-Za-z_:][A-Za-z0-9_.:-]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')"


def markup_elements(pages: DataFrame, key: str = "page_id", html: str = "html", allowed: list[str] = lookups.ELEMENTS) -> DataFrame:
    """``key, ord, name, local, attributes, allowed`` for every start tag; ``local`` has no namespace prefix."""
    tags = F.regexp_extract_all(html, F.lit(TAG), F.lit(0))
    rows = pages.select(key, F.posexplode(tags).alias("ord", "tag"))
    name = F.regexp_extract("tag", TAG, 1)
    local = ascii_lower(F.element_at(F.split(name, ":"), -1))
    return rows.select(key, "ord", name.alias("name"), local.alias("local"), F.regexp_extract("tag", TAG, 2).alias("attributes"), local.isin(*allowed).alias("allowed"))


def markup_attributes(elements: DataFrame, key: str = "page_id") -> DataFrame:
    """``key, ord, local, name, value`` for each quoted attribute; names are lower-cased, and those of 128 bytes or more dropped."""
    found = [F.regexp_extract_all("attributes", F.lit(ATTRIBUTE), F.lit(i)) for i in (1, 2, 3)]
    rows = elements.select(key, "ord", "local", F.explode(F.arrays_zip(*(f.alias(n) for f, n in zip(found, "nab", strict=True)))).alias("x"))
    return rows.select(key, "ord", "local", ascii_lower(F.col("x.n")).alias("name"), F.concat("x.a", "x.b").alias("value")).filter(F.octet_length("name") < 128)


def attribute_policy(local: Column, name: Column, value: Column, allowed: list[str] = lookups.ATTRIBUTES) -> Column:
    """Why an attribute is dropped, or null: handlers, names outside the list, link targets, then styles."""
    low = ascii_lower(value)
    link = name.isin("href", "xlink:href")
    style = [low.contains(w) for w in lookups.STYLE_WORDS]
    bad_style = style[0] | style[1] | style[2] | style[3] | style[4]
    return (
        F.when(name.startswith("on"), "event_handler")
        .when(~name.isin(*allowed), "not_allowed")
        .when(link & (value == ""), "href_empty")
        .when(link & low.startswith("javascript:"), "href_javascript")
        .when(link & low.startswith("data:"), "href_data")
        .when(link & local.isin(*lookups.FRAGMENT_ONLY) & ~value.startswith("#"), "href_not_fragment")
        .when(link & ~(value.startswith("#") | low.startswith("http://") | low.startswith("https://")), "href_scheme")
        .when((name == "style") & bad_style, "style_unsafe")
    )


def doctype_rejected(head: Column) -> Column:
    """A document type declaration begins in the first 256 bytes and ends there too."""
    window = F.decode(F.substring(F.encode(F.coalesce(head, F.lit("")), "UTF-8"), 1, 256), "ISO-8859-1")
    return F.instr(ascii_lower(window), "<!doctype") > 0


def output_too_large(source: Column, output: Column) -> Column:
    """Cleaned markup of more than four times its source and more than 1 MiB."""
    return F.octet_length(output) > F.greatest(4 * F.octet_length(source).cast("long"), F.lit(1 << 20).cast("long"))


def _why(local: str, name: str, value: str, attributes: set[str]) -> bool:
    """Whether an attribute stays; the row form of ``attribute_policy``."""
    low = value.lower()
    if name.startswith("on") or name not in attributes or len(name.encode()) >= 128:
        return False
    if name in ("href", "xlink:href"):
        if not value or low.startswith(("javascript:", "data:")):
            return False
        if local in lookups.FRAGMENT_ONLY:
            return value.startswith("#")
        return value.startswith("#") or low.startswith(("http://", "https://"))
    return not (name == "style" and any(w in low for w in lookups.STYLE_WORDS))


def _local(name: str) -> str:
    """What follows the first colon, if there is one."""
    return name.partition(":")[2] if ":" in name else name


class _Rebuild:
    """Writes allowed elements again; what stands below a disallowed one is skipped."""

    def __init__(self, elements: set[str], attributes: set[str], first: str | None, most: int) -> None:
        self.elements, self.attributes, self.first, self.left = elements, attributes, first, most
        self.out: list[str] = []
        self.depth, self.skip, self.found, self.error = 0, 0, False, ""

    def put(self, s: str) -> None:
        self.left -= len(s.encode("utf-8", "replace"))
        if self.left < 0 and not self.error:
            self.error = "svg_output_too_large"
        if not self.error:
            self.out.append(s)

    def start(self, name: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.error:
            return
        self.depth += 1
        local = _local(name)
        if self.skip:
            return
        if local.lower() not in self.elements:
            self.skip = self.depth
            return
        if self.first and not self.found and local.lower() != self.first:
            self.error = "svg_root_not_svg"
            return
        self.found = True
        kept = ((n.lower(), v or "") for n, v in attrs)
        text = "".join(f' {n}="{self.escaped(v, True)}"' for n, v in kept if _why(local.lower(), n, v, self.attributes))
        self.put(f"<{local}{text}>")

    def end(self, name: str) -> None:
        if self.error:
            return
        if not self.skip:
            self.put(f"</{_local(name)}>")
        elif self.skip == self.depth:
            self.skip = 0
        self.depth -= 1

    def text(self, data: str) -> None:
        if not self.skip and self.depth and not self.error:
            self.put(self.escaped(data, False))

    @staticmethod
    def escaped(s: str, attribute: bool) -> str:
        s = s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
        return s.replace('"', "&quot;").replace("'", "&#39;") if attribute else s


def _xml(source: bytes, rebuild: _Rebuild) -> bool:
    parser = expat.ParserCreate()
    parser.ordered_attributes = True
    parser.StartElementHandler = lambda n, a: rebuild.start(n, list(zip(a[::2], a[1::2], strict=True)))
    parser.EndElementHandler = rebuild.end
    parser.CharacterDataHandler = rebuild.text
    try:
        parser.Parse(source, True)
    except expat.ExpatError:
        return False
    return True


def _html(source: bytes, rebuild: _Rebuild) -> bool:
    open_: list[str] = []

    class Parser(HTMLParser):
        def handle_starttag(self, tag: str, attrs: list) -> None:
            rebuild.start(tag, attrs)
            open_.append(tag)

        def handle_endtag(self, tag: str) -> None:
            if tag in open_:  # elements left open inside end here too
                while open_:
                    last = open_.pop()
                    rebuild.end(last)
                    if last == tag:
                        break

        def handle_startendtag(self, tag: str, attrs: list) -> None:
            rebuild.start(tag, attrs)
            rebuild.end(tag)

        def handle_data(self, data: str) -> None:
            rebuild.text(data)

    parser = Parser(convert_charrefs=True)
    parser.feed(source.decode("utf-8", "replace"))
    parser.close()
    while open_:
        rebuild.end(open_.pop())
    return True


def sanitize_markup(df: DataFrame, key: str, content: str, xml: bool = True, elements: list[str] = lookups.ELEMENTS, attributes: list[str] = lookups.ATTRIBUTES, root: str | None = "svg") -> DataFrame:
    """``key, verdict, reason, output`` of rebuilt markup.

    Disallowed elements go with all below them; comments, declarations and instructions vanish; kept tags lose their
    prefix and keep their case, attribute names are lower-cased, and each element gets an end tag. Null
    counts as empty. ``root`` names the element that must come first among the allowed ones (none: any).
    """
    kind = df.schema[key].dataType.simpleString()
    allow_el, allow_at = set(elements), set(attributes)

    def clean(source: bytes) -> tuple[str, str | None, str | None]:
        if not source:
            return "rejected", "svg_empty", None
        if xml and b"<!doctype" in source[:256].lower():
            return "rejected", "svg_doctype_rejected", None
        rebuild = _Rebuild(allow_el, allow_at, root, max(4 * len(source), 1 << 20))
        whole = (_xml if xml else _html)(source, rebuild)
        out = "".join(rebuild.out)
        # what the rebuilding ended with counts before what the parser did
        reason = rebuild.error or (not whole and "svg_malformed") or (root and not rebuild.found and "svg_no_root_element") or (root and not out and "svg_empty_result")
        if reason:
            return "rejected", reason, None
        return "sanitized", None, out

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [clean(x.as_py() or b"") for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[i] for r in rows], pa.string()) for i in range(3))], [key, "verdict", "reason", "output"])

    return df.select(key, F.col(content).cast("binary")).mapInArrow(job, f"{key} {kind}, verdict string, reason string, output string")
