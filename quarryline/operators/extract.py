"""From pages to product records: wrapper detection per site, field extraction, listings, links.

What regular expressions can find runs as Column functions; walking the element tree runs in Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import urljoin, urlparse

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import dom, urls
from ..functions import text as X
from ..functions.dom import Element
from ..schema import DEFAULTS, Settings

#: Candidate selectors by field, the first that fits wins (fixed values).
CANDIDATES = {
    "product_name": ("h1[class*=title]", "h1[class*=product]", "div[class*=product-name] h1", "h1[itemprop=name]", "h1.product-title", ".product-name h1", "[data-product-name]", 'meta[property="og:title"]'),
    "price": ("span[class*=price]", 'meta[property="product:price"]', "div[class*=price]", ".price-current", "[data-price]", ".product-price", "span.price"),
    "images": ("img[class*=product-image]", "div[class*=gallery] img", ".product-image img", ".gallery-slider img", 'meta[property="og:image"]'),
    "description": ("div[class*=description]", "div[itemprop=description]", ".product-description", ".product-info__description", "meta[name=description]"),
    "characteristics": ("table[class*=specs]", "div[class*=attributes]", "dl[class*=features]", ".product-specifications", ".technical-data table"),
    "rating": ("div[class*=rating]", "span[class*=stars]", 'meta[property="og:rating"]', ".product-rating", "[data-rating]"),
    "availability": ("span[class*=stock]", "link[itemprop=availability]", ".product-availability", ".stock-status", "[data-in-stock]"),
    "sku": ("span[class*=sku]", "meta[itemprop=sku]", ".product-sku", "[data-product-id]"),
}
CURRENCY = re.compile(r"[\d\s.,]+₽|руб|€|\$")
#: Selectors of listings, paths, menus and next links (fixed values).
LISTING = (".product", ".item", ".goods", ".product-item", "[class*=product]", "[class*=item]", ".card")
CRUMBS = (".breadcrumbs", ".breadcrumb", "[class*=breadcrumb]")
NAV = ("nav ul li a", ".navigation a", ".menu a", ".categories a", ".nav-menu a", "[class*=nav] a", "[class*=menu] a", "[class*=category] a")
NEXT = (".pagination .next a", ".pagination a[rel=next]", ".next-page", ".load-more")
NEXT_TEXTS = ("Далее", "Next")


def content(e: Element) -> str:
    return e.attrs.get("content", e.attrs.get("href", "")) if e.tag in ("meta", "link") else e.text()


def _fits(field: str, text: str) -> bool:
    if field == "price":
        return bool(re.search(r"\d", text))
    if field == "rating":
        return bool(re.search(r"[0-9.,]", text)) or "★" in text
    if field == "sku":
        return bool(re.search(r"[A-Za-z0-9-]", text))
    if field == "availability":
        return any(w in text.lower() for w in ("в наличии", "есть", "available", "stock"))
    return bool(text.strip())


def detect(page: str | None) -> dict[str, str]:
    """A selector for each field that the page shows."""
    root = dom.parse(page)
    out = {}
    for field, candidates in CANDIDATES.items():
        for selector in candidates:
            found = root.select(selector)
            if found and (field == "images" or _fits(field, content(found[0]))):
                out[field] = selector
                break
    if "price" not in out:
        for e in root.walk():
            if any(isinstance(c, str) and CURRENCY.search(c) for c in e.children):
                out["price"] = f"{e.tag}[class*=price]"
                break
    return out


def detect_selectors(pages: DataFrame) -> DataFrame:
    """(page_id, selectors map) of each page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"page_id": b["page_id"], "selectors": [detect(h) for h in b["html"]]})

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, selectors map<string,string>")


def site_selectors(pages: DataFrame) -> DataFrame:
    """(site, selectors): detected on the first page of each site by page_id, as a wrapper for the whole site."""
    sited = pages.withColumn("site", urls.host(F.col("url")))
    firsts = sited.groupBy("site").agg(F.min_by(F.struct("page_id", "html"), "page_id").alias("f")).select("site", "f.page_id", "f.html")
    return firsts.select("site", "page_id").join(detect_selectors(firsts), "page_id").select("site", "selectors")


RECORD = "page_id long, url string, name string, price_text string, description string, category string, sku_text string, rating_text string, availability_text string, images array<string>, characteristics map<string,string>, metadata map<string,string>"


def _first(root: Element, selector: str | None) -> str | None:
    found = root.select(selector) if selector else []
    return (content(found[0]).strip() or None) if found else None


def characteristics(root: Element, selector: str | None) -> dict[str, str]:
    """Rows of tables, `key: value` items of lists, dt and dd in turn; later ones win. Else pairs in the text."""
    out: dict[str, str] = {}
    for e in root.select(selector) if selector else []:
        for part in [e, *e.walk()] if e.tag not in ("table", "ul", "ol", "dl") else [e]:
            if part.tag == "table":
                for row in part.select("tr"):
                    cells = [c for c in row.walk() if c.tag in ("td", "th")]
                    if len(cells) >= 2 and cells[0].text() and cells[1].text():
                        out[cells[0].text()] = cells[1].text()
            elif part.tag in ("ul", "ol"):
                out |= {k.strip(): v.strip() for k, s, v in (i.text().partition(":") for i in part.select("li")) if s}
            elif part.tag == "dl":
                out |= {k.text(): v.text() for k, v in zip(part.select("dt"), part.select("dd"), strict=False)}
    return out


def images(root: Element, url: str, selector: str | None, keep: int = DEFAULTS.images_kept) -> list[str]:
    main = root.select(selector) if selector else []
    src = main[0].attrs.get("src") or main[0].attrs.get("content", "") if main else ""
    out = [urljoin(url, src)] if src else []
    for e in [e for e in root.select("img") if e.attrs.get("src")][:10]:
        if any(k in e.attrs["src"].lower() for k in ("product", "item", "goods")):
            out.append(urljoin(url, e.attrs["src"]))
    return list(dict.fromkeys(out))[:keep]


def breadcrumb(root: Element) -> str | None:
    for selector in CRUMBS:
        found = root.select(selector)
        if found:
            return " > ".join(e.text() for e in found[0].walk() if e.tag in ("a", "span")) or None
    for selector in (".category-path", ".product-category"):
        found = root.select(selector)
        if found:
            return found[0].text() or None
    return None


def record(page_id: int, url: str | None, page: str | None, selectors: dict[str, str]) -> tuple:
    root, s, url = dom.parse(page), selectors.get, url or ""
    meta = {e.attrs.get("name") or e.attrs.get("property"): e.attrs.get("content") for e in root.select("meta")}
    return (
        page_id, url, _first(root, s("product_name")), _first(root, s("price")), _first(root, s("description")), breadcrumb(root),
        _first(root, s("sku")), _first(root, s("rating")), _first(root, s("availability")), images(root, url, s("images")),
        characteristics(root, s("characteristics")), {k: v for k, v in meta.items() if k and v},
    )


def extract_products(pages: DataFrame, wrappers: DataFrame | None = None) -> DataFrame:
    """Product records of pages (page_id, url, html), by the wrappers of their sites or, without these, page by page."""
    from ..functions import measures as M

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in RECORD.split(", ")]
        for b in batches:
            found = b["selectors"] if "selectors" in b else [None] * len(b)
            rows = [record(i, u, h, detect(h) if s is None else dict(s)) for i, u, h, s in zip(b["page_id"], b["url"], b["html"], found, strict=True)]
            yield pd.DataFrame(rows, columns=names)

    light = pages.select("page_id", "url", "html")
    if wrappers is not None:
        light = light.withColumn("site", urls.host(F.col("url"))).join(wrappers, "site", "left").select("page_id", "url", "html", "selectors")
    raw = light.mapInPandas(run, RECORD)
    c = F.col
    given = F.when(F.size("characteristics") > 0, c("characteristics")).otherwise(F.create_map().cast("map<string,string>"))
    return raw.select(
        "page_id", "url", X.collapse(c("name")).alias("name"), M.price(c("price_text")).alias("price"), c("price_text").alias("currency_text"),
        X.collapse(c("description")).alias("description"), X.collapse(c("category")).alias("category"), M.sku(c("sku_text")).alias("sku"),
        M.rating(c("rating_text")).alias("rating"), M.availability(c("availability_text")).alias("availability"), "images",
        M.normalize_map(given).alias("characteristics"), "metadata",
    )


def listing(page_id: int, url: str, page: str | None) -> list[tuple]:
    """(page_id, name, url, price_text, image_url) of the products on a listing page; without name or link, none."""
    root = dom.parse(page)
    items = next((f for f in map(root.select, LISTING) if f), [])
    out = []
    for e in items:
        pick = lambda *ss: next((f[0] for f in (e.select(s) for s in ss) if f), None)  # noqa: B023, E731
        name, link = pick("h3", "h4", ".title", ".name", "[class*=title]"), pick("a")
        if name is None or link is None or not name.text() or not link.attrs.get("href"):
            continue
        price, image = pick(".price", ".cost", "[class*=price]"), pick("img")
        src = image.attrs.get("src") if image is not None else None
        out.append((page_id, name.text(), urljoin(url, link.attrs["href"]), price.text() if price is not None else None, urljoin(url, src) if src else None))
    return out


def listing_products(pages: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """(page_id, position, name, url, price, image_url, category_page_data)."""
    from ..functions import measures as M

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(*r[:1], k, *r[1:]) for i, u, h in zip(b["page_id"], b["url"], b["html"], strict=True) for k, r in enumerate(listing(i, u or "", h), 1)]
            yield pd.DataFrame(rows, columns=["page_id", "position", "name", "url", "price_text", "image_url"])

    raw = pages.select("page_id", "url", "html").mapInPandas(run, "page_id long, position int, name string, url string, price_text string, image_url string")
    raw = raw.where(F.col("position") <= settings.products_per_category)
    return raw.select("page_id", "position", "name", "url", M.price(F.col("price_text")).alias("price"), "image_url", F.lit(True).alias("category_page_data"))


def next_page(page: str | None, url: str) -> str | None:
    """The address of the page that follows a listing page."""
    root = dom.parse(page)
    for selector in NEXT:
        for e in root.select(selector):
            if e.attrs.get("href"):
                return urljoin(url, e.attrs["href"])
    for e in root.select("a"):
        if e.text() in NEXT_TEXTS and e.attrs.get("href"):
            return urljoin(url, e.attrs["href"])
    here = re.search(r"page[=/]?(\d+)", url, re.IGNORECASE)
    number = int(here[1]) if here else 1
    for e in [*root.select(".pagination a"), *root.select(".page-numbers a")]:
        if e.text().isdigit() and int(e.text()) > number and e.attrs.get("href") not in (None, "", url):
            return urljoin(url, e.attrs["href"])
    return None


def next_pages(pages: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"page_id": b["page_id"], "next_url": [next_page(h, u or "") for u, h in zip(b["url"], b["html"], strict=True)]})

    return pages.select("page_id", "url", "html").mapInPandas(run, "page_id long, next_url string")


def category_scan(pages: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """The products of paginated listings: of each category (an address without its page number) the first pages_per_category
    pages by number, each address once (the smallest page_id), with the products in order of page and place."""
    number = urls.page_number(F.col("url"))
    category = F.regexp_replace("url", "(?i)[?&/]?page[=/]?\\d+/?$", "")
    numbered = pages.select("page_id", "url", "html", category.alias("category_url"), number.alias("page_number"))
    once = numbered.groupBy("category_url", "page_number").agg(F.min_by(F.struct("page_id", "url", "html"), "page_id").alias("p"))
    rank = F.row_number().over(W.partitionBy("category_url").orderBy("page_number"))
    first = once.withColumn("_rn", rank).where(F.col("_rn") <= settings.pages_per_category).select("category_url", "page_number", "p.*")
    found = listing_products(first.select("page_id", "url", "html"), settings)
    return first.select("category_url", "page_number", "page_id").join(found, "page_id")


def nav_links(pages: DataFrame) -> DataFrame:
    """(page_id, position, name, href, url) of the links within nav elements, by regular expressions alone."""
    navs = F.array_join(F.regexp_extract_all("html", F.lit("(?s)<nav[^>]*>(.*?)</nav>"), F.lit(1)), "")
    tags = F.regexp_extract_all(navs, F.lit('(?s)(<a [^>]*href="[^"]*"[^>]*>.*?</a>)'), F.lit(1))
    rows = pages.select("page_id", F.col("url").alias("page_url"), F.posexplode(tags).alias("position", "tag"))
    href = F.regexp_extract("tag", 'href="([^"]*)"', 1)
    name = F.trim(F.regexp_replace(F.regexp_replace("tag", "(?s)<[^>]*>", ""), "\\s+", " "))
    return rows.select("page_id", "position", name.alias("name"), href.alias("href"), urls.resolve(href, F.col("page_url")).alias("url"))


def sitemap_links(sitemaps: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """(url, name, type) of the category addresses among the first locations of each sitemap (xml)."""
    found = F.slice(F.regexp_extract_all("xml", F.lit("<loc>\\s*([^<\\s]+)\\s*</loc>"), F.lit(1)), 1, settings.sitemap_locations)
    rows = sitemaps.where(F.contains("xml", F.lit("<?xml"))).select(F.explode(found).alias("url")).where(urls.is_category(F.col("url")))
    return rows.select("url", urls.category_name(F.col("url")).alias("name"), F.lit("sitemap").alias("type"))


def categories(pages: DataFrame, sitemaps: DataFrame | None = None, settings: Settings = DEFAULTS) -> DataFrame:
    """(name, url, type): valid category links of menus, then of sitemaps, each address once, the first kept."""
    nav = nav_links(pages).where(urls.is_valid_category(F.col("name"), F.col("url")))
    nav = nav.select("name", "url", F.lit("navigation").alias("type"), F.struct(F.lit(0).alias("s"), "page_id", "position").alias("_o"))
    if sitemaps is not None:
        none = F.lit(None)
        site = sitemap_links(sitemaps, settings).select("name", "url", "type", F.struct(F.lit(1).alias("s"), none.cast("long").alias("page_id"), none.cast("int").alias("position")).alias("_o"))
        nav = nav.unionByName(site)
    best = nav.groupBy("url").agg(F.min_by(F.struct("name", "type"), F.struct("_o", "name")).alias("b"))
    return best.select("b.name", "url", "b.type")


def meta_map(html: Column) -> Column:
    """name or property -> content of the meta tags that have both; later ones win."""
    tags = F.regexp_extract_all(html, F.lit("(?i)(<meta [^>]*>)"), F.lit(1))
    name = lambda t: F.regexp_extract(t, '(?i)(?:name|property)="([^"]*)"', 1)
    content_ = lambda t: F.regexp_extract(t, '(?i)content="([^"]*)"', 1)
    pairs = F.filter(F.transform(tags, lambda t: F.struct(name(t).alias("k"), content_(t).alias("v"))), lambda p: (p["k"] != "") & (p["v"] != ""))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda o: o["k"] == p["k"]))
    return F.map_from_entries(last)


def image_links(html: Column, url: Column, settings: Settings = DEFAULTS) -> Column:
    """Up to five distinct product pictures among the first ten, by regular expressions alone."""
    found = F.slice(F.regexp_extract_all(html, F.lit('(?i)<img [^>]*src="([^"]+)"'), F.lit(1)), 1, 10)
    wanted = F.filter(found, lambda s: F.lower(s).rlike("product|item|goods"))
    return F.slice(F.array_distinct(F.transform(wanted, lambda s: urls.resolve(s, url))), 1, settings.images_kept)


def text_pairs(text: Column) -> Column:
    """`key: value` and `key - value` pairs of plain text, keys under 50 and values under 100 characters."""
    found = F.concat(
        F.regexp_extract_all(text, F.lit("([\\p{L}\\p{N}_][\\p{L}\\p{N}_ ]*:\\s*[^\\n]+)"), F.lit(1)),
        F.regexp_extract_all(text, F.lit("([\\p{L}\\p{N}_][\\p{L}\\p{N}_ ]*\\s-\\s+[^\\n]+)"), F.lit(1)),
    )
    pair = F.transform(found, lambda s: F.split(s, ":\\s*|\\s-\\s+", 2))
    entries = F.transform(pair, lambda p: F.struct(F.trim(p[0]).alias("k"), F.trim(p[1]).alias("v")))
    kept = F.filter(entries, lambda e: (F.length(e["k"]) < 50) & (F.length(e["v"]) < 100))
    last = F.filter(kept, lambda e, i: ~F.exists(F.slice(kept, i + 2, F.size(kept)), lambda o: o["k"] == e["k"]))
    return F.map_from_entries(last)


def enrich(products: DataFrame, images_per_article: DataFrame | None = None) -> DataFrame:
    """products with an article where they lack one, and their images joined on."""
    from ..functions.ids import hash_article

    made = hash_article(F.col("name"), F.col("category"), F.col("characteristics"))
    own = F.col("article") if "article" in products.columns else F.lit(None).cast("string")
    out = products.withColumn("article", F.coalesce(own, made))
    return out if images_per_article is None else out.join(images_per_article, "article", "left")


def first_categories(found: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """At most ten categories a site, in order of address."""
    rank = F.row_number().over(W.partitionBy(urls.host(F.col("url"))).orderBy("url"))
    return found.withColumn("_rn", rank).where(F.col("_rn") <= settings.categories_per_site).drop("_rn")


def site_of(url: str) -> str:
    return urlparse(url).netloc
