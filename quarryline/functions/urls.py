"""Column functions on URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Marks of category pages (fixed values).
CATEGORY_PARTS = ("/category/", "/categor/", "/kategor/", "/shop/", "/products/", "/catalog/", "/collection/")
PRODUCT_CATEGORY = ("/categor", "/category", "/kategor", "/kategoria", "/shop", "/products", "/tovary", "/catalog", "/collection", "/brand", "/type")
INDICATORS = ("product", "товар", "price", "цена", "buy", "купить", "add to cart", "в корзину", "товаров", "products")
STOP_NAMES = ("home", "main", "index", "contact", "about", "login", "register")
VALID = "^https?://[^\\s/$.?#].[^\\s]*$"


def scheme(url: Column) -> Column:
    return F.lower(F.nullif(F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1), F.lit("")))


def host(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)", 1), F.lit(""))


def base(url: Column) -> Column:
    return F.concat(scheme(url), F.lit("://"), host(url))


def path(url: Column) -> Column:
    return F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def site_key(url: Column) -> Column:
    return F.regexp_extract(url, "^(?:https?://)?([^/]*)", 1)


def page_number(url: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(url, "(?i)page[=/]?(\\d+)", 1), F.lit("")).try_cast("int"), F.lit(1))


def category_name(url: Column) -> Column:
    last = F.element_at(F.split(F.regexp_replace(url, "/+$", ""), "/"), -1)
    return F.initcap(F.regexp_replace(last, "[-_]", " "))


def subdomain(url: Column) -> Column:
    labels = F.split(host(url), "\\.")
    return F.when(F.size(labels) > 2, F.array_join(F.slice(labels, F.lit(1), F.greatest(F.size(labels) - 2, F.lit(0))), ".")).otherwise("")


def registered_domain(url: Column) -> Column:
    labels = F.split(host(url), "\\.")
    return F.when(F.size(labels) >= 2, F.array_join(F.slice(labels, -2, 2), ".")).otherwise("")


def problem(url: Column) -> Column:
    """What is wrong with a URL: no_host, bad_scheme, or null."""
    return F.when(scheme(url).isNull() | host(url).isNull(), "no_host").when(~scheme(url).isin("http", "https"), "bad_scheme")


def is_category(url: Column) -> Column:
    return F.lower(url).rlike("|".join(CATEGORY_PARTS))


def is_product_category(url: Column, page_text: Column) -> Column:
    """By its address, else by at least two indicators in its text."""
    low = F.lower(page_text)
    hits = sum((F.contains(low, F.lit(x)).cast("int") for x in INDICATORS), F.lit(0))
    return F.lower(url).rlike("|".join(PRODUCT_CATEGORY)) | (F.coalesce(hits, F.lit(0)) >= 2)


def is_valid_category(name: Column, url: Column) -> Column:
    return F.length(name).between(2, 100) & ~F.lower(name).rlike("|".join(STOP_NAMES)) & url.rlike("^https?://")


def resolve(href: Column, page_url: Column) -> Column:
    """href as an absolute URL: absolute, scheme-relative, host-relative or beside the page."""
    folder = F.regexp_replace(F.regexp_replace(page_url, "[?#].*$", ""), "(?<=[^/:])(?<!:/)/[^/]*$", "")
    return (
        F.when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme(page_url), F.lit(":"), href))
        .when(href.startswith("/"), F.concat(base(page_url), href))
        .otherwise(F.concat(folder, F.lit("/"), href))
    )
