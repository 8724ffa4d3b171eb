"""Products and links from pages of the web, without fetching: pages and known addresses are tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockloom.functions.text import collapse, decode_entities, quote, search_name, slug, slug_variants, strip, strip_tags, url_title

# Patterns of product pages, in the order they are tried.
NAME_IN_HEADING = r'(?id)<h1[^>]*class="[^"]*product[^"]*title[^"]*"[^>]*>(.*?)</h1>'
NAME_IN_OPEN_GRAPH = r'(?i)<meta\s+property="og:title"\s+content="([^"]+)"'
TEXT_IN_OPEN_GRAPH = r'(?i)<meta\s+property="og:description"\s+content="([^"]+)"'
TEXT_IN_META = r'(?i)<meta\s+name="description"\s+content="([^"]+)"'
TEXT_IN_DIV = r'(?is)<div[^>]*class="[^"]*product[^"]*description[^"]*"[^>]*>(.*?)</div>'
LONGEST_TEXT = 500
MOST_LINKS = 3
TRANSLATE = "https://translate.google.com/translate?sl=ja&tl=en&u="
SEARCH = "https://www.google.com/search?q="


def name_in_title(site: str) -> str:
    return rf"(?iUd)<title>(.*?)\s*[|–-]\s*{site}"


def product_name(html: Column, site: str) -> Column:
    """Name by the first pattern that matches, even with an empty group; null if none does."""
    title = name_in_title(site)
    return (
        F.when(html.rlike(NAME_IN_HEADING), strip_tags(strip(F.regexp_extract(html, NAME_IN_HEADING, 1))))
        .when(html.rlike(title), strip(F.regexp_extract(html, title, 1)))
        .when(html.rlike(NAME_IN_OPEN_GRAPH), strip(F.regexp_extract(html, NAME_IN_OPEN_GRAPH, 1)))
    )


def product_description(html: Column) -> Column:
    """Description by the first pattern that matches; an empty one is null."""
    content = lambda p: F.nullif(decode_entities(strip(F.regexp_extract(html, p, 1))), F.lit(""))
    body = collapse(strip_tags(F.regexp_extract(html, TEXT_IN_DIV, 1)))
    return (
        F.when(html.rlike(TEXT_IN_OPEN_GRAPH), content(TEXT_IN_OPEN_GRAPH))
        .when(html.rlike(TEXT_IN_META), content(TEXT_IN_META))
        .when(html.rlike(TEXT_IN_DIV), F.nullif(F.left(body, F.lit(LONGEST_TEXT)), F.lit("")))
    )


def post_links(html: Column, blog: str) -> Column:
    """Addresses of posts of a blog in a page: distinct, in their order, without the blog's own page, three at most."""
    pattern = rf'https://{blog.replace(".", "[.]")}/[^"\s]+'
    found = F.array_distinct(F.regexp_extract_all(html, F.lit(pattern), F.lit(0)))
    return F.slice(F.filter(found, lambda u: (u != f"https://{blog}/") & ~u.endswith("/blog/")), 1, MOST_LINKS)


def blog_links(html: Column, name: Column, blog: str) -> Column:
    """Links (title, url, translated_url) of a product; a search where the page has none."""
    posts = F.transform(post_links(html, blog), lambda u: F.struct(url_title(u).alias("title"), u.alias("url"), F.concat(F.lit(TRANSLATE), quote(u)).alias("translated_url")))
    short = search_name(name)
    address = F.concat(F.lit(SEARCH), quote(F.concat(F.lit(f'site:{blog} "'), short, F.lit('"'))))
    search = F.array(F.struct(F.concat(F.lit("Search: "), short).alias("title"), address.alias("url"), address.alias("translated_url")))
    return F.when(F.size(posts) > 0, posts).otherwise(search)


def existing(urls: DataFrame, known: DataFrame) -> DataFrame:
    """Addresses that are known to exist."""
    return urls.join(known, "url", "left_semi")


def first_match(queries: DataFrame, products: DataFrame, key: str, name: str) -> DataFrame:
    """For each query the product whose handle is the first of the query's handles that exists.

    products: (handle, product).  Queries without a match are left out.
    """
    tried = queries.select(key, F.posexplode(slug_variants(slug(F.col(name)))).alias("pos", "handle"))
    met = tried.join(products.select("handle", "product"), "handle")
    return met.groupBy(key).agg(F.min_by(F.struct("handle", "product"), F.struct("pos", "product")).alias("hit")).select(key, "hit.handle", "hit.product")
