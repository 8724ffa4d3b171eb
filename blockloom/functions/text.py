"""String functions as column expressions.

Regular expressions here follow Unicode classes and let '.' stop at a line feed only: the prefix (?Ud).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUSE = "(?Ud)"
#: White space as str.strip and \s of Python see it.
SPACE = r"[\s\x1c-\x1f]"


def strip(c: Column) -> Column:
    """Without white space at both ends, of any script."""
    return F.regexp_replace(c, rf"{HOUSE}^{SPACE}+|{SPACE}+$", "")


def collapse(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.regexp_replace(strip(c), rf"{HOUSE}{SPACE}+", " ")


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, r"(?d)<.*?>", "")


def decode_entities(c: Column) -> Column:
    """&quot; and then &amp;, once each."""
    return F.replace(F.replace(c, F.lit("&quot;"), F.lit('"')), F.lit("&amp;"), F.lit("&"))


def escape_html(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def slug(name: Column) -> Column:
    """Handle of a name: lower case, letters, digits, underscores and single hyphens."""
    kept = F.regexp_replace(F.lower(name), rf"{HOUSE}[^\p{{L}}\p{{N}}_\s\x1c-\x1f-]", "")
    return F.regexp_replace(F.regexp_replace(kept, rf"{HOUSE}(?:-|{SPACE})+", "-"), "^-+|-+$", "")


def slug_variants(base: Column) -> Column:
    """Handles to try, in order; an entry may come again."""
    none = F.array().cast("array<string>")
    version = F.regexp_replace(base, r"-v(?U:\d+)$", "")
    no_set = F.regexp_replace(base, "-set$", "")
    all_sets = F.replace(base, F.lit("-set"), F.lit(""))
    out = F.concat(F.array(base), F.when(version != base, F.array(version)).otherwise(none))
    with_set = F.concat(out, F.array(no_set))
    memorial = F.concat(with_set, F.when(F.array_contains(with_set, all_sets), none).otherwise(F.array(all_sets)))
    out = F.when(base.contains("memorial"), memorial).otherwise(out)
    after = F.array(F.replace(base, F.lit("next"), F.lit("NEXT")), F.replace(base, F.lit("-next"), F.lit("")))
    return F.when(base.isNotNull(), F.concat(out, F.when(base.contains("next"), after).otherwise(none)))


def quote(c: Column) -> Column:
    """Percent-encoding that leaves letters, digits, '_.-~' and '/'."""
    c = F.url_encode(c)
    for a, b in (("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def title_case(c: Column) -> Column:
    """Each letter after a non-letter in upper case, other letters in lower case."""
    return F.aggregate(
        F.split(c, ""),
        F.struct(F.lit("").alias("s"), F.lit(False).alias("letter")),
        lambda acc, ch: F.struct(
            F.concat(acc["s"], F.when(acc["letter"], F.lower(ch)).otherwise(F.upper(ch))).alias("s"),
            ch.rlike(r"^\p{L}$").alias("letter"),
        ),
        lambda acc: acc["s"],
    )


def url_title(url: Column) -> Column:
    """Title from the last segment of an address."""
    last = F.element_at(F.split(F.regexp_replace(url, "/+$", ""), "/"), -1)
    return title_case(F.replace(last, F.lit("-"), F.lit(" ")))


def search_name(name: Column) -> Column:
    """Product name without words that narrow a search."""
    short = F.replace(name, F.lit("Complete Selection Modification"), F.lit("CSM"))
    return strip(F.regexp_replace(short, rf"(?iUd){SPACE}+(Limited|Clear|Edition|Set|Memorial)\b", ""))


#: Marks of list items: numbers, circled numbers, numbers in parentheses, bullets.
LIST_MARK = r"(?:[\p{Nd}]+[.)]|[①②③④⑤⑥⑦⑧⑨⑩]|\([\p{Nd}]+\)|[・•●○■□★☆※])"


def list_mark(c: Column) -> Column:
    """(mark, rest) of a list item; the mark is empty if there is none."""
    first = rf"{HOUSE}^((?:[\p{{Nd}}]+[.)]|[①②③④⑤⑥⑦⑧⑨⑩]|\([\p{{Nd}}]+\)|[・•\-●○■□★☆※]){SPACE}*)"
    mark = F.regexp_extract(c, first, 1)
    return F.struct(mark.alias("mark"), F.substring(c, F.length(mark) + 1, F.length(c)).alias("rest"))


def split_list(c: Column) -> Column:
    """Items of a text with two marks or more, text before the first mark dropped; else the text itself; null of null."""
    parts = F.split(c, rf"{HOUSE}(?:^|(?<={SPACE}))(?={LIST_MARK})")
    items = F.filter(F.transform(parts, strip), lambda x: x.rlike(rf"{HOUSE}^{LIST_MARK}"))
    return F.when(F.size(items) >= 2, items).when(c.isNotNull(), F.array(c))


def embedded_json(c: Column) -> Column:
    """From the first '{' to the last '}', null if there is none."""
    start = F.instr(c, "{")
    end = F.length(c) - F.instr(F.reverse(c), "}") + 1
    return F.when((start > 0) & c.contains("}") & (end >= start), F.substring(c, start, end - start + 1))


def block_key(c: Column) -> Column:
    """(page_idx, block_idx) of a key like '3-14'; both null if it is malformed."""
    parts = F.split(c, "-")
    ok = c.rlike(r"^[0-9]{1,9}-[0-9]{1,9}$")
    return F.struct(F.when(ok, F.get(parts, F.lit(0)).try_cast("int")).alias("page_idx"), F.when(ok, F.get(parts, F.lit(1)).try_cast("int")).alias("block_idx"))


def first_non_empty(*cs: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in cs))


def is_address(c: Column) -> Column:
    """Whether a path is an address of the web."""
    return c.startswith("http://") | c.startswith("https://")
