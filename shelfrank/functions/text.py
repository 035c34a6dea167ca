"""Text functions, Column to Column, all inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that the lexical search leaves out.
STOP_WORDS = ("the", "a", "an")


def tokenize(text: Column) -> Column:
    """Lower-case runs of a-z and 0-9 without stop words; repeats stay; null gives no tokens."""
    return F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)), lambda x: ~x.isin(*STOP_WORDS))


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda x: x != "")


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


#: What marketplaces put before and after titles.
TITLE_PREFIXES, TITLE_SUFFIXES = ("Amazon.com: ", "Amazon.com : "), (" - Etsy", " | Etsy")


def clean_title(title: Column) -> Column:
    """Title without marketplace prefixes and suffixes; each is removed at most once, in this order."""
    t = strip(F.coalesce(title, F.lit("")))
    for prefix in TITLE_PREFIXES:
        t = F.when(t.startswith(prefix), F.substr(t, F.lit(len(prefix) + 1))).otherwise(t)
    for suffix in TITLE_SUFFIXES:
        t = F.when(t.endswith(suffix), F.substr(t, F.lit(1), F.length(t) - len(suffix))).otherwise(t)
    return strip(t)


def clean_query(query: Column, limit: int = 200) -> Column:
    """A typed query without white space at its ends, cut to ``limit`` characters; null where nothing is left."""
    t = F.substring(strip(query), 1, limit)
    return F.when(t != "", t)


def slug(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def category_level1(category: Column) -> Column:
    return F.coalesce(F.element_at(F.split(category, " > "), 1), F.lit(""))


def taxonomy_level2(line: Column) -> Column:
    """The path of a taxonomy line of two levels, else null."""
    path = F.regexp_extract(line, "^[0-9].*? - (.*)$", 1)
    return F.when(line.rlike("^[0-9]") & (F.size(F.split(path, " > ")) == 2), path)


def clean_description(text: Column, limit: int = 600) -> Column:
    t = strip(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(F.lower(t).isin("", "na"), F.lit("(none)")).otherwise(F.substring(t, 1, limit))


def to_number(text: Column) -> Column:
    return text.try_cast("double")


def clean_price(price: Column, most: float = 100_000.0) -> Column:
    return F.when(price.isNotNull() & ~F.isnan(price) & (price > 0) & (price <= most), price)


def id_text(number: Column) -> Column:
    return number.cast("bigint").cast("string")


def json_part(reply: Column) -> Column:
    """From the first brace to the last one of a chatty reply; null without braces."""
    found = F.regexp_extract(F.coalesce(reply, F.lit("")), r"(?s)\{.*\}", 0)
    return F.when(found != "", found)


def render(template: str, fields: dict[str, Column]) -> Column:
    """A prompt: ``{name}`` in the template replaced by the column of that name."""
    out, rest = [], template
    while rest:
        at = min((i for n in fields if (i := rest.find("{" + n + "}")) >= 0), default=-1)
        if at < 0:
            out.append(F.lit(rest))
            break
        name = next(n for n in fields if rest.startswith("{" + n + "}", at))
        out += [F.lit(rest[:at]), F.coalesce(fields[name].cast("string"), F.lit(""))]
        rest = rest[at + len(name) + 2 :]
    return F.concat(*out)
