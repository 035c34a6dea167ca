"""Colours: free wording to a palette, and the colours that a query asks for."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# The palette, the words that stand for each of its colours, and words that are colours in product
# texts but usually something else in queries.
PALETTE = ("black", "white", "gray", "beige", "brown", "red", "pink", "orange", "yellow", "green", "blue", "purple", "gold", "silver", "multicolor", "clear")
WORDS = {
    "black": ("black", "jet", "onyx", "ebony"),
    "white": ("white", "ivory", "off-white", "offwhite", "snow"),
    "gray": ("gray", "grey", "charcoal", "slate", "graphite", "heather", "ash", "pewter", "smoke"),
    "beige": ("beige", "cream", "tan", "khaki", "camel", "nude", "sand", "oatmeal", "ecru", "taupe", "natural", "champagne", "bone", "linen", "neutral", "stone"),
    "brown": ("brown", "chocolate", "espresso", "walnut", "mocha", "cognac", "chestnut", "mahogany", "wood", "oak", "caramel", "coffee"),
    "red": ("red", "burgundy", "maroon", "wine", "crimson", "scarlet", "cherry", "brick", "oxblood", "ruby"),
    "pink": ("pink", "rose", "blush", "fuchsia", "magenta", "coral", "salmon"),
    "orange": ("orange", "rust", "copper", "tangerine", "peach", "apricot", "terracotta"),
    "yellow": ("yellow", "mustard", "lemon"),
    "green": ("green", "olive", "sage", "emerald", "mint", "forest", "lime"),
    "blue": ("blue", "navy", "denim", "cobalt", "indigo", "sky", "royal", "cyan", "periwinkle", "teal", "turquoise", "aqua"),
    "purple": ("purple", "lavender", "lilac", "violet", "plum", "eggplant", "mauve"),
    "gold": ("gold", "golden", "brass", "bronze"),
    "silver": ("silver", "chrome", "metallic", "platinum", "steel", "nickel"),
    "multicolor": ("multicolor", "multicolored", "multi", "rainbow", "colorful", "assorted", "print"),
    "clear": ("clear", "transparent"),
}
PHRASES = {"hot pink": "pink"}
AMBIGUOUS = (
    "print", "coffee", "wood", "wine", "natural", "neutral", "stone", "linen", "steel", "chocolate", "espresso", "champagne", "oak", "snow", "sky",
    "cherry", "ruby", "bone", "multi", "heather", "brick", "apricot", "lemon", "lime", "smoke", "ash", "sand", "royal", "forest", "jet", "metallic",
    "walnut", "coral", "salmon", "peach", "mint", "caramel",
)

BY_WORD = {w: color for color, ws in WORDS.items() for w in ws}


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(pairs.items())])


def _named(text: Column, pairs: dict[str, str]) -> Column:
    """Colours of the known words of ``text``, in order."""
    found = F.regexp_extract_all(text, F.lit("[a-z]+(?:-[a-z]+)?"), F.lit(0))
    known = _map(pairs)
    return F.transform(F.filter(found, lambda w: F.map_contains_key(known, w)), lambda w: F.element_at(known, w))


def normalize_color(raw: Column) -> Column:
    """Exact wording first; two colours joined by a separator are multicolor; else the last known word; else null."""
    text = F.trim(F.lower(raw))
    whole = _map(BY_WORD | PHRASES)
    named = _named(text, BY_WORD)
    joined = text.rlike(" and |/|,|&")
    return (
        F.when(F.map_contains_key(whole, text), F.element_at(whole, text))
        .when(joined & (F.size(F.array_distinct(named)) > 1), F.lit("multicolor"))
        .when(F.size(named) > 0, F.element_at(named, -1))
    )


def query_colors(text: Column) -> Column:
    """Sorted distinct palette colours that a query names; none where it says rose gold."""
    low = F.lower(F.coalesce(text, F.lit("")))
    sure = {w: c for w, c in BY_WORD.items() if w not in AMBIGUOUS}
    return F.when(F.contains(low, F.lit("rose gold")), F.array().cast("array<string>")).otherwise(F.array_sort(F.array_distinct(_named(low, sure))))
