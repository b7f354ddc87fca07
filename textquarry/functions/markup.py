"""Column functions on markup: entities, and text without tags. All native."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import collapse_ws

LESS, MORE = "\x0e", "\x0f"
#: The entities in common use, in the order in which they are decoded.
ENTITIES = (("&lt;", LESS), ("&gt;", MORE), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))
#: Tags that end a paragraph.
PARAGRAPHS = ("p", "div", "h[1-6]", "li", "tr", "br")


def usual_entities(text: Column, names: tuple[str, ...] | None = None) -> Column:
    """The common entities decoded, or those of `names` alone; `<` and `>` become marks that no tag pattern meets."""
    for name, sign in ENTITIES:
        if names is not None and name not in names:
            continue
        text = F.replace(text, F.lit(name), F.lit(sign))
    return text


def signs(text: Column) -> Column:
    """Marks of `<` and `>` as the signs themselves."""
    return F.translate(text, LESS + MORE, "<>")


def strip_html(text: Column, blocks: bool = True) -> Column:
    """Text without tags. With `blocks` an array of paragraphs, cut where one ends, tags as blanks; else one line, tags as nothing. Entities are decoded and white space is collapsed; null stays null."""
    if not blocks:
        return collapse_ws(signs(usual_entities(F.regexp_replace(text, r"<[^>]*>", ""))))
    cut = F.regexp_replace(collapse_ws(text), rf"(?i)</(?:{'|'.join(PARAGRAPHS)})\s*/?>|<br\s*/?>", "\n")
    lines = F.split(F.regexp_replace(cut, r"<[^>]*>", " "), "\n")
    return F.filter(F.transform(lines, lambda x: collapse_ws(signs(usual_entities(x)))), lambda x: x != "")
