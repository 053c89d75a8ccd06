"""Text expressions: normal forms of names, title case, safe file names, markup removal.

Everything here is a Catalyst expression but ``normal_name`` and ``html_text``, which need Unicode
decomposition and a parser and run as Arrow-batched UDFs.
"""

from __future__ import annotations

import html
import re
import unicodedata
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Words kept lower case inside a title, and words kept upper case anywhere.
SMALL_WORDS = "a an the and but or nor for yet so at by in of on to up as into onto with from over than via per".split()
ACRONYMS = "BBQ MSG OJ NYC LA SF DC UK US EU TV".split()
# The marks that plain text loses, each with what stays, and where pages name their image.
MARKDOWN_MARKS = [
    (r"(?:og|twitter):\S+:.*\n?", ""),
    (r"!\[[^\]]*\]\([^)]*\)", ""),
    (r"\[([^\]]+)\]\([^)]*\)", "$1"),
    (r"(?m)^#{1,6}\s+", ""),
    (r"[*_]{1,2}", ""),
]
SOCIAL_IMAGE = r"(?:og|twitter):image:\s*(https?://\S+)"
EMBEDDED_IMAGE = r"!\[[^\]]*\]\((https?://[^)]+)\)"


def strip_space(text: Column) -> Column:
    """Outer whitespace of any kind removed; Spark's trim removes blanks only."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def collapse_space(text: Column) -> Column:
    """Every run of whitespace as one blank, none outside."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def exact_key(text: Column) -> Column:
    """Lower case without outer whitespace."""
    return strip_space(F.lower(text))


def match_key(text: Column) -> Column:
    """Lower case with whitespace collapsed; punctuation stays."""
    return collapse_space(F.lower(text))


def _normal(name: str | None) -> str | None:
    if name is None:
        return None
    plain = "".join(c for c in unicodedata.normalize("NFKD", name) if not unicodedata.combining(c))
    return re.sub(r"\s+", " ", re.sub(r"[^\w\s]", "", plain)).strip().lower()


@F.pandas_udf(StringType())
def _normal_udf(names: pd.Series) -> pd.Series:
    return names.map(_normal)


def normal_name(text: Column) -> Column:
    """Compatibility form without accents and punctuation, whitespace collapsed, lower case.

    Plain ASCII never leaves the JVM.
    """
    plain = F.lower(collapse_space(F.regexp_replace(text, r"[^A-Za-z0-9_\s]", "")))
    return F.when(text.rlike(r"^[\x00-\x7f]*$"), plain).otherwise(_normal_udf(F.when(~text.rlike(r"^[\x00-\x7f]*$"), text)))


def _capital(word: Column) -> Column:
    return F.concat(F.upper(F.substring(word, 1, 1)), F.lower(word.substr(F.lit(2), F.length(word))))


def title_case(text: Column) -> Column:
    """Title case: small words stay lower between the first and the last word, acronyms stay upper.

    Every part of a hyphenated word gets its capital. Blank text comes back as it is.
    """
    words = F.split(collapse_space(text), " ")
    last = F.size(words) - 1

    def part(p: Column) -> Column:
        return F.when(F.upper(p).isin(ACRONYMS), F.upper(p)).otherwise(_capital(p))

    def word(w: Column, i: Column) -> Column:
        small = (i > 0) & (i < last) & F.lower(w).isin(SMALL_WORDS)
        joined = F.array_join(F.transform(F.split(w, "-"), part), "-")
        return F.when(small, F.lower(w)).otherwise(joined)

    cased = F.array_join(F.transform(words, word), " ")
    return F.when(F.length(strip_space(text)) == 0, text).otherwise(cased)


def safe_file_name(text: Column, fallback: str = "Untitled_Recipe") -> Column:
    """Letters, digits, blanks, - and _ only; the fallback when nothing is left."""
    kept = strip_space(F.regexp_replace(text, r"[^\p{L}\p{N} _-]", ""))
    return F.coalesce(F.nullif(kept, F.lit("")), F.lit(fallback))


def split_lines(text: Column) -> Column:
    """The lines of a text that are not blank."""
    return F.filter(F.split(text, r"\R"), lambda s: strip_space(s) != "")


def markdown_text(text: Column) -> Column:
    """Markdown as plain text: social meta and images go, links keep their words, marks go."""
    for pattern, to in MARKDOWN_MARKS:
        text = F.regexp_replace(text, pattern, to)
    return strip_space(text)


def image_url(text: Column) -> Column:
    """The first social image address by position, else the first embedded image, else null."""
    social = F.regexp_replace(F.regexp_extract(text, SOCIAL_IMAGE, 1), r"\)\)$", ")")
    embedded = F.regexp_extract(text, EMBEDDED_IMAGE, 1)
    return F.coalesce(F.nullif(social, F.lit("")), F.nullif(embedded, F.lit("")))


class _Text(HTMLParser):
    """Collects text outside scripts, styles and templates; images may become markers."""

    HIDDEN = {"script", "style", "template"}

    def __init__(self, keep_images: set[str] | None = None, mark_images: bool = False):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden = 0
        self.keep, self.mark = keep_images, mark_images

    def handle_starttag(self, tag, attrs):
        if tag in self.HIDDEN:
            self.hidden += 1
        elif tag == "img" and self.mark and not self.hidden:
            name = (dict(attrs).get("src") or "").replace("\\", "/").split("?")[0].rsplit("/", 1)[-1]
            if name and (not self.keep or name in self.keep):
                self.parts.append(f"[IMAGE: {name}]")

    def handle_endtag(self, tag):
        if tag in self.HIDDEN and self.hidden:
            self.hidden -= 1

    def handle_data(self, data):
        if not self.hidden and data.strip():
            self.parts.append(data.strip())


def parse_html(source: str | None, keep_images: set[str] | None = None, mark_images: bool = False) -> str | None:
    """Visible text, one line per string; with ``mark_images`` images stay as markers."""
    if source is None:
        return None
    parser = _Text(keep_images, mark_images)
    parser.feed(source)
    parser.close()
    return "\n".join(parser.parts)


@F.pandas_udf(StringType())
def html_text(source: pd.Series) -> pd.Series:
    """Visible text of HTML, one line per string."""
    return source.map(parse_html)


def escape_html(text: str) -> str:
    return html.escape(text, quote=False)
