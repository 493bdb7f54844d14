"""Cleaning Markdown pages, all in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fewer words than this make a page a stub.
STUB_WORDS = 30

# The patterns that define a clean page. SPACE is what Unicode counts as white space.
FRONT_MATTER = r"(?s)\A---\n(.*?)\n---\n"
SHORTCODE = r"(?s)\{\{[%<]\s*.*?\s*[%>]\}\}"
TAG = r"<[^>]+>"
TRAILING_BLANKS = r"[ \t]+\n"
BLANK_LINES = r"\n{3,}"
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"


def universal_newlines(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n?", "\n")


def front_matter(text: Column) -> Column:
    """The block between the leading rules, '' without one. An empty block isn't one."""
    return F.regexp_extract(text, FRONT_MATTER, 1)


def without_front_matter(text: Column) -> Column:
    return F.regexp_replace(text, FRONT_MATTER, "")


def without_markup(text: Column) -> Column:
    """Without shortcodes, then without HTML tags."""
    return F.regexp_replace(F.regexp_replace(text, SHORTCODE, ""), TAG, "")


def tidy_space(text: Column) -> Column:
    """No blanks at line ends, no two blank lines in a row, nothing around the text, one line end after it."""
    t = F.regexp_replace(F.regexp_replace(text, TRAILING_BLANKS, "\n"), BLANK_LINES, "\n\n")
    t = F.regexp_replace(F.regexp_replace(t, rf"\A{SPACE}+", ""), rf"{SPACE}+\z", "")
    return F.concat(t, F.lit("\n"))


def clean_body(text: Column, newlines: bool = True) -> Column:
    """The cleaned body; newlines says whether CR LF is read as LF first, as a file reader does and a blob reader does not."""
    return tidy_space(without_markup(without_front_matter(universal_newlines(text) if newlines else text)))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, f"{SPACE}+"), lambda w: w != ""))


def is_stub(body: Column, least: int = STUB_WORDS) -> Column:
    return word_count(body) < least


def title_of(text: Column, path: Column) -> Column:
    """The front matter's title without quotes, else the file's stem."""
    said = F.regexp_extract(front_matter(text), r"(?m)^title:[ \t]*[\"']?(.*?)[\"']?[ \t]*$", 1)
    stem = F.regexp_replace(F.substring_index(path, "/", -1), r"(.)\.[^.]*$", "$1")
    return F.coalesce(F.nullif(said, F.lit("")), stem)


def front_matter_fields(text: Column) -> Column:
    """The front matter's plain fields, as an array of (key, value) in order: values without quotes, nested lines and lists left out."""
    field = r"^([A-Za-z_][A-Za-z0-9_-]*):[ \t]*[\"']?(.*?)[\"']?[ \t]*$"
    each = F.transform(F.split(front_matter(text), "\n"), lambda x: F.struct(F.regexp_extract(x, field, 1).alias("key"), F.regexp_extract(x, field, 2).alias("value")))
    return F.filter(each, lambda f: f["key"] != "")


def doc_id_of(path: Column, root: str = "content/handbook") -> Column:
    """A document's id: its path below the root, whatever stands before that, without its last suffix."""
    below = F.regexp_replace(path, rf"^(?:.*/)?{root}/", "")
    return F.regexp_replace(below, r"([^/])\.[^./]*$", "$1")


def paragraphs(text: Column) -> Column:
    return F.filter(F.split(text, r"\n\s*\n"), lambda p: F.length(F.regexp_replace(p, SPACE, "")) > 0)


def sentences(paragraph: Column) -> Column:
    return F.filter(F.split(paragraph, r"(?<=[.!?])\s+"), lambda s: F.length(F.regexp_replace(s, SPACE, "")) > 0)
