"""String operators as column expressions: normalization, tokens, sentence tests, joins, slugs, headings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as the reference system sees it, for Java patterns under (?U).
SPACE = r"[\s\x1c-\x1f]"
#: Han characters in layout rules.
HAN = "㐀-䶿一-鿿"
#: Punctuation that may stand alone on a line by mistake.
ORPHANS = ("。", "，", "；", "：", "、", ".", ",", ";", ":")
#: Sentence terminators and the closing marks that may follow them.
TERMINATORS = "。！？.!?"
CLOSERS = "”’\"'）)]】》〉"
#: Layout clean-up, applied in this order after white space is collapsed and trimmed.
LAYOUT_RULES = (
    (r"(?<=\d)\. +(?=\d)", "."),
    (rf"(?<=[{HAN}]) +(?=[{HAN}])", ""),
    (r" +(?=[，。；：？！、）】》])", ""),
    (r"(?<=[，。；：？！、]) +", ""),
    (r"(?<=[（【《]) +", ""),
    (r" +(?=[（【《])", ""),
    (rf"(?<=[）】》]) +(?=[{HAN}])", ""),
    (r"(?<=[A-Za-z0-9]) */ *(?=[A-Za-z0-9])", "/"),
    (r" +([％%])", "$1"),
)
#: Outline numbers and chapter markers.
NUMBERED_HEADING = r"^(\d+(?:\.\d+)+)(?:\s+|(?=[^\d.]))(.+)$"
CHAPTER_MARKER = r"^第\s*(\d+)\s*章$"
#: The token pattern; dotted numbers are one token unless an underscore touches them, characters outside a-z and 0-9 are one each.
TOKEN = r"(?<![a-z0-9_])[0-9]+(?:\.[0-9]+)*(?![a-z0-9_])|[a-z0-9]+|[\p{L}\p{N}]"
_WIDE = "".join(chr(c) for c in (*range(0xFF10, 0xFF1A), *range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B)))
_NARROW = "".join(chr(ord(c) - 0xFEE0) for c in _WIDE)


def replace(col: Column, pattern: str, by: str) -> Column:
    return F.regexp_replace(col, pattern, by)


def trimmed(col: Column) -> Column:
    """Without Unicode white space at either end."""
    return replace(col, rf"(?U)^{SPACE}+|{SPACE}+$", "")


def is_blank(col: Column) -> Column:
    """Null, empty or only white space."""
    return col.isNull() | ~col.rlike(rf"(?U)[^\s\x1c-\x1f]")


def normalize_text(col: Column) -> Column:
    """Layout clean-up of one text (S1): white space collapsed, spaces inside numbers, Han text and around marks removed.
    Null stays null."""
    out = F.trim(replace(col, rf"(?U){SPACE}+", " "))
    for pattern, by in LAYOUT_RULES:
        out = replace(out, pattern, by)
    return F.trim(out)


def folded(col: Column) -> Column:
    """Width forms of Latin letters and digits, case, and sharp s folded (S2, native path)."""
    return F.replace(F.lower(F.translate(col, _WIDE, _NARROW)), F.lit("ß"), F.lit("ss"))


def tokens(col: Column, stopwords: tuple[str, ...] = ()) -> Column:
    """Searchable terms in order, repeats kept (S3-S6). Null gives an empty array."""
    out = F.regexp_extract_all(folded(F.coalesce(col, F.lit(""))), F.lit(TOKEN), F.lit(0))
    if stopwords:
        stop = F.array(*[folded(F.lit(w)) for w in stopwords])
        out = F.filter(out, lambda t: ~F.array_contains(stop, t))
    return out


def ends_sentence(col: Column) -> Column:
    """Whether a text ends with a terminator, closing marks and white space aside (S7); false for null."""
    closers = "".join("\\" + c for c in CLOSERS)
    return F.coalesce(col.rlike(rf"(?U)[{TERMINATORS}](?:[{closers}]|{SPACE})*$"), F.lit(False))


def joined_continuation(left: Column, right: Column) -> Column:
    """Two parts of one paragraph (S10): a space only between two ASCII letters or digits."""
    a, b = trimmed_right(left), trimmed_left(right)
    spaced = a.rlike("[A-Za-z0-9]$") & b.rlike("^[A-Za-z0-9]")
    return F.when(spaced, F.concat(a, F.lit(" "), b)).otherwise(F.concat(a, b))


def trimmed_left(col: Column) -> Column:
    return replace(col, rf"(?U)^{SPACE}+", "")


def trimmed_right(col: Column) -> Column:
    return replace(col, rf"(?U){SPACE}+$", "")


def index_text(path: Column, content: Column) -> Column:
    """Heading path, an empty line, the content."""
    return F.concat(F.array_join(path, "\n"), F.lit("\n\n"), content)


def heading_number(col: Column) -> Column:
    """The outline number of a heading, empty if it has none."""
    return F.regexp_extract(col, NUMBERED_HEADING, 1)


def heading_level(number: Column) -> Column:
    """Dots of an outline number plus one."""
    return F.char_length(number) - F.char_length(F.replace(number, F.lit("."), F.lit(""))) + 1


def chapter_marker(col: Column) -> Column:
    """The marker rewritten without inner white space; null where the text is none."""
    number = F.regexp_extract(F.trim(col), CHAPTER_MARKER, 1)
    return F.when(number != "", F.concat(F.lit("第"), number, F.lit("章")))


def slug(col: Column) -> Column:
    """Runs of other characters than words to a hyphen; ``heading`` if nothing remains."""
    out = F.regexp_replace(F.regexp_replace(F.lower(col), rf"(?U)[^\w{HAN}]+", "-"), "^-+|-+$", "")
    return F.when(out == "", F.lit("heading")).otherwise(out)


def formula_prefix(col: Column) -> Column:
    """The part of a line before its first Han character; the whole line if it begins with one but is an equation."""
    head = F.trim(F.regexp_extract(col, rf"^([^{HAN}]*)", 1))
    return F.when((head == "") & looks_like_equation(col), F.trim(col)).otherwise(head)


def looks_like_equation(col: Column) -> Column:
    return col.rlike(r"[=+*/^<>≤≥∑√]") & col.rlike("[A-Za-z0-9]")


def occurrences(col: Column, part: Column) -> Column:
    """How often a part stands in a text, without overlap (S24); 0 for an empty part."""
    return F.when(F.char_length(part) > 0, (F.char_length(col) - F.char_length(F.replace(col, part, F.lit("")))) / F.char_length(part)).otherwise(0).cast("int")


def replaced_once(col: Column, find: Column, by: Column) -> Column:
    """The text with ``find`` replaced, an error if it doesn't stand there exactly once."""
    return F.when(occurrences(col, find) == 1, F.replace(col, find, by)).otherwise(F.raise_error(F.lit("the text to replace must occur exactly once")))


def query_instruction(instruction: str, query: Column) -> Column:
    """The template of query embeddings."""
    return F.format_string("Instruct: %s\nQuery: %s", F.lit(instruction), query)
