"""Text cleaning and string scalars as Column expressions; all stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.operators.common import let

# White space as Python's str.strip sees it.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# Page watermark patterns, applied in this order without regard to case.
WATERMARK_PATTERNS = [
    r"personal\s+use\s+only[,.]?\s*do\s+not\s+reproduce\.?",
    r"do\s+not\s+reproduce\.?\s*personal\s+use\s+only",
    r"\d{4}[-/]\d{2}[-/]\d{2}\s+\S+@\S+\.\S+",
    r"\S+@\S+\.\S+\s+\d{4}[-/]\d{2}[-/]\d{2}",
    r"\u00a9\s*\d{4}[^.]*\.?\s*all\s+rights\s+reserved\.?",
    r"confidential[:\s]+[^.]*\.?",
    r"proprietary[:\s]+[^.]*\.?",
    r"\bdraft\b",
    r"\bsample\s+copy\b",
]

# Characters replaced before speech normalisation.
CHARACTER_REPLACEMENTS = {
    "\u2018": "'",
    "\u2019": "'",
    "\u201c": '"',
    "\u201d": '"',
    "\u2013": "-",
    "\u2014": ", ",
    "\u2026": "...",
    "\u00a0": " ",
    "\u200b": "",
    "\u200c": "",
    "\u200d": "",
    "\ufeff": "",
    "\u00ad": "",
    "\u2022": ", ",
    "\u25cf": ", ",
    "\u00b7": ", ",
    "\u2212": "-",
    "\u00d7": " times ",
    "\u00f7": " divided by ",
    "\u2248": " approximately ",
    "\u2260": " not equal to ",
    "\u2264": " less than or equal to ",
    "\u2265": " greater than or equal to ",
}

# Abbreviations spelled out, in this order.
ABBREVIATIONS = {
    "Dr.": "Doctor",
    "Mr.": "Mister",
    "Mrs.": "Missus",
    "Ms.": "Miss",
    "Prof.": "Professor",
    "e.g.": "for example",
    "i.e.": "that is",
    "etc.": "et cetera",
    "vs.": "versus",
    "Fig.": "Figure",
    "fig.": "figure",
    "Ch.": "Chapter",
    "ch.": "chapter",
    "p.": "page",
    "pp.": "pages",
    "vol.": "volume",
    "ed.": "edition",
    "no.": "number",
}

# Fixed values: (pattern, replacement) of the speech normalisation after the abbreviations.
SPEECH_PATTERNS = [
    (r"https?://\S+", ""),
    (r"\S+@\S+\.\S+", ""),
    (r"\([A-Za-z&\s]+,?\s*\d{4}[a-z]?\)", ""),
    (r"\((?:[A-Za-z]+,?\s*\d{4}[a-z]?[;,]\s*)+[A-Za-z]+,?\s*\d{4}[a-z]?\)", ""),
    (r"(?i)[\[(](?:Figure|Table|Fig|Tab)\.?\s+[\d.]+[\])]", ""),
    (r"(?imd)^(?:Figure|Table|Fig|Tab)\.?\s+[\d.]+[.:]\s*", ""),
    (r"\(p{1,2}\.\s*\d+(?:\s*[-\u2013]\s*\d+)?\)", ""),
    (r"[\u00a9\u00ae\u2122]", ""),
    (r"\[\d+\]", ""),
    (r"(?<=\w)\s*(\d)\s*(?=[A-Z])", " "),
    (r"[.]{2,}", "."),
    (r"[,]{2,}", ","),
    (r"[-]{3,}", ", "),
    (r"(?<!\w)\s+[^aAI\s]\s+(?!\w)", " "),
    (r" {2,}", " "),
]

# Headings of a table of contents; the first matching pattern gives the number.
HEADING_PATTERNS = [
    r"^Chapter\s+(\d+)[:\s]*(.*)$",
    r"^CHAPTER\s+(\d+)[:\s]*(.*)$",
    r"^(\d+)\s+([A-Z][a-zA-Z\s]+)$",
    r"^Part\s+([IVX]+)[:\s]*(.*)$",
    r"^PART\s+([IVX]+)[:\s]*(.*)$",
]
PAGE_FILE_PATTERNS = [r"^Page_\d+\.pdf$", r"^[\d\-]+\.pdf$"]

# Characters with a meaning in full-text queries; backslash and slash are apart
# because the others end up with two backslashes in front, slash with one.
QUERY_SPECIALS = ["+", "-", "&", "|", "!", "(", ")", "{", "}", "[", "]", "^", '"', "~", "*", "?", ":"]


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def is_blank(text: Column) -> Column:
    return F.coalesce(F.length(strip(text)), F.lit(0)) == 0


def words(text: Column) -> Column:
    """Tokens between white space."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def count_tokens(text: Column) -> Column:
    return F.size(words(text))


def estimate_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 3)).cast("int")


def drop_repeated_lines(text: Column) -> Column:
    """Lines of 11 to 79 characters disappear from their fourth occurrence on.

    Sorting the lines with their numbers puts copies side by side, so a copy number is a look
    three places back; nothing leaves the row.
    """
    numbered = F.transform(
        F.split(text, "\n"), lambda line, i: F.struct(strip(line).alias("s"), i.alias("i"), line.alias("line"))
    )

    def early_copies(ranked):
        def keep(e, j):
            size = F.length(e["s"])
            fourth = F.coalesce(F.get(ranked, j - 3)["s"] == e["s"], F.lit(False))
            return ~((size > 10) & (size < 80) & fourth)

        return F.filter(ranked, keep)

    kept = let(F.array_sort(numbered), early_copies)
    back = F.array_sort(F.transform(kept, lambda e: F.struct(e["i"], e["line"])))
    return F.array_join(F.transform(back, lambda e: e["line"]), "\n")


# What a text must hold for the watermark pattern of the same place to match, in lower case.
WATERMARK_HINTS = ["personal", "reproduce", "@", "@", "\u00a9", "confidential", "proprietary", "draft", "sample"]
# letters beyond ASCII that count as s, k or i without regard to case
CASE_VARIANTS = "\u017f\u212a\u0130\u0131"
# The same for the speech patterns; none where a search would cost as much as the pattern.
SPEECH_HINTS = [["http"], ["@"], ["("], ["("], ["(", "["], [], ["(p"], ["\u00a9", "\u00ae", "\u2122"], ["["], [], [".."], [",,"], ["---"], [], ["  "]]
# \w of a text that holds only ASCII and the letters from C0 to FF
LATIN_WORD = r"[\w\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]"


def _holds(text: Column, parts) -> Column:
    found = [text.contains(part) for part in parts]
    return reduce(Column.__or__, found[1:], found[0])


def _replaced(text: Column, pattern: str, put: str, needed) -> Column:
    """The pattern replaced where the text passes a quick test; `text` is computed once."""
    return let(text, lambda t: F.when(needed(t), F.regexp_replace(t, pattern, put)).otherwise(t))


def remove_watermarks(text: Column) -> Column:
    for pattern, hint in zip(WATERMARK_PATTERNS, WATERMARK_HINTS):
        text = _replaced(text, f"(?iU){pattern}", "", lambda t, h=hint: F.lower(t).contains(h) | _holds(t, CASE_VARIANTS))
    return let(text, lambda t: F.when(F.size(F.split(t, "\n")) > 3, drop_repeated_lines(t)).otherwise(t))


def clean_text(text: Column) -> Column:
    """Watermarks, page-number lines, blank runs and end-of-line hyphens removed."""
    text = remove_watermarks(text)
    text = F.regexp_replace(text, r"(?mdU)^\d+\s*$", "")
    text = F.regexp_replace(text, r"\n{3,}", "\n\n")
    text = _replaced(text, r"(?U)(\w)-\n(\w)", "$1$2", lambda t: t.contains("-\n"))
    lines = F.filter(F.split(text, "\n"), lambda line: ~strip(line).rlike(r"^\d{1,3}$"))
    # a lone blank stays as it is
    text = F.regexp_replace(F.array_join(lines, "\n"), r"[ \t]{2,}|\t", " ")
    return strip(_replaced(text, r" +\n", "\n", lambda t: t.contains(" \n")))


def normalize_text(text: Column) -> Column:
    """Text as it should be spoken: symbols and abbreviations spelled out, references dropped."""
    one_to_one = {a: b for a, b in CHARACTER_REPLACEMENTS.items() if len(b) == 1}
    dropped = "".join(a for a, b in CHARACTER_REPLACEMENTS.items() if not b)
    text = F.translate(text, "".join(one_to_one) + dropped, "".join(one_to_one.values()))
    for char, spelled in CHARACTER_REPLACEMENTS.items():
        if len(spelled) > 1:
            text = F.replace(text, F.lit(char), F.lit(spelled))
    text = F.regexp_replace(text, r"[^\x00-\x7f\xc0-\xff]", " ")
    text = F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    # only these are left as white space, and the text is Latin from here on
    text = F.regexp_replace(text, r"[\t\n\r ]{2,}|[\t\n\r]", " ")
    for short, spelled in ABBREVIATIONS.items():
        text = F.replace(text, F.lit(short), F.lit(spelled))
    for pattern, put, hints in zip(*zip(*SPEECH_PATTERNS), SPEECH_HINTS):
        pattern = pattern.replace(r"\w", LATIN_WORD)
        if hints:
            text = _replaced(text, pattern, put, lambda t, h=hints: _holds(t, h))
        elif "^" in pattern and "m" in pattern[:6]:
            # there is one line, so the start of a line is the start of the text
            text = _replaced(text, pattern, put, lambda t: F.lower(F.substring(t, 1, 3)).isin("fig", "tab"))
        else:
            text = F.regexp_replace(text, pattern, put)
    return strip(text)


def sentences(text: Column, before_capital: bool = False) -> Column:
    """Sentences ending in . ! or ? before white space (and a capital letter, if asked)."""
    pattern = r"(?U)(?<=[.!?])\s+" + ("(?=[A-Z])" if before_capital else "")
    return F.filter(F.transform(F.split(text, pattern), strip), lambda s: s != "")


def text_preview(text: Column, size: int = 200) -> Column:
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("..."))).otherwise(text)


def safe_file_name(title: Column) -> Column:
    return F.replace(F.substring(F.regexp_replace(title, r"(?U)[^\w\s-]", ""), 1, 50), F.lit(" "), F.lit("_"))


def escape_query(query: Column) -> Column:
    """Query text with its special characters escaped for a full-text query language."""
    doubled = F.replace(query, F.lit("\\"), F.lit("\\\\"))
    specials = "".join("\\" + c for c in QUERY_SPECIALS)
    return F.replace(F.regexp_replace(doubled, f"([{specials}])", r"\\\\$1"), F.lit("/"), F.lit("\\/"))


def escape_markup(text: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def parse_model_json(reply: Column, schema: str) -> Column:
    """The outermost JSON object of a model reply, without code fences; null when unreadable."""
    text = strip(reply)
    fenced = F.when(
        text.contains("```json"), F.get(F.split(F.get(F.split(text, "```json"), F.lit(1)), "```"), F.lit(0))
    ).when(text.contains("```"), F.get(F.split(text, "```"), F.lit(1)))
    body = F.coalesce(fenced, text)
    found = F.regexp_extract(body, r"(?s)\{.*\}", 0)
    return F.from_json(F.when(found != "", found).otherwise(body), schema)


def toc_entries(toc: Column, offset: int = 13) -> Column:
    """Lines "number title page" of a contents list; printed pages are moved by `offset`."""
    pattern = r"(?U)^(\d+)\s+(.+?)\s+(\d+)$"
    hits = F.filter(F.transform(F.split(strip(toc), "\n"), strip), lambda line: line.rlike(pattern))
    return F.transform(
        hits,
        lambda line: F.struct(
            F.regexp_extract(line, pattern, 1).try_cast("long").alias("number"),
            strip(F.regexp_extract(line, pattern, 2)).alias("title"),
            (F.regexp_extract(line, pattern, 3).try_cast("long") + offset).alias("start_page"),
        ),
    )


def heading_number(title: Column) -> Column:
    """Number of the first heading pattern that fits; null when none fits or for page files."""
    hit = F.when(title.rlike(PAGE_FILE_PATTERNS[0]) | title.rlike(PAGE_FILE_PATTERNS[1]), F.lit(None))
    for pattern in HEADING_PATTERNS:
        hit = hit.when(title.rlike(f"(?iU){pattern}"), F.regexp_extract(title, f"(?iU){pattern}", 1))
    return hit


def natural_key(name: Column) -> Column:
    """Sortable parts of a name: digit runs compare as integers (length, then digits)."""
    lowered = F.lower(name)
    texts = F.split(lowered, r"\d+")
    digits = F.transform(F.regexp_extract_all(lowered, F.lit(r"(\d+)")), lambda d: F.ltrim(d, F.lit("0")))
    padded = F.transform(digits, lambda d: F.concat(F.lpad(F.length(d), 4, "0"), d))
    return F.flatten(F.transform(F.arrays_zip(texts.alias("t"), padded.alias("n")), lambda p: F.array_compact(F.array(p["t"], p["n"]))))


def first_tag(tags: Column, *names: str) -> Column:
    """First non-empty tag of `names`, whatever the case of the keys; the last spelling wins."""
    entries = F.map_entries(tags)

    def tag(name):
        named = F.filter(entries, lambda e: F.lower(e["key"]) == name)
        return F.nullif(F.try_element_at(named, F.lit(-1))["value"], F.lit(""))

    return F.coalesce(*[tag(name) for name in names])


_MINE_BODY = r"""["']?([^"']+?)["']?\s+by\s+([^,.]+)"""
_MINE_INTRO = r"(?iU)(?:this is|presenting|welcome to)\s+" + _MINE_BODY
_MINE_START = r"(?iU)^" + _MINE_BODY


def mine_metadata(intro: Column) -> Column:
    """Title, author and narrator named in the opening of a recording."""

    def group(text, pattern, n):
        found = strip(F.regexp_extract(text, pattern, n))
        return F.nullif(found, F.lit(""))

    def tidy(found):
        return F.regexp_replace(strip(found), r"[.,;:!?]+$", "")

    at_start = strip(intro)
    title = group(intro, _MINE_INTRO, 1)
    author = F.when(title.isNotNull(), group(intro, _MINE_INTRO, 2)).otherwise(group(at_start, _MINE_START, 2))
    return F.struct(
        tidy(F.coalesce(title, group(at_start, _MINE_START, 1))).alias("title"),
        tidy(F.coalesce(author, group(intro, r"(?iU)written by\s+([^,.]+)", 1))).alias("author"),
        tidy(group(intro, r"(?iU)(?:read|narrated)\s+by\s+([^,.]+)", 1)).alias("narrator"),
    )


def course_title(archive: Column) -> Column:
    for suffix in ("_Lectures", "_Videos", "_Course", "-Lectures", "-Videos"):
        archive = F.replace(archive, F.lit(suffix), F.lit(""))
    return F.replace(archive, F.lit("_"), F.lit(" "))


def lecturer(transcript: Column) -> Column:
    pattern = r"(?U)(?:I'm|I am|this is)\s+(?:Professor|Dr\.?)\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)"
    return F.coalesce(F.nullif(F.regexp_extract(F.substring(transcript, 1, 1000), pattern, 1), F.lit("")), F.lit("Unknown"))
