"""Text functions as Column expressions: no Python runs on the rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that queries and documents are not told apart by.
STOP_WORDS = (
    "a an the and or but in on at to for of with by from is are was were be been being have has had do does did not no it its this that as"
).split()

CJK = r"\p{IsHan}\p{IsHangul}\p{IsHiragana}\p{IsKatakana}"
FULLWIDTH = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
ASCII = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))


def trimmed(text: Column) -> Column:
    """White space of any script off both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def one_line(text: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def has_cjk(text: Column) -> Column:
    return text.rlike(f"[{CJK}]")


def normalize_query(text: Column) -> Column:
    """Trimmed, with full-width forms as ASCII."""
    return F.translate(trimmed(text), FULLWIDTH, ASCII)


def words(text: Column) -> Column:
    """Maximal runs of letters and digits, in lower case and order."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{Nd}]+"), lambda w: w != "")


def words_no_stop(text: Column) -> Column:
    """Words of two bytes at least that are no stop words."""
    return F.filter(words(text), lambda w: (F.octet_length(w) > 1) & ~w.isin(*STOP_WORDS))


def cjk_terms(run: Column, limit: int = 64) -> Column:
    """Terms of a run of CJK characters: single characters, then pairs, ``limit`` at most."""
    size = F.length(run)
    single = F.transform(F.sequence(F.lit(1), size), lambda i: F.substring(run, i, F.lit(1)))
    pairs = F.when(size > 1, F.transform(F.sequence(F.lit(1), size - 1), lambda i: F.substring(run, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    return F.slice(F.concat(single, pairs), 1, limit)


# Tags whose end breaks a line, and the character references that are decoded, & last.
BLOCK_TAGS = "p div li h1 h2 h3 h4 h5 h6 br tr blockquote".split()
REFERENCES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&mdash;", "—"), ("&ndash;", "–"), ("&hellip;", "…"), ("&amp;", "&"))


def _lines(text: Column) -> Column:
    """Lines with blanks and tabs as one blank and no white space at their ends."""
    return F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(F.regexp_replace(x, "[ \t]+", " "), r"(?U)^\s+|\s+$", ""))


def html_to_text(html: Column) -> Column:
    """Plain text of a page: scripts and styles off, line breaks after blocks, tags off, no blank lines."""
    out = F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>", "")
    out = F.regexp_replace(out, r"(?is)<style[^>]*>.*?</style>", "")
    out = F.regexp_replace(out, rf"(?i)</({'|'.join(BLOCK_TAGS)})[^>]*>", "\n")
    out = F.regexp_replace(out, r"<[^>]+>", "")
    for name, sign in REFERENCES:
        out = F.replace(out, F.lit(name), F.lit(sign))
    return F.array_join(F.filter(_lines(out), lambda x: x != ""), "\n")


def html_title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


# What goes from Markdown, in this order, and what stays of it.
MARKDOWN = (
    ("(?dm)^```[^`]*$", ""), (r"(?dm)^\|[-| :]+\|$", ""), (r"(?dm)(?:^\||\|$|(?<=[^|\n])\|(?=.*\|$))", " "), (r"(?dm)^#{1,6}\s+", ""),
    (r"(?dm)^[-*_]{3,}\s*$", ""), (r"(?dm)^>\s?", ""), (r"(?dm)^\s*[-*+]\s+", ""), (r"(?dm)^\s*\d+\.\s+", ""), (r"!?\[([^\]]*)\]\([^)]*\)", "$1"),
    (r"\[\[([^\]]+)\]\]", "$1"), ("`+([^`]*)`+", "$1"), (r"\*{1,3}(.+?)\*{1,3}", "$1"), ("_{1,3}(.+?)_{1,3}", "$1"),
)


def strip_markdown(text: Column) -> Column:
    """Plain text of Markdown; blank lines stay, two of them at most."""
    for pattern, to in MARKDOWN:
        text = F.regexp_replace(text, pattern, to)
    return trimmed(F.regexp_replace(F.array_join(_lines(text), "\n"), r"\n{3,}", "\n\n"))


def markdown_links(text: Column) -> Column:
    """Targets of links that don't lead to the web."""
    return F.filter(F.regexp_extract_all(text, F.lit(r"\]\(([^)\s]+)\)"), 1), lambda x: ~x.startswith("http"))


def link_hints(text: Column) -> Column:
    """(to_origin, rel_type, evidence) of the links in each line: ](target) refers unless it leads to the web, and after the
    last of these in a line [[target]] cites. The evidence is what is left of the line from where the link before it ends.
    """

    def found(line: Column, pattern: str, target: str, kind: str, tail: Column) -> Column:
        parts = F.regexp_extract_all(line, F.lit(pattern), 1)  # each from the end of the one before it
        return F.transform(
            parts,
            lambda x, i: F.struct(F.regexp_extract(x, target, 1).alias("to_origin"), F.lit(kind).alias("rel_type"), F.concat(F.array_join(F.slice(parts, i + 1, F.size(parts)), ""), tail).alias("evidence")),
        )

    def of_line(line: Column) -> Column:
        rest = F.regexp_replace(line, r"^.*\]\([^)]*\)", "")
        refers = F.filter(found(line, r"(.*?\]\([^)]*\))", r"^.*?\]\((.*)\)$", "ref", rest), lambda h: ~h["to_origin"].startswith("http"))
        cites = found(rest, r"(.*?\[\[.*?\]\])", r"^.*?\[\[(.*)\]\]$", "cite", F.regexp_replace(rest, r"^(.*?\[\[.*?\]\])*", ""))
        return F.filter(F.concat(refers, cites), lambda h: h["to_origin"] != "")

    return F.flatten(F.transform(F.split(text, "\n"), of_line))


def wikilinks(text: Column) -> Column:
    """(embed, target, section, alias) of [[target#section|alias]], each once."""
    found = F.regexp_extract_all(text, F.lit(r"(!?\[\[[^\]]+\]\])"), 1)
    inner = lambda x: F.regexp_extract(x, r"\[\[([^\]]+)\]\]", 1)
    target = lambda x: F.regexp_extract(inner(x), r"^([^#|]*)", 1)
    return F.array_distinct(
        F.transform(
            found,
            lambda x: F.struct(
                x.startswith("!").alias("embed"), F.trim(target(x)).alias("target"),
                F.trim(F.regexp_extract(inner(x), r"#([^|]*)", 1)).alias("section"), F.trim(F.regexp_extract(inner(x), r"\|(.*)$", 1)).alias("alias"),
            ),
        )
    )


def tags(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?:^|\s)#([\w/\-]+)"), 1))


def frontmatter(text: Column) -> Column:
    """Keys and values between the --- lines at the beginning."""
    block = F.regexp_extract(text, r"(?s)\A---\n(.*?)\n---", 1)
    pairs = F.filter(F.split(block, "\n"), lambda x: x.contains(":"))
    strip = lambda x: F.regexp_replace(F.trim(x), r"^[\"']|[\"']$", "")
    entry = lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("k"), strip(F.regexp_extract(x, r"^[^:]*:(.*)$", 1)).alias("v"))
    return F.map_from_entries(F.transform(pairs, entry))


def aliases(value: Column) -> Column:
    """Items of a list written as [a, b]."""
    return F.filter(F.transform(F.split(F.regexp_replace(value, r"^\[|\]$", ""), ","), lambda x: F.trim(x)), lambda x: x != "")


def notion_title(text: Column) -> Column:
    """A title without the 32 hex digits that exports put behind it."""
    return F.trim(F.regexp_replace(text, r"\s+[0-9a-f]{32}$", ""))


# Fixed value: what counts as white space at the ends of a text.
SPACES = " \t\n\v\f\r\x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000"


def stripped(text: Column) -> Column:
    """White space of any script off both ends, without a pattern."""
    return F.btrim(text, F.lit(SPACES))


def byte_cut(text: Column, limit: int) -> Column:
    """At most ``limit`` bytes of UTF-8, cut where a character ends."""
    raw = F.encode(text, "UTF-8")
    # A character begins with a byte that isn't 10xxxxxx: the cut goes back by the bytes of one that it would split.
    follows = lambda k: F.hex(F.substring(raw, limit + 1 - k, 1)).rlike("^[89AB]")
    back = F.when(~follows(0), 0).when(~follows(1), 1).when(~follows(2), 2).otherwise(3)
    cut = F.substring(raw, F.lit(1), F.greatest(F.lit(limit) - back, F.lit(0))).cast("string")
    return F.when(F.octet_length(text) <= limit, text).otherwise(cut)


def first_sentence(text: Column, limit: int = 120) -> Column:
    """Up to the first sentence mark that has over ten bytes before it, if that is at most ``limit`` bytes; else the text, cut there."""
    text = stripped(text)
    mark = lambda k: F.substring(text, k + 1, 1).isin(".", "!", "?") & (F.octet_length(F.substring(text, 1, k)) > 10)
    early = F.coalesce(*[F.when(mark(k), F.lit(k + 1)) for k in range(3, 11)])  # of up to four bytes a character
    late = F.nullif(F.length(F.regexp_extract(text, r"(?s)^(.{11,}?[.!?])", 1)), F.lit(0))
    sentence = stripped(F.left(text, F.coalesce(early, late)))
    whole = F.when(F.octet_length(text) <= limit, text).otherwise(F.concat(byte_cut(text, limit), F.lit("…")))
    return F.when(F.octet_length(sentence) <= limit, sentence).otherwise(whole)


def safe_filename(text: Column, limit: int = 80) -> Column:
    """A file name: separators as dashes, quotes and the like off, blanks as underscores."""
    return byte_cut(F.translate(text, "/\\:*| ?\"<>", "-----_"), limit)


def tokenize_query(text: Column) -> Column:
    """A query as it is, but each run of CJK characters as its terms joined by OR."""
    parts = F.regexp_extract_all(text, F.lit(rf"([{CJK}]+|[^\s{CJK}]+)"), 1)
    grouped = F.transform(parts, lambda x: F.when(has_cjk(x) & (F.length(x) > 1), F.concat(F.lit("("), F.array_join(cjk_terms(x), " OR "), F.lit(")"))).otherwise(x))
    return F.when(has_cjk(text), F.array_join(grouped, " ")).otherwise(text)


def normalize_pdf_text(text: Column) -> Column:
    """Text of a PDF: form feeds as line ends, no blanks at line ends, two line ends at most, no control characters."""
    out = F.regexp_replace(F.translate(text, "\f", "\n"), r"[ \t]+\n", "\n")
    return stripped(F.regexp_replace(F.regexp_replace(out, r"\n{3,}", "\n\n"), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", ""))


def source_label(title: Column, origin: Column, key: Column) -> Column:
    """title (origin), or the origin alone, or the id."""
    return F.when(F.coalesce(title, F.lit("")) != "", F.concat(title, F.lit(" ("), F.coalesce(origin, F.lit("")), F.lit(")"))).otherwise(F.coalesce(F.nullif(origin, F.lit("")), key.cast("string")))


def preview(text: Column, limit: int = 60) -> Column:
    """The first characters of a text, with an ellipsis if there are more."""
    text = stripped(text)
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit("…"))).otherwise(text)


def new_collection_name(title: Column) -> Column:
    """The name of a collection for a first document: the first four words of its title, in lower case."""
    return F.lower(F.array_join(F.slice(F.split(F.coalesce(F.nullif(one_line(title), F.lit("")), F.lit("default")), " "), 1, 4), " "))


# Fixed value: the signs that card ids are made of.
CARD_SIGNS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789!#"


def card_guid(text: Column) -> Column:
    """Ten signs, one for each of the first bytes of the SHA-1."""
    digest = F.unhex(F.sha1(text))
    byte = lambda i: F.conv(F.hex(F.substring(digest, i, 1)), 16, 10).cast("int")
    return F.concat(*[F.substring(F.lit(CARD_SIGNS), byte(i) % 64 + 1, F.lit(1)) for i in range(1, 11)])


def card_checksum(text: Column) -> Column:
    """The first 32 bits of the SHA-1 as a number."""
    return F.conv(F.substring(F.sha1(text), 1, 8), 16, 10).cast("long")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


# MIME types by extension; anything else is plain text.
MIME = {".md": "text/markdown", ".markdown": "text/markdown", ".html": "text/html", ".htm": "text/html", ".pdf": "application/pdf", ".json": "application/json", ".txt": "text/plain"}


def mime_type(path: Column) -> Column:
    found = F.element_at(F.create_map(*[F.lit(x) for kv in MIME.items() for x in kv]), extension(path))
    return F.coalesce(found, F.lit("text/plain"))


def source_type(origin: Column) -> Column:
    return (
        F.when(origin.startswith("http://") | origin.startswith("https://"), "url").when(origin.startswith("snippet:"), "snippet").when(extension(origin) == ".pdf", "pdf").otherwise("file")
    )


def node_label(title: Column, origin: Column) -> Column:
    """Title, else the origin's last part without extension, else the origin."""
    base = F.regexp_extract(origin, r"([^/]+?)(?:\.[^./]*)?$", 1)
    return F.coalesce(F.nullif(title, F.lit("")), F.nullif(base, F.lit("")), origin)


def is_uuid(text: Column) -> Column:
    return (F.length(text) == 36) & (F.size(F.split(text, "-")) == 5)


def entity_key(text: Column) -> Column:
    return F.lower(F.trim(text))


def predicate_key(text: Column) -> Column:
    return F.replace(F.lower(F.trim(text)), F.lit(" "), F.lit("-"))


def char_ngrams(word: Column, longest: int = 3) -> Column:
    """All substrings of one to ``longest`` characters, by length."""
    sizes = F.sequence(F.lit(1), F.least(F.lit(longest), F.length(word)))
    return F.flatten(F.transform(sizes, lambda n: F.transform(F.sequence(F.lit(1), F.length(word) - n + 1), lambda i: F.substring(word, i, n))))
