"""Scalar text functions as column expressions."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words left out of title tokens (English and Portuguese).
STOP_WORDS = (
    "the", "a", "an", "of", "in", "on", "to", "for", "and", "with", "as", "at", "by", "from", "after", "over", "is", "are", "was", "were", "says",
    "said", "new", "o", "a", "os", "as", "de", "do", "da", "dos", "das", "em", "no", "na", "nos", "nas", "um", "uma", "por", "para", "com", "que",
    "e", "é", "ao", "à", "se", "mais", "após", "sobre",
)
# Capitalised words that are no entities by themselves.
ENTITY_STOP_WORDS = (
    "The", "A", "An", "This", "That", "These", "Those", "It", "In", "On", "At", "For", "And", "But", "New", "More", "Why", "How", "What", "When",
    "Live", "Watch", "Video", "Um", "Uma", "Os", "As", "Mais", "Como", "Porque",
)
# Parts of user agents that mark automated clients.
BOT_PARTS = (
    "bot", "crawl", "spider", "slurp", "curl", "wget", "python-requests", "headless", "phantom", "scrapy", "http-client",
)
# Words that attribute a statement to somebody.
ATTRIBUTION = (
    "said", "claimed", "alleged", "according to", "afirmou", "alegou", "segundo", "reivindic",
)


def _accents() -> tuple[str, str]:
    """Characters whose decomposition is one ASCII letter and marks, and those letters; bare marks are dropped."""
    pairs = [(chr(c), d[0]) for c in range(0xC0, 0x1F00) if len(d := unicodedata.normalize("NFD", chr(c))) > 1 and d[0].isascii() and all(map(unicodedata.combining, d[1:]))]
    return "".join(p[0] for p in pairs) + "".join(map(chr, range(0x300, 0x370))), "".join(p[1] for p in pairs)


_FROM, _TO = _accents()


def strip_accents(text: Column) -> Column:
    return F.translate(text, _FROM, _TO)


def _pieces(text: Column) -> Column:
    """Folded words in order, from one pass over the text; the first and the last may be empty."""
    return F.split(F.lower(strip_accents(text)), "[^a-z0-9]+")


def fold_text(text: Column) -> Column:
    """Accents off, lower case, all but a-z, 0-9 and space as one space, trimmed."""
    return F.trim(F.array_join(_pieces(text), " "))


def tokens(text: Column) -> Column:
    """Distinct folded words of more than two characters that aren't stop words, in order."""
    # isin of constants is a lookup in a set
    return F.array_distinct(F.filter(_pieces(text), lambda w: (F.length(w) > 2) & ~w.isin(*dict.fromkeys(STOP_WORDS))))


def slugify(title: Column) -> Column:
    slug = F.regexp_replace(F.regexp_replace(F.lower(strip_accents(title)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(F.substring(slug, 1, 80), F.lit("")), F.lit("event"))


def article_id(url: Column) -> Column:
    return F.concat(F.lit("ART-"), F.substring(F.sha1(url), 1, 16))


def event_id(seed: Column, when: Column) -> Column:
    return F.concat(F.lit("EVT-"), F.date_format(when, "yyyy-MM-dd"), F.lit("-"), F.upper(F.substring(F.sha1(seed), 1, 8)))


def folded_head(text: Column, n: int) -> Column:
    """The first n characters of a folded text; the whole is folded only where its first 4 n characters fold to fewer."""
    head = fold_text(F.substring(text, 1, 4 * n))
    # the last character of what is folded may be one that the next would have kept: a space
    return F.substring(F.when(F.length(head) > n, head).otherwise(fold_text(text)), 1, n)


def content_hash(title: Column, summary: Column) -> Column:
    return F.sha1(F.concat(fold_text(title), F.lit("|"), folded_head(F.coalesce(summary, F.lit("")), 400)))


def conflict_id(event: Column, field: Column) -> Column:
    return F.concat(F.lit("CFL-"), F.substring(F.sha1(F.concat(event, F.lit("|"), field)), 1, 12))


def session_hash(day: Column, ip: Column, agent: Column, salt: str) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", F.lit(salt), day, ip, agent), 256), 1, 32)


def is_bot(agent: Column) -> Column:
    """True for automated clients and for empty or missing agents."""
    return F.coalesce(F.lower(agent).rlike("|".join(BOT_PARTS)) | (agent == ""), F.lit(True))


def url_host(url: Column) -> Column:
    return F.coalesce(F.try_parse_url(url, F.lit("HOST")), url)


def term_match(text: Column, term: str | Column) -> Column:
    """Whether a term occurs as a word, case folded; an edge that is no ASCII letter or digit needs no boundary."""
    term = F.lit(term) if isinstance(term, str) else term
    t = F.trim(term)
    quoted = F.regexp_replace(t, r"([.*+?^${}()|\[\]\\])", r"\\$1")
    left = F.when(t.rlike("^[a-z0-9]"), F.lit("(?<![a-zà-ÿ0-9])")).otherwise("")
    right = F.when(t.rlike("[a-z0-9]$"), F.lit("(?![a-zà-ÿ0-9])")).otherwise("")
    return (t != "") & F.regexp_like(F.lower(text), F.concat(left, quoted, right))


def strip_markup(markup: Column) -> Column:
    """Text of markup: CDATA unwrapped, tags as spaces, named entities decoded (ampersands last), white space collapsed.

    Numeric entities are decoded where they occur by numeric_entities.
    """
    text = F.regexp_replace(markup, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")
    text = F.regexp_replace(text, "<[^>]*>", " ")
    for name, value in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("nbsp", " ")):
        text = F.replace(text, F.lit(f"&{name};"), F.lit(value))
    text = F.replace(numeric_entities(text), F.lit("&amp;"), F.lit("&"))
    return F.trim(F.regexp_replace(text, "[\\s ]+", " "))


def numeric_entities(text: Column) -> Column:
    """&#233; and &#xe9; as characters; numbers that are no characters become replacement characters."""
    number = r"&#(?:[0-9]{1,7}|x[0-9a-fA-F]{1,6});"
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(number), F.lit(0)))

    def decoded(e: Column) -> Column:
        hexed = F.startswith(e, F.lit("&#x"))
        code = F.when(hexed, F.conv(F.substring(e, F.lit(4), F.length(e) - 4), 16, 10)).otherwise(F.substring(e, F.lit(3), F.length(e) - 3)).cast("int")
        ok = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
        wide = F.lpad(F.hex(F.when(ok, code).otherwise(0xFFFD)), 8, "0")
        return F.decode(F.unhex(wide), "UTF-32")

    return F.aggregate(found, text, lambda t, e: F.replace(t, e, decoded(e)))


def parse_date(text: Column, as_of: Column) -> Column:
    """A timestamp from feed date formats; null if none fits or the year is before 1990 or after next year."""
    plain = F.trim(F.regexp_replace(text, r"^\s*[A-Za-z]{3,9},\s*", ""))
    zone = F.regexp_replace(plain, r"\s*(GMT|UTC|UT|Z)$", " +0000")
    found = F.coalesce(
        *[F.try_to_timestamp(zone, F.lit(f)) for f in ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm Z", "yyyy-MM-dd'T'HH:mm:ss Z", "yyyy-MM-dd'T'HH:mm:ss.SSS Z", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "yyyy-MM-dd")]
    )
    return F.when(F.year(found).between(1990, F.year(as_of) + 1), found)


# Small words that stand inside a name, and the words at which a report states a number.
NAME_PARTICLES = ("de", "da", "do", "of", "van", "von", "el")
CLAIM_WORDS = {
    "magnitude": ("magnitude", "mag.", "mag", "m"),
    "fatalities": ("killed", "dead", "deaths", "mortos", "mortes", "vítimas mortais", "vitimas mortais"),
    "injured": ("injured", "wounded", "feridos"),
    "depth_km": ("depth", "depth of"),
}
#: Whether a field's words stand before its number.
WORDS_FIRST = {"magnitude": True, "fatalities": False, "injured": False, "depth_km": True}


def _either(words: tuple[str, ...]) -> str:
    return f"(?:{'|'.join(words)})"


#: White space between the words of a name; a vertical tab is none.
SPACE = r"[ \t\n\f\r]+"


def _names() -> str:
    """A capitalised word that follows no letter, digit or underscore, and up to three more, with a particle before any of them."""
    word = r"[A-ZÀ-Þ][\wÀ-ÿ'’-]+"
    # a letter beyond U+FFFF in the pattern makes Java look behind by whole characters, not by halves of pairs
    return rf"(?<![\p{{L}}\p{{Nd}}_{chr(0x10000)}]){word}(?:{SPACE}(?:{_either(NAME_PARTICLES)}{SPACE})?{word}){{0,3}}"


ENTITY = _names()


def entity_candidates(text: Column) -> Column:
    """Runs of capitalised words, with particles between: at least three characters, at most three words, none twice."""
    stop = F.array(*[F.lit(w) for w in ENTITY_STOP_WORDS])
    # a lambda, since transform would pass F.trim the place in the array as the characters to trim
    found = F.transform(F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0)), lambda e: F.trim(e))

    def kept(e: Column) -> Column:
        ws = F.split(F.lower(e), SPACE)
        return (F.length(e) >= 3) & ~F.array_contains(stop, e) & (F.size(ws) <= 3) & (F.size(F.array_distinct(ws)) == F.size(ws))

    return F.filter(found, kept)


#: A number as reports write it: thousands in groups with commas, or digits with one decimal mark.
NUMBER = "[0-9]{1,3}(?:,[0-9]{3})+(?:[.][0-9]+)?|[0-9]+(?:[.,][0-9]+)?"


def numeric_claim(text: Column, field: str) -> Column:
    """The first number that a text states for a field, without thousands commas and with a decimal point; null if there is none.

    A number is stated for a field if the field's words stand right beside it, before or after it as the field has it;
    words and numbers are whole ones. Deaths may name people between, and a depth is one in km.
    """
    # longer words come first, so that one isn't taken for the beginning of another
    words = _either(tuple(re.escape(w).replace("\\ ", r"\s+") for w in sorted(CLAIM_WORDS[field], key=len, reverse=True)))
    apart = "[\\p{L}\\p{N}]"
    if WORDS_FIRST[field]:
        unit = rf"\s*km(?!{apart})" if field == "depth_km" else ""
        pattern = rf"(?iu)(?<!{apart}){words}\s*({NUMBER}){unit}"
    else:
        people = r"(?:people\s+)?" if field == "fatalities" else ""
        pattern = rf"(?iu)(?<![\p{{L}}\p{{N}}.,])({NUMBER})\s*{people}{words}(?!{apart})"
    raw = F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))
    return F.replace(F.regexp_replace(raw, ",(?=[0-9]{3}(?:[^0-9]|$))", ""), F.lit(","), F.lit("."))


def is_attributed(text: Column) -> Column:
    """Whether a text attributes what it says; a stem also matches inflected words."""
    return text.rlike(r"(?i)\b(" + "|".join(ATTRIBUTION) + r"\w*)\b")


def title_case(name: Column) -> Column:
    return F.initcap(name)


def label_of(labels: dict[str, str], key: Column) -> Column:
    """The label of a key, else the key."""
    pairs = [F.lit(x) for kv in labels.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), key) if pairs else key


def json_field(json: Column, path: str) -> Column:
    """A field of JSON text; null where the text can't be read."""
    return F.get_json_object(json, path)
