"""Text rules as Column expressions.

Patterns carry ``(?U)`` or ``(?iu)`` where letters beyond ASCII must count as such.  Letter folding
for searches is ASCII only unless said otherwise, which is what the catalogue's store does.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_LOW, _UP = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# The words that mark legends and literature in names, and their forms.
LEGEND, LEGENDS, LITERATURE = "þjóðsaga", "þjóðsögur", "bókmenntir"


def nonnull(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def fold(c: Column) -> Column:
    """ASCII letters to upper case, all others as they are."""
    return F.translate(c, _LOW, _UP)


def strip(c: Column) -> Column:
    """Without white space of any script at the ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def chain(c: Column, *rules: tuple[str, str]) -> Column:
    """Ordered pattern rewriting: an earlier rule's output is the next rule's input."""
    return reduce(lambda x, rule: F.regexp_replace(x, rule[0], rule[1]), rules, c)


def _folded(text: str) -> str:
    return "".join(chr(ord(x) - 32) if "a" <= x <= "z" else x for x in text)


def matches_like(c: Column, before: str, text: str, after: str) -> Column:
    """LIKE on folded text; wildcards in ``text`` stay wildcards."""
    return like_folded(fold(c), before, text, after)


def like_folded(c: Column, before: str, text: str, after: str) -> Column:
    """``matches_like`` of a column that is folded."""
    return F.like(c, F.lit(before + _folded(text) + after))


def holds_parts(c: Column, text: str) -> Column:
    """Whether a folded column holds every part of a LIKE text, which is told faster than LIKE."""
    parts = [] if "\\" in text else [x for x in re.split("[%_]", _folded(text)) if x]
    return reduce(lambda a, b: a & b, (c.contains(x) for x in parts), F.lit(True))


# What is cut from names, and the forms of years in captions.
NAME_HEAD, BOILERPLATE = r"^(.*?)[,\-–—].*$", "ferðast og fræðast"
LEGEND_CUTS = ((rf"(?U),?\s*-?{LEGEND}\s*$", ""), (r"^\*", ""), (r'[.,;:!?"()\-]', " "))
PLAIN_CUTS = ((r'[.,;:!?"()\-–—„“”\']', " "),)
CATALOGUE_CUTS = ((rf"(?U),\s*[-]?{LEGEND}\s*$", ""), (r"(?U),\s*\d{4}\s*$", ""))
LEADING_YEARS = r"(?U)^(\d{4}(?:\s*[–\-]\s*\d{4})?)\s+(.+)$"


def place_name(c: Column) -> Column:
    """Lower case, cut at the first comma or dash that has something before it, without boilerplate."""
    low = F.lower(strip(nonnull(c)))
    head = F.regexp_extract(low, NAME_HEAD, 1)
    return squeeze(F.replace(F.when(strip(head) != "", head).otherwise(low), F.lit(BOILERPLATE), F.lit("")))


def legend_title(c: Column) -> Column:
    """Title without the legend mark, a leading star and punctuation."""
    return squeeze(chain(F.lower(strip(nonnull(c))), *LEGEND_CUTS))


def plain_title(c: Column) -> Column:
    """Lower case, punctuation as blanks."""
    return squeeze(chain(F.lower(nonnull(c)), *PLAIN_CUTS))


def catalogue_name(c: Column) -> Column:
    """Name without legend mark and closing year, lower case."""
    return F.lower(strip(chain(nonnull(c), *CATALOGUE_CUTS)))


def year_last(c: Column) -> Column:
    """``1783 event`` as ``Event, 1783`` for years (or ranges of them) from 1000 on."""
    years, rest = (F.regexp_extract(c, LEADING_YEARS, k) for k in (1, 2))
    moved = F.concat(F.upper(F.left(rest, F.lit(1))), F.substring(rest, 2, 1 << 30), F.lit(", "), years)
    return F.when((years != "") & (F.left(years, F.lit(4)).try_cast("int") >= 1000), moved).otherwise(c)


def first_paragraph(c: Column, most: int = 500) -> Column:
    first = strip(F.get(F.split(nonnull(c), "\n\n", -1), F.lit(0)))
    return F.when(F.length(first) > most, F.concat(F.left(first, F.lit(most)), F.lit("..."))).otherwise(first)


def _paragraphs(c: Column, longer_than: int) -> Column:
    lines = F.transform(F.split(c, "\n\n", -1), squeeze)
    return F.array_join(F.filter(lines, lambda x: F.length(x) > longer_than), "\n\n")


def join_lines(c: Column) -> Column:
    """Soft line ends joined, paragraph ends kept."""
    ends = F.replace(F.replace(F.replace(nonnull(c), F.lit("\r\r\n"), F.lit("\n")), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return _paragraphs(F.regexp_replace(ends, r"\n{3,}", "\n\n"), 0)


# The order and forms of markup that is dropped.
MARKUP = (
    *((r"\{\{[^{}]*\}\}", ""),) * 5,
    (r"(?iu)\[\[(?:File|Mynd|Image):[^\]]*\]\]", ""),
    (r"(?iu)\[\[(?:Flokkur|Category):[^\]]*\]\]", ""),
    (r"\[\[(?:[^|\]]*\|)?([^\]]*)\]\]", "$1"),
    (r"(?U)\[https?://[^\s\]]+ ([^\]]*)\]", "$1"),
    (r"\[https?://[^\]]*\]", ""),
    (r"'{2,}", ""),
    (r"(?s)<ref[^>]*>.*?</ref>", ""),
    (r"<ref[^/]*/?>", ""),
    (r"<[^>]+>", ""),
    (r"(?U)={2,}\s*[^=\n]+\s*={2,}", "\n\n"),
    (r"__[A-Z]+__", ""),
    (r"\n{3,}", "\n\n"),
)


def plain_markup(c: Column) -> Column:
    """Wiki markup as paragraphs of more than 20 characters."""
    return _paragraphs(chain(nonnull(c), *MARKUP), 20)


def clean_extract(c: Column) -> Column:
    return strip(chain(nonnull(c), (r"(?U)={2,}\s*[^=]+\s*={2,}", ""), (r"\n{3,}", "\n\n")))


def exported_story(c: Column) -> Column:
    """Story text with breaks as blank lines and left-over entities as blanks."""
    for old, new in (("<p>", "\n\n"), ("<br>", "\n\n"), ("(1,2)", ""), ("#47;", " "), ("amp;", " "), ("#39;", " ")):
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


# Letters without their marks (the catalogue's alphabet and its neighbours).
MARKED, BARE = "áàâäåéèêëíìîïóòôöõúùûüýÿñçÁÀÂÄÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÝÑÇ", "aaaaaeeeeiiiiooooouuuuyyncAAAAAEEEEIIIIOOOOOUUUUYNC"


def strip_marks(c: Column) -> Column:
    return F.translate(c, MARKED, BARE)


def url_slug(url: Column) -> Column:
    """Last part of a URL's path, lower case."""
    path = F.regexp_replace(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), "^/+|/+$", "")
    return F.lower(F.element_at(F.split(path, "/", -1), -1))


def article_url(lang: Column, title: Column) -> Column:
    return F.concat(F.lit("https://"), F.when(lang == "is", "is").otherwise("en"), F.lit(".wikipedia.org/wiki/"), F.replace(title, F.lit(" "), F.lit("_")))


def cap_first(c: Column) -> Column:
    return F.concat(F.upper(F.left(c, F.lit(1))), F.substring(c, 2, 1 << 30))


def lower_first(c: Column) -> Column:
    return F.concat(F.lower(F.left(c, F.lit(1))), F.substring(c, 2, 1 << 30))


def feature_story(name: Column, second: Column, kind: Column, note: Column, exists: Column, meaning: Column) -> Column:
    """Sentence about a named feature, its kind's meaning, and the note."""
    kind = nonnull(kind)
    head = F.concat(name, F.when(nonnull(second) != "", F.concat(F.lit(" ("), second, F.lit(")"))).otherwise(""), F.lit(" er "), kind)
    tail = F.when(nonnull(exists) == "Er ekki til", " sem er ekki lengur til.  ").otherwise(".  ")
    more = F.when(nonnull(meaning) != "", F.concat(F.lit("\n\n"), cap_first(kind), F.lit(" er "), lower_first(meaning))).otherwise("")
    return F.concat(head, tail, more, F.lit("\n\n"), nonnull(note))


def caption_and_text(c: Column, separator: str) -> tuple[Column, Column]:
    """Caption and text around the first separator; else the first line and the rest."""
    both, lines = F.split(c, _literal(separator), 2), F.split(strip(c), "\n", 2)
    has = c.contains(separator)
    pick = lambda k: F.when(has, strip(F.get(both, F.lit(k)))).otherwise(strip(F.coalesce(F.get(lines, F.lit(k)), F.lit(""))))
    return pick(0), pick(1)


def _literal(text: str) -> str:
    return "\\Q" + text + "\\E"


def unquoted(c: Column) -> Column:
    """Without one pair of equal quotes around the text."""
    s = strip(c)
    paired = s.rlike("(?s)^([\"']).*\\1$") & (F.length(s) >= 2)
    return F.when(paired, strip(F.substring(s, F.lit(2), F.length(s) - 2))).otherwise(s)


def spoken(name: Column, story: Column) -> Column:
    """Caption as a sentence of its own, a blank line, the story."""
    name, story = strip(nonnull(name)), strip(nonnull(story))
    return F.when(name == "", story).otherwise(F.concat(name, F.when(name.rlike("[.!?:]$"), "").otherwise("."), F.lit("\n\n"), story))


def has_letter(c: Column) -> Column:
    return nonnull(c).rlike(r"\p{L}")


def voice_tag(voice: str) -> str:
    """Short name of a voice: of ``xx-YY-NameNeural`` the name, of ``xx_YY-name-size`` the middle."""
    if voice.endswith("Neural"):
        return voice.rsplit("-", 1)[1].removesuffix("Neural").lower()
    return voice.split("-")[1] if "-" in voice else voice


def output_path(item_id: Column, folder: str, tag: str | None = None, lang: str = "is") -> Column:
    middle = f"-{tag}" if tag else ""
    return F.concat(F.lit(folder + "/"), item_id.cast("string"), F.lit(f"{middle}{'' if lang == 'is' else '_' + lang}.mp3"))


def tag_colour(tag: Column, colours: list[tuple[str, str]], default: str) -> Column:
    """Colour of the first listed word that the tag contains."""
    out = F.lit(default)
    for word, colour in reversed(colours):
        out = F.when(nonnull(tag).contains(word), colour).otherwise(out)
    return out


def html_escaped(c: Column) -> Column:
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def radius_label(metres: Column) -> Column:
    """Kilometres, rounded, from 1000 m on; else metres."""
    return F.when(metres >= 1000, F.concat(F.floor(metres / 1000 + 0.5).cast("string"), F.lit(" km"))).otherwise(F.concat(metres.cast("string"), F.lit(" m")))


def elevation(c: Column) -> Column:
    """Metres from free text: the first number, a comma as a decimal point, halves to even."""
    number = F.regexp_extract(F.replace(c, F.lit(","), F.lit(".")), r"-?\d+(?:\.\d+)?", 0)
    return F.bround(number.try_cast("double")).cast("int")


# How letters are written for English voices, and the clean-up before.
LATIN_PAIRS = (("Þ", "Th"), ("þ", "th"), ("Æ", "Ae"), ("æ", "ae"))
LATIN_FROM, LATIN_TO = "ÐðÖöÁáÉéÍíÓóÚúÝý", "DdOoAaEeIiOoUuYy"
ENGLISH_RULES = ((r"(?U)<\s*br\s*/?>", "\n\n"), (r"(?U)</?\s*p\s*>", "\n\n"), (r"(?U)\(\s*\d+(?:\s*,\s*\d+)+\s*\)", ""), (r"(?U)\s&\s", " and "))


def english_speech(c: Column) -> Column:
    """Text for English voices: breaks, footnote marks and ampersands, then plain Latin letters."""
    out = chain(nonnull(c), *ENGLISH_RULES)
    for old, new in LATIN_PAIRS:
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.regexp_replace(F.translate(out, LATIN_FROM, LATIN_TO), "[ \t]{2,}", " ")


def token_jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct words; 0 without words."""
    words = lambda c: F.filter(F.split(c, r"(?U)\s+", -1), lambda x: x != "")
    return list_jaccard(words(a), words(b))


def list_jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct elements; 0 without elements."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def leading_words(c: Column, n: int = 3) -> Column:
    return F.slice(F.filter(F.split(c, r"(?U)\s+", -1), lambda x: x != ""), 1, n)
