"""Column functions: tokens, folding, snippets, labels, numerals and keys."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dictionaries import Dictionary, replaced

TOKEN = r"[\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    """Lower-case words of letters and digits, in order; everything else, apostrophes too, separates."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), 0)


@lru_cache(1)
def _folding() -> tuple[str, str]:
    """Letters that canonical decomposition (NFD) makes into one letter and marks (U+0300 to U+036F), these letters, and then the marks, which stand for nothing."""
    marks = [chr(c) for c in range(0x300, 0x370)]
    bare = {c: "".join(x for x in unicodedata.normalize("NFD", c) if x not in marks) for c in map(chr, range(0xC0, 0x3000))}
    pairs = [(c, b) for c, b in bare.items() if b != c and len(b) == 1]
    return "".join(c for c, _ in pairs) + "".join(marks), "".join(b for _, b in pairs)


def fold(text: Column) -> Column:
    """Lower case without marks: canonically decomposed, as far as U+2FFF, and the marks left out. ASCII goes the short way."""
    low = F.lower(text)
    return F.when(F.octet_length(low) == F.char_length(low), low).otherwise(F.translate(low, *_folding()))


def folded(word: str) -> str:
    """fold() for a word of a query."""
    letters, bare = _folding()
    return word.lower().translate({ord(c): bare[i] if i < len(bare) else None for i, c in enumerate(letters)})


def transliterated(word: Column, aliases: dict[str, str] | None = None) -> Column:
    """A word as it is looked up in transliteration: folded, without quotes before it, common words by the name that they go by."""
    bare = F.regexp_replace(fold(word), "^['’‘ʼʻʾʿ`]+", "")
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv]), bare), bare) if aliases else bare


def cut(text: Column, size: int) -> Column:
    """The first `size` characters."""
    return F.substring(text, 1, size)


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[ \t\n\r\f\x0B]+", " "))


def escape_html(text: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def anchor(label: Column) -> Column:
    return F.regexp_replace(label, "[^0-9A-Za-z]", "")


def title_of_slug(slug: Column) -> Column:
    return F.initcap(F.replace(slug, F.lit("-"), F.lit(" ")))


def word_input(typed: Column) -> Column:
    """What of a typed word a concordance takes: letters, apostrophes and hyphens."""
    return F.regexp_replace(typed, r"[^\p{L}'’-]", "")


def respell(text: Column, spoken: dict[str, str] | Dictionary) -> Column:
    """Names that begin with a capital, as they are spoken; other words stay."""
    return replaced(text, spoken if isinstance(spoken, Dictionary) else Dictionary(spoken.items(), exact=True))


def title_key(title: Column) -> Column:
    return F.regexp_replace(F.lower(title), "[^a-z]", "")


def leading_int(label: Column) -> Column:
    return F.regexp_extract(label, "^([0-9]+)", 1).try_cast("int")


def passage_label(title: Column, chapter: Column, unit: Column) -> Column:
    """`Title C:V`; prose paragraphs (pN) are named by their chapter alone."""
    return F.when(unit.startswith("p"), F.concat(title, F.lit(" "), chapter)).otherwise(F.concat(title, F.lit(" "), chapter, F.lit(":"), unit))


def range_label(first: Column, last: Column) -> Column:
    return F.when(first == last, first).otherwise(F.concat(first, F.lit("–"), last))


def snippet_chars(text: Column, word: str, back: int = 60, beyond: int = 80, size: int = 280) -> Column:
    """`size` characters around the first hit of a word: from the start if the hit lies within `beyond`, else from `back` before it; all hits marked."""
    at = F.instr(F.lower(text), word.lower()) - 1
    start = F.when(at > beyond, at - back).otherwise(0)
    cut = F.substring(text, start + 1, F.lit(size))
    marked = F.regexp_replace(escape_html(cut), f"(?i)({_quoted(word)})", "<mark>$1</mark>")
    return F.concat(F.when(start > 0, F.lit("…")).otherwise(""), marked, F.when(F.char_length(text) > start + size, F.lit("…")).otherwise(""))


def _quoted(word: str) -> str:
    return "".join("\\" + c if not c.isalnum() and not c.isspace() else c for c in word)


def snippet_tokens(text: Column, word: str, size: int = 24) -> Column:
    """`size` tokens from a third of that before the first hit, the hits in brackets."""
    words = tokens(text)
    at = F.array_position(words, word.lower())
    start = F.greatest(F.lit(1), at - size // 3)
    shown = F.transform(F.slice(words, start.cast("int"), F.lit(size)), lambda w: F.when(w == word.lower(), F.concat(F.lit("["), w, F.lit("]"))).otherwise(w))
    return F.array_join(shown, " ")


# The Roman numerals and what they are worth, from the greatest down.
NUMERALS = [(1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")]


def roman(n: Column) -> Column:
    """A positive integer in Roman numerals: each place's repeats, from what the greater ones leave."""
    parts, rest = [], n
    for value, letters in NUMERALS:
        parts.append(F.repeat(F.lit(letters), F.floor(rest / value).cast("int")))
        rest = rest % value
    return F.concat(*parts)


def unroman(s: Column) -> Column:
    """The integer that a Roman numeral stands for: a letter before a greater one is taken off."""
    worth = F.create_map(*[x for v, k in NUMERALS if len(k) == 1 for x in (F.lit(k), F.lit(v))])
    values = F.transform(F.filter(F.split(F.upper(s), ""), lambda c: c != ""), lambda c: F.coalesce(F.try_element_at(worth, c), F.lit(0)))
    signed = F.transform(values, lambda v, i: F.when(v < F.coalesce(F.get(values, i + 1), F.lit(0)), -v).otherwise(v))
    return F.aggregate(signed, F.lit(0), lambda a, v: a + v)


def url_link(page: str, params: dict[str, Column]) -> Column:
    """A link of a page with the parameters that have a value."""
    pairs = F.filter(F.array(*[F.when(v.isNotNull() & (v != ""), F.concat(F.lit(f"{k}="), F.url_encode(v))) for k, v in params.items()]), lambda x: x.isNotNull())
    return F.when(F.size(pairs) > 0, F.concat(F.lit(f"{page}?"), F.array_join(pairs, "&"))).otherwise(F.lit(page))
