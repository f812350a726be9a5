"""Rule-based text cleaning: dictionary replacement that keeps case, ordered rewrites, and long sentences broken up.

Every table, list and rule belongs to its editor and is a parameter: nothing is built in but the defaults of two limits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .dictionaries import Dictionary, pieces, replaced

Words = dict[str, str] | Dictionary
PARTS = r"\p{L}+|[^\p{L}]+"


def inflected(stems: dict[str, str], endings: list[str]) -> dict[str, str]:
    """A table of stems carried through their endings."""
    return {old + e: new + e for old, new in stems.items() for e in endings}


def cased(like: Column, word: Column) -> Column:
    """word in capitals, with a capital or as it is, as `like` has it."""
    return F.when((F.upper(like) == like) & (F.char_length(like) > 1), F.upper(word)).when(F.substring(like, 1, 1) != F.lower(F.substring(like, 1, 1)), F.concat(F.upper(F.substring(word, 1, 1)), F.substring(word, F.lit(2), F.char_length(word)))).otherwise(word)


def replace_words(text: Column, *words: Words) -> Column:
    """Whole words, and phrases, by dictionaries of lower-case forms, one after the other, their case kept; what lies between words stays. One pass over a text for all of them."""
    return replaced(text, *map(_dictionary, words))


def _dictionary(words: Words) -> Dictionary:
    return words if isinstance(words, Dictionary) else Dictionary(words.items())


def rewrite(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Ordered rewrites (a pattern in any case, what it becomes, with $1 and so on for its groups); what begins with a capital keeps it."""
    for pattern, to in rules:
        capital = rf"(?=\p{{Lu}})(?i:{pattern})"
        if to.startswith("$"):  # what the group holds isn't known before: its place is marked
            pieces = F.split(F.regexp_replace(text, capital, "\0" + to), "\0", -1)
            text = F.array_join(F.transform(pieces, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, F.lit(2), F.char_length(p))))), "")
        else:
            text = F.regexp_replace(text, capital, to[:1].upper() + to[1:])
        text = F.regexp_replace(text, rf"(?=\P{{Lu}})(?i:{pattern})", to)
    return text


def relative(text: Column, heads: list[str], link: str, to: str, subjects: list[str]) -> Column:
    """`link` becomes `to` where it opens a relative clause: right after one of heads, and before a lower-case word that is none of subjects, as a subject
    would make it a clause of its own. All lists are in lower case."""

    def whole(parts: Column) -> Column:
        at = lambda i: F.coalesce(F.get(parts, i), F.lit(""))
        blank = lambda i: at(i).rlike(r"^\s+$")

        def one(w: Column, i: Column) -> Column:
            after = at(i + 2)
            opens = (F.lower(w) == link) & F.lower(at(i - 2)).isin(heads) & blank(i - 1) & blank(i + 1) & after.rlike(r"^\p{Ll}") & ~F.lower(after).isin(subjects)
            return F.when(opens, cased(w, F.lit(to))).otherwise(w)

        return F.array_join(F.transform(parts, one), "")

    # as a function's argument a text's parts are made once, and not again for each of them
    return F.get(F.transform(F.array(F.regexp_extract_all(text, F.lit(PARTS), 0)), whole), F.lit(0))


def modernized(text: Column, phrases: list[tuple[str, str]], words: Words) -> Column:
    """Phrases first, as they are made of words that change, then words."""
    return replace_words(rewrite(text, phrases), words)


def fixed(text: Column, syntax: list[tuple[str, str]], words: Words, spelling: Words, names: Words) -> Column:
    """The corrections of a text in their order: syntax, vocabulary, spelling, and names, which begin with a capital and go by their exact form. The dictionaries take one pass together."""
    exact = names if isinstance(names, Dictionary) else Dictionary(names.items(), exact=True)
    return replaced(rewrite(text, syntax), _dictionary(words), _dictionary(spelling), exact)


def by_tier(text: Column, tier: Column, spelling: dict[str, str], words: dict[str, str], phrases: list[tuple[str, str]]) -> Column:
    """As received (none), lightly (safe: spelling) or in full (phrases, words, spelling)."""
    light = replace_words(text, spelling)
    return F.when(tier == "none", text).when(tier == "safe", light).otherwise(modernized(text, phrases, spelling | words))


@dataclass(frozen=True)
class Clauses:
    """Where a sentence of more than `most` words may be cut, leaving `least` words on either side. After a semicolon, unless a subordinator follows. After a comma, before a joiner, if what follows it is a clause:
    one of subjects; for adversatives, which hardly ever join nouns, any word but a subordinator; or a noun phrase that a verb follows: a determiner, at most `within` words, and one of verbs or a word with a
    verb's ending, as a list has no verb behind it. A semicolon is safer than a comma. All lists are in lower case."""

    joiners: frozenset[str] = frozenset()
    subjects: frozenset[str] = frozenset()
    most: int = 32
    least: int = 7
    rounds: int | None = None
    adversatives: frozenset[str] = frozenset()
    subordinators: frozenset[str] = frozenset()
    determiners: frozenset[str] = frozenset()
    verbs: frozenset[str] = frozenset()
    endings: tuple[str, ...] = ()
    within: int = 2

    def clause(self, words: list[str], i: int) -> bool:
        """Whether a clause begins with the joiner words[i]."""
        bare = [w.strip(".,;:!?").lower() for w in words[i : i + 4 + self.within]]
        joiner, rest = bare[0], bare[1:]
        if not rest:
            return False
        if joiner in self.joiners and rest[0] in self.subjects or joiner in self.adversatives and rest[0] not in self.subordinators and words[i + 1][:1].islower():
            return True
        verb = lambda w: w in self.verbs or len(w) > 4 and w.endswith(self.endings or ("\0",))
        return joiner in self.joiners | self.adversatives and rest[0] in self.determiners and any(verb(w) and all(x.isalpha() for x in rest[1:k]) for k, w in enumerate(rest[1 : 2 + self.within], 1))

    def cut(self, sentence: str) -> int | None:
        """The word before which the sentence is best cut: the safest place, of these the one nearest the middle, of two the first."""
        words = sentence.split()
        best = None
        if len(words) > self.most:
            for i in range(max(1, self.least), len(words) - max(1, self.least) + 1):
                mark = words[i - 1][-1]
                safety = 2 if mark == ";" and words[i].lower() not in self.subordinators else 1 if mark == "," and i + 1 < len(words) and self.clause(words, i) else 0
                if safety:
                    best = max(best or (0, 0, 0), (safety, -abs(2 * i - len(words)), -i))
        return best and -best[2]

    def shortened(self, text: str | None) -> str | None:
        """Sentences are cut while they can be (with `rounds`, so many times in a text at most); marks and capitals change, words and line breaks don't."""
        if not text or len(text.split()) <= self.most:
            return text
        out, cuts, rounds = [], 0, self.rounds
        for sentence in re.split(r"((?<=[.!?])\s+)", text):
            todo = [sentence]
            while todo:
                now = todo.pop()
                at = self.cut(now) if rounds is None or cuts < rounds else None
                if at is None:
                    out.append(now)
                    continue
                cuts += 1
                words = list(re.finditer(r"\S+", now))
                left, gap, right = now[: words[at - 1].end() - 1], now[words[at - 1].end() : words[at].start()], now[words[at].start() :]
                todo += [right[:1].upper() + right[1:], gap, left + "."]
        return "".join(out)


def resentence(text: str, clauses: Clauses) -> Column:
    """The column text with its long sentences cut."""

    @F.arrow_udf(StringType())
    def cut(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for piece in pieces(texts):
            yield pa.array([clauses.shortened(t) for t in piece.to_pylist()], pa.string())

    return cut(text)


def applied(units: DataFrame, text: str, dictionary: DataFrame) -> DataFrame:
    """Which entries of dictionary(received, corrected) occur in the texts."""
    words = units.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), 0))).alias("w")).distinct()
    return dictionary.join(words, F.lower("received") == F.col("w"), "left_semi")


def corrected_titles(titles: DataFrame, fixes: DataFrame) -> DataFrame:
    """A title is replaced only if it is what the fix has received: titles(id, title), fixes(id, received, corrected)."""
    f = fixes.select(F.col("id").alias("__id"), F.col("received").alias("__r"), "corrected")
    return titles.join(f, (F.col("id") == F.col("__id")) & (F.col("title") == F.col("__r")), "left").select("id", F.coalesce("corrected", "title").alias("title"))
