"""Words and phrases replaced by dictionaries of any usual size, in one pass over each text.

A dictionary is compiled to a trie of words, once, and goes to the workers with the function that uses it (Spark broadcasts what is large). Its size is checked. Texts are read in Arrow batches; what a word
becomes is looked up once for each distinct form in a batch's texts, so the time doesn't depend on the number of entries. At each place the longest entry wins, and the next place is behind it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Bytes of entries that a dictionary may have: what each worker process can well hold.
LIMIT = 64 << 20
#: Texts that are strings in a worker at once; a batch has thousands.
PIECE = 64
#: Distinct forms that are remembered at once.
FORMS = 1 << 16
_parts = regex.compile(r"\p{L}+|[^\p{L}]+")
_END = ""


def cased(like: str, word: str) -> str:
    """word in capitals, with a capital or as it is, as `like` has it."""
    if len(like) > 1 and like.upper() == like:
        return word.upper()
    return word[:1].upper() + word[1:] if like[:1] != like[:1].lower() else word


class Dictionary:
    """Entries by their words. Received forms in any case match any case, which is kept; with exact, only the form itself matches, and the corrected one stands as it is."""

    def __init__(self, entries: Iterable[tuple[str, str]], exact: bool = False):
        self.exact, self.trie, size = exact, {}, 0
        for received, corrected in entries:
            words = _parts.findall(received if exact else received.lower())[::2] if received else []
            size += len(received or "") + len(corrected or "") + 32
            if size > LIMIT:
                raise ValueError(f"a dictionary of more than {LIMIT} bytes: replace by a join on the distinct words")
            node = self.trie
            for w in words:
                node = node.setdefault(w, {})
            if words and corrected is not None:
                node[_END] = corrected  # the last of several
        #: what a word alone becomes, and words that begin a phrase
        self.alone = {w: n[_END] for w, n in self.trie.items() if len(n) == 1 and _END in n}
        self.first = {w for w, n in self.trie.items() if len(n) > 1 or _END not in n}

    @classmethod
    def read(cls, table: DataFrame, exact: bool = False) -> Dictionary:
        """From a table of (received, corrected), in the order of received and corrected. Rows come one by one, and no more than LIMIT holds."""
        rows = table.select("received", "corrected").filter(F.col("received").isNotNull()).orderBy("received", "corrected")
        return cls(((r[0], r[1]) for r in rows.toLocalIterator()), exact)

    def replacer(self) -> Callable[[str], str]:
        """A function over texts, which remembers forms."""
        alone, first, exact, known = self.alone, self.first, self.exact, {}

        def form(part: str) -> str:
            """What a part becomes by itself."""
            new = alone.get(part if exact else part.lower())
            out = part if new is None else new if exact else cased(part, new)
            if len(known) >= FORMS:
                known.clear()
            known[part] = out
            return out

        def run(text: str) -> str:
            parts = _parts.findall(text)
            if first and not first.isdisjoint(parts if exact else map(str.lower, parts)):
                return "".join(self._longest(parts, form))
            return "".join([known[p] if p in known else form(p) for p in parts])

        return run

    def _longest(self, parts: list[str], form: Callable[[str], str]) -> Iterator[str]:
        key = (lambda p: p) if self.exact else str.lower
        i = 0
        while i < len(parts):
            node, j, best = self.trie.get(key(parts[i])), i, None
            while node is not None:
                if _END in node:
                    best = (j, node[_END])
                if j + 2 >= len(parts) or not parts[j + 1].isspace():
                    break
                node, j = node.get(key(parts[j + 2])), j + 2
            if best is None:
                yield form(parts[i])
                i += 1
            else:
                like = "".join(parts[i : best[0] + 1])
                yield best[1] if self.exact else cased(like, best[1])
                i = best[0] + 1


def replaced(text: Column, *dictionaries: Dictionary) -> Column:
    """text through dictionaries, one after the other; what lies between words stays, null stays null."""
    some = [d for d in dictionaries if d.trie]
    if not some:
        return text

    @F.arrow_udf(StringType())
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        steps = [d.replacer() for d in some]

        def through(t: str) -> str:
            for s in steps:
                t = s(t)
            return t

        for piece in pieces(texts):
            yield pa.array([None if t is None else through(t) for t in piece.to_pylist()], pa.string())

    return run(text)


def pieces(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Parts of batches, so that neither a batch's strings nor what becomes of them are held at once; an empty batch is one part."""
    for b in batches:
        for lo in range(0, max(1, len(b)), PIECE):
            yield b.slice(lo, PIECE)


def put(text: str, own: dict[str, str]) -> str:
    """text with words replaced by own(received, corrected). Text is cut at blanks, and what each distinct piece becomes is worked out once; only those that aren't a word are cut further."""

    def form(part: str) -> str:
        new = own.get(part.lower())
        return part if new is None else cased(part, new)

    pieces = text.split(" ")
    forms = {p: form(p) if p.isalpha() else "".join(map(form, _parts.findall(p))) for p in set(pieces)}
    return " ".join([forms[p] for p in pieces])


@F.arrow_udf(StringType())
def _put(rows: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for texts, entries in rows:
        for lo in range(0, max(1, len(texts)), PIECE):
            own = entries.slice(lo, PIECE)
            received, corrected = (c.to_pylist() for c in own.flatten().flatten())  # columns, as an object for each entry takes longer than all else
            out, at = [], 0
            for t, n in zip(texts.slice(lo, PIECE).to_pylist(), pc.list_value_length(own).to_pylist(), strict=True):
                out.append(put(t, dict(zip(received[at : at + n], corrected[at : at + n], strict=True))) if n else t)
                at += n or 0
            yield pa.array(out, pa.string())


def by_join(texts: DataFrame, key: str, text: str, dictionary: DataFrame) -> DataFrame:
    """texts with words replaced by dictionary(received: one lower-case word, corrected), of any size: each text's distinct words meet the dictionary by a join, and its few hits come back to it, where a word finds its own by hash. Rows are told apart by key and text; equal ones have their hits once."""
    rows = texts.withColumn("__key", F.xxhash64(key, text))
    words = rows.select("__key", F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), 0))).alias("received"))
    hits = words.join(dictionary.groupBy("received").agg(F.max("corrected").alias("corrected")), "received")
    own = hits.groupBy("__key").agg(F.collect_set(F.struct("received", "corrected")).alias("__own"))
    return rows.join(own, "__key", "left").withColumn(text, _put(F.col(text), F.col("__own"))).drop("__key", "__own")
