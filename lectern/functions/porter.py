"""Porter's suffix stripper (1980), with the two later changes -bli to -ble and -logi to -log: as expressions for a vocabulary's distinct words, and as a function for the few that a query has."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Suffixes and what replaces them.
STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log"}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")

_shape = re.compile(r"c*(v+c+)?")

def _shapes(w: str) -> str:
    """c or v for each letter: y is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(w):
        out += "v" if ch in "aeiou" or ch == "y" and i and out[-1] == "c" else "c"
    return out

def _measure(w: str) -> int:
    return len(re.findall("v+c+", _shapes(w)))

def _short_end(w: str) -> bool:
    return _shapes(w)[-3:] == "cvc" and len(w) > 2 and w[-1] not in "wxy"

def _swap(w: str, table: dict[str, str], least: int) -> str:
    for suffix in sorted(table, key=len, reverse=True):
        if w.endswith(suffix):
            base = w[: -len(suffix)]
            return base + table[suffix] if _measure(base) > least else w
    return w

def stem(w: str) -> str:
    if len(w) < 3:
        return w
    # plurals, -ed and -ing
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) else w
    else:
        for suffix in ("ed", "ing"):
            base = w[: -len(suffix)]
            if w.endswith(suffix) and "v" in _shapes(base):
                if base.endswith(("at", "bl", "iz")):
                    w = base + "e"
                elif len(base) > 1 and base[-1] == base[-2] and _shapes(base)[-1] == "c" and base[-1] not in "lsz":
                    w = base[:-1]
                else:
                    w = base + "e" if _measure(base) == 1 and _short_end(base) else base
                break
    if w.endswith("y") and "v" in _shapes(w[:-1]):
        w = w[:-1] + "i"
    w = _swap(_swap(w, STEP2, 0), STEP3, 0)
    for suffix in sorted(STEP4, key=len, reverse=True):
        if w.endswith(suffix):
            base = w[: -len(suffix)]
            if _measure(base) > 1 and (suffix != "ion" or base.endswith(("s", "t"))):
                w = base
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or m == 1 and not _short_end(w[:-1]):
            w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w[:-1]) > 1 else w


# ---- the same steps as expressions, for Spark and for a database that a result is held against ---------------------------------------------

#: For each step, from first to last: suffix, what its base (the word without it) must be like, and what replaces the suffix. The longest suffix that a word ends with decides, whether its base suffices or not.
RULES = [
    ("1a", [("sses", "any", "ss"), ("ies", "any", "i"), ("ss", "any", "ss"), ("s", "any", "")]),
    ("1b", [("eed", "m>0", "ee"), ("ed", "vowel", "*"), ("ing", "vowel", "*")]),
    ("1c", [("y", "vowel", "i")]),
    ("2", [(s, "m>0", r) for s, r in STEP2.items()]),
    ("3", [(s, "m>0", r) for s, r in STEP3.items()]),
    ("4", [(s, "m>1 after s or t" if s == "ion" else "m>1", "") for s in STEP4]),
    ("5a", [("e", "m>1 or not short", "")]),
    ("5b", [("l", "m>1 after l", "")]),
]
_VC = "length({b}) - length(replace({b}, 'vc', ''))"
_SHORT = "(right({b}, 3) = 'cvc' and right({w}, 1) not in ('w', 'x', 'y'))"
#: Of a base with the letters {w} and the shape {b}.
CONDITIONS = {
    "any": "true",
    "vowel": "position('v' in {b}) > 0",
    "m>0": f"{_VC} > 0",
    "m>1": f"{_VC} > 2",
    "m>1 after s or t": f"{_VC} > 2 and right({{w}}, 1) in ('s', 't')",
    "m>1 after l": f"{_VC} > 2 and right({{w}}, 1) = 'l'",
    "m>1 or not short": f"({_VC} > 2 or {_VC} = 2 and not {_SHORT})",
}
_LETTER = "case when c = '' then '' when c in ('a', 'e', 'i', 'o', 'u') or c = 'y' and right(a, 1) = 'c' then 'v' else 'c' end"
#: The shape of the word w: c or v for each letter.
SHAPES = {"spark": f"aggregate(split(w, ''), '', (a, c) -> a || {_LETTER})", "duckdb": f"list_reduce(list_prepend('', string_split(w, '')), lambda a, c: a || {_LETTER})"}


#: Consonants and vowels of endings that are put on, none of which has a y.
_PUT_ON = "translate({x}, 'aeioubcdfglnstvz', 'vvvvvccccccccccc')"
#: What a step does, from what it has found: how many letters go, and what is put on; nothing where it found nothing.
APPLIED = {
    "w": "case when r = '' then w else left(w, length(w) - cast(left(r, 1) as int)) || substring(r, 2) end",
    "s": f"case when r = '' then s else left(s, length(w) - cast(left(r, 1) as int)) || {_PUT_ON.format(x='substring(r, 2)')} end",
}


def _findings() -> list[str]:
    """For each step an expression of the word w and its shape s: how many letters go and what is put on, as 4ate. After 1b one that mends what -ed and -ing leave, marked by a star. The last letter leads to the suffixes that end with it."""
    out = []
    for _, rules in RULES:
        by_last: dict[str, list[str]] = {}
        for suffix, condition, new in sorted(rules, key=lambda r: -len(r[0])):
            k = len(suffix)
            so = CONDITIONS[condition].format(w=f"left(w, length(w) - {k})", b=f"left(s, length(w) - {k})")
            by_last.setdefault(suffix[-1], []).append(f"when right(w, {k}) = '{suffix}' then case when {so} then '{k}{new}' else '' end")
        out.append("case right(w, 1) " + " ".join(f"when '{c}' then case {' '.join(cases)} else '' end" for c, cases in by_last.items()) + " else '' end")
        if any(new == "*" for _, _, new in rules):
            b, s = "left(w, length(w) - 1)", "left(s, length(s) - 1)"
            double = f"length({b}) > 1 and right({b}, 1) = left(right({b}, 2), 1) and right({s}, 1) = 'c' and right({b}, 1) not in ('l', 's', 'z')"
            mended = f"case when right({b}, 2) in ('at', 'bl', 'iz') then '1e' when {double} then '2' when {_VC.format(b=s)} = 2 and {_SHORT.format(w=b, b=s)} then '1e' else '1' end"
            out.append(f"case when right(w, 1) = '*' then {mended} else '' end")
    return out


def stemmed(words: DataFrame, word: str = "term", to: str = "stem") -> DataFrame:
    """words with the stems of a column of distinct words of a-z and digits, without Python; words of one or two letters stay."""
    columns, out = words.columns, words.withColumn("w", F.col(word)).withColumn("s", F.expr(SHAPES["spark"]))
    for r in _findings():
        out = out.withColumn("r", F.expr(r)).withColumns({k: F.expr(e) for k, e in APPLIED.items()})
    return out.select(*columns, F.when(F.char_length(word) < 3, F.col(word)).otherwise(F.col("w")).alias(to))


def sql(source: str, word: str = "term", to: str = "stem") -> str:
    """Common table expressions for DuckDB: the last, `stems`, has each distinct `word` of the table `source` and its stem."""
    parts = [f"porter0 as (select word, w, {SHAPES['duckdb']} as s from (select distinct {word} as word, {word} as w from {source}))"]
    for k, r in enumerate(_findings()):
        parts.append(f"porter{k + 1} as (select word, {APPLIED['w']} as w, {APPLIED['s']} as s from (select *, {r} as r from porter{k}))")
    return ", ".join([*parts, f"stems as (select word as {word}, case when length(word) < 3 then word else w end as {to} from porter{len(parts) - 1})"])
