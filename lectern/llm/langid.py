"""Language ID: multinomial naive Bayes over hashed character n-grams.

A text is lower-cased, what is no letter counts as a blank, as does its end, and its two- and three-character sequences (none with two blanks side by side) are
hashed to SLOTS. Training sums counts by language and slot: each task adds up its own rows, blocks of slots are then summed by key, so what
moves is bounded by tasks x languages x slots. The smoothed log-probability matrix is languages x SLOTS; it goes to the workers, which score
batches of texts sparsely in numpy. A very long text is scored in slices that overlap by two characters, which changes no count.

Edge cases: null text, or text without a letter, is `und` with score 0; without a labelled row everything is `und`; rows without lang or text
teach nothing; repeated rows count each; a row without doc_id is scored, not held out and teaches nothing; ties go to the language first in
order; an empty table gives no rows; other columns are not read.

The pipeline's stage drops texts that no learned language explains: over a text's distinct sequences (those of each slice of a long one), the mean
log-probability in its best language lies below that of a uniform choice among the SLOTS by more than ERRORS standard errors. Fewer than FEWEST of
them decide nothing. Without a model only texts without a letter go.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SLOTS = 1 << 15
BLOCK = 1 << 11
SLICE = 1 << 19
SMOOTHING = 0.5
UNKNOWN = "und"
#: When a text counts as explained by no language.
ERRORS, FEWEST = 3, 16
#: Rows that the stage holds as Python objects at once.
PART = 256


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def slices(texts: list[str]) -> Iterator[tuple[list[int], str, list[int]]]:
    """Texts in pieces: which text each part is of, the parts joined, and where each begins. A part of a longer text carries its next two characters."""
    which, parts, starts, held = [], [], [], 0
    for k, text in enumerate(texts):
        text = text.lower()
        for at in range(0, len(text), SLICE):
            part = (text[at : at + SLICE + 2] + "\0\0")[: min(SLICE, len(text) - at) + 2]
            which.append(k)
            starts.append(held)
            parts.append(part)
            held += len(part)
            if held >= SLICE:
                yield which, "".join(parts), starts
                which, parts, starts, held = [], [], [], 0
    if parts:
        yield which, "".join(parts), starts


def grams(joined: str, starts: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots of the joined parts' sequences (of two, of three by position; SLOTS where there is none) and whether each character is a letter."""
    c = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letters()[c]
    c = np.where(letter, c, np.uint32(32))
    n = len(c) - 2
    ok = letter[:n] | letter[1 : n + 1]
    ends = np.asarray(starts[1:], int)
    ok[np.concatenate([ends - 1, ends - 2])] = False  # a part's last two characters begin no sequence
    a, b, d = c[:n] * np.uint32(0x9E3779B1), c[1 : n + 1] * np.uint32(0x85EBCA77), c[2:] * np.uint32(0xC2B2AE3D)
    shift, mix = np.uint32(32 - (SLOTS.bit_length() - 1)), np.uint32(0x27D4EB2F)
    two = a ^ (b >> np.uint32(3)) ^ b
    three = (two ^ (d >> np.uint32(7)) ^ d) * mix
    two = (two * mix + np.uint32(0x165667B1)) * np.uint32(0x9E3779B1) >> shift
    three = (three ^ three >> np.uint32(15)) * np.uint32(0x85EBCA77) >> shift
    ok3 = ok & (letter[1 : n + 1] | letter[2:])
    return np.where(ok, two, SLOTS), np.where(ok3, three, SLOTS), letter


def train(rows: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order, and log-probabilities (language x slot, a last column of the priors) from rows(lang, text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: dict[str, int] = {}
        totals: Counter[str] = Counter()
        sums = np.zeros((0, SLOTS + 1), np.int64)
        for b in batches:
            langs, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for lang in langs:
                index.setdefault(lang, len(index))
            if len(index) > len(sums):
                sums = np.concatenate([sums, np.zeros((len(index) - len(sums), SLOTS + 1), np.int64)])
            kinds = np.array([index[x] for x in langs], np.int64)
            for which, joined, starts in slices(texts):
                two, three, _ = grams(joined, starts)
                of = np.repeat(kinds[which] * (SLOTS + 1), np.diff([*starts, len(joined)]))[: len(two)]
                for slots in (two, three):
                    sums += np.bincount(of + slots, minlength=sums.size).reshape(sums.shape)
            totals.update(langs)
        names = sorted(index)
        for lang in names:
            row = sums[index[lang], :SLOTS]
            blocks = [row[i : i + BLOCK].astype("<i8").tobytes() for i in range(0, SLOTS, BLOCK)]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(blocks) + 1), pa.string()), pa.array(range(len(blocks) + 1), pa.int32()), pa.array([*blocks, np.array([totals[lang]], "<i8").tobytes()], pa.binary())], ["lang", "block", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int], np.ndarray] = {}
        for b in batches:
            for lang, block, counts in zip(*(c.to_pylist() for c in b.columns), strict=True):
                x = np.frombuffer(counts, "<i8")
                sums[lang, block] = sums[lang, block] + x if (lang, block) in sums else x
        if sums:
            keys = list(sums)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys]), pa.array([k[1] for k in keys], pa.int32()), pa.array([sums[k].tobytes() for k in keys], pa.binary())], ["lang", "block", "counts"])

    kind = "lang string, block int, counts binary"
    summed = common.map_arrow(common.map_arrow(rows.select("lang", "text"), count, kind).repartition("lang", "block"), add, kind).collect()  # languages x SLOTS: labels are a list of languages, a few hundred at most
    langs = sorted({r.lang for r in summed})
    counts = np.zeros((len(langs), SLOTS + 1), np.float64)
    for r in summed:
        x = np.frombuffer(r.counts, "<i8")
        counts[langs.index(r.lang), r.block * BLOCK : r.block * BLOCK + len(x)] = x
    slots, prior = counts[:, :SLOTS] + SMOOTHING, counts[:, SLOTS:]
    logs = np.log(slots) - np.log(slots.sum(1, keepdims=True)) if langs else slots
    return langs, np.concatenate([logs, np.log(prior / max(prior.sum(), 1))], 1).astype(np.float32) if langs else counts.astype(np.float32)


def weigh(texts: list[str | None], langs: list[str], logs: np.ndarray, judge: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's log-probability in each language, whether it has a letter, and, if judged, whether its best language explains it."""
    sums, seen = np.zeros((len(texts), len(langs))), np.zeros(len(texts), bool)
    count, total, squares = np.zeros(len(texts)), np.zeros(sums.shape), np.zeros(sums.shape)
    padded = np.concatenate([logs[:, :-1], np.zeros((len(langs), 1), np.float32)], 1)  # slot SLOTS adds nothing
    for which, joined, starts in slices([t or "" for t in texts]):
        two, three, letter = grams(joined, starts)
        begins = np.asarray(starts)
        np.logical_or.at(seen, which, np.logical_or.reduceat(letter, begins))
        for k in range(len(langs)):
            each = padded[k][two] + padded[k][three]
            np.add.at(sums[:, k], which, np.add.reduceat(each, begins, dtype=np.float64))
        if judge and langs:
            for i, lo, hi in zip(which, starts, [*starts[1:], len(joined)], strict=True):
                both = np.concatenate([two[lo:hi], three[lo:hi]])
                own = np.flatnonzero(np.bincount(both, minlength=SLOTS + 1)[:SLOTS]) if len(both) > SLOTS // 8 else (u := np.unique(both))[u < SLOTS]
                x = padded[:, own].astype(np.float64)
                count[i] += len(own)
                total[i] += x.sum(1)
                squares[i] += (x * x).sum(1)
    if not langs:
        return sums, seen, seen
    sums += logs[:, -1]
    best = np.arange(len(texts)), sums.argmax(1)
    n = np.maximum(count, 1)
    mean = total[best] / n
    error = np.sqrt(np.maximum(squares[best] / n - mean * mean, 0) / n)
    return sums, seen, seen & ((count < FEWEST) | (mean + ERRORS * error >= -np.log(SLOTS)))


def score(texts: list[str | None], langs: list[str], logs: np.ndarray) -> tuple[list[str], list[float]]:
    """The most probable language of each text, and its posterior probability."""
    sums, seen, _ = weigh(texts, langs, logs)
    if not langs:
        return [UNKNOWN] * len(texts), [0.0] * len(texts)
    best = sums.argmax(1)
    posterior = 1 / np.exp(sums - sums.max(1, keepdims=True)).sum(1)
    return [langs[b] if s else UNKNOWN for b, s in zip(best, seen, strict=True)], [float(p) if s else 0.0 for p, s in zip(posterior, seen, strict=True)]


def predict(docs: DataFrame, langs: list[str], logs: np.ndarray, keep: list[str], new: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs' columns keep, and under the names new lang_pred and score; the text is read from the column text."""
    shared = docs.sparkSession.sparkContext.broadcast(logs)  # languages x SLOTS floats
    names = [*keep, *new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang_pred, posterior = score(b.column(b.num_columns - 1).to_pylist(), langs, shared.value)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(lang_pred, pa.string()), pa.array(posterior, pa.float64())], names)

    chosen = docs.select(*keep, F.col("text").alias("__text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])
    return common.map_arrow(chosen, run, f"{kinds}, `{new[0]}` string, `{new[1]}` double")


def held_out(folds: int, fold: int):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == fold, F.lit(False))


def model(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """What train() gives of the labelled rows that aren't held out."""
    return train(docs.filter(F.col("doc_id").isNotNull() & ~held_out(4, 2) & F.col("lang").isNotNull() & F.col("text").isNotNull()))


def identify(docs: DataFrame, keep: list[str], new: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs' columns keep, lang_pred and score. It learns from the labelled rows that aren't held out."""
    langs, logs = model(docs)
    return predict(docs, langs, logs, keep, new)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    return identify(docs, ["doc_id"]).select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that a learned language explains; without a model, those with a letter. The label that they came with stays as it is."""
    langs, logs = model(docs)
    shared = spark.sparkContext.broadcast(logs)  # languages x SLOTS floats
    at, columns = docs.columns.index("text"), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x.slice(lo, PART) for x in batches for lo in range(0, x.num_rows, PART)):
            kept = weigh(b.column(at).to_pylist(), langs, shared.value, judge=True)[2]
            yield pa.RecordBatch.from_arrays(b.columns, columns).filter(pa.array(kept))

    return common.map_arrow(docs, run, docs.schema)
