"""Language identification by cross-parsing entropy.

A suffix automaton per language is built over running text of a bounded
labelled sample. A document is parsed from its start into the longest phrases
that the automaton knows, across blanks; the language that needs the fewest
phrases wins, each phrase counted with the bits that a place in that
language's sample costs, and divided by the letters parsed.

The automata become one table of transitions, in which a missing transition
already starts the next phrase, so that a step is one look-up. Texts are cut
into segments of ``SEGMENT`` characters (a phrase ends there too), and all
segments of a slice advance together, all languages at once, as arrays.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hashed_sample, row_slices

UNKNOWN = "und"
DOCS_PER_LANGUAGE = 200
#: bounds of the sample: characters of a language and of all, and languages
SAMPLE_CHARS, SAMPLE_IN_ALL, MOST_LANGUAGES = 30_000, 160_000, 64
#: characters that the table knows, the commonest of the samples; others match nothing
ALPHABET = 126
SEGMENT = 2_048
SLICE_BYTES = 4 << 20
SHARPNESS = 12.0


class SuffixAutomaton:
    """All substrings of a text; ``phrases`` parses a string into longest known ones."""

    def __init__(self, text: str):
        nexts: list[dict[str, int]] = [{}]
        links, lengths = [-1], [0]
        last = 0
        for ch in text:
            state = len(nexts)
            nexts.append({})
            links.append(0)
            lengths.append(lengths[last] + 1)
            at = last
            while at != -1 and ch not in nexts[at]:
                nexts[at][ch] = state
                at = links[at]
            if at != -1:
                to = nexts[at][ch]
                if lengths[at] + 1 == lengths[to]:
                    links[state] = to
                else:
                    copy = len(nexts)
                    nexts.append(dict(nexts[to]))
                    links.append(links[to])
                    lengths.append(lengths[at] + 1)
                    while at != -1 and nexts[at].get(ch) == to:
                        nexts[at][ch] = copy
                        at = links[at]
                    links[to] = links[state] = copy
            last = state
        self.nexts = nexts


class Parser:
    """Phrases of many texts for every language of a model."""

    def __init__(self, samples: tuple[tuple[str, str], ...]):
        self.languages = [name for name, _ in samples]
        self.bits = np.array([math.log2(len(text) + 2) for _, text in samples])
        common = Counter("".join(text for _, text in samples)).most_common(ALPHABET)
        self.width = len(common) + 2  # 0: behind the end, last: unknown
        self.symbols = np.full(0x110000, self.width - 1, np.uint8)
        for i, (ch, _) in enumerate(sorted(common), 1):
            self.symbols[ord(ch)] = i
        tables, self.roots = [], np.zeros(len(samples), np.int64)
        held = 0
        for k, (_, text) in enumerate(samples):
            self.roots[k] = held
            tables.append(self._table(SuffixAutomaton(text), held))
            held += len(tables[-1])
        self.table = np.concatenate(tables).ravel() if tables else np.zeros(0, np.int32)

    def _table(self, automaton: SuffixAutomaton, root: int) -> np.ndarray:
        """For each state and symbol: 4 x the next state + the phrases that end with the step."""
        edges = [(i, self.symbols[ord(ch)], to) for i, nexts in enumerate(automaton.nexts) for ch, to in nexts.items()]
        at, symbol, to = (np.array(x, np.int64) for x in zip(*edges))
        known = symbol < self.width - 1
        nexts = np.full((len(automaton.nexts), self.width), -1, np.int64)
        nexts[at[known], symbol[known]] = to[known]
        start = nexts[0]  # where a phrase that begins with the symbol is; none: the symbol stands alone
        missing = nexts < 0
        ended = missing & (np.arange(len(nexts)) > 0)[:, None]
        alone = missing & (start < 0)[None, :]
        out = (np.where(missing, np.maximum(start, 0)[None, :], nexts) + root) * 4 + ended + alone
        out[:, 0] = root * 4 + (np.arange(len(nexts)) > 0)  # the end closes an open phrase
        return out.astype(np.int32)

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases per text and language, and letters per text, of normalised texts."""
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        symbols = self.symbols[codes]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(sizes)
        letters = np.add.reduceat(np.append(codes != 32, False), np.append(ends - sizes, len(codes)))[:-1] * (sizes > 0)
        parts = -(-sizes // SEGMENT)
        row = np.repeat(np.arange(len(texts)), parts)
        first = (ends - sizes)[row] + SEGMENT * (np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts))
        length = np.minimum(SEGMENT, ends[row] - first)
        order = np.argsort(-length, kind="stable")  # those still going stand in front
        row, first, length = row[order], first[order], length[order]
        going = np.searchsorted(-length, -np.arange(length.max(initial=0)), side="left")
        state = np.repeat(self.roots[:, None], len(row), axis=1).astype(np.int32)
        count = np.zeros(state.shape, np.int32)
        for t, n in enumerate(going.tolist()):
            step = self.table[state[:, :n] * self.width + symbols[first[:n] + t]]
            count[:, :n] += step & 3
            state[:, :n] = step >> 2
        count += state != self.roots[:, None]
        out = np.zeros((len(texts), len(self.languages)), np.int64)
        np.add.at(out, row, count.T)
        return out, letters


@lru_cache(maxsize=2)
def _parser(samples: tuple[tuple[str, str], ...]) -> Parser:
    return Parser(samples)


def labelled(docs: DataFrame) -> DataFrame:
    """Documents that may be learnt from: a language, a text, and crc32 of the id not 2 modulo 4."""
    return docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def normalised(text: Column) -> Column:
    """Lower-cased letters, and one blank for whatever stands around and between their runs."""
    return F.regexp_replace(F.concat(F.lit(" "), F.lower(F.coalesce(text, F.lit(""))), F.lit(" ")), r"[^\p{L}]+", " ")


def fit(docs: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE, chars: int = SAMPLE_CHARS) -> tuple[tuple[str, str], ...]:
    """``(language, running text)`` of at most ``docs_per_language`` labelled documents and ``chars`` characters each.

    The sample has the smallest hashes of the id, in their order, until the
    characters are reached; the last text is cut there. It does not depend on
    the partitioning. More than ``MOST_LANGUAGES`` are an error.
    """
    known = labelled(docs)
    n_languages = known.select("lang").distinct().count()
    if n_languages > MOST_LANGUAGES:
        raise ValueError(f"{n_languages} languages; at most {MOST_LANGUAGES} can be told apart")
    chars = min(chars, SAMPLE_IN_ALL // max(n_languages, 1))
    chosen = hashed_sample(known, "lang", docs_per_language)
    texts = (known.select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi")
             .groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
             .select("lang", F.xxhash64("doc_id").alias("h"), "doc_id", F.substring(normalised(F.col("text")), 1, chars).alias("text")))
    # at most docs_per_language rows of a language
    before = F.sum(F.char_length("text")).over(Window.partitionBy("lang").orderBy("h", "doc_id")) - F.char_length("text")
    rows = texts.withColumn("before", before).where(F.col("before") < chars).orderBy("lang", "h", "doc_id").select("lang", "text").collect()
    samples: dict[str, str] = {}
    for lang, text in rows:
        samples[lang] = (samples.get(lang, "").rstrip(" ") + text)[:chars]
    return tuple(sorted(samples.items()))


def predict(docs: DataFrame, samples: tuple[tuple[str, str], ...], sharpness: float = SHARPNESS) -> DataFrame:
    """One row per input row: ``doc_id, held_out, lang_pred, score``.

    ``und`` with score 0 if the text is null or has no letter (or nothing was
    learnt); ties go to the first language by name. Repeated rows give equal
    rows; a null id counts as not held out; extra columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = _parser(samples)
        names = np.array([*parser.languages, UNKNOWN], object)
        k = len(parser.languages)
        for b in batches:
            for i, j in row_slices(b.column(2), SLICE_BYTES):
                best, score = np.full(j - i, k), np.zeros(j - i)
                if k:
                    phrases, letters = parser.phrases(b.column(2).slice(i, j - i).to_pylist())
                    cost = phrases * parser.bits / np.maximum(letters, 1)[:, None]
                    low = cost.min(axis=1)
                    weight = np.exp(-sharpness * (cost - low[:, None]))
                    best = np.where(letters > 0, cost.argmin(axis=1), k)
                    score = np.where(letters > 0, 1 / weight.sum(axis=1), 0.0)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.array(names[best], pa.string()),
                     pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out().alias("held_out"), normalised(F.col("text")))
    return source.mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """Fit on the labelled sample of ``docs`` and predict all of them."""
    return predict(docs, fit(docs))
