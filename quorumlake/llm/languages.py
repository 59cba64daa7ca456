"""Missing or wrong language labels: bit-sliced Bloom filters over character n-grams.

One array of slots holds a filter per language, a bit each, all with the same hash positions; the
AND over an n-gram's slots is the set of all languages that contain it. A line's score for a language
is the popcount of its bit over the line's n-grams, corrected for the share of n-grams that the
filter's fill would report by chance. The filters are fitted on a bounded sample of labelled rows;
labels are noisy, so the sample's lines are labelled anew by a first fit before the second one.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumlake.session import cut

#: Fixed: the languages and the ways in which labels name them (code, three letters, name, own name).
LANGUAGE_NAMES = {
    "en": ["en", "eng", "english"],
    "de": ["de", "deu", "ger", "german", "deutsch"],
    "fr": ["fr", "fra", "fre", "french", "français", "francais"],
    "es": ["es", "spa", "spanish", "español", "espanol", "castilian", "castellano"],
    "it": ["it", "ita", "italian", "italiano"],
    "pt": ["pt", "por", "portuguese", "português", "portugues"],
    "ja": ["ja", "jpn", "jp", "japanese", "日本語"],
}
LANGUAGES = list(LANGUAGE_NAMES)

#: Lengths of n-grams; slots of the filters and positions an n-gram; labelled rows that a fit reads at most.
GRAMS, SLOTS, PROBES, SAMPLE_ROWS = (3, 5), 1 << 22, 3, 20_000
#: An n-gram belongs to a language if so many of its texts have it, and at least so often relative to
#: the language that has it most (both by frequency within the language).
LEAST_COUNT, LEAST_SHARE = 4, 0.15
#: A line decides by itself if its language leads by so many n-grams and by this share of its own.
LINE_LEAD, LINE_SHARE = 12.0, 0.22
#: Where lines of a text decide for different languages, each must lead by so much without its capitalised
#: words: a name that only one language's texts mention makes no text mixed.
UNCAPITALISED_LEAD = 3.0


def label_code(label: Column) -> Column:
    """The language code a label names, in any spelling or with a region; null for any other label."""
    main = F.regexp_extract(F.lower(F.trim(label)), r"^([^\s_\-(.,;]+)", 1)
    pairs = [F.lit(x) for code, names in LANGUAGE_NAMES.items() for n in names for x in (n, code)]
    return F.element_at(F.create_map(*pairs), main)


def plain(line: str) -> str:
    """Lower-case letters of a line, everything else as single blanks."""
    return re.sub(r"[\W\d_]+", " ", f" {line.lower()} ")


def uncapitalised(line: str) -> str:
    """The same without capitalised words, which may be names; a line in capitals throughout stays whole."""
    words = re.sub(r"[\W\d_]+", " ", line).split()
    if not any(c.islower() for c in line):
        return plain(line)
    return f" {' '.join(w for w in words if not w[0].isupper()).lower()} "


def lines_of(text: str | None) -> list[str]:
    """The non-blank lines of a text."""
    return [x for x in re.split(r"\r\n|\r|\n", text or "") if x.strip()]


def gram_hashes(lines: Sequence[str], grams: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, line number) of every n-gram of every line, in one vectorised pass.

    Runs of blanks are one blank; n-grams without any letter don't count.
    """
    if not lines:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    text = "\n".join(lines)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    ends = codes == 10
    number = np.cumsum(ends)
    hashes, numbers = [], []
    for n in grams:
        if len(codes) < n:
            continue
        size = len(codes) - n + 1
        h = np.full(size, n, np.uint64)
        clean = np.ones(size, bool)
        for k in range(n):
            part = codes[k : k + size]
            h = h * np.uint64(0x9E3779B97F4A7C15) + part
            clean &= ~ends[k : k + size]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        hashes.append(h[clean])
        numbers.append(number[:size][clean])
    return np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), np.concatenate(numbers) if numbers else np.zeros(0, np.int64)


#: Counts of sets of languages that are held at a time; beyond it languages are counted one by one.
MOST_CELLS = 1 << 22
#: Characters that are turned into n-grams at a time; bounds a worker's memory however long the texts are.
CHUNK_CHARS = 1 << 20


def chunked(lines: Sequence[str], overlap: int, size: int = CHUNK_CHARS) -> Iterator[tuple[list[str], list[int]]]:
    """(pieces, line numbers) of at most about `size` characters each. A longer line goes in pieces that
    overlap, so that none of its n-grams is lost."""
    pieces, owners, total = [], [], 0
    for i, line in enumerate(lines):
        for at in range(0, max(1, len(line) - overlap), size):
            piece = line[at : at + size + overlap]
            if pieces and total + len(piece) > size:
                yield pieces, owners
                pieces, owners, total = [], [], 0
            pieces.append(piece)
            owners.append(i)
            total += len(piece) + 1
    if pieces:
        yield pieces, owners


@dataclass
class LanguageFilters:
    """The bit-sliced filters. slots: a mask of languages each; fill: each language's share of set slots."""

    languages: list[str]
    slots: np.ndarray
    grams: tuple[int, ...] = GRAMS
    probes: int = PROBES
    rate: np.ndarray | None = None  # the false rates, once known

    @classmethod
    def build(cls, languages: list[str], hashes: np.ndarray, masks: np.ndarray, n_slots: int = SLOTS) -> LanguageFilters:
        if len(languages) > 64:
            raise ValueError("at most 64 languages")
        kind = np.uint8 if len(languages) <= 8 else np.uint64
        out = cls(languages, np.zeros(n_slots, kind))
        for at in out.positions(hashes):
            np.bitwise_or.at(out.slots, at, masks.astype(kind))
        out.false_rate()
        return out

    def positions(self, hashes: np.ndarray) -> Iterator[np.ndarray]:
        step = (hashes >> np.uint64(32)) | np.uint64(1)
        for k in range(self.probes):
            yield ((hashes + np.uint64(k) * step) & np.uint64(len(self.slots) - 1)).astype(np.int64)

    @staticmethod
    def confidence(lead: float, top: float) -> float:
        """How sure a decision is, from its lead and its score."""
        return round(float(lead / (top + 5.0)), 4) if top > 0 else 0.0

    def false_rate(self) -> np.ndarray:
        """Chance that a filter reports an n-gram it doesn't hold; read off all slots once."""
        if self.rate is None:
            self.rate = np.array([np.mean((self.slots >> b) & 1) ** self.probes for b in range(len(self.languages))])
        return self.rate

    def scores(self, lines: Sequence[str]) -> np.ndarray:
        """Corrected popcounts, a row per (plain) line and a column per language."""
        out, total = np.zeros((len(lines), len(self.languages))), np.zeros(len(lines))
        for pieces, owners in chunked(lines, max(self.grams) - 1):
            hashes, number = gram_hashes(pieces, self.grams)
            mask = None
            for at in self.positions(hashes):
                mask = self.slots[at] if mask is None else mask & self.slots[at]
            # how often each line has each set of languages, then the languages' shares of that
            sets = 1 << len(self.languages)
            if len(pieces) * sets <= MOST_CELLS:
                piece = number * sets + mask if len(number) else number
                seen = np.bincount(piece, minlength=len(pieces) * sets).reshape(len(pieces), sets)
                bits = (np.arange(sets)[:, None] >> np.arange(len(self.languages))) & 1
                np.add.at(out, owners, seen @ bits)
                np.add.at(total, owners, seen.sum(1))
                continue
            owner = np.array(owners, np.int64)[number] if len(number) else number
            total += np.bincount(owner, minlength=len(lines))
            for b in range(len(self.languages)):
                out[:, b] += np.bincount(owner, weights=(mask >> b) & 1, minlength=len(lines))
        rate = self.false_rate()
        return np.maximum(0, (out - rate * total[:, None]) / (1 - rate))


def ranked(scores: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(best language, lead over the second, score) of each row."""
    order = np.sort(scores, axis=1)
    return scores.argmax(1), order[:, -1] - order[:, -2], order[:, -1]


def judge_lines(scores: np.ndarray) -> np.ndarray:
    """The language of each line that decides by itself, else -1: by its lead alone, not by its length."""
    best, lead, top = ranked(scores)
    return np.where((lead >= LINE_LEAD) & (lead >= LINE_SHARE * np.maximum(top, 1)), best, -1)


def judge_text(scores: np.ndarray, sure: np.ndarray, filters: LanguageFilters) -> tuple[int, float, list[tuple[int, float]]]:
    """(main language, confidence, [(language, confidence) per line]) of a text from its lines' scores and decisions.

    The list is empty unless lines of more than one language decide by themselves. In a mixed text a
    line that doesn't decide takes the better of the languages that occur, or its neighbour's if
    nothing speaks for either. The main language is the one with most n-grams in its lines. -1 if
    there is nothing to go by.
    """
    if not len(scores) or scores.max() <= 0:
        return -1, 0.0, []
    confidence = filters.confidence
    present = sorted(set(sure[sure >= 0].tolist()))
    if len(present) < 2:
        best, lead, top = ranked(scores.sum(0, keepdims=True))
        return int(best[0]), confidence(lead[0], top[0]), []
    among = scores[:, present]
    best, lead, top = ranked(among)
    lines: list[tuple[int, float]] = []
    for i in range(len(scores)):
        if sure[i] >= 0:
            lines.append((int(sure[i]), confidence(lead[i], top[i])))
        elif lead[i] > 0:
            lines.append((present[best[i]], confidence(lead[i], top[i])))
        else:
            near = lines[-1][0] if lines else next((int(s) for s in sure[i:] if s >= 0), present[0])
            lines.append((near, 0.0))
    weight = np.zeros(scores.shape[1])
    for (lang, _), s in zip(lines, scores):
        weight[lang] += s[lang]
    best, lead, top = ranked(weight[None, :])
    return int(best[0]), confidence(lead[0], top[0]), lines


def distinct_grams(hashes: np.ndarray, texts: np.ndarray, languages: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each (hash, text, language) once, told apart by one mixed 64 bit key."""
    place = (texts.astype(np.uint64) << np.uint64(8)) | languages.astype(np.uint64)
    key = (hashes ^ (place * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
    order = np.argsort(key)
    key = key[order]
    first = order[np.concatenate([np.ones(min(1, len(key)), bool), key[1:] != key[:-1]])]
    return hashes[first], texts[first], languages[first]


def gram_counts(texts: Sequence[tuple[Sequence[str], np.ndarray]], n_languages: int, grams: Sequence[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Arrays (hash as signed 64 bit, language, number of texts) over texts of (lines, label of each line, -1: none).

    A text counts an n-gram once a language however often it says it, so a name that few texts repeat is
    no n-gram of their language. What is held at a time is a chunk's n-grams and the distinct ones so far.
    """
    lines = [x for own, _ in texts for x in own]
    label = np.concatenate([np.zeros(0, np.int64), *[labels for _, labels in texts]])
    text = np.repeat(np.arange(len(texts)), [len(own) for own, _ in texts])
    seen = (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    for pieces, owners in chunked(lines, max(grams) - 1):
        hashes, number = gram_hashes(pieces, grams)
        line = np.array(owners, np.int64)[number]
        said = label[line] >= 0
        fresh = distinct_grams(hashes[said], text[line[said]], label[line[said]])
        seen = distinct_grams(*[np.concatenate(x) for x in zip(seen, fresh)]) if len(seen[0]) else fresh
    each = [np.unique(seen[0][seen[2] == b], return_counts=True) for b in range(n_languages)]
    return (
        np.concatenate([k for k, _ in each]).view(np.int64),
        np.repeat(np.arange(n_languages), [len(k) for k, _ in each]),
        np.concatenate([n for _, n in each]).astype(np.int64),
    )


def bits_of(counts: DataFrame, n: int, least_count: int, least_share: float) -> tuple[np.ndarray, np.ndarray]:
    """(hash, mask) of the n-grams that some language contains, from (h, b, n).

    Bounded by the fit's sample: at most its n-grams divided by the least count.
    """
    totals = {r.b: r.n for r in counts.groupBy("b").agg(F.sum("n").alias("n")).collect()}
    each = counts.groupBy("h").agg(*[F.sum(F.when(F.col("b") == b, F.col("n")).otherwise(0)).alias(f"c{b}") for b in range(n)])
    shares = [F.when(F.col(f"c{b}") >= least_count, F.col(f"c{b}") / F.lit(float(max(1, totals.get(b, 0))))).otherwise(0.0) for b in range(n)]
    rows = each.withColumn("_top", F.greatest(*shares) if n > 1 else shares[0]).filter("_top > 0")
    mask = sum((F.when(s >= F.col("_top") * least_share, F.lit(1 << b)).otherwise(0) for b, s in enumerate(shares)), F.lit(0))
    got = rows.select("h", mask.cast("bigint").alias("m")).toPandas()
    return got["h"].to_numpy(np.int64).view(np.uint64), got["m"].to_numpy(np.int64)


def fit(labelled: DataFrame, languages: list[str] = LANGUAGES, sample_rows: int = SAMPLE_ROWS, rounds: int = 2) -> LanguageFilters:
    """Filters fitted on (doc_id, text, code), code being one of the languages.

    Reads at most `sample_rows` labelled rows (those with the smallest hashes of doc_id). Every round
    after the first labels the sample's lines by the filters fitted so far instead of by their rows.
    """
    rows = labelled.select("doc_id", "text", "code").filter(F.col("code").isin(languages) & F.col("text").isNotNull())
    rows = rows.withColumn("_h", F.xxhash64("doc_id"))
    border = rows.select("_h").orderBy("_h").limit(sample_rows).agg(F.max("_h")).first()[0]
    sample = cut(rows.filter(F.col("_h") <= F.lit(border)).select("text", "code"))
    filters = None
    for _ in range(rounds):

        def count(batches: Iterable[pa.RecordBatch], filters: LanguageFilters | None = filters) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts, codes = (c.to_pylist() for c in batch.columns)
                for a in range(0, len(texts), 200):
                    each = [[plain(x) for x in lines_of(t)] for t in texts[a : a + 200]]
                    lines = [x for own in each for x in own]
                    if filters is None:
                        known = np.array([languages.index(c) for c, own in zip(codes[a : a + 200], each) for _ in own], np.int64)
                    else:
                        known = judge_lines(filters.scores(lines)) if lines else np.zeros(0, np.int64)
                    ends = np.cumsum([len(own) for own in each]).tolist()
                    found = gram_counts([(own, known[e - len(own) : e]) for own, e in zip(each, ends)], len(languages), GRAMS)
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], names=["h", "b", "n"])

        counts = cut(sample.mapInArrow(count, "h bigint, b bigint, n bigint").groupBy("h", "b").agg(F.sum("n").alias("n")))
        filters = LanguageFilters.build(languages, *bits_of(counts, len(languages), LEAST_COUNT, LEAST_SHARE))
    return filters


def detect(documents: DataFrame, filters: LanguageFilters) -> DataFrame:
    """(doc_id, segment_no, lang, confidence, label): -1 for the text, then each line of a text in several languages.

    Lines are counted from 0 without blank ones. lang is null for a text with nothing to go by (null,
    empty, digits only). A column `code` of the documents, if there is one, comes out as label. One map,
    in which each text is scored once, no shuffle; texts are read whole.
    """
    languages = filters.languages

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, codes = (c.to_pylist() for c in batch.columns)
            for a in range(0, len(ids), 500):
                raw, owners = [], []
                for t in texts[a : a + 500]:
                    own = lines_of(t)
                    raw += own
                    owners.append((len(raw) - len(own), len(raw)))
                scores = filters.scores([plain(x) for x in raw]) if raw else np.zeros((0, len(languages)))
                sure = judge_lines(scores)
                doubtful = [i for p, q in owners if len(set(sure[p:q].tolist()) - {-1}) > 1 for i in range(p, q) if sure[i] >= 0]
                if doubtful:
                    without = filters.scores([uncapitalised(raw[i]) for i in doubtful])
                    best, lead, _ = ranked(without)
                    kept = (best == sure[doubtful]) & (lead >= UNCAPITALISED_LEAD)
                    sure[doubtful] = np.where(kept, sure[doubtful], -1)
                out = []
                for doc, code, (p, q) in zip(ids[a : a + 500], codes[a : a + 500], owners):
                    main, confidence, segments = judge_text(scores[p:q], sure[p:q], filters)
                    out.append((doc, -1, languages[main] if main >= 0 else None, confidence, code))
                    out += [(doc, n, languages[b], c, code) for n, (b, c) in enumerate(segments)]
                columns = list(zip(*out)) if out else [[]] * 5
                types = [pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.string()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, types)], names=["doc_id", "segment_no", "lang", "confidence", "label"]
                )

    code = F.col("code") if "code" in documents.columns else F.lit(None).cast("string")
    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", code.alias("code")).mapInArrow(
        judge, "doc_id bigint, segment_no bigint, lang string, confidence double, label string"
    )
