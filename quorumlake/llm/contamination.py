"""Evaluation texts leaking into training text: a prefix-filtered set join on word shingles.

A text holds an item if it holds at least `min_words` consecutive words of it with at most one edit in
`words_per_edit`. Every such passage has one within it that is shorter than twice `min_words` (of two
halves one has no more edits than it may), so windows of a few lengths suffice: for each number of edits
the shortest length that allows it. An edit breaks at most as many shingles as a shingle has words, so
of a window's shingles, in order of rarity over all documents, one of the first (words of a shingle x
edits + 1) must be in the text. Those prefix shingles are joined, positions and lengths bound what a hit
can grow into, and each remaining hit is verified by an exact alignment.

Items of bounded size travel to the documents, which are mapped twice (counting, joining) and never
shuffled. More items than that meet the documents in joins on shingles: also two passes over the
documents and one over those with hits, however many items there are.
"""

from __future__ import annotations

import heapq
import html
import re
import unicodedata
import zlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumlake.operators.skew import salted_join
from quorumlake.session import cut

#: Words of a shingle; words of an item that a text must hold; item words to one edit. Shingles of five
#: words can't prune here: with two edits only one of a window's eleven need be left, so all are prefix.
SHINGLE, MIN_WORDS, WORDS_PER_EDIT = 3, 15, 7
#: Items of up to so many characters travel with the plan; more are joined.
MOST_CHARS = 20_000_000
#: Bits of the filter that tells which shingles items have; fixed, so more items only let more pass.
FILTER_BITS = 1 << 27

#: Fixed: tags that part words; other tags stand inside words without parting them.
PARTING_TAGS = "br|p|div|li|ul|ol|td|th|tr|table|h[1-6]|hr|pre|blockquote"
#: What may follow a tag's name: up to 300 signs of any kind, or attributes with values of any length.
TAG_REST = r"""(?:[^<>]{0,300}|(?:\s+[\w:@.-]+\s*=\s*(?:"[^"<>]*"|'[^'<>]*'|[^\s"'<>=]+))+\s*/?)>"""


class _Shown(dict):
    """Maps invisible characters and combining marks to nothing."""

    def __missing__(self, code: int) -> int | None:
        self[code] = None if unicodedata.category(chr(code)) in ("Mn", "Me", "Cf", "Cc") and chr(code) not in "\t\n\r\f\v\x1c\x1d\x1e\x1f\x85" else code
        return self[code]


def normalised_words(text: str | None, shown: dict | None = None) -> list[str]:
    """Words without case, accents, punctuation, markup and invisible characters."""
    if not text:
        return []
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text).translate(_Shown() if shown is None else shown)
    if "<" in text:
        text = re.sub(rf"(?i)</?(?:{PARTING_TAGS})\b{TAG_REST}", " ", text)
        text = re.sub(rf"</?[A-Za-z][\w:-]*{TAG_REST}", "", text)
    return re.findall(r"[^\W_]+", text.casefold())


def windows_of(min_words: int, words_per_edit: int) -> list[tuple[int, int]]:
    """(words, edits) of the windows that every passage has one of: the shortest for each number of edits."""
    lengths = range(min_words, 2 * min_words)
    return [(n, n // words_per_edit) for n in lengths if n == min_words or n % words_per_edit == 0]


def prefix_length(window: int, shingle: int, edits: int) -> int:
    """How many of a window's shingles, rarest first, must be looked up to miss no leak."""
    return min(window - shingle + 1, shingle * edits + 1)


def prefix_places(shingles: Sequence, min_words: int, shingle: int, words_per_edit: int, rarity: Callable[[Any], Any]) -> set[int]:
    """The places of an item's shingles that are in the prefix of some window."""
    ranks = [(rarity(s), p) for p, s in enumerate(shingles)]
    wanted: set[int] = set()
    for words, edits in windows_of(min_words, words_per_edit):
        n = words - shingle + 1
        take = prefix_length(words, shingle, edits)
        for start in range(len(shingles) - n + 1):
            wanted.update(p for _, p in heapq.nsmallest(take, ranks[start : start + n]))
    return wanted


def longest_passage(item: Sequence, text: Sequence, i: int, j: int, words_per_edit: int) -> tuple[int, int]:
    """(words, edits) of the longest passage of `item` from word i, held by `text` from word j.

    It begins and ends with an equal word and has at most one edit (word replaced, dropped or
    inserted) in `words_per_edit` of its words. Furthest reaching ends per diagonal and number of
    edits: quadratic in the edits, not in the lengths.
    """
    n, m = len(item), len(text)

    def slide(a: int, d: int) -> int:
        while a < n and 0 <= a + d < m and item[a] == text[a + d]:
            a += 1
        return a

    base = j - i
    reach = {base: slide(i, base)}
    best = (reach[base] - i, 0)
    for e in range(1, (n - i) // words_per_edit + 1):
        fresh: dict[int, int] = {}
        for d, a in reach.items():
            for to, at in ((d, a + 1), (d - 1, a + 1), (d + 1, a)):  # replaced, dropped, inserted
                if at <= n and at + to <= m:
                    fresh[to] = max(fresh.get(to, -1), at)
        reach = {}
        for d, a in fresh.items():
            end = slide(a, d)
            reach[d] = end
            if end > a and (end - i) >= words_per_edit * e and end - i > best[0]:
                best = (end - i, e)
    return best


class ItemIndex:
    """Items under their numbers: words as numbers, prefix shingles and where they stand."""

    def __init__(self, items: Iterable[tuple[int, list[str]]], min_words: int, shingle: int, words_per_edit: int) -> None:
        self.min_words, self.shingle, self.words_per_edit = min_words, shingle, words_per_edit
        self.number: dict[str, int] = {}
        self.items: list[tuple[int, list[int]]] = []  # one item_id may have several texts
        for item_id, words in items:
            if len(words) >= min_words:
                self.items.append((item_id, [self.number.setdefault(w, len(self.number)) for w in words]))
        self.places: dict[tuple, list[tuple[int, int]]] = defaultdict(list)
        for i, (_, words) in enumerate(self.items):
            for p in range(len(words) - shingle + 1):
                self.places[tuple(words[p : p + shingle])].append((i, p))

    def keep_prefixes(self, frequency: dict[tuple, int]) -> None:
        """Only the places that some window needs: its first shingles in order of rarity."""
        places: dict[tuple, list[tuple[int, int]]] = defaultdict(list)
        for i, (_, words) in enumerate(self.items):
            own = [tuple(words[p : p + self.shingle]) for p in range(len(words) - self.shingle + 1)]
            for p in prefix_places(own, self.min_words, self.shingle, self.words_per_edit, lambda s: (frequency.get(s, 0), s)):
                places[own[p]].append((i, p))
        self.places = dict(places)

    def shingles_of(self, words: list[str]) -> tuple[list[int], list[tuple[int, tuple]]]:
        """The text's words as numbers (-1: in no item) and its shingles that items have."""
        get = self.number.get
        numbers = [get(w, -1) for w in words]
        found, run = [], 0
        for p, x in enumerate(numbers):
            run = run + 1 if x >= 0 else 0
            if run >= self.shingle:
                s = tuple(numbers[p - self.shingle + 1 : p + 1])
                if s in self.places:
                    found.append((p - self.shingle + 1, s))
        return numbers, found

    def leaks(self, words: list[str]) -> Iterator[tuple[int, int, int, int]]:
        """(item_id, first word, words, edits) of the longest passage of each item in the text."""
        numbers, found = self.shingles_of(words)
        hits: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for p, s in found:
            for i, q in self.places[s]:
                hits[i].append((p, q))
        longest: dict[int, tuple[int, int, int]] = {}
        for i, seeds in sorted(hits.items()):
            item_id, item = self.items[i]
            slack = len(item) // self.words_per_edit
            spots: dict[int, list[int]] = defaultdict(list)
            for q, w in enumerate(item):
                spots[w].append(q)
            vocabulary, best, done_to, bands = set(item), (0, 0, 0), -1, set()
            for p, q in seeds:
                # position bound: what this hit can belong to lies within the item's length around it
                low, high = max(0, p - q - slack), min(len(numbers), p - q + len(item) + slack)
                if high <= done_to and (p - q) in bands:
                    continue
                # length bound: too few of the item's words around the hit to make up a window
                if sum(1 for x in numbers[low:high] if x in vocabulary) < self.min_words - self.min_words // self.words_per_edit:
                    continue
                bands.add(p - q)
                done_to = max(done_to, high)
                for j in range(low, high):
                    for k in spots.get(numbers[j], ()):
                        starts = k == 0 or j == 0 or item[k - 1] != numbers[j - 1]
                        if starts and abs((j - k) - (p - q)) <= slack and len(item) - k >= self.min_words:
                            n, e = longest_passage(item, numbers, k, j, self.words_per_edit)
                            if n > best[1]:
                                best = (k, n, e)
            if best[1] >= self.min_words and (item_id not in longest or best[1] > longest[item_id][1]):
                longest[item_id] = best
        for item_id, best in sorted(longest.items()):
            yield item_id, *best


LEAK_SCHEMA = "doc_id bigint, item_id bigint, item_from bigint, n_words bigint, n_edits bigint"


def leak_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[x.split()[0] for x in LEAK_SCHEMA.split(", ")])


def leaked_items(
    documents: DataFrame,
    items: DataFrame,
    min_words: int = MIN_WORDS,
    shingle: int = SHINGLE,
    words_per_edit: int = WORDS_PER_EDIT,
    most_chars: int = MOST_CHARS,
) -> DataFrame:
    """(doc_id, item_id, item_from, n_words, n_edits): one row per document and item that it holds.

    documents: doc_id (unique), text; items: item_id, text. Words compare as `normalised_words` says.
    Of several passages the longest is reported; one item_id may have several texts. Items of fewer than
    `min_words` words can't leak and null or empty texts hold nothing; repeated item rows count once.
    Items of up to `most_chars` characters in all travel with the plan, more are joined.
    """
    documents = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    items = items.select(F.col("item_id").cast("bigint").alias("item_id"), "text").dropna().distinct()
    if (items.agg(F.sum(F.length("text"))).first()[0] or 0) > most_chars:
        return joined_leaks(documents, items, min_words, shingle, words_per_edit)
    rows = items.orderBy("item_id", "text").collect()
    index = ItemIndex([(r.item_id, normalised_words(r.text)) for r in rows], min_words, shingle, words_per_edit)
    order = {s: k for k, s in enumerate(index.places)}
    shingles = list(order)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shown, seen = _Shown(), Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update({order[s] for _, s in index.shingles_of(normalised_words(text, shown))[1]})
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], names=["k", "n"])

    # one row per shingle of the items at most
    counts = documents.select("text").mapInArrow(count, "k bigint, n bigint").groupBy("k").agg(F.sum("n").alias("n"))
    frequency = {shingles[r.k]: r.n for r in counts.collect()}
    pruned = ItemIndex([(r.item_id, normalised_words(r.text)) for r in rows], min_words, shingle, words_per_edit)
    pruned.keep_prefixes(frequency)

    def join(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shown = _Shown()
        for batch in batches:
            pairs = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            yield leak_batch([(d, *leak) for d, text in pairs if text for leak in pruned.leaks(normalised_words(text, shown))])

    return documents.mapInArrow(join, LEAK_SCHEMA)


# ---- more items than a plan can carry -----------------------------------------------------------


def shingle_hashes(words: Sequence[str], shingle: int) -> list[int]:
    """A signed 64 bit hash per shingle, the same in every process."""
    joined = ("\x1f".join(words[p : p + shingle]) for p in range(len(words) - shingle + 1))
    return [xxhash.xxh3_64_intdigest(x) - (1 << 63) for x in joined]


class ShingleFilter:
    """A Bloom filter of fixed size over shingle hashes."""

    def __init__(self, bits: int = FILTER_BITS) -> None:
        self.bits, self.data = bits, np.zeros(bits // 8, np.uint8)

    def places(self, hashes: np.ndarray) -> Iterator[np.ndarray]:
        h = hashes.view(np.uint64)
        for k in range(3):
            yield ((h >> np.uint64(16 * k)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)) & np.uint64(self.bits - 1)

    def add(self, hashes: np.ndarray) -> None:
        for at in self.places(hashes):
            np.bitwise_or.at(self.data, (at >> np.uint64(3)).astype(np.int64), (1 << (at & np.uint64(7)).astype(np.uint8)).astype(np.uint8))

    def has(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for at in self.places(hashes):
            out &= (self.data[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return out

    @classmethod
    def of(cls, hashes: DataFrame, bits: int = FILTER_BITS) -> ShingleFilter:
        """Built in the tasks, a filter each, and united one at a time: the driver holds two."""

        def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = cls(bits)
            for b in batches:
                own.add(b.column(0).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(own.data.tobytes(), 1)], pa.binary())], names=["f"])

        out = cls(bits)
        for r in hashes.mapInArrow(build, "f binary").toLocalIterator():
            out.data |= np.frombuffer(zlib.decompress(r.f), np.uint8)
        return out


def document_shingles(documents: DataFrame, known: ShingleFilter, shingle: int) -> DataFrame:
    """(doc_id, h): the distinct shingles of each document that the filter knows."""

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shown = _Shown()
        for batch in batches:
            ids, hashes = [], []
            for d, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = np.unique(np.array(shingle_hashes(normalised_words(text, shown), shingle), np.int64))
                own = own[known.has(own)]
                ids.append(np.full(len(own), d, np.int64))
                hashes.append(own)
            none = np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([none, *x])) for x in (ids, hashes)], names=["doc_id", "h"])

    return documents.filter("doc_id is not null and text is not null").mapInArrow(emit, "doc_id bigint, h bigint")


def joined_leaks(documents: DataFrame, items: DataFrame, min_words: int, shingle: int, words_per_edit: int, bits: int = FILTER_BITS) -> DataFrame:
    """`leaked_items` by joins on shingles, for items of any number."""
    named = cut(items.withColumn("key", F.xxhash64("item_id", "text")))

    def cut_items(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shown = _Shown()
        for batch in batches:
            rows = [(k, p, h) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for w in [normalised_words(t, shown)] if len(w) >= min_words for p, h in enumerate(shingle_hashes(w, shingle))]
            columns = zip(*rows) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["key", "p", "h"])

    def choose(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, shingles in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = sorted((s["p"], s["n"], s["h"]) for s in shingles)
                wanted = prefix_places([x[1:] for x in own], min_words, shingle, words_per_edit, lambda s: s)
                rows += [(key, h) for h in sorted({own[p][2] for p in wanted})]
            columns = zip(*rows) if rows else [[]] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["key", "h"])

    def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shown = _Shown()
        for batch in batches:
            out = []
            for d, text, i, item in zip(*(c.to_pylist() for c in batch.columns)):
                index = ItemIndex([(i, normalised_words(item, shown))], min_words, shingle, words_per_edit)
                out += [(d, *leak) for leak in index.leaks(normalised_words(text, shown))]
            yield leak_batch(out)

    shingles = cut(named.select("key", "text").mapInArrow(cut_items, "key bigint, p bigint, h bigint"))
    known = ShingleFilter.of(shingles.select("h"), bits)
    counts = document_shingles(documents, known, shingle).groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    counts = cut(counts.join(shingles.select("h").distinct(), "h", "left_semi"))
    counted = salted_join(shingles, counts, ["h"], F.struct("key", "p"), "left").withColumn("n", F.coalesce("n", F.lit(0)))
    # the shingles of one item are as many as its text has words
    grouped = counted.groupBy("key").agg(F.collect_list(F.struct("p", "n", "h")).alias("s"))
    prefixes = cut(grouped.mapInArrow(choose, "key bigint, h bigint"))
    hits = document_shingles(documents, ShingleFilter.of(prefixes.select("h"), bits), shingle)
    hits = cut(hits.join(prefixes.select("h").distinct(), "h", "left_semi"))
    pairs = cut(salted_join(hits, prefixes, ["h"], F.col("doc_id")).select("doc_id", "key").distinct())
    with_item = cut(salted_join(pairs, named.withColumnRenamed("text", "item"), ["key"], F.col("doc_id")))
    met = salted_join(with_item, documents, ["doc_id"], F.col("key"))
    leaks = met.select("doc_id", "text", "item_id", "item").mapInArrow(verify, LEAK_SCHEMA)
    # an item with several texts counts by its longest passage
    best = F.max(F.struct("n_words", (-F.col("item_from")).alias("_at"), "n_edits")).alias("_b")
    return leaks.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", (-F.col("_b._at")).alias("item_from"), "_b.n_words", "_b.n_edits")
