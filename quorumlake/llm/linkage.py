"""Matching records without a common key: heuristic votes, and a label model that learns what they are worth.

Several matching functions vote on each candidate pair, each with one of a few categories (abstain,
disagree, ...). A generative model explains the votes by a hidden match or mismatch: it learns by EM
how often a function votes what in either case, and which functions err together (a tree of
conditional dependencies, so correlated votes aren't counted twice). The posterior is the confidence.
It is fitted on the counts of distinct vote patterns, which the categories bound, not the data.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from quorumlake.operators.skew import salted_join
from quorumlake.session import cut


@dataclass
class LabelModel:
    """P(match) and, per function, P(vote | match or not, vote of its parent in the tree)."""

    sizes: list[int]
    parents: list[int]  # -1: no parent
    prior: float
    tables: list[np.ndarray]  # (2, categories of the parent or 1, own categories)

    def log_odds(self, votes: np.ndarray) -> np.ndarray:
        out = np.full(len(votes), np.log(self.prior / (1 - self.prior)))
        for k, p in enumerate(self.parents):
            at = votes[:, p] if p >= 0 else np.zeros(len(votes), int)
            out += np.log(self.tables[k][1, at, votes[:, k]]) - np.log(self.tables[k][0, at, votes[:, k]])
        return out

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(votes), -500, 500)))


#: Sum of leanings from which on a pattern of votes that don't contradict each other is clear.
CLEAR = 3.0


def monotone(ratios: np.ndarray, weights: np.ndarray, leaning: np.ndarray) -> np.ndarray:
    """The closest ratios (weighted) that don't fall where the leaning rises, by pooling violators."""
    order = np.argsort(leaning, kind="stable")
    blocks: list[list[float]] = []
    for k in order:
        blocks.append([ratios[k], max(weights[k], 1e-9), 1])
        while len(blocks) > 1 and blocks[-2][0] > blocks[-1][0]:
            r, w, n = blocks.pop()
            q, v, m = blocks[-1]
            blocks[-1] = [(r * w + q * v) / (w + v), w + v, m + n]
    out = np.empty(len(ratios))
    out[order] = np.concatenate([np.full(n, r) for r, _, n in blocks])
    return out


def maximisation(
    votes: np.ndarray, n: np.ndarray, y: np.ndarray, leaning: list[list[float]], parents: list[int], smooth: float
) -> LabelModel:
    """Tables from soft labels. A vote that leans more to a match than another never counts less for it."""
    sizes, tables = [len(x) for x in leaning], []
    for k, p in enumerate(parents):
        table = np.full((2, sizes[p] if p >= 0 else 1, sizes[k]), smooth)
        at = votes[:, p] if p >= 0 else np.zeros(len(votes), int)
        np.add.at(table, (1, at, votes[:, k]), n * y)
        np.add.at(table, (0, at, votes[:, k]), n * (1 - y))
        seen = table.sum(0)
        table /= table.sum(2, keepdims=True)
        spoken = np.array([c != 0 for c in range(sizes[k])])  # abstaining is no step on the scale
        for q in range(table.shape[1]):
            ratio = np.log(table[1, q]) - np.log(table[0, q])
            ratio[spoken] = monotone(ratio[spoken], seen[q][spoken], np.array(leaning[k])[spoken])
            table[0, q] = table[1, q] / np.exp(ratio)
        tables.append(table)
    prior = float(np.clip((n * y).sum() / n.sum(), 1e-4, 1 - 1e-4))
    return LabelModel(sizes, parents, prior, tables)


def expectation_maximisation(
    votes: np.ndarray, n: np.ndarray, leaning: list[list[float]], parents: list[int], rounds: int, smooth: float
) -> tuple[LabelModel, float]:
    """The model for given dependencies, and the log likelihood of the votes under it."""
    said = np.stack([np.array(leaning[k], float)[votes[:, k]] for k in range(len(leaning))], 1)
    # a function that follows another has no say of its own at the start
    lean = said[:, [p < 0 for p in parents]].sum(1)
    y = 1 / (1 + np.exp(-lean))
    # patterns whose votes all point one way stay on that side, so that the two sides mean match and
    # mismatch; without that they may split along anything that many candidates share
    clear = np.where((said.sum(1) >= CLEAR) & (said >= 0).all(1), 1.0, np.where((said.sum(1) <= -CLEAR) & (said <= 0).all(1), 0.0, np.nan))
    y = np.where(np.isnan(clear), y, clear)
    for _ in range(rounds):
        model = maximisation(votes, n, y, leaning, parents, smooth)
        fresh = np.where(np.isnan(clear), model.posterior(votes), clear)
        done = np.abs(fresh - y).max() < 1e-6
        y = fresh
        if done:
            break
    likelihood = np.zeros((2, len(votes)))
    likelihood[1], likelihood[0] = np.log(model.prior), np.log(1 - model.prior)
    for k, p in enumerate(parents):
        at = votes[:, p] if p >= 0 else np.zeros(len(votes), int)
        for side in (0, 1):
            likelihood[side] += np.log(model.tables[k][side, at, votes[:, k]])
    return model, float((n * np.logaddexp(*likelihood)).sum())


def fit_label_model(votes: np.ndarray, counts: np.ndarray, leaning: list[list[float]], rounds: int = 60, smooth: float = 0.5) -> LabelModel:
    """EM on distinct vote patterns (rows of category numbers) and their counts.

    leaning: for each function and category how far the vote speaks for a match: the starting point,
    and the order in which votes may count. Dependencies are added one at a time, each function
    following at most one other, as long as they explain the votes better than their number of
    parameters costs (BIC). Without any pattern nothing is known and the prior is one half.
    """
    sizes = [len(x) for x in leaning]
    n = np.asarray(counts, float)
    votes = np.asarray(votes, int).reshape(-1, len(sizes))
    parents = [-1] * len(sizes)
    if not len(votes):
        one = np.ones((2, 1, 1))
        return LabelModel(sizes, parents, 0.5, [np.repeat(one, s, 2) / s for s in sizes])

    def price(parents: list[int]) -> float:
        free = sum(2 * (sizes[p] if p >= 0 else 1) * (sizes[k] - 1) for k, p in enumerate(parents))
        return 0.5 * free * float(np.log(n.sum() + 1))

    def follows(parents: list[int], k: int, p: int) -> bool:
        while p >= 0 and p != k:
            p = parents[p]
        return p == k

    model, likelihood = expectation_maximisation(votes, n, leaning, parents, rounds, smooth)
    best = likelihood - price(parents)
    for _ in sizes:
        tried = []
        for k in range(len(sizes)):
            for p in range(len(sizes)):
                if parents[k] < 0 and k != p and not follows(parents, k, p):
                    one = [*parents[:k], p, *parents[k + 1 :]]
                    fit, likelihood = expectation_maximisation(votes, n, leaning, one, rounds, smooth)
                    tried.append((likelihood - price(one), one, fit))
        score, one, fit = max(tried, key=lambda x: x[0], default=(best, parents, model))
        if score <= best:
            break
        best, parents, model = score, one, fit
    return model


# ---- the raid bosses and the forms they describe ------------------------------------------------

#: Fixed: words that stand for the plain form, and words that say nothing about the form.
PLAIN_FORM, NOISE_WORDS = {"", "standard", "normal", "none", "null", "nan"}, {"form", "forme"}
#: Fixed: the word for a kind of raid that says nothing about the form.
SHADOW = "shadow"


def folded(text: str | None) -> str:
    """Lower case, without accents, as words parted by single blanks."""
    t = unicodedata.normalize("NFKD", text or "")
    t = "".join(c for c in t if unicodedata.category(c) != "Mn").casefold()
    return re.sub(r"[\W_]+", " ", t).strip()


def squashed(text: str | None) -> str:
    """Letters and digits only, folded."""
    return folded(text).replace(" ", "")


def costume_key(text: str | None) -> str:
    """`event:year:number` of a costume by its token (KITE_2031_00007_NOEVOLVE) or display name
    (Kite goggles 2031 no. 7); another text squashed; the empty string for none."""
    words = [w for w in folded(text).split() if w not in ("noevolve", "costume")]
    year = next((i for i, w in enumerate(words) if re.fullmatch(r"(19|20|21)\d\d", w) and i), None)
    if year is None:
        return "" if " ".join(words) in PLAIN_FORM else "".join(words)
    number = next((str(int(w)) for w in words[year + 1 :] if w.isascii() and w.isdigit()), "")
    return f"{words[0]}:{words[year]}:{number}"


#: The end of a costume's name (a year and perhaps a number), what its name may not hold, and what opens it.
COSTUME_END = re.compile(r"\s(?:19|20|21)\d\d(?:\s+(?:no\.?\s*)?\d+)?\s*[\])]?\s*$", re.IGNORECASE)
NO_COSTUME, OPENS_COSTUME = re.compile(r"[\d\[\](),:]"), re.compile(r"\s(?:with|wearing|in|w/|-)(?=\s)", re.IGNORECASE)
BLANK = re.compile(r"\s*")
COSTUME_WORD = re.compile(r"[^\W\d_]+\b")


def costume_in(text: str) -> tuple[str, str] | None:
    """(what stands before, the costume's name) of a text that ends with a costume; None for another one.

    The costume is opened by a bracket, colon, comma, dash or word for wearing. Read from the end, in
    time linear in the text.
    """
    end = COSTUME_END.search(text)
    if end is None:
        return None
    marks = [m.start() for m in NO_COSTUME.finditer(text, 0, end.start())]
    at = marks[-1] + 1 if marks else 0
    tail = re.sub(r"[\s\])]+$", "", text)
    if marks and text[at - 1] in "[(:,":
        start = at + len(text[at:]) - len(text[at:].lstrip())
        if COSTUME_WORD.match(text, start):
            return text[: at - 1], tail[start:]
    for opening in OPENS_COSTUME.finditer(text, at, end.start() + 1):
        start = BLANK.match(text, opening.end()).end()
        if COSTUME_WORD.match(text, start):
            return text[: opening.start()], tail[start:]
    return None


def split_name(words: list[str], most: int = 2) -> list[tuple[str, str]]:
    """All readings (species, variant) of the words of a name without costume and raid kind.

    A variant has up to `most` words, at the beginning, the end or both.
    """
    words = [w for w in words if w not in NOISE_WORDS]
    out = [("".join(words), "")]
    for k in range(1, min(most, len(words) - 1) + 1):
        for before in range(k, -1, -1):
            after = k - before
            out.append(("".join(words[before : len(words) - after]), "".join([*words[:before], *words[len(words) - after :]])))
    return [(s, "" if v in PLAIN_FORM else v) for s, v in dict.fromkeys(out)]


def near_shadow(word: str) -> bool:
    return word == SHADOW or (len(word) in (5, 6, 7) and sorted(word) == sorted(SHADOW))


def read_boss(name: str | None, form: str | None, costume: str | None, reference: str | None, most: int = 2) -> tuple[list[tuple[str, str, str]], str, str]:
    """((source, species, variant) readings, costume in the name, costume column)."""
    text = re.sub(r"\s+", " ", name or "").strip()
    text = "".join(c for c in unicodedata.normalize("NFKD", text) if unicodedata.category(c) != "Mn")
    found = costume_in(text)
    rest, in_name = (found[0], costume_key(found[1])) if found else (text, "")
    words = folded(rest).split()
    words = words[1:] if len(words) > 1 and near_shadow(words[0]) else words
    readings = [("name", s, v) for s, v in split_name(words, most)] if words else []
    form_words = [w for w in folded(form).split() if w not in NOISE_WORDS]
    whole = "".join(form_words)
    if whole and whole not in PLAIN_FORM:
        readings.append(("form_only", "", whole))  # the field may hold the variant alone,
        readings += [("form", s, v) for s, v in split_name(form_words, most)]  # or the species with or without it
    elif whole:
        readings.append(("form_only", "", ""))
    if squashed(reference):
        readings.append(("id", squashed(reference), ""))
    return readings, in_name, costume_key(costume)


READING_SCHEMA = (
    "boss_id bigint, readings array<struct<source string, species string, variant string>>, in_name string, in_column string"
)


def read_bosses(batches: Iterable[pa.RecordBatch], most: int = 2) -> Iterator[pa.RecordBatch]:
    text = pa.string()
    reading = pa.list_(pa.struct([("source", text), ("species", text), ("variant", text)]))
    for b in batches:
        rows = [read_boss(*x, most) for x in zip(*(c.to_pylist() for c in b.columns[1:]))]
        columns = list(zip(*rows)) if rows else [[]] * 3
        readings = [[dict(zip(("source", "species", "variant"), r)) for r in x] for x in columns[0]]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array(readings, reading), pa.array(columns[1], text), pa.array(columns[2], text)],
            names=["boss_id", "readings", "in_name", "in_column"],
        )


def with_keys(df: DataFrame, columns: dict[str, tuple[str, str]]) -> DataFrame:
    """df with normalised text columns: new name -> (old name, squashed, variant or costume)."""
    work = {"squashed": squashed, "variant": lambda t: "" if squashed(t) in PLAIN_FORM else squashed(t), "costume": costume_key}
    schema = StructType([*df.schema, *[StructField(n, StringType()) for n in columns]])

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            extra = [
                pa.array([work[kind](t) for t in b.column(b.schema.get_field_index(old)).to_pylist()], pa.string()) for old, kind in columns.values()
            ]
            yield pa.RecordBatch.from_arrays([*b.columns, *extra], names=[*b.schema.names, *columns])

    return df.mapInArrow(add, schema)


#: Texts up to so many characters are found by deletions, longer ones by either half.
SHORT = 40


def edit_keys(c: Column) -> Column:
    """Keys of which two texts one edit apart (or with two neighbours exchanged) share at least one.

    A short text's keys are the text and all texts with one character less (a single character has only
    itself). An edit in a long text leaves its first or its last half as it is; halves are keys together
    with the length they belong to, for the text's own length and the two next to it, so that texts
    with a common opening meet only if a whole half is equal.
    """
    shorter = F.transform(
        F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, F.length(c)))
    )

    def halves(d: int) -> list[Column]:
        n = F.length(c) + d
        half = F.floor((n - 1) / 2).cast("int")
        return [F.concat(n.cast("string"), F.lit("<"), F.left(c, half)), F.concat(n.cast("string"), F.lit(">"), F.right(c, half))]

    both = F.array(*[k for d in (-1, 0, 1) for k in halves(d)])
    return F.array_distinct(
        F.when(F.length(c) < 2, F.array(c))
        .when(F.length(c) < SHORT, F.concat(F.array(c), shorter))
        .when(F.length(c) > SHORT + 1, both)
        .otherwise(F.concat(F.array(c), shorter, both))
    )


def similar_names(texts: DataFrame, names: DataFrame, most: int = 2) -> DataFrame:
    """(text, key, distance): names within `most` edits of a text among those that share an edit key.

    Any two texts of 2 characters or more that are one edit apart (a letter replaced, dropped, inserted
    or two neighbours exchanged) share one, so an equi-join finds them; no pairs are enumerated. Two
    letters exchanged count as one edit. Keys that many names share are salted.
    """
    left = cut(texts.select("text", F.explode(edit_keys(F.col("text"))).alias("_d")))
    right = names.select(F.col("text").alias("_name"), "key", F.explode(edit_keys(F.col("text"))).alias("_d"))
    # a sort-merge join by hint: runtime sizes are taken before texts are multiplied by their keys
    close = salted_join(left, right.hint("merge"), ["_d"], F.col("text")).select("text", "_name", "key").distinct()
    close = close.withColumn("distance", F.levenshtein("text", "_name", most))
    letters = lambda c: F.array_sort(F.split(c, ""))
    swapped = (F.col("distance") == 2) & (F.length("text") == F.length("_name")) & (letters(F.col("text")) == letters(F.col("_name")))
    close = close.withColumn("distance", F.when(swapped, 1).otherwise(F.col("distance")))
    return close.filter(F.col("distance") >= 0).groupBy("text", "key").agg(F.min("distance").alias("distance"))


#: Votes by function, each with what it leans to at the start. Category 0 abstains.
VOTES: dict[str, list[tuple[str, float]]] = {
    "name": [("abstain", 0), ("other", -3), ("other_variant", -3), ("beaten", -1.5), ("species_near", 0.5), ("species", 1.5), ("far", 0.5), ("near", 1.5), ("equal", 3)],
    "form": [("abstain", 0), ("other", -1), ("other_variant", -3), ("species", 0.5), ("near", 1), ("equal", 2)],
    "reference": [("abstain", 0), ("other", -0.5), ("near", 1), ("equal", 2)],
    "costume": [("abstain", 0), ("differs", -3), ("agrees", 2)],
    "cp": [("abstain", 0), ("far", -2), ("near", 0.5), ("equal", 2)],
}
#: Square of the CP multiplier of raid bosses and of boosted ones, over 10; individual values of the bounds.
RAID_CP, BOOSTED_CP, LOW_IV, HIGH_IV = 0.5974**2 / 10, 0.667934**2 / 10, 10, 15


def raid_cp(attack: Column, defence: Column, stamina: Column, iv: int, factor: float) -> Column:
    return (attack + iv) * F.sqrt(defence + iv) * F.sqrt(stamina + iv) * factor


def category(function: str, name: str) -> Column:
    return F.lit([n for n, _ in VOTES[function]].index(name))


def match_forms(bosses: DataFrame, forms: DataFrame, species: DataFrame, least: float = 0.5) -> DataFrame:
    """(boss_id, form_slug, confidence): the form each boss describes, if one is likely enough.

    bosses: boss_id, name, form, costume, reference, four CP columns, snapshot, loaded; forms: slug,
    dex, variant, costume, attack, defence, stamina, snapshot; species: dex, name. Of several rows of
    a boss the one loaded last counts; null or empty texts are no evidence. A boss whose costume or
    variant its species doesn't have finds no candidate with it and gives no row. Of a boss's likely
    candidates the one with the highest posterior counts, of equals the smallest slug. Candidates come from equi-joins on species, variant and costume, spread over salts
    where one species holds many rows.
    """
    cps = ["min_cp", "max_cp", "min_boosted_cp", "max_boosted_cp"]
    texts = ["name", "form", "costume", "reference"]
    last = (
        bosses.select("boss_id", F.struct("loaded", *texts, *cps, "snapshot").alias("_b"))
        .dropna(subset=["boss_id"])
        .groupBy("boss_id")
        .agg(F.max("_b").alias("_b"))
        .select("boss_id", "_b.*")
    )
    last = cut(last)
    # no form has a variant of more words, so no longer one needs to be read
    words = F.size(F.filter(F.split(F.lower("variant"), r"[\W_]+"), lambda w: w != ""))
    longest = max(2, forms.agg(F.max(words)).first()[0] or 0)
    read = cut(last.select("boss_id", *texts).mapInArrow(lambda b: read_bosses(b, longest), READING_SCHEMA))
    form_rows = with_keys(
        forms.select("slug", "dex", "variant", "costume").filter("slug is not null and dex is not null").distinct(),
        {"variant_key": ("variant", "variant"), "costume_key": ("costume", "costume")},
    )
    records = cut(form_rows.select("slug", "dex", "variant_key", "costume_key").distinct())
    names = with_keys(species.select("dex", "name").dropna().distinct(), {"text": ("name", "squashed")})
    names = names.filter("text <> ''").select("text", F.col("dex").alias("key")).distinct()

    # readings of a species, resolved once per distinct text
    readings = read.select("boss_id", F.explode("readings").alias("_r")).select("boss_id", "_r.*")
    spoken = readings.filter("species <> ''").withColumnRenamed("species", "text")
    resolved = similar_names(spoken.select("text").distinct(), names)
    hits = salted_join(spoken, resolved, ["text"], F.col("boss_id")).select("boss_id", F.col("key").alias("dex"), "source", "variant", "distance")
    per_boss = hits.groupBy("boss_id").agg(
        F.min(F.when(F.col("source") == "name", F.col("distance"))).alias("_closest"), F.max(F.col("source") == "form").alias("_like")
    )
    only = readings.filter("source = 'form_only'").select("boss_id", F.col("variant").alias("_only"))
    evidence = hits.groupBy("boss_id", "dex").agg(F.collect_set(F.struct("source", "variant", "distance")).alias("_e"))
    evidence = cut(evidence.join(per_boss, "boss_id").join(only, "boss_id", "left"))

    # candidates: forms of a resolved species with just the variant and the costume that the texts name
    def named(source: str) -> Column:
        mine = F.filter("_e", lambda x: x["source"] == source)
        return F.array_min(F.transform(mine, lambda x: F.struct(x["distance"], x["variant"] == "", x["variant"].alias("v"))))["v"]

    in_form = F.coalesce(named("form"), F.when(~F.col("_like"), F.col("_only")))
    variants = F.array_distinct(F.filter(F.array(named("name"), in_form), lambda x: x != ""))
    variants = F.when(F.size(variants) > 0, variants).otherwise(F.array(F.lit("")))
    mentioned = F.array_distinct(F.filter(F.array("in_name", "in_column"), lambda x: x != ""))
    costumes = F.when(F.size(mentioned) > 0, mentioned).otherwise(F.array(F.lit("")))
    wanted = (
        evidence.join(read.select("boss_id", "in_name", "in_column"), "boss_id")
        .withColumn("variant_key", F.explode(variants))
        .withColumn("costume_key", F.explode(costumes))
    )
    found = salted_join(wanted, records, ["dex", "variant_key", "costume_key"], F.col("boss_id"))
    found = cut(found.join(last.select("boss_id", "snapshot", *cps), "boss_id"))
    stats = (
        forms.filter("slug is not null")
        .join(found.select("slug", "snapshot").distinct(), ["slug", "snapshot"], "left_semi")
        .groupBy("slug", "snapshot")
        .agg(*[F.max(c).cast("double").alias(c) for c in ("attack", "defence", "stamina")])
    )
    found = salted_join(found, stats, ["slug", "snapshot"], F.col("boss_id"), "left")

    # votes
    def closest(source: str, variant: Column, same: bool = True) -> Column:
        mine = F.filter("_e", lambda x: (x["source"] == source) & ((x["variant"] == variant) if same else ~x["variant"].isin("") & (x["variant"] != variant)))
        return F.array_min(F.transform(mine, lambda x: x["distance"]))

    def graded(function: str, d: Column) -> Column:
        return F.when(d == 0, category(function, "equal")).when(d == 1, category(function, "near"))

    own_variant = F.col("variant_key")
    name_same, name_other, name_plain = closest("name", own_variant), closest("name", own_variant, False), closest("name", F.lit(""))
    form_same, form_other, form_plain = closest("form", own_variant), closest("form", own_variant, False), closest("form", F.lit(""))
    named = F.col("_named")
    formed = F.col("_only").isNotNull()
    reference = F.array_min(F.transform(F.filter("_e", lambda x: x["source"] == "id"), lambda x: x["distance"]))
    # a name without a variant is silent about it; one with another variant speaks against
    name_vote = (
        F.when(name_other < F.coalesce(F.least(name_same, name_plain), F.lit(9)), category("name", "other_variant"))
        .when(F.least(name_same, name_plain) > F.col("_closest"), category("name", "beaten"))  # another species' name is closer
        .when(name_same.isNotNull(), F.coalesce(graded("name", name_same), category("name", "far")))
        .when(name_plain == 0, category("name", "species"))
        .when(name_plain.isNotNull(), category("name", "species_near"))
    )
    form_vote = (
        F.when(F.col("_only") == own_variant, category("form", "equal"))
        .when((form_same == 0) & (own_variant != ""), category("form", "equal"))
        .when(form_same.isNotNull() & (own_variant != ""), category("form", "near"))
        .when(form_other.isNotNull() & (form_plain.isNull() | (form_other < form_plain)), category("form", "other_variant"))
        .when(form_plain.isNotNull(), category("form", "species"))
        .when(F.col("_whole_is_variant"), category("form", "other_variant"))
        .otherwise(category("form", "other"))
    )
    reference_vote = graded("reference", reference)
    costume_vote = (
        F.when((F.col("in_name") == "") & (F.col("in_column") == ""), category("costume", "abstain"))
        .when(F.col("in_name").isin("") | F.col("in_column").isin("") | (F.col("in_name") == F.col("in_column")), category("costume", "agrees"))
        .otherwise(category("costume", "differs"))
    )
    pairs = [("min_cp", LOW_IV, RAID_CP), ("max_cp", HIGH_IV, RAID_CP), ("min_boosted_cp", LOW_IV, BOOSTED_CP), ("max_boosted_cp", HIGH_IV, BOOSTED_CP)]
    errors = F.array(
        *[F.abs(F.col(c).cast("double") / raid_cp(F.col("attack"), F.col("defence"), F.col("stamina"), iv, factor) - 1) for c, iv, factor in pairs]
    )
    error = F.array_min(F.array_compact(errors))
    cp_vote = (
        F.when(error.isNull(), category("cp", "abstain"))
        .when(error <= 0.005, category("cp", "equal"))
        .when(error <= 0.04, category("cp", "near"))
        .otherwise(category("cp", "far"))
    )
    flags = read.select(
        "boss_id",
        F.exists("readings", lambda x: x["source"] == "name").alias("_named"),
        F.exists("readings", lambda x: x["source"] == "id").alias("_referred"),
    )
    # the form field names a variant by itself if it is like no species
    found = found.join(flags, "boss_id").withColumn("_whole_is_variant", formed & ~F.col("_like"))
    voted = found.select(
        "boss_id",
        "slug",
        F.coalesce(name_vote, F.when(named, category("name", "other")), category("name", "abstain")).alias("v_name"),
        F.when(formed, form_vote).otherwise(category("form", "abstain")).alias("v_form"),
        F.coalesce(reference_vote, F.when(F.col("_referred"), category("reference", "other")), category("reference", "abstain")).alias("v_reference"),
        costume_vote.alias("v_costume"),
        cp_vote.alias("v_cp"),
    )
    voted = cut(voted)
    columns = [f"v_{k}" for k in VOTES]
    # as many rows as the categories allow
    patterns = voted.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).toPandas()
    votes = patterns[columns].to_numpy(int).reshape(-1, len(columns))
    model = fit_label_model(votes, patterns["n"].to_numpy(), [[w for _, w in v] for v in VOTES.values()])
    # log odds keep apart what confidences near one don't
    odds = model.log_odds(votes) if len(votes) else []
    rows = [(*map(int, v), float(p), float(o)) for v, p, o in zip(votes, model.posterior(votes) if len(votes) else [], odds)]
    judged = voted.sparkSession.createDataFrame(rows, ", ".join(f"{c} int" for c in columns) + ", confidence double, _odds double")
    scored = voted.join(F.broadcast(judged), columns)  # at most a row per combination of categories
    likely = scored.filter(F.col("confidence") >= least)
    best = F.min(F.struct((-F.col("_odds")).alias("_o"), "slug", "confidence")).alias("_c")
    chosen = likely.groupBy("boss_id").agg(best).select("boss_id", F.col("_c.slug").alias("form_slug"), "_c.confidence")
    return chosen
