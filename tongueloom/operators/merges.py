"""Byte-pair training on an incremental pair index: exact merges, many to a pass, only the words that hold a merged pair are touched.

The index lists for every pair of adjacent symbols the word types that hold it, with their segmentation; a second table holds each pair's
count. A pass plans a run of merges from the exact leading counts and a bounded sample of frequent words. The words that hold a pair of
the run are fetched from the index, the run is replayed on each, and every step's changes of pair counts are summed. From these follows
the exact course of all counts, so that the longest part of the run is kept in which every merge was the leading pair when its
turn came. The plan decides how many merges a pass yields, never which. Changed words are added to the index under all their pairs,
with a mark under the pairs that they lost; counts change by the signed sums.

Merges above a count need no whole words: wherever a pair of symbols stands, the two letters at its border stand side by side, so it is no more
frequent than these. Words are cut between letters that are rarer together than the floor of a level; what is left are few distinct parts,
with exact counts of all pairs at or above the floor. Below it the words are cut anew, at a lower one.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Container, Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from tongueloom.config import WORD_MARK
from tongueloom.session import fresh_path, shuffle_width, stage

Pair = tuple[str, str]


@dataclass(frozen=True)
class MergePlan:
    """``candidates`` leading pairs and a sample of some ``sample`` words at most reach the driver; a pass plans ``ahead`` merges at most.

    ``bucket``: entries in a folder of the index; ``logs``: passes after which the index is written anew. ``level``: merges that a floor is meant
    to reach; ``links``: pairs of letters that a level may keep at most, with more it takes whole words. None changes the merges.
    """

    candidates: int = 1024
    sample: int = 20_000
    ahead: int = 128
    bucket: int = 500_000
    logs: int = 12
    level: int = 512
    links: int = 100_000


# ---- one word ----------------------------------------------------------------

def merged(syms: Sequence[str], pair: Pair) -> list[str]:
    """Every occurrence of the pair joined, left to right without overlap."""
    out, i, last = [], 0, len(syms) - 1
    while i <= last:
        if i < last and syms[i] == pair[0] and syms[i + 1] == pair[1]:
            out.append(pair[0] + pair[1])
            i += 2
        else:
            out.append(syms[i])
            i += 1
    return out


def pairs_of(syms: Sequence[str], allowed: frozenset[str] | None) -> Counter:
    """Adjacent pairs and how often they stand; a letter outside the alphabet stays alone."""
    if allowed is None:
        return Counter(zip(syms, syms[1:]))
    fine = lambda s: len(s) > 1 or s in allowed
    return Counter(p for p in zip(syms, syms[1:]) if fine(p[0]) and fine(p[1]))


def places(run: Sequence[Pair]) -> dict[Pair, list[int]]:
    """Pair -> its steps, ascending; a pair may come up again after another merge has made one of its symbols anew."""
    out: dict[Pair, list[int]] = {}
    for i, pair in enumerate(run):
        out.setdefault(pair, []).append(i)
    return out


def next_step(steps: dict[Pair, list[int]], pair: Pair, after: int) -> int | None:
    own = steps.get(pair)
    at = bisect_right(own, after) if own else 0
    return own[at] if own and at < len(own) else None


def replay(syms: list[str], steps: dict[Pair, list[int]], allowed: frozenset[str] | None) -> tuple[list[str], list[tuple[int, str, str, int]]]:
    """The word after the run, and ``(step, left, right, change)`` of its pair counts."""
    changes, now, have = [], -1, pairs_of(syms, allowed)
    while True:
        due = [(s, p) for p in have if p in steps and (s := next_step(steps, p, now)) is not None]
        if not due:
            return syms, changes
        now, pair = min(due)
        syms = merged(syms, pair)
        after = pairs_of(syms, allowed)
        changes += [(now, *p, after[p] - have[p]) for p in {**have, **after} if after[p] != have[p]]
        have = after


def apply_run(syms: list[str], steps: dict[Pair, list[int]]) -> list[str]:
    """The word after the run."""
    now = -1
    while True:
        due = [(s, p) for p in zip(syms, syms[1:]) if p in steps and (s := next_step(steps, p, now)) is not None]
        if not due:
            return syms
        now, pair = min(due)
        syms = merged(syms, pair)


# ---- planning ----------------------------------------------------------------

class Sample:
    """Some words at the driver, weighted to stand for all, to guess how merges change counts."""

    def __init__(self, rows: Iterable[tuple[Sequence[str], float]], allowed: frozenset[str] | None):
        self.allowed = allowed
        self.words: list[list[str]] = []
        self.weights: list[float] = []
        self.holders: dict[Pair, set[int]] = {}
        self.counts: Counter = Counter()
        for syms, n in rows:
            self.words.append([])
            self.weights.append(n)
            self._put(len(self.words) - 1, list(syms))

    def _put(self, i: int, syms: list[str]) -> None:
        n = self.weights[i]
        for p, m in pairs_of(self.words[i], self.allowed).items():
            self.counts[p] -= m * n
            self.holders[p].discard(i)
        for p, m in pairs_of(syms, self.allowed).items():
            self.counts[p] += m * n
            self.holders.setdefault(p, set()).add(i)
        self.words[i] = syms

    def merge(self, pair: Pair) -> dict[int, list[str]]:
        """Apply a merge; returns the words as they were."""
        old = {i: self.words[i] for i in self.holders.get(pair, ())}
        for i, syms in old.items():
            self._put(i, merged(syms, pair))
        return old

    def reach(self, n: int) -> float:
        """Merges the leading pair ``n`` times; the count of the last one, 0 if there are fewer."""
        last = 0.0
        for _ in range(n):
            pair = min(self.counts, key=lambda p: (-self.counts[p], p), default=None)
            if pair is None or self.counts[pair] < 1:
                return 0.0
            last = self.counts[pair]
            self.merge(pair)
        return last

    def plan(self, top: Sequence[tuple[str, str, int]], whole: bool, ahead: int) -> list[Pair]:
        """A likely run of merges that starts with the leading pair. ``whole``: ``top`` lists all pairs there are."""
        guess = {(a, b): n for a, b, n in top}
        floor = 0 if whole else top[-1][2]
        run: list[Pair] = []
        first: dict[int, list[str]] = {}
        while guess and len(run) < ahead:
            pair = min(guess, key=lambda p: (-guess[p], p))
            if guess[pair] <= 0 or (run and guess[pair] <= floor):
                break
            run.append(pair)
            n, seen = guess.pop(pair), self.counts[pair]
            if seen <= 0:
                break  # nothing known about what this one changes
            share = n / seen
            before = {p: self.counts[p] for i in self.holders[pair] for p in pairs_of(self.words[i], self.allowed)}
            for i, syms in self.merge(pair).items():
                first.setdefault(i, syms)
                before.update((q, 0) for q in pairs_of(self.words[i], self.allowed) if q not in before)
            for p, was in before.items():
                change = self.counts[p] - was
                if p in guess:
                    guess[p] += int(change * share)
                elif change > 0 and p != pair:
                    guess[p] = int(change * share)
        for i, syms in first.items():
            self._put(i, syms)
        return run


# ---- the index ---------------------------------------------------------------

ENTRY = "left string, right string, word string, version int, n long, sym string"


def _usable(allowed: frozenset[str] | None) -> Column:
    """Neither symbol is a letter outside the alphabet; longer symbols are made of its letters."""
    return F.lit(True) if allowed is None else F.translate(F.concat("left", "right"), "".join(sorted(allowed)), "") == ""


def held_pairs(syms: Column) -> Column:
    """The distinct adjacent pairs of an array of symbols."""
    m = F.greatest(F.size(syms) - 1, F.lit(0))
    return F.array_distinct(F.arrays_zip(F.slice(syms, F.lit(1), m).alias("left"), F.slice(syms, F.lit(2), m).alias("right")))


def among(run: Sequence[Pair]) -> Column:
    """The row's pair is one of the run's; symbols hold no blanks."""
    return F.concat("left", F.lit(" "), "right").isin([f"{a} {b}" for a, b in dict.fromkeys(run)])


def _split(sym: str) -> list[str]:
    return sym.strip(" ").split("  ")


def _joined(syms: Sequence[str]) -> str:
    return " " + "  ".join(syms) + " "


class PairIndex:
    """Entries ``(left, right, word, version, n, sym)``: the word held the pair from that version on, with that segmentation; a null one: no more.

    The base is stored in folders by a hash of the pair, of which only those asked for are read; later versions are logged beside it.
    """

    def __init__(self, spark: SparkSession, words: DataFrame, allowed: frozenset[str] | None, p: MergePlan):
        """``words``: (word, n, sym) with every letter a symbol."""
        self.spark, self.allowed, self.p, self.version = spark, allowed, p, 0
        held = words.select(F.explode(held_pairs(F.split(F.btrim("sym"), "  "))).alias("q"), "word", "n", "sym")
        entries = held.select("q.left", "q.right", "word", F.lit(0).alias("version"), "n", "sym").where(_usable(allowed))
        self._store(stage(entries, "pair-entries"))

    def _store(self, entries: DataFrame) -> None:
        self.buckets = max(1, entries.count() // self.p.bucket)
        path = fresh_path(self.spark, "pair-index")
        entries.withColumn("bucket", self._bucket()).repartition("bucket").write.partitionBy("bucket").parquet(path)
        self.base = self.spark.read.schema(ENTRY + ", bucket int").parquet(path)
        self.logs: list[DataFrame] = []

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("left", "right"), F.lit(self.buckets)).cast("int")

    def _all(self, base: DataFrame) -> DataFrame:
        for log in self.logs:
            base = base.unionByName(log)
        return base

    def holders(self, run: Sequence[Pair]) -> DataFrame:
        """(word, n, sym) of the words that hold a pair of the run."""
        own = [F.pmod(F.xxhash64(F.lit(a), F.lit(b)), F.lit(self.buckets)).cast("int") for a, b in dict.fromkeys(run)]
        where = sorted(set(self.spark.range(1).select(F.array(*own)).first()[0]))
        entries = self._all(self.base.where(F.col("bucket").isin(where)).drop("bucket")).where(among(run))
        last = F.max(F.struct("version", F.col("sym").isNotNull().alias("held"), "n", "sym")).alias("e")
        # dealt by number: what a word costs is not its bytes, so the groups are not packed by size
        dealt = entries.repartition(max(self.spark.sparkContext.defaultParallelism, shuffle_width(self.spark)), "word")
        return dealt.groupBy("word").agg(last).where("e.held").select("word", "e.n", "e.sym")

    def changes(self, words: DataFrame, run: Sequence[Pair]) -> DataFrame:
        """(step, left, right, change): by how much each step of the run changes pair counts, over all its words."""
        allowed, steps = self.allowed, places(run)

        def go(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                total: Counter = Counter()
                for n, sym in zip(batch.column("n").to_pylist(), batch.column("sym").to_pylist()):
                    for *key, change in replay(_split(sym), steps, allowed)[1]:
                        total[tuple(key)] += n * change
                if total:
                    own = [*zip(*total), list(total.values())]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, type=k) for c, k in zip(own, (pa.int32(), pa.string(), pa.string(), pa.int64()))], names=["step", "left", "right", "change"])

        each = words.select("n", "sym").mapInArrow(go, "step int, left string, right string, change long")
        return each.groupBy("step", "left", "right").agg(F.sum("change").alias("change")).where("change <> 0")

    def log(self, words: DataFrame, run: Sequence[Pair]) -> None:
        """Enter what the run makes of its words: their pairs, and marks under the pairs that they have lost."""
        self.version += 1
        steps = places(run)

        def go(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                new = [_joined(apply_run(_split(s), steps)) for s in batch.column("sym").to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(new, type=pa.string())], names=["word", "n", "sym", "new"])

        changed = words.select("word", "n", "sym").mapInArrow(go, "word string, n long, sym string, new string").where("sym <> new")
        held, had = held_pairs(F.split(F.btrim("new"), "  ")), held_pairs(F.split(F.btrim("sym"), "  "))
        marks = F.concat(F.transform(held, lambda q: F.struct(q.alias("q"), F.col("new").alias("sym"))),
                         F.transform(F.array_except(had, held), lambda q: F.struct(q.alias("q"), F.lit(None).cast("string").alias("sym"))))
        entries = changed.select(F.explode(marks).alias("e"), "word", "n").select(
            "e.q.left", "e.q.right", "word", F.lit(self.version).alias("version"), "n", "e.sym").where(_usable(self.allowed))
        self.logs.append(stage(entries.hint("rebalance"), "pair-log"))  # few files, as every pass reads them
        if len(self.logs) >= self.p.logs:
            last = F.max(F.struct("version", F.col("sym").isNotNull().alias("held"), "n", "sym")).alias("e")
            newest = self._all(self.base.drop("bucket")).groupBy("left", "right", "word").agg(last).where("e.held")
            self._store(stage(newest.select("left", "right", "word", "e.version", "e.n", "e.sym"), "pair-entries"))


# ---- training ----------------------------------------------------------------

def first_wrong(totals: DataFrame, changes: DataFrame, run: Sequence[Pair], counts: Sequence[int]) -> int:
    """The first step of the run at which another pair had a larger count than the planned one (ties: the smaller pair); its length if none.

    ``totals``: (left, right, n) before the run, ``changes``: (step, left, right, change), ``counts``: the planned pairs' counts in their turn.
    """
    course = totals.select("left", "right", F.lit(-1).alias("step"), F.col("n").alias("change")).unionByName(
        changes.select("left", "right", "step", "change"))
    in_order = W.partitionBy("left", "right").orderBy("step")
    spans = course.select(
        "left", "right", F.sum("change").over(in_order).alias("n"), (F.col("step") + 1).alias("since"),
        F.coalesce(F.lead("step").over(in_order), F.lit(len(run) - 1)).alias("upto"))
    spans = spans.where((F.col("n") >= min(counts)) & (F.col("since") <= F.col("upto")))
    planned = F.array(*[F.struct(F.lit(n).cast("long").alias("n"), F.lit(a).alias("a"), F.lit(b).alias("b")) for n, (a, b) in zip(counts, run)])

    def beaten(s: Column) -> Column:
        p = F.get(planned, s)
        smaller = (F.col("left") < p["a"]) | ((F.col("left") == p["a"]) & (F.col("right") < p["b"]))
        return (F.col("n") > p["n"]) | ((F.col("n") == p["n"]) & smaller)

    steps = F.filter(F.sequence("since", "upto"), beaten)
    wrong = spans.select(F.min(F.get(steps, F.lit(0)))).first()[0]
    return len(run) if wrong is None else wrong


def drawn(words: DataFrame, size: int, letters: str = "word") -> list[tuple[str, float]]:
    """Some ``size`` of ``words(letters, n)`` at most, drawn by a hash in proportion to ``n``, weighted by one over the chance."""
    total = words.agg(F.sum("n")).first()[0] or 0
    if not total:
        return []
    chance = F.least(F.lit(1.0), F.col("n") * F.lit(size / total))
    uniform = F.pmod(F.xxhash64(letters), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rows = words.select(F.col(letters).alias("letters"), (F.col("n") / chance).alias("weight"), (uniform < chance).alias("in")).where("in")
    return [(r.letters, r.weight) for r in rows.orderBy("letters").collect()]


def _summed(words: DataFrame, parts_of: Callable[[str], Iterable[str]], most: int = 200_000) -> DataFrame:
    """(part, n): how often each part stands in ``words(word, n)``; summed in a task for up to ``most`` parts at a time before they are shuffled."""

    def go(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        rows = lambda: pa.RecordBatch.from_arrays([pa.array(list(total), type=pa.string()), pa.array(list(total.values()), type=pa.int64())], names=["part", "n"])
        for batch in batches:
            for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist()):
                if word is not None and n is not None:
                    for part in parts_of(WORD_MARK + word):
                        total[part] += n
            if len(total) > most:
                yield rows()
                total.clear()
        yield rows()

    return words.select("word", F.col("n").cast("long").alias("n")).mapInArrow(go, "part string, n long").groupBy("part").agg(F.sum("n").alias("n"))


def letter_pairs(words: DataFrame) -> DataFrame:
    """(part, n): the pairs of letters of ``words(word, n)``, the word mark included, as strings of two."""
    return _summed(words, lambda s: [s[i:i + 2] for i in range(len(s) - 1)])


def cut(text: str, links: Container[str]) -> Iterator[str]:
    """The text cut between any two letters that are not among ``links``; single letters are left out."""
    start, last = 0, len(text)
    for i in range(1, last + 1):
        if i == last or text[i - 1:i + 1] not in links:
            if i - start > 1:
                yield text[start:i]
            start = i


def word_parts(words: DataFrame, links: Container[str] | None, merges: Sequence[Pair]) -> DataFrame:
    """(word, n, sym): what is left of ``words(word, n)``, cut between letters that are not ``links`` (None: whole), after ``merges``."""
    steps = places(merges)
    parts = _summed(words, (lambda s: (s,)) if links is None else lambda s: cut(s, links))

    def go(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sym = [_joined(apply_run(list(x), steps)) for x in batch.column("part").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sym, type=pa.string())], names=["word", "n", "sym"])

    return parts.select("part", "n").mapInArrow(go, "word string, n long, sym string")


def train(words: DataFrame, n_merges: int, allowed: set[str] | None = None, p: MergePlan = MergePlan()) -> list[Pair]:
    """Byte-pair merges of ``words(word, n)``, most frequent first (ties: left, then right piece ascending).

    ``allowed`` limits merges to an alphabet. Fewer merges come back if no pairs are left. ``words`` is read several times.
    """
    letters = None if allowed is None else frozenset(allowed)
    fine = F.lit(True) if letters is None else F.translate("part", "".join(sorted(letters)), "") == ""
    pairs = stage(letter_pairs(words).where(fine), "letter-pairs")
    some = [([WORD_MARK, *w], n) for w, n in drawn(words, p.sample)]
    n_words = words.count()
    merges: list[Pair] = []
    floor = None
    while len(merges) < n_merges and floor != 1:
        guess = Sample(some, letters)
        for pair in merges:
            guess.merge(pair)
        low = int(0.75 * guess.reach(min(p.level, n_merges - len(merges))))
        floor = max(1, low if floor is None else min(low, floor // 2))
        links = None
        if floor > 1:
            found = [r.part for r in pairs.where(F.col("n") >= floor).select("part").limit(p.links + 1).collect()]
            links = frozenset(found) if len(found) <= p.links else None
        parts = stage(word_parts(words, links, merges), "word-parts")
        if links is None or parts.count() > n_words // 2:  # hardly fewer than words: these serve for all that is left
            floor, parts = 1, parts if links is None else stage(word_parts(words, None, merges), "word-parts")
        merges += _train(parts, n_merges - len(merges), letters, p, floor)
    return merges


def _train(words: DataFrame, n_merges: int, letters: frozenset[str] | None, p: MergePlan, floor: int) -> list[Pair]:
    """The merges of ``words(word, n, sym)`` that come next, as long as the leading pair has a count of ``floor`` or more."""
    index = PairIndex(words.sparkSession, words, letters, p)
    occurrences = F.explode(F.arrays_zip(F.slice("s", F.lit(1), F.size("s") - 1).alias("left"), F.slice("s", F.lit(2), F.size("s") - 1).alias("right")))
    adjacent = words.select(F.split(F.btrim("sym"), "  ").alias("s"), "n").where(F.size("s") > 1).select(occurrences.alias("q"), "n")
    totals = stage(adjacent.select("q.left", "q.right", "n").where(_usable(letters)).groupBy("left", "right").agg(F.sum("n").alias("n")), "pair-totals")
    sample = Sample([(_split(x), n) for x, n in drawn(words, p.sample, "sym")], letters)
    merges: list[Pair] = []
    ahead = min(p.ahead, 48)
    while len(merges) < n_merges:
        top = [tuple(r) for r in totals.orderBy(F.desc("n"), "left", "right").limit(p.candidates).select("left", "right", "n").collect()]
        if not top or top[0][2] < floor:
            break
        run = sample.plan(top, len(top) < p.candidates, min(ahead, n_merges - len(merges)))
        touched = stage(index.holders(run), "touched-words")
        changes = stage(index.changes(touched, run), "pair-changes")
        # the planned pairs' own counts: at most as many rows as the square of the run
        course = totals.select(F.lit(-1).alias("step"), "left", "right", F.col("n").alias("change")).unionByName(changes)
        own: dict[Pair, list[tuple[int, int]]] = {}
        for r in course.where(among(run)).collect():
            own.setdefault((r.left, r.right), []).append((r.step, r.change))
        counts = [sum(c for t, c in own.get(pair, ()) if t < s) for s, pair in enumerate(run)]
        alive = next((s for s, n in enumerate(counts) if n < floor), len(run))
        right = first_wrong(totals, changes.where(F.col("step") < alive), run[:alive], counts[:alive])
        kept = run[:right]
        merges += kept
        index.log(touched, kept)
        moved = totals.unionByName(changes.where(F.col("step") < right).select("left", "right", F.col("change").alias("n")))
        totals = stage(moved.groupBy("left", "right").agg(F.sum("n").alias("n")).where("n > 0"), "pair-totals")
        for pair in kept:
            sample.merge(pair)
        ahead = min(p.ahead, max(16, 2 * right))
    return merges
