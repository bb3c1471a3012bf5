"""Near-duplicate documents by MinHash with tensored banding.

Two small collections of sketches are computed per document, each sketch made of a few minima. Every pair of
one sketch from either collection is the key of one table, so ``m * m`` tables cost ``2 * m`` sketches. Documents that
share a key are candidates and are confirmed on their full shingle sets.

A bucket is never expanded into pairs. Each of its sets is tied to the first one, and what hangs together that way is a family. A family is
dealt to blocks of bounded size, and a few heads of the family are sent to each: a block compares all its sets and yields the links that
connect the similar ones. In a family of copies that settles nearly all, at a cost that grows with its size. What does not
hang together with the largest group yet sends new heads. What is left after that is cut into smaller families by its rarest shingles, of
which similar sets share one, and is compared with all of those, block by block, so that no link between documents of a bucket is lost for the result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tongueloom.llm.common import attach, components, smallest_member
from tongueloom.llm.wordhash import Words, grouped, keys, long_lists, mix, shingle_hashes, slices, spanning
from tongueloom.session import stage


@dataclass(frozen=True)
class MinHash:
    """``sketches`` per collection of ``width`` minima each; links have Jaccard >= ``percent`` / 100.

    ``block`` sets are compared with ``heads`` others of their family at a time, in ``rounds`` rounds.
    """

    words: int = 5
    percent: int = 75
    sketches: int = 12
    width: int = 2
    block: int = 64
    heads: int = 8
    rounds: int = 2
    seed: int = 7


def _lower(texts: list[bytes]) -> list[bytes]:
    return [t.lower() for t in texts]  # bytes.lower changes A-Z only


def sketch_batch(sets: list[np.ndarray], p: MinHash) -> np.ndarray:
    """One row of ``2 * sketches`` hashes per non-empty set."""
    flat = np.concatenate(sets)
    begin = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    salt = keys(4 * p.sketches * p.width, p.seed)
    out = np.empty((len(sets), 2 * p.sketches), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for s in range(2 * p.sketches):
            sketch = np.full(len(sets), np.uint64(s), dtype=np.uint64)
            for j in range(s * p.width, (s + 1) * p.width):
                low = np.minimum.reduceat((flat ^ salt[2 * j]) * (salt[2 * j + 1] | np.uint64(1)), begin)
                sketch = mix(sketch + low)
            out[:, s] = sketch
    return out


def signatures(docs: DataFrame, p: MinHash = MinHash()) -> DataFrame:
    """``(doc_id, text_hash, n_shingles, set_a, set_b, sketches)`` of every document; the set hashes name the exact set."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "text"):
            words = Words(_lower(texts))
            sets = shingle_hashes(words.hashes, words.bounds, p.words)
            size = np.array([len(s) for s in sets], dtype=np.int64)
            full = np.flatnonzero(size)
            sketches: list = [None] * len(sets)
            a, b = np.zeros(len(sets), dtype=np.uint64), np.zeros(len(sets), dtype=np.uint64)
            if len(full):
                some = [sets[i] for i in full]
                rows = sketch_batch(some, p).view(np.int64)
                with np.errstate(over="ignore"):
                    for k, i in enumerate(full):
                        sketches[i] = rows[k]
                        a[i], b[i] = sets[i].sum(dtype=np.uint64), mix(sets[i] + np.uint64(1)).sum(dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), batch.column("text_hash"), pa.array(size), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)),
                 pa.array(sketches, type=pa.list_(pa.int64()))],
                names=["doc_id", "text_hash", "n_shingles", "set_a", "set_b", "sketches"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, "doc_id long, text_hash long, n_shingles long, set_a long, set_b long, sketches array<long>")


def table_rows(classes: DataFrame, p: MinHash) -> DataFrame:
    """``(bucket, node)``: one row per table, its key made of one sketch of either collection."""
    m = p.sketches
    salt = keys(m * m, p.seed + 1)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            s = np.array(batch.column("sketches").flatten().to_numpy(zero_copy_only=False), dtype=np.int64).view(np.uint64).reshape(n, 2 * m)
            with np.errstate(over="ignore"):
                key = mix(mix(s[:, :m, None] + salt.reshape(1, m, m)) + s[:, None, m:]).reshape(-1)
            node = np.repeat(batch.column("node").to_numpy(zero_copy_only=False), m * m)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(node)], names=["bucket", "node"])

    return classes.select("node", "sketches").mapInArrow(run, "bucket long, node long")


def bucket_heads(rows: DataFrame) -> DataFrame:
    """``(a, b)``: each row of a bucket with the bucket's first row.

    Streams over sorted partitions and holds one Arrow batch, whatever the size of a bucket.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_bucket = last_head = None
        for batch in batches:
            if not batch.num_rows:
                continue
            bucket, doc = (batch.column(c).to_numpy() for c in ("bucket", "node"))
            new = np.concatenate(([last_bucket is None or bucket[0] != last_bucket], bucket[1:] != bucket[:-1]))
            at = np.maximum.accumulate(np.where(new, np.arange(len(doc)), -1))
            head = np.where(at >= 0, doc[np.maximum(at, 0)], -1 if last_head is None else last_head)
            last_bucket, last_head = bucket[-1], head[-1]
            own, head = doc[~new], head[~new]
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(head)], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long").distinct()


def overlaps(sets: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of all pairwise intersections, by products of 0/1 matrices over ``width`` shared elements at a time."""
    size = [len(s) for s in sets]
    owner = np.repeat(np.arange(len(sets)), size)
    _, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    column = np.cumsum(shared) - 1
    use = shared[at]
    owner, at = owner[use], column[at[use]]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    out = np.zeros((len(sets), len(sets)))
    for low in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(at, (low, low + width))
        part = np.zeros((len(sets), width), dtype=np.float32)
        part[owner[a:b], at[a:b] - low] = 1
        out += part @ part.T
    return out


def shingled(texts: DataFrame, p: MinHash) -> DataFrame:
    """``(node, family, nb, sh)`` for ``(node, family, nb, text)``: the full shingle sets."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw in slices(batches, "text"):
            words = Words(_lower(raw))
            sets = shingle_hashes(words.hashes, words.bounds, p.words)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("node", "family", "nb")), long_lists(sets)], names=["node", "family", "nb", "sh"])

    return texts.select("node", "family", "nb", "text").mapInArrow(run, "node long, family long, nb int, sh array<long>")


def linked(dealt: DataFrame, p: MinHash) -> DataFrame:
    """Links ``(a, b)`` that connect all similar sets of each group ``(family, x, y)`` of ``(node, sh)``: a spanning forest per group."""

    def links(rows: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
        t = pa.Table.from_batches(rows).combine_chunks()
        nodes, first = np.unique(t.column("node").to_numpy(), return_index=True)  # a head may stand in its own block, too
        lists = t.column("sh").combine_chunks()
        edges, values = lists.offsets.to_numpy(), lists.values.to_numpy().view(np.uint64)
        sets = [values[edges[k]: edges[k + 1]] for k in first]
        size = np.array([len(s) for s in sets], dtype=np.float64)
        both = overlaps(sets)
        link = 100 * both >= p.percent * (size[:, None] + size[None, :] - both)
        np.fill_diagonal(link, False)
        return spanning(nodes, link)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, ("family", "x", "y")):
            if sum(b.num_rows for b in group) > 1:
                a, b = links(group)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    columns = ["family", "x", "y", "node", "sh"]
    return dealt.select(*columns).repartition("family", "x", "y").sortWithinPartitions("family", "x", "y").mapInArrow(run, "a long, b long")


def _block(seed: int, n: str) -> Column:
    return F.pmod(F.xxhash64("node", F.lit(seed)), F.col(n)).cast("int")


def _upto(n: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.col(n) - 1))


def close(members: DataFrame, p: MinHash) -> DataFrame:
    """``(node, family, n_rest, n_top)``: families of ``(family, node, sh, rest)`` cut into those that may hold links of the ``rest``, by prefixes.

    With the shingles of a family ordered from the rarest on, two similar sets have one in common among the first ``n - ceil(n * percent / 100) + 1`` of
    either. Sets that share only frequent shingles, as a line that is on many pages, fall apart that way, and no similar pair does.
    """
    found = members.select("family", "node", F.explode("sh").alias("s"))
    often = found.groupBy("family", "s").agg(F.count("*").alias("n")).where("n > 1")
    size = F.size("sh")
    first = size - F.ceil(size * p.percent / 100).cast("int") + 1
    ordered = found.join(often, ["family", "s"]).groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "s"))).alias("shared"))
    # shingles of one set alone come first in the order
    left = F.greatest(first - (size - F.size("shared")), F.lit(0))
    prefixes = stage(members.join(ordered, "node").select("node", "rest", F.explode(F.slice("shared", F.lit(1), left)).alias("e"), "family").select(
        F.xxhash64("family", "e.s").alias("bucket"), "node", "rest"), "prefixes")
    met = prefixes.join(prefixes.where("rest").select("bucket").distinct(), "bucket", "left_semi").select("bucket", "node")
    cut = components(bucket_heads(met.repartition("bucket").sortWithinPartitions("bucket", "node"))).withColumnRenamed("root", "family")
    cut = stage(cut.join(members.select("node", "rest"), "node"), "close")
    n = stage(cut.groupBy("family").agg(F.count_if("rest").alias("n_rest"), F.count_if(~F.col("rest")).alias("n_top")).where("n_rest > 0"), "close-sizes")
    return stage(attach(cut, n, ["family"]).select("node", "family", "n_rest", "n_top"), "close-families")


def verified(docs: DataFrame, classes: DataFrame, families: DataFrame, p: MinHash) -> DataFrame:
    """Links ``(a, b)`` that connect all similar sets of each family ``(node, component)``, found on their full shingle sets."""
    size = families.groupBy("component").agg(F.ceil(F.count("*") / p.block).cast("int").alias("nb"))
    named = stage(families.join(stage(size, "family-sizes"), "component").join(classes.select("node", "doc_id", "text_hash"), "node").select(
        "doc_id", "text_hash", "node", F.col("component").alias("family"), "nb"), "families")
    texts = attach(docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text"), named, ["doc_id", "text_hash"])
    sets = stage(shingled(texts, p), "shingles")  # rows that repeat an id and its text come several times, and count once in a group
    open_, heads_of = sets, named.select("node", "family")
    links: DataFrame | None = None
    for r in range(p.rounds):
        chosen = heads_of.groupBy("family", F.pmod(F.xxhash64("node"), F.lit(p.heads)).alias("h")).agg(F.min(F.struct(F.xxhash64("node", F.lit(r)), "node")).alias("m"))
        heads = attach(open_, stage(chosen.select(F.col("m.node").alias("node")), "heads"), ["node"], "left_semi").select("family", _upto("nb").alias("x"), "node", "sh")
        dealt = open_.select("family", _block(r, "nb").alias("x"), "node", "sh").unionByName(heads).withColumn("y", F.lit(0))
        found = stage(linked(dealt, p), "links")
        links = found if links is None else links.unionByName(found)
        # only families of several blocks can have links that no block has seen
        large = named.where("nb > 1").select("node", "family")
        if large.isEmpty():
            return links
        root = components(links)
        group = stage(large.join(root, "node", "left").select("node", "family", F.coalesce("root", "node").alias("root")), "groups")
        sizes = stage(group.groupBy("family", "root").agg(F.count("*").alias("n")), "group-sizes")
        top = stage(sizes.groupBy("family").agg(F.max(F.struct("n", "root")).alias("m"), F.count("*").alias("k")).where("k > 1").select(
            "family", F.col("m.root").alias("top")), "top-groups")
        if top.isEmpty():
            return links
        place = stage(attach(group, top, ["family"]).select("node", (F.col("root") != F.col("top")).alias("rest")), "places")
        heads_of = group.select("node", "family").join(place.where("rest").select("node"), "node", "left_semi")
        open_ = attach(sets, top.select("family"), ["family"], "left_semi")
    members = stage(attach(open_, place, ["node"]).dropDuplicates(["node"]).select("family", "node", "sh", "rest"), "members")
    blocks = lambda n: F.ceil(F.col(n) / p.block).cast("int")
    parts = attach(members.drop("family"), close(members, p), ["node"]).select("family", "node", "sh", "rest", blocks("n_rest").alias("nr"), blocks("n_top").alias("nt"))
    rest = parts.where("rest").withColumn("own", _block(p.rounds, "nr"))
    among = rest.withColumn("other", _upto("nr")).select("family", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "node", "sh")
    # groups with the largest one's blocks are numbered below zero
    against = rest.where("nt > 0").withColumn("other", _upto("nt")).select("family", F.col("own").alias("x"), (-1 - F.col("other")).alias("y"), "node", "sh")
    tops = parts.where("not rest").withColumn("y", -1 - _block(p.rounds, "nt")).select("family", _upto("nr").alias("x"), "y", "node", "sh")
    return links.unionByName(linked(among.unionByName(against).unionByName(tops), p))


def near_duplicates(docs: DataFrame, p: MinHash = MinHash()) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept, text_hash)`` for every row of ``docs(doc_id, text)``; other columns are ignored.

    Words are runs of bytes outside ``\\x20\\x09-\\x0D``, A-Z lower-cased. A text with fewer words than a shingle is one
    shingle; a null, empty or blank text has none and is linked with nothing. ``component_id`` is the
    smallest ``doc_id`` reachable by links, ``kept`` marks that document. Rows that repeat a ``doc_id`` are each returned, with the links of
    their own text; ``text_hash`` (xxhash64 of the text) tells them apart. A null ``doc_id`` is returned with a null component and links nothing. An empty table gives an empty result.
    """
    sig = stage(signatures(docs, p), "signatures")
    least = F.min(F.struct("doc_id", "text_hash")).alias("least")
    classes = stage(
        sig.where("n_shingles > 0 and doc_id is not null").groupBy("set_a", "set_b", "n_shingles")
        .agg(least, F.first("sketches").alias("sketches"))
        .select("set_a", "set_b", F.col("n_shingles").alias("n"), "least.doc_id", "least.text_hash", "sketches",
                F.monotonically_increasing_id().alias("node")), "classes")  # written once: the numbers stay
    rows = table_rows(classes, p).repartition("bucket").sortWithinPartitions("bucket", "node")
    families = stage(smallest_member(components(bucket_heads(rows))), "families")
    named = components(verified(docs, classes, families, p))
    of_node = stage(classes.join(named, "node", "left").select(
        "set_a", "set_b", F.col("n").alias("n_shingles"), "doc_id", F.coalesce("root", "node").alias("root")), "class-roots")
    first = stage(of_node.groupBy("root").agg(F.min("doc_id").alias("component_id")), "first-documents")
    of_class = stage(of_node.join(first, "root").select("set_a", "set_b", "n_shingles", "component_id"), "class-components")
    out = sig.drop("sketches").join(of_class, ["set_a", "set_b", "n_shingles"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"), "text_hash")
