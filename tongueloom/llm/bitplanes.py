"""Token ids in files of bit planes.

A shard holds consecutive documents. Its ids are cut into chunks of a fixed number of ids; a chunk is transposed into bit
(or byte) planes, each compressed with zstandard. The chunk index and the table of documents stand at the end of
the file, so that a chunk can be read alone.

Layout: magic, compressed planes, compressed document ids and lengths, JSON index, length of the index (8 bytes), magic.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from tongueloom.llm.common import prepare
from tongueloom.llm.wordhash import Remembered, Words, slices
from tongueloom.session import fresh_path, stage

MAGIC = b"IDPLANE1"


@dataclass(frozen=True)
class PlaneFile:
    """``chunk`` ids per block; ``bits`` per plane: 1 or 8; ``level`` of zstandard; ``cache`` words kept encoded per worker."""

    chunk: int = 65536
    bits: int = 1
    level: int = 3
    cache: int = 2_000_000


def to_planes(ids: np.ndarray, bits: int) -> list[bytes]:
    """The planes of an id block, lowest first; as many as the largest id needs."""
    if bits not in (1, 8):
        raise ValueError("a plane holds 1 or 8 bits")
    columns = np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    need = int(ids.max()).bit_length() if len(ids) else 0
    if bits == 8:
        return [columns[k].tobytes() for k in range(-(-need // 8))]
    planes = [np.packbits(np.unpackbits(columns[k][:, None], axis=1, bitorder="little").T, axis=1) for k in range(-(-need // 8))]
    return [plane.tobytes() for group in planes for plane in group][:need]


def from_planes(planes: list[bytes], n: int, bits: int) -> np.ndarray:
    out = np.zeros(n, dtype=np.uint32)
    for k, plane in enumerate(planes):
        raw = np.frombuffer(plane, dtype=np.uint8)
        part = raw if bits == 8 else np.unpackbits(raw, count=n)
        out |= part.astype(np.uint32) << np.uint32(k * bits)
    return out


class ShardWriter:
    def __init__(self, out, p: PlaneFile):
        self.out, self.p = out, p
        self.zip = zstandard.ZstdCompressor(level=p.level)
        self.waiting: list[np.ndarray] = []
        self.n_waiting = self.n_ids = 0
        self.place = len(MAGIC)
        self.chunks: list[dict] = []
        self.docs: list[int | None] = []
        self.lengths: list[int] = []
        out.write(MAGIC)

    def _put(self, raw: bytes) -> int:
        packed = self.zip.compress(raw)
        self.out.write(packed)
        self.place += len(packed)
        return len(packed)

    def _flush(self, all_of_it: bool) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.empty(0, dtype=np.uint32)
        at = 0
        while len(ids) - at >= self.p.chunk or (all_of_it and at < len(ids)):
            block = ids[at: at + self.p.chunk]
            place = self.place
            self.chunks.append({"at": place, "n": len(block), "planes": [self._put(x) for x in to_planes(block, self.p.bits)]})
            at += len(block)
        self.waiting = [ids[at:]]
        self.n_waiting = len(ids) - at

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.lengths.append(len(ids))
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        self.n_ids += len(ids)
        if self.n_waiting >= self.p.chunk:
            self._flush(False)

    def close(self) -> None:
        self._flush(True)
        table = {"at": self.place, "sizes": [
            self._put(np.array([d or 0 for d in self.docs], dtype="<i8").tobytes()),
            self._put(np.array([d is None for d in self.docs], dtype=np.uint8).tobytes()),
            self._put(np.array(self.lengths, dtype="<i8").tobytes())]}
        index = json.dumps({"bits": self.p.bits, "n_ids": self.n_ids, "chunks": self.chunks, "docs": table}).encode()
        self.out.write(index + len(index).to_bytes(8, "little") + MAGIC)


class ShardReader:
    def __init__(self, file):
        self.file, self.unzip = file, zstandard.ZstdDecompressor()
        size = file.size()
        tail = self._at(size - 16, 16)
        if tail[8:] != MAGIC:
            raise ValueError("not a file of id planes, or a cut one")
        n = int.from_bytes(tail[:8], "little")
        self.index = json.loads(self._at(size - 16 - n, n))

    def _at(self, place: int, n: int) -> bytes:
        self.file.seek(place)
        return self.file.read(n)

    def _parts(self, place: int, sizes: list[int]) -> list[bytes]:
        raw, out, at = self._at(place, sum(sizes)), [], 0
        for n in sizes:
            out.append(self.unzip.decompress(raw[at: at + n]))
            at += n
        return out

    def chunk(self, k: int) -> np.ndarray:
        c = self.index["chunks"][k]
        return from_planes(self._parts(c["at"], c["planes"]), c["n"], self.index["bits"])

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """``(doc_id, first position in the shard, ids)``; holds one chunk and one document."""
        ids, nulls, lengths = self._parts(self.index["docs"]["at"], self.index["docs"]["sizes"])
        have, k, start = np.empty(0, dtype=np.uint32), 0, 0
        at = 0
        for doc, null, n in zip(np.frombuffer(ids, "<i8").tolist(), nulls, np.frombuffer(lengths, "<i8").tolist()):
            while len(have) - at < n:
                have, at, k = np.concatenate((have[at:], self.chunk(k))), 0, k + 1
            yield None if null else doc, start, have[at: at + n]
            at, start = at + n, start + n


def byte_letters() -> dict[int, str]:
    """The letters that byte-level tokenizers write bytes as: printable Latin-1 as it is, the other bytes from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {**{b: chr(b) for b in shown}, **{b: chr(256 + k) for k, b in enumerate(hidden)}}


# runs that the pre-tokenizer splits plain words into: letters stable under NFC, single digits, other marks but the apostrophe
_RUNS = re.compile("[a-zÀ-ÖØ-öø-ÿ]+|[0-9]|[!-&(-/:-@\\[-`{-~]+")
_PLAIN = re.compile("(?:[a-zA-ZÀ-ÖØ-öø-ÿ]+|[0-9]|[!-&(-/:-@\\[-`{-~]+)+")


class WordEncoder:
    """Encodes whole texts with a ``tokenizers`` file, each distinct white-space-separated word once while it is remembered.

    Holds for the kind of tokenizer it checks for: NFC and lower case, white space dropped, runs of letters, single digits and runs of
    marks split, byte-level merges. A word of plain characters goes to the library's merges run by run, any other word
    through the library's whole encoding.
    """

    def __init__(self, path: str, cache: int):
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), cache
        self.merges, self.letters = self.tokenizer.model, byte_letters()
        self.direct = self._splits_as_expected()
        self.forget()

    def forget(self) -> None:
        self.known = Remembered(np.uint32)
        self.runs: dict[str, list[int]] = {}

    def _splits_as_expected(self) -> bool:
        t, probe = self.tokenizer, "abÉñß,-9x07.(é)"
        if t.normalizer is None or t.pre_tokenizer is None or t.normalizer.normalize_str(probe) != probe.lower():
            return False
        return [x for x, _ in t.pre_tokenizer.pre_tokenize_str(probe.lower())] == [self._bytes(x) for x in _RUNS.findall(probe.lower())]

    def _bytes(self, run: str) -> str:
        return run if run.isascii() else "".join(map(self.letters.__getitem__, run.encode()))

    def _run(self, run: str) -> list[int]:
        ids = self.runs.get(run)
        if ids is None:
            ids = self.runs[run] = [t.id for t in self.merges.tokenize(self._bytes(run))]
        return ids

    def word(self, raw: bytes) -> list[int]:
        if self.direct:
            if raw.isalpha():  # A-Z and a-z only
                return self._run(raw.lower().decode())
            if raw[:-1].isalpha() and raw[-1] in b".,":
                return self._run(raw[:-1].lower().decode()) + self._run(chr(raw[-1]))
        text = raw.decode()
        if not self.direct or "<|" in text or not _PLAIN.fullmatch(text):
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        return [i for run in _RUNS.findall(text.lower()) for i in self._run(run)]

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        words = Words(texts)
        distinct, first, inverse = np.unique(words.hashes, return_index=True, return_inverse=True)
        if len(self.known) > self.limit:
            self.known.keep(distinct)
        if len(self.runs) > 200_000:
            self.runs = {}
        rows = self.known.find(distinct)
        new = np.flatnonzero(rows < 0)
        if len(new):
            spans = zip(words.starts[first[new]].tolist(), words.ends[first[new]].tolist())
            got = [self.word(words.raw[a:b]) for a, b in spans]
            rows[new] = self.known.add(
                distinct[new], np.fromiter(chain.from_iterable(got), dtype=np.uint32), np.fromiter(map(len, got), dtype=np.int64))
        ids, ends = self.known.take(rows[inverse])
        cut = ends[words.bounds]
        return [ids[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]


_encoders: dict[tuple[str, int], WordEncoder] = {}


def encoder(path: str, cache: int) -> WordEncoder:
    if (path, cache) not in _encoders:
        _encoders[path, cache] = WordEncoder(path, cache)
    return _encoders[path, cache]


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int, p: PlaneFile = PlaneFile()) -> DataFrame:
    """Write the ids of ``docs(doc_id, text)`` in ascending ``doc_id`` order; ``(shard, path, n_docs, n_ids, offset)`` of each file.

    A null text counts as empty; every document ends with ``end_id``. Null ids come first; rows that repeat an id are all written, ordered
    by text. A file is written under a temporary name and moved, so a retried task replaces it whole. An empty table writes no
    file. Other columns are ignored.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        store, root = fs.FileSystem.from_uri(folder)
        path = f"{root}/shard-{task.partitionId():06d}.planes"
        own = f"{path}.{task.taskAttemptId()}"
        words, writer, out = encoder(tokenizer, p.cache), None, None
        for batch, texts in slices(batches, "text"):
            if writer is None:
                store.create_dir(root)
                out = store.open_output_stream(own)
                writer = ShardWriter(out, p)
            for doc, ids in zip(batch.column("doc_id").to_pylist(), words.encode(texts)):
                writer.add(doc, np.append(ids, np.uint32(end_id)))
        words.forget()  # a worker lives on and goes to other operators
        if writer is not None:
            writer.close()
            out.close()
            store.move(own, path)
            yield pa.RecordBatch.from_pydict({
                "shard": [task.partitionId()], "path": [path], "n_docs": [len(writer.docs)], "n_ids": [writer.n_ids]})

    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    shards = stage(ordered.mapInArrow(run, "shard long, path string, n_docs long, n_ids long"), "shards")
    before = F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))  # one row per file
    return stage(shards.withColumn("offset", F.coalesce(before, F.lit(0))), "shard-offsets")


def read_tokens(shards: DataFrame, folder: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids)`` of every document in the files; ``ids`` are little-endian unsigned 32-bit integers."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with store.open_input_file(row["path"]) as file:
                    rows, size = [], 0
                    for doc, start, ids in ShardReader(file).documents():
                        rows.append((doc, row["offset"] + start, len(ids), ids.astype("<u4").tobytes()))
                        size += len(ids)
                        if size >= 1_000_000:
                            yield _documents(rows)
                            rows, size = [], 0
                    yield _documents(rows)

    spread = shards.select("path", "offset").repartition(max(1, shards.count()), "path")  # a row per file
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def _documents(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()))
    return pa.RecordBatch.from_arrays(
        [pa.array([r[k] for r in rows], type=kind) for k, (_, kind) in enumerate(kinds)], names=[name for name, _ in kinds])


def token_folder(docs: DataFrame) -> str:
    """A new folder for a set of files, in the shared folder: a URI, or a plain path where that is a file system all machines mount."""
    spark = docs.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(fresh_path(spark, "planes"))
    whole = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return re.sub("^file:/+", "/", whole)
