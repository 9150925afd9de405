"""Which fingerprints of a corpus repeat: a distributed duplicate detection.

Documents are hashed to blocks of some megabytes. Each block sends its sorted
fingerprints, delta-coded and cut into buckets of the value range, with two
bytes of payload each; a bucket looks at all blocks' values at once and
answers each block for each fingerprint. So a fingerprint costs a few
bytes of shuffle, and texts move once, to their block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fingerprints have so many bits. What they decide is checked on contents, or errs with probability n / 2**48.
BITS = 48
BLOCK_BYTES = 8 << 20
#: Short documents make a block by their number.
BLOCK_DOCS = 30_000


def pack(values: np.ndarray) -> bytes:
    """Unsigned integers by byte planes; a plane of zeros costs nothing."""
    v = np.ascontiguousarray(values)
    return zstandard.ZstdCompressor(level=1).compress(v.view(np.uint8).reshape(len(v), v.itemsize).T.tobytes()) if len(v) else b""


def unpack(blob: bytes, dtype: type) -> np.ndarray:
    if not blob:
        return np.zeros(0, dtype=dtype)
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).ravel()


def pack_sorted(values: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=np.uint64(0)))


def unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack(blob, np.uint64), dtype=np.uint64)


_BLOCK = "block int, n int, docs binary"


@dataclass
class Blocked:
    """(block, n, docs): compressed documents; each of the n blocks is a partition of its own.

    Every further exchange also has n parts, so what a task reads doesn't grow with the data.
    """

    df: DataFrame
    n: int


def block_count(size: int | None, block_bytes: int = BLOCK_BYTES) -> int:
    return max(1, -(-int(size or 0) // block_bytes))


def blocks(docs: DataFrame, key: Column, text: Column, block_bytes: int = BLOCK_BYTES) -> Blocked:
    """The documents in blocks by key; null keys and texts are left out."""
    rows = docs.select(key.cast("bigint").alias("k"), text.alias("t")).where("k is not null and t is not null")
    return _blocks(rows, block_bytes, False)


def text_blocks(docs: DataFrame, text: Column, block_bytes: int = BLOCK_BYTES) -> Blocked:
    """The texts in blocks by text_key(), which takes the place of their keys; null texts are left out.

    A task sends each text once, so copies of one text weigh as much as there are tasks that have it.
    """
    rows = docs.select(text.alias("t")).where("t is not null").select(text_key(F.col("t")).alias("k"), "t")
    return _blocks(rows, block_bytes, True)


def text_key(text: Column) -> Column:
    """Equal texts have equal keys; of n texts some two others have with a probability of about n^2 / 2^65."""
    return F.xxhash64(text)


def _blocks(rows: DataFrame, block_bytes: int, fold: bool) -> Blocked:
    size, count = rows.agg(F.sum(F.octet_length("t")), F.count("*")).first()
    n = max(block_count(size, block_bytes), block_count(count, BLOCK_DOCS))
    return pack_blocks(rows.withColumn("block", F.pmod(F.xxhash64("k"), F.lit(n)).cast("int")), n, fold=fold)


def pack_blocks(rows: DataFrame, n: int, prepare: Callable[[str], str] = str, fold: bool = False) -> Blocked:
    """Rows (k, t, block), block one of n; prepare is applied to the texts first. fold: of a key a task sends the first row only."""
    schema = pa.schema([("block", pa.int32()), ("n", pa.int32()), ("docs", pa.binary())])

    def pack_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            keys, texts, at = batch.column(0).to_numpy(), batch.column(1), batch.column(2).to_numpy()
            if fold:
                new = np.array([k not in seen and not seen.add(k) for k in keys.tolist()], dtype=bool)
                keys, texts, at = keys[new], texts.filter(pa.array(new)), at[new]
            texts = texts.to_pylist()
            order = np.argsort(at, kind="stable")
            edge = np.flatnonzero(np.diff(at[order], prepend=-1, append=-1)) if len(order) else order
            out = []
            for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist()):
                i = order[lo:hi]
                raw = [prepare(texts[j]).encode() for j in i.tolist()]
                head = np.concatenate([keys[i], np.array([len(r) for r in raw], np.int64)])
                out.append((at[i[0]], len(i), zstandard.ZstdCompressor(level=3).compress(head.tobytes() + b"".join(raw))))
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out) if out else [[]] * 3, schema)], schema=schema)

    return Blocked(rows.select("k", "t", "block").mapInArrow(pack_docs, _BLOCK).repartitionById(n, "block"), n)


def block_docs(table: pa.Table) -> tuple[np.ndarray, list[str]]:
    """Keys and texts of a block, in the same order whenever it is read."""
    keys, texts = [], []
    for n, blob in zip(table["n"].to_pylist(), table["docs"]):
        raw = zstandard.ZstdDecompressor().decompress(blob.as_py())
        k, size = np.frombuffer(raw, np.int64, n), np.frombuffer(raw, np.int64, n, 8 * n)
        ends = 16 * n + np.cumsum(size)
        keys.append(k)
        texts.extend(raw[lo:hi].decode() for lo, hi in zip((ends - size).tolist(), ends.tolist()))
    if not keys:
        return np.zeros(0, np.int64), []
    all_keys = np.concatenate(keys)
    order = sorted(range(len(texts)), key=lambda i: (all_keys[i], texts[i]))  # shuffles bring the parts in any order
    return all_keys[order], [texts[i] for i in order]


Docs = tuple[np.ndarray, list[str]]
Emit = tuple[np.ndarray, np.ndarray]
Reduce = Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
_ANSWER = pa.schema([("block", pa.int32()), ("round", pa.int32()), ("bucket", pa.int32()), ("numbers", pa.binary()), ("words", pa.binary())])
_ANSWER_SQL = "block int, round int, bucket int, numbers binary, words binary"


def ask(blocked: Blocked, emit: Callable[[Docs, list[np.ndarray]], Emit], reduce: Reduce, earlier: DataFrame | None = None, kind: type = np.uint16) -> DataFrame:
    """Answers of a round, for finish() or a further round.

    emit(documents, words of the earlier rounds) gives sorted fingerprints
    below 2**BITS and their payload, of type kind; reduce(fingerprints, payload, block) a
    number for each entry of a bucket, sorted by fingerprint, and the table
    [numbers, words] of 64-bit words that the numbers stand for, row 0 of zeros.
    """
    buckets = blocked.n
    this = 0 if earlier is None else 1
    out = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("fps", pa.binary()), ("payload", pa.binary())])

    def send(left: pa.Table, right: pa.Table | None = None) -> pa.Table:
        if not left.num_rows:
            return out.empty_table()
        fps, payload = emit(block_docs(left), [] if right is None else _answers(right, this))
        cuts = np.searchsorted(fps, _bounds(buckets))
        rows = [(b, fps[cuts[b] : cuts[b + 1]], payload[cuts[b] : cuts[b + 1]]) for b in range(buckets)]
        rows = [r for r in rows if len(r[1])]
        block = left["block"][0].as_py()
        return pa.Table.from_arrays(
            [pa.array([r[0] for r in rows], pa.int32()), pa.array([block] * len(rows), pa.int32()), pa.array([pack_sorted(r[1]) for r in rows], pa.binary()), pa.array([pack(r[2]) for r in rows], pa.binary())],
            schema=out,
        )

    def answer(table: pa.Table) -> pa.Table:
        ids = table["block"].to_pylist()
        fps = [unpack_sorted(b.as_py()) for b in table["fps"]]
        size = np.array([len(f) for f in fps], dtype=np.int64)
        all_fps = np.concatenate(fps)
        del fps
        payload = np.concatenate([unpack(b.as_py(), kind) for b in table["payload"]])
        order = np.argsort(all_fps, kind="stable")
        number, words = reduce(all_fps[order], payload[order], np.repeat(np.array(ids, dtype=np.int64), size)[order])
        result = np.empty(len(order), dtype=np.uint32)
        result[order] = number
        bucket = table["bucket"][0].as_py()
        rows = []
        for block, part in zip(ids, np.split(result, np.cumsum(size)[:-1])):
            used, own = np.unique(np.append(part, np.uint32(0)), return_inverse=True)  # 0 stays 0
            rows.append((block, this, bucket, pack(own[:-1].astype(np.uint32)), zstandard.compress(np.ascontiguousarray(words[used].T).tobytes(), 1)))
        return pa.Table.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), _ANSWER)], schema=_ANSWER)

    schema = "bucket int, block int, fps binary, payload binary"
    groups = blocked.df.groupBy("block")
    if earlier is None:
        sent = groups.applyInArrow(lambda table: send(table), schema)
    else:
        sent = groups.cogroup(earlier.repartitionById(blocked.n, "block").groupBy("block")).applyInArrow(lambda left, right: send(left, right), schema)
    answers = sent.repartitionById(buckets, "bucket").groupBy("bucket").applyInArrow(answer, _ANSWER_SQL)
    return answers if earlier is None else earlier.unionAll(answers)


def _answers(table: pa.Table, rounds: int) -> list[np.ndarray]:
    """Per round the words [words, entries] of a block, in the order of emit."""
    out = []
    table = table.sort_by([("round", "ascending"), ("bucket", "ascending")])
    for r in range(rounds):
        got = []
        for at, numbers, words in zip(table["round"].to_pylist(), table["numbers"], table["words"]):
            if at == r:
                number = unpack(numbers.as_py(), np.uint32)
                of = np.frombuffer(zstandard.decompress(words.as_py()), np.uint64).reshape(-1, int(number.max(initial=0)) + 1)
                got.append(of[:, number])
        out.append(np.concatenate(got, axis=1) if got else np.zeros((0, 0), np.uint64))
    return out


def finish(blocked: Blocked, answers: DataFrame, rounds: int, result: Callable[[int, Docs, list[np.ndarray]], pa.Table], schema: str) -> DataFrame:
    """result(block, its documents, words of the rounds) of every block."""

    def end(left: pa.Table, right: pa.Table) -> pa.Table:
        return result(int(left["block"][0].as_py()), block_docs(left), _answers(right, rounds))

    return blocked.df.groupBy("block").cogroup(answers.repartitionById(blocked.n, "block").groupBy("block")).applyInArrow(end, schema)


def detect(blocked: Blocked, emit: Callable[[Docs], Emit], reduce: Reduce, result: Callable[[int, Docs, np.ndarray], pa.Table], schema: str) -> DataFrame:
    """One round: result(block, its documents, words) of every block."""
    answers = ask(blocked, lambda docs, _: emit(docs), reduce)
    return finish(blocked, answers, 1, lambda block, docs, words: result(block, docs, words[0]), schema)


def _bounds(buckets: int) -> np.ndarray:
    return np.array([(b << BITS) // buckets for b in range(buckets + 1)], dtype=np.uint64)
