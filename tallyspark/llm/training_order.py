"""Token sequences in training order as fixed-stride binary shards.

The ids of all documents, each closed by an end id, follow one another in the order of their keys (nulls first, rows of one key by
their text); sequence q is the ids from q * length on, so nothing is padded but the last. A keyed Feistel network over the least
even-bit domain that holds all sequence numbers, walked along its cycle until it lands among them, is a permutation that
gives every sequence its global slot without sorting by random keys. Shard s holds the slots from s * slots_per_shard
on, each as ``length`` ids (uint16 or uint32, little endian): reading in order is sequential, and slot i is found by
arithmetic, so reading can resume anywhere. The order depends on the documents and the key alone, not on files or tasks.

Ids are made once, into a compressed table. Of it only keys and lengths are sorted, which gives every document its place among
all ids; these places go back to files beside the table's parts, where the next pass finds them by the row's
number. That pass deals out the sequences' parts by shard, in compressed portions, and a task for each shard puts them
in place in a buffer of the shard's size and writes it.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import partitions, python_rows, shared_dir, sweep, written
from .minhash import mix

ROUNDS = 6
#: Bytes of ids that a task holds before it deals them out.
PORTION = 8 << 20
#: A part of a sequence: slot in its shard, first id in it, number of ids, place in the document, key and whether it is null.
PART = [("slot", "<u4"), ("at", "<u4"), ("n", "<u4"), ("start", "<u8"), ("key", "<i8"), ("null", "u1")]


def feistel(x: np.ndarray, n: int, key: int, inverse: bool = False) -> np.ndarray:
    """A keyed permutation of 0..n-1: balanced Feistel rounds over 2^(2h) >= n, walked until the value is under n."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    keys = [mix(np.array([(key + 0x9E3779B97F4A7C15 * (r + 1)) & (2**64 - 1)], dtype=np.uint64))[0] for r in range(ROUNDS)]

    def once(v: np.ndarray) -> np.ndarray:
        a, b = v >> np.uint64(half), v & low
        for k in reversed(keys) if inverse else keys:
            if inverse:
                a, b = b ^ (mix(a ^ k) & low), a
            else:
                a, b = b, a ^ (mix(b ^ k) & low)
        return (a << np.uint64(half)) | b

    out = once(x.astype(np.uint64))
    while (over := out >= np.uint64(n)).any():
        out[over] = once(out[over])
    return out.astype(np.int64)


def token_table(docs: DataFrame, path: str, end_id: int, key: str, text: str) -> DataFrame:
    """(part_, row_, key_, hash_, n_, ids_): a document's ids with the end id, and where the table holds them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kind = "<u2" if len(bpe.vocabulary(path).token) <= 1 << 16 else "<u4"
        encode, end = bpe.encoder(path, kind), np.array([end_id], dtype=kind).tobytes()
        part, row = TaskContext.get().partitionId(), 0
        for b in batches:
            ids = [encode(x) + end for x in b["text_"]]
            yield pd.DataFrame({"part_": part, "row_": np.arange(row, row + len(b)), "key_": b["key_"].to_numpy(), "hash_": b["hash_"].to_numpy(), "n_": [len(x) // int(kind[2]) for x in ids], "ids_": ids})
            row += len(b)

    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).cast("long").alias("key_"), F.xxhash64(whole).alias("hash_"), whole.alias("text_"))
    return python_rows(rows, run, "part_ int, row_ long, key_ long, hash_ long, n_ long, ids_ binary")


def place_documents(held: DataFrame, out: str) -> int:
    """Writes, for each part of the token table, the place of its rows' first ids among all ids; returns the number of ids.

    Equal rows of one key are dealt over the ranges by their place in the table; which of them comes first changes no id.
    """
    n = partitions(held.sparkSession)
    order = ["key_", "hash_", "salt_"]
    keyed = held.select("key_", "hash_", F.xxhash64("part_", "row_").alias("salt_"), "part_", "row_", "n_")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, range_ = 0, TaskContext.get().partitionId()
        for b in batches:
            ends = at + b["n_"].to_numpy().cumsum()
            yield pd.DataFrame({"range_": range_, "part_": b["part_"], "row_": b["row_"], "start_": ends - b["n_"], "end_": ends})
            at = int(ends[-1]) if len(ends) else at

    placed = keyed.repartitionByRange(n, *order).sortWithinPartitions(*order)
    placed = written(python_rows(placed, run, "range_ int, part_ int, row_ long, start_ long, end_ long"), "places")
    sums = dict(sorted((r["range_"], r["n"]) for r in placed.groupBy("range_").agg(F.max("end_").alias("n")).collect()))
    base, total = {}, 0
    for r, size in sums.items():  # as many as there are ranges
        base[r], total = total, total + size

    def save_parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, file = None, None
        for b in batches:
            for p, rows in b.groupby("part_", sort=False):
                if p != part:
                    if file:
                        file.commit()
                    part, file = p, Renamed(f"{out}/places-{p:06d}.bin")
                file.write((rows["start_"] + rows["range_"].map(base)).to_numpy("<i8").tobytes())
            yield pd.DataFrame({"n": [len(b)]})
        if file:
            file.commit()

    rows = placed.select("range_", "part_", "row_", "start_").repartition(n, "part_").sortWithinPartitions("part_", "row_")
    python_rows(rows, save_parts, "n long").agg(F.sum("n")).collect()
    return total


def materialise(docs: DataFrame, path: str, seed: int, length: int = 256, end_id: int = 50256, slots_per_shard: int = 65_536, out: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the shards under ``out`` and returns their index: (key, start, n_tokens, slot, offset, shard, byte_offset, ids_crc32),
    a row for each part of a document (its ids from ``start`` on) in a sequence, where it stands from id ``offset`` on.

    ``out`` is a folder that executors reach by a URI that pyarrow can open, by default one in the shared folder; shards
    are written under another name and renamed when whole, so a lost task leaves no half shard and simply writes its
    shard again, and a second copy of a task finds the shard there. A null text is the end id alone; null keys are
    returned as null; repeated rows are each written. Very long texts fill many sequences. Other columns of ``docs``, whatever
    their names, play no part. An empty table writes a manifest of no shards.
    """
    spark = docs.sparkSession
    out = out or f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}"
    size = 2 if len(bpe.vocabulary(path).token) <= 1 << 16 else 4
    stride, beside = size * length, f"{shared_dir(spark)}/places-{uuid.uuid4().hex}"
    tokens = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    made = token_table(docs, path, end_id, key, text)
    made.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", "9").parquet(tokens)
    held = spark.read.schema(made.schema).parquet(tokens)
    total = place_documents(held, beside)
    sequences = -(-total // length)
    shards = -(-sequences // slots_per_shard)
    save(f"{out}/manifest.json", json.dumps({"sequences": sequences, "tokens": total, "shards": shards, "slots_per_shard": slots_per_shard, "stride": stride, "id_bytes": size, "length": length, "seed": seed}).encode())

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pack, part, first = zstandard.ZstdCompressor(level=6), None, None
        rows, ids, n = [], [], 0

        def flush() -> pd.DataFrame:
            sequence = np.array([r[0] for r in rows], np.int64)
            slot = feistel(sequence, sequences, seed)
            t = np.empty(len(rows), PART)
            t["slot"] = slot % slots_per_shard
            for i, c in enumerate(("at", "n", "start", "key", "null"), 1):
                t[c] = [r[i] for r in rows]
            shard = slot // slots_per_shard
            order = np.argsort(shard, kind="stable")
            found = []
            for group in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
                head = b"".join(t[c][group].tobytes() for c, _ in PART)
                found.append((int(shard[group[0]]), len(group), pack.compress(head + b"".join(ids[i] for i in group.tolist()))))
            return pd.DataFrame(found, columns=["shard", "n", "portion"])

        for b in batches:
            for p, r, k, x in zip(b["part_"], b["row_"], b["key_"], b["ids_"], strict=True):
                if p != part:
                    part, first = p, np.frombuffer(load(f"{beside}/places-{p:06d}.bin"), "<i8")
                null = pd.isna(k)
                at, total_, k = int(first[r]), len(x) // size, 0 if null else int(k)
                sequence, inside, start = *divmod(at, length), 0
                while start < total_:
                    m = min(length - inside, total_ - start)
                    rows.append((sequence, inside, m, start, k, null))
                    ids.append(x[size * start : size * (start + m)])
                    sequence, inside, start = sequence + 1, 0, start + m
                n += len(x)
                if n >= PORTION:
                    yield flush()
                    rows, ids, n = [], [], 0
        if rows:
            yield flush()

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unpack, buffer, shard, parts = zstandard.ZstdDecompressor(), None, None, []

        def done() -> pd.DataFrame:
            t = np.concatenate([p for p, _ in parts])
            last = min(slots_per_shard, sequences - shard * slots_per_shard)
            save(f"{out}/shard-{shard:06d}.bin", memoryview(buffer)[: last * stride])
            order = np.argsort(t["slot"].astype(np.int64) * length + t["at"], kind="stable")
            t, crc = t[order], np.concatenate([c for _, c in parts])[order]
            keys = pd.array(t["key"].astype(np.int64), "Int64")
            keys[t["null"].astype(bool)] = pd.NA
            slot = t["slot"].astype(np.int64)
            return pd.DataFrame({"key_": keys, "start": t["start"].astype(np.int64), "n_tokens": t["n"].astype(np.int64), "slot": slot + shard * slots_per_shard, "offset": t["at"].astype(np.int64), "shard": np.int32(shard), "byte_offset": slot * stride, "ids_crc32": crc})

        for b in batches:
            for s, n, portion in zip(b["shard"], b["n"], b["portion"], strict=True):
                if s != shard:
                    if parts:
                        yield done()
                    buffer, shard, parts = bytearray(slots_per_shard * stride), int(s), []
                raw, t, at = unpack.decompress(portion), np.empty(n, PART), 0
                for c, kind in PART:
                    t[c] = np.frombuffer(raw, kind, n, at)
                    at += n * np.dtype(kind).itemsize
                crc = np.empty(n, np.int64)
                for i, (to, many) in enumerate(zip((t["slot"].astype(np.int64) * stride + t["at"] * size).tolist(), (t["n"].astype(np.int64) * size).tolist(), strict=True)):
                    ids = raw[at : at + many]
                    buffer[to : to + many] = ids
                    crc[i] = zlib.crc32(ids)
                    at += many
                parts.append((t, crc))
        if parts:
            yield done()

    dealt = python_rows(held.select("part_", "row_", "key_", "ids_"), deal, "shard int, n int, portion binary")
    dealt = dealt.repartitionById(max(1, shards), "shard").sortWithinPartitions("shard")
    index = written(python_rows(dealt, write, "key_ long, start long, n_tokens long, slot long, offset long, shard int, byte_offset long, ids_crc32 long"), "index")
    sweep(spark, tokens, beside)
    return index.select(F.col("key_").alias(key), "start", "n_tokens", "slot", "offset", "shard", "byte_offset", "ids_crc32")


class Renamed:
    """A file that appears under its name only when it is whole. Tasks that run twice write the same bytes: the one that
    comes second leaves the first one's file."""

    def __init__(self, uri: str):
        from pyarrow import fs

        self.fs, self.path = fs.FileSystem.from_uri(uri)
        self.own = f"{self.path}.{uuid.uuid4().hex}.part"
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.stream = self.fs.open_output_stream(self.own)
        self.write = self.stream.write

    def there(self) -> bool:
        from pyarrow import fs

        return self.fs.get_file_info(self.path).type == fs.FileType.File

    def commit(self) -> None:
        self.stream.close()
        if not self.there():
            try:
                self.fs.move(self.own, self.path)
                return
            except OSError:
                if not self.there():
                    raise
        self.fs.delete_file(self.own)


def save(uri: str, data: bytes | memoryview) -> None:
    f = Renamed(uri)
    f.write(data)
    f.commit()


def load(uri: str) -> bytes:
    from pyarrow import fs

    files, path = fs.FileSystem.from_uri(uri)
    with files.open_input_stream(path) as f:
        return f.read()


def read_slots(out: str, first: int = 0, count: int | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(slot, ids) from slot ``first`` on, shard after shard: a reader that can resume at any slot. The one sequence
    that ends the ids is returned without its padding."""
    from pyarrow import fs

    m = json.loads(load(f"{out}/manifest.json"))
    files, path = fs.FileSystem.from_uri(out)
    last = m["sequences"] if count is None else min(m["sequences"], first + count)
    kind, slot = f"<u{m['id_bytes']}", first
    short = int(feistel(np.array([m["sequences"] - 1]), m["sequences"], m["seed"])[0]) if m["sequences"] else -1
    while slot < last:
        shard, at = divmod(slot, m["slots_per_shard"])
        with files.open_input_file(f"{path}/shard-{shard:06d}.bin") as f:
            f.seek(at * m["stride"])
            while slot < last and slot // m["slots_per_shard"] == shard:
                ids = np.frombuffer(f.read(m["stride"]), kind)
                yield slot, ids[: (m["tokens"] - 1) % m["length"] + 1] if slot == short else ids
                slot += 1
