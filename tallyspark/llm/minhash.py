"""Near-duplicate documents: SuperMinHash signatures, banding, verification on full shingle sets, union-find groups.

Signatures: each element draws, level by level, a position of its own random permutation and a value level + uniform;
the signature keeps the least value at each position. Elements share correlated permutation ranks, which lowers the
variance against independent hashes. Levels stop as soon as every position of a document holds a value: later levels
give greater ones only.

Equal shingle sets are one class, represented by their smallest id, before anything is compared, so a group of
exact copies costs one row. Documents that share a band are candidates. Within a band's bucket it is links that
count, not pairs: documents are first held against their bucket's smallest one, and pairs are only compared further
while their ends lie in different components. Before their texts are read, four bits of each signature value weed these
pairs out: at similarity J they differ with chance (1 - J) * 15 / 16, and a pair goes if more differ than most_apart()
allows: 106 of the 384. What then is still apart is joined by differences, see by_differences(): exactly, and without comparing
all documents of a bucket with each other. Bands use the first 228 values. Two documents at the threshold 0.8 fail to share a band with probability
(1 - 0.8^6)^38 = 1e-5; above it with less. Six rows a band keep documents that merely share a long passage
(J around 0.3) out of each other's buckets.
"""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, maybe_listed, python_rows, without, written
from .graph import components

BANDS, ROWS, VALUES = 38, 6, 384
U = np.uint64
#: Elements whose permutations are held at once.
CHUNK = 12_000
#: Rounds against other bucket leaders before what is left is joined by differences.
LEADER_ROUNDS = 2
#: 64-bit words of a difference's parities, and elements of differences that a worker hands on at once.
PARITY_WORDS, PORTION = 16, 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


#: Random words for the bytes of a word, by place: the hash of a word is the sum of its bytes' words (tabulation hashing).
PLACES = 64
TABLE = mix(np.arange(1, PLACES * 256 + 1, dtype=U) * U(0x9E3779B97F4A7C15) ^ U(0x2545F4914F6CDD1D))
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
#: Bytes whose words are hashed at once; a longer text goes in parts cut at white space.
PART = 1 << 19


def _word_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    blank = BLANK[raw]
    edge = np.diff(np.concatenate([[True], blank, [True]]).view(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(start):
        return start, np.empty(0, U)
    n = end - start
    inside = raw[~blank]
    first = np.cumsum(n) - n
    place = np.minimum(np.arange(len(inside)) - np.repeat(first, n), PLACES - 1)
    place <<= 8
    place |= inside
    with np.errstate(over="ignore"):
        h = mix(np.add.reduceat(TABLE[place], first) + n.astype(U) * U(0xD6E8FEB86659FD93))
    for i in np.flatnonzero(n > PLACES):
        h[i] = xxhash.xxh3_64_intdigest(raw[start[i] : end[i]].tobytes())
    return start, h


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(start, 64-bit hash) of every run of bytes without ASCII white space."""
    whole = np.frombuffer(raw, np.uint8)
    starts, hashes, at = [], [], 0
    while at < len(raw):
        cut = at + PART
        while cut < len(raw) and not BLANK[raw[cut]]:
            cut += 1
        s, h = _word_hashes(whole[at:cut])
        starts.append(s + at)
        hashes.append(h)
        at = cut
    return (np.concatenate(starts), np.concatenate(hashes)) if starts else (np.empty(0, np.int64), np.empty(0, U))


class Shingler:
    """texts -> sorted distinct 64-bit hashes of each one's ``k``-word shingles.

    A-Z are lower-cased, words are runs without ASCII white space. With fewer than k words the whole sequence is one
    shingle; without words there is none. Nothing is kept between calls.
    """

    def __init__(self, k: int):
        self.k = k

    def rolled(self, h: np.ndarray, k: int) -> np.ndarray:
        n = len(h) - k + 1
        with np.errstate(over="ignore"):
            s = mix(h[:n] + U(k))
            for i in range(1, k):
                s = mix(s * U(0x9E3779B97F4A7C15) + h[i : n + i])
        return s

    def sets(self, texts: list[str | None]) -> list[np.ndarray]:
        raw = [(x or "").encode("utf-8", "surrogatepass").lower() for x in texts]
        start, h = word_hashes(b"\n".join(raw))
        to = np.searchsorted(start, np.cumsum([len(x) + 1 for x in raw]))
        s = self.rolled(h, self.k) if len(h) >= self.k else np.empty(0, U)
        out, a = [], 0
        for b in to.tolist():
            if b - a >= self.k:
                out.append(np.unique(s[a : b - self.k + 1]))
            else:
                out.append(self.rolled(h[a:b], b - a) if b > a else np.empty(0, U))
            a = b
        return out

    def __call__(self, text: str | None) -> np.ndarray:
        return self.sets([text])[0]


def portions(lengths: list[int], most: int, rows: int) -> Iterator[slice]:
    """Slices of up to ``rows`` rows and ``most`` characters, or of one longer row."""
    at = 0
    while at < len(lengths):
        end, n = at + 1, lengths[at]
        while end < len(lengths) and end - at < rows and n + lengths[end] <= most:
            n += lengths[end]
            end += 1
        yield slice(at, end)
        at = end


def signatures(sets: list[np.ndarray], m: int) -> np.ndarray:
    """SuperMinHash signatures of length m, a row for each set; rows of empty sets stay infinite.

    Sets are taken in the order of their sizes: small ones need many levels, large ones few.
    """
    out = np.full((len(sets), m), np.inf)
    order = [i for i in sorted(range(len(sets)), key=lambda i: len(sets[i])) if len(sets[i])]
    for part in portions([len(sets[i]) for i in order], CHUNK, len(order) or 1):
        ids = order[part]
        if len(sets[ids[0]]) > CHUNK:  # one very large set: in parts; the least of its parts' values is that of the whole
            for s in range(0, len(sets[ids[0]]), CHUNK):
                np.minimum(out[ids[0]], _signatures([sets[ids[0]][s : s + CHUNK]], m)[0], out=out[ids[0]])
        else:
            out[ids] = _signatures([sets[i] for i in ids], m)
    return out


def _signatures(sets: list[np.ndarray], m: int) -> np.ndarray:
    doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    x = np.concatenate(sets)
    sig = np.full(len(sets) * m, np.inf)
    perm = None
    for level in range(m):
        with np.errstate(over="ignore"):
            a = mix(x + U(((2 * level + 1) * 0x9E3779B97F4A7C15) & (2**64 - 1)))
            b = mix(a + U(0xD1B54A32D192ED03))
        k = level + (a % U(m - level)).astype(np.int64)
        if level == 0:
            at, first = k, k
        else:
            rows = np.arange(len(x))
            if perm is None:
                perm = np.tile(np.arange(m, dtype=np.uint16), (len(x), 1))
                perm[rows, 0], perm[rows, first] = first, 0
            at = perm[rows, k].astype(np.int64)
            perm[rows, k] = perm[rows, level]
            perm[rows, level] = at
        np.minimum.at(sig, doc * m + at, level + (b >> U(11)) * 2.0**-53)
        todo = ~np.isfinite(sig).reshape(-1, m).all(1)
        live = todo[doc]
        if not live.any():
            break
        x, doc = x[live], doc[live]
        first = first[live] if perm is None else None
        perm = perm[live] if perm is not None else None
    return sig.reshape(-1, m)


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band, the band's number mixed in."""
    bits = np.ascontiguousarray(sig).view(U).reshape(len(sig), bands, rows)
    with np.errstate(over="ignore"):
        key = np.tile(mix(np.arange(1, bands + 1, dtype=U)), (len(sig), 1))
        for r in range(rows):
            key = mix(key * U(0x9E3779B97F4A7C15) + bits[:, :, r])
    return key.view(np.int64)


def bit_words(sig: np.ndarray) -> np.ndarray:
    """Four bits of each value, packed into 64-bit words."""
    nibbles = (mix(np.ascontiguousarray(sig).view(U)) & U(15)).astype(np.uint8)
    nibbles = np.pad(nibbles, ((0, 0), (0, -sig.shape[1] % 16)))
    return np.ascontiguousarray(nibbles[:, ::2] << 4 | nibbles[:, 1::2]).view(np.int64)


def most_apart(m: int, percent: int) -> int:
    """Values of m that may differ at the threshold: the mean and 4.5 deviations."""
    p = (1 - percent / 100) * 15 / 16
    return int(m * p + 4.5 * math.sqrt(m * p * (1 - p)))


def apart(x: str, y: str, n: int):
    """Column: the number of values whose four bits differ, of two arrays of n words."""
    total = F.lit(0)
    for i in range(n):
        d = F.col(x)[i].bitwiseXOR(F.col(y)[i])
        d = d.bitwiseOR(F.shiftrightunsigned(d, 1))
        d = d.bitwiseOR(F.shiftrightunsigned(d, 2))
        total = total + F.bit_count(d.bitwiseAND(F.lit(0x1111111111111111)))
    return total


def sketch(docs: DataFrame, k: int, bands: int, rows: int, key: str, text: str) -> DataFrame:
    """(key_, n_, f1_, f2_, bands_, bits_): set size, fingerprint of the whole set, band keys (none for an empty set), bits."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingle = Shingler(k)
        for b in batches:
            texts = b["text_"].tolist()
            for at in portions([len(x or "") for x in texts], 1 << 20, 1024):
                sets = shingle.sets(texts[at])
                prints = np.array([divmod(xxhash.xxh3_128_intdigest(x.tobytes()), 1 << 64) for x in sets], dtype=U).view(np.int64).reshape(-1, 2)
                sig = signatures(sets, max(VALUES, bands * rows))
                keys, bits = band_keys(sig[:, : bands * rows], bands, rows), bit_words(sig)
                yield pd.DataFrame({"key_": b["key_"].to_numpy()[at], "n_": [len(x) for x in sets], "f1_": prints[:, 0], "f2_": prints[:, 1], "bands_": [q if len(x) else q[:0] for x, q in zip(sets, keys, strict=True)], "bits_": list(bits)})

    rows_in = docs.select(F.col(key).cast("long").alias("key_"), F.col(text).alias("text_"))
    return python_rows(rows_in, run, "key_ long, n_ long, f1_ long, f2_ long, bands_ array<long>, bits_ array<long>")


def with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``pairs`` with a_text and b_text; ``texts`` has key_ and text_."""
    side = lambda c: texts.select(F.col("key_").alias(c), F.col("text_").alias(f"{c}_text"))
    return pairs.join(side("b"), "b").join(side("a"), "a").select(*pairs.columns, "a_text", "b_text")


class Held:
    """(key, text) -> its set; the sets of the documents seen last are kept, up to 4 million elements or one document."""

    def __init__(self, k: int):
        self.shingle, self.held = Shingler(k), OrderedDict()

    def __call__(self, i: int, text: str) -> np.ndarray:
        at, held = (i, text), self.held
        if at in held:
            held.move_to_end(at)
            return held[at]
        held[at] = s = self.shingle(text)
        while len(held) > 2 and (len(held) > 500 or sum(map(len, held.values())) > 4_000_000):
            held.popitem(last=False)
        return s


def verified(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Those (a, b) of ``pairs`` whose full sets have 100 * intersection >= percent * union; ``texts`` has key_ and text_."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = Held(k)
        for b in batches:
            good = []
            for i, j, x, y in zip(b["a"], b["b"], b["a_text"], b["b_text"], strict=True):
                s, t = of(i, x), of(j, y)
                small, large = sorted((len(s), len(t)))
                if not small or 100 * small < percent * large:
                    good.append(False)
                    continue
                both = len(np.intersect1d(s, t, assume_unique=True))
                good.append(100 * both >= percent * (len(s) + len(t) - both))
            yield b.loc[good, ["a", "b"]]

    return with_texts(pairs.select("a", "b"), texts).mapInPandas(run, "a long, b long")


def parities(x: np.ndarray, words: int = PARITY_WORDS) -> np.ndarray:
    """For each of 64 * words places whether an odd number of the elements fall on it, packed.

    Two sets differ by no fewer elements than their parities by places.
    """
    n = 64 * words
    return np.packbits(np.bincount((mix(x) % U(n)).astype(np.int64), minlength=n).astype(np.uint8) & 1).view(np.int64)


def differences(under: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """For each (ref_, rep_, component) how the sets of rep_ and ref_ differ: see by_differences()."""
    near, far = 100 - percent, 100 + percent

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = Held(k)
        for batch in batches:
            rows, n = [], 0
            for i, j, c, x, y in zip(batch["a"], batch["b"], batch["component"], batch["a_text"], batch["b_text"], strict=True):
                r, s = of(i, x), of(j, y)
                if not len(r) or not len(s):
                    continue
                d = np.setxor1d(r, s, assume_unique=True)
                excess, bound = far * len(d) - near * len(s), near * len(r)
                # shared differences that a link to a document of greater, or of smaller excess needs at least
                index = max(1, -(-(excess + max(excess, bound + 1)) // (2 * far)))
                probe = max(1, -((100 * near * len(s) - percent * excess) // (percent * far))) if percent else 1
                rows.append((i, xxhash.xxh3_64_intdigest(r.tobytes()) - (1 << 63), j, xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63), c, len(s), excess, excess <= bound, len(d) - index + 1, len(d) - probe + 1, len(d), parities(d), d.view(np.int64)))
                n += len(d)
                if n >= PORTION:
                    yield pd.DataFrame(rows, columns=names)
                    rows, n = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=names)

    names = ["ref_", "ref_set_", "rep_", "set_", "component", "n_", "excess_", "linked_", "index_", "probe_", "apart_", "parity_", "d_"]
    kinds = {"linked_": "boolean", "parity_": "array<long>", "d_": "array<long>"}
    pairs = under.select(F.col("ref_").alias("a"), F.col("rep_").alias("b"), "component")
    return with_texts(pairs, texts).mapInPandas(run, ", ".join(f"{c} {kinds.get(c, 'long')}" for c in names))


def by_differences(under: DataFrame, texts: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(links to references, candidates): (a, b) each, for (ref_, rep_, component): documents near one reference.

    Candidates hold every link between documents of one reference and of different components, unless both are linked to
    the reference. Near copies have most of their sets in common, so no element of these tells them apart; what tells is their
    difference dX from a common reference R. With near = 100 - percent, far = 100 + percent and the excess
    w(X) = far * |dX| - near * |X|, A and B are linked if 2 * far * |dA & dB| >= w(A) + w(B), and X and R are if
    w(X) <= near * |R|. So of two documents that R doesn't link, the one of greater excess isn't linked to R, and the two share a
    number of differences, which bounds how many of each one's rarest differences have to be looked at (prefix filter).
    Differences that only one document has match nothing and only count. Matches whose parities lie farther apart than a
    link allows are dropped; all this is exact.
    """
    near, far = 100 - percent, 100 + percent
    own = ["ref_", "ref_set_", "rep_", "set_"]
    told = written(differences(under, texts, k, percent).dropDuplicates(own), "differences")
    each = told.where("apart_ > 0").select(*own, "apart_", F.greatest("index_", F.when(~F.col("linked_"), F.col("probe_")).otherwise(0)).alias("most_"), F.explode("d_").alias("e_"))
    several = each.groupBy("ref_", "ref_set_", "e_").agg(F.count("*").alias("held_")).where("held_ > 1")
    shared = each.join(several, ["ref_", "ref_set_", "e_"])
    doc = Window.partitionBy(*own)
    shared = shared.withColumn("place_", F.col("apart_") - F.count("*").over(doc) + F.row_number().over(doc.orderBy("held_", "e_")))
    shared = written(shared.where("place_ <= most_").select(*own, "e_", "place_").join(told.drop("d_"), own), "shared")
    one = shared.where("not linked_ and place_ <= probe_").select("ref_", "ref_set_", "e_", *(F.col(c).alias(f"a_{c}") for c in ("rep_", "component", "n_", "excess_", "parity_")))
    two = shared.where("place_ <= index_").select("ref_", "ref_set_", "e_", *(F.col(c).alias(f"b_{c}") for c in ("rep_", "component", "n_", "excess_", "parity_")))
    least = sum((F.bit_count(F.col("a_parity_")[i].bitwiseXOR(F.col("b_parity_")[i])) for i in range(PARITY_WORDS)), F.lit(0))
    two = two.withColumnsRenamed({c: f"x_{c}" for c in ("ref_", "ref_set_", "e_")})
    same = (F.col("ref_") == F.col("x_ref_")) & (F.col("ref_set_") == F.col("x_ref_set_")) & (F.col("e_") == F.col("x_e_"))
    fits = (F.col("a_component") != F.col("b_component")) & (F.col("a_excess_") >= F.col("b_excess_")) & (far * least <= near * (F.col("a_n_") + F.col("b_n_")))
    pairs = one.join(two, same & fits).select(F.least("a_rep_", "b_rep_").alias("a"), F.greatest("a_rep_", "b_rep_").alias("b"))
    links = told.where("linked_ and rep_ <> ref_").select(F.least("rep_", "ref_").alias("a"), F.greatest("rep_", "ref_").alias("b"))
    return links.distinct(), pairs.distinct()


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, key: str = "doc_id", text: str = "text", weed: bool = True) -> DataFrame:
    """(key, n_shingles, component_id, kept) for every row of ``docs``; other columns play no part.

    component_id is the smallest key reachable over links, kept says whether that is the row's own. Null, empty and
    blank texts have no shingles, n_shingles 0, and stand alone. Rows of one key are one document: a link of either
    text links it, and every such row is returned. Rows with a null key are returned with n_shingles and null for the
    rest. An empty table gives an empty one. Very long texts are hashed in parts and compared whole. ``weed`` false holds
    documents against leaders without weeding by signature bits before; the join by differences never weeds.
    """
    seen = written(sketch(docs, k, bands, rows, key, text), "sketch")
    own = seen.where("key_ is not null")
    classes = written(own.where("n_ > 0").groupBy("f1_", "f2_").agg(F.min("key_").alias("rep_")), "classes")
    member = written(own.join(classes, ["f1_", "f2_"], "left").select("key_", "n_", F.coalesce("rep_", "key_").alias("rep_"), *(F.when(F.col("rep_") == F.col("key_"), F.col(c)).alias(c) for c in ("bands_", "bits_"))), "members")
    values = max(VALUES, bands * rows)
    words, most = -(-values // 16), most_apart(values, percent) if weed else values

    band = member.where("bands_ is not null").select("rep_", F.explode("bands_").alias("band_"))
    shared = written(band.groupBy("band_").agg(F.min("rep_").alias("lead_"), F.max("rep_").alias("last_")).where("lead_ < last_").select("band_", "lead_"), "buckets")
    bucket = written(band.join(shared, "band_"), "candidates")
    vertices = bucket.select("rep_").distinct().join(member.where("bits_ is not null").select("rep_", "bits_"), "rep_").distinct().withColumnRenamed("rep_", "key_")
    vertices = written(vertices, "vertices")
    texts = written(docs.select(F.col(key).cast("long").alias("key_"), F.col(text).alias("text_")).join(vertices.select("key_").distinct(), "key_"), "texts")

    tried = written(bucket.where("lead_ < rep_").groupBy(F.col("rep_").alias("b")).agg(F.min("lead_").alias("a")).select("a", "b"), "pairs")
    links = written(verified(tried, texts, k, percent), "edges")
    group = components(links)
    for turn in range(LEADER_ROUNDS + 1):
        # buckets that still hold several components
        placed = bucket.select("band_", "rep_").join(group.select(F.col("node").alias("rep_"), "component"), "rep_", "left").withColumn("component", F.coalesce("component", "rep_"))
        placed = written(placed, "placed")
        first = F.min_by("rep_", F.struct("component", F.xxhash64("rep_", F.lit(turn))))
        lead = placed.groupBy("band_").agg(F.min("component").alias("low_"), F.max("component").alias("high_"), first.alias("lead_")).where("low_ < high_")
        lead = written(lead.select("band_", "low_", "lead_").join(vertices.select(F.col("key_").alias("lead_"), F.col("bits_").alias("b_bits")), "lead_"), "mixed")
        if lead.limit(1).count() == 0:
            break
        if turn == LEADER_ROUNDS:
            # the least component's smallest document is the reference of its buckets
            under = placed.join(lead.select("band_", F.col("low_").alias("ref_")), "band_").select("ref_", "rep_", "component").distinct()
            found, pairs = by_differences(under, texts, k, percent)
            found = found.union(verified(written(pairs.join(tried, ["a", "b"], "left_anti"), "pairs"), texts, k, percent))
        else:
            known = placed.join(lead.select("band_"), "band_").join(vertices.select(F.col("key_").alias("rep_"), "bits_"), "rep_")
            known = written(known, "apart")
            near = known.withColumnRenamed("bits_", "a_bits").join(lead.withColumnRenamed("band_", "at_"), (F.col("band_") == F.col("at_")) & (F.col("component") != F.col("low_")) & (apart("a_bits", "b_bits", words) <= most))
            # one link to a component is enough: of its leaders each document is held against the likeliest
            near = near.groupBy("rep_", "low_").agg(F.min_by("lead_", F.struct(apart("a_bits", "b_bits", words), "lead_")).alias("lead_"))
            pairs = near.select(F.least("rep_", "lead_").alias("a"), F.greatest("rep_", "lead_").alias("b"))
            pairs = written(pairs.distinct().join(tried, ["a", "b"], "left_anti"), "pairs")
            if pairs.limit(1).count() == 0:
                continue
            found = verified(pairs, texts, k, percent)
            tried = tried.union(pairs)
        found = written(found, "edges")
        if found.limit(1).count():
            links = links.union(found)
            group = components(links)
    ids = group.select(F.col("node").alias("rep_"), "component")
    out = member.select("key_", "n_", "rep_").join(ids, "rep_", "left").select(F.col("key_"), F.col("n_"), F.coalesce("component", "rep_").alias("component_id"))
    out = out.unionByName(seen.where("key_ is null").select("key_", "n_", F.lit(None).cast("long").alias("component_id")))
    return out.select(F.col("key_").alias(key), F.col("n_").alias("n_shingles"), "component_id", (F.col("key_") == F.col("component_id")).alias("kept"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """``docs`` with one document of each near-duplicate group, the one of the smallest key; all columns stay.

    Rows under one key are one document: they stay or go together, and of those that stay with equal words only one is
    left. Rows with a null key all stay. Only rows that go, or that share their key, are shuffled.
    """
    near = written(near_duplicates(docs, key=key, text=text, **how).where(F.col(key).isNotNull()).select(key, "kept"), "groups")
    left = without(docs, near.where("not kept").select(key), key)
    several = near.where("kept").groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key)
    may, clear = maybe_listed(left, several, key)
    (same,) = fresh(docs, "same_")
    plain = F.trim(F.regexp_replace(F.translate(F.col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[\x20\x09-\x0D]+", " "))
    one = may.where(F.col(key).isNotNull()).withColumn(same, F.coalesce(plain, F.lit(""))).dropDuplicates([key, same]).drop(same)
    return one.unionByName(may.where(F.col(key).isNull())).unionByName(clear)
