"""N-gram Jaccard self-join by parity sketches (operator 10).

A text's set of word shingles is hashed into chunks; each shingle is XORed into the one chunk it falls in and flips one
bit of a bit sketch. A shingle that only one of two sets has changes at most one chunk and one bit, so differing chunks,
and the Hamming distance of the bit sketches, are lower bounds of the symmetric difference. Two sets with Jaccard t
differ by at most (1 - t) / (1 + t) of their summed sizes: cut into more chunks than that, they agree on one at least.
Sizes are banded; a set is keyed by the chunks of its own band and, if it is large enough, of the next one.

Chunks without shingles say nothing. A scheme has z chunks more than needed, so that z + 1 chunks of a linked pair
agree, and a set with at most z empty chunks need not be keyed by those; one with more is.

Equal sets are one node. Keys are range-partitioned together with the sets that have them, so a common key spans tasks.
Pairs that share a small bucket (equal keys) are tested by sketch and set. A set whose chunks under a scheme include at
most z that are empty or have large buckets meets all its partners of that scheme in small ones too: a passage that
many texts share costs nothing more. What is left is near copies in great numbers. Sets that large buckets tie together
are a cluster, dealt into blocks of bounded bytes; a block is compared within itself and with a few hubs of its cluster,
sketches first, sets where they leave a doubt and the two aren't joined already. In clusters of several blocks that are
still several components, all members outside the largest component then meet all members of the cluster, block by
block. So each pair of different components that shares a key is tested, and work grows with what a hot group holds
besides its largest component, not with the square of the group.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components
from .textvec import NONSPACE_BYTES, U64, grams, mix, words

#: The largest size of a band over its smallest, or more if linked sets may differ by more.
BAND_GROWTH = 1.5
#: Bits of a sketch for each element that linked sets may differ by.
SKETCH_BITS = 16
#: All pairs are made of buckets with so many members at most.
SMALL_BUCKET = 48
#: Shingles of a block (8 bytes each), and the sets of a cluster that all its blocks hold.
BLOCK_SHINGLES, HUBS = 1 << 20, 4

_HASH_BITS = U64(52)


class Bands:
    """Size bands with their numbers of chunks, spare chunks and sketch words, from a threshold in percent."""

    def __init__(self, percent: int, largest: int = 1 << 31):
        if not 1 <= percent <= 100:
            raise ValueError(f"percent must be from 1 to 100, not {percent}")
        self.percent = percent
        growth = max(BAND_GROWTH, 100 / percent)  # linked sets are of one band or of two next to one another
        low, bounds = 1, [1]
        while low <= largest:
            low = max(low + 1, math.floor(low * growth))
            bounds.append(low)
        self.low = np.array(bounds[:-1], np.int64)
        self.high = np.array(bounds[1:], np.int64)
        self.differ = (100 - percent) * 2 * (self.high - 1) // (100 + percent)
        chunks, spare = [], []
        for low, d in zip(self.low, self.differ, strict=True):
            c = int(d) + 1
            for _ in range(4):
                empty = c * math.exp(-low * percent / 100 / c)
                c = int(d) + 1 + math.ceil(empty + 4 * math.sqrt(empty)) + 1
            chunks.append(c if d else 0)
            spare.append(c - int(d) - 1)
        self.chunks, self.spare = np.array(chunks, np.int64), np.array(spare, np.int64)
        self.sketch_words = np.maximum(1, -(-SKETCH_BITS * self.differ // 64))

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.high, sizes, "right")


def shingle_sets(column: pa.Array, k: int):
    """Per slice of rows: first row, rows, sorted 52-bit shingle hashes of all rows, and where each row's begin."""
    for w in words(column, NONSPACE_BYTES):
        at, h = grams(w, k)
        row = w.row[at]
        n_words = w.counts()
        short = np.flatnonzero((n_words > 0) & (n_words < k))
        if len(short):
            whole = np.zeros(len(short), U64)
            for i, r in enumerate(short):
                for x in w.hash[w.first[r] : w.first[r + 1]]:
                    whole[i] = mix(whole[i : i + 1] + x)[0]
            row, h = np.concatenate([row, short]), np.concatenate([h, mix(whole + n_words[short].astype(U64))])
        both = np.unique((row.astype(U64) << _HASH_BITS) | (h >> U64(12)))
        cut = np.searchsorted(both, np.arange(w.n_rows + 1, dtype=U64) << _HASH_BITS)
        yield w.row0, w.n_rows, both & U64((1 << 52) - 1), cut


def _xor_segments(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(values) + 1, U64)
    np.bitwise_xor.accumulate(values, out=sums[1:])
    return sums[ends[1:]] ^ sums[ends[:-1]]


def fingerprints(hashes: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each set."""
    size = np.diff(cut).astype(U64)
    sums = np.zeros(len(hashes) + 1, U64)
    np.cumsum(mix(hashes + U64(0x1234567)), out=sums[1:])
    return mix(sums[cut[1:]] - sums[cut[:-1]] + size), mix(_xor_segments(mix(hashes + U64(0x89ABCDEF)), cut) + size)


def _sketches(hashes: np.ndarray, cut: np.ndarray, n_words: np.ndarray) -> pa.Array:
    """One parity bit sketch of 64 * n_words bits for each set, as lists of longs."""
    size = np.where(n_words > 0, np.diff(cut), 0)
    if len(hashes) != size.sum():
        hashes = hashes[np.repeat(n_words > 0, np.diff(cut))]
    base = np.concatenate([[0], np.cumsum(n_words * 64)])
    bits = np.repeat(n_words.astype(U64) * U64(64), size)
    at = ((mix(hashes + U64(0x5EED)) >> U64(32)) * bits) >> U64(32)
    parity = np.bincount(np.repeat(base[:-1], size) + at.astype(np.int64), minlength=int(base[-1])) & 1
    data = np.packbits(parity.astype(np.uint8), bitorder="little").view(np.int64)
    return pa.ListArray.from_arrays(pa.array((base // 64).astype(np.int32)), pa.array(data))


def _chunk_keys(hashes: np.ndarray, cut: np.ndarray, scheme: np.ndarray, bands: Bands, use: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and key of every chunk that a set is keyed by, under the scheme of a band for each row in ``use``; and of
    each row, how many of its chunks may have large buckets (less than 0: none) and it still shares a small one with
    every set it links to under that scheme."""
    chunks = np.where(use, bands.chunks[scheme], 0)
    size = np.diff(cut)
    keyed = np.repeat(chunks > 0, size)
    owner = np.repeat(np.arange(len(size)), size)[keyed]
    h = hashes[keyed]
    base = np.concatenate([[0], np.cumsum(chunks)])
    chunk = ((h >> U64(20)) * chunks[owner].astype(U64)) >> U64(32)
    count = np.bincount(base[owner] + chunk.astype(np.int64), minlength=int(base[-1]))
    ends = np.concatenate([[0], np.cumsum(count)])
    value = _xor_segments(mix(h + U64(0xC0FFEE)), ends)
    row = np.repeat(np.arange(len(size)), chunks)
    empty = count == 0
    holes = np.bincount(row[empty], minlength=len(size))
    keep = ~empty | (holes > bands.spare[scheme])[row]
    place = np.arange(len(row)) - base[row]
    label = mix(scheme[row].astype(U64) * U64(1 << 32) + place.astype(U64) + U64(1))
    return row[keep], mix(value ^ label)[keep], np.where(use, bands.spare[scheme] - holes, 0)


_SIGNED = "doc_id long, text_hash long, n int, fp long, fp2 long, leads boolean, band int, own array<long>, following array<long>, room int, next_room int, keys array<long>, next_keys array<long>"


def _listed(rows: np.ndarray, values: np.ndarray, n_rows: int) -> pa.Array:
    at = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n_rows))])
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values.view(np.int64)))


def _sign(k: int, bands: Bands):
    """Signs each row; sketches and keys only where ``leads``: at a task's first row of a set that isn't empty."""

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            for row0, n_rows, hashes, cut in shingle_sets(batch.column(1), k):
                size = np.diff(cut)
                band = bands.of(np.maximum(size, 1))
                fp, fp2 = fingerprints(hashes, cut)
                leads = np.zeros(n_rows, bool)
                for i, x in enumerate(fp.tolist()):
                    if size[i] and x not in seen:
                        seen.add(x)
                        leads[i] = True
                row, key, room = _chunk_keys(hashes, cut, band, bands, leads)
                next_row, next_key, next_room = _chunk_keys(hashes, cut, band + 1, bands, leads & (100 * size >= bands.percent * bands.low[band + 1]))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(row0, n_rows),
                        batch.column(2).slice(row0, n_rows),
                        pa.array(size.astype(np.int32)),
                        pa.array(fp.view(np.int64)),
                        pa.array(fp2.view(np.int64)),
                        pa.array(leads),
                        pa.array(band.astype(np.int32)),
                        _sketches(hashes, cut, np.where(leads, bands.sketch_words[band], 0)),
                        _sketches(hashes, cut, np.where(leads, bands.sketch_words[band + 1], 0)),
                        pa.array(room.astype(np.int32)),
                        pa.array(next_room.astype(np.int32)),
                        _listed(row, key, n_rows),
                        _listed(next_row, next_key, n_rows),
                    ],
                    names=[x.split()[0] for x in _SIGNED.split(", ")],
                )

    return run


def _sets(k: int):
    def run(batches):
        for batch in batches:
            for _, n_rows, hashes, cut in shingle_sets(batch.column(1), k):
                fp, _ = fingerprints(hashes, cut)
                yield pa.RecordBatch.from_arrays([pa.array(fp.view(np.int64)), pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(hashes.view(np.int64)))], names=["fp", "elements"])

    return run


def _hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, x: acc + x)


class _Verifier:
    """Tests pairs of sets: the bound of the sketches first, then the sets themselves."""

    def __init__(self, nodes: DataFrame, percent: int):
        self.nodes, self.percent = nodes, percent

    def near(self, pairs: DataFrame) -> DataFrame:
        """Of distinct pairs (a, b), those that their sketches don't rule out."""
        p = self.percent
        side = lambda x: self.nodes.select(*[F.col(c).alias(f"{c}_{x}") for c in ("n", "band", "own", "following")], F.col("fp").alias(x))
        both = common.narrow(common.narrow(pairs.join(side("a"), "a")).join(side("b"), "b"))
        total = F.col("n_a") + F.col("n_b")
        distance = (
            F.when(F.col("band_a") == F.col("band_b"), _hamming(F.col("own_a"), F.col("own_b")))
            .when(F.col("band_a") + 1 == F.col("band_b"), _hamming(F.col("following_a"), F.col("own_b")))
            .when(F.col("band_b") + 1 == F.col("band_a"), _hamming(F.col("own_a"), F.col("following_b")))
        )
        return both.select("a", "b", total.alias("total"), distance.alias("distance")).where((100 + p) * F.col("distance") <= (100 - p) * F.col("total")).select("a", "b")

    def linked(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """Of pairs (a, b), those with 100 * intersection >= percent * union."""
        whole = lambda x: sets.select(F.col("fp").alias(x), F.col("elements").alias(f"set_{x}"))
        met = common.narrow(common.narrow(pairs.join(whole("a"), "a")).join(whole("b"), "b")).select("a", "b", (F.size("set_a") + F.size("set_b")).alias("total"), F.size(F.array_intersect("set_a", "set_b")).alias("common"))
        return met.where(100 * F.col("common") >= self.percent * (F.col("total") - F.col("common"))).select("a", "b")


def similar_groups(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", k: int = 4, percent: int = 85) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles (size of its set) and component_id (least doc_id reachable).

    Words are runs without ASCII white space, A-Z lower-cased; a set holds the distinct runs of k words, or the whole
    sequence if it has fewer. Texts link when 100 * intersection >= percent * union. Null, empty and blank texts have an
    empty set, link with nothing and are their own component. Rows that repeat an id each get a row. Ids are integers;
    a row with a null id links like any other, and a component without any id has a null component_id; other columns are
    ignored. An empty table gives an empty one. Sets are told apart by 64-bit hashes. Texts of any length are taken whole; a
    set is one row, and one of more shingles than a block holds is a block of its own.
    """
    return grouped_rows(docs, doc_id=doc_id, text=text, k=k, percent=percent).select(doc_id, "n_shingles", "component_id")


def grouped_rows(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", k: int = 4, percent: int = 85) -> DataFrame:
    """The rows of similar_groups with text_hash (xxhash64 of the text) and root, which tells components apart whose
    least ids are equal (null for an empty set)."""
    spark = docs.sparkSession
    common.ship(spark)
    bands = Bands(percent)
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("t"), F.xxhash64(text).alias("text_hash"))
    signed, signed_path = common.saved(plain.mapInArrow(_sign(k, bands), _SIGNED), "parity-signed")
    labels, done = _link(plain, signed, k, bands)
    classes = common.narrow(signed.where("n > 0").groupBy("n", "fp", "fp2").agg(F.min("doc_id").alias("rep")))
    labelled = classes.join(labels.select(F.col("node").alias("fp"), "root"), "fp", "left").select("n", "fp", "fp2", "rep", F.coalesce("root", "fp").alias("root"))
    labelled = common.narrow(labelled)
    least = common.narrow(labelled.groupBy("root").agg(F.min("rep").alias("component_id")))
    named = common.narrow(labelled.join(least, "root").select("n", "fp", "fp2", "root", "component_id"))
    whole = signed.select("doc_id", "text_hash", "n", "fp", "fp2")
    out = whole.where("n > 0").join(named, ["n", "fp", "fp2"]).select("doc_id", "text_hash", "n", "root", "component_id").unionByName(whole.where("n = 0").select("doc_id", "text_hash", "n", F.lit(None).cast("long").alias("root"), F.col("doc_id").alias("component_id")))
    result, _ = common.saved(out.select(F.col("doc_id").alias(doc_id), F.col("n").cast("long").alias("n_shingles"), "component_id", "text_hash", "root"), "parity-result")
    common.remove(spark, signed_path, *done)
    return result


# What _met says: two sets that share a small bucket; a set of a large one; a set at the edge of a partition.
_PAIR, _HOT, _EDGE = range(3)


def _met(percent: int):
    """Of rows (key, fp, n2) sorted by key and fp, with n2 twice a set's size and 1 more under the next scheme: pairs
    (a, b) of small buckets whose sizes fit, and rows (key, fp, n2) of large ones.

    A partition's first and last bucket may go on in another one: their rows are given out as edges, with one of n2 = -1
    if the bucket is large. Of a bucket no more rows are held than a small one has.
    """

    def rows(kind, key, fp, n2):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int32)), pa.array(key), pa.array(fp), pa.array(n2.astype(np.int32))], names=["kind", "a", "b", "n2"])

    def mark(key):
        return rows(_EDGE, np.array([key]), np.array([0]), np.array([-1]))

    def pairs(fp, n, first, count):
        for c in np.unique(count):
            at = first[count == c][:, None] + np.arange(c)
            i, j = np.triu_indices(c, 1)
            x, y = at[:, i].ravel(), at[:, j].ravel()
            fits = 100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y])
            yield fp[x[fits]], fp[y[fits]]

    def run(batches):
        held = [np.zeros(0, np.int64)] * 3
        begun = hot = last = None  # the first key; the large bucket whose rows pass by, and its last set so far
        for batch in batches:
            key, fp, n2 = (np.concatenate([h, batch.column(i).to_numpy().astype(np.int64)]) for i, h in enumerate(held))
            if not len(key):
                continue
            begun = key[0] if begun is None else begun
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (fp[1:] != fp[:-1])
            if hot is not None:
                new &= (key != hot) | (fp != last)
            key, fp, n2 = key[new], fp[new], n2[new]
            if hot is not None:
                more = int(np.searchsorted(key, hot, "right"))
                if more:
                    yield rows(_HOT, key[:more], fp[:more], n2[:more])
                    last = fp[more - 1]
                    key, fp, n2 = key[more:], fp[more:], n2[more:]
                if len(key):
                    hot = None
            held = [key, fp, n2]
            if not len(key):
                continue
            at = int(np.searchsorted(key, key[-1]))
            held = [key[at:], fp[at:], n2[at:]]
            if len(key) - at > SMALL_BUCKET:
                yield rows(_HOT, *held)
                hot, last, held = key[-1], fp[-1], [x[:0] for x in held]
                if hot == begun:
                    yield mark(begun)
            key, fp, n2 = key[:at], fp[:at], n2[:at]
            if not at:
                continue
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            count = np.diff(np.append(first, at))
            edge = key[first] == begun
            if edge[0]:
                if count[0] > SMALL_BUCKET:
                    yield mark(begun)
                else:
                    yield rows(_EDGE, key[: count[0]], fp[: count[0]], n2[: count[0]])
            large = np.repeat(count > SMALL_BUCKET, count)
            if large.any():
                yield rows(_HOT, key[large], fp[large], n2[large])
            small = (count > 1) & (count <= SMALL_BUCKET) & ~edge
            found = list(pairs(fp, n2 >> 1, first[small], count[small]))
            if found:
                both = np.unique(np.stack([np.concatenate([x[i] for x in found]) for i in (0, 1)], 1), axis=0) if len(found) > 1 or len(found[0][0]) > 1 else np.stack(found[0], 1)
                yield rows(_PAIR, both[:, 0], both[:, 1], np.zeros(len(both), np.int64))
        if len(held[0]):
            yield rows(_EDGE, *held)
        elif hot is not None and hot != begun:
            yield mark(hot)

    return run


def _group_links(bands: Bands):
    """For a group of sets: links (a, b) that join components, of all pairs within a cluster whose roots differ; if
    there are rows of side 1, of those between the two sides only."""
    percent = bands.percent

    def run(group: pa.Table) -> pa.Table:
        size = pa.compute.list_value_length(group["elements"].combine_chunks()).to_numpy()
        order = np.lexsort((size, group["cluster"].to_numpy()))
        fp, cluster, side = (group[c].to_numpy()[order] for c in ("fp", "cluster", "side"))
        label = np.unique(group["root"].to_numpy()[order], return_inverse=True)[1]
        size = size[order].astype(np.int64)
        lists = group["elements"].combine_chunks().take(pa.array(order))
        flat = lists.flatten().to_numpy().view(U64)
        cut = np.concatenate([[0], np.cumsum(size)])
        band = bands.of(size)
        links: list[tuple[int, int]] = []

        def gathered(pos):
            n = size[pos]
            ends = np.concatenate([[0], np.cumsum(n)])
            return flat[np.repeat(cut[pos] - ends[:-1], n) + np.arange(ends[-1])], ends

        def sketch(pos, scheme):
            h, ends = gathered(pos)
            return _sketches(h, ends, np.full(len(pos), bands.sketch_words[scheme])).values.to_numpy().view(U64).reshape(len(pos), -1)

        def test(i, cand):
            """Links i to the candidates whose sets are close enough, joining labels."""
            mine = flat[cut[i] : cut[i + 1]]
            while len(cand):
                part = cand[: max(1, int(np.searchsorted(np.cumsum(size[cand]), 1 << 18)))]
                cand = cand[len(part) :]
                theirs, ends = gathered(part)
                there = np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)
                common_n = np.diff(np.concatenate([[0], np.cumsum(mine[there] == theirs)])[ends])
                good = part[100 * common_n >= percent * (size[i] + size[part] - common_n)]
                if len(good):
                    gone, at = np.unique(label[good], return_index=True)
                    links.extend((i, j) for j in good[at].tolist())
                    label[np.isin(label, gone)] = label[i]
                    cand = cand[label[cand] != label[i]]

        two = bool(side.any())
        edges = np.append(np.flatnonzero(np.concatenate([[True], cluster[1:] != cluster[:-1]])), len(fp))
        for start, end in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            whole = np.arange(start, end)
            rows, columns = (whole[side[start:end] == 0], whole[side[start:end] == 1]) if two else (whole, whole)
            for v in np.unique(band[rows]).tolist():
                r = rows[band[rows] == v]
                for u in (v - 1, v, v + 1) if two else (v, v + 1):
                    c = columns[band[columns] == u]
                    if not len(c) or (len(r) == len(c) == 1 and r[0] == c[0]):
                        continue
                    x, y = sketch(r, max(u, v)), sketch(c, max(u, v))
                    low = np.searchsorted(100 * size[c], percent * size[r], "left")
                    high = np.searchsorted(percent * size[c], 100 * size[r], "right")
                    for at, i in enumerate(r.tolist()):
                        first = max(int(low[at]), at + 1) if u == v and not two else int(low[at])
                        near = first + np.flatnonzero(label[c[first : high[at]]] != label[i])
                        if len(near):
                            apart = np.bitwise_count(y[near] ^ x[at]).sum(1, dtype=np.int64)
                            near = c[near[(100 + percent) * apart <= (100 - percent) * (size[i] + size[c[near]])]]
                            test(i, near)
        at = np.array(links, np.int64).reshape(-1, 2)
        ends = np.sort(fp[at], 1)
        return pa.table({"a": ends[:, 0], "b": ends[:, 1]})

    return run


class _Clusters:
    """Clusters of sets that large buckets tie together, with their shingles."""

    def __init__(self, tied: DataFrame, sets: DataFrame, bands: Bands, keep):
        """``tied``: (key, fp) of the large buckets that count."""
        self.bands, self.keep = bands, keep
        hubs = common.narrow(tied.groupBy("key").agg(F.min("fp").alias("hub")))
        roots, path = components(common.narrow(tied.join(hubs, "key")).select(F.col("fp").alias("a"), F.col("hub").alias("b")).where("a <> b"))
        named = common.narrow(roots.select(F.col("node").alias("fp"), F.col("root").alias("cluster")))
        self.members = keep(common.narrow(sets.join(named, "fp")).select("fp", "cluster", F.size("elements").alias("n"), "elements"), "parity-members")
        common.remove(tied.sparkSession, path)
        self.weights = keep(common.narrow(self.members.groupBy("cluster").agg(F.sum("n").alias("weight"), *[F.min(F.struct(F.xxhash64("fp", F.lit(i)), "fp"))["fp"].alias(f"hub_{i}") for i in range(HUBS)])), "parity-weights")

    def _compared(self, rows: DataFrame) -> DataFrame:
        return common.narrow(rows.groupBy("whole", "i", "j").applyInArrow(_group_links(self.bands), "a long, b long"))

    def within(self) -> DataFrame:
        """Links found within blocks, and between their members and the hubs."""
        total = self.weights.agg(F.sum("weight")).first()[0] or 0
        bins = F.lit(max(1, 2 * total // BLOCK_SHINGLES))
        rows = common.narrow(self.members.join(self.weights.select("cluster", "weight"), "cluster"))
        columns = ("fp", F.col("fp").alias("root"), "cluster", F.lit(0).alias("side"), "elements")
        small = rows.where(F.col("weight") <= BLOCK_SHINGLES).select(F.lit(-1).cast("long").alias("whole"), F.pmod(F.xxhash64("cluster"), bins).alias("i"), F.lit(0).alias("j"), *columns)
        blocks = F.ceil(F.col("weight") / BLOCK_SHINGLES)
        own = F.pmod(F.xxhash64("fp"), blocks)
        large = rows.where(F.col("weight") > BLOCK_SHINGLES)
        dealt = large.select(F.col("cluster").alias("whole"), own.alias("i"), F.lit(0).alias("j"), *columns)
        hubs = self.weights.where(F.col("weight") > BLOCK_SHINGLES).select("weight", F.explode(F.array_distinct(F.array(*[f"hub_{i}" for i in range(HUBS)]))).alias("fp"))
        lent = common.narrow(hubs.join(self.members, "fp")).withColumns({"own": own, "i": F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))}).where("own <> i")
        return self._compared(small.unionByName(dealt).unionByName(lent.select(F.col("cluster").alias("whole"), "i", F.lit(0).alias("j"), *columns)))

    def across(self, roots: DataFrame | None) -> DataFrame | None:
        """Links between components of clusters of several blocks; None if each of these is one component."""
        several = self.weights.where(F.col("weight") > BLOCK_SHINGLES)
        if several.isEmpty():
            return None
        rooted = _rooted(self.members.join(several.select("cluster"), "cluster").select("fp", "cluster", "n"), roots, "fp", "root")
        shares = common.narrow(rooted.groupBy("cluster", "root").agg(F.sum("n").alias("share")))
        sums = shares.groupBy("cluster").agg(F.max(F.struct("share", "root"))["root"].alias("main"), F.sum("share").alias("weight"), (F.sum("share") - F.max("share")).alias("apart"))
        split = self.keep(common.narrow(sums.where("apart > 0")), "parity-split")
        if split.isEmpty():
            return None
        blocks = lambda c: F.ceil(F.col(c) / BLOCK_SHINGLES)
        of = lambda salt, c: F.pmod(F.xxhash64("fp", F.lit(salt)), blocks(c))
        dealt = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), blocks(c) - 1))
        rows = common.narrow(common.narrow(rooted.select("fp", "root")).join(self.members, "fp").join(split, "cluster"))
        columns = ("fp", "root", "cluster", "side", "elements")
        others = rows.withColumns({"whole": F.col("cluster"), "i": dealt("apart"), "j": of(5, "weight"), "side": F.lit(1)})
        apart = rows.where("root <> main").withColumns({"whole": F.col("cluster"), "i": of(6, "apart"), "j": dealt("weight"), "side": F.lit(0)})
        return self._compared(others.select("whole", "i", "j", *columns).unionByName(apart.select("whole", "i", "j", *columns)))


def _rooted(df: DataFrame, roots: DataFrame | None, node: str, name: str) -> DataFrame:
    """Adds the component that a node is in."""
    if roots is None:
        return df.withColumn(name, F.col(node))
    there = roots.select(F.col("node").alias(node), F.col("root").alias("_root"))
    return common.narrow(df.join(there, node, "left")).withColumn(name, F.coalesce("_root", node)).drop("_root")


def _meetings(signed: DataFrame, percent: int, keep) -> tuple[DataFrame, DataFrame]:
    """Distinct pairs (a, b) of sets that share a small bucket, and (key, fp, half) of the sets in large ones."""
    keyed = lambda keys, half: signed.where("leads").select(F.explode(keys).alias("key"), "fp", (2 * F.col("n") + half).alias("n2"))
    ordered = keyed("keys", 0).unionByName(keyed("next_keys", 1)).repartitionByRange("key", "fp").sortWithinPartitions("key", "fp")
    met = keep(ordered.mapInArrow(_met(percent), "kind int, a long, b long, n2 int"), "parity-met")
    # at most two buckets of a partition: of each, no more rows than a small one has
    edges = met.where(F.col("kind") == _EDGE).select(F.col("a").alias("key"), F.col("b").alias("fp"), "n2")
    totals = edges.groupBy("key").agg(F.count_if(F.col("n2") >= 0).alias("many"), F.max(F.col("n2") < 0).alias("large"))
    cut = keep(common.narrow(edges.where("n2 >= 0").join(common.narrow(totals), "key")).select("key", "fp", "n2", (F.col("large") | (F.col("many") > SMALL_BUCKET)).alias("large")), "parity-edges")
    one, two = (cut.where("NOT large").select("key", F.col("fp").alias(x), F.shiftright("n2", 1).alias(f"n_{x}")) for x in ("a", "b"))
    fits = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    pairs = met.where(F.col("kind") == _PAIR).select("a", "b").unionByName(one.join(two, "key").where((F.col("a") < F.col("b")) & fits).select("a", "b"))
    hot = met.where(F.col("kind") == _HOT).select(F.col("a").alias("key"), F.col("b").alias("fp"), "n2").unionByName(cut.where("large").select("key", "fp", "n2"))
    return common.narrow(pairs.distinct()), hot.select("key", "fp", F.col("n2").bitwiseAND(F.lit(1)).alias("half"))


def _link(plain: DataFrame, signed: DataFrame, k: int, bands: Bands) -> tuple[DataFrame, list[str]]:
    """(node, root) of the linked sets, and the folders to remove once it has been used."""
    spark = plain.sparkSession
    folders: list[str] = []

    def keep(df: DataFrame, name: str) -> DataFrame:
        df, path = common.saved(df, name)
        folders.append(path)
        return df

    pairs, hot = _meetings(signed, bands.percent, keep)
    pairs = keep(pairs, "parity-pairs")
    ends = lambda p: p.select(F.col("a").alias("fp")).unionByName(p.select(F.col("b").alias("fp")))
    met = common.narrow(ends(pairs).unionByName(hot.select("fp")).distinct())
    own = signed.where("leads").join(met, "fp", "left_semi").groupBy("fp").agg(F.min(F.struct("text_hash", "n", "band", "own", "following", "room", "next_room")).alias("x"))
    nodes = keep(common.narrow(own.select("fp", "x.*")), "parity-nodes")
    room = nodes.select("fp", F.explode(F.array(F.struct(F.lit(0).alias("half"), F.col("room").alias("room")), F.struct(F.lit(1).alias("half"), F.col("next_room").alias("room")))).alias("x")).select("fp", "x.*")
    bound = common.narrow(common.narrow(hot.groupBy("fp", "half").agg(F.count("*").alias("hot"))).join(room, ["fp", "half"]).where("hot > room").select("fp", "half"))
    tied = keep(common.narrow(hot.join(bound, ["fp", "half"], "left_semi")).select("key", "fp"), "parity-tied")
    verifier = _Verifier(nodes, bands.percent)
    near = keep(verifier.near(pairs), "parity-near")
    wanted = keep(common.narrow(nodes.join(common.narrow(ends(near).unionByName(tied.select("fp")).distinct()), "fp", "left_semi").select("text_hash", "fp")), "parity-wanted")
    rows = wanted.count()
    # a node's text is found by its hash: ids may be null or repeat
    docs = plain.join(common.maybe_broadcast(wanted.select("text_hash").distinct(), rows, 16), "text_hash", "left_semi").select("text_hash", "t")
    sets = keep(common.narrow(docs.mapInArrow(_sets(k), "fp long, elements array<long>").join(common.maybe_broadcast(wanted.select("fp"), rows, 16), "fp", "left_semi").dropDuplicates(["fp"])), "parity-sets")
    clusters = None if tied.isEmpty() else _Clusters(tied, sets, bands, keep)
    pick = keep(common.narrow(near.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")), "parity-pick")
    found = verifier.linked(pick, sets)
    links = keep(found if clusters is None else found.unionByName(clusters.within()), "parity-links")
    roots, path = components(links)
    folders.append(path)
    rest = _rooted(_rooted(near.select("a", "b"), roots, "a", "root_a"), roots, "b", "root_b").where("root_a <> root_b").select("a", "b")
    more = verifier.linked(keep(common.narrow(rest.join(pick, ["a", "b"], "left_anti")), "parity-rest"), sets)
    across = None if clusters is None else clusters.across(roots)
    more = keep(more if across is None else more.unionByName(across), "parity-more")
    if not more.isEmpty():
        roots, path = components(links.unionByName(more))
        folders.append(path)
    return roots, folders
