"""N-gram Jaccard join by a partition of the universe, with the pigeonhole principle.

Two sets of shingles link when 100 * |A and B| >= percent * |A or B|. Then their symmetric difference is at most
H = (100 - percent) * (|A| + |B|) / (100 + percent). Sizes fall into bands; in a band the universe of hashes is cut into
m > H segments, so of two linked sets at least m - H segments are alike. Every set is indexed by its segments under its own
band and looks up smaller sets under the bands below.

- Documents with one and the same set are one class; only classes take part, and members get their class's result.
- Cost-based allocation: m has segments to spare, so a segment whose list is long (`HOT` classes) is allotted nothing while
  a set keeps H + 1 others. A long list sends links to its smallest class only, and its members are kept aside.
- One-deletion neighbourhoods: empty segments are never indexed. A set with more empty segments than are to spare is also
  indexed by its segments and by each of them less one shingle, so that a segment may differ by one and counts double; if
  even that is less than the band's largest H, plus 1, the set joins the list of all such sets of its band.
- Signatures travel packed: a block of texts sends each bucket (a range of signatures) one row of sorted differences. A
  bucket holds `BUCKET` signatures on average, whatever the input, and is settled by itself.
- Candidates are first held to what is cheap: sizes, and the shingles that fall into each of 64 cells, whose differences
  add up to no more than the symmetric difference. Sets are read again only for pairs that pass, and compared whole.
- What long lists may have hidden: for sets that had fewer than H + 1 short lists, and lists that still hold several
  components, the lists' members are compared block by block as matrices of 0 and 1. That is the method's worst case.

Words and shingles stand as 64-bit hashes: the join is exact on these, and two different shingles of two documents count as
one only where their hashes meet.

Documents without words have no shingles and link with nothing. Rows with a null id get their figures, but no component
and no part in links; rows that share an id are one node. Empty tables give empty results; other columns don't matter."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, dropped, fresh, text_or_empty, written
from .graph import connected
from .shingles import mix, shingle_sets, sums

#: A list of more classes is long.
HOT = 8
PAIR, HOT_OWN, HOT_LOWER, SPARE = 0, 1, 2, 3
BAND_RATIO = 1.3
#: More segments than any set has.
MANY = 1 << 28
#: Bytes of text that a task indexes at a time, and signatures of a bucket on average.
TEXTS, BUCKET = 12 << 20, 2 << 20
#: Cells of a set's sketch, four to a long.
CELLS = 64
SKETCH = [f"s{i}" for i in range(CELLS // 4)]
#: Classes, shingles and columns of a block's matrix.
BLOCK, BLOCK_SHINGLES, COLUMNS = 1000, 1 << 20, 8192
#: Ids that may be looked up without a filter before, and bits of such a filter at most.
FEW, MOST_BITS = 1 << 14, 1 << 27
#: Sets are kept by ranges of hashes; pairs are compared a range at a time, so that a shuffle holds that part of the sets.
PARTS = ["set0", "set1", "set2", "set3"]
#: Blocks apart of the pairs of blocks that are compared at a time: a set is sent to twice as many pairs at most.
APART = 4


@dataclass(frozen=True)
class Scheme:
    """Bands of set sizes and segments of each band."""

    percent: int

    def differ(self, total: int | np.ndarray) -> int | np.ndarray:
        """The largest symmetric difference of two linked sets whose sizes add up to total."""
        return (100 - self.percent) * total // (100 + self.percent)

    def smallest(self, n: np.ndarray) -> np.ndarray:
        """The size of the smallest set that may link with a set of size n."""
        return -(-self.percent * n // 100)

    def bands(self, largest: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of bands and their numbers of segments; 0 segments where only equal sets link."""
        starts = [1]
        while starts[-1] <= largest:
            starts.append(max(starts[-1] + 1, int(starts[-1] * BAND_RATIO)))
        s = np.array(starts, np.int64)
        top = s[1:] - 1
        most = self.differ(top + 100 * top // self.percent)
        return s, np.where(most > 0, most + 1 + self.spare(most), 0)

    def spare(self, most: np.ndarray) -> np.ndarray:
        return 2 + most // 8


def signatures(bounds: np.ndarray, hashes: np.ndarray, scheme: Scheme) -> dict[str, np.ndarray]:
    """Of every set: lists to join (set's place, kind, signature) and how many segments it has beyond H + 1, under its own
    band and the least under a lower one."""
    n = np.diff(bounds)
    starts, segments = scheme.bands(int(n.max(initial=1)))
    own = np.searchsorted(starts, n, side="right") - 1
    lowest = np.searchsorted(starts, np.maximum(scheme.smallest(n), 1), side="right") - 1
    mixed = mix(hashes, 11)
    places, kinds, sigs = [], [], []
    spare = {HOT_OWN: np.full(len(n), 1 << 30, np.int64), HOT_LOWER: np.full(len(n), 1 << 30, np.int64)}
    for down in range(0, int((own - lowest).max(initial=0)) + 1):
        band = own - down
        use = np.flatnonzero((n > 0) & (band >= lowest) & (band >= 0) & (segments[np.maximum(band, 0)] > 0))
        if not len(use):
            continue
        kind = HOT_LOWER if down else HOT_OWN
        size, m, b = n[use], segments[band[use]], band[use]
        at = np.repeat(bounds[use], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        of = np.repeat(np.arange(len(use)), size)
        seg = ((hashes[at] >> np.uint64(32)) * m[of].astype(np.uint64)) >> np.uint64(32)
        new = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (seg[1:] != seg[:-1])]))
        edges = np.concatenate([new, [len(of)]])
        name = mix((b[of[new]].astype(np.uint64) << np.uint64(32)) + seg[new], 13)
        whole = sums(mixed[at], edges)
        places.append(use[of[new]])
        kinds.append(np.full(len(new), kind))
        sigs.append(mix(whole + name, 17))
        filled = np.bincount(of[new], minlength=len(use))
        partner = np.minimum(size, starts[b + 1] - 1)
        need = scheme.differ(size + partner) + 1
        np.minimum.at(spare[kind], use, filled - need)
        # Pairs that share empty segments only have at least m - H of them in both sets.
        most = scheme.differ(starts[b + 1] - 1 + 100 * (starts[b + 1] - 1) // scheme.percent)
        scarce = m - filled >= m - most
        if scarce.any():
            count = np.diff(edges)
            rows = scarce[of[new]]
            places.append(use[of[new[rows]]])
            kinds.append(np.full(rows.sum(), kind))
            sigs.append(mix(whole[rows] + name[rows], 19))
            several = np.repeat(rows & (count > 1), count)
            owner = np.repeat(np.arange(len(new)), count)[several]
            places.append(use[of[new[owner]]])
            kinds.append(np.full(len(owner), kind))
            sigs.append(mix(whole[owner] - mixed[at][several] + name[owner], 19))
            reach = np.bincount(of[new], weights=np.where(count > 1, 2, 1), minlength=len(use))
            # The partner may be larger than `need` assumes, and both sets of a pair must be in the list.
            rest = use[scarce & (reach < most + 1)]
            places.append(rest)
            kinds.append(np.full(len(rest), kind))
            sigs.append(mix(band[rest].astype(np.uint64), 23))
    empty = np.empty(0, np.int64)
    return {"place": np.concatenate(places or [empty]), "kind": np.concatenate(kinds or [empty]), "sig": np.concatenate(sigs or [empty.astype(np.uint64)]), "spare_own": spare[HOT_OWN], "spare_lower": spare[HOT_LOWER]}


def lists(sig: np.ndarray, key: np.ndarray, kind: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct (sig, key) in order, with the smallest kind and hot if any row is, and the bounds of the lists."""
    order = np.lexsort((kind, key, sig))
    sig, key, kind, hot = sig[order], key[order], kind[order], hot[order]
    first = np.flatnonzero(np.concatenate([[True], (sig[1:] != sig[:-1]) | (key[1:] != key[:-1])])) if len(sig) else np.empty(0, np.int64)
    hot = np.maximum.reduceat(hot, first) if len(first) else hot
    sig, key, kind = sig[first], key[first], kind[first]
    starts = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])) if len(sig) else np.empty(0, np.int64)
    return sig, key, kind, hot, np.concatenate([starts, [len(sig)]])


def paired(sig: np.ndarray, key: np.ndarray, kind: np.ndarray, hot: np.ndarray, final: bool) -> tuple[list[np.ndarray], np.ndarray]:
    """Rows (kind, a, b, hot) that lists give, and which distinct rows still go on (kept aside for the next level).
    A short list gives all its pairs, at the final level only. A long one links its members with its smallest and is kept aside."""
    sig, key, kind, hot, bounds = lists(sig, key, kind, hot)
    size = np.diff(bounds)
    is_hot = np.maximum.reduceat(hot, bounds[:-1]) > 0 if len(size) else np.empty(0, bool)
    long = (size > HOT) | is_hot
    out: list[np.ndarray] = []
    of = np.repeat(np.arange(len(size)), size)
    smallest = key[bounds[:-1]][of] if len(size) else key
    in_long = long[of] if len(size) else np.empty(0, bool)
    star = in_long & (key != smallest)
    out.append(np.stack([np.full(star.sum(), PAIR, np.int64).view(np.uint64), smallest[star], key[star]]))
    out.append(np.stack([kind[in_long].astype(np.int64).view(np.uint64), sig[in_long], key[in_long]]))
    if final:
        for k in range(2, HOT + 1):
            at = bounds[:-1][(size == k) & ~long]
            for i in range(k):
                for j in range(i + 1, k):
                    out.append(np.stack([np.full(len(at), PAIR, np.int64).view(np.uint64), key[at + i], key[at + j]]))
    go = ~in_long
    go[bounds[:-1][long]] = True
    return out, np.stack([sig[go], key[go], kind[go].astype(np.int64).view(np.uint64), in_long[go].astype(np.uint64)])


ROWS = "kind int, a long, b long"
#: A packed row: signatures of one kind (below 4; 4 more for long lists) that fall into one bucket, or finished rows (8 more).
PACKED = "bucket int, kind int, a binary, b binary, keys binary"


def planes(x: np.ndarray) -> bytes:
    """Numbers by bytes of one rank, so that the high ones, mostly zero, compress."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def from_planes(raw: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).view(kind).ravel()


def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct columns, in order."""
    x = x[:, np.lexsort(x[::-1])]
    return x[:, np.concatenate([np.ones(min(1, x.shape[1]), bool), (x[:, 1:] != x[:, :-1]).any(axis=0)])]


def bucket_of(x: np.ndarray, buckets: int) -> np.ndarray:
    return ((x >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def packed(done: np.ndarray, go: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Finished rows (kind, a, b) and signatures (sig, key, kind, hot) of a block as packed rows."""
    out: list[tuple] = []
    place = bucket_of(mix(done[1] + mix(done[2], 3), 43), buckets)
    done = distinct(np.stack([place, *done]))
    edges = np.flatnonzero(np.concatenate([[True], (done[:2, 1:] != done[:2, :-1]).any(axis=0), [True]])) if done.shape[1] else [0]
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        bucket, kind = done[:2, lo]
        out.append((int(bucket), 8 + int(kind), done[2, lo:hi].tobytes(), done[3, lo:hi].tobytes(), None))
    flag = go[2] + np.uint64(4) * go[3]
    for kind in np.unique(flag):
        sig, key = go[:2, flag == kind]
        order = np.argsort(sig, kind="stable")
        sig, key = sig[order], key[order]
        place = bucket_of(sig, buckets)
        edges = np.concatenate([np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])), [len(sig)]])
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            keys, at = np.unique(key[lo:hi], return_inverse=True)
            steps = np.diff(sig[lo:hi], prepend=np.uint64(0))
            out.append((int(place[lo]), int(kind), planes(steps), planes(at.astype(np.uint32)), keys.tobytes()))
    cols = list(zip(*out, strict=True)) or [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[2:])], names=["bucket", "kind", "a", "b", "keys"])


def unpacked(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """The finished rows (kind, a, b) and signatures (sig, key, kind, hot) of packed rows (kind, a, b, keys)."""
    done, go = [np.empty((3, 0), np.uint64)], [np.empty((4, 0), np.uint64)]
    for kind, a, b, keys in rows:
        if kind >= 8:
            x = np.frombuffer(a, np.uint64)
            done.append(np.stack([np.full(len(x), kind - 8, np.uint64), x, np.frombuffer(b, np.uint64)]))
        else:
            sig = np.cumsum(from_planes(a, np.uint64), dtype=np.uint64)
            key = np.frombuffer(keys, np.uint64)[from_planes(b, np.uint32)]
            go.append(np.stack([sig, key, np.full(len(sig), kind % 4, np.uint64), np.full(len(sig), kind // 4, np.uint64)]))
    return np.concatenate(done, axis=1), np.concatenate(go, axis=1)


def _rows(done: np.ndarray) -> Iterator[pa.RecordBatch]:
    step = 200_000
    for i in range(0, done.shape[1], step):
        kind, a, b = done[:, i : i + step]
        yield pa.RecordBatch.from_arrays([pa.array(kind.astype(np.int32)), *(pa.array(np.ascontiguousarray(x).view(np.int64)) for x in (a, b))], names=["kind", "a", "b"])


def _binary(column: pa.Array) -> list[bytes]:
    return column.cast(pa.binary()).to_pylist()


def set_keys(bounds: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that name a set."""
    return mix(sums(mix(hashes, 29), bounds), 31), mix(sums(mix(hashes, 37), bounds), 41)


def sketches(bounds: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """How many shingles of each set fall into each cell, up to 65,535, as longs of four cells."""
    n = len(bounds) - 1
    cell = np.repeat(np.arange(n), np.diff(bounds)) * CELLS + (mix(hashes, 47) % np.uint64(CELLS)).astype(np.int64)
    counts = np.minimum(np.bincount(cell, minlength=n * CELLS), 65535).astype(np.uint16)
    return counts.reshape(n, CELLS).view(np.int64)


def summaries(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, k1, k2 and the sketch of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text", 4 << 20):
            bounds, hashes = shingle_sets(_binary(batch.column("text")), k)
            k1, k2 = set_keys(bounds, hashes)
            cells = sketches(bounds, hashes)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(bounds)), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), *(pa.array(np.ascontiguousarray(c)) for c in cells.T)], names=["doc_id", "n_shingles", "k1", "k2", *SKETCH])

    return docs.mapInArrow(sketch, f"doc_id {kind}, n_shingles long, k1 long, k2 long, " + ", ".join(f"{c} long" for c in SKETCH))


def candidate_rows(docs: DataFrame, scheme: Scheme, k: int, buckets: int) -> DataFrame:
    """Rows (kind, a, b): PAIR of two classes' k1 (a < b); a class (b) that a long list (a) holds; and SPARE, how many
    segments a class (a) has to spare under its own and the lower bands (high and low half of b). Lists are folded in each
    block before the shuffle."""
    half = lambda spare: np.clip(spare, -MANY, MANY) + MANY

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in merged(batches, TEXTS):
            bounds, hashes = shingle_sets(texts, k)
            k1, _ = set_keys(bounds, hashes)
            _, first = np.unique(k1, return_index=True)  # copies in a block count once
            if len(first) < len(k1):
                first.sort()
                hashes = np.concatenate([hashes[bounds[i] : bounds[i + 1]] for i in first]) if len(first) else hashes[:0]
                bounds = np.concatenate([[0], np.cumsum(np.diff(bounds)[first])])
                k1 = k1[first]
            got = signatures(bounds, hashes, scheme)
            out, go = paired(got["sig"], k1[got["place"]], got["kind"], np.zeros(len(got["sig"]), np.int64), final=False)
            spare = ((half(got["spare_own"]) << 32) | half(got["spare_lower"])).view(np.uint64)
            out.append(np.stack([np.full(len(k1), SPARE, np.uint64), k1, spare]))
            yield packed(np.concatenate(out, axis=1), go, buckets)

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        last = None

        def settled() -> Iterator[pa.RecordBatch]:
            done, go = unpacked(held)
            held.clear()
            out, _ = paired(go[0], go[1], go[2].view(np.int64), go[3].view(np.int64), final=True)
            yield from _rows(distinct(np.concatenate([done, *out], axis=1)))

        for batch in batches:
            for bucket, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != last and held:
                    yield from settled()
                last = bucket
                held.append(tuple(row))
        if held:
            yield from settled()

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.select("text").mapInArrow(local, PACKED).repartitionById(parts, F.col("bucket")).sortWithinPartitions("bucket")
    return dealt.mapInArrow(final, ROWS).distinct()


def merged(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[bytes]]:
    held: list[bytes] = []
    n = 0
    for batch in blocks(batches, "text", most):
        texts = _binary(batch.column("text"))
        more = sum(map(len, texts))
        if held and n + more > most:
            yield held
            held, n = [], 0
        held, n = held + texts, n + more
    if held:
        yield held


def plausible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b: k1) that sizes and sketches do not rule out. Both sides of each join are scans, so AQE splits a class
    that many pairs name."""
    cells = F.array(*SKETCH)
    left = classes.select(F.col("k1").alias("ka"), F.col("rep").alias("ra"), F.col("n").alias("na"), cells.alias("sa"))
    right = classes.select(F.col("k1").alias("kb"), F.col("rep").alias("rb"), F.col("n").alias("nb"), cells.alias("sb"))
    sized = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    both = pairs.join(left, pairs["a"] == left["ka"]).join(right, (F.col("b") == right["kb"]) & sized).where("ra <> rb").select("a", "b", "na", "nb", "sa", "sb")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = (batch.column(c).to_numpy() for c in ("na", "nb"))
            sa, sb = (batch.column(c).flatten().to_numpy().view(np.uint16).reshape(-1, CELLS).astype(np.int64) for c in ("sa", "sb"))
            keep = pa.array(np.abs(sa - sb).sum(axis=1) <= Scheme(percent).differ(na + nb))
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    return both.mapInArrow(compare, "a long, b long").distinct()


def likely(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """docs (doc_id) less most of those whose id is not among wanted (rep), by one bit of an id's hash in a row of bits that
    is broadcast, 16 to 32 for each id: a join of what is left with a large table shuffles few other texts."""
    n = wanted.count()
    if n <= FEW:
        return docs
    bits = min(MOST_BITS, 1 << (16 * n).bit_length())
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    set_ = wanted.select(place("rep").alias("p")).groupBy(F.shiftright("p", 6).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 AS int))")).alias("mask")).toArrow()
    words = np.zeros(-(-bits // 64), np.int64)
    words[set_.column("word").to_numpy()] = set_.column("mask").to_numpy()
    row = docs.sparkSession.createDataFrame([(words.tolist(),)], "bits array<long>")
    at = place("doc_id")
    return docs.crossJoin(F.broadcast(row)).where(F.getbit(F.get("bits", F.shiftright(at, 6).cast("int")), at.bitwiseAND(63).cast("int")) == 1).drop("bits")


def sets_of(docs: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """A written table of rep, k1, k2, n and the set (sorted 64-bit hashes, packed, by PARTS) of some classes (k1, k2, rep),
    read again from their documents."""
    # A table's size is known to the planner: below Spark's threshold it is broadcast and no text is shuffled.
    wanted = written(classes.select("rep").distinct(), "join-wanted")
    rows = likely(docs, wanted).join(wanted, F.col("doc_id") == F.col("rep")).select("rep", "text")
    kind = rows.schema["rep"].dataType.simpleString()
    cuts = np.arange(1, len(PARTS), dtype=np.uint64) * np.uint64(2**64 // len(PARTS))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text", 4 << 20):
            bounds, hashes = shingle_sets(_binary(batch.column("text")), k)
            k1, k2 = set_keys(bounds, hashes)
            own = [hashes[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            edges = [[0, *np.searchsorted(x, cuts).tolist(), len(x)] for x in own]
            parts = [pa.array([x[e[i] : e[i + 1]].tobytes() for x, e in zip(own, edges, strict=True)], pa.binary()) for i in range(len(PARTS))]
            yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.array(np.diff(bounds)), *parts], names=["rep", "k1", "k2", "n", *PARTS])

    made = rows.mapInArrow(make, f"rep {kind}, k1 long, k2 long, n long, " + ", ".join(f"{c} binary" for c in PARTS))
    # Rows that share an id may hold other sets; a class is read once.
    out = written(made.join(classes.select("rep", "k1", "k2"), ["rep", "k1", "k2"], "left_semi").dropDuplicates(["rep", "k1", "k2"]), "join-sets")
    dropped(wanted)
    return out


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """A written table of the linked pairs (a, b: representatives) among pairs (a, b: k1), by exact comparison. Common
    shingles are counted in one range of hashes after the other: a set crosses two shuffles, which so hold a part of it.
    Both sides of each join are scans, so AQE splits a class that many pairs name."""
    names = [f"{c}{side}" for side in "ab" for c in ("r", "k", "x", "n")]
    kind = sets.schema["rep"].dataType.simpleString()
    steps = []
    for part in PARTS:
        left, right = (sets.select(F.col("rep").alias(f"r{s}"), F.col("k1").alias(f"k{s}"), F.col("k2").alias(f"x{s}"), F.col("n").alias(f"n{s}"), F.col(part).alias(f"s{s}")) for s in "ab")
        both = pairs.join(left, pairs["a"] == left["ka"]).join(right, F.col("b") == right["kb"]).where("ra <> rb").select(*names, "sa", "sb")

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                common = []
                for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), strict=True):
                    s, t = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                    at = np.searchsorted(t, s)
                    common.append(int((t[at[at < len(t)]] == s[at < len(t)]).sum()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(common, pa.int64())], names=[*names, "common"])

        steps.append(written(both.mapInArrow(compare, ", ".join(f"{c} {kind if c[0] == 'r' else 'long'}" for c in names) + ", common long"), "join-common"))
    whole = functools.reduce(DataFrame.unionByName, steps).groupBy(*names).agg(F.sum("common").alias("common"))
    out = written(whole.where(100 * F.col("common") >= percent * (F.col("na") + F.col("nb") - F.col("common"))).select(F.col("ra").alias("a"), F.col("rb").alias("b")), "join-links")
    dropped(*steps)
    return out


def join_classes(df: DataFrame, id_col: str, text_col: str, k: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The table of rows (doc_id, n_shingles, k1, k2, sketch), the classes (k1, k2, rep, n, sketch) and the links between
    classes' representatives (a, b)."""
    spark, scheme = df.sparkSession, Scheme(percent)
    docs = df.select(F.col(f"`{id_col}`").alias("doc_id"), text_or_empty(text_col).alias("text"))
    found = written(summaries(docs, k), "join-rows")
    docs = docs.where(F.col("doc_id").isNotNull())
    by = found.where("doc_id IS NOT NULL AND n_shingles > 0").groupBy("k1", "k2")
    classes = written(by.agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n"), *(F.max(c).alias(c) for c in SKETCH)), "join-classes")
    shingles = classes.agg(F.sum("n")).first()[0] or 0
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = parts * max(1, -(-shingles // (parts * BUCKET)))  # a set has about as many signatures as shingles
    rows = written(candidate_rows(docs, scheme, k, buckets), "join-candidates")
    alike = classes.groupBy("k1").agg(F.count("*").alias("n")).where("n > 1").select(F.col("k1").alias("a"), F.col("k1").alias("b"))
    pairs = written(plausible(rows.where(F.col("kind") == PAIR).select("a", "b").unionByName(alike), classes, percent), "join-pairs")
    named = pairs.select(F.col("a").alias("k1")).union(pairs.select("b")).distinct()
    sets = sets_of(docs, classes.join(named, "k1", "left_semi"), k)
    links = verified(pairs, sets, percent)
    dropped(pairs, sets)
    if rows.where(F.col("kind").isin(HOT_OWN, HOT_LOWER)).isEmpty():
        dropped(rows)
        return found, classes, links
    more = hidden(docs, rows, classes, links, scheme, k)
    dropped(rows)
    return found, classes, links.unionByName(more)


def hidden(docs: DataFrame, rows: DataFrame, classes: DataFrame, links: DataFrame, scheme: Scheme, k: int) -> DataFrame:
    """Links that long lists (of rows) may have hidden: between components of links, where one of the two sets had too few
    short lists."""
    hot = rows.where(F.col("kind").isin(HOT_OWN, HOT_LOWER))
    spare = rows.where(F.col("kind") == SPARE).select(F.col("a").alias("k1"), (F.shiftright("b", 32) - MANY).alias("spare_own"), (F.col("b").bitwiseAND((1 << 32) - 1) - MANY).alias("spare_lower"))
    lost = hot.groupBy(F.col("b").alias("k1")).agg(*(F.sum((F.col("kind") == c).cast("int")).alias(n) for c, n in ((HOT_OWN, "own"), (HOT_LOWER, "lower"))))
    few = spare.join(lost, "k1").where("own > spare_own OR lower > spare_lower").select("k1").distinct()
    labels = connected(links)
    reps = classes.groupBy("k1").agg(F.min("rep").alias("rep"))
    named = reps.join(labels, reps["rep"] == labels["node"], "left").select("k1", F.coalesce("component", "rep").alias("component"))
    members = hot.select("a", F.col("b").alias("k1")).distinct().join(named, "k1").join(few.withColumn("few", F.lit(True)), "k1", "left")
    members = written(members.withColumn("few", F.coalesce("few", F.lit(False))), "join-hot")
    mixed = members.groupBy("a").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.max("few").alias("any")).where("low <> high AND any").select("a")
    left = written(members.join(mixed, "a", "left_semi"), "join-mixed")
    groups = connected_lists(left)
    sets = sets_of(docs, classes.join(groups.select("k1").distinct(), "k1", "left_semi"), k)
    out = between_blocks(groups.join(classes.groupBy("k1").agg(F.max("n").alias("n")), "k1"), sets, scheme.percent)
    dropped(members, left, groups, sets, labels)
    return out


def connected_lists(members: DataFrame) -> DataFrame:
    """k1, component and group of the members of lists (a, k1): lists that share members are one group."""
    lists_ = members.groupBy("a").agg(F.min("k1").alias("low"))
    ties = members.join(lists_, "a").select(F.col("low").alias("a"), F.col("k1").alias("b"))
    labels = connected(ties).select(F.col("node").alias("k1"), F.col("component").alias("grp"))
    return written(members.select("k1", "component", "few").distinct().join(labels, "k1"), "join-groups")


def between_blocks(groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between components of a group (k1, component, few, grp, n). A group is cut into blocks of `BLOCK` classes or
    `BLOCK_SHINGLES` shingles, and a task compares two blocks at a time: a product of two 0-1 matrices counts the common
    shingles of all their pairs. Blocks that are near each other by number come first, so a step sends a set to few tasks.
    It returns links that tie components together, one fewer than components at most, and never the pairs themselves."""
    kind = sets.schema["rep"].dataType.simpleString()
    sizes = groups.groupBy("grp").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    most = sizes.agg(F.max("blocks")).first()[0] or 0
    dealt = groups.join(sizes, "grp").withColumn("own", F.pmod(F.xxhash64("k1"), F.col("blocks")).cast("int"))
    full = dealt.join(sets.select("k1", "rep", F.concat(*PARTS).alias("set")), "k1")

    def near(low: int) -> DataFrame:
        """Sets, once for each pair of blocks that are low to low + APART - 1 apart."""
        others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.abs(x - F.col("own")).between(low, low + APART - 1))
        return full.where(F.col("blocks") > low).withColumn("other", F.explode(others)).select("grp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "component", "rep", "set")

    def compare(pdf):  # noqa: ANN001, ANN202
        import pandas as pd

        pdf = pdf.sort_values("rep", kind="stable")
        sets_ = [np.frombuffer(x, "<u8") for x in pdf["set"]]
        n = np.array([len(x) for x in sets_])
        _, at, held = np.unique(np.concatenate(sets_), return_inverse=True, return_counts=True)
        shared = held > 1  # a shingle of one set alone is common to no pair
        row, at = np.repeat(np.arange(len(sets_)), n)[shared[at]], (np.cumsum(shared) - 1)[at[shared[at]]]
        common = np.zeros((len(sets_), len(sets_)), np.float32)
        for low in range(0, int(at.max(initial=-1)) + 1, COLUMNS):  # a bounded part of the universe at a time
            use = (at >= low) & (at < low + COLUMNS)
            part = np.zeros((len(sets_), COLUMNS), np.float32)
            part[row[use], at[use] - low] = 1
            common += part @ part.T
        linked = 100 * common >= percent * (n[:, None] + n[None, :] - common)
        parent: dict = {}

        def root(x):  # noqa: ANN001, ANN202
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        comp, rep, out = pdf["component"].to_numpy(), pdf["rep"].to_numpy(), []
        for x, y in zip(*np.nonzero(np.triu(linked, 1)), strict=True):
            p, q = root(comp[x]), root(comp[y])
            if p != q:
                parent[max(p, q)] = min(p, q)
                out.append((rep[x], rep[y]))
        return pd.DataFrame(out, columns=["a", "b"]).astype(pdf["rep"].dtype)

    steps = [written(near(low).groupBy("grp", "i", "j").applyInPandas(compare, f"a {kind}, b {kind}"), "join-hidden") for low in range(0, max(1, most), APART)]
    return functools.reduce(DataFrame.unionByName, steps)


def components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id (smallest id reachable by links), class_k1 and class_k2 (its
    class; documents of one class have one and the same set)."""
    found, classes, links = join_classes(df, id_col, text_col, shingle, percent)
    rows = found.where("doc_id IS NOT NULL AND n_shingles > 0")
    # An id with several rows ties their classes together.
    shared = rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("shared"))
    ties = rows.join(shared, F.col("doc_id") == F.col("shared"), "left_semi").join(classes.select("k1", "k2", "rep"), ["k1", "k2"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    labels = connected(links.unionByName(ties))
    named = written(classes.join(labels, classes["rep"] == labels["node"], "left").select("k1", "k2", F.coalesce("component", "rep").alias("component")), "join-named")
    dropped(labels, classes, links)
    # Both sides are scans: AQE splits the partition of a class that holds a large part of all rows.
    full = found.select("doc_id", "n_shingles", F.col("k1").alias("class_k1"), F.col("k2").alias("class_k2"))
    out = full.join(named, (F.col("class_k1") == F.col("k1")) & (F.col("class_k2") == F.col("k2")), "left")
    own = F.when(F.col("n_shingles") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), own).alias("component_id"), "class_k1", "class_k2")


def near_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of df less those that link, over others or not, to a smaller id; with all columns of df."""
    gone = fresh(df, "__gone")
    out = written(components(df, id_col, text_col, shingle, percent).where("component_id <> doc_id").select(F.col("doc_id").alias(gone)).distinct(), "join-gone")
    return df.join(out, F.col(f"`{id_col}`") == F.col(gone), "left_anti")
