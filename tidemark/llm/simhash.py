"""SimHash near-duplicates by anchor points of a covering code.

Two 64-bit fingerprints with at most 3 differing bits differ in at most one bit of their lower or of their
upper half. The anchors of a half are the words of the Hamming code of length 31 (the half's 32nd bit is left to the
comparison). The code's covering radius is 1, so with the threshold 1 on a half every fingerprint goes to all
anchors within distance 2 of the half: the nearest anchor of one fingerprint is then among those of the other, and every
link is found. That is 1 or 16 anchors a half, found by the syndrome, and an anchor draws 497 of 2**31 patterns.

Equal fingerprints are one before anything is replicated, so that copies cost nothing. An
anchor with more than `block` fingerprints is split into blocks, and each pair of blocks is compared on its own, so that no task
holds an unbounded group and no pair is missed. Comparing emits a spanning forest of the links, never all pairs.
Components come from alternating stars over the forest, cut by checkpoints.

`near_texts` finds what the 64 bits of three-word shingles can't: all documents whose sets of five-word shingles have a Jaccard similarity of 0.8
or more. A wide SimHash of 192 bits over pairs of neighbouring words nominates: its first word has anchors as above, and within an anchor of more than eight texts the nominations are
each text with its nearest and with the most central one, so that a group of n near copies costs some n comparisons of texts, not n * n. What it misses is found exactly:
sets that similar share a shingle among the first fifth of either, in any one order of all shingles (the prefix filter); the order is by
frequency, rare ones first. Texts that share such a shingle are compared unless a bound rules them out: sizes, places in the order, and 512 parity bits, of which
each shingle that only one text has flips one at most. In a group of more than eight, those nearest to a few central texts come first, and then all pairs that no link joins
yet. Of the pairs, those go on that parities as wide as their texts allow, too; only for these do texts move. Whatever is left is decided by the exact similarity of the whole texts.

Free style: fingerprints and comparisons in Arrow batches with numpy; the rest are DataFrames.

Defined results: a null or empty text has fingerprint zero and links like any other, rows that repeat share their
component, a null doc_id never names a component unless all of it is null, an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, freed, small, text_of, written

#: Bits at which fingerprints still link, and fingerprints that an anchor's block holds.
DISTANCE, BLOCK = 3, 4096
#: Of near_texts: words of a shingle and similarity that decide; words of a feature, 64-bit words of the wide fingerprint, and bits of it at which texts are still compared.
SHINGLE, SIMILARITY, FEATURE, WIDE, NOMINATED = 5, 0.8, 2, 3, 42
#: Its prefix filter: 64-bit words of parity; bits of the buckets that order shingles by frequency, buckets that a task reports, and that are ordered at all (others go by hash; any order is exact).
PARITY, BUCKET, REPORTED, ORDERED = 8, 20, 4096, 1 << 16
#: Members of a group that are compared at once; of larger ones the texts among which central ones are sought, and how many of these.
FEW, SAMPLE, CENTRAL = 8, 256, 32


def ones_of(rows: np.ndarray) -> np.ndarray:
    """How many of the rows (bytes) have each bit."""
    bits = np.unpackbits(rows, axis=1)
    # sums of up to 255 rows fit a byte
    return np.add.reduceat(bits, np.arange(0, len(bits), 255), axis=0, dtype=np.uint8).sum(axis=0, dtype=np.int64)


def mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th of independent 64-bit hashes that follow from one."""
    x = (h ^ np.uint64((k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(32)


def shingle_hashes(text: str, size: int) -> np.ndarray:
    """Hashes of a text's shingles of so many words, repeats included: one of all words if there are fewer, none without words."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()
    digest = xxhash.xxh64_intdigest
    h = np.fromiter(map(digest, words), np.uint64, len(words))
    size = min(size, len(h))
    if not size:
        return h
    out = np.zeros(len(h) - size + 1, np.uint64)
    for k in range(size):
        out = mixed(out, 0) + h[k : k + len(out)]
    return out


def wide_simhash(text: str, size: int = FEATURE, count: int = WIDE) -> list[int]:
    """A SimHash of count signed 64-bit words; zeros for a text without words."""
    h = shingle_hashes(text, size)
    ones = np.zeros(64 * count, np.int64)
    for at in range(0, len(h), 1 << 15):
        part = h[at : at + (1 << 15)]
        ones += ones_of(np.stack([mixed(part, k + 1) for k in range(count)], axis=1).view(np.uint8).reshape(len(part), -1))
    return np.packbits(2 * ones > len(h)).view(np.int64).tolist()


def similarity(a: str, b: str, size: int = SHINGLE) -> float:
    """Jaccard similarity of the sets of shingles; 1 if neither text has words."""
    x, y = (np.unique(shingle_hashes(t, size)) for t in (a, b))
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) + len(y) else 1.0


def fingerprints(docs: DataFrame, text: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """docs' columns (or those of keep) with __fp, the SimHash of three-word shingles as a signed 64-bit integer."""
    import pyarrow as pa

    kept = [c for c in docs.columns if (keep is None or c in keep) and c != "__fp"]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept), "__fp long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest = xxhash.xxh64_intdigest

        def simhash(text: str) -> int:
            words = text.encode("utf-8", "surrogatepass").lower().split()
            if not words:
                return 0
            flat = b" ".join(words)
            if len(words) <= 3:
                return digest(flat, 42)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
            starts = [0, *ends[:-3].tolist()]
            n, ones = len(starts), np.zeros(64, np.int64)
            stops = (ends[2:] - 1).tolist()
            for at in range(0, n, 1 << 16):
                h = np.array([digest(flat[a:b], 42) for a, b in zip(starts[at : at + (1 << 16)], stops[at : at + (1 << 16)], strict=True)], np.uint64)
                ones += ones_of(h.astype(">u8").view(np.uint8).reshape(-1, 8))
            return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")

        for batch in batches:
            out = [simhash(x) for x in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.array(out, np.uint64).view(np.int64))], names=[*kept, "__fp"])

    return docs.select(*(F.col(f"`{c}`") for c in kept), text_of(f"`{text}`").alias("__text")).mapInArrow(run, schema)


def anchored(distinct: DataFrame, words: list[str], carried: list[str]) -> DataFrame:
    """Rows to (anchor, carried): each row at every anchor within distance 2 of either half of any of the words."""
    import pyarrow as pa

    names = ["anchor", *carried]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = np.uint64((1 << 31) - 1)
        # parity masks of the syndrome: bit k of the syndrome sums the positions (from 1) whose number has bit k
        masks = [np.uint64(sum(1 << (p - 1) for p in range(1, 32) if p >> k & 1)) for k in range(5)]
        # for each syndrome the flips that reach a code word: that one position, or two whose numbers' sum is the syndrome
        flips = [[0] if s == 0 else [1 << (s - 1), *(1 << (p - 1) | 1 << ((p ^ s) - 1) for p in range(1, 32) if p < p ^ s)] for s in range(32)]
        table = np.array([f + [-1] * (16 - len(f)) for f in flips], np.int64)
        for batch in batches:
            cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(batch.num_columns)]
            for at in range(0, batch.num_rows, 1000):
                own = [c[at : at + 1000] for c in cols]
                anchors, who = [], []
                for half in range(2 * len(words)):
                    x = own[half // 2].view(np.uint64) >> np.uint64(32 * (half % 2)) & low
                    s = sum((np.bitwise_count(x & m) & 1).astype(np.int64) << k for k, m in enumerate(masks))
                    rows, places = np.nonzero(table[s] >= 0)
                    anchors.append((x[rows] ^ table[s][rows, places].astype(np.uint64)).astype(np.int64) << 4 | half)
                    who.append(rows)
                who = np.concatenate(who)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(anchors)), *(pa.array(c[who]) for c in own[len(words) :])], names=names)

    return distinct.select(*words, *[F.col(c).alias(f"__{k}") for k, c in enumerate(carried)]).mapInArrow(run, ", ".join(f"{c} long" for c in names))


def linked(placed: DataFrame, key: int, compared: list[int], distance: int, nearest: bool) -> DataFrame:
    """Rows of longs (anchor, p, q, carried), grouped by the first three, to links (a, b) of keys, a < b.

    Rows link at `distance` or fewer differing bits in the columns compared. Groups of up to eight give all their links, larger ones a spanning
    forest of them or, with `nearest`, each row's nearest and the links of the most central row, from which copies may stem.
    """
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def far(cols: list[np.ndarray], i: np.ndarray | slice, j: np.ndarray | int) -> np.ndarray:
            return sum(np.bitwise_count(c[i] ^ c[j]).astype(np.int16) for c in cols)

        def forest(cols: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
            """Breadth-first over one group's links, as positions."""
            a, b, rest, front = [], [], np.arange(1, len(cols[0])), [0]
            while len(rest):
                if not front:
                    front, rest = [rest[0]], rest[1:]
                    continue
                u = front.pop()
                near = far(cols, rest, u) <= distance
                if near.any():
                    got = rest[near]
                    a.append(np.full(len(got), u))
                    b.append(got)
                    front.extend(got)
                    rest = rest[~near]
            return (np.concatenate(a), np.concatenate(b)) if a else (rest, rest)

        def neighbours(cols: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
            """Every row with its nearest and with the most central row, if within the distance."""
            n = len(cols[0])
            near, least, total = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
            for v in range(n):
                d = far(cols, slice(None), v)
                total += np.minimum(d, distance + 1)
                d[v] = np.iinfo(np.int16).max
                near[v] = d.argmin()
                least[v] = d[near[v]]
            v = int(total.argmin())
            rows, central = np.flatnonzero(least <= distance), np.flatnonzero(far(cols, slice(None), v) <= distance)
            central = central[central != v]
            return np.concatenate([rows, central]), np.concatenate([near[rows], np.full(len(central), v)])

        def links(groups: np.ndarray, keys: np.ndarray, cols: list[np.ndarray]) -> pa.RecordBatch:
            starts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
            sizes = np.diff(np.r_[starts, len(groups)])
            a, b = [], []
            few = np.repeat(sizes <= 8, sizes)
            for shift in range(1, 8):
                i = np.flatnonzero(few[:-shift] & (groups[:-shift] == groups[shift:])) if len(groups) > shift else np.zeros(0, int)
                if not len(i):
                    break
                i = i[far(cols, i, i + shift) <= distance]
                a.append(i)
                b.append(i + shift)
            for at, n in zip(starts[sizes > 8], sizes[sizes > 8], strict=True):
                u, v = (neighbours if nearest else forest)([c[at : at + n] for c in cols])
                a.append(at + u)
                b.append(at + v)
            a, b = (keys[np.concatenate(z).astype(np.int64)] if z else keys[:0] for z in (a, b))
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])

        held: list[list[np.ndarray]] = []
        last, group = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(batch.num_columns)]
            new = np.r_[last is not None and any(c[0] != x for c, x in zip(cols[:3], last, strict=True)), np.any([c[1:] != c[:-1] for c in cols[:3]], axis=0)]
            groups, last = group + np.cumsum(new), [c[-1] for c in cols[:3]]
            group = int(groups[-1])
            own = [groups, cols[key], *(cols[k].view(np.uint64) for k in compared)]
            edge = int(np.searchsorted(groups, group))
            if edge:  # groups that end in this batch
                held.append([c[:edge] for c in own])
                whole = [np.concatenate(x) for x in zip(*held, strict=True)]
                yield links(whole[0], whole[1], whole[2:])
                held = []
            held.append([c[edge:] for c in own])
        if held:
            whole = [np.concatenate(x) for x in zip(*held, strict=True)]
            yield links(whole[0], whole[1], whole[2:])

    return placed.mapInArrow(run, "a long, b long")


def met(distinct: DataFrame, words: list[str], carried: list[str], block: int, across: bool = True) -> DataFrame:
    """(anchor, p, q, carried), grouped and sorted: what meets at an anchor, those of more than `block` rows in pairs of blocks or, unless `across`, in blocks alone."""
    # a row becomes up to 32 for each word, so few rows are dealt to all tasks first
    dealt = distinct.repartition(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), carried[0])
    pairs = anchored(dealt, words, carried)
    large = pairs.groupBy("anchor").count().filter(F.col("count") > block).select(F.col("anchor").alias("__anchor"), F.ceil(F.col("count") / block).cast("int").alias("__n"))
    split = pairs.join(small(large), F.col("anchor") == F.col("__anchor"), "left").withColumn("__n", F.coalesce("__n", F.lit(1)))
    part = F.pmod(F.xxhash64(carried[0]), F.col("__n")).cast("long")
    others = F.sequence(F.lit(0).cast("long"), F.col("__n").cast("long") - 1) if across else F.array(part)
    meets = F.transform(others, lambda k: F.struct(F.least(part, k).alias("p"), F.greatest(part, k).alias("q")))
    placed = split.select("anchor", *carried, F.inline(meets)).select("anchor", "p", "q", *carried)
    return placed.repartition("anchor", "p", "q").sortWithinPartitions("anchor", "p", "q", carried[0])


def links(distinct: DataFrame, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between distinct fingerprints (fp): their components are those of all pairs within the distance."""
    return linked(met(distinct, ["fp"], ["fp"], block), 3, [3], DISTANCE, False).distinct()


def components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) to (node, root): root is the smallest node of its component. Alternates large and small stars."""
    edges = cut(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    before = None
    while True:
        # large star: every larger neighbour of a node is tied to the node's smallest neighbour, or to itself
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        edges = both.filter("b > a").join(least, F.col("a") == F.col("n")).select(F.col("m").alias("a"), "b").distinct()
        # small star: a node and its smaller neighbours are tied to the smallest of them
        least = edges.groupBy("b").agg(F.min("a").alias("m")).select(F.col("b").alias("n"), "m")
        tied = edges.join(least, F.col("b") == F.col("n")).select("m", F.explode(F.array("a", "b")).alias("c"))
        edges = cut(tied.filter("c <> m").select(F.col("m").alias("a"), F.col("c").alias("b")).distinct())
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
        before = now


def rooted(printed: DataFrame, id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """printed, with (id, __fp), to one row per fingerprint (fp, root) and one per component (__root, component_id), the smallest id reachable."""
    own = cut(printed.groupBy(F.col("__fp").alias("fp")).agg(F.min(F.col(f"`{id_col}`")).alias("first")))
    comp = components(links(own))
    roots = own.join(comp, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    # cut, so that the join reads two plain exchanges and Spark can split a root that many fingerprints share
    return roots.select("fp", "root"), cut(roots.groupBy("root").agg(F.min("first").alias("component_id")).withColumnRenamed("root", "__root"))


def representatives(printed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The component ids alone, one row per component."""
    return rooted(printed, id_col)[1].select("component_id")


def classes(printed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """printed, with (id, __fp), to one row per fingerprint: (fp, component_id), the smallest id reachable."""
    roots, least = rooted(printed, id_col)
    return roots.join(least, F.col("root") == F.col("__root")).select("fp", "component_id")


def with_components(printed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """printed with component_id, which replaces a column of that name; printed is read twice and so should be written first."""
    found = classes(printed, id_col).select(F.col("fp").alias("__key"), F.col("component_id").alias("__component"))
    own = [F.col(f"`{c}`") for c in printed.columns if c != "component_id"]
    return printed.join(found, F.col("__fp") == F.col("__key")).select(*own, F.col("__component").alias("component_id"))


def key_of(text: str = "text") -> Column:
    """The hash that stands for a text in near_texts: two texts share one by chance in 1 of 2**64 pairs."""
    return F.xxhash64(text_of(f"`{text}`"))


def parity_of(h: np.ndarray) -> np.ndarray:
    """Of distinct hashes, by their lowest bits: whether an odd number has each value. As 64-bit words, a power of two of them: two to four bits a hash, PARITY words at least."""
    bits = max(64 * PARITY, 1 << max(0, 2 * len(h) - 1).bit_length())
    return np.packbits(np.bincount((h % np.uint64(bits)).astype(np.int64), minlength=bits) & 1).view(np.uint64)


def folded(parity: np.ndarray, words: int) -> np.ndarray:
    """The parity by fewer of the lowest bits."""
    return np.bitwise_xor.reduce(parity.reshape(-1, words), axis=0)


def features(docs: DataFrame, id_col: str, text: str, size: int) -> DataFrame:
    """One row for each row of docs: id, key, n shingles, the wide fingerprint f0, f1, ..., their parity p0, p1, ..., and fine, the parity in two to four bits a shingle.

    Besides, each task reports its most frequent buckets of shingles: rows of bucket (as key) and count (as a negative n).
    """
    import pyarrow as pa

    names = [*(f"f{k}" for k in range(WIDE)), *(f"p{k}" for k in range(PARITY))]
    kind = docs.schema[id_col].dataType
    schema = f"id {kind.simpleString()}, key long, n long, " + ", ".join(f"{x} long" for x in names) + ", fine binary"
    names = ["id", "key", "n", *names, "fine"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, counts, ids = set(), np.zeros(1 << BUCKET, np.int32), None
        for batch in batches:
            ids = batch.column(0).type
            rows, wide = [], []
            for key, x in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                h = np.unique(shingle_hashes(x, size))
                fine = parity_of(h)
                rows.append([len(h), *wide_simhash(x), *folded(fine, PARITY).view(np.int64).tolist()])
                wide.append(fine.tobytes())
                if key not in seen:
                    seen.add(key)
                    buckets, times = np.unique(h >> np.uint64(64 - BUCKET), return_counts=True)
                    counts[buckets.astype(np.int64)] += times.astype(np.int32)
            got = np.array(rows, np.int64).reshape(-1, len(names) - 3)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(got[:, k].copy()) for k in range(got.shape[1])), pa.array(wide, pa.binary())], names=names)
        if ids is not None:
            top = np.flatnonzero(counts > 1)
            top = top[np.argsort(-counts[top], kind="stable")[:REPORTED]]
            none = pa.array(np.zeros(len(top), np.int64))
            yield pa.RecordBatch.from_arrays([pa.nulls(len(top), ids), pa.array(top), pa.array(-counts[top].astype(np.int64)), *[none for _ in names[3:-1]], pa.nulls(len(top), pa.binary())], names=names)

    return docs.select(F.col(f"`{id_col}`").alias("id"), key_of(text).alias("key"), text_of(f"`{text}`").alias("text")).mapInArrow(run, schema)


def prefixes(docs: DataFrame, text: str, least: float, size: int, order: list[tuple[int, int]]) -> DataFrame:
    """(token, key, place): each text's first shingles by (frequency, hash), as many as a text that similar must share one of; place is n << 32 | position.

    order has (bucket, count) of the frequent buckets. Texts without words share the token 0.
    """
    import pyarrow as pa

    often = np.array(order, np.int64).reshape(-1, 2)
    often = often[np.argsort(often[:, 0])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, seen = np.zeros(1 << BUCKET, np.int64), set()
        weights[often[:, 0]] = often[:, 1]

        def flushed(parts: list[tuple[np.ndarray, int, int]]) -> pa.RecordBatch:
            token = np.concatenate([h for h, _, _ in parts]).view(np.int64)
            key = np.repeat(np.array([k for _, k, _ in parts], np.int64), [len(h) for h, _, _ in parts])
            place = np.concatenate([n << 32 | np.arange(len(h)) for h, _, n in parts])
            return pa.RecordBatch.from_arrays([pa.array(token), pa.array(key), pa.array(place)], names=["token", "key", "place"])

        for batch in batches:
            parts, held = [], 0
            for key, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if key in seen:
                    continue
                seen.add(key)
                h = np.unique(shingle_hashes(x, size))
                n = len(h)
                first = min(n, n - int(np.ceil(least * n - 1e-6)) + 1)
                h = h[np.lexsort((h, weights[(h >> np.uint64(64 - BUCKET)).astype(np.int64)]))[:first]] if n else np.zeros(1, np.uint64)
                parts.append((h, key, n))
                held += len(h)
                if held >= 100_000:
                    yield flushed(parts)
                    parts, held = [], 0
            if parts:
                yield flushed(parts)

    return docs.select(key_of(text).alias("key"), text_of(f"`{text}`").alias("text")).mapInArrow(run, "token long, key long, place long")


def matrix(batch, first: int = 0, stop: int | None = None) -> np.ndarray:
    """A batch's columns of longs as the columns of one array."""
    return np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(first, batch.num_columns if stop is None else stop)], axis=1)


def shared(placed: DataFrame) -> DataFrame:
    """placed without rows that repeat and without tokens that only one text has."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(rows[:, k].copy()) for k in range(3)], names=["token", "key", "place"])

        # the last row, which waits for the next one's token, and whether the row before had its token
        last, after = np.zeros((0, 3), np.int64), False
        for batch in batches:
            rows = np.concatenate([last, matrix(batch)])
            rows = rows[np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)]] if len(rows) else rows
            if not len(rows):
                continue
            same = np.r_[after, rows[1:, 0] == rows[:-1, 0]]
            keep = same[:-1] | same[1:]
            if keep.any():
                yield out(rows[:-1][keep])
            last, after = rows[-1:], bool(same[-1])
        if len(last) and after:
            yield out(last)

    return placed.repartition("token").sortWithinPartitions("token", "key").mapInArrow(run, "token long, key long, place long")


def possible(a: np.ndarray, b: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Whether rows (place, parity) of one token may be at least so similar, never false if they are; and bits in which their parities differ. Broadcasts all but the last axis."""
    x, y = a[..., 0], b[..., 0]
    n, m, i, j = x >> 32, y >> 32, x & 0xFFFFFFFF, y & 0xFFFFFFFF
    differ = sum(np.bitwise_count((a[..., k] ^ b[..., k]).view(np.uint64)).astype(np.int16) for k in range(1, a.shape[-1]))
    # shared shingles: at most those before the token in both, itself, and those after it in both
    both = np.minimum(i, j) + 1 + np.minimum(n - i - 1, m - j - 1)
    ok = (np.minimum(n, m) >= least * np.maximum(n, m) - 1e-6) & (both >= least / (1 + least) * (n + m) - 1e-6)
    return ok & (differ <= (1 - least) / (1 + least) * (n + m) + 1e-6), differ


def bounded(pairs: DataFrame, own: DataFrame, least: float) -> DataFrame:
    """pairs (a, b) of keys without those that sizes or parities rule out, never one that is at least so similar; own has (key, n, fine)."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(k).to_numpy() for k in (2, 3))
            most = (1 - least) / (1 + least) * (n + m) + 1e-6
            ok = np.minimum(n, m) >= least * np.maximum(n, m) - 1e-6
            for k in np.flatnonzero(ok).tolist():
                x, y = (np.frombuffer(batch.column(c)[k].as_buffer(), np.uint64) for c in (4, 5))
                words = min(len(x), len(y))
                ok[k] = int(np.bitwise_count(folded(x, words) ^ folded(y, words)).sum(dtype=np.int64)) <= most[k]
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(ok)) for k in (0, 1)], names=["a", "b"])

    asked = small(pairs.select(F.explode(F.array("a", "b")).alias("__key")).distinct())
    known = own.join(asked, F.col("key") == F.col("__key"), "left_semi")
    one, two = (known.select(*[F.col(c).alias(f"__{side}_{c}") for c in ["key", "n", "fine"]]) for side in "ab")
    both = pairs.join(one, F.col("a") == F.col("__a_key")).join(two, F.col("b") == F.col("__b_key"))
    return both.select("a", "b", "__a_n", "__b_n", "__a_fine", "__b_fine").mapInArrow(run, "a long, b long")


def pair_batch(a: np.ndarray, b: np.ndarray):
    import pyarrow as pa

    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])


def nominated(places: DataFrame, least: float) -> DataFrame:
    """(token, key, place, parity) to pairs (a, b) of keys: all possible ones of small groups; of larger ones each text with the nearest of a few central ones."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def central(sample: np.ndarray) -> np.ndarray:
            ok, _ = possible(sample[:, None, 2:], sample[None, :, 2:], least)
            left, found = np.ones(len(sample), bool), []
            while left.any() and len(found) < CENTRAL:
                near = (ok & left).sum(axis=1)
                v = int(near.argmax())
                if near[v] < 2:
                    break
                found.append(v)
                left &= ~ok[v]
            return sample[found]

        def star(rows: np.ndarray, centre: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for at in range(0, len(rows) if len(centre) else 0, 4096):
                part = rows[at : at + 4096]
                ok, differ = possible(part[:, None, 2:], centre[None, :, 2:], least)
                ok &= part[:, None, 1] != centre[None, :, 1]
                near = np.where(ok, differ, np.iinfo(np.int16).max).argmin(axis=1)
                got = ok[np.arange(len(part)), near]
                yield part[got, 1], centre[near[got], 1]

        def groups(rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            starts = np.flatnonzero(np.r_[True, rows[1:, 0] != rows[:-1, 0]])
            sizes = np.diff(np.r_[starts, len(rows)])
            few = np.repeat(sizes <= FEW, sizes)
            for shift in range(1, FEW):
                i = np.flatnonzero(few[:-shift] & (rows[:-shift, 0] == rows[shift:, 0]))
                if not len(i):
                    break
                i = i[possible(rows[i, 2:], rows[i + shift, 2:], least)[0]]
                yield rows[i, 1], rows[i + shift, 1]
            for at, n in zip(starts[sizes > FEW], sizes[sizes > FEW], strict=True):
                yield from star(rows[at : at + n], central(rows[at : at + min(n, SAMPLE)]))

        held, centre = None, None
        for batch in batches:
            rows = matrix(batch)
            if not len(rows):
                continue
            found = []
            if held is not None and centre is not None:
                # held is a row of the group whose central texts are known
                more = int(np.searchsorted(rows[:, 0], held[0, 0], "right"))
                found.extend(star(rows[:more], centre))
                if more == len(rows):
                    edge, rows = 0, rows[:0]
                else:
                    held, centre, rows = None, None, rows[more:]
            elif held is not None:
                rows = np.concatenate([held, rows])
            if len(rows):
                edge = int(np.searchsorted(rows[:, 0], rows[-1, 0]))
                if edge:
                    found.extend(groups(rows[:edge]))
                held = rows[edge:]
                if len(held) > SAMPLE:
                    centre = central(held[:SAMPLE])
                    found.extend(star(held, centre))
                    held = held[:1]
            if found:
                yield pair_batch(*(np.concatenate(x) for x in zip(*found, strict=True)))
        if held is not None and centre is None and (found := list(groups(held))):
            yield pair_batch(*(np.concatenate(x) for x in zip(*found, strict=True)))

    return places.repartition("token").sortWithinPartitions("token", "key").mapInArrow(run, "a long, b long")


def remaining(places: DataFrame, found: DataFrame, least: float, block: int) -> DataFrame:
    """All possible pairs (a, b) of keys in groups of more than a few that found, (node, root), doesn't join yet, each pair once.

    Members outside a group's most frequent class meet all, in blocks of some `block`, against which the group is read as a stream.
    """
    import pyarrow as pa

    large = places.join(places.groupBy("token").count().filter(F.col("count") > FEW).select("token"), "token", "left_semi")
    rows = cut(large.join(found, F.col("key") == F.col("node"), "left").withColumn("root", F.coalesce("root", "key")).drop("node"))
    tally = rows.groupBy("token", "root").count().groupBy("token").agg(F.max(F.struct("count", "root")).alias("most"), F.sum("count").alias("all"), F.count(F.lit(1)).alias("roots"))
    split = tally.filter("roots > 1").select("token", F.col("most.root").alias("usual"), F.ceil((F.col("all") - F.col("most.count")) / block).cast("long").alias("blocks"))
    several = rows.join(split, "token")
    # a pair meets at each token that both have; it is taken at the least
    tokens = several.groupBy("key").agg(F.collect_list("token").alias("tokens")).withColumnRenamed("key", "__key")
    own = F.struct(F.pmod(F.xxhash64("key"), F.col("blocks")).alias("block"), F.lit(0).cast("long").alias("kind"))
    seen = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda k: F.struct(k.alias("block"), F.when(F.col("root") == F.col("usual"), 1).otherwise(2).cast("long").alias("kind")))
    meets = F.when(F.col("root") == F.col("usual"), seen).otherwise(F.concat(F.array(own), seen))
    parity = [f"p{k}" for k in range(PARITY)]
    dealt = several.join(tokens, F.col("key") == F.col("__key")).select("token", F.inline(meets), "key", "root", "place", *parity, "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_tokens = None, []
        for batch in batches:
            rows, lists = matrix(batch, 0, 6 + PARITY), batch.column(6 + PARITY)
            if not len(rows):
                continue
            starts = [0, *(np.flatnonzero((rows[1:, :3] != rows[:-1, :3]).any(axis=1)) + 1).tolist(), len(rows)]
            for at, end in zip(starts, starts[1:], strict=False):
                part = rows[at:end]
                if held is not None and (part[0, :2] != held[0, :2]).any():
                    held, held_tokens = None, []
                if part[0, 2] == 0:
                    held = part if held is None else np.concatenate([held, part])
                    held_tokens += [np.array(x.as_py()) for x in lists[at:end]]
                    continue
                tile = max(1, (1 << 18) // len(held))
                for k in range(0, len(part), tile):
                    some = part[k : k + tile]
                    ok = possible(some[:, None, 5:], held[None, :, 5:], least)[0] & (some[:, None, 4] != held[None, :, 4])
                    if part[0, 2] == 2:
                        ok &= some[:, None, 3] < held[None, :, 3]
                    i, j = np.nonzero(ok)
                    if not len(i):
                        continue
                    theirs = {int(x): np.array(lists[at + k + int(x)].as_py()) for x in np.unique(i)}
                    least_of = [np.intersect1d(theirs[x], held_tokens[y], assume_unique=True)[0] for x, y in zip(i.tolist(), j.tolist(), strict=True)]
                    first = np.array(least_of) == some[0, 0]
                    if first.any():
                        yield pair_batch(some[i[first], 3], held[j[first], 3])

    return dealt.repartition("token", "block").sortWithinPartitions("token", "block", "kind", "key").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, least: float, size: int) -> DataFrame:
    """(a, b, text_a, text_b) to those (a, b) whose texts are at least so similar."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                near = [similarity(a, b, size) >= least for a, b in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(k).filter(pa.array(near)) for k in (0, 1)], names=["a", "b"])

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def decided(pairs: DataFrame, own: DataFrame, docs: DataFrame, id_col: str, text: str, least: float, size: int) -> DataFrame:
    """pairs (a, b) of keys to those whose texts are at least so similar. own has (key, id)."""
    asked = own.select("key", "id").join(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct(), "key", "left_semi")
    asked = small(asked.select(F.col("key").alias("__key"), F.col("id").alias("__id")))
    # one text for each key, by its smallest id; rows that repeat both give a pair more than once, which does no harm
    body = docs.select(key_of(text).alias("key"), F.col(f"`{id_col}`").alias("__own"), text_of(f"`{text}`").alias("body"))
    texts = written(body.join(asked, (F.col("key") == F.col("__key")) & F.col("__own").eqNullSafe(F.col("__id"))).select("key", "body"), "texts")
    one, two = texts.toDF("key_a", "text_a"), texts.toDF("key_b", "text_b")
    return verified(pairs.join(one, F.col("a") == F.col("key_a")).join(two, F.col("b") == F.col("key_b")), least, size).distinct()


def near_texts(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least: float = SIMILARITY, size: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """One row for each distinct text of docs: (key, id, class_key, class_id).

    key is the text's hash, id the smallest id that has it, class_key and class_id those of the text that stands for its class: the
    one with the smallest id (then key) among all that links reach. Links are all pairs of a similarity of `least` (above 0) or more. Rows with equal texts are one text, whatever their ids; rows that share an id but not
    a text stay apart; null ids are larger than others; texts without words are alike; no rows give no rows.
    """
    printed = cut(features(docs, id_col, text, size))
    words, parity = [f"f{k}" for k in range(WIDE)], [f"p{k}" for k in range(PARITY)]
    own = cut(printed.filter("n >= 0").groupBy("key").agg(F.min("id").alias("id"), *[F.min(w).alias(w) for w in ["n", *words, *parity, "fine"]]))
    order = printed.filter("n < 0").groupBy("key").agg(F.sum(-F.col("n")).alias("times")).orderBy(F.desc("times"), "key").limit(ORDERED)
    placed = shared(prefixes(docs, text, least, size, [tuple(r) for r in order.collect()]))
    places = written(placed.join(own.select("key", *parity), "key").select("token", "key", "place", *parity), "places")
    freed(docs.sparkSession)  # the shuffle files of the tokens
    simhashed = linked(met(own, words[:1], ["key", *words], block, False), 3, list(range(4, 4 + WIDE)), NOMINATED, True)
    pairs = cut(simhashed.unionByName(nominated(places, least)).distinct())
    freed(docs.sparkSession)  # those of the anchors
    near = components(decided(cut(bounded(pairs, own, least)), own, docs, id_col, text, least, size))
    freed(docs.sparkSession)  # those of the texts
    rest = cut(remaining(places, near, least, block).distinct())
    edges = decided(cut(bounded(rest, own, least)), own, docs, id_col, text, least, size).unionByName(near.select(F.col("root").alias("a"), F.col("node").alias("b")))
    found = own.select("key", "id").join(components(edges), F.col("key") == F.col("node"), "left").select("key", "id", F.coalesce("root", "key").alias("root"))
    found = cut(found)
    freed(docs.sparkSession)
    order = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("key").alias("key"))
    first = found.groupBy(F.col("root").alias("__root")).agg(F.min(order).alias("__first"))
    return found.join(first, F.col("root") == F.col("__root")).select("key", "id", F.col("__first.key").alias("class_key"), F.col("__first.id").alias("class_id"))


def hexed(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
