"""Document fingerprints by winnowing.

A polynomial hash of every k-gram of code points is rolled over a text; of each window of w neighbouring hashes the least is chosen, the
rightmost where several are least. Chosen hashes are kept with their positions, so that any passage of k + w - 1
characters that two texts share gives them a common fingerprint, and none shorter than k does. A text shorter than k is one gram, one with fewer than w
grams is one window.

The gram is the same for all texts, and the window shrinks with the text's length n, to n // 2 - k + 1 at most and 1 at least. As what a
window chooses is also chosen by smaller windows inside it, texts of different windows compare, and the guarantee for two texts is that
of the larger window: k + w - 1 characters, which is half of the longer text and 71 at most. So two texts of 16 characters or
more that share half of the longer one have a common fingerprint.

A text's neighbour in ascending order of id is found without a window over all rows: ids are cut into ranges at
quantiles, each range's first document also goes to the range before it, and each range is read in
order. So every text is moved once, in a shuffle on ranges, and no task holds more than its ranges' stream.

Free style: Arrow batches with numpy.

Defined results: a null text counts as empty and has no fingerprint, likeness of two empty fingerprints is 1, rows order by
id (null first) and then text, so rows that repeat are neighbours; a lone document is its own neighbour, an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import text_of

#: Characters in a gram, grams in the window of a long text.
K, W = 8, 64
#: The hash's multiplier (odd), and the final mix of its bits.
BASE, MIX = 0x9E3779B97F4A7C15, 0xFF51AFD7ED558CCD


def window(n: int, k: int = K) -> int:
    """Grams in the window of a text of n characters."""
    return max(1, min(W, n // 2 - k + 1))


def winnow(text: str, k: int = K, w: int | None = None):
    """(hashes, positions) of a text's fingerprint, in order, as numpy arrays; w is that of the text's length where none is given."""
    import numpy as np

    w = window(len(text), k) if w is None else w
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if not len(c):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    k = min(k, len(c))
    # h[i] = sum of c[i+j] B**(k-1-j) modulo 2**64, by doubling: a gram of 2m is two of m
    with np.errstate(over="ignore"):
        done, size, out = c + np.uint64(1), 1, None
        got = 0
        base = BASE
        rest = k
        while rest:
            if rest & 1:
                if out is None:
                    out, got = done, size
                else:
                    n = len(c) - got - size + 1
                    out = out[:n] * np.uint64(pow(BASE, size, 1 << 64)) + done[got : got + n]
                    got += size
            rest >>= 1
            if rest:
                n = len(done) - size
                done = done[:n] * np.uint64(base) + done[size : size + n]
                base = base * base & (1 << 64) - 1
                size *= 2
        h = out[: len(c) - k + 1]
        h = (h ^ (h >> np.uint64(33))) * np.uint64(MIX)
        h ^= h >> np.uint64(33)
    w = min(w, len(h))
    # the rightmost least of each window, by doubling as well; windows may overlap, as least and rightmost don't mind
    value, at, span = h, np.arange(len(h)), 1

    def joined(shift: int):
        a, b = value[: len(value) - shift], value[shift:]
        right = b <= a
        return np.where(right, b, a), np.where(right, at[shift:], at[: len(at) - shift])

    while span < w:
        shift = min(span, w - span)
        value, at = joined(shift)
        span += shift
    at = np.unique(at)
    return h[at], at


def likeness(a, b) -> float:
    """Jaccard likeness of two arrays of distinct hashes."""
    import numpy as np

    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def told(hashes, positions) -> str:
    """A fingerprint as text: hash@position, comma-joined."""
    return ",".join([f"{h:016x}@{p}" for h, p in zip(hashes.tolist(), positions.tolist(), strict=True)])


def fingerprints(docs: DataFrame, text: str = "text", into: str = "fingerprint", k: int = K, w: int | None = None) -> DataFrame:
    """docs with the fingerprint of each text as an array of (hash, position); map-only."""
    import pyarrow as pa

    kept = [c for c in docs.columns if c != into]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept), f"`{into}` array<struct<hash: bigint, position: bigint>>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                got = [winnow(x, k, w) for x in part.column(part.num_columns - 1).to_pylist()]
                ends = pa.array(np.r_[0, np.cumsum([len(x[0]) for x in got])].astype(np.int32))
                flat = pa.StructArray.from_arrays([pa.array(np.concatenate([x[0] for x in got]).view(np.int64)), pa.array(np.concatenate([x[1] for x in got]).astype(np.int64))], names=["hash", "position"])
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.ListArray.from_arrays(ends, flat)], names=[*kept, into])

    return docs.select(*(F.col(f"`{c}`") for c in kept), text_of(f"`{text}`").alias("__text")).mapInArrow(run, schema)


def bounds(docs: DataFrame, ranges: int, key: str = "doc_id") -> list[int]:
    """The first ids of about that many ranges of equal counts: a list as long as the parameter, from a mergeable sketch."""
    share = [i / ranges for i in range(1, ranges)]
    row = docs.agg(F.min(F.col(f"`{key}`")), F.percentile_approx(F.col(f"`{key}`"), share or [0.5], 10 * ranges)).first()
    return sorted({row[0], *(row[1] or [])} - {None})


def edited(docs: DataFrame, k: int = K, w: int | None = None, key: str = "doc_id", text: str = "text", ranges: int | None = None) -> DataFrame:
    """Each document's fingerprint beside that of its edited text: its last half replaced by the beginning of the next document's.

    Columns: key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    first = bounds(docs, ranges or 8 * parts, key)
    n = max(1, len(first))

    @F.pandas_udf("long")
    def place(ids):  # twice the range, plus one if the id begins it
        import numpy as np
        import pandas as pd

        at = np.searchsorted(np.array(first, np.int64), ids.fillna(np.iinfo(np.int64).min).to_numpy(np.int64), "right") - 1
        begins = (at >= 0) & (np.array(first, np.int64)[np.maximum(at, 0)] == ids.fillna(np.iinfo(np.int64).min).to_numpy(np.int64))
        return pd.Series(2 * np.maximum(at, 0) + begins)

    nulls = docs.filter(F.col(f"`{key}`").isNull()).limit(1).count() > 0
    at = (F.floor(F.col("__at") / 2)).cast("int")
    # the document that begins a range also ends the one before; null ids come first and so begin range 0
    begins = (F.col("__at") % 2 == 1) & (at > 0) | (at == 0) & (F.col("__id").isNull() if nulls else F.col("__at") % 2 == 1)
    place_of = place(F.col(f"`{key}`")) if first else F.lit(1).cast("long")
    rows = docs.select(F.col(f"`{key}`").alias("__id"), text_of(f"`{text}`").alias("__text"), place_of.alias("__at"))
    own = F.struct(at.alias("range"), F.lit(False).alias("next"))
    also = F.struct(F.pmod(at - 1, F.lit(n)).cast("int").alias("range"), F.lit(True).alias("next"))
    dealt = rows.select("__id", "__text", F.inline(F.when(begins, F.array(own, also)).otherwise(F.array(own))))
    dealt = dealt.repartition("range").sortWithinPartitions("range", "next", "__id", "__text").select("range", "next", "__id", "__text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces():
            for batch in batches:
                for at in range(0, batch.num_rows, 200):
                    yield from zip(*(batch.slice(at, 200).column(k).to_pylist() for k in range(4)), strict=True)

        names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        out, held, past = [], None, None
        for where, last, id_, body in pieces():
            if last and past == where:
                continue  # only the first of those that begin the next range
            print_ = winnow(body, k, w)
            if held is not None and held[0] == where:
                _, was, text_, had = held
                half = len(text_) // 2
                changed = text_[: len(text_) - half] + body[:half]
                new = winnow(changed, k, w)
                distinct = _distinct(had[0])
                out.append((was, len(text_), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), told(*had), told(*new), likeness(distinct, _distinct(new[0])), likeness(distinct, _distinct(print_[0]))))
                if len(out) >= 200:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
                    out = []
            held, past = (None if last else (where, id_, body, print_)), (where if last else past)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    found = dealt.mapInArrow(run, "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return found.withColumnRenamed("id", key)


def _distinct(hashes):
    import numpy as np

    return np.unique(hashes)
