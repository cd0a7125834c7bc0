"""Access methods against plain Python on random keys, many at once."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import keys
from tidemark.operators import access, lpm
from tidemark.operators.index import Index, LPMIndex, Query

A = Index("a", "a", keys.binary, unique=True)
B = Index("b", "b", keys.binary)
MANY = Index("many", "many", keys.binary, multi=True)


def random_bytes(rnd):
    return bytes(rnd.choice((0, 1, 97, 98, 254, 255)) for _ in range(rnd.randrange(0, 5)))


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(11)
    return list({a: (a, random_bytes(rnd), [random_bytes(rnd) for _ in range(rnd.randrange(4))]) for a in (random_bytes(rnd) for _ in range(400))}.values())


@pytest.fixture(scope="module")
def live(spark, rows):
    df = spark.createDataFrame([(bytearray(a), bytearray(b), [bytearray(x) for x in m]) for a, b, m in rows], "a binary, b binary, many array<binary>")
    return df.withColumn(access.PK, F.col("a")).withColumn(access.REV, F.lit(1)).cache()


def found(frame):
    return [bytes(r.a) for r in frame.collect()]


@pytest.mark.parametrize("seed", range(4))
def test_byte_order(live, rows, seed):
    k = random_bytes(random.Random(100 + seed))
    at = lambda index: Query(index.name, k)
    assert found(access.list_(live, B, at(B))) == sorted(a for a, b, _ in rows if b == k)
    assert found(access.prefix(live, A, at(A))) == sorted(a for a, *_ in rows if a.startswith(k))
    assert found(access.lower_bound(live, A, at(A))) == sorted(a for a, *_ in rows if a >= k)
    assert found(access.prefix(live, B, at(B))) == [a for _, a in sorted((b, a) for a, b, _ in rows if b.startswith(k))]
    assert found(access.lower_bound(live, B, at(B))) == [a for _, a in sorted((b, a) for a, b, _ in rows if b >= k)]
    # each object once, at its first matching key
    for method, fits in ((access.prefix, lambda x: x.startswith(k)), (access.lower_bound, lambda x: x >= k)):
        assert found(method(live, MANY, at(MANY))) == [a for _, a in sorted((min(filter(fits, m)), a) for a, _, m in rows if any(map(fits, m)))]
    assert found(access.list_(live, MANY, at(MANY))) == sorted(a for a, _, m in rows if k in m)


def test_bit_prefixes(spark):
    rnd = random.Random(5)
    stored = {(n := rnd.randrange(7), rnd.randrange(64) >> (6 - n) << (6 - n)) for _ in range(14)}
    rows = [(i, value, length) for i, (length, value) in enumerate(sorted(stored))]
    live = spark.createDataFrame(rows, "id long, v long, len int").withColumn(access.PK, keys.uint64.column(F.col("id"))).withColumn(access.REV, F.col("id") + 1).cache()
    x = LPMIndex("v", "v", kind="int", width=6, length="len")
    own = [(f"{v:06b}"[:n], i) for i, v, n in rows]
    order = lambda xs: [i for _, _, i in sorted((b.ljust(6, "0"), len(b), i) for b, i in xs)]
    for length, value in ((0, 0), (2, 0b110000), (3, 0b101000), (6, 0b101101), (6, 0b000001), (4, 0b011100)):
        q = x.query(value, length)
        ids = lambda f: [r.id for r in f.collect()]
        assert ids(lpm.prefix(live, x, q)) == order((b, i) for b, i in own if b.startswith(q.bits))
        assert ids(lpm.lower_bound(live, x, q)) == order((b, i) for b, i in own if (b.ljust(6, "0"), len(b)) >= (q.bits.ljust(6, "0"), len(q.bits)))
        within = [(b, i) for b, i in own if b.startswith(q.bits)] if length < 6 else []
        covering = [(b, i) for b, i in own if q.bits.startswith(b)]
        if within:
            want = [i for b, i in within if all(c.startswith(b) for c, _ in within)]
        else:
            want = [max(covering, key=lambda t: len(t[0]))[1]] if covering else []
        assert ids(lpm.get(live, x, q)) == want
