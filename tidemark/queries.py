"""The registered queries of the table engine, each with its SQL for another engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import keys, status, values
from tidemark.operators import access, derive, lpm, reconcile
from tidemark.operators.index import Index, LPMIndex, by_revision
from tidemark.plans import commit
from tidemark.plans.engine import Engine, Table, TableSpec
from tidemark.streaming.changes import compacted

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def rows(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Primary index of each table, and its unique integer order.
PRIMARY = {
    "orders": Index("id", "o_orderkey", keys.uint64, unique=True),
    "customer": Index("id", "c_custkey", keys.uint64, unique=True),
    "part": Index("id", "p_partkey", keys.uint64, unique=True),
    "supplier": Index("id", "s_suppkey", keys.uint64, unique=True),
    "events": Index("id", "event_id", keys.uint64, unique=True),
    "nation": Index("id", "n_nationkey", keys.uint32, unique=True),
}


def live(spark: SparkSession, sf_dir: str, name: str, primary: Index | None = None) -> DataFrame:
    """A driver table as the live rows of a table version: with _pk, and its order in the file's key as revision."""
    x = primary or PRIMARY[name]
    return rows(spark, sf_dir, name).withColumn(access.PK, x.key()).withColumn(access.REV, F.col(x.column).cast("bigint") + 1)


def numbered(frame: DataFrame, *order: str | Column) -> DataFrame:
    """ord: positions in an order. Only for results that are the answer to one lookup."""
    return frame.withColumn("ord", F.row_number().over(Window.orderBy(*order)).cast("bigint"))


def loaded(spark: SparkSession, sf_dir: str, name: str, tracked: bool = False) -> tuple[Engine, Table, DataFrame]:
    """An engine with the driver table inserted in bulk in order of its key."""
    db = Engine(spark)
    source = rows(spark, sf_dir, name)
    t = db.create_table(TableSpec(name, source.schema, PRIMARY[name]))
    with db.write(t) as w:
        if tracked:
            t.keep = w.changes(t)
        w.insert_frame(t, source, PRIMARY[name].column)
    return db, t, source


# --- reads -----------------------------------------------------------------


@query("SELECT c_custkey, c_name, CAST(row_number() OVER (ORDER BY c_custkey) AS BIGINT) AS ord FROM customer")
def all_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return commit.running_count(live(spark, sf_dir, "customer"), "c_custkey", F.lit(True), "ord").select("c_custkey", "c_name", "ord")


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey = 42")
def get_primary(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = PRIMARY["customer"]
    return access.get(live(spark, sf_dir, "customer"), x, x.query(42)).select("c_custkey", "c_name", "c_acctbal")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey = -1")
def get_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = PRIMARY["customer"]
    return access.get(live(spark, sf_dir, "customer"), x, x.query(1 << 50)).select("c_custkey", "c_name")


PRIORITY = Index("priority", "o_orderpriority")


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority = '1-URGENT'")
def list_nonunique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.list_(live(spark, sf_dir, "orders"), PRIORITY, PRIORITY.query("1-URGENT")).select("o_orderkey", "o_orderpriority")


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority = '1-URGENT' ORDER BY o_orderkey LIMIT 1")
def get_nonunique_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.get(live(spark, sf_dir, "orders"), PRIORITY, PRIORITY.query("1-URGENT")).select("o_orderkey", "o_orderpriority")


NAME = Index("name", "c_name", unique=True)


@query("SELECT c_custkey, c_name, CAST(row_number() OVER (ORDER BY c_name) AS BIGINT) AS ord FROM customer WHERE starts_with(c_name, 'Customer#00000000')")
def prefix_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = access.prefix(live(spark, sf_dir, "customer"), NAME, NAME.query("Customer#00000000"))
    return numbered(found, access.KEY, access.PK).select("c_custkey", "c_name", "ord")


BRAND = Index("brand", "p_brand")


@query("SELECT p_partkey, p_brand, CAST(row_number() OVER (ORDER BY p_brand, p_partkey) AS BIGINT) AS ord FROM part WHERE starts_with(p_brand, 'Brand#1')")
def prefix_nonunique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered(access.prefix(live(spark, sf_dir, "part"), BRAND, BRAND.query("Brand#1")), access.KEY, access.PK).select("p_partkey", "p_brand", "ord")


TAG = Index("tag", "tags", multi=True)


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live(spark, sf_dir, "part").withColumn("tags", values.new_set(F.split("p_name", " ")))


@query(
    """SELECT p_partkey, tag, CAST(row_number() OVER (ORDER BY tag, p_partkey) AS BIGINT) AS ord FROM (
    SELECT p_partkey, list_min(list_filter(string_split(p_name, ' '), lambda x: starts_with(x, 'w'))) AS tag FROM part) WHERE tag IS NOT NULL"""
)
def prefix_multikey_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = access.prefix(tagged(spark, sf_dir), TAG, TAG.query("w"))
    return numbered(found, access.KEY, access.PK).select("p_partkey", F.col(access.KEY).cast("string").alias("tag"), "ord")


@query("SELECT p_partkey, p_name FROM part WHERE list_contains(string_split(p_name, ' '), 'widget')")
def list_multikey(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.list_(tagged(spark, sf_dir), TAG, TAG.query("widget")).select("p_partkey", "p_name")


@query("SELECT p_partkey, tag FROM (SELECT p_partkey, unnest(list_distinct(string_split(p_name, ' '))) AS tag FROM part) WHERE starts_with(tag, 'w')")
def prefix_unique_multikey(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = Index("tag", "tags", unique=True, multi=True)
    return access.prefix(tagged(spark, sf_dir), x, x.query("w")).select("p_partkey", F.col(access.KEY).cast("string").alias("tag"))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey >= 1000")
def lower_bound_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = PRIMARY["orders"]
    return access.lower_bound(live(spark, sf_dir, "orders"), x, x.query(1000)).select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT c_custkey, c_name FROM customer WHERE c_name >= 'Customer#000000100'")
def lower_bound_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.lower_bound(live(spark, sf_dir, "customer"), NAME, NAME.query("Customer#000000100")).select("c_custkey", "c_name")


@query("SELECT p_partkey, p_brand FROM part WHERE p_brand >= 'Brand#3'")
def lower_bound_nonunique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.lower_bound(live(spark, sf_dir, "part"), BRAND, BRAND.query("Brand#3")).select("p_partkey", "p_brand")


@query("SELECT p_partkey, tag FROM (SELECT p_partkey, list_min(list_filter(string_split(p_name, ' '), lambda x: x >= 'm')) AS tag FROM part) WHERE tag IS NOT NULL")
def lower_bound_multikey_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.lower_bound(tagged(spark, sf_dir), TAG, TAG.query("m")).select("p_partkey", F.col(access.KEY).cast("string").alias("tag"))


@query(
    """SELECT c_custkey, n, CAST(row_number() OVER (ORDER BY CASE WHEN n < 0 THEN n + 4294967296 ELSE n END, c_custkey) AS BIGINT) AS ord
    FROM (SELECT c_custkey, CAST(c_nationkey - 12 AS INTEGER) AS n FROM customer) WHERE n >= 5 OR n < 0"""
)
def lower_bound_signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = Index("n", "n", keys.int32)
    signed = live(spark, sf_dir, "customer").withColumn("n", (F.col("c_nationkey") - 12).cast("int"))
    return numbered(access.lower_bound(signed, x, x.query(5)), access.KEY, access.PK).select("c_custkey", "n", "ord")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey + 1 = 77")
def by_revision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.list_(live(spark, sf_dir, "orders"), None, by_revision(77)).select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey, o_orderkey + 1 AS rev FROM orders WHERE o_orderkey + 1 >= 1200")
def by_revision_lower_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.lower_bound(live(spark, sf_dir, "orders"), None, by_revision(1200)).select("o_orderkey", F.col(access.REV).alias("rev"))


@query("SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_partkey || '  ' || p_name, '1.*  c[a-z]+ ')")
def grep_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.grep(access.project(live(spark, sf_dir, "part"), ["P_PARTKEY", "p_name"]), "1.*  c[a-z]+ ")


@query("SELECT c_custkey, upper(c_mktsegment) AS segment, c_acctbal * 2 AS doubled FROM customer WHERE c_acctbal > 0")
def filter_map_collect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live(spark, sf_dir, "customer").filter("c_acctbal > 0").select("c_custkey", F.upper("c_mktsegment").alias("segment"), (F.col("c_acctbal") * 2).alias("doubled"))


# --- keys --------------------------------------------------------------------


@query("SELECT o_orderkey, printf('%016X', o_orderkey) AS k FROM orders")
def key_hex_uint64(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sf_dir, "orders").select("o_orderkey", F.hex(keys.uint64.column(F.col("o_orderkey"))).alias("k"))


@query("SELECT c_custkey, printf('%016X', c_nationkey - 12) AS k64, right(printf('%016X', c_nationkey - 12), 8) AS k32, right(printf('%016X', c_nationkey - 12), 4) AS k16 FROM customer")
def key_hex_signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("c_nationkey") - 12
    return rows(spark, sf_dir, "customer").select("c_custkey", *[F.hex(e.column(n)).alias(f"k{w}") for e, w in ((keys.int64, 64), (keys.int32, 32), (keys.int16, 16))])


@query("SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN '54' ELSE '46' END AS b, hex(c_name) AS s FROM customer")
def key_hex_bool_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sf_dir, "customer").select("c_custkey", F.hex(keys.boolean.column(F.col("c_acctbal") > 0)).alias("b"), F.hex(keys.string.column(F.col("c_name"))).alias("s"))


def address(key: str) -> Column:
    """A synthetic IPv4 number: 10.0.0.0/8 with the key spread over the rest."""
    return F.lit(10 * (1 << 24)).cast("bigint") + F.pmod(F.col(key) * 40503, F.lit(1 << 24))


ADDRESS = "(167772160 + (({0} * 40503) % 16777216))"


@query(f"SELECT c_custkey, '00000000000000000000FFFF' || printf('%08X', a - a % 4096) || '14' AS k FROM (SELECT c_custkey, {ADDRESS.format('c_custkey')} AS a FROM customer)")
def plain_netip_prefix_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    cidr = F.concat(keys.ipv4_text(address("c_custkey")), F.lit("/20"))
    return rows(spark, sf_dir, "customer").select("c_custkey", F.hex(keys.ipv4_prefix.column(cidr)).alias("k"))


# --- bit prefixes ----------------------------------------------------------


def networks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A network for each supplier: its synthetic address cut to 8, 12, 16 or 20 bits."""
    s = live(spark, sf_dir, "supplier").withColumn("len", (8 + 4 * F.pmod(F.col("s_suppkey"), F.lit(4))).cast("int"))
    s = s.withColumn("net", keys.masked(address("s_suppkey"), F.col("len")))
    return s.select("s_suppkey", "net", "len", F.concat(keys.ipv4_text(F.col("net")), F.lit("/"), F.col("len").cast("string")).alias("cidr"), access.PK, access.REV)


NETWORKS = f"""WITH s AS (SELECT s_suppkey, CAST(8 + 4 * (s_suppkey % 4) AS INTEGER) AS len, {ADDRESS.format('s_suppkey')} AS a FROM supplier),
    n AS (SELECT s_suppkey, len, a - a % CAST(pow(2, 32 - len) AS BIGINT) AS net FROM s),
    u AS (SELECT net, len, max(s_suppkey) AS s_suppkey FROM n GROUP BY net, len)"""
CIDR = LPMIndex("cidr", "cidr")


@query(
    NETWORKS
    + f""", c AS (SELECT c_custkey, {ADDRESS.format('c_custkey')} AS a FROM customer)
    SELECT c_custkey, arg_max(s_suppkey, len) AS s_suppkey, CAST(max(len) AS INTEGER) AS len FROM c JOIN u ON c.a - c.a % CAST(pow(2, 32 - len) AS BIGINT) = net GROUP BY c_custkey"""
)
def lpm_get_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest network of every customer's address."""
    stored = lpm.entries(networks(spark, sf_dir), CIDR)
    probes = rows(spark, sf_dir, "customer").select("c_custkey", address("c_custkey").alias("a"))
    bits = F.concat(F.lit("0" * 80 + "1" * 16), keys.ipv4_bits(F.col("a")))
    return lpm.probe(probes, bits, stored, ["s_suppkey", "len"]).select("c_custkey", "match.s_suppkey", "match.len")


@query(
    NETWORKS
    + f""", c AS (SELECT c_custkey, CAST({ADDRESS.format('c_custkey')} AS BIGINT) AS a FROM customer
        UNION ALL SELECT c_custkey, CAST({ADDRESS.format('c_custkey')} AS BIGINT) AS a FROM customer WHERE c_custkey % 2 = 0
        UNION ALL SELECT c_custkey, CAST(16909060 AS BIGINT) AS a FROM customer WHERE c_custkey % 5 = 0
        UNION ALL SELECT c_custkey, CAST(NULL AS BIGINT) AS a FROM customer WHERE c_custkey % 7 = 0), k AS (SELECT row_number() OVER () AS id, * FROM c)
    SELECT any_value(c_custkey) AS c_custkey, max(a) AS a, arg_max(s_suppkey, len) AS s_suppkey, CAST(max(len) AS INTEGER) AS len
    FROM k LEFT JOIN u ON k.a - k.a % CAST(pow(2, 32 - len) AS BIGINT) = net GROUP BY id"""
)
def lpm_probe_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest network of addresses that repeat, that no network covers, or that are null: every probe has its row."""
    stored = lpm.entries(networks(spark, sf_dir), CIDR)
    one = rows(spark, sf_dir, "customer").select("c_custkey", address("c_custkey").cast("bigint").alias("a"))
    more = [one.filter("c_custkey % 2 = 0"), one.filter("c_custkey % 5 = 0").withColumn("a", F.lit(16909060).cast("bigint")), one.filter("c_custkey % 7 = 0").withColumn("a", F.lit(None).cast("bigint"))]
    probes = one.unionByName(more[0]).unionByName(more[1]).unionByName(more[2])
    bits = F.concat(F.lit("0" * 80 + "1" * 16), keys.ipv4_bits(F.col("a")))
    return lpm.probe(probes, bits, stored, ["s_suppkey", "len"]).select("c_custkey", "a", "match.s_suppkey", "match.len")


@query(NETWORKS + " SELECT s_suppkey, net, len FROM u WHERE net >= 167772160 AND net < 168820736 AND len >= 12")
def lpm_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lpm.prefix(networks(spark, sf_dir), CIDR, CIDR.query("10.0.0.0/12")).select("s_suppkey", "net", "len")


@query(NETWORKS + " SELECT s_suppkey, net, len, CAST(row_number() OVER (ORDER BY net, len) AS BIGINT) AS ord FROM u WHERE net > 167837696 OR (net = 167837696 AND len >= 16)")
def lpm_lower_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lpm.lower_bound(networks(spark, sf_dir), CIDR, CIDR.query("10.1.0.0/16"))
    return numbered(found, "net", "len").select("s_suppkey", "net", "len", "ord")


@query(
    NETWORKS
    + """, d AS (SELECT * FROM u WHERE len >= 10 AND net >= 167772160 AND net < 171966464), t AS (SELECT net, len, s_suppkey FROM d ORDER BY len, net LIMIT 1)
    SELECT t.s_suppkey FROM t WHERE (SELECT count(*) FROM d WHERE d.net - d.net % CAST(pow(2, 32 - t.len) AS BIGINT) <> t.net) = 0
    UNION ALL SELECT s_suppkey FROM (SELECT s_suppkey FROM u WHERE len < 10 AND net = 167772160 - 167772160 % CAST(pow(2, 32 - len) AS BIGINT) ORDER BY len DESC LIMIT 1) WHERE (SELECT count(*) FROM d) = 0"""
)
def lpm_get_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key shorter than full width: what covers all networks within it, or else the longest around it."""
    return lpm.get(networks(spark, sf_dir), CIDR, CIDR.query("10.0.0.0/10")).select("s_suppkey")


@query(NETWORKS + " SELECT s_suppkey FROM n WHERE len = 8 AND net = 167772160")
def lpm_nonunique_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = LPMIndex("cidr", "cidr", unique=False)
    return lpm.list_(networks(spark, sf_dir), x, x.query("10.0.0.0/8"), covering=True).select("s_suppkey")


# --- writes ------------------------------------------------------------------


@query("SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_orderkey) AS BIGINT) AS rev FROM orders")
def revision_after_bulk_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    db, t, _ = loaded(spark, sf_dir, "orders")
    return db.read().frame(t).select("o_orderkey", F.col(access.REV).alias("rev"))


def users(spark: SparkSession, sf_dir: str) -> tuple[Engine, Table, DataFrame]:
    """An empty table of users' last events, and the events."""
    source = rows(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    db = Engine(spark)
    return db, db.create_table(TableSpec("users", source.schema, Index("id", "user_id", keys.uint64, unique=True))), source


def user_ops(source: DataFrame) -> DataFrame:
    return source.withColumn("_op", F.when(F.col("event_type") == "error", "delete").otherwise("insert"))


#: Events as operations on users: an error deletes its user, anything else replaces it. Effective ones count a revision each.
OPS = """WITH o AS (SELECT user_id, event_id, event_type, value, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'insert' END AS op FROM events{0}),
    e AS (SELECT *, lag(op) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM o),
    f AS (SELECT *, CAST(row_number() OVER (ORDER BY event_id) AS BIGINT) AS rev FROM e WHERE op = 'insert' OR before = 'insert'),
    l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM f)"""


@query("SELECT user_id, event_id, event_type, rev FROM (SELECT *, CAST(row_number() OVER (ORDER BY event_id) AS BIGINT) AS rev, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1")
def upsert_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    db, t, source = users(spark, sf_dir)
    with db.write(t) as w:
        w.insert_frame(t, source, "event_id")
    return db.read().frame(t).select("user_id", "event_id", "event_type", F.col(access.REV).alias("rev"))


@query(OPS.format("") + " SELECT user_id, event_id, event_type, rev FROM l WHERE n = 1 AND op = 'insert'")
def mixed_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    db, t, source = users(spark, sf_dir)
    with db.write(t) as w:
        w.apply(t, user_ops(source), "event_id")
    return db.read().frame(t).select("user_id", "event_id", "event_type", F.col(access.REV).alias("rev"))


@query(
    """SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, max(value) AS value, max(rev) AS rev
    FROM (SELECT *, CAST(row_number() OVER (ORDER BY event_id) AS BIGINT) AS rev FROM events) GROUP BY user_id"""
)
def modify_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    db, t, source = users(spark, sf_dir)
    with db.write(t) as w:
        w.modify_frame(t, source.filter("event_id % 2 = 0").unionByName(source.filter("event_id % 2 = 1")), "event_id", {"value": "max"})
    return db.read().frame(t).select("user_id", "event_id", "event_type", "value", F.col(access.REV).alias("rev"))


def _guards(spark: SparkSession, sf_dir: str, op: str) -> tuple[Engine, Table, DataFrame]:
    """Operations on orders that expect a revision: right, wrong, unguarded, or of an order that isn't there, applied in one transaction; their results."""
    db, t, _ = loaded(spark, sf_dir, "orders")
    at = db.read().frame(t).select("o_orderkey", F.col(access.REV).alias("rev"))
    ops = rows(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") * 2).alias("o_orderkey")).join(at, "o_orderkey", "left")
    expected = F.when(F.col("k") % 5 == 0, 0).when(F.col("k") % 3 == 0, 1).otherwise(F.coalesce("rev", F.lit(1))).cast("bigint")
    with db.write(t) as w:
        found = w.guard_frame(t, ops.select("o_orderkey", F.lit(0.5).alias("o_totalprice"), expected.alias("_expected"), F.lit(op).alias("_op")), "o_orderkey")
    return db, t, found


GUARDS = """WITH o AS (SELECT o_orderkey, o_totalprice, CAST(row_number() OVER (ORDER BY o_orderkey) AS BIGINT) AS rev FROM orders),
    j AS (SELECT p.o_orderkey * 2 AS o_orderkey, rev, CASE WHEN p.o_orderkey % 5 = 0 THEN 0 WHEN p.o_orderkey % 3 = 0 THEN 1 ELSE coalesce(rev, 1) END AS expected
        FROM orders p LEFT JOIN o ON p.o_orderkey * 2 = o.o_orderkey),
    a AS (SELECT o_orderkey, (SELECT count(*) FROM orders) + CAST(row_number() OVER (ORDER BY o_orderkey) AS BIGINT) AS rev FROM j WHERE expected = 0 OR rev = expected)"""


@query(GUARDS + " SELECT o_orderkey, CASE WHEN expected = 0 OR rev = expected THEN 'ok' WHEN rev IS NULL THEN 'missing' ELSE 'conflict' END AS result, rev IS NOT NULL AS had_old FROM j")
def cas_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _guards(spark, sf_dir, "insert")[2].select("o_orderkey", F.col("_result").alias("result"), F.col("_had_old").alias("had_old"))


@query(GUARDS + " SELECT o_orderkey, o_totalprice, rev FROM o WHERE o_orderkey NOT IN (SELECT o_orderkey FROM a) UNION ALL SELECT o_orderkey, 0.5::DOUBLE, rev FROM a")
def cas_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders after guarded writes in bulk."""
    db, t, _ = _guards(spark, sf_dir, "insert")
    return db.read().frame(t).select("o_orderkey", "o_totalprice", F.col(access.REV).alias("rev"))


@query(GUARDS + " SELECT o_orderkey, rev FROM o WHERE o_orderkey NOT IN (SELECT o_orderkey FROM a)")
def compare_and_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    db, t, _ = _guards(spark, sf_dir, "delete")
    return db.read().frame(t).select("o_orderkey", F.col(access.REV).alias("rev"))


@query("SELECT o_orderkey, (SELECT count(*) FROM orders) + CAST(row_number() OVER (ORDER BY o_orderkey) AS BIGINT) AS rev FROM orders WHERE o_orderkey % 3 = 0")
def delete_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deleted orders with their deletions' revisions; orders that aren't there count none."""
    db, t, source = loaded(spark, sf_dir, "orders", tracked=True)
    gone = source.filter("o_orderkey % 3 = 0")
    missing = gone.withColumn("o_orderkey", F.col("o_orderkey") + (1 << 40))
    with db.write(t) as w:
        w.delete_frame(t, gone.unionByName(missing), "o_orderkey")
    return db.read().graveyard(t).select("o_orderkey", F.col(access.REV).alias("rev"))


@query("SELECT c_custkey, (SELECT count(*) FROM customer) + CAST(row_number() OVER (ORDER BY c_custkey) AS BIGINT) AS rev FROM customer")
def delete_all_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    db, t, _ = loaded(spark, sf_dir, "customer", tracked=True)
    with db.write(t) as w:
        w.delete_all(t)
    return db.read().graveyard(t).select("c_custkey", F.col(access.REV).alias("rev"))


@query("SELECT p_partkey FROM part WHERE NOT starts_with(p_brand, 'Brand#1')")
def query_and_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    db, t, _ = loaded(spark, sf_dir, "part")
    with db.write(t) as w:
        w.delete_where(t, access.prefix(w.frame(t), BRAND, BRAND.query("Brand#1")))
    return db.read().frame(t).select("p_partkey")


@query("SELECT 'orders' AS name, count(*) AS objects, count(*) AS revision FROM orders UNION ALL SELECT 'customer', count(*), count(*) FROM customer")
def table_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for name in ("orders", "customer"):
        db, t, _ = loaded(spark, sf_dir, name)
        one = db.read().frame(t).agg(F.count(F.lit(1)).alias("objects")).select(F.lit(name).alias("name"), "objects", F.lit(db.read().revision(t)).cast("bigint").alias("revision"))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT c_custkey, c_name FROM customer")
def abort_is_noop(spark: SparkSession, sf_dir: str) -> DataFrame:
    db, t, source = loaded(spark, sf_dir, "customer")
    w = db.write(t)
    w.delete_frame(t, source, "c_custkey")
    w.abort()
    return db.read().frame(t).select("c_custkey", "c_name")


@query("SELECT 'n' AS t, CAST(n_nationkey AS BIGINT) AS k FROM nation UNION ALL SELECT 's', s_suppkey FROM supplier")
def multi_table_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = Engine(spark)
    own = {n: rows(spark, sf_dir, n) for n in ("nation", "supplier")}
    tables = {n: db.create_table(TableSpec(n, df.schema, PRIMARY[n])) for n, df in own.items()}
    before = db.read()
    with db.write(*tables.values()) as w:
        for n, t in tables.items():
            w.insert_frame(t, own[n], PRIMARY[n].column)
    assert before.revision(tables["nation"]) == 0
    r = db.read()
    pick = lambda n: r.frame(tables[n]).select(F.lit(n[0]).alias("t"), F.col(PRIMARY[n].column).cast("bigint").alias("k"))
    return pick("nation").unionByName(pick("supplier"))


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events WHERE event_id < 500) WHERE n = 1")
def snapshot_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The users as of revision 500, from the log of all revisions."""
    log = rows(spark, sf_dir, "events").withColumn("rev", F.col("event_id") + 1)
    return compacted(log, "user_id", "rev", 0, 500).select("user_id", "event_id", "event_type")


@query("SELECT o_orderkey, o_custkey, o_totalprice, CAST(row_number() OVER (ORDER BY o_orderkey) AS BIGINT) AS rev FROM orders QUALIFY o_orderkey >= 1000")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    db, t, _ = loaded(spark, sf_dir, "orders")
    return db.read().lower_bound(t, t.spec.primary.query(1000)).select("o_orderkey", "o_custkey", "o_totalprice", F.col(access.REV).alias("rev"))


# --- change feeds --------------------------------------------------------------


@query("SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_orderkey) AS BIGINT) AS rev, false AS deleted FROM orders")
def changes_initial(spark: SparkSession, sf_dir: str) -> DataFrame:
    db, t, _ = loaded(spark, sf_dir, "orders", tracked=True)
    return t.keep.frame(db.read()).select("o_orderkey", "rev", "deleted")


def _two_commits(spark: SparkSession, sf_dir: str) -> tuple[Engine, Table, int]:
    """Events below 500, then the rest, as operations on users, under a change iterator that has seen the first part."""
    db, t, source = users(spark, sf_dir)
    with db.write(t) as w:
        t.keep = w.changes(t)
        w.apply(t, user_ops(source.filter("event_id < 500")), "event_id")
    at = db.read().revision(t)
    t.keep.take_all(db.read())
    with db.write(t) as w:
        w.apply(t, user_ops(source.filter("event_id >= 500")), "event_id")
    return db, t, at


#: The object that a deletion carries is the one stored before it.
PAYLOAD = OPS.replace("lag(op) OVER (PARTITION BY user_id ORDER BY event_id) AS before", "lag(op) OVER (PARTITION BY user_id ORDER BY event_id) AS before, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS prior")


@query(PAYLOAD.format("") + " SELECT user_id, CASE WHEN op = 'delete' THEN prior ELSE event_id END AS event_id, rev, op = 'delete' AS deleted FROM l WHERE n = 1")
def changes_with_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    db, t, source = users(spark, sf_dir)
    with db.write(t) as w:
        t.keep = w.changes(t)
        w.apply(t, user_ops(source), "event_id")
    return t.keep.frame(db.read()).select("user_id", "event_id", "rev", "deleted")


CUT = ", c AS (SELECT max(rev) AS seen FROM f WHERE event_id < 500)"


@query(PAYLOAD.format("") + CUT + " SELECT user_id, CASE WHEN op = 'delete' THEN prior ELSE event_id END AS event_id, rev, op = 'delete' AS deleted FROM l, c WHERE n = 1 AND rev > seen")
def changes_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    db, t, _ = _two_commits(spark, sf_dir)
    return t.keep.frame(db.read()).select("user_id", "event_id", "rev", "deleted")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events WHERE event_id >= 200 AND event_id < 700) WHERE n = 1")
def changes_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compacted(rows(spark, sf_dir, "events"), "user_id", "event_id", 199, 699).select("user_id", "event_id", "event_type")


@query("SELECT o_orderkey, 2 * (SELECT count(*) FROM orders) + CAST(row_number() OVER (ORDER BY o_orderkey) AS BIGINT) AS rev, false AS deleted FROM orders")
def changes_reinsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders deleted and inserted again between two reads: only the insertions show."""
    db, t, source = loaded(spark, sf_dir, "orders", tracked=True)
    t.keep.take_all(db.read())
    with db.write(t) as w:
        w.delete_all(t)
        w.insert_frame(t, source, "o_orderkey")
    return t.keep.frame(db.read()).select("o_orderkey", "rev", "deleted")


@query(PAYLOAD.format("") + " SELECT user_id, prior AS event_id, rev FROM l WHERE n = 1 AND op = 'delete'")
def graveyard_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    db, t, _ = _two_commits(spark, sf_dir)
    return db.read().graveyard(t).select("user_id", "event_id", F.col(access.REV).alias("rev"))


@query(OPS.format("") + CUT + " SELECT user_id, rev FROM l, c WHERE n = 1 AND op = 'delete' AND rev > seen")
def graveyard_after_gc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a tracker that has seen the first part still needs."""
    db, t, _ = _two_commits(spark, sf_dir)
    db.gc()
    return db.read().graveyard(t).select("user_id", F.col(access.REV).alias("rev"))


# --- derived tables and reconciliation -----------------------------------------


@query(
    """SELECT o_orderkey AS id, o_orderstatus = 'P' AS deleted FROM orders WHERE o_orderpriority <> '5-LOW' AND NOT (o_orderstatus = 'O' AND o_orderkey % 2 = 0)"""
)
def derive_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders into a derived table: low priority is skipped, then open even ones are deleted and pending ones updated."""
    db, t, source = loaded(spark, sf_dir, "orders", tracked=True)
    schema = "id bigint, deleted boolean"
    out = db.create_table(TableSpec("derived", spark.createDataFrame([], schema).schema, Index("id", "id", keys.uint64, unique=True)))

    def transform(c: DataFrame) -> DataFrame:
        action = F.when(F.col("o_orderpriority") == "5-LOW", derive.SKIP).when(~F.col("deleted"), derive.INSERT).when(F.col("o_orderstatus") == "O", derive.DELETE).otherwise(derive.UPDATE)
        return c.select(F.col("o_orderkey").alias("id"), "deleted", "rev", action.alias("_action"))

    feed = derive.Derived(t.keep, t, out, transform)
    feed.step()
    with db.write(t) as w:
        w.delete_frame(t, source.filter("o_orderstatus = 'P' or (o_orderstatus = 'O' and o_orderkey % 2 = 0)"), "o_orderkey")
    feed.step()
    return db.read().frame(out).select("id", "deleted")


STATUS = "CASE o_orderstatus WHEN 'F' THEN 'Done' WHEN 'O' THEN 'Pending' ELSE 'Error' END"


def with_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as objects to reconcile: filled ones are done since their date, open ones are pending, the others failed."""
    kind = F.when(F.col("o_orderstatus") == "F", "Done").when(F.col("o_orderstatus") == "O", "Pending").otherwise("Error")
    return live(spark, sf_dir, "orders").withColumn("status", F.struct(kind.alias("kind"), F.unix_timestamp("o_orderdate").cast("double").alias("updated_at"), F.lit("").alias("error"), F.col("o_orderkey").alias("id")))


@query(f"SELECT o_orderkey, o_orderkey + 1 AS rev FROM (SELECT *, {STATUS} AS kind FROM orders) WHERE kind = 'Pending' AND o_orderkey + 1 > 300")
def reconcile_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live objects after a revision that wait for an operation."""
    return reconcile.due(with_status(spark, sf_dir), 300).select("o_orderkey", F.col(access.REV).alias("rev"))


@query(f"SELECT o_orderkey, CASE WHEN kind <> 'Pending' THEN kind WHEN o_orderkey % 7 = 0 THEN 'Error' ELSE 'Done' END AS kind FROM (SELECT *, {STATUS} AS kind FROM orders) WHERE NOT (o_orderkey % 11 = 0)")
def reconcile_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statuses after a round: results of pending objects are stored where the revision is still the processed one; those of deleted objects are dropped."""
    objects = with_status(spark, sf_dir)
    results = reconcile.due(objects, 0).select(access.PK, F.col(access.REV).alias("_processed"), F.col("status.id").alias("_status_id"), F.when(F.col("o_orderkey") % 7 == 0, "failed").alias("_error"))
    now = objects.filter("o_orderkey % 11 <> 0")
    return reconcile.with_results(now, results, at=0.0).select("o_orderkey", F.col("status.kind").alias("kind"))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderdate <= TIMESTAMP '1996-01-01'")
def refresh_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.refresh_due(with_status(spark, sf_dir), 820454400.0).select("o_orderkey")


@query("SELECT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 2 = 0)")
def prune_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects of the target that aren't desired."""
    desired = rows(spark, sf_dir, "documents").filter("doc_id % 2 = 0")
    return reconcile.prune(rows(spark, sf_dir, "labels"), desired, "doc_id").select("doc_id")


@query("SELECT CAST(range AS BIGINT) AS attempt, least(60.0::DOUBLE, 0.1::DOUBLE * pow(2, range)) AS delay FROM range(20)")
def backoff_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(20).select(F.col("id").alias("attempt"), status.backoff_column(F.col("id")).alias("delay"))


@query("SELECT o_orderkey, CASE substr(o_orderstatus, 1, 1) WHEN 'F' THEN '44' WHEN 'O' THEN '50' ELSE '45' END AS k FROM orders")
def status_kind_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_status(spark, sf_dir).select("o_orderkey", F.hex(status.kind_key_column(F.col("status.kind"))).alias("k"))


# --- map and set values --------------------------------------------------------

WORDS = "list_sort(list_distinct(string_split(p_name, ' ')))"


def sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    other = F.split(F.concat_ws(" ", F.lit("widget"), F.lit("cold"), F.col("p_brand")), " ")
    return rows(spark, sf_dir, "part").select("p_partkey", values.new_set(F.split("p_name", " ")).alias("a"), values.new_set(other).alias("b"))


BOTH = f"WITH s AS (SELECT p_partkey, {WORDS} AS a, list_sort(['widget', 'cold', p_brand]) AS b FROM part)"


@query(BOTH + " SELECT p_partkey, array_to_string(list_sort(list_distinct(list_concat(a, b))), ',') AS u FROM s")
def set_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets(spark, sf_dir).select("p_partkey", F.array_join(values.set_union(F.col("a"), F.col("b")), ",").alias("u"))


@query(BOTH + " SELECT p_partkey, array_to_string(list_filter(a, lambda x: NOT list_contains(b, x)), ',') AS d FROM s")
def set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets(spark, sf_dir).select("p_partkey", F.array_join(values.set_difference(F.col("a"), F.col("b")), ",").alias("d"))


@query(BOTH + " SELECT p_partkey, a = list_sort(list_distinct(list_append(a, 'widget'))) AS has, CAST(len(list_filter(a, lambda x: x <> 'cold')) AS INTEGER) AS n, a = b AS same FROM s")
def set_equal_add_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("a")
    return sets(spark, sf_dir).select("p_partkey", (values.set_add(a, F.lit("widget")) == a).alias("has"), values.set_len(values.set_delete(a, F.lit("cold"))).alias("n"), values.set_equal(a, F.col("b")).alias("same"))


def maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = values.new_set(F.split("p_name", " "))
    return rows(spark, sf_dir, "part").select("p_partkey", F.map_from_entries(F.transform(words, lambda w: F.struct(w, F.length(w)))).alias("m"))


@query(f"SELECT p_partkey, array_to_string(list_filter({WORDS}, lambda x: starts_with(x, 'w')), ',') AS k FROM part")
def map_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maps(spark, sf_dir).select("p_partkey", F.array_join(F.transform(values.map_prefix(F.col("m"), "w"), lambda e: e["key"]), ",").alias("k"))


@query(f"SELECT p_partkey, array_to_string(list_filter({WORDS}, lambda x: x >= 'm'), ',') AS k FROM part")
def map_lower_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maps(spark, sf_dir).select("p_partkey", F.array_join(F.transform(values.map_lower_bound(F.col("m"), F.lit("m")), lambda e: e["key"]), ",").alias("k"))


@query(f"""SELECT p_partkey, '[' || array_to_string(list_transform({WORDS}, lambda x: '{{"k":"' || x || '","v":' || length(x) || '}}'), ',') || ']' AS j FROM part""")
def map_entries_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maps(spark, sf_dir).select("p_partkey", values.map_json(F.col("m")).alias("j"))


@query(f"SELECT p_partkey, CAST(len(list_filter({WORDS}, lambda x: x <> 'cold')) + 1 AS INTEGER) AS n, CASE WHEN list_contains({WORDS}, 'widget') THEN 6 END AS w, CAST(99 AS INTEGER) AS z FROM part")
def map_set_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = values.map_set(values.map_delete(F.col("m"), F.lit("cold")), F.lit("~"), F.lit(99))
    return maps(spark, sf_dir).select("p_partkey", values.map_len(m).alias("n"), values.map_get(m, F.lit("widget")).alias("w"), values.map_get(m, F.lit("~")).alias("z"))


# --- sinks -----------------------------------------------------------------------


@query("""SELECT '{"r_regionkey":' || r_regionkey || ',"r_name":"' || r_name || '"}' AS json FROM region""")
def dump_json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sf_dir, "region").select(F.to_json(F.struct("r_regionkey", "r_name")).alias("json"))
