"""The registered queries of the corpus operators and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, chat, html, licenses, mixing, quality, secrets, simhash, warc, winnow
from tidemark.llm.common import cut, table, text_of, word_count

#: Folder of the public vocabulary files.
TOKENIZERS = "/opt/tokenizers"


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    out = chat.format_chats(rows.unionByName(more)).select("conv_id", "valid", "first_bad_turn", "segments", "formatted", chat.read_turns(F.col("formatted")).alias("turns"))
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length(chat.read_loss_text(F.col("segments"))).cast("long").alias("loss_chars"),
        F.sha2(chat.read_loss_text(F.col("segments")), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
        "first_bad_turn",
    )


def op2_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "license_digest", "license")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mixed = mixing.mix(docs, word_count(text_of("text")), F.array("source"))
    own = F.get("__sources", 0)
    return mixed.select("doc_id", F.col("__size").alias("size"), own["size"].alias("source_size"), own["target"].alias("target"), (F.col("__size") * F.size("__copies")).cast("long").alias("taken"))


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"), keep=("doc_id",))
    n = lambda kind: F.size(F.filter("__base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(secrets.told(F.col("__base")), 256).alias("base_sha256"), secrets.told(F.col("__spans")).alias("spans"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.edited(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    printed = cut(simhash.fingerprints(table(spark, sf_dir, "documents"), keep=("doc_id",)))
    return simhash.with_components(printed).select("doc_id", simhash.hexed(F.col("__fp")).alias("fingerprint"), "component_id")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = quality.Rules()
    measured = cut(quality.measure(table(spark, sf_dir, "documents"), keep=("doc_id", "lang", "source")))
    q = [F.col(f"__quality.{c}") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return quality.judged(measured, rules).select("doc_id", *q, F.col("__base_failed").alias("base_failed"), F.col("__kept").alias("kept"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    arcs = warc.arc_of(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    found = warc.resolved(cut(warc.read(spark, warc.write(warc.convert(arcs, info=False)))))
    return found.select(
        F.col("http")["x-record-key"].cast("long").alias("page_id"),
        F.coalesce("__of.payload_bytes", "payload_bytes").alias("payload_bytes"),
        "payload_digest",
        "record_type",
        F.col("__of.key").cast("long").alias("refers_to"),
    )


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode_texts(docs, bpe.vocabulary(), ids=False)


QUERIES = {f.__name__: f for f in (op1_chat_formatting, op2_license_scans, op3_html_extraction, op4_mixing, op5_secret_scans, op6_fingerprints, op7_simhash, op8_quality_rules, op9_warc, op10_bpe)}
#: The template's marks and escapes, the machine's transitions and the digests.
CHAT_SQL = r"""
    WITH c AS (
        SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
    ), e AS (
        SELECT *, coalesce(role, '') AS r, coalesce(lag(role) OVER w, 'start') AS before, row_number() OVER w - 1 AS n,
            replace(replace(replace(text, '\', '\\'), '### ', '#\## '), '</turn>', '<\/turn>') AS escaped,
            CASE role WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Assistant' WHEN 'system' THEN 'System' END AS label
        FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
    ), m AS (
        SELECT *, (before || '|' || r) IN ('start|system', 'start|user', 'system|user', 'assistant|user', 'user|assistant') AS fine FROM e
    )
    SELECT conv_id, count(*) AS n_turns,
        sha256(string_agg(r || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
        CAST(coalesce(sum(length(text)) FILTER (r = 'assistant'), 0) AS BIGINT) AS loss_chars,
        sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (r = 'assistant'), '')) AS loss_sha256,
        CAST(sum(4 + length(label) + 2 + length(escaped) + 8) AS BIGINT) AS formatted_chars,
        bool_and(fine) AND arg_max(r, n) = 'assistant' AS valid,
        CAST(min(n) FILTER (NOT fine) AS INTEGER) AS first_bad_turn
    FROM m GROUP BY conv_id
"""


def quality_sql(rules: quality.Rules) -> str:
    """The base rule, the sketch and the joined thresholds in SQL."""
    edge = f"CASE WHEN bin = 0 THEN 0.0::DOUBLE ELSE pow({1.0 + rules.width}::DOUBLE, bin - 1) / 1000000.0::DOUBLE END"

    def level(name: str, *keys: str) -> str:
        by = "".join(f"{k}, " for k in keys)
        least = rules.least if keys else 0
        at = lambda q: f"min({edge}) FILTER (seen >= {q}::DOUBLE * rows)"
        return f"""{name} AS (SELECT {by}measure, {at(rules.start)} AS start, {at(rules.start)} - {at(rules.low)} AS below, {at(rules.high)} - {at(rules.start)} AS above
            FROM (SELECT *, sum(n) OVER (PARTITION BY {by}measure ORDER BY bin) AS seen, sum(n) OVER (PARTITION BY {by}measure) AS rows
                FROM (SELECT {by}measure, bin, count(*) AS n FROM binned GROUP BY ALL)) WHERE rows >= {least} GROUP BY {by}measure)"""

    start = "coalesce(own.start, by_lang.start, every.start)"
    top = f"{start} + {rules.spread}::DOUBLE * greatest(coalesce(own.below, by_lang.below, every.below), coalesce(usual.usual, every.above), {rules.width}::DOUBLE * {start})"
    return rf"""
    WITH d AS (SELECT row_number() OVER () AS id, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
    w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
    g AS (SELECT id, unnest(range(1, len(words) - 1)) AS i, unnest(list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2])) AS gram FROM w),
    s AS (SELECT id, i, count(*) OVER (PARTITION BY id, gram) AS n FROM g),
    r AS (SELECT id, count(DISTINCT place) AS n_repeat_words FROM (SELECT id, unnest([i, i + 1, i + 2]) AS place FROM s WHERE n > 1) GROUP BY id),
    q AS (SELECT id, doc_id, lang, source, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, len(lines) AS n_lines,
        CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM w LEFT JOIN r USING (id)),
    f AS (SELECT *, n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.max_repeat_percent} * n_words AS base_failed FROM q),
    m AS (SELECT id, lang, source, base_failed, unnest([NULL, n_words, n_lines, n_words]) AS share_of, unnest(['word_length', 'symbols', 'dup_lines', 'repeats']) AS measure,
        unnest([CASE WHEN n_words > 0 THEN word_chars::DOUBLE / n_words END, CASE WHEN n_words > 0 THEN n_symbols::DOUBLE / n_words END,
            CASE WHEN n_lines > 0 THEN n_dup_lines::DOUBLE / n_lines END, CASE WHEN n_words > 0 THEN n_repeat_words::DOUBLE / n_words END]) AS x FROM f),
    binned AS (SELECT *, CASE WHEN x > 0 THEN CAST(floor(ln(x * 1000000.0::DOUBLE) / ln({1.0 + rules.width}::DOUBLE)) AS INTEGER) + 1 ELSE 0 END AS bin FROM m WHERE NOT base_failed),
    {level("own", "lang", "source")}, {level("by_lang", "lang")}, {level("every")},
    usual AS (SELECT measure, CASE WHEN count(*) >= 3 THEN quantile_disc(above, 0.5) ELSE 0.0::DOUBLE END AS usual FROM own GROUP BY measure),
    t AS (SELECT m.id, m.x, m.share_of::DOUBLE AS n, {top} AS top FROM m
        LEFT JOIN own ON own.lang IS NOT DISTINCT FROM m.lang AND own.source IS NOT DISTINCT FROM m.source AND own.measure = m.measure
        LEFT JOIN by_lang ON by_lang.lang IS NOT DISTINCT FROM m.lang AND by_lang.measure = m.measure
        LEFT JOIN every ON every.measure = m.measure LEFT JOIN usual ON usual.measure = m.measure),
    v AS (SELECT id, bool_and(coalesce(x <= CASE WHEN n IS NULL THEN top ELSE top + {rules.noise}::DOUBLE * sqrt(top / n) + {rules.noise * rules.noise}::DOUBLE / n END, true)) AS fine FROM t GROUP BY id)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND fine AS kept FROM f JOIN v USING (id)
"""


ORACLE_SQL: dict[str, str] = {
    "op1_chat_formatting": CHAT_SQL,
    "op8_quality_rules": quality_sql(quality.Rules()),
    "op2_license_scans": licenses.sql(),
    "op9_warc": """
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS html, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS n, url FROM pages
        ), d AS (SELECT page_id, n, sha256(html) AS digest, min(page_id) OVER (PARTITION BY sha256(html)) AS first FROM p)
        SELECT page_id, n AS payload_bytes, digest AS payload_digest,
            CASE WHEN n >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN n >= 100 AND first <> page_id THEN first END AS refers_to
        FROM d
    """,
}
