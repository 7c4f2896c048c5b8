"""The registered queries of this package and their oracle SQL."""

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import shared_folder
from . import conversations, decontamination, fingerprints, jaccard, language, licenses, packing, pii, prefix_trie, sharding, tokens, urls, warc
from .shared import stored

QUERIES = {}
ORACLES = {}


def query(build):
    QUERIES[build.__name__] = build
    return build


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_fingerprints(spark, sf_dir):
    return fingerprints.edited_pairs(table(spark, sf_dir, "documents"))


@query
def op2_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))[1]


@query
def op9_sharding(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    narrow = sharding.assigned(docs).select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        "shard",
        "grown_shard",
    )
    return sharding.with_slots(stored(narrow, "shards"))


@query
def op7_jaccard_join(spark, sf_dir):
    return jaccard.classes(table(spark, sf_dir, "documents"))


@query
def op6_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs.where(F.col("doc_id").isNotNull() & ~language.held_out()))
    return language.predict(docs.select("doc_id", "text"), model).select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


@query
def op5_url_filter(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    model = urls.fit(urls.labelled_by_rules(pages))
    return urls.judge(pages.select("page_id", "url"), model).select("page_id", "host", "path", "rule", "verdict", "block_score")


@query
def op10_warc(spark, sf_dir):
    path = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    warc.write(warc.page_records(table(spark, sf_dir, "pages")), path)
    columns = "record_id string, record_type string, refers_to string, payload_digest string, payload_length long, payload binary"
    got = warc.read(spark, path, columns)
    number = lambda c: F.substring(c, len("urn:page:") + 1, 20).cast("long")
    full = F.col("record_type") == "response"
    return got.select(
        number("record_id").alias("page_id"),
        F.when(full, F.octet_length("payload").cast("long")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(full, F.sha1("payload")).otherwise(F.substring("payload_digest", len("sha1:") + 1, 40)).alias("payload_digest"),
        "record_type",
        number("refers_to").alias("refers_to"),
    )


ORACLES["op10_warc"] = """
WITH p AS (
    SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS digest FROM pages
), kept AS (
    SELECT digest, n, max(page_id) AS kept FROM p WHERE n >= 1000 GROUP BY digest, n
)
SELECT page_id, CAST(p.n AS BIGINT) AS payload_bytes, p.digest AS payload_digest,
    CASE WHEN page_id < kept THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN page_id < kept THEN kept END AS refers_to
FROM p LEFT JOIN kept ON p.digest = kept.digest AND p.n = kept.n
"""


@query
def op4_decontamination(spark, sf_dir):
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op8_pii(spark, sf_dir):
    found = pii.find(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")


@query
def op13_token_counts(spark, sf_dir):
    """A cache of its own, so that every run counts the whole table."""
    return tokens.count_tokens(table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/token-cache-{uuid.uuid4().hex}")


@query
def op11_conversation_repair(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    return conversations.repair(conversations.damaged(rows), rows)[1]


# CRC-32 of the ASCII string that the expression gives.
_CRC_TABLE = "list_transform(range(256), lambda x: list_reduce(list_concat([x], range(8)), lambda c, i: xor(c >> 1, 3988292384 * (c & 1))))"


def _crc32(text: str) -> str:
    bytes_of = f"list_transform(string_split({text}, ''), lambda x: CAST(ord(x) AS BIGINT))"
    step = "xor(c >> 8, v[CAST(1 + (xor(c, b) & 255) AS INTEGER)])"
    return f"xor(list_reduce(list_concat([4294967295], {bytes_of}), lambda c, b: {step}), 4294967295)"


# Costs and edits of the four grammar states, row by row from the end; then the edits from the front.
_WHITE = "[^\\x20\\x09-\\x0D]"
ORACLES["op11_conversation_repair"] = f"""
WITH RECURSIVE crc_table AS MATERIALIZED (SELECT {_CRC_TABLE} AS v),
given AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k
    FROM conversations
), drawn AS (SELECT *, {_crc32('k')} % 20 AS draw FROM given, crc_table),
bad AS (
    SELECT conv_id, turn, CASE draw WHEN 4 THEN 'user' ELSE role END AS role,
        CASE draw WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(CASE draw WHEN 0 THEN [] WHEN 3 THEN [0, 1] ELSE [0] END) AS copy
    FROM drawn
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
        count(*) OVER (PARTITION BY conv_id) AS n,
        regexp_extract(text, '({_WHITE})[\\x20\\x09-\\x0D]*$', 1) AS last
    FROM bad
), judged AS (
    SELECT conv_id, turn, i, n, role, text, left(role, 1) AS c,
        CASE WHEN last = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
             WHEN last NOT IN ('.', '!', '?') THEN 't' ELSE '-' END AS fault
    FROM placed
), back(conv_id, i, f0, f1, f2, f3, e0, e1, e2, e3) AS (
    SELECT DISTINCT conv_id, n + 1, 0, 6, 3, 0, '', 'I', 'I', '' FROM judged
    UNION ALL
    SELECT conv_id, i, f0, f1, f2, f3,
        CASE f0 WHEN d0 THEN 'D' WHEN 3 + f2 THEN 'I' WHEN k0 THEN 'K' ELSE 'R' END,
        CASE f1 WHEN d1 THEN 'D' WHEN 3 + f2 THEN 'I' WHEN k1 THEN 'K' ELSE 'R' END,
        CASE f2 WHEN d2 THEN 'D' WHEN 3 + f3 THEN 'I' WHEN k2 THEN 'K' ELSE 'R' END,
        CASE f3 WHEN d3 THEN 'D' WHEN 3 + f2 THEN 'I' WHEN k3 THEN 'K' ELSE 'R' END
    FROM (SELECT *, least(b0, 3 + f2) AS f0, least(b1, 3 + f2) AS f1 FROM (
        SELECT *, least(b2, 3 + b3) AS f2, least(b3, 3 + b2) AS f3 FROM (
            SELECT *, least(d0, k0, r0) AS b0, least(d1, k1, r0) AS b1, least(d2, k2, r2) AS b2, least(d3, k3, r0) AS b3 FROM (
                SELECT back.conv_id, j.i, 4 + f0 AS d0, 4 + f1 AS d1, 4 + f2 AS d2, 4 + f3 AS d3,
                    stay + CASE c WHEN 's' THEN f1 WHEN 'u' THEN f2 ELSE 1000000 END AS k0,
                    stay + CASE c WHEN 'u' THEN f2 ELSE 1000000 END AS k1,
                    stay + CASE c WHEN 'a' THEN f3 ELSE 1000000 END AS k2,
                    stay + CASE c WHEN 'u' THEN f2 ELSE 1000000 END AS k3,
                    stay + 3 + f2 AS r0, stay + 3 + f3 AS r2
                FROM back JOIN (SELECT *, CASE fault WHEN '-' THEN 0 WHEN 't' THEN 3 ELSE 1000000 END AS stay FROM judged) j
                    ON back.conv_id = j.conv_id AND back.i = j.i + 1))))
), edits AS (
    SELECT b.*, j.role, j.text, j.c FROM back b LEFT JOIN judged j ON b.conv_id = j.conv_id AND b.i = j.i
), forth(conv_id, i, g, audit, made) AS (
    SELECT DISTINCT conv_id, CAST(1 AS BIGINT), 0, '', CAST([] AS VARCHAR[]) FROM judged
    UNION ALL
    SELECT conv_id, CASE e WHEN 'I' THEN i ELSE i + 1 END,
        CASE WHEN e = 'D' THEN g WHEN e = 'K' THEN CASE c WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END WHEN g = 2 THEN 3 ELSE 2 END,
        audit || e,
        CASE e WHEN 'D' THEN made WHEN 'K' THEN list_append(made, role || ':' || text)
            ELSE list_append(made, CASE g WHEN 2 THEN 'assistant:' ELSE 'user:' END || CASE e WHEN 'R' THEN text ELSE '' END) END
    FROM (SELECT forth.*, role, text, c, CASE g WHEN 0 THEN e0 WHEN 1 THEN e1 WHEN 2 THEN e2 ELSE e3 END AS e
          FROM forth JOIN edits ON forth.conv_id = edits.conv_id AND forth.i = edits.i) WHERE e <> ''
), whole AS (
    SELECT conv_id, arg_max(audit, length(audit)) AS audit, arg_max(made, length(audit)) AS made FROM forth GROUP BY conv_id
), counted AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
        count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
        count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal
    FROM (SELECT *, lag(c) OVER (PARTITION BY conv_id ORDER BY i) || c AS pair FROM judged) GROUP BY conv_id
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
    coalesce(illegal, 0) AS illegal, CAST(coalesce(b.f0, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit,
    sha256(coalesce(array_to_string(made, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counted USING (conv_id) LEFT JOIN whole USING (conv_id)
    LEFT JOIN back b ON b.conv_id = o.conv_id AND b.i = 1
"""


@query
def op12_prefix_trie(spark, sf_dir):
    return prefix_trie.rebuilt_trie(table(spark, sf_dir, "conversations"))


# Prefixes as lists; subtrees by looking at every prefix of every node.
ORACLES["op12_prefix_trie"] = f"""
WITH crc_table AS MATERIALIZED (SELECT {_CRC_TABLE} AS v),
own AS (
    SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST, role, text) AS turns
    FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), drawn AS (SELECT *, CAST(k AS BIGINT) % 6 AS h FROM (SELECT *, {_crc32('CAST(conv_id AS VARCHAR)')} AS k FROM own, crc_table)),
made AS (
    SELECT c.conv_id, list_concat(CASE WHEN d.conv_id IS NULL THEN [] ELSE d.turns[1:c.h] END, c.turns[c.h + 1:]) AS turns
    FROM drawn c LEFT JOIN own d ON d.conv_id = c.conv_id - c.conv_id % 100
), steps AS (
    SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS depth FROM made
), members AS (
    SELECT conv_id, depth, turns[1:depth] AS prefix, len(turns) = depth AS ends FROM steps
), nodes AS (
    SELECT prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
        sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
    FROM members GROUP BY prefix, depth
), linked AS (
    SELECT n.*, p.conv_id AS parent_conv_id FROM nodes n LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.prefix = n.prefix[1:n.depth - 1]
), children AS (
    SELECT parent_conv_id, depth - 1 AS depth, count(*) AS n_children FROM linked WHERE depth > 0 GROUP BY ALL
), full_nodes AS (
    SELECT l.*, coalesce(c.n_children, 0) AS n_children,
        CASE WHEN l.depth = 0 THEN 0 ELSE (l.n_convs - 1) * length(l.prefix[l.depth].text) END AS saved
    FROM linked l LEFT JOIN children c ON c.parent_conv_id = l.conv_id AND c.depth = l.depth
), above AS (
    SELECT prefix[1:d] AS prefix, d AS depth, n_children, saved
    FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM full_nodes)
), totals AS (
    SELECT prefix, depth, count(*) FILTER (n_children = 0) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens FROM above GROUP BY ALL
)
SELECT f.conv_id, f.depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256
FROM full_nodes f JOIN totals t ON t.depth = f.depth AND t.prefix = f.prefix
"""


@query
def op3_license_scan(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


def _template_rows() -> str:
    return ", ".join("({}, '{}', '{}')".format(k, name, text.replace("'", "''")) for k, (name, text) in enumerate(licenses.TEMPLATES))


_GRAMS = "[array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]"
ORACLES["op3_license_scan"] = f"""
WITH t(template, license_id, text) AS (VALUES {_template_rows()}),
tw AS (SELECT template, license_id, regexp_extract_all(lower(text), '[a-z0-9\\x80-\\x{{10FFFF}}]+') AS w FROM t),
ts AS (SELECT template, license_id, unnest(list_distinct({_GRAMS})) AS g FROM tw),
tn AS (SELECT template, count(*) AS n_template FROM ts GROUP BY template),
dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9\\x80-\\x{{10FFFF}}]+') AS w FROM documents),
ds AS (SELECT doc_id, unnest(list_distinct({_GRAMS})) AS g FROM dw WHERE len(w) >= 5),
m AS (SELECT doc_id, license_id, template, count(*) AS n_shared FROM ds JOIN ts USING (g) GROUP BY ALL)
SELECT doc_id, license_id, CAST(template AS INTEGER) AS template, CAST(n_shared AS INTEGER) AS n_shared, CAST(n_template AS INTEGER) AS n_template
FROM m JOIN tn USING (template) WHERE n_shared >= {licenses.CONTAINED} * n_template
"""

# The words of a document, its shingles, the links between distinct sets, and their closure.
ORACLES["op7_jaccard_join"] = """
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents
), sets AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s
    FROM words
), items AS (
    SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets
), links AS (
    SELECT a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b USING (g)
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reached(a, b) AS (
    SELECT a, b FROM links UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a
)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, coalesce((SELECT min(b) FROM reached WHERE a = doc_id), doc_id) AS component_id FROM sets
"""
