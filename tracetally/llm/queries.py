"""The registered queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

import corpus_pipeline

from . import chat, decontam, exact_dedup, line_dedup, packing, pii, pitman_yor, quality, secret_scan, simhash, turn_repair, warc, whitening
from .common import span_digest, table

TOKENIZER = "word_bpe_49k.json"


def op1_secret_scan(s, d):
    found = secret_scan.find_secrets(table(s, d, "documents"))
    digest = lambda base: span_digest(F.col("spans"), base, secret_scan.KINDS)  # noqa: E731
    return found.select(
        "doc_id", *[secret_scan.counted(k).alias(f"n_{k}") for k in secret_scan.KINDS[:3]],
        F.sha2(digest(True), 256).alias("base_sha256"), digest(False).alias("spans"),
    )  # fmt: skip


def op2_best_fit_packing(s, d):
    packed = packing.pack(table(s, d, "documents"), TOKENIZER)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op3_simhash(s, d):
    near = simhash.near_groups(table(s, d, "documents"))
    return near.select("doc_id", simhash.hex_fingerprint().alias("fingerprint"), "component_id")


def op4_pii(s, d):
    found = pii.find_pii(table(s, d, "documents"))
    digest = lambda base: span_digest(F.col("spans"), base, pii.KINDS)  # noqa: E731
    return found.select(
        "doc_id", *[pii.counted(k).alias(f"n_{k}") for k in pii.KINDS],
        F.sha2(digest(True), 256).alias("base_sha256"), digest(False).alias("spans"),
    )  # fmt: skip


def op5_decontamination(s, d):
    """One row per document and test item that it holds."""
    leaks = decontam.find_leaks(table(s, d, "documents"), table(s, d, "benchmark"))
    return leaks.select("doc_id", "item_id", F.round("score", 6).alias("score"), "seeds", "word_end")


def op6_line_dedup(s, d):
    """One row per document: how many lines it has, and which an earlier line makes superfluous."""
    report = line_dedup.line_report(table(s, d, "documents"), shortest=line_dedup.SHORTEST)
    return report.select("doc_id", "n_lines", F.size("removed").alias("n_removed"), F.array_join("removed", ",").alias("removed_lines"))


def op7_quality(s, d):
    docs = table(s, d, "documents")
    return quality.score(docs, quality.fit(docs, table(s, d, "labels")))


def op8_exact_dedup(s, d):
    return exact_dedup.exact_groups(table(s, d, "documents"))


# Every page is a full response; two of three are asked for again later, under another spelling of the URL.
CAPTURES = """
SELECT page_id * 4 AS record_id, url, page_id * 60 AS captured, 200 AS status, html, CAST(NULL AS BIGINT) AS asked FROM pages
UNION ALL SELECT page_id * 4 + 1, replace(replace(url, 'http://', 'HTTP://WWW.'), '/en/', '/en/') || CASE WHEN page_id % 2 = 0 THEN '#again' ELSE '' END,
  page_id * 60 + 30 + (page_id % 5) * 40000, 304, html, page_id FROM pages WHERE page_id % 3 <> 0
UNION ALL SELECT page_id * 4 + 2, url, page_id * 60 - 7, 304, html, page_id FROM pages WHERE page_id % 11 = 0
UNION ALL SELECT page_id * 4 + 3, url, page_id * 60 + 90000, 200, html || ' ', CAST(NULL AS BIGINT) FROM pages WHERE page_id % 7 = 0"""


def captures(pages):
    """Web archive records: responses of all pages and revisits of most, with validators from the page's text."""
    rows = pages.sparkSession.sql(CAPTURES.replace("FROM pages", "FROM {pages}"), pages=pages)
    tag = F.concat(F.when(F.col("status") == 304, F.lit("W/")).otherwise(F.lit("")), F.lit('"'), F.md5(F.col("html").cast("binary")), F.lit('"'))
    tag = F.when(F.col("asked") % 13 == 5, F.lit('"gone"')).when(F.col("asked") % 13 == 6, F.lit(None)).otherwise(tag)
    fields = {
        "etag": tag,
        "last-modified": F.when(F.col("asked") % 26 == 6, F.lit("never")).otherwise(F.lit("once")),
        "date": F.col("captured").cast("string"),
        "server": F.concat(F.lit("s"), (F.col("record_id") % 3).cast("string")),
        "cache-control": F.when(F.col("record_id") % 5 > 1, F.concat(F.lit("max-age="), (F.col("record_id") % 100).cast("string"))),
        "content-type": F.when(F.col("status") == 200, F.lit("text/html")).otherwise(F.lit("text/plain")),
    }
    headers = F.map_filter(F.create_map(*[x for k, v in fields.items() for x in (F.lit(k), v)]), lambda _, v: v.isNotNull())
    return rows.select("record_id", "url", "captured", "status", headers.alias("headers"))


def op9_warc_revisits(s, d):
    resolved = warc.resolve(captures(table(s, d, "pages")))
    return resolved.select("record_id", "canonical_url", "captured", "response_id", "outcome", warc.header_lines(F.col("headers")).alias("header_lines"))


def op10_chat_formatting(s, d):
    return chat.format_chats(table(s, d, "conversations"))


def op11_pitman_yor(s, d):
    return pitman_yor.scores(table(s, d, "documents"))


def op12_whitening(s, d):
    white = whitening.whiten(table(s, d, "embeddings"))
    return white.withColumn("deviation", F.expr("try_cast(deviation AS BIGINT)"))


def op13_turn_repair(s, d):
    return turn_repair.repair(table(s, d, "conversations"), damage=turn_repair.damaged)


QUERIES = {
    f.__name__: f
    for f in (
        op1_secret_scan, op2_best_fit_packing, op3_simhash, op4_pii, op5_decontamination,
        op6_line_dedup, op7_quality, op8_exact_dedup, op9_warc_revisits, op10_chat_formatting,
        op11_pitman_yor, op12_whitening, op13_turn_repair,
    )
}  # fmt: skip
QUERIES["pipeline"] = corpus_pipeline.run

SPACES = r"[\x20\x09-\x0D]"


def repair_sql() -> str:
    """Reference SQL of op13: the least (cost, audit) per state, row after row; a state is one text, cost and audit first."""

    def put(v: str, cost: str, letter: str, line: str = "''", when: str = "true") -> str:
        at = f"strpos({v}, chr(1))"
        return f"CASE WHEN {when} THEN printf('%09d', CAST(substr({v}, 1, 9) AS INTEGER) + {cost}) || substr({v}, 10, {at} - 10) || '{letter}' || substr({v}, {at}) || {line} END"

    kept, user, assistant = "chr(10) || role || ':' || text", "chr(10) || 'user:' || text", "chr(10) || 'assistant:' || text"
    add_user, add_assistant = "chr(10) || 'user:'", "chr(10) || 'assistant:'"
    may, late = "NOT gone", "(CASE WHEN cut THEN 3 ELSE 0 END)"
    before_user = "least(c0, cs, ca)"
    return rf"""
WITH RECURSIVE bytes AS (SELECT range AS i FROM range(256)),
{", ".join(f"b{k + 1} AS (SELECT i, xor(c >> 1, 3988292384 * (c & 1)) AS c FROM (SELECT i, {'i' if k == 0 else 'c'} AS c FROM {'bytes' if k == 0 else f'b{k}'}))" for k in range(8))},
crc AS (SELECT list(c ORDER BY i) AS lot FROM b8),
named AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS spot FROM conversations),
lots AS (SELECT n.*, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(spot, ''), lambda x: CAST(ascii(x) AS BIGINT))),
  lambda c, b: xor(c >> 8, lot[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS lot FROM named n, crc),
hurt AS (SELECT conv_id, turn, CASE WHEN lot = 4 THEN 'user' ELSE role END AS role,
  CASE lot WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN lot = 3 THEN 2 ELSE 1 END)) AS copy FROM lots WHERE lot <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS pos FROM hurt),
seen AS (SELECT *, NOT regexp_matches(text, '[^ 	-]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS again,
  NOT regexp_matches(text, '[.!?]{SPACES}*$') AS cut, substr(role, 1, 1) AS ini, lead(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS next_ini FROM placed),
marked AS (SELECT *, blank OR again AS gone FROM seen),
w AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS pos, '000000000' || chr(1) AS c0, CAST(NULL AS VARCHAR) AS cs,
  '000000003I' || chr(1) || {add_user} AS cu, '000000006II' || chr(1) || {add_user} || {add_assistant} AS ca FROM marked
 UNION ALL
 SELECT conv_id, pos, c0, cs, cu, least(ca, {put("cu", "3", "I", add_assistant)}) AS ca FROM (
  SELECT conv_id, pos, c0, cs, least(cu, {put("c0", "3", "I", add_user)}, {put("cs", "3", "I", add_user)}, {put("ca", "3", "I", add_user)}) AS cu, ca FROM (
   SELECT w.conv_id, m.pos, {put("c0", "4", "D")} AS c0,
    least({put("cs", "4", "D")}, {put("c0", late, "K", kept, may + " AND ini = 's'")}) AS cs,
    least({put("cu", "4", "D")}, {put(before_user, late, "K", kept, may + " AND ini = 'u'")}, {put(before_user, "3 + " + late, "R", user, may)}) AS cu,
    least({put("ca", "4", "D")}, {put("cu", late, "K", kept, may + " AND ini = 'a'")}, {put("cu", "3 + " + late, "R", assistant, may)}) AS ca
   FROM w JOIN marked m ON m.conv_id IS NOT DISTINCT FROM w.conv_id AND m.pos = w.pos + 1))),
ended AS (SELECT conv_id, least(c0, ca) AS v FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY pos DESC) AS k FROM w) WHERE k = 1),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (NOT blank AND again) AS duplicate,
  count(*) FILTER (NOT gone AND cut) AS truncated, count(*) FILTER (next_ini IS NOT NULL AND ini || next_ini NOT IN ('su', 'ua', 'au')) AS illegal FROM marked GROUP BY conv_id),
all_ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT i.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(CAST(substr(v, 1, 9) AS BIGINT), 0) AS cost, coalesce(substr(v, 10, strpos(v, chr(1)) - 10), '') AS audit, sha256(coalesce(substr(v, strpos(v, chr(1)) + 2), '')) AS repaired_sha256
FROM all_ids i LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM i.conv_id"""


ORACLES = {
    "op8_exact_dedup": rf"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '{SPACES}', '', 'g') AS body FROM documents),
r AS (SELECT doc_id, body, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY body) AS group_size, row_number() OVER w AS place
  FROM d WINDOW w AS (PARTITION BY body ORDER BY points DESC, doc_id NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(body) AS text_sha256 FROM r""",
    "op9_warc_revisits": rf"""
WITH c AS ({CAPTURES}),
f AS (SELECT *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare,
  CASE WHEN asked % 13 = 5 THEN '"gone"' WHEN asked % 13 = 6 THEN NULL ELSE '"' || md5(html) || '"' END AS etag,
  CASE WHEN asked % 26 = 6 THEN 'never' ELSE 'once' END AS modified,
  CASE WHEN record_id % 5 > 1 THEN 'max-age=' || (record_id % 100) END AS cache FROM c),
g AS (SELECT *, regexp_replace(bare, '\?.*$', '') AS place, list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'),
  lambda p: p <> '' AND NOT regexp_matches(p, '^(?:ref|fbclid|gclid|utm_[a-z]+)(?:=|$)'))) AS query FROM f),
u AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_replace(place, '/.*$', '')), ':(?:80|443)$', ''), '^(?:www|m)\.', '')
  || regexp_replace(regexp_extract(place, '^[^/]*(/.*)$', 1), '/+$', '') || CASE WHEN len(query) > 0 THEN '?' || array_to_string(query, '&') ELSE '' END AS canonical_url FROM g),
m AS (SELECT r.*, s.record_id AS sid, s.etag AS stag, s.modified AS smod, s.cache AS scache, row_number() OVER (PARTITION BY r.record_id ORDER BY s.captured DESC, s.record_id DESC) AS k
  FROM u r LEFT JOIN u s ON s.status = 200 AND s.canonical_url = r.canonical_url AND s.captured < r.captured WHERE r.status = 304),
o AS (SELECT *, CASE WHEN sid IS NULL THEN 'no_response' WHEN CASE WHEN etag IS NOT NULL AND stag IS NOT NULL THEN etag = stag ELSE modified = smod END THEN 'resolved'
  ELSE 'validator_mismatch' END AS outcome FROM m WHERE k = 1)
SELECT record_id, canonical_url, captured, sid AS response_id, outcome,
  CASE WHEN outcome = 'resolved' THEN coalesce('cache-control: ' || coalesce(cache, scache) || chr(10), '') || 'content-type: text/html' || chr(10) || 'date: ' || captured || chr(10)
    || 'etag: ' || coalesce('W/' || etag, stag) || chr(10) || 'last-modified: ' || smod || chr(10) || 'server: s' || (sid % 3) END AS header_lines FROM o""",
    "op10_chat_formatting": """
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos FROM conversations),
p AS (SELECT *, string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER w AS upto, max(pos) OVER (PARTITION BY conv_id) AS n_turns
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
b AS (SELECT DISTINCT pos, upto FROM p WHERE pos < n_turns),
f AS (SELECT p.* FROM p WHERE pos = n_turns AND NOT EXISTS (SELECT 1 FROM b WHERE b.pos = p.pos AND b.upto = p.upto)),
k AS (SELECT min(conv_id) AS conv_id, n_turns, count(*) AS copies FROM f GROUP BY upto, n_turns)
SELECT k.conv_id, k.n_turns, k.copies, string_agg('<|im_start|>' || role || chr(10) || replace(replace(text, '<|im_', '< |im_'), '|>', '| >') || '<|im_end|>' || chr(10), '' ORDER BY pos) AS rendered
FROM k JOIN t ON t.conv_id = k.conv_id GROUP BY ALL""",
    "op13_turn_repair": repair_sql(),
}
