"""The operators of this package over whole tables, most with the same in SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm import (
    chat_format, decontaminate, filter_audit, hard_negatives, line_frequency, line_join, main_text, near_duplicates, packing, secret_scan, sharding,
    token_counts, toxicity,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def register(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# Lower-cased words as the contract has them; RE2 needs the class spelt out.
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@_query("op3_decontaminate", f"""
WITH dw AS (SELECT doc_id, {_WORDS} AS w FROM documents),
iw AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
patterns AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, len AS n,
                    array_to_string(w[p : p + len - 1], ' ') AS phrase
             FROM (SELECT item_id, w, least(len(w), 10) AS len, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p
                   FROM iw WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM patterns),
spans AS (SELECT doc_id, n, p, array_to_string(w[p : p + n - 1], ' ') AS phrase
          FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM dw, lengths WHERE len(w) >= n)),
hits AS (SELECT doc_id, spans.p, spans.n, item FROM spans JOIN patterns USING (n, phrase)),
words_hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit
              FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT doc_id, p, n FROM hits)) GROUP BY doc_id),
items_hit AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
              FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN words_hit USING (doc_id) LEFT JOIN items_hit USING (doc_id)""")
def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontaminate.digest(decontaminate.occurrences(docs, items))


@_query("op8_token_counts")
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.with_limit(token_counts.token_counts(table(spark, sf_dir, "documents")))


@_query("op10_packing")
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def _spans_sql(kind: str, number: int, pattern: str, keep: str = "true") -> str:
    """Matches of one kind: the stretches between them give their places."""
    return f"""SELECT doc_id, '{kind}' AS kind, {number} AS rule, start, start + len(m) AS stop FROM (
  SELECT doc_id, ms[k] AS m, len(array_to_string(gs[1:k], '') || array_to_string(ms[1:k-1], '')) AS start
  FROM (SELECT doc_id, ms, gs, unnest(range(1, len(ms) + 1)) AS k FROM (
    SELECT doc_id, regexp_extract_all(t, '{pattern}') AS ms, regexp_split_to_array(t, '{pattern}') AS gs FROM texts))) WHERE {keep}"""


_Q = "[\"'']?"
_HEAD = rf"(?i:password|passwd|secret|token|api_?key){_Q}\x20*[:=]\x20*{_Q}"


@_query("op5_secret_scan", f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
spans AS ({_spans_sql("assign", 0, _HEAD + "[A-Za-z0-9+/_.=-]+", f"len(regexp_replace(m, '^{_HEAD}', '')) >= 6")}
UNION ALL {_spans_sql("access", 1, "AKIA[A-Z0-9]+", "len(m) >= 20")}
UNION ALL {_spans_sql("hex", 2, "[0-9a-f]+", "len(m) >= 24")}
UNION ALL {_spans_sql("pem", 3, "-----BEGIN [A-Z ]*PRIVATE KEY-----")}
UNION ALL {_spans_sql("jwt", 4, "eyJ[A-Za-z0-9_-]+[.]eyJ[A-Za-z0-9_-]+[.][A-Za-z0-9_-]+")}),
listed AS (SELECT doc_id, count(*) FILTER (rule = 0) AS a, count(*) FILTER (rule = 1) AS b, count(*) FILTER (rule = 2) AS c,
  string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rule) FILTER (rule < 3) AS base,
  string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rule) AS spans FROM spans GROUP BY doc_id)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM documents LEFT JOIN listed USING (doc_id)""")
def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.found(table(spark, sf_dir, "documents")))


@_query("op6_line_frequency", r"""
WITH t AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM t),
wins AS (SELECT doc_id, p, ws[p] || ' ' || ws[p + 1] || ' ' || ws[p + 2] AS win
         FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS p FROM w WHERE len(ws) > 2)),
twice AS (SELECT doc_id, win FROM wins GROUP BY ALL HAVING count(*) > 1),
rep AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM wins JOIN twice USING (doc_id, win)) GROUP BY doc_id),
lines AS (SELECT doc_id, source, text, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS nw,
  array_to_string(regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000'), '[^\x20\x09-\x0D]+'), ' ') AS norm
  FROM (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line FROM t)),
full_lines AS (SELECT * FROM lines WHERE nw > 0),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM full_lines GROUP BY doc_id),
held AS (SELECT source, norm, count(DISTINCT text) AS n FROM full_lines GROUP BY ALL),
often AS (SELECT source, norm FROM held WHERE n > 20),
gone AS (SELECT doc_id, CAST(sum(nw) AS BIGINT) AS n FROM full_lines JOIN often
         ON full_lines.source IS NOT DISTINCT FROM often.source AND full_lines.norm = often.norm GROUP BY doc_id),
counted AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(array_to_string(ws, '')) AS BIGINT) AS word_chars,
  CAST(len(text) - len(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines,
  coalesce(rep.n, 0) AS n_repeat_words, coalesce(gone.n, 0) AS removed_words
  FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (doc_id)),
base AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted)
SELECT *, NOT base_failed AND n_words - removed_words >= 0.3 * n_words AS kept FROM base""")
def op6_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_frequency.judged(table(spark, sf_dir, "documents"))


# Lines of the article element (menus, adverts and footers lie outside it in these tables); a page's
# windows of three lines decide whether it surges, over 80 or at the largest window.
@_query("op9_main_text", r"""
WITH bodies AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(?:</article>|$)', 1) AS body FROM pages),
blocks AS (SELECT page_id, k, trim(regexp_replace(regexp_replace(replace(replace(replace(regexp_replace(
             regexp_replace(regexp_replace(b, '<br>', ' ', 'g'), '<[^>]*>', '', 'g'), '&quot;', '"', 'g'),
             '&lt;', '<'), '&gt;', '>'), '&nbsp;', ' '), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS t
           FROM (SELECT page_id, unnest(bs) AS b, generate_subscripts(bs, 1) AS k
                 FROM (SELECT page_id, regexp_split_to_array(body, '</?(?:p|h1)>') AS bs FROM bodies))),
sums AS (SELECT page_id, sum(len(t)) OVER (PARTITION BY page_id ORDER BY k ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS s FROM blocks),
surges AS (SELECT page_id FROM (SELECT page_id, s, max(s) OVER (PARTITION BY page_id) AS most FROM sums) WHERE s > least(80, most - 1) AND most > 0 GROUP BY page_id),
texts AS (SELECT page_id, string_agg(t, chr(10) ORDER BY k) AS text FROM blocks SEMI JOIN surges USING (page_id) WHERE t <> '' GROUP BY page_id)
SELECT page_id, url, coalesce(text, '') AS text, CAST(len(coalesce(text, '')) AS BIGINT) AS n_chars FROM bodies LEFT JOIN texts USING (page_id)""")
def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extracted(table(spark, sf_dir, "pages"))


@_query("op4_toxicity")
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.fitted(docs, table(spark, sf_dir, "labels")))


@_query("op1_sharding")
def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(table(spark, sf_dir, "documents"))


# All pairs that share a shingle, and everything reachable.
@_query("op2_near_duplicates", r"""
WITH RECURSIVE reps AS (SELECT coalesce(text, '') AS t, min(doc_id) AS rep FROM documents GROUP BY 1),
words AS (SELECT rep, regexp_extract_all(lower(t), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM reps),
shingles AS (SELECT rep, array_to_string(w[p : p + n - 1], ' ') AS s
             FROM (SELECT rep, w, least(len(w), 5) AS n, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS p FROM words WHERE len(w) > 0)),
bags AS (SELECT rep, s, count(*) AS c FROM shingles GROUP BY rep, s),
sizes AS (SELECT rep, sum(c) AS n FROM bags GROUP BY rep),
met AS (SELECT a.rep AS a, b.rep AS b, sum(least(a.c, b.c)) AS common FROM bags a JOIN bags b ON a.s = b.s AND a.rep < b.rep GROUP BY 1, 2),
near AS (SELECT a, b FROM met JOIN sizes x ON a = x.rep JOIN sizes y ON b = y.rep WHERE common >= 0.8 * (x.n + y.n - common)),
edges AS (SELECT a, b FROM near UNION ALL SELECT b, a FROM near),
reach AS (SELECT rep AS node, rep AS other FROM reps UNION SELECT node, b FROM reach JOIN edges ON other = a),
classes AS (SELECT node, min(other) AS class_id FROM reach GROUP BY node),
placed AS (SELECT d.doc_id, class_id FROM documents d JOIN reps ON coalesce(d.text, '') = t JOIN classes ON rep = node)
SELECT doc_id, class_id, count(*) OVER (PARTITION BY class_id) AS class_size, doc_id = class_id AS stays FROM placed""")
def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.classed(table(spark, sf_dir, "documents")).drop("link")


# SQL's levenshtein counts bytes: the tables' letters beyond ASCII become control characters, a byte each.
_BYTES = f"translate(line, 'ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöü', '{''.join(map(chr, [*range(1, 9), *range(14, 27)]))}')"


# Of two lines within t edits the longer one holds one of the shorter one's t + 1 parts, at most t places off.
@_query("op7_line_join", rf"""
WITH RECURSIVE split AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text <> ''),
rows_ AS (SELECT doc_id, CAST(generate_subscripts(ls, 1) - 1 AS BIGINT) AS line_no, trim(unnest(ls), ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS line FROM split),
long AS (SELECT DISTINCT line, len(line) AS n FROM rows_ WHERE len(line) >= 10),
parts AS (SELECT line, m, n, t, i, i * n // (t + 1) AS low, (i + 1) * n // (t + 1) AS high
  FROM (SELECT *, unnest(range(0, t + 1)) AS i FROM (SELECT *, least(3, n // 10) AS t
    FROM (SELECT line, n AS m, n - d AS n, d FROM long, (SELECT unnest([0, 1, 2, 3]) AS d))) WHERE t >= greatest(1, m - n))),
probes AS (SELECT line, m, n, t, i, substr(line, low + s + 1, high - low) AS seg FROM (SELECT *, unnest(range(-t, t + 1)) AS s FROM parts)
           WHERE low + s >= 0 AND high + s <= m),
met AS (SELECT DISTINCT p.line AS a, x.line AS b, p.t FROM probes p JOIN parts x ON x.m = x.n AND p.n = x.n AND p.i = x.i AND p.seg = substr(x.line, x.low + 1, x.high - x.low)
        WHERE p.m > p.n OR p.line < x.line),
near AS (SELECT a, b FROM met WHERE levenshtein({_BYTES.replace("line", "a")}, {_BYTES.replace("line", "b")}) <= t),
edges AS (SELECT a, b FROM near UNION ALL SELECT b, a FROM near),
reach AS (SELECT a AS node, a AS other FROM edges UNION SELECT node, b FROM reach JOIN edges ON other = a),
roots AS (SELECT node, min(other) AS root FROM reach GROUP BY node),
degrees AS (SELECT a AS node, count(*) AS n_links FROM edges GROUP BY a),
placed AS (SELECT r.*, CASE WHEN line <> '' THEN coalesce(root, line) END AS root, coalesce(n_links, 0) AS n_links
           FROM rows_ r LEFT JOIN roots ON line = roots.node LEFT JOIN degrees ON line = degrees.node),
firsts AS (SELECT root, min((doc_id, line_no)) AS f, count(*) AS class_lines FROM placed WHERE root IS NOT NULL GROUP BY root)
SELECT doc_id, line_no, CAST(len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_words, f[1] AS class_doc_id, f[2] AS class_line_no,
  coalesce(class_lines, 0) AS class_lines, n_links FROM placed LEFT JOIN firsts USING (root)""")
def op7_line_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_join.classed(table(spark, sf_dir, "documents")).drop("root")


# Every anchor against every row; a score is a sum over the components.
@_query("op12_hard_negatives", r"""
WITH v AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
           AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
met AS (SELECT a.id AS anchor_id, b.id, a.label = b.label AS same,
               CAST(list_sum(list_transform(list_zip(a.e, b.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
        FROM v a JOIN v b ON a.id <> b.id WHERE a.id % 100 = 0),
near AS (SELECT * FROM met WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id) AS INTEGER) AS rank,
       n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM near p JOIN met n ON p.anchor_id = n.anchor_id AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
QUALIFY rank <= 10""")
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mined(hard_negatives.vectors(table(spark, sf_dir, "embeddings"), label), F.col("id") % 100 == 0)


@_query("op13_filter_audit", r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY text) AS least FROM t),
marks AS (SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS toxic FROM labels GROUP BY doc_id),
masked AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
  CAST(len(ws) < 100 AS INTEGER) + 2 * CAST(100 * len(list_distinct(ws)) < 80 * len(ws) AS INTEGER)
  + 4 * CAST(100 * (len(text) - len(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 10 * len(text) AS INTEGER)
  + 8 * CAST(regexp_matches(text, '[#$%&*|]') AS INTEGER) + 16 * CAST(coalesce(least < doc_id, false) AS INTEGER) AS mask
  FROM w LEFT JOIN marks USING (doc_id)),
counted AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM masked GROUP BY part, mask),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l, unnest([1, 2, 4, 8, 16]) AS b),
orders AS (SELECT a.l || b.l || c.l || d.l || e.l AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits FROM f a, f b, f c, f d, f e
           WHERE a.b | b.b | c.b | d.b | e.b = 31),
steps AS (SELECT filter_order, s AS step, bits[s] AS bit, CAST(coalesce(list_sum(bits[1 : s - 1]), 0) AS INTEGER) AS before
          FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS s)),
told AS (SELECT part, filter_order, step, bit,
  coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0) AS kept, coalesce(sum(n) FILTER (mask & before = 0 AND mask & bit > 0), 0) AS removed,
  coalesce(sum(n) FILTER (mask & before > 0 AND mask & bit > 0), 0) AS redundant, coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails,
  coalesce(sum(good) FILTER (mask & before = 0 AND mask & bit > 0), 0) AS good_lost,
  coalesce(sum(toxic) FILTER (mask & before = 0 AND mask & bit > 0), 0) AS toxic_lost FROM counted, steps GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM told""")
def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(filter_audit.masks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


PLANTED = "\\### Assistant: </turn> ok"  # a conversation of its own, -7, says this twice


def _starts(text: str, whole: str) -> str:
    return f"(len({text}) - len(replace({text}, '{whole}', ''))) // {len(whole)}"


def _escaped_length(text: str) -> str:
    """Code points of an escaped text: a backslash more for each backslash, control string, and beginning of one at the end."""
    controls = chat_format.MARKED.controls
    more = [_starts(text, x) for x in ("\\", *controls)]
    tails = {c: "|".join(sorted({x[1:i] for x in controls if x[0] == c for i in range(2, len(x)) if not x.startswith("#") or i > 4})) for c in "<#"}
    return (f"len({text}) + {' + '.join(more)} + CAST(regexp_matches({text}, '<({tails['<']})?$') AS INTEGER)"
            f" + CAST(regexp_matches({text}, '#({tails['#']})$') AS INTEGER) + len(regexp_extract({text}, '#{{0,3}}$'))")


@_query("op11_chat_format", f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '{PLANTED}' UNION ALL SELECT -7, 1, 'assistant', '{PLANTED}'),
e AS (SELECT *, {_escaped_length('text')} AS n_text,
  CASE role WHEN 'system' THEN 6 WHEN 'user' THEN 4 WHEN 'assistant' THEN 9 ELSE 1 + {_escaped_length('role')} + {_starts('role', ':')} END AS n_name FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(len(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({len(chat_format.MARKED.opens + chat_format.MARKED.parts + chat_format.MARKED.closes)} + n_name + n_text) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id""")
def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame([(-7, 0, "user", PLANTED), (-7, 1, "assistant", PLANTED)], "conv_id long, turn long, role string, text string")
    return chat_format.read_back(chat_format.formatted(rows.unionByName(planted)))
