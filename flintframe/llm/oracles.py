r"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

import string

from . import codes, decontaminate, importance, quality, sharding, urls, vectors

_LOWER = f"'{string.ascii_uppercase}', '{string.ascii_lowercase}'"


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def url_filters() -> str:
    rules = ", ".join(f"({_quote(a)}, {_quote(h)}, {_quote(p)})" for a, h, p in urls.HOST_RULES)
    bad = " OR ".join(f"regexp_matches(host || path || rest, {_quote(p)})" for a, p, _ in urls.PATTERN_RULES if a == "block")
    return f"""
WITH rules(action, rhost, rpath) AS (VALUES {rules}),
cut AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, instr(url, '://') + 3) ELSE '' END AS a FROM pages),
parts AS (SELECT row_number() OVER () AS k, page_id, translate(regexp_extract(a, '^([^/?#]*)', 1), {_LOWER}) AS host,
  regexp_extract(a, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(a, '(?s)^[^?#]*(.*)$', 1) AS rest FROM cut),
best AS (SELECT k, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(action, length(rhost || rpath)) AS action
  FROM parts JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY k)
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN {bad} THEN 'block' ELSE 'allow' END) AS verdict
FROM parts LEFT JOIN best USING (k)"""


def chat_format() -> str:
    return r"""
WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
esc AS (SELECT *, length(replace(replace(replace(replace(text, '\', '\\'), '###', '\h'), '</turn>', '\e'), ': ', '\c')) AS body,
  CASE role WHEN 'user' THEN 4 WHEN 'system' THEN 6 WHEN 'assistant' THEN 9
    ELSE 5 + length(replace(replace(replace(replace(role, '\', '\\'), '###', '\h'), '</turn>', '\e'), ': ', '\c')) END AS head,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS k FROM rows),
prev AS (SELECT *, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY k), 'start') AS before,
  max(k) OVER (PARTITION BY conv_id) AS last FROM esc),
moves AS (SELECT *, (before || '>' || role) NOT IN ('start>system', 'start>user', 'system>user', 'user>assistant', 'assistant>user') AS bad FROM prev)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY k), '')) AS loss_sha256,
  sum(4 + head + 2 + body + 8)::BIGINT AS formatted_chars,
  NOT bool_or(bad) AND coalesce(bool_or(k = last AND role = 'assistant'), false) AS valid, min(CASE WHEN bad THEN k END)::INTEGER AS error_turn
FROM moves GROUP BY conv_id"""


def shards() -> str:
    names = [f"shard-{k}" for k in range(sharding.SHARDS)]
    owners = ",".join(map(str, sharding.fill_table(names)))
    return f"""
WITH t AS (SELECT string_split('{owners}', ',') AS owners),
placed AS (SELECT doc_id, (('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), concat_ws(chr(31), 'null', coalesce(source, ''), coalesce(lang, ''), coalesce(CAST(n_chars AS VARCHAR), '')))), 1, 8))::BIGINT % {sharding.TABLE_SIZE})::INTEGER AS slot FROM documents)
SELECT doc_id, slot, owners[slot + 1]::INTEGER AS shard FROM placed, t"""


def distribution_quality() -> str:
    blank, q = r"\x20\x09-\x0D", quality
    pieces = {"lower": "[a-z]+", "space": rf"[{blank}]+", "upper": "[A-Z]+", "digit": "[0-9]+", "symbol": "[#*$%&|<>]+", "punct": r"[\x21-\x7E]+", "letter": r"\p{L}+"}
    cut = "".join(f", c{k + 1} AS (SELECT *, regexp_replace(t{k}, '{pieces[name]}', '', 'g') AS t{k + 1} FROM c{k})" for k, (name, _) in enumerate(q.CLASSES))
    last = len(q.CLASSES)
    counts = ", ".join([f"length(t{k}) - length(t{k + 1})" for k in range(last)] + [f"length(t{last})"])
    half = "CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END"
    return f"""
WITH c0 AS (SELECT row_number() OVER () AS k, doc_id, lang, coalesce(text, '') AS t0, regexp_extract_all(coalesce(text, ''), '[^{blank}]+') AS ws FROM documents){cut},
base AS (SELECT k, doc_id, lang, ws, len(ws) AS n_words, length(t0) AS chars, coalesce(list_sum([length(w) FOR w IN ws]), 0)::BIGINT AS word_chars, length(t0) - length(regexp_replace(t0, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  [x FOR x IN string_split(t0, chr(10)) IF regexp_matches(x, '[^{blank}]')] AS lines, [{counts}] AS cs FROM c{last}),
grams AS (SELECT k, i, array_to_string(ws[i : i + {q.WINDOW - 1}], ' ') AS g FROM (SELECT k, ws, unnest(range(1, len(ws) - {q.WINDOW - 2})) AS i FROM base WHERE len(ws) >= {q.WINDOW})),
reps AS (SELECT k, count(DISTINCT p) AS n FROM (SELECT k, unnest(range(i, i + {q.WINDOW})) AS p FROM grams WHERE (k, g) IN (SELECT (k, g) FROM grams GROUP BY k, g HAVING count(*) > 1)) GROUP BY k),
sizes AS (SELECT lang, count(*) AS docs FROM base WHERE lang IS NOT NULL GROUP BY lang HAVING count(*) >= {q.LEAST_DOCS}),
said AS (SELECT DISTINCT k, lang, unnest(regexp_extract_all(lower(t0), '[^{blank}]+')) AS word FROM c0 WHERE lang IS NOT NULL),
common AS (SELECT DISTINCT word FROM (SELECT lang, word, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS r
  FROM (SELECT lang, word, count(*) AS n FROM said WHERE length(word) <= {q.LONGEST} GROUP BY 1, 2) JOIN sizes USING (lang) WHERE n >= {q.LEAST_SHARE}::DOUBLE * docs) WHERE r <= {q.COMMON}),
spelled AS (SELECT word, word AS s FROM common UNION SELECT word, upper(word[1]) || lower(word[2:]) FROM common),
own AS (SELECT k, word, count(*) AS n FROM (SELECT k, unnest(ws) AS s FROM base) JOIN spelled USING (s) GROUP BY 1, 2),
totals AS (SELECT lang, sum(n_words)::DOUBLE AS words, sum(chars)::DOUBLE AS chars FROM base JOIN sizes USING (lang) GROUP BY lang HAVING sum(n_words) > 0),
class_ref AS (SELECT lang, j, sum(cs[j]) / any_value(totals.chars) AS q FROM base JOIN totals USING (lang), (SELECT unnest(range(1, {last + 2})) AS j) GROUP BY lang, j),
word_ref AS (SELECT t.lang, c.word, coalesce(n, 0) / t.words AS q FROM totals t CROSS JOIN common c LEFT JOIN (SELECT lang, word, sum(n) AS n FROM own JOIN base USING (k) GROUP BY 1, 2) x ON x.lang = t.lang AND x.word = c.word),
class_d AS (SELECT k, r.lang, sqrt(greatest(0, sum({half}) / 2)) AS d FROM (SELECT k, r.lang, cs[j]::DOUBLE / chars AS p, q FROM base, class_ref r WHERE chars >= {q.LEAST_CHARS}) r GROUP BY k, r.lang),
pq AS (SELECT b.k, r.lang, coalesce(own.n, 0) / b.n_words::DOUBLE AS p, r.q FROM base b CROSS JOIN word_ref r LEFT JOIN own ON own.k = b.k AND own.word = r.word WHERE b.n_words >= {q.LEAST_WORDS}),
word_d AS (SELECT k, lang, sqrt(greatest(0, sum({half}) / 2)) AS d FROM (SELECT * FROM pq UNION ALL SELECT k, lang, greatest(0, 1 - sum(p)), greatest(0, 1 - sum(q)) FROM pq GROUP BY k, lang) GROUP BY k, lang),
silent AS (SELECT lang, sqrt(greatest(0, sum({half}) / 2)) AS d FROM (SELECT lang, 0.0 AS p, q FROM word_ref UNION ALL SELECT lang, 1.0, greatest(0, 1 - sum(q)) FROM word_ref GROUP BY lang) GROUP BY lang),
best AS (SELECT b.k, arg_min(c.d, (coalesce(c.d, 0) + coalesce(w.d, 0), t.lang)) AS c, arg_min(w.d <= {q.MOST_WORD_SHARE} * s.d, (coalesce(c.d, 0) + coalesce(w.d, 0), t.lang)) AS w
  FROM base b CROSS JOIN totals t LEFT JOIN silent s ON s.lang = t.lang LEFT JOIN class_d c ON c.k = b.k AND c.lang = t.lang LEFT JOIN word_d w ON w.k = b.k AND w.lang = t.lang WHERE b.lang IS NULL OR b.lang IN (SELECT lang FROM totals) GROUP BY b.k),
rows AS (SELECT doc_id, n_words, word_chars, n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(reps.n, 0) AS n_repeat_words, n_words < 10 OR 100 * coalesce(reps.n, 0) > 20 * n_words AS base_failed, best.c, best.w
  FROM base LEFT JOIN reps USING (k) LEFT JOIN best USING (k))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND coalesce(c <= {q.MOST_CLASS_DISTANCE}, true) AND coalesce(w, true) AS kept FROM rows"""


def contamination() -> str:
    said = lambda text: rf"regexp_extract_all(translate(coalesce({text}, ''), {_LOWER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, {said('text')} AS w FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) AS item, {said('text')} AS w FROM benchmark),
cut AS (SELECT item, w, least({decontaminate.WIDTH}, len(w)) AS n FROM items WHERE len(w) > 0),
wins AS (SELECT DISTINCT item, n, array_to_string(w[i : i + n - 1], ' ') AS win FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM cut)),
each AS (SELECT k, i, n, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM (SELECT k, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM wins) WHERE len(w) >= n)),
hits AS (SELECT k, i, n, item FROM each JOIN wins USING (n, win)),
covered AS (SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT k, unnest(range(i, i + n)) AS p FROM hits) GROUP BY k),
named AS (SELECT k, count(DISTINCT item) AS n_items, sha256(coalesce(string_agg(DISTINCT item, ',' ORDER BY item), '')) AS items FROM hits GROUP BY k)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  coalesce(items, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN covered USING (k) LEFT JOIN named USING (k)"""


def jaccard_join() -> str:
    return rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT DISTINCT k, array_to_string(w[i : i + 2], ' ') AS s FROM (SELECT k, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
sizes AS (SELECT k, count(*) AS n FROM sets GROUP BY k),
met AS (SELECT a.k AS x, b.k AS y, count(*) AS c FROM sets a JOIN sets b ON a.s = b.s AND a.k <> b.k GROUP BY a.k, b.k),
links AS (SELECT x, y FROM met JOIN sizes p ON x = p.k JOIN sizes q ON y = q.k WHERE 100 * c >= 90 * (p.n + q.n - c)),
reach AS (SELECT k, k AS r FROM d UNION SELECT reach.k, y FROM reach JOIN links ON r = x),
tops AS (SELECT reach.k, min(e.doc_id) AS component_id FROM reach JOIN d e ON r = e.k GROUP BY reach.k),
degree AS (SELECT x AS k, count(*) AS n_links FROM links GROUP BY x)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, coalesce(n_links, 0)::BIGINT AS n_links
FROM d LEFT JOIN sizes USING (k) LEFT JOIN tops USING (k) LEFT JOIN degree USING (k)"""


def _whole_vectors() -> str:
    """Rows of embeddings with whole components; k: their order."""
    v = vectors
    return f"""SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS k, vec_id, label,
  [least(greatest(floor({v.SCALE} * x::DOUBLE), {-v.MOST}), {v.MOST})::BIGINT FOR x IN embedding] AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0"""


def bitslice_topk() -> str:
    return f"""
WITH v AS ({_whole_vectors()}),
s AS (SELECT q.vec_id AS query_id, c.vec_id, coalesce(list_sum([t[1] * t[2] FOR t IN list_zip(q.v, c.v)]), 0)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id IS DISTINCT FROM q.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s QUALIFY rank <= 5"""


def annular_codes() -> str:
    parts, entries = codes.PARTS, codes.ENTRIES
    step = f"len(v) // {parts}"
    apart = "list_sum([(t[1] - t[2]) * (t[1] - t[2]) FOR t IN list_zip(x, c)])"
    rounds = "".join(f""",
a{r} AS MATERIALIZED (SELECT k, p, any_value(x) AS x, arg_min(e, (d, e)) AS e, min(d) AS d FROM (SELECT k, parts.p, x, e, {apart} AS d FROM parts JOIN b{r} ON b{r}.p = parts.p) GROUP BY k, p),
s{r} AS (SELECT p, e, list(m ORDER BY i) AS c FROM (SELECT p, e, i, sum(x[i]) // count(*) - (sum(x[i]) % count(*) < 0)::INT AS m FROM a{r}, (SELECT unnest(range(1, (SELECT max(len(x)) FROM parts) + 1)) AS i) GROUP BY p, e, i) GROUP BY p, e),
b{r + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(s.c, b.c) AS c FROM b{r} b LEFT JOIN s{r} s ON s.p = b.p AND s.e = b.e)""" for r in range(codes.ROUNDS))
    last = codes.ROUNDS
    return f"""
WITH v AS MATERIALIZED ({_whole_vectors()}),
parts AS MATERIALIZED (SELECT k, p, v[p * ({step}) + 1 : (p + 1) * ({step})] AS x FROM v, (SELECT unnest(range({parts})) AS p)),
b0 AS (SELECT p, k - 1 AS e, x AS c FROM parts WHERE k <= {entries}){rounds},
a{last} AS (SELECT k, parts.p, arg_min(e, ({apart}, e)) AS e, min({apart}) AS d FROM parts JOIN b{last} ON b{last}.p = parts.p GROUP BY k, parts.p),
coded AS (SELECT k, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{last} GROUP BY k),
books AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{last})
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM coded JOIN v USING (k), books"""


def importance_resampling() -> str:
    q = importance
    if q.LONGEST_RUN != 1:
        raise NotImplementedError("this SQL takes single words")
    said = lambda name, id_col: rf"SELECT {id_col} AS k, unnest(regexp_extract_all(translate(text, {_LOWER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM {name}"
    return f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, text FROM documents), own AS MATERIALIZED ({said('d', 'k')}), target AS MATERIALIZED ({said('benchmark', '0')}),
steps AS (SELECT list(list_reduce([n] || range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY n) AS tab FROM (SELECT unnest(range(256)) AS n)),
bytes AS (SELECT w, [('0x' || hex(encode(w))[2 * i + 1 : 2 * i + 2])::BIGINT FOR i IN range(octet_length(encode(w)))] AS b FROM (SELECT DISTINCT w FROM (FROM own UNION ALL FROM target))),
hashed AS MATERIALIZED (SELECT w, xor(list_reduce([4294967295] || b, lambda c, x: xor(tab[(xor(c, x) & 255) + 1], c >> 8)), 4294967295) % {q.BUCKETS} AS bucket FROM bytes, steps),
counts AS (SELECT bucket, sum(s) AS s, sum(t) AS t FROM (SELECT w, 1 AS s, 0 AS t FROM own UNION ALL SELECT w, 0, 1 FROM target) JOIN hashed USING (w) GROUP BY bucket),
gains AS (SELECT bucket, floor(1000 * ln(((t + 1) * ((SELECT count(*) FROM own) + {q.BUCKETS}))::DOUBLE / ((s + 1) * ((SELECT count(*) FROM target) + {q.BUCKETS}))::DOUBLE))::BIGINT AS g FROM counts),
sums AS (SELECT k, count(*) AS n, sum(g)::BIGINT AS g FROM own JOIN hashed USING (w) JOIN gains USING (bucket) GROUP BY k),
weighed AS (SELECT k, doc_id, coalesce(n, 0) AS n_features, coalesce(floor(g::DOUBLE / n), 0)::BIGINT AS weight, ('0x' || sha256('{q.SEED}:' || doc_id)[1:8])::BIGINT AS h FROM d LEFT JOIN sums USING (k)),
scored AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM weighed),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_features >= {q.LEAST_WORDS} ORDER BY score DESC, doc_id) AS r FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= {q.LEAST_WORDS} AND r <= (SELECT {q.PERCENT} * count(*) // 100 FROM scored WHERE n_features >= {q.LEAST_WORDS}) THEN r END AS rank FROM placed"""


ORACLES = {
    "op1_distribution_quality": distribution_quality, "op4_url_filters": url_filters, "op5_chat_format": chat_format, "op6_decontamination": contamination,
    "op8_sharding": shards, "op9_jaccard_join": jaccard_join, "op11_bitslice_topk": bitslice_topk, "op12_annular_codes": annular_codes,
    "op13_importance_resampling": importance_resampling,
}
