"""DuckDB SQL for the training-data queries that SQL can express."""

from __future__ import annotations

from llm import queries as q

ASCII = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def url_sql() -> str:
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in q.HOST_RULES)

    def regex(pattern: str) -> str:
        """Quoted text, but for * and ^."""
        return "(?s)" + "".join({"*": ".*", "^": "(?:[^A-Za-z0-9_]|^|$)"}.get(c, c if c.isalnum() else "\\" + c) for c in pattern)

    # An allowing pattern beats a blocking one, then the greater text decides.
    ordered = sorted(sorted(q.PATTERN_RULES, key=lambda r: r[1], reverse=True), key=lambda r: r[0] != "allow")
    names = " ".join(f"WHEN regexp_matches(host || path, '{regex(p)}') THEN '{p}'" for _, p in ordered)
    decided = " ".join(f"WHEN regexp_matches(host || path, '{regex(p)}') THEN '{v}'" for v, p in ordered)
    return f"""
WITH rules(verdict, rhost, rpath) AS (VALUES {rules}),
parts AS (
  SELECT page_id, row_number() OVER () AS n,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), {ASCII}) AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
fits AS (
  SELECT n, max_by(rhost || rpath, length(rhost || rpath)) AS rule,
         max_by(verdict, length(rhost || rpath)) AS verdict
  FROM parts JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY n)
SELECT page_id, host, path, rule,
       coalesce(verdict, CASE {decided} ELSE 'allow' END) AS verdict,
       CASE WHEN verdict IS NULL THEN CASE {names} END END AS pattern
FROM parts LEFT JOIN fits USING (n)"""


BASE_RULES = r"""
WITH texts AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS text FROM documents),
words AS (SELECT n, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM texts),
grams AS (
  SELECT n, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1),
         lambda k: w[k] || ' ' || w[k + 1] || ' ' || w[k + 2])) AS gram FROM words),
twice AS (SELECT n, i FROM grams QUALIFY count(*) OVER (PARTITION BY n, gram) > 1),
hit AS (SELECT n, count(DISTINCT i + d) AS n_repeat_words FROM twice, (VALUES (0), (1), (2)) AS t(d) GROUP BY n),
lines AS (SELECT n, unnest(l) AS line, generate_subscripts(l, 1) AS place FROM (SELECT n, string_split(text, chr(10)) AS l FROM texts)),
judged AS (
  SELECT n, line, place, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS w,
         length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')) AS chars,
         length(regexp_replace(line, '[^#*$%%&|<>]+', '', 'g')) AS symbols,
         length(line) - length(replace(line, '|', '')) AS bars,
         length(line) - length(replace(line, '!!', '')) AS marks
  FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
failed AS (
  SELECT *, CASE WHEN bars >= 3 THEN 'navigation' WHEN symbols * 10 > chars THEN 'symbols'
    WHEN len(w) >= 3 AND ((regexp_matches(line, '\p{Lu}') AND NOT regexp_matches(line, '\p{Ll}')) OR marks > len(w))
      THEN 'shouting'
    WHEN len(w) <= %(notice_words)d AND (%(notices)s) THEN 'boilerplate'
    WHEN right(w[-1], 1) NOT IN (%(closing)s) AND NOT regexp_matches(w[-1], '[\p{Thai}\p{Lao}]') THEN 'unpunctuated' END AS failure
  FROM judged),
sums AS (
  SELECT n, count(*) AS n_lines, count(failure) AS n_failed_lines, count(*) - count(DISTINCT line) AS n_dup_lines,
         sum(chars) AS word_chars, sum(symbols) AS n_symbols,
         string_agg(CASE WHEN failure IS NULL THEN line END, chr(10) ORDER BY place) AS clean,
         sum(CASE WHEN failure IS NULL THEN 0 WHEN failure = 'unpunctuated' THEN %(weight)s ELSE 1 END * chars) AS lost
  FROM failed GROUP BY n),
measures AS (
  SELECT doc_id, len(w) AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
         coalesce(n_symbols, 0)::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0)::BIGINT AS n_lines,
         coalesce(n_failed_lines, 0)::BIGINT AS n_failed_lines, coalesce(lost, 0)::DOUBLE AS lost,
         sha256(coalesce(clean, '')) AS clean_sha256,
         len(w) < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * len(w) AS base_failed
  FROM texts JOIN words USING (n) LEFT JOIN hit USING (n) LEFT JOIN sums USING (n))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND lost / word_chars <= %(max_lost)s AS kept, n_lines, n_failed_lines, clean_sha256
FROM measures"""


def quality_sql() -> str:
    from llm import line_rules as lr

    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    return BASE_RULES % {
        "notice_words": lr.NOTICE_WORDS, "weight": lr.UNPUNCTUATED_WEIGHT, "max_lost": lr.MAX_LOST,
        "closing": ", ".join(map(quoted, lr.CLOSING)),
        "notices": " OR ".join(f"contains(lower(line), {quoted(x)})" for x in lr.NOTICES)}


DECONTAMINATION = rf"""
WITH texts AS (SELECT row_number() OVER () AS n, doc_id, regexp_extract_all(translate(coalesce(text, ''), {ASCII}),
                 '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT DISTINCT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), {ASCII}),
                 '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
cut AS (SELECT DISTINCT item, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda s: w[s:s + 9])) AS x
        FROM items WHERE len(w) > 0),
windows AS (SELECT item, len(x) AS length, array_to_string(x, ' ') AS gram FROM cut),
grams AS (SELECT n, length, unnest(range(1, len(w) - length + 2)) AS i,
                 unnest(list_transform(range(1, len(w) - length + 2), lambda s: array_to_string(w[s:s + length - 1], ' '))) AS gram
          FROM texts, (SELECT DISTINCT length FROM windows) WHERE len(w) >= length),
found AS (SELECT n, i, length, item FROM grams JOIN windows USING (length, gram)),
hit AS (SELECT n, count(DISTINCT i + d) AS n_hit FROM found, range(0, 10) AS r(d) WHERE d < length GROUP BY n),
owned AS (SELECT n, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM found GROUP BY n)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM texts LEFT JOIN hit USING (n) LEFT JOIN owned USING (n)"""


def mixing_sql() -> str:
    from llm import poisson_mix as pm

    return f"""
WITH docs AS (SELECT doc_id, source, coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, '')) AS key,
                     coalesce(strlen(text), 0) + {pm.ROW_BYTES} AS size FROM documents),
sizes AS (SELECT source, sum(size)::DOUBLE AS size FROM docs GROUP BY source),
rates AS (SELECT source, round(sqrt(size) / (SELECT sum(sqrt(size)) FROM sizes)
                               * (SELECT sum(size) FROM sizes) / size, 9) AS rate FROM sizes),
blocks AS (SELECT source, rate, greatest(ceil(rate / {pm.BLOCK}), 1)::INT AS blocks FROM rates),
steps AS (SELECT source, k, sum(exp(-rate / blocks) * pow(rate / blocks, k) / gamma(k + 1))
                 OVER (PARTITION BY source ORDER BY k) AS below
          FROM blocks, range(0, 120) AS r(k) WHERE k <= ceil(rate / blocks + 12 * sqrt(rate / blocks) + 24)),
cdf AS (SELECT source, list(below) AS steps FROM steps GROUP BY source),
draws AS (SELECT doc_id, docs.source, key, rate, steps,
                 ('0x' || substr(md5('{pm.SEED}|' || key || '|' || b), 1, 13))::BIGINT / {float(16 ** 13)} AS u
          FROM docs JOIN blocks ON docs.source IS NOT DISTINCT FROM blocks.source
          JOIN cdf ON docs.source IS NOT DISTINCT FROM cdf.source, range(0, 1000) AS r(b) WHERE b < blocks),
counts AS (SELECT doc_id, source, key, rate, sum(len(list_filter(steps, lambda s: s <= u)))::INT AS n
           FROM draws GROUP BY ALL)
SELECT doc_id, source, copy::INT AS copy, rate, md5('{pm.SEED}-order|' || key || '|' || copy) AS order_key
FROM counts, range(0, 100000) AS r(copy) WHERE copy < n"""


TOOL_CALLS = """
WITH RECURSIVE rows_ AS (SELECT conv_id::VARCHAR AS conversation, turn, role, text FROM conversations),
calls AS (
  SELECT conversation, 'call-' || turn AS call_id, min(turn) AS turn, count(*) AS n_calls,
         min(CASE role WHEN 'system' THEN 'configure' WHEN 'user' THEN 'answer' ELSE coalesce(role, '') END) AS tool, min(text) AS text
  FROM rows_ WHERE role IS DISTINCT FROM 'assistant' GROUP BY 1, 2),
ways AS (SELECT conversation, turn, CASE WHEN length(coalesce(text, '')) % 2 = 0 THEN -2 ELSE 2 END AS way,
                length(coalesce(text, '')) % 3 = 0 AS far FROM calls),
edges AS (
  SELECT w.conversation, w.turn, c.turn AS needs FROM ways w JOIN calls c
  ON c.conversation = w.conversation AND (c.turn = w.turn + way OR far AND c.turn = w.turn + 2 * way)),
sizes AS (SELECT conversation, count(*) AS n FROM calls GROUP BY 1),
walks AS (
  SELECT conversation, turn, turn AS at_, 0 AS steps FROM calls
  UNION SELECT w.conversation, w.turn, e.needs, steps + 1
  FROM walks w JOIN edges e ON e.conversation = w.conversation AND e.turn = at_ JOIN sizes s ON s.conversation = w.conversation
  WHERE steps < n),
depths AS (SELECT conversation, turn, max(steps) AS depth, max(steps) = any_value(n) AS cyclic
           FROM walks JOIN sizes USING (conversation) GROUP BY 1, 2),
results AS (
  SELECT conversation, 'call-' || (CASE turn WHEN 0 THEN 1 ELSE turn - 1 END) AS call_id, min(turn) AS result_turn,
         count(*) AS n_results, min(text) AS content
  FROM rows_ WHERE role = 'assistant' GROUP BY 1, 2),
linked AS (
  SELECT * FROM calls FULL JOIN results USING (conversation, call_id) LEFT JOIN depths USING (conversation, turn)),
checked AS (
  SELECT *, CASE tool
    WHEN 'answer' THEN concat_ws('; ',
      CASE WHEN length(text) < 1 THEN 'text: min_length' WHEN length(text) > 2000 THEN 'text: max_length' END,
      CASE WHEN length(text) < 1 THEN 'length: min' END, CASE WHEN turn < 0 THEN 'turn: min' END)
    WHEN 'configure' THEN CASE WHEN turn > 0 THEN 'turn: max' ELSE '' END ELSE '' END AS errors
  FROM linked)
SELECT conversation, call_id, turn, result_turn, tool, CASE WHEN NOT cyclic THEN depth::INTEGER END AS round,
       CASE WHEN tool IS NULL THEN 'orphan_result' WHEN tool NOT IN ('answer', 'configure') THEN 'unknown_tool'
            WHEN text IS NULL THEN 'bad_json' WHEN errors <> '' THEN 'invalid_arguments' WHEN cyclic THEN 'cyclic'
            WHEN n_results IS NULL THEN 'no_result' WHEN result_turn <= turn THEN 'result_first' ELSE 'ok' END AS status,
       errors, coalesce(n_calls, 0) AS n_calls, coalesce(n_results, 0) AS n_results,
       CASE WHEN tool IS NOT NULL AND text IS NOT NULL THEN
         '{"arguments":{"length":' || length(text) || ',"text":' || to_json(text) || ',"turn":' || turn || '},"id":'
         || to_json(call_id) || CASE WHEN content IS NULL THEN '' ELSE ',"result":' || to_json(content) END
         || ',"tool":' || to_json(tool) || '}' END AS json
FROM checked"""


NEAR_COPIES = rf"""
WITH RECURSIVE texts AS (SELECT row_number() OVER () AS n, doc_id, regexp_extract_all(translate(coalesce(text, ''), {ASCII}),
                           '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (SELECT DISTINCT n, gram FROM (SELECT n, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
            ELSE list_transform(range(1, len(w) - 1), lambda k: w[k] || ' ' || w[k + 1] || ' ' || w[k + 2]) END) AS gram FROM texts)),
sizes AS (SELECT n, count(*) AS size FROM grams GROUP BY n),
shared AS (SELECT a.n AS x, b.n AS y, count(*) AS common FROM grams a JOIN grams b USING (gram) WHERE a.n <> b.n GROUP BY 1, 2),
links AS (SELECT x, y FROM shared JOIN sizes a ON a.n = x JOIN sizes b ON b.n = y WHERE 100 * common >= 85 * (a.size + b.size - common)),
reach AS (SELECT n, n AS m FROM texts UNION SELECT reach.n, y FROM reach JOIN links ON x = m),
smallest AS (SELECT reach.n, min(doc_id) AS component_id FROM reach JOIN texts ON texts.n = m GROUP BY 1)
SELECT doc_id, coalesce(size, 0) AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept
FROM texts JOIN smallest USING (n) LEFT JOIN sizes USING (n)"""


def fim_sql() -> str:
    from llm import fim_scatter as fs

    draws = ", ".join(f"('0x' || h[{8 * k + 1}:{8 * k + 8}])::BIGINT AS h{k + 1}" for k in range(4))
    return rf"""
WITH lines AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS l,
                      sha256('{fs.SEED}:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
draws AS (SELECT doc_id, text, l, len(l) AS n, {draws} FROM lines),
cuts AS (SELECT *, least(h1 %% (n + 1), h2 %% (n + 1)) AS a, greatest(h1 %% (n + 1), h2 %% (n + 1)) AS b FROM draws),
pieces AS (
  SELECT doc_id, n, text, coalesce(array_to_string(l[1:a], ''), '') AS p, coalesce(array_to_string(l[a + 1:b], ''), '') AS m,
         coalesce(array_to_string(l[b + 1:], ''), '') AS s,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 %% 100 >= {fs.RATE}
           THEN 'plain' WHEN h4 %% 100 < {fs.SPM_SHARE} THEN 'spm' ELSE 'psm' END AS form FROM cuts)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
              ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
FROM pieces""".replace("%%", "%")


#: Left to right over the turns instead of bottom-up over spans; CRC-32 bit by bit, as SQL has none.
REPAIR = r"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
drawn AS (
  SELECT conv_id, turn, role, text, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(key, ''), lambda ch: ord(ch)::BIGINT)),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, i: xor(v >> 1, 3988292384 * (v & 1))))) % 20 AS rule
  FROM keyed),
spoilt AS (
  SELECT conv_id, turn, CASE WHEN rule = 4 THEN 'user' ELSE role END AS role,
         CASE rule WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE rule WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM drawn),
convs AS (SELECT conv_id, row_number() OVER () AS conv FROM (SELECT DISTINCT conv_id FROM conversations)),
placed AS (SELECT conv, turn, role, text, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i
           FROM spoilt JOIN convs ON spoilt.conv_id IS NOT DISTINCT FROM convs.conv_id),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv, role, text ORDER BY i) > 1 AS later,
                left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv ORDER BY i) AS previous FROM placed),
turns AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN later THEN 'duplicate'
                    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' END AS fault FROM seen),
closure(p, q, cost, edits) AS (VALUES (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''), (0, 2, 5, 'I'), (1, 2, 5, 'I'),
  (3, 2, 5, 'I'), (2, 3, 5, 'I'), (0, 3, 10, 'II'), (1, 3, 10, 'II')),
edits(p, q, edit, initial, cost) AS (VALUES (0, 1, 'K', 's', 0), (0, 2, 'K', 'u', 0), (1, 2, 'K', 'u', 0), (3, 2, 'K', 'u', 0),
  (2, 3, 'K', 'a', 0), (0, 2, 'R', NULL, 1), (1, 2, 'R', NULL, 1), (3, 2, 'R', NULL, 1), (2, 3, 'R', NULL, 1),
  (0, 0, 'D', NULL, 2), (1, 1, 'D', NULL, 2), (2, 2, 'D', NULL, 2), (3, 3, 'D', NULL, 2)),
best AS (
  SELECT conv, 0::BIGINT AS i, q AS place, {'cost': cost, 'audit': edits} AS least FROM convs, closure WHERE p = 0
  UNION ALL
  SELECT conv, i, place, min(least) FROM (
    SELECT best.conv, t.i, c.q AS place, {
      'cost': least.cost + e.cost + c.cost + CASE WHEN fault = 'truncated' AND edit <> 'D' THEN 5 ELSE 0 END,
      'audit': least.audit || edit || c.edits} AS least
    FROM best JOIN turns t ON t.conv = best.conv AND t.i = best.i + 1
    JOIN edits e ON e.p = place AND (e.initial IS NULL OR e.initial = t.initial)
      AND (edit = 'D' OR fault IS NULL OR fault = 'truncated')
    JOIN closure c ON c.p = e.q) GROUP BY ALL),
sizes AS (SELECT conv, count(i) AS n FROM convs LEFT JOIN turns USING (conv) GROUP BY conv),
parsed AS (SELECT best.conv, min(least) AS least FROM best JOIN sizes ON best.conv = sizes.conv AND best.i = n
           WHERE place IN (0, 3) GROUP BY best.conv),
letters AS (SELECT conv, unnest(string_split(least.audit, '')) AS edit, unnest(range(1, length(least.audit) + 1)) AS j FROM parsed
            WHERE least.audit <> ''),
aligned AS (SELECT conv, j, edit, sum((edit <> 'I')::INT) OVER w AS i, sum((edit <> 'D')::INT) OVER w AS k
            FROM letters WINDOW w AS (PARTITION BY conv ORDER BY j)),
rows_ AS (SELECT a.conv, j, k, edit, role, text, max((k = 1 AND edit = 'K' AND initial = 's')::INT) OVER (PARTITION BY a.conv) AS led
          FROM aligned a LEFT JOIN turns t ON t.conv = a.conv AND t.i = a.i AND edit <> 'I' WHERE edit <> 'D'),
repaired AS (SELECT conv, sha256(string_agg(
    CASE WHEN edit = 'K' THEN role WHEN (k - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''),
    chr(10) ORDER BY j)) AS digest FROM rows_ GROUP BY conv),
counts AS (SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
                  count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
                  count(*) FILTER (fault = 'truncated') AS truncated,
                  count(*) FILTER (previous IS NOT NULL AND previous || initial NOT IN ('su', 'ua', 'au')) AS illegal
           FROM turns GROUP BY conv)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, least.cost::BIGINT AS cost, least.audit AS audit,
       coalesce(digest, sha256('')) AS repaired_sha256
FROM convs JOIN parsed USING (conv) LEFT JOIN counts USING (conv) LEFT JOIN repaired USING (conv)"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_tool_call_linking": TOOL_CALLS,
        "op4_url_filter": url_sql(),
        "op7_poisson_mixing": mixing_sql(),
        "op9_benchmark_decontamination": DECONTAMINATION,
        "op10_quality_rules": quality_sql(),
        "op11_bbit_minhash": NEAR_COPIES,
        "op12_conversation_repair": REPAIR,
        "op13_fill_in_middle": fim_sql(),
    }
