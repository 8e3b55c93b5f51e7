"""DuckDB SQL for the corpus queries that SQL can express."""

ORACLES: dict[str, str] = {}

ORACLES["op10_chat_format"] = r"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), marked AS (
  SELECT *, lag(role) OVER w IS NOT DISTINCT FROM role AS same,
         length(replace(replace(text, '\', '\\'), '<|', '<\|')) AS n_text,
         length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '<|im_nl|>')) AS n_role
  FROM rows_ WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(CASE WHEN same THEN 10 + n_text ELSE 12 + n_role + 1 + 11 + n_text END) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""

# The same character references, in the same order, as the operator decodes.
_NUMBERED = r"(?i)&#(x[0-9a-f]{1,6}|[0-9]{1,7});"
_NAMED = (
    "replace(replace(replace(replace(replace(replace(replace({0}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&apos;', ''''),"
    " '&nbsp;', ' '), '&copy;', chr(169)), '&middot;', chr(183))"
)
_CODE = f"CAST(CASE WHEN lower(regexp_extract(x, '{_NUMBERED}', 1)) LIKE 'x%' THEN '0x' || substr(regexp_extract(x, '{_NUMBERED}', 1), 2) ELSE regexp_extract(x, '{_NUMBERED}', 1) END AS INTEGER)"
_CHARACTER = f"CASE WHEN {_CODE} = 38 THEN '&amp;' WHEN {_CODE} BETWEEN 1 AND 1114111 AND {_CODE} NOT BETWEEN 55296 AND 57343 THEN chr({_CODE}) ELSE chr(65533) END"
_DECODED = f"replace(list_reduce(list_distinct(regexp_extract_all({_NAMED}, '{_NUMBERED}')), lambda t, x: replace(t, x, {_CHARACTER}), {_NAMED}), '&amp;', '&')"
ORACLES["op2_warc"] = (
    r"""
WITH base AS (
  SELECT page_id, url, coalesce(html, '') AS html, md5(concat_ws('|', 'response', CAST(page_id AS VARCHAR), url)) AS m FROM pages
), ids AS (
  SELECT *, 'urn:uuid:' || regexp_replace(m, '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\1-\2-\3-\4-\5') AS rid, 'sha256:' || sha256(html) AS sd,
    regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(?:!--.*?(?:-->|\z)|script\b.*?(?:</script\s*>|\z)|style\b.*?(?:</style\s*>|\z)|head\b.*?</head\s*>)', chr(10), 'g'),
      '(?i)</?(?:p|div|br|hr|li|ul|ol|dl|dt|dd|h[1-6]|tr|table|article|section|header|footer|nav|aside|main|blockquote|pre|form)\b[^>]*>', chr(10), 'g'), '</?[a-zA-Z][^>]*>|<[!?][^>]*>', '', 'g') AS t0,
    regexp_extract(html, '(?is)<title\b[^>]*>(.*?)</title', 1) AS title0, regexp_replace(regexp_extract(html, '(?i)<html\b[^>]*\blang="([^"]*)"', 1), '[\t\r\n]', '', 'g') AS lang,
    list_transform(regexp_extract_all(html, '(?i)<a\b[^>]*?\bhref\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)', 1),
      lambda x: 'outlink: ' || regexp_replace(regexp_replace(x, '^["'']|["'']$', '', 'g'), '[\t\r\n]', '', 'g') || chr(13) || chr(10)) AS links
  FROM base
), cleaned AS (
  SELECT * EXCLUDE (t0, title0),
    trim(regexp_replace(regexp_replace(DECODED_T, '[ \t\r\f]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), ' ' || chr(10)) AS t,
    trim(regexp_replace(DECODED_TITLE, '[ \t\r\n\f]+', ' ', 'g'), ' ') AS title,
    'urn:uuid:' || regexp_replace(md5('metadata|' || rid), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\1-\2-\3-\4-\5') AS mid,
    'urn:uuid:' || regexp_replace(md5('conversion|' || rid), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\1-\2-\3-\4-\5') AS cid,
    chr(13) || chr(10) AS nl
  FROM ids
), records AS (
  SELECT page_id, mid AS record_id, 'metadata' AS warc_type, cid AS concurrent_to, 'application/warc-fields' AS content_type, rid, url, html, sd, nl,
    'source-record-id: ' || rid || nl || 'source-payload-digest: ' || sd || nl || 'source-content-length: ' || strlen(html) || nl || 'conversion-record-id: ' || cid || nl
      || 'conversion-block-digest: sha256:' || sha256(t) || nl || 'title: ' || title || nl || 'language: ' || lang || nl || coalesce(array_to_string(links, ''), '')
      || 'source-header: HTTP/1.1 200 OK' || nl || 'source-header: Content-Type: text/html; charset=utf-8' || nl || 'source-header: Content-Length: ' || strlen(html) || nl AS block
  FROM cleaned
  UNION ALL
  SELECT page_id, cid, 'conversion', mid, 'text/plain; charset=utf-8', rid, url, html, sd, nl, t FROM cleaned
)
SELECT page_id, record_id, warc_type, rid AS refers_to, concurrent_to, url AS target_uri, '2024-01-01T00:00:00Z' AS warc_date, content_type,
  'HTTP/1.1 200 OK' || nl || 'Content-Type: text/html; charset=utf-8' || nl || 'Content-Length: ' || strlen(html) || nl || nl AS source_headers,
  sd AS source_payload_digest, 'sha256:' || sha256(block) AS block_digest, CAST(strlen(block) AS BIGINT) AS content_length, block
FROM records
""".replace("DECODED_TITLE", _DECODED.replace("{0}", "title0")).replace("DECODED_T", _DECODED.replace("{0}", "t0"))
)

ORACLES["op4_line_dedup"] = r"""
WITH split_ AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents
), windows AS (
  SELECT doc_id, pos, trim(lines[pos + 1], blanks) AS a, trim(lines[pos + 2], blanks) AS b, trim(lines[pos + 3], blanks) AS c
  FROM (SELECT ' ' || chr(9) || chr(13) || chr(11) || chr(12) AS blanks, doc_id, lines, unnest(range(len(lines) - 2)) AS pos FROM split_ WHERE len(lines) >= 3)
), places AS (
  SELECT doc_id, pos, first_value(doc_id) OVER w AS first_doc, first_value(pos) OVER w AS first_pos
  FROM windows WHERE a <> '' OR b <> '' OR c <> '' WINDOW w AS (PARTITION BY a, b, c ORDER BY doc_id, pos)
), gone AS (
  SELECT doc_id, list(DISTINCT p) AS gone
  FROM (SELECT doc_id, unnest(range(CASE WHEN doc_id = first_doc THEN greatest(pos, first_pos + 3) ELSE pos END, pos + 3)) AS p FROM places WHERE doc_id <> first_doc OR pos <> first_pos)
  GROUP BY doc_id
)
SELECT doc_id, CASE WHEN gone IS NULL THEN text ELSE array_to_string([lines[i + 1] FOR i IN range(len(lines)) IF NOT list_contains(gone, i)], chr(10)) END AS text,
  CAST(CASE WHEN text IS NULL THEN 0 ELSE len(lines) END AS BIGINT) AS n_lines, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed
FROM split_ LEFT JOIN gone USING (doc_id)
"""

ORACLES["op11_fill_in_middle"] = r"""
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units
  FROM documents
), placed AS (
  SELECT *, len(units) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(units) + 1) AS k1, CAST('0x' || h[9:16] AS BIGINT) % (len(units) + 1) AS k2,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 50 THEN 'plain'
      WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
), cut AS (
  SELECT doc_id, t, n, form, array_to_string(units[:least(k1, k2)], '') AS p, array_to_string(units[least(k1, k2) + 1:greatest(k1, k2)], '') AS m, array_to_string(units[greatest(k1, k2) + 1:], '') AS s
  FROM placed
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM cut
"""

ORACLES["op12_collocations"] = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), cut AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), spans AS (
  SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM cut, (SELECT unnest([1, 2, 3, 4, 5]) AS m) WHERE len(w) >= m
), found AS (
  SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase, count(*) AS f FROM spans GROUP BY ALL HAVING count(*) >= 100
), totals AS (
  SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM cut GROUP BY lang
), halves AS (
  SELECT lang, phrase, f AS a, string_split(phrase, ' ') AS w, unnest(range(1, m)) AS k FROM found WHERE m > 1
), scores AS (
  SELECT h.lang, h.phrase, h.a, h.k, l.f AS l, r.f AS r, t.n, CAST((CAST(1000 AS HUGEINT) * h.a * t.n) // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
  FROM halves h JOIN found l ON l.lang = h.lang AND l.phrase = array_to_string(h.w[1:h.k], ' ') JOIN found r ON r.lang = h.lang AND r.phrase = array_to_string(h.w[h.k + 1:], ' ') JOIN totals t ON t.lang = h.lang
), worst AS (
  SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inner_ AS (
  SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(f) AS around
  FROM (SELECT lang, w, f, m, unnest(range(1, len(w) - m + 2)) AS i FROM (SELECT lang, string_split(phrase, ' ') AS w, f, unnest(range(2, m)) AS m FROM found WHERE m > 2)) GROUP BY ALL
)
SELECT w.lang, row_number() OVER (PARTITION BY w.lang ORDER BY score DESC, a DESC, w.phrase) AS rank, w.phrase, a, l, r, n, score
FROM worst w LEFT JOIN inner_ i ON i.lang = w.lang AND i.phrase = w.phrase WHERE coalesce(100 * i.around < 100 * a, true) QUALIFY rank <= 2000
"""
