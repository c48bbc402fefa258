"""DuckDB SQL for the registered queries, over the same tables."""

from __future__ import annotations

_WHITE = r"[\s\p{Z}\x1c-\x1f\x85\x0b]"
_GOOD = r"[^\p{L}\p{N}\s\p{Z}\x1c-\x1f\x85\x0b]"


def _heuristic(rows: str, keys: str, text: str, area: str | None) -> str:
    """A query with ``keys`` and confidence for a text expression."""
    small = f"CASE WHEN {area} < 50000 THEN 0.85::DOUBLE ELSE 1::DOUBLE END" if area else "1::DOUBLE"
    return f"""
SELECT {keys}, CASE WHEN coalesce(length(t), 0) = 0 THEN 0.1::DOUBLE ELSE
  0.7::DOUBLE * (CASE WHEN length(t) < 10 THEN 0.7::DOUBLE WHEN length(t) > 5000 THEN 0.9::DOUBLE ELSE 1::DOUBLE END)
  * (CASE WHEN len(list_filter(range(1, len(c) - 3), lambda i: c[i] <> chr(10) AND c[i] = c[i + 1] AND c[i] = c[i + 2] AND c[i] = c[i + 3] AND c[i] = c[i + 4])) > 0 THEN 0.6::DOUBLE ELSE 1::DOUBLE END)
  * (0.5::DOUBLE + length(regexp_replace(t, '{_GOOD}', '', 'g'))::DOUBLE / length(t) * 0.5::DOUBLE) * {small} END AS confidence
FROM (SELECT *, string_split(t, '') AS c FROM (SELECT *, regexp_replace({text}, '^{_WHITE}+|{_WHITE}+$', '', 'g') AS t FROM {rows}))"""


_AREA = "((100 + doc_id % 400) * (100 + doc_id % 300))"
_LEVEL = "CASE WHEN confidence >= 0.85 THEN 'high' WHEN confidence >= 0.70 THEN 'medium' WHEN confidence IS NOT NULL THEN 'low' END"
_SCORED = f"WITH scored AS ({_heuristic('documents', 'doc_id', 'text', _AREA)}), rounded AS (SELECT doc_id, round(confidence, 6) AS confidence FROM scored)"
_TOKENS = """
token AS (
  SELECT doc_id, count(p) AS steps, round(coalesce(exp(avg(ln(greatest(p, 0.01::DOUBLE)))), 0.5), 6) AS token_confidence
  FROM (SELECT vec_id // 8 AS doc_id, greatest(exp(e[label + 1] - m) / list_sum(list_transform(e, lambda x: exp(x - m))), 0.01::DOUBLE) AS p
        FROM (SELECT *, list_max(e) AS m FROM (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)))
  GROUP BY doc_id)"""
_PAGES = f"""
WITH scored AS ({_heuristic('conversations', 'conv_id, turn, text', 'text', None)}),
page AS (
  SELECT conv_id, turn AS n, CASE WHEN turn % 7 = 5 THEN NULL WHEN turn % 6 = 4 THEN '' ELSE text END AS text,
         CASE WHEN turn % 7 <> 5 AND turn % 5 <> 3 THEN confidence END AS confidence, CASE WHEN turn % 7 = 5 THEN 'failed' END AS error FROM scored),
valued AS (SELECT *, CASE WHEN error IS NOT NULL THEN 0.1::DOUBLE ELSE coalesce(confidence, 0.5::DOUBLE) END AS value FROM page)"""
_SEGMENTS = """
WITH seg AS (
  SELECT l_orderkey AS image_id, l_linenumber AS line_index, l_partkey * 7 % 600 AS x1, l_suppkey * 13 % 400 AS y1, (l_orderkey * 31 + l_linenumber * 97) % 600 AS x2,
         l_suppkey * 13 % 400 + (l_quantity::BIGINT * 3 + l_linenumber * 11) % 90 - 40 AS y2 FROM lineitem),
measured AS (SELECT *, sqrt((x2 - x1)::DOUBLE * (x2 - x1) + (y2 - y1)::DOUBLE * (y2 - y1)) AS length, degrees(atan2({dy}::DOUBLE, (x2 - x1)::DOUBLE)) AS raw FROM seg),
turned AS (SELECT *, {angle} AS angle FROM measured),
line AS (SELECT *, {level} AS is_level FROM turned)"""
_NORMAL = "CASE WHEN raw < -90 THEN raw + 180 WHEN raw > 90 THEN raw - 180 ELSE raw END"
_PROFILES = {
    "server": ({"dy": "(y1 - y2)", "angle": _NORMAL, "level": "abs(angle) < 20"}, "-angle", True),
    "util": ({"dy": "(y2 - y1)", "angle": _NORMAL, "level": "abs(angle) < 15"}, "angle", False),
    "local": ({"dy": "(y2 - y1)", "angle": "raw", "level": "(abs(angle) < 10 OR abs(angle) > 170)"}, "CASE WHEN angle > 170 THEN 180 - angle WHEN angle < -170 THEN -180 - angle ELSE -angle END", False),
}


def _select(profile: str) -> str:
    shape, turn, fallback = _PROFILES[profile]
    taken = "true" if fallback else "is_level"
    chosen = ", ".join(f"CASE WHEN {taken} THEN {c} END AS {c}" for c in ("line_index", "x1", "y1", "x2", "y2"))
    return f"""{_SEGMENTS.format(**shape)},
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY is_level DESC, length DESC, line_index, x1, y1, x2, y2) AS r,
         count(*) OVER (PARTITION BY image_id) AS total_lines, count(*) FILTER (is_level) OVER (PARTITION BY image_id) AS level_lines FROM line)
SELECT image_id, total_lines, level_lines, {chosen}, round(CASE WHEN {taken} THEN length END, 6) AS length, round(CASE WHEN {taken} THEN angle END, 6) AS detected_angle,
       round(CASE WHEN {taken} THEN {turn} ELSE 0 END, 6) AS rotation_angle, ({taken} AND NOT is_level) AS warning
FROM ranked WHERE r = 1"""


_MISREAD = "regexp_replace(translate({0}, 'aeo', '430'), 'th|é', 't', 'g')"
# DuckDB's levenshtein counts bytes: the characters of a pair become ASCII ones first.
_CER = """
SELECT *, CASE WHEN reference = '' THEN CASE WHEN hypothesis = '' THEN 0 ELSE 1 END WHEN hypothesis = '' THEN 1 ELSE
  levenshtein(array_to_string(list_transform(string_split(reference, ''), lambda x: chr(list_position(k, x)::INTEGER)), ''),
              array_to_string(list_transform(string_split(hypothesis, ''), lambda x: chr(list_position(k, x)::INTEGER)), ''))::DOUBLE / length(reference) END AS rate
FROM (SELECT *, list_distinct(string_split(reference || hypothesis, '')) AS k FROM ({rows}))"""


# Word error rates by the table of prefixes, row by row: DuckDB's own distance has too few symbols for words.
def _wer(rows: str) -> str:
    return f"""
SELECT *, CASE WHEN len(a) = 0 THEN CASE WHEN len(b) = 0 THEN 0 ELSE 1 END ELSE
  list_reduce(list_transform(range(1, len(a) + 1), lambda i: [i]), lambda up, i:
    list_reduce(list_transform(range(1, len(b) + 1), lambda j: [j]), lambda own, j: list_append(own, least(own[-1] + 1, up[j[1] + 1] + 1, up[j[1]] + CASE WHEN a[i[1]] = b[j[1]] THEN 0 ELSE 1 END)), [i[1]]),
    range(0, len(b) + 1))[-1]::DOUBLE / len(a) END AS word_rate
FROM (SELECT *, list_filter(string_split_regex(reference, '{_WHITE}+'), lambda w: w <> '') AS a, list_filter(string_split_regex(hypothesis, '{_WHITE}+'), lambda w: w <> '') AS b FROM ({rows}))"""


_PAIRS = f"SELECT conv_id, turn, text AS reference, {_MISREAD.format('text')} AS hypothesis FROM conversations"

# Records of no declared type, as JSON, and their values by walking down the tree: the path of positions gives the order.
def _mixed(text: str) -> str:
    turns = f"""list(json_object('n', turn, 'said', {text} || ' "' || chr(92) || chr(9), 'who', CASE WHEN turn % 3 = 1 THEN role END, 'box', json_array(json_array((turn * 0.5)::DOUBLE, NULL), json_array((turn * 1000003.25)::DOUBLE)),
      'even', turn % 2 = 0, 'blank', '  ') ORDER BY turn)"""
    return f"""
SELECT conv_id, CASE conv_id % 3 WHEN 0 THEN json_object('kind', 'list', 'turns', t, 'total', total) WHEN 1 THEN json_object('out', json_object('in', json_object('deep', t, 'a:b', total)), 'id', conv_id)
  ELSE CASE WHEN conv_id % 9 <> 8 THEN json_array(json_array(t), json_array(json_array(json_array(t)))) END END AS record
FROM (SELECT conv_id, {turns} AS t, (conv_id % 7 * CASE WHEN conv_id % 2 = 0 THEN 1e-5 ELSE 1e15 END)::DOUBLE AS total FROM conversations GROUP BY conv_id)"""


def _walked(rows: str, name: str) -> str:
    return f"""
{name}_tree(conv_id, path, node) AS (
  SELECT conv_id, []::BIGINT[], record FROM ({rows}) WHERE record IS NOT NULL
  UNION ALL
  SELECT conv_id, list_append(path, -place), part FROM (
    SELECT conv_id, path, unnest(parts) AS part, generate_subscripts(parts, 1) AS place FROM (
      SELECT conv_id, path, CASE json_type(node) WHEN 'OBJECT' THEN list_transform(json_keys(node), lambda k: json_extract(node, '$."' || k || '"')) ELSE json_extract(node, '$[*]') END AS parts
      FROM {name}_tree WHERE json_type(node) IN ('OBJECT', 'ARRAY')))),
{name}_leaf AS (
  SELECT conv_id, path, CASE json_type(node) WHEN 'VARCHAR' THEN regexp_replace(node ->> '$', '^{_WHITE}+|{_WHITE}+$', '', 'g') WHEN 'BOOLEAN' THEN CASE WHEN node::BOOLEAN THEN 'True' ELSE 'False' END
    WHEN 'DOUBLE' THEN node::DOUBLE::VARCHAR ELSE node::VARCHAR END AS value
  FROM {name}_tree WHERE json_type(node) NOT IN ('OBJECT', 'ARRAY', 'NULL')),
{name} AS (SELECT conv_id, list(value ORDER BY path) FILTER (value <> '') AS found FROM {name}_leaf GROUP BY conv_id)"""


_POSITIONAL = f"""
SELECT conv_id, turn, CASE WHEN a = b THEN 100::DOUBLE WHEN a = '' OR b = '' THEN 0::DOUBLE ELSE len(list_filter(range(1, least(len(x), len(y)) + 1), lambda i: x[i] = y[i]))::DOUBLE / greatest(len(x), len(y)) * 100 END AS percent
FROM (SELECT *, string_split(a, '') AS x, string_split(b, '') AS y FROM (
  SELECT conv_id, turn, lower(regexp_replace(reference, '^{_WHITE}+|{_WHITE}+$', '', 'g')) AS a, lower(regexp_replace(hypothesis, '^{_WHITE}+|{_WHITE}+$', '', 'g')) AS b FROM ({_PAIRS})))"""


def _record(text: str) -> str:
    return f"(turn * 0.25)::DOUBLE::VARCHAR || ' ' || coalesce(nullif(regexp_replace({text}, '^{_WHITE}+|{_WHITE}+$', '', 'g'), '') || ' ', '') || role || ' ' || turn || ' C-' || conv_id"


_ENDS = "['.JPG', '.pdf', '.tif', '.tiff', '.webp', '.gif', '.docx', '.txt', '.Json', '', '.tar.gz', '.png', '.']"
_MIMES = "[NULL, 'image/png', 'application/pdf', 'application/octet-stream', 'image/webp']"
_UPLOADS = f"""
WITH up AS (
  SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN '.' ELSE 'Файл ' || source || '_' END || doc_id || CASE WHEN doc_id % 4 = 1 THEN '.v2' ELSE '' END || ({_ENDS})[doc_id % 13 + 1] AS name,
         coalesce(({_MIMES})[doc_id % 5 + 1], '') AS mime, CASE WHEN doc_id % 17 = 0 THEN 0 ELSE n_chars * 9973 % 60000000 END AS size FROM documents),
named AS (SELECT *, lower(regexp_extract(name, '^\\.*[^.].*?(\\.[^.]+)$', 1)) AS ext FROM up),
kinds AS (
  SELECT *, mime IN ('image/jpeg', 'image/jpg', 'image/png', 'image/bmp', 'image/gif') OR ext IN ('.jpg', '.jpeg', '.png', '.bmp', '.gif') AS is_image,
         mime = 'application/pdf' OR ext = '.pdf' AS is_pdf, mime LIKE '%wordprocessingml.document' OR ext = '.docx' AS is_docx, lower(string_split(name, '.')[-1]) AS last FROM named)"""
_WANTED = "['llama3', 'glm-ocr:latest', 'codellama', 'llava', 'unknown', 'moondream:latest', 'phi3', 'qwen']"
_MODELS = """
models(ordinal, name, class, category, alias, system, vision, tokens, prompt) AS (VALUES
  (0, 'llama3:latest', 'Llama3TextModel', 'text_general', 'llama3', true, false, 2048, 'You are a helpful assistant.'),
  (1, 'qwen:latest', 'QwenTextModel', 'text_general', 'qwen', true, false, 2048, 'You are a helpful assistant.'),
  (2, 'phi3:latest', 'Phi3TextModel', 'text_general', 'phi3', true, false, 2048, 'You are a helpful assistant.'),
  (3, 'codellama:latest', 'CodeLlamaModel', 'text_code', 'codellama', true, false, 2048, 'You are a helpful assistant.'),
  (4, 'glm-ocr:latest', 'GlmOcrModel', 'ocr', 'glm-ocr', false, true, 2048, 'Extract all text from this image. Preserve structure and layout.'),
  (5, 'llava:latest', 'LlavaVisionModel', 'vision', 'llava', true, true, 1024, 'You are a helpful assistant that can analyze images. Describe what you see.'),
  (6, 'moondream:latest', 'MoondreamVisionModel', 'vision', 'moondream', true, true, 512, 'Describe this image.'))"""
_ASKED = f"WITH {_MODELS}, asked AS (SELECT doc_id, text, ({_WANTED})[doc_id % 8 + 1] AS model FROM documents)"
_EVENTS = """
WITH ev AS (
  SELECT user_id AS session_id, ts, event_id, CASE event_type WHEN 'view' THEN 'upload' WHEN 'signup' THEN 'remove' WHEN 'error' THEN 'clear' ELSE 'result' END AS action,
         CASE WHEN event_type = 'view' THEN 'file' || (event_id % 3) END AS file_name, (['ocr', 'binary', 'rotation'])[event_id % 3 + 1] AS kind, props AS payload FROM events),
changes AS (
  SELECT *, CASE WHEN action IN ('upload', 'remove') THEN coalesce(file_name, '-') END AS now FROM ev),
known AS (
  SELECT *, coalesce(last_value(now IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '-') AS before FROM changes),
epochs AS (
  SELECT *, sum(CASE WHEN action = 'upload' AND file_name <> before THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS epoch FROM known),
held AS (
  SELECT session_id, kind, payload FROM (
    SELECT *, row_number() OVER (PARTITION BY session_id, kind ORDER BY ts DESC, event_id DESC) AS r
    FROM epochs JOIN (SELECT session_id, max(epoch) AS epoch FROM epochs GROUP BY session_id) USING (session_id, epoch) WHERE action IN ('result', 'clear'))
  WHERE r = 1 AND action = 'result')"""
_KINDS = "['packing_list', 'invoice', 'payment_order', 'account_protocol']"
_BLANK = r"[^\s\p{Z}]"

_ROLLUP = f"""{_PAGES}
SELECT conv_id, count(*) AS total_pages, count(*) FILTER (text <> '') AS processed_pages, count(error) AS failed_pages, round(min(value), 6) AS confidence,
       string_agg(round(value * 10000)::BIGINT::VARCHAR, ',' ORDER BY n) AS confidence_per_page FROM valued GROUP BY conv_id"""
_UPSERT = f"""
WITH store AS (SELECT ({_KINDS})[doc_id % 4 + 1] AS doc_type, 'f' || doc_id AS file_name, '{{"lang":"' || lang || '","n_chars":' || n_chars || '}}' AS record FROM documents),
changes AS (SELECT ({_KINDS})[doc_id % 4 + 1] AS doc_type, 'f' || (doc_id - doc_id % 8 + doc_id % 4) AS file_name, '{{"quality":' || quality || ',"toxic":' || toxic || '}}' AS record, doc_id AS n FROM labels),
last AS (SELECT doc_type, file_name, record FROM (SELECT *, row_number() OVER (PARTITION BY doc_type, file_name ORDER BY n DESC) AS r FROM changes) WHERE r = 1)
SELECT * FROM store s WHERE NOT EXISTS (SELECT 1 FROM last l WHERE l.doc_type = s.doc_type AND l.file_name = s.file_name) UNION ALL SELECT * FROM last"""
_COMBINED = f"""{_SCORED}, {_TOKENS},
both_ AS (SELECT doc_id, s.confidence AS looks, token_confidence AS token, doc_id % 4 AS k FROM scored s LEFT JOIN token USING (doc_id))
SELECT doc_id, (['deepseek-ocr', 'deepseek-ocr2', 'glm-ocr', 'paddleocr-vl-1.5'])[k + 1] AS model,
       round(CASE WHEN doc_id % 10 = 9 THEN NULL WHEN k = 3 THEN looks WHEN token IS NOT NULL THEN 0.7::DOUBLE * token + 0.3::DOUBLE * looks WHEN k < 2 THEN looks END, 6) AS confidence FROM both_"""

ORACLE_SQL = {
    "confidence_heuristic": f"{_SCORED} SELECT *, {_LEVEL} AS level FROM rounded",
    "confidence_band_summary": f"{_SCORED} SELECT {_LEVEL} AS level, count(*) AS documents, min(confidence) AS least, max(confidence) AS most FROM rounded GROUP BY 1",
    "token_confidence": f"WITH {_TOKENS} SELECT * FROM token",
    "token_confidence_long": f"WITH {_TOKENS} SELECT * FROM token",
    "confidence_combined": _COMBINED,
    "confidence_advice": f"""
SELECT doc_id, {_LEVEL} AS level, CASE {_LEVEL} WHEN 'high' THEN 'Высокая' WHEN 'medium' THEN 'Средняя' WHEN 'low' THEN 'Низкая' END AS label,
       CASE {_LEVEL} WHEN 'high' THEN '#28a745' WHEN 'medium' THEN '#ffc107' WHEN 'low' THEN '#dc3545' END AS color, CASE {_LEVEL} WHEN 'high' THEN '✅' WHEN 'medium' THEN '⚠️' WHEN 'low' THEN '❌' END AS sign,
       CASE {_LEVEL} WHEN 'high' THEN 'Результат можно использовать без дополнительной проверки' WHEN 'medium' THEN 'Рекомендуется проверить критичные поля (суммы, даты, номера)'
            WHEN 'low' THEN 'Обязательна полная ручная проверка документа' END AS advice FROM ({_COMBINED})""",
    "document_rollup": _ROLLUP,
    "page_stream": _ROLLUP,
    "document_text_concat": f"""{_PAGES}
SELECT conv_id, coalesce(string_agg('[Страница ' || n || ']' || chr(10) || text, chr(10) || chr(10) || '--- СТРАНИЦА РАЗДЕЛИТЕЛЬ ---' || chr(10) || chr(10) ORDER BY n) FILTER (text <> ''), '') AS combined_text
FROM valued GROUP BY conv_id""",
    "pages_with_text": f"""{_PAGES}
SELECT conv_id, coalesce(string_agg(n::VARCHAR, ',' ORDER BY n) FILTER (text <> ''), '') AS numbers, max(text) FILTER (n = 1) AS second_text FROM valued GROUP BY conv_id""",
    "line_geometry": f"{_SEGMENTS.format(**_PROFILES['server'][0])} SELECT image_id, line_index, round(length, 6) AS length, round(angle, 6) AS angle, is_level FROM line",
    **{f"line_select_{p}": _select(p) for p in _PROFILES},
    "cer": f"SELECT conv_id, turn, round(rate, 6) AS cer FROM ({_CER.format(rows=_PAIRS)})",
    "wer": f"SELECT conv_id, turn, round(word_rate, 6) AS wer FROM ({_wer(_PAIRS)})",
    "metric_records": f"""
WITH texts AS (SELECT *, {_MISREAD.format('text')} AS misread FROM conversations),
flat AS (
  SELECT conv_id, turn, {_record('text')} AS reference, CASE WHEN conv_id % 9 = 4 THEN '' ELSE {_record('misread')} END AS hypothesis FROM texts)
SELECT conv_id, turn, round(rate, 6) AS cer, round(word_rate, 6) AS wer FROM ({_CER.format(rows=_wer("SELECT * FROM flat"))})""",
    "round_trip_tally": f"""
SELECT conv_id, count(*) FILTER (percent >= 80) AS passed, count(*) AS total, round(count(*) FILTER (percent >= 80) / count(*), 6) AS share FROM ({_POSITIONAL}) GROUP BY conv_id""",
    "image_counts": f"{_PAGES} SELECT conv_id, count(*) FILTER (error IS NULL) AS image_count FROM page GROUP BY conv_id",
    "page_timing": """
SELECT conv_id, string_agg(round(round(((turn * 37 + conv_id * 11) % 400) / 64::DOUBLE, 2) * 100)::BIGINT::VARCHAR, ',' ORDER BY turn) AS hundredths FROM conversations GROUP BY conv_id""",
    "page_selectors": """
SELECT conv_id, turn, least(greatest(1, turn * 3 - 2), n) AS clamped, CASE WHEN turn * 3 - 2 BETWEEN 1 AND n THEN turn * 3 - 2 ELSE 1 END AS saved, CASE WHEN turn * 3 - 2 >= 0 AND turn * 3 - 2 < n THEN turn * 3 - 2 ELSE 0 END AS from_zero
FROM (SELECT conv_id, turn, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)""",
    "text_similarity": f"SELECT conv_id, turn, round(percent, 6) AS percent, percent >= 70 AS passes FROM ({_POSITIONAL})",
    "nested_records": f"""
WITH flat AS (
  SELECT conv_id, (count(*) * 0.25)::DOUBLE::VARCHAR || ' ' || string_agg(coalesce(nullif(regexp_replace(CASE WHEN turn % 3 <> 2 THEN text END, '^{_WHITE}+|{_WHITE}+$', '', 'g'), '') || ' ', '') || role || ' ' || turn, ' ' ORDER BY turn DESC) || ' C-' || conv_id AS reference
  FROM conversations GROUP BY conv_id)
SELECT conv_id, reference, round(rate, 6) AS cer FROM ({_CER.format(rows="SELECT *, " + _MISREAD.format("reference") + " AS hypothesis FROM flat")})""",
    "json_values": f"""
WITH RECURSIVE {_walked(_mixed('text'), 'own')}
SELECT conv_id, len(found)::INTEGER AS n, array_to_string(found, '|') AS joined FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN own USING (conv_id)""",
    "json_records": f"""
WITH RECURSIVE {_walked(_mixed('text'), 'own')}, {_walked(_mixed(_MISREAD.format('text')), 'seen')},
flat AS (
  SELECT c.conv_id, coalesce(array_to_string(own.found, ' '), '') AS reference, CASE WHEN c.conv_id % 5 = 2 THEN '' ELSE coalesce(array_to_string(seen.found, ' '), '') END AS hypothesis
  FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN own USING (conv_id) LEFT JOIN seen USING (conv_id))
SELECT conv_id, round(rate, 6) AS cer FROM ({_CER.format(rows="SELECT * FROM flat")})""",
    "file_classify_ui": f"""{_UPLOADS}
SELECT doc_id, ext, is_image, is_pdf, is_docx, is_image OR is_pdf OR is_docx AS is_supported, is_image OR is_pdf AS is_image_like,
       CASE WHEN is_image THEN 'image' WHEN is_pdf THEN 'pdf' WHEN is_docx THEN 'docx' WHEN ext IN ('.txt', '.csv', '.json') THEN 'text' ELSE 'other' END AS icon FROM kinds""",
    "file_classify_ocr": f"""{_UPLOADS}
SELECT doc_id, CASE WHEN last = 'pdf' THEN 'pdf' WHEN last IN ('jpg', 'jpeg', 'png', 'bmp', 'tiff', 'webp') THEN 'image' END AS kind, regexp_matches(lower(name), '\\.(jpg|jpeg|png|bmp|tiff|webp|pdf)$') AS admitted FROM kinds""",
    "file_classify_convert": f"""{_UPLOADS}
SELECT doc_id, CASE WHEN mime = 'application/pdf' OR (contains(name, '.') AND last = 'pdf') THEN 'pdf'
  WHEN mime IN ('image/jpeg', 'image/jpg', 'image/png', 'image/bmp', 'image/gif', 'image/x-png', 'image/pjpeg', 'image/x-jpg', 'image/webp') OR (contains(name, '.') AND last IN ('jpg', 'jpeg', 'png', 'bmp', 'gif', 'webp')) THEN 'image' END AS kind FROM kinds""",
    "file_size_gate": f"""{_UPLOADS}
SELECT doc_id, CASE WHEN size > 10485760 THEN 'too_large' WHEN NOT (is_image OR is_pdf OR is_docx) THEN 'unsupported' END AS upload,
       CASE WHEN doc_id % 19 = 0 THEN 'missing' WHEN size > 52428800 THEN 'too_large' WHEN NOT (is_image OR is_pdf OR is_docx) THEN 'unsupported' WHEN size = 0 THEN 'empty' END AS "full" FROM kinds""",
    "file_names": f"""{_UPLOADS}
SELECT doc_id, substr(name, 1, length(name) - length(ext)) AS stem, round_even(size / 1048576, 2) AS size_mb,
       CASE WHEN size < 1024 THEN size || ' B' WHEN size < 1048576 THEN printf('%.1f KB', size / 1024) ELSE printf('%.1f MB', size / 1048576) END AS human_size,
       'ocr_' || regexp_replace(string_split(name, '.')[1], '[^\\p{{L}}\\p{{N}}_\\-]', '_', 'g') || '.txt' AS download_name,
       substr(regexp_replace(name, '[^\\p{{L}}\\p{{N}}]', '_', 'g'), 1, 20) AS safe_name, 'binary_' || name || '_page_' || (doc_id % 9 + 1) || '_threshold_' || (doc_id % 256) || '.png' AS binary_name FROM kinds""",
    "param_clamp": """
WITH raw AS (SELECT doc_id, n_chars % 700 - 40 AS n, doc_id % 9 AS k, (n_chars % 8000 - 4000) / 10 AS a FROM documents)
SELECT doc_id, CASE WHEN k < 2 THEN 50 ELSE least(greatest(n, 10), 500) END::INTEGER AS min_line_length, CASE WHEN k < 2 THEN 20 ELSE least(greatest(n, 1), 100) END::INTEGER AS max_line_gap,
       doc_id % 3 <> 0 AS use_morphology, CASE WHEN k >= 2 AND n BETWEEN 0 AND 255 THEN n END::INTEGER AS threshold, CASE WHEN k < 2 THEN 'not_a_number' WHEN n NOT BETWEEN 0 AND 255 THEN 'out_of_range' END AS threshold_error,
       CASE WHEN k = 0 THEN NULL WHEN k = 1 THEN 'not_a_number' WHEN a NOT BETWEEN -360 AND 360 THEN 'out_of_range' END AS angle_error, CASE WHEN k < 2 OR n NOT BETWEEN 0 AND 255 THEN 422 END AS status FROM raw""",
    "binarize": """
WITH px AS (SELECT vec_id, list_transform(embedding, lambda x: least(greatest(floor(x::DOUBLE * 256 + 128), 0), 255)::INTEGER) AS g, least(greatest(vec_id % 300 - 20, 0), 255) AS t FROM embeddings)
SELECT vec_id, len(list_filter(g, lambda p: p > t)) AS white, array_to_string(list_transform(g, lambda p: CASE WHEN p > t THEN '1' ELSE '0' END), '') AS bits FROM px""",
    "binarize_bytes": """
WITH px AS (SELECT vec_id, list_transform(embedding, lambda x: least(greatest(floor(x::DOUBLE * 256 + 128), 0), 255)::INTEGER) AS g, vec_id % 300 - 20 AS t FROM embeddings)
SELECT vec_id, array_to_string(list_transform(g, lambda p: CASE WHEN p > least(greatest(t, 0), 255) THEN '1' ELSE '0' END), '') AS bits,
       array_to_string(list_transform(g, lambda p: CASE WHEN p > t THEN '1' ELSE '0' END), '') AS unclamped FROM px""",
    "docx_paging": f"""
WITH lines AS (SELECT doc_id, generate_subscripts(l, 1) AS pos, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
placed AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n, count(*) OVER (PARTITION BY doc_id) AS total FROM lines WHERE regexp_matches(line, '{_BLANK}'))
SELECT doc_id, ((n - 1) // 5 + 1)::INTEGER AS page, ceil(total / 5)::INTEGER AS total_pages, min(n)::INTEGER AS first, max(n)::INTEGER AS last, count(*)::INTEGER AS paragraphs, string_agg(line, chr(10) ORDER BY n) AS text
FROM placed GROUP BY doc_id, total, (n - 1) // 5""",
    "registry_resolve": f"""{_ASKED}
SELECT doc_id, model, m.name AS model_name, m.class AS model_class, CASE WHEN m.name IS NULL THEN 400 END AS status_code FROM asked LEFT JOIN models m ON model IN (m.alias, m.name)""",
    "registry_by_category": f"""{_ASKED},
used AS (SELECT m.category, count(*) AS requests FROM asked JOIN models m ON model IN (m.alias, m.name) GROUP BY 1),
listed AS (SELECT category, string_agg(name, ',' ORDER BY ordinal) AS models FROM models GROUP BY 1)
SELECT c.category, coalesce(models, '') AS models, coalesce(requests, 0) AS requests
FROM (SELECT unnest(['ocr', 'text_general', 'text_code', 'vision', 'specialized']) AS category) c LEFT JOIN listed USING (category) LEFT JOIN used USING (category)""",
    "chat_request": f"""{_ASKED}
SELECT doc_id, m.name AS model, CASE WHEN vision THEN 1 ELSE 2 END AS messages, CASE WHEN vision THEN 'user' ELSE 'system' END AS first_role,
       CASE WHEN vision THEN coalesce(nullif(text, ''), prompt) ELSE text END AS content, CASE WHEN vision AND doc_id % 3 = 0 THEN 1 ELSE 0 END AS images, tokens AS num_predict,
       CASE WHEN category = 'text_code' THEN 8 ELSE 0 END AS stops,
       CASE WHEN coalesce(text, '') <> '' THEN NULL WHEN NOT vision THEN 'text' WHEN doc_id % 3 <> 0 THEN 'text_or_image' END AS lacks
FROM asked JOIN models m ON model IN (m.alias, m.name)""",
    "chat_response": f"""
SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN regexp_replace(text, '^{_WHITE}+|{_WHITE}+$', '', 'g') WHEN 2 THEN NULL ELSE '' END AS text,
       CASE turn % 4 WHEN 0 THEN length(text) WHEN 2 THEN NULL ELSE 0 END::INTEGER AS tokens_used, CASE WHEN turn % 4 = 2 THEN 'not_json' END AS error FROM conversations""",
    "error_categories": """
WITH e AS (
  SELECT event_id, (['api', 'ocr_server', 'preprocessing_server', 'file', 'validation', 'image', 'timeout'])[event_id % 7 + 1] AS kind, event_type AS m,
         CASE WHEN trunc(value)::BIGINT % 3 <> 0 THEN ([400, 404, 500, 503])[trunc(value)::BIGINT % 4 + 1] END AS code,
         CASE WHEN user_id % 2 = 0 THEN '/ocr' END AS endpoint, CASE WHEN user_id % 3 = 0 THEN 'glm-ocr' END AS model, CASE WHEN user_id % 5 = 0 THEN 'rotate' END AS operation FROM events),
b AS (SELECT *, 'APIError' || CASE WHEN code IS NULL THEN '' ELSE ' (' || code || ')' END || ': ' || m AS base, concat_ws(' | ', 'endpoint=' || endpoint, 'model=' || model) AS extras,
             kind IN ('api', 'ocr_server', 'preprocessing_server') AS api FROM e)
SELECT event_id,
       CASE WHEN kind = 'ocr_server' OR (api AND endpoint IS NOT NULL) THEN 'ocr' WHEN kind = 'preprocessing_server' OR (api AND operation IS NOT NULL) THEN 'preprocessing'
            WHEN kind IN ('file', 'validation', 'image') THEN kind ELSE 'unknown' END AS category,
       CASE kind WHEN 'ocr_server' THEN base || CASE WHEN extras <> '' THEN ' [' || extras || ']' ELSE '' END
            WHEN 'preprocessing_server' THEN base || ' [operation=' || coalesce(operation, 'unknown') || ']' WHEN 'api' THEN base ELSE m END AS message,
       CASE kind WHEN 'file' THEN 'other_format' WHEN 'image' THEN 'check_image' WHEN 'validation' THEN 'check_value' WHEN 'timeout' THEN 'smaller_file'
            ELSE CASE WHEN code = 404 THEN 'check_url' WHEN code = 400 THEN 'check_parameters' WHEN code >= 500 THEN 'server_failed' END END AS hint FROM b""",
    "session_epochs": f"{_EVENTS} SELECT event_id, session_id, epoch FROM epochs",
    "session_stream": f"{_EVENTS} SELECT event_id, session_id, epoch FROM epochs",
    "session_results": f"{_EVENTS} SELECT * FROM held",
    "session_summary": f"""{_EVENTS},
files AS (SELECT session_id, max_by(file_name, (ts, event_id)) FILTER (true) AS file_name FROM (SELECT session_id, ts, event_id, now AS file_name FROM changes WHERE now IS NOT NULL) GROUP BY session_id)
SELECT session_id, e.epochs, e.events, nullif(file_name, '-') AS file_name, coalesce(results, 0) AS results
FROM (SELECT session_id, max(epoch) AS epochs, count(*) AS events FROM epochs GROUP BY session_id) e LEFT JOIN files USING (session_id)
LEFT JOIN (SELECT session_id, count(*) AS results FROM held GROUP BY session_id) USING (session_id)""",
    "ground_truth_upsert": _UPSERT,
    "ground_truth_stream": _UPSERT,
    "ground_truth_files": """
SELECT (['invoice', 'pay{"ment', 'protocol}'])[doc_id % 3 + 1] AS doc_type, 'f"}{' || doc_id || chr(92) AS file_name, doc_id, lang, md5(text) AS digest FROM documents""",
    "file_source_kind": f"{_UPLOADS} SELECT doc_id, CASE WHEN is_pdf THEN 'pdf' WHEN is_image THEN 'image' END AS kind FROM kinds",
    "file_preview": f"""{_UPLOADS},
shown AS (SELECT *, mime = 'application/pdf' OR ext = '.pdf' AS pdf, starts_with(mime, 'image/') OR ext IN ('.jpg', '.jpeg', '.png', '.bmp', '.gif') AS image, ext = '.docx' AS docx FROM kinds)
SELECT doc_id, CASE WHEN pdf THEN 150 END AS dpi, CASE WHEN NOT pdf AND image THEN 'Изображение' END AS caption, CASE WHEN NOT pdf AND NOT image AND docx THEN 30 END AS paragraphs_per_page,
       CASE WHEN pdf OR (NOT image AND docx) THEN true END AS show_page_selector,
       CASE WHEN is_image THEN '🖼️' WHEN is_pdf THEN '📄' WHEN is_docx THEN '📝' WHEN ext IN ('.txt', '.csv', '.json') THEN '📋' ELSE '📁' END AS icon FROM shown""",
    "file_formats": f"""{_UPLOADS},
lists(profile, formats, image_like) AS (VALUES
  ('ui', ['.bmp', '.docx', '.gif', '.jpeg', '.jpg', '.pdf', '.png'], ['.bmp', '.gif', '.jpeg', '.jpg', '.pdf', '.png']),
  ('ocr', ['.bmp', '.jpeg', '.jpg', '.pdf', '.png', '.tiff', '.webp'], ['.bmp', '.jpeg', '.jpg', '.pdf', '.png', '.tiff', '.webp']),
  ('convert', ['.bmp', '.gif', '.jpeg', '.jpg', '.pdf', '.png', '.webp'], ['.bmp', '.gif', '.jpeg', '.jpg', '.pdf', '.png', '.webp'])),
each AS (SELECT profile, (generate_subscripts(formats, 1) - 1)::INTEGER AS place, unnest(formats) AS format, image_like AS likes FROM lists),
used AS (SELECT ext AS format, count(*) AS uploads FROM kinds GROUP BY ext)
SELECT profile, place, format, list_contains(likes, format) AS image_like, coalesce(uploads, 0) AS uploads FROM each LEFT JOIN used USING (format)""",
    "file_scan": """
SELECT coalesce(source, '') AS source, sum(strlen(coalesce(text, '')) + 1)::BIGINT AS bytes, sum(strlen(coalesce(text, '')) + 1)::BIGINT AS "read", '.txt' AS ext FROM documents GROUP BY 1""",
    "raw_previews": """
SELECT doc_id, CASE WHEN shown THEN md5(text) END AS digest, CASE WHEN shown THEN length(text) END::INTEGER AS characters FROM (SELECT *, doc_id % 7 <> 0 AND strlen(text) < 10000 AS shown FROM documents)""",
    "output_names": f"""{_UPLOADS}
SELECT doc_id, printf('aligned_%s_%.1fdeg.png', substr(name, 1, length(name) - length(ext)), (size % 901 - 450) / 10) AS aligned_name FROM kinds""",
    "load_failures": """
WITH e AS (
  SELECT event_id, ts, (['404 Client Error: Not Found', 'No module AIStudio_SDK', 'PaddleNLP is missing', 'needs accelerate>=0.26', 'CUDA out of memory'])[event_id % 5 + 1] || ' / ' || event_type AS m,
         (['deepseek-ocr2', 'glm-ocr', 'deepseek-ocr'])[event_id % 3 + 1] AS model FROM events),
r AS (
  SELECT event_id, 'req_' || epoch_us(ts) // 1000 AS request_id, CASE WHEN contains(m, '404 Client Error') AND model = 'deepseek-ocr2' THEN 'model_not_published' WHEN lower(m) LIKE '%aistudio_sdk%' THEN 'dependency_aistudio'
           WHEN lower(m) LIKE '%paddlenlp%' THEN 'dependency_paddlenlp' WHEN lower(m) LIKE '%accelerate%' THEN 'dependency_accelerate' ELSE m END AS reason FROM e)
SELECT *, substr(reason, 1, 15) AS short FROM r""",
    "error_texts": "SELECT doc_id, md5(text || chr(65533)) AS digest, substr(text, 1, 100) AS short FROM documents",
    "result_exports": """
WITH t AS (
  SELECT doc_id, lang, n_chars, coalesce(CASE WHEN doc_id % 3 = 0 THEN 'all ' || source WHEN doc_id % 5 <> 0 THEN lang END, '') AS text FROM documents)
SELECT doc_id, text, to_base64(encode(text)) AS encoded, CASE WHEN doc_id % 4 <> 0 THEN text END AS decoded, '{"doc_id":' || doc_id || ',"lang":"' || lang || '","n_chars":' || n_chars || ',"error":null}' AS json FROM t""",
    "registry_defaults": f"""
WITH {_MODELS},
typed AS (SELECT *, CASE WHEN category LIKE 'text%' THEN 'text' ELSE category END AS model_type FROM models),
d AS (SELECT doc_id, (['text', 'vision', 'multimodal', 'ocr', 'embedding', 'specialized'])[doc_id % 6 + 1] AS model_type, (['ocr', 'text_general', 'text_code', 'vision', 'specialized'])[doc_id % 5 + 1] AS category FROM documents)
SELECT doc_id, d.model_type, coalesce(f.name, 'llama3:latest') AS default_name, d.category, coalesce(offered, 0) AS offered
FROM d LEFT JOIN (SELECT model_type, min_by(name, ordinal) AS name FROM typed GROUP BY 1) f USING (model_type) LEFT JOIN (SELECT category, count(*) AS offered FROM models GROUP BY 1) o USING (category)""",
    "registry_server": f"""{_ASKED},
hits AS (SELECT m.name, doc_id, length(text) > 2000 AND doc_id % 3 = 0 AS served FROM asked JOIN models m ON model IN (m.alias, m.name))
SELECT m.name, coalesce(bool_or(served), false) AS available_on_server, CASE WHEN m.name IN ('llava:latest', 'qwen:latest') THEN 'loaded' ELSE 'not_loaded' END AS label, count(h.doc_id) AS requests
FROM models m LEFT JOIN hits h USING (name) GROUP BY m.name""",
    "registry_refused": f"{_ASKED} SELECT doc_id, model, 400 AS status_code FROM asked WHERE NOT EXISTS (SELECT 1 FROM models m WHERE model IN (m.alias, m.name))",
    "model_inventory": f"""{_ASKED}
SELECT m.name AS model, ordinal % 3 = 0 AS is_loaded, false AS accelerated, count(doc_id) AS requests FROM models m LEFT JOIN asked ON model IN (m.alias, m.name) GROUP BY m.name, ordinal""",
    "binarize_unclamped": """
WITH px AS (SELECT vec_id, list_transform(embedding, lambda x: least(greatest(floor(x::DOUBLE * 256 + 128), 0), 255)::INTEGER) AS g, vec_id % 300 - 20 AS t FROM embeddings)
SELECT vec_id, array_to_string(list_transform(g, lambda p: CASE WHEN p > t THEN '1' ELSE '0' END), '') AS bits FROM px""",
    "ground_truth_records": """
SELECT 'f' || doc_id AS file_name, CASE WHEN ok THEN doc_id::VARCHAR END AS invoice_number, CASE WHEN ok THEN lang END AS invoice_date, CASE WHEN ok THEN doc_id % 4 END::INTEGER AS items, CASE WHEN ok AND doc_id % 4 > 0 THEN source END AS first
FROM (SELECT *, doc_id % 5 <> 0 AS ok FROM documents WHERE doc_id % 2 = 0)""",
}
