"""The SQL that the registered queries are compared with: recipes of the layout tables, and a statement per query."""

WORDS = """
tok AS (
  SELECT page_id, line_no, unnest(range(len(l))) AS word_no, unnest(l) AS content
  FROM (SELECT page_id, line_no, string_split(line, ' ') AS l FROM (SELECT doc_id AS page_id, unnest(range(len(t))) AS line_no, unnest(t) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS t FROM documents WHERE text IS NOT NULL)))
), pos AS (
  SELECT *, 50 + 10 * coalesce(sum(length(content) + 1) OVER (PARTITION BY page_id, line_no ORDER BY word_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS x1,
    ((line_no * 7) % 5 - 2) * 0.25::DOUBLE AS jitter, CASE page_id % 8 WHEN 3 THEN 1.0 WHEN 4 THEN -1.0 WHEN 5 THEN 90.0 WHEN 6 THEN 2.0 WHEN 7 THEN 358.0 ELSE 0.0 END::DOUBLE AS base FROM tok
), w AS (
  SELECT page_id, line_no // 4 AS par_no, line_no, word_no, content, x1, x1 + 10 * length(content) AS x2, y2 - 20 AS y1, y2, base + jitter AS angle_deg,
    ((page_id * 31 + line_no * 17 + word_no * 7) % 100) / 100.0::DOUBLE AS confidence, 20.0::DOUBLE AS font_size,
    length(content) - CASE WHEN (page_id + word_no) % 17 = 0 AND length(content) > 1 THEN 1 ELSE 0 END AS n_chars
  FROM (SELECT *, 100 + 40 * line_no + floor((x1 - 50) * tan(radians(jitter)) + 0.5) AS y2 FROM pos) WHERE content <> ''
)"""

LINES = (
    WORDS
    + """, lines AS (
  SELECT page_id, par_no, line_no, min(x1) AS lx1, min(y1) AS ly1, max(x2) AS lx2, max(y2) AS ly2, any_value(angle_deg) AS angle_deg, -5.0::DOUBLE AS line_y FROM w GROUP BY ALL HAVING true
)"""
).replace("GROUP BY ALL HAVING true", "GROUP BY page_id, par_no, line_no")

#: Words with their line's box, levelled angle, font and start.
LEVEL = (
    LINES
    + """, lw AS (
  SELECT w.*, lx1, ly1, lx2, ly2, line_y, radians(w.angle_deg) AS angle, (y2 - ly2) + line_y + tan(radians(w.angle_deg)) * (x1 - lx1) AS word_y, abs(radians(w.angle_deg)) < 0.005 AS flat FROM w JOIN lines USING (page_id, par_no, line_no)
), lev AS (
  SELECT *, CASE WHEN flat THEN 0.0 ELSE angle END AS line_angle, CASE WHEN font_size > 1 THEN font_size ELSE 10.0 END + abs(shift) AS font, lx1::DOUBLE AS start_x, ly2 + line_y + greatest(shift, 0.0) AS start_y
  FROM (SELECT *, CASE WHEN flat THEN sin(angle) * (lx2 - lx1) / 2 ELSE 0.0 END AS shift FROM lw)
)"""
)

PIXELS = """
px AS (SELECT page_id, y, x, floor((e::DOUBLE + 1) * 127)::INT AS v FROM (SELECT vec_id // 20 AS page_id, vec_id % 20 AS y, unnest(range(len(embedding))) AS x, unnest(embedding) AS e FROM embeddings)),
cells AS (SELECT page_id, cell, (cell % 4) * 16 AS x1, (cell // 4) * 10 AS y1, (cell % 4) * 16 + 16 AS x2, (cell // 4) * 10 + 10 AS y2, 1 + (page_id + cell) % 3 AS n_chars FROM (SELECT DISTINCT page_id FROM px), range(8) r(cell))"""

SOBEL = (
    PIXELS
    + """, d1 AS (
  SELECT page_id, y, x, v, coalesce(lag(v) OVER r, lead(v) OVER r, v) AS l, coalesce(lead(v) OVER r, lag(v) OVER r, v) AS rr FROM px WINDOW r AS (PARTITION BY page_id, y ORDER BY x)
), d2 AS (SELECT page_id, y, x, v, rr - l AS dx, l + 2 * v + rr AS sx FROM d1), g AS (
  SELECT page_id, y, x, v, 0.5 * (coalesce(lag(dx) OVER c, lead(dx) OVER c, dx) + 2 * dx + coalesce(lead(dx) OVER c, lag(dx) OVER c, dx)) + 0.5 * (coalesce(lead(sx) OVER c, lag(sx) OVER c, sx) - coalesce(lag(sx) OVER c, lead(sx) OVER c, sx)) AS g
  FROM d2 WINDOW c AS (PARTITION BY page_id, x ORDER BY y)
)"""
)


def quantile(source: str, q: float) -> str:
    return f"SELECT page_id, cell, min(bucket) FILTER (upto >= {q} * total) AS at FROM (SELECT *, sum(n) OVER (PARTITION BY page_id, cell ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY page_id, cell) AS total FROM {source}) GROUP BY page_id, cell"


BLUR = (
    SOBEL
    + f""", part AS (SELECT c.page_id, c.cell, g.v, g.g FROM cells c JOIN g ON g.page_id = c.page_id AND g.x >= c.x1 AND g.x < c.x2 AND g.y >= c.y1 AND g.y < c.y2),
hv AS (SELECT page_id, cell, v AS bucket, count(*) AS n FROM part WHERE v >= 0 AND v < 255 GROUP BY ALL), hg AS (SELECT page_id, cell, floor(g)::INT AS bucket, count(*) AS n FROM part WHERE g >= 0 AND g < 255 GROUP BY ALL),
hi AS ({quantile("hv", 0.95)}), lo AS ({quantile("hv", 0.05)}),
ws AS (SELECT c.page_id, c.cell, nullif(greatest(x2 - x1, y2 - y1) // n_chars, 0) AS char_width, coalesce(hi.at, 0) - coalesce(lo.at, 0) AS contrast FROM cells c LEFT JOIN hi USING (page_id, cell) LEFT JOIN lo USING (page_id, cell)),
steep AS (SELECT hg.* FROM hg JOIN ws USING (page_id, cell) WHERE bucket >= contrast // char_width), q85 AS ({quantile("steep", 0.85)})"""
)


def dominant(name: str, wrap: float, window: float) -> str:
    return f"""{name}_a AS (SELECT page_id, CASE WHEN r < 0 THEN r + {wrap} ELSE r END AS a, sum(wt)::DOUBLE AS w FROM (SELECT page_id, angle % {wrap} AS r, wt FROM angles) GROUP BY ALL),
{name}_b AS (SELECT page_id, a, w, 0 AS copy FROM {name}_a UNION ALL SELECT page_id, a - {wrap}, w, 1 FROM {name}_a WHERE a - {wrap} > -{window}),
{name}_c AS (SELECT page_id, a, w, copy, sum(w) OVER u - coalesce(sum(w) OVER e, 0) AS density, sum(w * a) OVER u - coalesce(sum(w * a) OVER e, 0) AS moment, (sum(copy) OVER u - coalesce(sum(copy) OVER e, 0)) > 0 AS crosses FROM {name}_b
  WINDOW u AS (PARTITION BY page_id ORDER BY a RANGE BETWEEN {window} PRECEDING AND CURRENT ROW), e AS (PARTITION BY page_id ORDER BY a RANGE BETWEEN {window} PRECEDING AND {window} PRECEDING)),
{name} AS (SELECT page_id, moment / nullif(density, 0) AS angle, density / nullif(total, 0) AS fraction FROM (SELECT *, sum(w) OVER (PARTITION BY page_id) AS total, row_number() OVER (PARTITION BY page_id ORDER BY density DESC, crosses, a) AS rn FROM {name}_c WHERE copy = 0) WHERE rn = 1)"""


ANGLES = WORDS + ", angles AS (SELECT page_id, angle_deg AS angle, n_chars AS wt FROM w)"


def near_zero(x: str, y: float) -> str:
    return f"(CASE WHEN ({x}) % {y} > {y / 2} THEN ({x}) % {y} - {y} WHEN ({x}) % {y} < -{y / 2} THEN ({x}) % {y} + {y} ELSE ({x}) % {y} END)"


ROTATION = f"""WITH {ANGLES}, {dominant("f", 360.0, 5.0)}, {dominant("q", 90.0, 5.0)},
r AS (SELECT f.page_id, f.angle AS a, f.fraction AS fr, {near_zero("f.angle", 360.0)} AS t, {near_zero("q.angle", 90.0)} AS qt, q.fraction AS qf FROM f JOIN q USING (page_id)), s AS (SELECT *, {near_zero("t", 90.0)} AS rest FROM r)
SELECT page_id, round(a, 6) AS dominant_deg, round(fr, 6) AS fraction, round(CASE WHEN abs(rest) < 5 AND fr > 0.95 THEN t - rest + rest WHEN abs(qt) < 5 AND qf > 0.95 THEN qt ELSE 0.0 END, 6) + 0.0 AS adjust_deg FROM s"""

SYMBOLS = (
    WORDS
    + """, ch AS (SELECT page_id, par_no, line_no, word_no, x1, y1, y2, confidence, unnest(range(length(content))) AS char_no, unnest(string_split(content, '')) AS text FROM w),
kept AS (SELECT * FROM ch WHERE NOT (line_no % 50 = 49 OR line_no % 70 = 69)), nw AS (
  SELECT dense_rank() OVER (PARTITION BY page_id ORDER BY par_no) - 1 AS p, dense_rank() OVER (PARTITION BY page_id ORDER BY line_no) - 1 AS l, dense_rank() OVER (PARTITION BY page_id ORDER BY line_no, word_no) - 1 AS wn, * FROM kept)"""
)

JOBS = """j0 AS (SELECT user_id AS page_id, event_id AS seq, event_type IN ('click', 'view') AS submit, sum(CASE WHEN event_type IN ('click', 'view') THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS so_far FROM events WHERE event_type IN ('click', 'view', 'purchase')),
jobs AS (SELECT page_id, seq, submit, CASE WHEN submit THEN so_far ELSE so_far - seq % 2 END AS job_id FROM j0 WHERE CASE WHEN submit THEN so_far ELSE so_far - seq % 2 END >= 1)"""

OPTIONS = """o2 AS (SELECT doc_id AS page_id, CASE WHEN doc_id % 3 = 0 THEN 0.5 ELSE 0.3 END AS conf, CASE WHEN doc_id % 3 = 1 THEN 0.2 ELSE 0.1 END AS blur, CASE WHEN doc_id % 5 = 0 THEN 4.0 ELSE 5.0 END AS diff FROM documents)"""

#: Options as one text each, those of recognition and the cheap ones; a page's accepted options are those of its last submission with an image.
SUBMISSIONS = """sub AS (SELECT doc_id AS page_id, v AS version, (doc_id + v) % 4 <> 0 AS has_image, concat_ws(' ', (doc_id + v) % 9 <> 0, CASE WHEN doc_id % 5 = v THEN 4 ELSE 5 END, doc_id % 11 = 0) AS other,
  concat_ws(' ', CASE WHEN doc_id % 3 = 0 AND v > 2 THEN 5 ELSE 3 END, CASE WHEN doc_id % 3 = 1 THEN v // 2 ELSE 1 END) AS cheap FROM documents, (SELECT unnest([1, 2, 3, 4]) AS v)),
was AS (SELECT s.*, max(o.version) AS at FROM sub s LEFT JOIN sub o ON o.page_id = s.page_id AND o.version < s.version AND o.has_image GROUP BY ALL),
changed AS (SELECT w.*, o.other AS old_other, o.cheap AS old_cheap FROM was w LEFT JOIN sub o ON o.page_id = w.page_id AND o.version = w.at WHERE o.page_id IS NULL OR o.other <> w.other OR o.cheap <> w.cheap)"""

DEVICES = """s AS (SELECT s_suppkey AS device_id, (s_suppkey % 5)::DOUBLE AS k, 100.0 + 10.0 * (s_suppkey % 5) AS top FROM supplier),
opt AS (SELECT * FROM (
  SELECT device_id, 1 AS idx, 'resolution' AS name, 'INT' AS type, 1 AS cap, NULL::DOUBLE AS range_min, NULL::DOUBLE AS range_max, 300.0::DOUBLE AS value, 'group standard' AS grp FROM s
  UNION ALL SELECT device_id, 3, 'tl-x', 'FIXED', 1, k, top, k, 'group geometry' FROM s UNION ALL SELECT device_id, 4, 'tl-y', 'FIXED', 1, 0, top * 2, 0, 'group geometry' FROM s
  UNION ALL SELECT device_id, 5, 'br-x', 'FIXED', 1, 0, top, CASE WHEN device_id % 3 = 0 THEN top ELSE top / 2 END, 'group geometry' FROM s
  UNION ALL SELECT device_id, 6, 'br-y', 'FIXED', 1, 0, top * 2, top * 2, 'group geometry' FROM s WHERE device_id % 11 <> 0
  UNION ALL SELECT device_id, 7, 'mode', 'STRING', CASE WHEN device_id % 6 = 0 THEN 3 ELSE 1 END, NULL, NULL, 1.0, 'group geometry' FROM s
  UNION ALL SELECT device_id, 8, 'start', 'BUTTON', 1, NULL, NULL, NULL, 'group geometry' FROM s UNION ALL SELECT device_id, 10, 'resolution', 'INT', 1, 1, 2, 1, 'group empty' FROM s))"""

AREAS = (
    DEVICES
    + """, cur AS (SELECT device_id, x, y, bx - x AS w, b_y - y AS h FROM (SELECT device_id, max(value) FILTER (name = 'tl-x') AS x, max(value) FILTER (name = 'tl-y') AS y, max(value) FILTER (name = 'br-x') AS bx, max(value) FILTER (name = 'br-y') AS b_y FROM opt GROUP BY ALL)),
mx AS (SELECT device_id, x, y, bx - x AS w, b_y - y AS h FROM (SELECT device_id, max(range_min) FILTER (name = 'tl-x') AS x, max(range_min) FILTER (name = 'tl-y') AS y, max(range_max) FILTER (name = 'br-x') AS bx, max(range_max) FILTER (name = 'br-y') AS b_y FROM opt GROUP BY ALL))"""
)
_NULLED = "CASE WHEN h IS NOT NULL THEN {0} END AS {0}"
_AREA = ", ".join(_NULLED.format(c) for c in "xyw") + ", h"

RESOLUTIONS = "b AS (SELECT s_suppkey AS device_id, s_suppkey % 4 AS kind, 50 + 25 * (s_suppkey % 5) AS base FROM supplier)"



#: Lines of 8 tokens in reading order: the densest window of buckets is peeled off again and again, one step of the recursion for all paragraphs.
READING = (
    WORDS
    + """, frag AS (
  SELECT page_id, par_no, line_no, word_no // 8 AS part, min(x1) AS x1, max(x2) AS x2, max(y2) AS y2, any_value(radians(angle_deg)) AS angle, arg_min(y1, word_no) AS top, avg(font_size) AS font FROM w GROUP BY page_id, par_no, line_no, word_no // 8
), ln AS (
  SELECT *, row_number() OVER (PARTITION BY page_id, par_no ORDER BY top, line_no, part) - 1 AS line_at, abs(angle - avg(angle) OVER p) < radians(2) AS good, (min(x1) OVER p + max(x2) OVER p) / 2 AS mid, avg(font) OVER p AS mean_font
  FROM frag WINDOW p AS (PARTITION BY page_id, par_no)
), gl AS (SELECT *, y2 - 5.0 + CASE WHEN good THEN tan(angle) * (mid - x1) ELSE 0.0 END AS y FROM ln),
par AS (SELECT page_id, par_no, count(*) FILTER (good) AS n, min(y) FILTER (good) AS lo, max(y) FILTER (good) AS hi, any_value(mean_font) AS font, any_value(mean_font) / 10 AS size FROM gl GROUP BY ALL),
used AS (SELECT *, hi - lo <= 0 OR hi - lo < 5 * size AS one FROM par WHERE n >= 3 AND font >= 10 AND (hi - lo) / font <= 200),
counts AS (SELECT page_id, par_no, lo, size, floor((hi - lo) / size) AS last, least(floor((y - lo) / size), floor((hi - lo) / size)) AS bucket, count(*) AS n FROM gl JOIN used USING (page_id, par_no) WHERE good AND NOT one GROUP BY ALL),
hist AS (SELECT page_id, par_no, lo, size, list_transform(range(last::INT + 1), lambda i: coalesce(m[i], 0)) AS h FROM (SELECT page_id, par_no, lo, size, last, map_from_entries(list((bucket::BIGINT, n))) AS m FROM counts GROUP BY ALL)),
peel AS (
  SELECT page_id, par_no, lo, size, h, 0 AS step, NULL::BIGINT AS a, NULL::BIGINT AS b FROM hist
  UNION ALL
  SELECT page_id, par_no, lo, size, list_transform(h, lambda x, i: CASE WHEN i > greatest(c - 5, 0) AND i <= c + 6 THEN 0 ELSE x END), step + 1, greatest(c - 5, 0), least(c + 6, len(h) + 1)
  FROM (SELECT *, floor(list_sum(list_transform(range(s, s + 5), lambda i: i * h[i + 1])) / list_sum(h[s + 1 : s + 5]) + 0.5)::BIGINT AS c
    FROM (SELECT *, list_position(sums, list_max(sums)) - 1 AS s FROM (SELECT *, list_transform(range(len(h) - 4), lambda i: list_sum(h[i + 1 : i + 5])) AS sums FROM peel WHERE list_sum(h) > 0)))
), cluster AS (SELECT g.page_id, g.par_no, g.line_at, arg_min((p.lo + a * p.size + p.lo + b * p.size) / 2, step) AS key FROM gl g JOIN peel p ON p.page_id = g.page_id AND p.par_no = g.par_no AND g.good AND step > 0 AND y >= p.lo + a * p.size AND y <= p.lo + b * p.size GROUP BY ALL),
keyed AS (SELECT g.*, used.page_id IS NOT NULL AS used, CASE WHEN NOT good THEN y WHEN one THEN (hi + lo) / 2 ELSE key END AS key FROM gl g LEFT JOIN used USING (page_id, par_no) LEFT JOIN cluster USING (page_id, par_no, line_at))"""
)


#: Numbers as the export writes them, and a page's document.
_NUMBER = "replace(replace(({0})::DOUBLE::VARCHAR, 'e+', 'E'), 'e-', 'E-')"
_ESCAPED = "replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
_HEAD = '<?xml version="1.0" encoding="UTF-8"?>\n<!DOCTYPE html PUBLIC "-//W3C//DTD XHTML 1.0 Transitional//EN" "http://www.w3.org/TR/xhtml1/DTD/xhtml1-transitional.dtd">\n<html xmlns="http://www.w3.org/1999/xhtml"><head><title></title></head><body>\n<div class="ocr_page" title="ppageno 0"><div class="ocr_carea">\n'
EXPORTED = (
    LINES
    + f""", wx AS (
  SELECT w.*, lx1, ly1, lx2, ly2, line_y, '<span class="ocrx_word" title="bbox ' || concat_ws(' ', x1, y1::INT, x2, y2::INT) || '; x_wconf ' || {_NUMBER.format("round(confidence * 100, 6)")} || '">' || array_to_string(list_transform(range(length(content)),
    lambda i: '<span class="ocrx_cinfo" title="x_bboxes ' || CASE WHEN i < n_chars THEN concat_ws(' ', x1 + 10 * i, y1::INT, x1 + 10 * i + 10, y2::INT) ELSE concat_ws(' ', x2, y1::INT, x2, y2::INT) END || '">' || {_ESCAPED.format("content[i + 1]")} || '</span>'), '') || '</span>' AS t
  FROM w JOIN lines USING (page_id, par_no, line_no)
), lx AS (
  SELECT page_id, par_no, line_no, min(lx1) AS x1, min(ly1)::INT AS y1, max(lx2) AS x2, max(ly2)::INT AS y2, '<span class="ocr_line" title="bbox ' || concat_ws(' ', min(lx1), min(ly1)::INT, max(lx2), max(ly2)::INT) || '; baseline ' || {_NUMBER.format("tan(radians(min(angle_deg)))")} || ' ' || {_NUMBER.format("min(line_y)")} || '; x_size ' || {_NUMBER.format("min(font_size)")} || '">' || string_agg(t, '' ORDER BY word_no) || '</span>' || chr(10) AS t
  FROM wx GROUP BY page_id, par_no, line_no
), px_ AS (SELECT page_id, par_no, '<p class="ocr_par" title="bbox ' || concat_ws(' ', min(x1), min(y1), max(x2), max(y2)) || '">' || chr(10) || string_agg(t, '' ORDER BY line_no) || '</p>' || chr(10) AS t FROM lx GROUP BY page_id, par_no),
exported AS (SELECT page_id, '{_HEAD}' || string_agg(t, '' ORDER BY par_no) || '</div></div>' || chr(10) || '</body></html>' || chr(10) AS content FROM px_ GROUP BY page_id)"""
)


def level_only(x: str, digits: int = 4) -> str:
    return f"CASE WHEN abs({x}) < 1e9 THEN round({x}, {digits}) + 0.0 END"


ORACLE_SQL: dict[str, str] = {
    "flatten_words": f"WITH {WORDS} SELECT page_id, par_no, line_no, word_no, content, x1, y1, x2, y2, n_chars FROM w",
    "flatten_chars": f"WITH {WORDS} SELECT page_id, par_no, line_no, word_no, i AS char_no, x1 + 10 * i AS x1, x1 + 10 * i + 10 AS x2 FROM (SELECT *, unnest(range(n_chars)) AS i FROM w)",
    "nest_roundtrip": f"WITH {WORDS} SELECT page_id, count(DISTINCT par_no) AS n_pars, count(DISTINCT line_no) AS n_lines, count(*) AS n_words, sum(x1)::BIGINT AS sum_x1, sum(n_chars)::BIGINT AS n_chars FROM w GROUP BY ALL",
    "conf_clean_words": f"WITH {WORDS} SELECT page_id, par_no, line_no, word_no, content, confidence FROM w WHERE confidence >= 0.3",
    "conf_clean_lines": f"WITH {WORDS} SELECT page_id, par_no, line_no, count(*) AS n_words FROM w WHERE confidence >= 0.3 GROUP BY ALL",
    "conf_clean_paragraphs": f"WITH {WORDS} SELECT page_id, par_no, count(DISTINCT line_no) AS n_lines, count(*) AS n_words FROM w WHERE confidence >= 0.3 GROUP BY ALL",
    "good_baseline_lines": f"WITH {LINES} SELECT page_id, par_no, line_no, abs(angle_deg - avg(angle_deg) OVER (PARTITION BY page_id, par_no)) < 0.4 AS good FROM lines",
    "char_position_ok": f"WITH {WORDS} SELECT page_id, line_no, count(*) FILTER (length(content) = n_chars) AS n_ok, count(*) AS n_words FROM w GROUP BY ALL",
    "order_label": f"WITH {WORDS} SELECT page_id, concat_ws('-', par_no, line_no, word_no) AS label, x2 - x1 AS width, y2 - y1 AS height, concat_ws(' ', x1, y1::INT, x2, y2::INT) AS box_text FROM w",
    "avg_angle": f"WITH {WORDS} SELECT page_id, round(sum(n_chars * angle_deg) / nullif(sum(n_chars), 0), 6) AS angle FROM w GROUP BY ALL",
    "dominant_angle_360": f"WITH {ANGLES}, {dominant('d', 360.0, 5.0)} SELECT page_id, round(angle, 6) AS angle, round(fraction, 6) AS fraction FROM d",
    "dominant_angle_90": f"WITH {ANGLES}, {dominant('d', 90.0, 5.0)} SELECT page_id, round(angle, 6) AS angle, round(fraction, 6) AS fraction FROM d",
    "rotation_decision": ROTATION,
    "par_font_mean": f"WITH {WORDS} SELECT page_id, par_no, round(avg(m), 6) AS mean FROM (SELECT page_id, par_no, line_no, avg(font_size + word_no % 3) AS m FROM w GROUP BY ALL) GROUP BY ALL",
    "extents": f"WITH {LINES} SELECT page_id, par_no, min(lx1) AS x1, max(lx2) AS x2, round(min(ly2 + line_y), 6) AS low, round(max(ly2 + line_y), 6) AS high FROM lines GROUP BY ALL",
    "page_counts": f"WITH {WORDS} SELECT page_id, count(*) AS n_words, sum(n_chars)::BIGINT AS n_chars FROM w GROUP BY ALL",
    "hist255": f"WITH {BLUR} SELECT page_id, cell, bucket, n FROM hv",
    "quantile_index": f"WITH {BLUR}, lo5 AS (SELECT page_id, cell, 0 AS q0 FROM hv GROUP BY ALL) SELECT page_id, cell, q0, lo.at AS q05, hi.at AS q95 FROM lo5 JOIN lo USING (page_id, cell) JOIN hi USING (page_id, cell)",
    "hocr_props": f"WITH {WORDS} SELECT page_id, line_no, word_no, x1, y1::INT AS y1, x2, y2::INT AS y2, confidence AS wconf FROM w",
    "hocr_ingest": f"WITH {LINES}, k AS (SELECT w.*, lx1, ly1, lx2, ly2 FROM w JOIN lines USING (page_id, par_no, line_no) WHERE n_chars > 0) SELECT page_id, dense_rank() OVER (PARTITION BY page_id ORDER BY par_no) - 1 AS par_no, content, x1, y1::INT AS y1, x2, y2::INT AS y2, confidence, font_size, length(content) AS n_boxes, {level_only('(y2 - ly2) - 5.0 + tan(radians(angle_deg)) * (x1 - lx1)', 3)} AS base_y FROM k",
    "symbols_nest": f"WITH {SYMBOLS} SELECT page_id, p AS par_no, l AS line_no, wn AS word_no, string_agg(text, '' ORDER BY char_no) AS content, min(x1 + 10 * char_no) AS x1, max(x1 + 10 * char_no + 10) AS x2, count(*) AS n_chars, round(avg(confidence), 6) AS confidence FROM nw GROUP BY page_id, p, l, wn",
    "word_baseline_hocr": f"WITH {LEVEL} SELECT page_id, line_no, word_no, {level_only('word_y', 6)} AS word_y FROM lw",
    "baseline_transfer": f"WITH {LEVEL}, m AS (SELECT *, lx1 - x1 AS dx, ly2 + line_y - y2 AS dy FROM lw) SELECT page_id, line_no, word_no, round(CASE WHEN abs(angle) > pi() / 4 THEN dx + dy / tan(angle) ELSE 0.0 END, 4) + 0.0 AS bx, round(CASE WHEN abs(angle) > pi() / 4 THEN 0.0 ELSE dy + dx * tan(angle) END, 6) + 0.0 AS b_y FROM m",
    "baseline_from_points": f"""WITH {LINES}, m AS (SELECT *, atan(((ly1 - ly2) + (line_no % 5) * 3) / (lx2 - lx1)::DOUBLE) AS s, CASE page_id % 4 WHEN 0 THEN -pi() / 2 WHEN 1 THEN 0.0 WHEN 2 THEN pi() / 2 ELSE pi() END AS low FROM lines), n AS (SELECT *, CASE WHEN s < low THEN s + pi() ELSE s END AS t FROM m)
      SELECT page_id, line_no, 0.0::DOUBLE AS bx, 0.0::DOUBLE AS b_y, round(CASE WHEN t < low THEN t + pi() ELSE t END, 6) + 0.0 AS angle FROM n""",
    "flat_line_level": f"WITH {LEVEL} SELECT page_id, line_no, word_no, round(line_angle, 6) + 0.0 AS line_angle, round(font, 6) AS font, round(start_y, 6) AS start_y FROM lev",
    "line_matrix": f"WITH {LEVEL} SELECT DISTINCT page_id, line_no, round(cos(-line_angle), 6) AS a, round(sin(-line_angle), 6) + 0.0 AS b, round(start_x, 6) AS x, round(100000.0 - start_y, 6) AS y FROM lev",
    "word_pen": f"WITH {LEVEL}, m AS (SELECT *, x1 - coalesce(lag(x1) OVER o, start_x) AS mx, y2 + word_y - coalesce(lag(y2 + word_y) OVER o, start_y) AS my FROM lev WINDOW o AS (PARTITION BY page_id, par_no, line_no ORDER BY word_no)) SELECT page_id, line_no, word_no, {level_only('mx * cos(line_angle) + my * sin(line_angle)')} AS dx, {level_only('my * cos(line_angle) - mx * sin(line_angle)')} AS dy FROM m",
    "char_advance": f"WITH {WORDS} SELECT page_id, line_no, word_no, char_no, 10 AS advance FROM (SELECT *, unnest(range(length(content))) AS char_no FROM w WHERE length(content) = n_chars)",
    "rotated_pen": f"WITH {LEVEL} SELECT page_id, line_no, word_no, char_no, round(x1 + cos(line_angle) * 10 * char_no, 4) AS x, {level_only('y2 + word_y + sin(line_angle) * 10 * char_no')} AS y FROM (SELECT *, unnest(range(length(content))) AS char_no FROM lev WHERE length(content) = n_chars)",
    "stretch": f"WITH {LEVEL}, m AS (SELECT *, 100 * (sqrt((x2 - x1) ** 2 + ((x2 - x1) * tan(line_angle)) ** 2) / nullif(length(content), 0)) / (font / 2) AS s FROM lev WHERE length(content) <> n_chars) SELECT page_id, line_no, word_no, round(s, 4) AS stretch, round(s * 0.2, 4) AS space FROM m",
    "page_text": f"WITH {WORDS} SELECT page_id, string_agg(content, ' ' ORDER BY par_no, line_no, word_no) || ' ' AS text FROM w GROUP BY ALL",
    "text_layer": f"WITH {LEVEL} SELECT page_id, count(*) FILTER (length(content) <> n_chars) AS n_whole, sum(CASE WHEN length(content) = n_chars THEN length(content) + 1 ELSE 2 END)::BIGINT AS n_rows, round(max(CASE WHEN length(content) = n_chars THEN 1000 / (font / 2) ELSE 100 * (sqrt((x2 - x1) ** 2 + ((x2 - x1) * tan(line_angle)) ** 2) / nullif(length(content), 0)) / (font / 2) END), 3) AS stretch FROM lev GROUP BY ALL",
    "text_layer_rows": f"WITH {LEVEL}, s AS (SELECT *, length(content) = n_chars AS ok, 100 * (sqrt((x2 - x1) ** 2 + ((x2 - x1) * tan(line_angle)) ** 2) / length(content)) / (font / 2) AS whole FROM lev) SELECT page_id, line_no, sum(CASE WHEN ok THEN length(content) + 1 ELSE 2 END)::BIGINT AS n_rows, round(max(cos(line_angle)), 6) + 0.0 AS a, round(max(-sin(line_angle)), 6) + 0.0 AS b, max(start_x) AS line_x, round(max(100000.0 - start_y), 6) AS line_y, count(*) AS n_spaces, round(min(CASE WHEN ok THEN least(20.0, 1000 / (font / 2)) ELSE whole * 0.2 END), 3) AS least FROM s GROUP BY page_id, line_no",
    "export_manifest_pdf": "SELECT doc_id AS page_id, 'scan.pdf' AS file, n AS file_page, CASE WHEN doc_id % 9 = 0 THEN 'no image' WHEN doc_id % 7 = 0 THEN 'no result' END AS error FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS n, count(*) OVER () AS total FROM documents) WHERE n < total",
    "blurred_boxes": f"WITH {BLUR} SELECT page_id, count(*) AS n, string_agg(concat_ws(' ', x1, y1, x2, y2), ',' ORDER BY cell) AS boxes FROM ws JOIN cells USING (page_id, cell) LEFT JOIN q85 USING (page_id, cell) WHERE ws.contrast >= ws.char_width * 0.1 * coalesce(q85.at, 0) GROUP BY page_id",
    "recompute_words": f"WITH {OPTIONS}, {WORDS} SELECT page_id, count(*) AS n_words, sum(x1)::BIGINT AS sum_x1, max(blur) AS blur_coef FROM w JOIN o2 USING (page_id) WHERE page_id % 7 <> 0 AND diff = 5 AND (conf <> 0.3 OR blur <> 0.1) AND confidence >= conf GROUP BY page_id",
    "symbols_pages": f"WITH {SYMBOLS}, wd AS (SELECT page_id, l, wn, min(x1 + 10 * char_no) AS a, min(y1) AS b, max(x1 + 10 * char_no + 10) AS c, max(y2) AS d, count(*) AS k FROM nw GROUP BY ALL) SELECT page_id, l AS line_no, min(a) AS x1, min(b)::INT AS y1, max(c) AS x2, max(d)::INT AS y2, count(*) AS n_words, sum(k)::BIGINT AS n_chars, round(max(d) * count(*) - sum(d), 3)::DOUBLE AS base_y FROM wd GROUP BY page_id, l",
    "hocr_paragraphs": f"WITH {LINES}, c AS (SELECT page_id, par_no, count(*) AS n_words FROM w GROUP BY ALL) SELECT page_id, dense_rank() OVER (PARTITION BY page_id ORDER BY par_no) - 1 AS par_no, x1, y1::INT AS y1, x2, y2::INT AS y2, n_lines, n_words FROM (SELECT page_id, par_no, min(lx1) AS x1, min(ly1) AS y1, max(lx2) AS x2, max(ly2) AS y2, count(*) AS n_lines FROM lines GROUP BY ALL) JOIN c USING (page_id, par_no)",
    "export_manifest": "SELECT doc_id AS page_id, 'scan-' || n || '.png' AS file, 'adjusted' AS image, true AS with_text FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS n, count(*) OVER () AS total FROM documents) WHERE n < total",
    "sobel": f"WITH {SOBEL} SELECT page_id, y, x, round(g, 6) + 0.0 AS g FROM g",
    "word_pixels": f"WITH {BLUR} SELECT page_id, cell, count(*) AS n, sum(v)::BIGINT AS total FROM part GROUP BY ALL",
    "word_blur": f"WITH {BLUR} SELECT page_id, cell, char_width, contrast, coalesce(q85.at, 0) AS sharpness, contrast >= char_width * 0.1 * coalesce(q85.at, 0) AS blurred FROM ws LEFT JOIN q85 USING (page_id, cell)",
    "latest_submission_wins": f"WITH {JOBS} SELECT page_id, seq, job_id FROM (SELECT *, max(CASE WHEN submit THEN job_id END) OVER (PARTITION BY page_id ORDER BY seq) AS last FROM jobs) WHERE NOT submit AND job_id = last",
    "current_state": f"WITH {JOBS} SELECT s.page_id, s.job_id, coalesce(d.done, false) AS finished FROM (SELECT page_id, max(job_id) AS job_id FROM jobs WHERE submit GROUP BY ALL) s LEFT JOIN (SELECT DISTINCT page_id, job_id, true AS done FROM jobs WHERE NOT submit) d USING (page_id, job_id)",
    "recompute_mode": f"WITH {OPTIONS} SELECT page_id, CASE WHEN page_id % 7 = 0 OR diff <> 5 THEN 'FULL' WHEN conf <> 0.3 OR blur <> 0.1 THEN 'ONLY_PARAGRAPHS' ELSE 'NONE' END AS mode FROM o2",
    "option_change_suppress": f"WITH {OPTIONS} SELECT page_id, 1 AS version FROM o2 WHERE page_id % 7 <> 0 UNION ALL SELECT page_id, 2 FROM o2 WHERE page_id % 7 = 0 OR conf <> 0.3 OR blur <> 0.1 OR diff <> 5",
    "option_groups": f"WITH {DEVICES} SELECT device_id, grp AS group_name, idx, name FROM opt",
    "option_first_match": f"WITH {DEVICES} SELECT device_id, name, min(idx) AS idx FROM opt GROUP BY ALL",
    "scan_area_current": f"WITH {AREAS} SELECT device_id, {_AREA} FROM cur",
    "scan_area_max": f"WITH {AREAS} SELECT device_id, {_AREA} FROM mx",
    "full_area": f"WITH {AREAS} SELECT device_id, coalesce(abs(c.x - m.x) <= 0.1 AND abs(c.y - m.y) <= 0.1 AND abs(c.x + c.w - m.x - m.w) <= 0.1 AND abs(c.y + c.h - m.y - m.h) <= 0.1, false) AS full_area FROM cur c JOIN mx m USING (device_id)",
    "min_resolution": f"WITH {RESOLUTIONS} SELECT device_id, base * CASE kind WHEN 0 THEN 1.0 WHEN 1 THEN 2.0 WHEN 2 THEN 1.5 ELSE 3.0 END::DOUBLE AS min_resolution FROM b",
    "value_valid": f"WITH {RESOLUTIONS} SELECT device_id, CASE kind WHEN 0 THEN 300 IN (base, base * 2) WHEN 1 THEN 300 IN (base * 2, base * 4) WHEN 2 THEN 300 BETWEEN base * 1.5 AND base * 8 ELSE 300 BETWEEN base * 3 AND base * 9 END AS valid FROM b",
    "settings_diff": f"WITH {DEVICES}, f AS (SELECT device_id, name, min(idx) AS idx FROM opt GROUP BY ALL), want AS (SELECT device_id, name, CASE WHEN name = 'mode' THEN 2.0 WHEN name = 'resolution' THEN 300.0 ELSE device_id % 5 END AS desired FROM f WHERE name <> 'start') SELECT device_id, idx, name, value, desired::DOUBLE AS desired FROM f JOIN opt USING (device_id, name, idx) JOIN want USING (device_id, name) WHERE cap = 1 AND desired IS DISTINCT FROM value",
    "unknown_settings": "SELECT s_suppkey AS device_id, 'br-y' AS name FROM supplier WHERE s_suppkey % 11 = 0",
    "missing_devices": "SELECT s_name || '-b' AS name FROM supplier WHERE s_suppkey % 9 = 0",
    "scalar_angles": f"WITH {WORDS} SELECT page_id, line_no, word_no, round({near_zero('angle_deg * (word_no - 3)', 90.0)}, 6) + 0.0 AS near, round(CASE WHEN (angle_deg * (word_no - 3)) % 90 < 0 THEN (angle_deg * (word_no - 3)) % 90 + 90 ELSE (angle_deg * (word_no - 3)) % 90 END, 6) + 0.0 AS positive, round(radians(angle_deg), 6) + 0.0 AS rad, round(x1 / 25.4, 6) AS inches FROM w",
    "almost_equal_boxes": f"WITH {LINES} SELECT page_id, line_no, word_no, abs(x1 - lx1) <= 40 AND abs(y1 - ly1) <= 40 AND abs(x2 - lx2) <= 40 AND abs(y2 - ly2) <= 40 AS near FROM w JOIN lines USING (page_id, par_no, line_no)",
    "reading_order": f"WITH RECURSIVE {READING} SELECT page_id, par_no, line_at, row_number() OVER (PARTITION BY page_id, par_no ORDER BY CASE WHEN used THEN key END, CASE WHEN used THEN CASE WHEN good THEN x1 ELSE -1e300 END END, line_at) - 1 AS place FROM keyed",
    "option_submissions": f"WITH {SUBMISSIONS} SELECT page_id, version::INT AS version, CASE WHEN has_image THEN (SELECT count(*) FROM changed c WHERE c.page_id = x.page_id AND c.has_image AND c.version <= x.version) END::INT AS job_id, CASE WHEN has_image THEN CASE WHEN old_other IS NULL OR old_other <> other THEN 'FULL' ELSE 'ONLY_PARAGRAPHS' END END AS mode, CASE WHEN NOT has_image THEN 'no image' END AS error FROM changed x",
    "recompute_store": f"WITH {OPTIONS}, {WORDS}, {BLUR}, kw AS (SELECT page_id, count(*) AS n_words, sum(line_no * 31 + word_no)::BIGINT AS places FROM w JOIN o2 USING (page_id) WHERE confidence >= conf GROUP BY ALL), kb AS (SELECT ws.page_id, count(*) AS n_blurred FROM ws JOIN o2 USING (page_id) LEFT JOIN q85 USING (page_id, cell) WHERE ws.contrast >= ws.char_width * blur * coalesce(q85.at, 0) GROUP BY ALL) SELECT page_id, conf::DOUBLE AS min_word_confidence, blur::DOUBLE AS blur_coef, coalesce(n_words, 0) AS n_words, coalesce(places, 0) AS places, coalesce(n_blurred, 0) AS n_blurred FROM o2 LEFT JOIN kw USING (page_id) LEFT JOIN kb USING (page_id)",
    "hocr_export": f"WITH {EXPORTED} SELECT page_id AS doc, content FROM exported",
    "hocr_packed": f"WITH {EXPORTED} SELECT page_id, length(content) AS n_chars, md5(content) AS digest FROM exported",
    "hocr_errors": f"WITH {WORDS} SELECT DISTINCT page_id, CASE page_id % 5 WHEN 0 THEN 'malformed' WHEN 1 THEN 'no body' WHEN 2 THEN 'word' WHEN 3 THEN 'line' ELSE 'char' END AS error FROM w",
    "export_sessions": "SELECT doc_id AS page_id, session, session || '/scan-' || n || '.png' AS file, CASE WHEN doc_id % 9 = 0 THEN 'no image' END AS error FROM (SELECT doc_id, session, row_number() OVER (PARTITION BY session ORDER BY doc_id) AS n, count(*) OVER (PARTITION BY session) AS total FROM (SELECT doc_id, CASE WHEN doc_id % 13 <> 0 THEN coalesce(source, '') ELSE '' END AS session FROM documents)) WHERE n < total",
    "typed_values": "WITH o AS (SELECT s_suppkey AS id, unnest(['preview', 'resolution', 'tl-x', 'mode', 'depth', 'button', 'holes']) AS name FROM supplier), t AS (SELECT *, CASE name WHEN 'depth' THEN CASE WHEN id % 2 = 0 THEN 'resolution' ELSE 'tl-x' END ELSE name END AS kind, id % 4 > 1 AS one FROM o) SELECT id AS device_id, name, CASE WHEN kind = 'preview' AND one THEN (id % 2 = 0)::VARCHAR END AS b, CASE WHEN kind = 'resolution' AND one THEN id END::INT AS i, CASE WHEN kind = 'tl-x' AND one THEN id / 2 END::DOUBLE AS f, CASE WHEN kind = 'mode' THEN 'Mode ' || id % 3 END AS s FROM t",
    "word_changes": f"WITH {WORDS}, k AS (SELECT page_id, par_no, line_no, word_no, n_chars, (page_id + line_no * 3 + word_no) % 40 AS k FROM w WHERE page_id % 4 <> 0) SELECT page_id, par_no, line_no, word_no, CASE WHEN k = 0 THEN 'gone' ELSE 'changed' END AS status FROM k WHERE k < 3 OR k = 3 AND n_chars > 1 UNION ALL SELECT page_id, par_no, line_no, word_no + 100000, 'new' FROM k WHERE k = 4",
}
