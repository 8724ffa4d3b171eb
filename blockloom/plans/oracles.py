"""DuckDB SQL of the core queries, with the same columns."""

from __future__ import annotations

from blockloom.functions.rules import TAGS
from blockloom.sources.providers import TASK

SP = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
LATEST = "(SELECT * FROM translations QUALIFY row_number() OVER (PARTITION BY manual, page_idx, block_idx ORDER BY loaded_at DESC, row_id DESC) = 1)"
META = "(SELECT * FROM meta WHERE manual IS NOT NULL QUALIFY row_number() OVER (PARTITION BY manual ORDER BY loaded_at DESC, meta_id DESC) = 1)"


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^{SP}+|{SP}+$', '', 'g')"


def collapse(c: str) -> str:
    return f"regexp_replace({strip(c)}, '{SP}+', ' ', 'g')"


def noise(c: str) -> str:
    s = strip(c)
    return (
        f"({c} IS NULL OR {s} = '' OR regexp_full_match({s}, '[\\p{{Nd}}①-⑳]+') OR regexp_full_match({s}, '[・•\\-●○■□★☆※→←↑↓↔▲▼◆◇]+')"
        f" OR regexp_full_match({s}, '[\\p{{Nd}}①-⑩]+[.)）:：]?') OR regexp_full_match({s}, '[©®™]+') OR regexp_full_match({s}, '[A-Za-z]') OR regexp_full_match({s}, '[A-Z]{{1,4}}'))"
    )


def rule(c: str) -> str:
    s = strip(c)
    return (
        f"CASE WHEN regexp_full_match({s}, '\\(\\p{{Nd}}+\\)') THEN 'page_number' WHEN regexp_full_match({s}, '[.!?,;:]+') THEN 'punctuation'"
        f" WHEN regexp_full_match({s}, '[a-zA-Z0-9]') THEN 'single' WHEN regexp_full_match({s}, '[©®™]+') THEN 'mark' WHEN {s} = 'BANDAI' THEN 'maker' WHEN {s} = '' THEN 'blank' END"
    )


def slug(c: str) -> str:
    kept = f"regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}_\\t-\\r\\x1c-\\x20\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}-]', '', 'g')"
    return f"regexp_replace(regexp_replace({kept}, '(?:-|{SP})+', '-', 'g'), '^-+|-+$', '', 'g')"


INDEX = f"""
SELECT m.manual, coalesce(name, '') AS name, coalesce(source, '') AS source, coalesce(thumbnail, 'pages/page-0.webp') AS thumbnail,
       coalesce(source_url, '') <> '' AS has_url, coalesce(array_to_string(list_sort(list_filter(tags, lambda t: t IS NOT NULL)), ','), '') AS tags,
       coalesce(c.pages, 0)::BIGINT AS pages, coalesce(c.blocks, 0)::BIGINT AS blocks
FROM {META} m LEFT JOIN (SELECT manual, count(DISTINCT page_idx) AS pages, count(*) AS blocks FROM {LATEST} GROUP BY manual) c USING (manual)
"""
NUMBERED = f"(SELECT *, row_number() OVER (PARTITION BY manual ORDER BY page_idx, block_idx) - 1 AS n FROM {LATEST})"
REMOVALS = "(SELECT DISTINCT manual, page_idx, block_idx FROM edits WHERE op = 'delete')"
CORRECTIONS = "(SELECT manual, page_idx, block_idx, arg_max(translation, edit_id) AS new_translation FROM edits WHERE op = 'update_text' AND translation IS NOT NULL GROUP BY ALL)"
STANDING = """(SELECT * FROM (SELECT *, lead(op) OVER (PARTITION BY manual ORDER BY seq, edit_id) AS after FROM edits WHERE op IN ('update_text', 'update_bbox', 'undo'))
  WHERE op <> 'undo' AND after IS DISTINCT FROM 'undo' UNION ALL SELECT *, NULL FROM edits WHERE op IN ('add', 'delete'))"""
BLOG = "https://blog.example/posts"
HTML = f"""(SELECT meta_id, name, manual, '<html><head><title>' || coalesce(name, '') || ' | Depot</title>' ||
  CASE WHEN meta_id % 2 = 0 THEN '<meta property="og:description" content="A &quot;' || manual || '&quot; &amp; more"></head>' ELSE '</head>' END ||
  '<div class="product-description">The <b>' || manual || '</b>' || chr(10) || '  toy</div>' ||
  '<a href="{BLOG}/' || manual || '-one"> <a href="{BLOG}/' || manual || '-two"> <a href="{BLOG}/' || manual || '-one"> <a href="{BLOG}/"></html>' AS html FROM meta)"""


def ok_box(b: str) -> str:
    return f"coalesce(len({b}) = 4 AND len(list_filter({b}, lambda v: v IS NULL OR isnan(v))) = 0, false)"


def clamp(b: str) -> list[str]:
    x, y = (f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, {b}[{i}]))" for i in (1, 2))
    w, h = (f"greatest(0.01::DOUBLE, least(1.0::DOUBLE - {o}, {b}[{i}]))" for i, o in ((3, x), (4, y)))
    return [f"CASE WHEN {ok_box(b)} THEN {e} END" for e in (x, y, w, h)]


_CLAMPED = clamp("bbox")
_FIRST_ADD = f"""(SELECT manual, page_idx, block_idx, arg_min(edit_id, (seq, edit_id)) AS edit_id, min((seq, edit_id)) AS added FROM edits a
  WHERE op = 'add' AND block_idx IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {LATEST} l WHERE l.manual = a.manual AND l.page_idx = a.page_idx AND l.block_idx = a.block_idx) GROUP BY ALL)"""
FOLD = f"""
WITH s AS {STANDING}, t AS (SELECT manual, page_idx, block_idx, arg_max({strip('translation')}, (seq, edit_id)) AS new_text FROM s WHERE op = 'update_text' AND translation IS NOT NULL GROUP BY ALL),
b AS (SELECT manual, page_idx, block_idx, arg_max([{', '.join(_CLAMPED)}], (seq, edit_id)) AS new_box FROM s WHERE op = 'update_bbox' AND {ok_box('bbox')} GROUP BY ALL),
g AS (SELECT DISTINCT manual, page_idx, block_idx FROM s WHERE op = 'delete'),
w AS (SELECT s.*, f.edit_id AS own FROM s JOIN {_FIRST_ADD} f USING (manual, page_idx, block_idx) WHERE op <> 'add' AND (s.seq, s.edit_id) > f.added),
wt AS (SELECT own AS edit_id, arg_max({strip('translation')}, (seq, edit_id)) AS new_text FROM w WHERE op = 'update_text' AND translation IS NOT NULL GROUP BY own),
wb AS (SELECT own AS edit_id, arg_max([{', '.join(_CLAMPED)}], (seq, edit_id)) AS new_box FROM w WHERE op = 'update_bbox' AND {ok_box('bbox')} GROUP BY own),
n AS (SELECT a.manual, a.page_idx, coalesce(l.last, -1) + row_number() OVER (PARTITION BY a.manual, a.page_idx ORDER BY seq, a.edit_id) AS block_idx, 'New text block' AS text,
  coalesce(new_text, translation, '') AS translation, coalesce(new_box, CASE WHEN {ok_box('bbox')} THEN [{', '.join(_CLAMPED)}] ELSE [0.4, 0.45, 0.2, 0.1]::DOUBLE[] END) AS bbox
  FROM s a LEFT JOIN wt USING (edit_id) LEFT JOIN wb USING (edit_id) LEFT JOIN (SELECT manual, page_idx, max(block_idx) AS last FROM {LATEST} GROUP BY ALL) l ON l.manual = a.manual AND l.page_idx = a.page_idx
  WHERE op = 'add' AND a.edit_id NOT IN (SELECT own FROM w WHERE op = 'delete')),
f AS (SELECT l.manual, l.page_idx, l.block_idx, l.text, coalesce(new_text, translation) AS translation, coalesce(new_box, bbox) AS bbox FROM {LATEST} l
  LEFT JOIN t USING (manual, page_idx, block_idx) LEFT JOIN b USING (manual, page_idx, block_idx) ANTI JOIN g USING (manual, page_idx, block_idx) UNION ALL SELECT * FROM n)
SELECT manual, page_idx::BIGINT AS page_idx, row_number() OVER (PARTITION BY manual, page_idx ORDER BY block_idx) - 1 AS block_idx, text, translation, bbox[1] AS x, bbox[3] AS w FROM f
"""
_OUT = "list_concat([b], CASE WHEN regexp_replace(b, '-v\\p{Nd}+$', '') <> b THEN [regexp_replace(b, '-v\\p{Nd}+$', '')] ELSE [] END)"
_SET, _SETS = "regexp_replace(b, '-set$', '')", "replace(b, '-set', '')"
VARIANTS = f"""list_concat({_OUT}, CASE WHEN contains(b, 'memorial') THEN list_concat([{_SET}], CASE WHEN list_contains(list_concat({_OUT}, [{_SET}]), {_SETS}) THEN [] ELSE [{_SETS}] END) ELSE [] END,
  CASE WHEN contains(b, 'next') THEN [replace(b, 'next', 'NEXT'), replace(b, '-next', '')] ELSE [] END)"""
_TAG_CASES = ", ".join(
    f"CASE WHEN {test} THEN '{tag}' END"
    for tag, test in {
        "csm": "regexp_matches(t, '(?:^|[^\\p{L}\\p{N}_])csm(?:$|[^\\p{L}\\p{N}_])|complete selection modification')",
        "dx": "regexp_matches(t, '(?:^|[^\\p{L}\\p{N}_])dx(?:$|[^\\p{L}\\p{N}_])')",
        "memorial": "regexp_matches(t, '(?:^|[^\\p{L}\\p{N}_])memorial(?:$|[^\\p{L}\\p{N}_])')",
        "premium": "regexp_matches(t, '(?:^|[^\\p{L}\\p{N}_])premium(?:$|[^\\p{L}\\p{N}_])')",
        "kamen-rider": "regexp_matches(t, '仮面ライダー|rider|driver|dengasher|faiz|零ワン|zero.*one|zein|memory|progrise')",
        "sentai": "regexp_matches(t, '(?:^|[^\\p{L}\\p{N}_])sentai(?:$|[^\\p{L}\\p{N}_])|ranger.*key|abaranger|戦隊')",
        "ultraman": "regexp_matches(t, 'ultraman|ウルトラマン|ultra.*replica|beta.*capsule|shin.*ultra')",
    }.items()
)
_MARK = f"^((?:\\p{{Nd}}+[.)]|[①②③④⑤⑥⑦⑧⑨⑩]|\\(\\p{{Nd}}+\\)|[・•\\-●○■□★☆※]){SP}*)"

_LIST_MARK = "(?:\\p{Nd}+[.)]|[①②③④⑤⑥⑦⑧⑨⑩]|\\(\\p{Nd}+\\)|[・•●○■□★☆※])"
ITEMS = f"list_filter(list_transform(string_split(regexp_replace(translation, '(^|{SP})({_LIST_MARK})', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda x: {strip('x')}), lambda x: regexp_matches(x, '^{_LIST_MARK}'))"
PLACED = f"(SELECT *, row_number() OVER (PARTITION BY manual, page_idx ORDER BY block_idx) - 1 AS pos FROM {LATEST})"
PAGED = f"(SELECT manual, page_idx, count(*) AS b FROM {LATEST} GROUP BY ALL)"
COUNTED = f"(SELECT manual, count(*) AS pages, sum(b)::BIGINT AS blocks, min(page_idx) AS first FROM {PAGED} GROUP BY manual)"
KEYED = f"""SELECT l.row_id, row_number() OVER (PARTITION BY l.manual, l.page_idx ORDER BY l.block_idx) - 1 AS block_idx, coalesce(new_translation, l.translation) AS translation
    FROM {LATEST} l LEFT JOIN {CORRECTIONS} c USING (manual, page_idx, block_idx) ANTI JOIN {REMOVALS} g USING (manual, page_idx, block_idx)"""


def _listed(tags: dict[str, tuple[str, str]]) -> str:
    return "\n".join(f"- {tag}: {label}" for tag, (_, label) in tags.items())


ORACLES: dict[str, str] = {
    "corpus_index": INDEX,
    "corpus_stats": f"SELECT count(*) AS manuals, sum(pages)::BIGINT AS pages, sum(blocks)::BIGINT AS blocks FROM ({INDEX})",
    "latest_blocks": f"SELECT row_id, manual, page_idx, block_idx FROM {LATEST}",
    "line_blocks": "SELECT doc_id, unnest(generate_series(0, len(p) - 1)) AS block_idx, unnest(p) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents WHERE text IS NOT NULL)",
    "noise_filter": f"SELECT row_id, {strip('text')} AS text FROM translations WHERE NOT {noise('text')}",
    "rule_cleanup": f"SELECT row_id, translation FROM translations WHERE ({rule('translation')}) IS NULL",
    "rule_counts": f"SELECT rule, count(*) AS n FROM (SELECT {rule('translation')} AS rule FROM translations) WHERE rule IS NOT NULL GROUP BY rule",
    "cleanup_stats": f"SELECT count(*) AS before, count(*) FILTER (r IS NULL) AS after, count(*) FILTER (r IS NOT NULL) AS removed FROM (SELECT {rule('translation')} AS r FROM translations)",
    "sample_first_100": f"SELECT row_id, n FROM {NUMBERED} WHERE n < 100",
    "batch_ids": f"SELECT row_id, n // 100 AS batch, n % 100 AS pos FROM {NUMBERED}",
    "block_ids": f"SELECT row_id, 'b' || n AS block_id FROM {NUMBERED}",
    "page_assembly": f"""SELECT p.manual, p.page_idx::BIGINT AS page_idx, count(l.row_id) AS n_blocks, coalesce(string_agg(CASE WHEN l.row_id IS NOT NULL THEN coalesce(l.text, '') END, '|' ORDER BY l.block_idx), '') AS texts
        FROM (SELECT DISTINCT manual, page_num AS page_idx FROM ocr_pages WHERE page_num IS NOT NULL) p LEFT JOIN {LATEST} l USING (manual, page_idx) GROUP BY ALL""",
    "zip_by_position": f"""SELECT a.row_id, b.row_id AS answer_id FROM {NUMBERED} a JOIN
        (SELECT *, row_number() OVER (PARTITION BY manual ORDER BY page_idx, block_idx) - 1 AS k FROM {LATEST} WHERE translation IS NOT NULL) b ON a.manual = b.manual AND a.n = b.k""",
    "remove_keys": f"SELECT row_id FROM {LATEST} ANTI JOIN {REMOVALS} g USING (manual, page_idx, block_idx)",
    "apply_corrections": f"SELECT row_id, coalesce(new_translation, translation) AS translation FROM {LATEST} LEFT JOIN {CORRECTIONS} c USING (manual, page_idx, block_idx)",
    "rekey_after_delete": f"SELECT row_id, row_number() OVER (PARTITION BY manual, page_idx ORDER BY block_idx) - 1 AS block_idx FROM {LATEST} ANTI JOIN {REMOVALS} g USING (manual, page_idx, block_idx)",
    "correct_and_remove": f"""SELECT row_id, row_number() OVER (PARTITION BY manual, page_idx ORDER BY block_idx) - 1 AS block_idx, coalesce(new_translation, translation) AS translation
        FROM {LATEST} LEFT JOIN {CORRECTIONS} c USING (manual, page_idx, block_idx) ANTI JOIN {REMOVALS} g USING (manual, page_idx, block_idx)""",
    "edit_fold": FOLD,
    "edited_keys": f"SELECT manual, count(*) AS n_keys FROM (SELECT DISTINCT manual, page_idx, block_idx FROM {STANDING}) GROUP BY manual",
    "tag_rules": f"SELECT meta_id, coalesce(array_to_string(list_sort(list_filter([{_TAG_CASES}], lambda x: x IS NOT NULL)), ','), '') AS tags FROM (SELECT meta_id, lower(coalesce(name, '') || ' ' || coalesce(source, '')) AS t FROM meta)",
    "tag_dictionary": "SELECT meta_id, pos, tag_id, label, color FROM (SELECT meta_id, unnest(generate_series(0, len(tags) - 1)) AS pos, unnest(tags) AS tag_id FROM meta WHERE len(tags) > 0) JOIN tag_list USING (tag_id)",
    "facet_counts": f"""SELECT tag_id, coalesce(k, 0) AS n, coalesce(k, 0) || CASE WHEN coalesce(k, 0) = 1 THEN ' manual' ELSE ' manuals' END AS shown FROM tag_list
        LEFT JOIN (SELECT tag_id, count(*) AS k FROM (SELECT DISTINCT manual, unnest(tags) AS tag_id FROM {META}) GROUP BY tag_id) USING (tag_id)""",
    "tag_filter_all": "SELECT meta_id FROM meta WHERE list_contains(tags, 'jubilee') AND list_contains(tags, 'mecha')",
    "tag_toggle": "SELECT meta_id, NOT coalesce(list_contains(tags, 'jubilee'), false) AS \"on\" FROM meta",
    "search": f"SELECT manual FROM ({INDEX}) WHERE contains(lower(replace(name, '-', ' ')), 'driver') OR contains(lower(source), 'driver')",
    "legacy_search": f"SELECT manual FROM ({INDEX}) WHERE contains(lower(name), 'driver') OR contains(lower(source), 'driver')",
    "display_titles": "SELECT meta_id, coalesce(nullif(name, ''), nullif(source, '')) AS title, replace(manual, '-', ' ') AS shown, coalesce(source_url, '') <> '' AS has_url FROM meta",
    "slug": f"SELECT meta_id, {slug('name')} AS handle FROM meta",
    "slug_variants": f"""SELECT meta_id, array_to_string([b, regexp_replace(b, '-v\\p{{Nd}}+$', ''), regexp_replace(b, '-set$', ''), replace(b, '-set', ''), replace(b, 'next', 'NEXT'), replace(b, '-next', '')], ',') AS handles
        FROM (SELECT meta_id, {slug("name || ' Memorial Next Set Set-v2'")} AS b FROM meta)""",
    "first_match": f"""SELECT meta_id, arg_min(handle, (pos, product)) AS handle, arg_min(product, (pos, product)) AS product
        FROM (SELECT meta_id, unnest(v) AS handle, unnest(generate_series(1, len(v))) AS pos FROM (SELECT meta_id, {VARIANTS} AS v FROM (SELECT meta_id, {slug('name')} AS b FROM meta WHERE name IS NOT NULL)))
        JOIN (SELECT {slug('name')} AS handle, ref_id AS product FROM product_list) USING (handle) GROUP BY meta_id""",
    "title_extract": f"SELECT meta_id, {strip('coalesce(name, chr(32))')} AS title FROM {HTML}",
    "description_extract": f"SELECT meta_id, CASE WHEN meta_id % 2 = 0 THEN 'A \"' || manual || '\" & more' ELSE 'The ' || manual || ' toy' END AS description FROM {HTML}",
    "strip_tags": f"SELECT meta_id, {collapse("regexp_replace(html, '<.*?>', '', 'g')")} AS plain FROM {HTML}",
    "entities": "SELECT row_id, e AS escaped, replace(replace(e, '&quot;', '\"'), '&amp;', '&') AS decoded FROM (SELECT row_id, replace(replace(replace(translation, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS e FROM translations)",
    "links_distinct_3": f"""SELECT meta_id, '{BLOG}/' || manual || '-one {BLOG}/' || manual || '-two' AS links, t || ' One|' || t || ' Two' AS titles
        FROM (SELECT meta_id, manual, array_to_string(list_transform(string_split(manual, '-'), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS t FROM meta)""",
    "search_link": f"SELECT meta_id, 'Search: ' || {strip("regexp_replace(replace(name, 'Complete Selection Modification', 'CSM') || ' Clear Set', '(?i)" + SP + "+(Limited|Clear|Edition|Set|Memorial)\\b', '', 'g')")} AS title, 1::BIGINT AS n FROM meta WHERE name IS NOT NULL",
    "title_case": "SELECT meta_id, coalesce(list_aggregate(list_transform(generate_series(1, length(name)), lambda i: CASE WHEN i > 1 AND regexp_matches(name[i - 1], '\\p{L}') THEN lower(name[i]) ELSE upper(name[i]) END), 'string_agg', ''), '') AS title FROM meta WHERE name IS NOT NULL",
    "url_encode": "SELECT meta_id, 'https://translate.google.com/translate?sl=ja&tl=en&u=' || replace(url_encode(source_url || '?q=a b*~é+/'), '%2F', '/') AS address FROM meta WHERE source_url IS NOT NULL",
    "strip_and_collapse": f"SELECT row_id, {strip('text')} AS stripped, {collapse('translation')} AS collapsed FROM translations",
    "list_marks": f"SELECT row_id, regexp_extract(translation, '{_MARK}', 1) AS mark, substring(translation, length(regexp_extract(translation, '{_MARK}', 1)) + 1) AS rest FROM translations",
    "embedded_json": "SELECT event_id, (props::JSON ->> 'k')::BIGINT AS k FROM events",
    "model_answers": "SELECT edit_id, page_idx::BIGINT AS page_idx, block_idx::BIGINT AS block_idx, translation, true AS rejected FROM edits WHERE op = 'update_text' AND translation IS NOT NULL",
    "bbox_valid": f"SELECT row_id, {ok_box('bbox')} AS ok FROM translations",
    "bbox_clamp": f"SELECT row_id, {', '.join(f'{e} AS {n}' for e, n in zip(_CLAMPED, 'xywh'))} FROM translations",
    "bbox_pixels": f"""SELECT row_id, x, y, w, h, greatest(10, least(14, trunc(h * 0.5)::BIGINT)) AS size FROM (SELECT row_id, trunc(bbox[1] * 1000)::BIGINT AS x, trunc(bbox[2] * 1400)::BIGINT AS y,
        trunc(bbox[3] * 1000)::BIGINT AS w, trunc(bbox[4] * 1400)::BIGINT AS h FROM translations WHERE {ok_box('bbox')}) WHERE w >= 10 AND h >= 10""",
    "bbox_round": "SELECT row_id, round(bbox[1], 4) AS x, round(bbox[2], 4) AS y, round(bbox[3], 4) AS w, round(bbox[4], 4) AS h FROM translations",
    "render_zoom": "SELECT page_id, CASE WHEN greatest(n_blocks * 300.0::DOUBLE, 595.0::DOUBLE) * (200 / 72.0::DOUBLE) > 9500 THEN 7000.0::DOUBLE / greatest(n_blocks * 300.0::DOUBLE, 595.0::DOUBLE) ELSE 200 / 72.0::DOUBLE END AS zoom FROM ocr_pages",
    "interval_hit": f"""SELECT row_id, min(p.page_no)::BIGINT AS page_no FROM (SELECT row_id, manual, page_idx + bbox[2] + bbox[4] / 2 AS c FROM {LATEST} WHERE {ok_box('bbox')}) b
        JOIN (SELECT DISTINCT manual, page_idx AS page_no FROM {LATEST}) p ON b.manual = p.manual AND b.c >= p.page_no AND b.c <= p.page_no + 1 GROUP BY row_id""",
    "page_navigation": """SELECT manual, page_idx::BIGINT AS page_idx, greatest(0, page_idx - 1)::BIGINT AS previous, least(max(page_idx) OVER (PARTITION BY manual), page_idx + 1)::BIGINT AS next, page_idx >= 2 AS late
        FROM (SELECT DISTINCT manual, page_idx FROM translations)""",
    "ocr_quarantine": "SELECT page_id, coalesce(success, false) AS good, CASE WHEN NOT coalesce(success, false) THEN left(error, 100) END AS error FROM ocr_pages",
    "status_changes": """SELECT page_id, status FROM (SELECT page_id, status, lag(status) OVER (PARTITION BY manual ORDER BY page_num NULLS FIRST, page_id) AS b
        FROM (SELECT *, CASE WHEN success THEN 'ok' WHEN NOT success THEN coalesce(error, 'failed') END AS status FROM ocr_pages) WHERE status <> '') WHERE b IS DISTINCT FROM status""",
    "latest_state": "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id",
    "debounce": """SELECT user_id, max(ts) + INTERVAL 2 HOUR AS fired, arg_max(event_id, (ts, event_id)) AS event_id, count(*) AS n FROM
        (SELECT *, sum(g) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM
          (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 2 HOUR THEN 0 ELSE 1 END AS g FROM events)) GROUP BY user_id, s""",
    "throttle": """WITH RECURSIVE o AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
        r AS (SELECT user_id, event_id, ts AS last, k, true AS ok FROM o WHERE k = 1 UNION ALL
          SELECT o.user_id, o.event_id, CASE WHEN o.ts - r.last >= INTERVAL 2 HOUR THEN o.ts ELSE r.last END, o.k, o.ts - r.last >= INTERVAL 2 HOUR FROM r JOIN o ON o.user_id = r.user_id AND o.k = r.k + 1)
        SELECT user_id, event_id FROM r WHERE ok""",
    "job_names": f"SELECT meta_id, 'translate-' || replace({strip("regexp_replace(source, '[.]pdf$', '')")}, ' ', '-') || '-' || strftime(loaded_at, '%Y%m%d-%H%M%S') AS job FROM meta WHERE source IS NOT NULL AND loaded_at IS NOT NULL",
    "job_progress": """SELECT manual, count(*) FILTER (coalesce(success, false)) AS done, count(*) AS total, count(*) FILTER (coalesce(success, false)) / count(*)::DOUBLE AS steps,
        count(*) FILTER (coalesce(success, false)) > 0 AS success FROM ocr_pages GROUP BY manual""",
    "heartbeats": "SELECT page_id, page_num FROM ocr_pages WHERE page_num % 5 = 0",
    "block_explode": f"""SELECT p.manual, l.pos::BIGINT AS block_idx, 'manuals/' || p.manual || '/pages/page-' || p.page_idx || '.webp' AS image, l.text, l.translation
        FROM (SELECT DISTINCT manual, page_num AS page_idx FROM ocr_pages WHERE page_num IS NOT NULL) p LEFT JOIN {PLACED} l USING (manual, page_idx)""",
    "list_split": f"SELECT row_id, CASE WHEN len(i) >= 2 THEN len(i) ELSE 1 END AS n, CASE WHEN len(i) >= 2 THEN i[1] ELSE translation END AS first FROM (SELECT row_id, translation, {ITEMS} AS i FROM translations WHERE translation IS NOT NULL)",
    "model_cleanup": KEYED,
    "rejected_keys": "SELECT manual, 'x-' || block_idx AS key, 'remove' AS kind FROM edits WHERE op = 'delete'",
    "accepted_tags": """SELECT meta_id, CASE WHEN meta_id % 3 < 2 THEN array_to_string(list_sort(list_filter(coalesce(tags, []), lambda t: t IN ('jubilee', 'mecha'))), ',') ELSE '' END AS known,
        CASE WHEN meta_id % 3 < 2 THEN coalesce(array_to_string(list_filter(list_sort(coalesce(tags, [])), lambda t: t IS NOT NULL), ','), '') ELSE '' END AS every,
        array_to_string(list_filter(tags, lambda t: t IS NOT NULL), ',') AS unsorted FROM meta""",
    "anchored_text": "SELECT row_id, substring(text, 1, 2) || substring(text, 5, 5) AS piece FROM translations",
    "polygon_boxes": f"""SELECT row_id, CASE WHEN row_id % 5 > 0 THEN x END AS x, CASE WHEN row_id % 5 > 0 THEN y END AS y, CASE WHEN row_id % 5 > 0 THEN (x + w) - x END AS w, CASE WHEN row_id % 5 > 0 THEN (y + h) - y END AS h
        FROM (SELECT row_id, bbox[1] AS x, bbox[2] AS y, bbox[3] AS w, bbox[4] AS h FROM translations WHERE {ok_box('bbox')})""",
    "bbox_shown": f"""SELECT row_id, array_to_string(list_transform(bbox, lambda v: printf('%.2f', floor(v * 100 + 0.5) / 100)), ' ') AS shown, bbox[1] * 100 AS x, bbox[2] * 100 AS y, bbox[3] * 100 AS w, bbox[4] * 100 AS h
        FROM translations WHERE {ok_box('bbox')}""",
    "manual_links": """SELECT meta_id, CASE WHEN meta_id % 3 = 0 THEN 1 WHEN meta_id % 3 = 1 THEN 0 WHEN coalesce(blog_url, '') <> '' THEN 1 ELSE 0 END::BIGINT AS n,
        CASE WHEN meta_id % 3 = 0 THEN source_url WHEN meta_id % 3 = 2 THEN nullif(blog_url, '') END AS url, CASE WHEN meta_id % 3 = 1 THEN '' ELSE coalesce(blog_url, '') END AS first FROM meta""",
    "link_lines": "SELECT meta_id, concat_ws(' ', nullif(source_url, ''), nullif(blog_url, ''), nullif(thumbnail, '')) AS line FROM meta",
    "image_paths": "SELECT page_id, 'manuals/' || manual || '/pages/page-' || page_num || '.webp' AS path FROM ocr_pages",
    "shown_texts": "SELECT row_id, text AS original, translation AS shown FROM translations",
    "url_set": "SELECT meta_id, CASE WHEN manual = 'grand-compendium' THEN 'https://shop.example/1' ELSE source_url END AS source_url FROM meta",
    "shifted_keys": """SELECT manual, page_idx::BIGINT AS page_idx, (block_idx - CASE WHEN page_idx = 1 AND block_idx > 2 THEN 1 ELSE 0 END)::BIGINT AS block_idx
        FROM (SELECT DISTINCT manual, page_idx, block_idx FROM edits WHERE op <> 'add') WHERE NOT (page_idx = 1 AND block_idx = 2)""",
    "block_at": f"SELECT row_id FROM {LATEST} SEMI JOIN edits USING (manual, page_idx, block_idx)",
    "union_of_pages": f"SELECT row_id, row_number() OVER (PARTITION BY manual ORDER BY page_idx, block_idx) - 1 AS n, pos FROM {PLACED}",
    "known_addresses": "SELECT meta_id FROM meta WHERE source_url IN (SELECT source_url FROM meta WHERE blog_url IS NOT NULL AND source_url IS NOT NULL)",
    "recorded_answers": """SELECT manual, page_idx::BIGINT AS page_idx, page_id, n_blocks FROM (SELECT DISTINCT manual, page_idx FROM translations) LEFT JOIN
        (SELECT manual, page_num AS page_idx, page_id, n_blocks FROM ocr_pages WHERE page_num IS NOT NULL QUALIFY row_number() OVER (PARTITION BY manual, page_num ORDER BY ocr_at DESC NULLS LAST, page_id DESC) = 1) USING (manual, page_idx)""",
    "provider_answers": "SELECT row_id, upper(regexp_replace(translation, '[^ -~]', '', 'g')) AS answer FROM translations WHERE translation IS NOT NULL",
    "page_requests": "SELECT meta_id::VARCHAR AS doc, unnest(generate_series(0, pages - 1)) AS page_num FROM meta WHERE pages > 0",
    "image_forms": "SELECT page_id, CASE WHEN n_blocks * 700000 > 10000000 THEN 'image/jpeg' ELSE 'image/png' END AS mime, CASE WHEN n_blocks * 700000 > 10000000 THEN 95 END::BIGINT AS quality FROM ocr_pages",
    "address_kinds": "SELECT meta_id, coalesce(starts_with(source_url, 'http://') OR starts_with(source_url, 'https://'), false) AS remote, coalesce(starts_with(source, 'http://') OR starts_with(source, 'https://'), false) AS local FROM meta",
    "folder_names": "SELECT meta_id, manual || ' 取扱+1' AS folder, 'https://edit.example/x/' || manual || '/translations.json' AS editor FROM meta WHERE manual IS NOT NULL",
    "manual_documents": f"SELECT manual, dense_rank() OVER (PARTITION BY manual ORDER BY page_idx) - 1 AS page_idx, pos AS block_idx, text, translation, bbox[1] AS x, len(bbox) AS n FROM {PLACED} l SEMI JOIN {META} m USING (manual)",
    "manual_headers": f"SELECT manual, name AS manual_name, source, blog_url, coalesce(c.pages, 0) AS pages, coalesce(c.blocks, 0) AS blocks, len(tags) AS n_tags, false AS broken FROM {META} m LEFT JOIN {COUNTED} c USING (manual)",
    "catalog_document": f"""SELECT manual AS name, coalesce(source, manual) AS source, coalesce(c.pages, 0) AS pages, coalesce(c.blocks, 0) AS blocks,
        manual || '/' || CASE WHEN c.first IS NULL THEN 'pages/page-0.webp' ELSE 'manuals/' || manual || '/pages/page-' || c.first || '.webp' END AS thumbnail,
        coalesce(source_url, '') AS source_url, coalesce(blog_url, '') AS blog_url, array_to_string(list_filter(tags, lambda t: t IS NOT NULL), ',') AS tags FROM {META} m LEFT JOIN {COUNTED} c USING (manual)""",
    "prompts": f"""SELECT manual, '{TASK.replace("'", "''")}' || chr(10) || 'Product: ' || coalesce(nullif(name, ''), 'Unknown') || chr(10) || 'Address: ' || coalesce(source_url, '') || chr(10) || 'Tags:' || chr(10) || '{_listed(TAGS)}' || chr(10)
        || 'Blocks:' || chr(10) || b AS prompt FROM (SELECT manual, '[' || string_agg(to_json({{'index': page_idx || '-' || block_idx, 'original': text, 'translation': translation}})::VARCHAR, ',' ORDER BY n) || ']' AS b FROM {NUMBERED} WHERE n < 100 GROUP BY manual) LEFT JOIN {META} m USING (manual)""",
}
