"""DuckDB SQL of the registered queries, put together from named parts."""

from __future__ import annotations

import re

from kbq.operators import collectors as C
from kbq.plans.fixture import KB_SQL

_WS = r"[ \t\n\r\f\v]"
_STRIP = lambda c: rf"regexp_replace({c}, '^{_WS}+|{_WS}+$', '', 'g')"
_list = lambda words: ", ".join(f"'{w}'" for w in words)
_q = lambda p: p.replace("'", "''")

#: name -> SELECT over earlier parts.
PARTS: dict[str, str] = {
    "kb": KB_SQL.format(documents="documents"),
    "art": r"""SELECT doc_id, lang, source, uri, CASE WHEN text LIKE '---%' THEN regexp_extract(text, '(?s)^---\s*\n(.*?)\n---\s*\n', 1) ELSE '' END AS fm,
  regexp_replace(text, '(?s)^---\s*\n(.*?)\n---\s*\n', '') AS body FROM kb""",
    "line": "SELECT uri, i AS line, ls[i] AS s, len(ls) AS n_lines FROM (SELECT uri, string_split(body, chr(10)) AS ls FROM art), unnest(range(1, len(ls) + 1)) AS t(i)",
    "head": rf"""SELECT uri, row_number() OVER (PARTITION BY uri ORDER BY line) - 1 AS pos, length(regexp_extract(s, '^(#{{1,6}})\s+(.+)$', 1)) AS level, {_STRIP(r"regexp_extract(s, '^(#{1,6})\s+(.+)$', 2)")} AS text, line
  FROM line WHERE regexp_matches(s, '^(#{{1,6}})\s+(.+)$')""",
    "sec_of": "SELECT l.uri, l.line, l.s, l.n_lines, coalesce(sum((h.line IS NOT NULL)::INT) OVER (PARTITION BY l.uri ORDER BY l.line), 0) AS sec, h.line IS NOT NULL AS is_head FROM line l LEFT JOIN head h ON l.uri = h.uri AND l.line = h.line",
    "sec_text": f"""SELECT uri, sec, {_STRIP("coalesce(string_agg(s, chr(10) ORDER BY line) FILTER (NOT is_head), '')")} AS text, min(line) AS first_line, max(line) AS last_line FROM sec_of GROUP BY uri, sec""",
    "sec": """SELECT s.uri, row_number() OVER (PARTITION BY s.uri ORDER BY s.sec) - 1 AS pos, h.text AS heading, h.level, s.text, coalesce(h.line, 1) AS line_start, s.last_line AS line_end
  FROM sec_text s LEFT JOIN head h ON s.uri = h.uri AND s.sec = h.pos + 1 WHERE s.sec > 0 OR s.text <> '' OR NOT EXISTS (SELECT 1 FROM head x WHERE x.uri = s.uri)""",
    "txt": "SELECT uri, string_agg(text, chr(10) || chr(10) ORDER BY pos) AS all_text FROM sec GROUP BY uri",
    "para": f"""SELECT uri, row_number() OVER (PARTITION BY uri ORDER BY pos, i) - 1 AS pos, p AS text, heading AS section_heading, line_start AS line FROM (
  SELECT uri, pos, coalesce(heading, '') AS heading, line_start, i, {_STRIP("ps[i]")} AS p FROM (SELECT *, string_split(text, chr(10) || chr(10)) AS ps FROM sec), unnest(range(1, len(ps) + 1)) AS t(i))
  WHERE p <> '' AND p NOT LIKE '```%' AND p NOT LIKE '|%'""",
    "link": rf"""SELECT uri, row_number() OVER (PARTITION BY uri ORDER BY line, i) - 1 AS pos, ts[i] AS text, {_STRIP("gs[i]")} AS target, line, NOT regexp_matches({_STRIP("gs[i]")}, '^https?://') AS is_internal FROM (
  SELECT uri, line, regexp_extract_all(s, '\[([^\]]*)\]\(([^)]+)\)', 1) AS ts, regexp_extract_all(s, '\[([^\]]*)\]\(([^)]+)\)', 2) AS gs FROM line), unnest(range(1, len(ts) + 1)) AS t(i)""",
    "code": r"""SELECT uri, i - 1 AS pos, CASE la[i] WHEN '' THEN 'text' ELSE la[i] END AS language, te[i] AS text,
  1 + list_sum(list_transform(ga[1:i], lambda x: length(x) - length(replace(x, chr(10), '')))) + coalesce(list_sum(list_transform(wh[1:i-1], lambda x: length(x) - length(replace(x, chr(10), '')))), 0) AS line
  FROM (SELECT uri, regexp_extract_all(body, '(?s)```(\w*)\n(.*?)```', 0) AS wh, regexp_extract_all(body, '(?s)```(\w*)\n(.*?)```', 1) AS la, regexp_extract_all(body, '(?s)```(\w*)\n(.*?)```', 2) AS te, string_split_regex(body, '(?s)```(\w*)\n(.*?)```') AS ga FROM art), unnest(range(1, len(wh) + 1)) AS t(i)""",
    "meta": rf"""SELECT uri, k AS key, last(v ORDER BY i) AS value FROM (SELECT uri, i, {_STRIP("regexp_extract(ls[i], '^([^:]*):', 1)")} AS k, {_STRIP("regexp_extract(ls[i], '^[^:]*:(.*)$', 1)")} AS v FROM (SELECT uri, string_split(fm, chr(10)) AS ls FROM art), unnest(range(1, len(ls) + 1)) AS t(i) WHERE contains(ls[i], ':')) GROUP BY uri, k""",
    "title": r"SELECT a.uri, coalesce(m.value, h.text, regexp_replace(regexp_replace(a.uri, '^.*/', ''), '(.)\.[^.]*$', '\1')) AS title FROM art a LEFT JOIN meta m ON a.uri = m.uri AND m.key = 'title' LEFT JOIN head h ON a.uri = h.uri AND h.pos = 0",
    # every target here is a file name, alone or behind one step up
    "res": r"""SELECT l.uri, l.pos, l.text, l.target, l.clean, l.line, k.uri AS resolved FROM (
  SELECT *, CASE WHEN clean LIKE '../%' THEN regexp_replace(regexp_extract(uri, '^(.+/)', 1), '[^/]+/$', '') || substring(clean, 4) ELSE regexp_extract(uri, '^(.+/)', 1) || clean END AS path FROM (SELECT *, regexp_replace(target, '[#?].*$', '') AS clean FROM link WHERE is_internal)) l LEFT JOIN art k ON k.uri = l.path""",
    "edge": "SELECT DISTINCT uri AS source_uri, resolved AS target_uri, 'cross_reference' AS relation_type FROM res WHERE resolved IS NOT NULL",
    "deg": "SELECT a.uri, count(t.uri) AS inbound FROM art a LEFT JOIN (SELECT target_uri AS uri FROM edge UNION ALL SELECT target FROM link WHERE is_internal) t ON a.uri = t.uri GROUP BY a.uri",
    "kw": rf"""SELECT DISTINCT uri, cluster, k FROM (SELECT uri, cluster, unnest(regexp_extract_all(lower(text), '[a-z]{{2,}}')) AS k FROM (
  SELECT *, sum((level = top)::INT) OVER (PARTITION BY uri ORDER BY pos) AS cluster FROM (SELECT *, min(level) OVER (PARTITION BY uri) AS top, count(*) OVER (PARTITION BY uri) AS n FROM head) WHERE n > 1) WHERE cluster > 0) WHERE k NOT IN ({_list(C.STOPWORDS)})""",
    "clu": """SELECT uri, cluster, 1 + count(k) AS n FROM (SELECT DISTINCT uri, cluster FROM (SELECT *, sum((level = top)::INT) OVER (PARTITION BY uri ORDER BY pos) AS cluster FROM (SELECT *, min(level) OVER (PARTITION BY uri) AS top, count(*) OVER (PARTITION BY uri) AS n FROM head) WHERE n > 1) WHERE cluster > 0) LEFT JOIN kw USING (uri, cluster) GROUP BY uri, cluster""",
    "c_purity": """SELECT uri, count(*) AS cluster_count, round(max(p), 3) AS largest_cluster_ratio, round(-sum(p * log2(p)), 3) AS topic_entropy FROM (SELECT uri, n / sum(n) OVER (PARTITION BY uri) AS p FROM clu) GROUP BY uri HAVING count(*) > 1 AND max(p) < 0.7""",
    "c_dangling": "SELECT uri, sum(n)::BIGINT AS dangling_reference_count FROM (SELECT uri, " + " + ".join([f"len(regexp_extract_all(lower(text), '{p}'))" for p in C.DANGLING] + [f"len(regexp_extract_all(text, '{p}'))" for p in C.UNDEFINED]) + " AS n FROM para) GROUP BY uri HAVING sum(n) > 0",
    "c_heading": rf"""SELECT uri, line, level, text AS heading, issue AS signal_type FROM (SELECT *, CASE WHEN lower(text) IN ({_list(C.PLACEHOLDER)}) THEN 'placeholder' WHEN regexp_matches(lower(text), '^(step\s+)?\d+$') THEN 'numbered_only' WHEN lower(text) IN ({_list(C.GENERIC)}) THEN 'generic'
  WHEN len(string_split_regex(text, '\s+')) = 1 AND lower(text) NOT IN ({_list(C.GOOD_WORDS)}) AND length(text) < 4 THEN 'too_short' END AS issue FROM head) WHERE issue IS NOT NULL""",
    "term": "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{t}', '{''.join(c for c in t.lower() if c not in ' -_/')}', '{'(?i)' if t.islower() else ''}\\b{re.escape(t).replace(chr(92) + ' ', ' ')}\\b')" for i, t in enumerate(C.TERMS)) + ") AS v(place, variant, term_group, pattern)",
    "used": "SELECT uri, term_group, variant, place FROM txt, term WHERE regexp_matches(all_text, pattern)",
    "ranked": "SELECT *, row_number() OVER (PARTITION BY term_group ORDER BY n DESC, first_uri, place) AS r, count(*) OVER (PARTITION BY term_group) AS variants FROM (SELECT term_group, variant, place, count(*) AS n, min(uri) AS first_uri FROM used GROUP BY ALL)",
    "c_term": """SELECT u.uri, u.term_group, first(u.variant ORDER BY r.first_uri, r.place) AS minority_variant, any_value(m.variant) AS majority_variant, first(r.n ORDER BY r.first_uri, r.place) AS minority_count, any_value(m.n) AS majority_count
  FROM used u JOIN ranked r ON u.term_group = r.term_group AND u.variant = r.variant AND r.r > 1 JOIN ranked m ON m.term_group = u.term_group AND m.r = 1 GROUP BY u.uri, u.term_group""",
    "vclaim": f"SELECT uri, lower(unnest(regexp_extract_all(all_text, '{C.VERSION}', 1))) AS subject, unnest(regexp_extract_all(all_text, '{C.VERSION}', 2)) AS version FROM txt",
    "c_version": r"""SELECT c.uri, c.subject, max(c.version) AS version, max(m.lowest) AS lowest FROM vclaim c JOIN (SELECT subject, first(version ORDER BY list_transform(string_split(version, '.'), lambda x: x::INT), version) AS lowest FROM vclaim GROUP BY subject) m USING (subject) WHERE c.version <> m.lowest GROUP BY c.uri, c.subject""",
}
for _name, _pattern, _reach in (("dctx", C.DEPRECATION, 50), ("rctx", C.RECOMMENDATION, 30)):
    PARTS[_name] = rf"""SELECT DISTINCT uri, i, w FROM (SELECT uri, i, unnest(regexp_extract_all(lower(substring(all_text, greatest(st - {_reach}, 0)::BIGINT + 1, (st + length(m[i]) + {_reach} - greatest(st - {_reach}, 0))::BIGINT)), '[0-9A-Za-z_]+')) AS w FROM (
  SELECT uri, all_text, m, i, list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS st FROM (SELECT uri, all_text, regexp_extract_all(all_text, '{_pattern}') AS m, string_split_regex(all_text, '{_pattern}') AS g FROM txt), unnest(range(1, len(m) + 1)) AS t(i))) WHERE w NOT IN ({_list(C.SMALL_WORDS)})"""
PARTS |= {
    "c_depr": "SELECT DISTINCT uri FROM (SELECT d.uri FROM dctx d JOIN rctx r ON d.w = r.w AND d.uri <> r.uri GROUP BY d.uri, d.i, r.uri, r.i HAVING count(*) >= 2)",
    "fclaim": f"SELECT uri, lower({_STRIP('f')}) AS feature, lower(v) IN ('enabled', 'on', 'true') AS value FROM (SELECT uri, unnest(regexp_extract_all(all_text, '{C.FEATURE}', 1)) AS f, unnest(regexp_extract_all(all_text, '{C.FEATURE}', 2)) AS v FROM txt)",
    "c_bool": "SELECT DISTINCT uri, feature FROM fclaim WHERE feature IN (SELECT feature FROM fclaim GROUP BY feature HAVING count(DISTINCT value) > 1)",
    "canon": "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{d}')" for k, d in C.CANONICAL.items()) + ") AS v(keyword, domain)",
    "c_canon": "SELECT t.uri, keyword, domain FROM txt t JOIN canon ON contains(lower(t.all_text), keyword) WHERE NOT EXISTS (SELECT 1 FROM link l WHERE l.uri = t.uri AND NOT l.is_internal AND contains(l.target, domain))",
    "sig": f"SELECT uri, lower({_STRIP(r"regexp_replace(substring(all_text, 1, 200), '\s+', ' ', 'g')")}) AS signature FROM txt",
    "c_dup": "SELECT uri, n AS copies FROM (SELECT uri, count(*) OVER (PARTITION BY signature) AS n FROM sig WHERE length(signature) > 50) WHERE n > 1",
    "dated": rf"""SELECT a.uri, coalesce({", ".join(f"(SELECT coalesce({', '.join(f'try_strptime(m.value, {chr(39)}{f}{chr(39)})' for f in ('%Y-%m-%d', '%Y/%m/%d', '%Y-%m-%dT%H:%M:%S', '%Y-%m-%dT%H:%M:%SZ'))})::DATE FROM meta m WHERE m.uri = a.uri AND m.key = '{k}')" for k in C.DATE_KEYS)},
  try_strptime(regexp_extract(substring(t.all_text, 1, 2000), '{C.ISO_DATE}', 1) || '-' || regexp_extract(substring(t.all_text, 1, 2000), '{C.ISO_DATE}', 2) || '-' || regexp_extract(substring(t.all_text, 1, 2000), '{C.ISO_DATE}', 3), '%Y-%m-%d')::DATE) AS d FROM art a JOIN txt t ON a.uri = t.uri""",
    "c_fresh": "SELECT uri, CASE WHEN d IS NULL THEN 'no_date_signal' ELSE 'stale_content' END AS signal_type, date_diff('day', d, DATE '2024-06-30')::INT AS age_days FROM dated WHERE d IS NULL OR date_diff('day', d, DATE '2024-06-30') > 365",
    "c_broken": "SELECT uri, string_agg(target, ' ' ORDER BY pos) AS targets, count(*) AS broken_link_count FROM res WHERE resolved IS NULL GROUP BY uri",
    "c_orphan": "SELECT uri FROM art WHERE uri NOT IN (SELECT resolved FROM res WHERE resolved IS NOT NULL) AND (SELECT count(*) FROM art) > 1",
    "c_flow": rf"""SELECT uri, missing FROM (SELECT t.uri, array_to_string(list_filter([CASE WHEN NOT regexp_matches(lower(all_text), '{C.PREREQUISITES}') THEN 'prerequisites' END, CASE WHEN len(regexp_extract_all(all_text, '{C.STEPS}')) < 2 THEN 'numbered_steps' END,
  CASE WHEN NOT regexp_matches(lower(all_text), '{C.VERIFICATION}') THEN 'verification_step' END, CASE WHEN t.uri NOT IN (SELECT uri FROM code) THEN 'code_examples' END], lambda x: x IS NOT NULL), ',') AS missing
  FROM txt t JOIN title USING (uri) WHERE regexp_matches(lower(all_text), '{"|".join(C.WORKFLOW)}') OR regexp_matches(lower(title), '{"|".join(C.WORKFLOW)}')) WHERE missing <> ''""",
    "every": """SELECT uri, 'topic_purity' AS collector_id, 'mixed_topics' AS signal_type, NULL::INT AS line, '' AS mark FROM c_purity
  UNION ALL SELECT uri, 'context_independence', 'dangling_reference', NULL, '' FROM c_dangling UNION ALL SELECT uri, 'heading_quality', signal_type, line, '' FROM c_heading
  UNION ALL SELECT uri, 'terminology_consistency', 'terminology_variant', NULL, '' FROM c_term UNION ALL SELECT uri, 'contradiction_detection', 'version_conflict', NULL, '' FROM c_version
  UNION ALL SELECT uri, 'contradiction_detection', 'deprecation_vs_recommendation', NULL, '' FROM c_depr UNION ALL SELECT uri, 'contradiction_detection', 'boolean_default_conflict', NULL, '' FROM c_bool
  UNION ALL SELECT uri, 'canonical_source', 'missing_canonical_source', NULL, 'canonical_domain=' || domain || '|topic_keyword=' || keyword FROM c_canon UNION ALL SELECT uri, 'canonical_source', 'duplicate_content', NULL, '' FROM c_dup
  UNION ALL SELECT uri, 'freshness', signal_type, NULL, '' FROM c_fresh UNION ALL SELECT uri, 'knowledge_connectivity', 'orphan_artifact', NULL, '' FROM deg WHERE inbound = 0
  UNION ALL SELECT uri, 'link_integrity', 'broken_link', NULL, '' FROM c_broken UNION ALL SELECT uri, 'link_integrity', 'orphan', NULL, '' FROM c_orphan UNION ALL SELECT uri, 'workflow_completeness', 'incomplete_workflow', NULL, '' FROM c_flow""",
    "signal": "SELECT *, row_number() OVER (PARTITION BY signal_id ORDER BY line NULLS FIRST) AS occurrence FROM (SELECT *, substring(sha256(collector_id || ':' || uri || ':' || signal_type || CASE mark WHEN '' THEN '' ELSE ':' || mark END), 1, 16) AS signal_id FROM every)",
}


def sql(select: str, instead: dict[str, str] | None = None) -> str:
    """select with a WITH clause of the parts it names, directly or through others. instead: parts to put in place of those of the same name."""
    parts = PARTS | (instead or {})
    needed: set[str] = set()
    todo = [select]
    while todo:
        text = todo.pop()
        for name in parts:
            if name not in needed and re.search(rf"\b(FROM|JOIN|,)\s+{name}\b|\({name}\b", text):
                needed.add(name)
                todo.append(parts[name])
    if not needed:
        return select
    listed = ",\n".join(f"{name} AS MATERIALIZED ({text})" for name, text in parts.items() if name in needed)
    return f"WITH {listed}\n{select}"
