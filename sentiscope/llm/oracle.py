"""DuckDB SQL for the queries that SQL can express, over the same tables."""

from __future__ import annotations

from . import url_filter
from .merkle import ARITY, LEAF_COLUMNS
from .quality_rules import RULES, STOP_WORDS, SYMBOLS, WINDOW


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


WS = r"[\x20\x09-\x0D]+"


def _rule(r) -> str:
    parts = ([f"100 * {r.measure} < {r.low} * {r.base}"] if r.low is not None else []) + (
        [f"100 * {r.measure} > {r.high} * {r.base}"] if r.high is not None else [])
    return f"(({' OR '.join(parts)}) AND n_words >= {r.min_words})"


_CHAR_CLASS = "[" + "".join("\\" + c for c in SYMBOLS) + "]"
_STOPS = ", ".join(q(w) for w in STOP_WORDS + [w.capitalize() for w in STOP_WORDS])

QUALITY = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '{WS}'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_replace(x, '{WS}', '', 'g') <> '') AS ls FROM d),
pos AS (SELECT doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS p FROM w WHERE len(ws) >= {WINDOW}),
win AS (SELECT doc_id, p, array_to_string(ws[p:p + {WINDOW - 1}], ' ') AS s FROM pos),
twice AS (SELECT doc_id, s FROM win GROUP BY ALL HAVING count(*) >= 2),
hit AS (SELECT DISTINCT doc_id, p + k AS at FROM win JOIN twice USING (doc_id, s), range({WINDOW}) r(k)),
rep AS (SELECT doc_id, count(*) AS n FROM hit GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words,
             coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
             (length(t) - length(regexp_replace(t, '{_CHAR_CLASS}', '', 'g')))::BIGINT AS n_symbols,
             (length(t) - length(replace(t, '!', '')))::BIGINT AS n_exclaim,
             len(list_filter(ws, lambda x: x IN ({_STOPS})))::BIGINT AS n_stop_words,
             len(ls)::BIGINT AS n_lines,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
             len(list_filter(ls, lambda x: regexp_matches(ltrim(x, ' '), '^[-*•]')))::BIGINT AS n_bullet_lines,
             len(list_filter(ls, lambda x: regexp_matches(rtrim(x, ' '), '(\.\.\.|…)$')))::BIGINT AS n_ellipsis_lines,
             coalesce(rep.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN rep USING (doc_id)),
v AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
             concat_ws(',', {", ".join(f"CASE WHEN {_rule(r)} THEN {q(r.name)} END" for r in RULES)}) AS failed_rules
      FROM m)
SELECT *, NOT base_failed AND failed_rules = '' AS kept FROM v
"""

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

DECONTAMINATION = rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id,
                  list_filter(regexp_split_to_array({_LOWERED}, '{NOT_WORD}'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array({_LOWERED}, '{NOT_WORD}'), lambda x: x <> '') AS w
      FROM benchmark),
bl AS (SELECT item_id, w, least(len(w), 10) AS n FROM b WHERE len(w) > 0),
bp AS (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM bl),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS s FROM bp),
lens AS (SELECT DISTINCT n FROM bw),
dp AS (SELECT k, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, lens WHERE len(w) >= n),
dw AS (SELECT k, p, n, array_to_string(w[p:p + n - 1], ' ') AS s FROM dp),
hit AS (SELECT k, p, n, item_id FROM dw JOIN bw USING (n, s)),
cov AS (SELECT k, count(DISTINCT p + o) AS n_hit FROM hit, range(10) r(o) WHERE o < n GROUP BY k),
it AS (SELECT k, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
       FROM (SELECT DISTINCT k, item_id::VARCHAR AS i FROM hit) GROUP BY k)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (k) LEFT JOIN it USING (k)
"""

NEAR_DUPLICATES = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS row, doc_id,
                            list_filter(regexp_split_to_array({_LOWERED}, '{WS}'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT row, w, least(len(w), 5) AS k, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS i
      FROM d WHERE len(w) > 0),
s AS (SELECT DISTINCT row, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM p),
c AS (SELECT row, count(*)::BIGINT AS n FROM s GROUP BY row),
x AS (SELECT a.row AS a, b.row AS b, count(*) AS i FROM s a JOIN s b USING (k, g)
      WHERE a.row <> b.row GROUP BY ALL),
e AS (SELECT a, b FROM x JOIN c ca ON ca.row = a JOIN c cb ON cb.row = b
      WHERE 100 * i >= 85 * (ca.n + cb.n - i)),
r(row, other) AS (SELECT row, row FROM d UNION SELECT r.row, e.b FROM r JOIN e ON r.other = e.a),
m AS (SELECT r.row, min(d.doc_id) AS component_id FROM r JOIN d ON d.row = r.other GROUP BY r.row)
SELECT d.doc_id, coalesce(c.n, 0)::BIGINT AS n_shingles, component_id, d.doc_id IS NOT DISTINCT FROM component_id AS kept
FROM d JOIN m USING (row) LEFT JOIN c USING (row)
"""


def _host(u: str) -> str:
    return (f"translate(CASE WHEN contains({u}, '://') THEN regexp_extract({u}, '^.*?://([^/?#]*)', 1, 's') ELSE '' END, "
            "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")


def _path(u: str) -> str:
    return f"CASE WHEN contains({u}, '://') THEN regexp_extract({u}, '^.*?://[^/?#]*([^?#]*)', 1, 's') ELSE '' END"


def _rule_case(host: str, path: str, want: int) -> str:
    cases = []
    for rule in sorted(url_filter.RULES, key=lambda r: -len(r[0])):
        h, p = rule[0].split("/", 1)
        cases.append(f"WHEN ({host} = {q(h)} OR ends_with({host}, {q('.' + h)})) AND starts_with({path}, {q('/' + p)}) "
                     f"THEN {q(rule[want])}")
    return f"CASE {' '.join(cases)} END"


def _form(u: str) -> str:
    return (f"CASE WHEN contains({u}, '://') THEN regexp_replace({_host(u)}, ':(80|443)$', '') || "
            f"regexp_replace({_path(u)}, '/+$', '') || '?' || array_to_string(list_sort(list_filter("
            f"string_split(regexp_extract({u}, '^[^?#]*\\?([^#]*)', 1), '&'), "
            f"lambda x: x <> '' AND NOT regexp_matches(x, {q(url_filter.TRACKING)}))), '&') END")


def _without_dots(path: str) -> str:
    kept = (f"list_reduce(list_prepend([]::VARCHAR[], list_transform(string_split({path}, '/')[2:], lambda x: [x])), "
            "lambda done, x: CASE WHEN x[1] = '..' THEN done[1:greatest(len(done) - 1, 0)] WHEN x[1] = '.' THEN done "
            "ELSE list_concat(done, x) END)")
    return (f"('/' || array_to_string({kept}, '/') || "
            f"CASE WHEN regexp_matches({path}, '/\\.\\.?$') AND len({kept}) > 0 THEN '/' ELSE '' END)")


def _absolute(h: str, base: str) -> str:
    site = f"split_part({base}, '://', 1) || '://' || {_host(base)}"
    path, tail = f"regexp_extract({h}, '^[^?#]*', 0)", f"regexp_extract({h}, '^[^?#]*(.*)$', 1)"
    folder = f"CASE WHEN {_path(base)} = '' THEN '/' ELSE regexp_extract({_path(base)}, '^.*/', 0) END"
    return (f"CASE WHEN regexp_matches({h}, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN {h} "
            f"WHEN starts_with({h}, '//') THEN split_part({base}, '://', 1) || ':' || {h} "
            f"WHEN starts_with({h}, '/') THEN {site} || {_without_dots(path)} || {tail} "
            f"WHEN {h} = '' OR regexp_matches({h}, '^[A-Za-z][A-Za-z0-9+.-]*:') OR NOT contains({base}, '://') THEN NULL "
            f"WHEN starts_with({h}, '#') THEN regexp_extract({base}, '^[^#]*', 0) || {h} "
            f"WHEN starts_with({h}, '?') THEN {site} || {_path(base)} || {h} "
            f"ELSE {site} || {_without_dots(f'({folder} || {path})')} || {tail} END")


URLS = f"""
WITH RECURSIVE tags AS (
  SELECT url, unnest(list_concat(
    list_transform(regexp_extract_all(html, {q(url_filter.CANONICAL)}), lambda t: regexp_extract(t, {q(url_filter.HREF)}, 1)),
    list_transform(regexp_extract_all(html, {q(url_filter.REFRESH)}), lambda t: regexp_extract(t, {q(url_filter.REFRESH_URL)}, 1))
  )) AS t FROM pages WHERE url IS NOT NULL AND html IS NOT NULL),
hrefs AS (SELECT url, replace(t, '&amp;', '&') AS h FROM tags),
links AS (SELECT url AS src, {_absolute('h', 'url')} AS dst FROM hrefs),
e AS (SELECT {_form('src')} AS u, {_form('dst')} AS v, src, dst FROM links WHERE dst IS NOT NULL),
und AS (SELECT u AS a, v AS b FROM e WHERE u IS NOT NULL AND v IS NOT NULL
        UNION SELECT v, u FROM e WHERE u IS NOT NULL AND v IS NOT NULL),
reach(node, other) AS (SELECT a, a FROM und UNION SELECT reach.node, und.b FROM reach JOIN und ON reach.other = und.a),
comp AS (SELECT node, min(other) AS root FROM reach GROUP BY node),
urls AS (SELECT url FROM pages UNION SELECT src FROM e UNION SELECT dst FROM e),
own AS (SELECT {_form('url')} AS form, {_rule_case(_host('url'), _path('url'), 1)} AS own FROM urls),
shared AS (SELECT coalesce(root, form) AS root, CASE WHEN bool_or(own = 'allow') THEN 'allow' ELSE 'block' END AS shared
           FROM own LEFT JOIN comp ON form = node WHERE form IS NOT NULL AND own IS NOT NULL GROUP BY 1),
p AS (SELECT page_id, coalesce({_host('url')}, '') AS host, coalesce({_path('url')}, '') AS path, {_form('url')} AS form,
             {_rule_case(_host('url'), _path('url'), 0)} AS rule, {_rule_case(_host('url'), _path('url'), 1)} AS own FROM pages)
SELECT page_id, host, path, rule, coalesce(own, shared, 'allow') AS verdict,
       CASE WHEN own IS NOT NULL THEN 'rule' WHEN shared IS NOT NULL THEN 'alias' ELSE 'default' END AS why
FROM p LEFT JOIN comp ON form = node LEFT JOIN shared ON shared.root = coalesce(comp.root, form)
"""

_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR END"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_FIELD.format(text if c == "text" else c) for c in LEAF_COLUMNS) + ")"


# bit by bit; each step is (c >> 1) ^ (the polynomial if c is odd), with a character's byte let in before its first bit
_CRC_IN = "xor(c, CASE WHEN i % 8 = 0 THEN ascii(substr(doc_id::VARCHAR, (i // 8 + 1)::INTEGER, 1)) ELSE 0 END)"
_CRC32 = (f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, range(8 * length(doc_id::VARCHAR))), "
          f"lambda c, i: xor({_CRC_IN} >> 1, 3988292384 * ({_CRC_IN} & 1))))")

MERKLE = f"""
WITH RECURSIVE d AS (
    SELECT *, {_leaf("text")} AS leaf,
           CASE WHEN doc_id IS NOT NULL AND {_CRC32} % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")} ELSE {_leaf("text")} END AS other
    FROM documents),
l AS (SELECT doc_id, source, leaf, other, row_number() OVER () AS id, count(*) OVER (PARTITION BY source) AS n,
             row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM d),
up(source, level, idx, n, h) AS (
    SELECT source, 0::BIGINT, idx, n, leaf FROM l
    UNION ALL
    SELECT source, level + 1, idx // {ARITY}, (n + {ARITY - 1}) // {ARITY}, sha256(string_agg(h, '' ORDER BY idx))
    FROM up WHERE n > 1 GROUP BY source, level, idx // {ARITY}, n),
subs AS (SELECT source, h, count(*) OVER () AS n, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS idx FROM up WHERE n = 1),
top(level, idx, n, h) AS (
    SELECT 0::BIGINT, idx, n, h FROM subs
    UNION ALL
    SELECT level + 1, idx // {ARITY}, (n + {ARITY - 1}) // {ARITY}, sha256(string_agg(h, '' ORDER BY idx))
    FROM top WHERE n > 1 GROUP BY level, idx // {ARITY}, n),
near AS (
    SELECT l.id, u.level AS lv, u.idx, u.h, l.idx // pow({ARITY}, u.level)::BIGINT AS me
    FROM l JOIN up u ON u.source IS NOT DISTINCT FROM l.source AND u.n > 1 AND u.idx // {ARITY} = l.idx // pow({ARITY}, u.level + 1)::BIGINT
    UNION ALL
    SELECT l.id, 1000 + u.level, u.idx, u.h, s.idx // pow({ARITY}, u.level)::BIGINT
    FROM l JOIN subs s ON s.source IS NOT DISTINCT FROM l.source
    JOIN top u ON u.n > 1 AND u.idx // {ARITY} = s.idx // pow({ARITY}, u.level + 1)::BIGINT),
step AS (SELECT id, lv, row_number() OVER (PARTITION BY id ORDER BY lv) AS k,
                coalesce(string_agg(h, '' ORDER BY idx) FILTER (WHERE idx < me), '') AS before,
                coalesce(string_agg(h, '' ORDER BY idx) FILTER (WHERE idx > me), '') AS after FROM near GROUP BY id, lv),
folded(id, k, h) AS (
    SELECT id, 0::BIGINT, other FROM l
    UNION ALL
    SELECT f.id, s.k, sha256(s.before || f.h || s.after) FROM folded f JOIN step s ON s.id = f.id AND s.k = f.k + 1),
ended AS (SELECT id, arg_max(h, k) AS folded_root FROM folded GROUP BY id),
proof AS (SELECT id, sha256(string_agg(before || after, '' ORDER BY lv)) AS p FROM step GROUP BY id)
SELECT l.doc_id, l.leaf, subs.h AS subroot, r.h AS root, coalesce(proof.p, sha256('')) AS proof_sha256,
       ended.folded_root, ended.folded_root = r.h AS verified
FROM l JOIN subs ON subs.source IS NOT DISTINCT FROM l.source JOIN ended USING (id) LEFT JOIN proof USING (id)
JOIN (SELECT h FROM top WHERE n = 1) r ON true
"""

ORACLE = {
    "op11_merkle_manifest": MERKLE,
    "op10_url_filter": URLS,
    "op5_minhash_dedup": NEAR_DUPLICATES,
    "op3_decontamination": DECONTAMINATION,
    "op9_quality_rules": QUALITY,
}
