"""DuckDB SQL of the fitted features: the train rows give the statistics, all rows get vectors."""

from __future__ import annotations

from ..functions.lookups import CATEGORICAL_FEATURES
from ..operators.features import TOKEN_PATTERN
from ..operators.fitted import REVIEW_TERMS, REVIEW_TITLE_TERMS, TITLE_TERMS
from .oracle import NUMERIC_SQL, STOPS, _bins, _hash, _parse_num, _rev_rating, q, with_base

_NUMERIC = [k for k in NUMERIC_SQL if k != "_rating"]  # the target's own column stays out


def _split(labelled: str) -> str:
    return f"""lab AS (SELECT product_id, y, row_number() OVER (PARTITION BY y ORDER BY {_hash('product_id')}, product_id)
                              <= (2 * count(*) OVER (PARTITION BY y) + 5) // 10 AS is_test FROM ({labelled}) l0)"""


def _terms(name: str, text: str, limit: int, bigrams: bool) -> str:
    """{name}(product_id, term, idx, weight) of all rows; vocabulary and idf from the train rows."""
    toks = f"regexp_extract_all(lower(coalesce({text}, '')), {q(TOKEN_PATTERN)})"
    pairs = f"""UNION ALL SELECT a.product_id, a.is_test, a.term || ' ' || b.term FROM {name}1 a JOIN {name}1 b
                ON a.product_id = b.product_id AND b.p = a.p + 1""" if bigrams else ""
    return f"""
{name}0 AS (SELECT product_id, is_test, unnest({toks}) AS term, generate_subscripts({toks}, 1) AS pos FROM r),
{name}1 AS (SELECT product_id, is_test, term, row_number() OVER (PARTITION BY product_id ORDER BY pos) AS p
            FROM {name}0 WHERE term NOT IN (SELECT w FROM {STOPS})),
{name}2 AS (SELECT product_id, is_test, term FROM {name}1 {pairs}),
{name}f AS (SELECT product_id, is_test, term, count(*) AS tf FROM {name}2 GROUP BY ALL),
{name}v AS (SELECT term, ln((1.0 + (SELECT count(*) FROM r WHERE NOT is_test)) / (1.0 + df)) + 1.0 AS idf,
                   row_number() OVER (ORDER BY term) - 1 AS idx
            FROM (SELECT term, sum(tf) AS cf, count(*) AS df FROM {name}f WHERE NOT is_test GROUP BY term
                  ORDER BY cf DESC, term LIMIT {limit}) c),
{name}w AS (SELECT product_id, term, idx, tf * idf AS w FROM {name}f JOIN {name}v USING (term)),
{name} AS (SELECT product_id, term, idx, w / sqrt(sum(w * w) OVER (PARTITION BY product_id)) AS weight FROM {name}w)"""


def _code(c: str) -> str:
    return f"""SELECT r.product_id, r.is_test, '{c}_code' AS feature, coalesce(k.code, -1)::DOUBLE AS value
FROM r LEFT JOIN (SELECT label, row_number() OVER (ORDER BY label) - 1 AS code
                  FROM (SELECT DISTINCT coalesce({c}, 'Unknown') AS label FROM r WHERE NOT is_test) d) k
ON k.label = coalesce(r.{c}, 'Unknown')"""


_RATED = f"""
SELECT product_id, CAST({_bins('v', [2, 3, 4, 5.01])} AS DOUBLE) AS y
FROM (SELECT product_id, {_parse_num('rating')} AS v FROM products) a WHERE v IS NOT NULL"""

_FEATURES = f""" {_split(_RATED)},
r AS (SELECT p.*, lab.is_test, {', '.join(f'{NUMERIC_SQL[k]} AS {k}' for k in _NUMERIC)} FROM products p JOIN lab USING (product_id)),
{_terms('tt', 'title', TITLE_TERMS, False)},
x AS ({' UNION ALL '.join(f"SELECT product_id, is_test, '{k}' AS feature, coalesce({k}, (SELECT median({k}) FROM r WHERE NOT is_test)) AS value FROM r" for k in _NUMERIC)}
      UNION ALL {' UNION ALL '.join(map(_code, CATEGORICAL_FEATURES))}
      UNION ALL SELECT r.product_id, r.is_test, 't_' || v.term, coalesce(tt.weight, 0.0)
      FROM r CROSS JOIN ttv v LEFT JOIN tt ON tt.product_id = r.product_id AND tt.term = v.term),
st AS (SELECT feature, avg(value) AS mean, stddev_pop(value) AS deviation FROM x WHERE NOT is_test GROUP BY feature)"""

_ORDER = _NUMERIC + [f"{c}_code" for c in CATEGORICAL_FEATURES]
_MEDIANS = " UNION ALL ".join(f"SELECT '{k}' AS feature, median({k}) AS median FROM r WHERE NOT is_test" for k in _NUMERIC)

_MOODS = f"""
SELECT product_id, CAST({_bins('v', [2.5, 3.5, 5.01])} AS DOUBLE) AS y
FROM (SELECT product_id, coalesce({_rev_rating('reviews_rating')}, median({_rev_rating('reviews_rating')}) OVER ()) AS v FROM products) a"""

ORACLE = {
    "feature_matrix": with_base(f"""SELECT * FROM (WITH {_FEATURES}
SELECT product_id, is_test, feature, round_even(CASE WHEN deviation > 0 THEN (value - mean) / deviation ELSE 0.0 END, 6) + 0.0 AS value
FROM x JOIN st USING (feature)) z"""),
    "feature_statistics": with_base(f"""SELECT * FROM (WITH {_FEATURES}, md AS ({_MEDIANS}),
pos AS (SELECT unnest([{', '.join(q(n) for n in _ORDER)}]) AS feature, unnest(range({len(_ORDER)})) AS position
        UNION ALL SELECT 't_' || term, {len(_ORDER)} + idx FROM ttv)
SELECT feature, CAST(position AS INTEGER) AS position, round_even(md.median, 6) + 0.0 AS median, round_even(ttv.idf, 6) + 0.0 AS idf,
       round_even(st.mean, 6) + 0.0 AS mean, round_even(st.deviation, 6) + 0.0 AS deviation
FROM pos JOIN st USING (feature) LEFT JOIN md USING (feature) LEFT JOIN ttv ON 't_' || ttv.term = pos.feature) z"""),
    "review_matrix": with_base(f"""SELECT * FROM (WITH {_split(_MOODS)},
r AS (SELECT p.*, lab.y AS label, lab.is_test FROM products p JOIN lab USING (product_id)),
{_terms('rv', "coalesce(reviews, 'no review')", REVIEW_TERMS, True)},
{_terms('tt', 'title', REVIEW_TITLE_TERMS, False)},
n AS (SELECT (SELECT count(*) FROM rvv) AS a, (SELECT count(*) FROM ttv) AS b),
e AS (SELECT product_id, idx, weight FROM rv UNION ALL SELECT product_id, a + idx, weight FROM tt, n
      UNION ALL SELECT product_id, a + b, {_parse_num('price')} FROM r, n UNION ALL SELECT product_id, a + b + 1, {_parse_num('rating')} FROM r, n
      UNION ALL SELECT product_id, a + b + 2, len(string_split(coalesce(reviews, 'no review'), '||'))::DOUBLE FROM r, n)
SELECT r.product_id, r.label, r.is_test, CAST(e.idx AS INTEGER) AS idx, round_even(e.weight, 6) + 0.0 AS weight
FROM e JOIN r USING (product_id) WHERE e.weight <> 0) z"""),
}
