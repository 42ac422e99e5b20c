"""DuckDB SQL for every registered query that SQL can express.

The SQL rebuilds the adapter, cleaning, flattening and scoring itself from the
driver's tables (views ``part``, ``documents``, ``labels``, ...), so a match
checks the whole Spark plan, not just its last step. Scoring is written in a
different shape (tokens unnested, context by ``lag``/``lead`` windows) from
the Spark job (shifted arrays and broadcast joins).
"""

from __future__ import annotations

from ..functions.lexicons import (
    C_INCR,
    EXCLAIM_MAX,
    EXCLAIM_STEP,
    FIXTURE_BOOSTERS,
    FIXTURE_CONTRAST,
    FIXTURE_LEXICON,
    FIXTURE_NEGATIONS,
    N_SCALAR,
    NORMALIZE_ALPHA,
    QUESTION_MAX_AMP,
    QUESTION_STEP,
)
from ..functions.lookups import CATEGORY_ICON, FORM_FACTOR_TO_CATEGORY
from ..sources.testdata import OTHER_FORM_FACTOR, TYPE_TO_FORM_FACTOR
from .catalog import EVENT_TYPES, KPI_FILTER, SCORE_AT, SEARCH_PATTERN, WEEKDAYS

PUNCT = r"[!-/:-@\[-`{-~]"
D = "::DOUBLE"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _values(rows, cols: str) -> str:
    body = ", ".join("(" + ", ".join(rows_i) + ")" for rows_i in rows)
    return f"(SELECT * FROM (VALUES {body}) AS v({cols}))"


def round_ratio(num: str, den: str, digits: int) -> str:
    """Exact half-even round(num/den, digits) for integers, as in ``clean.round_ratio``."""
    scale = 10 ** digits
    n = f"(abs(CAST({num} AS BIGINT)) * {scale})"
    d = f"CAST({den} AS BIGINT)"
    r = f"({n} % {d})"
    qq = f"(({n} - {r}) // {d})"
    up = f"(CASE WHEN {r} * 2 > {d} THEN 1 WHEN {r} * 2 = {d} AND {qq} % 2 = 1 THEN 1 ELSE 0 END)"
    return f"(CASE WHEN {d} > 0 THEN sign({num}) * ({qq} + {up}) / {float(scale)} END)"


def pct1(a: str, b: str) -> str:
    return round_ratio(f"({a}) * 100", b, 1)


def e4(c: str) -> str:
    return f"CAST(round({c} * 10000) AS BIGINT)"


def avg_e4(c: str, cond: str | None = None) -> str:
    x = e4(c) if cond is None else f"CASE WHEN {cond} THEN {e4(c)} END"
    return f"(sum({x}) / count({x}) / 10000.0)"


def label(c: str) -> str:
    return (f"CASE WHEN {c} >= 0.05 THEN 'Positive' WHEN {c} <= -0.05 THEN 'Negative' "
            f"ELSE 'Neutral' END")


def _ff_case() -> str:
    whens = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in TYPE_TO_FORM_FACTOR.items())
    return f"CASE split_part(p_type, ' ', 1) {whens} ELSE {q(OTHER_FORM_FACTOR)} END"


CATEGORY_MAP = _values([(q(k), q(v)) for k, v in FORM_FACTOR_TO_CATEGORY.items()], "ff, category")
ICONS = _values([(q(k), q(v)) for k, v in CATEGORY_ICON.items()], "category, icon")

BASE = f"""
raw AS (
  SELECT p_partkey AS product_id, p_name AS title,
    CASE WHEN p_partkey % 19 <> 0 THEN '₹' || CAST(p_size AS VARCHAR) || ','
      || lpad(CAST(CAST(floor(p_retailprice) AS BIGINT) AS VARCHAR), 3, '0') || '.50' END AS price,
    CASE WHEN p_partkey % 17 <> 0 THEN CAST(1 + p_size % 5 AS VARCHAR) || '.'
      || CAST(p_partkey % 10 AS VARCHAR) || ' out of 5 stars' END AS rating,
    CAST(p_size * 13 AS VARCHAR) || ' ratings' AS total_reviews,
    CAST((p_size % 4 + 1) * 2 AS VARCHAR) || ' GB' AS ram,
    {_ff_case()} AS form_factor,
    CASE WHEN p_partkey % 23 <> 0 THEN p_brand END AS manufacturer,
    CASE WHEN p_size % 3 = 0 THEN 'Android' WHEN p_size % 3 = 1 THEN 'iOS' END AS os,
    split_part(p_name, ' ', 1) AS colour,
    CASE WHEN p_partkey % 11 = 0 THEN 'Out of stock' ELSE 'In stock' END AS availability_status,
    CASE WHEN p_size % 4 = 0 THEN 'India' WHEN p_size % 4 = 1 THEN 'China'
         WHEN p_size % 4 = 2 THEN 'Vietnam' END AS country_of_origin,
    p_type AS special_features,
    CAST(p_size * 10 AS VARCHAR) || ' g' AS weight,
    CAST(p_size * 100 AS VARCHAR) AS battery_power_rating
  FROM part),
items AS (
  SELECT d.doc_id, CAST(floor(d.doc_id / 5) AS BIGINT) AS product_id,
    regexp_replace(d.text, '[|]+', ' ', 'g') AS text,
    CASE l.quality WHEN 1 THEN '5.0 out of 5 stars' WHEN 0 THEN '2.0 out of 5 stars' ELSE '' END AS star
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
packed AS (
  SELECT product_id, string_agg(text, '||' ORDER BY doc_id) AS reviews,
    string_agg(star, '||' ORDER BY doc_id) AS reviews_rating
  FROM items GROUP BY product_id),
products AS (
  SELECT r.*, pk.reviews, pk.reviews_rating,
    TRY_CAST(regexp_replace(r.price, '[^0-9.]', '', 'g') AS DOUBLE) AS price_clean,
    TRY_CAST(nullif(regexp_extract(r.rating, '([\\d.]+)', 1), '') AS DOUBLE) AS rating_clean,
    TRY_CAST(nullif(regexp_replace(regexp_replace(r.total_reviews, '\\.0$', ''), '[^0-9]', '', 'g'), '')
             AS DOUBLE) AS reviews_count,
    TRY_CAST(nullif(regexp_extract(r.ram, '(\\d+)', 1), '') AS DOUBLE) AS ram_gb,
    coalesce(cm.category, 'Other') AS category
  FROM raw r LEFT JOIN packed pk USING (product_id)
  LEFT JOIN {CATEGORY_MAP} cm ON cm.ff = lower(regexp_replace(r.form_factor, '^\\s+|\\s+$', '', 'g'))),
flat0 AS (
  SELECT product_id, title, manufacturer, category, os, colour, price_clean, rating_clean, ram_gb,
    string_split(coalesce(reviews, 'nan'), '||') AS rv,
    string_split(coalesce(reviews_rating, 'nan'), '||') AS rt
  FROM products),
flat1 AS (SELECT *, unnest(range(least(len(rv), len(rt)))) AS i FROM flat0),
reviews AS (
  SELECT * FROM (
    SELECT product_id, CAST(i AS INTEGER) AS review_pos, title, manufacturer, category, os, colour,
      regexp_replace(rv[i + 1], '^\\s+|\\s+$', '', 'g') AS review_text,
      price_clean, rating_clean, ram_gb,
      TRY_CAST(nullif(regexp_extract(rt[i + 1], '([\\d.]+)', 1), '') AS DOUBLE) AS star_rating
    FROM flat1)
  WHERE review_text <> '' AND lower(review_text) <> 'nan')"""

# Every 7th product lacks its last star text (for flatten_reviews alone).
BASE_SHORT = BASE.replace("string_agg(star, '||' ORDER BY doc_id) AS reviews_rating", """CASE WHEN product_id % 7 = 0
      THEN array_to_string(list_slice(list(star ORDER BY doc_id), 1, count(*) - 1), '||')
      ELSE string_agg(star, '||' ORDER BY doc_id) END AS reviews_rating""")

LEXICON = _values([(q(k), f"{v}{D}") for k, v in FIXTURE_LEXICON.items()], "term, valence")
BOOSTERS = _values([(q(k), f"{v}{D}") for k, v in FIXTURE_BOOSTERS.items()], "term, booster")
NEGATIONS = _values([(q(k),) for k in FIXTURE_NEGATIONS], "term")


def basic_scoring(src: str, keys: list[str], text: str, out: str) -> str:
    """CTEs: ``out`` = ``src`` + basic lexicon scores (tenths summed exactly)."""
    k = ", ".join(keys)
    on = " AND ".join(f"b.{x} = a.{x}" for x in keys)
    lex10 = f"(SELECT term, CAST(round(valence * 10) AS BIGINT) AS v10 FROM {LEXICON})"
    return f""",
{out}_tok AS (SELECT {k}, unnest(regexp_extract_all(lower({text}), '[a-z]+')) AS term FROM {src}),
{out}_agg AS (
  SELECT {k}, CAST(sum(v10) AS BIGINT) AS s10,
    CAST(sum(CASE WHEN v10 > 0 THEN v10 + 10 END) AS BIGINT) AS pos10,
    CAST(sum(CASE WHEN v10 < 0 THEN 10 - v10 END) AS BIGINT) AS neg10,
    count(CASE WHEN v10 <> 0 THEN 1 END) AS nz
  FROM {out}_tok JOIN {lex10} l USING (term) GROUP BY {k}),
{out}_base AS (
  SELECT b.*, len(regexp_extract_all(lower(b.{text}), '[a-z]+')) AS ntok,
    coalesce(a.s10, 0) / 10.0 AS s, coalesce(a.pos10, 0) AS pos10, coalesce(a.neg10, 0) AS neg10,
    (len(regexp_extract_all(lower(b.{text}), '[a-z]+')) - coalesce(a.nz, 0)) * 10 AS neu10
  FROM {src} b LEFT JOIN {out}_agg a ON {on}),
{out} AS (
  SELECT * EXCLUDE (ntok, s, pos10, neg10, neu10),
    CASE WHEN ntok > 0 THEN round_even(s / sqrt(s * s + {NORMALIZE_ALPHA}), 4) ELSE 0.0 END AS compound,
    CASE WHEN ntok > 0 THEN {round_ratio('pos10', 'pos10 + neg10 + neu10', 3)} ELSE 0.0 END AS pos_score,
    CASE WHEN ntok > 0 THEN {round_ratio('neg10', 'pos10 + neg10 + neu10', 3)} ELSE 0.0 END AS neg_score,
    CASE WHEN ntok > 0 THEN {round_ratio('neu10', 'pos10 + neg10 + neu10', 3)} ELSE 0.0 END AS neu_score,
    {label(f"CASE WHEN ntok > 0 THEN round_even(s / sqrt(s * s + {NORMALIZE_ALPHA}), 4) ELSE 0.0 END")}
      AS sentiment
  FROM {out}_base)"""


def full_scoring(src: str, keys: list[str], text: str, out: str) -> str:
    """CTEs: ``out`` = ``src`` + full rule-set scores (V1-V10), via windows."""
    k = ", ".join(keys)
    on = " AND ".join(f"b.{x} = a.{x}" for x in keys)
    strip = f"regexp_replace(raw, '^{PUNCT}+|{PUNCT}+$', '', 'g')"
    w = f"(PARTITION BY {k} ORDER BY pos)"
    g = f"(PARTITION BY {k})"
    C, N = f"{C_INCR}{D}", f"{N_SCALAR}{D}"
    ctes = f""",
{out}_t0 AS (
  SELECT {k}, unnest(string_split_regex({text}, '\\s+')) AS raw,
    generate_subscripts(string_split_regex({text}, '\\s+'), 1) AS rpos FROM {src}),
{out}_t1 AS (
  SELECT {k}, rpos, CASE WHEN length({strip}) <= 2 THEN raw ELSE {strip} END AS tok
  FROM {out}_t0 WHERE raw <> ''),
{out}_t2 AS (
  SELECT {k}, row_number() OVER (PARTITION BY {k} ORDER BY rpos) - 1 AS pos, lower(tok) AS lw,
    (tok = upper(tok) AND tok <> lower(tok)) AS up
  FROM {out}_t1),
{out}_t3 AS (
  SELECT *, lag(lw, 1) OVER {w} AS p1, lag(lw, 2) OVER {w} AS p2, lag(lw, 3) OVER {w} AS p3,
    lead(lw, 1) OVER {w} AS n1, lag(up, 1) OVER {w} AS up1, lag(up, 2) OVER {w} AS up2,
    lag(up, 3) OVER {w} AS up3, count(*) OVER {g} AS ntok, count_if(up) OVER {g} AS nup,
    min(CASE WHEN lw = {q(FIXTURE_CONTRAST)} THEN pos END) OVER {g} AS but_pos
  FROM {out}_t2),
{out}_h0 AS (
  SELECT t.*, l.valence AS v0, (t.nup > 0 AND t.nup < t.ntok) AS cap,
    (l1.term IS NOT NULL) AS p1_lex, (l2.term IS NOT NULL) AS p2_lex,
    (l3.term IS NOT NULL) AS p3_lex, (ln.term IS NOT NULL) AS n1_lex,
    b1.booster AS p1_boost, b2.booster AS p2_boost, b3.booster AS p3_boost,
    (g1.term IS NOT NULL OR coalesce(contains(t.p1, 'n''t'), false)) AS p1_neg,
    (g2.term IS NOT NULL OR coalesce(contains(t.p2, 'n''t'), false)) AS p2_neg,
    (g3.term IS NOT NULL OR coalesce(contains(t.p3, 'n''t'), false)) AS p3_neg
  FROM {out}_t3 t JOIN {LEXICON} l ON l.term = t.lw
  LEFT JOIN {LEXICON} l1 ON l1.term = t.p1 LEFT JOIN {LEXICON} l2 ON l2.term = t.p2
  LEFT JOIN {LEXICON} l3 ON l3.term = t.p3 LEFT JOIN {LEXICON} ln ON ln.term = t.n1
  LEFT JOIN {BOOSTERS} b1 ON b1.term = t.p1 LEFT JOIN {BOOSTERS} b2 ON b2.term = t.p2
  LEFT JOIN {BOOSTERS} b3 ON b3.term = t.p3
  LEFT JOIN {NEGATIONS} g1 ON g1.term = t.p1 LEFT JOIN {NEGATIONS} g2 ON g2.term = t.p2
  LEFT JOIN {NEGATIONS} g3 ON g3.term = t.p3
  WHERE t.lw NOT IN (SELECT term FROM {BOOSTERS})
    AND NOT (t.lw = 'kind' AND coalesce(t.n1 = 'of', false))),
{out}_h1 AS (SELECT *, CASE WHEN lw = 'no' AND n1 IS NOT NULL AND n1_lex THEN 0.0{D} ELSE v0 END AS v1
  FROM {out}_h0),
{out}_h2 AS (SELECT *, CASE WHEN coalesce(p1 = 'no' OR p2 = 'no' OR (p3 = 'no' AND p1 IN ('or', 'nor')), false)
  THEN v0 * {N} ELSE v1 END AS v2 FROM {out}_h1),
{out}_h3 AS (SELECT *, CASE WHEN up AND cap THEN (CASE WHEN v2 > 0 THEN v2 + {C} ELSE v2 - {C} END)
  ELSE v2 END AS v3 FROM {out}_h2)"""
    prev = "v3"
    for i, damp in ((1, 1.0), (2, 0.95), (3, 0.9)):
        s = (f"(CASE WHEN p{i}_boost IS NOT NULL THEN (CASE WHEN {prev} < 0 THEN -p{i}_boost ELSE p{i}_boost END)"
             f" + (CASE WHEN up{i} AND cap THEN (CASE WHEN {prev} > 0 THEN {C} ELSE -{C} END) ELSE 0.0{D} END)"
             f" ELSE 0.0{D} END) * {damp}{D}")
        if i == 1:
            neg = f"CASE WHEN p1_neg THEN w{i} * {N} ELSE w{i} END"
        elif i == 2:
            neg = (f"CASE WHEN p2 = 'never' AND p1 IN ('so', 'this') THEN w{i} * 1.25{D} "
                   f"WHEN p2 = 'without' AND p1 = 'doubt' THEN w{i} "
                   f"WHEN p2_neg THEN w{i} * {N} ELSE w{i} END")
        else:
            neg = (f"CASE WHEN (p3 = 'never' AND p2 IN ('so', 'this')) OR p1 IN ('so', 'this') THEN w{i} * 1.5{D} "
                   f"WHEN p3 = 'without' AND (p2 = 'doubt' OR p1 = 'doubt') THEN w{i} "
                   f"WHEN p3_neg THEN w{i} * {N} ELSE w{i} END")
        ctes += f""",
{out}_k{i}a AS (SELECT *, {prev} + {s} AS w{i} FROM {out}_{'h3' if i == 1 else f'k{i-1}'}),
{out}_k{i} AS (SELECT *, CASE WHEN p{i} IS NOT NULL AND NOT p{i}_lex THEN ({neg}) ELSE {prev} END AS vk{i}
  FROM {out}_k{i}a)"""
        prev = f"vk{i}"
    bc = FIXTURE_CONTRAST
    del bc
    ctes += f""",
{out}_hl AS (SELECT *, CASE WHEN p1 = 'least' AND NOT p1_lex AND (p2 IS NULL OR p2 NOT IN ('at', 'very'))
  THEN {prev} * {N} ELSE {prev} END AS vl FROM {out}_k3),
{out}_hs AS (SELECT {k}, vl * (CASE WHEN but_pos IS NULL THEN 1.0{D} WHEN pos < but_pos THEN 0.5{D}
  WHEN pos > but_pos THEN 1.5{D} ELSE 1.0{D} END) AS s FROM {out}_hl),
{out}_agg AS (
  SELECT {k}, sum(s) AS sum_s, sum(CASE WHEN s > 0 THEN s + 1.0{D} END) AS pos_sum,
    sum(CASE WHEN s < 0 THEN s - 1.0{D} END) AS neg_sum, count(CASE WHEN s <> 0 THEN 1 END) AS nz
  FROM {out}_hs GROUP BY {k}),
{out}_nt AS (SELECT {k}, count(*) AS ntok FROM {out}_t1 GROUP BY {k}),
{out}_b0 AS (
  SELECT b.*, coalesce(nt.ntok, 0) AS _ntok,
    least(length(b.{text}) - length(replace(b.{text}, '!', '')), {EXCLAIM_MAX}) * {EXCLAIM_STEP}{D}
    + (CASE WHEN length(b.{text}) - length(replace(b.{text}, '?', '')) > 3 THEN {QUESTION_MAX_AMP}{D}
            WHEN length(b.{text}) - length(replace(b.{text}, '?', '')) > 1
            THEN (length(b.{text}) - length(replace(b.{text}, '?', ''))) * {QUESTION_STEP}{D}
            ELSE 0.0{D} END) AS _punct,
    coalesce(a.sum_s, 0.0{D}) AS _sum_s, coalesce(a.pos_sum, 0.0{D}) AS _pos_sum,
    coalesce(a.neg_sum, 0.0{D}) AS _neg_sum, coalesce(a.nz, 0) AS _nz
  FROM {src} b LEFT JOIN {out}_agg a ON {on} LEFT JOIN {out}_nt nt ON {' AND '.join(f'nt.{x} = b.{x}' for x in keys)}),
{out}_b1 AS (
  SELECT *,
    CASE WHEN _sum_s > 0 THEN _sum_s + _punct WHEN _sum_s < 0 THEN _sum_s - _punct ELSE _sum_s END AS _s2,
    CASE WHEN _pos_sum > abs(_neg_sum) THEN _pos_sum + _punct ELSE _pos_sum END AS _p2,
    CASE WHEN _pos_sum < abs(_neg_sum) THEN _neg_sum - _punct ELSE _neg_sum END AS _n2,
    _ntok - _nz AS _neu
  FROM {out}_b0),
{out}_b2 AS (
  SELECT * EXCLUDE (_ntok, _punct, _sum_s, _pos_sum, _neg_sum, _nz, _s2, _p2, _n2, _neu),
    CASE WHEN _ntok > 0 THEN round_even(greatest(-1.0{D}, least(1.0{D}, _s2 / sqrt(_s2 * _s2 + {NORMALIZE_ALPHA}{D}))), 4)
      ELSE 0.0{D} END AS compound,
    CASE WHEN _ntok > 0 THEN round_even(abs(_p2 / (_p2 + abs(_n2) + _neu)), 3) ELSE 0.0{D} END AS pos_score,
    CASE WHEN _ntok > 0 THEN round_even(abs(_n2 / (_p2 + abs(_n2) + _neu)), 3) ELSE 0.0{D} END AS neg_score,
    CASE WHEN _ntok > 0 THEN round_even(abs(_neu / (_p2 + abs(_n2) + _neu)), 3) ELSE 0.0{D} END AS neu_score
  FROM {out}_b1),
{out} AS (SELECT *, {label('compound')} AS sentiment FROM {out}_b2)"""
    return ctes


DOCS = """,
docs AS (SELECT doc_id AS review_id, text AS review_text FROM documents)"""

SCORED = BASE + full_scoring("reviews", ["product_id", "review_pos"], "review_text", "scored")


def with_scored(select: str) -> str:
    return f"WITH {SCORED}\n{select}"


def with_base(select: str) -> str:
    return f"WITH {BASE}\n{select}"


POS, NEG, NEU = "sentiment = 'Positive'", "sentiment = 'Negative'", "sentiment = 'Neutral'"


def _kpi_select(key: str | None) -> str:
    k = f"{key}, " if key else ""
    return f"""
SELECT {k}CAST(count_if(_is_product) AS BIGINT) AS products,
  count(DISTINCT CASE WHEN _is_product THEN category END) AS categories,
  count(DISTINCT CASE WHEN _is_product THEN manufacturer END) AS brands,
  CAST(count_if(NOT _is_product) AS BIGINT) AS reviews,
  CAST(count_if(NOT _is_product AND {POS}) AS BIGINT) AS positive,
  CAST(count_if(NOT _is_product AND {NEG}) AS BIGINT) AS negative,
  CAST(count_if(NOT _is_product AND {NEU}) AS BIGINT) AS neutral,
  count_if(NOT _is_product AND {POS}) / greatest(count_if(NOT _is_product), 1) AS pos_share,
  count_if(NOT _is_product AND {NEG}) / greatest(count_if(NOT _is_product), 1) AS neg_share,
  coalesce({avg_e4('compound', 'NOT _is_product')}, 0.0) AS avg_compound"""


def _union(p_where: str = "TRUE", r_where: str = "TRUE") -> str:
    return f"""(
  SELECT TRUE AS _is_product, product_id, category, manufacturer, NULL::DOUBLE AS compound,
         NULL::VARCHAR AS sentiment FROM products WHERE {p_where}
  UNION ALL
  SELECT FALSE, product_id, category, manufacturer, compound, sentiment FROM scored WHERE {r_where})"""


def _filter_where(with_price: bool) -> str:
    f = KPI_FILTER
    c = ["TRUE"]
    if f.category is not None:
        c.append(f"category = {q(f.category)}")
    if f.brand is not None:
        c.append(f"manufacturer = {q(f.brand)}")
    if with_price and f.price_range is not None:
        lo, hi = f.price_range
        c.append(f"(price_clean BETWEEN {lo} AND {hi} OR price_clean IS NULL)")
    if f.min_star > 0:
        c.append(f"rating_clean >= {f.min_star}")
    return " AND ".join(c)


def _sentiment_table(key: str) -> str:
    extra = ""
    if key == "category":
        extra = ", coalesce(ic.icon, '⚙️') AS icon, coalesce(ic.icon, '⚙️') || '  ' || t.category AS cat_label"
    body = f"""
SELECT {key}, CAST(count_if({POS}) AS BIGINT) AS pos, CAST(count_if({NEG}) AS BIGINT) AS neg,
  count(sentiment) AS total, {avg_e4('compound')} AS avg_score,
  {pct1(f'count_if({POS})', 'count(sentiment)')} AS pos_pct,
  {pct1(f'count_if({NEG})', 'count(sentiment)')} AS neg_pct,
  {round_ratio(f"sum({e4('compound')})", 'count(sentiment) * 10', 3)} AS avg_vader
FROM scored WHERE {key} IS NOT NULL GROUP BY {key}"""
    if key == "category":
        return f"SELECT t.*{extra} FROM ({body}) t LEFT JOIN {ICONS} ic ON ic.category = t.category"
    return body


def _top_titles(group: str) -> str:
    return f"""
SELECT {group}, title, reviews, avg_compound, avg_vader, rn FROM (
  SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY avg_compound DESC, title ASC) AS rn FROM (
    SELECT {group}, title, count(compound) AS reviews,
      sum({e4('compound')}) / count(compound) / 10000.0 AS avg_compound,
      {round_ratio(f"sum({e4('compound')})", 'count(compound) * 10', 3)} AS avg_vader
    FROM scored WHERE {group} IS NOT NULL AND title IS NOT NULL GROUP BY {group}, title))
WHERE rn <= 10"""


CATEGORY_LIST = list(CATEGORY_ICON)


def _heatmap() -> str:
    cols = ",\n  ".join(
        f"coalesce(sum({e4('compound')}) FILTER (WHERE category = {q(c)}) / "
        f"count(compound) FILTER (WHERE category = {q(c)}) / 10000.0, 0.0) AS \"{c}\""
        for c in CATEGORY_LIST)
    return f"""
, top AS (SELECT manufacturer FROM scored WHERE manufacturer IS NOT NULL GROUP BY manufacturer
          ORDER BY count(compound) DESC, manufacturer ASC LIMIT 30)
SELECT manufacturer,
  {cols}
FROM scored WHERE manufacturer IN (SELECT manufacturer FROM top) GROUP BY manufacturer"""


def _top_reviews(lbl: str, n: int, group: str | None = None) -> str:
    order = "compound DESC" if lbl == "Positive" else "compound ASC"
    cols = "product_id, review_pos, title, manufacturer, category, compound, review_text"
    if group is None:
        return (f"SELECT {cols} FROM scored WHERE sentiment = {q(lbl)} "
                f"ORDER BY {order}, product_id, review_pos LIMIT {n}")
    return f"""
SELECT {cols}, rn FROM (SELECT {cols}, row_number() OVER (PARTITION BY {group}
  ORDER BY {order}, product_id, review_pos) AS rn FROM scored
  WHERE sentiment = {q(lbl)} AND {group} IS NOT NULL) WHERE rn <= {n}"""


def _rev_rating(c: str) -> str:
    m = f"regexp_extract_all({c}, '(\\d+\\.?\\d*)\\s*out of 5', 1)"
    return (f"CASE WHEN len({m}) > 0 THEN list_sum(list_transform({m}, lambda x: CAST(x AS DOUBLE)))"
            f" / len({m}) END")


def _parse_num(c: str) -> str:
    return f"TRY_CAST(nullif(regexp_extract({c}, '(\\d+\\.?\\d*)', 1), '') AS DOUBLE)"


ORACLE: dict[str, str] = {
    "clean_products": with_base(f"""
SELECT product_id, title, manufacturer, form_factor, price, rating, price_clean, rating_clean,
  reviews_count, ram_gb, category, {_parse_num('price')} AS price_num,
  {_parse_num("replace(price, ',', '')")} AS price_parsed
FROM products"""),
    "category_map": with_base(f"""
SELECT p.form_factor, p.category, count(*) AS products, coalesce(ic.icon, '⚙️') AS icon
FROM products p LEFT JOIN {ICONS} ic ON ic.category = p.category
GROUP BY p.form_factor, p.category, ic.icon"""),
    "flatten_reviews": f"WITH {BASE_SHORT}\nSELECT * FROM reviews",
    "score_basic": "WITH " + BASE + DOCS + basic_scoring("docs", ["review_id"], "review_text", "sb")
                   + "\nSELECT * EXCLUDE (review_text) FROM sb",
    "score_full": "WITH " + BASE + DOCS + full_scoring("docs", ["review_id"], "review_text", "sf")
                  + "\nSELECT * EXCLUDE (review_text) FROM sf",
    "packed_ratings": with_base(f"""
SELECT product_id, {_rev_rating('reviews_rating')} AS review_rating_avg,
  CASE WHEN reviews IS NULL THEN 0 ELSE len(string_split(reviews, '||')) END AS review_count,
  len(string_split(coalesce(reviews, 'no review'), '||')) AS review_count_filled,
  TRY_CAST(battery_power_rating AS DOUBLE) AS battery, {_parse_num('weight')} AS weight_num
FROM products"""),
    "sentiment_counts": with_scored(f"""
SELECT CAST(count_if({POS}) AS BIGINT) AS positive, CAST(count_if({NEG}) AS BIGINT) AS negative,
  CAST(count_if({NEU}) AS BIGINT) AS neutral, count(*) AS total FROM scored"""),
    "filtered_kpis": with_scored(_kpi_select(None) + " FROM " + _union(
        _filter_where(True), _filter_where(True))),
    "price_bounds": with_base("""
SELECT CAST(trunc(min(price_clean)) AS BIGINT) AS price_lo, CAST(trunc(max(price_clean)) AS BIGINT) AS price_hi
FROM products"""),
    "product_search": with_base(f"""
SELECT product_id, title, manufacturer, category, price_clean, rating_clean FROM products
WHERE coalesce(regexp_matches(title, {q('(?i)' + SEARCH_PATTERN)}), false)"""),
    "product_card": with_scored(f"""
SELECT product_id, count(*) AS reviews, CAST(count_if({POS}) AS BIGINT) AS positive,
  CAST(count_if({NEG}) AS BIGINT) AS negative, CAST(count_if({NEU}) AS BIGINT) AS neutral,
  {pct1(f'count_if({POS})', 'count(*)')} AS pos_pct, {pct1(f'count_if({NEG})', 'count(*)')} AS neg_pct,
  {round_ratio(f"sum({e4('compound')})", 'count(*) * 10', 3)} AS avg_compound
FROM scored GROUP BY product_id"""),
    "brand_kpis": with_scored(_kpi_select("manufacturer") + " FROM " + _union()
                              + " WHERE manufacturer IS NOT NULL GROUP BY manufacturer"),
    "brand_category_mix": with_base("""
SELECT manufacturer, category, count(*) AS products FROM products
WHERE manufacturer IS NOT NULL GROUP BY manufacturer, category"""),
    "brand_category_scores": with_scored(f"""
SELECT manufacturer, category, {avg_e4('compound')} AS avg_compound, count(compound) AS reviews
FROM scored WHERE manufacturer IS NOT NULL AND category IS NOT NULL GROUP BY manufacturer, category"""),
    "brand_top_titles": with_scored(_top_titles("manufacturer")),
    "category_kpis": with_scored(_kpi_select("category") + " FROM " + _union()
                                 + " WHERE category IS NOT NULL GROUP BY category"),
    "category_brands": with_scored(f"""
SELECT category, manufacturer, {avg_e4('compound')} AS avg_compound, count(compound) AS reviews
FROM scored WHERE manufacturer IS NOT NULL AND category IS NOT NULL GROUP BY category, manufacturer"""),
    "category_best_titles": with_scored(_top_titles("category")),
    "top_rated": with_base("""
SELECT category, product_id, title, manufacturer, price_clean, rating_clean, rn FROM (
  SELECT category, product_id, title, manufacturer, price_clean, rating_clean,
    row_number() OVER (PARTITION BY category ORDER BY rating_clean DESC, product_id ASC) AS rn
  FROM products WHERE rating_clean IS NOT NULL AND category IS NOT NULL) WHERE rn <= 10"""),
    "category_table": with_scored(_sentiment_table("category")),
    "brand_table": with_scored(_sentiment_table("manufacturer")),
    "brand_top40_long": with_scored(f"""
, bt AS ({_sentiment_table('manufacturer')}),
top AS (SELECT * FROM bt ORDER BY avg_score DESC, manufacturer ASC LIMIT 40)
SELECT manufacturer, avg_score, 'pos_pct' AS variable, pos_pct AS value FROM top
UNION ALL
SELECT manufacturer, avg_score, 'neg_pct' AS variable, neg_pct AS value FROM top""".replace(
        "\n, bt AS", "SELECT * FROM (WITH bt AS", 1) + ") x"),
    "brand_category_heatmap": with_scored(_heatmap().replace("\n, top AS", "SELECT * FROM (WITH top AS", 1)
                                          + ") x"),
    "score_histogram": with_scored(f"""
SELECT sentiment, bin, count(*) AS reviews, (bin - 1) * 250 / 10000.0 - 1.0 AS bin_lo FROM (
  SELECT sentiment, least(CAST(floor(({e4('compound')} + 10000) / 250) AS INTEGER) + 1, 80) AS bin
  FROM scored) GROUP BY sentiment, bin"""),
    "sentiment_breakdown": with_scored(f"""
SELECT category, 'Positive' AS sentiment, CAST(count_if({POS}) AS BIGINT) AS reviews FROM scored
  WHERE category IS NOT NULL GROUP BY category
UNION ALL SELECT category, 'Neutral', CAST(count_if({NEU}) AS BIGINT) FROM scored
  WHERE category IS NOT NULL GROUP BY category
UNION ALL SELECT category, 'Negative', CAST(count_if({NEG}) AS BIGINT) FROM scored
  WHERE category IS NOT NULL GROUP BY category"""),
    "price_rating_pairs": with_base("""
SELECT category, product_id, manufacturer, title, price_clean, rating_clean FROM products
WHERE price_clean IS NOT NULL AND rating_clean IS NOT NULL
  AND category IN (SELECT category FROM products GROUP BY category HAVING count(price_clean) > 3)"""),
    "top_positive": with_scored(_top_reviews("Positive", 5)),
    "top_negative": with_scored(_top_reviews("Negative", 5)),
    "category_top_reviews": with_scored(_top_reviews("Positive", 6, "category")),
}


# --- features, neighbours, metrics ------------------------------------------

from ..functions.lookups import ENGLISH_STOP_WORDS  # noqa: E402
from ..operators.features import HASH_MOD, HASH_MULT, ID_MOD, TOKEN_PATTERN  # noqa: E402

STOPS = _values([(q(w),) for w in ENGLISH_STOP_WORDS], "w")


def _hash(col: str) -> str:
    return f"((((({col}) % {ID_MOD}) + {ID_MOD}) % {ID_MOD} + 42) * {HASH_MULT}) % {HASH_MOD}"


def _bins(c: str, edges: list[float]) -> str:
    parts = [f"WHEN {c} >= 0 AND {c} <= {edges[0]} THEN 0"]
    for i in range(1, len(edges)):
        parts.append(f"WHEN {c} > {edges[i-1]} AND {c} <= {edges[i]} THEN {i}")
    return "CASE " + " ".join(parts) + " ELSE 1 END"


NUMERIC_SQL = {
    "_price": _parse_num("price"),
    "_rating": _parse_num("rating"),
    "_revn": _parse_num("total_reviews"),
    "_weight": _parse_num("weight"),
    "_batt": "TRY_CAST(battery_power_rating AS DOUBLE)",
    "_ravg": _rev_rating("reviews_rating"),
    "_rcnt": "CAST(CASE WHEN reviews IS NULL THEN 0 ELSE len(string_split(reviews, '||')) END AS DOUBLE)",
}


def _tfidf(text: str, limit: int, bigrams: bool) -> str:
    pat = q(TOKEN_PATTERN)
    toks = f"regexp_extract_all(lower(coalesce({text}, '')), {pat})"
    terms = f"""
t0 AS (SELECT product_id, unnest({toks}) AS term, generate_subscripts({toks}, 1) AS pos FROM products),
t1 AS (SELECT product_id, term, row_number() OVER (PARTITION BY product_id ORDER BY pos) AS p
       FROM t0 WHERE term NOT IN (SELECT w FROM {STOPS})),"""
    if bigrams:
        terms += """
terms AS (SELECT product_id, term FROM t1 UNION ALL
          SELECT a.product_id, a.term || ' ' || b.term FROM t1 a JOIN t1 b
          ON a.product_id = b.product_id AND b.p = a.p + 1),"""
    else:
        terms += "\nterms AS (SELECT product_id, term FROM t1),"
    return f"""SELECT * FROM (WITH {terms}
tf AS (SELECT product_id, term, count(*) AS tf FROM terms GROUP BY product_id, term),
vocab AS (SELECT term, sum(tf) AS cf, count(*) AS df FROM tf GROUP BY term
          ORDER BY cf DESC, term ASC LIMIT {limit}),
nd AS (SELECT count(*) AS n FROM products),
w AS (SELECT tf.product_id, tf.term, tf.tf * (ln((1.0 + nd.n) / (1.0 + v.df)) + 1.0) AS w
      FROM tf JOIN vocab v ON v.term = tf.term CROSS JOIN nd),
norms AS (SELECT product_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY product_id)
SELECT w.product_id, w.term, round_even(w.w / norms.norm, 6) AS weight
FROM w JOIN norms ON norms.product_id = w.product_id) x"""


_SAMPLE300 = f"""(SELECT vec_id, label, embedding FROM embeddings
  ORDER BY {_hash('vec_id')}, vec_id LIMIT 300)"""

_STAR_VS_LABEL = f"""
, sv AS (
  SELECT CAST({_bins('star_rating', [2.5, 3.5, 5.01])} AS DOUBLE) AS label,
    CAST(CASE sentiment WHEN 'Negative' THEN 0 WHEN 'Neutral' THEN 1 WHEN 'Positive' THEN 2 END AS DOUBLE)
      AS prediction, star_rating, compound
  FROM scored WHERE star_rating IS NOT NULL)"""

ORACLE.update({
    "median_impute": with_base(f"""
SELECT product_id, {', '.join(f'coalesce({k}, median({k}) OVER ()) AS {k}' for k in NUMERIC_SQL)}
FROM (SELECT product_id, {', '.join(f'{v} AS {k}' for k, v in NUMERIC_SQL.items())} FROM products) x"""),
    "label_encode": with_base("""
SELECT product_id, manufacturer,
  CAST(dense_rank() OVER (ORDER BY coalesce(manufacturer, 'Unknown')) - 1 AS INTEGER) AS manufacturer_code
FROM products"""),
    "rating_bins": with_base(f"""
SELECT product_id, {_parse_num('rating')} AS rating_num,
  {_bins(_parse_num('rating'), [2, 3, 4, 5.01])} AS rating_bin,
  {_bins(_rev_rating('reviews_rating'), [2.5, 3.5, 5.01])} AS review_bin
FROM products"""),
    "rare_class_filter": with_base("""
SELECT * FROM (WITH y AS (SELECT product_id, title, coalesce(title, 'Unknown') AS v FROM products),
top AS (SELECT v FROM y GROUP BY v ORDER BY count(*) DESC, v ASC LIMIT 15),
m AS (SELECT product_id, title, CASE WHEN v IN (SELECT v FROM top) THEN v ELSE 'Other' END AS title_class FROM y)
SELECT * FROM m WHERE title_class IN (SELECT title_class FROM m GROUP BY title_class HAVING count(*) >= 4)) x"""),
    "prepare_target": with_base(f"""
SELECT product_id, CAST({_bins('v', [2, 3, 4, 5.01])} AS DOUBLE) AS y
FROM (SELECT product_id, {_parse_num('rating')} AS v FROM products) x WHERE v IS NOT NULL"""),
    "tfidf_titles": with_base(_tfidf("title", 60, False)),
    "tfidf_bigrams": with_base(_tfidf("coalesce(reviews, 'no review')", 500, True)),
    "standardize": with_base("""
SELECT product_id,
  round_even((reviews_count - avg(reviews_count) OVER ()) / stddev_pop(reviews_count) OVER (), 6) AS reviews_count,
  round_even((ram_gb - avg(ram_gb) OVER ()) / stddev_pop(ram_gb) OVER (), 6) AS ram_gb
FROM products"""),
    "sample_rows": f"SELECT vec_id, label FROM embeddings ORDER BY {_hash('vec_id')}, vec_id LIMIT 300",
    "split_stratified": with_base(f"""
SELECT y, is_test, count(*) AS rows FROM (
  SELECT y, row_number() OVER (PARTITION BY y ORDER BY {_hash('product_id')}, product_id)
            <= (2 * count(*) OVER (PARTITION BY y) + 5) // 10 AS is_test
  FROM (SELECT product_id, CAST({_bins('v', [2, 3, 4, 5.01])} AS DOUBLE) AS y
        FROM (SELECT product_id, {_parse_num('rating')} AS v FROM products) a WHERE v IS NOT NULL) c) b
GROUP BY y, is_test"""),
    "content_knn": f"""
WITH s AS {_SAMPLE300},
u AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
nrm AS (SELECT vec_id, sqrt(sum(x * x)) AS n FROM u GROUP BY vec_id),
un AS (SELECT u.vec_id, u.i, CASE WHEN nrm.n > 0 THEN u.x / nrm.n ELSE 0.0 END AS x
       FROM u JOIN nrm ON nrm.vec_id = u.vec_id),
sim AS (SELECT a.vec_id AS qv, b.vec_id AS cv, round_even(sum(a.x * b.x), 6) AS sim
        FROM un a JOIN (SELECT * FROM un WHERE vec_id IN (SELECT vec_id FROM s)) b
        ON a.i = b.i AND a.vec_id <> b.vec_id GROUP BY a.vec_id, b.vec_id),
top AS (SELECT qv, cv FROM (SELECT *, row_number() OVER (PARTITION BY qv ORDER BY sim DESC, cv ASC) AS r
        FROM sim) z WHERE r <= 5),
votes AS (SELECT t.qv, s.label AS nbr_y, count(*) AS votes FROM top t JOIN s ON s.vec_id = t.cv
          GROUP BY t.qv, s.label),
pred AS (SELECT qv, nbr_y FROM (SELECT *, row_number() OVER (PARTITION BY qv ORDER BY votes DESC, nbr_y ASC)
         AS rr FROM votes) z WHERE rr = 1)
SELECT s.vec_id, CAST(s.label AS DOUBLE) AS label, CAST(pred.nbr_y AS DOUBLE) AS prediction
FROM embeddings s JOIN pred ON pred.qv = s.vec_id""",
    "weighted_metrics": with_scored(_STAR_VS_LABEL + """,
conf AS (SELECT label AS l, prediction AS p, count(*) AS n FROM sv GROUP BY label, prediction),
bl AS (SELECT l, sum(n) AS support, sum(CASE WHEN l = p THEN n END) AS tp, sum(n * (l - p) ^ 2) AS sq
       FROM conf GROUP BY l),
bp AS (SELECT p AS l, sum(n) AS predicted FROM conf GROUP BY p),
per AS (SELECT bl.support, coalesce(bl.tp, 0) AS tp, bl.sq,
          CASE WHEN bp.predicted > 0 THEN coalesce(bl.tp, 0) / bp.predicted ELSE 0.0 END AS pr,
          coalesce(bl.tp, 0) / bl.support AS re
        FROM bl LEFT JOIN bp ON bp.l = bl.l),
per2 AS (SELECT *, CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0.0 END AS f1 FROM per)
SELECT round_even(sum(tp) / sum(support), 6) AS accuracy,
  round_even(sum(support * pr) / sum(support), 6) AS "precision",
  round_even(sum(support * re) / sum(support), 6) AS recall,
  round_even(sum(support * f1) / sum(support), 6) AS f1,
  round_even(sqrt(sum(sq) / sum(support)), 6) AS rmse, CAST(sum(support) AS BIGINT) AS rows
FROM per2"""),
    "regression_metrics": with_scored(_STAR_VS_LABEL + """,
rp AS (SELECT star_rating AS y, 3.0 + 2.0 * compound AS p FROM sv),
agg AS (SELECT sqrt(avg((y - p) ^ 2)) AS rmse, sum((y - p) ^ 2) AS sse,
          sum(y * y) - sum(y) * sum(y) / count(*) AS sst,
          avg(greatest(0.0, 1 - abs(p - y) / (abs(y) + 1e-6))) AS closeness, count(*) AS rows FROM rp),
r AS (SELECT *, CASE WHEN sst > 0 THEN 1 - sse / sst ELSE 0.0 END AS r2 FROM agg)
SELECT round_even(rmse, 6) AS rmse, round_even(r2, 6) AS r2, round_even(greatest(0.0, r2), 6) AS r2_clipped,
  round_even(closeness, 6) AS closeness, rows FROM r"""),
    "event_windows": """
SELECT date_trunc('day', ts) AS window_start, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end,
  event_type, count(*) AS events, round_even(avg(value), 6) AS mean_value
FROM events GROUP BY date_trunc('day', ts), event_type""",
})


def _list(items: list[str]) -> str:
    return "[" + ", ".join(q(x) for x in items) + "]"


RESULTS = f"""
r AS (SELECT event_type AS target, list_position({_list(EVENT_TYPES)}, event_type) AS target_order,
             ({_list(WEEKDAYS)})[isodow(ts)] AS model, isodow(ts) - 1 AS model_order,
             count(CASE WHEN value >= {SCORE_AT} THEN 1 END) / count(value) AS score
      FROM events GROUP BY ALL),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY score DESC, model_order) AS k FROM r) x
         WHERE k = 1)"""

ORACLE.update({
    "product_detail": with_base("""
SELECT p.product_id, p.title, p.category,
  coalesce('₹' || format('{:,}', CAST(trunc(price_clean) AS BIGINT)), 'N/A') AS price,
  coalesce(printf('%.1f / 5', rating_clean), 'N/A') AS rating,
  coalesce(CAST(CAST(trunc(ram_gb) AS BIGINT) AS VARCHAR) || ' GB', 'N/A') AS ram,
  coalesce(CAST(CAST(trunc(TRY_CAST(battery_power_rating AS DOUBLE)) AS BIGINT) AS VARCHAR) || ' mAh', 'N/A') AS battery,
  coalesce(r.n, 0) AS reviews, coalesce(printf('%.1f / 5', r.stars), 'N/A') AS stars
FROM products p LEFT JOIN (SELECT product_id, count(*) AS n, avg(star_rating) AS stars FROM reviews GROUP BY product_id) r
  USING (product_id)"""),
    "model_scoreboard": f"""
WITH {RESULTS},
w AS (SELECT model, count(*) AS wins, min(target_order) AS first_win FROM best GROUP BY model),
top AS (SELECT * FROM best ORDER BY score DESC, target_order LIMIT 1),
win AS (SELECT * FROM w ORDER BY wins DESC, first_win LIMIT 1)
SELECT round((SELECT avg(score) FROM best), 9) AS mean_best_score, (SELECT count(*) FROM best) AS targets,
       top.target AS best_target, top.model AS best_model, round(top.score, 9) AS best_score,
       win.model AS most_frequent_winner, win.wins AS winner_count FROM top, win""",
    "best_per_target": f"""
WITH {RESULTS}, t AS (SELECT unnest({_list(EVENT_TYPES + ["none"])}) AS target)
SELECT t.target, round(coalesce(score, 0.0), 9) AS score, coalesce(model, 'N/A') AS model
FROM t LEFT JOIN best USING (target)""",
    "score_shares": f"""
WITH {RESULTS},
f AS (SELECT target, model, CAST(model_order AS INTEGER) AS model_order, score,
        score - avg(score) OVER t AS deviation, score - coalesce(lag(score) OVER o, 0.0) AS step,
        coalesce(lag(score) OVER o, 0.0) AS step_base, score / sum(score) OVER t AS share,
        score / max(score) OVER t AS ratio_to_best,
        CAST(row_number() OVER (PARTITION BY target ORDER BY score DESC, model_order) AS INTEGER) AS rank
      FROM r WINDOW t AS (PARTITION BY target), o AS (PARTITION BY target ORDER BY model_order)),
g AS (SELECT *, coalesce(sum(share) OVER (PARTITION BY target ORDER BY model_order
                                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS share_offset,
             greatest(1, CAST(round_even(share * 100, 0) AS INTEGER)) AS p FROM f),
h AS (SELECT *, sum(CASE WHEN rank <> 1 THEN p ELSE 0 END) OVER (PARTITION BY target) AS others FROM g)
SELECT target, model, model_order, rank, round(score, 9) AS score, round(deviation, 9) AS deviation, round(step, 9) AS step,
       round(step_base, 9) AS step_base, round(share, 9) AS share, round(ratio_to_best, 9) AS ratio_to_best,
       round(share_offset, 9) AS share_offset,
       CAST(CASE WHEN rank = 1 THEN greatest(0, 100 - others) ELSE p END AS BIGINT) AS pct FROM h""",
    "score_matrix": f"""
WITH {RESULTS},
f AS (SELECT model, min(target_order * 100 + model_order) AS seen,
        {", ".join(f"round(max(CASE WHEN target = {q(t)} THEN score * 100 END), 9) AS {t}" for t in EVENT_TYPES)}
      FROM r GROUP BY model)
SELECT * EXCLUDE (seen), CAST(row_number() OVER (ORDER BY seen, model) AS INTEGER) AS first_seen FROM f""",
})

from .training_oracle import ORACLE as TRAINING_ORACLE  # noqa: E402

ORACLE.update(TRAINING_ORACLE)
ORACLE["scored_update"] = with_scored(
    "SELECT product_id, CAST(review_pos AS INTEGER) AS review_pos, category, sentiment, compound, star_rating FROM scored")
ORACLE["sentiment_windows"] = with_scored("""
SELECT date_trunc('day', ts) AS window_start, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end, sentiment,
  count(*) AS reviews, round_even(CAST(sum(CAST(round(compound * 10000) AS BIGINT)) AS DOUBLE) / count(*) / 10000, 6) AS mean_compound
FROM (SELECT *, TIMESTAMP '2024-01-01' + to_hours(CAST((product_id % 40) * 24 + review_pos * 7 AS INTEGER)) AS ts FROM scored) s
GROUP BY date_trunc('day', ts), sentiment""")
ORACLE["product_by_title"] = with_base("""
SELECT title, product_id, category, price_clean, rating_clean FROM products
WHERE title IS NOT NULL QUALIFY row_number() OVER (PARTITION BY title ORDER BY product_id) = 1""")
ORACLE["filter_options"] = with_base(" UNION ALL ".join(f"""
SELECT '{c}' AS filter, {c} AS value, CAST(row_number() OVER (ORDER BY {c}) - 1 AS INTEGER) AS place
FROM (SELECT DISTINCT {c} FROM products WHERE {c} IS NOT NULL) {c}_values""" for c in ("category", "manufacturer", "os")))
ORACLE["score_bubbles"] = f"""
WITH {RESULTS}
SELECT target, model, round_even(greatest(400.0, pow(score * 100, 1.85)), 6) AS bubble FROM r WHERE score IS NOT NULL"""
