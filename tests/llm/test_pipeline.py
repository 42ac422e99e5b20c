"""The pipeline against a stage-by-stage brute force; queries and their SQL."""
import hashlib
import os
import re
import sys

import duckdb
import public_tokenizers
import pytest
from tokenizers import Tokenizer

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tools"))

import corpus_pipeline  # noqa: E402
from sentiscope.llm import pii, quality_rules  # noqa: E402
from sentiscope.llm.catalog import ORACLE, QUERIES  # noqa: E402

from .test_group_operators import brute_components  # noqa: E402
from .test_text_operators import brute_hits  # noqa: E402

SF = "/root/testdata/sf0.001"


def brute_rules(text):
    """The verdict of one text, rule by rule."""
    t = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
    lines = [x for x in t.split("\n") if re.sub(r"[\x20\x09-\x0D]+", "", x)]
    wins = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    twice = {w for w in wins if wins.count(w) > 1} if len(set(wins)) < len(wins) else set()
    repeat = len({i + k for i, w in enumerate(wins) if w in twice for k in range(5)})
    if len(words) < 10 or 100 * repeat > 20 * len(words):
        return False
    stops = set(quality_rules.STOP_WORDS) | {w.capitalize() for w in quality_rules.STOP_WORDS}
    m = {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in quality_rules.SYMBOLS for c in t),
         "n_exclaim": t.count("!"), "n_stop_words": sum(w in stops for w in words), "n_lines": len(lines),
         "n_dup_lines": len(lines) - len(set(lines)),
         "n_bullet_lines": sum(bool(re.match("^ *[-*•]", x)) for x in lines),
         "n_ellipsis_lines": sum(bool(re.search(r"(\.\.\.|…) *$", x)) for x in lines)}
    for r in quality_rules.RULES:
        low = r.low is not None and 100 * m[r.measure] < r.low * m[r.base]
        high = r.high is not None and 100 * m[r.measure] > r.high * m[r.base]
        if len(words) >= r.min_words and (low or high):
            return False
    return True


def test_pipeline_matches_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    docs = [d for d in docs if brute_rules(d[1])]
    kept = {k[0] for k in brute_components([(d[0], d[1]) for d in docs], 80, 100) if k[3]}
    docs = [d for d in docs if d[0] in kept]
    bad = {h[0] for h in brute_hits([(d[0], d[1]) for d in docs], items) if h[5]}
    docs = [d for d in docs if d[0] not in bad]
    tagger, lib = pii.Tagger(pii.train()), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {}
    for doc_id, text, lang, source in docs:
        clean = pii.masked(text, next(pii.find_spans([text], tagger))[1])
        ids = lib.encode(clean, add_special_tokens=False).ids
        want[doc_id] = (lang, source, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                        hashlib.sha256(clean.encode()).hexdigest(), ids)
    got = {r["doc_id"]: tuple(r)[1:] for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want and len(want) > 100


def test_stages_keep_the_columns(spark, edge_docs, no_docs):
    for docs, rows in ((edge_docs, None), (no_docs, 0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns
            assert rows is None or out.count() == rows


def test_names():
    assert [n for n in QUERIES if n.startswith("op")] and len(corpus_pipeline.STAGES) == 5
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES} == set(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_queries_match_their_sql(spark, name):
    import oracle_check
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = QUERIES[name](spark, SF)
    res = con.execute(ORACLE[name])
    cols = [d[0] for d in res.description]
    assert sorted(cols) == sorted(df.columns)
    assert oracle_check.digest(df.columns, [tuple(r) for r in df.collect()]) == oracle_check.digest(cols, res.fetchall())
