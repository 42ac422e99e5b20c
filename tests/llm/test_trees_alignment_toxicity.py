"""Merkle manifest, cross-tokenizer alignment and toxicity against brute force."""
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from sentiscope.llm import alignment, merkle, toxicity
from sentiscope.llm.catalog import tokenizer


# --- Merkle manifest -----------------------------------------------------------

def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row, text):
    values = (row[0], row[3], row[2], row[4], text)
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_levels(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][k:k + 3]) for k in range(0, len(levels[-1]), 3)])
    return levels


def plain_path(levels, i):
    path = []
    for nodes in levels[:-1]:
        at = i // 3 * 3
        path.append((i - at, [x for k, x in enumerate(nodes[at:at + 3]) if k != i - at]))
        i //= 3
    return path


def plain_manifest(rows):
    """Rows of the query from (doc_id, text, lang, source, n_chars)."""
    by_source = {}
    for r in rows:
        by_source.setdefault(r[3], []).append(r)
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees, order = {}, {}
    for s in sources:
        order[s] = sorted(by_source[s], key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r, r[1])))
        trees[s] = plain_levels([plain_leaf(r, r[1]) for r in order[s]])
    top = plain_levels([trees[s][-1][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        for i, r in enumerate(order[s]):
            path = plain_path(trees[s], i) + plain_path(top, k)
            cut = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[1] is not None
            node = plain_leaf(r, r[1].replace("\n", "") if cut else r[1])
            for place, siblings in path:
                node = h(*siblings[:place], node, *siblings[place:])
            out.append((r[0], trees[s][0][i], trees[s][-1][0], top[-1][0], h(*(x for _, p in path for x in p)),
                        node, node == top[-1][0]))
    return out


def many_rows():
    rng = random.Random(5)
    rows = [(i, f"text\n{i % 7} line\n" * (i % 3), "en", f"s{rng.choice([0, 0, 0, 1, 2, 3])}", i) for i in range(400)]
    rows += [(1000 + i, "alone", None, f"é{i}", None) for i in range(50)] + [(7, "same\nrow", "de", "s0", 1)] * 60
    return rows + [(None, None, None, None, None), (None, "\n", "fr", None, 2), (3, "", None, "", 0)]


@pytest.mark.parametrize("part_rows", [5, 40, 20_000])
def test_proofs_match_plain_trees(spark, monkeypatch, part_rows):
    monkeypatch.setattr(merkle, "PART_ROWS", part_rows)
    monkeypatch.setattr(merkle, "DEPTH", 2)
    rows = many_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    assert Counter(map(tuple, merkle.verify_documents(docs).collect())) == Counter(plain_manifest(rows))


def test_manifest_of_edge_rows(spark, edge_docs, edge_rows, no_docs):
    assert Counter(map(tuple, merkle.verify_documents(edge_docs).collect())) == Counter(plain_manifest([r[:5] for r in edge_rows]))
    assert merkle.verify_documents(no_docs).count() == 0 and merkle.manifest(no_docs).root() is None
    one = spark.createDataFrame([(1, "a\nb", "en", "s", 3)], "doc_id long, text string, lang string, source string, n_chars long")
    m = merkle.manifest(one)
    got = merkle.proofs(m, paths=True).first()
    assert got["leaf"] == got["subroot"] == got["root"] == m.root() and got["proof"] == [] and got["proof_sha256"] == h("")


def test_missing_coordinates_are_minimal():
    for n in range(1, 60):
        levels = [n]
        while levels[-1] > 1:
            levels.append(-(-levels[-1] // 3))
        for first in range(0, n, 4):
            for last in range(first, n, 5):
                known, want = set(range(first, last + 1)), set()
                for level, size in enumerate(levels[:-1]):
                    needed = {c for k in known for c in range(k // 3 * 3, min(k // 3 * 3 + 3, size))}
                    want |= {(level, c) for c in needed - known}
                    known = {k // 3 for k in known}
                assert sorted(want) == sorted(merkle.missing(first, last, n))


# --- alignment -----------------------------------------------------------------

@pytest.fixture(scope="module")
def tok():
    return alignment.Tokenizers(tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"))


def brute_alignment(texts, tok):
    """Every column from the libraries' ids and all pairs of tokens."""
    import sentencepiece
    from tokenizers import Tokenizer
    lib = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    lib.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer("piece_bpe_32k.model"))
    rows, held = [], Counter()
    for t in texts:
        rows.append(None)
        if not t:
            continue
        whole = (" " + t).encode()
        a, b = lib.encode(" " + t, add_special_tokens=False).ids, sp.encode(t)
        a_bytes, b_bytes = [tok.a_bytes[i] for i in a], [tok.b_bytes[i] for i in b]
        if b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
            continue
        a_end, b_end = np.cumsum([len(x) for x in a_bytes]).tolist(), np.cumsum([len(x) for x in b_bytes]).tolist()
        groups, i, j = [], 0, 0
        for c in sorted(set(a_end) & set(b_end)):
            i2, j2 = a_end.index(c) + 1, b_end.index(c) + 1
            groups.append(",".join(map(str, a[i:i2])) + "|" + ",".join(map(str, b[j:j2])))
            i, j = i2, j2
        links = [(a[i], b[j]) for i in range(len(a)) for j in range(len(b))
                 if b_end[j] - len(b_bytes[j]) < a_end[i] and b_end[j] > a_end[i] - len(a_bytes[i])]
        rows[-1] = (len(a), len(b), groups, links)
        held.update(set(links))
    most = {}
    for (i, _), n in held.items():
        most[i] = max(most.get(i, 0), n)
    return [(0,) * 6 + ("",) if r is None else
            (r[0], r[1], len(r[2]), len(r[3]), sum(held[p] == most[p[0]] for p in r[3]), sum(held[p] for p in r[3]),
             hashlib.sha256(";".join(r[2]).encode()).hexdigest()) for r in rows]


PARTS = ["a", "b", "the", " ", " ", "  ", "\n", "\t", "é", "中", "ß", "▁", "<|endoftext|>", "<s>", "<0x41>", "12", "'s", "!",
         "　", "\xa0", "\x85", "᠎", "\x1c", "​", "😀", "ing", "\0", ".", " \n"]


def test_alignment_matches_brute_force(spark, tok, monkeypatch):
    rng = random.Random(3)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    texts += [None, "", " ", "  ", "▁", "a▁ b", "\0", "same words here"] + ["same words here"] * 5
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    monkeypatch.setattr(alignment, "CHUNK_DOCS", 50)
    got = {r["doc_id"]: tuple(r)[1:] for r in
           alignment.align(docs, tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model")).collect()}
    assert [got[i] for i in range(len(texts))] == brute_alignment(texts, tok)


def test_alignment_of_edge_rows(spark, edge_docs, edge_rows, no_docs, tok):
    paths = tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model")
    got = alignment.align(edge_docs, *paths).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in edge_rows)
    short = [r for r in edge_rows if len(r[1] or "") < 5000]
    docs = spark.createDataFrame([(r[0], r[1]) for r in short], "doc_id long, text string")
    want = brute_alignment([r[1] for r in short], tok)
    assert Counter(map(tuple, alignment.align(docs, *paths).collect())) == Counter((r[0], *w) for r, w in zip(short, want))
    assert alignment.align(no_docs, *paths).count() == 0
    long = next(r for r in got if r["doc_id"] == 11)
    assert long["n_a"] > 0 and long["n_links"] == long["n_a"] + long["n_b"] - long["n_groups"]


def test_chunk_is_aligned_in_small_parts(tok, monkeypatch):
    import tracemalloc
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(2000)]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 800))) for _ in range(500)] + [None, "", "▁"]
    alignment.align_chunk(tok, texts)  # all words are kept now
    tracemalloc.start()
    small = alignment.align_chunk(tok, texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(len(t or "") for t in texts) > 4 * alignment.PART_CHARS and peak < 60e6
    for chars in (1, 10_000, 1 << 40):  # the last one: all texts at once
        monkeypatch.setattr(alignment, "PART_CHARS", chars)
        part = alignment.align_chunk(tok, texts)
        assert all(np.array_equal(small[k], part[k]) for k in small)


def test_totals_take_one_chunk_at_a_time(spark, tok, monkeypatch):
    monkeypatch.setattr(alignment, "CHUNK_DOCS", 3)
    docs = spark.createDataFrame([(i, f"word{i % 5} and more") for i in range(30)], "doc_id long, text string").coalesce(1)
    whole = alignment.align(docs, tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"))
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "collect_list" not in plan and "MapInArrow _totals" not in plan
    assert whole.count() == 30


def test_shared_cuts_of_any_intervals():
    rng = np.random.default_rng(1)
    for reach in (1, 2, 7):
        for _ in range(300):
            a, b = (np.unique(rng.integers(1, 80, rng.integers(1, 60))) for _ in range(2))
            x, y = alignment.shared_cuts(a, b, reach)
            assert a[x].tolist() == b[y].tolist() == sorted(set(a.tolist()) & set(b.tolist()))
    far = np.arange(1, 2_000_002, 2)  # no cut but the last one
    x, y = alignment.shared_cuts(far, np.append(far[:-1] + 1, far[-1]))
    assert x.tolist() == y.tolist() == [len(far) - 1]


# --- toxicity ------------------------------------------------------------------

def test_nearest_is_exact():
    rng = np.random.default_rng(2)
    for _ in range(20):
        terms, n = 40, int(rng.integers(1, 300))
        dense = rng.random((n, terms)) * (rng.random((n, terms)) < 0.1)
        dense[np.arange(n), rng.integers(0, terms, n)] += 0.5
        dense[n // 2:] = dense[:n - n // 2]  # ties
        dense /= np.linalg.norm(dense, axis=1)[:, None]
        index = toxicity.BlockMaxIndex([(np.flatnonzero(v), v[v > 0]) for v in dense], terms)
        for q in dense[:10]:
            found, cosines = index.nearest(np.flatnonzero(q), q[q > 0], 7)
            cos = np.round(dense @ q, 12)
            want = [i for i in np.lexsort((np.arange(n), -cos)) if cos[i] > 0][:7]
            assert found.tolist() == want and np.allclose(cosines, np.minimum(cos[want], 1))
            assert 0 not in index.nearest(np.flatnonzero(q), q[q > 0], 7, leave_out=0)[0]


def corpus(n=900):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(400)]
    rows, marks = [], []
    for i in range(n):
        bad = rng.random() < 0.2
        text = [rng.choice(words) for _ in range(rng.randint(20, 80))]
        for _ in range(rng.randint(2, 4) * bad):
            text.insert(rng.randrange(len(text)), rng.choice(["zonk", "yuckling", "yuckles", "xiff"]))
        rows.append((i, " ".join(text), "en", "s", 0))
        marks.append((i, 1, int(bad)))
    return rows, marks


def test_toxicity_on_held_out_labels(spark):
    rows, marks = corpus()
    clean = " ".join(rows[next(i for i, m in enumerate(marks) if not m[2])][1].split())
    rows += [(5000 + i, clean, "en", "s", 0) for i in range(300)]  # a large group of copies
    marks += [(5000 + i, 1, 0) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    truth = {m[0]: m[2] for m in marks}
    got = toxicity.score_documents(docs, labels, evidence=3).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    out = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in out) >= 0.97 * len(out)
    known = {str(i) for i in truth if zlib.crc32(str(i).encode()) % 5}
    for r in got:
        assert len(r["evidence"]) <= 3 and all(e["id"] in known and 0 < e["cosine"] <= 1 + 1e-9 for e in r["evidence"])
    # labels of held-out rows, language and source have no say
    other = spark.createDataFrame([(m[0], 0, 1 - m[2] if str(m[0]) not in known else m[2]) for m in marks],
                                  "doc_id long, quality int, toxic int")
    again = toxicity.score_documents(docs.selectExpr("doc_id", "text", "'xx' lang", "cast(doc_id as string) source"), other)
    assert {r["doc_id"]: r["score"] for r in again.collect()} == {r["doc_id"]: r["score"] for r in got}


def test_terms_and_scores_match_brute_force(spark):
    rows, marks = corpus(300)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    learnt = [(toxicity.term_counts(r[1]), m[2]) for r, m in zip(rows, marks) if zlib.crc32(str(r[0]).encode()) % 5]
    n, n_1 = len(learnt), sum(y for _, y in learnt)

    def g2(term):
        x, x_1 = sum(term in c for c, _ in learnt), sum(term in c for c, y in learnt if y)
        cells = ((x_1, x * n_1 / n), (x - x_1, x * (n - n_1) / n), (n_1 - x_1, (n - x) * n_1 / n),
                 (n - n_1 - x + x_1, (n - x) * (n - n_1) / n))
        lift = x_1 / x * n / n_1
        if x < toxicity.LEAST_DOCS or 1 / toxicity.LEAST_LIFT < lift < toxicity.LEAST_LIFT:
            return 0
        return 2 * sum(o * np.log(o / e) for o, e in cells if o)

    names = model.terms.names
    assert names == sorted(t for t in {t for c, _ in learnt for t in c} if g2(t) >= toxicity.LEAST_G2)
    df = [sum(t in toxicity.term_counts(r[1]) for r in rows) for t in names]
    assert np.allclose(model.idf, np.log(1 + len(rows) / np.array(df)))
    vectors = [model.vector({names.index(t): n for t, n in c.items() if t in names}) for c, _ in learnt]
    for r in rows[:40]:
        term, weight = model.vector(model.terms.counts(r[1]))
        q = dict(zip(term.tolist(), weight))
        cos = sorted((sum(q.get(t, 0) * w for t, w in zip(*v)) for v in vectors), reverse=True)
        got = model.index.nearest(term, weight, 10)[1]
        assert np.allclose(got, [c for c in cos if c > 0][:10])


def test_toxicity_edge_cases(spark, edge_docs, edge_rows, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame([(1, 1, 1), (7, None, None), (None, 1, 0), (8, 0, 1)], "doc_id long, quality int, toxic int")
    for labels, score in ((none, 0.0), (one, 1.0)):
        got = toxicity.score_documents(edge_docs, labels).collect()
        assert len(got) == len(edge_rows) and {r["score"] for r in got} == {score}
    rows, marks = corpus(300)
    docs = edge_docs.select("doc_id", "text").unionByName(
        spark.createDataFrame([(100 + r[0], r[1]) for r in rows], "doc_id long, text string"))
    labels = spark.createDataFrame([(100 + m[0], m[1], m[2]) for m in marks] + [(100, 1, 0), (100, 1, 1)],
                                   "doc_id long, quality int, toxic int")
    got = toxicity.score_documents(docs, labels).collect()
    assert len(got) == len(edge_rows) + len(rows)
    assert len({r["score"] for r in got if r["doc_id"] in (4, 5, 6)}) == 1
    assert toxicity.score_documents(no_docs, labels).count() == 0
