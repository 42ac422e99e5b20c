"""Quality rules, decontamination, personal data, BPE, token files, language, quality model."""
import hashlib
import json
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sentiscope.llm import bpe, decontaminate, langid, pii, quality_model, quality_rules, token_store
from sentiscope.llm.catalog import tokenizer

SF = "/root/testdata/sf0.001"
ALPHABET = list("abcXYZ \n\t\r\x0b\x0c.,'!?019éßñ中文字한  　\x85́İſΣς😀‍#$%&*<|>/@-_()[]\x00\x1cª²") + [
    "'s", "'ll", " 's", "<|endoftext|>", "<|startoftext|>", "  ", "   \n", "ing", "tion", "The "]


def texts_of(rnd, n, alphabet=ALPHABET, longest=40):
    return ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, longest))) for _ in range(n)]


# --- quality rules ---------------------------------------------------------------

def brute_measures(text):
    t = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
    lines = [x for x in t.split("\n") if re.sub(r"[\x20\x09-\x0D]+", "", x)]
    wins = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    c = Counter(wins)
    covered = {i + k for i, w in enumerate(wins) if c[w] > 1 for k in range(5)}
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(x in "#*$%&|<>" for x in t),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered)}


def test_quality_measures_match_brute_force(spark, edge_docs, edge_rows):
    got = quality_rules.quality_report(edge_docs).toPandas()
    assert len(got) == len(edge_rows)
    want = [brute_measures(r[1]) for r in edge_rows]
    cols = list(want[0])
    assert Counter(map(tuple, got[cols].to_numpy().tolist())) == Counter(tuple(w[c] for c in cols) for w in want)
    failed = (got.n_words < 10) | (100 * got.n_repeat_words > 20 * got.n_words)
    assert (got.base_failed == failed).all() and not (got.kept & got.base_failed).any()


def test_repeat_words_random(spark):
    rnd = random.Random(5)
    texts = [" ".join(rnd.choice("ab") for _ in range(rnd.randint(0, 40))) for _ in range(200)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = quality_rules.quality_report(df).toPandas().set_index("doc_id")
    assert all(got.n_repeat_words[i] == brute_measures(t)["n_repeat_words"] for i, t in enumerate(texts))


def test_apply_rules_keeps_rows_unchanged(spark, edge_docs, no_docs):
    out = quality_rules.apply_rules(edge_docs)
    assert out.columns == edge_docs.columns
    kept = {r["doc_id"] for r in quality_rules.quality_report(edge_docs).where("kept").collect()}
    rows = out.collect()
    assert {r["doc_id"] for r in rows} == kept and all(r["n_words"] == 7 for r in rows)
    assert quality_rules.apply_rules(no_docs).count() == 0


def test_rules_separate_labelled_documents(spark):
    got = quality_rules.quality_report(spark.read.parquet(f"{SF}/documents.parquet")).toPandas()
    m = got.merge(pd.read_parquet(f"{SF}/labels.parquet"), on="doc_id")
    long = m[m.n_words >= 10]
    assert long[long.quality == 1].kept.mean() >= 0.98 and long[long.quality == 0].kept.mean() <= 0.1


# --- decontamination --------------------------------------------------------------

def norm(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered) if w]


def brute_hits(docs, items):
    wins = {}
    for item, text in items:
        w = norm(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            wins.setdefault((n, tuple(w[i:i + n])), set()).add(str(item))
    sizes = {n for n, _ in wins}
    out = []
    for doc_id, text in docs:
        w, hit, found = norm(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (n, tuple(w[i:i + n])) in wins:
                    hit.update(range(i, i + n))
                    found |= wins[n, tuple(w[i:i + n])]
        ids = ",".join(sorted(found))
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return out


ITEMS = [(1, "Alpha3 beta3 alpha4 beta4 alpha5 beta5 alpha6 beta6 alpha7 beta7 ALPHA8"), (2, "one"), (10, "C, D!"),
         (3, None), (4, ""), (5, "..."), (6, "nowhere to be seen at all in any of these documents here"), (2, "one")]


def test_decontamination_matches_brute_force(spark, edge_docs, edge_rows, no_docs):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontaminate.hit_report(edge_docs, bench).collect()
    assert Counter(map(tuple, got)) == Counter(brute_hits([(r[0], r[1]) for r in edge_rows], ITEMS))
    assert decontaminate.hit_report(no_docs, bench).count() == 0
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.hit_report(edge_docs, empty).where("contaminated").count() == 0
    cleaned = decontaminate.clean_documents(edge_docs, bench)
    assert cleaned.columns == edge_docs.columns
    # rows of one doc_id are judged by their texts, rows without a doc_id too
    clean = [(r[0], r[1]) for r in edge_rows if not brute_hits([(r[0], r[1])], ITEMS)[0][5]]
    assert Counter((r["doc_id"], r["text"]) for r in cleaned.collect()) == Counter(clean)
    assert len(clean) == 12 and (None, None) in clean


def test_remove_spans_cuts_only_hits(spark):
    docs = spark.createDataFrame([(1, "Start here: one, two; three four five six seven eight nine ten. The end."),
                                  (2, "nothing to cut"), (3, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id long, text string")
    got = {r["doc_id"]: r["text"] for r in decontaminate.remove_spans(docs, bench).collect()}
    assert got == {1: "Start here: The end.", 2: "nothing to cut", 3: None}


def test_texts_under_one_id_are_decontaminated_apart(spark):
    hit = "one two three four five six seven eight nine ten"
    rows = [(None, "Start. " + hit), (None, "clean text"), (None, None), (7, hit + " end"), (7, "also clean"), (7, hit), (8, hit), (8, hit)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    items = [(1, hit), (2, "seven eight nine ten end")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert Counter(map(tuple, decontaminate.hit_report(docs, bench).collect())) == Counter(brute_hits(rows, items))
    clean = Counter(map(tuple, decontaminate.clean_documents(docs, bench).collect()))
    assert clean == Counter([(None, "clean text"), (None, None), (7, "also clean")])
    cut = Counter(map(tuple, decontaminate.remove_spans(docs, bench).collect()))
    assert cut == clean + Counter([(None, "Start. "), (7, ""), (7, ""), (8, ""), (8, "")])


# --- personal data ------------------------------------------------------------------

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def passes(kind, found):
    digits = re.sub("[^0-9]", "", found)
    if kind == "ip":
        return all(int(p) <= 255 for p in found.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and pii.luhn(digits)
    return 9 <= len(digits) <= 15 if kind == "phone" else True


def brute_base(text):
    return [(k, m.start(), m.end()) for k in pii.BASE_KINDS for m in re.finditer(PATTERNS[k], text) if passes(k, m[0])]


def test_base_spans_match_the_patterns():
    rnd = random.Random(3)
    for t in texts_of(rnd, 20_000, list("0123456789.+-() @ab_%12..@@é5 \n")):
        assert pii.base_spans(t) == brute_base(t), t


def test_crf_learns_its_table_and_splits_exactly():
    crf = pii.train()
    tagger, whole = pii.Tagger(crf), pii.Tagger(pii.Crf(crf.index, crf.weights, crf.trans))
    whole.crf.gain = np.full_like(crf.gain, 1e9)  # no position is certain: one chain a text
    data = pii.labelled_sentences(pii.LABELLED)
    for (_, tags), got in zip(data, tagger.tags([w for w, _ in data]), strict=True):
        assert [pii.TAGS[t] for t in got] == tags
    texts = [t.split() for t in pd.read_parquet(f"{SF}/documents.parquet").text]
    assert all((a == b).all() for a, b in zip(tagger.tags(texts), whole.tags(texts), strict=True))


def test_viterbi_is_the_best_path():
    import itertools
    rng = np.random.default_rng(1)
    tagger = pii.Tagger(pii.train(["a b"], steps=1))
    tagger.crf.change = rng.normal(size=(len(pii.TAGS),) * 2).astype(np.float32)
    e = rng.normal(size=(4, 3, len(pii.TAGS))).astype(np.float32)
    got, tr = tagger._viterbi(e), tagger.crf.change
    for i in range(4):
        def value(p):
            return sum(e[i, j, t] for j, t in enumerate(p)) + tr[0, p[0]] + tr[p[-1], 0] + sum(tr[a, b] for a, b in zip(p, p[1:]))
        best = max(itertools.product(range(len(pii.TAGS)), repeat=3), key=value)
        assert tuple(got[i]) == best


def test_span_report_and_redaction(spark, edge_docs, edge_rows, no_docs):
    got = pii.span_report(edge_docs).collect()
    assert len(got) == len(edge_rows) and pii.span_report(no_docs).count() == 0
    want = Counter()
    for r in edge_rows:
        base = brute_base(r[1] or "") if len(r[1] or "") < 1000 else []
        if len(r[1] or "") < 1000:
            want[(r[0], *[sum(s[0] == k for s in base) for k in pii.BASE_KINDS],
                  hashlib.sha256(pii._joined(base).encode()).hexdigest())] += 1
    assert not want - Counter((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in got)
    spans = next(r["spans"] for r in got if r["doc_id"] == 14)
    assert spans == "email:18:38,ip:39:47,phone:0:17"
    red = {r["doc_id"]: r for r in pii.redact(edge_docs).collect()}
    assert pii.redact(edge_docs).columns == edge_docs.columns
    assert red[14]["text"] == "[PHONE] [EMAIL] [IP]" and red[14]["n_chars"] == 20
    assert red[4]["text"] is None and red[5]["text"] == "" and red[1]["text"] == next(r[1] for r in edge_rows if r[0] == 1)


# --- BPE ---------------------------------------------------------------------------

def test_bpe_equals_the_library_on_random_texts():
    path = tokenizer("byte_bpe_50k.json")
    own, lib = bpe.ForcedBoundaryBPE(path), Tokenizer.from_file(path)
    for t in texts_of(random.Random(1), 4000):
        ids = lib.encode(t, add_special_tokens=False).ids
        assert own.encode(t).tolist() == ids, t
        assert own.decode(ids) == lib.decode(ids, skip_special_tokens=False)


def test_forced_cuts_lie_inside_no_token():
    own = bpe.ForcedBoundaryBPE(tokenizer("byte_bpe_50k.json"))
    with open(tokenizer("byte_bpe_50k.json"), encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    assert len(own._inside) < 256 * 256 and all(t[i:i + 2] in own._inside for t in vocab for i in range(len(t) - 1))


def test_bpe_query(spark, edge_docs, edge_rows, no_docs):
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = bpe.encode(edge_docs, tokenizer("byte_bpe_50k.json"), ["doc_id", "digest"], with_ids=True)
    want = Counter()
    for r in edge_rows:
        ids = lib.encode(r[1] or "", add_special_tokens=False).ids
        want[(r[0], "digest", len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
              hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest(), tuple(ids))] += 1
    assert Counter((*r[:-1], tuple(r[-1])) for r in out.collect()) == want
    assert bpe.encode(no_docs, tokenizer("byte_bpe_50k.json"), ["doc_id"]).count() == 0


# --- token files ----------------------------------------------------------------------

@pytest.mark.parametrize("n", [1, 255, 256, 257, 5000, 1_050_000])
def test_blocks_round_trip(n):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, 50_000, n).astype(np.uint32)
    ids[rng.random(n) < 0.02] = 2 ** 32 - 1  # exceptions
    blocks = token_store.encode_blocks(ids)
    offsets = np.cumsum([0] + [len(b) for b in blocks])[:-1]
    assert (token_store.decode_blocks(np.frombuffer(b"".join(blocks), np.uint8), offsets) == ids).all()


def test_small_ids_pack_narrow_and_ranges_read_alone():
    ids = np.tile(np.arange(16, dtype=np.uint32), 64) + 1000
    assert all(len(b) <= 8 + 256 * 4 // 8 for b in token_store.encode_blocks(ids))
    w = token_store.FileWriter()
    for i in range(8):
        w.add(i, ids[i * 100:(i + 1) * 100].tobytes())
    r = token_store.FileReader(w.bytes())
    assert (r.ids(250, 613) == ids[250:613]).all() and [d[0] for d in r.documents()] == list(range(8))


def test_words_equal_the_library_on_random_texts():
    path = tokenizer("word_bpe_49k.json")
    own, lib = token_store.WordIds(path), Tokenizer.from_file(path)
    for t in texts_of(random.Random(2), 4000):
        got = np.frombuffer(b"".join(map(own.__getitem__, t.encode().split())), "<u4").tolist()
        assert got == lib.encode(t, add_special_tokens=False).ids, t


def test_token_files_read_back(spark, edge_docs, edge_rows, no_docs):
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = token_store.token_digests(edge_docs, tokenizer("word_bpe_49k.json")).toPandas()
    want = Counter()
    for r in edge_rows:
        ids = np.array(lib.encode(r[1] or "", add_special_tokens=False).ids + [1], "<u4")
        want[r[0], len(ids), zlib.crc32(ids.tobytes())] += 1
    ids = [None if pd.isna(x) else int(x) for x in got.doc_id]
    assert Counter(zip(ids, got.n_tokens, got.ids_crc32, strict=True)) == want
    got = got.sort_values("start")
    assert (got.start.to_numpy() == np.cumsum([0, *got.n_tokens[:-1]])).all()
    assert got.doc_id.isna().iloc[:2].all() and got.doc_id.iloc[2:].is_monotonic_increasing
    assert token_store.token_digests(no_docs, tokenizer("word_bpe_49k.json")).count() == 0


# --- language ------------------------------------------------------------------------

def test_profile_and_distance_match_brute_force():
    def grams(text):
        words = re.findall(r"[^\W\d_]+", text.lower())
        s = " " + " ".join(words) + " "
        return [s[i:i + n] for n in (1, 2, 3) for i in range(len(s) - n + 1)
                if s[i:i + n].strip() and not (n == 3 and s[i + 1] == " ")]

    def top(text, n):
        c = Counter(grams(text))
        return [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], len(x[0]), x[0]))][:n]

    def name(v):
        out = []
        while v:
            out.append(chr(v & 0x1FFFFF))
            v >>= 21
        return "".join(out[::-1])

    for t in ["the cat, the hat", "Ünïcode 12 Straße", "a", "one-two  three"]:
        c = Counter(map(name, langid.ngrams(t).tolist()))
        assert c == Counter(grams(t))
        mine = [name(v) for v in langid.profile(langid.ngrams(t), 6).tolist()]
        assert [Counter(grams(t))[g] for g in mine] == [Counter(grams(t))[g] for g in top(t, 6)]
    rows = [("a", int(g), i) for i, g in enumerate(langid.profile(langid.ngrams("the cat"), 50))]
    rows += [("b", int(g), i) for i, g in enumerate(langid.profile(langid.ngrams("le chat"), 50))]
    judge = langid.Judge(rows, 50)
    own = langid.profile(langid.ngrams("the chat"), 50)
    apart = {x: sum(abs(i - dict((g, r) for y, g, r in rows if y == x).get(int(g), i + 50)) for i, g in enumerate(own)) for x in "ab"}
    best = min(apart, key=lambda x: (apart[x], x))
    assert judge("the chat") == (best, pytest.approx(1 - apart[best] / (50 * len(own))))


def test_languages_held_out(spark, edge_docs, edge_rows, no_docs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.predict_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    out = got[got.held_out]
    assert (out.lang == out.lang_pred).mean() >= 0.98 and got.score.between(0, 1).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]).all()
    edge = langid.predict_languages(edge_docs).toPandas()
    assert len(edge) == len(edge_rows)
    und = edge[edge.doc_id.isin([4, 5, 6, 12, 16])]
    assert (und.lang_pred == "und").all() and (und.score == 0).all()
    assert langid.predict_languages(no_docs).count() == 0
    unlabelled = edge_docs.selectExpr("doc_id", "text", "cast(null as string) as lang")
    assert {r[0] for r in langid.predict_languages(unlabelled).select("lang_pred").collect()} == {"und"}


def test_copies_and_nulls_do_not_thin_the_sample(spark):
    rows = [("aa", f"copied text {i % 5}") for i in range(2000)] + [("bb", "only text")] * 500 + [("bb", None)] * 500
    rows += [("cc", f"own text {i}") for i in range(2000)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    got = Counter(r["lang"] for r in langid.training_rows(docs, F.lit(True), 20).collect())
    assert got["aa"] == 5 and got["bb"] == 1 and 5 <= got["cc"] <= 45


# --- quality model ---------------------------------------------------------------------

def test_bradley_terry_gradient_vanishes_and_ranks():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, len(quality_model.FEATURES)))
    label = (x[:, 0] - 0.5 * x[:, 3] + rng.normal(size=400) * 0.3 > 0.2).astype(int)
    m = quality_model.fit(x, label, (label == 0).mean(), pairs=5000)
    z = np.clip((x - m.mean) / m.scale, -8, 8)
    draw = np.random.default_rng(quality_model.SEED)
    diff = z[draw.choice(np.flatnonzero(label == 1), 5000)] - z[draw.choice(np.flatnonzero(label == 0), 5000)]
    grad = -diff.T @ (1 / (1 + np.exp(diff @ m.weights))) / 5000 + quality_model.RIDGE * m.weights
    assert np.abs(grad).max() < 1e-6
    assert m.weights[0] > 0 > m.weights[3]
    share = (m.score(x) < quality_model.CUT_SCORE).mean()
    assert abs(share - (label == 0).mean()) <= 2 / 400  # the cut is a score quantile


def test_quality_scores_held_out(spark, edge_docs, edge_rows, no_docs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality_model.score_documents(docs, labels).toPandas()
    assert len(got) == docs.count() and got.score.between(0, 1).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    m = got.merge(labels.toPandas(), on="doc_id")
    out = m[m.held_out]
    assert (out.predicted == out.quality).mean() >= 0.95
    assert (m.predicted == (m.score >= 0.3)).all()
    edge = quality_model.score_documents(edge_docs, labels).toPandas()
    assert len(edge) == len(edge_rows) and edge.score.between(0, 1).all()
    none = quality_model.score_documents(edge_docs, labels.limit(0)).toPandas()
    assert np.allclose(none.score, 0.3)
    assert quality_model.score_documents(no_docs, labels).count() == 0


# --- personal data in very long texts ---------------------------------------------

def test_mixed_runs_and_merged_spans_match_their_definitions():
    rng = random.Random(1)
    mixed = re.compile(r"(?=[0-9A-Za-z]*[0-9])(?=[0-9A-Za-z]*[A-Za-z])[0-9A-Za-z]{16,}")  # what a mixed run is
    parts = ["a", "B", "1", "9", "é", "-", "_", "٣", "a" * 16, "1" * 16, "@", "."]
    for _ in range(3000):
        word = "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))
        assert ("mixed" in pii.features(word)) == bool(mixed.search(word.strip(pii._EDGE)))
        base = [(pii.KINDS[0], a, a + rng.randint(1, 9)) for a in rng.sample(range(40), rng.randint(0, 6))]
        more = [("secret", a, a + rng.randint(1, 9)) for a in rng.sample(range(40), 4)]
        kept = [s for s in more if not any(s[1] < b and a < s[2] for _, a, b in base)]
        assert pii.merged_spans(base, more) == sorted(base) + sorted(kept)


def test_very_long_texts_take_time_in_proportion():
    crf = pii.train()
    rng = random.Random(2)
    words = ["call +1 212 555 0147 now ", "a@b.org ", "10.0.0.1 ", "word ", "k3yABCDEF0123456789x ", "4111 1111 1111 1111 "]
    for text in ("1" * 3_000_000, "a1" * 1_500_000, "x" * 3_000_000, "a@" * 500_000, "+1(" * 500_000,
                 "".join(rng.choice(words) for _ in range(100_000))):
        began = time.process_time()
        (base, spans), = pii.find_spans([text], pii.Tagger(crf))
        assert time.process_time() - began < 60
        assert base == pii.base_spans(text) and set(base) <= set(spans)


# --- quality scores by brute force --------------------------------------------------

def plain_features(text):
    """The features as they are named, counted byte by byte."""
    b = (text or "").encode()
    words = b.split()
    if not words:
        return [0.0] * len(quality_model.FEATURES)
    n, size = len(words), sum(len(w) for w in words)
    lines = [x for x in b.split(b"\n") if x.split()]
    stops = {w for s in quality_rules.STOP_WORDS for w in (s.encode(), s.capitalize().encode())}

    def count(test):
        return sum(1 for c in b if test(c))

    return [np.log(n + 1), size / n, count(lambda c: chr(c) in "#*$%&<>") / n, count(lambda c: c == 33) / n,
            count(lambda c: c == 124) / n, count(lambda c: 65 <= c <= 90) / size, count(lambda c: 48 <= c <= 57) / size,
            count(lambda c: 33 <= c < 127 and not chr(c).isalnum()) / size, len(set(words)) / n,
            sum(1 for i in range(1, n) if words[i] == words[i - 1]) / n, 1 - len(set(lines)) / len(lines),
            np.log(n / len(lines) + 1), sum(1 for w in words if w in stops) / n]


def test_quality_scores_match_brute_force(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality_model.train(docs, labels)
    got = {r["doc_id"]: r for r in quality_model.score_documents(docs, labels).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        z = sum(w * min(max((x - m) / s, -8), 8) for x, m, s, w in
                zip(plain_features(r["text"]), model.mean, model.scale, model.weights)) - model.cut
        score = 1 / (1 + np.exp(-(z + np.log(0.3 / 0.7))))
        own = got[r["doc_id"]]
        assert abs(own["score"] - score) < 1e-9 and own["predicted"] == (own["score"] >= 0.3)
        assert own["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)


def test_bpe_hands_on_a_batch_in_parts():
    import pyarrow as pa

    from sentiscope.llm import bpe
    from sentiscope.llm.catalog import tokenizer

    texts = ["some words here " * 20_000, None, "", "short", *["other words " * 30_000] * 4, "end"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], ["_row", "text"])
    path = tokenizer("byte_bpe_50k.json")
    out = list(bpe._encoded(path, True)(iter([batch, batch.slice(0, 0)])))
    assert len(out) >= 2 and max(b.num_rows for b in out) < len(texts)
    rows = pa.Table.from_batches(out)
    assert rows.column("_row").to_pylist() == list(range(len(texts)))
    own = bpe.tokenizer_of(path)
    assert rows.column("token_ids").to_pylist() == [own.encode(t).tolist() for t in texts]


def test_quality_model_learns_from_every_label(spark):
    # labels beyond any fixed number of rows: the last few decide the means, the blocks and the cut
    rng = random.Random(5)
    texts = [(i, " ".join(rng.choice(["Alpha", "beta", "##", "the", "10"]) for _ in range(rng.randint(1, 12)))) for i in range(9000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int("##" not in t and i % 10 > 0)) for i, t in texts], "doc_id long, quality int")
    model = quality_model.train(docs, labels)
    used = [(quality_model.features(t.encode()), int("##" not in t and i % 10 > 0)) for i, t in texts if zlib.crc32(str(i).encode()) % 5]
    x, y = np.array([u[0] for u in used]), np.array([u[1] for u in used])
    assert len(x) > 6500 and np.allclose(model.mean, x.mean(axis=0)) and np.allclose(model.scale, np.where(x.std(axis=0) < 1e-9, 1, x.std(axis=0)))
    s = np.sort(model.strength(x))
    n0 = int((y == 0).sum())
    assert abs(model.cut - (s[n0 - 1] + s[n0]) / 2) < 1e-9
    learnt = quality_model.feature_rows(docs).join(labels, "doc_id")
    one = np.zeros(len(quality_model.FEATURES)), np.ones(len(quality_model.FEATURES))
    packed = quality_model.blocks(learnt, {0: 4500, 1: 4500}, *one).selectExpr("sum(size(good) + size(bad)) as n").first()["n"]
    assert packed == 9000 * len(quality_model.FEATURES)


def test_quality_blocks_hold_both_labels_where_one_is_rare(spark):
    d = len(quality_model.FEATURES)
    rows = spark.createDataFrame([(i, int(i < 3), [float(i % 7)] * d) for i in range(3000)], "doc_id long, quality int, x array<double>")
    packed = quality_model.blocks(rows, {0: 2997, 1: 3}, np.zeros(d), np.ones(d))
    assert packed.where("size(good) = 0 and size(bad) > 0").count() == 0
    w = quality_model.fit_blocks(packed)
    assert np.isfinite(w).all()
