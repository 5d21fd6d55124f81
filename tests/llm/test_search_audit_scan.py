"""Ranked search, source divergence and license scan against brute force and edge cases."""

import math
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridlore.llm import divergence, lexical, licenses

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, term string, item long, row_hash string, width int, shard string, class string"
CLASH = (7, "t", 8, "x", 9, "s", "c")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def frame(spark, rows):
    """Rows of (doc_id, text, lang, source), with columns whose names the operators use inside."""
    return spark.createDataFrame([(*r, *CLASH) for r in rows], SCHEMA)


def words_of(text, pattern=r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"):
    return re.findall(pattern, (text or "").translate(LOWER))


def corpus(n, vocabulary, seed):
    random.seed(seed)
    made = []
    for k in range(n):
        text = " ".join(random.choices(vocabulary, weights=[1 / (i + 1) for i in range(len(vocabulary))], k=random.randint(0, 60)))
        made.append((k, text, random.choice(["a", "b", None]), random.choice(["s1", "s2", "s3", "", None])))
    return made + [(n, None, "a", "s1"), (n + 1, "", "b", None), (n + 2, "¡É日本🙂x " * 300, "c", "only"), made[3], made[3], (None, made[4][1], "a", "s2"), (n + 3, "The THE the.", "a", "s9")]


VOCABULARY = ["the", "of", "É", "élan", "x1", "a_b", "Zeta", *[f"w{k}" for k in range(60)], "averyveryverylongword"]


# op11


def ranked(rows, items, top):
    docs = [(d, Counter(words_of(t))) for d, t, *_ in rows]
    docs = [(d, c, sum(c.values())) for d, c in docs if c]
    n_docs, n_terms = len(docs), sum(n for _, _, n in docs)
    out = {}
    for item, text in items:
        terms = set(words_of(text))
        weights = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * sum(t in c for _, c, _ in docs) + 1))) for t in terms}
        scores = []
        for d, c, n in docs:
            m = 50 + 50 * n * n_docs // n_terms
            s = sum(weights[t] * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if t in c)
            if s > 0:
                scores.append((-s, d is None, d or 0))
        out[item] = [(-s, None if no else d) for s, no, d in sorted(scores)[:top]]
    return {i: r for i, r in out.items() if r}


@pytest.mark.parametrize("group_terms, block_docs, broadcast", [(1 << 16, 256, 1 << 20), (6, 3, 0)])
def test_search_equals_scoring_everything(spark, monkeypatch, group_terms, block_docs, broadcast):
    monkeypatch.setattr(lexical, "BLOCK_DOCS", block_docs)
    monkeypatch.setattr(lexical, "BROADCAST_ROWS", broadcast)
    rows = corpus(300, VOCABULARY, 1)
    random.seed(2)
    items = [(k, " ".join(random.choices(VOCABULARY, k=random.randint(1, 12)))) for k in range(12)] + [(50, None), (51, " .. "), (52, "nowhere"), (53, "the THE the")]
    table = spark.createDataFrame([*items, items[0]], "item_id long, text string")
    got = defaultdict(list)
    for r in lexical.search(frame(spark, rows), table, top=7, group_terms=group_terms).orderBy("item_id", "rank").collect():
        got[r.item_id].append((r.score, r.doc_id))
        assert r["rank"] == len(got[r.item_id])
    assert dict(got) == ranked(rows, items, 7)


def test_a_text_of_two_items_is_ranked_for_both_and_ids_may_repeat(spark):
    docs = frame(spark, [(1, "alpha beta", "a", "s"), (2, "alpha", "a", "s"), (3, "gamma", "a", "s")])
    items = spark.createDataFrame([("i", "alpha"), ("i", "gamma"), (None, "alpha")], "item_id string, text string")
    got = lexical.search(docs, items).groupBy("item_id").count().collect()
    assert {r.item_id: r["count"] for r in got} == {"i": 3, None: 2}


def test_search_without_documents_or_items(spark):
    items = spark.createDataFrame([(1, "alpha")], "item_id long, text string")
    docs = frame(spark, [(1, "alpha", "a", "s")])
    assert lexical.search(frame(spark, []), items).count() == 0
    none = lexical.search(docs, items.where("false"))
    assert none.count() == 0 and {"item_id", "rank", "doc_id", "score"} <= set(none.columns)


def test_bounds_are_never_below_the_score():
    random.seed(3)
    texts = [" ".join(random.choices(VOCABULARY, k=random.randint(1, 80))) for _ in range(90)]
    column = pa.array(texts)
    items = [(k, sorted(set(words_of(" ".join(random.choices(VOCABULARY, k=9)))))) for k in range(20)]
    query = lexical.Query.of(items)
    data, starts, ends, of = lexical.lowered(column, lexical.ALNUM)
    doc, hashes, tf = lexical.distinct_pairs(of, lexical.span_hashes(data, starts, ends, query.seed))
    entries = [
        np.concatenate([lexical.level_hashes(np.array([h]), n) for h, f in zip(hashes[doc == d], tf[doc == d], strict=True) for n, least in enumerate(lexical.LEVELS) if f >= least])
        for d in range(len(texts))
    ]
    width, bits = lexical.pack(entries)
    lengths = np.bincount(of)
    query.n_docs, query.n_terms = len(texts), int(lengths.sum())
    query.weights = np.arange(1, len(query.hashes) + 1)
    upper = lexical.bounds(width, bits, lengths, query, lexical.query_levels(query))
    on, term = query.find(data, starts, ends)
    d, t, f = lexical.distinct_pairs(of[on], term)
    exact = np.zeros((len(texts), len(query.hashes)), np.int64)
    exact[d, t] = query.weights[t] * lexical.share(f, query.length_parts(lengths)[d])
    true = np.array([[exact[k, query.refs[query.first[i] : query.first[i + 1]]].sum() for k in range(len(texts))] for i in range(len(items))])
    assert (upper >= true).all() and upper.sum() < 1.3 * true.sum()


# op12


def divergent(rows, least, top):
    terms = [(lang or "", source or "", words_of(t, r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")) for _, t, lang, source in rows]
    df, tf = defaultdict(Counter), defaultdict(Counter)
    for lang, source, ws in terms:
        df[lang].update(set(ws))
        tf[lang, source].update(ws)
    kept = {lang: sorted(t for t, n in c.items() if n >= least) for lang, c in df.items()}
    shares = lambda c, ts, n: {t: 1 + 10**9 * (c[t] + 2) // (n + 2 * len(ts)) for t in ts}
    f = lambda p, q: (p - q) ** 2 // (p + q)
    totals = {g: sum(c[t] for t in kept[g[0]]) for g, c in tf.items()}
    p = {g: shares(c, kept[g[0]], totals[g]) for g, c in tf.items()}
    out = set()
    for lang in kept:
        groups = [g for g in tf if g[0] == lang]
        all_counts = sum((tf[g] for g in groups), Counter())
        q = shares(all_counts, kept[lang], sum(totals[g] for g in groups))
        found = defaultdict(list)
        for a, b in permutations(groups, 2):
            found[a, "pair"].append((-sum(f(p[a][t], p[b][t]) for t in kept[lang]), b[1].encode(), b[1]))
        for a in groups:
            found[a, "term"] += [(-f(p[a][t], q[t]), t.encode(), t) for t in kept[lang] if tf[a][t] and p[a][t] > q[t]]
        for (g, part), values in found.items():
            ranked = sorted(values)[: top if part == "term" else None]
            out |= {(*g, part, item, -v, k + 1) for k, (v, _, item) in enumerate(ranked)}
    return out


@pytest.mark.parametrize("given", [{}, {"shard_terms": 3, "wave_bytes": 150, "slot_bytes": 0, "sources": 2}])
def test_divergence_equals_counting(spark, given):
    rows = corpus(250, VOCABULARY, 4)
    got = {tuple(r) for r in divergence.divergence(frame(spark, rows), least_docs=6, top=4, **given).collect()}
    assert got == divergent(rows, 6, 4)
    assert {("c", "only"), ("b", "")} & {(r[0], r[1]) for r in got} == {("b", "")}  # a single source of a language has no pair and no term above its language


@pytest.mark.parametrize("shard_terms", [1, 8])
def test_a_pair_is_one_row_in_whatever_order_its_shards_come(spark, shard_terms):
    spread = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "7"}
    before = {name: spark.conf.get(name) for name in spread}
    rng = random.Random(2)
    rows = [(n, " ".join(rng.choices([a + b for a in "abcdefgh" for b in "xyzuvw"], k=20)), "l", f"s{n % 9}") for n in range(200)]
    try:
        for name, value in spread.items():
            spark.conf.set(name, value)
        got = [tuple(r) for r in divergence.divergence(frame(spark, rows), least_docs=6, top=4, shard_terms=shard_terms).collect()]
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert len(got) == len(set(got)) and set(got) == divergent(rows, 6, 4)


def test_divergence_edges(spark):
    assert divergence.divergence(frame(spark, [])).count() == 0
    few = divergence.divergence(frame(spark, [(1, "word", "a", "s"), (2, None, "a", None)])).collect()
    assert {tuple(r) for r in few} == {("a", "s", "pair", "", 0, 1), ("a", "", "pair", "s", 0, 1)}


def test_perfect_hashes_are_perfect_and_verified():
    rng = np.random.default_rng(0)
    for n in (1, 2, 7, 500, 2500):
        hashes = rng.integers(0, 1 << 63, n).astype(np.uint64)
        pilots, slots = divergence.perfect_hash(hashes)
        assert sorted(slots.tolist()) == list(range(n))
        assert (divergence.slot_of(hashes, pilots[divergence.key_parts(hashes, n)], n) == slots).all()


def test_shares_are_exact_beyond_64_bits():
    random.seed(5)
    for _ in range(300):
        n_terms = random.randint(1, 10**9)
        total = random.randint(0, 10**13)
        count = random.randint(0, total)
        assert int(divergence.scaled(np.array([count]), total, n_terms)[0]) == 1 + 10**9 * (count + 2) // (total + 2 * n_terms)


def test_words_with_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(divergence, "span_hashes", lambda d, s, e, seed=0: np.zeros(len(s), np.uint64))
    data, starts, ends, _ = divergence.terms_in(pa.array(["b a b ccc a"]))
    codes, order = divergence.exact_codes(data, starts, ends)
    assert codes.tolist() == [1, 0, 1, 2, 0] and (codes[order] == np.sort(codes)).all()


# op13


def scanned(rows, templates, percent):
    pairs = lambda ws: [f"{a} {b}" for a, b in zip(ws, ws[1:])]
    known = {(n, x): (licenses.block_class(len(words_of(t))), set(pairs(words_of(t)))) for n, x, t in templates}
    out = []
    for d, text, *_ in rows:
        ws = words_of(text)
        places = [(k, label) for phrase, label in licenses.PHRASES for k in range(len(ws)) if ws[k : k + len(phrase.split())] == phrase.split()]
        score, labels = 0.0, {x for _, x in places}
        for (_, label), (size, tokens) in known.items():
            for first in range(0, len(ws), size):
                common = len(tokens & set(pairs(ws[first : first + 2 * size])))
                if tokens and 100 * common >= percent * len(tokens):
                    labels.add(label)
                    score = max(score, common / len(tokens))
        at = [k for k, _ in places]
        out.append((d, len(ws), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places})), ",".join(sorted(labels)), score))
    return Counter(out)


def licensed(seed):
    """Texts with notices, whole, with words changed and cut."""
    random.seed(seed)
    rows = []
    for k in range(160):
        text = random.choices(["MIT", "License", "the", "Apache", "general", "public", "software", "of", "x", "\n"], k=random.randint(0, 40))
        for _ in range(random.randint(0, 3)):
            notice = random.choice(licenses.TEMPLATES)[2].split()
            for _ in range(random.randint(0, len(notice) // 6)):
                notice[random.randrange(len(notice))] = random.choice(["THE", "x", "of"])
            at = random.randint(0, len(text))
            text[at:at] = notice[: random.randint(1, len(notice) + 5)]
        rows.append((k, " ".join(text), "a", "s"))
    return [*rows, rows[0], (None, rows[1][1], "a", "s"), (900, None, "a", "s"), (901, "", None, None), (902, "MIT\x00License mitlicense é-mit.LICENSE", "a", "s"), (903, "word " * 30_000 + licenses.TEMPLATES[1][2], "a", "s")]


COLUMNS = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


@pytest.mark.parametrize("percent, group_tokens", [(80, 1 << 17), (55, 20)])
def test_scan_equals_trying_every_block(spark, percent, group_tokens):
    rows = licensed(6)
    documents, found = licenses.scan_licenses(frame(spark, rows), percent=percent, group_tokens=group_tokens)
    joined = [F.array_join(c, ",").alias(c) for c in ("base_labels", "labels")]
    got = Counter(tuple(r[c] for c in COLUMNS) for r in documents.select(*[c for c in COLUMNS if "labels" not in c], *joined).collect())
    assert got == scanned(rows, licenses.TEMPLATES, percent)
    assert found.where("containment < 0.55 or last <= first").count() == 0


def test_scan_edges(spark):
    documents, found = licenses.scan_licenses(frame(spark, []))
    assert documents.count() == 0 and found.count() == 0
    own = spark.createDataFrame([("t", "one", "a b"), ("t", "one", "a b"), ("u", "short", "word"), ("v", None, None)], "template string, label string, text string")
    documents, found = licenses.scan_licenses(frame(spark, [(1, "A, b!", "x", "y"), (2, "word", "x", "y")]), own)
    assert [(r.doc_id, r.labels, r.score) for r in documents.orderBy("doc_id").collect()] == [(1, ["one"], 1.0), (2, [], 0.0)]
    assert found.count() == 1
    documents, found = licenses.scan_licenses(frame(spark, [(1, "mit license", "x", "y")]), own.where("false"))
    assert [(r.labels, r.n_base) for r in documents.collect()] == [(["mit"], 1)]
