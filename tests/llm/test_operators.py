"""Operators of the corpus subpackage against brute force, round trips and edge cases."""

import functools
import hashlib
import math
import random
import re
import sys
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridlore.llm import bpe, chat, common, decontaminate, graph, langid, linededup, pii, quality, shards, simhash, siteprior

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, row_hash string"
LONG = "word " * 30_000


def docs(spark, texts):
    return spark.createDataFrame([(n, t, "en", "s", len(t or ""), 7, "x") for n, t in enumerate(texts)], SCHEMA)


EDGES = [None, "", " ", "\n\n", "a", LONG, "the same text here", "the same text here", "1 2 3", "é日 本 🙂", "<|endoftext|> x"]


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# op1


def test_bpe_equals_the_library():
    path = bpe.tokenizer_path()
    model, told = bpe.BpeModel(open(path, encoding="utf-8").read()), Tokenizer.from_file(path)
    random.seed(1)
    alphabet = " \n\t'sratve\x1c\x85\xa0é日1٣!?#　\r🙂A"
    texts = ["", "aaaa" * 500, "<|endoftext|>a<|endoftext|>", "it's I'LL"] + ["".join(random.choices(alphabet, k=random.randint(0, 50))) for _ in range(2000)]
    for e, g in zip(told.encode_batch(texts, add_special_tokens=False), model.encode_batch(texts), strict=True):
        assert e.ids == np.frombuffer(g, "<u4").tolist()
        assert model.decode(g) == told.decode(e.ids, skip_special_tokens=False)


def test_what_a_worker_remembers_is_bounded_by_bytes(monkeypatch):
    model = bpe.BpeModel(open(bpe.tokenizer_path(), encoding="utf-8").read())
    monkeypatch.setattr(bpe, "REMEMBERED_BYTES", 20_000)
    random.seed(8)
    size = lambda d: sum(sys.getsizeof(k) + sys.getsizeof(v) + bpe.SLOT_BYTES for k, v in d.items())
    told = Tokenizer.from_file(bpe.tokenizer_path())
    for n in range(60):
        texts = ["x" * 5_000 + "y" * n, " ".join("".join(random.choices("abcdefé", k=random.randint(1, 180))) for _ in range(40))]
        got = [np.frombuffer(g, "<u4").tolist() for g in model.encode_batch(texts)]
        assert got == [e.ids for e in told.encode_batch(texts, add_special_tokens=False)]
        assert size(model.recent) == model.held <= 20_000 + 40 * 1_200 and size(model.older) <= 20_000 + 40 * 1_200
        assert max(map(len, model.recent)) <= bpe.REMEMBERED_LENGTH


def test_bpe_edges(spark, empty):
    path = bpe.tokenizer_path()
    rows = {r.doc_id: r.decoded_text for r in bpe.decode(bpe.encode(docs(spark, EDGES), path), path).collect()}
    assert rows == {n: t or "" for n, t in enumerate(EDGES)}
    assert bpe.encode(empty, path).count() == 0


# op2


def test_patterns_by_regex():
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    random.seed(2)
    for _ in range(3000):
        t = "".join(random.choices("a1.@-+_ é", k=random.randint(0, 25)))
        assert [(a, b) for k, a, b in pii.pattern_spans(t) if k == "email"] == [m.span() for m in email.finditer(t)]
    assert pii.pattern_spans("a 1.2.3.4 b 4111 1111 1111 1111 c +1 (743) 555-3824 d 1.2.3.999") == [
        ("ip", 2, 9),
        ("card", 12, 31),
        ("phone", 34, 51),
    ]


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(0)
    crf = pii.Crf(np.zeros((1, len(pii.LABELS))), rng.normal(size=(len(pii.LABELS),) * 2))
    scores = rng.normal(size=(3, len(pii.LABELS)))
    got = crf.viterbi(scores, np.array([0]), np.array([3]))
    n, t = len(pii.LABELS), crf.transitions
    best = max(
        ((a, b, c) for a in range(n) for b in range(n) for c in range(n)),
        key=lambda p: t[0, p[0]] + scores[0, p[0]] + t[p[0], p[1]] + scores[1, p[1]] + t[p[1], p[2]] + scores[2, p[2]] + t[p[2], 0],
    )
    assert tuple(got) == best


def test_field_learns_its_table_and_keeps_base_spans(spark, empty):
    crf = pii.train()
    marked = [pii.parse_labelled(r) for r in pii.LABELLED]
    secrets = [(t, s) for t, s in marked if any(k == "secret" for k, _, _ in s)]
    hits = sum(bool(pii.field_spans(pa.array([t]), crf)) for t, _ in secrets)
    assert hits >= 0.9 * len(secrets)
    clean = [t for t, s in marked if not s]
    assert sum(bool(pii.field_spans(pa.array([t]), crf)) for t in clean) <= 0.1 * len(clean)
    r = pii.find(docs(spark, ['mail a@b.cd token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" ok']), crf).first()
    assert r.base_spans == "email:5:11" and r.spans == "email:5:11,secret:21:61"
    assert pii.find(docs(spark, EDGES), crf).count() == len(EDGES) and pii.find(empty, crf).count() == 0


# op3


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_banded_distance():
    random.seed(3)
    for _ in range(5000):
        a, b = ("".join(random.choices("ab", k=random.randint(0, 9))) for _ in range(2))
        for e in (1, 2, 3):
            assert linededup.within(a, b, e) == (edits(a, b) <= e)


def word_lines(count):
    random.seed(4)
    base = [[random.choice("abcdefgh") + random.choice("xyz") for _ in range(n)] for n in (8, 9, 21, 43, 44, 61, 85)]
    lines = []
    for _ in range(count):
        words = list(random.choice(base))
        for _ in range(random.randint(0, 5)):
            at = random.randrange(len(words))
            words[at : at + 1] = random.choice([[], ["new"], [words[at], "more"], ["tail"]])
        lines.append(random.choice([" ", "  "]).join(words))
    return lines


def classes_of(links):
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in links:
        root[find(a)] = find(b)
    groups = {}
    for x in root:
        groups.setdefault(find(x), set()).add(x)
    return sorted(map(sorted, groups.values()))


@functools.cache
def told_links():
    lines = word_lines(120)
    limits = linededup.LIMITS
    ids = {x: (linededup.line_hash(x.encode())[0] & -2, x.split()) for x in set(lines)}
    told = set()
    for i, a in ids.values():
        for j, b in ids.values():
            short = min(len(a), len(b))
            if i < j and short >= 8 and abs(len(a) - len(b)) <= 4 and edits(a, b) <= limits.of(short):
                told.add((i, j))
    return lines, told


@pytest.mark.parametrize("paired,most,levels", [(10_000, 10_000, 1), (6, 10_000, 1), (6, 12, 1), (6, 12, 3)])
def test_edit_join_loses_no_link(spark, paired, most, levels):
    lines, told = told_links()
    table = spark.createDataFrame([(i, "\n".join(lines[i * 5 : i * 5 + 5])) for i in range(24)], "doc long, text string")
    got = {(r.a, r.b) for r in linededup.near_links(table, linededup.LIMITS, paired, most, levels).collect()}
    if paired > len(lines):
        assert got == told
    else:
        assert got <= told and classes_of(got) == classes_of(told)


def test_near_lines_share_one_of_few_keys():
    rng = np.random.default_rng(6)
    limits = linededup.LIMITS
    behind_all = np.full(1 << 18, ~np.uint64(0))
    for size in [8, 9, 10, 39, 40, 41, 59, 60, 63, 64, 79, 80, 83, 95, 96, 100, 130] * 6:
        line = rng.integers(0, 1 << 62, size).tolist()
        other = list(line)
        for _ in range(int(limits.of(size))):
            at, new = int(rng.choice([0, len(other) - 1, rng.integers(len(other))])), int(rng.integers(1 << 62))
            other[at : at + 1] = [[], [new], [new, other[at]], [other[at], new]][rng.integers(4)]
        if not linededup.within(line, other, int(limits.of(min(size, len(other))))):
            continue  # a word less and the line may have fewer edits
        whole = linededup.Views(np.array(line + other, np.uint64), np.array([size, len(other)]), np.arange(2))
        for level, views in enumerate((whole, whole.behind(behind_all, limits))):
            made = [(int(n), int(k)) for on, key, *_ in views.keys(limits) for n, k in zip(views.line[on], key, strict=True)]
            assert {k for n, k in made if n == 0} & {k for n, k in made if n == 1}
            if level == 0:
                assert len(made) <= 2 * (9 + 9)  # 49 a line of four edits when keys had the exact length


def test_near_lines_grow_with_the_length():
    words = [f"w{n}" for n in range(100)]
    change = lambda n, size: " ".join(["x"] * n + words[n:size])
    for size, most in ((7, 0), (8, 1), (39, 1), (40, 2), (60, 3), (80, 4), (100, 4)):
        assert linededup.near(change(0, size), change(most, size), linededup.LIMITS)
        assert not linededup.near(change(0, size), change(most + 1, size), linededup.LIMITS)


def test_line_dedup_keeps_the_first(spark, empty):
    line = "this line is long enough to count as one that may nearly repeat"
    table = docs(spark, [f"{line}\nown one\n\n{line}", f"x\n{line}s", None, "", "x", LONG, LONG])
    rows = {r.doc_id: r for r in linededup.dedup_lines(table).collect()}
    assert rows[0].text == f"{line}\nown one\n" and rows[1].text == "x" and rows[2].text is None
    assert rows[4].text == "" and rows[4].line_dedup.first_docs == [1] and rows[6].text == "" and rows[5].text == LONG
    assert rows[1].line_dedup.n_near == 1 and rows[0].fp == 7
    assert linededup.dedup_lines(empty).count() == 0


# op4


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", chat.TRICKY), (1, 1, "assistant", "a#\\b"), (1, 2, None, None), (1, 3, "assistant", ""), (2, 0, "user", "x"), (None, None, "a:b", "é\n")]
    made = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.conv_id: r for r in chat.read_back(made).collect()}
    told = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in rows[:4])
    assert got[1].turns_sha256 == hashlib.sha256(told.encode()).hexdigest()
    assert (got[1].n_turns, got[1].loss_chars, got[1].loss_sha256) == (4, 4, hashlib.sha256(b"a#\\b").hexdigest())
    assert got[2].loss_chars == 0 and got[None].n_turns == 1
    texts = chat.example_texts(made).orderBy("turn_no").collect()
    assert [chat.unescape(r.text[r.loss_start : r.loss_stop]) for r in texts] == ["a#\\b", ""]


def test_query_goes_through_every_example(spark, monkeypatch):
    rows = [(c, n, "assistant" if n % 2 else "user", f"{chat.TRICKY} {n}\n") for c in (1, 2, None) for n in range(7)]
    made = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    seen = []
    monkeypatch.setattr(chat, "digests", lambda examples, own=chat.digests: seen.append(examples) or own(examples))
    assert chat.read_back(made).count() == 3
    got = [tuple(r) for r in seen[0].where("loss_start is not null").collect()]
    assert len(got) == 9 and sorted(got, key=str) == sorted((tuple(r) for r in chat.example_texts(made).collect()), key=str)
    assert seen[0].where("loss_start is null").count() == 3


# op5


def test_quality_counts(spark, empty):
    random.seed(5)
    texts = EDGES + ["\n".join(" ".join(random.choices(["a", "b", "c#"], k=random.randint(0, 6))) for _ in range(8)) for _ in range(30)]
    for r in quality.quality_rules(docs(spark, texts)).collect():
        t = texts[r.doc_id] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = list(zip(w, w[1:], w[2:], strict=False))
        seen, covered, dup = Counter(windows), set(), 0
        for i, x in enumerate(windows):
            covered |= {i, i + 1, i + 2} if seen[x] > 1 else set()
        lines = t.split("\n")
        dup = sum(x in lines[:i] and bool(re.search(r"[^\x20\x09-\x0D]", x)) for i, x in enumerate(lines))
        told = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(covered))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == told
        assert r.base_failed == (len(w) < 50 or 2 * len(covered) > len(w)) and not (r.base_failed and r.kept)
    assert quality.quality_rules(empty).count() == 0


def test_odd_documents_fail_their_group(spark):
    random.seed(6)
    plain = [" ".join("".join(random.choices("abcde", k=5)) for _ in range(80)) for _ in range(60)]
    rows = quality.quality_rules(docs(spark, [*plain, plain[0].replace(" ", "### ")])).collect()
    assert {r.doc_id for r in rows if not r.kept} == {60}


def signals(spark, rows):
    """Signals of rows of (source, name of a signal, its value, how many)."""
    rows = [(s, n, float(v)) for s, n, v, times in rows for _ in range(times)]
    made = spark.createDataFrame(rows, "source string, name string, value double")
    shares = [f"if(name = '{n}', value, 0d) AS {n}" for n in quality.SIGNALS]
    return made.selectExpr("'en' AS lang", "source", "value", *shares, "false AS base_failed")


def test_a_group_judges_by_its_own_distribution(spark):
    rows = [("calm", "upper_share", n / 100_000, 5) for n in range(1000)] + [("loud", "upper_share", n / 5000, 5) for n in range(1000)]
    told = quality.judge(signals(spark, [*rows, ("calm", "upper_share", 0.11111, 1), ("loud", "upper_share", 0.11111, 1)]))
    assert {r.source: r.kept for r in told.where("value = 0.11111").collect()} == {"calm": False, "loud": True}


@pytest.mark.parametrize("size", [190, 199, 200, 400])
def test_a_source_of_junk_cannot_excuse_itself(spark, size):
    junk = size * 3 // 10
    rows = [("clean", "symbol_share", 0, 4000), ("spam", "symbol_share", 0, size - junk), ("spam", "symbol_share", 0.36, junk)]
    told = quality.judge(signals(spark, rows)).groupBy("value", "kept").count().collect()
    assert {(r.value, r.kept): r["count"] for r in told} == {(0.0, True): 4000 + size - junk, (0.36, False): junk}


def fenced(rows, weight):
    """Fences by (lang, source, signal), from rows of (lang, source, four signals, four units), with plain lists."""
    g, least = quality.GAMMA, quality.LEAST
    bucket = lambda v: -1 if v < least else math.floor(math.log(v / least) / math.log(g))

    def told(chosen, n):
        held = sorted(bucket(r[2 + n]) for r in chosen)
        unit = math.floor(sum(bucket(r[6 + n]) for r in chosen) / len(chosen))
        tail = held[math.ceil((1 - quality.RARE) * len(held)) - 1]
        tail = 0.0 if tail < 0 else least * g ** (tail + 0.5)
        steps = sorted(set(held))
        found = []
        for before, b in zip([-1, *steps], steps, strict=False):
            low = max(unit, before)
            if b >= 0 and (b - low) * math.log(g) >= math.log(quality.GAP) and sum(h >= b for h in held) <= quality.ODD * len(held):
                found.append((low - b, b, least * g ** ((b + low) / 2 + 0.5)))
        return len(held), tail, min(found)[2] if found else None

    out = {}
    for lang, source in {r[:2] for r in rows}:
        for n, signal in enumerate(quality.SIGNALS):
            _, all_tail, all_gap = told(rows, n)
            count, tail, gap = told([r for r in rows if r[0] == lang], n)
            of_lang = (count * tail + weight * all_tail) / (count + weight)
            count, tail, _ = told([r for r in rows if r[:2] == (lang, source)], n)
            fence = min((count * tail + weight * of_lang) / (count + weight), of_lang) * g
            gap = all_gap if gap is None else gap
            out[lang, source, signal] = fence if gap is None else min(fence, gap)
    return out


def test_fences_and_verdicts_by_brute_force(spark):
    random.seed(11)
    rows = []
    for n in range(900):
        lang, source = random.choice(["en", "en", "de", None]), random.choice(["x", "y", None])
        sizes = [random.randint(50, 900) for _ in range(4)]
        junk = random.random() < 0.05
        values = (random.uniform(0.1, 0.4) if junk else random.choice([0, 0, 0, 1]) / sizes[0], random.choice([0, 0, 1, 2]) / sizes[1], random.expovariate(40), random.uniform(0, 0.03 if lang == "de" else 0.01))
        rows.append((lang, source, *map(float, values), *[1 / s for s in (sizes[0], sizes[1], sizes[1] / 2, sizes[0])], *sizes))
    kind = ", ".join(["lang string, source string", *[f"{s} double" for s in quality.SIGNALS], *[f"u{n} double" for n in range(4)], "word_chars long, n_lines long, n_words long, other long"])
    made = spark.createDataFrame(rows, kind).selectExpr("*", "false AS base_failed", "monotonically_increasing_id() AS id")
    told = fenced(rows, 50)
    assert len({round(v, 9) for (*_, s), v in told.items() if s == "symbol_share"}) > 1
    for r in quality.judge(made, min_rows=50).collect():
        for s in quality.SIGNALS:
            assert abs(r[f"{s}_fence"] - told[r.lang, r.source, s]) <= 1e-9 * told[r.lang, r.source, s] + 1e-15
        assert r.kept == all(r[s] <= r[f"{s}_fence"] for s in quality.SIGNALS)


def test_one_event_in_a_long_text_is_no_reason(spark):
    random.seed(12)
    line = lambda: " ".join("".join(random.choices("abcdefgh", k=5)) for _ in range(20))
    texts = ["\n".join(line() for _ in range(50)) for _ in range(80)]
    texts += [texts[0].replace(" ", " % ", 1), texts[1] + "\n" + texts[1].split("\n")[7], texts[2].replace(" ", " $$$$$ ", 300)]
    kept = {r.doc_id: r.kept for r in quality.quality_rules(docs(spark, texts)).collect()}
    assert [d for d, k in kept.items() if not k] == [82]


# op6


def test_contamination_is_exact(spark, empty):
    random.seed(7)
    item = lambda n: " ".join(random.choices("abcdefgh", k=n))
    items = [item(25), item(12), item(10), item(4), "Z z", None, "", item(5)]
    bench = spark.createDataFrame([(n, t) for n, t in enumerate(items)], "item_id long, text string")
    texts = [*EDGES, *[" ".join([item(30), x or "", item(7).upper()]) for x in items], *[item(400) for _ in range(20)]]
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = defaultdict(set)
    for n, t in enumerate(items):
        w = cut(t)
        for i in range(len(w) - min(10, len(w)) + 1) if w else ():
            windows[tuple(w[i : i + min(10, len(w))])].add(str(n))
    for r in decontaminate.contamination(docs(spark, texts), bench).collect():
        w, hit, found = cut(texts[r.doc_id]), set(), set()
        for size in {len(k) for k in windows}:
            for i in range(len(w) - size + 1):
                if s := windows.get(tuple(w[i : i + size])):
                    found |= s
                    hit |= set(range(i, i + size))
        assert (r.n_words, r.n_hit, sorted(r.item_ids)) == (len(w), len(hit), sorted(found))
    none = bench.where("false")
    assert not decontaminate.contamination(docs(spark, texts), none).where("contaminated").count()
    assert decontaminate.contamination(empty, bench).count() == 0


# op7


def test_fingerprints_and_spans():
    random.seed(8)
    data = bytes(random.choices(range(256), k=4000))
    starts = np.array([random.randrange(3900) for _ in range(500)])
    lengths = np.array([random.randrange(0, 60) for _ in range(500)])
    got = simhash.xxh64_spans(np.frombuffer(data, np.uint8), starts, lengths)
    assert got.tolist() == [xxhash.xxh64_intdigest(data[s : s + n], 42) for s, n in zip(starts, lengths, strict=True)]
    assert simhash.fingerprints_of(pa.array(["", None, "A b"])).tolist() == [0, 0, xxhash.xxh64_intdigest(b"a b", 42)]


@pytest.mark.parametrize("most", [4096, 3])
def test_components_lose_no_link(spark, most):
    random.seed(9)
    fps = [random.getrandbits(64) for _ in range(8)]
    for _ in range(150):
        x = random.choice(fps)
        for _ in range(random.randint(1, 5)):
            x ^= 1 << random.choice([*range(64), 0, 1, 2, 33])
        fps.append(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    rows = simhash.components(spark.createDataFrame([(n, 0, x) for n, x in enumerate(signed)], "doc_id long, row_hash long, fp long"), most)
    root = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3 and root[i] != root[j]:
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    assert {r.doc_id: r.component_id for r in rows.collect()} == dict(enumerate(root))


def test_simhash_edges(spark, empty):
    rows = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs(spark, EDGES)).collect()}
    assert rows[0] == rows[1] == rows[2] == rows[3] == 0 and rows[7] == 6
    assert simhash.near_duplicates(empty).count() == 0


def test_long_chain_is_one_component(spark):
    links = spark.createDataFrame([(n, n + 1) for n in range(300)] + [(1000, 1001), (5, 5), (None, 3)], "a long, b long")
    assert {r.node: r.root for r in graph.connected_components(links).collect()} == dict.fromkeys(range(301), 0) | {1000: 1000, 1001: 1000}


# op8


def test_slots_are_a_permutation():
    for n in (1, 2, 3, 100, 4097):
        assert sorted(shards.slots_of(np.arange(n), n).tolist()) == list(range(n))
    assert shards.slots_of(np.arange(100), 100, 1).tolist() != shards.slots_of(np.arange(100), 100, 2).tolist()


def test_shards_round_trip_and_resume(spark, empty, tmp_path):
    path = bpe.tokenizer_path("byte_bpe_50k.tiktoken")
    out = f"file://{tmp_path}/a"
    manifest = shards.materialise_order(docs(spark, EDGES), out, path, seq_len=16, shard_slots=64, waves=3)
    rows = shards.read_shards(manifest, out, 16).orderBy("slot").collect()
    assert [r.slot for r in rows] == list(range(len(rows)))
    encoder = shards.encoder_of(open(path).read())
    for n, t in enumerate(EDGES):
        own = sorted((r.place, r.ids[: 2 * r.n_tokens]) for r in rows if r.doc_id == n)
        ids = np.frombuffer(b"".join(x for _, x in own), "<u2").tolist()
        assert ids == [*encoder.encode_ordinary(t or ""), 50256]
    assert shards.read_shards(manifest, out, 16, from_slot=100).orderBy("slot").collect() == rows[100:]
    assert shards.materialise_order(empty, f"file://{tmp_path}/b", path).count() == 0


# op9


def test_code_lengths_are_of_a_distribution():
    rng = np.random.default_rng(1)
    codes, counts = np.unique(rng.integers(97, 101, size=(400, 4)) @ np.array([1 << 24, 1 << 16, 1 << 8, 1]), return_counts=True)
    tree = langid.Tree(codes, counts.astype(float))
    for context in (0x616263, 0x626263, 0x999999, 0x996263, 0x999963):
        assert np.exp(-tree.costs(np.arange(256) + (context << 8))).sum() == pytest.approx(1)


def test_languages_are_told_apart(spark, empty):
    random.seed(10)
    make = lambda words: " ".join(random.choices(words, k=60))
    kinds = {"aa": ["the", "and", "then", "there"], "bb": ["der", "und", "dann", "dort"]}
    rows = [(n, make(kinds[k]), k) for n, k in enumerate(["aa", "bb"] * 40)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(table.where("doc_id < 60"), "doc_id", "text", "lang")
    got = {r.doc_id: r for r in langid.predict(table, model).collect()}
    assert all(got[n].lang_pred == k and 0.5 < got[n].score <= 1 for n, _, k in rows)
    edges = {r.doc_id: r for r in langid.predict(docs(spark, EDGES), model).collect()}
    assert [edges[n].lang_pred for n in (0, 1, 2, 3, 8)] == ["und"] * 5 and edges[0].score == 0
    assert langid.train(empty, "doc_id", "text", "lang") is None
    assert {r.lang_pred for r in langid.predict(docs(spark, EDGES), None).collect()} == {"und"}


def test_the_sample_shrinks_until_the_model_fits(spark, monkeypatch):
    random.seed(14)
    rows = [(n, "".join(random.choices("abcdefghij ", k=300)), ["aa", "bb"][n % 2]) for n in range(120)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    whole = langid.train(table, "doc_id", "text", "lang")
    monkeypatch.setattr(langid, "MODEL_CELLS", 4_000)
    less = langid.train(table, "doc_id", "text", "lang")
    assert less.langs == whole.langs and less.costs.size <= 4_000 + 2 < whole.costs.size
    with monkeypatch.context() as m:
        calls = []
        m.setattr(langid, "materialise", lambda df, real=langid.materialise: calls.append(1) or real(df))
        langid.train(table, "doc_id", "text", "lang")
        assert len(calls) > 1  # the first sample did not fit


# op10


def test_site_priors_move_documents(spark, empty):
    random.seed(11)
    good = lambda: " ".join("".join(random.choices("abcdefg", k=5)) for _ in range(60))
    bad = lambda: " ".join("".join(random.choices("ABC#", k=5)) for _ in range(60))
    rows = [(n, bad() if n % 4 == 0 else good(), "en", f"h{n % 3}") for n in range(200)]
    table = spark.createDataFrame([*rows, (None, None, None, None), (900, "", "en", None)], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(n, int(n % 4 != 0)) for n in range(0, 100)] + [(None, 1), (3, None)], "doc_id long, quality int")
    got = {r.doc_id: r for r in siteprior.posteriors(table, labels).collect()}
    assert len(got) == 202 and all(got[n].kept == (n % 4 != 0) for n in range(100, 200))
    assert all(0 <= r.quality <= 1 for r in got.values())
    assert siteprior.posteriors(empty, labels).count() == 0
    assert siteprior.posteriors(table, labels.where("false")).count() == 202


def test_break_even_lies_between_good_and_bad_rows_unseen():
    rng = np.random.default_rng(3)
    y = (np.arange(400) % 8 > 0).astype(float)
    x = np.column_stack([y + rng.normal(0, 0.1, 400), rng.normal(0, 1, 400)])
    fold = rng.integers(0, siteprior.FOLDS, 400)
    at = siteprior.break_even(x, y, fold)
    for k in range(siteprior.FOLDS):
        w = siteprior.fit(x[fold != k], y[fold != k])
        z = x[fold == k] @ w[:-1] + w[-1]
        assert ((z > at) == (y[fold == k] == 1)).mean() > 0.98
    assert siteprior.break_even(x, np.ones(400), fold) == 0.0
    assert siteprior.break_even(x[:3], np.array([1.0, 0.0, 1.0]), np.array([0, 0, 0])) == 0.0


@pytest.mark.parametrize("often", [2, 1024])
def test_join_by_count_is_a_join(spark, monkeypatch, often):
    monkeypatch.setattr(common, "OFTEN", often)
    rows = spark.range(100).select(F.expr("CASE WHEN id < 60 THEN 0 ELSE id % 7 END").alias("k"), "id")
    table = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("last"))
    got = sorted(map(tuple, common.join_by_count(rows, table, "k").select("k", "id", "last").collect()))
    assert got == sorted(map(tuple, rows.join(table.drop("n"), "k").select("k", "id", "last").collect()))
    assert common.join_by_count(rows.where("false"), table.where("false"), "k").count() == 0


def test_places_are_in_the_order_of_documents_and_lines(spark, empty):
    random.seed(13)
    ends = [0, 1, -1, 5, (1 << 63) - 1, linededup.NULL_DOC]
    told = [(d, n) for d in [*ends, *(random.randrange(-(1 << 62), 1 << 62) for _ in range(20))] for n in (0, 1, 7, (1 << 31) - 1)]
    docs_, numbers = (np.array(x, np.int64) for x in zip(*told, strict=True))
    assert [int(p) for p in linededup.place_of(docs_, numbers).to_pylist()] == [d * (1 << 32) + n for d, n in told]


def test_line_dedup_with_null_and_repeated_ids(spark):
    one, two = "the first line is here", "another line stands here"
    rows = [(None, f"{one}\n{two}", 1, "a"), (None, two, 2, "b"), (3, f"{two}\nonly here", 3, "c"), (3, f"{two}\nonly here", 3, "c"), (-5, one, 4, "d"), ((1 << 63) - 1, f"{one}\n\n{one}", 5, "e")]
    made = spark.createDataFrame(rows, "doc_id long, text string, doc long, row string")
    got = sorted(((r.doc_id is not None, r.doc_id or 0), r.text, r.row, r.line_dedup.n_removed, r.line_dedup.first_docs) for r in linededup.dedup_lines(made).collect())
    assert got == [
        ((False, 0), two, "b", 0, []),
        ((False, 0), one, "a", 1, []),
        ((True, -5), "", "d", 1, []),
        ((True, 3), "only here", "c", 1, []),
        ((True, 3), "only here", "c", 1, []),
        ((True, (1 << 63) - 1), "", "e", 2, []),
    ]


def test_lines_keep_their_bytes_and_places(spark):
    """Blank lines, carriage returns, NULs, beyond ASCII; texts in slices of a batch, null and empty ones between."""
    odd = ["\x1c", " \t\x0b\x0c\r", " ", " x\x85y", "é\x00", "z\r"]
    texts = ["\n".join([*odd, "same", "", "same"]), None, "", "\n", "same\n" + odd[3], " \n\nown\n"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {r.doc_id: (r.text, r.line_dedup.n_lines, r.line_dedup.n_removed) for r in linededup.dedup_lines(rows).collect()}
    assert got == {
        0: ("\n".join([*odd, "same", ""]), 7, 1),
        1: (None, 0, 0),
        2: ("", 0, 0),
        3: ("\n", 0, 0),
        4: ("", 2, 2),
        5: ("\nown\n", 2, 1),
    }
    lines = ["a b".encode(), "é\x00".encode()]
    assert [tuple(x) for x in linededup.line_hashes(lines).tolist()] == [linededup.line_hash(x) for x in lines]
    assert linededup.line_hashes([]).shape == (0, 2)
