import pytest

import corpus_pipeline

TABLES = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_clean_documents(spark):
    rows = corpus_pipeline.run(spark, TABLES).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{TABLES}/documents.parquet").collect()}
    assert 0 < len(rows) < len(docs) and len({r.doc_id for r in rows}) == len(rows)
    assert all(len(r.ids) == 4 * r.n_tokens for r in rows)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "simhash_dedup", "decontaminate", "bpe"]


def test_first_stage_drops_what_the_rules_reject(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    kept = corpus_pipeline.quality_rules(spark, docs, TABLES)
    assert kept.columns == docs.columns
    words = {r.doc_id: len(r.text.split()) for r in docs.collect()}
    assert all(words[r.doc_id] >= 50 for r in kept.select("doc_id").collect())


def test_one_row_of_a_group_stays(spark):
    long = " ".join(f"word{n}" for n in range(400))
    rows = [(1, long, "b"), (1, long, "a"), (1, long + " word400", "c"), (2, long, "d"), (None, "no id " * 9, "e"), (None, "no id " * 9, "e")]
    rows += [(None, "another text without an id", "f"), (3, "alone in its group here", "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = corpus_pipeline.simhash_dedup(spark, docs, TABLES)
    groups = {(r.doc_id, r.row_hash): r.root for r in corpus_pipeline.near_duplicates(docs).collect()}
    assert kept.columns == docs.columns and kept.count() == len(set(groups.values()))
    got = sorted((str(r.doc_id), r.source) for r in kept.collect())
    assert len(got) == len({s for _, s in got}) and ("3", "g") in got and ("None", "e") in got and ("None", "f") in got
    assert ("1", "b") not in got and ("2", "d") not in got


EDGE = "doc_id long, text string, lang string, source string, n_chars long, row string, key long, place int"
PLAIN = " ".join(f"plain{n}" for n in range(120))


def edges(spark):
    """Null ids and texts, empty and long texts, ties, repeated rows, and columns named like helpers."""
    texts = [None, "", " \n ", "a", PLAIN, PLAIN + " more", "word " * 20_000, "é日本🙂 " * 60, "one line\n" * 3 + PLAIN]
    rows = [(n, t, "en", "s", len(t or ""), "r", 7, n) for n, t in enumerate(texts)]
    rows += [rows[4], rows[4], (None, PLAIN, None, None, 1, None, None, None), (None, None, "en", "s", 0, "r", 1, 2), (4, "another text under one id", "en", "s", 25, "r", 1, 2)]
    return spark.createDataFrame(rows, EDGE)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_edges_and_empty_tables(spark, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = edges(spark)
    given = docs.collect()
    kept = stage(spark, docs, TABLES)
    rows = kept.collect()
    assert stage(spark, docs.where("false"), TABLES).count() == 0
    if name == "bpe":
        assert len(rows) == len(given) and all(r.n_tokens == 0 for r in rows if r.doc_id in (0, 1))
        return
    assert kept.columns == docs.columns and kept.schema == docs.schema
    if name == "line_dedup":
        text_of = {(r.doc_id, r.place): r.text or "" for r in given}
        assert all(set((r.text or "").split("\n")) <= set(text_of[r.doc_id, r.place].split("\n")) for r in rows)
    else:
        assert {repr(r) for r in rows} <= {repr(r) for r in given}
    if name == "decontaminate":
        assert len(rows) == len(given)
    if name == "simhash_dedup":
        assert sum(r.text == PLAIN for r in rows) <= 1
