"""The pipeline's stages against brute force over a small corpus."""

import os
import random

import pytest
from helpers import ODD_TEXTS, TOKENIZER, components, prose, shingles
from tokenizers import Tokenizer

import corpus_pipeline
from rillset.llm import packing, queries
from rillset.llm.common import materialize

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, rows = random.Random(6), []
    for i in range(150):
        words = prose(rng, rng.randint(20, 60)).split(" ")
        for bad in ("wretch", "fiendish", "wretch") if i % 10 == 0 else ("a.b@mail.example.com",) if i % 10 == 1 else ():
            words.insert(rng.randrange(1, len(words)), bad)
        rows.append((i, " ".join(words)))
    rows += [(200 + i, rows[i + 2][1]) for i in range(5)] + [(300 + i, rows[i + 2][1] + " again") for i in range(5)] + [(400 + i, t) for i, t in enumerate(ODD_TEXTS)]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 10 == 0)) for i in range(150)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, dict(rows)


def test_stages(spark, folder):
    path, texts = folder
    docs, seen = spark.read.parquet(f"{path}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, path), "test-stage")
        seen[name] = docs.collect()
        assert name == "packing" or docs.columns == columns
    kept = {r.doc_id for r in seen["toxicity"]}
    assert kept == {i for i in texts if not (i < 150 and i % 10 == 0)}
    best = {}
    for i in kept:
        best[texts[i] or ""] = max(i, best.get(texts[i] or "", -1))
    kept = set(best.values())
    assert {r.doc_id for r in seen["exact_dedup"]} == kept
    sets = {i: shingles(texts[i]) for i in kept}
    links = [(i, j) for i in kept for j in kept if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    kept = set(components(kept, links).values())
    assert {r.doc_id for r in seen["ngram_join"]} == kept and links
    masked = {r.doc_id: r for r in seen["pii"]}
    assert set(masked) == kept
    for i, r in masked.items():
        want = texts[i] and texts[i].replace("a.b@mail.example.com", "<EMAIL>")
        assert r.text == want and r.n_chars == (None if want is None else len(want))
    lib, tokens = Tokenizer.from_file(TOKENIZER), {}
    for r in seen["packing"]:
        tokens[r.doc_id] = tokens.get(r.doc_id, 0) + r.length
    assert tokens == {i: len(lib.encode(r.text or "", add_special_tokens=False).ids) + 1 for i, r in masked.items()}


def test_stages_go_by_row_and_take_odd_tables(spark, folder):
    path, _ = folder
    rng = random.Random(8)
    a, b, c = (prose(rng, 40) for _ in range(3))
    schema = "doc_id long, text string, lang string, source string, n_chars long, component_id string, __n string"
    rows = [(5, a, "x"), (5, b, "y"), (9, b, "z"), (9, b, "y"), (5, b + " more", "x"), (2, c, "x"), (None, c + " more", "x"), (None, None, "x"), (7, "", "x"), (1, a + " more", "x")]
    df = spark.createDataFrame([(i, t, k, "s", None if t is None else len(t), "clash", "clash") for i, t, k in rows], schema).repartition(3)
    stages = dict(corpus_pipeline.STAGES)
    left = materialize(stages["exact_dedup"](spark, df, path), "test-odd")
    assert sorted((r.doc_id or 0, r.text or "", r.lang) for r in left.collect()) == sorted((i or 0, t or "", k) for i, t, k in [rows[0], rows[3], rows[4], rows[5], rows[6], rows[8], rows[9]])
    left = materialize(stages["ngram_join"](spark, left, path), "test-odd")
    assert sorted((r.doc_id or 0, r.text) for r in left.collect()) == sorted([(1, a + " more"), (9, b), (2, c), (7, "")]) and left.columns == df.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df.limit(0), path)
        assert out.count() == 0 and (name == "packing" or out.columns == df.columns)
        assert stage(spark, df, path).count() > 0


def test_run_and_registration(spark, folder):
    path, _ = folder
    assert "sequence_id" in corpus_pipeline.run(spark, path).columns
    assert set(corpus_pipeline.queries()) == {"pipeline"} and not corpus_pipeline.oracle_sql()
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names] == [f"op{k}" for k in range(1, 11)]
    assert set(queries.oracle_sql()) <= set(names)
    assert packing.cut(0) == []


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["op1_licenses", "op2_pii", "op7_exact_dedup"])
def test_sql(spark, name):
    import duckdb

    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got, want = queries.queries()[name](spark, SF), duck.sql(queries.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    place = [want.columns.index(c) for c in columns]
    assert sorted(str(tuple(r[c] for c in columns)) for r in got.collect()) == sorted(str(tuple(r[i] for i in place)) for r in want.fetchall())
