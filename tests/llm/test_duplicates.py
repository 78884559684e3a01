"""Exact copies, near copies, near embeddings, against brute force."""

import hashlib
import random

import numpy as np
import pytest
from helpers import ODD_TEXTS, components, docs, empty, prose, shingles

from rillset.llm import embedding_dedup, exact_dedup, graph, ngram_join
from rillset.llm.exact_dedup import CountingQuotientFilter


def test_quotient_filters_merge_losslessly():
    rng = np.random.default_rng(3)
    values = rng.integers(0, 1 << 63, 4000, dtype=np.uint64) * np.uint64(2)
    values = np.concatenate([values, values[:500], np.repeat(values[7], 300), np.array([0, 0, (1 << 64) - 1], np.uint64)])
    rng.shuffle(values)
    slices = {}
    for part in np.array_split(values, 5):
        for k, f in CountingQuotientFilter.build(part, 12).slices(8):
            slices.setdefault(k, []).append(CountingQuotientFilter.from_bytes(f.to_bytes()))
    whole = [CountingQuotientFilter.merge(x) for x in slices.values()]
    want, counts = np.unique(values, return_counts=True)
    got = np.concatenate([w.fingerprints() for w in whole])
    order = np.argsort(got)
    assert (got[order] == want).all() and (np.concatenate([w.counts for w in whole])[order] == counts).all()


def test_exact_groups(spark):
    texts = [*ODD_TEXTS, "copy", "copy", "copy", "Copy", "x" * 5000, ""]
    df = docs(spark, texts).union(docs(spark, ["copy"], 10**6)).union(spark.createDataFrame([(None, "copy", None, None, None, None, None)], docs(spark, [""]).schema))
    rows = [(i, t or "") for i, t in enumerate(texts)] + [(10**6, "copy"), (None, "copy")]
    best, size = {}, {}
    for i, t in rows:
        best[t] = max(best.get(t, -1), -1 if i is None else i)
        size[t] = size.get(t, 0) + 1
    out = exact_dedup.exact_groups(df).collect()
    assert len(out) == len(rows)
    known = {i: t for i, t in rows}
    for r in out:
        t = known[r.doc_id]
        assert (r.keep_id, r.group_size, r.kept) == (best[t], size[t], r.doc_id == best[t]) and r.text_sha256 == hashlib.sha256(t.encode()).hexdigest()
    assert exact_dedup.exact_groups(empty(spark)).count() == 0


def test_few_unique_texts_pass_the_filter(spark):
    df = docs(spark, [f"text {i}" for i in range(4000)] + ["copy"] * 2000 + [f"pair {i // 2}" for i in range(40)])
    copies = exact_dedup._Copies(df, "doc_id", "text")
    assert 2040 <= copies.suspects.count() <= 2100 and copies.groups.count() == 21
    assert copies.suspects.count() + copies.alone.count() == df.count()
    sizes = [r.group_size for r in exact_dedup.exact_groups(df).collect()]
    assert sizes.count(2000) == 2000 and sizes.count(2) == 40 and sizes.count(1) == 4000


def test_distinct_texts_go_by_row(spark):
    schema = "doc_id long, text string, lang string, keep_id long, __row string"
    rows = [(5, "a", "x", 1, "r"), (5, "b", "y", 2, "r"), (9, "b", "z", 3, "r"), (9, "b", "a", 4, "r"), (None, "", "n", 5, "r"), (None, None, "m", 6, "r"), (None, "b", "q", 7, "r"), (3, "c", "u", 8, None)]
    df = spark.createDataFrame(rows, schema).repartition(3)
    out = exact_dedup.distinct_texts(df)
    assert out.columns == df.columns
    assert {tuple(r) for r in out.collect()} == {rows[0], rows[3], rows[5], rows[7]} and out.count() == 4
    assert exact_dedup.distinct_texts(df.limit(0)).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (7, 7), (200, 150), (150, 200)]
    out = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(chain, "src long, dst long")).collect()}
    want = components({x for e in chain for x in e if e[0] != e[1]}, chain)
    assert out == want


def near(rng, text, n):
    words = text.split(" ")
    for _ in range(n):
        words[rng.randrange(len(words))] = prose(rng, 1) + "q"
    return " ".join(words)


def test_similar_groups(spark, monkeypatch):
    # small groups, so that cut groups, pivots and opened groups are all met
    monkeypatch.setattr(ngram_join, "GROUP_DOCS", 6)
    monkeypatch.setattr(ngram_join, "QUERIES_PER_CELL", 3)
    rng = random.Random(9)
    base, passage = prose(rng, 120), prose(rng, 30)
    texts = [near(rng, base, rng.randint(0, 9)) for _ in range(40)] + [passage + " " + prose(rng, 60) for _ in range(20)]
    texts += [prose(rng, 80) for _ in range(10)] + ["one two three", "ONE two  three", "One Two", *ODD_TEXTS, base, base.upper(), base]
    for k in range(6):
        other = prose(rng, 50 + 20 * k)
        texts += [other, near(rng, other, 1), near(rng, other, 2)]
    sets = [shingles(t) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    want = components(range(len(texts)), links)
    out = {r.doc_id: r for r in ngram_join.similar_groups(docs(spark, texts)).collect()}
    assert {i: r.component_id for i, r in out.items()} == want
    assert all(out[i].n_shingles == len(s) for i, s in enumerate(sets))
    assert len({*want.values()}) < len(texts) - 20
    assert ngram_join.similar_groups(empty(spark)).count() == 0


def test_threshold_is_exact(spark):
    """Similarities of exactly 0.8 link, the next lower does not."""
    words = [f"w{i}" for i in range(400)]
    # 36 shingles each; 32 shared of 40 is 0.8 exactly, 31 of 41 is less
    a, b, c = words[:40], words[4:44], words[100:140]
    d = words[105:145]
    out = {r.doc_id: r.component_id for r in ngram_join.similar_groups(docs(spark, [" ".join(x) for x in (a, b, c, d)])).collect()}
    assert out == {0: 0, 1: 0, 2: 2, 3: 3}


def test_near_vectors(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 8)
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(6, 32))
    rows = [(c + 0.12 * rng.normal(size=32)).tolist() for c in centers for _ in range(12)] + rng.normal(size=(60, 32)).tolist()
    rows += [rows[0], rows[0], (np.array(rows[1]) * 3).tolist()]
    odd = [None, [], [0.0] * 32, [None] + [1.0] * 31, [float("nan")] * 32, [float("inf")] + [0.0] * 31]
    table = spark.createDataFrame([(i, v, "clash", 1) for i, v in enumerate(rows + odd)], "vec_id long, embedding array<double>, n_links string, members int").repartition(3)
    x = np.array(rows)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = x @ x.T >= 0.95
    np.fill_diagonal(linked, False)
    want = components(range(len(rows) + len(odd)), [(int(i), int(j)) for i, j in zip(*np.nonzero(linked))])
    out = {r.vec_id: r for r in embedding_dedup.near_duplicate_vectors(table, block=8).collect()}
    found = sum(out[i].n_links for i in range(len(rows)))
    assert 0.98 * linked.sum() <= found <= linked.sum() > 100 and all(out[i].n_links <= linked[i].sum() for i in range(len(rows)))
    assert {i: r.component_id for i, r in out.items()} == want and all(r.kept == (i == r.component_id) for i, r in out.items())
    assert all(out[len(rows) + k].n_links == 0 for k in range(len(odd)))
    assert embedding_dedup.near_duplicate_vectors(table.limit(0)).count() == 0


def test_recall_of_vectors_at_the_threshold_holds_with_more_hashes(spark):
    """Large tables use more hashes; pairs just above the threshold are still found."""
    rng, n = np.random.default_rng(7), 80
    a, b = rng.normal(size=(2, n, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(1, keepdims=True) * a
    b *= np.sqrt(1 - 0.9501**2) / np.linalg.norm(b, axis=1, keepdims=True)
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([a, 0.9501 * a + b]))]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = embedding_dedup.near_duplicate_vectors(table, hashes=4).collect()
    assert sum(r.n_links for r in out) == 2 * n and all(r.n_links <= 1 for r in out)


@pytest.mark.parametrize("width", [32, 64, 128, 256])
def test_recall_at_the_threshold_for_every_number_of_hashes(width):
    rng, n, threshold = np.random.default_rng(77), 200, 0.95
    a, b = rng.normal(size=(2, n, width))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(1, keepdims=True) * a
    b *= np.sqrt(1 - threshold**2) / np.linalg.norm(b, axis=1, keepdims=True)
    for hashes in range(1, 6 if width < 256 else 5):
        tables = embedding_dedup.tables_for(width, threshold, hashes)
        x, y = (np.concatenate([own[:, :, None], probes], 2) for own, probes in (embedding_dedup.bucket_codes(v, tables, hashes) for v in (a, threshold * a + b)))
        assert (x[:, :, :, None] == y[:, :, None, :]).any((1, 2, 3)).mean() >= 0.99


def test_vectors_of_several_widths_families_and_odd_rows(spark, monkeypatch):
    """Planted families, a hot vector, several widths, nulls and clashing columns, against all pairs; few pairs held at a time."""
    monkeypatch.setattr(embedding_dedup, "PAIRS", 500)
    rng, rows = np.random.default_rng(5), []
    for width in (8, 24):
        centres = rng.normal(size=(12, width))
        for i in range(140):
            rows.append((centres[i % 12] + rng.normal(size=width) * (0.01 if i % 2 else 0.25)).tolist())
        rows += [[1.0] * width] * 70
    rows += [None, [], [0.0] * 8, [float("nan")] * 8, [float("inf")] + [1.0] * 7, [1.0, None] + [1.0] * 6]
    ids = list(range(100, 100 + len(rows)))
    table = spark.createDataFrame([(i, v, "x", 5) for i, v in zip(ids, rows)] + [(None, [1.0] * 8, "x", 5)], "vec_id long, embedding array<double>, bucket string, members int").repartition(3)
    out = {r.vec_id: r for r in embedding_dedup.near_duplicate_vectors(table, block=40).collect()}
    sound = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for v in rows]
    links = []
    for i, v in enumerate(rows):
        for j in range(i):
            if sound[i] and sound[j] and len(v) == len(rows[j]):
                x, y = np.array(v), np.array(rows[j])
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.95 or v == rows[j]:
                    links.append((ids[i], ids[j]))
    want, degree = components(ids, links), {i: 0 for i in ids}
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    assert len(links) > 3000 and len(out) == len(ids) + 1 and out[None].n_links == 0
    assert all((out[i].n_links, out[i].component_id, out[i].kept) == (degree[i], want[i], want[i] == i) for i in ids)


def test_components_of_hubs_and_long_chains(spark, monkeypatch):
    """A hub of most edges, chains, null ends: the hub's edges meet by a broadcast, and the result is the same."""
    monkeypatch.setattr(graph, "FEW", 0)
    rng = random.Random(9)
    links = [(7000, i) for i in range(2000)] + [(i, i + 1) for i in range(3000, 3300)] + [(rng.randrange(4000, 6000), rng.randrange(4000, 6000)) for _ in range(700)]
    rng.shuffle(links)
    df = spark.createDataFrame([*links, (None, 3), (4, 4), (9, None)], "src long, dst long").repartition(3)
    got = {r.node: r.component for r in graph.connected_components(df).collect()}
    links = [(a, b) for a, b in links if a != b]
    nodes = {x for link in links for x in link}
    assert got == components(nodes, links)
    hot = {r.src for r in graph._hot(df.where("src is not null"), "src").collect()}
    assert 7000 in hot and len(hot) < 1000
