"""N-gram Jaccard join with a token-group matrix, and the components of its links.

1. Frequencies. Documents move once, as compressed blocks; each block asks, for its distinct shingles, in how many
   documents of the corpus each occurs (two small shuffles of sorted, delta-coded hashes). A shingle of one document
   cannot be shared, so a document with fewer than 80 % shared shingles has no partner and leaves here; of the others
   the shared shingles stay, rarest first.
2. Groups. Documents of equal sets become one. The others are partitioned into groups of similar documents by min-hash,
   a few times with different hashes; large groups are cut, and one document of the group, the pivot, joins every part.
   Inside a group the shingle-by-document matrix gives all overlaps by one product; links leave as spanning stars, whose
   components are found at once, so that a family of thousands is one component before any further pair is looked at.
3. The token-group matrix: for each shingle, the groups that have it among their documents' rarest 20 %.
   Two documents that link share one of those, so joining it with a document's own gives every group that can hold a
   partner. Only pairs of different components matter, asked from the smaller one, and only where sizes allow a link.
4. Bounds. A group's token union bounds its overlap with a query: below 80 % of the query's shingles no member can link,
   and the group stays closed. Groups that qualify are opened and their documents compared exactly.
Every step is exact for the links it may skip: those within a component that is connected already. Shingles are compared by
hashes of 64 bits: two different ones of a pair of documents agree with a probability of 2 ** -64 for each two, which can
move a similarity by one shingle and is not looked into further.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillset.llm.blocks import ask_and_answer, block_count, mix64, to_blocks
from rillset.llm.common import materialize, n_parts, release, select_text, tidied_group
from rillset.llm.graph import connected_components
from rillset.llm.shingles import shingle_sets

PERCENT = 80
ROUNDS = 3
GROUP_DOCS, GROUP_TOKENS = 512, 600_000
QUERIES_PER_CELL = 512
KEY_BITS = 44
SALTS = 16
DF_MOST = 65_535


def _least_overlap(n: np.ndarray, percent: int) -> np.ndarray:
    return -(-percent * n // 100)


def _planes(x: np.ndarray, width: int) -> bytes:
    """Integers as compressed byte planes; small numbers cost little."""
    raw = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _from_planes(b: bytes, width: int) -> np.ndarray:
    raw = pa.decompress(b[8:], int.from_bytes(b[:8], "little"), codec="zstd", asbytes=True)
    wide = np.zeros((len(raw) // width, 8), np.uint8)
    wide[:, :width] = np.frombuffer(raw, np.uint8).reshape(width, -1).T
    return wide.reshape(-1).view("<u8")


def shared_shingles(docs: DataFrame, percent: int = PERCENT, n: int | None = None) -> DataFrame:
    """(doc_id, n_shingles, tokens, prefix, keys): tokens, the shared shingles, are null where no partner is possible.

    prefix: the rarest of them, as many as two linked documents cannot both be without; keys: min-hashes for groups.
    """
    n = n or block_count(docs)
    shift = np.uint64(64 - KEY_BITS)
    # slices are ranges of the key, so that a block's sorted keys are cut, not dealt
    edges = np.array([(k << KEY_BITS) // n for k in range(n + 1)], np.uint64)

    def keys_of(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.unique(tokens >> shift, return_inverse=True, return_counts=True)

    def ask(table: pa.Table) -> Iterator[tuple[int, bytes]]:
        keys, _, counts = keys_of(shingle_sets(table.column("text").combine_chunks())[0])
        bounds = np.searchsorted(keys, edges)
        for k in range(n):
            a, z = bounds[k], bounds[k + 1]
            if z > a:
                gaps = np.diff(keys[a:z], prepend=np.uint64(edges[k]))
                head = _planes(gaps, 6)
                yield k, len(head).to_bytes(8, "little") + head + _planes(np.minimum(counts[a:z], DF_MOST), 2)

    def answer(asked: list[bytes]) -> list[bytes]:
        keys, counts = [], []
        for b in asked:
            size = int.from_bytes(b[:8], "little")
            keys.append(np.cumsum(_from_planes(b[8 : 8 + size], 6), dtype=np.uint64))
            counts.append(_from_planes(b[8 + size :], 2).astype(np.int64))
        # the slice's start is the same for all, so sums of gaps compare as they are
        ends = np.cumsum([len(x) for x in keys])
        _, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(inverse, weights=np.concatenate(counts))[inverse]
        frequency = np.minimum(total, DF_MOST).astype(np.uint64)
        return [_planes(frequency[z - len(x) : z], 2) for x, z in zip(keys, ends)]

    def finish(table: pa.Table, replies: dict[int, bytes]) -> pa.Table:
        tokens, offsets = shingle_sets(table.column("text").combine_chunks())
        keys, inverse, _ = keys_of(tokens)
        frequency = np.concatenate([_from_planes(replies[k], 2) for k in sorted(replies)]).astype(np.int64) if replies else np.zeros(0, np.int64)
        if len(frequency) != len(keys):
            raise ValueError(f"{len(keys)} shingles asked, {len(frequency)} answers")
        frequency = frequency[inverse] if len(keys) else frequency
        sizes = np.diff(offsets)
        shared = np.diff(np.concatenate([[0], np.cumsum(frequency > 1)])[offsets])
        least = _least_overlap(sizes, percent)
        sets, prefixes, minima = [], [], []
        for d, (a, z) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
            if z == a or shared[d] < least[d]:
                sets.append(None)
                prefixes.append(None)
                minima.append(None)
                continue
            both = frequency[a:z] > 1
            own, often = tokens[a:z][both], frequency[a:z][both]
            sets.append(own.tobytes())
            rarest = np.argsort(often, kind="stable")[: int(shared[d] - least[d] + 1)]
            prefixes.append(own[rarest].view(np.int64))
            minima.append([int(mix64(own ^ np.uint64(7919 * r + 13)).min().view(np.int64)) for r in range(ROUNDS)])
        return pa.table(
            {
                "doc_id": table.column("doc_id"), "n_shingles": pa.array(sizes.astype(np.int64)), "tokens": pa.array(sets, pa.binary()),
                "prefix": pa.array(prefixes, pa.list_(pa.int64())), "keys": pa.array(minima, pa.list_(pa.int64())),
            }
        )

    return ask_and_answer(to_blocks(docs, n), n, ask, answer, finish, "doc_id long, n_shingles long, tokens binary, prefix array<bigint>, keys array<bigint>")


def _linked(x: list[np.ndarray], sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The linked pairs (i < j) among sets, from the product of their shingle matrix, some thousand columns at a time."""
    k = len(x)
    _, column = np.unique(np.concatenate(x), return_inverse=True)
    row = np.repeat(np.arange(k), [len(t) for t in x])
    width = int(column.max()) + 1
    step = min(width, max(256, (1 << 22) // k))
    overlap = np.zeros((k, k), np.int64)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    bounds = np.searchsorted(column, np.arange(0, width + step, step))
    for b, (a, z) in enumerate(zip(bounds[:-1], bounds[1:])):
        if z > a:
            m = np.zeros((k, step), np.float32)
            m[row[a:z], column[a:z] - b * step] = 1
            overlap += np.rint(m @ m.T).astype(np.int64)
    union = sizes[:, None] + sizes[None, :] - overlap
    i, j = np.nonzero(np.triu(100 * overlap >= percent * union, 1))
    return i, j


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def _sets(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in column.to_pylist()]


def _runs(values: np.ndarray) -> Iterator[tuple[int, int]]:
    starts = np.flatnonzero(np.concatenate([np.ones(min(1, len(values)), bool), values[1:] != values[:-1]]))
    yield from zip(starts.tolist(), [*starts[1:].tolist(), len(values)])


def similar_groups(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, n_shingles and component_id, the smallest doc_id reachable by links.

    Two documents link when their sets of five-word shingles have a Jaccard similarity of percent / 100 or more. A text
    without words (null, empty, white space) has no shingle and links with nothing; one of fewer than five words has its
    whole sequence as its one shingle. Ids are taken as unique: rows that repeat one share a component, and a null id has
    itself (null). An empty table gives no rows.
    """
    spark = docs.sparkSession
    base = select_text(docs, id_col, text_col)
    all_docs = materialize(shared_shingles(base, percent), "shingles")
    alive = all_docs.where("tokens is not null and doc_id is not null")
    # equal sets are one document from here on; only sets all of whose shingles are shared can have an equal
    whole = F.length("tokens") == 8 * F.col("n_shingles")
    slim = materialize(
        alive.select("doc_id", F.col("n_shingles").alias("n"), (F.length("tokens") / 8).cast("long").alias("m"), "keys", F.when(whole, F.sha2("tokens", 256)).alias("same"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt")), "similar-slim"
    )
    equal = slim.where("same is not null").groupBy("same").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("c")).where("c > 1")
    spread = equal.select("same", "rep", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    slim = materialize(slim.join(spread, ["same", "salt"], "left").select("doc_id", F.coalesce("rep", "doc_id").alias("rep"), "n", "m", "keys"), "similar-reps")
    reps = slim.where("rep = doc_id").dropDuplicates(["doc_id"])

    keyed = reps.select("doc_id", "m", F.posexplode("keys").alias("round", "key"))
    sizes = materialize(
        keyed.groupBy("round", "key").agg(F.count(F.lit(1)).alias("c"), F.sum("m").alias("t"), F.min("doc_id").alias("pivot")).where("c > 1")
        .select("round", "key", "pivot", F.greatest(F.ceil(F.col("c") / GROUP_DOCS), F.ceil(F.col("t") / GROUP_TOKENS)).cast("int").alias("parts")), "similar-groups"
    )
    part = F.pmod(F.hash("doc_id"), F.coalesce("parts", F.lit(1)))
    group = lambda p: F.xxhash64("round", "key", p.cast("int"))
    inside = keyed.join(sizes, ["round", "key"]).select("doc_id", group(part).alias("g"))
    pivots = sizes.where("parts > 1").select("round", "key", F.col("pivot").alias("doc_id"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("p")).select("doc_id", group(F.col("p")).alias("g"))
    cells = 4 * n_parts(spark)
    cell = lambda *c: F.pmod(F.xxhash64(*c), F.lit(cells)).cast("int").alias("cell")

    def cluster(table: pa.Table) -> pa.Table:
        table = table.take(pa.array(np.lexsort((table.column("doc_id").to_numpy(), table.column("g").to_numpy()))))
        ids, sizes = table.column("doc_id").to_numpy(), table.column("n_shingles").to_numpy()
        sets, one, other = _sets(table.column("tokens")), [], []
        for a, z in _runs(table.column("g").to_numpy()):
            if z - a > 1:
                root = _roots(z - a, *_linked(sets[a:z], sizes[a:z], percent))
                moved = np.flatnonzero(root != np.arange(z - a))
                one.append(ids[a + moved])
                other.append(ids[a + root[moved]])
        none = np.zeros(0, np.int64)
        return pa.table({"doc_id": np.concatenate([*one, none]), "root": np.concatenate([*other, none])})

    sets = alive.select("doc_id", "n_shingles", "tokens")
    stars = inside.union(pivots).distinct().join(sets, "doc_id").withColumn("cell", cell("g")).groupBy("cell").applyInArrow(tidied_group(cluster), "doc_id long, root long")
    near = connected_components(stars, "doc_id", "root").withColumnRenamed("node", "doc_id")

    first = F.col("keys")[0]
    homes = reps.select("doc_id", "n", F.lit(0).alias("round"), first.alias("key")).join(sizes.select("round", "key", "parts"), ["round", "key"], "left").select("doc_id", "n", group(part).alias("g"))
    homes = materialize(homes.join(near, "doc_id", "left").select("doc_id", "n", "g", F.coalesce("component", "doc_id").alias("comp")), "similar-homes")
    weights = homes.groupBy("comp").agg(F.count(F.lit(1)).alias("w"))
    # (weight, component) in one number would not fit; a struct orders alike
    known = homes.join(weights, "comp").select("doc_id", "n", "g", F.struct("w", "comp").alias("comp"))
    postings = known.join(alive.select("doc_id", "prefix"), "doc_id").select(F.explode("prefix").alias("token"), "doc_id", "n", "g", "comp")
    postings = materialize(postings, "similar-postings")
    split = postings.groupBy("token").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a <> b").select("token")
    live = materialize(postings.join(split, "token"), "similar-live")
    # one row for each shingle and group, whatever components the group's documents are of
    matrix = live.groupBy("token", "g").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max("comp").alias("other"))
    # documents of one group have met already, in step 2
    fits = (F.col("g") != F.col("h")) & (F.col("comp") < F.col("other")) & (F.col("n") * percent <= 100 * F.col("high")) & (F.col("low") * percent <= 100 * F.col("n"))
    asked = materialize(live.join(matrix.withColumnRenamed("g", "h"), "token").where(fits).select("doc_id", F.col("h").alias("g")).distinct(), "similar-asked")
    release(postings, live, sizes)

    final = near_by_links(spark, asked, homes, sets, percent, cells)
    labels = homes.select("doc_id", "comp").join(final, "comp", "left").select(F.col("doc_id").alias("rep"), F.coalesce("component", "comp").alias("component"))
    found = slim.select("doc_id", "rep").join(labels, "rep").select("doc_id", "component").distinct()
    return all_docs.select("doc_id", "n_shingles").join(found, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def near_by_links(spark, asked: DataFrame, homes: DataFrame, sets: DataFrame, percent: int, cells: int) -> DataFrame:
    """(comp, component) of components that the asked (doc_id, g) pairs turn out to link; bounds first, then exact overlaps."""
    per_group = asked.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / QUERIES_PER_CELL).cast("int").alias("parts"))
    per_group = materialize(per_group, "similar-open")
    part = F.pmod(F.hash("doc_id"), F.col("parts"))
    about = homes.select("doc_id", "comp").join(sets, "doc_id")
    queries = asked.join(per_group, "g").select("doc_id", "g", part.alias("p")).join(about, "doc_id")
    members = homes.join(per_group, "g").select("doc_id", "g", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("p")).join(about, "doc_id")
    columns = ["cell", "doc_id", "g", "p", "comp", "n_shingles", "tokens"]
    cell = F.pmod(F.xxhash64("g", "p"), F.lit(cells)).cast("int").alias("cell")
    left = queries.withColumn("cell", cell).select(*columns)
    right = members.withColumn("cell", cell).select(*[F.col(c).alias(f"m_{c}") for c in columns])

    def spans(table: pa.Table) -> tuple[pa.Table, dict[tuple[int, int], tuple[int, int]]]:
        g, p = table.column("g").to_numpy(), table.column("p").to_numpy()
        order = np.lexsort((p, g))
        g, p = g[order], p[order]
        starts = [0, *(np.flatnonzero((g[1:] != g[:-1]) | (p[1:] != p[:-1])) + 1).tolist()] if len(g) else []
        return table.take(pa.array(order)), {(int(g[a]), int(p[a])): (a, z) for a, z in zip(starts, [*starts[1:], len(g)])}

    def open_groups(q: pa.Table, m: pa.Table) -> pa.Table:
        (q, by_q), (m, by_m) = spans(q), spans(m.rename_columns([c.removeprefix("m_") for c in m.column_names]))
        q_sets, m_sets = _sets(q.column("tokens")), _sets(m.column("tokens"))
        q_n, m_n = q.column("n_shingles").to_numpy(), m.column("n_shingles").to_numpy()
        q_comp, m_comp = q.column("comp").to_numpy(), m.column("comp").to_numpy()
        least, found = _least_overlap(q_n, percent), set()
        for key, (a, z) in by_q.items():
            if key not in by_m:
                continue
            c, e = by_m[key]
            union, column = np.unique(np.concatenate(m_sets[c:e]), return_inverse=True)
            row = np.repeat(np.arange(e - c), [len(x) for x in m_sets[c:e]])
            for i in range(a, z):
                at = np.minimum(np.searchsorted(union, q_sets[i]), len(union) - 1)
                hit = at[union[at] == q_sets[i]]
                if len(hit) < least[i]:
                    continue  # the union bounds every member's overlap
                has = np.zeros(len(union), bool)
                has[hit] = True
                overlap = np.bincount(row[has[column]], minlength=e - c)
                link = (100 * overlap >= percent * (q_n[i] + m_n[c:e] - overlap)) & (m_comp[c:e] != q_comp[i])
                found.update((int(q_comp[i]), int(x)) for x in m_comp[c:e][link])
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    links = left.groupBy("cell").cogroup(right.groupBy("m_cell")).applyInArrow(tidied_group(open_groups), "a long, b long")
    out = connected_components(links, "a", "b").withColumnRenamed("node", "comp")
    release(asked, per_group)
    return out
