"""The registered queries of the corpus operators, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rillset.llm.licenses import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rillset.llm.pii import digest, find_pii

    return digest(find_pii(table(spark, sf_dir, "documents")))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rillset.llm.embedding_dedup import near_duplicate_vectors

    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rillset.llm.toxicity import score_toxicity

    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rillset.llm.bpe import encode_documents

    return encode_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rillset.llm.ngram_join import similar_groups

    return similar_groups(table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rillset.llm.exact_dedup import exact_groups

    return exact_groups(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rillset.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rillset.llm.quality import score_quality

    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rillset.llm.common import scratch_path
    from rillset.llm.token_files import read_token_files, write_token_files

    folder = scratch_path(spark, "tokens")
    write_token_files(table(spark, sf_dir, "documents"), folder, tokenizer_path())
    return read_token_files(spark, folder)


def op1_sql() -> str:
    from rillset.llm.licenses import LONG, TEMPLATES, THRESHOLD, anchors_of, bigrams_of, size_bounds, words_of

    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    rows = ", ".join(f"({quoted(k)}, [{', '.join(map(quoted, bigrams_of(v)))}], {len(words_of(v)) - 1}, {', '.join(map(str, size_bounds(len(bigrams_of(v)), THRESHOLD)))})" for k, v in TEMPLATES.items())
    places = ", ".join(f"({quoted(k)}, {quoted(pair)}, {at})" for k, v in TEMPLATES.items() for pair, at in anchors_of(v))
    return f"""
WITH t(license, want, size, least, most) AS (VALUES {rows}), anchor(license, pair, place) AS (VALUES {places}),
cut AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS lines,
               string_split_regex(coalesce(text, ''), '\\n[ \\t\\r]*\\n') AS paragraphs FROM documents),
seg AS (SELECT r, unnest(list_concat(lines,
            CASE WHEN len(paragraphs) > 1 THEN list_filter(paragraphs, lambda p: contains(p, chr(10))) ELSE [] END,
            CASE WHEN len(lines) > 1 THEN [text] ELSE [] END)) AS s FROM cut),
w AS (SELECT r, list_filter(string_split_regex(lower(s), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM seg),
b AS (SELECT r, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS have FROM w WHERE len(w) > 1),
every AS (SELECT r, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM cut),
pairs AS (SELECT r, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS p FROM every WHERE len(w) > 1),
standing AS (SELECT r, p, license, place, unnest(list_filter(range(1, len(p) + 1), lambda i: p[i] = pair)) AS i FROM pairs, anchor WHERE list_contains(p, pair)),
starts AS (SELECT DISTINCT r, license, i - place AS s FROM standing),
inside AS (SELECT s.r, s.license, s.s, s.s + t.size - 1 AS e, list_distinct(p.p[greatest(s.s, 1) : s.s + t.size - 1]) AS have, want FROM starts s JOIN pairs p ON s.r = p.r JOIN t ON s.license = t.license),
shown AS (SELECT r, license, s, e FROM inside WHERE len(list_intersect(have, want)) * 2.0::DOUBLE / (len(have) + len(want)) >= {THRESHOLD}),
spot AS (SELECT r, license, p, want, most, unnest(list_filter(range(1, len(p) + 1), lambda i: list_contains(want, p[i]))) AS s FROM pairs, t WHERE len(list_intersect(p, want)) >= least),
bare AS (SELECT *, least(s + most - 1, len(p), coalesce((SELECT min(h.s) - 1 FROM shown h WHERE h.r = spot.r AND h.license = spot.license AND h.s > spot.s), len(p))) AS far
         FROM spot WHERE NOT EXISTS (SELECT 1 FROM shown h WHERE h.r = spot.r AND h.license = spot.license AND spot.s BETWEEN h.s AND h.e)),
part AS (SELECT r, license, s, e, list_distinct(p[s : e]) AS have, want FROM (SELECT *, unnest(range(s, far + 1)) AS e FROM bare)),
run AS (SELECT r, license, s, e, len(list_intersect(have, want)) * 2.0::DOUBLE / (len(have) + len(want)) AS dice FROM part
        QUALIFY row_number() OVER (PARTITION BY r, license, s ORDER BY len(list_intersect(have, want)) * 2.0::DOUBLE / (len(have) + len(want)) DESC, e) = 1),
apart AS (SELECT *, s > coalesce(max(e) OVER (PARTITION BY r, license ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS new FROM run WHERE dice >= {THRESHOLD}),
grouped AS (SELECT r, license, dice, sum(new::INT) OVER (PARTITION BY r, license ORDER BY s) AS g FROM apart),
d AS (SELECT r, license, len(list_intersect(have, want)) * 2.0::DOUBLE / (len(have) + len(want)) AS dice FROM b, t WHERE len(want) <= {LONG}
      UNION ALL SELECT r, license, len(list_intersect(have, want)) * 2.0::DOUBLE / (len(have) + len(want)) FROM inside
      UNION ALL SELECT r, license, max(dice) FROM grouped GROUP BY r, license, g),
m AS (SELECT r, license, dice, row_number() OVER (PARTITION BY r ORDER BY dice DESC, license) AS k,
             count(*) OVER (PARTITION BY r) AS n FROM d WHERE dice >= {THRESHOLD})
SELECT c.doc_id, m.license, coalesce(m.dice, 0.0)::DOUBLE AS dice, coalesce(m.n, 0) AS n_matches
FROM cut c LEFT JOIN m ON m.r = c.r AND m.k = 1
"""


#: The same spans from the patterns as the task gives them, by another route.
PLAIN_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)\b",
    "secret": r"\b(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|(?i:api_?key|secret|token|passwd|password)\x20?[=:]\x20?[\x22\x27]?[A-Za-z0-9+/_-]{16,})",
}


def op2_sql() -> str:
    from rillset.llm.pii import CONTEXT, CONTEXT_BONUS, CONTEXT_CHARS, SCORES

    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    digits = "regexp_replace(v, '[^0-9]', '', 'g')"
    letters = "upper(replace(v, ' ', '')[5:] || replace(v, ' ', '')[:4])"
    checks = {
        "email": "true",
        "ip": "len(list_filter(string_split(v, '.'), lambda p: coalesce(try_cast(p AS HUGEINT), 999) > 255)) = 0",
        "card": f"len({digits}) BETWEEN 16 AND 19 AND list_sum(list_transform(range(len({digits})), lambda i: CASE WHEN i % 2 = 0 THEN {digits}[-(i + 1)]::INT "
        f"ELSE (2 * {digits}[-(i + 1)]::INT) // 10 + (2 * {digits}[-(i + 1)]::INT) % 10 END)) % 10 = 0",
        "phone": f"len({digits}) BETWEEN 8 AND 15",
        "iban": f"list_reduce(list_concat([0], list_transform(string_split({letters}, ''), lambda c: CASE WHEN c BETWEEN 'A' AND 'Z' THEN ascii(c) - 55 + 1000 ELSE ascii(c) - 48 END)), "
        "lambda a, x: CASE WHEN x >= 1000 THEN (a * 100 + x - 1000) % 97 ELSE (a * 10 + x) % 97 END) = 1",
        "secret": "true",
    }
    parts, names = [], list(PLAIN_PATTERNS)
    for k, kind in enumerate(names):
        pattern = PLAIN_PATTERNS[kind]
        parts.append(
            f"SELECT doc_id, {k} AS k, '{kind}' AS kind, s, s + len(v) AS e, v, "
            f"round({SCORES[kind]}::DOUBLE + CASE WHEN regexp_matches(lower(near), {quoted(CONTEXT[kind])}) THEN {CONTEXT_BONUS}::DOUBLE ELSE 0.0::DOUBLE END, 3) AS score FROM ("
            f"SELECT doc_id, m[i] AS v, right(p[i], {CONTEXT_CHARS}) || ' ' || left(p[i + 1], {CONTEXT_CHARS}) AS near, list_sum(list_transform(p[:i], lambda x: len(x))) + coalesce(list_sum(list_transform(m[:i - 1], lambda x: len(x))), 0) AS s FROM ("
            f"SELECT doc_id, m, p, unnest(range(1, len(m) + 1)) AS i FROM ("
            f"SELECT doc_id, regexp_extract_all(text, '{pattern}') AS m, string_split_regex(text, '{pattern}') AS p FROM texts WHERE regexp_matches(text, '{pattern}')))) WHERE {checks[kind]}"
        )
    union = " UNION ALL ".join(parts)
    label = "string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY k, s)"
    return f"""
WITH texts AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL), found AS ({union}),
g AS (SELECT doc_id, {label} AS spans, string_agg(score::VARCHAR, ',' ORDER BY k, s) AS scores, {label} FILTER (WHERE k < 4) AS base,
             {', '.join(f"count(*) FILTER (WHERE kind = '{x}') AS n_{x}" for x in names[:4])} FROM found GROUP BY doc_id)
SELECT d.doc_id, {', '.join(f'coalesce(n_{x}, 0)::BIGINT AS n_{x}' for x in names[:4])}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores
FROM documents d LEFT JOIN g ON d.doc_id = g.doc_id
"""


OP7_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_licenses, op2_pii, op3_embedding_dedup, op4_toxicity, op5_bpe, op6_ngram_join, op7_exact_dedup, op8_packing, op9_quality, op10_token_files]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_licenses": op1_sql(), "op2_pii": op2_sql(), "op7_exact_dedup": OP7_SQL}
