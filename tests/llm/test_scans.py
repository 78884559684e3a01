"""Licences and personal data."""

import random
import re
import time

import duckdb
import pyarrow as pa
import pytest
from helpers import ODD_TEXTS, docs, empty
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from rillset.llm import licenses, pii, queries

#: the base patterns as given, for the re module
PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def brute(text):
    found = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else 0, "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if ok:
                found.append((kind, m.start(), m.end()))
    return found


def spans(spark, texts):
    return {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans if s.kind in pii.BASE_KINDS] for r in pii.find_pii(docs(spark, texts)).collect()}


CASES = [
    "write to a.b+c@mail.example.com, or a@b.c+d@e.f and x@y", "10.1.2.3 and 10.1.2.256, 1.2.3.4.5.6.7.8 0001.2.3.004", "card 4111 1111 1111 1111 or 4111-1111-1111-1112 5500000000000004 1234567890123456789012",
    "+1 (555) 123-4567. +12 3 +1 2345678901234567", "é\U0001f600 z@q.io \x01\x02\x03 w@q.io", "+1 4111 1111 1111 1111@x.com", *ODD_TEXTS, "a" * 30000, "1." * 9000, ("1 " * 9000), "+" * 5000, "a.b-" * 5000 + "@c.d",
]


def test_base_spans_are_those_of_the_patterns(spark):
    out = spans(spark, CASES)
    assert all(out[i] == brute(t) for i, t in enumerate(CASES))


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(["a", "@", ".", "b-", "1", "22", "256", "+", " ", "-", "(", ")", "4111111111111111", "é", "%", "\x01"]), max_size=25).map("".join), min_size=40, max_size=60))
def test_base_spans_of_random_texts(spark, texts):
    out = spans(spark, texts)
    assert all(out[i] == brute(t) for i, t in enumerate(texts))


def test_ibans_context_and_masks(spark):
    texts = ["iban DE89370400440532013000 here", "XX DE89370400440532013001 no", "GB82WEST12345698765432", "mail me: a@b.cc or +49 30 1234567", None, "to DE89 3704 0044 0532 0130 00.", 'token = "f95017526fc608ad71587f8ea5418b66"']
    found = pii.find_pii(docs(spark, texts))
    out = {r.doc_id: r.spans for r in found.collect()}
    assert [s.kind for s in out[0]] == ["iban"] and out[0][0].score > out[2][0].score and out[1] == [] and out[4] == []
    assert [(s.kind, s.start, s.end) for s in out[5]] == [("iban", 3, 30)] and [s.kind for s in out[6]] == ["secret"]
    masked = {r.doc_id: r.masked for r in pii.with_masked(found).collect()}
    assert masked[5] == "to <IBAN>." and masked[4] == ""
    assert masked[3] == "mail me: <EMAIL> or <PHONE>" and masked[0] == "iban <IBAN> here" and masked[1] == texts[1]
    one = {r.doc_id: r for r in pii.digest(found).collect()}
    assert one[3].n_email == 1 and one[3].n_phone == 1 and one[3].spans == "email:9:15,phone:19:33" and one[3].scores == "1.0,0.6"
    assert pii.digest(pii.find_pii(empty(spark))).count() == 0


def brute_mask(text, spans):
    out, at = "", 0
    for s in sorted(spans, key=lambda s: (s.start, s.end, s.kind)):
        out += text[at : s.start] + f"<{s.kind.upper()}>" if s.start >= at else ""
        at = max(at, s.end)
    return out + text[at:]


def test_masks_of_overlapping_spans_and_repeated_rows(spark):
    texts = [*CASES, "é\U0001f600" * 3000 + " a@b.cc +1 4111 1111 1111 1111 " + "z" * 5000 + " 1.2.3.4", "call +123.123.123.12 or a@1.2.3.4", "a@b.cc", "a@b.cc"]
    df = docs(spark, texts)
    rows = pii.with_masked(pii.find_pii(df.union(df.where("doc_id = 0")))).collect()
    assert len(rows) == len(texts) + 1 and all(r.masked == brute_mask(r.text, r.spans) for r in rows)
    assert any(a.end > b.start for r in rows for a, b in zip(sorted(r.spans, key=lambda s: s.start), sorted(r.spans, key=lambda s: s.start)[1:]))


def test_a_text_of_many_matches(spark):
    n = 100_000
    began = time.perf_counter()
    df = spark.createDataFrame([(1, "a@b.cd " * n)], "doc_id long, text string")
    row = pii.with_masked(pii.find_pii(df)).selectExpr("size(spans) AS n", "spans[99999].start AS last", "masked").first()
    assert row.n == n and row.last == 7 * (n - 1) and row.masked == "<EMAIL> " * n
    assert time.perf_counter() - began < 60


def dice(a, b):
    a, b = set(licenses.bigrams_of(a)), set(licenses.bigrams_of(b))
    return 2 * len(a & b) / (len(a) + len(b)) if a and b else 0.0


def brute_license(text):
    lines = (text or "").split("\n")
    parts = re.split(r"\n[ \t\r]*\n", text or "")
    segments = lines + ([p for p in parts if "\n" in p] if len(parts) > 1 else []) + ([text] if len(lines) > 1 else [])
    hits = [(dice(s, t), k) for s in segments for k, t in licenses.TEMPLATES.items() if len(licenses.bigrams_of(t)) <= licenses.LONG and dice(s, t) >= licenses.THRESHOLD]
    words = licenses.words_of(text or "")
    for k, t in licenses.TEMPLATES.items():
        size, starts = len(licenses.words_of(t)), set()
        for pair, at in licenses.anchors_of(t):
            starts |= {i - at for i in range(len(words) - 1) if f"{words[i]} {words[i + 1]}" == pair}
        hits += [(d, k) for s in starts if (d := dice(" ".join(words[max(0, s) : s + size]), t)) >= licenses.THRESHOLD]
    best = min(hits, key=lambda x: (-x[0], x[1])) if hits else (0.0, None)
    return best[1], best[0], len(hits)


def test_notices_inside_longer_texts(spark):
    """Whole notices as sections, in comments, wrapped in prose, inside a line, edited; each template is found where it stands."""
    rng = random.Random(3)
    own = lambda n: " ".join(rng.choice(["foo", "bar", "tool", "reads", "files", "quickly"]) for _ in range(n))
    wrapped = lambda t, mark: "\n".join(mark + " ".join(t.split(" ")[i : i + 9]) for i in range(0, len(t.split(" ")), 9))
    names, texts = list(licenses.TEMPLATES), []
    for name in names:
        t = licenses.TEMPLATES[name]
        texts += [f"{own(60)} {t} {own(70)}", f"{own(20)}\n{wrapped(t, ' * ')}\n{own(9)}\n"]
    texts += ["Foo is a tool. Released under\nthe MIT License. Use it.", own(500), "licensed under nothing, all rights to bar", licenses.TEMPLATES["MIT-text"].replace("software", "program", 1) * 2]
    out = {r.doc_id: r for r in licenses.scan_licenses(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        license, best, n = brute_license(t)
        assert (out[i].license, out[i].n_matches) == (license, n) and out[i].dice == pytest.approx(best)
        if i < 2 * len(names):
            assert out[i].license is not None and out[i].dice > 0.95
    assert out[2 * len(names)].license == "MIT" and out[2 * len(names) + 1].license is None and out[2 * len(names) + 3].license == "MIT-text"


def test_licenses(spark):
    mit = licenses.TEMPLATES["MIT-text"]
    half = mit[: len(mit) // 2] + "\n" + mit[len(mit) // 2 :]
    texts = ["some text\nAll rights reserved.\nmore", "licensed under the APACHE license, version 2.0", f"a b c\n\n{half}\n\nd", half, "Released under the MIT License.\nAll Rights Reserved", "all rights", *ODD_TEXTS, "All rights reserved. " * 500]
    out = {r.doc_id: (r.license, r.dice, r.n_matches) for r in licenses.scan_licenses(docs(spark, texts)).collect()}
    assert all(out[i] == pytest.approx(brute_license(t)) if out[i][0] is None else (out[i][0], out[i][2]) == (brute_license(t)[0], brute_license(t)[2]) and out[i][1] == pytest.approx(brute_license(t)[1]) for i, t in enumerate(texts))
    assert out[3][0] == "MIT-text" and out[0][0] == "All-Rights-Reserved" and out[5][0] is None
    assert licenses.scan_licenses(empty(spark)).count() == 0
    with pytest.raises(ValueError):
        licenses.scan_licenses(docs(spark, ["a"]), {"x": "one"})


def brute_runs(text):
    """(dice, template) of the runs away from windows at anchors that match: the best from each place on, overlapping ones as one."""
    words, found = licenses.words_of(text), []
    pairs = [f"{a} {b}" for a, b in zip(words, words[1:])]
    for name, t in licenses.TEMPLATES.items():
        want, size = set(licenses.bigrams_of(t)), len(licenses.words_of(t)) - 1
        starts = {i - at for pair, at in licenses.anchors_of(t) for i, p in enumerate(pairs) if p == pair}
        covered = {i for s in starts if dice(" ".join(words[max(0, s) : max(0, s + size + 1)]), t) >= licenses.THRESHOLD for i in range(s, s + size)}
        last, clusters = -1, []
        for s in range(len(pairs)):
            have, best, end = set(), 0.0, s
            for e in range(s, min(len(pairs), s + int((2 - licenses.THRESHOLD) * len(want) / licenses.THRESHOLD + 1e-9))):
                if e in covered:
                    break
                have.add(pairs[e])
                d = 2 * len(have & want) / (len(have) + len(want))
                best, end = (d, e) if d > best else (best, end)
            if best >= licenses.THRESHOLD and pairs[s] in want:
                clusters = clusters + [best] if s > last else [*clusters[:-1], max(clusters[-1], best)]
                last = max(last, end)
        found += [(d, name) for d in clusters]
    return found


def test_notices_without_their_anchors(spark):
    """Notices edited at every anchor, shortened, with words put in, alone or beside whole ones: no run of the threshold is left out."""
    rng = random.Random(5)
    own = lambda n: " ".join(rng.choice(["foo", "bar", "tool", "reads", "files", "quickly"]) for _ in range(n))
    texts, names = [], [k for k, t in licenses.TEMPLATES.items() if len(licenses.bigrams_of(t)) > licenses.LONG]
    for name in names:
        words = licenses.words_of(licenses.TEMPLATES[name])
        places = {at for _, at in licenses.anchors_of(licenses.TEMPLATES[name])}
        edited = " ".join(w + " foo" if i in places else w for i, w in enumerate(words))
        texts += [f"{own(30)} {edited} {own(40)}", f"{own(30)}\n\n{' '.join(words[: len(words) * 3 // 4])}\n\n{own(60)}"]
    whole = licenses.TEMPLATES[name]
    texts += ["Distributed under the MIT License", f"{edited} {own(9)} {whole} {own(50)} {edited}\n{own(5)}", " ".join([edited, own(12)] * 3), f"{edited} {edited}", own(20) + " reserved all rights " * 3]
    texts += [" ".join(w for w in licenses.TEMPLATES[rng.choice(names)].split(" ") if rng.random() > 0.06) + own(rng.randint(0, 9)) for _ in range(3)]
    out = {r.doc_id: r for r in licenses.scan_licenses(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        runs, (license, best, n) = brute_runs(t), brute_license(t)
        score, name = min([*runs, (best, license or "~")], key=lambda x: (-x[0], x[1]))
        assert (out[i].license or "~", out[i].n_matches) == (name, n + len(runs)) and out[i].dice == pytest.approx(score)
    duck = duckdb.connect()
    duck.register("documents", pa.table({"doc_id": list(range(len(texts))), "text": texts}))
    assert {r[0]: r[1:] for r in duck.sql(queries.oracle_sql()["op1_licenses"]).fetchall()} == {i: (r.license, r.dice, r.n_matches) for i, r in out.items()}
    assert all(brute_license(texts[2 * k])[0] != name and out[2 * k].license == name for k, name in enumerate(names))
    assert all(out[2 * k + 1].license is not None for k in range(len(names)))
    after = 2 * len(names)
    assert (out[after].license, out[after].n_matches) == ("MIT", 1) and out[after + 1].n_matches == 3 and out[after + 2].n_matches == 3


def test_size_bounds_lose_nothing():
    for n in range(1, 60):
        low, high = licenses.size_bounds(n, 0.8)
        for m in range(1, 150):
            possible = 2 * min(n, m) / (n + m) >= 0.8
            assert not possible or low <= m <= high
