"""Toxicity by weak supervision: voters, a generative label model, a linear classifier on its posteriors.

1. Voters vote toxic (1), clean (-1) or abstain (0) on every document, each from evidence of its own: five word lists kept
   apart by kind, two lexicons mined from labels, threats, insults put to the reader, insults in disguise (digits for
   letters, dots or stars inside), shouting; and for clean: polite words, prose that addresses nobody, a text without
   any hit. Only counts of vote patterns, of which there are at most 3 ** voters, leave the executors.
2. Mined terms are words, and beginnings of words, that labelled toxic documents have and clean ones do not, from at most
   MOST_ROWS labelled rows outside the held-out fold, where a family of near copies counts as one document.
3. The label model: given the true class, groups of voters are independent, and voters of one group, those whose votes
   stay correlated once the class is accounted for, have a joint table. EM over the pattern counts of all documents, begun
   at what the labelled rows say of each voter and with these rows in their classes, estimates accuracies and correlations; a posterior follows from its pattern.
4. A linear classifier (logistic regression) over hit counts and text statistics is trained on the posteriors of at most
   MOST_ROWS distinct rows of votes and features, each weighted by the documents it stands for, and scores every document.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillset.llm.blocks import mix64
from rillset.llm.common import materialize, select_text, tidied
from rillset.llm.labels import fitting_rows, remainder
from rillset.llm.ngram_join import similar_groups
from rillset.llm.textstats import byte_counts, coded_words
from rillset.llm.tokens import chunks

MOST_ROWS = 30_000
FOLDS, HELD_OUT, CUT = 5, 0, 0.5
MINED = 2
PREFIXES = (4, 5, 6)
LEAST_DOCS, LEAST_SHARE, LEAST_PRECISION, LEAST_CONTEXTS = 4, 0.01, 0.9, 0.6
#: Of all terms tried so many may pass by chance.
CHANCE = 0.01
EDGE = ".,;:!?\"'()[]{}<>*#$%&|-_~/\\"
#: A text of fewer words does not shout.
LONG = 5
#: Text that is taken at a time; words, terms and contexts of a part are several times its size.
PART_BYTES = 1 << 20
#: Features are rounded to this part of one, so that equal documents can be counted.
GRID = 50

#: Word lists of the lexicon voters: names for people, contempt, profanity, other languages, and milder words.
LISTS = {
    "people": "asshole bastard bitch coward creep cretin dimwit dumbass dirtbag fool halfwit idiot idiots imbecile jackass jerk loser losers lowlife moron morons parasite prick scum scumbag simpleton vermin wanker weirdo",
    "contempt": "brainless contemptible despicable disgusting dumb filthy pathetic repulsive revolting stupid vile worthless wretched",
    "profanity": "arse bollocks bullshit crap damn damned fuck fucked fucker fucking piss shit shitty",
    "abroad": "abruti abschaum arschloch blödmann cabrón connard crétin dummkopf estúpido gilipollas idiota idioten imbécil imbécile imbéciles ordure salaud schwachkopf trottel versager widerlich",
    "mild": "clown crazy freak garbage hate hated insane lunatic ridiculous rubbish trash ugly useless",
}
POLITE = "please thanks thank kindly sorry welcome bitte danke gracias merci"
SECOND = "you your yours yourself u ur du dich dir dein deine tu toi te ton ta usted vous"
#: What stands for a letter in disguise; signs that are only put between letters go.
DISGUISE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", ".": None, "-": None, "_": None})
THREAT = r"\b(?:kill|hurt|destroy|choke|strangle) (?:you|yourself|him|her|them)\b|\bdrop dead\b|\bgo to hell\b|\bhope you (?:die|suffer)|\bdeserve to (?:die|suffer)|\bshut up\b|\bi hate you\b"
_SAID = "|".join(sorted(w for k in ("people", "contempt", "mild") for w in LISTS[k].split()))
ADDRESS = rf"\b(?:you|you're|you are|du bist|tu es|eres)(?: (?:a|an|all|just|so|such|total|complete|utter|little|stupid|ein|un|une))*,? (?:{_SAID})\b"


def terms_of(word: str) -> list[str]:
    """A lower-cased word's terms: itself, and its beginnings, marked by a star."""
    bare = word.strip(EDGE)
    return [bare, *(bare[:k] + "*" for k in PREFIXES if len(bare) > k)] if len(bare) > 2 else []


def _contexts(document: np.ndarray, word: np.ndarray, words: list[str]) -> np.ndarray:
    """A number for each word's two neighbours, the same in every batch."""
    used = np.unique(word)
    hashes = np.zeros(len(words) + 1, np.uint64)  # the last one stands for a text's end
    hashes[used] = [zlib.crc32(words[k].encode()) + 1 for k in used.tolist()]
    same = document[1:] == document[:-1]
    end = len(words)
    before = np.concatenate([[end], np.where(same, word[:-1], end)]) if len(word) else word
    after = np.concatenate([np.where(same, word[1:], end), [end]]) if len(word) else word
    with np.errstate(over="ignore"):
        return mix64(hashes[before] * np.uint64(0x9E3779B97F4A7C15) + hashes[after]).view(np.int64)


def _counts_of_terms(texts: pa.Array, toxic: np.ndarray, family: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(terms; clean and toxic documents of each, those without a family (-1); pairs (term number, context) of all toxic ones;
    distinct triples (term number, family, toxic or not) of those with a family).
    """
    document, word, words = coded_words(pc.utf8_lower(texts))
    number: dict[str, int] = {}
    owner, term = [], []
    for i, w in enumerate(words):
        for t in terms_of(w):
            owner.append(i)
            term.append(number.setdefault(t, len(number)))
    none = np.zeros(0, np.int64)
    if not number:
        return [], none, none, none.reshape(0, 2), none.reshape(0, 3)
    owner, term = np.array(owner), np.array(term)
    starts = np.searchsorted(owner, np.arange(len(words) + 1))

    def spread(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each word in turn its terms: (place of the word, term)."""
        n = np.diff(starts)[codes]
        flat = np.repeat(starts[codes] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        return np.repeat(np.arange(len(codes)), n), term[flat]

    pairs = np.unique(document * len(words) + word)
    place, found = spread(pairs % len(words))
    pairs = np.unique((pairs // len(words))[place] * len(number) + found)
    at, found = pairs // len(number), pairs % len(number)
    alone = family[at] < 0
    clean, bad = (np.bincount(found[alone & (toxic[at] == t)], minlength=len(number)) for t in (False, True))
    shared = np.unique(np.column_stack([found, family[at], toxic[at]])[~alone].astype(np.int64), axis=0)
    own = toxic[document]
    contexts = _contexts(document[own], word[own], words)
    place, found = spread(word[own])
    return list(number), clean, bad, np.unique(np.column_stack([found, contexts[place]]), axis=0), shared


def labelled_texts(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """(doc_id, y, text, family) of the chosen labels' documents. Copies and near copies, those that op6 links, share a family; it is null for a text of its own."""
    labelled = materialize(select_text(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "y", "text"), "labelled")
    members = similar_groups(labelled).dropDuplicates(["doc_id"]).select("doc_id", F.col("component_id").alias("family"))
    members = materialize(members, "families")
    several = members.groupBy("family").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("family")
    # no more rows than chosen ones
    return labelled.join(F.broadcast(members.join(F.broadcast(several), "family")), "doc_id", "left")


def mine_terms(labelled: DataFrame) -> tuple[list[str], list[str]]:
    """(mined terms, words of LISTS that are as common in clean texts and lose their vote).

    Mined are terms of high precision for toxic documents, more often there than chance allows, most frequent first, none inside another.

    A family of copies and near copies counts as one document of each of its terms, and of each label it has, however many
    its members; so it neither brings the words of its own into a lexicon nor keeps the toxic ones out. Words of texts that
    resemble each other less than near copies stand between the same neighbours, while the words that make texts toxic
    stand anywhere; so a term needs about as many different contexts as it has documents.
    """

    @tidied
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, PART_BYTES):
            family = np.where(b.column(2).is_null(), -1, np.unique(pc.fill_null(b.column(2), 0), return_inverse=True)[1])
            terms, clean, toxic, pairs, shared = _counts_of_terms(b.column(1), b.column(0).to_numpy(zero_copy_only=False) == 1, family)
            named, n = pa.array(terms, pa.string()), len(terms)
            # a batch's terms that no toxic document of it has still count against others
            yield pa.RecordBatch.from_arrays([named, pa.array(clean), pa.array(toxic), *[pa.nulls(n, pa.int64())] * 3], names)
            if len(pairs):
                zero, none = pa.array(np.zeros(len(pairs), np.int64)), pa.nulls(len(pairs), pa.int64())
                yield pa.RecordBatch.from_arrays([named.take(pa.array(pairs[:, 0])), zero, zero, pa.array(pairs[:, 1]), none, none], names)
            if len(shared):
                zero, none = pa.array(np.zeros(len(shared), np.int64)), pa.nulls(len(shared), pa.int64())
                whose = np.unique(pc.fill_null(b.column(2), 0))[shared[:, 1]]
                yield pa.RecordBatch.from_arrays([named.take(pa.array(shared[:, 0])), zero, zero, none, pa.array(whose), pa.array(shared[:, 2])], names)

    names = ["term", "clean", "toxic", "context", "family", "y"]
    counted = labelled.select("y", "text", "family").mapInArrow(run, "term string, clean long, toxic long, context long, family long, y long")
    # a row with a family stands for one document, from however many batches it comes
    one = counted.groupBy("term", "context", "family", "y").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    of = lambda label, c: F.sum(F.when(F.col("y") == label, 1).otherwise(F.col(c))).alias(c)
    each = one.groupBy("term").agg(of(0, "clean"), of(1, "toxic"), F.count("context").alias("contexts"))
    toxic, known = labelled.select(F.coalesce("family", "doc_id").alias("f"), "y").distinct().agg(F.sum("y"), F.count(F.lit(1))).first()
    each = materialize(each.where(F.col("toxic") + F.col("clean") >= LEAST_DOCS), "terms")
    precision = (F.col("toxic") + 0.5) / (F.col("toxic") + F.col("clean") + 1)
    # how much likelier the counts are at the term's own rate than at that of all documents
    rate, n = min(max(toxic / known, 1e-6), 1 - 1e-6), F.col("toxic") + F.col("clean")
    gain = F.col("toxic") * F.log(F.col("toxic") / n / rate) + F.when(F.col("clean") > 0, F.col("clean") * F.log(F.col("clean") / n / (1 - rate))).otherwise(0.0)
    least = math.log(max(1, each.where("toxic > 0").count()) / CHANCE)
    listed = [w for ws in LISTS.values() for w in ws.split()]
    unfit = sorted(r.term for r in each.where(F.col("term").isin(listed) & (F.col("toxic") <= F.col("clean"))).collect())
    best = each.where((F.col("toxic") >= max(LEAST_DOCS, LEAST_SHARE * toxic)) & (precision >= LEAST_PRECISION) & (F.col("contexts") >= LEAST_CONTEXTS * F.col("toxic")) & (gain >= least))
    terms: list[str] = []
    taken: set[str] = set()
    # each is in a share of LEAST_SHARE of the toxic documents, so there are 1 / LEAST_SHARE times a document's terms at most
    for r in best.orderBy(F.desc("toxic"), F.length("term"), "term").collect():
        bare = r.term.rstrip("*")
        if any(bare[:k] + "*" in taken for k in PREFIXES if len(bare) >= k):
            continue
        taken.add(r.term)
        terms.append(r.term)
    return terms, unfit


class Voters:
    """Evidence, votes and features of whole batches."""

    def __init__(self, terms: list[str], unfit: Iterable[str] = ()):
        self.kinds = [*LISTS, *(f"mined_{k}" for k in range(MINED)), "masked"]
        self.names = [*self.kinds, "threat", "address", "shouting", "polite", "prose", "nothing"]
        self.listed = {w: k for k, ws in enumerate(LISTS.values()) for w in ws.split() if w not in set(unfit)}
        self.exact = [t for t in terms if not t.endswith("*")]
        self.starts = {k: [t[:-1] for t in terms if t.endswith("*") and len(t) == k + 1] for k in PREFIXES}
        self.place = {t: i % MINED for i, t in enumerate(terms)}

    def _mined(self, bare: pa.Array) -> np.ndarray:
        """For each word the mined lexicon that it or a beginning of it is in, -1 without one; the whole word counts first."""
        found = np.full(len(bare), -1)
        length = pc.utf8_length(bare).to_numpy(zero_copy_only=False)
        for k in reversed(PREFIXES):
            if self.starts[k]:
                at = pc.fill_null(pc.index_in(pc.utf8_slice_codeunits(bare, 0, k), value_set=pa.array(self.starts[k])), -1).to_numpy()
                whose = np.array([self.place[t + "*"] for t in self.starts[k]])
                found = np.where((at >= 0) & (length > k), whose[at], found)
        if self.exact:
            at = pc.fill_null(pc.index_in(bare, value_set=pa.array(self.exact)), -1).to_numpy()
            found = np.where(at >= 0, np.array([self.place[t] for t in self.exact])[at], found)
        return found

    def _disguised(self, bare: pa.Array) -> np.ndarray:
        """Whether a word is one of the lists once digits and signs are read as letters, or stars as any letter."""
        out = np.zeros(len(bare), bool)
        odd = pc.match_substring_regex(bare, r"^[a-z@$0-9][a-z]*[0-9@$!*._-][a-z0-9@$!*._-]*$").to_numpy(zero_copy_only=False)
        for i in np.flatnonzero(odd).tolist():
            w = bare[i].as_py()
            if 3 < len(w) < 24 and any("a" <= c <= "z" for c in w):
                if "*" in w:
                    out[i] = any(len(x) == len(w) and all(a in ("*", b) for a, b in zip(w, x)) for x in self.listed) and sum(c == "*" for c in w) < len(w) - 1
                else:
                    plain = w.translate(DISGUISE)
                    out[i] = plain in self.listed
        return out

    def evidence(self, texts: pa.Array) -> dict[str, np.ndarray]:
        """By document: words that hit for each kind, flags of the patterns, words and the share of capitals."""
        n, c, lower = len(texts), byte_counts(texts), pc.utf8_lower(texts.cast(pa.large_string()))
        document, word, words = coded_words(lower)
        bare = pc.utf8_trim(pa.array(words, pa.string()), EDGE)
        at = pc.fill_null(pc.index_in(bare, value_set=pa.array(list(self.listed))), -1).to_numpy()
        listed = np.where(at >= 0, np.array(list(self.listed.values()))[at], -1)
        kinds = len(self.kinds)
        out = np.zeros((n, kinds), np.int64)
        for own in (listed, np.where((m := self._mined(bare)) >= 0, m + len(LISTS), -1), np.where(self._disguised(bare), kinds - 1, -1)):
            if len(word) and (own >= 0).any():
                kind = own[word]
                hit = kind >= 0
                out += np.bincount(document[hit] * kinds + kind[hit], minlength=n * kinds).reshape(n, kinds)

        def count(names: str) -> np.ndarray:
            among = pc.is_in(bare, value_set=pa.array(names.split())).to_numpy(zero_copy_only=False)
            return np.bincount(document[among[word]], minlength=n) if len(word) else np.zeros(n, np.int64)

        match = lambda pattern: pc.match_substring_regex(lower, pattern).to_numpy(zero_copy_only=False)
        loud = pc.match_substring(lower, "!").to_numpy(zero_copy_only=False)
        return {
            "hits": out, "threat": match(THREAT), "address": match(ADDRESS), "polite": count(POLITE), "second": count(SECOND), "loud": loud,
            "words": np.bincount(document, minlength=n), "upper": c["upper"] / np.maximum(c["upper"] + c["lower"], 1),
        }

    def votes(self, e: dict[str, np.ndarray]) -> np.ndarray:
        """(documents, voters) of 1, 0, -1."""
        some, long = (e["hits"] > 0).astype(int), e["words"] >= LONG
        # an empty text is clean by the last two, or its silence would count as evidence
        total = e["hits"].sum(1) + e["threat"] + e["address"]
        clean = [e["polite"] > 0, (e["second"] == 0) & ~e["loud"], total == 0]
        toxic = [e["threat"], e["address"], long & (e["upper"] > 0.7)]
        return np.column_stack([some, *(x.astype(int) for x in toxic), *(-x.astype(int) for x in clean)]).astype(np.int8)

    def features(self, e: dict[str, np.ndarray]) -> np.ndarray:
        """The first column tells whether anything hit."""
        total = e["hits"].sum(1)
        flags = [e["threat"], e["address"], e["polite"] > 0, e["second"] > 0, e["loud"]]
        numbers = [np.minimum(total, 5), total / np.maximum(e["words"], 1), np.log1p(e["words"]) / 10, e["upper"], np.ones(len(total))]
        return np.column_stack([(total > 0) | e["threat"] | e["address"], np.minimum(e["hits"], 3), *flags, *numbers]).astype(float)


class LabelModel:
    """P(class) and, for each group of voters, P(votes | class), by EM over counts of vote patterns."""

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, prior: float, known: tuple[np.ndarray, np.ndarray] | None = None, correlated: float = 0.3, rounds: int = 60):
        """known: votes of labelled rows and their labels, from which EM begins; without them it begins at a majority vote."""
        self.groups = [[j] for j in range(patterns.shape[1])]
        sign = patterns.sum(1)
        # correlations are read off a first guess: EM without groups would take a correlated pair for the class itself
        posterior = np.where(sign > 0, 0.9, np.where(sign < 0, 0.05, prior))
        if known is not None and 0 < known[1].sum() < len(known[1]):
            votes, y = known
            score = np.full(len(patterns), np.log(prior) - np.log1p(-prior))
            for j in range(patterns.shape[1]):
                share = [(np.bincount(votes[y == c, j] + 1, minlength=3) + 1) / ((y == c).sum() + 3) for c in (0, 1)]
                score += np.log(share[1] / share[0])[patterns[:, j] + 1]
            posterior = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
        residual = np.zeros((patterns.shape[1],) * 2)
        for weight in (posterior, 1 - posterior):  # covariance of votes within a class
            w = counts * weight
            if w.sum() > 0:
                d = patterns - np.average(patterns, axis=0, weights=w)
                residual += (d * w[:, None]).T @ d
        scale = np.sqrt(np.maximum(np.diag(residual), 1e-9))
        self.correlation = residual / np.outer(scale, scale)
        self.groups = self._grouped(np.abs(self.correlation), correlated)
        self._fit(patterns, counts, posterior, rounds, known)

    @staticmethod
    def _grouped(strength: np.ndarray, least: float, most: int = 3) -> list[list[int]]:
        """Voters joined by strong correlations, strongest first, at most `most` in a group."""
        group = {j: {j} for j in range(len(strength))}
        pairs = sorted(((strength[i, j], i, j) for i in range(len(strength)) for j in range(i) if strength[i, j] >= least), reverse=True)
        for _, i, j in pairs:
            if group[i] is not group[j] and len(group[i]) + len(group[j]) <= most:
                both = group[i] | group[j]
                group |= dict.fromkeys(both, both)
        return sorted(map(list, {tuple(sorted(g)) for g in group.values()}))

    def _codes(self, patterns: np.ndarray, group: list[int]) -> np.ndarray:
        return ((patterns[:, group] + 1) @ (3 ** np.arange(len(group)))).astype(np.int64)

    def _fit(self, patterns: np.ndarray, counts: np.ndarray, posterior: np.ndarray, rounds: int, known: tuple[np.ndarray, np.ndarray] | None) -> np.ndarray:
        """EM. Labelled rows keep their class, so that the classes keep their meaning where few voters tell them apart."""
        if known is not None:
            patterns, counts = np.concatenate([patterns, known[0]]), np.concatenate([counts, np.ones(len(known[1]))])
            posterior = np.concatenate([posterior, known[1]])
        codes = [self._codes(patterns, g) for g in self.groups]
        for _ in range(rounds):
            self.prior = float(np.clip((counts * posterior).sum() / max(1, counts.sum()), 1e-4, 0.5))
            self.tables = []
            for g, code in zip(self.groups, codes):
                table = np.stack([np.bincount(code, weights=counts * w, minlength=3 ** len(g)) + 0.1 for w in (1 - posterior, posterior)])
                self.tables.append(np.log(table / table.sum(1, keepdims=True)))
            new = self.posterior(patterns)
            if known is not None:
                new[len(new) - len(known[1]) :] = known[1]
            if np.abs(new - posterior).max() < 1e-6:
                break
            posterior = new
        return posterior

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        log = np.log(self.prior) - np.log1p(-self.prior)
        for g, table in zip(self.groups, self.tables):
            code = self._codes(patterns, g)
            log = log + table[1, code] - table[0, code]
        return 1 / (1 + np.exp(-np.clip(log, -30, 30)))

    def accuracies(self) -> dict[tuple[int, ...], tuple[float, float]]:
        """Of each group: how likely a toxic and a clean document are not to be voted against."""
        out = {}
        for g, table in zip(self.groups, self.tables):
            votes = np.array(np.unravel_index(np.arange(3 ** len(g)), (3,) * len(g), order="F")).sum(0) - len(g)
            out[tuple(g)] = (float(np.exp(table[1])[votes >= 0].sum()), float(np.exp(table[0])[votes <= 0].sum()))
        return out


def fit_linear(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, rounds: int = 40) -> np.ndarray:
    """Logistic regression on soft labels of weighted rows, by damped Newton steps."""
    w, weight = np.zeros(x.shape[1]), weight / max(1e-9, weight.mean())
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (weight * (y - p)) - ridge * w)
        w = w + step * min(1.0, 4.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-7:
            break
    return w


class ToxicityModel:
    def __init__(self, voters: Voters, label_model: LabelModel, weights: np.ndarray):
        self.voters, self.label_model, self.weights = voters, label_model, weights

    def score(self, texts: pa.Array) -> np.ndarray:
        z = self.voters.features(self.voters.evidence(texts)) @ self.weights
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_toxicity(docs: DataFrame, labels: DataFrame, most: int = MOST_ROWS) -> ToxicityModel | None:
    """Lexicons from labelled rows, a label model from the votes on all documents, weights from bounded posteriors.

    None where no labelled document is toxic.
    """
    chosen = fitting_rows(labels, "toxic", FOLDS, HELD_OUT, most).cache()
    try:
        rate = chosen.agg(F.avg("y")).first()[0]
        labelled = materialize(labelled_texts(docs, chosen), "labelled-families") if rate else None
    finally:
        chosen.unpersist()
    if labelled is None or (rate := labelled.agg(F.avg("y")).first()[0] or 0.0) == 0.0:
        return None
    voters = Voters(*mine_terms(labelled))
    m, width = len(voters.names), voters.features(voters.evidence(pa.array([""]))).shape[1]

    @tidied
    def cast_votes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, PART_BYTES):
            e = voters.evidence(b.column(0))
            votes, x = voters.votes(e).astype(np.int64), np.rint(voters.features(e) * GRID).astype(np.int64)
            x = np.column_stack([x, b.column(1).to_numpy()]) if b.num_columns > 1 else x
            # documents of equal votes and features are one row with a count
            first, count = np.unique(np.concatenate([votes, x], axis=1), axis=0, return_index=True, return_counts=True)[1:]
            lists = [pa.array(list(t[first]), pa.list_(pa.int64())) for t in (votes, x)]
            yield pa.RecordBatch.from_arrays([*lists, pa.array(count.astype(np.int64))], ["votes", "x", "n"])

    def counted(rows: DataFrame) -> DataFrame:
        return rows.mapInArrow(cast_votes, "votes array<bigint>, x array<bigint>, n long").groupBy("votes", "x").agg(F.sum("n").alias("n"))

    # one row for each family and label, at most `most`
    one = labelled.groupBy(F.coalesce("family", "doc_id"), "y").agg(F.min("text").alias("text"))
    gold = counted(one.select("text", F.col("y").cast("long"))).select("votes", F.element_at("x", -1).alias("y"), "n").orderBy("votes", "y", "n").toArrow()
    known = np.repeat(np.array(gold.column("votes").to_pylist(), np.int64).reshape(-1, m), gold.column("n").to_numpy(), axis=0), np.repeat(gold.column("y").to_numpy(), gold.column("n").to_numpy())
    base = select_text(docs).where(remainder(F.col("doc_id"), FOLDS) != HELD_OUT)
    cast = materialize(counted(base.select("text")), "votes")
    seen = cast.groupBy("votes").agg(F.sum("n").alias("n")).toArrow()
    patterns = np.array(seen.column("votes").to_pylist(), dtype=np.int64).reshape(-1, m)
    counts = seen.column("n").to_numpy().astype(float)
    order = np.lexsort(patterns.T)
    label_model = LabelModel(patterns[order], counts[order], float(rate), known)
    # rows with a hit are few and each matters, so both kinds get their share of the bound, and the weight of what it leaves out
    hit = F.col("x")[0] > 0
    by_hash = [F.xxhash64("votes", "x"), "votes", "x"]
    parts = []
    for kind in (cast.where(hit), cast.where(~hit)):
        whole = kind.agg(F.sum("n")).first()[0] or 0
        rows = kind.orderBy(*by_hash).limit(most // 2).toArrow()
        n = rows.column("n").to_numpy().astype(float)
        parts.append((np.array(rows.column("x").to_pylist(), float).reshape(-1, width) / GRID, np.array(rows.column("votes").to_pylist(), dtype=np.int64).reshape(-1, m), n * (whole / max(1.0, n.sum()))))
    x, votes, n = map(np.concatenate, zip(*parts))
    posterior = label_model.posterior(votes)
    order = np.lexsort((n, *x.T, posterior))
    return ToxicityModel(voters, label_model, fit_linear(x[order], posterior[order], n[order]))


def score_toxicity(docs: DataFrame, labels: DataFrame, most: int = MOST_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, held_out, score (0 to 1, higher: toxic likelier), predicted (1 from CUT on).

    A null text counts as empty: no hit, a low score. Without a labelled toxic document all scores are 0.0. Repeated rows get
    equal scores, a null id is held out of nothing and fitted on never; an empty table gives no rows. Labels, language, source and ids are no input of a score.
    """
    model = fit_toxicity(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), labels, most)

    @tidied
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, PART_BYTES):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(b.column(1)) if model else np.zeros(b.num_rows))], ["doc_id", "score"])

    scored = select_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")
    held = F.coalesce(remainder(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, most: int = MOST_ROWS, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose text scores below CUT; a null text stays."""
    model = fit_toxicity(docs, labels, most)
    if model is None:
        return docs

    place = docs.columns.index(text_col)

    @tidied
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, PART_BYTES):
            yield b.filter(pa.array(model.score(pc.fill_null(b.column(place), "")) < CUT))

    return docs.mapInArrow(run, docs.schema)
