"""Mixing, filter interactions and source divergence against plain versions, with nulls, ties, repeated rows and long texts."""

import itertools
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from corduroy.llm import common, divergence, filters, mixing

COLUMNS = "doc_id long, text string, lang string, source string, n long, c long, part string, size long"
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def docs(spark, rows):
    """Documents (doc_id, text, lang, source) with extra columns whose names operators use inside."""
    return spark.createDataFrame([(*r, 1, 2, "p", 3) for r in rows], COLUMNS)


def path(spark, name):
    return common.scratch(spark, name)


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


# --- 11 mixing


def plain_targets(sizes):
    """Exact targets by repeated sharing."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    budget, full = Fraction(3 * sum(sizes.values()), 2), set()
    while True:
        rest = sum(weight[s] for s in names if s not in full)
        share = {s: Fraction(2 * sizes[s]) if s in full else (budget - sum(2 * sizes[x] for x in full)) * weight[s] / rest for s in names}
        more = {s for s in names if share[s] > 2 * sizes[s]}
        if not more:
            return share
        full |= more


def test_word_counts(spark):
    texts = [None, "", "  \n", "a", " a ", "a\x0bb\x0c c\rd\t\te", "x y  z", "é 日本 \x00 \x1f", "w " * 50000, "y" * 100000]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", mixing.word_count(F.col("t")).alias("n")).orderBy("i").collect()
    assert [r.n for r in got] == [len(words(t)) for t in texts]


@pytest.mark.parametrize("seed", range(2))
def test_mixture_meets_targets_and_repeats_itself(spark, seed):
    rng = random.Random(seed)
    names = ["b", "a", "é", "", "Z", "\U0001f600", "￿", None]
    rows = [(i if i % 40 else None, rng.choice([None, "", "w " * rng.randrange(0, 60), "w " * rng.randrange(0, 60)]), "en", rng.choice(names) if rng.random() < 0.7 else "hot") for i in range(500)]
    rows += [rows[7]] * 3 + [(7, "other words here", "en", "hot"), (9000, "long " * 30000, None, "long"), (9001, None, None, "none"), (9002, "one", None, "single")]
    table = docs(spark, rows)
    got = [r for r in mixing.mix_sources(table, path(spark, "t11")).collect()]
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    want, budget = plain_targets(sizes), 3 * sum(sizes.values()) // 2
    assert Counter((r.doc_id, r.source, r.size) for r in got) == Counter((r[0], r[3], len(words(r[1]))) for r in rows)
    taken, longest = Counter(), defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(float(want[r.source]), rel=1e-12) and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
        longest[r.source] = max(longest[r.source], r.size)
    assert sum(taken.values()) == budget
    assert sum(r.taken % r.size != 0 for r in got if r.size) <= 1  # only the document at the cut is cut
    slack = max(longest.values())
    assert all(abs(taken[s] - want[s]) <= slack + longest[s] for s in sizes)
    again = mixing.mix_sources(table.repartition(7), path(spark, "t11b")).collect()
    assert Counter(again) == Counter(got)


def test_mixture_follows_the_virtual_finish_times(spark):
    """Whole words of two sources, by a plain queue over the same shuffle."""
    import hashlib

    rows = [(i, "w " * (i % 7), "en", "ab"[i % 5 == 0]) for i in range(60)]
    got = {r.doc_id: r.taken for r in mixing.mix_sources(docs(spark, rows), path(spark, "t11c")).collect()}
    sizes = Counter()
    for i, t, _, s in rows:
        sizes[s] += len(words(t))
    target, queue, taken = plain_targets(sizes), [], Counter()
    for s in sizes:
        total = 0
        for _ in range(2):
            for i, t, _, x in sorted(rows, key=lambda r: hashlib.md5(f"mix:{r[0]}".encode()).hexdigest()):
                if x == s and words(t):
                    total += len(words(t))
                    queue.append((total / target[s], s, i, len(words(t))))
    left = 3 * sum(sizes.values()) // 2
    for _, _, i, n in sorted(queue):
        taken[i] += min(n, left)
        left -= min(n, left)
    assert got == {i: taken[i] for i, *_ in rows}


def test_mixture_of_nothing(spark):
    assert mixing.mix_sources(docs(spark, [(1, "a", "en", "s")]).limit(0), path(spark, "t11d")).count() == 0
    none = mixing.mix_sources(docs(spark, [(1, None, "en", "s"), (2, " ", "en", None)]), path(spark, "t11e")).collect()
    assert [(r.size, r.target, r.taken) for r in none] == [(0, 0.0, 0)] * 2
    one = mixing.mix_sources(docs(spark, [(1, "a b c", "en", None)]), path(spark, "t11f")).collect()
    assert [(r.target, r.taken) for r in one] == [(4.5, 4)]


# --- 12 filter interactions


def plain_audit(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    ids = defaultdict(list)
    for i, t, *_ in rows:
        if i is not None:
            ids[t or ""].append(i)
    counts = Counter()
    for i, t, lang, _ in rows:
        t = t or ""
        w = words(t)
        fails = "A" * (len(w) < 200) + "B" * (100 * len(set(w)) < 50 * len(w)) + "C" * (100 * len(re.findall("[A-Z]", t)) > 3 * len(t))
        fails += "D" * bool(re.search("[#$%&*|]", t)) + "E" * (i is not None and min(ids[t]) < i)
        counts[lang or "", fails, i in good, i in toxic] += 1
    out = {}
    for part in {k[0] for k in counts}:
        for order in map("".join, itertools.permutations("ABCDE")):
            for step, f in enumerate(order, 1):
                row = Counter()
                for (p, fails, g, x), n in counts.items():
                    if p == part:
                        gone, failing = bool(set(order[: step - 1]) & set(fails)), f in fails
                        row["kept"] += n * (not gone and not failing)
                        row["removed"] += n * (not gone and failing)
                        row["redundant"] += n * (gone and failing)
                        row["unique_fails"] += n * (fails == f)
                        row["good_lost"] += n * (not gone and failing and g)
                        row["toxic_lost"] += n * (not gone and failing and x)
                out[part, order, step] = row
    for (part, order, step), row in out.items():
        row["shapley"] = sum(r["removed"] for (p, o, s), r in out.items() if p == part and o[s - 1] == order[step - 1])
    return out


def audited(df):
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    return {(r.part, r.filter_order, r.step): {k: r[k] for k in names} for r in df.collect()}


def sample_texts(rng):
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(40000))
    same = "a" * 20000  # equal lengths and equal beginnings, other ends
    texts = [None, "", "", "  ", "A", "x $ y", "Ab é 日本", "word " * 250, long, long, long[:-1] + "§", same + "b", same + "c", same + "b", "B" + same, "é" * 30]
    for _ in range(60):
        n = rng.choice([5, 199, 200, 260])
        texts.append(" ".join(rng.choice(["Up", "low", "#tag", "z"]) if rng.random() < 0.05 else f"v{rng.randrange(3 * n)}" for _ in range(n)))
    return texts


@pytest.mark.parametrize("weak", [False, True])
def test_filter_audit_equals_a_plain_version(spark, weak):
    rng = random.Random(5)
    rows = [(i, t, rng.choice(["en", "de", None, ""]), "s") for i, t in enumerate(sample_texts(rng))]
    rows += [(100 + i, rng.choice(rows)[1], "en", "s") for i in range(60)] + [(None, rows[5][1], "en", "s"), (None, "alone", "de", "s"), (101, rows[5][1], "fr", "s")]
    if not weak:
        rows += [rows[20]] * 2
    labels = [(rng.randrange(170), rng.choice([0, 1, None]), rng.choice([0, 1])) for _ in range(150)] + [(3, 0, 0), (3, 1, 1), (None, 1, 1)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    hashed = (lambda *c: F.length(F.concat(*[F.col(x).cast("string") if isinstance(x, str) else x.cast("string") for x in c])) % 3) if weak else F.xxhash64
    got = audited(filters.filter_audit(docs(spark, rows), table, path(spark, "t12"), hashed))
    assert got == {k: dict(v) for k, v in plain_audit(rows, labels).items()}


def test_failed_filters_split_long_texts(monkeypatch):
    text = " ".join(f"wörd{i % 700}" for i in range(3000)).encode()
    whole = filters.failed_filters(text)
    monkeypatch.setattr(filters, "_PART", 100)
    assert filters.failed_filters(text) == whole == "B"


def test_filter_audit_of_nothing(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filters.filter_audit(docs(spark, [(1, "a", "en", "s")]).limit(0), labels, path(spark, "t12b")).count() == 0
    one = audited(filters.filter_audit(docs(spark, [(1, None, None, None)]), labels, path(spark, "t12c")))
    assert len(one) == 600 and sum(r["removed"] for r in one.values()) == 120 and {k[0] for k in one} == {""}


# --- 13 source divergence


def plain_divergence(rows, min_docs):
    found, groups = [], set()
    for _, text, lang, source in rows:
        terms = TERM.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))
        found.append((lang or "", source or "", Counter(terms)))
        groups.add((lang or "", source or ""))
    out = set()
    for lang in {g[0] for g in groups}:
        seen = Counter(t for x, _, c in found if x == lang for t in c)
        kept = [t for t, n in seen.items() if n >= min_docs]
        count = {s: Counter() for x, s in groups if x == lang}
        for x, s, c in found:
            if x == lang:
                count[s].update(c)
        whole = sum(count.values(), Counter())

        def prob(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (total + 5 * len(kept)) for t in kept}

        p, q = {s: prob(c) for s, c in count.items()}, prob(whole)
        for s in count:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in count if o != s]
            terms = [(p[s][t] - q[t], t) for t in kept if count[s][t] and p[s][t] > q[t]]
            for part, items, top in (("pair", pairs, None), ("term", terms, 50)):
                for rank, (value, item) in enumerate(sorted(items, key=lambda x: (-x[0], x[1].encode()))[:top], 1):
                    out.add((lang, s, part, item, value, rank))
    return out


@pytest.mark.parametrize("small", [False, True])
def test_divergence_equals_a_plain_version(spark, monkeypatch, small):
    if small:  # many decks, parts, flushes, blocks and chunks
        for name, value in {"DECK_CHARS": 150, "DECKS_HELD": 2, "ENTRIES": 50, "SCAN_BYTES": 200, "SOURCES": 3, "CHUNK": 8}.items():
            monkeypatch.setattr(divergence, name, value)
    monkeypatch.setattr(divergence, "MIN_DOCS", 4)
    rng = random.Random(2)
    vocab = [a + b for a in "kamirestu" for b in ("x", "Y", "é", "日本", "ab", "aba")] + ["\U0001f600", "ß", "x y"]
    rows = []
    for i in range(260):
        text = "".join(rng.choice(vocab) + rng.choice([" ", "-", "1", "\x00", "\x7f ", "_"]) for _ in range(rng.randrange(0, 40)))
        lang = rng.choice(["en", "en", "en", "de", None, ""])
        rows.append((i, rng.choice([text, text, text, None]), lang, rng.choice([f"s{k}" for k in range(9)] + [None, "", "hot", "hot", "hot"])))
    rows += [rows[3]] * 4 + [(900, "kx " * 3000 + "mY", "en", "long"), (901, None, "xx", "bare"), (902, "", "xx", None), (903, "only once", "yy", "s")]
    got = [tuple(r) for r in divergence.source_divergence(docs(spark, rows).repartition(3), path(spark, "t13")).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_divergence(rows, 4)


def test_term_parts_end_between_terms():
    text = "Ab cd1EF gh".encode()
    assert [b"".join(divergence.term_parts(text, n)) for n in (1, 3, 100)] == [b"ab cd ef gh"] * 3
    assert all(p.split() for p in divergence.term_parts(text, 3))


def test_probabilities_are_exact(spark):
    cases = [(0, 0, 1), (7, 9, 3), (10**14, 2 * 10**14, 10**9), (123456789012345, 123456789012346, 1), (0, 9 * 10**14, 7)]
    got = spark.createDataFrame(cases, "n long, t long, v long").select(divergence.probability(F.col("n"), F.col("t"), F.col("v")).alias("p")).collect()
    assert [r.p for r in got] == [1 + 10**9 * (n + 5) // (t + 5 * v) for n, t, v in cases]


def test_divergence_of_nothing(spark):
    assert divergence.source_divergence(docs(spark, [(1, "a", "en", "s")]).limit(0), path(spark, "t13b")).count() == 0
    few = divergence.source_divergence(docs(spark, [(1, "a", "en", "s"), (2, None, "en", None)]), path(spark, "t13c")).collect()
    assert sorted(tuple(r) for r in few) == [("en", "", "pair", "s", 0, 1), ("en", "s", "pair", "", 0, 1)]
