"""Training-data operators against brute force, round trips and edge cases."""

import base64
import datetime
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from corduroy.llm import common, decontaminate, language, near, passages, pieces, pii, quality, tokens, topk, warc

public_tokenizers = pytest.importorskip("public_tokenizers")
ODD = [None, "", "   ", "word", "Ünïcode 日本 \x00 é", "x " * 3000, "a  b\n\n c\t", "same text", "same text"]


def docs(spark, texts, first=0):
    """Documents with extra columns whose names operators use inside."""
    rows = [(first + i, t, "en", "s", 1, 2) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n long, score long")


def path(spark, name):
    return common.scratch(spark, name)


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ",", "."]) for _ in range(n))


WORDS = [a + b for a in ("ka", "lo", "mi", "re", "su", "tan", "ver", "pol") for b in ("na", "ri", "sto", "me", "du", "lix", "po", "qua")]


# --- 1 decontamination


def test_decontamination_finds_copies_and_new_parameters_only(spark):
    items = spark.createDataFrame([(1, "Alice has 12 apples and gives 5 of them to her friend Bob who lives 3 km away, so how many apples does Alice keep?"), (2, "short item here"), (3, None)], "item_id long, text string")
    texts = [
        "Today Carol has 40 apples and gives 7 of them to her friend Dave who lives 9 miles away, so how many apples does Carol keep? End",
        "Today Carol has 40 apples and gives 7 of them to her friend Dave who lives 9 miles away, so how many apples does Erin keep? Then Carol has gone",
        "Say Alice has 12 apples and gives 5 of them to her friend Bob who lives 3 km away, so how many apples does Alice keep?",
        "Here is a short item here.", "Apples and friends live many km away.", *ODD,
    ]
    got = {(r.doc_id, r.item_id): r.kind for r in decontaminate.contaminated(docs(spark, texts), items, path(spark, "t1")).collect()}
    assert got[0, 1] == "reparameterised" and got[2, 1] == "copy" and got[3, 2] == "copy"
    assert set(got) - {(0, 1), (1, 1), (2, 1), (3, 2)} == set()
    assert decontaminate.contaminated(docs(spark, texts), items.limit(0), path(spark, "t1b")).count() == 0
    assert decontaminate.contaminated(docs(spark, texts).limit(0), items, path(spark, "t1c")).count() == 0


def test_inconsistent_slots_don_t_count(spark):
    item = "then Ann met Ben and later Ann told Ben that Ann saw Ben where Ann left Ben before Ann called Ben"
    names = iter("Cid Dee Eli Fay Gus Hal Ida Jon Kim Leo".split())
    text = re.sub("Ann|Ben", lambda m: next(names), item)
    df = decontaminate.contaminated(docs(spark, [f"so {text} again", f"so {item.replace('Ann', 'Zoe')} again"]), spark.createDataFrame([(1, item)], "item_id long, text string"), path(spark, "t1d"))
    assert [r.doc_id for r in df.collect()] == [1]


def test_names_at_the_start_of_a_sentence_are_placeholders(spark):
    item = "Natalia sold 48 clips to her friends in April. Natalia gave 7 more clips away in May. How many clips did she hand out altogether?"
    text = item.replace("Natalia", "Weng").replace("48", "36").replace(" 7 ", " 3 ")
    got = decontaminate.contaminated(docs(spark, [text, "Noise first. " + text + " Noise last."]), spark.createDataFrame([(1, item)], "item_id long, text string"), path(spark, "t1n")).collect()
    assert sorted((r.doc_id, r.kind) for r in got) == [(0, "reparameterised"), (1, "reparameterised")]


def test_values_of_an_item_that_become_one_value_are_inconsistent(spark):
    item = "then Ann met Ben and later Ann told Ben that Ann saw Ben where Ann left Ben before Ann called Ben"
    one = re.sub("Ann|Ben", "Zoe", item)
    two = item.replace("Ann", "Zoe").replace("Ben", "Lev")
    df = decontaminate.contaminated(docs(spark, [one, two]), spark.createDataFrame([(1, item)], "item_id long, text string"), path(spark, "t1o"))
    assert [(r.doc_id, r.coverage) for r in df.collect()] == [(1, 1.0)]


@pytest.mark.parametrize("shift", range(6))
def test_items_with_few_template_windows_at_every_place(spark, shift):
    items = ["sum 1 2 plus 3 minus 4 5 6 7 8 9", "Find the median of 3, 7, 9, 12, 15, 18, 21", "What is 48 + 17 + 93 + 25?"]
    texts = [" ".join(["pad"] * shift) + f" {x} end" for x in items]
    df = decontaminate.contaminated(docs(spark, texts), spark.createDataFrame(list(enumerate(items)), "item_id long, text string"), path(spark, f"t1p{shift}"))
    assert sorted((r.doc_id, r.item_id) for r in df.collect()) == [(0, 0), (1, 1), (2, 2)]


def test_planted_items_by_brute_force(spark):
    rng = random.Random(2)
    items = [prose(rng, 30) for _ in range(12)]
    texts = []
    for i in range(120):
        body = prose(rng, rng.randrange(5, 90))
        part = " ".join(items[i % 12].split()[3 : 3 + rng.choice([9, 12, 13, 16])])
        texts.append(f"{body} {items[i % 12]} {prose(rng, 9)}" if i % 5 == 0 else f"{body} {part} {prose(rng, 9)}" if i % 7 == 0 else body)
    clean = lambda t: re.sub("[^a-z ]", "", t.lower()).split()
    want = set()
    for d, t in enumerate(texts):
        seen = {tuple(clean(t)[i : i + 6]) for i in range(len(clean(t)) - 5)}
        for k, it in enumerate(items):
            w = [tuple(clean(it)[i : i + 6]) for i in range(len(clean(it)) - 5)]
            long_run = any(all(x in seen for x in w[i : i + 8]) for i in range(len(w) - 7))
            if sum(x in seen for x in w) >= len(w) / 2 or long_run:
                want.add((d, k))
    got = decontaminate.contaminated(docs(spark, texts), spark.createDataFrame(list(enumerate(items)), "item_id long, text string"), path(spark, "t1e"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want


def test_copies_of_items_with_few_fixed_words_and_of_partly_changed_ones(spark):
    tale = "Alice has 12 apples and gives some of them away to her old friend, then walks home along the river and counts what is left before Alice sleeps"
    items = {1: "Find the median of 3, 7, 9, 12, 15, 18, 21", 2: "What is 48 + 17 + 93 + 25?", 3: f"Today {tale}"}
    texts = [f"{'so ' * k}on. {items[i]}" for i in (1, 2) for k in range(6)]
    texts += [f"Today {tale.replace('Alice sleeps', 'Erin sleeps')}", "What is 48 + 17 + 93 + 26?", "on. Find the sum of 4, 7, 9, 12, 15, 18, 21"]
    df = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.kind for r in decontaminate.contaminated(docs(spark, texts), df, path(spark, "t1f")).collect()}
    assert got == {(k, 1 + k // 6): "copy" for k in range(12)} | {(12, 3): "copy"}


def test_copies_in_another_case_number_words_and_runs_of_names(spark):
    items = spark.createDataFrame([
        (1, "Solve for x"),
        (2, "Find the sum of three numbers: seven, nine and twelve when each of them is doubled first"),
        (3, "If Tom walks with his dog to the school while Tom carries his bag, how far does Tom walk with the dog?"),
        (4, "the old harbour master counted every single boat again before sunset"),
    ], "item_id long, text string")
    texts = [
        "please solve for x today", "please Solve for x today", "PLEASE SOLVE FOR X TODAY",
        "now find the sum of five numbers: two, four and twenty-six when each of them is doubled first ok",
        "so If Mary Ann walks with his dog to the school while Mary Ann carries his bag, how far does Mary Ann walk with the dog? yes",
        "The Old Harbour master counted every Single boat again before Sunset", "please solve for y today", "word " * 20000 + "Solve FOR x " + "word " * 20000,
    ]
    got = {(r.doc_id, r.item_id): r.kind for r in decontaminate.contaminated(docs(spark, texts), items, path(spark, "t1case")).collect()}
    assert got == {(0, 1): "copy", (1, 1): "copy", (2, 1): "copy", (3, 2): "reparameterised", (4, 3): "reparameterised", (5, 4): "copy", (7, 1): "copy"}


def test_windows_common_to_many_items_make_no_pairs_by_themselves(spark):
    common = "what is the value of the following"
    rng = random.Random(8)
    texts = [f"{common} {prose(rng, 14)}" for _ in range(60)]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    where = path(spark, "t1hot")
    given = docs(spark, [f"{common} {prose(rng, 10)}" for _ in range(40)] + [f"so {texts[7]} then", f"yes {' '.join(texts[9].split()[2:])}", " ".join(texts[11].split()[-13:])])
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(given, items, where).collect()}
    assert got == {(40, 7), (41, 9), (42, 11)}
    assert spark.read.parquet(f"{where}/found").count() < 60  # of 2,580 pairs that share a window


# --- 2 personal data


def luhn(s):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(s))) % 10 == 0


def test_pseudonyms_keep_format_and_link(spark):
    texts = ["a 4041894974608795 b 4041 8949 7460 8795 c", "x 4041894974608795 y 4041894974608796", "tel +1 (386) 555-3733, 386-555-3733.", "ip 42.144.35.254 999.1.1.1", "born 1980-02-29 and 31/12/1999, not 99/99/1999", "ssn 123-45-6789, not 000-12-3456", "me@mail8.example.com You@x.org", 'password=7602ad27cf55 token = "1beb58b8af68854f"', "Version 2.0 costs 40 euros in 2024.", *ODD]
    rows = pii.pseudonymise(docs(spark, texts), "k").orderBy("doc_id").collect()
    out = [r.text for r in rows]
    one, two = re.match(r"a (\d{16}) b (\d{4} \d{4} \d{4} \d{4}) c", out[0]).groups()
    assert one == two.replace(" ", "") and one != "4041894974608795" and luhn(one) and one[0] == "4"
    assert out[1] == f"x {one} y 4041894974608796"
    a, b = re.match(r"tel \+1 \((\d{3})\) (\d{3}-\d{4}), (\d{3}-\d{3}-\d{4})\.", out[2]).group(1, 2) and (re.sub(r"\D", "", out[2][4:21])[1:], re.sub(r"\D", "", out[2][22:]))
    assert a == b != "3865553733"
    assert re.fullmatch(r"ip (\d{1,3}\.){3}\d{1,3} 999\.1\.1\.1", out[3]) and "42.144.35.254" not in out[3]
    assert re.fullmatch(r"born \d{4}-\d\d-\d\d and \d\d/\d\d/\d{4}, not 99/99/1999", out[4]) and "1980-02-29" not in out[4]
    assert out[5].endswith("not 000-12-3456") and "123-45-6789" not in out[5]
    assert "@mail8" not in out[6] and out[6].count("@") == 2 and rows[6].n_email == 2
    assert "7602ad27cf55" not in out[7] and "1beb58b8af68854f" not in out[7] and len(out[7]) == len(texts[7])
    assert out[8:] == texts[8:]
    assert rows[0].n == 1 and rows[0].n_card == 2 and rows[8].n_values == 0
    assert [r.text for r in pii.pseudonymise(docs(spark, texts), "other").orderBy("doc_id").collect()][0] != out[0]


def test_feistel_is_a_permutation(spark):
    df = spark.range(1000).select(F.col("id").alias("doc_id"), F.format_string("10.0.%d.%d", F.floor(F.col("id") / 250), F.col("id") % 250).alias("text"))
    assert pii.pseudonymise(df, "k").select("text").distinct().count() == 1000


def plain_pseudonym(m, key):
    """The pseudonym of one valid value, with plain integers."""
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()

    def feistel(kind, left, right, a, b):
        for n in range(pii.ROUNDS):
            if n % 2 == 0:
                left = (left + int(sha(f"{key}|{kind}|{n}|{right}|{key}")[:12], 16)) % a
            else:
                right = (right + int(sha(f"{key}|{kind}|{n}|{left}|{key}")[:12], 16)) % b
        return left, right

    def refill(digits):
        rest = iter(digits)
        return "".join(next(rest) if c.isdigit() else c for c in m)

    d = re.sub(r"\D", "", m)
    if "@" in m:
        return f"u{sha(f'{key}|user|{m.lower()}|{key}')[:12]}@h{sha(f'{key}|host|{m.lower().split('@')[1]}|{key}')[:8]}.example"
    if m.startswith("AKIA"):
        return m[:4] + sha(f"{key}|access|{m}|{key}")[:16].upper()
    if m.count(".") == 3:
        o = [int(x) for x in m.split(".")]
        left, right = feistel("ipv4", o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536)
        return f"{left // 256}.{left % 256}.{right // 256}.{right % 256}"
    if re.fullmatch(r"\d{4}-\d\d-\d\d", m):
        v = (datetime.date.fromisoformat(m) - datetime.date(1900, 1, 1)).days
        while True:
            left, right = feistel("date", v // 229, v % 229, 319, 229)
            v = left * 229 + right
            if v < 73049:
                return str(datetime.date(1900, 1, 1) + datetime.timedelta(v))
    if re.fullmatch(r"\d{3}-\d\d-\d{4}", m):
        rank = int(d[:3]) - (2 if d[:3] > "666" else 1)
        left, right = feistel("ssn", rank, (int(d[3:5]) - 1) * 9999 + int(d[5:]) - 1, 898, 989901)
        return f"{left + (2 if left >= 665 else 1):03d}-{right // 9999 + 1:02d}-{right % 9999 + 1:04d}"
    if len(d) < 13:
        left, right = feistel("phone", int(d[-10:-7]) - 200, int(d[-7:]) - 2000000, 800, 8000000)
        return refill(f"{d[:-10]}{left + 200}{right + 2000000:07d}")
    u = (len(d) - 2) // 2
    left, right = feistel("card", int(d[1 : 1 + u]), int(d[1 + u : -1]), 10**u, 10 ** (len(d) - 2 - u))
    body = f"{d[0]}{left:0{u}d}{right:0{len(d) - 2 - u}d}"
    return refill(body + next(c for c in "0123456789" if luhn(body + c)))


def test_pseudonyms_equal_a_plain_version(spark):
    rng, values = random.Random(3), []
    n = lambda low, high: rng.randrange(low, high)
    for _ in range(60):
        body = "".join(rng.choice("0123456789") for _ in range(n(12, 19)))
        body = "4" + body[1:]
        values.append(body + next(c for c in "0123456789" if luhn(body + c)))
        values.append(f"({n(200, 1000)}) {n(200, 1000)}-{n(0, 10000):04d}")
        values.append(f"+1 {n(200, 1000)}-{n(200, 1000)}-{n(0, 10000):04d}")
        values.append(f"{rng.choice([*range(1, 666), *range(667, 900)]):03d}-{n(1, 100):02d}-{n(1, 10000):04d}")
        values.append(".".join(str(n(0, 256)) for _ in range(4)))
        values.append(str(datetime.date(1900, 1, 1) + datetime.timedelta(n(0, 73049))))
        values.append(f"a.{n(0, 999)}@Mail{n(0, 99)}.example.com")
        values.append("AKIA" + "".join(rng.choice("ABCDEFGH0123") for _ in range(16)))
    texts = [f"say {x}, then" for x in values] + ["word " * 30000 + values[0]]
    rows = docs(spark, texts).withColumn("_found", F.lit(1)).withColumn("_values", F.lit("x")).withColumn("__found__", F.lit(2))
    got = pii.pseudonymise(rows, "k").orderBy("doc_id").collect()
    assert [r.text for r in got[:-1]] == [f"say {plain_pseudonym(x, 'k')}, then" for x in values]
    assert got[-1].text == "word " * 30000 + plain_pseudonym(values[0], "k")
    assert (got[0]["_found"], got[0]["_values"], got[0]["__found__"]) == (1, "x", 2)


def test_dates_are_permuted_among_themselves(spark):
    days = spark.range(73049).select(F.col("id").alias("doc_id"), F.date_add(F.lit("1900-01-01").cast("date"), F.col("id").cast("int")).cast("string").alias("text"))
    out = pii.pseudonymise(days, "k").agg(F.count_distinct("text").alias("n"), F.min("text").alias("lo"), F.max("text").alias("hi"), F.min("n_date").alias("all")).first()
    assert tuple(out) == (73049, "1900-01-01", "2099-12-31", 1)


@pytest.mark.parametrize("form", ["/", "."])
def test_dates_of_one_written_form_never_meet(spark, form):
    """All days as dd/mm/yyyy and, where that reads as no date, as mm/dd/yyyy: as many outputs as inputs, each of its own reading."""
    days = [datetime.date(1900, 1, 1) + datetime.timedelta(i) for i in range(73049)]
    values = [d.strftime(f"%d{form}%m{form}%Y") for d in days] + [d.strftime("%m/%d/%Y") for d in days if d.day > 12 and form == "/"]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.text for r in pii.pseudonymise(rows, "k").collect()}
    assert len(set(got.values())) == len(values) == len(set(values)) and set(got.values()) == set(values)
    assert all((int(got[i][3:5]) > 12) == (int(v[3:5]) > 12) for i, v in enumerate(values))


def test_grouped_cards_and_foreign_hosts(spark):
    texts = ["pay 3782 822463 10005 now", "pay 3782-822463-10005.", "pay 3056 930902 5904 now", "pay 3782 822463 10006 now", "write to x@münchen.de, please", "an josé@correo.example.es."]
    got = [r.text for r in pii.pseudonymise(docs(spark, texts), "k").orderBy("doc_id").collect()]
    assert all(a != b for a, b, i in zip(got, texts, range(9)) if i != 3) and got[3] == texts[3]
    for g in got[:3]:
        d = re.sub("[^0-9]", "", g)
        assert luhn(d) and d[0] == "3"
    assert re.fullmatch("pay [0-9]{4} [0-9]{6} [0-9]{5} now", got[0]) and "münchen" not in got[4] and got[4].endswith(".example, please") and "josé" not in got[5]


# --- 3 WARC


def test_archives_round_trip_with_selection(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 4000)
    html = ["<p>one</p>", "<p>two é</p>", "<p>one</p>", None, "", "x" * 50000, "<p>one</p>", "\r\n\r\nWARC/1.1\r\n"]
    pages = spark.createDataFrame([(10 - i, f"http://e.com/{i} x" if i else None, h) for i, h in enumerate(html)], "page_id long, url string, html string")
    index = warc.write_warc(pages, path(spark, "t3"))
    got = {r.page_id: r for r in warc.read_warc(index).collect()}
    assert len(got) == len(html) and index.select("file").distinct().count() > 1
    for i, h in enumerate(html):
        data, r = (h or "").encode(), got[10 - i]
        smallest = min(10 - j for j, x in enumerate(html) if (x or "") == (h or ""))
        assert (r.payload_bytes, r.payload_digest) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if smallest == r.page_id else ("revisit", smallest))
        assert r.payload is None if r.refers_to else bytes(r.payload) == data
    one = warc.read_warc(index.where("page_id = 9")).collect()
    assert [bytes(r.payload).decode() for r in one] == ["<p>two é</p>"]
    assert warc.read_warc(warc.write_warc(pages.limit(0), path(spark, "t3b"))).count() == 0
    assert warc.write_warc(pages, path(spark, "t3c"), min_revisit_bytes=11).where("record_type = 'revisit'").count() == 0


# --- 4 passages


def brute_passages(texts, window):
    first, words = {}, [(t or "").encode().split() for t in texts]
    for i, w in enumerate(words):
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k : k + window]), i)
    out = []
    for i, w in enumerate(words):
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest(), kept.decode()))
    return out


@pytest.mark.parametrize("batches", [1, 3])
def test_passages_equal_brute_force(spark, batches):
    rng = random.Random(9)
    shared = [prose(rng, n) for n in (49, 50, 51, 80, 200)]
    texts = list(ODD)
    for i in range(90):
        texts.append(" ".join([prose(rng, rng.randrange(0, 70)), rng.choice([*shared, ""]), prose(rng, rng.randrange(0, 70)), rng.choice([*shared, ""])]))
    texts += [texts[20], texts[21] + " more", "na na " * 200, "na na " * 120]
    got = sorted(tuple(r) for r in passages.remove_repeats(docs(spark, texts), path(spark, "t4"), batches=batches, text=True).collect())
    assert got == brute_passages(texts, 50)


def test_fingerprint_log_goes_on_where_it_was_left(spark):
    where = path(spark, "t4log")
    batch = lambda *pairs: spark.createDataFrame(pairs, "fp long, doc_id long")
    log = passages.FingerprintLog(spark, where)
    assert log.add(batch((1, 1), (2, 1), (2, 2))).collect() == [(2,)]
    assert sorted(r.fp for r in log.add(batch((1, 3), (5, 3))).collect()) == [1]
    again = passages.FingerprintLog(spark, where)
    assert again.runs == log.runs and len(again.runs) == 2
    assert sorted(r.fp for r in again.add(batch((5, 4), (2, 4), (7, 4))).collect()) == [2, 5]
    assert len(again.runs) == 2 and again.runs[0].startswith("merged")  # the merged run is what the third batch met
    assert passages.FingerprintLog(spark, path(spark, "t4none")).runs == []


def test_passages_of_an_empty_table(spark):
    assert passages.remove_repeats(docs(spark, ["a"]).limit(0), path(spark, "t4b")).count() == 0


# --- 5 near duplicates


def brute_groups(texts, size, percent):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [(i, len(s), find(i), find(i) == i) for i, s in enumerate(sets)]


def test_near_groups_equal_brute_force(spark):
    rng = random.Random(4)
    texts = list(ODD)
    for _ in range(6):  # chains of edits: group members differ by more than the threshold
        base = prose(rng, 120).split()
        for _ in range(35):
            w = list(base)
            for _ in range(rng.randrange(0, 9)):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            texts.append(" ".join(w))
    texts += [prose(rng, 60) for _ in range(30)]
    got = sorted(tuple(r) for r in near.near_groups(docs(spark, texts), path(spark, "t5"), size=4).collect())
    assert got == brute_groups(texts, 4, 80)


def test_near_groups_of_nulls_and_nothing(spark):
    rows = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (2, "A B c d e f")], "doc_id long, text string")
    got = sorted((tuple(r) for r in near.near_groups(rows, path(spark, "t5b")).collect()), key=repr)
    assert got == [(1, 2, 1, True), (2, 2, 1, False), (None, 2, None, True)]
    assert near.near_groups(rows.limit(0), path(spark, "t5c")).count() == 0


def test_near_groups_of_a_large_bucket_in_blocks(spark, monkeypatch):
    """Near copies of one text of which many are alike by less than the threshold, compared in several blocks after the hubs."""
    monkeypatch.setattr(near, "BLOCK", 16)
    monkeypatch.setattr(near, "HUBS", 1)
    rng = random.Random(5)
    base, texts = prose(rng, 150).split(), []
    for _ in range(90):
        w = list(base)
        for _ in range(rng.randrange(0, 18)):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        texts.append(" ".join(w))
    got = sorted(tuple(r) for r in near.near_groups(docs(spark, texts), path(spark, "t5d"), size=4).collect())
    assert got == brute_groups(texts, 4, 80)
    assert 1 < len({r[2] for r in got}) < 90


def test_near_groups_of_rows_with_one_doc_id_and_large_ids(spark):
    a, b = "a b c d e f g h", "p q r s t u v w"
    big = 2**53 + 1
    rows = spark.createDataFrame([(big, a), (big, b), (None, a), (big + 1, a), (big + 2, b), (big + 2, None)], "doc_id long, text string")
    got = sorted((tuple(r) for r in near.near_groups(rows, path(spark, "t5e")).collect()), key=repr)
    assert got == sorted([(big, 4, big, True), (big, 4, big, True), (None, 4, None, True), (big + 1, 4, big, False), (big + 2, 4, big, False), (big + 2, 0, big + 2, True)], key=repr)


@pytest.mark.parametrize("size", [3, 9, 40, 150, 1000, 5000])
def test_odd_sketches_of_pairs_at_the_threshold_pass(size):
    import numpy as np

    rng = np.random.default_rng(size)
    for _ in range(100):
        common = -(-8 * size // 9)  # 0.8 of the union
        h = rng.integers(0, 2**63, 2 * size - common, dtype=np.uint64) * np.uint64(2)
        a, b = np.sort(h[:size]), np.sort(np.concatenate([h[:common], h[size:]]))
        (x, p), (y, q) = near.odd_sketch(a), near.odd_sketch(b)
        ones = int(np.bitwise_count(p.view(np.uint64) ^ q.view(np.uint64)).sum())
        assert ones <= near.most_ones(size, size, x, y, 80, np.sqrt) < near.BITS / 4


# --- 6 top k


def test_top_k_equals_brute_force(spark):
    rng = random.Random(6)
    rows = [(i, [rng.gauss(0, 1) * 3 ** (i % 5) for _ in range(8)]) for i in range(300)]
    rows += [(300, None), (301, [1.0, None] + [0.0] * 6), (302, [float("nan")] * 8), (303, [float("inf")] * 8), (304, [0.0] * 8), (400, [1.0] * 8), (401, [1.0] * 8), (402, [1.0, 2.0]), (500, [1e30] * 8), (501, [2.0**22] + [0.001] * 7)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in topk.top_k(v, v.where("vec_id % 100 = 0"), 10, path(spark, "t6")).collect())
    import math

    ints = {i: [math.floor(1024 * x) for x in e] for i, e in rows if e and all(x is not None and math.isfinite(x) for x in e)}
    want = []
    for q in ints:
        if q % 100 == 0:
            best = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(ints[q], p)))), i) for i, p in ints.items() if i != q and len(p) == len(ints[q]))[:10]
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    assert got == sorted(want)
    assert topk.top_k(v.limit(0), v, 10, path(spark, "t6b")).count() == 0
    assert topk.top_k(v, v.limit(0), 10, path(spark, "t6c")).count() == 0


def test_top_k_in_many_chunks_with_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(topk, "CHUNK", 16)
    monkeypatch.setattr(topk, "BLOCK", 8)
    rng = random.Random(7)
    rows = [(i, [float(rng.randrange(-9, 10)) * 1.3 ** (i % 20) for _ in range(4)]) for i in range(400)]
    rows += [rows[7], rows[7], (9, [50.0, 50.0, 50.0, 50.0]), (9, [1.0, 0.0, 0.0, 0.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in topk.top_k(v, v.where("vec_id % 10 = 0"), 10, path(spark, "t6d")).collect())
    import math

    ints, want = [(i, [math.floor(1024 * x) for x in e]) for i, e in rows], []
    for q, a in ints:
        if q % 10 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, p)), i) for i, p in ints if i != q)[:10]
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    assert got == sorted(want)


# --- 7 and 8 classifiers


def test_language_edge_cases_and_accuracy(spark):
    sf = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language.identify_languages(sf, language.learn_languages(sf.where(common.crc32_mod("doc_id", 4) != 2)))
    got = found.join(sf.select("doc_id", "lang"), "doc_id").where(common.crc32_mod("doc_id", 4) == 2)
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.95
    d = language.learn_languages(sf)
    rows = {r.doc_id: r for r in language.identify_languages(docs(spark, [*ODD, "123 456"]), d).collect()}
    assert [rows[i].lang_pred for i in (0, 1, 2, 9)] == ["und"] * 4 and all(0 <= r.score <= 1 for r in rows.values())
    assert {r.lang_pred for r in language.identify_languages(docs(spark, ["abc"]), {}).collect()} == {"und"}
    assert language.learn_languages(sf.limit(0)) == {}


def test_languages_are_learnt_from_distinct_texts(spark):
    rows = spark.createDataFrame([(f"l{k}", f"only text {k}") for k in range(20)], "lang string, text string")
    copies = rows.crossJoin(spark.range(2000)).select("lang", "text")
    assert language.learn_languages(copies) == {f"l{k}": f"only text {k}".encode() for k in range(20)}
    mixed = copies.where("lang = 'l0'").union(spark.range(100).selectExpr("'l0'", "concat('text ', id)"))
    assert len(set(language.learn_languages(mixed)["l0"].split(b"\n"))) == language.DOCS_PER_LANGUAGE
    long_ = spark.createDataFrame([("a", "x" * 500), ("a", "y" * 900), ("b", "z " * 5000)], "lang string, text string")
    assert language.learn_languages(long_, dictionary_bytes=1000) == {"a": b"x" * 500, "b": b"z " * 5000}


def test_languages_equal_plain_compression(spark):
    """Sizes by the library's own calls; ties and repeated rows, very long texts, signs that are no letters."""
    import zstandard

    d = {"aa": b"the cat sat on the mat and the dog ran", "bb": b"der hund und die katze auf der matte", "cc": b"der hund und die katze auf der matte"}
    texts = ["the dog sat", "Die Katze und der Hund", "Die Katze und der Hund", "\u00bd \u00b2 \u2460", "katze " * 20000, "\u01c5"]
    got = [r.lang_pred for r in language.identify_languages(docs(spark, texts), d).orderBy("doc_id").collect()]

    def size(name, text):
        how = zstandard.ZstdCompressionParameters(strategy=zstandard.STRATEGY_LAZY, write_content_size=False, write_checksum=False, write_dict_id=False, **language.SEARCH)
        one = zstandard.ZstdCompressionDict(d[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        data, n = text.lower().encode(), language.PIECE_BYTES
        return sum(len(zstandard.ZstdCompressor(dict_data=one, compression_params=how).compress(data[i : i + n])) for i in range(0, len(data), n))

    assert got == ["und" if t == texts[3] else min(d, key=lambda name: (size(name, t), name)) for t in texts]
    assert got[:3] == ["aa", "bb", "bb"]


def test_quality_accuracy_and_edges(spark):
    sf = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.quality_model(sf, labels)
    out = quality.score_quality(sf, model).join(labels, "doc_id").where(common.crc32_mod("doc_id", 5) == 0)
    right = out.agg(F.avg(((F.col("score") >= quality.THRESHOLD).cast("int") == F.col("quality")).cast("double"))).first()[0]
    assert right > 0.9
    odd = quality.score_quality(docs(spark, ODD), model, keep=["doc_id", "score", "n"], name="p").collect()
    assert len(odd) == len(ODD) and all(0 <= r.p <= 1 for r in odd) and odd[0].p == odd[1].p and odd[0].score == 2
    assert quality.train([]) == {"constant": 0.5} and quality.train([(1, b"x" * 512)]) == {"constant": 1.0}
    assert quality.score_quality(docs(spark, ["a"]).limit(0), model).count() == 0


def test_quality_score_does_not_depend_on_the_next_text():
    import numpy as np

    rng = np.random.default_rng(1)
    model = {"tables": [rng.normal(0, 1, (256, quality.FILTERS)).astype(np.float32) for _ in range(quality.WIDTH)], "bias": np.zeros(quality.FILTERS, np.float32), "out": rng.normal(0, 0.05, 3 * quality.FILTERS), "base": 0.0}
    texts = [rng.bytes(n) for n in (512, 1024, 511, 768, 3, 0, 512) * 20]
    alone = [quality.score_texts(model, [x])[0] for x in texts]
    assert np.allclose(quality.score_texts(model, texts), alone, rtol=0, atol=1e-9)


def test_quality_equals_a_plain_convolution():
    import numpy as np

    rng = np.random.default_rng(2)
    model = {"tables": [rng.normal(0, 1, (256, quality.FILTERS)) for _ in range(quality.WIDTH)], "bias": rng.normal(0, 1, quality.FILTERS), "out": rng.normal(0, 0.05, 3 * quality.FILTERS), "base": 0.1}
    for n in (0, 1, 251, 252, 253, 254, 255, 256, 257, 512, 513, 700, 5000):
        x = rng.bytes(n)
        blocks = max(2, -(-n // quality.BLOCK))
        padded = x.ljust(blocks * quality.BLOCK, b"\0") + bytes(quality.WIDTH)
        outs = [sum(model["tables"][j][padded[at + j]] for j in range(quality.WIDTH)) for at in range(0, blocks * quality.BLOCK, quality.STEP)]
        per = quality.BLOCK // quality.STEP
        h = np.array([np.maximum(np.max(outs[b * per : (b + 2) * per], 0) + model["bias"], 0) for b in range(blocks - 1)])
        want = 1 / (1 + np.exp(-(np.concatenate([h.mean(0), h.max(0), h.min(0)]) @ model["out"] + model["base"])))
        assert np.allclose(quality.score_texts(model, [b"before " * 90, x, b"after"])[1], want, rtol=0, atol=1e-9)


def test_quality_sample_of_repeated_and_null_rows(spark):
    rows = docs(spark, ["good text"] * 3 + [None, "other"]).withColumn("doc_id", F.when(F.col("doc_id") < 3, 7).otherwise(F.col("doc_id")))
    labels = spark.createDataFrame([(7, 1), (7, 1), (3, 0), (4, None), (None, 1), (99, 0)], "doc_id long, quality int")
    assert sorted(quality.labelled_sample(rows, labels)) == [(0, b""), (1, b"good text")]
    assert len(quality.labelled_sample(rows, labels, most_bytes=5)) == 1
    assert quality.labelled_sample(rows, labels.limit(0)) == [] and quality.labelled_sample(rows.limit(0), labels) == []


# --- 9 and 10 tokens


def test_token_shards_round_trip(spark):
    np = pytest.importorskip("numpy")
    from tokenizers import Tokenizer

    texts = [*ODD, "Hello  world\n\nfoo, bar's 123! x \x1c ,\x1cy <|endoftext|>"]
    df = docs(spark, texts).repartition(3)
    got = sorted(tuple(r) for r in tokens.read_token_shards(tokens.write_token_shards(df, path(spark, "t9"), public_tokenizers.path("byte_bpe_50k.json"))).collect())
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want, start = [], 0
    for i, t in enumerate(texts):
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want
    assert tokens.read_token_shards(tokens.write_token_shards(df.limit(0), path(spark, "t9b"), public_tokenizers.path("byte_bpe_50k.json"))).count() == 0


def test_pieces_equal_the_library(spark):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(8)
    letters = "aabcethn o r.,\n  '\"0123éüñ▁=-<>日本😀\t"
    texts = [*ODD, *("".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(1500)), " " * 40 + "x", "a" * 400, "====", "▁▁a", "\r\n"]
    rows = pieces.encode_pieces(docs(spark, texts), public_tokenizers.path("piece_bpe_32k.model")).orderBy("doc_id").collect()
    codec = pieces.codec(public_tokenizers.path("piece_bpe_32k.model"))
    for r, t in zip(rows, texts):
        ids = lib.encode(t or "")
        assert r.ids == ",".join(map(str, ids)) and r.n_tokens == len(ids) and r.decoded == lib.decode(ids) == codec.decode(ids)
    assert codec.decode([codec.bytes[0xE2], codec.bytes[0x61]]) == lib.decode([codec.bytes[0xE2], codec.bytes[0x61]])


@pytest.mark.parametrize("special_as_text", [False, True])
def test_token_chunks_equal_the_library_with_few_slots_and_cut_texts(monkeypatch, special_as_text):
    import numpy as np
    from tokenizers import Tokenizer

    where = public_tokenizers.path("byte_bpe_50k.json")
    monkeypatch.setattr(tokens, "SLOT_BITS", 3)
    monkeypatch.setattr(tokens, "PART_CHARS", 50)
    monkeypatch.setattr(tokens, "_loaded", {})
    encode, dtype = tokens._encoder(where, special_as_text)
    lib = Tokenizer.from_file(where)
    lib.encode_special_tokens = special_as_text
    rng = random.Random(3)
    some = ["a", "é", "日", " ", " ", "　", "\xa0", "\n", "\t", "1", "'s", "<|endoftext|>", "\x00", "\U0001f600", "\x85", "0123456789abcdef0123456789", "x" * 40]
    texts = ["", " ", "　", *["".join(rng.choice(some) for _ in range(rng.randint(0, 60))) for _ in range(500)]]
    want = [np.array(lib.encode(t, add_special_tokens=False).ids, dtype).tobytes() for t in texts]
    assert encode(texts) == want and encode(texts) == want
    assert encode([]) == []


def test_token_query_gives_special_tokens_their_ids(spark, tmp_path):
    import numpy as np
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["ab <|endoftext|> cd", "a<|endoftext|><|endoftext|>b  <|endoftext|>\n\n<|endoftext|> c", "<|endoftext|", "plain text"]
    docs(spark, texts).write.parquet(f"file://{tmp_path}/documents.parquet")
    want, start = [], 0
    for i, t in enumerate(texts):
        ids = np.array([*lib.encode(t, add_special_tokens=False).ids, 0], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in tokens.op9_token_binary(spark, f"file://{tmp_path}").collect()) == want


def test_pieces_of_text_without_spaces_take_bounded_memory():
    import sentencepiece

    where = public_tokenizers.path("piece_bpe_32k.model")
    lib, codec, rng = sentencepiece.SentencePieceProcessor(model_file=where), pieces.PieceCodec(where), random.Random(5)
    for some in ([chr(i) for i in range(0x4E00, 0x5200)], "abcdefghinorstABC0123+/", ["the", "tion", "ing", "日本", "é"]):
        text = "".join(rng.choice(some) for _ in range(20_000))
        assert codec.encode(text) == lib.encode(text)
    assert max(map(len, codec.longest)) <= max(map(len, codec.piece)) < 100
    for text in ("".join(rng.choice("abcdefghinorst") for _ in range(1_000_000)), " " * 300_000):
        assert codec.encode(text) == lib.encode(text)
