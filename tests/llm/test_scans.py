"""Personal data, licences, quality rules and decontamination against brute force."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from foliant.llm import decontaminate, license_scan, pii, quality
from foliant.llm.common import Words, documents, utf8


def by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def brute_pii(text):
    text, counts, out = text or "", [], []
    digits = lambda m: re.sub("[^0-9]", "", m)
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    ]
    for kind, pattern, good in kinds:
        found = [m for m in re.finditer(pattern, text) if good(m.group())]
        counts.append(len(found))
        out += [f"{kind}:{m.start()}:{m.end()}" for m in found]
    return (*counts, hashlib.sha256(",".join(out).encode()).hexdigest()), out


PII_TEXTS = [
    None,
    "",
    "write to a.b@c.de, x@y.z_q@r.st! é😀 u@v.w",
    "a@b@c.d..e@f.g 1.2.3.4.5.6.7.8 256.1.1.1 001.2.003.4 1.2.3",
    "card 4111 1111 1111 1111, 4111-1111-1111-1112; 4111 1111 1111 1111 22",
    "+1 (555) 123-4567 or +49 30 1234567890123 ++1 555.123.4567-",
    "call 555 123 4567 today, ssn 123-45-6789, order 123-45-6780",
    "mail jane [at] example [dot] com or joe(at)site.org",
    "9" * 3000 + "." + "1" * 500,
    "a" * 20000 + "@" + "b" * 20000 + ".c" * 3000,
    "a" * 50000,
    "1 " * 4000,
    "0000.000.0000255.1",
]


def test_pii_base(spark, sf):
    df = spark.createDataFrame(list(enumerate(PII_TEXTS)), "doc_id long, text string")
    docs = documents(spark, sf).select("doc_id", "text")
    for table in (df, docs):
        texts = {r["doc_id"]: r["text"] for r in table.collect()}
        got = by_id(pii.find_pii(table), "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")
        for i, t in texts.items():
            want, spans = brute_pii(t)
            assert got[i][:5] == want, (i, t and t[:80])
            assert set(spans) <= set(got[i][5].split(",") if got[i][5] else [])


def test_pii_odd(odd, empty, repeated):
    texts, df = odd
    assert pii.find_pii(df).count() == len(texts)
    assert pii.find_pii(empty).collect() == []
    assert pii.find_pii(repeated).count() == 6


def test_pii_method_adds_and_refuses(spark):
    """Loose numbers beside words that speak for them are added, failing checksums alone aren't."""
    rows = [(i, f"please call 212 555 {1000 + i} now") for i in range(60)] + [(100 + i, f"mail to user{i}@example.com please") for i in range(60)]
    rows += [(200 + i, f"serial {4000000000000000 + 7 * i + 1}") for i in range(60)]
    got = by_id(pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")), "n_phone", "n_card", "spans")
    assert all("phone:12:24" in got[i][2] for i in range(60))
    assert all("card" not in got[200 + i][2] for i in range(60) if not got[200 + i][1])


def test_pii_secrets(spark):
    """Tokens beside words that speak for them are added; digests, words and paths aren't."""
    import random

    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdef") + rng.choice("0123456789") for _ in range(20))
    rows = [(i, f'set token = "{word()}" here') for i in range(40)] + [(100 + i, f"see commit {word()} there") for i in range(40)]
    rows += [(200 + i, f"read src/module{i}/part/of/the/code and go on") for i in range(40)]
    got = by_id(pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")), "spans", "n_spans")
    assert all(got[i] == ("secret:13:53", 1) for i in range(40))
    assert all(got[i] == ("", 0) for i in (*range(100, 140), *range(200, 240)))


def test_em_finds_reliabilities(spark):
    """A labeler that votes at random gets less weight than one that agrees with the others."""
    import random

    rng = random.Random(1)
    rows = []
    for _ in range(2000):
        truth = rng.random() < 0.5
        good = lambda p: (1 if truth else -1) if rng.random() < p else (-1 if truth else 1)  # noqa: B023, E731
        rows.append(("phone", [good(0.95), good(0.9), good(0.9), good(0.5), 0, good(0.85)]))
    model = pii.reliabilities(spark.createDataFrame(rows, "kind string, votes array<int>")).collect()[0]["model"]
    weight = [o[2] - o[0] for o in model["odds"]]
    assert weight[0] > 4 and abs(weight[3]) < 0.6 and weight[1] > 3 and weight[5] > 2


def brute_license(text):
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(word, low)
    at, base, added, score = [], set(), set(), 0.0
    for phrase, label in license_scan.PHRASES:
        p = phrase.split()
        found = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
        at += found
        base |= {label} if found else set()
    for label, template in license_scan.TEMPLATES:
        want = set(template.split())
        width = 2 * len(template.split())
        most = max(len(set(words[i : i + width]) & want) for i in range(max(1, len(words) - width + 1)))
        if 10 * most >= 8 * len(want):
            added.add(label)
            score = max(score, most / len(want))
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | added)), score


LICENSE_TEXTS = [
    "The MIT-License!\nmit license mit license",
    "CC  BY\nSA. Gnu General Public\tLicense, GNU general public LICENSE",
    " ".join(license_scan.TEMPLATES[9][1].split()[:60]),
    "x " * 90 + license_scan.TEMPLATES[8][1].replace(" ", "\n", 20),
    "License mit; apache; license",
    "Released under the MIT License.",
    "Ärger apache license ÄPACHE LICENSE",
]


def test_license(spark, sf, odd, empty):
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    own = spark.createDataFrame(list(enumerate(LICENSE_TEXTS)), "doc_id long, text string")
    for df in (own, documents(spark, sf), odd[1]):
        texts = {r["doc_id"]: r["text"] for r in df.collect()}
        got = by_id(license_scan.scan_licenses(df), *names)
        for i, t in texts.items():
            assert got[i] == pytest.approx(brute_license(t)), (i, t and t[:80])
    assert license_scan.scan_licenses(empty).collect() == []


def test_license_windows(spark):
    """A notice is found in a line of many words, and where a line break cuts it."""
    filler = " ".join(f"w{i}" for i in range(60))
    texts = {
        0: f"{filler} released under the mit license {filler}",
        1: "this work is licensed under\nthe gnu general public license version 3",
        2: f"{filler} licensed under cc by nc 4 0 {filler}",
        3: f"released {filler} under {filler} the {filler} mit {filler} license",
        4: f"released {filler}",
    }
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = by_id(license_scan.scan_licenses(df), "labels", "score")
    assert "mit" in got[0][0].split(",") and got[0][1] == 1.0
    assert "gpl-3.0" in got[1][0].split(",") and got[1][1] == 1.0
    assert "cc-by-nc-4.0" in got[2][0].split(",") and got[2][1] == 1.0
    assert got[3] == ("", 0.0) and got[4] == ("", 0.0)


def test_license_in_long_and_wrapped_text(spark):
    """A notice among seventy other words, wrapped over lines, with words put between, at either end."""
    notice = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."
    filler = " ".join(f"w{i}" for i in range(70))
    half = notice.split()
    texts = {
        0: f"{filler} {notice}",
        1: notice.replace(" terms", "\nterms"),
        2: " ".join(f"{w} q{i}" if i % 3 == 0 else w for i, w in enumerate(half)),
        3: f"{notice} {filler}",
        4: " ".join(half[:9]),
        5: filler + "\n" + "\n".join(half) + "\n" + filler,
    }
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = by_id(license_scan.scan_licenses(df), "labels", "score")
    for i, t in texts.items():
        assert got[i] == pytest.approx(brute_license(t)[5:]), i
    assert all("mpl-2.0" in got[i][0] for i in (0, 1, 2, 3, 5)) and got[4] == ("", 0.0)


def brute_quality(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    n = len(w)
    windows = Counter(tuple(w[i : i + 5]) for i in range(n - 4))
    cover = {p for i in range(n - 4) if windows[tuple(w[i : i + 5])] > 1 for p in range(i, i + 5)}
    seen, lines = set(), 0
    for x in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", x):
            lines += x in seen
            seen.add(x)
    places = defaultdict(list)
    for i in range(n - 4):
        places[tuple(w[i : i + 5])].append(i)
    reach = [0] * n
    for at in places.values():
        for a in at:
            for b in at:
                if a != b and reach[a] < 400:
                    k = 5
                    while a + k < n and b + k < n and w[a + k] == w[b + k]:
                        k += 1
                    reach[a] = max(reach[a], k)
    spans = {p for i, x in enumerate(reach) if x >= quality.SPAN_WORDS for p in range(i, i + x)}
    longest = max(reach, default=0)
    failed = n < 10 or 100 * len(cover) > 20 * n
    kept = not failed and 100 * len(spans) <= quality.MAX_COVERED_PERCENT * n and longest <= quality.MAX_LONGEST
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), lines, len(cover), failed, kept, longest


QUALITY_TEXTS = [" ".join(f"w{i}" for i in range(300)) + " " + " ".join(f"w{i}" for i in range(30)), " ".join(f"v{i}" for i in range(700)) + "\n" + " ".join(f"v{i}" for i in range(120)), "a b c d e f g h i j k\na b c d e f g h i j k", "# $ % |\n# $ % |\n\n\n x"]


def test_quality(spark, sf, odd, empty):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "longest_repeat"]
    own = spark.createDataFrame(list(enumerate(QUALITY_TEXTS)), "doc_id long, text string")
    for df in (own, documents(spark, sf), odd[1]):
        texts = {r["doc_id"]: r["text"] for r in df.collect()}
        got = by_id(quality.quality_scores(df), *names)
        for i, t in texts.items():
            assert got[i] == brute_quality(t), (i, t and t[:80])
    assert quality.quality_scores(empty).collect() == []


def test_quality_longest_repeat_rejects(spark):
    got = by_id(quality.quality_scores(spark.createDataFrame([(1, QUALITY_TEXTS[1])], "doc_id long, text string")), "base_failed", "kept", "longest_repeat")
    assert got[1] == (True, False, 120)
    text = " ".join(f"v{i}" for i in range(1500)) + "\n" + " ".join(f"v{i}" for i in range(120))
    got = by_id(quality.quality_scores(spark.createDataFrame([(1, text)], "doc_id long, text string")), "base_failed", "kept", "longest_repeat")
    assert got[1] == (False, False, 120)


def test_quality_filter_keeps_columns(odd):
    texts, df = odd
    out = quality.quality_filter(df)
    assert out.schema == df.schema
    assert {r["doc_id"] for r in out.collect()} == {i for i, t in texts.items() if brute_quality(t)[6]}


def words_of(t):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute_leaks(texts, items, least=0.75):
    out = {}
    for d, t in texts.items():
        w = words_of(t)
        for i, s in items.items():
            v = words_of(s)
            k = min(5, len(v))
            if not v or len(w) < len(v):
                continue
            m = len(v) - k + 1
            mine = Counter(tuple(v[j : j + k]) for j in range(m))
            grams = [tuple(w[j : j + k]) for j in range(len(w) - k + 1)]
            if not any(g in mine for g in grams):
                continue
            best = 0.0
            for a in range(len(grams) - m + 1):
                common = sum((Counter(grams[a : a + m]) & mine).values())
                best = max(best, common / (2 * m - common))
            if best >= least:
                out[d, i] = best
    return out


def test_leaks(spark, sf, odd, empty):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    items = {r["item_id"]: r["text"] for r in bench.collect()}
    df = documents(spark, sf)
    texts = {r["doc_id"]: r["text"] for r in df.collect()}
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.leaks(df, bench).collect()}
    assert got == pytest.approx(brute_leaks(texts, items))
    clean = decontaminate.decontaminate(df, bench)
    assert clean.columns == df.columns and {r["doc_id"] for r in clean.collect()} == set(texts) - {d for d, _ in got}
    assert decontaminate.leaks(empty, bench).collect() == []
    assert decontaminate.leaks(df, bench.limit(0)).collect() == []


def test_leaks_edits_and_short_items(spark):
    base = [f"q{i}" for i in range(60)]
    edited = list(base)
    edited[3] = "changed"
    far = list(base)
    for p in range(0, 60, 6):
        far[p] = "other"
    docs = {1: "x y z " + " ".join(edited) + " tail", 2: " ".join(far), 3: "some tiny item here", 4: None, 5: " ".join(base[:50])}
    items = {10: " ".join(base), 11: "tiny item", 12: "", 13: None, 14: " ".join(base)}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.leaks(df, bench).collect()}
    assert got == pytest.approx(brute_leaks(docs, items))
    assert set(got) >= {(1, 10), (1, 14), (3, 11)} and not any(d == 2 for d, _ in got)


def test_item_blocks(spark, monkeypatch):
    """Items in many blocks give what they give in one."""
    bench = spark.createDataFrame([(i, " ".join(f"b{i}w{k}" for k in range(20))) for i in range(12)], "item_id long, text string")
    df = spark.createDataFrame([(i, "start " + " ".join(f"b{i}w{k}" for k in range(20))) for i in range(12)], "doc_id long, text string")
    blocks = list(decontaminate.blocks_of(bench, 1200))
    assert len(blocks) > 3 and sorted(i for b in blocks for i in b.ids.tolist()) == list(range(12))
    monkeypatch.setattr(decontaminate.blocks_of, "__defaults__", (1200,))
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(df, bench).collect()} == {(i, i) for i in range(12)}


def test_every_item_within_radius_is_found(spark):
    """The index gives every item whose fingerprint is within the radius, and none beyond."""
    import random

    import numpy as np

    rng = random.Random(4)
    bench = spark.createDataFrame([(i, " ".join(f"i{i}k{k}" for k in range(30))) for i in range(50)], "item_id long, text string")
    (index,) = decontaminate.blocks_of(bench)
    for flips in (0, 20, decontaminate.RADIUS, decontaminate.RADIUS + 1):
        for _ in range(40):
            i = rng.randrange(50)
            bits = np.unpackbits(index.prints[i].view(np.uint8))
            bits[rng.sample(range(256), flips)] ^= 1
            probe = np.packbits(bits).view("<u2")[None]
            near = np.flatnonzero(decontaminate._distance(np.repeat(probe, 50, axis=0), index.prints) <= decontaminate.RADIUS).tolist()
            assert index.look_up(probe, 30)[1].tolist() == near
            assert (i in near) == (flips <= decontaminate.RADIUS)
            assert not len(index.look_up(probe, 29)[1])


def test_recall_near_the_threshold(spark):
    """Copies with edits that leave a similarity of 0.75 to 0.9: at least nine of ten are found, by count all but few."""
    import random

    rng = random.Random(11)
    items, docs = {}, {}
    for i in range(120):
        base = [f"v{i}x{k}" if rng.random() < 0.9 else "the" for k in range(rng.randint(30, 90))]
        items[i] = " ".join(base)
        for p in rng.sample(range(len(base)), max(1, len(base) // 40)):
            base[p] = f"changed{i}"
        docs[i] = "before " + " ".join(base) + " after it"
    want = brute_leaks(docs, items)
    df, bench = spark.createDataFrame(list(docs.items()), "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.leaks(df, bench).collect()}
    assert set(got) <= set(want) and len(want) > 50 and min(want.values()) < 0.78
    assert len(got) >= 0.97 * len(want) and all(got[k] == pytest.approx(want[k]) for k in got)


def test_words_match_the_pattern():
    texts = ["a\x0bb\x0cc", "x y  z", "", "  lead", "trail  ", "é\tü"]
    data, bounds = utf8(pa.array(texts))
    words = Words(data, bounds)
    raw = data.tobytes()
    got = [[raw[s:e].decode() for s, e, d in zip(words.start, words.end, words.doc) if d == i] for i in range(len(texts))]
    assert got == [re.findall(r"[^\x20\x09-\x0D]+", t) for t in texts]
