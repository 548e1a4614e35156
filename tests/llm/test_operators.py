"""Each operator against a brute-force version on small tables with nulls, ties, repeats and clashing names."""

import hashlib
import math
import random
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.llm import decontaminate, exact, graph, langid, licenses, mixing, neardup, ngram, quality, revisits, rollup, substring
from tracewright.llm.common import Runs, written

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, id long, v long, kept boolean, digest string"


def table(spark, rows):
    """Rows of (doc_id, text[, lang[, source]]) with columns whose names the operators use themselves."""
    full = [(*r, *[None] * (4 - len(r)), 0, 1, 2, 3, False, "x") for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def words(rng, n, size=40):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


EMPTY = []
ODD = [(1, None), (2, ""), (3, "  \t "), (4, "One two"), (4, "One two"), (None, "one TWO"), (None, None), (5, "É é"), (6, "a " * 5000)]


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


@pytest.mark.parametrize("rows", [EMPTY, ODD, [(i, "Same" if i % 3 else f"t{i}") for i in range(120)]])
def test_exact(spark, rows):
    got = exact.exact_dedup(table(spark, rows), least=8).collect()
    groups = defaultdict(list)
    for i, t in rows:
        groups[lower(t)].append(i)
    assert len(got) == len(rows)
    want = Counter()
    for t, ids in groups.items():
        top = max((i for i in ids if i is not None), default=None)
        for i in ids:
            want[i, top, len(ids), hashlib.sha256(t.encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == len(groups) and all(r.doc_id == r.keep_id for r in got if r.kept)
    left = exact.drop_copies(table(spark, rows), least=8).collect()
    assert len(left) == len(groups) and {lower(r.text) for r in left} == set(groups)


def components(n, links):
    at = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(at[a], at[b])
            if at[a] != m or at[b] != m:
                at[a] = at[b] = m
                changed = True
    return at


def test_graph(spark):
    rng = random.Random(3)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(60, 90)]
    want = components(91, links)
    got = {r.id: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: want[i] for i in {x for a, b in links if a != b for x in (a, b)}}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("short", [64, 3])
@pytest.mark.parametrize("percent", [80, 85])
def test_near(spark, short, percent):
    rng = random.Random(5)
    base = [words(rng, 80, 10**6) for _ in range(4)]
    passage = words(rng, 60, 10**6)
    rows = [(1, None), (2, ""), (3, "Just three words"), (4, "just THREE words"), (5, "three words just")]
    for i in range(6, 120):
        w = base[i % 4].split()
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(w).upper() if i % 9 == 0 else " ".join(w)))
    rows += [(i, passage + " " + words(rng, 15, 10**6)) for i in range(120, 160)]
    rng.shuffle(rows)
    sets = {}
    for i, t in rows:
        w = lower(t).split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] & sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    want = components(max(sets) + 1, links)
    got = {r.doc_id: r for r in neardup.near_dedup(table(spark, rows), percent=percent, short=short).collect()}
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(s), want[i], want[i] == i) for i, s in sets.items()}


def test_near_links(spark):
    """Sketches lose no link that the exact search finds, at the threshold too."""
    rng = random.Random(31)
    rows = []
    for g in range(60):
        base = [f"g{g}x{j}" for j in range(120)]
        for i in range(6):
            w = list(base)
            for j in rng.sample(range(0, 120, 6), rng.randrange(5)):
                w[j] = f"e{g}x{i}x{j}"
            rows.append((10 * g + i, " ".join(w)))
    exact_, sketched = ({r.doc_id: r.component_id for r in neardup.near_dedup(table(spark, rows), exact=x, short=4).collect()} for x in (True, False))
    assert exact_ == sketched and len(set(exact_.values())) < len(rows)


def test_near_odd(spark):
    assert neardup.near_dedup(table(spark, EMPTY)).count() == 0
    got = neardup.near_dedup(table(spark, ODD)).collect()
    assert len(got) == len(ODD) and all(r.kept for r in got)


def brute_substring(rows, size):
    first = {}
    seqs = {i: (t or "").split() for i, t in rows}
    for i, w in seqs.items():
        for j in range(len(w) - size + 1):
            k = tuple(w[j : j + size])
            first[k] = min(first.get(k, i), i)
    out = {}
    for i, w in seqs.items():
        gone = set()
        for j in range(len(w) - size + 1):
            if first[tuple(w[j : j + size])] < i:
                gone |= set(range(j, j + size))
        left = [x for j, x in enumerate(w) if j not in gone]
        spans = [j for j in range(len(w) + 1) if (j in gone) != (j - 1 in gone)]
        out[i] = (len(w), len(gone), hashlib.sha256(" ".join(left).encode()).hexdigest(), [list(x) for x in zip(spans[::2], spans[1::2])])
    return out


@pytest.mark.parametrize(("size", "seed"), [(50, 16), (8, 3), (5, 5)])
def test_substring(spark, size, seed):
    rng = random.Random(size)
    shared = [words(rng, size + rng.randrange(20), 10**6) for _ in range(6)] + ["b " * (2 * size)]
    rows = [(i, " ".join(x for _ in range(rng.randrange(4)) for x in (rng.choice(shared), words(rng, rng.randrange(9), 10**6)))) for i in range(60)]
    rows += [(60 + i, rows[i][1]) for i in range(10)] + [(80, None), (81, ""), (82, "few words")]
    rows += [(90 + i, " ".join(shared[i].split()[: size - 1 + i % 2])) for i in range(6)]
    rng.shuffle(rows)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256, r.factors or []) for r in substring.substring_dedup(table(spark, rows), size, seed).collect()}
    assert got == brute_substring(rows, size)


def test_substring_odd(spark):
    assert substring.substring_dedup(table(spark, EMPTY)).count() == 0
    got = substring.substring_dedup(table(spark, ODD)).collect()
    assert len(got) == len(ODD) and not any(r.n_removed for r in got)


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def best_distance(item, text):
    """Least edit distance of the item to any part of the text."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_decontaminate(spark):
    rng = random.Random(8)
    items = [(i, words(rng, rng.randrange(9, 40), 500)) for i in range(12)] + [(20, None), (21, "too short"), (22, ""), (23, "Solitary!"), (24, "one two three four five six"), (25, "too SHORT"), (26, "...")]
    rows, planted = [(1, None), (2, ""), (3, words(rng, 300, 500))], set()
    rows += [(4, "It is too short, too short."), (5, "a solitary one two three four five six"), (5, "one two three four changed six"), (6, "too"), (7, "short too")]
    for k in range(60):
        i, text = items[k % 12]
        w = text.split()
        for _ in range(rng.randrange(len(w) // 5 + 1) if len(w) >= 10 else 0):
            p, kind = rng.randrange(len(w)), rng.randrange(3)
            w[p : p + (kind != 1)] = [] if kind == 2 else [f"z{k}"]  # change, insert or delete a word
        rows.append((100 + k, words(rng, 30, 10**6) + " " + " ".join(w).title() + ". " + words(rng, 20, 10**6)))
        planted.add((100 + k, i))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contaminated(table(spark, rows), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} >= planted
    texts, known = dict(rows), dict(items)
    # Every match that there is, by alignment of each item with each text.
    tokens = lambda t: [x for x in (w.strip("!.,").lower() for w in (t or "").split()) if x]
    want = {(d, i): best for d, t in rows for i, x in items if tokens(x) and (best := best_distance(tokens(x), tokens(t))) <= decontaminate.edits(len(tokens(x)))}
    assert {(r.doc_id, r.item_id): r.distance for r in got} == want and any(i >= 20 for _, i in want)
    for r in (r for r in got if r.doc_id > 7):
        part = [w.strip(".").lower() for w in texts[r.doc_id].split()][r.first_word : r.end_word]
        assert edit(known[r.item_id].split(), part) == r.distance <= 0.2 * len(known[r.item_id].split())
    blocks = decontaminate.contaminated(table(spark, rows), bench, block=3, block_words=60).collect()
    assert sorted(blocks) == sorted(got)
    assert decontaminate.contaminated(table(spark, EMPTY), bench).count() == 0
    assert decontaminate.contaminated(table(spark, rows), bench.limit(0)).count() == 0
    assert decontaminate.contaminated(table(spark, ODD), bench).count() == 0


def test_nearest():
    rng = np.random.default_rng(2)
    for _ in range(200):
        a, b = (rng.integers(0, 4, rng.integers(1, 9)).astype(np.uint64) for _ in range(2))
        d, lo, hi = decontaminate.nearest(a, b)
        best = min(edit(a.tolist(), b[i:j].tolist()) for i in range(len(b) + 1) for j in range(i, len(b) + 1))
        assert d == best == edit(a.tolist(), b[lo:hi].tolist())


def brute_ppm(train, text, order):
    """Code length by the definition: escape from the longest context to shorter ones."""
    counts = defaultdict(Counter)
    for t in train:
        b = b"\n" * (order - 1) + t.encode().lower()
        for i in range(order - 1, len(b)):
            for k in range(order):
                counts[b[i - k : i]][b[i]] += 1
    total, b = 0.0, b"\n" * (order - 1) + text.encode().lower()
    for i in range(order - 1, len(b)):
        for k in range(order - 1, -1, -1):
            seen = counts.get(b[i - k : i])
            if not seen:
                continue
            t, d = sum(seen.values()), len(seen)
            if b[i] in seen:
                total -= math.log2(seen[b[i]] / (t + d))
                break
            total -= math.log2(d / (t + d))
        else:
            total += 8
    return total


def test_ppm(spark):
    train = {"aa": ["abab abba cab", "bab", "abc"], "bb": ["xyzzy xx yy", "zyx abz"]}
    rows = [(i, t, lang) for i, (lang, t) in enumerate((lang, t) for lang, ts in train.items() for t in ts)]
    model = langid.PPM.fit(table(spark, [*rows, (50, None, "aa"), (51, "text", None), (52, "", "bb")]), order=4)
    tests = ["abba", "zyx xyz", "Q!", "", None, "123 -", "abz cab xyzzy " * 50]
    got = {r.doc_id: r for r in langid.predict(table(spark, [(i, t) for i, t in enumerate(tests)]), model, keep=["doc_id"]).collect()}
    for i, t in enumerate(tests):
        if not t or not any(c.isalpha() for c in t):
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        bits = {lang: brute_ppm(ts, t, 4) for lang, ts in train.items()}
        assert got[i].lang_pred == min(sorted(bits), key=bits.get)
        assert got[i].bits == pytest.approx(min(bits.values()), rel=1e-5)
        assert got[i].score == pytest.approx(1 / sum(2 ** (min(bits.values()) - x) for x in bits.values()), rel=1e-3)
    none = langid.PPM.fit(table(spark, EMPTY))
    assert {r.lang_pred for r in langid.predict(table(spark, rows), none).collect()} == {"und"}


def test_ppm_all_grams(spark, monkeypatch):
    """Trees that don't fit at once give the same code lengths, and a small language beside a hot one stays."""
    monkeypatch.setattr(langid, "BLOCK", 2)
    rng = random.Random(16)
    train = {"hot": ["".join(rng.choice("abcdefgh ") for _ in range(900)) for _ in range(4)], "mid": ["xyz abc " * 3], "small": ["pqrs tuv"]}
    rows = [(i, t, lang) for i, (lang, t) in enumerate((lang, t) for lang, ts in train.items() for t in ts)]
    model = langid.PPM.fit(table(spark, rows), order=4, most=900)
    tests = ["pqrs", "abc hgf", "xyz", "123", None, "tuv pqrs " * 9, "pqrs"]
    got = langid.predict(table(spark, list(enumerate(tests))).withColumnRenamed("n", "key"), model, keep=["doc_id", "key"]).collect()
    assert len(model.parts) > 2 and len(got) == len(tests) and {r.key for r in got} == {1}
    for r in got:
        t = tests[r.doc_id]
        if r.doc_id in (3, 4):
            assert (r.lang_pred, r.score, r.bits) == ("und", 0.0, 0.0)
            continue
        bits = {lang: brute_ppm(ts, t, 4) for lang, ts in train.items()}
        assert r.lang_pred == min(sorted(bits), key=bits.get) and r.bits == pytest.approx(min(bits.values()), rel=1e-5)
        assert r.score == pytest.approx(1 / sum(2 ** (min(bits.values()) - x) for x in bits.values()), rel=1e-3)
    assert {r.lang_pred for r in got if r.doc_id in (0, 5, 6)} == {"small"}


def brute_kn(train, order):
    """Interpolated modified Kneser-Ney, recursively by the textbook."""
    counts = {order: Counter()}
    for t in train:
        b = b"\n" * (order - 1) + t.encode()
        for i in range(order - 1, len(b)):
            counts[order][b[i - order + 1 : i + 1]] += 1
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    cut = {}
    for k, c in counts.items():
        n = Counter(c.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0
        cut[k] = [0.5 if not (n[1] and n[j]) else max(0.05, min(j - 0.05, j - (j + 1) * y * n[j + 1] / n[j])) for j in (1, 2, 3)]
    by = {k: defaultdict(list) for k in counts}
    for k, c in counts.items():
        for g, n in c.items():
            by[k][g[:-1]].append(n)

    def p(g, k):
        if k == 0:
            return 1 / 256
        seen = by[k].get(g[:-1])
        if not seen:
            return p(g[1:], k - 1)
        n, d = counts[k].get(g, 0), cut[k]
        total, gamma = sum(seen), sum(d[min(x, 3) - 1] for x in seen) / sum(seen)
        return (n - d[min(n, 3) - 1] if n else 0) / total + gamma * p(g[1:], k - 1)

    def bits(text):
        b = b"\n" * (order - 1) + text.encode()
        return -sum(math.log2(p(b[i - order + 1 : i + 1], order)) for i in range(order - 1, len(b)))

    return bits


def test_kneser_ney(spark):
    rng = random.Random(4)
    train = [words(rng, 12, 30) for _ in range(40)]
    counts = written(langid.gram_counts(table(spark, [(i, t, "xx") for i, t in enumerate(train)]), 4, lower=False))
    model = quality.tables(quality.kneser_ney(counts, 4), 4)
    bits = brute_kn(train, 4)
    tests = ["w1 w2", "hello", "w7 w7 w7 Q", words(rng, 50, 60)]
    got = {r.doc_id: r for r in quality.perplexity(table(spark, [(i, t, "xx") for i, t in enumerate(tests)]), model, ["doc_id"]).collect()}
    for i, t in enumerate(tests):
        assert got[i].bits == pytest.approx(bits(t), rel=1e-4) and got[i].n_bytes == len(t)


def test_quality(spark):
    rng = random.Random(6)
    good = [(i, words(rng, 60, 50), "xx" if i % 2 else "yy") for i in range(300)]
    bad = [(1000 + i, "".join(rng.choice("#$%&QZ!") for _ in range(300)), "xx") for i in range(10)]
    odd = [(2000, None, "xx"), (2001, "", "yy"), (2002, "text", None), (2003, "text", "zz"), (None, words(rng, 60, 50), "xx")]
    labels = spark.createDataFrame([(i, 1, 0) for i, _, _ in good] + [(i, 0, 0) for i, _, _ in bad] + [(None, 1, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.judge(table(spark, good + bad + odd), labels).collect()}
    assert len(got) == len(good + bad + odd)
    assert sum(got[i].kept for i, _, _ in good) >= 297 and not any(got[i].kept for i, _, _ in bad)
    assert not got[2000].kept and not got[2001].kept and got[2002].kept and got[2003].kept and got[None].kept
    assert quality.judge(table(spark, EMPTY), labels).count() == 0
    assert all(r.kept for r in quality.judge(table(spark, good), labels.limit(0)).collect())


def test_quality_all_grams(spark):
    """Any bound on what is held at once gives the same rows, for a small language beside a hot one too."""
    rng = random.Random(15)
    rows = [(i, "".join(rng.choice("abcdefghij klmno") for _ in range(rng.randrange(20, 200))), "hot") for i in range(120)]
    rows += [(1000 + i, "".join(rng.choice("uvwxyz ") for _ in range(60)), "small") for i in range(20)]
    rows += [(2000, rows[0][1], "hot"), (2000, rows[0][1], "small"), (2001, "", "hot"), (2002, None, "hot"), (2003, "zz", None), (None, "zz 0123456789" * 9, "small")]
    labels = spark.createDataFrame([(i, 1, 0) for i, _, _ in rows[:140]], "doc_id long, quality int, toxic int")
    key = lambda r: (r.doc_id or -1, r.lang or "", r.n_bytes)
    one, many = (sorted(quality.judge(table(spark, rows), labels, most=most).collect(), key=key) for most in (1_000_000, 6_000))
    assert len(one) == len(many) == len(rows)
    for a, b in zip(one, many):
        assert (a.doc_id, a.lang, a.n_bytes, a.kept) == (b.doc_id, b.lang, b.n_bytes, b.kept)
        for x in ("bits_per_byte", "threshold"):
            assert (a[x] is None) == (b[x] is None) and (a[x] is None or abs(a[x] - b[x]) < 1e-6)
    assert all(r.threshold is not None for r in many if r.lang == "small")
    assert not next(r for r in many if r.doc_id is None).kept


def test_licenses(spark):
    known = licenses.known(spark)
    rows = [(1, "Released under the MIT License."), (2, "Copyright 2020 Me\nRELEASED under the M.I.T licence"), (3, "released   under,\nthe MIT Licence!"), (4, "Prose about the MIT License and more."),
            (5, "Some text.\nLicensed under CC BY-NC 4.0.\nMore text.\nReleased under the MIT licence\nLicensed under CC BY-NC 4.0."), (6, None), (7, ""), (7, "Copyright only"), (None, "Released under the MIT License.")]
    got = defaultdict(list)
    for r in licenses.license_scan(table(spark, rows), known).collect():
        got[r.doc_id].append((r.text_license, r.notices, r.licenses))
    assert got[1] == [("MIT", 1, "MIT")] and got[3][0][0] == "MIT" and got[None] == [("MIT", 1, "MIT")]
    assert got[4] == [(None, 0, None)] and got[5] == [(None, 3, "CC-BY-NC-4.0,MIT")]
    assert got[6] == [(None, 0, None)] and got[7] == [(None, 0, None)] * 2
    assert licenses.license_scan(table(spark, EMPTY), known).count() == 0
    assert {r.licenses for r in licenses.license_scan(table(spark, rows), known.limit(0)).collect()} == {None}
    with pytest.raises(ValueError):
        licenses.license_scan(table(spark, rows), known, most=3)


def test_license_texts(spark):
    """Whole licences in altered case, spelling, punctuation, wrapping and copyright lines, alone and inside documents."""
    rng, rows, want = random.Random(12), [], {}
    for i, (name, text) in enumerate(licenses.TEXTS):
        words = text.replace("license", "licence").replace('"', "''").split()
        wrapped, line = [f"Copyright (c) 20{i:02d} Somebody", "All rights reserved."], ""
        for w in words:
            line = f"{line} {w.upper() if rng.random() < 0.2 else w}".strip()
            if len(line) > rng.randrange(30, 90):
                wrapped.append(f"  {line}")
                line = ""
        body = "\n".join([*wrapped, line])
        rows += [(10 * i, body), (10 * i + 1, f"Some prose first.\n{body}\n\nAnd more prose."), (10 * i + 2, body.rstrip() + " and then some"), (10 * i + 3, " ".join(words[:-1]))]
        want |= {10 * i: (name, 1, name), 10 * i + 1: (None, 1, name), 10 * i + 2: (None, 0, None), 10 * i + 3: (None, 0, None)}
    for r in licenses.license_scan(table(spark, rows), licenses.known(spark)).collect():
        whole, contained, names = want[r.doc_id]
        # The first line of some texts is itself a known notice, as is each of a text's lines that stands alone.
        assert (r.text_license, r.contained) == (whole, contained) and (names is None or names in r.licenses.split(","))
        assert names or not r.licenses or r.notices


def test_license_lines(spark):
    """Documents of very many lines behind, between and before licence texts: the time follows the length."""
    mit, known = licenses.TEXTS[0][1], licenses.known(spark)
    code = "\n".join(f"value_{i} = compute({i}, other_{i % 7})" for i in range(40_000))
    heads = "\n".join(["permission is hereby granted free of charge"] * 3_000)
    rows = [(1, f"{mit}\n{code}"), (2, f"{code}\n{mit}"), (3, f"{mit}\n{code}\n{mit}"), (4, f"{heads}\n{mit}"), (5, code)]
    took = []
    for lines in (code[: len(code) // 8], code):
        began = time.perf_counter()
        assert licenses.license_scan(table(spark, [(1, f"{mit}\n{lines}\n")] * 4), known).where("contained = 1").count() == 4
        took.append(time.perf_counter() - began)
    assert took[1] < 16 * took[0] + 5
    got = {r.doc_id: (r.contained, r.licenses) for r in licenses.license_scan(table(spark, rows), known).collect()}
    assert got == {1: (1, "MIT"), 2: (1, "MIT"), 3: (2, "MIT"), 4: (1, "MIT"), 5: (0, None)}


def test_rollup(spark, tmp_path):
    root = f"file://{tmp_path}/rollup"
    before = rollup.word_counts(table(spark, [(1, "a b", "en", "s"), (2, "c", "en", "s"), (3, None, None, None), (4, "d e f", "en", "t")]))
    after = rollup.word_counts(table(spark, [(1, "a b", "en", "s"), (2, "c d e", "en", "s"), (3, None, None, None), (5, "x", "en", "t")]))
    assert rollup.commit(root, "one", rollup.inserted(before)) and not rollup.commit(root, "one", rollup.inserted(before))
    assert rollup.commit(root, "two", rollup.revised(before, after))
    direct = after.groupBy("source", "lang", "tokenizer").agg({"doc_id": "count", "n_tokens": "sum"}).collect()
    got = {tuple(r)[:3]: (r.n_docs, r.n_tokens) for r in rollup.totals(spark, root).collect()}
    assert got == {(r["source"], r["lang"], r["tokenizer"]): (r["count(doc_id)"], r["sum(n_tokens)"]) for r in direct}
    want = sorted(map(str, rollup.totals(spark, root).collect()))
    # An attempt that died before it was named, and one of a batch that another writer has committed meanwhile.
    rollup.inserted(before).select(F.lit("dead").alias("attempt"), "*").write.parquet(f"{root}/deltas/dead")
    spark.createDataFrame([("two", "zzz")], "batch string, attempt string").write.parquet(f"{root}/commits/zzz")
    rollup.inserted(before).select(F.lit("zzz").alias("attempt"), "*").write.parquet(f"{root}/deltas/zzz")
    assert sorted(map(str, rollup.totals(spark, root).collect())) == want
    rollup.compact(spark, root)
    assert sorted(map(str, rollup.totals(spark, root).collect())) == want and not rollup.commit(root, "two", rollup.inserted(before))
    rollup.commit(root, "three", rollup.deleted(after))
    assert rollup.totals(spark, root).count() == 0
    rollup.compact(spark, root)
    assert rollup.totals(spark, root).count() == 0 and rollup.commit(root, "four", rollup.inserted(after))
    assert sorted(map(str, rollup.totals(spark, root).collect())) == want
    assert rollup.totals(spark, f"{root}-none").count() == 0
    bpe = rollup.bpe_counts(table(spark, [(1, "hello world", "en", "s"), (2, None, None, None), (3, "", "en", "s")]), "/opt/tokenizers/byte_bpe_50k.tiktoken", "bpe")
    assert {r.doc_id: r.n_tokens for r in bpe.collect()} == {1: 2, 2: 0, 3: 0}


def test_revisits(spark):
    rng = random.Random(9)
    rows = []
    for i in range(400):
        kind, tag = rng.choice(["response", "revisit"]), rng.choice(['"a"', 'W/"a"', '"b"', None])
        headers = {"date": str(i), "content-type": kind} | ({"etag": tag} if tag else {})
        url = rng.choice(["http://www.x.org/a/", "https://x.org/a?utm_source=f#t", "http://x.org/b"] + ["http://hot.org/"] * 5 + [None])
        rows.append((i, kind, url, rng.randrange(150) if i % 50 else None, None if i % 41 == 0 else headers, f"p{i}" if kind == "response" else None))
    df = spark.createDataFrame(rows, "record_id long, kind string, url string, ts long, headers map<string,string>, payload string")
    got = {r.record_id: r for r in revisits.resolve(df, buckets=5).collect()}
    canon = {"http://www.x.org/a/": "x.org/a", "https://x.org/a?utm_source=f#t": "x.org/a", "http://x.org/b": "x.org/b", "http://hot.org/": "hot.org", None: None}
    for i, kind, url, ts, headers, _ in rows:
        if kind == "response":
            continue
        earlier = [(t, j, h, p) for j, k, u, t, h, p in rows if k == "response" and u and url and canon[u] == canon[url] and t is not None and ts is not None and t < ts]
        r = got[i]
        assert r.canonical_url == canon[url]
        if not earlier:
            assert (r.outcome, r.response_id, r.payload) == ("missing", None, None)
            continue
        _, j, old, payload = max(earlier, key=lambda x: x[:2])
        tag = lambda h: ((h or {}).get("etag") or "").removeprefix("W/") or None
        want = "unvalidated" if tag(headers) is None else "resolved" if tag(headers) == tag(old) else "mismatch"
        assert (r.response_id, r.outcome) == (j, want)
        if want != "mismatch":
            fresh = {k: v for k, v in (headers or {}).items() if k in revisits.PERMITTED}
            assert r.headers == (old or {}) | fresh and r.payload == payload
    assert len(got) == sum(r[1] == "revisit" for r in rows) and revisits.resolve(df.limit(0)).count() == 0


def test_revisits_repeated(spark):
    """Responses sent twice, revisits without a record id or sent twice, and header names in any case."""
    schema = "record_id long, kind string, url string, ts long, headers map<string,string>, payload string, row int, stored int"
    full = (1, "response", "http://x.org/a", 10, {"ETag": '"t"', "etag": '"u"', "Content-Type": "x"}, "p", 0, 0)
    ask = lambda i, ts: (i, "revisit", "https://www.x.org/a", ts, {"ETAG": 'W/"u"', "Date": "d", "X-Own": "no"}, None, 0, 0)
    rows = [full, full, (None, "response", "http://x.org/a", 12, {"etag": '"u"'}, "q", 0, 0), ask(2, 11), ask(2, 11), ask(None, 11), ask(None, 13), ask(3, 5)]
    got = sorted(map(str, revisits.resolve(spark.createDataFrame(rows, schema)).collect()))
    one = {r.record_id or r.response_id: r for r in revisits.resolve(spark.createDataFrame(rows, schema)).collect()}
    assert len(got) == 5 and sum("missing" in x for x in got) == 1 and sum("resolved" in x for x in got) == 4
    assert one[2].headers == {"etag": 'W/"u"', "content-type": "x", "date": "d"} and one[2].payload == "p" and one[3].outcome == "missing"


def test_mixing(spark):
    rng = random.Random(10)
    rows = [(i, words(rng, rng.randrange(1, 40)), "en", "hot" if i % 3 else f"s{i % 7}") for i in range(600)] + [(700, None, "en", "hot"), (701, "", "en", None), (702, "x y", "en", None), (702, "x y", "en", None)]
    docs = table(spark, rows)
    drawn = mixing.mix(docs, block_docs=20, repetition=2.0).collect()
    tokens, own = Counter(), Counter()
    for r in drawn:
        tokens[r.source] += r.n_tokens
    for _, t, _, s in rows:
        own[s] += len((t or "").split())
    quota = {r.source: r for r in mixing.weights(docs.groupBy("source").agg({"n_chars": "max"}).select("source").join(spark.createDataFrame([(k, v) for k, v in own.items()], "s string, tokens long"), docs.source.eqNullSafe(__import__("pyspark").sql.functions.col("s"))).select("source", "tokens"), repetition=2.0).collect()}
    assert sum(q.weight for q in quota.values()) == pytest.approx(1)
    ratio = [q.quota / q.tokens for q in quota.values()]
    assert min(ratio) == pytest.approx(1) and max(ratio) == pytest.approx(2, abs=1e-3)
    longest = max(len((t or "").split()) for _, t, _, _ in rows)
    for s, q in quota.items():
        assert q.quota - longest <= tokens[s] <= q.quota + 1e-3
    # The draws by their definition: whole epochs, then whole blocks in the order of their keys, then of the next block
    # the documents that fit, in the order of their keys.
    by_source = defaultdict(lambda: defaultdict(list))
    for r in drawn:
        by_source[r.source][r.epoch].append(r)
    for s, q in quota.items():
        whole, epochs = math.floor(round(q.quota / q.tokens, 9)), by_source[s]
        everything = sorted(i for i, t, _, x in rows if x == s)
        assert all(sorted(r.doc_id for r in epochs[e]) == everything for e in range(whole)) and set(epochs) <= set(range(whole + 1))
        size = Counter()
        for r in epochs[0]:
            size[r.block] += r.n_tokens
        rest, last = q.quota - whole * q.tokens, epochs.get(whole, [])
        taken = Counter()
        for r in last:
            taken[r.block] += r.n_tokens
        turns = sorted((r.block_key, r.block) for r in last)
        order = list(dict.fromkeys(b for _, b in turns))
        assert all(taken[b] == size[b] for b in order[:-1]) and sum(taken.values()) <= rest + 1e-3
    seen = Counter((r.doc_id, r.epoch) for r in drawn)
    assert max(n for (i, _), n in seen.items() if i != 702) == 1 and {r.doc_id for r in drawn} == {r[0] for r in rows}
    target = mixing.weights(spark.createDataFrame([("a", 900), ("b", 90), ("c", 10)], "source string, tokens long"), entropy=1.0).collect()
    assert -sum(q.weight * math.log(q.weight) for q in target) == pytest.approx(1.0, abs=1e-4)
    assert mixing.mix(table(spark, EMPTY)).count() == 0 and mixing.mix(table(spark, [(1, None), (2, "")])).count() == 0


def test_key_index():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 2**63, 5000).astype(np.uint64))
    at = ngram.KeyIndex(keys)
    assert (at.find(keys) == np.arange(len(keys))).all() and (at.find(keys + np.uint64(1))[~np.isin(keys + np.uint64(1), keys)] == -1).all()
    assert (ngram.KeyIndex(np.zeros(0, np.uint64)).find(keys) == -1).all()


def test_runs():
    tokens = np.arange(50, dtype=np.uint64) % np.uint64(7)
    got = Runs(tokens).windows(5)
    for i in range(46):
        for j in range(46):
            assert (got[i] == got[j]) == (tokens[i : i + 5] == tokens[j : j + 5]).all()


def test_thresholds(spark):
    """The limits of each language and who is kept, from the scores of all texts."""
    rng = random.Random(21)
    rows = [(i, words(rng, rng.randrange(5, 80), 60), "xx" if i % 3 else "yy") for i in range(200)] + [(500 + i, "".join(rng.choice("#$%&QZ! ") for _ in range(90)), "xx") for i in range(20)]
    labels = spark.createDataFrame([(i, int(i < 500), 0) for i, _, _ in rows], "doc_id long, quality int, toxic int")
    got = quality.judge(table(spark, rows), labels).withColumn("held", F.pmod(F.xxhash64("doc_id"), F.lit(quality.HELD_OUT)) == 0).collect()
    for lang in ("xx", "yy"):
        base = [r for r in got if r.lang == lang and r.held and r.doc_id < 500]
        mean = sum(r.bits_per_byte * r.n_bytes for r in base) / sum(r.n_bytes for r in base)
        smooth = lambda r: (r.bits_per_byte * r.n_bytes + 200 * mean) / (r.n_bytes + 200)  # noqa: B023, E731
        limit = sorted(map(smooth, base))[math.ceil(0.99 * len(base)) - 1] + 0.15
        for r in (r for r in got if r.lang == lang):
            assert r.threshold == pytest.approx(limit) and r.kept == (smooth(r) <= limit) and r.perplexity == pytest.approx(2**r.bits_per_byte)


def test_pipeline(spark):
    import corpus_pipeline

    docs = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert docs.count() > 0 and [n for n, _ in corpus_pipeline.STAGES][1:4] == ["exact_dedup", "near_dedup", "decontaminate"]
    empty = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0)
    # Rows with nulls, repeats and very long texts: no stage fails, and each returns rows of what it was given.
    odd = empty.unionByName(spark.createDataFrame([(i, t, "en", "s", 0) for i, t in ODD] + [(9, "x " * 30_000, None, None, None)], "doc_id long, text string, lang string, source string, n_chars int").select(*(F.col(c).cast(empty.schema[c].dataType) for c in empty.columns)))
    given = set(map(tuple, odd.collect()))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "/root/testdata/sf0.001").count() == 0
        got = stage(spark, odd, "/root/testdata/sf0.001")
        if name != "mix":
            assert set(map(tuple, got.collect())) <= given and got.columns == empty.columns
        else:
            assert {r.doc_id for r in got.collect()} <= {x[0] for x in given}
