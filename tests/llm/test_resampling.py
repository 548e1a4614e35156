"""Resampling, divergence and byte-pair encoding against brute force: nulls, ties, repeats, long texts, clashing names."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from time import process_time
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
from test_operators import EMPTY, ODD, lower, table

from tracewright.llm import bpe, divergence, resample

VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"


def features(text, n):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    return words, [" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)]


def resampled(rows, target, n, least, percent, buckets=10_000):
    s = Counter(crc32(f.encode()) % buckets for _, t in rows for f in features(t, n)[1])
    t = Counter(crc32(f.encode()) % buckets for x in target for f in features(x, n)[1])
    big_s, big_t, scored = sum(s.values()), sum(t.values()), []
    for i, text in rows:
        words, found = features(text, n)
        at = [crc32(f.encode()) % buckets for f in found]
        gains = [math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in at]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        scored.append((i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words)))
    able = sorted((r for r in scored if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, -r[2], -r[1]))
    drawn = able[: len(able) * percent // 100]
    return Counter([(*r[:4], k + 1) for k, r in enumerate(drawn)] + [(*r[:4], None) for r in able[len(drawn) :] + [r for r in scored if r[4] < least]])


def some_texts(rng, n):
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "straße", "日本", "A1b", "x"]
    return [" ".join(rng.choice(vocabulary) + rng.choice(["", "", ",", "\n", "  -  ", "."]) for _ in range(rng.choice([0, 1, 5, 19, 20, 21, 60, 300]))) for _ in range(n)]


@pytest.mark.parametrize("chunk", [16, 200, 1 << 16])
@pytest.mark.parametrize("n", [1, 2, 3])
def test_resample(spark, chunk, n):
    rng = random.Random(chunk + n)
    rows = list(enumerate(some_texts(rng, 60))) + [(7, "again " * 30), (7, "again " * 30), (None, "no id " * 20)] + ODD
    target = some_texts(rng, 5) + [None, ""]
    got = resample.resample(table(spark, rows), table(spark, [(None, t) for t in target]), ngrams=n, chunk=chunk).collect()
    assert Counter((r.doc_id, r.n_features, r.weight, r.score, r.rank) for r in got) == resampled(rows, target, n, 20, 25)


def test_resample_parts(spark):
    """Chunks own every feature once, and their texts add up."""
    text = b"one two  three four five six seven " * 7
    for most in range(1, 60, 7):
        cut = list(resample.chunks(text, most, 2))
        assert b"".join(own for own, _ in cut) == text
        assert Counter(f for own, carried in cut for f in resample.buckets(own, carried, 3, 1 << 31)[1]) == Counter(resample.buckets(text, b"", 3, 1 << 31)[1])
    assert resample.resample(table(spark, EMPTY), table(spark, EMPTY)).count() == 0
    rows = table(spark, [(i, f"word{i} " * 30) for i in range(40)])
    picked = resample.resample(rows, table(spark, [(0, "word3 word3")]))
    assert resample.drawn(rows, picked).count() == 10 and sorted(r.rank for r in picked.where("rank is not null").collect()) == list(range(1, 11))
    long = " ".join(f"t{i % 977}" for i in range(400_000))  # 2 MB in one row
    assert resample.resample(table(spark, [(1, long)]), table(spark, [])).first().n_features == 799_999


def audited(rows, least, ranks):
    """rows: (text, lang, source)"""
    rows = [tuple(x or "" for x in r) for r in rows]
    df, counts, groups = defaultdict(Counter), defaultdict(Counter), {(l, s) for _, l, s in rows}
    for t, l, s in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(t))
        df[l].update(set(terms))
        counts[l, s].update(terms)
    out = set()
    for l, s in groups:
        kept = [t for t, n in df[l].items() if n >= least]
        share = lambda c, k: 1 + 10**9 * (k + 5) // (sum(c[t] for t in kept) + 5 * len(kept))  # noqa: B023, E731
        whole = sum((counts[l, o] for m, o in groups if m == l), Counter())
        p = {t: share(counts[l, s], counts[l, s][t]) for t in kept}
        pair = [(sum(abs(p[t] - share(counts[l, o], counts[l, o][t])) for t in kept), o) for m, o in groups if m == l and o != s]
        term = [(p[t] - q, t) for t in kept if counts[l, s][t] > 0 and p[t] > (q := share(whole, whole[t]))]
        for part, found, most in (("pair", pair, None), ("term", term, ranks)):
            ordered = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
            out |= {(l, s, part, item, value, i + 1) for i, (value, item) in enumerate(ordered)}
    return out


@pytest.mark.parametrize("width", [1 << 16, 64, 2])
@pytest.mark.parametrize("least", [1, 4, 300])
def test_audit(spark, width, least):
    rng = random.Random(least)
    words = ["Ab", "ab", "c1d", "é", "日本", "zz-top", "x", "long_term"] + [f"{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(80)]
    rows = [(" ".join(rng.choice(words[: 20 + 10 * (i % 7)]) for _ in range(rng.randrange(12))), rng.choice(["en", "en", "en", "fr", None, ""]), rng.choice(["a", "a", "b", "é", None])) for i in range(150)]
    rows += [(None, "en", "empty"), ("1 2 3", "de", "only"), ("ties ties", "fr", "a"), ("ties ties", "fr", "a")]
    got = divergence.audit(table(spark, [(i, *r) for i, r in enumerate(rows)]), least=least, ranks=5, width=width, depth=2).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == audited(rows, least, 5)


def test_audit_sketch(spark):
    """Counters never fall short of the frequency, whatever collides; a term isn't cut between slices of a long text."""
    rng = random.Random(9)
    rows = [(i, " ".join(f"t{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}" for _ in range(20)), rng.choice("ab")) for i in range(200)]
    counters = divergence.sketch(table(spark, rows), least=40, width=97, depth=3)
    df = defaultdict(Counter)
    for _, t, l in rows:
        df[l].update(set(t.split()))
    for l, seen in df.items():
        estimate = counters[divergence.places(divergence.hashes([t.encode() for t in seen], l.encode()), 97, 3)].min(axis=0)
        assert all(e >= min(40, n) for e, n in zip(estimate.tolist(), seen.values())) and estimate.max() <= 40
    assert divergence.term_counts(b"alpha beta1gamma " * 50, most=7) == Counter({b"alpha": 50, b"beta": 50, b"gamma": 50})
    assert divergence.audit(table(spark, EMPTY)).count() == 0


@pytest.mark.parametrize("most", [1, 40, 1 << 22])
def test_audit_terms(most):
    """Terms of texts that are counted together stay apart, at both ends of texts and around empty ones."""
    texts = ["", "Ab", "ab", " ab\tAB9x ", "日本-é\x00É", "12 3", "", "no_underscore " * 9, "é"]
    got = Counter()
    for terms, doc, term, n in divergence.occurrences([t.encode() for t in texts], most):
        terms = terms.to_pylist()
        got.update({(d, terms[t].decode()): k for d, t, k in zip(doc.tolist(), term.tolist(), n.tolist())})
    assert got == Counter((d, t) for d, text in enumerate(texts) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text)))


def test_audit_hashes():
    """A term's hash doesn't depend on its neighbours, and long terms are hashed alone."""
    terms = [b"a", "日本".encode(), b"x" * 70_000, b"b", b"x" * 70_000, b"a", b"y" * 65_536, b"z" * 65_537]
    found = divergence.term_hashes(pa.array(terms, pa.binary()))
    assert found[0] == found[5] and found[2] == found[4] and len(set(found.tolist())) == 6
    assert (divergence.term_hashes(pa.array([b"before", *terms], pa.binary()).slice(1)) == found).all()


def test_audit_tally():
    """Rows are summed up before there are too many of them, and none is lost or doubled when they are handed out."""
    rng, tally, expected, got = random.Random(2), divergence.Tally(most=20), Counter(), Counter()
    groups = [(b"en", b"a"), (b"en", "é".encode()), (b"", b"")]

    def handed_out():
        for rows in map(pa.RecordBatch.to_pylist, tally.rows(batch=7)):
            for r in rows:
                got.update({(r["lang"], r["source"], r["term"], "n"): r["n"], (r["lang"], r["source"], r["term"], "docs"): r["docs"]})

    for _ in range(60):
        keys = rng.sample([(g, t) for g in range(3) for t in range(12)], rng.randrange(12))
        n, docs = [rng.randrange(1, 9) for _ in keys], [rng.randrange(1, 9) for _ in keys]
        for (g, t), x, y in zip(keys, n, docs):
            name = (groups[g][0].decode(), groups[g][1].decode(), f"t{t}")
            expected.update({(*name, "n"): x, (*name, "docs"): y})
        tally.add(groups, np.array([g for g, _ in keys], np.int64), pa.array([b"t%d" % t for _, t in keys], pa.binary()), np.array(n, np.int64), np.array(docs, np.int64))
        assert tally.size <= 40
        if rng.random() < 0.1:
            handed_out()
    handed_out()
    assert got == expected and not list(tally.rows())


def test_audit_cost():
    """Counting takes about the time of Python's own counter of each text's words; it took more than twice as long."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(rng.randrange(2, 12))) for _ in range(20_000)]
    batch = [" ".join(rng.choices(words, k=300)).encode() for _ in range(1_000)]

    def least_cpu(run):
        took = []
        for _ in range(5):
            began = process_time()
            run()
            took.append(process_time() - began)
        return min(took)

    assert least_cpu(lambda: list(divergence.occurrences(batch))) < 1.5 * least_cpu(lambda: [Counter(t.translate(divergence.TERMS).split()) for t in batch])


@pytest.fixture(scope="module")
def coder():
    with open(VOCABULARY, encoding="utf-8") as file:
        return bpe.ready(file.read())


def tree(coder, text, piece, leaf):
    out, leaves, cut = [], [], list(coder.cut(text, piece, leaf))
    for (kind, _), ids in zip(cut, coder.pieces([k for k, _ in cut], [p for _, p in cut])):
        ids = np.frombuffer(ids, "<u4").tolist()
        if kind < bpe.LEAF_IN:
            out += ids
            continue
        leaves.append(ids)
        if kind == bpe.LEAF_END:
            out, leaves = out + coder.tree(leaves), []
    return out


def test_bpe_trees(coder):
    rng = random.Random(2)
    kinds = ["abcdefghijklmnopqrstuvwxyz", "ab", "a", "aeiou", "éèüßñ", "日本語中文字", "!?.", "0123", "eEtThH", "aé日!0'<|> \n\t", "́ıİʼΣσς"]
    words = ["the", "ing", "startoftext", "<|endoftext|>", "<|startoftext|>", "happi", "'s", "'ll"]
    for _ in range(400):
        kind, n = rng.choice(kinds), rng.randrange(400)
        text = "".join(rng.choice(kind) if rng.random() < 0.8 else rng.choice(words) for _ in range(n))
        want = coder.whole.encode(text, add_special_tokens=False).ids
        for piece, leaf in ((16, 8), (32, 5), (20, 1)):
            assert tree(coder, text, piece, leaf) == want
    for text in ("a" * 100_003, "ab" * 40_000 + "c", "".join(rng.choice("etaoin") for _ in range(100_000))):
        assert tree(coder, text, 1 << 12, 1 << 9) == coder.whole.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("piece", [24, bpe.PIECE])
def test_bpe(spark, coder, piece):
    rng = random.Random(4)
    texts = ["Don't stop me  now", "x" * 500, " " * 300, "naïve ﬁ Å " * 40, "<|endoftext|>" * 9, "日本語" * 100, "a1!b2?" * 60] + ["".join(rng.choice("abc déf'<|1 \n") for _ in range(rng.randrange(300))) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(texts)] + ODD
    encoded = bpe.encode(table(spark, rows), VOCABULARY, piece=piece, leaf=7)
    got = bpe.decode(encoded, VOCABULARY).collect()
    want = Counter()
    for i, t in rows:
        ids = coder.whole.encode(t or "", add_special_tokens=False).ids
        want[i, len(ids), np.array(ids, "<u4").tobytes(), coder.whole.decode(ids, skip_special_tokens=False)] += 1
    assert Counter((r.doc_id, r.n_tokens, bytes(r.ids), r.text) for r in got) == want


def test_bpe_empty(spark):
    assert bpe.decode(bpe.encode(table(spark, EMPTY), VOCABULARY), VOCABULARY).count() == 0
