"""Each operator against a plain version over small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkeda.llm import decontamination, graph, jaccard, kernels, lbl, licences, lines, mixing, quality, scoring, sharding, substring, tokens

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def words(t):
    return WORD.findall(t or "")


def low(t):
    return (t or "").translate(LOWER)


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def make(n=120, seed=1):
    """Texts with copies, near copies, shared passages, repeated lines, and odd ones."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["Straße", "été", "中文", "İx", "the", "of"]
    text = lambda k: "".join(r.choice(vocabulary) + r.choice([" ", " ", " ", "\n", "\t", "  "]) for _ in range(k))
    passage = text(40)
    out = []
    for i in range(n):
        t = text(r.choice([3, 15, 60, 120]))
        if i % 7 == 0 and out:
            t = out[r.randrange(len(out))]
        elif i % 11 == 0 and out:
            w = (out[r.randrange(len(out))] or "x").split(" ")
            w[r.randrange(len(w))] = "changed"
            t = " ".join(w)
        elif i % 9 == 0:
            t = text(10) + passage + text(5)
        out.append(t)
    out += [None, "", " \n ", "one", "a b c d", "x " * 3000, "same line here\nsame line here\nother\nsame line here\nsame line here\nother\n"]
    return [(i * 3 % 1009, t, r.choice(["en", "de", None]), r.choice(["a", "b", "B", None]), len(t or "")) for i, t in enumerate(out)]


@pytest.fixture(scope="module")
def rows():
    return make()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).persist()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Null and repeated doc_ids, with columns named like those the operators make."""
    t = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"
    return spark.createDataFrame([(None, t, "en", "a", 1), (5, t, "en", "a", 1), (5, t, "en", "a", 1), (7, None, None, None, None), (None, None, "en", None, 0)], SCHEMA).withColumns({"slot": F.lit("mine"), "shard": F.lit(1), "h": F.lit(2), "words": F.lit("w"), "size": F.lit(3)})


def plain(df, key="doc_id"):
    return {r[key]: tuple(r)[1:] for r in df.collect()}


VOCABULARY = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def test_token_codes(docs, rows, empty, odd):
    from tokenizers import Tokenizer

    got, start, t = plain(tokens.token_table(docs, VOCABULARY)), 0, Tokenizer.from_file(VOCABULARY)
    for i, text, *_ in sorted(rows):
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        assert got[i] == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert tokens.token_table(empty, VOCABULARY).count() == 0
    assert tokens.token_table(odd, VOCABULARY).count() == 5


def test_codes_give_random_access():
    rng = np.random.default_rng(1)
    ids = rng.choice([0, 3, 255, 256, 65535, 65536, 2**31], 5000).astype(np.uint32)
    keys, first, dac = tokens.unpack(tokens.pack(np.arange(2), np.array([0, 1234, 5000]), ids))
    assert (dac.slice(0, 5000) == ids).all() and len(dac.levels) == 4
    assert all(dac[i] == ids[i] for i in range(0, 5000, 37)) and dac.slice(1234, 1300).tolist() == ids[1234:1300].tolist()
    assert tokens.unpack(tokens.pack(np.arange(1), np.array([0, 0]), ids[:0]))[2].slice(0, 0).size == 0
    with pytest.raises(ValueError):
        tokens.unpack(b"nothing")


def test_encoder_equals_the_library():
    e, r = tokens.Encoder(VOCABULARY), random.Random(3)
    alphabet = ["a", "B", "é", "É", "J̌", "İ", "Σ", "σς", ".", ",", "'s", "<|endoftext|>", " ", " ", "\t", "́", "1", "中", "ß", "\n", "  ", "the", "<", "̸", "-", "\x00"]
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 30))) for _ in range(3000)]
    ids, first = e.encode(texts, 1)
    assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)] == [x.ids + [1] for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_encoder_on_added_tokens_and_whole_documents():
    """Spellings of added tokens, and every whole text of a table, as the library encodes them."""
    import pyarrow.parquet as pq

    e = tokens.Encoder(VOCABULARY)
    texts = ["<|ENDOFTEXT|>", "<|EndOfText|> x", "a<|endoftext|>b", "<|STARTOFTEXT|>.", "x<|StartOfText|>,"]
    path = Path("/root/testdata/sf0.01/documents.parquet")
    if path.exists():
        texts += [t or "" for t in pq.read_table(path, columns=["text"]).column(0).to_pylist()]
    ids, first = e.encode(texts, 1)
    want = [x.ids + [1] for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)] == want


def test_lookup_table_takes_turns():
    names = [f"s{i}" for i in range(7)]
    table = sharding.lookup_table(names, 101)
    counts = Counter(table)
    assert set(table) == set(range(7)) and max(counts.values()) - min(counts.values()) <= 1
    fewer = sharding.lookup_table(names[:-1], 101)
    assert sum(a != b for a, b in zip(table, fewer, strict=True)) < 60  # far from all move
    with pytest.raises(ValueError):
        sharding.lookup_table(names, 100)


def test_shards(docs, rows, empty, odd):
    table = sharding.lookup_table([f"shard-{k}" for k in range(8)], 809)
    got = {r["doc_id"]: (r["slot"], r["shard"]) for r in sharding.shard(docs, 8).collect()}
    for i, *_ in rows:
        slot = int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16) % 809
        assert got[i] == (slot, table[slot])
    assert sharding.shard(empty).count() == 0
    out = sharding.shard(odd)
    assert out.count() == 5 and out.columns.count("slot") == 1


def test_substring(docs, rows, empty, odd):
    size, first = 13, {}
    for i, t, *_ in sorted(rows, key=lambda r: r[0]):
        w = words(t)
        for a in range(len(w) - size + 1):
            first.setdefault(tuple(w[a : a + size]), i)
    got = plain(substring.deduplicate(docs))
    removed = 0
    for i, t, *_ in rows:
        w = words(t)
        keep = [True] * len(w)
        for a in range(len(w) - size + 1):
            if first[tuple(w[a : a + size])] < i:
                keep[a : a + size] = [False] * size
        kept = " ".join(x for x, y in zip(w, keep, strict=True) if y)
        removed += keep.count(False)
        assert got[i] == (len(w), keep.count(False), sha(kept), kept)
    assert removed > 500
    assert substring.deduplicate(empty).count() == 0
    out = substring.deduplicate(odd).collect()
    assert len(out) == 5 and sorted(r["n_removed"] for r in out) == [0, 0, 0, 15, 15]  # the null id is the smallest


def test_licences(spark, empty, odd):
    texts = ["Released under the MIT License. UNDER THE MIT LICENSE", "Apache License, Version 2.0", "cc by-nc 4.0", "This work is licensed under the GNU General Public License, version 3", "cc by nc cc by nc", "under the mit licence", None, "", "Permission is hereby granted, free of charge, to any person", "mit license the under " * 50]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = plain(licences.scan(d))
    for i, t in enumerate(texts):
        w = ALNUM.findall(low(t))
        hits = [(a, b.label) for b in licences.BASE for a in range(len(w)) if tuple(w[a : a + len(b.words)]) == b.words]
        assert got[i][:5] == (len(w), len(hits), min((a for a, _ in hits), default=None), max((a for a, _ in hits), default=None), ",".join(sorted({x for _, x in hits})))
        assert set(filter(None, got[i][4].split(","))) <= set(filter(None, got[i][5].split(","))) and 0 <= got[i][6] <= 1
    assert got[3][5] == "gpl" and got[8][5] == "mit" and 0 < got[8][6] < 1 and got[4][1] == 2
    assert licences.scan(empty).count() == 0 and licences.scan(odd).count() == 5


def test_licence_places_labels_and_scores(spark):
    """Whole, broken and repeated notices against a search for every phrase at every word."""
    templates, r = licences.BASE + licences.OTHERS, random.Random(2)
    texts = []
    for t in templates:
        w = list(t.words)
        texts += [" ".join(w), "before it " + " ".join(w) + " after", " ".join(w[t.key : t.key + t.n_key]), " ".join(w[t.key :]), " ".join(w[: t.key + t.n_key - 1])]
        gap = r.randrange(len(w))
        texts.append(" ".join([*w[:gap], "else", *w[gap:]] * 2))
    got = plain(licences.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)))
    for i, text in enumerate(texts):
        w, labels, score = text.split(), set(), 0.0
        for t in templates:
            for a in range(len(w) - t.n_key + 1):
                if tuple(w[a : a + t.n_key]) == t.phrase:
                    labels.add(t.label)
                    score = max(score, sum(0 <= a + j - t.key < len(w) and w[a + j - t.key] == x for j, x in enumerate(t.words)) / len(t.words))
        assert got[i][5] == ",".join(sorted(labels)) and abs(got[i][6] - score) < 1e-12


def test_licence_index_holds_the_rarest_words_of_each_phrase():
    templates = licences.BASE + licences.OTHERS
    vocabulary = sorted({w for t in templates for w in t.phrase})
    weights = {w: 1.0 / (1 + k % 17) for k, w in enumerate(vocabulary)}
    postings, needs = licences.index(templates, weights, 2)
    assert min(needs) >= 2 and len(postings) < len(vocabulary)
    for k, t in enumerate(templates):
        assert all(k * licences.SPAN - t.phrase.index(w) in postings[w] for w in sorted(t.phrase, key=lambda w: -weights[w])[:2])


def test_mixing(docs, rows, empty, odd):
    size = {i: len(words(t)) for i, t, *_ in rows}
    by = defaultdict(int)
    for i, _, _, s, _ in rows:
        by[s] += size[i]
    order = sorted((s for s in by if s is not None)) + [None]
    weight = {s: [1, 2, 3][k % 3] for k, s in enumerate(order)}
    total, clamped = sum(by.values()), set()
    while True:
        level = (total - sum(3 * by[s] for s in clamped)) / sum(weight[s] for s in by if s not in clamped)
        more = {s for s in by if s not in clamped and level * weight[s] > 3 * by[s]}
        if not more:
            break
        clamped |= more
    out = mixing.mix(docs)
    got, again = plain(out), plain(mixing.mix(docs.repartition(3)))
    assert got == again
    taken = defaultdict(int)
    for i, _, _, s, _ in rows:
        want = 3.0 * by[s] if s in clamped else level * weight[s]
        assert got[i][0] == size[i] and got[i][1] == by[s] and abs(got[i][2] - want) < 1e-6 and 0 <= got[i][3] <= 3 * size[i]
        taken[s] += got[i][3]
    assert all(abs(taken[s] - (3 * by[s] if s in clamped else level * weight[s])) <= 1 for s in by)
    assert mixing.mix(empty).count() == 0 and mixing.mix(odd).count() == 5


def test_mixing_clamps(spark):
    d = spark.createDataFrame([(i, "w " * (400 if s == "a" else 2), s) for i, s in enumerate(["a"] * 20 + ["b"] * 5 + ["c"] * 5)], "doc_id long, text string, source string")
    got = {r["source_size"]: r["target"] for r in mixing.mix(d).collect()}
    assert got[10] == 30.0 and abs(got[8000] - (8020 - 60)) < 1e-6


def test_decontamination(spark, docs, rows, empty, odd):
    source = [t for _, t, *_ in rows if len(words(t)) > 30]
    items = [("a", " ".join(words(source[0])[5:25])), ("b", " ".join(words(source[3])[:10]).upper()), ("c", "w1"), ("d", "nothing like it in any of these texts at all I hope"), ("e", None), ("f", ""), ("g", "Straße of"), (None, "w2")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = plain(decontamination.decontaminate(docs, bench))
    hit_docs = 0
    for i, t, *_ in rows:
        w, hit, who = ALNUM.findall(low(t)), set(), set()
        for item, it in items:
            iw = ALNUM.findall(low(it))
            if item is None or not iw:
                continue
            n = min(10, len(iw))
            wins = {tuple(iw[k : k + n]) for k in range(len(iw) - n + 1)}
            for a in range(len(w) - n + 1):
                if tuple(w[a : a + n]) in wins:
                    hit |= set(range(a, a + n))
                    who.add(item)
        hit_docs += bool(hit)
        assert got[i] == (len(w), len(hit), len(who), sha(",".join(sorted(who))), bool(hit))
    assert hit_docs > 3
    assert decontamination.decontaminate(empty, bench).count() == 0
    assert decontamination.decontaminate(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontamination.decontaminate(odd, bench).count() == 3  # one row for each doc_id


def test_decontamination_in_blocks(docs, spark, monkeypatch, rows):
    bench = spark.createDataFrame([(k, " ".join(words(t)[:14])) for k, t, *_ in rows if len(words(t)) > 20][:20], "item_id long, text string")
    want = plain(decontamination.decontaminate(docs, bench))
    monkeypatch.setattr(decontamination, "BLOCK_WINDOWS", 10)
    assert plain(decontamination.decontaminate(docs, bench)) == want


def test_lines(docs, rows, empty, odd):
    run, first = 3, {}
    kept_lines = lambda t: [(k, x) for k, x in enumerate((t or "").split("\n")) if WORD.search(x)]
    for i, t, *_ in sorted(rows, key=lambda r: r[0]):
        ls = kept_lines(t)
        for a in range(len(ls) - run + 1):
            first.setdefault(tuple(x for _, x in ls[a : a + run]), (i, a))
    got, removed = plain(lines.deduplicate(docs)), 0
    for i, t, *_ in rows:
        ls, gone = kept_lines(t), set()
        for a in range(len(ls) - run + 1):
            if first[tuple(x for _, x in ls[a : a + run])] != (i, a):
                gone |= {k for k, _ in ls[a : a + run]}
        text = "\n".join(x for k, x in enumerate((t or "").split("\n")) if k not in gone)
        removed += len(gone)
        assert got[i] == (len(ls), len(gone), sha(text), text)
    assert removed > 20
    assert lines.deduplicate(empty).count() == 0 and lines.deduplicate(odd).count() == 5


def test_lines_long_and_whole(spark):
    """Single lines of many words, and documents of one or two lines, as runs; without the options none of them goes."""
    long, two = " ".join(f"p{i}" for i in range(60)), "first short line\nsecond short line"
    texts = [long, "intro\n" + long + "\nend", two, two, "only one", "only one", "first short line", long + "\n" + long, "a\nb\nc", "x\na\nb\nc", None, ""]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_removed"], r["kept_text"]) for r in lines.deduplicate(d, long_words=50, whole=True).collect()}
    assert got == {0: (0, long), 1: (1, "intro\nend"), 2: (0, two), 3: (2, ""), 4: (0, "only one"), 5: (1, ""), 6: (0, "first short line"), 7: (2, ""), 8: (0, "a\nb\nc"), 9: (3, "x"), 10: (0, ""), 11: (0, "")}
    assert {r["doc_id"]: r["n_removed"] for r in lines.deduplicate(d).collect()} == {i: 3 if i == 9 else 0 for i in range(12)}


def test_lines_put_out_fingerprints_alone(spark):
    """Fewer than all windows leave the texts; a run around a fingerprint is found from it on both sides."""
    r = random.Random(3)
    t = [f"line {r.random()}" for _ in range(300)]
    docs = spark.createDataFrame([(1, "\n".join(t)), (2, "\n".join(["own"] * 1 + t[100:160] + ["other"]))], "doc_id long, text string")
    hashed = docs.select("doc_id", F.transform(F.split("text", "\n"), lambda x: F.xxhash64(x)).alias("h"))
    assert lines.fingerprints(hashed, 3).count() < 0.65 * (300 + 62)
    got = {x["doc_id"]: x["kept_text"] for x in lines.deduplicate(docs).collect()}
    assert got[2] == "own\nother" and got[1] == "\n".join(t)


def shingles(t, k=5):
    w = words(low(t))
    return frozenset(tuple(w[a : a + k]) for a in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    sets = {i: shingles(t) for i, t in rows}
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for a, i in enumerate(ids):
        for j in ids[a + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                x, y = top(i), top(j)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i)) for i in ids}


def chain(seed=5, n=40):
    """Near copies that drift: neighbours link, distant ones do not; and pairs just at, and just under, the threshold."""
    r = random.Random(seed)
    w = [f"c{r.randrange(10**6)}" for _ in range(80)]
    out = []
    for k in range(n):
        w[r.randrange(80)] = f"d{k}"
        out.append(" ".join(w))
    for drop in range(10, 24):
        base = [f"e{drop}_{k}" for k in range(100)]
        out += [" ".join(base), " ".join(base[: 100 - drop])]
    return out


@pytest.mark.parametrize(("tiny", "small"), [(8, 4096), (2, 3)])
def test_jaccard(spark, docs, rows, empty, odd, monkeypatch, tiny, small):
    monkeypatch.setattr(jaccard, "TINY", tiny)
    monkeypatch.setattr(jaccard, "SMALL", small)
    more = [(10_000 + k, t, None, None, 0) for k, t in enumerate(chain())]
    both = docs.unionByName(spark.createDataFrame(more, SCHEMA))
    want = brute_components([(i, t) for i, t, *_ in rows + more])
    assert plain(jaccard.cluster(both)) == want
    assert len({c for _, c in want.values()}) < len(want) - 30
    if tiny == 8:
        assert jaccard.cluster(empty).count() == 0
        out = jaccard.cluster(odd).collect()
        assert len(out) == 5 and [r["component_id"] for r in out if r["doc_id"] == 7] == [7]


def test_parity_never_exceeds_the_difference():
    rng = np.random.default_rng(2)
    for _ in range(50):
        a, b = (np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in rng.integers(1, 900, 2))
        b = np.unique(np.concatenate([b, a[: len(a) // 2]]))
        bits = [jaccard.parity_bits(x, np.array([0, len(x)]))[0] for x in (a, b)]
        assert jaccard.folded_difference(*bits) <= len(np.setxor1d(a, b))


def test_components_of_a_path(spark):
    n = 60
    links = spark.createDataFrame([(k, k + 1) for k in range(0, n, 1) if k % 20 != 19], "a long, b long")
    got = {r["node"]: r["label"] for r in graph.components(links).collect()}
    assert got == {k: k // 20 * 20 for k in range(n + 1) if k in got} and len(got) >= n


def base_quality(t):
    w = words(t)
    grams = Counter(tuple(w[a : a + 3]) for a in range(len(w) - 2))
    covered = {a + d for a in range(len(w) - 2) if grams[tuple(w[a : a + 3])] > 1 for d in range(3)}
    ls = [x for x in (t or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(ls) - len(set(ls)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)


def test_quality_base(docs, rows, empty, odd):
    got = plain(quality.judge(docs))
    for i, t, *_ in rows:
        assert got[i][:6] == base_quality(t)
        assert not (got[i][5] and got[i][6])
    assert quality.judge(empty).count() == 0 and quality.judge(odd).count() == 5


FLOOR2 = np.diag(np.array(quality.FLOORS) ** 2)


def step_of(x, m, cov, share=quality.SHARE):
    """A C-step with numpy: mean and covariance (floors added) of the nearest share, by counted bins of distance."""
    d = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(cov), x - m)
    b = np.floor(np.log(d + 1) * quality.BINS)
    near = x[b <= sorted(b)[math.ceil(share * len(b)) - 1]]
    return near.mean(0), np.cov(near.T, bias=True) + FLOOR2


def first_fits(x):
    """Medians and quartile ranges, with no correlation, that of spatial signs, and that of hyperbolic tangents."""
    of = lambda v, s: sorted(v)[math.ceil(s * len(v)) - 1]
    low_ = np.floor(np.round(x * quality.UNIT) / 1000) / 1000
    m = np.array([of(c, 0.5) for c in low_.T])
    s = np.maximum([(of(c, 0.75) - of(c, 0.25)) / 1.349 for c in low_.T], quality.FLOORS)
    z = (x - m) / s
    far = np.sqrt((z**2).sum(1))
    yield m, np.diag(s**2) + FLOOR2
    for v in (z / np.where(far > 0, far, 1)[:, None], np.tanh(z)):
        p = np.round(v[:, :, None] * v[:, None, :] * 1e6).sum(0)
        scale = np.sqrt(np.outer(np.diag(p), np.diag(p)))
        alike = 0.95 * np.divide(p, scale, out=np.zeros_like(p), where=scale > 0)
        np.fill_diagonal(alike, 1)
        yield m, alike * np.outer(s, s) + FLOOR2


def brute_fit(x):
    fits = []
    for m, cov in first_fits(x):
        for share in (0.5, quality.SHARE, quality.SHARE):
            m, cov = step_of(x, m, cov, share)
        fits.append((np.linalg.slogdet(cov)[1], m, cov))
    best = min(fits, key=lambda f: round(f[0], 9))
    while True:
        m, cov = step_of(x, *best[1:])
        if np.linalg.slogdet(cov)[1] >= best[0] - quality.GAIN:
            return best
        best = (np.linalg.slogdet(cov)[1], m, cov)


def brute_mcd(vectors, groups):
    """The same estimator with numpy, its distances scaled by their median."""
    out = {}
    for ids in groups.values():
        x = np.array([vectors[i] for i in ids])
        _, m, cov = brute_fit(x)
        d = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(cov), x - m)
        middle = sorted(np.floor(np.log(d + 1) * quality.BINS))[math.ceil(0.5 * len(d)) - 1]
        out |= dict(zip(ids, d / max(1.0, (math.exp((middle + 1) / quality.BINS) - 1) / quality.CHI2_MEDIAN), strict=True))
    return out


def test_covariance_has_the_least_determinant(spark):
    """On a table whose quartiles mislead (two crossed clouds), the fit is no worse than the best of 200 random starts of two C-steps."""
    rng = np.random.default_rng(11)
    clouds = {}
    for g, share in (("even", 0.0), ("crossed", 0.22)):
        x = rng.multivariate_normal([1.8, 0.3, 0.3, 0.4], np.array([[4, 3.6, 0, 0], [3.6, 4, 0, 0], [0, 0, 1, 0.8], [0, 0, 0.8, 1]]) / 10, 400)
        k = int(share * len(x))
        x[:k] = rng.multivariate_normal([2.6, -0.9, 0.9, -0.4], np.eye(4) / 200, k)
        clouds[g] = np.round(x * quality.UNIT) / quality.UNIT
    rows = [(g, *(int(round(v * quality.UNIT)) for v in r)) for g, x in clouds.items() for r in x.tolist()]
    got = {r["g"]: r for r in quality.estimate(spark.createDataFrame(rows, "g string, x0 long, x1 long, x2 long, x3 long")).collect()}
    for g, x in clouds.items():
        dets = []
        for _ in range(200):
            some = x[rng.choice(len(x), 5, replace=False)]
            m, cov = some.mean(0), np.cov(some.T, bias=True) + FLOOR2
            for _ in range(2):
                m, cov = step_of(x, m, cov)
            dets.append(np.linalg.slogdet(cov)[1])
        assert abs(got[g]["logdet"] - brute_fit(x)[0]) < 1e-6
        assert got[g]["logdet"] <= min(dets) + 0.02
        one = next(iter(first_fits(x)))
        assert got[g]["logdet"] <= np.linalg.slogdet(step_of(x, *one)[1])[1] + 1e-9


def test_quality_outliers(spark):
    r = random.Random(4)
    text = lambda: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(3, 8))) for _ in range(80))
    rows = [(k, text(), "en", "a" if k % 3 else "b") for k in range(360)]
    rows += [(1000 + k, " ".join(w + "$$$%%%" for w in text().split()), "en", "a") for k in range(6)]
    rows += [(2000 + k, "\n".join(["the very same line of text here"] + [text()[:40] for _ in range(3)]) * 3, "de", None) for k in range(3)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {x["doc_id"]: x for x in quality.judge(d).collect()}
    assert not any(got[1000 + k]["kept"] for k in range(6)) and all(got[k]["kept"] for k in range(360))
    vectors, groups = {}, defaultdict(list)
    for i, t, lang, source in rows:
        n, chars, sym, dup, rep, bad = base_quality(t)
        ls = [x for x in t.split("\n") if WORD.search(x)]
        vectors[i] = [math.log(chars / n + 1), math.sqrt(sym / chars), math.sqrt(dup / len(ls)), math.sqrt(rep / n)]
        if not bad and lang == "en":
            groups[(lang, source)].append(i)
    for i, v in brute_mcd(vectors, groups).items():
        assert abs(got[i]["distance2"] - v) <= 1e-3 * max(1, v)


def test_quality_rejects_repeats_alone(spark):
    """Texts within the base rules whose only fault is 50 % repeated words, or 40 % repeated lines, go."""
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(3, 8)))
    rows = [(k, " ".join(word() for _ in range(80))) for k in range(200)]
    for k in range(4):
        w = [word() for _ in range(80)]
        rows.append((1000 + k, " ".join(w[:60] + w[:20])))
        rows.append((2000 + k, "\n".join([" ".join(w[:36]), " ".join(w[36:])] + [x for x in w[:2] for _ in range(3)] + w[2:4])))
    got = {x["doc_id"]: x for x in quality.judge(spark.createDataFrame([(i, t, "en", "a") for i, t in rows], "doc_id long, text string, lang string, source string")).collect()}
    assert math.isclose(math.exp(-quality.CUT / 2) * (1 + quality.CUT / 2), 0.001, rel_tol=1e-6)  # the tail of chi-squared with 4 degrees of freedom
    assert all(got[k]["kept"] for k in range(200))
    for k in range(4):
        assert got[1000 + k]["n_repeat_words"] == 40 and not got[1000 + k]["base_failed"] and not got[1000 + k]["kept"]
        assert got[2000 + k]["n_dup_lines"] == 4 and not got[2000 + k]["base_failed"] and not got[2000 + k]["kept"]


def test_scoring(docs, rows, empty, odd):
    got = plain(scoring.score(docs))
    texts = {i: words(low(t)) + [None] for i, t, *_ in rows}
    counts = Counter()
    for i, w in texts.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update(w)
    n, v = sum(counts.values()), len(counts)
    for i, w in texts.items():
        assert got[i][:4] == (zlib.crc32(str(i).encode()) % 7 == 2, len(w), sum(counts[x] > 0 for x in w), n)
        assert abs(got[i][4] - sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w)) < 1e-6 * len(w)
        assert got[i][5] < 0
    assert scoring.score(empty).count() == 0 and scoring.score(odd).count() == 3


def plain_score(known, text, keys):
    """log10 of a text's probability, token by token, from the fitted parts; keys maps words to their hash."""
    top, m = known.top, known.model
    place = {int(h): i for i, h in enumerate(top.hash)}
    ending = lambda w: int((kernels.mix(np.array([sum(x * 256**k for k, x in enumerate(w.encode()[-3:]))], np.uint64), 3) % np.uint64(scoring.TAILS))[0])
    before, total = [top.stop] * lbl.CONTEXT, 0.0
    for w in [*words(low(text)), None]:
        i = place.get(keys[w], -1) if w is not None else -1
        cls = scoring.END_CLASS if w is None else i if 0 <= i < scoring.HEAD else scoring.HEAD + ending(w)
        h = sum(m.r[x].astype(float) @ m.c[k].astype(float) for k, x in enumerate(before))
        s = np.array([q.astype(float) @ h + b for q, b in zip(m.q, m.b.astype(float), strict=True)])
        p = np.exp(s - s.max()) / np.exp(s - s.max()).sum()
        total += math.log10(0.999 * p[cls] + 0.001 * m.own[cls])
        if w is not None and cls >= scoring.HEAD:
            total += math.log10(known_counts.get(keys[w], 0) + 1) - known.log_mass[cls - scoring.HEAD]
        before = [top.stop if w is None else i if 0 <= i < top.n_inputs else top.n_inputs + ending(w), *before[:-1]]
    return total


known_counts = {}


def test_score_is_the_models(spark, monkeypatch):
    """The score column against a plain scorer; with enough words that classes of endings, shared inputs and rare words take part."""
    import pyarrow as pa

    r = random.Random(9)
    text = lambda: " ".join(f"w{r.randrange(r.choice([20, 600, 40_000])):x}" for _ in range(300))
    rows = [(i, text()) for i in range(150)] + [(150, None), (151, ""), (152, "Straße W1 w1"), (153, "never seen before")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    known = scoring.fit(scoring.keyed_texts(docs, "doc_id", "text"))
    assert len(known.top.hash) > scoring.INPUTS
    known_counts.update({r["h"] % 2**64: r["n"] for r in known.counts.collect()})
    texts = [t or "" for _, t in rows]
    keys = {}
    for part, data, offsets in kernels.text_blocks(pa.array(texts)):
        w = kernels.words(data, offsets, True)
        raw = w.data.tobytes()
        keys |= {raw[a:b].decode(): int(h) for a, b, h in zip(w.start, w.end, w.hash, strict=True)}
    monkeypatch.setattr(scoring, "fit", lambda *_: known)
    got = {r["doc_id"]: r["score"] for r in scoring.score(docs).collect()}
    for i, t in rows[-8:]:
        assert abs(got[i] - plain_score(known, t, keys)) < 1e-4 * (len(words(t)) + 1)


def test_model_is_a_distribution_and_uses_each_place_of_its_context():
    """Sequences in which the token three places back decides: a model of the last token alone cannot tell."""
    rng = np.random.default_rng(1)
    n, stop = 60, 60
    ids = []
    for _ in range(600):
        t = rng.integers(0, n, 3).tolist()
        for _ in range(40):
            t.append((t[-3] * 7 + 1) % n if rng.random() < 0.9 else int(rng.integers(0, n)))
        ids += [*t, stop]
    ids = np.array(ids, np.int16)
    class_of = np.arange(n + 1)
    start = lbl.initial(n + 1, np.bincount(ids, minlength=n + 1))
    m, seen, hit = lbl.train_unit(start, ids[:-4300], class_of, stop)
    held = ids[-4300:]
    x = m.hidden(lbl.contexts(held, 0, len(held), stop)) @ m.q.T + m.b
    p = np.exp(x - x.max(1, keepdims=True))
    log_p = np.log10(0.999 * p / p.sum(1, keepdims=True) + 0.001 * m.own)
    assert np.allclose((10**log_p).sum(1), 1, atol=1e-5)
    assert np.allclose(log_p[np.arange(len(held)), held], lbl.log10_probabilities(m, held, class_of, stop), atol=1e-5)
    own = np.log10(start.own)[held].mean()
    assert lbl.log10_probabilities(m, held, class_of, stop).mean() > own + 0.3
    one = lbl.averaged(start, lbl.weighed(m, seen, hit) + lbl.weighed(m, seen, hit))
    assert np.allclose(one.q[hit > 0], m.q[hit > 0], atol=1e-5) and np.allclose(one.c, m.c, atol=1e-5) and np.allclose(one.r[seen == 0], start.r[seen == 0])


def test_contexts_stop_at_the_end_of_a_text():
    ids = np.array([5, 6, 9, 7, 9, 9], np.int16)
    want = [[9, 9, 9], [5, 9, 9], [6, 5, 9], [9, 9, 9], [7, 9, 9], [9, 9, 9]]
    assert lbl.contexts(ids, 0, 6, 9).tolist() == want
    assert np.concatenate([lbl.contexts(ids, a, min(6, a + 2), 9) for a in range(0, 6, 2)]).tolist() == want


def test_held_out_texts_are_likelier_under_the_model(spark):
    r = random.Random(6)
    rows = []
    for i in range(400):
        w = "ab" if i % 2 else "xy"
        rows.append((i, " ".join(w + str(r.randrange(30)) for _ in range(60))))
    out = scoring.score(spark.createDataFrame(rows, "doc_id long, text string")).where("held_out").agg(F.sum("base_score"), F.sum("score")).first()
    assert out[1] > out[0] * 0.9  # two halves that never mix: knowing the words before saves about a bit a word


def test_kernels_split_like_the_pattern(rows):
    import pyarrow as pa

    texts = [t for _, t, *_ in rows]
    for part, data, offsets in kernels.text_blocks(pa.array(texts).slice(2)):
        w = kernels.words(data, offsets, True)
        raw, k = data.tobytes(), 0
        for t in texts[2:][part]:
            for x in words(t):
                assert raw[w.start[k] : w.end[k]].decode() == x
                k += 1
        assert k == len(w.hash)
        seen = {}
        for a, b, h in zip(w.start, w.end, w.hash.tolist(), strict=True):
            assert seen.setdefault(low(raw[a:b].decode()), h) == h
        assert len(set(seen.values())) == len(seen)
