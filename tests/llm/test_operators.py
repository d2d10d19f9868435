"""The ten operators against brute force, and on nulls, empty and long texts, repeated rows, empty tables."""

import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ohmgrid.llm import bpe, decontamination, jaccard_join, language_id, packing, pii, quality_classifier, quality_rules, sharding, url_filters
from ohmgrid.llm.common import scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [
    None, "", " \n\t ", "one", "two words", "x" * 5000, "a b c d", "A B C D", "<|endoftext|>mid<|endoftext|>  twice", "tab\tand\r\nline\n\n  end ",
    "naïve façade —   wide space", "it's they'll 123 4.5.6 😀😀 日本語", "word " * 3000, "'s 't  'x", "\x1c\x1d sep \x85 nel",
]


def table(spark, texts, **extra):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({k: F.lit(v) for k, v in extra.items()})


# -- 7 ----------------------------------------------------------------------------


def test_counts_equal_the_library(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rng = random.Random(1)
    alphabet = "ab c'sdé \n\t 日1.<|>endoftext_😀 \x1c"
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(600)]
    got = {r.doc_id: r for r in bpe.token_counts(table(spark, texts, n_tokens="clash"), path).collect()}
    for i, t in enumerate(texts):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((t or "").encode()), n > 512), repr(t)
    assert bpe.token_counts(table(spark, texts).limit(0), path).count() == 0


def test_long_pretoken_is_not_quadratic():
    c = bpe.counter(public_tokenizers.path("byte_bpe_50k.json"))
    text = "thering" * 40_000
    assert c.count(text) == len(Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(text).ids)


# -- 10 ---------------------------------------------------------------------------


def check_packing(rows, most=2048):
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= most
    return len(bins)


def test_packing_round_trip(spark):
    rng = random.Random(2)
    texts = ODD + ["lorem ipsum dolor " * rng.randint(1, 1500) for _ in range(60)] + ["same text here"] * 40
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    parts = packing.pieces(table(spark, texts, offset="clash").select("doc_id", "text"), **packing.vocabulary())
    rows = packing.best_fit(parts).collect()
    total = 0
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    for i, t in enumerate(texts):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        mine = sorted(by[i], key=lambda r: r.piece)
        assert [r.piece for r in mine] == list(range(len(mine))) and all(r.length == 2048 for r in mine[1:])
        assert sum(r.length for r in mine) == len(ids)
        for r in mine:
            assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
        total += len(ids)
    assert check_packing(rows) <= -(-total // 2048) * 1.02 + 1
    assert packing.best_fit(parts.limit(0)).count() == 0


@pytest.mark.parametrize("measure", ["dot", "norm"])
def test_packing_respects_every_capacity(measure):
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 300, 2000)
    sizes, counts = np.unique(lengths, return_counts=True)
    cap = packing.Capacity(300, 4, 100_000)
    plan = packing.pack(sizes, counts, cap, measure)
    bins = {}
    for n, c in zip(sizes, counts, strict=True):
        b, o = plan.place(np.full(c, n), np.arange(c))
        for x, y in zip(b, o, strict=True):
            bins.setdefault(int(x), []).append((int(y), int(n)))
    assert len(bins) == plan.bins
    for places in bins.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= 300 and len(places) <= 4 and sum(n * n for _, n in places) <= 100_000
    with pytest.raises(ValueError):
        packing.pack(np.array([301]), np.array([1]), cap)


# -- 2 ----------------------------------------------------------------------------


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w)} - {()} if len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}


def brute(texts):
    sets = [shingles(t) for t in texts]
    comp, links = list(range(len(texts))), [0] * len(texts)

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                comp[max(x, y)] = min(x, y)
                links[a] += 1
                links[b] += 1
    return [(len(s), find(i), links[i]) for i, s in enumerate(sets)]


def corpus(seed, n=160):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(300)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    bases = [[rng.choice(vocabulary) for _ in range(rng.choice([6, 12, 40, 150, 400]))] for _ in range(25)]
    texts = []
    for _ in range(n):
        w = list(rng.choice(bases[:3] if rng.random() < 0.5 else bases))
        for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        if rng.random() < 0.4:
            w = w[: len(w) // 2] + passage + w[len(w) // 2 :]
        texts.append(" ".join(w) if rng.random() < 0.8 else " \n".join(w).upper())
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_components(spark, seed, monkeypatch):
    if seed == 2:  # many blocks in a component
        monkeypatch.setattr(jaccard_join, "BLOCK_SETS", 3)
    texts = corpus(seed) + ODD
    found, links = jaccard_join.join_components(table(spark, texts, n=1, comp="clash").repartition(5))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in found.collect()}
    want = brute(texts)
    assert [got[i] for i in range(len(texts))] == want
    sets = [shingles(t) for t in texts]
    for r in links.collect():
        assert r.overlap == len(sets[r.a] & sets[r.b]) and r.na == len(sets[r.a]) and r.nb == len(sets[r.b])


def test_plans_of_links_and_components_stay_small(spark, monkeypatch):
    """The driver holds some megabytes for each stage of a plan at once: few stages a plan, all components right."""
    rng, written, plans = random.Random(3), jaccard_join.written, {}

    def seen(df, name):
        plan = df._jdf.queryExecution().executedPlan().toString()
        plans[name] = max(plans.get(name, 0), len(re.findall(r"\bExchange |BroadcastExchange", plan)))
        return written(df, name)

    monkeypatch.setattr(jaccard_join, "written", seen)
    # chains, cycles, a star, both directions, repeats, and a link of a node with itself
    pairs = [(i, i + 1) for i in range(0, 40)] + [(60, i) for i in range(61, 90)] + [(rng.randint(100, 160), rng.randint(100, 160)) for _ in range(40)] + [(61, 60), (5, 4), (5, 4), (200, 200), (-3, 90)]
    got = {r.node: r.comp for r in jaccard_join.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    least = {x: x for p in pairs if p[0] != p[1] for x in p}
    for _ in least:
        for a, b in pairs:
            if a != b:
                least[a] = least[b] = min(least[a], least[b])
    assert got == least
    docs = spark.createDataFrame([(i, f"a b c d e f g h {i % 3}") for i in range(9)], "doc_id long, text string")
    met = jaccard_join.verify(spark.createDataFrame([(3, 1), (4, 1), (3, 1), (5, 2)], "a long, b long"), docs, 5, True)
    assert sorted(map(tuple, met.collect())) == [(3, 1, 5, 5, 4), (4, 1, 5, 5, 5), (5, 2, 5, 5, 5)]
    assert plans["edges"] <= 5 and plans["edges-large"] <= 5 and plans["verified"] <= 5, plans


def test_jaccard_odd_rows(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "A B C D E F"), (None, "a b c d e f"), (3, None), (4, "x y"), (4, "q r s"), (5, "q r s")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.component_id, r.n_links) for r in jaccard_join.join_components(df)[0].collect())
    assert got == [(-1, None, None), (1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 3, 0), (4, 4, 1), (4, 4, 1), (5, 4, 1)]
    assert jaccard_join.join_components(df.limit(0))[0].count() == 0
    kept = sorted((r.doc_id if r.doc_id is not None else -1, r.text) for r in jaccard_join.keep_one(df.withColumn("rep", F.lit(1))).select("doc_id", "text").fillna("").collect())
    assert kept == [(-1, "a b c d e f"), (1, "a b c d e f"), (3, ""), (4, "q r s")]


@pytest.mark.parametrize("same", [True, False])
def test_links_from_differences(same):
    rng = np.random.default_rng(8)
    hub = np.arange(100, dtype=np.uint64)
    def some():
        return [set(rng.choice(hub, rng.integers(60, 101), replace=False).tolist()) | set(rng.integers(200, 240, rng.integers(0, 20)).tolist()) for _ in range(40)]
    a = some()
    b = a if same else some()
    sides = [[np.array(sorted(s ^ set(hub.tolist())), np.uint64) for s in side] for side in (a, b)]
    lost = [[len(set(hub.tolist()) - s) for s in side] for side in (a, b)]
    weight = [rng.integers(1, 5, 40) for _ in range(2)] if not same else [np.arange(1, 41)] * 2
    x, y = jaccard_join.block_links(tuple([len(s) for s in side] for side in (a, b)), tuple(lost), tuple(sides), tuple(weight), 100, 80, same)
    link = np.array([[100 * len(p & q) >= 80 * len(p | q) and not (same and i == j) for j, q in enumerate(b)] for i, p in enumerate(a)])
    assert x.tolist() == (link @ weight[1]).tolist() and y.tolist() == (weight[0] @ link).tolist() and link.any()


def test_long_text_is_cut_between_words():
    words = [f"w{k}" for k in range(400_000)]
    h, n = jaccard_join.word_hashes([" ".join(words).encode(), b"w7 W7"])
    assert n.tolist() == [400_000, 2] and h[7] == h[-1] == h[-2] and len(np.unique(h)) == 400_000


# -- 9 ----------------------------------------------------------------------------


def plain_stats(t):
    t = t or ""
    w = WORD.findall(t)
    c = Counter(zip(w, w[1:], w[2:], strict=False))
    hit = {k for i in range(len(w) - 2) if c[w[i], w[i + 1], w[i + 2]] > 1 for k in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), dup, len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)


def test_rule_statistics(spark):
    rng = random.Random(4)
    texts = ODD + ["".join(rng.choice("ab \n\t#|") for _ in range(rng.randint(0, 300))) for _ in range(150)]
    df = table(spark, texts, z0=1, kept="clash", n_lines=0).withColumn("lang", F.when(F.col("doc_id") % 3 > 0, F.col("lang")))
    got = {r.doc_id: r for r in quality_rules.quality_rules(df).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain_stats(t), repr(t)
    assert quality_rules.quality_rules(df.limit(0)).count() == 0


def test_outliers_go_and_clean_stay(spark):
    rng = random.Random(5)
    words = ["the", "river", "stone", "walks", "quiet", "morning", "under", "seven", "lanterns", "and", "of", "market"]
    clean = [" ".join(rng.choice(words) + str(rng.randint(0, 99)) for _ in range(rng.randint(60, 400))) for _ in range(400)]
    junk = [" ".join(rng.choice(words) + str(k) + "%%%$$$" for k in range(200)) for _ in range(20)]
    df = table(spark, clean + junk, n=1, z1="x")
    kept = {r.doc_id for r in quality_rules.keep_good(df).collect()}
    assert kept == set(range(400)) and quality_rules.keep_good(df).columns == df.columns
    single = quality_rules.quality_rules(df.where("doc_id < 5")).collect()
    assert all(r.kept != r.base_failed for r in single)
    alone = df.where("doc_id < 60 or doc_id = 401").withColumn("source", F.when(F.col("doc_id") == 401, "only here").otherwise("s"))
    assert {r.doc_id for r in quality_rules.keep_good(alone).collect()} == set(range(60))  # judged by its language


def plain_mcd(Z, support=0.75):
    """Location, scatter and determinant of the best of four starts, by plain loops over all rows."""
    p, floor, scale = 4, np.array(quality_rules.FLOOR), quality_rules.SCALE
    med, spread = np.median(Z, axis=0), (np.quantile(Z, 0.75, axis=0) - np.quantile(Z, 0.25, axis=0)) / 1.349
    s = np.sqrt(spread**2 + floor**2)
    Y = (Z - med) / s
    length = np.sqrt((Y**2).sum(axis=1, keepdims=True))
    t = np.round(np.tanh(Y) * scale) / scale
    u = np.round(np.divide(Y, length, out=np.zeros_like(Y), where=length > 0) * scale) / scale
    cov = lambda x: x.T @ x / len(x) - np.outer(x.mean(axis=0), x.mean(axis=0))
    extra = np.diag(floor**2)
    narrow = support / quality_rules.chi2_cdf(quality_rules.chi2_quantile(support, p), p + 2)
    found = [(med, np.diag(spread**2)), (Z.mean(axis=0), cov(Z)), (med, np.outer(s, s) * cov(t)), (med, np.outer(s, s) * (u.T @ u) / len(u) * p)]
    found = [(m, c + extra) for m, c in found]
    for k, (m, c) in enumerate(found):
        for step in range(quality_rules.MOST_STEPS):
            b = np.minimum(np.floor(np.einsum("ij,jk,ik->i", Z - m, np.linalg.inv(c), Z - m) * quality_rules.BIN), quality_rules.LAST)
            near = Z[b <= np.ceil(np.quantile(b, support))]
            new = cov(near) * narrow + extra
            if step and np.linalg.slogdet(new)[1] >= np.linalg.slogdet(c)[1] - quality_rules.STILL:
                break
            m, c = near.mean(axis=0), new
        found[k] = m, c
    best = min(found, key=lambda x: np.linalg.slogdet(x[1])[1])
    return len(Z), *best


def test_verdicts_equal_plain_estimates(spark):
    rng = random.Random(15)
    words = ["the", "river", "stone", "walks", "quiet", "morning", "under", "seven", "lanterns", "and", "of", "market"]
    rows = []
    for i in range(700):
        odd = rng.random()
        t = [rng.choice(words) + (str(rng.randint(0, 99)) if rng.random() < 0.9 else "") for _ in range(rng.randint(40, 200))]
        t = [w + "|#%" * rng.randint(0, 3) if odd < 0.08 else w for w in t]
        t = t + ["\n" + " ".join(t[:20])] * 3 if odd > 0.95 else t
        rows.append((i, " ".join(t), rng.choice(["en", "en", "de", None]), rng.choice(["a", "a", "a", "b", None, f"x{i}"]), 0))
    df = spark.createDataFrame(rows, DOCS)
    stats = quality_rules.vectors(quality_rules.statistics(df))
    table_ = {r.doc_id: r for r in stats.collect()}
    good = [r for r in table_.values() if not r.base_failed]
    z = {r.doc_id: np.array([r.z0, r.z1, r.z2, r.z3]) / quality_rules.SCALE for r in good}
    keys = {r.doc_id: [(r.lang, r.source), r.lang, "all"] for r in good}
    made = {}
    for level in range(3):
        by = {}
        for i, k in keys.items():
            by.setdefault(k[level], []).append(i)
        made[level] = {k: plain_mcd(np.array([z[i] for i in ids])) for k, ids in by.items()}
    got = {r.doc_id: r for r in quality_rules.quality_rules(df.repartition(3)).collect()}
    near = 0
    for i, k in keys.items():
        _, m, c = made[2]["all"]
        for level in (1, 0):
            n, m1, c1 = made[level][k[level]]
            m, c = (n * m1 + 20 * m) / (n + 20), (n * c1 + 20 * c) / (n + 20)
        d = (z[i] - m) @ np.linalg.inv(c) @ (z[i] - m)
        assert np.isclose(got[i].distance2, d, rtol=1e-6, atol=1e-6), (i, k)
        near += not got[i].kept
        assert got[i].kept == (d <= quality_rules.CUTOFF)
    assert 20 < near < 200


# -- 6 ----------------------------------------------------------------------------

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def plain_spans(t):
    out = []
    for k, p in PLAIN.items():
        for m in re.finditer(p, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": k != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[k]:
                out.append(f"{k}:{m.start()}:{m.end()}")
    return out


def test_base_spans(spark):
    rng = random.Random(6)
    texts = ODD + [
        "mail a.b@c-d.example.com, x@y.z..w a@b.c_d@e.f 😀 10.0.0.255 and 256.1.1.1, 1.2.3.4.5.6.7.8 01.002.3.4", "4111 1111 1111 1111 4111-1111-1111-1111x4111111111111111",
        "+1 (755) 555-9729 in +49 30 1234567890123456 +1+2 3456789", "a@" + "b." * 20_000 + "c", "1 " * 3000, "password=c1f6c02f845bf3028d token = \"391907ea4e9feb9cda83477b57ac2654884f485\"",
    ]
    texts += ["".join(rng.choice("01234 @.+-ab()é😀") for _ in range(rng.randint(0, 120))) for _ in range(300)]
    df = table(spark, texts, spans="clash")
    got = {r.doc_id: r for r in pii.find_pii(df)[0].collect()}
    for i, t in enumerate(texts):
        want = plain_spans(t)
        assert got[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), (t, want, got[i].spans)
        assert got[i].spans.split(",")[: len(want)] == (want or got[i].spans.split(",")[:0])
        assert [got[i][f"n_{k}"] for k in PLAIN] == [sum(s.startswith(k + ":") for s in want) for k in PLAIN]
    assert pii.find_pii(df.limit(0))[0].count() == 0


def test_redaction(spark):
    texts = ["write to a.b@example.com or 10.1.2.3 now", None, "nothing here", "+1 (755) 555-9729"]
    out = {r.doc_id: r for r in pii.redact(table(spark, texts, __m_email="clash")).collect()}
    assert out[0].text == "write to <EMAIL> or <IP> now" and out[1].text is None and out[2].text == texts[2] and out[3].text == "<PHONE>"
    assert out[0].n_chars == len(out[0].text) and pii.redact(table(spark, texts)).columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_em_finds_good_labelers():
    rng = np.random.default_rng(1)
    truth = rng.random(4000) < 0.3
    def vote(right):
        v = np.where(rng.random(4000) < right, truth, ~truth).astype(int)
        return np.where(rng.random(4000) < 0.2, -1, v)
    v = np.stack([vote(0.95), vote(0.9), vote(0.55), vote(0.85), vote(0.9)], axis=1)
    rows = Counter((",".join(map(str, r)), "0,0,0,0,0") for r in v.tolist())
    model = pii.estimate([(a, b, n) for (a, b), n in rows.items()])
    assert abs(model.sensitivity[0] - 0.95) < 0.04 and model.sensitivity[2] < 0.65 and abs(model.prior - 0.3) < 0.05


# -- 5 ----------------------------------------------------------------------------


def test_decontamination(spark):
    item = "if Anna buys 12 apples for 3.5 euros each and Anna sells 7 pears how much money does Anna have left today"
    other = "a completely different question about rivers and mountains that nobody would ever copy into a text anywhere"
    items = spark.createDataFrame([(1, item), (2, other), (3, None), (None, item), (4, "too short")], "item_id long, text string")
    filler = "the quiet lanterns walk under the seven stones of morning while the market sleeps " * 3
    texts = [
        filler + item + " " + filler, filler + item.upper().replace(" ", "!! ") + filler,
        filler + item.replace("Anna", "Boris").replace("12", "31").replace("3.5", "9,25") + ". " + filler,
        filler, None, "", filler + " ".join(item.split()[:6]), item.replace("Anna", "Boris", 1).replace("Anna", "Clara", 1) + filler,
    ]
    df = table(spark, texts, h="clash", item_id=9)
    got = {(r.doc_id, r.item_id): r for r in decontamination.contaminated(df, items).collect()}
    assert {k for k in got if k[1] == 1} >= {(0, 1), (2, 1)} and not {k[0] for k in got} & {3, 4, 5, 6, 7} and all(k[1] == 1 for k in got)
    assert got[0, 1].coverage == 1 and got[0, 1].n_changed == 0 and got[2, 1].n_changed >= 3
    left = {r.doc_id for r in decontamination.decontaminate(df, items).collect()}
    assert left == set(range(len(texts))) - {k[0] for k in got}
    assert decontamination.contaminated(df.limit(0), items).count() == 0 and decontamination.contaminated(df, items.limit(0)).count() == 0


def test_decontamination_of_edited_and_partial_copies(spark):
    words = "when seven grey herons cross this narrow river before dawn their keeper counts every feather left behind and writes the sum upon old walls".split()
    long_item = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}q" for i in range(600)]
    names = "after lunch Anna meets Anna while the slow train leaves for the coast with all of its empty wagons behind it"
    items = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(long_item)), (3, "ha " * 40), (4, names)], "item_id long, text string")
    filler = "the quiet lanterns walk under the seven stones of morning while the market sleeps " * 3
    middle = len(words) // 2
    texts = [
        words[:middle] + ["oddly"] + words[middle:], words[:middle] + words[middle + 1 :], words[:middle] + ["oddly"] + words[middle + 1 :],
        words[:middle], long_item[100:120], long_item[100:110], words[:8], ["ha"] * 9,
        words[:8] + [filler * 10] + words[-8:], words[:10] + [filler] * 0 + ["so", "it", "goes"] + words[10:],
        names.replace("Anna", "Boris", 1).replace("Anna", "Clara", 1).split(),
    ]
    got = {(r.doc_id, r.item_id): r for r in decontamination.contaminated(table(spark, [filler + " ".join(t) + " " + filler for t in texts]), items).collect()}
    assert set(got) == {(0, 1), (1, 1), (2, 1), (3, 1), (4, 2), (9, 1), (10, 4)}
    assert got[0, 1].coverage == 1 and got[2, 1].coverage < 1 and got[4, 2].run_words == 20 and got[10, 4].n_changed == 0


def plain_template(t):
    import regex

    t = regex.sub(r"(?<=[\p{Ll},;:] )\p{Lu}\p{Ll}+", decontamination.NAME, t)
    t = re.sub(r"[0-9]+(?:[.,:/][0-9]+)*", decontamination.NUMBER, t).lower()
    t = regex.sub(rf"(?<={decontamination.NUMBER} ?)(?:{decontamination.UNITS})(?![\p{{L}}\p{{N}}])", decontamination.UNIT, t)
    return regex.sub(rf"[^\p{{L}}\p{{N}}{decontamination.PLACES}\s]+", "", t).split()


def plain_raw(t):
    import regex

    return regex.sub(rf"[^\p{{L}}\p{{N}}{decontamination.PLACES}\s]+", "", t.lower()).split()


def plain_matches(text, item, width=8, long_run=13):
    """Whether an item is in a text: runs by plain loops over all pairs of windows, added up where they are near."""
    dt, dr, it, ir = plain_template(text), plain_raw(text), plain_template(item), plain_raw(item)
    size = min(width, len(it))
    if not size:
        return False
    hit = {(d, i) for i in range(len(it) - size + 1) for d in range(len(dt) - size + 1) if dt[d : d + size] == it[i : i + size]}
    mark = [any(c in decontamination.PLACES for c in w) for w in it]
    values = lambda d, a, b: {(ir[k], dr[d + k]) for k in range(a, b) if mark[k]}
    runs, long = [], False
    for d, i in sorted(hit):
        if (d - 1, i - 1) in hit:
            continue
        n = 1
        while (d + n, i + n) in hit:
            n += 1
        got = values(d - i, i, i + n + size - 1)
        words = n + size - 1
        fine = len({a for a, _ in got}) == len(got)
        # the longest stretch of windows without a changed value
        copied, best = [], None
        for k in range(i, i + n):
            clean = all(a == b for a, b in values(d - i, k, k + size))
            copied = [*copied, k] if clean else []
            if copied and (best is None or len(copied) > best[1] - best[0] + 1):
                best = (copied[0], copied[-1])
        held = best is not None and best[1] - best[0] + size >= long_run
        if fine:
            long |= words >= long_run and words - sum(a != b for a, b in got) >= size or held
            runs.append((d - i, i, i + n - 1, got))
        elif held:
            long = True
    if long:
        return True
    runs.sort(key=lambda r: (r[1] + r[0], r[2] + r[0] + size, r[1]))
    groups, past = [], None
    for r in runs:
        if past is None or r[1] + r[0] - past > len(it):
            groups.append([])
        groups[-1].append(r)
        past = max(past if past is not None else -1, r[2] + r[0] + size)
    for g in groups:
        words = min(len({k for _, a, b, _ in g for k in range(a, b + size)}), len({s + k for s, a, b, _ in g for k in range(a, b + size)}))
        if words >= 0.5 * len(it) and (len(it) >= decontamination.LEAST_WORDS or all(a == b for *_, got in g for a, b in got)):
            return True
    return False


@pytest.mark.parametrize("most", [200_000, 0])
def test_decontamination_equals_plain_loops(spark, monkeypatch, most):
    monkeypatch.setattr(decontamination, "MOST_BROADCAST", most)  # 0: by shuffles alone
    rng = random.Random(21)
    words = ["a", "b", "c", "12", "7 km", "so Anna", "so Boris", "x,", "7", "then"]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [line(rng.choice([1, 2, 3, 4, 6, 9, 14, 25])) for _ in range(24)] + ["3 apples cost 4 euros", "", "three 5 km"]
    texts = []
    for _ in range(90):
        w = line(rng.randint(0, 30)).split()
        for _ in range(rng.randint(0, 2)):
            part = rng.choice(items).split()
            part = part[rng.randint(0, 3) :] if rng.random() < 0.3 else part
            part = [str(rng.randint(1, 99)) if x.isdigit() and rng.random() < 0.5 else x for x in part]
            w[len(w) // 2 : len(w) // 2] = part
        texts.append(" ".join(w))
    texts += ["three 5 km", "three 6 km", "", None, "9 apples cost 8 euros"]
    items_df = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(table(spark, texts, size=1, h="x", words=2), items_df).collect()}
    want = {(d, i) for d, t in enumerate(texts) for i, x in enumerate(items) if plain_matches(t or "", x)}
    assert got == want and 50 < len(want) < len(texts) * len(items) / 2


# -- 4 ----------------------------------------------------------------------------


def plain_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def test_url_rules(spark):
    urls = [None, "", "nothing", "http://A.Example.COM/en/7?x", "http://example.com/en/6", "http://com/en/", "http://xcom/en/", "https://a.net/de/1#f", "https://www.example.net/de/88", "ftp://x.org/es/", "http://x.org?/es/", "http://h#/en/", "http://É.com/en/", "http://a.com://b/en/"]
    pages = spark.createDataFrame([(i if i != 4 else None, u, "h") for i, u in enumerate(urls)] + [(3, urls[3], "h")], "page_id long, url string, html string")
    labels = spark.createDataFrame([(0, 1, 0), (3, 0, None), (5, None, 1), (None, 0, 0)], "doc_id long, quality int, toxic int")
    rows = url_filters.url_filters(pages, labels).collect()
    assert len(rows) == len(urls) + 1
    rules = [(r.action, r.pattern) for r in url_filters.RULES]
    for r in rows:
        if r.page_id is None:
            continue
        host, path = plain_url(urls[r.page_id])
        assert (r.host, r.path) == (host, path)
        fit = [(len(p), p, a) for a, p in rules if (host == p.split("/", 1)[0] or host.endswith("." + p.split("/", 1)[0])) and path.startswith("/" + p.split("/", 1)[1])]
        assert (r.rule, r.verdict) == ((max(fit)[1], max(fit)[2]) if fit else (None, "allow"))
    assert url_filters.url_filters(pages.limit(0), labels).count() == 0 and url_filters.url_filters(pages, labels.limit(0)).count() == len(urls) + 1


def test_url_association(spark, monkeypatch):
    rng = random.Random(7)
    rows, marks = [], []
    for i in range(600):
        bad = i % 4 == 0
        rows.append((i, f"http://{'casino' if bad else rng.choice(['news', 'blog', 'shop'])}.site{rng.randint(0, 2)}.info/{rng.choice('xyz')}/{i}", ""))
        if i % 2 == 0:
            marks.append((i, 0 if bad else 1, 0))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = {r.page_id: r.verdict for r in url_filters.url_filters(pages, labels).collect()}
    assert all(got[i] == ("block" if i % 4 == 0 else "allow") for i in range(600))
    # the index finds what a scan of all rules finds
    rules = [set(r.antecedent) for r in url_filters.mine(pages, labels).collect()]
    tokens = {r.page_id: set(r.t) for r in pages.select("page_id", url_filters.url_tokens(F.col("url")).alias("t")).collect()}
    assert all((got[i] == "block") == any(r <= tokens[i] for r in rules) for i in got)
    # the rules are those of a count of all combinations, in either way of mining
    labelled = {i: q == 0 for i, q, _ in marks}
    n, both = Counter(), Counter()
    for i, b in labelled.items():
        for size in (1, 2, 3):
            for c in combinations(sorted(tokens[i]), size):
                n[c] += 1
                both[c] += b
    want = {c: both[c] / n[c] for c in n if both[c] >= 20 and both[c] / n[c] >= 0.5 and both[c] / n[c] * len(labelled) / sum(labelled.values()) >= 1.5}
    assert {tuple(r.antecedent): r.confidence for r in url_filters.mine(pages, labels).collect()} == want
    monkeypatch.setattr(url_filters, "MOST_TOKENS", 1)
    monkeypatch.setattr(url_filters, "MOST_BROADCAST", 0)
    assert {tuple(r.antecedent): r.confidence for r in url_filters.mine(pages, labels).collect()} == want
    assert {r.page_id: r.verdict for r in url_filters.url_filters(pages, labels).collect()} == got


# -- 3 ----------------------------------------------------------------------------


def test_language(spark):
    rng = random.Random(8)
    parts = {"en": ["the", "ing", "tion", "and", "er"], "de": ["sch", "ung", "ein", "keit", "ü"], "fr": ["eau", "ment", "é", "oi", "aux"]}
    rows = []
    for i in range(240):
        lang = rng.choice(list(parts))
        rows.append((i, " ".join("".join(rng.choice(parts[lang]) for _ in range(3)) for _ in range(30)), lang))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(df.where("doc_id % 5 <> 0"))
    odd = spark.createDataFrame([(1000, None, "en"), (1001, "12 3 ²", "en"), (1002, "", None)], df.schema)
    got = {r.doc_id: r for r in language_id.predict(df.union(odd).withColumn("score", F.lit("clash")), model).collect()}
    held = [r for r in rows if r[0] % 5 == 0]
    assert sum(got[i].lang_pred == lang for i, _, lang in held) >= 0.98 * len(held)
    assert all(got[i].lang_pred == "und" for i in (1000, 1001, 1002)) and all(0 <= r.score <= 1 for r in got.values())
    # the counts behind the model, one by one
    want = Counter()
    for i, t, lang in rows:
        if i % 5 and lang == "de":
            for h in language_id.grams(t):
                want.update(h.tolist())
    k = model.langs.index("de")
    p = np.full(language_id.BUCKETS, 0.5)
    for b, n in want.items():
        p[b] += n
    assert np.allclose(model.logp[k], np.log(p / p.sum()), atol=1e-4)
    # every prediction, text by text
    def plain(t):
        if t is None or not any(c.isalpha() for c in t):
            return "und", 0.0
        x = model.blocks[0][1] + sum(model.logp.astype(float)[:, h].sum(axis=1) for h in language_id.grams(t))
        return model.langs[int(x.argmax())], 1 / np.exp(x - x.max()).sum()
    for r in [*rows, *odd.collect()]:
        assert got[r[0]].lang_pred == plain(r[1])[0] and np.isclose(got[r[0]].score, plain(r[1])[1])
    none = language_id.train(df.limit(0))
    assert {r.lang_pred for r in language_id.predict(df, none).collect()} == {"und"}


def test_more_languages_than_a_matrix_holds(spark, monkeypatch):
    rng = random.Random(18)
    rows = [(i, "".join(rng.choice("abcdefgh"[k % 6 : k % 6 + 3]) for _ in range(40)), f"l{k}") for i in range(150) for k in [rng.randrange(9)]]
    df = spark.createDataFrame([*rows, (900, "12", None)], "doc_id long, text string, lang string")
    one = {r.doc_id: r for r in language_id.predict(df, language_id.train(df)).collect()}
    monkeypatch.setattr(language_id, "BLOCK", 4)
    model = language_id.train(df)
    many = {r.doc_id: r for r in language_id.predict(df, model).collect()}
    assert len(model.blocks) == 3 and one.keys() == many.keys()
    assert all(one[i].lang_pred == many[i].lang_pred and np.isclose(one[i].score, many[i].score) for i in one) and many[900].lang_pred == "und"


def test_ngrams_across_steps(monkeypatch):
    text = "abcdefghij" * 30
    before = language_id.sparse([text, None, "b", text])
    whole = Counter(int(x) for h in language_id.grams(text) for x in h)
    monkeypatch.setattr(language_id, "STEP", 17)
    assert Counter(int(x) for h in language_id.grams(text) for x in h) == whole
    assert all((x == y).all() for x, y in zip(before, language_id.sparse([text, None, "b", text]), strict=True))


# -- 1 ----------------------------------------------------------------------------


def plain_features(text):
    """Bucket and value of each feature, by plain loops."""
    words = re.findall(r"\S+", text or "")
    if not words:
        return {0: 1.0, 16: 1.0}
    bucket = lambda w: zlib.crc32(w.encode()) % (quality_classifier.BUCKETS - 64) + 64
    found = Counter()
    for word in words:
        for run in re.findall(r"[^\W_]+", word) or [word]:
            run = run.lower() if run != word or re.search(r"[^\W_]", word) else run
            found[bucket(run)] += 1
            for n in quality_classifier.STARTS:
                if len(run) > n:
                    found[bucket(run[:n] + "-")] += 1
    out = {b: 0.5 * (1 + np.log(n)) for b, n in found.items()}
    return out | {b: 4 * v for b, v in quality_classifier.shape(words)}


@pytest.mark.parametrize("text", ["foo-bar-baz plain", "a/b it's, _x_ ###!!!???### foo-zzz", "Inflected INFLECTING " * 3, "word" * 50 + " x " + " ".join(f"w{k}" for k in range(5000))])
def test_features_of_whole_words(text):
    ids, values = quality_classifier.vector(text)
    got = Counter()
    for i, v in zip(ids.tolist(), values.tolist(), strict=True):
        got[i] += v
    want = plain_features(text)
    assert got.keys() == want.keys() and all(np.isclose(got[b], want[b]) for b in want)


def test_fit_is_at_the_likelihood(spark):
    rng = np.random.default_rng(12)
    rows = [(np.array([0, 64 + int(k)]), np.array([1.0, 1.0])) for k in rng.integers(0, 3, 600)]
    grades = np.array([int(i[1] - 64) if rng.random() < 0.8 else int(rng.integers(0, 3)) for i, _ in rows])
    model = quality_classifier.fit(rows, grades, 3, steps=3000)

    def loss(w, t):
        p = np.array([np.concatenate([[1.0], 1 / (1 + np.exp(t - v @ w[i])), [0.0]]) for i, v in rows])
        return -np.log(p[np.arange(600), grades] - p[np.arange(600), grades + 1]).mean() + 5e-4 * (w**2).sum()
    best = loss(model.weights, model.thresholds)
    for b in (64, 65, 66):
        for step in (-0.3, 0.3):
            w = model.weights.copy()
            w[b] += step
            assert loss(w, model.thresholds) > best - 1e-3
    for k in (0, 1):
        for step in (-0.3, 0.3):
            t = model.thresholds.copy()
            t[k] += step
            assert loss(model.weights, t) > best - 1e-3


def test_classifier(spark):
    rng = random.Random(9)
    words = [f"w{k}" for k in range(200)]
    rows, marks = [], []
    for i in range(500):
        grade = rng.choice([0, 1, 2])
        w = [rng.choice(words) for _ in range(60)] + {0: ["awful"] * 2, 1: ["dull"] * 2, 2: []}[grade]
        rng.shuffle(w)
        rows.append((i, " ".join(w)))
        marks.append((i, grade))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ratings = spark.createDataFrame(marks, "doc_id long, grade int")
    model = quality_classifier.train(docs, ratings.where("doc_id < 400"))
    assert (np.diff(model.thresholds) > 0).all()
    got = {r.doc_id: r for r in quality_classifier.score(docs.union(spark.createDataFrame([(900, None), (901, "")], docs.schema)).withColumn("selected", F.lit(3)), model).collect()}
    held = [m for m in marks if m[0] >= 400]
    assert sum((got[i].selected) == (g == 2) for i, g in held) >= 0.95 * len(held)
    assert sum((got[i].expected_grade < 0.7) == (g == 0) for i, g in held) >= 0.9 * len(held)
    assert got[900].expected_grade == got[901].expected_grade
    assert quality_classifier.score(docs.limit(0), model).count() == 0
    # every probability, from features counted one by one
    for i, t in [*rows[:40], (900, None)]:
        x = sum(model.weights[b] * v for b, v in plain_features(t).items())
        p = 1 / (1 + np.exp(model.thresholds - x))
        assert np.isclose(got[i].expected_grade, p.sum()) and np.isclose(got[i].tail_probability, p[-1]) and got[i].selected == (p[-1] >= 0.5)
    nothing = quality_classifier.train(docs, ratings.limit(0))
    assert np.isclose(quality_classifier.score(docs.limit(1), nothing).first().expected_grade, 1.0)


# -- 8 ----------------------------------------------------------------------------


def test_sharding_round_trip(spark):
    df = table(spark, ODD + ["text " * k for k in range(200)], more=1).withColumn("arrival", F.col("doc_id") % 3)
    store = sharding.ShardStore(spark, scratch(spark, "t"), target=60_000, smallest=1_000)
    first = store.append(df, "arrival")
    assert first == 3
    old = store.manifest()
    store.compact()
    store.compact(all=True)
    assert sorted(store.read().select(*df.columns).collect(), key=str) == sorted(df.collect(), key=str)
    assert sorted(store.read(first).select(*df.columns).collect(), key=str) == sorted(df.collect(), key=str)  # an old version stays readable
    assert len(store.manifest()) < len(old) and store.vacuum() == 0 and store.vacuum(keep=99, age=0) == 0 and store.vacuum(keep=1, age=0) > 0
    assert store.read().count() == df.count()
    with pytest.raises(sharding.Conflict):
        store.commit(store.version() - 1, sharding.Manifest())
    assert store.append(df.limit(0)) == store.version() and store.read().count() == df.count()


def test_shards_with_other_columns(spark):
    root = scratch(spark, "t")
    a, b = spark.createDataFrame([(1, "x"), (2, None)], "doc_id long, `__arrival` string"), spark.createDataFrame([(0.5, 3), (None, 4)], "`ex tra` double, doc_id long")
    store = sharding.ShardStore(spark, root)
    store.append(a)
    store.append(b.repartition(2))
    store.compact(all=True)
    assert len(store.manifest()) == 1 and store.read().columns == ["doc_id", "__arrival", "ex tra"]
    assert sorted(store.read().collect(), key=str) == [(1, "x", None), (2, None, None), (3, None, 0.5), (4, None, None)]
    with pytest.raises(ValueError, match="doc_id"):
        store.append(spark.createDataFrame([("q",)], "doc_id string"))
    assert store.read().count() == 4


def test_empty_shards_and_a_writer_before_its_commit(spark):
    df = spark.createDataFrame([(1, None, 0), (2, "t", None)], "doc_id long, text string, arrival int")
    empty = sharding.shard(df.limit(0), scratch(spark, "t"), "arrival")
    assert empty.read().count() == 0 and empty.read().schema == df.schema
    store = sharding.shard(df, scratch(spark, "t"), "arrival")
    assert sorted(store.read().collect(), key=str) == sorted(df.collect(), key=str)
    df.write.parquet(f"{store.root}/data/a-other")  # of a writer that has not committed
    store.vacuum()
    assert spark.read.parquet(f"{store.root}/data/a-other").count() == 2


def test_tiers():
    store = sharding.ShardStore.__new__(sharding.ShardStore)
    store.target, store.fanout, store.smallest = 1000, 4, 10
    shard = lambda i, n: sharding.Shard(f"p{i}", n, store.tier(n))
    runs = store.plan([shard(i, 9) for i in range(9)] + [shard(20, 600), shard(21, 30), shard(22, 31)])
    assert len(runs) == 1 and len(runs[0]) == 9
    assert store.plan([shard(1, 600), shard(2, 700)], all=True) == []
    for r in store.plan([shard(i, 120) for i in range(40)]):
        assert 1 < len(r) and sum(s.bytes for s in r) <= 1000


def test_url_rules_of_deep_paths_and_site_words(spark):
    urls = [f"http://h{i % 9}.org/en/2024/{'casino' if i < 30 else 'garden'}/x" for i in range(60)]
    urls += [f"http://{'casino-win' if i < 30 else 'tea-time'}.com/{i % 4}" for i in range(60)]
    urls += [f"http://shop.net/a?sort={'spam' if i < 30 else 'date'}" for i in range(60)]
    urls += [f"http://f{i}.info/de" for i in range(11000)]
    bad = [i < 180 and i % 60 < 30 for i in range(len(urls))]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(i, int(not b), 0) for i, b in enumerate(bad)], "doc_id long, quality int, toxic int")
    found = {tuple(r.antecedent): r for r in url_filters.mine(pages, labels, least=30).collect()}
    assert {("path=casino",), ("word=casino",), ("arg=sort=spam",)} <= set(found) and max(map(len, found)) == 3
    assert found["path=casino",].confidence == 1 and abs(found["path=casino",].support - 30 / len(urls)) < 1e-12
    blocked = {r.page_id for r in url_filters.url_filters(pages, labels, rules=(), confidence=0.9).where("mined_hit").collect()}
    assert blocked == {i for i, b in enumerate(bad) if b}
