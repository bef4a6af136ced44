"""Each operator against brute force on a small table with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from voxelspark.llm import anchors, contentsort, decontaminate, fuzzylines, minhash, mixing_lm, mixture, phrases, quality, sharding, suffixes, tokens, urlfilter

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def shingles(text, k=5):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def roots(nodes, links):
    parent = {i: i for i in nodes}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in nodes}


def test_word_hashes_don_t_depend_on_blocks(texts):
    import pyarrow as pa

    column = pa.array([t for _, t in texts])
    parts = [np.concatenate([w.hash for *_, w in tokens.text_blocks(column, most)]) for most in (10, 1000, 1 << 22)]
    flat = [w for _, t in texts for w in words(t)]
    assert len(parts[0]) == len(flat)
    assert all((p == parts[0]).all() for p in parts)
    seen = dict(zip(parts[0].tolist(), flat))
    assert all(seen[h] == w for h, w in zip(parts[0].tolist(), flat)) and len(seen) == len(set(flat))


def test_near_duplicates(docs, texts):
    got = minhash.near_duplicates(docs).collect()
    assert len(got) == len(texts)
    sets = defaultdict(list)
    for i, t in texts:
        sets[i].append(shingles(t))
    ids = sorted(i for i in sets if i is not None)
    links = [(a, b) for a in ids for b in ids if a < b and any(100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b] if x and y)]
    want = roots(ids, links)
    assert len(links) > 10
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        elif r.n_shingles:
            assert r.component_id == want[r.doc_id]
            assert r.kept == (r.doc_id == want[r.doc_id])
            assert r.n_shingles in [len(s) for s in sets[r.doc_id]]
        else:
            assert r.component_id == r.doc_id and r.kept


def test_near_duplicates_of_a_large_group(spark):
    """A chain of copies, each near the next only, is one component; another group of mutual strangers stays apart."""
    base = [f"w{i}" for i in range(200)]
    chain = [base[k * 6 : 100 + k * 6] for k in range(16)]
    rows = [(i, " ".join(w)) for i, w in enumerate(chain)] + [(100 + i, " ".join(f"v{i}x{j}" for j in range(50))) for i in range(20)]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {i: shingles(t) for i, t in rows}
    want = roots(sets, [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])])
    assert got == want


def test_pruning_never_loses_probable_pairs():
    for n, least in zip(range(minhash.BATCH, minhash.HASHES + 1, minhash.BATCH), minhash.fewest_matches()):
        below = sum(math.comb(n + 1, m) * 0.75**m * 0.25 ** (n + 1 - m) for m in range(least))
        assert below < minhash.MISS


@pytest.mark.parametrize("partitions", [1, 5])
def test_exact_duplicates(docs, texts, partitions):
    got = contentsort.exact_duplicates(docs, partitions=partitions).collect()
    groups = defaultdict(list)
    for i, t in texts:
        groups[(t or "").translate(LOWER)].append(i)
    want = Counter()
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        for i in ids:
            want[(i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest())] += 1
    assert Counter(map(tuple, got)) == want


def test_shards(docs, texts):
    got = sharding.rendezvous_shards(docs).collect()
    assert len(got) == len(texts)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 8) and r.law == "key"
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == sizes


def test_weights_of_shards(spark):
    df = spark.range(4000).selectExpr("id AS doc_id", "CAST(NULL AS STRING) AS text")
    n = Counter(r.shard for r in sharding.rendezvous_shards(df, [1.0, 3.0]).collect())
    assert 0.7 < n[1] / 4000 < 0.8


RULES = (("com", "/en/", True), ("example.com", "/en/7", False), ("net", "/de/", False))


def test_urls(spark):
    urls = ["http://A.example.com/en/7?x", "https://example.com/en/8#a", "http://notcom/en/1", "x://h.net", "nothing", None, "", "http://q.net/de/1", "http://shop.org/p/1", "a://b://c/d", "http://h?x/y"]
    rows = [(k, u, "html", "h", 1) for k, u in enumerate(urls)] + [(0, urls[0], "", "", 2)]
    got = urlfilter.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string, host string, n int"), RULES).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    assert (by[0].host, by[0].path, by[0].rule, by[0].verdict) == ("a.example.com", "/en/7", "example.com/en/7", "allow")
    assert (by[1].rule, by[1].verdict) == ("com/en/", "block")
    assert by[2].rule is None and by[3].path == "" and by[3].host == "h.net"
    assert all((by[k].host, by[k].path, by[k].rule) == ("", "", None) for k in (4, 5, 6))
    assert by[7].rule == "net/de/" and (by[9].host, by[9].path) == ("b:", "//c/d") and (by[10].host, by[10].path) == ("h", "")


def test_url_templates_reject_impure_branches(spark):
    urls = [(f"http://s.org/spam/{k}", 1) for k in range(40)] + [(f"http://s.org/news/{k}.html", 0) for k in range(40)]
    pages = [(k, u) for k, (u, _) in enumerate(urls)] + [(200, "http://s.org/spam/999"), (201, "http://s.org/news/999.html"), (202, "http://other.org/spam/1")]
    got = {r.page_id: r for r in urlfilter.judge_urls(spark.createDataFrame(pages, "page_id long, url string"), (), spark.createDataFrame(urls, "url string, bad int")).collect()}
    assert got[200].verdict == "block" and got[200].template == "/spam/{num}"
    assert got[201].verdict == "allow" and got[202].verdict == "allow"


def test_contaminated(spark, docs, texts):
    own = dict(texts[:20])
    items = [(0, " ".join(words(own[2])[10:40])), (1, " ".join(words(own[3])[5:40] + ["new"] * 30)), (2, None), (3, ""), (4, "one two"), (None, own[5]), (5, own[6].upper()), (6, "zz yy"), (6, own[8])]
    bench = spark.createDataFrame([(i, t, 1, "x") for i, t in items], "item_id long, text string, n int, string string")
    got = {(r.doc_id, r.item_id): (r.shared, r.item_shingles) for r in decontaminate.contaminated(docs, bench).collect()}
    want = {}
    cut = lambda t, k: {tuple(w[i : i + k]) for w in [t] for i in range(len(w) - k + 1)}
    need = defaultdict(set)
    for i, t in items:
        w = (t or "").lower().split()
        if i is not None and w:
            need[i] |= {(min(5, len(w)), s) for s in cut(w, min(5, len(w)))}
    have = defaultdict(set)
    for i, t in texts:
        if i is not None:
            w = (t or "").lower().split(" ") if False else re.split(r"[\x20\x09-\x0D]+", (t or "").lower())
            w = [x for x in w if x]
            have[i] |= {(k, s) for k in range(1, 6) for s in cut(w, k)}
    for d, s in have.items():
        for i, n in need.items():
            if 100 * len(s & n) >= 75 * len(n):
                want[(d, i)] = (len(s & n), len(n))
    assert got == want and len(want) >= 4


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_fuzzy_lines(spark):
    long = " ".join(f"token{i}" for i in range(300))
    same = "The quick brown fox jumps over the lazy dog near the river bank today"
    texts = [(1, f"{same}\nunique line one\n\n{long}"), (2, f"{same.upper()}  \n{long} extra"), (3, same.replace("today", "Today.")), (4, None), (None, same), (5, ""), (2, "unique line one"), (6, f"  {same}")]
    df = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in texts], "doc_id long, text string, line int, chars int, sim int")
    rows = fuzzylines.fuzzy_lines(df).collect()
    lines = [(i, k, " ".join(line.lower().split())) for i, t in texts for k, line in enumerate((t or "").split("\n")) if line.strip()]
    assert len(rows) == len(lines)
    found = fuzzylines.simhashes(fuzzylines._lines(df.select("doc_id", "text"))).select("line", "sim").distinct().collect()
    sims = {r.line: r.sim for r in found}
    norm = {r.line: r.norm for r in spark.createDataFrame([(n,) for _, _, n in lines], "norm string").selectExpr("norm", "xxhash64(norm) AS line").collect()}
    ids = sorted(sims)
    links = [(a, b) for a in ids for b in ids if a < b and bin((sims[a] ^ sims[b]) & (2**64 - 1)).count("1") <= 3 and _distance(norm[a], norm[b]) * 100 <= 10 * max(len(norm[a]), len(norm[b]))]
    want = roots(ids, links)
    text = {n: h for h, n in norm.items()}
    group = [((i, k), want[text[n]]) for i, k, n in lines]
    assert Counter((r.doc_id, r.line_no, r.line_group) for r in rows) == Counter((*at, g) for at, g in group)
    assert len(links) >= 1
    first = {}
    for at, g in group:
        key = (at[0] is not None, at[0] or 0, at[1])
        first[g] = min(first.get(g, key), key)
    assert all(r.kept == (first[r.line_group] == (r.doc_id is not None, r.doc_id or 0, r.line_no)) for r in rows)
    after = {r.doc_id: r.text for r in fuzzylines.drop_lines(df.where("doc_id in (1, 6)"), spark.createDataFrame(rows)).collect()}
    assert after[6] == "" and after[1].endswith("token299")


def test_repeated_passages(docs, texts):
    got = suffixes.repeated_passages(docs).collect()
    own = defaultdict(list)
    for i, t in texts:
        if i is not None:
            own[i].append(words(t))
    where = defaultdict(set)
    for i, many in own.items():
        for w in many:
            for s in range(len(w) - 49):
                where[tuple(w[s : s + 50])].add(i)
    want = {i for ids in where.values() if len(ids) > 1 for i in ids}
    assert {r.doc_id for r in got} == want and want
    for r in got:
        # Each word lies in a repeated window; matches that touch are one span.
        covers = [{k for s in range(len(w) - 49) if len(where[tuple(w[s : s + 50])]) > 1 for k in range(s, s + 50)} for w in own[r.doc_id]]
        assert r.end_word - r.start_word >= 50 and any(set(range(r.start_word, r.end_word)) <= c for c in covers)
        assert r.other_id != r.doc_id


@pytest.mark.parametrize("percent,epochs", [(50, 2), (100, 1), (300, 2), (0, 1)])
def test_mixture(docs, texts, percent, epochs):
    from pyspark.sql import functions as F

    got = mixture.mix_sources(docs, {"lang": F.col("lang"), "source": F.col("source")}, {("en",): 3, ("en", "src1"): 2}, percent, epochs).collect()
    assert len(got) == len(texts)
    leaf, target, drawn = Counter(), {}, Counter()
    for r in got:
        leaf[(r.lang, r.source)] += r.tokens
        target[(r.lang, r.source)] = r.target
        drawn[(r.lang, r.source)] += r.tokens * r.copies
    whole = sum(leaf.values())
    budget = min(whole * percent // 100, whole * epochs)
    assert budget - 2 * len(leaf) <= sum(target.values()) <= budget
    for k in leaf:
        assert drawn[k] <= target[k] <= leaf[k] * epochs
        # What is left of a target is less than a document that would not fit.
        assert target[k] - drawn[k] < max([r.tokens for r in got if (r.lang, r.source) == k], default=0) + 1


def test_quality(spark):
    import random

    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    good = lambda: ". ".join(" ".join(word() for _ in range(12)) for _ in range(8))
    bad = lambda: " ".join(word().upper() + "!!*" for _ in range(60))
    kinds = [rng.random() < 0.75 for _ in range(900)]
    rows = [(i, good() if k else bad(), 1) for i, k in enumerate(kinds)] + [(900, None, 1), (901, "", 1), (None, good(), 1), (5, good(), 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, flag int")
    labels = spark.createDataFrame([(i, int(k)) for i, k in enumerate(kinds) if rng.random() < 0.4] + [(None, 1), (3, None)], "doc_id long, quality int")
    got = quality.classify(docs, labels).collect()
    assert len(got) == len(rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    right = [r.predicted == kinds[r.doc_id] for r in got if r.held_out and r.doc_id < 900]
    assert len(right) > 150 and np.mean(right) > 0.97
    # However the rows are split; sums of floats differ in their last digits.
    again = {r.doc_id: r.score for r in quality.classify(docs.repartition(7), labels).collect()}
    assert max(abs(again[r.doc_id] - r.score) for r in got if r.doc_id not in (None, 5)) < 0.01


def test_language_model(docs, texts):
    got = mixing_lm.score_documents(docs).collect()
    assert len(got) == len(texts)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts = Counter(w for i, t in texts if not held(i) for w in [*words(t), None])
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for i, t in texts:
        w = [*words(t), None]
        want[(i, held(i), len(w), sum(counts[x] > 0 for x in w), n, round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), 6))] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)


def _known_grams():
    """Grams of two texts with their counts, all 256 symbols after some of their contexts (counted 0 where not seen), and a mixer."""
    rng = np.random.default_rng(1)
    raw = rng.choice(np.frombuffer(b"abc d", np.uint8), 4000)
    own, n = np.unique(mixing_lm.grams(raw, np.array([0, 2000, 4000]))[0], return_counts=True)
    every = [(context & ~np.uint64(0xFF)) | np.arange(256, dtype=np.uint64) for context in own[::97][:5]]
    gram = np.unique(np.concatenate([own, *every]))
    count = np.zeros(len(gram), np.int64)
    count[np.searchsorted(gram, own)] = n
    middle = 1 / (1 + np.exp(-np.linspace(-11, 11, mixing_lm.BUCKETS)))
    mixer = mixing_lm.Mixer(rng.normal(0.3, 0.1, (mixing_lm._GATES, mixing_lm.ORDER + 1)), np.tile(middle, (256, 1)) * rng.uniform(0.8, 1, (256, mixing_lm.BUCKETS)))
    return gram, count, every, mixer


def test_language_model_is_a_distribution():
    """After any context the probabilities of the 256 symbols sum to one."""
    gram, n, every, mixer = _known_grams()
    cost = mixing_lm.costs(gram, n, mixing_lm.Shared(gram, n), mixer)
    for symbols in every:
        assert abs((10 ** cost[np.searchsorted(gram, symbols)]).sum() - 1) < 1e-6


def test_language_model_costs_by_a_plain_program():
    gram, n, _, mixer = _known_grams()
    cost = mixing_lm.costs(gram, n, mixing_lm.Shared(gram, n), mixer)
    counts = Counter()
    for g, c in zip(gram.tolist(), n.tolist()):
        symbol = format(g & 255, "08b")
        for k in range(mixing_lm.ORDER + 1):
            for b in range(9):
                counts[(k, g >> 8 & ((1 << 8 * k) - 1), symbol[:b])] += c
    for at in range(0, len(gram), 53):
        g, total = int(gram[at]), 0.0
        symbol = format(g & 255, "08b")
        for b in range(8):
            odds, longest, most = [], 0, 0
            for k in range(mixing_lm.ORDER + 1):
                zero, one = (counts[(k, g >> 8 & ((1 << 8 * k) - 1), symbol[:b] + x)] for x in "01")
                odds.append(math.log((one + mixing_lm.PRIOR) / (zero + mixing_lm.PRIOR)))
                if zero + one:
                    longest, most = k + 1, zero + one
            gate = (longest * 4 + sum(most >= x for x in (2, 4, 16))) * 8 + b
            logit = max(-11.0, min(11.0, sum(w * o for w, o in zip(mixer.weights[gate], odds))))
            place = round((logit + 11) * (mixing_lm.BUCKETS - 1) / 22)
            p = 0.5 / (1 + math.exp(-logit)) + 0.5 * (mixer.refine[int("1" + symbol[:b], 2), place] * (1 - 1e-5) + 5e-6)
            total += math.log10(p if symbol[b] == "1" else 1 - p)
        assert abs(total - cost[at]) < 1e-3


def test_empty_tables(spark, empty):
    from pyspark.sql import functions as F

    labels = spark.createDataFrame([], "doc_id long, quality int")
    items = spark.createDataFrame([], "item_id long, text string")
    pages = spark.createDataFrame([], "page_id long, url string")
    results = [
        minhash.near_duplicates(empty), contentsort.exact_duplicates(empty), sharding.rendezvous_shards(empty), urlfilter.judge_urls(pages, RULES), decontaminate.contaminated(empty, items),
        fuzzylines.fuzzy_lines(empty), suffixes.repeated_passages(empty), mixture.mix_sources(empty, {"lang": F.col("lang")}, {}), quality.classify(empty, labels), mixing_lm.score_documents(empty),
        phrases.collocations(empty), anchors.remove_repeats(empty),
    ]
    assert [r.count() for r in results] == [0] * 12


def _judged(spark, urls, extra=()):
    pages = [(k, u) for k, (u, _) in enumerate(urls)] + [(1000 + k, u) for k, u in enumerate(extra)]
    told = spark.createDataFrame([r for r in urls if r[1] is not None], "url string, bad int")
    return {r.page_id: r for r in urlfilter.judge_urls(spark.createDataFrame(pages, "page_id long, url string"), (), told).collect()}


def test_url_branches_with_few_children_stay_apart(spark):
    urls = [(f"http://h/{a}/{w}/page", None) for a in ("alpha", "beta") for w in (f"{a}{c}" for c in "vwxyz")]
    got = _judged(spark, [*urls, ("http://g/x", 0)])
    assert [got[k].template for k in range(10)] == [u[len("http://h") :] for u, _ in urls]


def test_url_branches_of_opposite_labels_stay_apart(spark):
    urls = [(f"http://h/alpha/{k}", 1) for k in range(5)] + [(f"http://h/beta/{k}", 0) for k in range(5)]
    got = _judged(spark, urls, ["http://h/alpha/99", "http://h/beta/99", "http://h/alpha/a{num}"])
    assert got[1001].verdict == "allow" and got[1000].impurity > got[1001].impurity
    assert got[1000].template == "/alpha/{num}" and got[1002].template == "/alpha/a%7Bnum}"


@pytest.mark.parametrize("sections, each", [(7, 20), (8, 20), (9, 40)])
def test_url_sections_next_to_a_bad_one_stay_allowed(spark, sections, each):
    urls = [(f"http://h.com/s{chr(97 + s)}/{k}", 1 if s == 0 else None) for s in range(sections) for k in range(each)]
    got = _judged(spark, [*urls, ("http://g/x", 0)], ["http://h.com/sa/9999"])
    assert got[1000].verdict == "block"
    assert all(got[k].verdict == "allow" for k, (_, bad) in enumerate(urls) if bad is None)


def test_url_verdicts_follow_their_definition(spark):
    """Templates and rates of a random tree by a plain program over the returned templates."""
    rng = random.Random(3)
    urls = {f"http://h{rng.randint(0, 2)}/{rng.choice(['a', 'b', 'news', 'x1', 'x2'])}/{rng.choice(['p', str(rng.randint(0, 60))])}/{rng.choice(['', 'q', '7.html'])}": rng.choice([None, 0, 1, 1]) for _ in range(600)}
    got = _judged(spark, list(urls.items()))
    sums, told = defaultdict(lambda: [0, 0]), [b for b in urls.values() if b is not None]
    paths = {}
    for k, (u, b) in enumerate(urls.items()):
        paths.setdefault((got[k].host, got[k].path), []).append(b)
        if b is not None:
            sums[(got[k].host, got[k].template)][0] += b
            sums[(got[k].host, got[k].template)][1] += 1
        assert [s for s in got[k].path.split("/") if s] == [] or len(got[k].template.strip("/").split("/")) == len([s for s in got[k].path.split("/") if s])
    prior = min(0.5, sum(told) / len(told))
    for k in range(len(urls)):
        bad, n = sums[(got[k].host, got[k].template)]
        assert got[k].impurity == pytest.approx((bad + 4 * prior) / (n + 4))
        assert got[k].verdict == ("block" if (bad + 4 * prior) / (n + 4) >= 0.8 else "allow")
