"""Operators against plain brute force on a small table with every odd case."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparkfactors.llm import decontaminate, line_dedup, near_dedup, packing, pii, quality, secret_scan, substring_dedup, token_count, url_filter

WORD = re.compile("[^\x20\x09-\x0d]+")
PATH = public_tokenizers.path("word_bpe_49k.json")
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
lower = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s)
least = -(2**63)


def same(df, want):
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(want, key=repr)


def test_substring_dedup(docs, rows):
    k, first = 20, {}
    words = [(least if d is None else d, WORD.findall(t or "")) for d, t in rows]
    for d, w in words:
        for i in range(len(w) - k + 1):
            key = tuple(w[i : i + k])
            first[key] = min(first.get(key, (d, i)), (d, i))
    want = []
    for d, w in words:
        gone = {j for i in range(len(w) - k + 1) if first[tuple(w[i : i + k])] < (d, i) for j in range(i, i + k)}
        want.append((None if d == least else d, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    same(substring_dedup.dedup_substrings(docs).drop("kept_text"), want)


def test_substring_dedup_hot_grams(docs, monkeypatch):
    """Grams dealt by whole windows give the same factors."""
    plain = substring_dedup.dedup_substrings(docs).drop("kept_text").collect()
    f = substring_dedup.find_factors
    monkeypatch.setattr(substring_dedup, "find_factors", lambda d, w: f(d, w, block_words=300, hot=3))
    same(substring_dedup.dedup_substrings(docs).drop("kept_text"), list(map(tuple, plain)))


def test_quality(docs, rows):
    want = []
    for d, t in rows:
        t = t or ""
        w, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        n = Counter(grams)
        rep = len({j for i, g in enumerate(grams) if n[g] > 1 for j in range(i, i + 3)})
        want.append((d, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), rep, len(w) < 50 or 100 * rep > 50 * len(w)))
    got = quality.quality_report(docs)
    same(got.drop("kept", "failed_rule"), want)
    assert got.where("base_failed AND kept").count() == 0
    assert got.where("kept <> (failed_rule IS NULL) AND NOT base_failed").count() == 0
    kept = got.where("kept").select("doc_id")
    same(quality.filter_quality(docs).select("doc_id"), list(map(tuple, kept.collect())))


def test_rule_order_is_rejection_per_cost(spark):
    d = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "a b").otherwise("c " * 60).alias("text"))
    rules = [quality.Rule("never", lambda t, w: F.lit(False), 0.1), quality.Rule("dear", lambda t, w: F.size(w) < 50, 9.0), quality.Rule("cheap", lambda t, w: F.size(w) < 50, 1.0)]
    assert [r.name for r in quality.order_rules(d, rules, 500)] == ["cheap", "never", "dear"]


def test_rule_order_is_the_same_each_time(docs):
    names = [[r.name for r in quality.order_rules(d, quality.default_rules())] for d in (docs, docs.repartition(5), docs)]
    assert names[0] == names[1] == names[2] and names[0][0] == "few_words" and set(names[0]) == {r.name for r in quality.default_rules()}


def test_rule_costs_are_timed(spark):
    """Of two rules that reject alike, the one that does more work comes second."""
    d = spark.range(500).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(2000)), lambda i: (i * 7 + F.col("id")).cast("string"))).alias("text"))
    dear = quality.Rule("dear", lambda t, w: quality.n_repeat_words(w) < F.size(w))
    cheap = quality.Rule("cheap", lambda t, w: F.size(w) > 10)
    assert [r.name for r in quality.order_rules(d, [dear, cheap])] == ["cheap", "dear"]


def test_near_dedup(docs, rows):
    sets = []
    for d, t in rows:
        w = WORD.findall(lower(t or ""))
        sets.append((d, {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()))
    root = {i: i for i in range(len(sets))}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (d, a) in enumerate(sets):
        for j in range(i):
            e, b = sets[j]
            if None not in (d, e) and a and b and 100 * len(a & b) >= 75 * len(a | b):
                root[find(i)] = find(j)
    best = defaultdict(list)
    for i, (d, _) in enumerate(sets):
        best[find(i)].append(d)
    want = [(d, len(s), min(best[find(i)]) if d is not None else None, d is None or d == min(best[find(i)])) for i, (d, s) in enumerate(sets)]
    same(near_dedup.near_components(docs), want)
    left = near_dedup.dedup_near(docs.where("doc_id IS NOT NULL"))
    assert {x[0] for x in left.select("doc_id").collect()} == {x[0] for x in want if x[3] and x[0] is not None}


def test_near_dedup_parts_regions(spark):
    """A large group of near copies, over split_at, is one component."""
    base = [f"w{i}" for i in range(150)]
    rows = [(i, " ".join([*base[: i % 140], f"e{i}", *base[i % 140 + 1 :]])) for i in range(300)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dedup.near_components(d, near_dedup.Forest(split_at=40))
    assert got.select("component_id").distinct().count() == 1


def brute_components(texts):
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    root = list(range(len(sets)))
    for i, x in enumerate(sets):
        for j in range(i):
            if root[i] != root[j] and 100 * len(x & sets[j]) >= 75 * len(x | sets[j]):
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    return root


def near_roots(spark, texts, f):
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    return [x["component_id"] for x in near_dedup.near_components(d, f).orderBy("doc_id").collect()]


@pytest.mark.parametrize("block", [1 << 20, 12_000])
def test_near_dedup_tries_all_of_a_large_region(spark, block):
    """Copies of copies with few links, in regions of one block or of many, which the second forest replaces."""
    base = [f"w{i}" for i in range(300)]
    texts = [" ".join([*base[:i], f"e{i}", *base[i + 1 :]]) for i in range(150)]
    # Each has a link to the copy whose edit it repeats, and to few others or none; more edits make chains and strays.
    texts += [" ".join([*base[:i], f"e{i}", *base[i + 1 : 262], *(f"x{i}_{j}" for j in range(38))]) for i in range(0, 150, 10)]
    texts += [" ".join([*base[:i], f"e{i}", *base[i + 1 : 225], *(f"x{i}_{j}" for j in range(75))]) for i in range(0, 150, 10)]
    texts += [" ".join([*base[:100], *(f"y{i}_{j}" for j in range(200))]) for i in range(30)]
    want = brute_components(texts)
    assert 2 < len(set(want)) < 100
    assert near_roots(spark, texts, near_dedup.Forest(block=block, split_at=40)) == want


def test_near_dedup_tries_unlikely_signatures(spark):
    """A pair of similarity 0.75 whose signatures agree in few minima is linked, also where nothing else is."""
    signature = lambda t: near_dedup.minima(near_dedup.shingles(t, near_dedup.c.WordHashes())).astype("u1")
    for seed in range(20_000):
        base = [f"w{seed}_{i}" for i in range(300)]
        x, y = " ".join(base), " ".join([*base[:259], *(f"x{seed}_{j}" for j in range(41))])
        share = (signature(x) == signature(y)).mean()
        if 0.55 <= share < 0.64 and brute_components([x, y]) == [0, 0]:
            break
    assert share < 0.64
    assert near_roots(spark, [x, y], near_dedup.Forest()) == [0, 0]


def test_line_dedup(docs, rows):
    strip = " \t\n\x0b\x0c\r"
    where, lines = defaultdict(list), []
    for n, (d, t) in enumerate(rows):
        ls = (t or "").split("\n")
        lines.append((d, ls))
        for key in {lower(x.strip(strip)) for x in ls}:
            if len(key) >= 40:
                where[key].append((n, least if d is None else d))
    want = []
    for d, ls in lines:
        kept = []
        for x in ls:
            ids = [i for _, i in where[lower(x.strip(strip))]]
            if len(ids) < 5 or (least if d is None else d) == max(ids):
                kept.append(x)
        want.append((d, len(ls), len(ls) - len(kept), sha("\n".join(kept))))
    out = line_dedup.dedup_lines(docs, n_batches=5, fan_out=2)
    same(out.select("row.doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept_text", "UTF-8"), 256)), want)
    assert [x[2] for x in want if x[2]]


def test_line_runs(docs):
    """Four batches end in one run of level 2; its keeper of a key is the largest doc_id, found by the first batch alone."""
    staged = line_dedup.in_batches(docs, 40, 4)
    runs = line_dedup.index_lines(staged, 4, fan_out=2)
    assert [len(x) for x in runs.levels] == [0, 0, 1]
    keys = staged.select("doc_id", F.explode("lines").alias("x")).distinct()
    want = keys.groupBy("x.h1", "x.h2").agg(F.max("doc_id").alias("keeper"))
    assert staged.select("batch").distinct().count() > 1
    same(runs.runs()[0].select("h1", "h2", "keeper"), list(map(tuple, want.collect())))
    runs.drop()


def test_line_runs_take_the_keeper_from_known_keys(spark):
    runs = line_dedup.LineRuns(spark, fan_out=3)
    for rows in ([(1, 1, 2, 9)], [(1, 1, 3, 8), (2, 2, 1, 5)]):
        runs.add(spark.createDataFrame(rows, "h1 long, h2 long, n_docs long, keeper long"))
    same(runs.runs()[1], [(1, 1, 3, None), (2, 2, 1, 5)])
    same(line_dedup.merged(runs.runs()), [(1, 1, 5, 9), (2, 2, 1, 5)])
    runs.drop()


def test_decontaminate(spark, docs, rows):
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    texts = dict(rows)
    long = [t for t in texts.values() if t and len(t.split()) > 30]
    items = [(1, long[0].upper()[:200]), (2, long[1].replace(" ", "; ")), (10, "one"), (3, None), (4, "--"), (5, "cat the cat"), (5, "nothing of it here"), (6, long[0])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    phrases = defaultdict(set)
    for i, t in items:
        w = word.findall(lower(t or ""))
        for x in range(max(1, len(w) - 9) if w else 0):
            phrases[tuple(w[x : x + 10])].add(str(i))
    want = []
    for d, t in rows:
        w = word.findall(lower(t or ""))
        hit, found = set(), set()
        for k in {len(p) for p in phrases}:
            for x in range(len(w) - k + 1):
                if tuple(w[x : x + k]) in phrases:
                    hit |= set(range(x, x + k))
                    found |= phrases[tuple(w[x : x + k])]
        want.append((d, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    same(decontaminate.contamination_report(docs, bench).drop("items"), want)
    # In blocks of two items, whose findings are put together.
    blocks = decontaminate.find_overlaps(docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]), bench, block_items=2)
    n = {r["doc_id"]: sum(s["b"] - s["a"] for s in r["spans"]) for r in blocks.collect()}
    assert n == {x[0]: x[2] for x in want if x[0] is not None}
    # A row per row also then, repeated rows and null ids included.
    every = decontaminate.find_overlaps(docs, bench, block_items=2)
    got = [(r["doc_id"], r["n_words"], sum(s["b"] - s["a"] for s in r["spans"]), len(r["items"])) for r in every.collect()]
    assert sorted(got, key=repr) == sorted((x[:4] for x in want), key=repr)
    clean = decontaminate.decontaminate(docs, bench)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    again = decontaminate.contamination_report(clean, bench)
    assert again.where("contaminated").count() == 0
    cased = spark.createDataFrame([(1, "Clean Start. ONE more"), (2, "AB Cd eF, (one) Tail")], "doc_id long, text string")
    assert [x["text"] for x in decontaminate.decontaminate(cased, bench).orderBy("doc_id").collect()] == ["Clean Start. \n more", "AB Cd eF, (\n) Tail"]
    none = decontaminate.contamination_report(docs, bench.limit(0))
    assert none.where("contaminated").count() == 0 and none.count() == len(rows)


def test_packing(docs, rows):
    tok = Tokenizer.from_file(PATH)
    ids = Counter()
    want = defaultdict(list)
    for d, t in rows:
        want[d].append([*tok.encode(t or "", add_special_tokens=False).ids, 1])
        ids[d] += 1
    pieces = packing.pack(docs, PATH, size=256).collect()
    seqs = defaultdict(list)
    for p in pieces:
        seqs[p["sequence_id"]].append((p["offset"], p["length"]))
        assert any(
            len(x) == p["doc_tokens"] and zlib.crc32(np.array(x[p["start"] : p["start"] + p["length"]], "<u4").tobytes()) == p["ids_crc32"] for x in want[p["doc_id"]]
        )
    padding = 0
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at and length > 0
            at += length
        assert at <= 256
        padding += 0 if at & (at - 1) == 0 else 256 - at
    total = sum(len(x) for xs in want.values() for x in xs)
    assert sum(p["length"] for p in pieces) == total
    assert padding < 0.12 * total
    for d, n in Counter(p["doc_id"] for p in pieces if p["start"] == 0).items():
        assert n == ids[d]


@pytest.mark.parametrize("seed", range(6))
def test_packing_dp_is_optimal(seed):
    r = np.random.default_rng(seed)
    doc_ends = np.cumsum(r.integers(1, 40, 12))
    sentences = np.unique(r.integers(1, doc_ends[-1], 20))
    pos, kind = packing.cut_positions(doc_ends, sentences, 32)
    costs = packing.Costs()
    fee = {0: 0.0, 1: costs.sentence, 2: costs.forced}
    kinds = dict(zip(pos.tolist(), kind.tolist(), strict=True))
    cost = lambda cuts: sum((0 if (b - a) & (b - a - 1) == 0 else 32 - (b - a)) + fee[kinds[b]] + costs.each for a, b in zip(cuts, cuts[1:]))
    best = {0: 0.0}
    for b in pos.tolist()[1:]:
        best[b] = min(best[a] + cost([a, b]) for a in best if b - a <= 32)
    assert cost(packing.best_cuts(pos, kind, 32, costs).tolist()) == pytest.approx(best[pos[-1]])


def test_token_counts(spark, docs, rows):
    tok = Tokenizer.from_file(PATH)
    tok.encode_special_tokens = True
    same(token_count.count_documents(docs, PATH, 49407), [(d, len(tok.encode(t or "", add_special_tokens=False).ids)) for d, t in rows])


def test_token_blocks_are_stitched(spark):
    r, eod = np.random.default_rng(3), 7
    rows, want = [], []
    for file in ("a", "b"):
        ids = r.integers(0, 40, 3000).astype("<u2")
        ids[500:1400] = 3  # a document over many blocks
        at = np.flatnonzero(ids == eod)
        want += [(file, i, int(n), True) for i, n in enumerate(np.diff(np.append(-1, at)) - 1)]
        if at[-1] < 2999:
            want.append((file, len(at), int(2999 - at[-1]), False))
        rows += [(file, b, len(x), x.tobytes()) for b, x in enumerate(np.split(ids, range(64, 3000, 64)))]
    token_count.RUN, was = 5, token_count.RUN
    try:
        same(token_count.count_tokens(spark.createDataFrame(rows, token_count.BLOCKS), eod), want)
    finally:
        token_count.RUN = was


def test_token_files(spark, tmp_path):
    np.array([5, 6, 1, 9, 1, 4], "<u2").tofile(tmp_path / "x.bin")
    got = token_count.count_tokens(token_count.read_blocks(spark, str(tmp_path), block_ids=2), 1)
    assert [tuple(x) for x in got.select("ordinal", "n_tokens", "complete").orderBy("ordinal").collect()] == [(0, 2, True), (1, 1, True), (2, 1, False)]


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([ -]?[0-9])+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}


def plain_base(t):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, t):
            digits = re.sub("[^0-9]", "", m[0])
            total = sum(int(x) if i % 2 == 0 else sum(divmod(2 * int(x), 10)) for i, x in enumerate(digits[::-1]))
            ok = {"email": True, "ip": all(int(x) < 256 for x in m[0].split(".")) if kind == "ip" else 0, "card": 16 <= len(digits) <= 19 and total % 10 == 0, "phone": 8 <= len(digits) <= 15}
            if ok[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


ODD = [
    "a@b.c x@y z@@w.de .é@q.r..s a@b.c@d.e.f 1@2.3", "1.2.3.4.5.6.7.8.9 256.1.1.1 0001.02.3.255 1.2.3", "4111 1111-1111 1111 4111111111111112 4111  1111",
    "+1 (234) 555-6789 +49.30.1234567) +1 +12 +1((((((((2", "+1+2 345 67 89+", "é" * 5 + "x@y.zz 1.1.1.1", "5500005555555559123 60110000000000041",
]


def test_pii_base(spark, docs, rows):
    texts = [(i, t) for i, t in enumerate(ODD)] + rows
    same(pii.scan_pii(docs.select("doc_id", "text").union(spark.createDataFrame(texts[: len(ODD)], "doc_id long, text string"))).select("doc_id", "base_sha256"), [(d, sha(plain_base(t or ""))) for d, t in texts])


@pytest.mark.parametrize(
    ("text", "kind", "span"),
    [
        ("ask john at example dot com today", "email", "john at example dot com"),
        ("ask john.doe [at] mail (dot) example {dot} org.", "email", "john.doe [at] mail (dot) example {dot} org"),
        ("ask jоhn@exаmple.com", "email", "jоhn@exаmple.com"),
        ("card ４１１１ １１１１ １１１１ １１１１ x", "card", "４１１１ １１１１ １１１１ １１１１"),
        ("call plus one five five five one two three four five six seven now", "phone", "plus one five five five one two three four five six seven"),
        ("host one nine two dot one six eight dot one dot two up", "ip", "one nine two dot one six eight dot one dot two"),
        ("call plus 1 555 123 4567 now", "phone", "plus 1 555 123 4567"),
        ("host 192 point 168 point 1 point 1 up", "ip", "192 point 168 point 1 point 1"),
        ("ask john at example dot nl today", "email", "john at example dot nl"),
        ("ask john  at  example.com today", "email", "john  at  example.com"),
        ("card 4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 one x", "card", "4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 one"),
        ("four one one one one one one one one one one one one one one one", "card", "four one one one one one one one one one one one one one one one"),
    ],
)
def test_pii_disguises(text, kind, span):
    base, every = pii.find_spans(text)
    assert not base[kind]
    a = text.index(span)
    assert (a, a + len(span)) in every[kind]


@pytest.mark.parametrize("text", ["he sat at the table and drew a dot", "one two three", "look at me dot", "look at the dot in it", "a (at) b", "x" * 9000 + " at "])
def test_pii_leaves_prose_alone(text):
    assert not any(pii.find_spans(text)[1].values())


def test_secrets_held_out(spark):
    import random

    r, rows, truth = random.Random(1), [], {}
    for i in range(600):
        secret = i % 3 == 0
        value = "".join(r.choice("0123456789abcdef") for _ in range(40)) if secret else r.choice(["4" + "".join(r.choice("0123456789") for _ in range(15)), f"chapter-of-the-book-{i}", f"version_number_{i}_of_many"])
        near = 'token = "' if secret and i % 2 else 'value is "'
        rows.append((i, f"some words here {near}{value}\" and more words", f"s{i % 4}"))
        truth[i] = secret
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = secret_scan.find_candidates(d)
    train = {i for i in truth if i % 5}
    labels = spark.createDataFrame([(x["doc_id"], x["at"], float(truth[x["doc_id"]])) for x in found.collect() if x["doc_id"] in train], "doc_id long, at int, label double")
    got = {x["doc_id"]: x["is_secret"] for x in secret_scan.scan_secrets(d, labels).collect()}
    held = [i for i in truth if i not in train]
    assert sum(got[i] == truth[i] for i in held) >= 0.95 * len(held)
    assert secret_scan.scan_secrets(d.limit(0)).count() == 0


def test_secrets_all_of_a_word(spark):
    """All runs of a word, of any length, with their own lead; a digit elsewhere in the word is none of the run's."""
    a, b, long = "a1" * 10, "b2" * 10, "Zz9/" * 300
    texts = [f'x {{"token":"{a}","id":"{b}"}} y', long, "my-long-hostname-here.example.com/ABCDEF0123456789abcdef", f"AWS_SECRET_ACCESS_KEY={a}", f"?q=1&auth={a}&n={a}", f"{a}=="]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = secret_scan.find_candidates(d)
    assert sorted((x["doc_id"], x["lead"], x["value"]) for x in found.collect()) == [
        (0, '","id":"', b), (0, '{"token":"', a), (1, "", long), (2, ".example.", "com/ABCDEF0123456789abcdef"),
        (3, "AWS_SECRET_ACCESS_KEY=", a), (4, "&n=", a), (4, "?q=1&auth=", a), (5, "", a + "=="),
    ]
    labels = {(x["doc_id"], x["nth"]): x["label"] for x in secret_scan.label_by_assignment(found).collect()}
    assert labels[3, 0] == 1 and labels[0, 0] == 1 and (0, 1) not in labels
    assert secret_scan.scan_secrets(d).count() == 8


def test_secrets_candidates_against_regular_expressions(docs, rows):
    """Candidates of the table with nulls, odd and very long texts, by Python's own expressions."""
    want = []
    for d, t in rows:
        for word in WORD.findall(t or ""):
            for m in re.finditer(r"(?:-*[A-Za-z_][A-Za-z0-9_-]*=(?=[A-Za-z0-9+/_-][A-Za-z0-9+/_=-]{15}))?([A-Za-z0-9+/_=-]{16,})", word):
                if re.search("[0-9]", m[1]):
                    want.append((d, m[1]))
    same(secret_scan.find_candidates(docs).select("doc_id", "value"), want)
    assert secret_scan.scan_secrets(docs).count() == len(want)


def test_secrets_in_very_long_words(spark):
    """A word of a megabyte, of one run or of very many, is read in a time that grows with its length."""
    import random
    import time

    r = random.Random(9)
    dotted = ".".join("".join(r.choice("0123456789abcdef") for _ in range(20)) for _ in range(50_000))
    blob = "".join(r.choice("ABCDEFabcdef0123456789+/") for _ in range(1_000_000))
    d = spark.createDataFrame([(0, dotted), (1, blob), (2, "plain words of a text")], "doc_id long, text string")
    began = time.time()
    found = secret_scan.find_candidates(d).groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.length("value")).alias("most"), F.max("lead").alias("lead"))
    assert {tuple(x) for x in found.collect()} == {(0, 50_000, 20, "."), (1, 1, 1_000_000, "")}
    assert secret_scan.scan_secrets(d).count() == 50_001
    words = spark.createDataFrame([("abc", 10), ("bca", 30)], "word string, n long")
    values = spark.createDataFrame([(b"a", "abX-ca"), (b"b", blob)], "digest binary, value string")
    table = {x["pair"]: x["p"] for x in secret_scan.transitions(words).collect()}
    got = {bytes(x["digest"]): x["transition"] for x in secret_scan.string_features(values, words, secret_scan.Settings()).collect()}
    for key, value in ((b"a", "abx-ca"), (b"b", blob.lower())):
        want = [table.get(value[i : i + 2], -9.0) for i in range(len(value) - 1)]
        assert abs(got[key] - sum(want) / len(want)) < 1e-9
    assert time.time() - began < 60


def test_secrets_without_reviewed_labels(spark):
    """What a place settles elsewhere is told from the string alone: secrets that nothing names, and names of files."""
    import random

    r, rows, truth = random.Random(3), [], {}
    for i in range(400):
        secret, named = i % 2 == 0, i % 3 > 0
        value = "".join(r.choice("0123456789abcdef") for _ in range(40)) if secret else f"chapter-of-the-book-{i}"
        rows.append((i, f"some words {'token: ' if secret and named else 'of: ' if not named else ''}{value} and more"))
        truth[i] = secret
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x["doc_id"]: x["is_secret"] for x in secret_scan.scan_secrets(d).collect()}
    unnamed = [i for i in truth if i % 3 == 0]
    assert sum(got[i] == truth[i] for i in unnamed) >= 0.95 * len(unnamed)


BIG = 2**53 + 1


def test_large_ids_beside_nulls(spark):
    """Batches with a null id leave the others as they are."""
    prose = [" ".join(f"w{i}x{j}" for j in range(60)) for i in range(3)]
    rows = [(BIG, prose[0]), (None, prose[1]), (BIG + 2, prose[0]), (BIG + 4, prose[2]), (None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    want = sorted((x[0] for x in rows), key=repr)
    bench = spark.createDataFrame([(1, prose[0][:80])], "item_id long, text string")
    for out in (
        near_dedup.near_components(d), pii.scan_pii(d), packing.pack(d, PATH).where("start = 0"), token_count.count_documents(d, PATH, 49407),
        decontaminate.contamination_report(d, bench), substring_dedup.dedup_substrings(d),
    ):
        assert sorted((x["doc_id"] for x in out.collect()), key=repr) == want, out.columns
    left = near_dedup.dedup_near(d)
    assert sorted((x["doc_id"] for x in left.collect()), key=repr) == sorted((BIG, BIG + 4, None, None), key=repr)
    assert {x["component_id"] for x in near_dedup.near_components(d).collect()} == {BIG, BIG + 4, None}


def test_near_dedup_repeated_ids(spark):
    """Rows that share an id are judged by their own texts; of rows that share id and text, one stays."""
    a, b, x = (" ".join(f"{p}{j}" for j in range(60)) for p in "abx")
    rows = [(1, a), (2, a), (2, b), (3, x), (3, x), (4, b + " more")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"k": F.lit("clash"), "row": F.lit(1)})
    left = near_dedup.dedup_near(d)
    assert left.columns == d.columns
    assert (1, a) in [x[:2] for x in left.collect()] and sorted(x["doc_id"] for x in left.collect()).count(3) == 1


def test_url_filter(spark):
    urls = [None, "no scheme", "HTTP://A.Example.COM/en/7x?q#f", "x://y://z/en/", "http://b.org/es/1", "http://c.net#/de/", "http://c.net/de/81", "http://example.net/de/81/", "http://com/en/9", "http://xcom/en/9", "http://é.com/en/\n8"]
    d = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls + urls)], "page_id long, url string, host string")
    got = {x["row"]["page_id"]: x for x in url_filter.filter_urls(d).collect()}
    assert [(got[i]["host"], got[i]["path"], got[i]["rule"]) for i in range(len(urls))] == [
        ("", "", None), ("", "", None), ("a.example.com", "/en/7x", "example.com/en/7"), ("y:", "//z/en/", None), ("b.org", "/es/1", "org/es/"), ("c.net", "", None),
        ("c.net", "/de/81", "net/de/"), ("example.net", "/de/81/", "example.net/de/8"), ("com", "/en/9", "com/en/"), ("xcom", "/en/9", None), ("é.com", "/en/\n8", "com/en/"),
    ]
    assert got[2]["verdict"] == "allow" and got[4]["verdict"] == "block"
    assert len(got) == 2 * len(urls) and url_filter.filter_urls(d.limit(0)).count() == 0


def test_templates_generalise_and_reject(spark):
    rows = [("h", f"/u/name{'abcdefghijklmnopqrstuvwxyz'[i % 26]}x/p{i}", "block" if i % 10 else "allow") for i in range(200)] + [("h", f"/ok/{i}", "allow") for i in range(50)]
    t = url_filter.templates(spark.createDataFrame(rows, "host string, path string, label string")).collect()
    assert {x["template"] for x in t} == {"/u/*/p*", "/ok/*"}
    purity = {x["template"]: x["purity"] for x in t}
    assert purity["/u/*/p*"] > 0.75 > purity["/ok/*"]


def test_families_against_a_regular_expression(spark):
    import itertools

    paths = ["", "/", "//", *("/".join(p) for n in (1, 2, 3, 4) for p in itertools.product(("", "a", "b*", "*c", "*"), repeat=n))]
    rows = spark.createDataFrame([(p,) for p in paths], "general string").select("general", url_filter.family(F.col("general"))).collect()
    assert {p: f for p, f in rows} == {p: re.sub(r"[^/*]+((?:/[^/]*\*[^/]*)*/?)\Z", r"?\1", p) for p in paths}


def test_urls_of_very_many_segments(spark):
    """Ten thousand segments, all literal, all numbers or half and half, in a time that grows with their number."""
    import time

    n = 10_000
    paths = ["/".join(f"s{chr(97 + i % 26)}" for i in range(n)), "/".join(str(i) for i in range(n)), "/".join(f"x/{i}" for i in range(n // 2))]
    d = spark.createDataFrame([(i, f"http://h{i}.org/{'es/' if i % 2 else ''}{p}") for i, p in enumerate(paths)], "page_id long, url string")
    began = time.time()
    got = {x["row"]["page_id"]: x for x in url_filter.filter_urls(d).collect()}
    assert [got[i]["verdict"] for i in range(3)][1] == "block" and got[1]["rule"] == "org/es/"
    assert got[0]["template"].count("/") == n and "*" in got[1]["template"]
    assert time.time() - began < 60


def test_empty_tables(spark, empty):
    assert substring_dedup.dedup_substrings(empty).count() == 0
    assert quality.quality_report(empty).count() == quality.filter_quality(empty).count() == 0
    assert near_dedup.near_components(empty).count() == near_dedup.dedup_near(empty).count() == 0
    assert line_dedup.dedup_lines(empty).count() == 0
    assert packing.pack(empty, PATH).count() == 0
    assert token_count.count_documents(empty, PATH, 49407).count() == 0
    assert pii.scan_pii(empty).count() == 0
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontaminate.decontaminate(empty, bench).count() == 0


def test_tokenizer_gives_the_librarys_ids():
    import random

    from sparkfactors.llm.tokens import WordTokenizer

    r = random.Random(2)
    parts = ["a", "é", "É", "É", "ß", "ŝ", ".", "!?", "'s", "'LL", "'", "|", "<|", "|>", "<|endoftext|>", "<|EndOfText|>", "7", "½", " ", "\x0b", "\n", " ", "\x1c", "Σ", "İ", "×", "the", "tion", "###", "_", "‍", "漢", "x" * 70]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(30))) for _ in range(1500)] + [""]
    for specials in (True, False):
        tok = WordTokenizer(PATH, specials=specials)
        for text, (ids, ends) in zip(texts, tok.encode_many(texts, 900), strict=True):
            assert ids.tolist() == tok.tokenizer.encode(text, add_special_tokens=False).ids, text
            assert all(0 < e <= len(ids) for e in ends)
