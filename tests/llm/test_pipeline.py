"""The whole pipeline against brute force, stage by stage and at its end."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline

WORD = re.compile("[^\x20\x09-\x0d]+")
ITEM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
BLANKS = " \t\n\x0b\x0c\r"


def lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def good(t):
    w, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n, chars = Counter(grams), sum(map(len, w))
    rep = len({j for i, g in enumerate(grams) if n[g] > 1 for j in range(i, i + 3)})
    return not (
        len(w) < 50 or 100 * rep > 50 * len(w) or not 2 * len(w) <= chars <= 20 * len(w) or 100 * len(re.findall(r"[#*$%&|<>]", t)) > 10 * len(w)
        or 100 * len(re.findall("[A-Z]", t)) > 50 * chars or 100 * (len(lines) - len(set(lines))) > 50 * len(t.split("\n"))
    )


def without_lines(docs):
    where = defaultdict(set)
    key = lambda x: lower(x.strip(BLANKS))
    for d, t in docs.items():
        for x in t.split("\n"):
            where[key(x)].add(d)
    gone = lambda x, d: len(key(x)) >= 40 and len(where[key(x)]) >= 5 and d != max(where[key(x)])
    return {d: "\n".join(x for x in t.split("\n") if not gone(x, d)) for d, t in docs.items()}


def first_of_groups(docs):
    sets = {}
    for d, t in docs.items():
        w = WORD.findall(lower(t))
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    group = {d: d for d in docs}
    for a in sorted(docs):
        for b in sorted(docs):
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((group[a], group[b]))
                group = {d: x if g == y else g for d, g in group.items()}
    return {d: t for d, t in docs.items() if group[d] == d}


def without_items(docs, items):
    phrases = set()
    for t in items:
        w = ITEM.findall(lower(t))
        phrases |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9) if w else 0)}
    out = {}
    for d, t in docs.items():
        at = list(ITEM.finditer(lower(t)))
        w = [m[0] for m in at]
        hit = {j for k in {len(p) for p in phrases} for i in range(len(w) - k + 1) if tuple(w[i : i + k]) in phrases for j in range(i, i + k)}
        text, last = "", 0
        for j in sorted(hit):
            if j - 1 not in hit:
                text += t[last : at[j].start()] + "\n"
            last = at[j].end() if j in hit else last
        out[d] = text + t[last:]
    return out


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{path}/documents.parquet")
    long = sorted(r["text"] for r in docs.where("text IS NOT NULL").collect() if 60 < len(r["text"].split()) < 140)
    bench = [(i, "; ".join(t.split()[20:45]).title()) for i, t in enumerate(long[::3])]
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, [t for _, t in bench]


def test_stages_and_run(spark, folder):
    path, items = folder
    df = spark.read.parquet(f"{path}/documents.parquet")
    want = {r["doc_id"]: r["text"] for r in df.collect()}
    steps = [lambda d: {k: t for k, t in d.items() if good(t or "")}, without_lines, first_of_groups, lambda d: without_items(d, items)]
    assert [n for n, _ in corpus_pipeline.STAGES][-1] == "packing" and len(corpus_pipeline.STAGES) == 5
    for (name, stage), step in zip(corpus_pipeline.STAGES, steps, strict=False):
        before, want = want, step(want)
        assert want and want != before, name
        df = stage(spark, df, path)
        assert df.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert {r["doc_id"]: r["text"] for r in df.collect()} == want, name
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {d: [*tok.encode(t, add_special_tokens=False).ids, 1] for d, t in want.items()}
    end, seqs = Counter(), Counter()
    for p in sorted(corpus_pipeline.run(spark, path).collect(), key=lambda p: (p["doc_id"], p["start"])):
        part = ids[p["doc_id"]][p["start"] : p["start"] + p["length"]]
        assert p["start"] == end[p["doc_id"]] and p["doc_tokens"] == len(ids[p["doc_id"]])
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == p["ids_crc32"] and len(part) == p["length"]
        end[p["doc_id"]] += p["length"]
        seqs[p["sequence_id"]] += p["length"]
    assert end == {d: len(x) for d, x in ids.items()} and max(seqs.values()) <= 2048

