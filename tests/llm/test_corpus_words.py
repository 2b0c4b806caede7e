"""op11, op12 and op13 against brute force, and on hard rows."""

import math
import re
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from claimspark.llm import collocations, quality, queries, variants
from claimspark.llm.common import buffers, span_hashes, words
from tests.llm.test_ids import HARD, documents

EXTRA = "doc_id bigint, text string, lang string, source string, n bigint, word string, near string, key string, part string, trusted string"


def hard_rows(spark, texts=()):
    """The hard rows of the other tests, rows without an id, repeated ids and texts, a very long word and text, and columns named like the operators' own."""
    rows = [(r[0], r[1], r[2]) for r in HARD] + [(None, "gläserner Vorhang", None), (None, "gläserner Vorhang", "de"), (None, None, None), (9, "", "en"), (8, "x" * 40_000 + " " + "a b " * 30_000, "fr"), (8, "x" * 40_000, "fr"), (12, "x" * 39_999, "fr"), (12, "x" * 39_999, "fr")]
    rows += [(100 + k, t, "en") for k, t in enumerate(texts)]
    return rows, spark.createDataFrame([(*r, "s", 1, "w", "n", "k", "p", "t") for r in rows], EXTRA)


def brute_words(rows):
    count = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % 31 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            count[word] += 1
    return {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}


def brute_variants(rows):
    """Near words by the words that lack one code point, or have a gap in its place."""
    words, gaps, near = brute_words(rows), defaultdict(set), defaultdict(set)
    for w in words:
        if len(w) < 1_000:
            for i in range(len(w)):
                gaps[w[:i] + "\0" + w[i + 1 :]].add(w)
                if (short := w[:i] + w[i + 1 :]) in words:
                    near[w].add(short)
                    near[short].add(w)
        else:
            near[w] |= {v for v in words if abs(len(v) - len(w)) == 1 and set(v) == set(w)}
    for alike in gaps.values():
        for w in alike:
            near[w] |= alike - {w}
    best = {w: min(near[w], key=lambda v: (-words[v], v.encode())) for w in words if near[w]}
    form = {w: v for w, v in best.items() if words[v] >= 10 * words[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return {(w, form.get(w), root(w), n, len(near[w]), words.get(form.get(w))) for w, n in words.items()}


def test_op11_against_brute_force(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = queries.op11_trie_frontier_variants(spark, sf_dir).collect()
    expected = brute_variants([(d["doc_id"], d["text"]) for d in documents(spark, sf_dir)])
    assert len(rows) == len(expected) and {tuple(r) for r in rows} == expected
    assert any(r.form != r.root and r.form for r in rows) or any(r.form for r in rows)


def test_op11_chains_and_hard_rows(spark):
    texts = ["straight " * 2, "straightx " * 30 + "straightxy " * 400, "abcdefgh abcdefgi " * 3, "abcdefg " * 50, "Zürichsee ZÜRICHSEE zürichsee " * 2, "zurichsee " * 60, "aaaaaaa aaaaaaaa aaaaaaaaa " * 4, "prefix" + "q" * 30 + " ", "haveing having naïvely naïvelys " * 2]
    rows, frame = hard_rows(spark, texts)
    found = variants.variants(frame).collect()
    assert len(found) == len({r.word for r in found}) and {tuple(r) for r in found} == brute_variants(rows)
    root = {r.word: r.root for r in found}
    assert root["straight"] == "straightxy" and any(len(w) > 39_000 for w in root)
    assert variants.variants(frame.limit(0)).collect() == []


def test_op11_ranges_cut_through_tries(spark):
    """Words that begin or end alike, dealt to many ranges."""
    texts = [" ".join(f"stem{a}{b}{c}tail" for b in "abcdef" for c in "abcdef") for a in "abcdef"]
    rows, frame = hard_rows(spark, texts * 2)
    spark.conf.set("spark.sql.shuffle.partitions", 23)
    try:
        assert {tuple(r) for r in variants.variants(frame).collect()} == brute_variants(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def brute_collocations(rows, longest=3, least=10, share=50, first=2000):
    count, total = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if c.isascii() else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            words = re.findall("[^ \t]+", piece)
            total[lang] += len(words)
            for n in range(1, longest + 1):
                for i in range(len(words) - n + 1):
                    count[lang][tuple(words[i : i + n])] += 1
    out = set()
    for lang, f in count.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        gone = {p[i:j] for p, a in candidates.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and 100 * a >= share * f[p[i:j]]}
        ranked = []
        for p, a in candidates.items():
            if p not in gone:
                score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                ranked.append((-score, -a, " ".join(p).encode(), " ".join(p), a, f[p[:k]], f[p[k:]], score))
        out |= {(lang, k, phrase, a, l, r, total[lang], score) for k, (_, _, _, phrase, a, l, r, score) in enumerate(sorted(ranked)[:first], 1)}
    return out


@pytest.mark.parametrize("longest", [2, 3, 4])
def test_op12_of_hard_rows(spark, monkeypatch, longest):
    """With few counts to a task, so that tasks begin within the phrases of a word."""
    texts = ["the the the the of the of the. In the end, of course! Of course, of all of it\tof  course;of course:x" * 3, "New York city in New York; new york city" * 12, "a b c d e " * 20, "a b c d. a b c d. x b c y. " * 9, "Ünder ünder ünder " * 11, "z\x01 z z\x01 z " * 8]
    rows, frame = hard_rows(spark, texts)
    monkeypatch.setattr(collocations, "TASK_COUNTS", 7)
    monkeypatch.setattr(collocations, "SAMPLED", 4)
    found = collocations.collocations(frame, longest=longest).collect()
    assert {tuple(r) for r in found} == brute_collocations(rows, longest)
    assert len(found) == len({(r.lang, r.rank) for r in found}) and {r.lang for r in found} >= {"en", "und"} - {"und"}
    assert collocations.collocations(frame.limit(0), longest=longest).collect() == []


def test_op12_many_buckets_and_tasks(spark, monkeypatch):
    sf_dir = "/root/testdata/sf0.001"
    rows = [(d["doc_id"], d["text"], d["lang"]) for d in documents(spark, sf_dir)]
    monkeypatch.setattr(collocations, "TASK_COUNTS", 60)
    monkeypatch.setattr(collocations, "BUCKET_BYTES", 20_000)
    monkeypatch.setattr(collocations, "CELL_KEYS", 1)
    found = queries.op12_ordered_stream_collocations(spark, sf_dir).collect()
    assert {tuple(r) for r in found} == brute_collocations(rows)


def test_op12_exact_beyond_64_bits():
    row = [0, ("en", "a", "b"), True, 3 * 10**12, False, [5 * 10**12], 0]
    out = list(collocations.merged(iter([(0, ("en", "a"), True, 4 * 10**12, False, []), tuple(row[:6])]), lambda r, s: (r[1], r[3], [x[3] for x in s], r[6])))
    assert out == [(("en", "a", "b"), 3 * 10**12, [4 * 10**12], 0), (("en", "a"), 4 * 10**12, [], 3 * 10**12)]
    assert collocations.SCALE * out[0][1] ** 2 // (4 * 10**12 * 5 * 10**12) == 450_000


def brute_rules(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = defaultdict(list)
    for i in range(len(words) - 4):
        windows[tuple(words[i : i + 5])].append(i)
    again = {j for places in windows.values() if len(places) > 1 for i in places for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 10 or 100 * len(again) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(again), failed


def test_op13_base_and_labels(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = queries.op13_target_likelihood(spark, sf_dir).collect()
    docs = {d["doc_id"]: d["text"] for d in documents(spark, sf_dir)}
    assert len(rows) == len(docs) and all(tuple(r)[1:7] == brute_rules(docs[r.doc_id]) for r in rows)
    assert not any(r.kept and r.base_failed for r in rows)
    good = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rest = [(r.kept, good[r.doc_id]) for r in rows if r.doc_id in good and not r.base_failed]
    assert sum(k for k, q in rest if q) >= 0.98 * sum(q for _, q in rest)
    assert sum(r.score for r in rows if good.get(r.doc_id) == 1) / sum(v == 1 for v in good.values()) > sum(r.score for r in rows if good.get(r.doc_id) == 0) / sum(v == 0 for v in good.values())


def test_op13_of_hard_rows(spark):
    texts = ["one two three four five six seven eight nine ten\nsame line\n\nsame line\n \nsame line", "a b c d e a b c d e", "# * $ % & | < > é x y", "\n\n\n", "w " * 11, "same\r\nsame\nsame\r\nsame"]
    rows, frame = hard_rows(spark, texts)
    labels = spark.createDataFrame([(100, 1, 0), (100, 0, 0), (101, 1, 0), (None, 1, 0), (8, None, 1)], "doc_id bigint, quality int, toxic int")
    found = quality.assess(frame, quality.fit(frame, labels)).collect()
    assert Counter(tuple(r)[:7] for r in found) == Counter((r[0], *brute_rules(r[1])) for r in rows)
    nothing = quality.fit(frame.limit(0), labels.limit(0))
    assert all(r.kept != r.base_failed and r.score == 0 for r in quality.assess(frame, nothing).collect())
    assert quality.assess(frame.limit(0), nothing).collect() == []


def test_op13_scores_against_brute_force(spark):
    """Few buckets, so that n-grams share them; the ratio of smoothed shares, averaged over a document's n-grams."""
    texts = {k: " ".join(("alpha beta gamma delta" if k % 3 else "junk&& noise%%").split()[(k * j) % 2] for j in range(12 + k)) for k in range(30)}
    frame = spark.createDataFrame([*texts.items()], "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, 1 if k % 3 else 0) for k in texts], "doc_id bigint, quality int")
    known = {r.doc_id: (r.trusted, r.held) for r in quality.with_trust(frame, labels).collect()}
    model = quality.fit(frame, labels, buckets=7)
    grams = {}
    for k, text in texts.items():
        data, at = buffers(pa.array([text]))
        starts, ends, offsets = words(data, at)
        h = span_hashes(data, starts, ends)
        grams[k] = {n: quality._grams(h, offsets, 7, n)[0].tolist() for n in quality.GRAMS}
        assert [len(grams[k][n]) for n in quality.GRAMS] == [len(starts), len(starts) - 1]
    ratio = {}
    for n in quality.GRAMS:
        raw, target = Counter(b for k in texts for b in grams[k][n]), Counter(b for k in texts if known[k][0] for b in grams[k][n])
        for b in range(7):
            ratio[n, b] = math.log((target[b] + 0.5) / (sum(target.values()) + 3.5)) - math.log((raw[b] + 0.5) / (sum(raw.values()) + 3.5))
    for r in quality.assess(frame, model).collect():
        assert r.score == pytest.approx(sum(sum(ratio[n, b] for b in grams[r.doc_id][n]) / len(grams[r.doc_id][n]) for n in quality.GRAMS) / 2)
        assert r.kept == (not r.base_failed and r.score >= model.threshold)
    assert any(h for _, h in known.values()) and not any(t and h for t, h in known.values())


def test_op13_takes_every_trusted_document(spark):
    """More of them than any limit there was: each is counted into the target or held, and the target's counts are those of all."""
    docs = spark.range(120_000).selectExpr("id as doc_id", "concat('w', id % 7, ' v', id % 3) as text")
    labels = spark.range(120_000).selectExpr("id as doc_id", "cast(id % 8 > 0 as int) as quality")
    known = {(r.trusted, r.held): (r.n, r.w) for r in quality.with_trust(docs, labels).groupBy("trusted", "held").agg(F.count("*").alias("n"), F.sum(F.expr("doc_id % 7 = 0").cast("int")).alias("w")).collect()}
    assert known[True, False][0] + known[False, True][0] == 105_000 and known[False, False][0] == 15_000
    (n, w), b = known[True, False], 1 << 12
    ratio = quality.fit(docs, labels, buckets=b).ratio[1]
    data, at = buffers(pa.array(["w0"]))
    bucket = quality._grams(span_hashes(data, at[:1], at[1:]), at[[0, 0]] + [0, 1], b, 1)[0][0]
    assert ratio[bucket] == pytest.approx(math.log((w + 0.5) / (2 * n + b / 2)) - math.log((17_143 + 0.5) / (240_000 + b / 2)))


def test_quantiles_are_exact(spark):
    values = [math.sin(k * k) for k in range(30_000)] + [0.25] * 9_000
    frame = spark.createDataFrame([(v,) for v in values], "score double").repartition(7)
    ordered, shares = sorted(values), [0.0, 0.01, 0.5, 0.61803, 1.0]
    assert quality.quantiles(frame, shares) == [ordered[max(1, math.ceil(q * len(values))) - 1] for q in shares]
    assert quality.quantiles(frame.limit(0), shares) == []
