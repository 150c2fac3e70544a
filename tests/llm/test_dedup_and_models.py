"""Near duplicates, lines, benchmark passages, BPE and the pipeline against brute force."""

import collections
import hashlib
import pathlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quaylight.llm import bpe, common, cumulative_link, decontaminate, embedding_dedup, line_dedup, minhash_dedup

DOCS = "doc_id long, text string, n int, h string, component_id int"
WORDS = [f"w{i}" for i in range(400)]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, 1, "x", 2) for i, t in texts], DOCS)


def components(nodes, linked):
    up = {n: n for n in nodes}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    for a in nodes:
        for b in nodes:
            if a < b and top(a) != top(b) and linked(a, b):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return {n: top(n) for n in nodes}


def families(rng, n_families, copies, words):
    out = []
    for _ in range(n_families):
        base = [rng.choice(WORDS) for _ in range(words)]
        out.append(" ".join(base))
        for _ in range(copies):
            new = [rng.choice(WORDS) if rng.random() < rng.choice([0, 0.005, 0.02]) else w for w in base]
            out.append(" ".join(new))
    return out


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


@pytest.mark.parametrize("percent", [80, 85])
def test_minhash_dedup(spark, percent, monkeypatch):
    rng = random.Random(percent)
    texts = [None, "", " \n", "a b", "A\tb", "a b c d e", "\x0b", "İ é", *families(rng, 8, 7, 150), *families(rng, 6, 5, 12)]
    monkeypatch.setattr(minhash_dedup, "BUCKET_BLOCK", 3)  # buckets and clusters of several blocks
    monkeypatch.setattr(minhash_dedup, "CLUSTER_BLOCK", 400)
    rows = list(enumerate(texts)) + [(20, texts[20]), (None, texts[20])]
    got = minhash_dedup.near_duplicates(frame(spark, rows), percent).collect()
    sets = {i: shingles(t) for i, t in enumerate(texts)}
    want = components(list(sets), lambda a, b: bool(sets[a] and sets[b]) and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]))
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is not None) == sorted([(i, len(sets[i]), want[i], want[i] == i) for i in sets] + [(20, len(sets[20]), want[20], want[20] == 20)])
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]
    assert minhash_dedup.near_duplicates(frame(spark, []), percent).count() == 0


def test_sketches_estimate_and_merge():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**63, 1000).astype(np.uint64)
    a, b = x[:900], x[100:]
    whole = np.maximum(minhash_dedup.sketch(a, 512), minhash_dedup.sketch(b, 512))
    assert (whole == minhash_dedup.sketch(x, 512)).all()
    u, v = (minhash_dedup.sketch(s, 512).astype(int) for s in (a, b))
    ask = lambda low: minhash_dedup.may_reach(low, (u > v).sum(), (u < v).sum(), (u == v).sum(), np.array(900.0), np.array(900.0))
    assert ask(0.7) and not ask(0.9)  # the similarity is 0.8


def test_embedding_dedup(spark, monkeypatch):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(12, 16))
    rows = [(i, (base[i % 12] * rng.uniform(0.5, 2) + rng.normal(size=16) * rng.choice([0.0, 0.1, 0.25])).astype(np.float32).tolist()) for i in range(150)]
    rows += [(200 + i, rows[i][1]) for i in range(20)]
    odd = [(300, None), (301, []), (302, [0.0] * 16), (303, [None] * 16), (304, [float("nan")] * 16), (305, [float("inf")] + [0.0] * 15), (306, rows[0][1][:8]), (307, [1e-30] * 16), (308, [3e38] * 16)]
    monkeypatch.setattr(embedding_dedup, "BLOCK_BYTES", 16 * 8 * 20)
    monkeypatch.setattr(embedding_dedup, "LEAF", 4)
    df = spark.createDataFrame([(i, v, 0, 1) for i, v in rows + odd + [(None, rows[0][1])]], "vec_id long, embedding array<float>, label int, n int")
    got = embedding_dedup.near_duplicates(df).collect()
    m = {i: np.array(v, np.float32).astype(float) for i, v in rows + odd[-3:]}
    unit = {i: v / np.abs(v).max() / np.linalg.norm(v / np.abs(v).max()) for i, v in m.items()}
    near = lambda a, b: a in unit and b in unit and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.95
    ids = [i for i, _ in rows + odd]
    want = components(ids, near)
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got if r.vec_id is not None) == sorted((i, sum(near(i, j) for j in ids if j != i), want[i], want[i] == i) for i in ids)
    assert [(r.n_links, r.component_id, r.kept) for r in got if r.vec_id is None] == [(0, None, True)]
    assert embedding_dedup.near_duplicates(df.where("vec_id < 0")).count() == 0


def test_blocks_of_vectors_arent_written_for_each_pair(spark, monkeypatch):
    """With many blocks that all meet, an exchange of pairs with their vectors grew with the square of the input."""
    monkeypatch.setattr(embedding_dedup, "BLOCK_BYTES", 16 * 8 * 20)
    plans, whole = {}, embedding_dedup.materialize
    monkeypatch.setattr(embedding_dedup, "materialize", lambda df, tag: plans.update({tag: df._jdf.queryExecution().sparkPlan().toString()}) or whole(df, tag))
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(400, 16)))], "vec_id long, embedding array<double>")
    assert embedding_dedup.near_duplicates(df).where("n_links = 0 and kept").count() == 400
    assert "CartesianProduct" in plans["found"] and "Exchange" not in plans["found"] and "HashJoin" not in plans["found"] and "SortMergeJoin" not in plans["found"]


def test_decontamination(spark):
    rng = random.Random(4)
    some = lambda n: [rng.choice(WORDS[:60]) for _ in range(n)]
    items = [some(25), some(13), some(4), some(30), ["é", "w1"]]
    texts = [None, "", "... !", " ".join(some(3000)), " ".join(items[2]), " ".join(items[0][3:16]), " ".join(items[0]).upper(), "É w1, é-W1"]
    for _ in range(60):
        it = rng.choice(items)
        k = rng.randint(0, max(0, len(it) - 13))
        texts.append(rng.choice([" ", ", ", "\n"]).join([*some(rng.randint(0, 300)), *it[k : k + rng.randint(12, 20)], *some(rng.randint(0, 300))]))
    bench = spark.createDataFrame([(i, " ".join(w), 0) for i, w in enumerate(items)] + [(9, None, 0), (10, "--", 0), (None, texts[3], 0), (11, " ".join(items[1]), 0)], "item_id long, text string, doc_id int")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    wins = {(str(i), tuple(w[k : k + 13])) for i, w in [*enumerate(items), (11, items[1])] for k in range(max(1, len(w) - 12))}
    want = []
    for i, t in [*enumerate(texts), (30, texts[30]), (None, texts[6])]:
        w, hit, found = words(t), set(), set()
        for item, win in wins:
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    found.add(item)
        want.append((str(i), len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    df = frame(spark, [*enumerate(texts), (30, texts[30]), (None, texts[6])])
    for limit in (100_000, 1):  # both ways to join
        got = decontaminate.contamination(df, bench, broadcast_windows=limit).drop("h").collect()
        assert sorted((str(r.doc_id), *r[1:]) for r in got) == sorted(want)
    clash = df.withColumns({c: F.lit(i) for i, c in enumerate(("_d", "_h", "key0", "row", "gone0"))})
    gone = decontaminate.decontaminated(clash, bench)
    assert gone.columns == clash.columns and sorted(str(r.doc_id) for r in gone.collect()) == sorted(w[0] for w in want if not w[-1])
    kept = decontaminate.decontaminated(df, bench)
    assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(w[0] for w in want if not w[-1])
    assert decontaminate.contamination(frame(spark, []), bench).count() == 0
    assert decontaminate.contamination(df, bench.where("item_id < 0")).where("n_hit > 0 or contaminated").count() == 0


def differing_bits(a, b):
    """Bits in which the fingerprints of two word lists differ; up to three are found for certain."""
    xxhash = pytest.importorskip("xxhash")
    prints = []
    for words in (a, b):
        hashes = [xxhash.xxh64(w.encode(), seed=42).intdigest() for w in words]
        prints.append(sum((sum(h >> i & 1 for h in hashes) > len(words) // 2) << i for i in range(64)))
    return (prints[0] ^ prints[1]).bit_count()


def test_line_dedup(spark):
    rng = random.Random(5)
    line = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    shared, passage = line(9), line(60)
    fuzzy = next(w for k in range(60) if differing_bits(passage.split(), w := [*passage.split()[:k], "changed", *passage.split()[k + 1 :]]) <= 3)
    texts = [None, "", "\n\n", "a b\na b", f"{shared}\n{line(8)}", f"  {shared.upper()} \nshort one\n{line(7)}", f"{line(20)}\n{passage}", f"{line(12)}\n{' '.join(fuzzy)}", shared, "short one", " ".join(["long"] * 20_000) + "\nx", " ".join(["long"] * 20_000), line(6) + "\r"]
    rows = [*enumerate(texts), (4, texts[4]), (None, texts[12])]
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.dropped) for r in line_dedup.decisions(frame(spark, rows)).collect()}
    want = {i: (0 if t is None else t.count("\n") + 1, 0, "") for i, t in enumerate(texts)}
    want |= {5: (3, 1, "0"), 7: (2, 1, "1"), 8: (1, 1, "0"), 11: (1, 1, "0"), 12: (1, 1, "0"), None: (1, 0, "")}
    assert got == want
    kept = line_dedup.deduplicated(frame(spark, rows))
    said = {r.doc_id: r.text for r in kept.collect()}
    assert kept.columns == frame(spark, []).columns
    assert set(said) == {i for i, _ in rows} - {8, 11, 12}
    assert said[5] == texts[5].split("\n", 1)[1] and said[7] == texts[7].split("\n")[0] and said[4] == texts[4] and said[0] is None and said[1] == ""
    assert line_dedup.decisions(frame(spark, [])).count() == 0


def test_lines_with_a_changed_word_are_found(spark):
    """Of lines of 60 words with one changed word, most share a bucket and are linked; different lines never are."""
    rng = random.Random(6)
    pairs = []
    for _ in range(100):
        a = [rng.choice(WORDS) for _ in range(60)]
        b = list(a)
        b[rng.randrange(60)] = "other"
        pairs += [" ".join(a), " ".join(b)]
    got = line_dedup.decisions(frame(spark, enumerate(pairs))).where("n_dropped > 0").collect()
    assert all(r.doc_id % 2 for r in got) and len(got) >= 70


def edited(rng, words, edits):
    words = list(words)
    for at in sorted(rng.sample(range(len(words)), edits), reverse=True):
        kind = rng.randrange(3)
        words[at : at + 1] = [[f"new{rng.randrange(10**9)}"], [], [words[at], f"new{rng.randrange(10**9)}"]][kind]
    return words


def word_distance(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(last[j] + 1, now[-1] + 1, last[j - 1] + (x != y)))
        last = now
    return last[-1]


def dropped_by_brute_force(texts):
    """The numbers of the one-line texts that are not the first of their group of linked texts; lines under five words stay."""
    words = [t.split() for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            n = max(len(words[i]), len(words[j]))
            if min(len(words[i]), len(words[j])) >= 5 and abs(len(words[i]) - len(words[j])) <= n // 5 and word_distance(words[i], words[j]) <= n // 5:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i for i in range(len(texts)) if find(i) != i}


def test_line_dedup_finds_every_pair_of_the_similarity(spark):
    """Lines with as many changed words as 0.8 allows, and one more, against all pairs."""
    rng = random.Random(8)
    texts = []
    for n in [*range(5, 31), 40, 59, 60, 61]:
        for over in (0, 0, 1):
            a = [rng.choice(WORDS) for _ in range(n)]
            texts += [" ".join(a), " ".join(edited(rng, a, n // 5 + over))]
    got = {r.doc_id for r in line_dedup.decisions(frame(spark, enumerate(texts))).where("n_dropped > 0").collect()}
    want = dropped_by_brute_force(texts)
    assert got == want and 30 < len(want) < 90


@pytest.mark.parametrize("block", [line_dedup.BUCKET_BLOCK, 8])
def test_line_dedup_compares_all_of_a_bucket(spark, monkeypatch, block):
    """Small groups whose fingerprints are all equal, as the lines hold the same words, and that share a common piece."""
    monkeypatch.setattr(line_dedup, "BUCKET_BLOCK", block)
    rng = random.Random(9)
    texts = []
    for _ in range(40):
        a = WORDS[:20]
        rng.shuffle(a)
        b = [*a[:15], a[16], a[15], *a[17:]]
        texts += [" ".join([*"one piece of all".split(), *x]) for x in (a, b)]
    got = {r.doc_id for r in line_dedup.decisions(frame(spark, enumerate(texts))).where("n_dropped > 0").collect()}
    assert got == dropped_by_brute_force(texts) == set(range(1, 80, 2))


def test_line_dedup_links_very_long_lines(spark):
    """Lines too long for a fingerprint meet their near copies, with few edits and with nearly as many as 0.8 allows."""
    rng = random.Random(10)
    a, b = ([f"w{rng.randrange(5000)}" for _ in range(n)] for n in (20_000, 17_000))
    texts = [" ".join(x) for x in (a, edited(rng, a, 5), b, edited(rng, b, 3300), a[::-1])]
    got = {r.doc_id for r in line_dedup.decisions(frame(spark, enumerate(texts))).where("n_dropped > 0").collect()}
    assert got == {1, 3}


def test_line_dedup_splits_words_at_any_white_space(spark):
    texts = ["one\ttwo\tthree\tfour\tfive\tsix", "one\ttwo\tthree\tfour\tfive\tsix", "one\u3000two\u00a0three four five other"]
    got = {r.doc_id for r in line_dedup.decisions(frame(spark, enumerate(texts))).where("n_dropped > 0").collect()}
    assert got == {1, 2}


def test_copies_sent_more_than_once_dont_overflow_fingerprints(spark, monkeypatch):
    """Beyond what is broadcast, a line's copies all come to its class; sums over them overflowed from some 3,000 copies on."""
    monkeypatch.setattr(line_dedup, "SMALL_ROWS", 0)
    monkeypatch.setattr(line_dedup, "HOT_SHARE", 1.0)
    line = " ".join(f"word{i}" for i in range(25))
    df = spark.createDataFrame([(1, "\n".join([line] * 6000)), (2, line.replace("word7", "other"))], "doc_id long, text string")
    got = {r.doc_id: r.dropped for r in line_dedup.dropped_lines(df).collect()}
    assert got == {1: list(range(1, 6000)), 2: [0]}


def test_different_lines_with_a_common_passage_make_few_pairs(spark, monkeypatch):
    """Lines that only 128 bits of parities let pass are told apart before they make rows, whose number grew with the square of the lines."""
    rng = random.Random(11)
    passage = [rng.choice(WORDS) for _ in range(60)]
    lines = [[*(f"own{rng.randrange(10**9)}" for _ in range(26)), *passage] for _ in range(40)]
    texts = [" ".join(x) for x in (*lines, edited(rng, lines[3], 17), edited(rng, lines[5], 10))]
    rows, stored = {}, line_dedup.materialize

    def counted(df, tag):
        out = stored(df, tag)
        rows[tag] = out.count()
        return out

    monkeypatch.setattr(line_dedup, "materialize", counted)
    got = {r.doc_id for r in line_dedup.decisions(frame(spark, enumerate(texts))).where("n_dropped > 0").collect()}
    assert got == dropped_by_brute_force(texts) == {40, 41}
    assert rows["remaining"] <= len(texts)


def test_a_common_passage_gives_a_pair_once(spark, monkeypatch):
    """Not once for each of the passage's runs; the lines hold the same words, so that all pairs may be similar."""
    rng = random.Random(12)
    docs = frame(spark, enumerate(" ".join([*WORDS[100:114], *rng.sample(WORDS[:20], 20)]) for _ in range(10)))
    each = common.materialize(line_dedup.signatures(docs), "lines")
    classes = each.groupBy("k").agg(F.min(F.struct("doc_id", "h", "line_no")).alias("first"), F.count("*").alias("times"), F.min("low").alias("low"), F.min("high").alias("high"))
    kept = common.materialize(line_dedup.shared_runs(each, classes), "runs")
    early = kept.select("k", F.col("k").alias("component")).limit(0)
    said = line_dedup.said_by(docs, classes, kept.select("k"))
    monkeypatch.setattr(type(docs), "distinct", lambda self: self)
    rows = [(r.a, r.b) for r in line_dedup.remaining(kept, early, said).collect()]
    assert len(rows) == len(set(rows)) == 45


def test_runs_are_sent_once(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    each = common.materialize(line_dedup.signatures(docs), "lines")
    classes = common.materialize(each.groupBy("k").agg(F.min(F.struct("doc_id", "h", "line_no")).alias("first"), F.count("*").alias("times"), F.min("low").alias("low"), F.min("high").alias("high")), "classes")
    runs = line_dedup.shared_runs(each, classes)
    runs.collect()
    ran = runs._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert ran.count("posexplode(runs") == 1 and "ReusedExchange" in ran


def test_runs_are_sent_in_parts(spark, monkeypatch):
    """All runs at once took more disk than three times the input; the parts give the same rows, and the runs of lines go before the shared ones are ranked."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(300)
    tables, there, stored = [], {}, line_dedup.materialize

    def seen(df, tag):
        there[tag] = [pathlib.Path(x._scratch_path.removeprefix("file:")).exists() for t, x in tables if t == "lines"]
        out = stored(df, tag)
        if tag == "several":
            all_of[len(all_of)] = out.collect()
        if tag == "lines":
            classes = out.groupBy("k").agg(F.min(F.struct("doc_id", "h", "line_no")).alias("first"), F.count("*").alias("times")).cache()
            whole.extend(line_dedup.runs_of_several(line_dedup.sent_once(out, classes)).collect())
        tables.append((tag, out))
        return out

    whole, all_of = [], {}
    monkeypatch.setattr(line_dedup, "materialize", seen)
    line_dedup.dropped_lines(docs).collect()
    assert len(all_of) == line_dedup.PARTS > 1 and all(all_of.values())
    assert sorted(r for part in all_of.values() for r in part) == sorted(whole)
    keys = [{r.key for r in part} for part in all_of.values()]
    assert sum(map(len, keys)) == len(set().union(*keys))
    assert there["several"] == [True] and there["runs"] == [False]


def test_bpe_equals_the_library(spark):
    tokenizers, P = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    path = P.path("word_bpe_49k.json")
    library = tokenizers.Tokenizer.from_file(path)
    rng = random.Random(7)
    parts = [*"abzAZ09 '\t\n\x1c\x85\xa0é́ΣςßİſⅧ½一한🎉‍-_!?.<|>", "<|endoftext|>", "'LL", "don't", "the ", "<|ENDOFTEXT|>"]
    texts = [None, "", " ", "ab" * 3000, *["".join(rng.choice(parts) for _ in range(rng.randint(1, 40))) for _ in range(400)]]
    df = frame(spark, [*enumerate(texts), (None, texts[5]), (6, texts[6])])
    got = bpe.decode(bpe.encode(df, path), path).collect()
    assert len(got) == len(texts) + 2
    digests = {r.doc_id: r for r in bpe.round_trip_digests(df, path).collect()}
    checked = {r.doc_id: r for r in bpe.encode_and_check(df, path).collect()}
    for r in got:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        said = library.decode(ids, skip_special_tokens=False)
        assert list(r.token_ids) == ids == list(checked[r.doc_id].token_ids) and r.decoded == said
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert digests[r.doc_id][1:] == (len(ids), sha(" ".join(map(str, ids))), sha(said))
    assert bpe.round_trip_digests(frame(spark, []), path).count() == 0


def test_bpe_splits_every_code_point_as_the_library_does():
    """All code points among letters, signs and numbers, newer ones than our Unicode tables included."""
    tokenizers, P = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    path = P.path("word_bpe_49k.json")
    library, codec = tokenizers.Tokenizer.from_file(path), bpe.Codec(open(path, encoding="utf-8").read())
    stand = bpe.byte_characters()
    for a in [*range(0, 0xD800, 64), *range(0xE000, 0x34000, 64), *range(0xE0000, 0xE0200, 64)]:
        text = "\n".join(f"a{chr(c)}!{chr(c)}1" for c in range(a, a + 64))
        normal = library.normalizer.normalize_str(text)
        want = [w for w, _ in library.pre_tokenizer.pre_tokenize_str(normal)]
        assert ["".join(stand[b] for b in w.encode()) for w in codec.split(text)] == want, hex(a)


def test_cumulative_link_orders_grades(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(600):
        g = rng.choice([0, 0, 1, 2])
        words = [rng.choice(WORDS) for _ in range(30)] + {0: [], 1: ["badly"], 2: ["badly", "worse", "vileness"]}[g]
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, g, 1))
    rows += [(None, "badly worse vileness"), (700, None), (701, ""), (0, rows[0][1])]
    df, rated = frame(spark, rows), spark.createDataFrame(labels + [(None, 1, 1), (3, None, 1)], "doc_id long, toxic int, text int")
    train, test = rated.where("doc_id % 2 = 0 or doc_id is null"), dict((i, g) for i, g, _ in labels if i % 2)
    got = {r.doc_id: r for r in cumulative_link.graded(df, train, "toxic", "toxic").collect()}
    right = [round(got[i].expected_grade) == g for i, g in test.items()]
    assert sum(right) > 0.95 * len(right)
    assert got[None].expected_grade > 1.5 and got[700].expected_grade < 0.5 and 0 <= got[701].tail_probability < 0.5
    assert cumulative_link.toxicity(df, train.where("doc_id < 0")).where("toxic").count() == 0  # no labels: nothing is rejected
    assert cumulative_link.quality(frame(spark, []), train.withColumnRenamed("toxic", "quality")).count() == 0


def test_held_out_quality_and_toxicity(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    fit, held = labels.where("doc_id % 3 <> 0"), {r.doc_id: r for r in labels.where("doc_id % 3 = 0").collect()}
    quality = {r.doc_id: r.kept for r in cumulative_link.quality(docs, fit).select("doc_id", "kept").collect()}
    assert sum(quality[i] == bool(r.quality) for i, r in held.items()) > 0.95 * len(held)
    toxic = {r.doc_id: r.toxic for r in cumulative_link.toxicity(docs, fit).select("doc_id", "toxic").collect()}
    assert not [i for i, r in held.items() if toxic[i] and not r.toxic]  # clean documents are left alone
    assert sum(toxic[i] for i, r in held.items() if r.toxic) >= 0.4 * sum(r.toxic for r in held.values())


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5001 + i) for i in range(200)] + [(None, 3), (7, 7)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    known = collections.defaultdict(set)
    for a, b in edges:
        if a is not None and a != b:
            known[a].add(b)
            known[b].add(a)
    want = {}
    for n in sorted(known):
        if n not in want:
            stack = [n]
            while stack:
                x = stack.pop()
                if x not in want:
                    want[x] = n
                    stack += known[x]
    assert got == want


def test_texts_beyond_a_megabyte(spark):
    """Very long near copies are linked, and a passage at the end of a long text is found."""
    rng = random.Random(12)
    a = [f"w{rng.randrange(3000)}" for _ in range(180_000)]
    texts = [" ".join(a), " ".join([*a[:90_000], "other", *a[90_001:]]), " ".join(a[::-1]), " ".join([*a[:170_000], *a[:20]])]
    assert min(map(len, texts)) > 800_000
    got = {r.doc_id: r for r in minhash_dedup.near_duplicates(frame(spark, enumerate(texts)), 95).collect()}
    assert [got[i].component_id for i in range(4)] == [0, 0, 2, 3]
    bench = spark.createDataFrame([(1, " ".join(a[-13:]))], "item_id long, text string")
    found = {r.doc_id: (r.n_words, r.n_hit) for r in decontaminate.contamination(frame(spark, enumerate(texts)), bench).collect()}
    assert found == {0: (180_000, 13), 1: (180_000, 13), 2: (180_000, 0), 3: (170_020, 0)}


def test_pipeline_stages_take_odd_tables(spark, tmp_path):
    """Nulls, empty texts, repeated rows and columns whose names clash with the stages' own; then an empty table."""
    import corpus_pipeline

    rng = random.Random(13)
    line = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    texts = [None, "", line(40), line(50)]
    names = ["toxic", "expected_severity", "_gone", "_d", "_h", "row", "component_id", "token_ids"]
    rows = [(i, t, *range(len(names))) for i, t in [*enumerate(texts), (2, texts[2]), (None, line(30)), (None, None), (5, line(30))]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{c} int" for c in names))
    spark.createDataFrame([(2, 0, 1), (3, 0, 1), (None, None, None)], "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, texts[3]), (2, None), (None, texts[2])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for table, want in ((docs, {0, 1, 2, 5, None}), (docs.where("doc_id < 0"), set())):
        kept = table
        for name, stage in corpus_pipeline.STAGES:
            kept = common.materialize(stage(spark, kept, str(tmp_path)), "odd")
            if name != "bpe":
                assert kept.columns == docs.columns
                assert all(tuple(r)[2:] == tuple(range(len(names))) for r in kept.collect())
        assert {r.doc_id for r in kept.collect()} == want


def test_pipeline(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES:
        before, kept = kept, common.materialize(stage(spark, kept, d), "test")
        if name != "bpe":
            assert kept.columns == docs.columns
        if name == "near dedup":
            rows = {r.doc_id: shingles(r.text) for r in before.collect()}
            want = components(list(rows), lambda a, b: bool(rows[a] and rows[b]) and 100 * len(rows[a] & rows[b]) >= 80 * len(rows[a] | rows[b]))
            assert {r.doc_id for r in kept.collect()} == {i for i, c in want.items() if i == c}
    got = corpus_pipeline.run(spark, d)
    assert sorted((r.doc_id, r.n_tokens) for r in got.collect()) == sorted((r.doc_id, r.n_tokens) for r in kept.collect())
