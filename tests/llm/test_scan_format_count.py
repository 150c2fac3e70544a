"""Secret scans, chat formatting and token counts against brute force."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from quaylight.llm import chat_format, secret_scan, token_count

DOCS = "doc_id long, text string, spans int, n int"
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def brute(text):
    out = []
    for k, (kind, pattern, least) in enumerate((("assign", ASSIGN, 6), ("access", "AKIA[A-Z0-9]+", 20), ("hex", "[0-9a-f]+", 24))):
        flags = re.IGNORECASE | re.ASCII if kind == "assign" else 0
        g = 2 if kind == "assign" else 0  # the group whose length counts; the span is the whole match
        out += [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text or "", flags) if len(m[g]) >= least]
    return [x for *_, x in sorted(out)]


def test_secret_scan(spark):
    rng = random.Random(1)
    parts = ["password", "API_KEY", "apikey", "token: ", "secret=", '"', " = ", "abc", "AKIA", "ABCDEFGHIJKLMNOPQ", "0123456789abcdef", "é", "ſecret=abcdefgh", "\n", "x" * 5, "token:token:abcdefgh"]
    texts = [None, "", " ", *["".join(rng.choice(parts) for _ in range(rng.randint(1, 12))) for _ in range(300)], "é" * 100_000 + "password = hunter22"]
    rows = [(i, t, 1, 2) for i, t in enumerate(texts)] + [(None, texts[5], 1, 2), (4, texts[4], 1, 2)]
    got = secret_scan.digests(secret_scan.find_secrets(spark.createDataFrame(rows, DOCS))).collect()
    assert len(got) == len(rows)
    for r in got:
        want = brute(texts[5 if r.doc_id is None else r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(w.startswith(k) for w in want) for k in ("assign:", "access:", "hex:"))
        assert [x for x in r.spans.split(",") if x and not x.startswith("novel")] == want
    assert secret_scan.find_secrets(spark.createDataFrame([], DOCS)).count() == 0


def test_novelty_tells_random_strings_from_known_names(spark):
    random_key = "Zx9Qv7LmT2pWk4RbYc8N"
    texts = [f"credential {random_key} goes here", "credential your_api_key_here_v2 your_token_here_v2 goes here", f"nothing {random_key} goes here", f"bearer {'ab12' * 8} and ab12ab12ab12ab12"]
    got = secret_scan.find_secrets(spark.createDataFrame([(i, t, 0, 0) for i, t in enumerate(texts)], DOCS)).orderBy("doc_id").collect()
    assert [[(s.kind, texts[r.doc_id][s.start : s.end]) for s in r.spans] for r in got[:3]] == [[("novel", random_key)], [], []]
    assert not [s for s in got[3].spans if s.kind == "novel"]


def test_novelty_is_linear_and_finds_planted_keys():
    """Long texts of sensitive words and runs; spans never overlap; of random keys in reach nearly all are found, of names none."""
    import time

    rng = random.Random(11)
    for text in ("token1A" * 150_000, "token " * 170_000, ("credentialtoken" + "aB3" * 7 + " ") * 25_000):
        began = time.time()
        spans = secret_scan.novel_spans(text, secret_scan.base_spans(text), 0.75)
        assert time.time() - began < 20 and all(a[2] <= b[0] for a, b in zip(spans, spans[1:]))
    assert list(secret_scan.candidates("credentialtokenZx9Qv7LmT2pWk4RbYc8N"))[0] == (15, 35)
    assert list(secret_scan.candidates("secret" + "." * 81 + "Zx9Qv7LmT2pWk4RbYc8N")) == []
    assert list(secret_scan.candidates("secret" + "." * 80 + "Zx9Qv7LmT2pWk4RbYc8N")) == [(86, 106)]
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    words = "the value of our setting is kept in a file and read by each service when it starts up again".split()
    found = named = 0
    for _ in range(300):
        key = "".join(rng.choice(alphabet) for _ in range(rng.randint(20, 40)))
        text = " ".join(rng.choices(words, k=30)) + " credential " + key + " " + " ".join(rng.choices(words, k=30))
        found += [text[s:e] for s, _, e, _ in secret_scan.novel_spans(text, [], 0.75)] == [key]
        text = text.replace(key, "default_connection_string_of_database_2")
        named += bool(secret_scan.novel_spans(text, [], 0.75))
    assert found >= 290 and named == 0


def test_chats_round_trip(spark, monkeypatch):
    rng = random.Random(2)
    parts = ["<|im_start|>", "<|im_end|>", "</s>", "<s>", "[INST]", "[/INST]", "\\", "<\\s>", "<", "|im_end|>", "\n", "é", "hi ", "<\\\\|im_end|>", "[", "INST]"]
    rows = []
    for c in [None, *range(40)]:
        for t in range(rng.randint(1, 6)):
            text = rng.choice([None, ""]) if rng.random() < 0.2 else "".join(rng.choice(parts) for _ in range(rng.randint(1, 9)))
            rows.append((c, t, rng.choice(["user", "assistant", "system", None, "a\nb\\n<s>"]), text, 7))
    rows += [(50, t, "assistant", f"{t} " + "long é" * 2000, 7) for t in range(400)]  # some MB, so several parts
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, part int")
    parts_made = chat_format.format_chats(df)
    got = {r.conv_id: r for r in chat_format.read_back(parts_made, in_order=True).collect()}
    stored = parts_made.orderBy(F.desc("part")).repartition(7)  # as a reader may split a stored table
    assert {r.conv_id: r for r in chat_format.read_back(stored).collect()} == got
    assert parts_made.where("conv_id = 50").count() > 1
    assert len(got) == len({r[0] for r in rows})
    for c, r in got.items():
        own = sorted((t, role or "", text or "") for k, t, role, text, _ in rows if k == c)
        loss = "".join(text for _, role, text in own if role == "assistant")
        assert r.n_turns == len(own) and r.loss_chars == len(loss)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{role}\n{text}\n" for _, role, text in own).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert chat_format.read_back(chat_format.format_chats(df.where("conv_id = 99"))).count() == 0


def test_token_counts(spark, tmp_path):
    tokenizers = pytest.importorskip("public_tokenizers")
    path = tokenizers.path("byte_bpe_50k.tiktoken")
    rng = random.Random(3)
    texts = [None, "", "a", "hello world " * 5000, *["".join(rng.choice("abc é\n1") for _ in range(rng.randint(0, 300))) for _ in range(200)]]
    df = spark.createDataFrame([(i, t, 0, 0) for i, t in enumerate(texts)] + [(7, texts[7], 0, 0)], DOCS).repartition(3)
    encode = token_count._encoder(type("B", (), {"value": open(path, "rb").read()})).encode_ordinary
    want = sorted([(i, len(encode(t or ""))) for i, t in enumerate(texts)] + [(7, len(encode(texts[7])))])
    assert sorted(map(tuple, token_count.document_tokens(df, path, 50256).collect())) == want
    folder, order = token_count.write_token_files(df, path, 50256)
    for block in (2, 14, 1000):  # every border between blocks is stitched
        got = order.join(token_count.count_tokens(spark, folder, 50256, block_bytes=block if block > 2 else 1024), ["file", "ordinal"]).select("doc_id", "n_tokens")
        assert sorted(map(tuple, got.collect())) == want
    import numpy as np

    np.array([9, 1, 2, 9, 9, 3, 4], "<u4").tofile(tmp_path / "a.bin")
    np.array([1, 2, 9], "<u4").tofile(tmp_path / "b.bin")
    (tmp_path / "c.bin").write_bytes(b"")
    got = token_count.count_tokens(spark, f"file://{tmp_path}", 9, "<u4", block_bytes=4)
    assert sorted(map(tuple, got.collect())) == [("a.bin", 0, 0), ("a.bin", 1, 2), ("a.bin", 2, 0), ("a.bin", 3, 2), ("b.bin", 0, 2)]
    assert token_count.document_tokens(df.where("doc_id < 0"), path, 50256).count() == 0
