"""Token counts, periodic runs and the conversation trie against the library, brute force and SQL."""

import hashlib
import random
import re
import zlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from eventflow.llm import periodic_runs, prefix_trie, queries, token_counts
from eventflow.llm.common import table

SF = "/root/testdata/sf0.001"
WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
SPLIT = re.compile(r"[^\x20\x09-\x0D]+")
NONE = hashlib.sha256(b"").hexdigest()


def odd_texts(n=600):
    rng = random.Random(1)
    pools = [
        [chr(c) for c in range(0x300)],
        [chr(c) for c in range(0x300, 0x20000, 37) if not 0xD800 <= c < 0xE000],
        list("Σσςa ̧́é'sS'tTre ''ll<|endoftext|>İ"),
        list("中文字　a1²½٣ॐ़क‍’﻿"),
    ]
    made = ["".join(rng.choice(rng.choice(pools)) for _ in range(rng.randint(0, 60))) for _ in range(n)]
    return [*made, "<|endoftext|>" * 3, "a<|startoftext|>b <|endoftext|", "ΟΔΟΣ ΣΑΣ", "İ̧stanbul", "'S'Re don'T", "x" * 5000 + " y", None, ""]


@pytest.mark.parametrize("vocabulary", [WORDS, BYTES])
def test_lengths_are_the_librarys(vocabulary, monkeypatch):
    monkeypatch.setattr(token_counts, "CACHED", 500)  # the cache starts anew several times
    library = Tokenizer.from_file(vocabulary)
    texts = odd_texts()
    lengths = token_counts.Lengths(vocabulary, {})
    expected = [len(library.encode(t or "", add_special_tokens=False).ids) for t in texts]
    assert lengths.count(texts) == expected
    assert lengths.count(texts) == expected


def test_long_texts_are_cut_at_spaces(monkeypatch):
    text = " ".join(odd_texts(200)[:200]) + "z" * 9000
    library = Tokenizer.from_file(WORDS)
    monkeypatch.setattr(token_counts, "AT_ONCE", 100)
    assert len(list(token_counts._parts(text))) > 20
    assert token_counts.Lengths(WORDS, {}).count([text]) == [len(library.encode(text, add_special_tokens=False).ids)]


def test_token_counts(spark):
    rows = [(i, t, "x", 7) for i, t in enumerate([*odd_texts(100), "the the of", "the the of"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_tokens long").repartition(3)
    table = token_counts.frequent(docs, WORDS, entries=3)
    assert 0 < len(table) <= 3
    got = token_counts.count_tokens(docs, WORDS, limit=20, entries=3)
    assert got.columns == ["doc_id", "text", "source", "n_bytes", "n_tokens", "over_limit"]
    library = Tokenizer.from_file(WORDS)
    for r in got.collect():
        n = len(library.encode(r.text or "", add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((r.text or "").encode()), n, n > 20)
    assert got.count() == len(rows)
    assert token_counts.count_tokens(docs.limit(0), WORDS, 20).collect() == []


def test_frequent_prefers_the_most_frequent(spark):
    docs = spark.createDataFrame([("often " * 50 + "rare " + "some " * 9,)] * 4 + [(None,)], "text string").repartition(5)
    assert list(token_counts.frequent(docs, WORDS, entries=1)) == ["often"]
    assert set(token_counts.frequent(docs, WORDS, entries=2)) == {"often", "some"}


def test_op11_equals_the_library(spark):
    library = Tokenizer.from_file(WORDS)
    texts = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    got = queries.op11_token_counts(spark, SF).collect()
    assert {r.doc_id: r.n_tokens for r in got} == {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t in texts.items()}


# --- runs --------------------------------------------------------------------------------------


def brute_runs(words):
    found = []
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            n = i + q - s
            if n >= max(6, 4 * q) and not any(words[s : s + n - r] == words[s + r : s + n] for r in range(1, q)):
                found.append((s, n, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def brute_row(words):
    runs = brute_runs(words)
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    milli = 1000 * best[1] // best[2] if runs else None
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return (len(runs), *best, milli, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def made_documents(n, seed=3):
    rng = random.Random(seed)
    periods = [1, 2, 3, 7, 8, 9, 10, 15, 16, 17, 18, 20, 31, 32, 33, 34, 60, 64, 65, 66, 100, 129]
    docs = []
    for _ in range(n):
        k = rng.choice([1, 2, 2, 3, 5, 50])
        words = [f"w{rng.randrange(k)}" for _ in range(rng.choice([0, 1, 5, 6, 7, 30, 100, 400]))]
        for _ in range(rng.randrange(3)):
            p = rng.choice(periods)
            base = [f"{rng.choice('wz')}{rng.randrange(rng.choice([2, 3, 100]))}" for _ in range(p)]
            at = rng.randint(0, len(words))
            words[at:at] = [base[i % p] for i in range(rng.randint(3 * p, 6 * p))]
        docs.append(words)
    # One word short of four periods, exactly four, one more; and a power of two around each scale.
    docs += [[str(i % 700) for i in range(n)] for n in (2799, 2800, 2801)]
    docs += [[str(i % q) for i in range(4 * q + extra)] for q in (8, 9, 16, 17, 32, 33, 128, 129) for extra in (-1, 0, 1)]
    return [*docs, ["a"] * 3000, ["a", "b"] * 1500]


def test_runs_equal_brute_force():
    docs = made_documents(400)
    got = list(periodic_runs.runs_of([" ".join(d) for d in docs]))
    expected = [brute_row(d) for d in docs]
    assert sum(e[0] for e in expected) > 300
    assert got == expected


def test_long_periods_come_from_minimizers(monkeypatch):
    docs = [d for d in made_documents(80, seed=5) if any(q > periodic_runs.SHORT for _, _, q in brute_runs(d))]
    assert len(docs) > 10
    monkeypatch.setattr(periodic_runs, "_seeds", lambda hashes, gram: [])
    got = list(periodic_runs.runs_of([" ".join(d) for d in docs]))
    assert all(g != brute_row(d) for g, d in zip(got, docs, strict=True))


def test_scales_go_by_document_and_pieces(monkeypatch):
    """Documents leave the array scale by scale; a small array gives the same as one of all."""
    docs = made_documents(60, seed=9)
    texts = [" ".join(d) for d in docs]
    whole = list(periodic_runs.runs_of(texts))
    monkeypatch.setattr(periodic_runs, "AT_ONCE", 50)
    assert list(periodic_runs.runs_of(texts)) == whole


def test_odd_texts(spark):
    rows = [(1, None, 5), (2, "", 5), (3, " \n\t", 5), (4, "a a a a a a", 5), (4, "a a a a a a", 5), (None, "b " * 100_000, 5), (6, "a a a a x", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs long").withColumn("start", F.lit("replaced"))
    got = periodic_runs.detect(docs)
    assert got.columns[:3] == ["doc_id", "text", "runs"]
    for r in got.collect():
        words = SPLIT.findall(r.text or "")
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) == (
            brute_row(words) if len(words) < 1000 else (1, 0, 100_000, 1, 100_000_000, hashlib.sha256(b"0,100000,1\n").hexdigest(), hashlib.sha256(b"b").hexdigest())
        )
        assert r.runs == 5
    assert periodic_runs.detect(docs.limit(0)).collect() == []


def test_op12_equals_brute_force(spark):
    expected = {}
    for r in table(spark, SF, "documents").collect():
        words = SPLIT.findall(r.text or "")
        h, n = zlib.crc32(str(r.doc_id).encode()), len(words)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        if n <= 3000:
            expected[r.doc_id] = brute_row(words)
    got = {r[0]: tuple(r)[1:] for r in queries.op12_periodic_runs(spark, SF).collect() if r[0] in expected}
    assert got == expected and sum(e[0] > 0 for e in expected.values()) > 10


# --- trie --------------------------------------------------------------------------------------


def brute_trie(rows, head, block):
    told = {}
    for conv, turn, role, text in sorted((r[:4] for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0)):
        told.setdefault(conv, []).append((role or "", text or ""))
    nodes = {}
    for c, turns in told.items():
        h = head(c)
        whole = told.get(c - c % block, [])[:h] + turns[h:]
        for d in range(len(whole) + 1):
            nodes.setdefault(tuple(whole[:d]), []).append((c, d == len(whole)))
    kids = {k: 0 for k in nodes}
    for k in nodes:
        if k:
            kids[k[:-1]] += 1
    leaves, saved = ({k: 0 for k in nodes} for _ in range(2))
    for k, members in nodes.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not kids[k]
            saved[k[:d]] += (len(members) - 1) * len(k[-1][1]) if k else 0
    first = {k: min(c for c, _ in m) for k, m in nodes.items()}
    over = lambda m: hashlib.sha256(",".join(str(c) for c, last in sorted(m) if last).encode()).hexdigest()
    return sorted((first[k], len(k), first[k[:-1]] if k else -1, len(m), kids[k], leaves[k], saved[k], over(m)) for k, m in nodes.items())


def found_trie(df):
    return sorted(tuple(-1 if v is None else v for v in r) for r in df.collect())


TRIE = "conv_id long, turn long, role string, text string, depth string, k1 long"


def made_conversations():
    rng = random.Random(2)
    rows = []
    for c in range(300):
        n = rng.choice([1, 1, 2, 3, 4, 6, 9])
        rows += [(c * 7 % 900, t, rng.choice("ab"), rng.choice(["", "hi", "ünï", "yes"])) for t in range(n)]
    rows += [(5000, t, "a", f"deep {t // 50}") for t in range(150)]  # deeper than a band of bands
    rows += [(5100, t, "a", f"deep {t // 50}") for t in range(140)] + [(5101, 0, "b", "x")]
    rows += [(6000 + i, t, "a", "copy") for i in range(2500) for t in range(2)]  # more ids than a range at one end
    rows += [(None, 1, "a", "left out"), (7000, None, None, None), (7000, None, None, None), (7000, 3, "a", None), (7000, 2, "b", "z" * 50_000)]
    return [(*r, "x", 1) for r in rows]


@pytest.mark.parametrize("height", [4, 16])
def test_trie_equals_brute_force(spark, height):
    rows = made_conversations()
    table = spark.createDataFrame(rows, TRIE).repartition(5)
    head = F.crc32(F.col("conv_id").cast("string")) % 6
    got = found_trie(prefix_trie.conversation_trie(table, head, 100, height))
    assert got == brute_trie(rows, lambda c: zlib.crc32(str(c).encode()) % 6, 100)
    if height == 4:
        plain = found_trie(prefix_trie.conversation_trie(table, height=4))
        assert plain == brute_trie(rows, lambda c: 0, 1)


def test_trie_by_segments(spark, monkeypatch):
    """A conversation cut into many segments, with turns lacking a number, gives the same trie."""
    rows = [(1, t, "a", f"t{t % 3}", "x", 1) for t in range(200)] + [(1, None, "n", f"n{i}", "x", 1) for i in range(60)]
    table = spark.createDataFrame(rows, TRIE).repartition(4)
    whole = found_trie(prefix_trie.conversation_trie(table))
    monkeypatch.setattr(prefix_trie, "TURNS", 7)
    assert found_trie(prefix_trie.conversation_trie(table)) == whole
    assert len(whole) == 261


def test_trie_of_nothing(spark):
    assert prefix_trie.conversation_trie(spark.createDataFrame([], TRIE)).collect() == []
    assert prefix_trie.conversation_trie(spark.createDataFrame([(None, 1, "a", "b", "x", 1)], TRIE)).collect() == []
    # Conversation 3 takes one turn of an absent one and has none of its own left.
    got = found_trie(prefix_trie.conversation_trie(spark.createDataFrame([(3, 1, "a", "b", "x", 1)], TRIE), F.lit(1), 100))
    assert got == [(3, 0, -1, 1, 0, 1, 0, hashlib.sha256(b"3").hexdigest())]
