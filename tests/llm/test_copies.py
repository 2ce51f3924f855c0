"""Planted copies of benchmark items: recall of the search against the subsequence over all windows."""

import random
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from eventflow.llm import decontaminate as dec

FOLDER = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def bench():
    """(searcher over all items, texts of many documents), learned from part of the documents."""
    texts = pd.read_parquet(f"{FOLDER}/documents.parquet", columns=["text"]).text.fillna("").tolist()[:2500]
    items = pd.read_parquet(f"{FOLDER}/benchmark.parquet")
    sums = dec.Statistics()
    for chunk in dec._chunks(texts):
        sums.add(chunk)
    space = dec.decompose(sums.n, sums.df, sums.gram.T)
    known = [x for x in (dec.item_of(int(k), t) for k, t in zip(items.item_id, items.text, strict=True)) if x]
    return dec.Searcher(space, known), texts


def planted(bench, change, seed):
    """For each item a long document with a changed copy of it between words of its own."""
    searcher, texts = bench
    rng = random.Random(seed)
    corpus = [w for t in texts[:500] for w in dec.words_of(t)]
    hosts = [dec.words_of(t) for t in texts if len(t) > 1500]
    for item in searcher.items:
        host = rng.choice(hosts)[:300]
        at = rng.randint(50, min(200, len(host)))
        yield item, b" ".join(host[:at] + change(rng, corpus, item.words) + host[at:]).decode("utf-8", "replace")


def found(searcher, item, text):
    chunk = next(dec._chunks([text]))
    return any(hit[0] == item.key for hit in searcher.search(chunk)[0])


def longest_overlap(item, text):
    """Largest share of the item that is a subsequence of any window as long as the search looks at."""
    words, masks, n = dec.words_of(text), dec.masks_of(item.words), len(item.words)
    return max(dec.common(masks, n, words[at : at + n]) for at in range(max(1, len(words) - n + 1))) / n


def replaced(share, with_word=None):
    return lambda rng, corpus, words: [(with_word or rng.choice(corpus)) if rng.random() < share else w for w in words]


def inserted(share):
    return lambda rng, corpus, words: [x for w in words for x in ([w, rng.choice(corpus)] if rng.random() < share else [w])]


def test_every_verbatim_copy_at_any_offset(bench):
    for seed in range(3):
        assert all(found(bench[0], item, text) for item, text in planted(bench, lambda _r, _c, words: words, seed))


@pytest.mark.parametrize(
    "change",
    [replaced(0.15), replaced(0.25), replaced(0.2, b"the"), inserted(0.15), inserted(0.25)],
    ids=["15 % replaced", "25 % replaced", "20 % by one word", "15 % inserted", "25 % inserted"],
)
def test_recall_of_changed_copies(bench, change):
    due = [(item, text) for item, text in planted(bench, change, 11) if longest_overlap(item, text) >= dec.OVERLAP]
    assert len(due) > 100
    recall = sum(found(bench[0], item, text) for item, text in due) / len(due)
    assert recall >= 0.95


def test_shared_words_in_another_order_are_no_copy(bench):
    searcher, _ = bench
    for item in searcher.items[:40]:
        if len(set(item.words)) > 15:
            assert not found(searcher, item, b" ".join(sorted(item.words, reverse=True)).decode("utf-8", "replace"))


def test_repeated_rows_long_texts_and_clashing_columns(spark):
    items = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa")], "item_id long, text string")
    copy = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    long = "filler words of no meaning " * 20_000 + copy + " more filler words" * 20_000
    rows = [(1, copy, "h"), (1, copy, "h"), (2, long, "h"), (3, "nothing here", "h"), (4, None, "h")]
    docs = spark.createDataFrame(rows, "item_id long, text string, hits string")
    got = dec.contaminated(docs, items, key="item_id").orderBy("item_id")
    assert got.columns[:2] == ["item_id", "found_item_id"]
    assert [r.item_id for r in got.collect()] == [1, 1, 2]
    kept = dec.clean(docs, items)
    assert kept.columns == docs.columns and sorted(r.item_id for r in kept.collect()) == [3, 4]
    assert kept.where(F.col("hits") == "h").count() == 2


def test_files_follow_the_bytes(spark, tmp_path, monkeypatch):
    from eventflow.llm import token_files

    spark.range(20_000).selectExpr("id as doc_id", "repeat(md5(cast(id as string)), 3) as text").repartition(4).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    stored = sum(p.stat().st_size for p in (tmp_path / "docs").glob("*.parquet"))
    assert token_files.files_for(docs) == 1
    monkeypatch.setattr(token_files, "BYTES_PER_FILE", stored // 8)
    assert token_files.files_for(docs) in (8, 9)
    assert token_files.files_for(docs.join(docs.select(F.col("doc_id").alias("x")), F.col("doc_id") == F.col("x"))) <= 18
    assert token_files.files_for(spark.createDataFrame([], "doc_id long, text string")) <= 1


def test_columns_named_like_inner_ones_stay(spark):
    from eventflow.llm import jaccard_join, mixing

    rows = [(i, f"some words number {i} stand here {'again ' * (i % 5)}", "ab"[i % 2], i, f"h{i}") for i in range(20)] + [(20, "some words number 0 stand here ", "a", 99, "h99")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _hash long, _key string")
    docs = docs.withColumns({"_band": F.col("_hash"), "_src": F.lit("mine"), "_bucket": F.lit(1), "_digest": F.lit("d"), "_copy": F.col("_key")})
    for out in (jaccard_join.keep_one(docs), mixing.emit(mixing.mix(docs))):
        kept = out.select(docs.columns).collect()
        assert len(kept) > 10
        for r in kept:
            want = rows[20][3] if r.doc_id == 20 else r.doc_id
            assert (r["_hash"], r["_band"], r["_src"], r["_bucket"], r["_digest"]) == (want, want, "mine", 1, "d") and r["_key"] == r["_copy"] == f"h{want}"
    by_key = mixing.mix(docs.withColumnsRenamed({"doc_id": "_rank", "text": "_start", "source": "_unused"}), text="_start", source="_src", key="_rank")
    assert {"_rank", "_start", "_src"} <= set(by_key.columns) and by_key.count() == 21


def test_words_new_to_several_texts_are_learned_together():
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    from eventflow.llm import token_files

    path = public_tokenizers.path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = True
    words = ["über", "\nÉté,", "naïve***", "\n", "it's", "", "ß", "x\ty", "中文,", "<|endoftext|>", "a×b", "\nword", "co-op", "3km", "Ñu.\n\nÀ"]
    texts = [" ".join(f"{w}{'abcdefgh'[i % 8] * (i // 8)}" for w in words[i % 7 :]) for i in range(40)] + ["", " ", "ÿ", "\n"]
    e = token_files.Encoder(path, 2)
    rounds, learn = [], e._learn
    e._learn = lambda pieces: (rounds.append(len(pieces)), learn(pieces))
    for _ in range(2):
        got = [np.frombuffer(ids, "<u2").tolist() for ids in e.encode(texts)]
        assert got == [whole.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(rounds) <= 2, "one round for new pieces, one for those that have to be cut otherwise"


def test_few_pairs_without_enough_words_are_checked_word_by_word(bench, monkeypatch):
    searcher, texts = bench
    enough, check = [], dec.Searcher._check

    def counted(self, i, part, *rest):
        enough.append((Counter(part) & self.counts[i]).total() >= dec.OVERLAP * len(self.items[i].words))
        return check(self, i, part, *rest)

    monkeypatch.setattr(dec.Searcher, "_check", counted)
    for chunk in dec._chunks([*texts[:300], *(text for _, text in planted(bench, replaced(0.2), 1))]):
        searcher.search(chunk)
    assert sum(enough) > 100 and sum(enough) > 0.8 * len(enough)


def test_features_in_common_are_counted_as_often_as_both_have_them(bench):
    import numpy as np

    searcher, texts = bench
    words = dec.Words([dec.clean_bytes(t) for t in ["", "a b", *texts[:40]]])
    blocks, count = words.laid_out(dec.BLOCK)
    rng, last = random.Random(2), np.cumsum(count)
    begin = np.array([rng.randrange(len(blocks)) for _ in range(300)])
    end = np.minimum(begin + 6, last[np.searchsorted(last, begin, "right")])
    column = np.array([rng.randrange(len(searcher.items)) for _ in begin])
    want = [
        sum((Counter(blocks[b:e].ravel().tolist()) & Counter(dec.features_of(searcher.items[searcher.order[c]].words).tolist())).values())
        for b, e, c in zip(begin, end, column, strict=True)
    ]
    assert searcher._alike(blocks, begin, end, 6, column).tolist() == want
