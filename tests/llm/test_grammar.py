import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

from nameweave.llm import grammar
from tests.llm.conftest import collected, rows


@pytest.fixture(scope="module")
def enc():
    return grammar.Encoder(grammar.default_tokenizer())


@pytest.fixture(scope="module")
def library():
    """The tokenizer as the library opens it, apart from the encoder's own."""
    return Tokenizer.from_file(grammar.default_tokenizer())


def direct(library, texts):
    return [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_encoder_gives_the_tokenizers_ids(enc, library, monkeypatch):
    monkeypatch.setattr(grammar, "MEMORY", 500)
    monkeypatch.setattr(grammar, "CHARACTERS", 3000)
    rng = random.Random(9)
    bits = [" ", " ", " ", "\n", "\t", "a", "Bc", "é", "ß", "12", "'s", "'ll", ".", "!!", "\x1c", "\x85", "　", "\xa0", " ", "<|endoftext|>", "the", "日本", "|"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(14))) for _ in range(6000)] + [t or "" for _, t, *_ in rows()]
    assert [np.frombuffer(x, "<u4").tolist() for x in enc(texts)] == direct(library, texts)
    assert direct(library, ["<|endoftext|>"]) == [[50256]] == [np.frombuffer(x, "<u4").tolist() for x in enc(["<|endoftext|>"])]


def test_known_words_are_not_encoded_again(library):
    """Words that were seen go to the library no more when marks follow them or a line end joins them."""
    enc, words, sent = grammar.Encoder(grammar.default_tokenizer()), [f"w{'abcdefgh'[i % 8]}{'xyz'[i % 3]}q{chr(224 + i % 20)}{i}" for i in range(500)], []
    ids = enc._ids
    enc._ids = lambda texts: sent.extend(texts) or ids(texts)
    texts = [" ".join(["", *words, *(f"\n{w}" for w in words)])]
    joined = ["a " + " ".join(f"{x}.\n{y}" for x, y in zip(words, words[1:])), *("a " + " ".join(w + m for w in words) for m in ("%%%", ".$$", "'", ",", "?!"))]
    assert [np.frombuffer(x, "<u4").tolist() for x in enc(texts)] == direct(library, texts)
    sent.clear()
    assert [np.frombuffer(x, "<u4").tolist() for x in enc(joined)] == direct(library, joined)
    once = "".join("\n" + w for w in words[1:])
    assert sum(map(len, sent)) < len(once) + 100
    sent.clear()
    assert [np.frombuffer(x, "<u4").tolist() for x in enc(joined)] == direct(library, joined)
    assert sum(map(len, sent)) < 100


def test_grammar_round_trip_and_random_access(monkeypatch):
    monkeypatch.setattr(grammar, "LEAST", 2)
    rng = random.Random(10)
    for _ in range(100):
        docs = [np.array([rng.randrange(3) for _ in range(rng.randrange(60))], "<u4") for _ in range(rng.randrange(1, 9))]
        ids, ends = np.concatenate(docs), np.cumsum([len(d) for d in docs])
        row = grammar._pack(list(range(len(docs))), ids, ends)
        block = grammar.Block(row)
        all_ids, all_ends = block.all()
        assert all_ids.tolist() == ids.tolist() and all_ends.tolist() == ends.tolist()
        for k, d in enumerate(docs):
            assert block.document(k).tolist() == d.tolist()
            for i in range(0, len(d), 7):
                assert block.token(k, i) == d[i]


def apart(symbols, starts):
    """How often each pair of neighbours within a document occurs, without overlap."""
    n, last, cuts = Counter(), {}, set(starts.tolist())
    for i in range(len(symbols) - 1):
        pair = int(symbols[i]), int(symbols[i + 1])
        if i + 1 not in cuts and last.get(pair, -2) != i - 1:
            n[pair] += 1
            last[pair] = i
    return n


def test_no_frequent_pair_is_left():
    """The result is a grammar of the ids, in which no pair could pay for another rule, and each rule pays for itself."""
    rng = random.Random(22)
    for case in range(60):
        words = [[rng.randrange(40) for _ in range(rng.randrange(1, 6))] for _ in range(rng.randrange(2, 12))]
        docs = [np.array([x for _ in range(rng.randrange(40)) for x in rng.choice(words)] + [7] * (case % 9), "<u4") for _ in range(rng.randrange(1, 30))]
        docs += [docs[0]] * (case % 7) + [np.array([5] * (case * 3), "<u4")]
        ids, ends = np.concatenate(docs), np.cumsum([len(d) for d in docs])
        symbols, starts, left, right = grammar.grammar(ids, ends, 50, 4)
        assert max(apart(symbols, starts).values(), default=0) < 4
        lengths = [1] * 50
        for a, b in zip(left.tolist(), right.tolist(), strict=True):
            assert a < len(lengths) and b < len(lengths)  # rules are made of earlier symbols
            lengths.append(lengths[a] + lengths[b])
        for s, st, a, b in ((symbols, starts, left, right), grammar.pruned(symbols, starts, left, right, 50)):
            lengths = [1] * 50
            for x, y in zip(a.tolist(), b.tolist(), strict=True):
                lengths.append(lengths[x] + lengths[y])
            assert grammar.expand(s, a, b, np.array(lengths), 50).tolist() == ids.tolist()
            cuts = [*st.tolist(), len(s)]
            assert [sum(lengths[x] for x in s[i:j]) for i, j in zip(cuts, cuts[1:])] == [len(d) for d in docs]
        used = Counter([*s.tolist(), *a.tolist(), *b.tolist()])
        assert all(used[50 + r] > 1 or 50 + r in {*a.tolist(), *b.tolist()} for r in range(len(a)))


def test_equal_documents_fold():
    doc = np.random.default_rng(3).integers(0, 50_000, 300).astype("<u4")
    c = grammar.compress(np.tile(doc, 64), 300 * np.arange(1, 65))
    assert len(c["symbols"]) <= 64 * 5


def test_frequent_pairs_are_replaced():
    ids = np.tile(np.array([5, 6, 7, 8], np.uint32), 500)
    c = grammar.compress(ids, np.array([2000]))
    assert len(c["symbols"]) < 100 and c["lengths"].max() >= 16


def brute(library, docs):
    out, start = [], 0
    key = lambda t: xxhash.xxh64_intdigest((t or "").encode(), 42) ^ (1 << 63)  # in the order of the signed hash
    for d, t in sorted(docs, key=lambda x: (x[0] is not None, x[0] or 0, key(x[1]))):
        ids = np.array([*direct(library, [t or ""])[0], 2], "<u4")
        out.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return sorted(map(repr, out))


def test_query(library, odd, none, clashing):
    docs = [(i, t) for i, t, *_ in rows()]
    got = grammar.token_output(odd)
    assert sorted(repr(tuple(r)) for r in got.collect()) == brute(library, docs)
    assert collected(grammar.token_output(clashing)) == collected(got)
    assert grammar.token_output(none).count() == 0
    shards = grammar.write_shards(odd, shard_docs=2).df
    assert shards.count() > 3
    assert sorted(repr(tuple(r)) for r in grammar.read_shards(shards).collect()) == brute(library, docs)


def test_equal_ids_are_spread_and_may_be_strings(library, spark):
    docs = [(None, f"text {i % 3} <|endoftext|> x") for i in range(40)] + [(7, "same")] * 40
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    shards = grammar.write_shards(df, shard_docs=10).df
    assert shards.select("shard").distinct().count() > 4
    assert sorted(repr(tuple(r)) for r in grammar.read_shards(shards).collect()) == brute(library, docs)
    named = grammar.token_output(df.withColumn("doc_id", df.doc_id.cast("string")))
    assert named.schema["doc_id"].dataType.simpleString() == "string" and named.agg({"n_tokens": "sum"}).first()[0] == sum(len(x) + 1 for x in direct(library, [t for _, t in docs]))
