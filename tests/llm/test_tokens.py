"""p6 and p7 against the public tokenizer and a plain computation."""

import random

import pytest

from codestrata.llm import byte_bpe, mixing

RANKS = byte_bpe.load_ranks(f"{byte_bpe.VOCABULARIES}/byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def public():
    tiktoken = pytest.importorskip("tiktoken")
    return tiktoken.Encoding("own", pat_str=byte_bpe.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def texts():
    rng = random.Random(3)
    alphabet = ["the", " ", "\n", "a", "é", "中", "🙂", "1", "'s", "_", "\t", "  ", "XY"]
    return ["", " ", "\r\n", "hello world", "a" * 5000, "日本語" * 400, " " * 3000, *["".join(rng.choices(alphabet, k=rng.randint(1, 200))) for _ in range(200)]]


def test_encoder_equals_the_public_tokenizer(public):
    encoder = byte_bpe.Encoder(RANKS)
    for text in texts():
        assert encoder.encode(text) == public.encode_ordinary(text)


def test_short_and_long_merges_agree(public):
    rng = random.Random(4)
    for _ in range(100):
        word = "".join(rng.choices("abcdeiorst", k=rng.randint(1, 150))).encode()
        assert byte_bpe.merge_short(word, RANKS) == byte_bpe.merge_long(word, RANKS)


def test_column(spark, public):
    rows = [(1, "Hello there"), (2, None), (3, ""), (None, "x"), (3, "<|endoftext|>")]
    df = spark.createDataFrame([(k, t, "clash") for k, t in rows], "doc_id long, text string, ids string")
    got = sorted((str(r.doc_id), r.ids) for r in byte_bpe.encode_column(df, "doc_id", "text").collect())
    assert got == sorted((str(k), public.encode_ordinary(t or "")) for k, t in rows)
    assert byte_bpe.encode_column(df.limit(0), "doc_id", "text").count() == 0


DOCS = "doc_id long, text string, source string, tokens string"
TARGETS = "source string, target_share double, max_repeats int"


def test_mix_meets_its_shares(spark):
    rng = random.Random(1)
    docs = [(i, "word " * rng.randint(1, 40), rng.choice(["a", "a", "a", "b", "c", "x"]), None) for i in range(600)] + [(1000, None, "a", None), (1001, "z", None, None), (1002, "", "b", None)]
    targets = [("a", 0.5, 1), ("b", 0.4, 3), ("c", 0.1, 2), ("none", 0.0, 1), (None, 0.3, 1), ("d", None, None)]
    mix, shares = mixing.mix(spark.createDataFrame(docs, DOCS), spark.createDataFrame(targets, TARGETS))
    rows, told = mix.collect(), {r.source: r for r in shares.collect()}
    assert set(told) == {"a", "b", "c", "none", "d"} and {r.source for r in rows} == {"a", "b", "c"}
    caps = {"a": 1, "b": 3, "c": 2}
    for r in rows:
        assert 1 <= r.times <= caps[r.source]
    for s in "abc":
        mine = [r for r in rows if r.source == s]
        assert sum(r.tokens * r.times for r in mine) == told[s].reached
        assert abs(told[s].reached - told[s].budget) <= max(r.tokens for r in mine)
        assert abs(told[s].share - dict(a=0.5, b=0.4, c=0.1)[s]) < 0.02
        assert max(r.times for r in mine) - min(r.times for r in mine) <= 1
    assert any(told[s].budget == caps[s] * told[s].available for s in "abc")  # as large as the sources allow
    assert told["none"].reached == told["d"].reached == 0
    again = mixing.mix(spark.createDataFrame(docs, DOCS).repartition(7), spark.createDataFrame(targets, TARGETS))[0]
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows))


def test_mix_of_a_given_size_reports_what_it_cannot_reach(spark):
    docs = spark.createDataFrame([(1, "one two three", "a", None), (2, "one two three", "b", None)], DOCS)
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 10)], TARGETS)
    mix, shares = mixing.mix(docs, targets, total_tokens=24)
    assert {r.source: (r.reached, r.times) for r in mix.withColumnRenamed("tokens", "reached").collect()} == {"a": (3, 1), "b": (3, 4)}
    assert {r.source: round(r.share, 3) for r in shares.collect()} == {"a": 0.2, "b": 0.8}


def test_mix_of_nothing(spark):
    docs, targets = spark.createDataFrame([], DOCS), spark.createDataFrame([("a", 1.0, 1)], TARGETS)
    mix, shares = mixing.mix(docs, targets)
    assert mix.count() == 0 and [(r.source, r.reached, r.share) for r in shares.collect()] == [("a", 0, 0.0)]
    assert mixing.mix(docs, spark.createDataFrame([], TARGETS))[1].count() == 0
