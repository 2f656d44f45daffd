from __future__ import annotations

import math
import random
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
import regex
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.helpers import RAW, alike, at, reading, us, views
from velotrace.llm import queries as lq
from velotrace.llm.bpe import PATTERN, TOKENIZERS, VOCABULARY, Bpe, count_tokens, dealt, decode, divider, encode
from velotrace.llm.digests import build, cluster, estimates, merge, percentiles, quantile
from velotrace.llm.mixing import mixed, shares
from velotrace.llm.runs import SAME, collapse, overtake_runs, reading_runs
from velotrace.llm.splitting import split, split_documents, stretches_of
from velotrace.operators.skew import joined_by

DOCS = "doc_id long, text string"


@pytest.fixture(scope="module")
def bpe():
    return Bpe((Path(TOKENIZERS) / VOCABULARY).read_bytes())


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{TOKENIZERS}/{VOCABULARY}")
    t.encode_special_tokens = True
    return t


@pytest.fixture(scope="module")
def duck(sf):
    return views(sf)


@pytest.mark.parametrize("name", sorted(lq.oracle_sql()))
def test_query_equals_sql(spark, sf, duck, name):
    got, want = alike(lq.queries()[name](spark, sf).toPandas(), duck.sql(lq.oracle_sql()[name]).df())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(lq.queries()) - set(lq.oracle_sql())))
def test_query_without_sql_runs(spark, sf, name):
    assert lq.queries()[name](spark, sf).count() > 0


# 8

ODD = ["", " ", "\n\n", "<|endoftext|>", "é é", "a\r\n\tb", "😀👨‍👩‍👧 x", "�\x00", "don't I'LL", "   three   spaces ", "١٢٣", "12O.5", "a" * 3000, " " * 500 + "x"]


def test_ids_equal_the_library(bpe, library):
    random.seed(4)
    letters = "aetoinshrdlu .,'\n\t-0123456789äé中😀́<|>_ "
    texts = ODD + ["".join(random.choices(letters, k=random.randint(0, 90))) for _ in range(2000)]
    for t in texts:
        ids = bpe.encode(t)
        assert ids == library.encode(t, add_special_tokens=False).ids
        assert bpe.decode(ids) == t and bpe.count(t) == len(ids)


def test_encode_table(spark, library):
    data = [(i, t) for i, t in enumerate([*ODD, None])] + [(None, "x"), (1, " "), (1, " ")]
    df = spark.createDataFrame(data, DOCS).select("*", F.lit(1).alias("ids"), F.lit(2).alias("n_tokens"))
    got = encode(df)
    assert got.columns == ["doc_id", "ids"]
    want = Counter((d, tuple(library.encode(t or "", add_special_tokens=False).ids)) for d, t in data)
    assert Counter((r.doc_id, tuple(r.ids)) for r in got.collect()) == want
    assert {r.doc_id: r.text for r in decode(got).where("doc_id > 1").collect()} == {d: t or "" for d, t in data if d and d > 1}
    assert encode(df.limit(0)).count() == 0 and count_tokens(df, "doc_id").agg(F.sum("n_tokens")).first()[0] == sum(len(k[1]) * n for k, n in want.items())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=8), st.sampled_from(["'s", "'ll", " ", "\n", "\u3000", "\x1c", "\x85", "\u2028", "x\u0301", "\u00b2", "7", "\U0001f600", "\U00012000"]))).map("".join))
def test_both_engines_divide_alike(text):
    assert divider()(text) == regex.findall(PATTERN, text)


def test_texts_move_only_if_splits_are_few_or_large(spark, tmp_path, monkeypatch):
    shuffled = lambda df: "Exchange" in df._jdf.queryExecution().executedPlan().toString()
    few = spark.range(100).select(F.col("id").alias("doc_id"), F.lit("text").alias("text")).repartition(2)
    few.write.parquet(str(tmp_path / "few"))
    few.repartition(16).write.parquet(str(tmp_path / "many"))
    few, many = (spark.read.parquet(str(tmp_path / n)) for n in ("few", "many"))
    spark.conf.set("spark.sql.files.openCostInBytes", "128m")  # a split per file
    try:
        assert shuffled(dealt(few, "doc_id", "text")) and dealt(few, "doc_id", "text").count() == 100
        assert not shuffled(dealt(many, "doc_id", "text"))
        monkeypatch.setattr("velotrace.llm.bpe.LARGEST_SPLIT", 10)
        assert shuffled(dealt(many, "doc_id", "text"))
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_ids_of_the_test_table(spark, sf, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r.ids for r in lq.p8_ids(spark, sf).collect()}
    assert got == {d: library.encode(t or "", add_special_tokens=False).ids for d, t in docs.items()}


# 10


def pieces_of(spark, texts, **how):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], DOCS)
    out: dict[int, list] = {}
    for r in split(df, **how).orderBy("doc_id", "piece").collect():
        out.setdefault(r.doc_id, []).append(r)
    return out


def check_pieces(texts, out, bpe, limit, overlap):
    for i, t in enumerate(texts):
        ps = out[i]
        assert [p.piece for p in ps] == list(range(len(ps))) and all(p.n_pieces == len(ps) for p in ps)
        if t is None:
            assert ps[0].piece_text is None
            continue
        raw = t.encode()
        assert ps[0].start_byte == 0 and ps[-1].end_byte == len(raw) and ps[0].n_tokens == bpe.count(t)
        assert (len(ps) > 1) == (bpe.count(t) > limit)
        for a, b in zip(ps, ps[1:], strict=False):
            assert a.start_byte < b.start_byte <= a.end_byte < b.end_byte
            assert bpe.count(raw[b.start_byte : a.end_byte].decode()) <= overlap + 2
        for p in ps:
            assert p.piece_text == raw[p.start_byte : p.end_byte].decode() and bpe.count(p.piece_text) <= limit


def test_pieces(spark, bpe):
    random.seed(6)
    words = ["ride", "kerb", "the", "Münster", "12.5", "cm", "overtake", "中文", "😀"]
    sentence = lambda: " ".join(random.choices(words, k=random.randint(3, 14))) + random.choice([". ", "! ", "? ", ".\n", ".\n\n", '." '])
    texts = ["".join(sentence() for _ in range(n)) for n in (1, 30, 200, 900)]
    texts += [None, "", " ", "a" * 9000, "😀" * 2000, " \n" * 3000, "x" * 300 + " word" * 400, "\r\n".join("line %d" % i for i in range(900)), "word " * 999 + "end"]
    check_pieces(texts, pieces_of(spark, texts), bpe, 1000, 50)
    check_pieces(texts, pieces_of(spark, texts, limit=120, overlap=10), bpe, 120, 10)
    check_pieces(texts[:4], pieces_of(spark, texts[:4], limit=120, overlap=0), bpe, 120, 0)


def test_cuts_prefer_strong_boundaries(spark):
    block = "one two three four five six seven eight nine ten. " * 12
    text = (block + "\n\n") * 12
    assert {p.boundary for p in pieces_of(spark, [text])[0]} == {"P"}
    assert {p.boundary for p in pieces_of(spark, [block * 12])[0][:-1]} == {"S"}
    assert {p.boundary for p in pieces_of(spark, ["word " * 3000])[0][:-1]} == {"W"}
    assert {p.boundary for p in pieces_of(spark, ["ab" * 9000])[0][:-1]} == {"C"}
    with pytest.raises(ValueError, match="room"):
        split(spark.createDataFrame([], DOCS), limit=10, overlap=9)


def test_boundaries_with_many_blanks_or_closing_marks(spark):
    block = "one two three four five six seven eight nine ten " * 12
    assert {p.boundary for p in pieces_of(spark, [(block + "end\n" + " " * 40 + "\n") * 20])[0]} == {"P"}
    assert {p.boundary for p in pieces_of(spark, [(block + 'end."\')]}"\') ') * 20])[0][:-1]} == {"S"}


def test_overlap_of_long_words_is_in_tokens(spark, bpe):
    random.seed(8)
    texts = ["".join(random.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", k=9000)), "".join(chr(random.randint(0x4E00, 0x9FA5)) for _ in range(2500)), "straßenbahnhaltestelle" * 900]
    out = pieces_of(spark, texts)
    check_pieces(texts, out, bpe, 1000, 50)
    for i, t in enumerate(texts):
        for a, b in zip(out[i], out[i][1:], strict=False):
            assert 45 <= bpe.count(t.encode()[b.start_byte : a.end_byte].decode()) <= 52
    # no token ends with a character for more than 40 tokens: characters count as their bytes
    assert stretches_of("é".encode() * 50, [1, *[2] * 49, 1]) == ([2] * 50, [2] * 50)
    assert stretches_of("aéb".encode(), [2, 1, 1]) == ([2, 1], [3, 1])


def test_split_documents(spark):
    df = spark.createDataFrame([(1, "a b " * 600), (2, "a b " * 600), (2, "a b " * 600), (None, "a b " * 600), (3, "short"), (4, None)], DOCS)
    assert sorted(r.doc_id for r in split_documents(df).collect()) == [1, 2]
    assert split_documents(df.limit(0)).count() == 0


# 7


def test_reading_runs(spark):
    values = {0: "50", 1: "52", 2: "x", 3: "49.5", 6: "50", 10: "50", 11: "50", 12: "0", 13: "50", 14: "50", 15: "53", 16: "57"}
    data = [reading(i, s, v) for i, (s, v) in enumerate(values.items())] + [reading(50, 0, "999"), reading(60, 1, "1", lat=None)]
    data += [reading(70 + i, i, "9", box="small") for i in range(4)]
    got = reading_runs(spark.createDataFrame(data, RAW).select("*", F.lit("?").alias("entity"), F.lit(1).alias("v"))).collect()
    assert sorted((r.entity, r.start_us - us(0), r.end_us - us(0), r.n) for r in got) == [("b", 0, 6_000_000, 4), ("b", 13_000_000, 15_000_000, 3)]
    assert reading_runs(spark.createDataFrame([], RAW)).count() == 0


def test_one_run_over_many_shards(spark):
    data = [reading(i, 2.5 * i, "80") for i in range(3000)]
    got = reading_runs(spark.createDataFrame(data, RAW)).collect()
    assert [(r.n, r.duration_us) for r in got] == [(3000, 2999 * 2_500_000)]


def test_overtake_runs(spark):
    e = lambda i, s, end, n, traj="t": (f"{traj}_ev{i}", traj, i, at(s), at(end), n)
    data = [e(1, 0, 2, 3), e(1, 0, 2, 3), e(2, 22, 23, 3), e(3, 43.000001, 44, 3), e(4, 50, None, 3), e(5, 60, 61, None), e(6, 62, 63, None), e(7, 64, 65, 2), e(8, 64, 66, 2), e(1, 0, 1, 3, None), e(9, None, 1, 2), ("x", "u", None, at(100), at(101), 5), ("y", "u", None, at(105), at(106), 5)]
    df = spark.createDataFrame(data, "event_uid string, traj_id string, event_id long, `start` timestamp, `end` timestamp, n_samples long")
    got = sorted((r.start_us - us(0), r.end_us - us(0), r.n) for r in overtake_runs(df).collect())
    assert got == [(0, 23_000_000, 2), (43_000_001, 50_000_000, 2), (64_000_000, 66_000_000, 2), (100_000_000, 106_000_000, 2)]
    assert overtake_runs(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="shard"):
        collapse(df, SAME, shard_s=60, ride_gap_s=600)


# 6


@settings(max_examples=30, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=400), st.integers(20, 400))
def test_clusters_keep_mass(values, delta):
    v = np.array(values)
    m, w = cluster(v, np.ones(len(v)), delta)
    assert w.sum() == len(v) and math.isclose((m * w).sum(), v.sum(), rel_tol=1e-9, abs_tol=1e-3) and len(m) <= delta + 1
    assert (np.diff(m) >= -1e-9).all()


def test_merged_parts_keep_the_rank_bound():
    rng = np.random.default_rng(8)
    v = rng.lognormal(5, 1, 200_000)
    parts = [cluster(x, np.ones(len(x))) for x in np.array_split(rng.permutation(v), 60)]
    m, w = cluster(*(np.concatenate(x) for x in zip(*parts, strict=True)))
    p = np.array([0.001, 0.01, 0.25, 0.5, 0.9, 0.999])
    ranks = np.searchsorted(np.sort(v), quantile(m, w, v.min(), v.max(), p)) / len(v)
    assert np.abs(ranks - p).max() < 0.004 and np.abs(ranks - p)[[0, -1]].max() < 0.0005


def test_percentiles_per_group_and_day(spark):
    rows = spark.range(20_000).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 100 == 1, None).otherwise(F.concat(F.lit("g"), (F.col("id") % 7).cast("string"))).alias("g"),
        (F.col("id") % 5).cast("string").alias("day"), (F.col("id") * 7919 % 10007).cast("double").alias("v"), F.lit("?").alias("estimates"),
    )
    bad = spark.createDataFrame([("nan", "1", float("nan"), "?"), ("null", "1", None, "?"), ("inf", "1", float("inf"), "?"), ("one", "1", 4.0, "?")], rows.schema)
    got = percentiles(rows.unionByName(bad), "v", ["g"], [0.1, 0.5, 0.99]).collect()
    assert {r.g for r in got} == {"hot", None, "one", *(f"g{i}" for i in range(7))} and max(r.rank_error for r in got) <= 0.005
    assert [r.estimate for r in got if r.g == "one"] == [4.0] * 3
    by_day = build(rows, "v", ["g", "day"]).repartition(9)
    whole = merge(by_day, F.get_json_object("digest_key", "$.g"))
    exact = {r.g: r.n for r in rows.groupBy("g").agg(F.count("*").alias("n")).collect()}
    assert {r.digest_key: r.n for r in estimates(whole, [0.5]).collect()} == exact
    assert percentiles(rows.limit(0), "v", ["g"], [0.5]).count() == 0


def test_fine_digests_keep_every_value():
    rng = np.random.default_rng(3)
    v = rng.gamma(2.0, 50.0, 9000)
    m, w = cluster(np.concatenate([v[:4000], v[4000:]]), np.ones(9000), 60_000)
    assert len(m) == 9000 and (w == 1).all()
    p = np.array(lq.SHARES)
    assert (quantile(m, w, v.min(), v.max(), p) == np.sort(v)[np.ceil(p * 9000 - 1e-9).astype(int) - 1]).all()


# 9


def corpus(spark, n=4000):
    random.seed(7)
    rows = [(i, random.choices(["big", "mid", "small", None, "other"], [60, 25, 5, 5, 5])[0], random.choice([0, 3, 20, 150, 900])) for i in range(n)]
    return rows, spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")


TARGETS = "source string, target_share double, max_repeats int"


def test_shares_are_reached(spark):
    rows, df = corpus(spark)
    targets = spark.createDataFrame([("big", 0.45, 1), ("mid", 0.25, 2), ("small", 0.25, 5), ("absent", 0.05, 3), (None, 0.1, 1)], TARGETS)
    mix, plan = mixed(df, targets)
    picked = mix.collect()
    assert len({r.doc_id for r in picked}) == len(picked)
    cap = {"big": 1, "mid": 2, "small": 5}
    assert all(1 <= r.copies <= cap[r.source] and r.n_tokens > 0 for r in picked)
    got = {r.source: r for r in shares(mix, plan, targets).collect()}
    for s, share in (("big", 0.45), ("mid", 0.25), ("small", 0.25)):
        assert abs(got[s].actual_share - share / 0.95) < 0.002
        assert got[s].n_tokens_available == sum(n for _, x, n in rows if x == s)
    assert got["absent"].actual_share == 0 and got["absent"].n_docs == 0
    again = mixed(df.repartition(7), targets)[0].collect()
    assert sorted((r.doc_id, r.copies) for r in again) == sorted((r.doc_id, r.copies) for r in picked)


def test_many_sources_are_joined_without_broadcast(spark, monkeypatch):
    _, df = corpus(spark, 800)
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.5, 2)], TARGETS)
    picks = lambda: sorted((r.doc_id, r.copies) for r in mixed(df, targets)[0].collect())
    want = picks()
    monkeypatch.setattr("velotrace.operators.skew.is_small", lambda df: False)
    split = joined_by
    monkeypatch.setattr("velotrace.llm.mixing.joined_by", lambda a, b, keys, hot, by, n, how: split(a, b, keys, hot, by, 50, how))
    assert picks() == want


def test_inclusion_follows_size(spark):
    rows = [(i, "s", 10 if i % 2 else 40) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("s", 1.0, 3)], TARGETS)
    for power, ratio in ((0.0, 1.0), (1.0, 4.0)):
        n = Counter(r.n_tokens for r in mixed(df, targets, total=30_000, size_power=power)[0].collect())
        assert 0.8 < n[40] / n[10] / ratio < 1.25
    more = mixed(df, targets, total=250_000)[0].collect()
    assert abs(sum(r.n_tokens * r.copies for r in more) - 250_000) <= 20 and {r.copies for r in more} == {2, 3}
    assert {r.copies for r in mixed(df, targets, total=10**9)[0].collect()} == {3}


def test_mix_of_nothing(spark):
    _, df = corpus(spark, 50)
    targets = spark.createDataFrame([("big", 1.0, 1)], TARGETS)
    assert mixed(df.limit(0), targets)[0].count() == 0
    assert mixed(df, targets.limit(0))[0].count() == 0
    mix, plan = mixed(df.limit(0), targets)
    assert [(r.source, r.actual_share) for r in shares(mix, plan, targets).collect()] == [("big", 0.0)]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["a", "b"]), st.integers(0, 60)), min_size=1, max_size=60), st.integers(1, 3), st.integers(1, 4))
def test_no_cap_is_passed(spark, docs, cap_a, cap_b):
    df = spark.createDataFrame([(i, *d) for i, d in enumerate(docs)], "doc_id long, source string, n_tokens long")
    mix, _ = mixed(df, spark.createDataFrame([("a", 0.3, cap_a), ("b", 0.7, cap_b)], TARGETS))
    assert all(1 <= r.copies <= {"a": cap_a, "b": cap_b}[r.source] for r in mix.collect())
