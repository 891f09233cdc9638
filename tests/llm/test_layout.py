"""Sharding, mixing, packing, chat formatting, search and the pipeline."""

import hashlib
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tessera.llm import chat, mixing, packing, registry, sharding, topk_search

TINY = "/root/testdata/sf0.001"


@pytest.mark.parametrize("which", ["corpus", "odd"])
def test_sharding(request, which):
    df = request.getfixturevalue(which)
    rows = sharding.assign_shards(df, 8, oversplit=16).collect()
    texts = [(r["doc_id"], r["text"]) for r in df.collect()]
    want = sorted(str((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode()))) for d, t in texts)
    assert sorted(str((r["doc_id"], r["size"], r["text_crc32"])) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r)
    assert all(sorted(r["slot"] for r in v) == list(range(len(v))) for v in by.values()) and set(by) <= set(range(8))
    sizes = [sum(r["size"] for r in v) for v in by.values()]
    if which == "corpus":
        assert max(sizes) - min(sizes) < max(r["size"] for r in rows) and len(by) == 8
    assert {(r["law"], r["grown_shard"]) for r in rows} == {("bytes", None)}


def test_one_text_fills_many_shards(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("the same text " * 5)).otherwise(F.concat(F.lit("text "), "id")).alias("text"))
    sizes = [r["b"] for r in sharding.assign_shards(df, 10).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(sizes) == 10 and max(sizes) < 1.02 * min(sizes)


def test_sharding_nothing(nothing):
    assert sharding.assign_shards(nothing).count() == 0


def test_mixing(corpus, odd, nothing):
    rows = mixing.taken(corpus).join(corpus.select("doc_id", "source"), "doc_id").collect()
    by = defaultdict(list)
    for r in rows:
        by[r["source"]].append(r)
    total = sum(r["size"] for r in rows)
    share = {s: w for s, w in zip(sorted(by), [5, 2, 1] * 9, strict=False)}
    sizes = {s: sum(r["size"] for r in v) for s, v in by.items()}
    targets = {s: total * w / sum(share.values()) for s, w in share.items()}
    while over := [s for s in targets if targets[s] > 3 * sizes[s] + 1e-6]:
        excess = sum(targets[s] - 3 * sizes[s] for s in over)
        for s in over:
            targets[s] = 3 * sizes[s]
        free = [s for s in targets if targets[s] < 3 * sizes[s]]
        weight = sum(share[s] for s in free)
        for s in free:
            targets[s] += excess * share[s] / weight
    for s, v in by.items():
        assert v[0]["target"] == pytest.approx(targets[s]) and abs(sum(r["taken"] for r in v) - targets[s]) < 1.01
    assert all(r["taken"] <= 3 * r["size"] for r in rows)
    assert sorted(map(tuple, mixing.taken(corpus).collect())) == sorted(map(tuple, mixing.taken(corpus).collect()))
    mix = mixing.mix_documents(corpus)
    words = {r["doc_id"]: 0 for r in rows}
    for r in mix.collect():
        words[r["doc_id"]] += len(r["text"].split())
        assert r["n_chars"] == len(r["text"])
    assert words == {r["doc_id"]: r["taken"] for r in rows} and mix.columns == corpus.columns
    assert mixing.taken(odd).count() == odd.count() and mixing.mix_documents(odd).columns == odd.columns
    assert mixing.taken(nothing).count() == 0 and mixing.mix_documents(nothing).count() == 0


def test_token_ids():
    path = packing.default_tokenizer()
    t = Tokenizer.from_file(path)
    for x in ["", " ", "it's I'LL 'tis  \n\n x  ", "a<|endoftext|>b", "\t\n ", "don't've''s 12ab#$%..' s", "é'sÀ'll  ", "ĳ ½ ² 日本語 'll", "a b c\x1cd", "x" * 3000, "año ñandú 😀"]:
        assert np.frombuffer(packing.token_ids(x, path), "<u4").tolist() == [*t.encode(x, add_special_tokens=False).ids, 2]
    assert np.frombuffer(packing.token_ids(None, path), "<u4").tolist() == [2]


@pytest.mark.parametrize("which", ["corpus", "odd", "nothing"])
def test_packing(request, which):
    df = request.getfixturevalue(which)
    rows = packing.pack(df).collect()
    t = Tokenizer.from_file(packing.default_tokenizer())
    want = []
    for r in df.collect():
        ids = np.asarray([*t.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        first = (len(ids) - 1) % 1024 + 1
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        want += [str((r["doc_id"], k, a, b - a, zlib.crc32(ids[a:b].tobytes()))) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    assert sorted(str((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])) for r in rows) == sorted(want)
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for v in by.values():
        v.sort()
        assert [o for o, _ in v] == [sum(n for _, n in v[:i]) for i in range(len(v))] and sum(n for _, n in v) <= 1024
    assert len(by) <= -(-sum(r["length"] for r in rows) // 1024) * 1.05 + 1


def test_packing_program():
    rng = np.random.default_rng(2)
    for counts in (rng.integers(0, 400, 1025), np.bincount([700] * 50 + [324] * 50, minlength=1025), np.bincount([513] * 10, minlength=1025), np.zeros(1025, int)):
        counts[0] = 0
        patterns, n_program = packing.solve(counts)
        assert 0 <= n_program <= sum(n for _, n in patterns)
        assert (sum((p * n for p, n in patterns), np.zeros(1025, int)) == counts).all()
        assert all((p * np.arange(1025)).sum() <= 1024 for p, _ in patterns)
        used, least = sum(n for _, n in patterns), -(-int((counts * np.arange(1025)).sum()) // 1024)
        assert used <= max(least * 1.01 + 1, counts[513:].sum())


@pytest.mark.parametrize(("docs", "share"), [(10_000, 0.75), (100_000, 0.9)])
def test_packing_comes_from_the_program(docs, share):
    """Of the sequences that aren't one full piece nearly all are patterns of the program, and few are wasted."""
    n = np.maximum(2, np.random.default_rng(6).lognormal(6.0, 1.2, docs)).astype(int)
    counts = np.bincount((n - 1) % 1024 + 1, minlength=1025)
    counts[1024] += ((n - 1) // 1024).sum()
    patterns, n_program = packing.solve(counts)
    used, least = sum(k for _, k in patterns), -(-int((counts * np.arange(1025)).sum()) // 1024)
    assert n_program >= share * (used - counts[1024]) and used <= 1.002 * least + 1


def turns_of(spark):
    rows = [(1, 0, "user", "a\\b #1 <x>"), (1, 1, "assistant", None), (1, None, "assistant", "Ω end"), (2, 0, None, "</turn>\n### user <turn>\n"), (3, 1, "assistant", "\\" * 7), (3, 0, "assistant", ""), (None, 0, "user", "x"), (3, 0, "assistant", "")]
    rows += [(9, i, "user" if i % 2 else "assistant", f"turn {i} \\# <") for i in range(60)]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


@pytest.mark.parametrize("batch", [1000, 3])
def test_chat(spark, batch, monkeypatch):
    monkeypatch.setattr(chat._formatted, "__defaults__", (batch,))
    df = chat.with_probe(turns_of(spark))
    convs = defaultdict(list)
    for r in df.collect():
        convs[r["conv_id"]].append((r["turn"] is None, r["turn"] or 0, r["role"] or "", r["text"] or ""))
    want = []
    for c, v in convs.items():
        v.sort()
        loss = "".join(t for *_, r, t in v if r == "assistant")
        chars = sum(20 + len(r) + len(t) + sum(x in "\\#<" for x in r + t) for *_, r, t in v)
        want.append(str((c, len(v), hashlib.sha256("".join(f"{r}\n{t}\n" for *_, r, t in v).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), chars)))
    assert sorted(str(tuple(r)) for r in chat.digests(df).collect()) == sorted(want)
    assert chat.digests(df.where("false")).count() == 0


def brute_search(rows, k=20):
    v = [(i, np.floor(64 * np.asarray(e, float)).astype(int)) for i, e in rows if e is not None and i is not None and all(x is not None and np.isfinite(x) for x in e)]
    out = []
    for q, a in v:
        if q % 20 == 0:
            n = lambda b: min(len(a), len(b))
            scored = sorted((-int(a[: n(b)] @ b[: n(b)]), i) for i, b in v if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize("sizes", [(32_768, 4_096), (90, 7)])
def test_search(spark, sizes, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(0, 1, 8)]) for i in range(300)]
    same = rows[40][1]
    rows += [(i, same) for i in range(300, 420)] + [(500, None), (501, [float("nan")] * 8), (502, [None] * 8), (503, [float("inf")] + [0.0] * 7), (520, []), (540, [0.5, -0.5]), (None, same)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, score int")
    monkeypatch.setattr(topk_search, "SHARD_ROWS", sizes[0])
    monkeypatch.setattr(topk_search, "GROUP_ROWS", sizes[1])
    monkeypatch.setattr(topk_search, "BLOCK", 16)
    got = sorted(tuple(r) for r in topk_search.search(df).collect())
    assert got == brute_search([(i, None if e is None else [None if x is None else float(np.float32(x)) for x in e]) for i, e in rows])


def test_search_few(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (20, [1.0])], "vec_id long, embedding array<float>")
    assert sorted(tuple(r)[:3] for r in topk_search.search(df).collect()) == [(0, 1, 1), (0, 2, 20), (20, 1, 1), (20, 2, 0)]
    assert topk_search.search(df.where("false")).count() == 0 and topk_search.search(df.where("vec_id = 0")).count() == 0


@pytest.mark.parametrize("copies", [2, 25])
def test_search_repeated_query_row(spark, copies):
    """A query's repeated row leaves room for all of its equals; a repeated candidate is an entry each time."""
    rows = [(0, [1.0])] * copies + [(i, [1.0]) for i in range(1, 26)] + [(3, [1.0])] * 30 + [(90, [0.5])]
    got = defaultdict(list)
    for r in topk_search.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(got[0]) == [(i + 1, v, 4096) for i, v in enumerate([1, 2, *[3] * 18])]
    assert sorted(got[20]) == [(i + 1, v, 4096) for i, v in enumerate(([0] * copies + [1, 2, *[3] * 31])[:20])]
    once = [(0, [1.0])] * copies + [(i, [1.0]) for i in range(1, 26)]
    few = topk_search.search(spark.createDataFrame(once, "vec_id long, embedding array<float>")).where("query_id = 0").collect()
    assert sorted((r["rank"], r["vec_id"]) for r in few) == [(i, i) for i in range(1, 21)]


@pytest.mark.parametrize("name", ["op2_topk_search", "op6_chat_format", "op8_mixing"])
def test_oracles(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{TINY}/{t}.parquet')")
    df = registry.queries()[name](spark, TINY)
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, con.execute(f"SELECT {', '.join(df.columns)} FROM ({registry.oracle_sql()[name]})").fetchall()))


def test_pipeline(spark):
    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    sizes, now = [docs.count()], docs
    for name, step in corpus_pipeline.STAGES[:-1]:
        now = spark.createDataFrame(step(spark, now, TINY).toPandas(), docs.schema)
        assert now.columns == docs.columns, name
        sizes.append(now.count())
    assert sizes[0] > sizes[1] > sizes[2] >= sizes[3] > 0
    rows = corpus_pipeline.run(spark, TINY).collect()
    assert sum(r["length"] for r in rows) == sum(r["length"] for r in packing.pack(now).collect())


def test_workers_remember_few_parts():
    """A text of ASCII and Latin letters needs no whole tokenizer beside the ranks, and a worker's memory of parts is bounded."""
    path = packing.default_tokenizer()
    packing._whole.cache_clear()
    text = " ".join(f"{a}{b}q{a}x" for a in "abcdefghij" for b in "klmnopqrst")
    ids = packing.token_ids(text, path)
    assert packing._whole.cache_info().currsize == 0 and packing._KNOWN_WORDS <= 100_000
    assert np.frombuffer(ids, "<u4").tolist() == [*packing._whole(path).encode(text, add_special_tokens=False).ids, packing.END_ID]
