"""Legacy archives, hard negatives and collocations, against brute force."""

import base64
import gzip
import hashlib
import random
import tracemalloc
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest

from tessera.llm import collocations, hard_negatives, joins, warc

# WARC


def test_warc_round_trip(spark):
    pages = [(i, f"http://h/{i}", f"<p>{i % 7}</p>" * (i % 7), "x") for i in range(60)]
    pages += [(100, None, None, "x"), (101, "http://a b/\nc", "", "x"), (102, "http://é/", "日本" * 3000, None), (None, "http://n/", "<p>1</p>", None), (59, "http://again/", "<p>3</p>" * 3, None)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, record_id string").repartition(3)
    rows = warc.report(df).collect()
    digest = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    groups = defaultdict(list)
    for page, _, text, _ in pages:
        groups[digest(text or "")].append((page, len((text or "").encode())))
    assert sorted(map(str, ((r["page_id"], r["payload_bytes"], r["payload_digest"]) for r in rows))) == sorted(str((p, n, d)) for d, g in groups.items() for p, n in g)
    for d, g in groups.items():
        own = [r for r in rows if r["payload_digest"] == d]
        top = max((p for p, _ in g if p is not None), default=None)
        assert [r["page_id"] for r in own if r["record_type"] == "response"] == [top]
        assert {r["refers_to"] for r in own if r["record_type"] == "revisit"} <= {top}
    assert warc.report(df.where("false")).count() == 0
    assert {r["record_type"] for r in warc.report(df, least=10**9).collect()} == {"response"}


def test_hot_payload(spark, monkeypatch):
    monkeypatch.setattr(joins, "HEAVY_ROWS", 20)
    df = spark.range(300).selectExpr("id as page_id", "'u' as url", "if(id % 3 = 0, 'same', cast(id as string)) as html")
    rows = warc.report(df).collect()
    assert len(rows) == 300 and Counter(r["refers_to"] for r in rows if r["record_type"] == "revisit") == {297: 99}


def arc(version, records, declared=None):
    fields = " ".join(warc.ARC_FIELDS[version])
    block = f"{version} 0 someone\n{fields}\n".encode()
    extra = " 200 - - 0 old.arc" if version == 2 else ""
    out = f"filedesc://old{version}.arc 0.0.0.0 19970101000000 text/plain{extra} {len(block)}\n".encode() + block + b"\n"
    for url, body in records:
        out += f"{url} 1.2.3.4 19980203040506 text/html{extra} {declared or len(body)}\n".encode() + body + b"\n"
    return out


def test_reads_both_versions(spark, tmp_path):
    (tmp_path / "in").mkdir()
    message = b"HTTP/1.0 200 OK\r\nA: b\r\n\r\nline\n\nhttp://fake 1 19980203040506 x 4\nbody\xff"
    (tmp_path / "in" / "a.arc").write_bytes(arc(1, [("http://a/with blank", message), ("dns:a", b"1.2.3.4")]))
    (tmp_path / "in" / "b.arc.gz").write_bytes(gzip.compress(arc(2, [("http://b/", message)])) + gzip.compress(b""))
    (tmp_path / "in" / "c.arc").write_bytes(arc(1, [("http://c/", message)]).replace(b"\nhttp://c/", b"\n?? stray bytes\nhttp://c/"))
    (tmp_path / "in" / "d.arc").write_bytes(arc(1, [("http://d/", b"short")], declared=999))
    (tmp_path / "in" / "e.arc").write_bytes(b"")
    rows = {r["url"]: r for r in warc.read_arc(spark, f"file://{tmp_path}/in").collect() if r["type"] != "warcinfo"}
    assert {u: r["version"] for u, r in rows.items()} == {"http://a/with blank": 1, "dns:a": 1, "http://b/": 2, "http://c/": 1, warc.NO_URL: 1, "http://d/": 1}
    assert all(bytes(rows[u]["block"]) == message for u in ("http://a/with blank", "http://b/", "http://c/"))
    assert (rows["dns:a"]["type"], rows["http://b/"]["type"]) == ("resource", "response")
    assert (rows[warc.NO_URL]["damage"], bytes(rows[warc.NO_URL]["block"])) == ("no header", b"?? stray bytes\n")
    assert rows["http://d/"]["damage"] == "cut off" and bytes(rows["http://d/"]["block"]) == b"short\n"
    warc.convert(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out")
    files = [gzip.decompress(f.read_bytes()) for f in (tmp_path / "out").rglob("*.gz")]
    assert all(f.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n") and f.endswith(b"\r\n\r\n") for f in files)
    back = warc.read_warc(spark, f"file://{tmp_path}/out").collect()
    kinds = Counter(r["type"] for r in back)
    assert kinds["response"] == 1 and kinds["revisit"] == 2 and kinds["resource"] == 3
    (whole,) = (r for r in back if r["type"] == "response")
    assert bytes(whole["block"]) == message and whole["date"] == "1998-02-03T04:05:06Z"
    assert {r["refers_to"] for r in back if r["type"] == "revisit"} == {whole["record_id"]}


# hard negatives


def vectors(spark, rng, n, width=8, labels=4, copies=0):
    centres = rng.normal(size=(labels, width))
    rows = []
    for i in range(n):
        label = int(rng.integers(labels))
        v = centres[label] * rng.choice([0.2, 1.0]) + rng.normal(size=width)
        rows.append((i, [float(x) for x in (centres[0] if i % 3 == 0 and copies else v)], label))
    return rows


SCHEMA = "vec_id long, embedding array<double>, label int, q string, _shard int, windows int, norm string"


@pytest.mark.parametrize(("copies", "shard"), [(0, 10_000), (0, 150), (1, 150)])
def test_hard_negatives(spark, monkeypatch, copies, shard):
    monkeypatch.setattr(hard_negatives, "SHARD_ROWS", shard)
    monkeypatch.setattr(joins, "HEAVY_ROWS", 5)
    rows = vectors(spark, np.random.default_rng(3), 600, copies=copies)
    rows += [(1000, None, 1), (1050, [float("nan")] * 8, 1), (1100, [1.0, None], 1), (1150, [1.0] * 8, None), (1200, [0.5, 0.25], 2), (1250, [], 3), (1300, [-9.0] * 8, 77), (None, [1.0] * 8, 1)]
    rows.append(rows[50])  # a repeated row counts once
    df = spark.createDataFrame([(*r, "x", 1, 2, None) for r in rows], SCHEMA)
    got = hard_negatives.mine(df).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()
    con = duckdb.connect()
    embeddings = spark.createDataFrame(rows[:-1], "vec_id long, embedding array<double>, label int").toPandas()
    embeddings["label"] = embeddings["label"].astype("Int64")
    embeddings["vec_id"] = embeddings["vec_id"].astype("Int64")
    con.register("given", embeddings)
    con.execute("CREATE VIEW embeddings AS SELECT vec_id, label, CASE WHEN embedding IS NULL THEN NULL ELSE list_concat(embedding, list_transform(range(8 - len(embedding)), lambda x: 0.0)) END AS embedding FROM given")
    sql = hard_negatives.ORACLE.replace("(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END)", "label")
    assert sorted(map(tuple, got)) == sorted(con.execute(sql).fetchall()) and got


def test_hard_negatives_nothing(spark):
    assert hard_negatives.mine(hard_negatives.relabelled(spark.createDataFrame([], SCHEMA))).count() == 0


def test_index_leaves_out_and_prunes():
    rng = np.random.default_rng(1)
    energy = np.asarray([40, 30, 20, 10, 2, 1, 1, 1])
    x = np.round(rng.normal(size=(5_000, 8)) * energy).astype(np.int64)
    index = hard_negatives.ShardIndex(np.arange(5_000), np.zeros(5_000, np.int64), x, np.arange(8))
    asks, own = x[:40], np.arange(40)
    scores = asks @ x.T
    for low in (np.sort(scores, axis=1)[:, -4], np.full(40, -(10**6))):
        found = {(int(a), int(r)): int(s) for block in index.matches(asks, np.zeros(40, np.int64), own, low, True) for a, r, s in zip(*block, strict=True)}
        assert found == {(a, r): int(scores[a, r]) for a in range(40) for r in range(5_000) if scores[a, r] >= low[a] and a != r}


# collocations


def brute(rows, least, top):
    counts, totals = defaultdict(Counter), Counter()
    table = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", b"\n" * 10 + b" ")
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in (text or "").encode().lower().translate(table).split(b"\n"):
            w = [x.decode() for x in piece.split(b" ") if x]
            totals[lang] += len(w)
            for m in range(1, 5):
                counts[lang].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, f in counts.items():
        often = {p: a for p, a in f.items() if a >= least and len(p) > 1}
        gone = {p[i : i + k] for p, a in often.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * a >= 80 * f[p[i : i + k]]}
        scored = []
        for p, a in often.items():
            if p not in gone:
                score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, lf, r, totals[lang], -s) for i, (s, a, p, lf, r) in enumerate(sorted(scored)[:top])]
    return out


def test_collocations(spark, odd_rows):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(40)] + ["Ünd", "日本", "\xa0x"]
    rows = [(rng.choice(["en", "de", None, "und"]), "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ", ", "!\n", "\r"]) for _ in range(rng.randrange(1, 120)))) for _ in range(300)]
    rows += [("en", "of the same KIND as before; " * 40), ("en", "a a a a a a a a " * 30), ("fr", "only ends"), ("en", None), ("en", ""), ("x", " . ")]
    rows += [(r[2], r[1]) for r in odd_rows]
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], "lang string, text string, phrase string, n int, `prefix` string").repartition(3)
    for least, top in ((3, 200), (30, 2000)):
        got = collocations.collocations(df, least=least, top=top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
        assert sorted(map(tuple, got)) == sorted(brute(rows, least, top)) and got
    assert collocations.collocations(df.where("false")).count() == 0


def test_windows_cross_shipments_and_parts(monkeypatch):
    """The same stripes, however often a task ships them and wherever a long text is cut."""
    rng = random.Random(4)
    text = "".join(f"w{rng.randrange(9)}" + rng.choice([" ", " ", ". "]) for _ in range(3_000)).encode()
    batch = collocations.pa.RecordBatch.from_arrays([collocations.pa.array(["en"]), collocations.pa.array([text.decode()])], names=["lang", "text"])

    class Told:
        value = collocations._Sieve(64, np.full(1, np.iinfo(np.uint64).max, np.uint64), np.empty(0, np.uint64))  # lets everything pass

    def counted(m):
        out = Counter()
        for b in collocations._count(m, Told)(iter([batch])):
            for r in b.to_pylist():
                for e in r["stripe"]:
                    out[r["prefix"], r["slice"], e["next"]] += e["n"]
        return out

    whole = [counted(m) for m in range(1, 5)]
    monkeypatch.setattr(collocations, "WINDOWS", 37)
    monkeypatch.setattr(collocations, "PART_BYTES", 50)
    assert [counted(m) for m in range(1, 5)] == whole


def test_many_words(monkeypatch):
    """Vocabularies whose windows do not fit one machine word."""
    rng = np.random.default_rng(6)
    columns = [rng.integers(1, 70_000, 500) for _ in range(4)]
    words = collocations.pa.array([""] + [f"w{i}" for i in range(1, 70_000)])
    rows = collocations._stripes("en", [np.r_[c, c] for c in columns], np.arange(1_000) % 500 < 250, words).to_pylist()
    want = Counter((" ".join(f"w{c[i]}" for c in columns[:3]), f"w{columns[3][i]}") for i in range(500))
    assert {(r["prefix"], e["next"]): e["n"] for r in rows for e in r["stripe"]} == {k: 2 * n for k, n in want.items()}


def test_counting_takes_little_memory():
    """Windows of one shipment: their ids, keys and stripes stay far below what whole arrays of 64-bit ids took."""
    rng = np.random.default_rng(7)
    number = rng.integers(0, 60_000, 1_000_000)
    counter = collocations._Counter("en", 2, collocations._Sieve(64, np.full(1, np.iinfo(np.uint64).max, np.uint64), np.empty(0, np.uint64)))
    known = collocations.pa.array([f"w{i}".encode() for i in range(60_000)], collocations.pa.binary())
    counter.read(known, (number + 1).astype(np.int32))
    tracemalloc.start()
    n = sum(len(b) for b in counter.ship(last=True))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == len(np.unique(number)) and peak < 70 * len(number)


def test_stripes_take_little_room(spark):
    """The first two levels write 0.44 of the size of these texts to shuffle files; a struct for each counter took 0.83."""
    rng = np.random.default_rng(8)
    number = np.minimum(rng.zipf(1.2, (2_000, 150)), 20_000)
    rows = [("en", " ".join(f"word{i}" + "." * (i % 17 == 0) for i in line)) for line in number.tolist()]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(2).localCheckpoint()
    env = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get()
    dirs = [str(d) for d in env.blockManager().diskBlockManager().localDirs()]
    files = lambda: {f: f.stat().st_size for d in dirs for f in Path(d).rglob("shuffle_*.data")}
    known, written = files(), {}
    for m, sieve in ((1, None), (2, collocations._Sieve(64, np.full(1, np.iinfo(np.uint64).max, np.uint64), np.empty(0, np.uint64)))):
        found = collocations.stripes(df, m, sieve).collect()
        written[m] = sum(size for f, size in files().items() if f not in known)
        known = files()
        assert found
    assert sum(written.values()) < 0.6 * sum(len(r[1]) for r in rows), written


def test_stripes_keep_every_kind_of_word(spark):
    """Stripes are shipped as joined words: no character of a word may split, join or lose one."""
    odd = ["|", "\\", "\x1c", "\x00", " ", " ", "　", "😀", "a\x1fb", "[x]", "$1", "(", "ﬀ", "é"]
    rows = [("en", " ".join(odd[i % len(odd)] + odd[j % len(odd)] for i in range(9))) for j in range(60)] + [("en", " ".join(odd))] * 35
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    got = collocations.collocations(df, least=4).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows, 4, 2000)) and got


def test_windows_that_cannot_count_are_not_shipped():
    """A window whose prefix or end is infrequent is part of no candidate."""
    words = [b"a", b"b", b"c"]
    bits = np.zeros(1 << 10, np.uint64)
    at = np.concatenate(collocations._Sieve.places(collocations._Sieve.fold("en", [collocations._hashes(words[:2])]), 1 << 16))
    np.bitwise_or.at(bits, at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63)))

    class Told:
        value = collocations._Sieve(1 << 16, bits, np.empty(0, np.uint64))

    batch = collocations.pa.RecordBatch.from_arrays([collocations.pa.array(["en"]), collocations.pa.array(["a b c a a. b a, a c b"])], names=["lang", "text"])
    got = {(r["prefix"], e["next"]): e["n"] for b in collocations._count(2, Told)(iter([batch])) for r in b.to_pylist() for e in r["stripe"]}
    assert got == {("a", "b"): 1, ("a", "a"): 1, ("b", "a"): 1}
