"""SimHash, paragraph dedup and components against brute force."""

from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tessera.llm import paragraph_dedup, simhash
from tessera.llm.components import components


def union(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = np.random.default_rng(seed)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 60, (45, 2))] + [(i, i + 1) for i in range(100, 130)] + [(7, int(x)) for x in range(200, 240)]
    pairs += [(-5, 3), (3, -5), (9, 9)]
    ids = sorted({x for p in pairs for x in p})
    at = {x: i for i, x in enumerate(ids)}
    want = union(len(ids), [(at[a], at[b]) for a, b in pairs])
    got = {r["a"]: r["root"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert {x: got.get(x, x) for x in ids} == {x: ids[want[at[x]]] for x in ids}


def brute_fingerprint(text):
    w = [x for x in "".join(" " if c in "\t\n\x0b\x0c\r" else c.lower() if "A" <= c <= "Z" else c for c in text or "").split(" ") if x]
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
    h = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def check_simhash(df):
    rows = df.select("doc_id", "text").collect()
    fps = [brute_fingerprint(r["text"]) for r in rows]
    f = np.asarray(fps, np.uint64)
    pairs = [(i, int(j)) for i in range(len(f)) for j in np.flatnonzero(np.bitwise_count(f ^ f[i]) <= 3) if j > i]
    root = union(len(f), pairs)
    least = {}
    for r, c in zip(rows, root, strict=True):
        if r["doc_id"] is not None:
            least[c] = min(least.get(c, r["doc_id"]), r["doc_id"])
    want = sorted(str((r["doc_id"], f"{fp:016x}", least.get(c))) for r, fp, c in zip(rows, fps, root, strict=True))
    assert sorted(str(tuple(r)) for r in simhash.report(df).collect()) == want
    return len(set(root))


def test_simhash_corpus(corpus):
    groups = check_simhash(corpus)
    kept = simhash.keep_first(corpus)
    assert kept.count() == groups < corpus.count() and kept.columns == corpus.columns


def test_simhash_odd(odd, nothing):
    check_simhash(odd)
    assert simhash.report(nothing).count() == 0 and simhash.keep_first(nothing).count() == 0
    kept = simhash.keep_first(odd)
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == odd.columns and len(ids) == len(set(ids)) and 5 in ids and 6 not in ids


@pytest.mark.parametrize("divide", [4096, 8])
def test_simhash_links_are_complete(spark, divide, monkeypatch):
    """A dense ball and its fringe, with and without dividing large keys."""
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 2**63, dtype=np.int64)
    balls = [centre]
    for _ in range(120):
        x = int(balls[rng.integers(0, len(balls))])
        for b in rng.integers(0, 63, rng.integers(1, 4)):
            x ^= 1 << int(b)
        balls.append(x)
    fps = sorted({int(x) for x in [*balls, *rng.integers(0, 2**63, 60, dtype=np.int64)]})
    f = np.asarray(fps, np.uint64)
    want = union(len(f), [(i, int(j)) for i in range(len(f)) for j in np.flatnonzero(np.bitwise_count(f ^ f[i]) <= 3) if j > i])
    monkeypatch.setattr(simhash, "DIVIDE_OVER", divide)
    keys = defaultdict(list)
    for x in fps:
        for v in range(64):
            half = x & 0xFFFFFFFF if v < 32 else x >> 32
            keys[v << 32 | half & ~(1 << v % 32)].append(x)
    at = {x: i for i, x in enumerate(fps)}
    pairs = [(at[int(a)], at[int(b)]) for k, g in keys.items() if len(g) > 1 for a_, b_ in simhash._linked(k, np.asarray(g, np.uint64)) for a, b in zip(a_, b_, strict=True)]
    assert union(len(f), pairs) == want and len(pairs) < 64 * len(f)


def brute_passages(docs, least=50):
    """Word places that must go: of each run of ``least`` words that stood before, and did not overlap itself there, all.
    ``docs``: (id, text), one for each text of an id."""
    seen, out = {}, set()
    for d, text in sorted({(-(2**63) if d is None else d, t or "") for d, t in docs}, key=lambda x: (x[0], xx(x[1]))):
        w, last = text.encode().lower().split(), {}
        for i in range(len(w) - least + 1):
            run = tuple(w[i : i + least])
            at = last.get(run)
            first = i if at is None or i - at[1] >= least else at[0]
            last[run] = (first, i)
            if seen.setdefault(run, (d, text, first)) != (d, text, first):
                out |= {(d, text, j) for j in range(first, i + least)}
    return out


def xx(text):
    """Spark's xxhash64, which orders the texts of one id."""
    h = xxhash.xxh64(text.encode(), seed=42).intdigest()
    return h - 2**64 if h >= 2**63 else h


def check_passages(df):
    """Every run that must go does; what goes beside has been there before, to a near-equal paragraph."""
    rows = {(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()}
    want = brute_passages(rows)
    ids = [d for d, _ in rows]
    got = paragraph_dedup.report(df).collect()
    text = {d: t or "" for d, t in rows if ids.count(d) == 1}
    places = {(r["doc_id"], j) for r in got for j in range(r["first_word"], r["first_word"] + r["n_words"]) if r["doc_id"] in text}
    assert {(d, j) for d, _, j in want if d in text} <= places
    grams = lambda t: list(zip(*((t or "").encode().lower().split()[i:] for i in range(5))))
    seen = {g for d, t in rows if d not in text for g in grams(t)}
    order = sorted(text.items(), key=lambda x: -(2**63) if x[0] is None else x[0])
    sets = {d: t.encode().lower().split() for d, t in order}
    for d, w in sets.items():
        gone = {j for e, j in places if e == d}
        mine = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        for r in (r for r in got if r["doc_id"] == d):
            some = mine[r["first_word"] : r["first_word"] + r["n_words"] - 4]
            before = seen | {g for i, g in enumerate(mine) if i < r["first_word"]}
            assert r["n_words"] >= 50 and sum(g in before for g in some) >= 0.6 * len(some)
        seen |= set(mine)
        assert gone <= set(range(len(w)))
    left = {r["doc_id"]: r["text"] for r in paragraph_dedup.remove_repeats(df).collect() if r["doc_id"] in text}
    for d, w in sets.items():
        stays = [x for j, x in enumerate(w) if (d, j) not in places]
        if stays or not w:
            assert (left[d] or "").encode().lower().split() == stays
        else:
            assert d not in left
    return {(d, j) for d, _, j in want}, places


def test_passages_corpus(corpus):
    want, places = check_passages(corpus)
    assert len(want) > 3000 and len(places) < 1.2 * len(want)
    assert paragraph_dedup.remove_repeats(corpus).columns == corpus.columns


def test_passages_odd(odd, nothing):
    check_passages(odd)
    assert paragraph_dedup.report(nothing).count() == 0 and paragraph_dedup.remove_repeats(nothing).count() == 0
    assert paragraph_dedup.remove_repeats(odd).columns == odd.columns


def test_passages_inside_lines(spark):
    """Passages that begin and end mid-line, go over line ends, come twice in one line, or are a word too short."""
    rng = np.random.default_rng(4)

    def some(n):
        return [f"w{x}" for x in rng.integers(0, 3000, n)]

    one, two, three, short = some(59), some(50), some(80), some(49)
    docs = [
        (1, [*some(58), *one, *some(9)]), (2, [*some(90), *one, *some(29)]), (3, [*some(7), *two, *some(70), *two, *some(3)]),
        (4, [*some(33), *three, *some(20)]), (5, [*some(11), *three[5:70], *some(40)]), (6, [*some(30), *short, *some(30)]), (7, [*some(60), *short, *some(5)]),
        (8, [*one[:55], *some(4)]), (9, ["A", "b"] * 90), (10, some(70)),
    ]
    rows = [(d, " ".join(w)) for d, w in docs]
    rows[4] = (5, " ".join(docs[4][1][:40]) + "  \n\n" + " ".join(docs[4][1][40:]))
    want = {(d, j) for d, _, j in brute_passages(rows)}
    assert {d for d, _ in want} == {2, 3, 5, 8}
    df = spark.createDataFrame([*rows, rows[1]], "doc_id long, text string").repartition(3)
    got = paragraph_dedup.report(df).collect()
    assert {(r["doc_id"], j) for r in got for j in range(r["first_word"], r["first_word"] + r["n_words"])} == want
    assert {r["doc_id"]: r["kept_doc_id"] for r in got} == {2: 1, 3: 3, 5: 4, 8: 1} and len(got) == 4
    left = {r["doc_id"]: r["text"] for r in paragraph_dedup.remove_repeats(df).collect()}
    assert {d: t.split() for d, t in left.items()} == {d: [x for j, x in enumerate(t.split()) if (d, j) not in want] for d, t in rows}
    assert left[1] == rows[0][1] and left[2] == " ".join([*docs[1][1][:90], *docs[1][1][149:]])


def test_equal_runs_always_meet():
    """Every run of 50 words, wherever it stands, holds a paragraph, and the same one."""
    rng = np.random.default_rng(8)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 5000, n)) for n in (50, 51, 400)] * 20
    run = [f"r{x}" for x in rng.integers(0, 300, 50)]
    texts += [" ".join([*(f"w{x}" for x in rng.integers(0, 5000, int(n))), *run, "end"]) for n in rng.integers(0, 200, 200)]
    h, text, place = paragraph_dedup._words(pa.array(texts))
    at, _ = paragraph_dedup._cuts(h, text, 50, 25)
    classes = paragraph_dedup._rolled(h, 25)[at]
    assert set(text[at].tolist()) == set(range(len(texts)))
    ends = np.bincount(text)
    inside = (text[at] >= 60) & (place[at] >= ends[text[at]] - 51) & (place[at] + 25 < ends[text[at]])
    common = set.intersection(*(set(classes[inside & (text[at] == t)].tolist()) for t in range(60, 260)))
    assert common and len(at) < len(h) / 10


def test_words_are_split_as_bytes_are():
    texts = ["", " ", "a", "A b\tC\n\n d", None, "\u00c4x \u00e4x\u00a0y", "w" * 900 + " " * 500 + "z", "x"]
    h, text, place = paragraph_dedup._words(pa.array(texts).slice(1))
    want = [(i, k, w) for i, t in enumerate(texts[1:]) for k, w in enumerate((t or "").encode().lower().split())]
    assert list(zip(text.tolist(), place.tolist())) == [(i, k) for i, k, _ in want]
    assert len({(x, w) for x, (_, _, w) in zip(h.tolist(), want)}) == len({w for _, _, w in want}) == len(set(h.tolist()))


@pytest.mark.parametrize("hot", [256, 4])
def test_near_equal_paragraphs_are_linked(spark, hot, monkeypatch):
    """Paragraphs with one word changed at an end: the links' components are those of all pairs."""
    monkeypatch.setattr(paragraph_dedup, "HOT", hot)
    monkeypatch.setattr(paragraph_dedup, "HELD", 4 * hot)
    rng = np.random.default_rng(2)
    rows = []
    for k in range(30):
        base = [f"b{k}x{x}" for x in rng.integers(0, 9000, 90)]
        for _ in range(45):
            w = list(base)
            for j in rng.choice(90, 2, replace=False):
                w[j] = f"n{rng.integers(10**9)}"
            rows.append((len(rows), " ".join(w)))
    given = paragraph_dedup._given(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), "doc_id", "text")
    got = paragraph_dedup.links(given, 0.8, 0.99).collect()
    h, text, place = paragraph_dedup._words(pa.array([t for _, t in rows]))
    at, alone = paragraph_dedup._cuts(h, text, 50, 25)
    words = [t.split() for _, t in rows]
    sets = {}
    for c, i, p in zip(paragraph_dedup._rolled(h, 25)[at[alone]].view(np.int64).tolist(), text[at[alone]], place[at[alone]]):
        w = words[i][p : p + 25]
        sets[c] = frozenset(zip(*(w[j:] for j in range(5))))
    ids = sorted(sets)
    pairs = [(i, j) for i in range(len(ids)) for j in range(i) if len(sets[ids[i]] & sets[ids[j]]) >= 0.8 * len(sets[ids[i]] | sets[ids[j]])]
    want, where = union(len(ids), pairs), {x: i for i, x in enumerate(ids)}
    have = union(len(ids), [(where[r["a"]], where[r["b"]]) for r in got])
    linked = [(i, j) for i, j in pairs]
    assert len(linked) > 100 and all(want[where[r["a"]]] == want[where[r["b"]]] for r in got)
    assert sum(have[i] == have[j] for i, j in linked) >= 0.98 * len(linked)


def test_overlapping_paragraphs_are_linked(spark):
    """Near-equal paragraphs are linked, whichever others they overlap in their own texts."""
    rng = np.random.default_rng(12)
    rows = []
    for k in range(20):
        base = [f"b{k}x{x}" for x in rng.integers(0, 9000, 90)]
        for _ in range(30):
            w = list(base)
            for j in rng.choice(90, 2, replace=False):
                w[j] = f"n{rng.integers(10**9)}"
            rows.append((len(rows), " ".join(w)))
    given = paragraph_dedup._given(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), "doc_id", "text")
    got = paragraph_dedup.links(given, 0.8, 0.99).collect()
    h, text, place = paragraph_dedup._words(pa.array([t for _, t in rows]))
    at, _ = paragraph_dedup._cuts(h, text, 50, 25)
    words = [t.split() for _, t in rows]
    sets = {}
    for c, i, p in zip(paragraph_dedup._rolled(h, 25)[at].view(np.int64).tolist(), text[at], place[at]):
        w = words[i][p : p + 25]
        sets[c] = frozenset(zip(*(w[j:] for j in range(5))))
    ids = sorted(sets)
    pairs = [(i, j) for i in range(len(ids)) for j in range(i) if len(sets[ids[i]] & sets[ids[j]]) >= 0.8 * len(sets[ids[i]] | sets[ids[j]])]
    where, beside = {x: i for i, x in enumerate(ids)}, set()
    own = [where[c] for c in paragraph_dedup._rolled(h, 25)[at].view(np.int64).tolist()]
    for a in range(len(at)):
        for b in range(a):
            if text[at[a]] == text[at[b]] and at[a] - at[b] < 25:
                beside |= {(own[a], own[b]), (own[b], own[a])}
    want, have = union(len(ids), pairs), union(len(ids), [(where[r["a"]], where[r["b"]]) for r in got])
    assert all(want[where[r["a"]]] == want[where[r["b"]]] for r in got)
    apart = [p for p in pairs if p not in beside]
    assert len(apart) > 100 and sum(have[i] == have[j] for i, j in apart) >= 0.98 * len(apart)


def test_near_equal_paragraphs_that_overlap_are_one(spark):
    """A text that changes slowly repeats no run of 50 words; its paragraphs are near-equal to those they overlap."""
    rows = [(k, " ".join(x for j in range(12) for x in [*[f"a{k}"] * 20, f"b{k}n{j}"])) for k in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert not brute_passages(rows) and paragraph_dedup.report(df).count() == 0


def test_bands_reach_the_recall():
    bands, rows = paragraph_dedup.tune_bands(0.8, 0.999)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.999
