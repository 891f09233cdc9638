"""Quality rules, toxicity and the quality network."""

import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from tessera.llm import quality_cnn, quality_rules, toxicity

SMALL = "/root/testdata/sf0.01"


def expected_counts(text):
    text = text or ""
    w = [x for x in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text).split(" ") if x]
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_counts_and_verdicts(odd, odd_rows):
    got = sorted(map(str, (tuple(r) for r in quality_rules.verdicts(odd).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect())))
    want = []
    for r in odd_rows:
        c = expected_counts(r[1])
        want.append(str((r[0], *c, c[0] < 10 or 100 * c[4] > 20 * c[0])))
    assert got == sorted(want)


def test_order_does_not_change_verdicts(odd):
    frames = [quality_rules.measure(odd, []).select(quality_rules.cascade(list(order)).isNull().alias("k")).collect() for order in (quality_rules.RULES, quality_rules.RULES[::-1])]
    assert frames[0] == frames[1]


def test_rules_reject_what_they_name(spark):
    clean = " ".join(f"word{i}" for i in range(40))
    junk = {"symbol_share": clean.replace(" ", "%% "), "upper_case_share": clean.upper().replace("WORD", "WORDS"), "mean_word_length": "x" * 400 + " a b c d e f g h i j k l", "base": "too short"}
    rows = [(n, t) for n, t in junk.items()] + [(None, clean)]
    df = spark.createDataFrame(rows, "name string, text string")
    from pyspark.sql import functions as F

    got = quality_rules.measure(df, [F.col("name")]).select("name", quality_rules.cascade(list(quality_rules.RULES)).alias("by")).collect()
    assert all(r["name"] == r["by"] for r in got)


def test_length_alone_rejects_nothing(spark):
    rng = np.random.default_rng(5)
    long, poor = (" ".join(f"word{i}" for i in rng.integers(0, n, 60_000)) for n in (4_000, 40))
    docs = spark.createDataFrame([(1, long), (2, poor)], "doc_id long, text string")
    assert [r["doc_id"] for r in quality_rules.keep_documents(docs).collect()] == [1]


def test_keep_documents(odd, nothing):
    kept = quality_rules.keep_documents(odd)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} >= {5, 7, 8, 17, 18}
    assert kept.where("doc_id = 5").count() == 3  # repeated rows stay
    assert quality_rules.keep_documents(nothing).count() == 0 and quality_rules.verdicts(nothing).count() == 0


def test_labelled_rows_of_the_tables(spark):
    """Clean labelled documents stay, junk goes."""
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    kept = {(r["quality"], r["kept"]): r["count"] for r in quality_rules.verdicts(docs).join(labels, "doc_id").groupBy("quality", "kept").count().collect()}
    assert kept.get((1, True), 0) / (kept.get((1, True), 0) + kept.get((1, False), 0)) > 0.95
    assert kept.get((0, False), 0) / (kept.get((0, True), 0) + kept.get((0, False), 0)) > 0.95


def test_order_is_one(corpus):
    """Costs are counted, so every call gives one order, whatever way the rows are dealt."""
    given = (*quality_rules.RULES, *quality_rules.BASE)
    orders = {tuple(r.name for r in quality_rules.order_rules(corpus.repartition(n), given=given)) for n in (1, 3, 5, 3, 1)}
    assert len(orders) == 1 and len(next(iter(orders))) == len(given)


def test_native_plan(odd):
    plan = quality_rules.verdicts(odd)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_grammar():
    lexicon = toxicity._Lexicon({"idiot"}, set(), set())

    def found(text):
        return np.expm1(toxicity.matches(text, lexicon)).round(4).tolist()

    assert found("You are an idiot.") == [1, 0, 0]  # strong, weak, threats: targeted ones weigh 1
    assert found("such idiot") == [0.25, 0, 0] and found("idiot, you") == [1, 0, 0]
    assert found("He is not an idiot.") == [0.125, 0, 0] and found("Er ist nicht idiot. Sie ist nicht da.") == [0.125, 0, 0]
    assert found("She said you are an idiot. What a clown!") == [0.125, 1, 0]
    assert found("I will kill you.") == [0, 0, 1] and found("kill time here.") == [0, 0, 0]
    assert found("Die Leute und der Mann. die and be gone, du") == found("la la") == [0, 0, 0]  # German: die is no threat
    assert found("") == [0] * 3 and found("IDIOT\nidiot") == [0.5, 0, 0]


def test_transducers_compose():
    """The composed machine writes what its parts write one after another."""
    rng = np.random.default_rng(7)
    parts = [toxicity._scope(toxicity.REPORT, toxicity._SOFTER, None), toxicity._scope(toxicity.NEGATION, toxicity._SOFTER, 4), toxicity._scope(toxicity.TARGET, toxicity._AIMED, 8)]
    for _ in range(300):
        clause = bytes(rng.choice(list(b"IWTYNR......"), rng.integers(0, 30)).astype(np.uint8))
        want = clause
        for t in parts:
            want = bytes(t.run(want))
        assert bytes(toxicity.FORWARD.run(clause)) == want


def test_clauses_matter(monkeypatch):
    """The same words score differently in another order, and the patterns catch what bare words don't."""
    lexicon = toxicity._Lexicon({"idiot"}, set(), set())
    words = ["w"] * 30 + ["you", "idiot"]
    apart = ["you", *words[:30], "idiot"]
    assert (toxicity.matches(" ".join(words), lexicon) > toxicity.matches(" ".join(apart), lexicon)).any()
    rng = np.random.default_rng(5)
    texts, y = [], []
    for i in range(600):
        w = [f"t{x}" for x in rng.integers(0, 200, 40)]
        kind = i % 3
        w[20] = "idiot" if kind < 2 else "you"  # insults stand in clean texts too, in reported speech
        w[17] = "you" if kind == 0 else w[17]
        w[0] = "said" if kind == 1 else w[0]
        texts.append(" ".join(w))
        y.append(int(kind == 0))
    y = np.asarray(y, float)

    def accuracy():
        x = np.stack([toxicity.matches(t, lexicon) for t in texts])
        w = toxicity.fit_weights(x[::2], y[::2])
        return ((x[1::2] @ w[:-1] + w[-1] > 0) == y[1::2]).mean()

    assert accuracy() == 1
    monkeypatch.setattr(toxicity, "rewritten", lambda clause: clause)
    assert accuracy() < 0.8


def labelled(spark, n=400):
    rng = np.random.default_rng(1)
    rows, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        w = [f"t{x}" for x in rng.integers(0, 300, 60)]
        if toxic:
            for at in rng.integers(0, 60, 3):
                w[at] = f"grubnik{'abcde'[at % 5]}" if i % 8 else "zorp"
        junk = i % 5 == 1
        text = " ".join(w).upper().replace(" ", "!! ") if junk else " ".join(w)
        rows.append((i, text, "x", "x", 1))
        labels.append((i, int(not junk), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize(("module", "label", "modulus"), [(toxicity, "toxic", 3), (quality_cnn, "quality", 5)])
def test_held_out_accuracy(spark, module, label, modulus):
    docs, labels = labelled(spark)
    rows = module.score(docs, labels).join(labels, "doc_id").collect()
    keep = 1 if label == "toxic" else 0
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % modulus == keep) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["predicted"] == r[label] for r in held) / len(held) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= module.CUT) for r in rows)


def test_held_out_labels_are_not_read(spark):
    """Turning every held-out label round changes no score."""
    docs, labels = labelled(spark, 200)
    for module, label in ((toxicity, "toxic"), (quality_cnn, "quality")):
        turned = labels.selectExpr("doc_id", f"if({module.HELD_OUT}, 1 - {label}, {label}) as {label}")
        a, b = ({r["doc_id"]: r["score"] for r in module.score(docs, x).collect()} for x in (labels, turned))
        assert a == b


@pytest.mark.parametrize("module", [toxicity, quality_cnn])
def test_odd_rows_are_scored(spark, odd, nothing, module):
    labels = spark.createDataFrame([(3, 1, 0), (5, 1, 0), (16, 0, 1), (None, 1, 1), (17, None, None)], "doc_id long, quality int, toxic int")
    rows = module.score(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] == 5}) == 1
    assert module.score(nothing, labels).count() == 0
    assert module.score(odd, labels.where("false")).count() == odd.count()


def test_chunks_cover_the_text():
    data = bytes(np.random.default_rng(0).integers(1, 255, 2000, dtype=np.uint8))
    for n in (0, 1, 63, 64, 383, 384, 385, 704, 705, 2000):
        rows, lengths = quality_cnn.chunks(data[:n])
        step = quality_cnn.CHUNK - quality_cnn.OVERLAP
        whole = bytearray(n)
        for i, (r, k) in enumerate(zip(rows, lengths, strict=True)):
            whole[i * step : i * step + k] = bytes(r[:k])
        assert bytes(whole) == data[:n] and (lengths > 0).all() | (n == 0)


def test_oracle_agrees(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM read_parquet('/root/testdata/sf0.001/documents.parquet')")
    df = quality_rules.verdicts(docs)
    assert sorted(map(tuple, df.collect())) == sorted(con.execute(f"SELECT {', '.join(df.columns)} FROM ({quality_rules.ORACLE})").fetchall())
