"""The three learned operators: held-out accuracy and awkward rows."""

import numpy as np
import pytest

from plumbline.llm import language, quality, toxicity
from plumbline.llm.linear import newton
from plumbline.llm.queries import QUERIES
from tests.llm.helpers import AWKWARD, prose, table

SF = "/root/testdata/sf0.01"


def auc(score, label):
    rank = np.argsort(np.argsort(score)) + 1.0
    good = label == 1
    n1, n0 = good.sum(), (~good).sum()
    return (rank[good].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)


@pytest.mark.parametrize(("name", "label", "least"), [
    ("op6_quality_classifier", "quality", 0.97), ("op3_toxicity", "toxic", 0.85)])
def test_held_out_documents(spark, name, label, least):
    out = QUERIES[name](spark, SF)
    rows = out.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert auc(rows["score"].to_numpy() + 1e-9 * np.arange(len(rows)), rows[label].to_numpy()) > least
    assert ((rows["predicted"] == 1) == (rows["score"] >= {"quality": 0.3, "toxic": 0.7}[label])).all()
    assert out.count() == 1000


def test_languages_of_held_out_documents(spark):
    out = QUERIES["op7_language_id"](spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = out.join(docs, "doc_id").where("held_out").toPandas()
    assert (rows["lang"] == rows["lang_pred"]).mean() > 0.97
    assert rows["score"].between(0, 1).all()


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int, text string")


def test_awkward_rows_are_scored(spark):
    rows = [(i, prose(i, 40) if i % 2 else "idiot trash " + prose(i, 40) + " ### " * 20, "en", "s")
            for i in range(60)] + AWKWARD
    docs = table(spark, rows)
    marks = labels(spark, [(i, i % 2, 1 - i % 2, "x") for i in range(60)]
                   + [(i, None, None, None) for i in range(60, 70)] + [(None, 1, 0, "x"), (1, 1, 0, "x")])
    for got in (quality.quality_scores(docs, marks), toxicity.toxicity(docs, marks)):
        got = got.collect()
        assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    tox = {r.doc_id: r for r in got}
    assert tox[3].predicted == 0 and tox[4].predicted == 1 and tox[901].predicted == 0
    none = labels(spark, [])
    assert {r.score for r in quality.quality_scores(docs, none).collect()} == {0.5}
    assert {r.score for r in toxicity.toxicity(docs, none).collect()} == {0.0}
    empty = table(spark, [])
    assert not quality.quality_scores(empty, marks).collect()
    assert not toxicity.toxicity(empty, marks).collect() and not language.languages(empty).collect()
    kept = quality.filtered(docs, None)
    assert kept.columns == docs.columns and kept.count() == len(rows)


def test_undetermined_languages(spark):
    rows = [(i, prose(i, 30) if i % 2 else "le la les " * 20, "en" if i % 2 else "fr", "s") for i in range(40)]
    got = {r.doc_id: r for r in language.languages(table(spark, rows + AWKWARD)).collect()}
    assert {got[d].lang_pred for d in (901, 902, 903, 909)} == {"und"}
    assert all(got[i].lang_pred == ("en" if i % 2 else "fr") for i in range(40))
    untaught = table(spark, [(1, "some text", None, "s")])
    assert [(r.lang_pred, r.score) for r in language.languages(untaught).collect()] == [("und", 0.0)]


def test_disguises_fold_to_the_word():
    plain = toxicity.fold_tokens("idiot loser trash")
    assert toxicity.fold_tokens("1d10t*** L0ser!! tr@sh") == plain
    assert toxicity.fold_tokens("іdіоt") == plain[:1]
    assert toxicity.fold_tokens("ＩＤＩＯＴ") == plain[:1]
    assert toxicity.fold_tokens("2024 was 10 days") == ["2024", "was", "10", "days"]


def test_exception_phrases_cancel_matches():
    model = {"weights": {" trash ": 2.0, " scum": 1.5}, "exceptions": ["trash can"]}
    machine = toxicity.automaton(model)
    x = toxicity.evidence(["trash", "the trash can", "trash can trash", "scummy scum", "", "mytrash"], machine)
    assert np.allclose(np.expm1(x[:, 0]), [2, 0, 2, 3, 0, 0])


def test_pairwise_fit_orders_by_the_true_score():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    truth = x @ [2.0, -1.0, 0.0]
    a, b = rng.integers(0, 400, 3000), rng.integers(0, 400, 3000)
    better = np.where(truth[a] > truth[b], a, b)
    worse = np.where(truth[a] > truth[b], b, a)
    w = newton(x[better] - x[worse], None)
    assert np.corrcoef(x @ w, truth)[0, 1] > 0.99


def test_ftrl_is_sparse_and_right():
    rng = np.random.default_rng(1)
    rows, label = [], []
    for i in range(300):
        y = i % 3
        ids = np.unique(np.append(rng.integers(10, 200, 8), y)).astype(np.int32)
        rows.append((ids, np.full(len(ids), 1 / np.sqrt(len(ids)))))
        label.append(y)
    w = language.ftrl(rows, np.array(label), 3, 200, l1=0.3)
    hit = [int(np.argmax(v @ w[i] + w[-1])) == y for (i, v), y in zip(rows, label)]
    assert np.mean(hit) > 0.97 and (w == 0).mean() > 0.3


def test_folds_follow_crc32(spark):
    import zlib

    from plumbline.llm.linear import fold
    got = spark.range(50).select("id", fold("id", 5).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 5 for r in got)


def test_quality_learns_from_every_labelled_row(spark):
    """Beyond 20,000 rows too: counts, knots, pairs and threshold cover all of them."""
    rng = np.random.default_rng(3)
    n = 24_000
    x, label = rng.normal(size=(n, 2)).round(2), (np.arange(n) % 3 > 0).astype(int)
    x[:, 0] += label
    rows = spark.createDataFrame(
        [(int(label[i]), i, x[i].tolist()) for i in range(n)], "label int, _h bigint, x array<double>").coalesce(3)
    model = quality.fit(rows, 10)
    assert np.allclose(model["knots"], np.quantile(x, quality.KNOTS, axis=0).T, atol=1e-12)
    raw = quality.hinges(x, model["knots"], np.ones(1))
    assert np.allclose(model["scale"], np.maximum(raw.std(axis=0), 1e-9))
    s = raw / model["scale"] @ model["weights"]
    assert np.isclose(model["cut"], np.quantile(s, (label == 0).mean()))
    assert auc(s, label) > 0.75
    known = spark.createDataFrame([(int(i < 5), i % 5 + 1, [float(i)]) for i in range(8)],
                                  "label int, _n bigint, x array<double>")
    pairs = [(r.won[0], r.lost[0]) for r in quality.paired(known, 5, 3, 1).collect()]
    assert {a for a, _ in pairs} == {0, 1, 2, 3, 4} and {b for _, b in pairs} == {5, 6, 7}
    assert len(set((r.won[0], r.lost[0]) for r in quality.paired(known, 5, 3, 15).collect())) == 15
