import inspect

import numpy as np

from tanglaw.operators import model
from tanglaw.plans import pipelines
from tanglaw.sources.tables import load


def test_forest_of_the_reference(spark):
    forest = model.forest()
    assert (forest.getNumTrees(), forest.getMaxDepth(), forest.getMinInstancesPerNode()) == (200, 30, 2)
    defaults = inspect.signature(model.cross_validated).parameters
    assert (defaults["trees"].default, defaults["depth"].default) == (200, 30)


def test_predictions_of_the_index(spark, data):
    index = load(spark, data, "high_resource_index")
    rows = pipelines.fold_features(load(spark, data, "all_languages"), index, load(spark, data, "anchor_ngrams"))
    out = {r.doc_id: r for r in model.cross_validated(rows, pipelines.FEATURES, trees=3, depth=4).collect()}
    want = {r.doc_id: r for r in pipelines.folds(index).collect()}
    assert out.keys() == want.keys() and len(out) > 50 and len(pipelines.FEATURES) == 14
    assert all((r.fold, r.y_true) == (want[d].fold, want[d].label - 1) and r.y_pred in (0, 1, 2) for d, r in out.items())


def test_perceptron_and_transfer(spark, data):
    from tanglaw import queries

    rows = queries.perceptron_cross_validation(spark, data).collect()
    assert len({r.doc_id for r in rows}) == len(rows) > 0 and {r.y_pred for r in rows} <= {0, 1, 2}
    held = queries.zero_shot_transfer(spark, data).collect()
    assert {r.language for r in held} <= {"hiligaynon", "minasbate", "karay-a", "rinconada"} and all(0 <= r.macro_f1 <= 1 for r in held)


def test_build_of_the_corpus(spark, data):
    from tanglaw import queries
    from tanglaw.sources.tables import load

    out = queries.corpus_build(spark, data)
    raw = {r.doc_id: r.text for r in load(spark, data, "all_languages").collect()}
    rows = out.collect()
    assert rows and all(r.text.strip() and len(r.text.split()) >= 3 and raw[r.doc_id] for r in rows) and len({r.doc_id for r in rows}) == len(rows)


def table_of(spark, n=400, parts=3):
    """Rows of three classes that two of four features tell, with other classes for every tenth row."""
    rows = [(k, "x", k % 5, (k // 5) % 3 if k % 10 else k % 3, float((k // 5) % 3 + k % 7 / 10), float(k % 11), float(k % 13), float(-((k // 5) % 3))) for k in range(n)]
    return spark.createDataFrame(rows, "doc_id bigint, language string, fold int, label int, a double, b double, c double, d double").repartition(parts, "b", "doc_id")


def jobs(spark):
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return spark.sparkContext._jsc.sc().statusStore().jobsList(None).size()


def test_jobs_do_not_grow_with_levels(spark):
    """Trees are grown within tasks; a job for each level of each fold took minutes on small tables."""
    before = jobs(spark)
    rows = model.cross_validated(table_of(spark), ("a", "b", "c", "d"), trees=20).collect()
    assert jobs(spark) - before <= 12
    assert len({r.doc_id for r in rows}) == len(rows) == 400 and sum(r.y_true == r.y_pred for r in rows) > 350


def test_predictions_do_not_depend_on_partitions(spark):
    one, other = ({(r.doc_id, r.y_pred) for r in model.cross_validated(table_of(spark, parts=n), ("a", "b", "c", "d"), trees=9).collect()} for n in (1, 4))
    assert one == other


def test_local_and_distributed_forest_agree(spark, monkeypatch):
    local = {r.doc_id: r.y_pred for r in model.cross_validated(table_of(spark), ("a", "b", "c", "d"), trees=20).collect()}
    monkeypatch.setattr(model, "LOCAL", 0)
    spread = {r.doc_id: r.y_pred for r in model.cross_validated(table_of(spark), ("a", "b", "c", "d"), trees=20).collect()}
    assert local.keys() == spread.keys() and sum(local[d] == spread[d] for d in local) > 0.95 * len(local)


def test_a_tree_obeys_its_rules(monkeypatch):
    rng = np.random.default_rng(3)
    codes, label = rng.integers(0, 32, (600, 5)).astype(np.uint8), rng.integers(0, 3, 600)
    votes = model.grow(codes, label, codes, 30, np.random.default_rng(1))
    assert (abs(votes.sum(1) - model.VOTE) <= 3).all() and (votes.argmax(1) == label).mean() > 0.5
    # No levels: every row gets the classes' shares of the bag, which weigh the same but for the draw.
    flat = model.grow(codes, label, codes, 0, np.random.default_rng(1))
    assert len(np.unique(flat, axis=0)) == 1 and abs(flat[0] / model.VOTE - 1 / 3).max() < 0.1
    # Leaves hold two rows of the bag or more.
    alone = model.grow(np.array([[0], [9]], np.uint8), np.array([0, 1]), np.array([[0], [9]], np.uint8), 30, np.random.default_rng(0))
    assert (alone[0] == alone[1]).all() or np.random.default_rng(0).poisson(1.0, 2).min() >= 2
    # A level of many nodes is done in groups.
    monkeypatch.setattr(model, "CELLS", 32 * 3 * 8)
    few = model.grow(codes, label, codes, 30, np.random.default_rng(1))
    assert (abs(few.sum(1) - model.VOTE) <= 3).all() and (few.argmax(1) == label).mean() > 0.5


def test_metrics_of_the_forest(spark, data):
    """The whole query runs few jobs, and its rows are those of the out-of-fold predictions."""
    from tanglaw import queries

    before = jobs(spark)
    rows = {r.language: r for r in queries.forest_metrics(spark, data).collect()}
    assert jobs(spark) - before <= 60
    want = pipelines.folds(load(spark, data, "high_resource_index")).groupBy("language").count().collect()
    assert {r.language: rows[r.language].n_docs for r in want} | {"all": sum(r["count"] for r in want)} == {k: r.n_docs for k, r in rows.items()}


def test_nodes_that_cannot_be_split_are_not_counted(monkeypatch):
    """Over rows of one class a tree counts the classes of its root, not the bins of its values."""
    rows, bincount = [], np.bincount
    monkeypatch.setattr(model.np, "bincount", lambda *a, **k: rows.append(len(a[0])) or bincount(*a, **k))
    codes = np.random.default_rng(2).integers(0, 32, (300, 9)).astype(np.uint8)
    votes = model.grow(codes, np.zeros(300, np.int64), codes, 30, np.random.default_rng(1))
    assert (votes == model.VOTE).all() and len(rows) == 2


def test_features_count_words_in_one_text(spark, data):
    """The text of a document's words is made once, and no feature makes skeletons of words one by one."""
    rows = pipelines.features14(load(spark, data, "all_languages"), load(spark, data, "anchor_ngrams"))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_join(") == 1 and "transform(" not in plan
