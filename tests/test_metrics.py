from gullwatch.operators.metrics import METRICS, classification_metrics, confusion, fold_summary


def scored(spark, tp, fp, tn, fn):
    rows = [(1, 1.0)] * tp + [(0, 1.0)] * fp + [(0, -1.0)] * tn + [(1, -1.0)] * fn
    return spark.createDataFrame(rows, "label int, prediction double")


def test_metrics(spark):
    counts = confusion(scored(spark, 6, 2, 8, 4))
    assert tuple(counts.first()) == (6, 2, 8, 4)
    m = classification_metrics(counts).first()
    assert (m.tpr, m.tnr, m.fpr, m.fnr, m.accuracy) == (0.6, 0.8, 0.2, 0.4, 0.7)
    assert (m.precision, m.recall, m.avg_tp_tn) == (0.75, 0.6, 0.7)
    assert m.f_measure == 0.66667 and m.g_mean == 0.69282


def test_legacy_names(spark):
    m = classification_metrics(confusion(scored(spark, 6, 2, 8, 4)), legacy_names=True).first()
    assert (m.fpr, m.fnr, m.precision, m.recall, m.f_measure) == (0.4, 0.2, 0.6, 0.75, 0.6)


def test_no_positives_gives_zero_rates(spark):
    m = classification_metrics(confusion(scored(spark, 0, 0, 3, 0))).first()
    assert (m.tpr, m.fnr, m.precision, m.f_measure, m.accuracy) == (0.0, 0.0, 0.0, 0.0, 1.0)


def test_fold_summary(spark):
    parts = [classification_metrics(confusion(scored(spark, 6, 2, 8, n))) for n in (2, 4)]
    summary = {r.metric: r for r in fold_summary(parts[0].unionByName(parts[1])).collect()}
    assert set(summary) == set(METRICS)
    assert (summary["tpr"].min, summary["tpr"].max, summary["tpr"].avg, summary["tpr"].std) == (0.6, 0.75, 0.675, 0.075)
