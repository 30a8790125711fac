"""The day-table run of the README on small CSV files: 78 features, three clients, dirty values."""

import numpy as np
from pyspark.sql import functions as F

from tidegate.operators import cleaning, federation, networks, sampling, scaling, training
from tidegate.session import written
from tidegate.sources import flows as sources


def write_days(folder):
    rng = np.random.default_rng(5)
    header = ",".join(f" f{i:02d} " for i in range(1, 79)) + ", Label"
    files = {c: sources.DAY_FILES[c] for c in (3, 4, 5)}
    for client, name in files.items():
        x = rng.normal(size=(300 + client, 78)).round(4).astype(object)
        bad = (x[:, 0] + x[:, 1]).astype(float) > 0.5
        x[3, 5], x[4, 6], x[5, 7], x[6, 8] = "Infinity", "-Infinity", "NaN", ""
        x[:, 77] = 1.0
        x[10:20] = x[10]                                     # copies of one flow
        bad[10:20] = bad[10]
        names = np.where(bad, "DDoS", "BENIGN")
        lines = [",".join(map(str, [*r, n])) for r, n in zip(x, names)]
        (folder / name).write_text("\n".join([header, *lines]) + "\n")
    return sources.catalog(str(folder), files)


def test_federated_days(spark, tmp_path):
    days = sources.read_catalog(spark, write_days(tmp_path), sources.day_schema())
    names = sources.feature_names(78)
    rows = sampling.with_row_id(days)
    rows = cleaning.repair_infinities(cleaning.binarise_label(rows), names)
    marked = sampling.split_by_share(rows, 0.2, ["row_id"])
    train = marked.where(~F.col("is_test"))
    marked = cleaning.encode_label(marked, cleaning.fit_label_codes(train), out="attack")
    stats = scaling.fit_robust(train, names)
    assert stats.where("scale_f78 <> 1.0").isEmpty()
    ready = written(cleaning.assemble_features(scaling.scale(marked, stats, names), names))
    assert {r["client"]: r["count"] for r in ready.where("is_test").groupBy("client").count().collect()} == {3: 61, 4: 61, 5: 61}
    width = cleaning.width_violations(ready, 78).first()
    assert (width["n_rows"], width["n_bad"]) == (912, 0)

    shards = training.lay_out_shards(ready.where(~F.col("is_test")), ["row_id"], "attack", rows_per_shard=20_000)
    layout = networks.VARIANTS["v3"]
    run = federation.federate(shards, layout, training.Fit("SGD", lr=0.01, epochs=30, batch_size=16), rounds=3)
    holdout = sampling.mini_batches(sampling.shuffle_rows(ready.where("is_test"), ["row_id"]))
    records = federation.evaluate_rounds(holdout, layout, run.models, label="attack")
    accuracy = {r["round"]: r["mean_accuracy_pct"] for r in federation.server_metrics(records).collect()}
    share = ready.agg(F.avg("attack")).first()[0]
    assert accuracy[3] > 100 * max(share, 1 - share) and accuracy[3] > accuracy[0]
    # no batch can fall below ln(1 + 1/e) with a second softmax
    lowest = records.agg(F.min("loss")).first()[0]
    assert lowest >= 2 * np.log(1 + np.exp(-1))


def test_narrowed_scaler_over_more_columns_than_one_pass(spark, tmp_path):
    days = sources.read_catalog(spark, write_days(tmp_path), sources.day_schema())
    names = sources.feature_names(78)[50:]
    rows = cleaning.repair_infinities(days, names)
    direct = scaling.fit_robust(rows, names).orderBy("client").toPandas()
    narrowed = scaling.fit_robust(rows, names, direct_rows=0).orderBy("client").toPandas()
    assert np.allclose(direct.to_numpy(dtype=float), narrowed[direct.columns].to_numpy(dtype=float), rtol=1e-12)
