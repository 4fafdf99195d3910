import json

from foldloom.session import new_folder
from foldloom.streaming import arrivals


def fold(condition, x, seed=42):
    return {"dataset": "d", "graph_type": "g", "hvg": 200, "seed": seed, "condition": condition, "pearson_r": x, "spearman_rho": x, "mse": x, "jaccard": x}


def test_late_and_repeated_chunks(spark, tmp_path):
    stream = arrivals.running_summary(arrivals.arriving(spark, str(tmp_path)))
    running = stream.writeStream.outputMode("complete").format("memory").queryName("arrived").option("checkpointLocation", new_folder(spark, "stream")).start()
    try:
        for i, chunk in enumerate([[fold("A", 0.25), fold("B", 0.75)], [fold("B", 9.0), fold("A", 0.5, 43)]]):
            (tmp_path / f"c{i}.json").write_text("\n".join(map(json.dumps, chunk)))
            running.processAllAvailable()
        assert [(r["n_folds"], r["pearson_mean"]) for r in spark.sql("SELECT * FROM arrived").collect()] == [(3, 0.5)]
    finally:
        running.stop()
