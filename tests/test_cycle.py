"""A training cycle promotes its first model, keeps it against an equal one, and logs both."""

from wattframe import bindings as b
from wattframe.operators import ml
from wattframe.operators.cycle import training_cycle
from wattframe.sources import registry

DAY = 86_400.0


def test_two_cycles(spark, tmp_path):
    root = str(tmp_path / "models")
    telemetry = b.samples(spark, "/root/testdata/sf0.01").filter("server < 8").cache()
    args = dict(
        upstream=False, train_s=10 * DAY, eval_s=4 * DAY, block_s=4 * DAY, horizon_s=DAY, min_train=30, min_pos=3, directions=("rise",),
        learner=ml.Learner("rf", trees=2, depth=2, min_leaf=5),
    )
    first = training_cycle(spark, telemetry, b.SAMPLES, root, "v1", **args)
    assert first["status"] == "promoted" and first["champion"] == "none" and first["train_positives"] >= 3
    champion, version = registry.load_latest(spark, root)
    assert version == "v1" and champion.features
    second = training_cycle(spark, telemetry, b.SAMPLES, root, "v2", **args)
    assert second["champion"] == "v1" and second["status"] in ("promoted", "kept")
    assert registry.load_latest(spark, root)[1] == ("v2" if second["promoted"] else "v1")
    assert spark.read.json(f"{root}/metrics").count() == 2
