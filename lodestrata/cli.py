"""``python -m lodestrata.cli COMMAND IN OUT [--force] [--config FILE]``: the experiments over a folder of tables.

| command | what it writes below OUT |
|---|---|
| prepare_data | the stages of ``lodestrata.plans.pipeline`` |
| train | the summed perceptron: parameters, threshold, metrics |
| train_baselines | boosted trees and the sequence models: thresholds and metrics |
| run_imbalanced, run_ablation, run_cve, run_leakage_check | one table each |
| predict | a record for every scored function |
| reproduce | all of these; what fails is recorded in OUT/failures and the rest goes on |
| any query's name | its result |

Tables that are complete are skipped unless ``--force`` is given. The exit code is 0 if nothing failed.
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata import registry
from lodestrata.config import load_config
from lodestrata.operators import artifacts, training
from lodestrata.plans import models, pipeline

TABLES = {"run_imbalanced": "imbalanced_metrics", "run_ablation": "edge_ablation", "run_cve": "holdout_summary", "run_leakage_check": "leakage_refit", "predict": "predictions"}
BASELINES = {
    "metrics": "metrics_classifier_scores", "tokens": "token_classifier_scores", "token_convolution": "token_conv_scores",
    "recurrent": "recurrent_scores", "recurrent_attention": "recurrent_attention_scores",
}


def _saved(spark: SparkSession, root: str, model: str, scored: DataFrame, parameters=None) -> DataFrame:
    path = artifacts.save_model(spark, root, model, scored, parameters)
    return spark.createDataFrame([(model, path)], "model string, path string").withColumn("threshold", F.lit(artifacts.load_threshold(spark, root, model)))


def run(spark: SparkSession, command: str, source: str, out: str, config: dict | None = None, force: bool = False) -> dict[str, str]:
    """What failed, by name; an error for an unknown command."""
    stages, queries, root = pipeline.Stages(spark, out, force), registry.queries(), f"{out}/models"
    readout = lambda: models._readout_scores(models.Corpus(spark, source), training.Settings.of_config(config or {}))

    def one(name: str) -> None:
        if name == "prepare_data":
            pipeline.prepare(spark, source, f"{out}/data", config, force)
        elif name == "train":
            stages.attempt("train", lambda: _saved(spark, root, "readout", *readout()))
        elif name == "train_baselines":
            for model, query in BASELINES.items():
                stages.attempt(f"train-{model}", lambda model=model, query=query: _saved(spark, root, model, queries[query](spark, source)))
        elif name in TABLES or name in queries:
            stages.attempt(name, lambda: queries[TABLES.get(name, name)](spark, source))
        else:
            raise ValueError(f"unknown command {name}")

    for name in ["prepare_data", "train", "train_baselines", *TABLES] if command == "reproduce" else [command]:
        one(name)
    stages.record_failures()
    return stages.failed


def main(args: list[str]) -> int:
    config = load_config(args[args.index("--config") + 1]) if "--config" in args else None
    words = [a for k, a in enumerate(args) if not a.startswith("--") and (k == 0 or args[k - 1] != "--config")]
    if len(words) != 3:
        print(__doc__)
        return 2
    failed = run(SparkSession.builder.appName(words[0]).getOrCreate(), *words, config=config, force="--force" in args)
    for name, why in failed.items():
        print(f"{name}: {why}", file=sys.stderr)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
