"""Commands: ``python -m matchloom.cli COMMAND ...``.  Faulty data end with 1 and a message, faulty arguments with 2."""

from __future__ import annotations

import argparse
import json
import sys

from .schema import RetrievalSettings, SplitSettings, TfidfSettings


def positive(text: str) -> int:
    value = int(text)
    if value <= 0:
        raise argparse.ArgumentTypeError("a positive number is needed")
    return value


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="matchloom", description=__doc__)
    out.add_argument("--cpus", type=positive, default=8)
    commands = out.add_subparsers(dest="command", required=True)

    def add(name: str, text: str, *options) -> None:
        p = commands.add_parser(name, help=text, description=text)
        for flags, settings in options:
            p.add_argument(*flags.split(), **settings)

    need = {"required": True}
    dataset, output = ("--dataset-dir", need), ("--output-dir", need)
    add("inspect", "profile the sources and the truth", dataset, ("--sample-rows", {"type": positive, "default": 1000}), ("--full", {"action": "store_true"}), ("--report", {}))
    s = SplitSettings()
    add("split", "audit the data and draw roles and samples", dataset, output, ("--split-dir", {}), ("--seed", {"type": int, "default": s.seed}), ("--development-fraction", {"type": float, "default": s.development_fraction}), *[(f"--{r}-sample-size", {"type": positive, "default": getattr(s, r)}) for r in ("train", "development", "evaluation")])
    add("index", "index the training targets", dataset, output, ("--limit-per-source", {"type": positive}))
    r = RetrievalSettings()
    add("retrieval", "evaluate candidate retrieval", dataset, output, ("--experiment-dir", need), ("--index-dir", need), *[(f"--{k.replace('_', '-')}", {"type": positive, "default": v}) for k, v in vars(r).items()])
    t = TfidfSettings()
    add("pipeline", "train, infer and grade on a fixture", ("--fixture-dir", need), output, ("--top-k", {"type": positive, "default": t.top_k}), ("--minimum-similarity", {"type": float, "default": t.minimum_similarity}), ("--threshold", {"type": float, "default": 0.5}), ("--seed", {"type": int, "default": 42}))
    add("score", "score list files", ("--truth", need), ("--predictions", need), ("--candidates", {}), ("--entities", {}), ("--source1", {}), ("--report", {}))
    add("validate", "validate output files", ("--matching", need), ("--candidate", {}), ("--test-dir", need), ("--check-ids", {"action": "store_true"}))
    add("split-demo", "the early split", dataset, output, ("--fraction", {"type": float, "default": 0.2}), ("--seed", {"type": int, "default": 42}))
    add("candidate-demo", "nearest names in a restricted pool", dataset, ("--query-rows", {"type": positive, "default": 10}), ("--targets-per-source", {"type": positive, "default": 100_000}), ("--neighbors", {"type": positive, "default": 5}))
    add("training-demo", "pair metrics on training pairs", dataset, ("--sample-rows", {"type": positive, "default": 5000}), ("--seed", {"type": int, "default": 42}))
    return out


def run(a: argparse.Namespace) -> int:
    from .operators import validate
    from .plans import workflows as w
    from .session import local_session

    spark = local_session(a.cpus)
    report = None
    if a.command == "inspect":
        report = w.inspect_dataset(spark, a.dataset_dir, None if a.full else a.sample_rows)
    elif a.command == "split":
        report = w.prepare_experiment(spark, a.dataset_dir, a.output_dir, a.split_dir, SplitSettings(a.seed, a.development_fraction, a.train_sample_size, a.development_sample_size, a.evaluation_sample_size))
    elif a.command == "index":
        report = w.build_target_index(spark, a.dataset_dir, a.output_dir, a.limit_per_source)
    elif a.command == "retrieval":
        report = w.evaluate_retrieval(spark, a.dataset_dir, a.experiment_dir, a.index_dir, a.output_dir, RetrievalSettings(a.per_channel, a.max_candidates, a.max_terms, a.max_token_documents))
    elif a.command == "pipeline":
        report = w.run_fixture(spark, a.fixture_dir, a.output_dir, TfidfSettings(a.top_k, a.minimum_similarity), a.threshold, a.seed)
    elif a.command == "score":
        report = w.score_files(spark, a.truth, a.predictions, a.candidates, a.entities, a.source1)
    elif a.command == "validate":
        errors, warnings = validate.validate(spark, a.matching, a.candidate, a.test_dir, a.check_ids)
        for text in [*(f"error: {e}" for e in errors), *(f"warning: {x}" for x in warnings)]:
            print(text)
        return int(bool(errors))
    elif a.command == "split-demo":
        w.create_split(spark, a.dataset_dir, a.output_dir, a.fraction, a.seed)
    elif a.command == "candidate-demo":
        w.candidate_demo(spark, a.dataset_dir, a.query_rows, a.targets_per_source, a.neighbors).orderBy("query", "rank").show(50, False)
    elif a.command == "training-demo":
        report = w.training_demo(spark, a.dataset_dir, a.sample_rows, a.seed)
    if report is not None:
        text = json.dumps(report, ensure_ascii=False, indent=1, default=str)
        if getattr(a, "report", None):
            from .sources.tsv import write_text

            write_text(spark, a.report, text + "\n")
        print(text)
    return 0


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        return run(args)
    except (OSError, ValueError) as e:
        print(f"{args.command} failed: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    raise SystemExit(main())
