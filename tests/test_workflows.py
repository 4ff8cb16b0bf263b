import json

import pytest

from matchloom import cli
from matchloom.plans import workflows
from matchloom.schema import SOURCE_COLUMNS, DataFormatError, RetrievalSettings, SplitSettings
from matchloom.sources import store, tsv
from matchloom.streaming import lookups


def write(path, header, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(["\t".join(header), *("\t".join(r) for r in rows)]) + "\n", encoding="utf-8")


TRUTH = ("source1_entity_id", "matched_entity_ids")


def dataset(root):
    """Two countries, with and without links, three businesses each; the first of each is legacy training."""
    s1, lists, s2, s3 = [], [], [], []
    for c in ("US", "IN"):
        for linked in (0, 1):
            for i in range(3):
                key = f"{c}{linked}{i}"
                s1.append((f"S1-{key}", f"Shop {key}", f"{i} Road {c}", c))
                lists.append((f"S1-{key}", f"S{2 + i % 2}-{key}" if linked else ""))
                if linked:
                    (s2, s3)[i % 2].append((f"S{2 + i % 2}-{key}", f"SHOP  {key}" if i else "Other", f"{i} Road {c}", c))
    write(root / "train/train_source1.tsv", SOURCE_COLUMNS, s1)
    write(root / "train/train_ground_truth.tsv", TRUTH, lists)
    write(root / "train/train_source2.tsv", SOURCE_COLUMNS, s2)
    write(root / "train/train_source3.tsv", SOURCE_COLUMNS, s3)
    first = lambda rows, yes: [r for r in rows if r[0].endswith("0") == yes]
    write(root / "train/train_source1_sampled.tsv", SOURCE_COLUMNS, first(s1, True))
    write(root / "train/train_ground_truth_sampled.tsv", TRUTH, first(lists, True))
    write(root / "val/val_source1.tsv", SOURCE_COLUMNS, first(s1, False))
    write(root / "val/val_ground_truth.tsv", TRUTH, first(lists, False))
    return root


SMALL = SplitSettings(train=4, development=4, evaluation=4)


def test_experiment_index_and_retrieval(spark, tmp_path):
    data = dataset(tmp_path / "data")
    manifest = workflows.prepare_experiment(spark, str(data), str(tmp_path / "exp"), settings=SMALL)
    assert {k: v["rows"] for k, v in manifest["files"].items()} == {f"{p}{r}_ids.tsv": 4 for r in ("train", "development", "evaluation") for p in ("", "sample_")}
    ids = [(tmp_path / "exp" / f"{r}_ids.tsv").read_text().split()[1:] for r in ("train", "development", "evaluation")]
    assert len({i for part in ids for i in part}) == 12 and all(part == sorted(part) for part in ids)
    assert json.loads((tmp_path / "exp/audit.json").read_text())["status"] == "pass"
    with pytest.raises(FileExistsError):
        workflows.prepare_experiment(spark, str(data), str(tmp_path / "exp"), settings=SMALL)

    told = []
    meta = workflows.build_target_index(spark, str(data), str(tmp_path / "index"), progress=told.append)
    assert told[-1] == "6 targets indexed"
    assert meta["statistics"]["targets"] == 6
    report = workflows.evaluate_retrieval(spark, str(data), str(tmp_path / "exp"), str(tmp_path / "index"), str(tmp_path / "out"), timed=2, progress=told.append)
    took = report["latency_seconds"]
    assert took["queries"] == 2 and 0 < took["mean"] <= took["p95"] <= took["maximum"] <= took["total"]
    assert told[-1] == "report written" and sum(x.startswith("query S1-") for x in told) == 2
    assert report["summaries"]["hybrid"]["queries"] == 4 and report["summaries"]["hybrid"]["pair_recall"] == 1.0
    assert sorted(p.name for p in (tmp_path / "out").glob("*.tsv")) == ["candidate_pairs.tsv", "exact_name_address_candidates.tsv", "missed_links.tsv", "name_only_candidates.tsv", "query_details.tsv", "retrieval_trace.tsv"]

    tables, _ = store.open_index(spark, str(tmp_path / "index"))
    stream = spark.readStream.schema(", ".join(f"{c} string" for c in SOURCE_COLUMNS)).option("sep", "\t").option("header", True).csv(str(data / "val/*source1.tsv"))
    hits = lookups.exact_lookup(stream, tables["records"]).writeStream.format("memory").queryName("hits").trigger(availableNow=True).start()
    hits.awaitTermination()
    assert ("S1-US11", "S3-US11", "exact_name") in {tuple(r) for r in spark.table("hits").collect()}
    lookups.retrieve_batches(stream, tables, str(tmp_path / "traces"), str(tmp_path / "cp")).awaitTermination()
    batch = workflows.retrieve.retrieve(workflows.index.prepare(tsv.read_tsv(spark, str(data / "val/val_source1.tsv"), SOURCE_COLUMNS)), tables["records"], RetrievalSettings(), tables)[1]
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "traces/batch=0")).collect())) == sorted(map(tuple, workflows.retrieve.trace(batch).collect()))


def change(data, name, f):
    path = data / name
    lines = path.read_text().split("\n")
    path.write_text("\n".join(f(lines)))


@pytest.mark.parametrize(
    "name, f, message",
    [
        ("train/train_source1.tsv", lambda x: [*x[:-1], x[1], ""], "duplicate"),
        ("train/train_source2.tsv", lambda x: [*x[:-1], x[1], ""], "target ID"),
        ("train/train_source2.tsv", lambda x: [x[0], x[1].replace("S2-", "S9-", 1), *x[2:]], "ID"),
        ("train/train_ground_truth.tsv", lambda x: x[:-2] + [""], "ground-truth coverage"),
        ("train/train_ground_truth.tsv", lambda x: [x[0], x[1] + "S2-US10", *x[2:]], "ownership"),
        ("train/train_ground_truth.tsv", lambda x: [x[0], x[1] + "S2-zz", *x[2:]], "unknown target"),
        ("val/val_source1.tsv", lambda x: x[:-2] + [""], "split"),
        ("val/val_source1.tsv", lambda x: [x[0], x[1].replace("Shop", "Chop"), *x[2:]], "split"),
        ("val/val_ground_truth.tsv", lambda x: [x[0], x[1] + "S2-US10", *x[2:]], "split ground-truth"),
    ],
)
def test_faulty_inputs_fail_the_audit(spark, tmp_path, name, f, message):
    data = dataset(tmp_path / "data")
    change(data, name, f)
    with pytest.raises(DataFormatError, match=message):
        workflows.prepare_experiment(spark, str(data), str(tmp_path / "exp"), settings=SMALL)
    assert json.loads((tmp_path / "exp/audit.json").read_text())["status"] == "fail"
    assert [p.name for p in (tmp_path / "exp").iterdir() if not p.name.startswith(".")] == ["audit.json"]


def test_fixture_run(spark, tmp_path):
    root = tmp_path / "fx"
    rows = [("Amber Mill", "4 Oak Way"), ("Rhône Café", "9 Quai"), ("NA", "7 Lane"), ("", ""), ("Birch Tools", "12 Hill")]
    for split, mark in (("train", "a"), ("test", "b")):
        write(root / f"{split}/{split}_source1.tsv", SOURCE_COLUMNS, [(f"S1-{mark}{i}", n, a, "US") for i, (n, a) in enumerate(rows)])
        write(root / f"{split}/{split}_source2.tsv", SOURCE_COLUMNS, [(f"S2-{mark}{i}", n.upper(), a, "US") for i, (n, a) in enumerate(rows) if n])
        write(root / f"{split}/{split}_source3.tsv", SOURCE_COLUMNS, [(f"S3-{mark}{i}", n, "800 Elsewhere Street", "US") for i, (n, a) in enumerate(rows) if n])
        place = root / ("train/train_ground_truth.tsv" if split == "train" else "expected_test_matches.tsv")
        write(place, TRUTH, [(f"S1-{mark}{i}", f"S2-{mark}{i}" if n else "") for i, (n, _) in enumerate(rows)])
    report = workflows.run_fixture(spark, str(root), str(tmp_path / "out"))
    assert report["training"][1] == 4 and report["training"][0] > 0 and report["reload_difference"] <= 1e-12
    assert report["metrics"]["entities"] == 5 and report["metrics"]["macro_f05"] == 1.0 and report["candidates"]["pair_recall"] == 1.0
    lines = (tmp_path / "out/matching_results.tsv").read_text().split("\n")
    assert lines[0] == "\t".join(TRUTH) and lines[4] == "S1-b3\t" and len(lines) == 7
    # other answers change nothing but the grade
    write(root / "expected_test_matches.tsv", TRUTH, [(f"S1-b{i}", "") for i in range(5)])
    again = workflows.run_fixture(spark, str(root), str(tmp_path / "out2"))
    assert (tmp_path / "out2/matching_results.tsv").read_text() == (tmp_path / "out/matching_results.tsv").read_text()
    assert again["metrics"]["macro_f05"] < 1
    # the answers' fault leaves no output
    write(root / "expected_test_matches.tsv", TRUTH, [("S1-b0", "")])
    with pytest.raises(DataFormatError, match="coverage"):
        workflows.run_fixture(spark, str(root), str(tmp_path / "out3"))
    assert not (tmp_path / "out3").exists()


def test_demonstrations(spark, tmp_path):
    data = dataset(tmp_path / "data")
    near = workflows.candidate_demo(spark, str(data), neighbors=2).collect()
    assert len(near) == 8 * 2
    metrics = workflows.training_demo(spark, str(data))
    assert set(metrics) == {"precision", "recall", "f05"}
    workflows.create_split(spark, str(data), str(tmp_path / "split"), 0.25)
    assert len((tmp_path / "split/val/val_source1.tsv").read_text().split("\n")) == 1 + 3 + 1
    report = workflows.inspect_dataset
    with pytest.raises(FileNotFoundError):
        report(spark, str(data))


def test_validator(spark, tmp_path):
    from matchloom.operators import validate

    write(tmp_path / "t/test_source1.tsv", SOURCE_COLUMNS, [("S1-a", "", "", ""), ("S1-b", "", "", "")])
    for n in (2, 3):
        write(tmp_path / f"t/test_source{n}.tsv", SOURCE_COLUMNS, [(f"S{n}-x", "", "", "")])
    good, cands = tmp_path / "m.tsv", tmp_path / "c.tsv"
    write(good, ("Source1_Entity_ID", "matched_entity_ids"), [("S1-a", "S2-x"), ("S1-b", "")])
    write(cands, ("source1_entity_id", "candidate_entity_ids"), [("S1-a", "S2-x,S3-x"), ("S1-b", "")])
    run = lambda m=good, c=cands, check=True: validate.validate(spark, str(m), str(c), str(tmp_path / "t"), check)
    assert run() == ([], [])
    assert run(check=False)[0] == [] and len(run(check=False)[1]) == 1
    write(cands, ("source1_entity_id", "candidate_entity_ids"), [("S1-a", "S3-x"), ("S1-b", "")])
    assert run()[0] == [] and "candidates lack" in run()[1][0]
    bad = tmp_path / "bad.tsv"
    write(bad, TRUTH, [("S1-a", "S2-x,S2-x"), ("S1-a", "S1-q,S9-z,S2-nope"), ("S1-z", "")])
    text = "\n".join(run(bad)[0])
    for category in validate.CATEGORIES:
        assert category in text
    for content in ("", "a,b\n", "x\ty\n"):
        bad.write_text(content)
        assert len(run(bad)[0]) == 1
    bad.write_text("\t".join(TRUTH) + "\nS1-a\t\nno tab\n\nS1-b\t\n")
    assert len(run(bad)[0]) == 1 and "line 3" in run(bad)[0][0]
    assert "not found" in run(tmp_path / "none.tsv")[0][0]


def test_validator_of_a_file_in_many_splits(spark, tmp_path):
    from matchloom.operators import validate

    path = tmp_path / "lists.tsv"
    lines = ["\t".join(TRUTH)] + [f"S1-{i % 50:02}\tS2-{i}" for i in range(400)]
    lines[123] = "no tab here"
    lines[301] = "nor here"
    path.write_text("\n".join(lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows, errors = validate.read_lists(spark, str(path), list(TRUTH))
        assert validate.read_lines(spark, str(path)).rdd.getNumPartitions() > 8
        assert [e.split(":")[1] for e in errors] == [" malformed row (no tab) at line 124", " malformed row (no tab) at line 302"]
        want = {}
        for x in lines[1:]:
            if "\t" in x:
                want[x.split("\t")[0]] = x.split("\t")[1]
        assert {r.key: r.rest for r in validate.last_rows(rows).collect()} == want
        assert rows.count() == 398 and validate.read_ids(spark, str(path)).count() == 52
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_commands(tmp_path, capsys):
    with pytest.raises(SystemExit) as e:
        cli.main(["index"])
    assert e.value.code == 2
    with pytest.raises(SystemExit) as e:
        cli.main(["retrieval", "--help"])
    assert e.value.code == 0 and "--per-channel" in capsys.readouterr().out


def test_command_errors(spark, tmp_path, capsys):
    assert cli.main(["inspect", "--dataset-dir", str(tmp_path)]) == 1
    assert "not found" in capsys.readouterr().err
